"""Content-quality gates over question banks and notes. Every gate yields rows with a status, and a one-row verdict on top."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import frontmatter, has_value, plain_text


def flatten(banks: DataFrame) -> DataFrame:
    """Questions of nested banks, case sets taken apart: a case's questions take over its topic and tags, and know their case, place and
    its size. ``banks`` has ``questions``, an array of structs with perhaps nested ``questions``."""
    top = banks.select("path", F.posexplode("questions").alias("at", "q"))
    alone = top.filter(F.coalesce(F.size("q.questions"), F.lit(0)) <= 0).select(
        "path", "at", F.lit(0).alias("sub"), "q.id", "q.topic", F.coalesce("q.type", F.lit("mcq")).alias("type"), F.coalesce("q.numerical", F.lit(False)).alias("numerical"), "q.stem", "q.options", "q.correct", "q.applicableAttempts", "q.lawAsOnDate", F.lit(None).cast("string").alias("case_id"), F.lit(None).cast("string").alias("case_text"), F.lit(1).alias("case_size")
    )
    subs = top.filter(F.size("q.questions") > 0).select("path", "at", F.col("q").alias("c"), F.posexplode("q.questions").alias("sub", "q"))
    of_case = subs.select(
        "path", "at", "sub", "q.id", F.coalesce("q.topic", "c.topic").alias("topic"), F.coalesce("q.type", F.lit("mcq")).alias("type"), F.coalesce("q.numerical", F.lit(False)).alias("numerical"), "q.stem", "q.options", "q.correct", "c.applicableAttempts", "c.lawAsOnDate", F.col("c.id").alias("case_id"), F.col("c.case").alias("case_text"), F.size("c.questions").alias("case_size")
    )
    return alone.unionByName(of_case)


def blind(questions: DataFrame) -> DataFrame:
    """What a second answerer may see: case, stem, option keys and texts; neither the key nor the explanations."""
    return questions.select("id", "case_text", "stem", F.transform("options", lambda o: F.struct(o["key"].alias("key"), o["text"].alias("text"))).alias("options"))


def compare_answers(keys: DataFrame, fresh: DataFrame, key: str, ours: str, theirs: str) -> DataFrame:
    """Status of each key: agreed, mismatch or unanswered, regardless of case and blanks."""
    plain = lambda c: F.upper(F.trim(F.col(c).cast("string")))
    rows = keys.join(fresh, key, "left")
    answered = F.coalesce(plain(theirs), F.lit("")) != ""
    return rows.withColumn("status", F.when(~answered, "unanswered").when(plain(ours) == plain(theirs), "agreed").otherwise("mismatch"))


def consistency_gate(compared: DataFrame, allow_missing: bool = False) -> DataFrame:
    """Counts and exit status: 1 with a mismatch, 2 with unanswered rows unless they are allowed, else 0."""
    n = lambda s: F.count_if(F.col("status") == s)
    code = F.when(n("mismatch") > 0, 1).when((n("unanswered") > 0) & ~F.lit(allow_missing), 2).otherwise(0)
    return compared.agg(n("agreed").alias("agreed"), n("mismatch").alias("mismatch"), n("unanswered").alias("unanswered"), code.alias("code"))


def pick_option(questions: DataFrame, computed: DataFrame, tolerance: float) -> DataFrame:
    """The one option whose number lies within the tolerance of the computed value: null ``picked`` with no or several such options."""
    rows = questions.join(computed, "id").select("id", "value", F.explode("options").alias("o"))
    near = F.abs(first_number(F.col("o.text")) - F.col("value")) <= tolerance
    hits = rows.groupBy("id").agg(F.count_if(near).alias("hits"), F.max(F.when(near, F.col("o.key"))).alias("key"))
    return hits.select("id", "hits", F.when(F.col("hits") == 1, F.col("key")).alias("picked"))


def first_number(text: Column) -> Column:
    """First number of a text, without currency signs, thousands' commas and per-cent signs; null without one."""
    return F.nullif(F.regexp_extract(F.regexp_replace(text, "[,₹$%]", ""), r"-?\d+(\.\d+)?", 0), F.lit("")).cast("double")


def verify(questions: DataFrame, computed: DataFrame, modules: DataFrame | None = None) -> DataFrame:
    """Status of each numerical question: ok, mismatch, error, no verifier, or no module where its bank has none at all. ``computed`` has id, answer, error;
    ``modules`` lists the ``path`` of banks that have verifiers."""
    rows = questions.filter("numerical").join(computed.select("id", "answer", "error", F.lit(True).alias("_has")), "id", "left")
    status = F.when(F.col("_has").isNull(), "no verifier").when(F.col("error").isNotNull(), "error").when(F.upper(F.trim("answer")) == F.upper(F.trim("correct")), "ok").otherwise("mismatch")
    if modules is not None:
        rows = rows.join(modules.select("path", F.lit(True).alias("_module")).distinct(), "path", "left")
        status = F.when(F.col("_module").isNull(), "no module").otherwise(status)
    return rows.withColumn("status", status).drop("_has", "_module")


def gate(rows: DataFrame, good: str) -> DataFrame:
    return rows.agg(F.count("*").alias("checked"), F.count_if(F.col("status") != good).alias("failures"), (F.count_if(F.col("status") != good) == 0).alias("passed"))


def tag_violations(banks: DataFrame) -> DataFrame:
    """Top-level entries of banks that lack their sittings or the date of their law; a row per missing tag."""
    top = banks.select("path", F.explode("questions").alias("q"))
    missing = F.array(F.when(F.coalesce(F.size("q.applicableAttempts"), F.lit(0)) <= 0, "applicableAttempts"), F.when(F.coalesce(F.trim("q.lawAsOnDate"), F.lit("")) == "", "lawAsOnDate"))
    return top.select("path", "q.id", F.explode(F.filter(missing, lambda m: m.isNotNull())).alias("missing"))


def vacuous(expected: DataFrame, checked: DataFrame, content: DataFrame, key: str) -> DataFrame:
    """Keys that have content somewhere but of which nothing was checked."""
    return expected.join(checked, key, "left_anti").join(content, key, "left_semi")


def headings(notes: DataFrame, key: str, text: str) -> DataFrame:
    """Second-level headings of each note in order, inline marks stripped. Deeper headings after a second pair of marks are none."""
    found = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"(?m)^##[ \t]+(.+?)[ \t\r]*$"), F.lit(1))
    return notes.select(key, F.posexplode(F.filter(found, lambda h: ~h.startswith("#"))).alias("at", "heading")).withColumn("heading", plain_text(F.col("heading")))


def note_violations(notes: DataFrame, keys: tuple[str, ...] = ("applicable_attempts", "law_as_on_date"), free: tuple[str, ...] = ("index", "amendments", "weightage")) -> DataFrame:
    """Notes of volatile papers that lack a tag in their front matter, a row per missing one, and pages that should be notes (``not a note``). ``notes`` has path, text."""
    stem, kind = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1), F.regexp_extract("path", r"\.([^./]+)$", 1)
    front = frontmatter(F.coalesce("text", F.lit("")))
    missing = F.array(*(F.when((kind == "mdx") & ~has_value(front, k), k) for k in keys), F.when((kind == "astro") & ~stem.isin(*free), "not a note"))
    return notes.select("path", F.explode(F.filter(missing, lambda m: m.isNotNull())).alias("missing"))


#: What a date that is stamped looks like, by kind of file, and the names that must not be there without one.
STAMPS = {"js": (r"(lastChecked:\s*')[^']*(')", r"(LAST_CHECKED\s*=\s*')[^']*(')"), "json": (r'("lastChecked":\s*")[^"]*(")',), "yaml": (r"(last_checked:\s*)[^\s#]+()",)}
MENTIONS = "lastChecked|last_checked|LAST_CHECKED"


def stamp_dates(files: DataFrame, date: str, green: Column | None = None) -> DataFrame:
    """Files with their checked dates set to ``date`` (ISO): ``stamped`` text, number of ``dates`` and ``drift`` where dates are mentioned in no known form. Nothing is
    stamped unless the sweep is ``green``; question banks are left out. ``files`` has path, text."""
    day = F.lit(date).cast("date")
    human, iso, text, hits = F.date_format(day, "d MMM yyyy"), F.date_format(day, "yyyy-MM-dd"), F.col("text"), F.lit(0)
    for kind, patterns in STAMPS.items():
        for p in patterns:
            hits = hits + F.regexp_count("text", F.lit(p))
            text = F.regexp_replace(text, F.lit(p), F.concat(F.lit("$1"), iso if kind == "yaml" else human, F.lit("$2")))
    rows = files.filter(~F.col("path").contains("/questions/")).withColumns({"dates": hits, "drift": (hits == 0) & F.col("text").rlike(MENTIONS)})
    return rows.withColumn("stamped", F.when(green if green is not None else F.lit(True), text).otherwise(F.col("text")))


def not_exactly_one(members: DataFrame, member: str, group: str, all_members: DataFrame | None = None) -> DataFrame:
    """Members that belong to several groups, and those of ``all_members`` that belong to none."""
    counts = members.groupBy(member).agg(F.count_distinct(group).alias("groups"))
    if all_members is not None:
        counts = all_members.select(member).distinct().join(counts, member, "left").fillna(0, ["groups"])
    return counts.filter("groups <> 1")


def unresolved(references: DataFrame, known: DataFrame, slug: str, *of: str) -> DataFrame:
    """References (``of`` and the slug) to what isn't known, each once; a null slug resolves to nothing."""
    return references.select(*of, slug).distinct().join(known.select(slug).distinct(), slug, "left_anti").select(*of, slug)
