"""Question banks, notes and dimensions built from the given tables, the operators over them, and their SQL.

Twenty parts in a row make a bank; its last five are one case set. The SQL states each question's fields from its part, without the nesting.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import content as op
from ..operators import quality
from ..sources import dimensions
from ..sources.adapters import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


PER_BANK, ALONE = 20, 15

QUESTION = """q AS (SELECT p_partkey AS k, p_partkey // 20 AS bank, p_partkey % 20 >= 15 AS sub, CASE WHEN p_partkey % 20 >= 15 THEN 'cs-f' ELSE 'q-f' END || CAST(p_partkey % 4 + 1 AS VARCHAR) || 'c' || CAST(p_size AS VARCHAR) || '-' || CAST(p_partkey AS VARCHAR) AS id,
  CASE WHEN p_partkey % 20 >= 15 AND p_partkey % 2 = 0 THEN 'Case' ELSE p_brand || ' — ' || p_type END AS topic, CASE WHEN p_partkey % 20 < 15 AND p_partkey % 5 = 0 THEN 'descriptive' ELSE 'mcq' END AS type, p_partkey % 3 = 0 AS numerical, p_name AS stem,
  chr(CAST(65 + p_partkey % 4 AS INTEGER)) AS correct, CASE WHEN p_partkey % 20 >= 15 THEN CASE WHEN p_partkey // 20 % 6 = 0 THEN '' ELSE 'm1' END WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN '' ELSE 'm' || CAST(p_partkey % 3 AS VARCHAR) || ',m3' END AS attempts,
  CASE WHEN p_partkey % 20 >= 15 THEN '2026-02-28' WHEN p_partkey % 9 = 0 THEN '' ELSE '2026-02-28' END AS law, p_size, p_retailprice, p_brand, p_type, 'Paper ' || CAST(p_partkey // 20 % 5 AS VARCHAR) || ' — ' || CASE WHEN p_partkey // 20 % 2 = 0 THEN 'Laws & Acts' ELSE 'Accounts' END AS paper,
  CASE WHEN p_partkey // 20 % 3 = 0 THEN 'foundation' WHEN p_partkey // 20 % 3 = 1 THEN 'intermediate' END AS level, CASE WHEN p_partkey // 20 % 4 > 0 THEN 'paper-' || CAST(p_partkey // 20 % 5 AS VARCHAR) END AS paper_slug, 'chapter-' || CAST(p_partkey // 20 % 8 AS VARCHAR) AS chapter_slug, 'Ch ' || CAST(p_partkey // 20 % 8 AS VARCHAR) || ' Basics' AS chapter FROM part)"""


def _attempts(k):
    tags = F.array(F.concat(F.lit("m"), (k % 3).cast("string")), F.lit("m3"))
    return F.when(k % 11 == 0, F.lit(None).cast("array<string>")).when(k % 7 == 0, F.array().cast("array<string>")).otherwise(tags)


def banks(spark, sf_dir):
    """Banks of ``PER_BANK`` questions each, so that no bank grows with the table."""
    k = F.col("p_partkey")
    part = table(spark, sf_dir, "part").withColumns({"bank": F.floor(k / PER_BANK), "sub": k % PER_BANK >= ALONE})
    name = F.concat(F.when(F.col("sub"), "cs-f").otherwise("q-f"), k % 4 + 1, F.lit("c"), "p_size", F.lit("-"), k)
    option = lambda i: F.struct(F.lit("ABCD"[i]).alias("key"), F.concat(F.lit("₹"), F.col("p_size") + 10 * i).alias("text"), F.lit("because").alias("explanation"))
    own = {"id": name, "topic": F.when(~(F.col("sub") & (k % 2 == 0)), F.concat("p_brand", F.lit(" — "), "p_type")), "numerical": k % 3 == 0, "stem": F.col("p_name"), "options": F.array(*map(option, range(4))), "correct": F.element_at(F.array(*map(F.lit, "ABCD")), (k % 4 + 1).cast("int"))}
    sub_type = "array<struct<id:string,topic:string,type:string,numerical:boolean,stem:string,options:array<struct<key:string,text:string,explanation:string>>,correct:string>>"
    points = F.transform(F.sequence(F.lit(0), (k % 4).cast("int")), lambda i: F.struct(F.concat(F.lit("point "), i).alias("point"), F.when(i != 1, i + 1.5).alias("marks"), F.lit("ref").alias("citation")))
    single = F.struct(
        k.alias("k"), *(v.alias(c) for c, v in own.items()), F.when(k % 5 == 0, "descriptive").when(k % 5 != 1, "mcq").alias("type"), F.lit(None).cast("string").alias("case"), _attempts(k).alias("applicableAttempts"), F.when(k % 9 == 0, "").otherwise("2026-02-28").alias("lawAsOnDate"),
        F.when((k % 5 == 0) & (k % 2 == 1), (k % 7 + 1).cast("double")).alias("marks"), F.when(k % 5 == 0, points).alias("skeleton"), F.lit(None).cast(sub_type).alias("questions"),
    )
    small = F.struct(own["id"].alias("id"), own["topic"].alias("topic"), F.lit(None).cast("string").alias("type"), *(own[c].alias(c) for c in ("numerical", "stem", "options", "correct")))
    sets = part.filter("sub").groupBy("bank").agg(F.array_sort(F.collect_list(F.struct(k.alias("k"), small.alias("q")))).alias("subs"), F.min(k).alias("k"))
    tags = F.when(F.col("bank") % 6 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("m1")))
    case = F.struct(
        "k", F.concat(F.lit("case-"), "bank").alias("id"), F.lit("Case").alias("topic"), F.lit(False).alias("numerical"), F.lit(None).cast("string").alias("stem"), F.lit(None).cast("array<struct<key:string,text:string,explanation:string>>").alias("options"), F.lit(None).cast("string").alias("correct"), F.lit("case_mcq_set").alias("type"),
        F.concat(F.lit("About "), "bank").alias("case"), tags.alias("applicableAttempts"), F.lit("2026-02-28").alias("lawAsOnDate"), F.lit(None).cast("double").alias("marks"), F.lit(None).cast("array<struct<point:string,marks:double,citation:string>>").alias("skeleton"), F.col("subs.q").alias("questions"),
    )
    top = part.filter("NOT sub").select("bank", single.alias("q")).unionByName(sets.select("bank", case.alias("q")))
    bank = top.groupBy("bank").agg(F.array_sort(F.collect_list("q")).alias("questions"))
    b = F.col("bank")
    paper = F.concat(F.lit("Paper "), b % 5, F.lit(" — "), F.when(b % 2 == 0, "Laws & Acts").otherwise("Accounts"))
    return bank.select(F.concat(F.lit("bank-"), b).alias("path"), F.when(b % 3 == 0, "foundation").when(b % 3 == 1, "intermediate").alias("level"), paper.alias("paper"), F.when(b % 4 > 0, F.concat(F.lit("paper-"), b % 5)).alias("paper_slug"), F.concat(F.lit("chapter-"), b % 8).alias("chapter_slug"), F.concat(F.lit("Ch "), b % 8, F.lit(" Basics")).alias("chapter"), "questions")


def _flat(spark, sf_dir):
    held = banks(spark, sf_dir)
    return quality.flatten(held), held


def _deck(spark, sf_dir):
    flat, held = _flat(spark, sf_dir)
    return op.with_meta(op.deck(flat).join(held.drop("questions"), "path"))


@query(f"""WITH {QUESTION} SELECT 'bank-' || CAST(bank AS VARCHAR) AS path, id, topic, CASE WHEN sub THEN 'case-' || CAST(bank AS VARCHAR) END AS case_id, CASE WHEN sub THEN CAST(row_number() OVER (PARTITION BY bank, sub ORDER BY k) AS INTEGER) END AS place,
  CASE WHEN sub THEN CAST(count(*) OVER (PARTITION BY bank, sub) AS INTEGER) ELSE 1 END AS case_size, law AS law_date FROM q WHERE type = 'mcq'""")
def bank_questions(spark, sf_dir):
    return op.deck(_flat(spark, sf_dir)[0]).select("path", "id", "topic", "case_id", "place", "case_size", F.col("lawAsOnDate").alias("law_date"))


@query(f"""WITH {QUESTION} SELECT id, CAST(bank % 5 AS INTEGER) AS paper_no, CAST(bank % 8 AS INTEGER) AS chapter_no, coalesce(level = 'foundation', NULL) AND bank % 5 IN (3, 4) AS negative,
  CASE WHEN bank % 5 > 0 AND bank % 8 > 0 THEN CASE WHEN level = 'foundation' THEN 'f' ELSE 'i' END || CAST(bank % 5 AS VARCHAR) || '-ch' || CAST(bank % 8 AS VARCHAR) END AS mastery_id FROM q WHERE type = 'mcq'""")
def question_meta(spark, sf_dir):
    return _deck(spark, sf_dir).select("id", "paper_no", "chapter_no", "negative", "mastery_id")


@query(f"""WITH {QUESTION} SELECT id FROM q WHERE type = 'mcq' AND coalesce(level, 'intermediate') = 'intermediate' AND CASE WHEN paper_slug IS NOT NULL THEN paper_slug = 'paper-2' ELSE contains(regexp_replace(lower(paper), '[^a-z0-9]+', '-', 'g'), 'paper-2') END AND chapter_slug IN ('chapter-1', 'chapter-2', 'chapter-5', 'chapter-7') AND chapter_slug = 'chapter-1'
UNION ALL SELECT id FROM q WHERE type = 'mcq' AND CASE WHEN paper_slug IS NOT NULL THEN paper_slug = 'laws-acts' ELSE contains(regexp_replace(lower(paper), '[^a-z0-9]+', '-', 'g'), 'laws-acts') END""")
def scoped_questions(spark, sf_dir):
    deck = _deck(spark, sf_dir)
    return op.in_scope(deck, "intermediate", "paper-2", "chapter-1").unionByName(op.in_scope(deck, paper="laws-acts")).select("id")


@query(f"""WITH {QUESTION} SELECT id, topic FROM q WHERE type = 'mcq' AND contains(lower(topic), '— econ')""")
def questions_about(spark, sf_dir):
    return op.about(_deck(spark, sf_dir), "— Econ").select("id", "topic")


@query(f"""WITH {QUESTION} SELECT 'm1' AS attempt, count(*) AS questions FROM q WHERE type = 'mcq' AND (attempts IS NULL OR list_contains(string_split(attempts, ','), 'm1')) UNION ALL SELECT 'm3', count(*) FROM q WHERE type = 'mcq' AND (attempts IS NULL OR list_contains(string_split(attempts, ','), 'm3'))""")
def applicable_questions(spark, sf_dir):
    deck = _deck(spark, sf_dir).withColumn("attempt", F.explode(F.array(F.lit("m1"), F.lit("m3"))))
    return deck.filter(op.applicable(F.col("applicableAttempts"), F.col("attempt"))).groupBy("attempt").agg(F.count("*").alias("questions"))


@query(f"""WITH {QUESTION} SELECT id, 'About ' || CAST(bank AS VARCHAR) AS case_text, stem, 'A:₹' || CAST(p_size AS VARCHAR) || ' B:₹' || CAST(p_size + 10 AS VARCHAR) || ' C:₹' || CAST(p_size + 20 AS VARCHAR) || ' D:₹' || CAST(p_size + 30 AS VARCHAR) AS options FROM q WHERE sub
UNION ALL SELECT id, NULL, stem, 'A:₹' || CAST(p_size AS VARCHAR) || ' B:₹' || CAST(p_size + 10 AS VARCHAR) || ' C:₹' || CAST(p_size + 20 AS VARCHAR) || ' D:₹' || CAST(p_size + 30 AS VARCHAR) FROM q WHERE NOT sub""")
def blind_questions(spark, sf_dir):
    rows = quality.blind(_flat(spark, sf_dir)[0])
    return rows.withColumn("options", F.array_join(F.transform("options", lambda o: F.concat(o["key"], F.lit(":"), o["text"])), " "))


@query(f"""WITH {QUESTION}, d AS (SELECT id, k, unnest(range(0, k % 4 + 1)) AS i FROM q WHERE type = 'descriptive') SELECT id, CASE WHEN k % 2 = 1 THEN CAST(k % 7 + 1 AS DOUBLE) ELSE CAST(sum(CASE WHEN i = 1 THEN 1.0 ELSE i + 1.5 END) AS DOUBLE) END AS total_marks,
  CAST(floor(CASE WHEN k % 2 = 1 THEN k % 7 + 1 ELSE sum(CASE WHEN i = 1 THEN 1.0 ELSE i + 1.5 END) END * 1.8 + 0.5) AS BIGINT) AS minutes FROM d GROUP BY id, k""")
def written_questions(spark, sf_dir):
    return _written(spark, sf_dir).select("id", "total_marks", scalars.minutes_for(F.col("total_marks")).alias("minutes"))


def _written(spark, sf_dir):
    held = banks(spark, sf_dir)
    rows = held.select("path", "paper", F.explode("questions").alias("q")).select("path", "paper", "q.id", "q.type", "q.marks", "q.skeleton", "q.applicableAttempts")
    return op.written(rows)


@query(f"""WITH {QUESTION}, g AS (SELECT 'chapter-' || CAST(i AS VARCHAR) AS chapter_slug, 'g' || CAST(i % 3 AS VARCHAR) AS group_id FROM (SELECT unnest(range(0, 6)) AS i)) SELECT coalesce(group_id, 'ungrouped') AS group_id, count(*) AS questions, count(*) FILTER (WHERE sub) AS of_cases FROM q LEFT JOIN g USING (chapter_slug) WHERE type = 'mcq' GROUP BY 1""")
def exam_pool(spark, sf_dir):
    deck = _deck(spark, sf_dir)
    chapters = deck.select("chapter_slug").distinct().withColumn("i", F.regexp_extract("chapter_slug", r"(\d+)", 1).cast("int")).filter("i < 6")
    pool = op.exam_pool(deck, F.broadcast(chapters.select("chapter_slug", F.concat(F.lit("g"), F.col("i") % 3).alias("group_id"))))  # eight chapters
    return pool.groupBy("group_id").agg(F.count("*").alias("questions"), F.count_if(F.col("case_id").isNotNull()).alias("of_cases"))


@query(f"""WITH {QUESTION}, f AS (SELECT bank, bool_and(level = 'foundation' AND bank % 5 IN (3, 4)) AS neg, bool_and(coalesce(level, 'intermediate') = 'intermediate') AS inter FROM q WHERE type = 'mcq' GROUP BY 1)
SELECT 'bank-' || CAST(bank AS VARCHAR) AS path, CASE WHEN neg THEN 'negative' WHEN inter THEN 'intermediate' ELSE 'mixed' END AS mode FROM f""")
def deck_modes(spark, sf_dir):
    return op.deck_mode(_deck(spark, sf_dir), "path")


@query(f"""WITH {QUESTION} SELECT 'bank-' || CAST(bank AS VARCHAR) AS path, CAST(count(*) FILTER (WHERE sub OR (k % 5 NOT IN (0, 1))) AS INTEGER) AS questions FROM q GROUP BY 1""")
def deck_sizes(spark, sf_dir):
    return op.deck_size(banks(spark, sf_dir))


@query(f"""WITH {QUESTION} SELECT 'old-' || CAST(s_suppkey AS VARCHAR) AS id, s_name AS topic, CAST(NULL AS VARCHAR) AS case_id FROM supplier UNION ALL SELECT id, topic, CASE WHEN sub THEN 'case-' || CAST(bank AS VARCHAR) END FROM q WHERE type = 'mcq'""")
def all_questions(spark, sf_dir):
    legacy = table(spark, sf_dir, "supplier").select(F.concat(F.lit("old-"), "s_suppkey").alias("id"), F.col("s_name").alias("topic"))
    return op.all_questions(legacy, op.deck(_flat(spark, sf_dir)[0]).select("id", "topic", "case_id"))


@query(f"""WITH {QUESTION}, c AS (SELECT id, CAST(p_size + 10 * (k % 5) AS DOUBLE) AS value, p_size, k FROM q WHERE numerical AND type = 'mcq') SELECT id, CAST(CASE WHEN k % 5 < 4 THEN 1 ELSE 0 END AS BIGINT) AS hits, CASE WHEN k % 5 < 4 THEN chr(CAST(65 + k % 5 AS INTEGER)) END AS picked FROM c""")
def picked_options(spark, sf_dir):
    questions = op.deck(_flat(spark, sf_dir)[0]).filter("numerical")
    number = F.regexp_extract("id", r"-(\d+)$", 1).cast("long")
    computed = questions.select("id", (quality.first_number(F.col("options")[0]["text"]) + 10 * (number % 5)).alias("value"))
    return quality.pick_option(questions, computed, 0.5)


VERIFIED = f"""{QUESTION}, v AS (SELECT 'bank-' || CAST(bank AS VARCHAR) AS path, id, CASE WHEN bank % 9 = 4 THEN 'no module' WHEN k % 10 = 3 THEN 'no verifier' WHEN k % 10 = 9 THEN 'error' WHEN k % 10 = 6 AND k % 4 <> 0 THEN 'mismatch' ELSE 'ok' END AS status FROM q WHERE numerical)"""


def _verified(spark, sf_dir):
    questions = _flat(spark, sf_dir)[0]
    k = F.regexp_extract("id", r"-(\d+)$", 1).cast("long")
    computed = questions.filter("numerical").withColumn("k", k).filter("k % 10 <> 3").select("id", F.when(F.col("k") % 10 == 6, "a ").otherwise(F.lower("correct")).alias("answer"), F.when(F.col("k") % 10 == 9, "raised").alias("error"))
    modules = questions.select("path").distinct().filter(F.regexp_extract("path", r"(\d+)$", 1).cast("long") % 9 != 4)
    return quality.verify(questions, computed, modules)


@query(f"WITH {VERIFIED} SELECT * FROM v")
def verified_questions(spark, sf_dir):
    return _verified(spark, sf_dir).select("path", "id", "status")


@query(f"WITH {VERIFIED} SELECT path, count(*) AS checked, count(*) FILTER (WHERE status <> 'ok') AS failures, count(*) FILTER (WHERE status <> 'ok') = 0 AS passed FROM v GROUP BY 1")
def verify_gate(spark, sf_dir):
    bad = F.count_if(F.col("status") != "ok")
    return _verified(spark, sf_dir).groupBy("path").agg(F.count("*").alias("checked"), bad.alias("failures"), (bad == 0).alias("passed"))


@query(f"""WITH {QUESTION}, t AS (SELECT 'bank-' || CAST(bank AS VARCHAR) AS path, id, attempts, law FROM q WHERE NOT sub UNION ALL SELECT DISTINCT 'bank-' || CAST(bank AS VARCHAR), 'case-' || CAST(bank AS VARCHAR), attempts, law FROM q WHERE sub)
SELECT path, id, 'applicableAttempts' AS missing FROM t WHERE coalesce(attempts, '') = '' UNION ALL SELECT path, id, 'lawAsOnDate' FROM t WHERE law = ''""")
def tag_lint(spark, sf_dir):
    return quality.tag_violations(banks(spark, sf_dir))


@query(f"""WITH {QUESTION}, r AS (SELECT id, regexp_extract(id, '(?:^|-)f(\\d+)c\\d+', 1) AS paper FROM q WHERE k % 3 <> 0) SELECT CAST(paper AS INTEGER) AS paper, count(*) AS mistakes FROM r GROUP BY 1""")
def mistakes_by_paper(spark, sf_dir):
    mistakes = _flat(spark, sf_dir)[0].filter("NOT numerical").select(scalars.paper_of_question(F.col("id")).alias("paper"))
    return mistakes.groupBy("paper").agg(F.count("*").alias("mistakes"))


def _requests(spark, sf_dir):
    b = F.col("c_custkey") % 10
    paper = F.concat(F.lit("Paper "), b % 5, F.lit(" — "), F.when(b % 2 == 0, "Laws & Acts").otherwise("Accounts"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("request_id"), paper.alias("paper"), F.concat(F.lit("m"), F.col("c_custkey") % 4).alias("attempt"))


@query()
def composed_papers(spark, sf_dir):
    """Marks of each part and what is missing. Which questions is up to the hash; tested by the rules."""
    return op.shortfall(_requests(spark, sf_dir), composed(spark, sf_dir))


def composed(spark, sf_dir):
    return op.compose_papers(_requests(spark, sf_dir), _deck(spark, sf_dir), _written(spark, sf_dir), "seed")


# notes: documents with front matter and headings that are made of their columns

NOTE = """note AS (SELECT doc_id, 'notes/' || source || '/' || CASE WHEN doc_id % 10 = 3 THEN 'index' ELSE 'n' || CAST(doc_id AS VARCHAR) END || CASE WHEN doc_id % 10 IN (3, 4) THEN '.astro' ELSE '.mdx' END AS path,
  '---' || chr(10) || 'title: ''Note ' || CAST(doc_id AS VARCHAR) || '''' || chr(10) || CASE doc_id % 3 WHEN 0 THEN 'applicable_attempts :' || chr(10) || '  - May' WHEN 1 THEN 'applicable_attempts: [May]' ELSE 'applicable_attempts:' END || chr(10) || 'law_as_on_date:' || CASE WHEN doc_id % 4 = 0 THEN '' ELSE ' 2026-02-28' END || chr(10) || '---' || chr(10)
  || '## **On** `' || lang || '` <b>law</b> a_b' || chr(10) || 'text' || chr(10) || '## # deeper' || chr(10) || '##  One * two  ' || chr(10) || '| a | ' || lang || chr(10) || '|---|:-:|' || chr(10) || '| 1 | 2 |' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN '## One-page revision summary' WHEN doc_id % 5 = 1 THEN '## Chapter at a glance' ELSE '## End' END || chr(10) || 'sum ' || CAST(n_chars AS VARCHAR) || chr(10) AS text, lang, n_chars FROM documents)"""


def notes(spark, sf_dir):
    k, nl = F.col("doc_id"), F.lit("\n")
    path = F.concat(F.lit("notes/"), "source", F.lit("/"), F.when(k % 10 == 3, "index").otherwise(F.concat(F.lit("n"), k)), F.when((k % 10).isin(3, 4), ".astro").otherwise(".mdx"))
    tags = F.when(k % 3 == 0, "applicable_attempts :\n  - May").when(k % 3 == 1, "applicable_attempts: [May]").otherwise("applicable_attempts:")
    front = F.concat(F.lit("---\ntitle: 'Note "), k, F.lit("'\n"), tags, F.lit("\nlaw_as_on_date:"), F.when(k % 4 == 0, "").otherwise(" 2026-02-28"), F.lit("\n---\n"))
    head = F.when(k % 2 == 0, "## One-page revision summary").when(k % 5 == 1, "## Chapter at a glance").otherwise("## End")
    body = F.concat(F.lit("## **On** `"), "lang", F.lit("` <b>law</b> a_b\ntext\n## # deeper\n##  One * two  \n| a | "), "lang", F.lit("\n|---|:-:|\n| 1 | 2 |\n"), head, F.lit("\nsum "), "n_chars", nl)
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), F.concat(front, body).alias("text"), "lang", "n_chars")


@query(f"""WITH {NOTE} SELECT doc_id, CAST(0 AS INTEGER) AS "at", 'On ' || lang || ' law a_b' AS heading FROM note UNION ALL SELECT doc_id, CAST(1 AS INTEGER), 'One * two' FROM note
UNION ALL SELECT doc_id, CAST(2 AS INTEGER), CASE WHEN doc_id % 2 = 0 THEN 'One-page revision summary' WHEN doc_id % 5 = 1 THEN 'Chapter at a glance' ELSE 'End' END FROM note""")
def headings(spark, sf_dir):
    return quality.headings(notes(spark, sf_dir), "doc_id", "text")


@query(f"""WITH {NOTE} SELECT path, 'applicable_attempts' AS missing FROM note WHERE path LIKE '%.mdx' AND doc_id % 3 = 2 UNION ALL SELECT path, 'law_as_on_date' FROM note WHERE path LIKE '%.mdx' AND doc_id % 4 = 0 UNION ALL SELECT path, 'not a note' FROM note WHERE doc_id % 10 = 4""")
def note_lint(spark, sf_dir):
    return quality.note_violations(notes(spark, sf_dir))


@query(f"""WITH {NOTE} SELECT doc_id, 'Note ' || CAST(doc_id AS VARCHAR) AS title, CASE WHEN doc_id % 2 = 0 THEN 'summary' WHEN doc_id % 5 = 1 THEN 'fallback' END AS found, CASE WHEN doc_id % 2 = 0 OR doc_id % 5 = 1 THEN 'sum ' || CAST(n_chars AS VARCHAR) END AS summary, 'a/' || lang || ' 1/2' AS cells FROM note""")
def note_parts(spark, sf_dir):
    """Title, summary section and cells of the tables of each note."""
    text = F.col("text")
    part = scalars.section(text, "One-page revision summary", "(?:at a glance|quick recap)")
    cells = F.array_join(F.transform(scalars.table_rows(text), lambda row: F.array_join(row, "/")), " ")
    return notes(spark, sf_dir).select("doc_id", scalars.front_value(scalars.frontmatter(text), "title").alias("title"), part["found"].alias("found"), F.trim(F.regexp_replace(part["body"], r"\s+$", "")).alias("summary"), cells.alias("cells"))


@query("""WITH f AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 7 = 0 THEN 'data/questions/b.json' ELSE 'data/f' || CAST(s_suppkey AS VARCHAR) || '.js' END AS path FROM supplier)
SELECT path, CASE k % 3 WHEN 0 THEN 'lastChecked: ''3 Jul 2026'', x' WHEN 1 THEN 'last_checked: 2026-07-03 # y' ELSE 'lastChecked = soon' END AS stamped, CASE WHEN k % 3 < 2 THEN 1 ELSE 0 END AS dates, k % 3 = 2 AS drift FROM f WHERE k % 7 <> 0""")
def stamped_files(spark, sf_dir):
    k = F.col("s_suppkey")
    text = F.when(k % 3 == 0, "lastChecked: '1 Jan 2026', x").when(k % 3 == 1, "last_checked: 2026-01-01 # y").otherwise("lastChecked = soon")
    files = table(spark, sf_dir, "supplier").select(F.when(k % 7 == 0, "data/questions/b.json").otherwise(F.concat(F.lit("data/f"), k, F.lit(".js"))).alias("path"), text.alias("text"))
    return quality.stamp_dates(files, "2026-07-03").select("path", "stamped", "dates", "drift")


# dimensions: sittings are nations, papers regions, changes of the law suppliers

SITTING = "sit AS (SELECT n_nationkey AS sitting, DATE '2026-01-01' + CAST(n_nationkey * 11 AS INTEGER) AS cutoff, n_nationkey % 3 = 0 AS verified FROM nation)"


def _sittings(spark, sf_dir):
    k = F.col("n_nationkey")
    verify = F.when(k % 3 == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), (k % 3).cast("int")), lambda i: i.cast("string")))
    return table(spark, sf_dir, "nation").select(k.alias("sitting"), F.date_add(F.lit("2026-01-01").cast("date"), k * 11).alias("cutoff"), (k % 3 == 0).alias("verified"), verify.alias("verify"))


@query(f"""WITH {SITTING}, n AS (SELECT sitting, cutoff FROM sit WHERE cutoff > DATE '2026-05-01' ORDER BY cutoff LIMIT 1) SELECT c_custkey AS learner_id, coalesce(o.sitting, n.sitting) AS sitting, coalesce(o.cutoff, n.cutoff) AS cutoff
FROM customer, n LEFT JOIN (SELECT * FROM sit WHERE cutoff > DATE '2026-05-01') o ON o.sitting = c_nationkey""")
def next_cutoff(spark, sf_dir):
    chosen = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("learner_id"), F.col("c_nationkey").alias("sitting"))
    return op.next_cutoff(_sittings(spark, sf_dir), chosen, F.lit("2026-05-01").cast("date"))


@query(f"WITH {SITTING} SELECT sitting, CAST(sitting % 3 + 1 AS INTEGER) AS open FROM sit WHERE NOT verified")
def unverified_sittings(spark, sf_dir):
    return op.unverified(_sittings(spark, sf_dir))


CHANGE = "chg AS (SELECT s_suppkey AS amendment_id, s_nationkey AS paper, DATE '2026-01-01' + CAST(s_suppkey % 300 AS INTEGER) AS applies_from, s_suppkey % 4 AS n FROM supplier)"


def _changes(spark, sf_dir):
    k = F.col("s_suppkey")
    affected = F.when(k % 4 > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), (k % 4).cast("int"))), lambda i: F.concat(F.lit("ch"), i)))
    return table(spark, sf_dir, "supplier").select(k.alias("amendment_id"), F.col("s_nationkey").alias("paper"), F.date_add(F.lit("2026-01-01").cast("date"), (k % 300).cast("int")).alias("applies_from"), affected.alias("affected"))


@query(f"""WITH {CHANGE}, c AS (SELECT chg.*, i FROM chg LEFT JOIN (SELECT unnest(range(1, 4)) AS i) q ON i <= n) SELECT amendment_id, paper, applies_from, CASE WHEN i IS NOT NULL THEN 'ch' || CAST(i AS VARCHAR) END AS chapter FROM c WHERE paper IN (SELECT n_nationkey FROM nation WHERE n_nationkey % 4 < 3)""")
def volatile_amendments(spark, sf_dir):
    """Changes of volatile papers only."""
    volatile = table(spark, sf_dir, "nation").filter("n_nationkey % 4 < 3").select(F.col("n_nationkey").alias("paper"))
    return op.amendments_of(_changes(spark, sf_dir), volatile)


@query(f"WITH {CHANGE}, {SITTING} SELECT sitting, amendment_id FROM chg JOIN sit ON applies_from <= cutoff")
def applicable_changes(spark, sf_dir):
    return op.upto_cutoff(_changes(spark, sf_dir), _sittings(spark, sf_dir))


LOADS = """loads AS (SELECT make_date(CAST(year(o_orderdate) AS BIGINT), CAST(CASE WHEN month(o_orderdate) < 7 THEN 1 ELSE 7 END AS BIGINT), 1) AS loaded, o_custkey % 200 AS topic, count(*) % 3 AS weight, min(o_orderpriority) AS label FROM orders GROUP BY 1, 2),
dates AS (SELECT loaded, lead(loaded) OVER (ORDER BY loaded) AS nxt FROM (SELECT DISTINCT loaded FROM loads)),
marks AS (SELECT loads.*, nxt, CASE WHEN lag(weight) OVER w IS NOT DISTINCT FROM weight AND lag(label) OVER w IS NOT DISTINCT FROM label AND lag(nxt) OVER w IS NOT DISTINCT FROM loaded THEN 0 ELSE 1 END AS begins FROM loads JOIN dates USING (loaded) WINDOW w AS (PARTITION BY topic ORDER BY loaded)),
runs AS (SELECT *, sum(begins) OVER (PARTITION BY topic ORDER BY loaded) AS version FROM marks),
ver AS (SELECT topic, min(weight) AS weight, min(label) AS label, min(loaded) AS valid_from, CASE WHEN bool_or(nxt IS NULL) THEN NULL ELSE max(nxt) END AS valid_to FROM runs GROUP BY topic, version)"""


def _loads(spark, sf_dir):
    """Half-yearly snapshots of topics with a weight and a label, as the half-year's orders give them; a topic without orders isn't in the load."""
    orders = table(spark, sf_dir, "orders")
    half = F.make_date(F.year("o_orderdate"), F.when(F.month("o_orderdate") < 7, 1).otherwise(7), F.lit(1))
    return orders.groupBy(half.alias("loaded"), (F.col("o_custkey") % 200).alias("topic")).agg((F.count("*") % 3).alias("weight"), F.min("o_orderpriority").alias("label"))


@query(f"WITH {LOADS} SELECT topic, weight, label, valid_from, valid_to FROM ver")
def dimension_versions(spark, sf_dir):
    return dimensions.versions(_loads(spark, sf_dir), ["topic"], "loaded").select("topic", "weight", "label", "valid_from", "valid_to")


@query(f"""WITH {LOADS}, f AS (SELECT c_custkey % 200 AS topic, DATE '1994-06-01' + CAST(c_custkey * 37 % 3000 AS INTEGER) AS date FROM customer)
SELECT weight, label, count(*) AS facts FROM f LEFT JOIN ver ON ver.topic = f.topic AND date >= valid_from AND coalesce(date < valid_to, true) GROUP BY 1, 2""")
def weights_as_of(spark, sf_dir):
    """Facts by the weight and label that their topic had on their date."""
    facts = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 200).alias("topic"), F.date_add(F.lit("1994-06-01").cast("date"), (F.col("c_custkey") * 37 % 3000).cast("int")).alias("date"))
    held = dimensions.versions(_loads(spark, sf_dir), ["topic"], "loaded")
    return dimensions.as_of(facts, held, ["topic"], "date").groupBy("weight", "label").agg(F.count("*").alias("facts"))


@query("""WITH r AS (SELECT c_mktsegment AS scheme, c_nationkey AS ord, round(100.0 * count(*) FILTER (WHERE c_acctbal > 4500) / count(*), 2) AS pct, CASE WHEN c_nationkey % 3 = 0 THEN count(*) END AS appeared FROM customer GROUP BY 1, 2)
SELECT scheme, min(pct) AS lo, max(pct) AS hi, max_by(pct, ord) AS latest, count(*) AS sittings, count(appeared) AS with_counts FROM r GROUP BY 1""")
def pass_rates(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    rates = c.groupBy(F.col("c_mktsegment").alias("scheme"), F.col("c_nationkey").alias("ord")).agg(F.round(100.0 * F.count_if(F.col("c_acctbal") > 4500) / F.count("*"), 2).alias("pct"), F.when(F.first("c_nationkey") % 3 == 0, F.count("*")).alias("appeared"))
    return op.pass_rates(rates)


@query("""WITH c AS (SELECT s_nationkey AS paper, count(*) AS chapters FROM supplier GROUP BY 1), w AS (SELECT n_nationkey AS paper, count(*) AS groups, CAST(sum(k * 5) AS BIGINT) AS lo, CAST(sum(k * 5 + n_nationkey % 4) AS BIGINT) AS hi FROM nation, (SELECT unnest([1, 2, 3]) AS k) q WHERE n_nationkey % 5 > 0 GROUP BY 1),
r AS (SELECT c_nationkey AS paper, count(*) AS links, count(*) FILTER (WHERE c_acctbal < 0) AS behind_login, min(DATE '2026-01-01' + CAST(c_custkey % 100 AS INTEGER)) AS oldest_check FROM customer WHERE c_custkey % 3 = 0 GROUP BY 1)
SELECT n_nationkey AS paper, coalesce(chapters, 0) AS chapters, coalesce(groups, 0) AS groups, coalesce(links, 0) AS links, coalesce(behind_login, 0) AS behind_login, oldest_check, CASE WHEN lo = hi THEN CAST(lo AS VARCHAR) || '%' WHEN lo < hi THEN CAST(lo AS VARCHAR) || '–' || CAST(hi AS VARCHAR) || '%' END AS label
FROM nation LEFT JOIN c ON c.paper = n_nationkey LEFT JOIN w ON w.paper = n_nationkey LEFT JOIN r ON r.paper = n_nationkey""")
def paper_hub(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    papers = nation.select(F.col("n_nationkey").alias("paper"))
    chapters = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("paper"))
    weights = papers.filter("paper % 5 > 0").select("paper", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("k")).select("paper", (F.col("k") * 5).alias("lo"), (F.col("k") * 5 + F.col("paper") % 4).alias("hi"))
    links = table(spark, sf_dir, "customer").filter("c_custkey % 3 = 0").select(F.col("c_nationkey").alias("paper"), (F.col("c_acctbal") < 0).alias("requires_login"), F.date_add(F.lit("2026-01-01").cast("date"), (F.col("c_custkey") % 100).cast("int")).alias("last_checked"))
    return op.paper_hub(papers, chapters, weights, links).withColumn("label", scalars.weight_label(F.col("lo"), F.col("hi"))).drop("lo", "hi")


@query(f"""WITH {QUESTION} SELECT chapter_slug, CAST(count(DISTINCT p_type) AS INTEGER) AS themes, CAST(count(DISTINCT p_brand) AS INTEGER) AS topics FROM q WHERE NOT sub AND type = 'mcq' GROUP BY 1""")
def chapter_topics(spark, sf_dir):
    """Distinct first and second parts of the topics of a chapter."""
    rows = _deck(spark, sf_dir).filter("case_id IS NULL").withColumn("parts", F.split("topic", " — "))
    return rows.groupBy("chapter_slug").agg(F.size(F.collect_set(F.col("parts")[1])).alias("themes"), F.size(F.collect_set(F.col("parts")[0])).alias("topics"))
