"""Column functions: dates, labels, numbers in texts, classifications."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# How papers, chapters and the ids of questions are written in the data.
PAPER_NUMBER = r"(?i)Paper\s*(\d)"
CHAPTER_NUMBER = r"(?i)Ch\s*(\d+)"
QUESTION_PAPER = r"(?:^|-)f(\d+)c\d+"
CHAPTER_SEGMENT = r"^Ch(apter)?\s*\d+$"


def half_up_whole(x: Column) -> Column:
    """Nearest whole number, halves towards plus infinity."""
    return F.floor(x + 0.5)


def human_date(text: Column) -> Column:
    """A date written as ``3 July 2026`` (or Jul; September as Sep or Sept) or in ISO form; null otherwise."""
    plain = F.regexp_replace(F.trim(text), r"\b(Jun|Jul|Sep)[elty]\b", "$1")
    return F.coalesce(F.try_to_date(plain, "d MMM yyyy"), F.try_to_date(plain, "yyyy-MM-dd"))


def human_label(date: Column) -> Column:
    """A date as ``3 July 2026``: names of months of more than four letters are cut to three, September to Sept."""
    return F.regexp_replace(F.regexp_replace(F.date_format(date, "d MMMM yyyy"), "September", "Sept"), r"([A-Z][a-z]{2})[a-z]{2,}", "$1").cast("string")


def month_label(date: Column) -> Column:
    return F.date_format(date, "MMMM yyyy")


def topic_list(topics: Column) -> Column:
    """The themes of a chapter: each topic's first segment, or where that gives fewer than three themes its last one; each once, in the order of the topics."""
    segments = F.filter(F.transform(topics, topic_segments), lambda s: F.size(s) > 0)
    of = lambda at: F.array_distinct(F.transform(segments, lambda s: F.element_at(s, at)))
    return F.when(F.size(of(1)) >= 3, of(1)).otherwise(of(-1))


def days_to_exam(exam: Column, now: Column, zone: str = "Asia/Kolkata") -> Column:
    """Whole days, rounded up, until the end of the exam's day in its zone. ``now`` is a timestamp."""
    end = F.to_utc_timestamp(F.to_timestamp(F.concat(F.date_format(exam, "yyyy-MM-dd"), F.lit(" 23:59:59"))), zone)
    return F.ceil((F.unix_millis(end) - F.unix_millis(now)) / 86_400_000.0)


def bill_due(start: Column, months: Column, days: Column, on_demand: Column) -> Column:
    """Due date of a bill: months are clamped at their end, then days, then three days of grace unless it is payable on demand."""
    return F.date_add(F.add_months(start, months), days + F.when(on_demand, 0).otherwise(3))


def topic_prefix(topic: Column) -> Column:
    return F.lower(F.trim(F.split(topic, r"[—–:|\-]")[0]))


def topic_segments(topic: Column) -> Column:
    """Parts of a topic between middle dots, without a leading chapter number."""
    parts = F.transform(F.split(topic, "·"), lambda x: F.trim(x))
    return F.filter(parts, lambda x: (x != "") & ~x.rlike(CHAPTER_SEGMENT))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-")


def weight_label(lo: Column, hi: Column) -> Column:
    return F.when(lo == hi, F.concat(lo.cast("string"), F.lit("%"))).otherwise(F.concat(lo.cast("string"), F.lit("–"), hi.cast("string"), F.lit("%")))


def expected_value(live: Column) -> Column:
    """Expected marks of a guess among ``live`` options: one mark, or a quarter lost."""
    return (1 + (live - 1) * -0.25) / live


def relation(holding: Column) -> Column:
    """Subsidiary above half of the shares, associate from a fifth on."""
    return F.when(holding > 50, "subsidiary").when(holding >= 20, "associate").otherwise("none")


def is_small(capital: Column, turnover: Column, public: Column, most_capital: float = 4e7, most_turnover: float = 4e8) -> Column:
    """Small company: private, and within both limits, which are included."""
    return ~public & (capital <= most_capital) & (turnover <= most_turnover)


def band(value: Column, bands: tuple[tuple[float, str], ...], lowest: str) -> Column:
    """Label of the highest band whose lower bound the value exceeds."""
    out = F.lit(lowest)
    for bound, label in sorted(bands):
        out = F.when(value > bound, label).otherwise(out)
    return out


def frontmatter(text: Column) -> Column:
    return F.regexp_extract(text, r"(?s)\A---\r?\n(.*?)\r?\n---", 1)


def front_value(front: Column, name: str) -> Column:
    """Value of a flat key of the front matter, without quotes; null where it is missing or empty. Blanks may stand before the colon."""
    found = F.trim(F.regexp_extract(front, rf"(?m)^{name}[ \t]*:[ \t]*(.+)$", 1))
    return F.nullif(F.regexp_replace(found, "^['\"]|['\"]$", ""), F.lit(""))


def has_value(front: Column, name: str) -> Column:
    """Whether a key of the front matter has a value on its line or indented below it."""
    return front.rlike(rf"(?m)^{name}[ \t]*:[ \t]*\S") | front.rlike(rf"(?m)^{name}[ \t]*:[ \t]*\r?\n(?:[ \t]*\r?\n)*[ \t]+\S")


def plain_text(text: Column) -> Column:
    """Without tags and without the marks of emphasis and code around what they mark; a lone mark or an underscore stays."""
    text = F.regexp_replace(text, "<[^>]+>", "")
    for mark in (r"\*\*([^*]+)\*\*", r"\*([^*]+)\*", r"`([^`]+)`"):
        text = F.regexp_replace(text, mark, "$1")
    return F.trim(text)


def section(text: Column, heading: str, looser: str) -> Column:
    """Text under a second-level heading up to the next one: the heading itself, else the first that the looser pattern finds."""
    body = r"[^\n]*\n(.*?)(?=\n## |\z)"
    exact, loose = F.regexp_extract(text, rf"(?s)(?:\A|\n)## {heading}[ \t]*\n(.*?)(?=\n## |\z)", 1), F.regexp_extract(text, rf"(?s)(?:\A|\n)## [^\n]*{looser}{body}", 1)
    return F.when(exact != "", F.struct(F.lit("summary").alias("found"), exact.alias("body"))).when(loose != "", F.struct(F.lit("fallback").alias("found"), loose.alias("body")))


def table_rows(text: Column) -> Column:
    """Cells of the pipe-table lines of a text. A line is one if it begins with a pipe; the last pipe may be missing. Rows whose cells are all dashes and colons only
    set the alignment and are left out."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x.startswith("|"))
    cells = F.transform(lines, lambda x: F.transform(F.split(F.regexp_replace(F.substring(x, 2, 1 << 30), r"\|$", ""), r"\|"), lambda c: F.trim(c)))
    return F.filter(cells, lambda row: F.exists(row, lambda c: ~c.rlike("^[-:]+$")))


def paper_number(text: Column) -> Column:
    """Number after ``Paper`` in a display text, 0 without one."""
    return F.coalesce(F.nullif(F.regexp_extract(text, PAPER_NUMBER, 1), F.lit("")).cast("int"), F.lit(0))


def chapter_number(text: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(text, CHAPTER_NUMBER, 1), F.lit("")).cast("int"), F.lit(0))


def paper_of_question(question: Column) -> Column:
    """Paper that a question's id carries (``q-f1c4-001``, ``cs-f2c2-01``); null without one."""
    return F.nullif(F.regexp_extract(question, QUESTION_PAPER, 1), F.lit("")).cast("int")


def minutes_for(marks: Column) -> Column:
    """Time budget of 1.8 minutes a mark, in whole minutes."""
    return half_up_whole(marks * 1.8)
