"""URL filter: host and path rules, and a character language-model ratio for what no rule decides.

Two Markov models of variable order are learnt from URLs known as accepted and as rejected. A context is kept if it
occurred often enough, so its order varies with the evidence; the probability of a character in a kept context is smoothed
towards that in the next shorter one. The difference of the log-likelihoods over the length, calibrated on URLs
that were held back, is the probability of rejection.

Written out, the log-likelihood difference is a sum over all substrings of the URL: each kept substring adds how much
its last character gains over the shorter context, and each kept context of which it is the beginning adds what unseen
characters lose there. So a URL is scored by one lookup per substring, without state from character to character.

The model grows with the input. Substrings that make up at least 1 / ``MOST_STRINGS`` of those looked up, for each length,
are so few that they are broadcast; any other one is rare among them, so that a shuffle deals them evenly. Only DataFrame
functions are used.

Null URLs, and URLs without ``://``, have an empty host and path; with no characters to judge a null or empty URL is
allowed. Without URLs of both kinds to learn from, the method allows all.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hold, materialise, table

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
ORDER = 4  # characters of context at most
LEAST = 3  # occurrences of a kept string at least
MOST_STRINGS = 32_768  # strings of each length at most that are broadcast
PRIOR = 4.0  # weight of the shorter context, in characters
ALPHABET = 128.0
END = "\x03"


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    rest = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def with_rule(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, url: str = "url") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``rule_verdict``: of the rules that fit, the longest; null without one.
    Of rules equally long the first in the list wins."""
    host, path = host_and_path(url)
    rows = pages.withColumns({"host": host, "path": path})
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, domain, start in sorted(rules, key=lambda r: len(r[1]) + len(r[2]), reverse=True)[::-1]:
        fits = ((F.col("host") == domain) | F.col("host").endswith("." + domain)) & F.col("path").startswith(start)
        rule, verdict = F.when(fits, domain + start).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rows.withColumns({"rule": rule, "rule_verdict": verdict})


def _substrings(rows: DataFrame, url: Column, keep: Sequence[str]) -> DataFrame:
    """``s``: each substring of up to ``ORDER`` + 1 characters of the URL and its end mark; ``context``: more follows.
    What is exploded are windows of a few characters, so the work is linear in the URL."""
    chars = hold(rows.select(*keep, url.alias("_u")), "_c", F.regexp_extract_all(F.concat("_u", F.lit(END)), F.lit("(?s)."), F.lit(0))).drop("_u")
    windows = F.transform(F.sequence(F.lit(1), F.size("_c")), lambda i: F.array_join(F.slice("_c", i, F.lit(ORDER + 1)), ""))
    starts = chars.select(*keep, F.explode(windows).alias("_w"))
    both = starts.select(*keep, "_w", F.explode(F.sequence(F.lit(1), F.length("_w"))).alias("_n"))
    return both.select(*keep, F.substring("_w", F.lit(1), F.col("_n")).alias("s"), (F.col("_n") < F.length("_w")).alias("context"))


def learn(labelled: DataFrame, url: str = "url", accepted: str = "accepted") -> DataFrame | None:
    """The model: ``s``, ``gain`` (of its last character), ``loss`` (of an unseen one after it), for accepted over rejected."""
    kinds = labelled.agg(F.count_if(accepted), F.count_if(~F.col(accepted))).first()
    if not kinds[0] or not kinds[1]:
        return None
    yes = F.col(accepted).cast("long")
    counts = materialise(
        _substrings(labelled.select(url, accepted), F.col(url), [accepted])
        .groupBy("s")
        .agg(F.sum(yes).alias("a"), F.sum(1 - yes).alias("r"), F.sum(yes * F.col("context").cast("long")).alias("ca"), F.sum((1 - yes) * F.col("context").cast("long")).alias("cr"))
        .filter(F.col("a") + F.col("r") >= LEAST)
    )
    total = labelled.agg(F.sum(F.when(F.col(accepted), F.length(url) + 1)), F.sum(F.when(~F.col(accepted), F.length(url) + 1))).first()
    smooth = lambda n, of, below: (n + PRIOR * below) / (of + PRIOR)
    level = counts.filter(F.length("s") == 1).select(
        "s", smooth(F.col("a"), F.lit(total[0]), F.lit(1 / ALPHABET)).alias("pa"), smooth(F.col("r"), F.lit(total[1]), F.lit(1 / ALPHABET)).alias("pr")
    )
    levels = [level.select("s", F.log(F.col("pa") / F.col("pr")).alias("step"))]
    for n in range(2, ORDER + 2):
        contexts = counts.filter(F.length("s") == n - 1).select(F.col("s").alias("before"), "ca", "cr")
        lower = level.select(F.col("s").alias("shorter"), F.col("pa").alias("la"), F.col("pr").alias("lr"))
        own = counts.filter(F.length("s") == n).select("s", "a", "r", F.substring("s", 1, n - 1).alias("before"), F.substring("s", 2, n - 1).alias("shorter"))
        joined = own.join(contexts, "before").join(lower, "shorter")
        level = materialise(joined.select("s", smooth(F.col("a"), F.col("ca"), F.col("la")).alias("pa"), smooth(F.col("r"), F.col("cr"), F.col("lr")).alias("pr"), "la", "lr", "ca", "cr"))
        # over the shorter context's probability, and over what an unseen character would have lost
        levels.append(level.select("s", (F.log(F.col("pa") / F.col("la")) - F.log(F.col("pr") / F.col("lr")) - _loss()).alias("step")))
        level = level.select("s", "pa", "pr")
    gains = levels[0]
    for x in levels[1:]:
        gains = gains.unionByName(x)
    losses = counts.filter(F.length("s") <= ORDER).select("s", _loss().alias("loss"))
    return materialise(gains.join(losses, "s", "left").select("s", F.col("step").alias("gain"), F.coalesce("loss", F.lit(0.0)).alias("loss")))


def _loss() -> Column:
    return F.log((F.col("cr") + PRIOR) / (F.col("ca") + PRIOR))


def ratio(rows: DataFrame, model: DataFrame, url: str, keys: Sequence[str]) -> DataFrame:
    """``keys`` and ``ratio``: log-likelihood as accepted less that as rejected, over the length in characters."""
    found = _substrings(rows, F.col(url), keys)
    chars = rows.agg(F.sum(F.length(url) + 1)).first()[0] or 0
    frequent = found.groupBy("s").agg(F.count("*").alias("n")).filter(F.col("n") >= math.ceil(chars / MOST_STRINGS)).select("s")
    head = F.broadcast(materialise(frequent.join(model, "s", "left")))
    # a frequent substring without a gain is not in the model, and isn't looked up again
    rest = found.join(head.select("s"), "s", "left_anti").join(model, "s")
    found = found.join(head.filter("gain IS NOT NULL"), "s").unionByName(rest)
    worth = F.sum(F.col("gain") + F.when(F.col("context"), F.col("loss")).otherwise(0.0))
    return found.groupBy(*keys).agg(worth.alias("_sum"))


def filter_urls(pages: DataFrame, labelled: DataFrame, url: str = "url", accepted: str = "accepted") -> DataFrame:
    """``pages`` with ``ratio`` (log-likelihood difference a character) and ``reject_probability``, one row per row.

    Columns of these names are replaced. Rows that occur twice are judged alike; an empty table gives an empty result. Distinct URLs are scored once. One labelled URL of five, by a hash of it, is held back and calibrates."""
    pages = pages.drop("ratio", "reject_probability", "_h1", "_h2", "_chars", "_sum", "_url")
    known = labelled.filter(F.col(url).isNotNull() & (F.col(url) != "") & F.col(accepted).isNotNull())
    held = F.crc32(url) % 5 == 0
    model = learn(known.filter(~held), url, accepted)
    if model is None:
        return pages.withColumns({"ratio": F.lit(0.0), "reject_probability": F.lit(0.0)})
    marks = {"_h1": F.xxhash64(url), "_h2": F.xxhash64(url, F.lit(1)), "_chars": F.length(url) + 1}  # 128 bits stand for the URL
    judged = ratio(known.filter(held).withColumns(marks), model, url, ["_h1", "_h2", "_chars", accepted])
    per_char = F.col("_sum") / F.col("_chars")
    stats = {bool(r[0]): r[1:] for r in judged.groupBy(accepted).agg(F.avg(per_char), F.var_pop(per_char), F.count("*")).collect()}
    slope, shift = _calibrated(stats)
    rows = pages.withColumns(marks)
    asked = rows.filter(F.col(url).isNotNull() & (F.col(url) != "")).groupBy("_h1", "_h2").agg(F.first(url).alias("_url"))
    scored = ratio(asked, model, "_url", ["_h1", "_h2"])
    found = rows.join(scored, ["_h1", "_h2"], "left")
    value = F.coalesce(F.col("_sum") / F.col("_chars"), F.lit(0.0))
    odds = F.exp(F.least(F.lit(50.0), F.greatest(F.lit(-50.0), value * slope + shift)))
    return found.select(*pages.columns, value.alias("ratio"), F.when(F.col("_sum").isNull(), 0.0).otherwise(1 / (1 + odds)).alias("reject_probability"))


def _calibrated(stats: dict[bool, tuple]) -> tuple[float, float]:
    """Slope and shift of the log odds of acceptance, for two normal kinds of equal spread and equal odds."""
    if len(stats) < 2 or stats[True][0] <= stats[False][0]:
        return 1.0, 0.0
    (ma, va, na), (mr, vr, nr) = stats[True], stats[False]
    spread = max(1e-6, (va * na + vr * nr) / (na + nr))
    return (ma - mr) / spread, -(ma * ma - mr * mr) / (2 * spread)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL with its host, path, rule and verdict."""
    pages = with_rule(table(spark, sf_dir, "pages").select("page_id", "url"))
    labelled = pages.select("url", (F.col("rule_verdict") == "allow").alias("accepted"))
    judged = filter_urls(pages, labelled)
    method = F.when(F.col("reject_probability") > 0.5, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", method).alias("verdict"), F.round("ratio", 9).alias("ratio"), F.round("reject_probability", 9).alias("reject_probability"))
