"""Document fingerprints by a randomised edit embedding.

Every text takes the same random walk: at step j the walk stands on one character, writes it down and
moves on if a random bit that depends on (j, character) says so. Texts a few edits apart fall into step
again soon after each edit, so edit distance becomes Hamming distance between what the walks wrote.
The fingerprint keeps sampled symbols of that sequence: all of the first steps and equally many from
each later octave, so that texts of any length share positions. Bands of samples find near texts,
and the likeness of two fingerprints verifies them.

Nulls count as empty text; the empty text has the fingerprint ``0-``. Equal texts have equal
fingerprints. A walk is linear in the text and is never cut short.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256
from itertools import accumulate
from operator import getitem, itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, materialise, shuffle_partitions, small_batches, table, take_over
from .linking import link_by_marked_bands

PERIOD = 512  # the random bits repeat after so many steps
DENSE = 128  # every step below this one is sampled
PER_OCTAVE = 64
OCTAVES = 34
BANDS, BAND_WIDTH = 24, 6  # at likeness 0.8 symbols agree with 0.8125: a pair is missed with (1 - 0.8125 ** 6) ** 24 < 0.0004
SHORTEST = 8  # steps of a walk that is banded
CHANCE = 1 / 16  # that two unlike symbols agree
SEED = 20_240
MARK = ("steps", "start", "seen", "a0", "a1", "b0", "b1")  # see marked_bands
MOST_BUCKETS, PER_BUCKET = 100_000, 20  # buckets that texts are dealt by, sampled keys for each


@lru_cache(1)
def _walk() -> tuple[list, bytes, np.ndarray, list[int]]:
    """The walk's states, the symbol of each character class, the sampled steps and the octaves' starts."""
    rng = np.random.Generator(np.random.PCG64(SEED))
    moves = rng.integers(0, 2, (256, PERIOD)).astype(bool)
    moves[:, 0] = True
    states: list[list] = [[None] * 257 for _ in range(PERIOD)]
    for c in range(256):
        at = np.flatnonzero(moves[c])
        after = at[np.searchsorted(at, np.arange(PERIOD)) % len(at)]
        for p in range(PERIOD):
            states[p][c] = states[(after[p] + 1) % PERIOD]
    for p in range(PERIOD):
        states[p][256] = p
    symbols = np.frombuffer(b"0123456789abcdef", np.uint8)[rng.integers(0, 16, 256)]
    steps, edges = [np.arange(DENSE)], [0]
    for k in range(DENSE.bit_length() - 1, OCTAVES):
        edges.append(DENSE + (len(steps) - 1) * PER_OCTAVE)
        steps.append(2**k + np.sort(rng.choice(2**k if k < 40 else 2**40, PER_OCTAVE, replace=False, shuffle=False)))
    return states, symbols.tobytes(), np.concatenate(steps), edges


@dataclass
class Walk:
    """A text's characters by class, the step at which the walk leaves each, and the phase it ends in."""

    kinds: np.ndarray
    leaves: np.ndarray
    phase: int

    def then(self, text: str) -> Walk:
        """The walk over this text followed by ``text``: what is walked already is not walked again."""
        states = _walk()[0]
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = ((code ^ (code >> 8) ^ (code >> 16)) & 255).astype(np.uint8)
        phase = np.fromiter(map(PHASE, accumulate(kinds.tobytes(), getitem, initial=states[self.phase])), np.int16, len(kinds) + 1)
        stays = np.diff(phase) % PERIOD
        stays[stays == 0] = PERIOD
        start = self.leaves[-1] if len(self.leaves) else 0
        return Walk(np.concatenate([self.kinds, kinds]), np.concatenate([self.leaves, start + np.cumsum(stays, dtype=np.int64)]), int(phase[-1]))

    def first(self, chars: int) -> Walk:
        """The walk over the first ``chars`` characters."""
        return Walk(self.kinds[:chars], self.leaves[:chars], int(self.leaves[chars - 1] % PERIOD) if chars else 0)

    def fingerprint(self) -> str:
        """Length of the walk in hexadecimal, a dash, one hexadecimal symbol for each sampled step."""
        if not len(self.leaves):
            return "0-"
        _, symbols, samples, _ = _walk()
        inside = samples[: np.searchsorted(samples, self.leaves[-1])]
        seen = self.kinds[np.searchsorted(self.leaves, inside, side="right")]
        return f"{self.leaves[-1]:x}-{seen.tobytes().translate(symbols).decode()}"


PHASE = itemgetter(256)
START = Walk(np.empty(0, np.uint8), np.empty(0, np.int64), 0)


def fingerprint(text: str | None) -> str:
    return START.then(text or "").fingerprint()


def likeness(a: str, b: str) -> float:
    """Estimated share of equal steps of two walks, corrected for chance: 1 for equal texts, about 0 for unrelated ones."""
    if a == b:
        return 1.0
    (la, sa), (lb, sb) = ((int(n, 16), s) for n, s in (x.split("-", 1) for x in (a, b)))
    longest, (_, _, samples, edges) = max(la, lb), _walk()
    x, y = np.frombuffer(sa.encode(), np.uint8), np.frombuffer(sb.encode(), np.uint8)
    both = min(len(x), len(y))
    equal = np.zeros(max(len(x), len(y)))
    equal[:both] = x[:both] == y[:both]
    weight = total = 0.0
    for i, lo in enumerate(edges):
        hi = edges[i + 1] if i + 1 < len(edges) else len(samples)
        part = equal[lo:hi]
        if not len(part):
            break
        first, last = (0, DENSE) if i == 0 else (DENSE << (i - 1), DENSE << i)
        steps = min(last, longest) - first
        total, weight = total + steps * part.mean(), weight + steps
    return float(max(0.0, (total / weight - CHANCE) / (1 - CHANCE)))


@lru_cache(OCTAVES + 8)
def _places(octave: int) -> np.ndarray:
    """The sampled symbols of each band of the first 2**octave steps, spread over them evenly."""
    rng = np.random.Generator(np.random.PCG64(SEED + octave))
    samples, steps = _walk()[2], 1 << octave
    drawn = np.stack([np.sort(rng.choice(steps, BAND_WIDTH, replace=False, shuffle=False)) for _ in range(BANDS)])
    return np.minimum(np.searchsorted(samples, drawn), np.searchsorted(samples, steps) - 1)


def bands(value: str) -> list[str]:
    """Keys of sampled symbols, from the steps below the last two powers of two that the walk fills: texts of which one is less
    than twice as long as the other share one of these. Walks of fewer than ``SHORTEST`` steps give one key, their whole fingerprint."""
    length, symbols = value.split("-", 1)
    steps = int(length, 16)
    if steps < SHORTEST:
        return [value]
    seen, full = np.frombuffer(symbols.encode(), np.uint8), steps.bit_length() - 1
    octaves = range(max(SHORTEST.bit_length() - 1, full - 1), full + 1)
    return [f"{octave}:{band}:{key.tobytes().decode()}" for octave in octaves for band, key in enumerate(seen[_places(octave)])]


@lru_cache(OCTAVES + 8)
def _block(octave: int) -> slice:
    """The symbols sampled between the first 2**(octave - 1) steps and the first 2**octave: all of them or ``PER_OCTAVE``."""
    return slice(*np.searchsorted(_walk()[2], (1 << octave - 1, 1 << octave)).tolist())


def marked_bands(value: str) -> dict:
    """``bands``, the same of both octaves by turns, and a mark, which tells most unlike walks apart: steps, the last power of two that they fill, two bits
    of each symbol in the block before it and in the one after it, and how many symbols the latter has."""
    length, symbols = value.split("-", 1)
    steps, keys = int(length, 16), bands(value)
    full = max(1, steps.bit_length() - 1)
    code = np.frombuffer(symbols.encode(), np.uint8)
    code = (code & 15) + 9 * (code >> 6)  # of hexadecimal digits
    planes = np.zeros((4, PER_OCTAVE), np.uint8)
    for k in range(2):
        own = code[_block(full + k)]
        planes[2 * k, : len(own)], planes[2 * k + 1, : len(own)] = own & 1, own >> 1 & 1
    return {"bands": [k for i in range(BANDS) for k in keys[i::BANDS]]} | dict(zip(MARK, (steps, 1 << full, len(own), *np.packbits(planes, axis=1).view(np.int64)[:, 0].tolist()), strict=True))


def may_be_like(x: Column, y: Column, threshold: float) -> Column:
    """Whether the marks of two walks that share a band leave it open that their likeness reaches ``threshold``: false only if they tell too many steps apart.
    Symbols that differ in none of the two bits count as equal here, and so do those outside the blocks."""
    unlike = lambda p, q: F.bit_count(x[f"{p}0"].bitwiseXOR(y[f"{q}0"]).bitwiseOR(x[f"{p}1"].bitwiseXOR(y[f"{q}1"])))
    longest, start = F.greatest(x["steps"], y["steps"]), F.greatest(x["start"], y["start"])
    steps = F.greatest(F.lit(1.0), start / DENSE)  # for a symbol of the block before ``start``
    rest = lambda seen: F.when(seen > 0, longest - start).otherwise(0)
    apart = (
        F.when(x["start"] == y["start"], unlike("a", "a") * steps + unlike("b", "b") * (longest - start) / F.greatest(F.lit(1), x["seen"], y["seen"]))
        .when(x["start"] == 2 * y["start"], unlike("a", "b") * steps + rest(x["seen"]))
        .when(y["start"] == 2 * x["start"], unlike("b", "a") * steps + rest(y["seen"]))
        .otherwise(0)  # they share no octave
    )
    return F.lit(threshold <= 0) | (apart <= (1 - threshold) * (1 - CHANCE) * longest * (1 + 1e-9) + 1e-6)


def band_hits(a: str, b: str) -> int:
    return len(set(bands(a)) & set(bands(b)))


@F.pandas_udf(T.StringType())
def fingerprint_of(texts: pd.Series) -> pd.Series:
    return texts.map(fingerprint)


@F.pandas_udf(T.DoubleType())
def likeness_of(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([likeness(x, y) for x, y in zip(a, b, strict=True)])


@F.pandas_udf(T.StructType([T.StructField("bands", T.ArrayType(T.StringType())), *(T.StructField(c, T.LongType()) for c in MARK)]))
def marked_bands_of(values: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([marked_bands(v) for v in values], columns=["bands", *MARK])


def near_classes(docs: DataFrame, threshold: float = 0.8, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: ``key``, ``class_id`` (smallest key of its class), ``class_size``.

    Equal fingerprints form one class first, however many they are; their representatives meet in bands and
    are linked where their likeness reaches ``threshold``. Empty texts form one class; an empty table gives none."""
    small_batches(docs.sparkSession)
    prints = docs.select(F.col(key).alias("id"), fingerprint_of(F.coalesce(F.col(text), F.lit(""))).alias("print"))
    prints = materialise(prints.select("id", "print", F.unhex(F.sha2("print", 256)).alias("content")))

    def verify(pairs: DataFrame, groups: DataFrame) -> DataFrame:
        of = lambda name: groups.select(F.col("id").alias(name), F.col("print").alias(f"print_{name}"))
        return pairs.join(of("a"), "a").join(of("b"), "b").filter(likeness_of("print_a", "print_b") >= threshold)

    # bands go as 64-bit hashes, shorter than their strings; should two bands share one, their pairs are verified like all others
    marked = marked_bands_of("print")
    bands, mark = F.transform(marked["bands"], lambda b: F.xxhash64(b)), F.struct(*(marked[c].alias(c) for c in MARK))
    classes = link_by_marked_bands(prints, bands, mark, lambda x, y: may_be_like(x, y, threshold), verify)
    return classes.withColumnRenamed("id", key)


def _bounds(docs: DataFrame, key: str, rows: int) -> list[int]:
    """First keys of buckets of about ``rows`` rows in key order, but of ``MOST_BUCKETS`` at most: the first key and some of a sample, as a range
    partitioner takes them. All of them are keys that occur."""
    n, least = docs.agg(F.count("*"), F.min(key)).first()
    parts = min(max(1, n // rows), MOST_BUCKETS)
    share = PER_BUCKET * parts / max(1, n)
    keys = docs.select(key) if share >= 1 else docs.select(key).sample(share, SEED)
    drawn = np.sort(keys.toArrow().column(0).to_numpy())
    return sorted({int(x) for x in drawn[:: max(1, len(drawn) // parts)]} | ({least} if n else set()))


def _neighbours(bounds: list[int], key: Column) -> Column:
    """For each key the bucket it lies in; the first row of a bucket is also handed to the bucket before."""
    last = len(bounds) - 1

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def place(keys: pd.Series) -> pd.Series:
        out = []
        for k in keys.astype("object"):
            at = 0 if k is None or k != k else max(0, bisect_right(bounds, k) - 1)
            first = bounds and k == bounds[bisect_left(bounds, k)] if k in edge else False
            out.append([at, -1 - (at - 1 if at else last)] if first else [at])
        return pd.Series(out)

    edge = frozenset(bounds)
    return place(key)


def with_edited(docs: DataFrame, text: str = "text", key: str = "doc_id", rows: int = 400) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose later half comes from the next document.

    Documents are dealt once, by bucket of consecutive keys; the first document of a bucket is dealt to the
    bucket before it too, so that each task sees all neighbours. A task holds two texts at a time. Rows with
    equal keys follow each other by their text; a null key comes first."""
    spark = docs.sparkSession
    source = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    bounds = _bounds(source.filter(F.col("id").isNotNull()), "id", rows)
    dealt = (
        source.withColumn("place", F.explode(_neighbours(bounds, F.col("id"))))
        .withColumn("ahead", F.col("place") < 0)
        .withColumn("bucket", F.when(F.col("ahead"), -1 - F.col("place")).otherwise(F.col("place")))
        .select("id", "text", "ahead", "bucket")
        .repartition(shuffle_partitions(spark), "bucket")
        .sortWithinPartitions("bucket", "ahead", "id", "text")
    )

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), batch.column(2)[i].as_py(), batch.column(3)[i].as_py()

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("fingerprints")
        out: list[tuple] = []
        held: tuple | None = None
        for key_, text_, ahead, bucket in rows_of(batches):
            walk = START.then(text_)
            value = walk.fingerprint()
            if held and held[0] == bucket:
                _, id_, own, own_walk, own_value = held
                half = len(own) // 2
                edited = own[: len(own) - half] + text_[:half]
                edited_value = own_walk.first(len(own) - half).then(text_[:half]).fingerprint()
                out.append((id_, len(own), sha256(edited.encode()).hexdigest(), own_value, edited_value, likeness(own_value, edited_value), likeness(own_value, value), band_hits(own_value, edited_value)))
                if len(out) >= 512:
                    yield _batch(out)
                    out = []
            held = None if ahead else (bucket, key_, text_, walk, value)
        if out:
            yield _batch(out)
        give_back()

    small_batches(spark)
    return dealt.mapInArrow(pairs, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited_band_hits int").withColumnRenamed("id", key)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32()]
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "edited_band_hits"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, its edited text's, and how like they are to it and to the next document's."""
    return with_edited(table(spark, sf_dir, "documents"))


def fingerprint_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of like fingerprints: those that meet in a band and agree for four fifths."""
    return near_classes(table(spark, sf_dir, "documents"))
