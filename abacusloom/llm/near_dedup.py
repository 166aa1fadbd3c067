"""Near-duplicate detection by DartMinHash over word shingles.

A document is a weighted set: shingles of five words, weighted by how often they occur. Darts fall on the
plane of (weight, rank) of every shingle as a Poisson process that a hash fixes; a dart counts if its
weight coordinate lies within the shingle's weight. Each dart belongs to one of ``COORDINATES`` coordinates, and
the dart of lowest rank is a coordinate's value. Only darts below a rank that shrinks with the document's total weight
are thrown, so the signature costs one hash a shingle and a constant number of darts a document. Two documents
agree in a coordinate with the probability of their weighted Jaccard similarity.

Bands of four coordinates bring documents together (at 0.8 a pair is missed with probability below 0.0003); the exact
weighted similarity of the shingles then decides. Where a crowded bucket keeps members that its leaders aren't near to,
they are joined by their rarest shingles: two similar sets share one among the first fifth of each. Words are runs without ASCII white space, in lower case. A text of fewer than
five words is one shingle; null and word-less texts have none, are alike to each other and to nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, kept_by_worker, materialise, maybe_among, small_batches, table, take_over
from .linking import in_blocks, link_by_bands
from .words import slices

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 16, 4
COORDINATES = BANDS * ROWS
DARTS = COORDINATES * (np.log(COORDINATES) + 2)
PART_BYTES = 1 << 18
KEPT_POWERS = PART_BYTES + 4_096
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
U = np.uint64
COUNTERS = 1 << 18  # of shingles, by their last bits; they only order the shingles


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every bit of the input moves every bit of the output."""
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


BASE = 0x9E3779B97F4A7C15 | 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i below n."""
    found = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        steps = np.full(n, base, U)
        steps[0] = 1
        found.append(np.multiply.accumulate(steps))
    return found[0], found[1]


_kept_powers = kept_by_worker(lru_cache(1)(_powers))


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word: differences of a running polynomial of the bytes. Long texts go part by part."""
    found = []
    at = 0
    while at < len(data):
        to = min(len(data), at + PART_BYTES)
        while to < len(data) and not SPACE[data[to]]:
            to += 1
        part = np.frombuffer(data, np.uint8, to - at, at)
        power, inverse = _kept_powers(KEPT_POWERS) if len(part) < KEPT_POWERS else _powers(len(part) + 1)  # a word may be longer
        gap = np.concatenate([[True], SPACE[part], [True]])
        change = np.flatnonzero(gap[1:] != gap[:-1])
        start, end = change[::2], change[1::2]
        running = np.zeros(len(part) + 1, U)
        np.cumsum((part.astype(U) + U(1)) * power[: len(part)], out=running[1:])
        found.append(mix((running[end] - running[start]) * inverse[start] + (end - start).astype(U)))
        at = to
    return np.concatenate(found) if found else np.empty(0, U)


def shingles(words: np.ndarray) -> np.ndarray:
    if not len(words):
        return words
    n = max(1, len(words) - SHINGLE + 1)
    out = np.zeros(n, U)
    for i in range(min(SHINGLE, len(words))):
        out = (out * U(0x100000001B3)) ^ mix(words[i : i + n] + U(i))
    return mix(out)


def elements(words: np.ndarray) -> np.ndarray:
    """The weighted set as a plain one: the j-th occurrence of a shingle is an element of its own."""
    found = np.sort(shingles(words))
    if len(found) > 1:
        new = np.concatenate([[True], found[1:] != found[:-1]])
        if not new.all():
            at = np.arange(len(found))
            nth = at - np.maximum.accumulate(np.where(new, at, 0))
            found = np.where(nth > 0, mix(found + nth.astype(U) * U(0xD6E8FEB86659FD93)), found)
    return found


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> U(11)).astype(np.float64) + 0.5) / 2.0**53


def signatures(sets: list[np.ndarray], darts: float = DARTS) -> np.ndarray:
    """A row of ``COORDINATES`` dart hashes for each non-empty set. The unit of weight of each element has its darts in
    rank order, with exponential gaps; all ranks below ``darts`` over the document's weight are thrown. A document
    with a coordinate that no dart hit is thrown again up to twice the rank, which changes none of its other values."""
    sizes = np.array([len(s) for s in sets])
    doc, element = np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets)
    limit, rank = darts / sizes, np.zeros(len(element))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    nth = 1
    while len(element):
        dart = mix(element + U(nth * 0xA0761D6478BD642F & (1 << 64) - 1))
        rank = rank - np.log(_uniform(dart))
        inside = rank < limit[doc]
        doc, element, rank = doc[inside], element[inside], rank[inside]
        own = mix(dart[inside] + U(0xE7037ED1A0B428DB))
        found.append((doc * COORDINATES + (own % U(COORDINATES)).astype(np.int64), rank, own))
        nth += 1
    cell, rank, own = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(-rank)
    value, hit = np.zeros(len(sets) * COORDINATES, U), np.zeros(len(sets) * COORDINATES, bool)
    value[cell[order]], hit[cell] = own[order], True  # of several values the last one stays: the lowest rank
    value = value.reshape(-1, COORDINATES)
    if len(missed := np.flatnonzero(~hit.reshape(-1, COORDINATES).all(axis=1))):
        value[missed] = signatures([sets[i] for i in missed], darts * 2)
    return value


def band_keys(signature: np.ndarray) -> np.ndarray:
    """A key for each band of each row; the band's number is part of it."""
    out = np.zeros((len(signature), BANDS), U)
    for i in range(ROWS):
        out = mix(out ^ signature[:, i::ROWS][:, :BANDS] + U(i))
    return mix(out + np.arange(BANDS, dtype=U) * U(0x9E3779B97F4A7C15)).view(np.int64)


def sketch(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``id``, ``content`` (digest of the words), ``bands`` (array of 64-bit keys, empty without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import blake2b

        take_over("near dedup")
        for batch in batches:
            at = 0
            for texts in slices(batch.column(1)):
                words = [word_hashes(x.lower().encode("utf-8", "surrogatepass")) for x in texts]
                sets = [elements(w) for w in words]
                full = [i for i, s in enumerate(sets) if len(s)]
                keys: list = [[]] * len(texts)
                if full:
                    for i, k in zip(full, band_keys(signatures([sets[i] for i in full])), strict=True):
                        keys[i] = k
                digests = pa.array([blake2b(w.tobytes(), digest_size=16).digest() for w in words], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), digests, pa.array(keys, pa.list_(pa.int64()))], ["id", "content", "bands"])
                at += len(texts)
        give_back()

    small_batches(docs.sparkSession)
    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, "id long, content binary, bands array<long>")


def element_sets(docs: DataFrame) -> DataFrame:
    """``id`` and ``elements`` (32 bits of each) of rows ``id``, ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("near dedup")
        for batch in batches:
            at = 0
            for texts in slices(batch.column(1)):
                sets = [np.unique((elements(word_hashes(x.lower().encode("utf-8", "surrogatepass"))) >> U(32)).astype(np.uint32)).view(np.int32) for x in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(sets, pa.list_(pa.int32()))], ["id", "elements"])
                at += len(texts)
        give_back()

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, "id long, elements array<int>")


def occurrences(sets: DataFrame) -> np.ndarray:
    """How many sets an element of each counter is in, for rows ``elements``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy() & (COUNTERS - 1), minlength=COUNTERS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["counter", "n"])

    found = sets.select("elements").mapInArrow(run, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(COUNTERS, np.int64)
    out[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return out


def rarest(sets: DataFrame, counts: np.ndarray, similarity: float) -> DataFrame:
    """The elements of each set, rarest first, that can be the first that it has in common with a similar set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = batch.column(2).offsets.to_numpy()
            values = batch.column(2).values.to_numpy()
            firsts = []
            for i in range(batch.num_rows):
                own = values[ends[i] : ends[i + 1]]
                most = int(len(own) * (1 - similarity) + 1e-6) + 1
                firsts.append(own[np.lexsort((own, counts[own & (COUNTERS - 1)]))][:most])
            if not firsts:
                continue
            kept = np.array([len(f) for f in firsts])
            row = pa.array(np.repeat(np.arange(len(kept)), kept))
            size, at = np.repeat(np.diff(ends), kept), np.concatenate([np.arange(k) for k in kept])
            columns = [batch.column(0).take(row), batch.column(1).take(row), pa.array(size, pa.int32()), pa.array(at, pa.int32()), pa.array(np.concatenate(firsts), pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "component", "size", "at", "element"])

    return sets.select("id", "component", "elements").mapInArrow(run, "id long, component long, size int, at int, element int")


def near_classes(docs: DataFrame, similarity: float = SIMILARITY, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: ``key``, ``class_id`` (smallest key of its class), ``class_size``, ``kept`` (the class's first
    document). Rows of equal key fall into one class; a null key has no class. An empty table gives an empty result."""
    rows = materialise(sketch(docs, text, key))

    def sets_of(ids: DataFrame) -> DataFrame:
        """Elements of the texts of some keys; hardly more than those are shuffled."""
        ids = materialise(ids)
        texts = maybe_among(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")), "id", ids, "_asked")
        return materialise(element_sets(texts.filter("_asked").drop("_asked").join(ids, "id", "left_semi")).dropDuplicates(["id"]))

    def verify(pairs: DataFrame, groups: DataFrame) -> DataFrame:
        sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
        of = lambda name: sets.select(F.col("id").alias(name), F.col("elements").alias(f"set_{name}"))
        common = F.size(F.array_intersect("set_a", "set_b"))
        compared = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", common.alias("common"), (F.size("set_a") + F.size("set_b")).alias("both"))
        return compared.filter(F.col("common") >= similarity * (F.col("both") - F.col("common")))

    def meet(told: DataFrame) -> DataFrame:
        members = told.select("id", "component").distinct()
        sets = sets_of(members.select("id"))
        lists = materialise(rarest(sets.join(members, "id"), occurrences(sets), similarity))
        pairs = in_blocks(lists, "element", ["size", "at"])
        most = F.least(F.col("size_x") - F.col("at_x"), F.col("size_y") - F.col("at_y"))  # in common, if this element is the first
        near = most * (1 + similarity) >= similarity * (F.col("size_x") + F.col("size_y")) - 1e-6
        return pairs.filter(near).select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b")).distinct()

    found = link_by_bands(rows, F.col("bands"), verify, meet)
    return found.withColumn("kept", F.coalesce(F.col("id") == F.col("class_id"), F.lit(True))).withColumnRenamed("id", key)


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of near copies."""
    return near_classes(table(spark, sf_dir, "documents"))
