"""Ranked lexical search over an inverted index in shards: term-at-a-time over short lists, document-at-a-time over long ones.

**Index.** Every task turns its documents, as they come, into shards of bounded size. A shard is one row: its documents with their
lengths, and for each term the list of documents that hold it, with how often. No posting is shuffled; only the numbers of documents a term
has are summed over shards. Shards are written before they are searched. The index holds the terms of the queries, or all terms.

**Search.** Queries come in blocks of bounded size, each against all shards. In a shard a query's short lists are summed term at a time
into accumulators. These form one more list, whose bound is the largest sum, beside the long lists, whose bounds are kept for each
window of documents. Then documents pass in order, a window at a time: long lists whose bounds together can't lift a document to
the query's threshold only get looked up, a window that can't reach the threshold is skipped, and of the others' candidates only
those are looked up, list by list from the largest bound, that can still reach it. The threshold is the k-th best score so far. It
starts from what a bounded sample of shards has reached, so that most shards emit few rows or none; the results are those of an
exhaustive search in any case.

Terms are maximal runs of ASCII letters and digits and of characters beyond ASCII; A-Z are lower-cased. The weights and scores are whole
numbers (see ``weight_of`` and ``impacts``), so that sums don't depend on their order.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import give_back, materialise, small_batches, table, take_over
from .words import slices

TOP = 10
SHARD_DOCS, SHARD_POSTINGS = 16_384, 4_000_000  # a shard ends with the document that reaches either
QUERY_BYTES = 4_000_000  # of the texts of a block of queries, about
WINDOW = 256  # documents of a window
LONG_SHARE = 8  # a list is long if one in so many of a shard's documents is on it
PRIMING = 32  # shards, at most, that give the first thresholds
TERM = bytes(c + 32 if 65 <= c <= 90 else c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))
SHARD = "ids array<long>, lengths array<int>, terms array<binary>, ends array<int>, postings array<int>, counts array<int>"


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(TERM).split()


def weight_of(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def impacts(counts: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * counts // (1000 * counts + 8 * m)


def _shard(ids: list[pa.Array], lengths: list[int], found: list[Counter]) -> pa.RecordBatch:
    """Lists of each term: the places of documents in the shard, where documents stand by key, null keys last."""
    keys = pa.concat_arrays(ids)
    order = pc.sort_indices(pa.table({"id": keys}), sort_keys=[("id", "ascending")], null_placement="at_end").to_numpy()
    numbers: dict[bytes, int] = {}
    sizes = np.array([len(found[i]) for i in order])
    term = np.fromiter((numbers.setdefault(t, len(numbers)) for i in order for t in found[i]), np.int32, sizes.sum())
    count = np.fromiter((n for i in order for n in found[i].values()), np.int32, sizes.sum())
    by_term = np.argsort(term, kind="stable")
    place = np.repeat(np.arange(len(order), dtype=np.int32), sizes)[by_term]
    ends = np.cumsum(np.bincount(term, minlength=len(numbers)))
    row = [keys.take(pa.array(order)), pa.array(np.array(lengths, np.int32)[order]), pa.array(numbers, pa.binary()), pa.array(ends, pa.int32()), pa.array(place), pa.array(count[by_term])]
    names = ["ids", "lengths", "terms", "ends", "postings", "counts"]
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a) for a in row], names)


def index(docs: DataFrame, vocabulary: frozenset[bytes] | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Shards of all documents, for the terms of ``vocabulary`` (None: all terms). Lengths count all terms."""
    spark = docs.sparkSession
    kept = spark.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("search")
        ids, lengths, found, postings = [], [], [], 0
        for batch in batches:
            at = 0
            for texts in slices(batch.column(1)):
                ids.append(batch.column(0).slice(at, len(texts)))
                at += len(texts)
                for words in map(terms_of, texts):
                    of = Counter(words)
                    if kept.value is not None:
                        of = {t: n for t, n in of.items() if t in kept.value}
                    lengths.append(len(words))
                    found.append(of)
                    postings += len(of)
                if len(found) >= SHARD_DOCS or postings >= SHARD_POSTINGS:
                    yield _shard(ids, lengths, found)
                    ids, lengths, found, postings = [], [], [], 0
        if found:
            yield _shard(ids, lengths, found)
        give_back()

    small_batches(spark)
    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, SHARD)


def statistics(shards: DataFrame, vocabulary: frozenset[bytes]) -> tuple[int, int, dict[bytes, int]]:
    """Documents with a term, all their terms, and the documents that hold each term of a bounded vocabulary."""
    docs, length = shards.select(
        F.sum(F.size(F.filter("lengths", lambda n: n > 0))), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, n: a + n))
    ).first()
    pairs = F.arrays_zip("terms", "ends", F.concat(F.array(F.lit(0)), F.slice("ends", 1, F.greatest(F.size("ends") - 1, F.lit(0)))).alias("starts"))
    asked = shards.sparkSession.createDataFrame([(t,) for t in vocabulary], "terms binary")
    lists = shards.select(F.explode(pairs).alias("x")).select("x.*").join(F.broadcast(asked), "terms").groupBy("terms").agg(F.sum(F.col("ends") - F.col("starts")).alias("n"))
    return docs or 0, length or 0, {bytes(r[0]): r[1] for r in lists.collect()}


@dataclass
class Lists:
    """A shard in memory: places and impacts of each term's list."""

    ids: pa.Array
    size: int
    at: dict[bytes, int]
    ends: np.ndarray
    places: np.ndarray
    impact: np.ndarray

    def of(self, term: bytes) -> tuple[np.ndarray, np.ndarray] | None:
        i = self.at.get(term)
        if i is None:
            return None
        own = slice(self.ends[i - 1] if i else 0, self.ends[i])
        return self.places[own], self.impact[own]


def read_shard(batch: pa.RecordBatch, row: int, documents: int, length: int) -> Lists:
    ids, lengths, terms, ends, places, counts = (batch.column(i)[row].values for i in range(6))
    m = np.array([25 + 75 * n * documents // max(1, length) for n in lengths.to_pylist()], np.int64)
    places = places.to_numpy()
    impact = impacts(counts.to_numpy().astype(np.int64), m[places])
    return Lists(ids, len(ids), {t: i for i, t in enumerate(terms.to_pylist())}, ends.to_numpy(), places, impact)


class Best:
    """The k best of (score, place): highest score first, then lowest place. ``least`` is the score below which nothing can enter."""

    def __init__(self, k: int, least: int):
        self.k, self.least = k, max(1, least)
        self.scores, self.places = np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, scores: np.ndarray, places: np.ndarray) -> None:
        keep = scores >= self.least
        if keep.any():
            scores, places = np.concatenate([self.scores, scores[keep]]), np.concatenate([self.places, places[keep]])
            order = np.lexsort((places, -scores))[: self.k]
            self.scores, self.places = scores[order], places[order]
            if len(order) == self.k:
                self.least = max(self.least, int(self.scores[-1]))


def best_of_shard(lists: Lists, query: dict[bytes, int], k: int = TOP, least: int = 0, window: int = WINDOW, long_share: int = LONG_SHARE) -> Best:
    """The shard's best documents for a query, given as terms with their weights (repeats multiplied in)."""
    best = Best(k, least)
    found = [(lists.of(t), w) for t, w in query.items() if w > 0]
    found = [(places, impact * w) for (places, impact), w in ((x, w) for x, w in found if x is not None)]
    short = [x for x in found if len(x[0]) * long_share < lists.size]
    long = sorted((x for x in found if len(x[0]) * long_share >= lists.size), key=lambda x: int(x[1].max()))
    # term at a time: short lists become one, of summed accumulators
    held, sums = np.empty(0, np.int64), np.empty(0, np.int64)
    if short:
        places = np.concatenate([p for p, _ in short])
        held = np.unique(places)
        sums = np.zeros(len(held), np.int64)
        np.add.at(sums, np.searchsorted(held, places), np.concatenate([s for _, s in short]))
    if not long:
        best.add(sums, held)
        return best
    if len(sums) >= k:  # their sums are lower bounds of documents' scores
        best.least = max(best.least, int(np.partition(sums, -k)[-k]))
    windows = -(-lists.size // window)
    edges = np.arange(windows + 1) * window
    cuts = [np.searchsorted(p, edges) for p, _ in long]
    tops = np.array([_maxima(s, c) for (_, s), c in zip(long, cuts, strict=True)])
    held_cut = np.searchsorted(held, edges)
    held_top = _maxima(sums, held_cut)
    reach = np.cumsum(tops, axis=0)  # what the long lists up to each one can add together, in each window
    for w in np.flatnonzero(reach[-1] + held_top >= best.least):
        if reach[-1, w] + held_top[w] < best.least:
            continue
        looked_up = int(np.searchsorted(reach[:, w], best.least, "left"))  # these lists alone can't reach the threshold
        start = w * window
        score, there = np.zeros(window, np.int64), np.zeros(window, bool)
        own = slice(held_cut[w], held_cut[w + 1])
        score[held[own] - start] = sums[own]
        there[held[own] - start] = True
        for i in range(looked_up, len(long)):
            own = slice(cuts[i][w], cuts[i][w + 1])
            at = long[i][0][own] - start
            score[at] += long[i][1][own]
            there[at] = True
        docs = np.flatnonzero(there)
        partial = score[docs]
        for i in range(looked_up - 1, -1, -1):
            alive = partial + reach[i, w] >= best.least
            docs, partial = docs[alive], partial[alive]
            if not len(docs):
                break
            own = slice(cuts[i][w], cuts[i][w + 1])
            at = np.searchsorted(long[i][0][own], docs + start)
            hit = at < own.stop - own.start
            hit[hit] = long[i][0][own][at[hit]] == docs[hit] + start
            partial[hit] += long[i][1][own][at[hit]]
        best.add(partial, docs + start)
    return best


def _maxima(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The largest value between each two cuts, 0 where there is none."""
    out = np.zeros(len(cuts) - 1, np.int64)
    full = cuts[1:] > cuts[:-1]
    if full.any():
        out[full] = np.maximum.reduceat(values, cuts[:-1][full])
    return out


def _results(shards: DataFrame, queries: list[tuple[int, dict[bytes, int], int]], documents: int, length: int, k: int) -> DataFrame:
    """``item``, ``doc``, ``score``: each shard's best documents for each query, given with its number and its threshold."""
    held = shards.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("search")
        reached = {number: least for number, _, least in held.value}
        for batch in batches:
            for row in range(batch.num_rows):
                lists = read_shard(batch, row, documents, length)
                found = []
                for number, query, _ in held.value:
                    best = best_of_shard(lists, query, k, reached[number])
                    reached[number] = best.least
                    found.append(best)
                sizes = [len(b.scores) for b in found]
                item = np.repeat(np.array([number for number, *_ in held.value], np.int32), sizes)
                places, scores = (np.concatenate([np.empty(0, np.int64), *x]) for x in ([b.places for b in found], [b.scores for b in found]))
                yield pa.RecordBatch.from_arrays([pa.array(item), lists.ids.take(pa.array(places)), pa.array(scores)], ["item", "doc", "score"])
        give_back()

    return shards.mapInArrow(run, "item int, doc long, score long")


def _first(results: DataFrame, k: int) -> DataFrame:
    """The k best of each item. Each task keeps its own k best before anything is shuffled."""
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc").asc_nulls_last())
    return results.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _blocks(items: DataFrame, text: str) -> Callable[[], Iterator[list[tuple]]]:
    """Distinct items in blocks of about ``QUERY_BYTES`` of text, by a hash of the item."""
    size = items.select(F.sum(F.octet_length(text))).first()[0] or 0
    parts = size // QUERY_BYTES + 1

    def each() -> Iterator[list[tuple]]:
        for part in range(parts):
            yield [tuple(r) for r in items.filter(F.pmod(F.xxhash64("item_id", text), F.lit(parts)) == part).collect()]

    return each


def search(docs: DataFrame, items: DataFrame, k: int = TOP, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id") -> DataFrame:
    """``item_id``, ``rank``, ``doc_id``, ``score``: the k documents of highest score above 0 for each item, equal scores by key.

    Items without a term, or whose terms no document holds, have no rows; null texts have no terms. Rows of ``items`` that repeat count once; rows that share a
    key but not a text are items of their own. Rows of ``docs`` that repeat are each a document; a null key comes last among equal scores.
    Only keys and texts are read, so no other column can clash. Empty tables give an empty result."""
    spark = docs.sparkSession
    asked = items.select(F.col(item_key).cast("long").alias("item_id"), F.col(item_text).alias("text")).distinct()
    found: DataFrame | None = None
    for block in _blocks(asked, "text")():
        of_item = [Counter(terms_of(t)) for _, t in block]
        vocabulary = frozenset().union(*of_item)
        shards = materialise(index(docs, vocabulary, text, key))
        documents, length, holding = statistics(shards, vocabulary)
        weight = {t: weight_of(documents, n) for t, n in holding.items()}
        queries = [(i, {t: n * weight[t] for t, n in of.items() if t in weight}, 0) for i, of in enumerate(of_item)]
        queries = [q for q in queries if q[1]]
        few = _prime(shards)
        reached = {r["item"]: r["score"] for r in _first(_results(few, queries, documents, length, k), k).filter(F.col("rank") == k).collect()}
        queries = [(i, q, reached.get(i, 0)) for i, q, _ in queries]
        best = _first(_results(shards, queries, documents, length, k), k)
        names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], "item int, item_id long")
        own = best.join(F.broadcast(names), "item").select("item_id", "rank", F.col("doc").alias("doc_id"), "score")
        found = materialise(own) if found is None else found.unionByName(materialise(own))
    return found


def _prime(shards: DataFrame) -> DataFrame:
    """An eighth of the shards, but about ``PRIMING`` of them at most: their results bound those of all from below."""
    share = max(8, -(-shards.count() // PRIMING))
    return shards.filter(F.pmod(F.xxhash64("ids"), F.lit(share)) == 0)


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH words AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
lengths AS (SELECT doc_id, count(*)::BIGINT AS n FROM words GROUP BY 1),
total AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM lengths),
asked AS (SELECT item_id, term, count(*)::BIGINT AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY 1, 2),
held AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM words SEMI JOIN asked USING (term) GROUP BY 1, 2),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM held, total GROUP BY 1),
hits AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))) AS part FROM held JOIN weights USING (term) JOIN lengths USING (doc_id), total),
scores AS (SELECT item_id, doc_id, sum(times * part)::BIGINT AS score FROM asked JOIN hits USING (term) GROUP BY 1, 2)
SELECT item_id, rank, doc_id, score FROM (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scores WHERE score > 0)
WHERE rank <= 10
"""
