"""Byte-level BPE encoding by corpus-level merge replay, and decoding.

The distinct words of a slice of the corpus are laid out in one chain of tokens. An inverted index leads
from each mergeable pair to the places where it stands; pairs are replayed in rank order, each merge
touches its two neighbours only, and so every distinct word is encoded once however often it occurs. The
slices are batches of whole documents; a worker keeps the words it has met, up to a bound, and an evicted word
is simply encoded again. No row is shuffled.

Null and empty texts have no ids. Special tokens' strings are ordinary text. Texts of any length are encoded whole. Rows that occur twice are
encoded twice alike; an empty table gives an empty result. Only the key and the text are read, so other columns can't clash.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from heapq import heappop, heappush
from struct import pack

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, kept_by_worker, small_batches, table, take_over
from .words import Key, WordCache, cut_words, slices, text_of

RANKS = "byte_bpe_multi_50k.tiktoken"
MOST_PAIRS = 500_000  # whose rank is kept, some 60 MB; of others it is looked up again
MOST_BYTES = 200_000_000  # of words kept by a worker: a replay is dear


@kept_by_worker
@lru_cache(2)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class Replay:
    """Encodes words by the ranks of a vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.pairs: dict[int, int] = {}
        self.cache = WordCache(self.learn, self.split, MOST_BYTES)

    def rank(self, a: int, b: int) -> int:
        """Rank of the token that the pair makes, or -1."""
        found = self.pairs.get(a << 32 | b)
        if found is None:
            found = self.ranks.get(self.bytes_of[a] + self.bytes_of[b], -1)
            if len(self.pairs) < MOST_PAIRS:
                self.pairs[a << 32 | b] = found
        return found

    def replay(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each of the ``words``: all merges of all of them, in rank order.

        ``token`` is one chain of all words with -1 after each; a merge leaves -2 where its right half was, and
        ``left`` and ``right`` lead from each token over such gaps to its neighbours."""
        token: list[int] = []
        end: list[int] = []
        single = self.single
        for p in words:
            token += map(single.__getitem__, p)
            token.append(-1)
            end.append(len(token))
        size = len(token)
        left, right = list(range(-1, size - 1)), list(range(1, size + 1))
        index: dict[int, list[int]] = {}
        rank, known = self.rank, self.pairs.get
        a = -1
        for at, b in enumerate(token, -1):
            if a >= 0 and b >= 0:
                r = known(a << 32 | b)
                if r is None:
                    r = rank(a, b)
                if r >= 0:
                    if r in index:
                        index[r].append(at)
                    else:
                        index[r] = [at]
            a = b
        heap = sorted(index)

        def note(at: int, a: int, b: int) -> bool:
            """Add a pair to the index; whether it precedes the pair that is being merged."""
            new = known(a << 32 | b)
            if new is None:
                new = rank(a, b)
            if new < 0:
                return False
            if new in index:
                index[new].append(at)
            else:
                index[new] = [at]
                heappush(heap, new)
            return new < r

        while heap:
            r = heappop(heap)
            places = index.pop(r)
            places.sort()
            for n, i in enumerate(places):
                a, j = token[i], right[i]
                if a < 0:
                    continue
                b = token[j]
                if b < 0 or known(a << 32 | b, -3) != r and rank(a, b) != r:
                    continue
                token[i], token[j] = r, -2
                k, h = right[j], left[i]
                right[i], left[k] = k, i
                b, a = token[k], token[h] if h >= 0 else -1
                lower = b >= 0 and note(i, r, b)
                if a >= 0 and note(h, a, r) or lower:  # the new pair comes first; the rest of this one waits
                    rest = places[n + 1 :]
                    if rest:
                        if r in index:
                            index[r] += rest
                        else:
                            index[r] = rest
                            heappush(heap, r)
                        break
        out, start = [], 0
        for e in end:
            out.append([t for t in token[start : e - 1] if t >= 0])
            start = e
        return out

    def learn(self, words: list[Key], known: dict[Key, bytes]) -> None:
        """Encode new words, each cut by the pattern into pieces that merge on their own."""
        parts = cut_words(words, self.split, known)
        new = [*parts.plain, *parts.pieces]
        raw = [text_of(p).encode("utf-8", "replace") for p in new]
        to_merge = [b for b in raw if b not in self.ranks]
        ids = dict(zip(to_merge, self.replay(to_merge), strict=True))
        for p, b in zip(new, raw, strict=True):
            found = ids.get(b)
            known[p] = pack(f"<{len(found)}I", *found) if found is not None else pack("<I", self.ranks[b])
        parts.join(known)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        return self.cache.encode(texts)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@kept_by_worker
@lru_cache(2)
def _replay(path: str, pattern: str) -> Replay:
    return Replay(load_ranks(path), pattern)


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key`` and ``ids`` (binary, little-endian unsigned 32-bit)."""
    path, pattern = path or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("bpe")
        replay = _replay(path, pattern)
        for batch in batches:
            at = 0
            for texts in slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(replay.encode_all(texts), pa.binary())], [key, "ids"])
                at += len(texts)
        give_back()

    small_batches(docs.sparkSession)
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, ids binary")


def decode(encoded: DataFrame, path: str | None = None, ids: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded`` (binary) in place of its ids."""
    path, pattern = path or public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    small_batches(encoded.sparkSession)

    @F.pandas_udf("binary")
    def bytes_of(values: pd.Series) -> pd.Series:
        replay = _replay(path, pattern)
        return values.map(lambda x: replay.decode(x or b""))

    return encoded.withColumn("decoded", bytes_of(ids)).drop(ids)


def round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Encode and decode in one pass, for digests: ``n_tokens``, ``ids_sha256``, ``decoded_sha256``."""
    path, pattern = path or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("bpe")
        replay = _replay(path, pattern)
        for batch in batches:
            at = 0
            for texts in slices(batch.column(1)):
                ids = replay.encode_all(texts)
                columns = [
                    batch.column(0).slice(at, len(texts)),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([sha256(x).hexdigest() for x in ids]),
                    pa.array([sha256(replay.decode(x)).hexdigest() for x in ids]),
                ]
                yield pa.RecordBatch.from_arrays(columns, [key, "n_tokens", "ids_sha256", "decoded_sha256"])
                at += len(texts)
        give_back()

    small_batches(docs.sparkSession)
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's ids and what they decode to, by digests."""
    return round_trip(table(spark, sf_dir, "documents"))
