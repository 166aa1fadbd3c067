"""Packing along a space-filling curve.

Each document becomes a hashed vector of its tokens, projected to a few dimensions; the Hilbert index of
that point is its place on the curve. A range sort by this key puts like documents next to each other, and
each range is cut into sequences from its start to its end. A sequence is full, except that the rest of a
range is laid out in sequences of falling powers of two, which need no padding.

Null and empty texts have the end token alone. Documents may be of any length: a piece never exceeds a
sequence. Equal keys are dealt by document id, so that a large group of copies is no hot range; rows that
are equal in both are packed each on its own. An empty table gives no sequence.
"""

from __future__ import annotations

import gc
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, kept_by_worker, materialise, small_batches, table, take_over
from .words import Key, WordCache, cut_words, slices, text_of

SEQUENCE = 2048
END_ID = 1
TOKENIZER = "byte_bpe_50k.json"
DIMENSIONS, BITS = 4, 10
BUCKETS = 1 << 16  # of hashed tokens
SEED = 4_096
BLANK = re.compile(r"\s")
LINES = 4_096  # pieces encoded as one text


def _ranks(vocabulary: dict[str, int]) -> dict[bytes, int]:
    """A byte-level vocabulary by bytes. Its characters stand for bytes: printable ones for themselves, the others, in order,
    for the characters from 256 on; an id is the rank of the merge that makes it."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    byte = {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(others)}
    return {bytes(byte[c] for c in t): i for t, i in vocabulary.items()}


class Encoder:
    """Ids of texts by a ``tokenizers`` file, each distinct piece of a word encoded once. The pieces' merges are replayed by the
    tiktoken library from the ranks in that file, several times faster than ``tokenizers`` itself would; that this is the same
    tokenizer is checked when it is loaded. Texts that hold an added token go to ``tokenizers``.

    Many pieces are encoded as the lines of one text: the id of a line's end then parts them."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        gc.set_threshold(100_000, 50, 100)  # the cache's many small objects never form cycles
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        ranks = _ranks({t: i for t, i in vocabulary.items() if t not in self.added})
        self.id_type = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._check(path, ranks)
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        (self.line_end,) = self.ids("\n")
        self.cache = WordCache(self.learn, self.split)

    def _check(self, path: str, ranks: dict[bytes, int]) -> None:
        """Merges stand in the order of the ids that they make, and texts of every kind of character give equal ids."""
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        made = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        probe = "".join(map(chr, [*range(1, 0x500), *range(0x2000, 0x2100), *range(0x4E00, 0x4E40), *range(0x1F600, 0x1F610)]))
        probes = [probe, "It's 12,345.60  tabs\t\tand\r\n\n ends  ", " ".join(t.decode("utf-8", "replace") for t in list(ranks)[::7]) + " "]
        plain = [p for p in probes if not any(t in p for t in self.added)]
        if made != sorted(made) or any(self.tokenizer.encode(p, add_special_tokens=False).ids != self.plain.encode_ordinary(p) for p in plain):
            raise ValueError(f"{path} is not a byte-level BPE with merges in the order of ids and the pattern of public_tokenizers")

    def ids(self, text: str) -> np.ndarray:
        return self.plain.encode_to_numpy(text, disallowed_special=()).astype(self.id_type)

    def learn(self, words: list[Key], known: dict[Key, bytes]) -> None:
        new = cut_words(words, self.split, known)
        blank = [BLANK.search(p if type(p) is str else p[0]) for p in new.pieces]
        whole, rest = [p for p, b in zip(new.pieces, blank, strict=True) if not b], [p for p, b in zip(new.pieces, blank, strict=True) if b]
        for at in range(0, len(new.plain), LINES):
            part = new.plain[at : at + LINES]
            self._lines(part, " " + "\n ".join(part), known, rest)
        for at in range(0, len(whole), LINES):
            part = whole[at : at + LINES]
            self._lines(part, "\n".join(map(text_of, part)), known, rest)
        for p in rest:
            known[p] = self.ids(text_of(p)).tobytes()
        new.join(known)

    def _lines(self, part: list[Key], text: str, known: dict[Key, bytes], rest: list[Key]) -> None:
        """Encode pieces as lines of one text; they are left for later if a line's end doesn't stand between each two of them."""
        ids = self.ids(text)
        ends = np.flatnonzero(ids == self.line_end)
        if len(ends) + 1 != len(part):
            rest += part
            return
        data, size = ids.tobytes(), ids.itemsize
        starts = [0, *((ends + 1) * size).tolist()]
        known.update(zip(part, map(data.__getitem__, map(slice, starts, [*(ends * size).tolist(), len(data)])), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        whole = {i: np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, self.id_type).tobytes() for i, t in enumerate(texts) if any(a in t for a in self.added)}
        found = self.cache.encode(["" if i in whole else t for i, t in enumerate(texts)] if whole else texts)
        return [whole.get(i, x) for i, x in enumerate(found)] if whole else found


@kept_by_worker
@lru_cache(2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


@lru_cache(1)
def _projection() -> np.ndarray:
    """One random direction for each bucket of hashed tokens."""
    return np.random.Generator(np.random.PCG64(SEED)).standard_normal((BUCKETS, DIMENSIONS)).astype(np.float32)


def points(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of documents whose ids follow each other up to ``ends``: directions of the projected count vectors (logarithms of counts),
    each coordinate as an integer of ``BITS`` bits."""
    doc = np.repeat(np.arange(len(ends), dtype=np.uint64), np.diff(ends, prepend=0))
    pairs = np.sort(doc << np.uint64(32) | ids)
    first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
    counts = np.diff(first, append=len(pairs))
    pairs = pairs[first]
    bucket = ((pairs & np.uint64(0xFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype(np.int64) % BUCKETS
    start = np.searchsorted(pairs >> np.uint64(32), np.arange(len(ends), dtype=np.uint64))
    v = np.add.reduceat(np.log1p(counts)[:, None] * _projection()[bucket], start)
    size = np.linalg.norm(v, axis=1, keepdims=True)
    return np.clip((v / np.where(size > 0, size, 1) + 1) * 2 ** (BITS - 1), 0, 2**BITS - 1).astype(np.uint32)


def hilbert_key(points: np.ndarray) -> np.ndarray:
    """Place on the Hilbert curve of each row of an (n, dimensions) array of coordinates below 2**BITS.

    Gray-code corner by corner from the coarsest bit: at each level the cell's bits are reflected and
    exchanged so that consecutive cells share a face."""
    x = points.astype(np.uint64).T.copy()
    dims = len(x)
    for level in range(BITS - 1, 0, -1):
        bit, low = np.uint64(1 << level), np.uint64((1 << level) - 1)
        for d in range(dims):
            set_ = (x[d] & bit) != 0
            swap = np.where(set_, np.uint64(0), (x[0] ^ x[d]) & low)
            x[0] ^= np.where(set_, low, np.uint64(0)) ^ swap
            x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    turn = np.zeros_like(x[0])
    for level in range(BITS - 1, 0, -1):
        turn ^= np.where((x[-1] & np.uint64(1 << level)) != 0, np.uint64((1 << level) - 1), np.uint64(0))
    x ^= turn
    key = np.zeros_like(x[0])
    for level in range(BITS - 1, -1, -1):
        for d in range(dims):
            key = (key << np.uint64(1)) | ((x[d] >> np.uint64(level)) & np.uint64(1))
    return key.astype(np.int64)


def tokenised(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id``, ``curve`` (Hilbert key), ``width`` (bytes of an id) and ``ids`` (little-endian, unsigned) with the end token last."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("packing")
        encoder = _encoder(path)
        kind = np.dtype(encoder.id_type)
        end = np.array([END_ID], kind).tobytes()
        for batch in batches:
            at = 0
            for texts in slices(batch.column(1)):
                found = [x + end for x in encoder.encode(texts)]
                ends = np.cumsum([len(x) for x in found]) // kind.itemsize
                curve = hilbert_key(points(np.frombuffer(b"".join(found), kind).astype(np.uint64), ends))
                width = pa.array(np.full(len(texts), kind.itemsize, np.int8))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(curve), width, pa.array(found, pa.binary())], ["doc_id", "curve", "width", "ids"])
                at += len(texts)
        give_back()

    small_batches(docs.sparkSession)
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(encode, "doc_id long, curve long, width byte, ids binary")


class _Sequences:
    """Cuts documents, one after the other, into the sequences of one range."""

    def __init__(self, first: int):
        self.sequence, self.filled, self.open, self.closed = first, 0, [], []

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        start = 0
        while start < len(ids):
            part = ids[start : start + SEQUENCE - self.filled]
            self.open.append((doc, start, part, len(ids), self.sequence, self.filled))
            start, self.filled = start + len(part), self.filled + len(part)
            if self.filled == SEQUENCE:
                self.closed += self.open
                self.sequence, self.filled, self.open = self.sequence + 1, 0, []

    def finish(self) -> None:
        """Lay the rest out anew in sequences of falling powers of two."""
        rest, pieces = self.filled, list(self.open)
        while rest:
            room, at = 1 << (rest.bit_length() - 1), 0
            rest -= room
            while at < room:
                doc, start, ids, total, _, _ = pieces.pop(0)
                part = ids[: room - at]
                if len(part) < len(ids):
                    pieces.insert(0, (doc, start + len(part), ids[len(part) :], total, 0, 0))
                self.closed.append((doc, start, part, total, self.sequence, at))
                at += len(part)
            self.sequence += 1
        self.open, self.filled = [], 0

    def take(self) -> pa.RecordBatch:
        rows, self.closed = self.closed, []
        doc, start, ids, total, sequence, offset = zip(*rows, strict=True) if rows else [()] * 6
        columns = [doc, start, list(map(len, ids)), [zlib.crc32(x.astype("<u4").tobytes()) for x in ids], total, sequence, offset]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], PIECE)


PIECE = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack(docs: DataFrame, path: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per piece of a document: which of its ids lie where in which sequence. The texts are encoded once,
    into a table in the shared folder; ranges are sorted and cut in streams that hold one open sequence."""
    source = materialise(tokenised(docs, path or public_tokenizers.path(TOKENIZER), text, key))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequences = _Sequences(TaskContext.get().partitionId() << 40)
        for batch in batches:
            for doc, width, ids in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                sequences.add(doc.as_py(), np.frombuffer(ids.as_buffer(), f"<u{width.as_py()}"))
            yield sequences.take()
        sequences.finish()
        yield sequences.take()
        give_back()

    ranged = source.repartitionByRange("curve", "doc_id").sortWithinPartitions("curve", "doc_id")
    return ranged.select("doc_id", "width", "ids").mapInArrow(cut, ", ".join(f"{c} long" for c in PIECE))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document in its sequence."""
    return pack(table(spark, sf_dir, "documents"))
