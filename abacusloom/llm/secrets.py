"""Secret scan: fixed patterns, and strings that a tokenizer's vocabulary can't shorten.

Three kinds of spans come from patterns: ``assign`` (a value given to a name such as ``password``), ``access`` (access key ids) and ``hex``
(long runs of hexadecimal digits). Beside them the token-efficiency test looks at every run of key characters that no pattern has taken:
merges of byte pairs follow words, so that words and names take few tokens, while random strings fall apart into pieces of one or two
characters. A run is a secret (kind ``random``) if its letters and digits, 20 at least, take so many tokens that a token has ``MOST_RATIO``
characters or fewer. At 1.9 that holds for 99 % of random strings of 20 letters and digits and for 95 % of hexadecimal ones, and
for none of the names that the tests list.

Not tested are what is known to look random without being secret: digests (runs of hexadecimal digits of a digest's length, and what follows
a digest's name such as ``sha256-``), UUIDs, and identifiers whose parts between ``_-+/=`` are each a word of letters or a number.

Positions are code points, ends exclusive. Texts are read whole, of any length; null and empty ones have no spans. Only the key and the text
are read, so no other column can clash; rows of equal or null key are each scanned alone. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, kept_by_worker, small_batches, table, take_over
from .words import slices

# The patterns of the three base kinds and the least length of each.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a maximal run: the same as [0-9a-f]+ without the shorter ones
SHORTEST_VALUE, SHORTEST_ACCESS = 6, 20

VOCABULARY = "byte_bpe_50k.tiktoken"
MOST_RATIO = 1.9
SHORTEST_RUN = 20
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
PARTS = re.compile(r"[A-Za-z0-9]+")
UUID = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", re.IGNORECASE | re.ASCII)
DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})", re.IGNORECASE | re.ASCII)
DIGEST_NAME = re.compile(r"(?:md5|sha-?(?:1|224|256|384|512)|blake2b|blake2s|blake3|crc32)[-_:= ]*\Z", re.IGNORECASE | re.ASCII)
DIGEST_RUN = re.compile(r"(?:md5|sha-?(?:1|224|256|384|512))[-_=]", re.IGNORECASE | re.ASCII)
KINDS = ("assign", "access", "hex", "random")
Span = tuple[str, int, int]


def _encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("secrets", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


_kept_encoding = kept_by_worker(lru_cache(1)(_encoding))


def encoding_of(path: str) -> tiktoken.Encoding:
    """The encoding of a rank file, loaded once while a worker keeps it."""
    return _kept_encoding(path)


def base_spans(text: str) -> list[Span]:
    """Of each base kind the leftmost matches that don't overlap, less those that are too short."""
    return [
        *(("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= SHORTEST_VALUE),
        *(("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= SHORTEST_ACCESS),
        *(("hex", *m.span()) for m in HEX.finditer(text)),
    ]


def excluded(run: str, before: str) -> bool:
    """Whether a run is known not to be secret: a digest, a UUID or an identifier of words and numbers. ``before`` is what stands before it."""
    if DIGEST.fullmatch(run) or UUID.fullmatch(run) or DIGEST_RUN.match(run) or DIGEST_NAME.search(before):
        return True
    return all(p.isalpha() or p.isdigit() for p in PARTS.findall(run))


def ratio(run: str, encoding: tiktoken.Encoding) -> float:
    """Characters per token of a run's letters and digits."""
    parts = PARTS.findall(run)
    return sum(map(len, parts)) / max(1, sum(len(encoding.encode_ordinary(p)) for p in parts))


def random_spans(text: str, taken: list[Span], encoding: tiktoken.Encoding, most_ratio: float = MOST_RATIO) -> list[Span]:
    """Runs that overlap no span of ``taken`` and are random by the ratio of their characters to their tokens."""
    found = []
    for m in RUN.finditer(text):
        start, end = m.span()
        if sum(c.isalnum() for c in m[0]) < SHORTEST_RUN or excluded(m[0], text[max(0, start - 12) : start]):
            continue
        if any(a < end and start < b for _, a, b in taken):
            continue
        if ratio(m[0], encoding) <= most_ratio:
            found.append(("random", start, end))
    return found


def spans_of(text: str, encoding: tiktoken.Encoding, most_ratio: float = MOST_RATIO) -> list[Span]:
    """All spans, by start and then by kind as listed in ``KINDS``."""
    base = base_spans(text)
    return sorted(base + random_spans(text, base, encoding, most_ratio), key=lambda s: (s[1], KINDS.index(s[0])))


def find_secrets(docs: DataFrame, text: str = "text", key: str = "doc_id", vocabulary: str | None = None, most_ratio: float = MOST_RATIO) -> DataFrame:
    """One row per document: ``key`` and ``spans``, an array of ``kind``, ``start``, ``end`` in order. ``vocabulary`` is the path of a rank file,
    which every executor has."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("secrets")
        encoding = encoding_of(path)
        for batch in batches:
            at = 0
            for texts in slices(batch.column(1)):
                found = [spans_of(t, encoding, most_ratio) for t in texts]
                ends = pa.array([0, *_running(map(len, found))], pa.int32())
                kind, start, end = zip(*chain.from_iterable(found), strict=True) if any(found) else ((), (), ())
                fields = pa.StructArray.from_arrays([pa.array(kind, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32())], ["kind", "start", "end"])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.ListArray.from_arrays(ends, fields)], ["id", "spans"])
                at += len(texts)
        give_back()

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "id long, spans array<struct<kind string, start int, end int>>").withColumnRenamed("id", key)


def _running(sizes: Iterator[int]) -> Iterator[int]:
    total = 0
    for n in sizes:
        total += n
        yield total


def joined(spans: Column) -> Column:
    """Spans as text: ``kind:start:end``, with commas between them."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, a digest of their spans, and all spans, of rows of ``find_secrets``."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select(key, count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), count("random"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its secrets."""
    return report(find_secrets(table(spark, sf_dir, "documents")))
