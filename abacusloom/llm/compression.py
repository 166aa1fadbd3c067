"""Compressed sizes under raw-content dictionaries: what language identification and the quality classifier share."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVEL, SHORTEST = 3, 4  # matches from four bytes on: syllables count
BLOCK = 16_384  # bytes compressed at a time, so that a long text doesn't become its own dictionary
DRAWS = 1_000_000


class Sizer:
    """Sizes under each of some dictionaries. A task makes one and drops it with its last row."""

    def __init__(self, dictionaries: Sequence[bytes]):
        settings = zstandard.ZstdCompressionParameters.from_level(LEVEL, min_match=SHORTEST, write_content_size=0, write_checksum=0, write_dict_id=0)
        self.frame = len(zstandard.ZstdCompressor(compression_params=settings).compress(b""))  # bytes that hold no text
        self.compressors = []
        for content in dictionaries:
            held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(compression_params=settings)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=held, compression_params=settings))

    def sizes(self, text: bytes) -> list[int]:
        """Bytes that ``text``, block by block, takes with each dictionary."""
        blocks = [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]
        return [sum(max(0, len(c.compress(b)) - self.frame) for b in blocks) for c in self.compressors]


def dictionary(passages: Sequence[str], most: int) -> bytes:
    """Passages one after the other, up to ``most`` bytes; the last one may be cut."""
    out = bytearray()
    for p in passages:
        out += p.encode("utf-8", "replace") + b"\n"
        if len(out) >= most:
            break
    return bytes(out[:most])


def drawn(rows: DataFrame, kind: str, key: str, counts: Mapping, most: int, salt: str = "") -> DataFrame:
    """About ``most`` rows of each kind, by a hash of their key; ``counts`` has the rows of each kind. So the sample is bounded
    whatever the size of the table."""
    share = F.lit(0.0)
    for k, n in counts.items():
        share = F.when(F.col(kind) == k, min(1.0, most / max(1, n))).otherwise(share)
    return rows.filter(F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(salt)), F.lit(DRAWS)) / DRAWS < share)


def halves(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows in two halves by a hash of their key: dictionaries from one, calibration from the other, which no dictionary holds."""
    first = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("half")), F.lit(2)) == 0
    return rows.filter(first), rows.filter(~first)


def passages(rows: DataFrame, kind: str, text: str, key: str, chars: int) -> DataFrame:
    """``kind``, ``draw``, ``passage``: one passage of each row, at a place of its text that a hash of the key draws."""
    draw = F.xxhash64(F.col(key).cast("string"))
    start = (F.pmod(draw, F.greatest(F.lit(0), F.length(text) - chars) + 1) + 1).cast("int")
    return rows.select(F.col(kind).alias("kind"), draw.alias("draw"), F.substring(F.col(text), start, F.lit(chars)).alias("passage"))
