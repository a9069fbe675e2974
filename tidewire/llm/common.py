"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import components, durable, local_roots

__all__ = ["SPACED_BYTES", "WORD_BYTES", "alnum_words", "batches_of", "byte_sizes", "components", "crc_mod", "durable", "filter_by_text", "free_names", "give_back", "hashed_words", "local_roots", "mixed", "read", "slices", "spaced_words", "texts", "whole_row"]

#: Maps A-Z to a-z, keeps digits, a-z and every byte of 0x80 and above, and turns all else into a space.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


#: Maps A-Z to a-z and the bytes 0x09 to 0x0D to a space.
SPACED_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x20 if 0x09 <= b <= 0x0D else b for b in range(256))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of the data directory."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def slices(batches, rows: int = 500):
    """Arrow batches in parts of few rows, so that what is made of texts at once is small; memory goes back at the end."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)
    give_back()


def give_back() -> None:
    """Return memory that this worker no longer uses to the machine, since idle workers stay beside the heap."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def texts(batch) -> list[bytes]:
    """The column ``text`` of an Arrow batch as UTF-8 bytes; null counts as empty."""
    import pyarrow as pa

    column = batch.column(batch.schema.get_field_index("text"))
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def byte_sizes(column) -> list[int]:
    """Bytes of each value of a large_binary column without nulls."""
    if not len(column):
        return []
    return np.diff(np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]).tolist()


def batches_of(sizes: list[int], most: int):
    """Ranges (first, end) of items in a row that hold ``most`` bytes at most, or one item."""
    first = total = 0
    for k, size in enumerate(sizes):
        if k > first and total + size > most:
            yield first, k
            first, total = k, 0
        total += size
    if first < len(sizes):
        yield first, len(sizes)


def filter_by_text(df: DataFrame, text_col: str, predicate) -> DataFrame:
    """Rows of ``df`` for whose texts ``predicate()`` holds; all columns pass through unchanged.

    ``predicate`` makes, once per task, a function from a list of UTF-8 texts to a list of booleans.
    """

    def run(batches):
        import pyarrow as pa

        decide = predicate()
        for batch in batches:
            column = batch.column(place).cast(pa.large_binary()).to_pylist()
            yield batch.filter(pa.array(decide([b"" if x is None else x for x in column]), pa.bool_()))

    place = df.columns.index(text_col)
    return df.mapInArrow(run, df.schema)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of ``df`` has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def whole_row(df: DataFrame) -> Column:
    """All columns of ``df`` as the one column ``row``."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")


#: Bytes of a text that are hashed at once, and the longest word that is hashed by its table.
SEGMENT, TABLED = 1 << 20, 64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers after which every bit depends on all."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A number for each byte at each place of a word; places and bytes are told apart by numbers without a pattern.
_TABLE = mixed(np.arange(1, TABLED * 256 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def hashed_words(plain: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes, first bytes and ends of the words of a text whose separators are spaces; no step is taken word by word.

    A word's hash is the sum of its bytes' numbers, which depend on the place (tabulation); a word longer than ``TABLED`` bytes
    has its BLAKE2b digest. So no words collide by their form, as they would under a polynomial modulo a power of two.
    """
    if len(plain) > SEGMENT and (cut := plain.rfind(b" ", 0, SEGMENT) + 1 or plain.find(b" ", SEGMENT) + 1):
        parts, at = [], 0
        while at < len(plain):
            end = len(plain) if len(plain) - at <= SEGMENT else plain.rfind(b" ", at, at + SEGMENT) + 1 or plain.find(b" ", at + SEGMENT) + 1 or len(plain)
            h, starts, ends = _hashed(plain[at:end])
            parts.append((h, starts + at, ends + at))
            at = end
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    return _hashed(plain)


def _hashed(plain: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(plain, np.uint8)
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = raw != 32
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends
    size = ends - starts
    begins = np.cumsum(size) - size
    place = np.minimum(np.arange(begins[-1] + size[-1]) - np.repeat(begins, size), TABLED - 1)
    with np.errstate(over="ignore"):
        h = mixed(np.add.reduceat(_TABLE[place * 256 + raw[inside[1:-1]]], begins))
    for k in np.flatnonzero(size > TABLED).tolist():
        h[k] = int.from_bytes(hashlib.blake2b(plain[starts[k] : ends[k]], digest_size=8).digest(), "little")
    return h, starts, ends


def alnum_words(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z only) words of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``."""
    return text.translate(WORD_BYTES).split()


def spaced_words(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z only) words of ``[^\\x20\\x09-\\x0D]+``."""
    return text.lower().split()


def crc_mod(column: Column, modulus: int) -> Column:
    """crc32 of an id written as text, modulo ``modulus``; null stays null."""
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(modulus))
