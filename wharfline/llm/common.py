"""What the operators share: scratch tables in the cluster's shared folder, Arrow chunking and vectorised word hashing."""

from __future__ import annotations

import contextlib
import ctypes
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from ..session import store

CHUNK_BYTES = 1 << 20
BATCH_BYTES = 4 << 20
BATCH_ROWS = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts the lineage and survives lost executors."""
    return store(df, name)


def carried(columns: list[str] | None) -> list[Column]:
    """A struct ``carried`` of the named columns, or nothing: other columns of a row that go with it."""
    return [] if columns is None else [F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`").alias(c) for c in columns]).alias("carried")]


def with_fields(schema: StructType, ddl: str) -> StructType:
    """The schema with further fields."""
    return StructType([*schema, *_parse_datatype_string(ddl)])


def crc_mod(column: str, modulus: int):
    """crc32 of the id written as text, modulo ``modulus``; null ids count as the empty string."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


# ---------------------------------------------------------------- Arrow chunks


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's bounds on Arrow batches, so that long texts do not pile up on either side of the Python workers."""
    for key, bound in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)):
        now = re.sub(r"\D", "", str(spark.conf.get(key)))
        if not now or int(now) > bound:
            spark.conf.set(key, str(bound))


def release() -> None:
    """Give freed memory back to the system; Python workers live on between stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (from 0) of a string array; nulls are empty."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or offs[-1] == offs[0]:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with at most ``limit`` bytes of text each (a longer text stands alone), with bytes and offsets."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        data, offs = raw(batch.column(text))
        at = 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at), data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
            at = to
        del batch, data, offs
    release()


BLOCK = 4096


def add_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of compressed blocks of counts by block, as compressed 64-bit numbers."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for b, c in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist()):
            total.setdefault(b, np.zeros(BLOCK, np.uint64))
            total[b] += np.frombuffer(zstandard.decompress(c), np.uint32)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([zstandard.compress(c.tobytes(), 1) for c in total.values()], pa.binary())], names=["block", "counts"])


def counted(source: DataFrame, cells: int, places) -> np.ndarray:
    """How often ``places(data, offs)`` gives each of the numbers below ``cells`` (a multiple of BLOCK), over all slices of the column ``text``.

    Each task adds up its own; the blocks of all tasks are added up by block. ``cells`` bounds what reaches the driver.
    """

    def own(batches):
        total = np.zeros(cells, np.uint32)
        for _, data, offs in chunks(batches, "text"):
            np.add.at(total, places(data, offs), np.uint32(1))
        blocks = total.reshape(-1, BLOCK)
        live = np.flatnonzero(blocks.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(live, pa.int32()), pa.array([zstandard.compress(blocks[i].tobytes(), 1) for i in live], pa.binary())], names=["block", "counts"])

    out = np.zeros((cells // BLOCK, BLOCK), np.uint64)
    for r in source.select("text").mapInArrow(own, "block int, counts binary").repartition("block").mapInArrow(add_blocks, "block int, counts binary").collect():
        out[r.block] = np.frombuffer(zstandard.decompress(r.counts), np.uint64)
    return out.ravel()


# ---------------------------------------------------------------- words and hashes

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_LOWER_BYTES = LOWER.tobytes()

#: ``[^\x20\x09-\x0D]+``
NON_SPACE = np.ones(256, bool)
NON_SPACE[[32, *range(9, 14)]] = False
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z
ALNUM = np.zeros(256, bool)
ALNUM[list(range(48, 58)) + list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = True

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE = _BYTE[LOWER]
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def word_spans(data: np.ndarray, offs: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words and, for each document, the index of its first word (one more entry at the end)."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offs), np.int64)
    inside = word[data]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    first = np.ones(n, bool)
    np.logical_not(inside[:-1], out=first[1:])
    first |= edge[:-1]
    first &= inside
    last = np.ones(n, bool)
    np.logical_not(inside[1:], out=last[:-1])
    last |= edge[1:]
    last &= inside
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words with A-Z lower-cased: a polynomial over random byte values, from prefix sums."""
    if not len(starts):
        return np.empty(0, np.uint64)
    power, inverse = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[: len(data)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * inverse[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def lowered(data: np.ndarray) -> bytes:
    return data.tobytes().translate(_LOWER_BYTES)


class Numbering:
    """Finds 64-bit hashes in a sorted set of them: numbers from 1, 0 for absent ones. A direct table over the top bits leads to the few candidates."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(8, len(keys).bit_length() + 3)
        self.slot = np.searchsorted(keys >> np.uint64(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=np.uint64)).astype(np.int32)

    def of(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), np.int64)
        top = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.slot[top], self.slot[top + 1]
        live = np.flatnonzero(at < end)
        at, end = at[live], end[live]
        while len(live):
            hit = self.keys[at] == h[live]
            out[live[hit]] = at[hit] + 1
            at = at + 1
            more = ~hit & (at < end)
            live, at, end = live[more], at[more], end[more]
        return out
