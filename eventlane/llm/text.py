"""Helpers shared by the text operators: Arrow access to texts, word splitting and byte-gram hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word is a maximal run of bytes other than these (space and 0x09 to 0x0D); ``bytes.split()`` splits on the same set.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

_M1 = np.uint64(0x9E3779B97F4A7C15)
_M2 = np.uint64(0xC2B2AE3D27D4EB4F)
_S29 = np.uint64(29)
_S32 = np.uint64(32)


def splitmix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (unsigned arrays wrap around)."""
    x = (x + _M1).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_CODE = splitmix(np.arange(256, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))


def join_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of the concatenation of what ``a`` and ``b`` stand for."""
    x = a * _M1
    x += b
    x ^= x >> _S29
    x *= _M2
    x ^= x >> _S32
    return x


def widen(h: np.ndarray, have: int, want: int) -> np.ndarray:
    """Hashes of runs of ``have`` items to hashes of runs of ``want`` items, by doubling."""
    while have * 2 <= want:
        h, have = join_hash(h[:-have], h[have:]), have * 2
    if have < want:
        h = join_hash(h[: len(h) - (want - have)], h[want - have :])
    return h


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = 1
    while n * 2 <= width:
        x, n = np.minimum(x[:-n], x[n:]), n * 2
    if n < width:
        x = np.minimum(x[: len(x) - (width - n)], x[width - n :])
    return x


def raw(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.binary())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf, off


def texts(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """Each text as bytes; null as empty."""
    buf, off = raw(column)
    view = memoryview(np.ascontiguousarray(buf))
    return [bytes(view[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]


def id_text(docs: DataFrame, *more: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the named columns, under names of our own: extra columns of any name do no harm."""
    return docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"), *[docs[c] for c in more])


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What this worker keeps from task to task, by the operator's name for it: one thing only.
_HELD: dict = {}


def held(name, make):
    """What ``make`` gives, made once in this worker as long as nothing else is held or released."""
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = make()
    return _HELD[name]


def release() -> None:
    """Lets go what tasks of another operator left in this worker: it would count as memory of an operator that does not use it."""
    _HELD.clear()


def crc_bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null ids give null."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))
