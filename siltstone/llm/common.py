"""Pieces shared by the training-data operators.

Text leaves the JVM only as Arrow buffers.  Everything here works on whole
Arrow buffers with numpy: no per-character or per-word Python loop.
"""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text handled at once by one numpy pass (a longer single text is handled alone).
CHUNK_BYTES = 2 << 20

_MULT = np.uint64(0x9E3779B97F4A7C15)
_MULT_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The table ``name`` of the folder, with the named columns only."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder's URI below ``spark.checkpoint.dir``, which every executor shares.

    Where the setting is absent, as in tests on one machine, a local folder is
    used; on a cluster that is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "siltstone-shared")
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Returns to the system the memory that this process has freed, and that of the tables of powers."""
    _POWERS.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, after which its task gives memory back.

    Workers outlive tasks and stages, and allocators keep what was freed: a
    worker would hold the most that any stage ever took, beside the executor.
    """

    @wraps(run)
    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return own


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, vectorised."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the rolling multiplier and of its inverse."""
    if len(_POWERS.get("p", ())) < n:
        size = max(n, CHUNK_BYTES + 1)
        one = np.ones(1, np.uint64)
        _POWERS["p"] = np.concatenate([one, np.cumprod(np.full(size - 1, _MULT, np.uint64))])
        _POWERS["i"] = np.concatenate([one, np.cumprod(np.full(size - 1, _MULT_INV, np.uint64))])
    return _POWERS["p"][:n], _POWERS["i"][:n]


def as_strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One string array (64-bit offsets) without nulls: a null text counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    return column.fill_null("") if column.null_count else column


def normalised(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """Lower case, every run of characters that are neither letters nor digits made one space."""
    return pc.replace_substring_regex(pc.utf8_lower(as_strings(column)), r"[^\p{L}\p{N}]+", " ")


def raw(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and the offsets of its items in them."""
    offsets = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
    data = strings.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about ``size`` bytes in the text column each."""
    if batch.num_rows == 0:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(lengths) // size
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [batch.num_rows]])
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield batch.slice(a, b - a)


def word_hashes(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of normalised texts: a 64-bit hash of every word, in order, and the words before each text's first.

    The second array has one item more than there are texts.  A word's hash is
    the difference of two prefix sums of a polynomial, so the cost is a few
    passes over the bytes, whatever the number of words.
    """
    data, offsets = raw(strings)
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(strings) + 1, np.int64)
    inside = data != 32
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:n]
    starts = np.flatnonzero(begins)
    ends_here = inside
    ends_here[:-1] &= ~inside[1:] | edge[1:n]
    ends = np.flatnonzero(ends_here) + 1
    p, inverse = powers(n)
    value = _BYTE[data]
    value *= p
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(value, out=total[1:])
    hashes = mix((total[ends] - total[starts]) * inverse[starts])
    return hashes, np.searchsorted(starts, offsets)


def ngram_hashes(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every n consecutive words of a text, and the text of each.

    A text of fewer than n words, but at least one, has one n-gram: all of it.
    """
    counts = np.diff(first)
    text = np.repeat(np.arange(len(counts)), counts)
    if len(words) == 0:
        return words, text
    padded = np.concatenate([words, np.zeros(n - 1, np.uint64)])
    last = first[1:][text]
    position = np.arange(len(words))
    gram = np.zeros(len(words), np.uint64)
    for k in range(n):
        gram = mix(gram * _MULT + np.where(position + k < last, padded[k : k + len(words)], np.uint64(0)))
    whole = position == first[:-1][text]
    keep = (position + n <= last) | whole
    return gram[keep], text[keep]
