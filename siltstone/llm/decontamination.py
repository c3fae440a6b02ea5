"""Benchmark decontamination by Wu-Manber multi-pattern search.

The test strings are all windows of ``window`` consecutive words of the
benchmark items (an item of fewer words is one test string).  Texts and items
are lower-cased and every run of other characters than letters and digits is
one space, so case, punctuation and line breaks do not hide a leak.

A table of shifts, indexed by a hash of a block of bytes, says how far a search
may jump when that block ends at the current position; the jumps of thousands
of stretches of a text buffer are made together with numpy.  Where the shift
is zero the last block of the pattern prefix, with its first one, selects the
test strings in question, and bytes are compared directly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import normalised, raw, released, slices

_HASH = np.uint64(0x9E3779B97F4A7C15)


class WuManber:
    """Search tables for a list of byte strings, none of them empty."""

    def __init__(self, patterns: list[bytes], block: int = 8, lanes: int = 4096):
        self.patterns = patterns
        self.lanes = lanes
        self.least = min(map(len, patterns))
        self.block = min(block, self.least)
        self.mask = np.uint64((1 << (8 * self.block)) - 1)
        heads = np.frombuffer(b"".join(p[: self.least] + b"\0" * 8 for p in patterns), np.uint8)
        heads = heads.reshape(len(patterns), self.least + 8)
        per = self.least - self.block + 1
        self.bits = min(26, max(16, int(np.ceil(np.log2(len(patterns) * per))) + 2))
        self.shift = np.full(1 << self.bits, per, np.int32)
        for end in range(self.block, self.least + 1):
            value = np.ascontiguousarray(heads[:, end - self.block : end - self.block + 8]).view("<u8").ravel()
            np.minimum.at(self.shift, self._slot(value), self.least - end)
        suffix = np.ascontiguousarray(heads[:, per - 1 : per + 7]).view("<u8").ravel() & self.mask
        prefix = np.ascontiguousarray(heads[:, :8]).view("<u8").ravel() & self.mask
        key = self._pair(suffix, prefix)
        order = np.argsort(key, kind="stable")
        self.keys, begin = np.unique(key[order], return_index=True)
        self.buckets = [part.tolist() for part in np.split(order, begin[1:])]

    def _slot(self, value: np.ndarray) -> np.ndarray:
        return (((value & self.mask) * _HASH) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _pair(self, suffix: np.ndarray, prefix: np.ndarray) -> np.ndarray:
        return (suffix * _HASH) ^ (prefix * np.uint64(0xC2B2AE3D27D4EB4F))

    def search(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each occurrence begins, and which pattern it is."""
        n = len(data)
        if n < self.least:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        value = np.ndarray((n,), "<u8", padded, strides=(1,))
        back = self.block - 1
        cuts = np.linspace(self.least - 1, n, min(self.lanes, max(1, n // 256)) + 1).astype(np.int64)
        at, until = cuts[:-1], cuts[1:]
        live = at < until
        at, until = at[live], until[live]
        stops = []
        while len(at):
            jump = self.shift[self._slot(value[at - back])]
            zero = jump == 0
            if zero.any():
                stops.append(at[zero])
                jump[zero] = 1
            at = at + jump
            live = at < until
            if not live.all():
                at, until = at[live], until[live]
        if not stops:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        end = np.concatenate(stops)
        begin = end - self.least + 1
        key = self._pair(value[end - back] & self.mask, value[begin] & self.mask)
        slot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[slot] == key
        whole = data.tobytes()
        found, which = [], []
        for start, bucket in zip(begin[hit].tolist(), slot[hit].tolist()):
            for k in self.buckets[bucket]:
                if whole.startswith(self.patterns[k], start):
                    found.append(start)
                    which.append(k)
        return np.array(found, np.int64), np.array(which, np.int64)


def test_strings(items: list[tuple[int, str | None]], window: int) -> dict[bytes, list[int]]:
    """Each test string, with one space at either end, and the items that have it."""
    texts = normalised(pa.array([t for _, t in items], pa.string())).to_pylist()
    out: dict[bytes, list[int]] = {}
    for (item, _), text in zip(items, texts):
        words = text.split()
        for k in range(max(1, len(words) - window + 1) if words else 0):
            owners = out.setdefault(f" {' '.join(words[k : k + window])} ".encode(), [])
            if item not in owners:
                owners.append(item)
    return out


def _grouped(strings: dict[bytes, list[int]], most: int) -> Iterator[dict[bytes, list[int]]]:
    group, size = {}, 0
    for s, owners in strings.items():
        if group and size + len(s) > most:
            yield group
            group, size = {}, 0
        group[s] = owners
        size += len(s)
    if group:
        yield group


def _strings(benchmark: DataFrame, window: int, least_words: int, item_col: str, item_text_col: str, benchmark_bytes: int) -> dict[bytes, list[int]]:
    """The test strings of a benchmark, whose size is checked before it comes to the driver."""
    items = benchmark.where(F.col(item_col).isNotNull() & F.col(item_text_col).isNotNull()).select(
        F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")
    )
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if size > benchmark_bytes:
        raise ValueError(f"the benchmark has {size} bytes of text; at most {benchmark_bytes} can be searched for")
    strings = test_strings([(r.item_id, r.text) for r in items.collect()], window)
    return {s: owners for s, owners in strings.items() if len(s.split()) >= min(least_words, window)}


def _scanned(batches: Iterator[pa.RecordBatch], text: str, groups: list[dict[bytes, list[int]]], held_bytes: int = 32 << 20) -> Iterator[tuple[pa.RecordBatch, dict[tuple[int, int], int]]]:
    """Parts of the batches, each with the number of distinct test strings by (row, item).

    With several groups of test strings, parts of ``held_bytes`` are held and
    the groups' tables are made one after the other, so that a row's counts are
    complete here however many groups there are.
    """
    machine = WuManber(list(groups[0])) if len(groups) == 1 else None
    held: list[tuple[pa.RecordBatch, np.ndarray, np.ndarray, dict[tuple[int, int], int]]] = []

    def search() -> Iterator[tuple[pa.RecordBatch, dict[tuple[int, int], int]]]:
        for group in groups:
            own, patterns, owner_lists = machine or WuManber(list(group)), list(group), list(group.values())
            for _, data, offsets, counts in held:
                begin, which = own.search(data)
                if not len(begin):
                    continue
                row = np.searchsorted(offsets, begin, "right") - 1
                inside = begin + np.array([len(patterns[k]) for k in which.tolist()]) <= offsets[row + 1]
                seen = np.unique(np.stack([row[inside], which[inside]]), axis=1)
                for r, k in zip(seen[0].tolist(), seen[1].tolist()):
                    for item in owner_lists[k]:
                        counts[r, item] = counts.get((r, item), 0) + 1
        for part, _, _, counts in held:
            yield part, counts
        held.clear()

    space = pa.scalar(" ", pa.large_string())
    for batch in batches:
        for part in slices(batch, text):
            wrapped = pc.binary_join_element_wise(space, normalised(part.column(text)), space, pa.scalar("", pa.large_string()))
            held.append((part, *raw(pc.replace_substring(wrapped, "  ", " ")), {}))
            if machine is not None or sum(len(x[1]) for x in held) >= held_bytes:
                yield from search()
    if held:
        yield from search()


def benchmark_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 8,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    table_bytes: int = 64 << 20,
    benchmark_bytes: int = 512 << 20,
    least_words: int = 1,
) -> DataFrame:
    """Which documents have which benchmark items: (doc_id, item_id, n_windows).

    ``n_windows`` counts the distinct test strings of the item that occur in
    the document.  One row for each document row and item with at least one.

    The benchmark is bounded and comes to the driver; its size is checked
    first and ``ValueError`` raised beyond ``benchmark_bytes``.  A task searches
    for test strings of ``table_bytes`` at a time; the result is the same for
    any.  The documents are scanned in place, whole: no shuffle.

    Null, empty and wordless texts and items match nothing; a repeated document
    row, and a row with a null id, gives rows of its own; a repeated item id
    with several texts owns the test strings of all of them; an item with a
    null id is left out.  An item of fewer words than ``window`` is one test
    string: one of a single common word is found in very many documents, and
    makes the search slow; items of fewer than ``least_words`` are left out.
    Other columns of either table are ignored; empty tables give an empty
    result.
    """
    groups = list(_grouped(_strings(benchmark, window, least_words, item_col, item_text_col, benchmark_bytes), table_bytes))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, item_id long, n_windows long"
    if not groups:
        return docs.sparkSession.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, counts in _scanned(batches, "text", groups):
            if counts:
                rows = pa.array([r for r, _ in counts], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(rows), pa.array([i for _, i in counts], pa.int64()), pa.array(list(counts.values()), pa.int64())],
                    ["doc_id", "item_id", "n_windows"],
                )

    return source.mapInArrow(released(run), schema)


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = 8, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    table_bytes: int = 64 << 20, benchmark_bytes: int = 512 << 20, least_words: int = 1,
) -> DataFrame:
    """The rows of ``docs``, all columns kept, whose text has no benchmark hit.

    Every row is judged by its own text where it is, so ids do not matter and
    nothing is shuffled.  Otherwise as :func:`benchmark_hits`.
    """
    groups = list(_grouped(_strings(benchmark, window, least_words, item_col, item_text_col, benchmark_bytes), table_bytes))
    if not groups:
        return docs

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, counts in _scanned(batches, text_col, groups):
            clean = np.ones(part.num_rows, bool)
            clean[[r for r, _ in counts]] = False
            yield part.filter(pa.array(clean))

    return docs.mapInArrow(released(keep), docs.schema)
