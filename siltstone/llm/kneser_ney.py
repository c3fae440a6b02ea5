"""Interpolated modified Kneser-Ney bigram model, counted in Spark and memory-mapped for scoring.

Words are runs of letters and digits, lower-cased; each is known by 32 bits of
its hash.  Every text begins with one marker and ends with another.

Counting.  Tasks count the bigrams of their texts as 64-bit keys (context,
word), cut into ranges of the context; ranges are shuffled as packed arrays
and merged by sorting.  As a range holds whole contexts, the statistics of a
context are complete where its range is merged.

Storage.  A range is one file in the shared folder: sorted keys with counts,
sorted contexts with their totals and their numbers of words seen once, twice
and more.  The continuation counts of words are kept likewise, by range of the
word.  Files are written under another name and renamed, so a task that is run
again leaves the same file.

Scoring.  Workers map the files into memory and look up the sorted keys of a
slice of texts by binary search: nothing of the model is sent to them.
"""

from __future__ import annotations

import math
import os
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import normalised, shared_dir, slices, stored, word_hashes

BEGIN, END = np.uint64(0), np.uint64(1)
#: Bytes of text counted together before they are shuffled.
COUNT_BYTES = 8 << 20
OPEN_FILES = 512


def local_path(uri: str) -> str:
    """The path of a shared folder, which must be mounted on every worker to be mapped into memory."""
    parsed = urlparse(uri)
    if parsed.scheme not in ("", "file"):
        raise ValueError(f"the model is memory-mapped: spark.checkpoint.dir must be a mounted folder, not {uri}")
    return parsed.path


def bigrams(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Keys (context << 32 | word) of all bigrams of normalised texts, and each text's first."""
    words, first = word_hashes(strings)
    words = np.maximum(words >> np.uint64(32), np.uint64(2))
    count = np.diff(first)
    has = count > 0
    begin = np.concatenate([[0], np.cumsum(count + has)])
    total = int(begin[-1])
    context, word = np.full(total, BEGIN), np.full(total, END)
    shift = np.repeat(begin[:-1] - first[:-1], count) + np.arange(len(words))
    word[shift] = words
    context[shift + 1] = words
    return context << np.uint64(32) | word, begin


def _counter(bits: int):
    shift = np.uint64(64 - bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", COUNT_BYTES):
                keys, _ = bigrams(normalised(part.column("text")))
                if len(keys):
                    keys, counts = np.unique(keys, return_counts=True)
                    yield _packed(keys, counts, (keys >> shift).astype(np.int64))

    return run


def _packed(keys: np.ndarray, counts: np.ndarray, part: np.ndarray) -> pa.RecordBatch:
    begin = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    cuts = list(zip(begin.tolist(), [*begin[1:].tolist(), len(keys)]))
    high, low = (keys >> np.uint64(32)).astype(np.uint32), keys.astype(np.uint32)
    counts = counts.astype(np.uint32)
    return pa.RecordBatch.from_arrays(
        [pa.array(part[begin].astype(np.int32)), *(pa.array([x[a:b].tobytes() for a, b in cuts], pa.binary()) for x in (high, low, counts))],
        ["part", "high", "low", "counts"],
    )


_PACKED = "part int, high binary, low binary, counts binary"


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each range's sorted keys and summed counts."""
    by: dict[int, list[tuple[bytes, bytes, bytes]]] = {}
    for batch in batches:
        for part, *blobs in zip(*(c.to_pylist() for c in batch.columns)):
            by.setdefault(part, []).append(tuple(blobs))
    for part in sorted(by):
        blobs = by.pop(part)
        high, low, counts = (np.frombuffer(b"".join(b[k] for b in blobs), np.uint32) for k in range(3))
        keys = high.astype(np.uint64) << np.uint64(32) | low
        order = np.argsort(keys)
        keys = keys[order]
        begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        yield part, keys[begin], np.add.reduceat(counts[order].astype(np.int64), begin)


def _write(folder: str, name: str, *arrays: np.ndarray) -> None:
    os.makedirs(folder, exist_ok=True)
    head = np.array([len(arrays), *(len(a) for a in arrays), *(a.dtype.itemsize for a in arrays)], np.int64)
    temporary = os.path.join(folder, f".{name}-{uuid.uuid4().hex}")
    with open(temporary, "wb") as f:
        f.write(head.tobytes())
        for a in arrays:
            f.write(a.tobytes())
            f.write(b"\0" * (-a.nbytes % 8))
    os.replace(temporary, os.path.join(folder, name))


def _read(path: str) -> list[np.ndarray]:
    whole = np.memmap(path, np.uint8, "r")
    n = int(whole[:8].view(np.int64)[0])
    head = whole[8 : 8 + 16 * n].view(np.int64).tolist()
    at, out = 8 + 16 * n, []
    for length, item in zip(head[:n], head[n:]):
        out.append(whole[at : at + length * item].view(f"<u{item}"))
        at += length * item + -length * item % 8
    return out


def _of_counts(counts: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(counts, 5), minlength=6)[1:5].tolist()


def _builder(folder: str, bits: int):
    shift = np.uint64(32 - bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, stats = [], []
        for part, keys, counts in _merged(batches):
            context = (keys >> np.uint64(32)).astype(np.uint32)
            begin = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
            kinds = [np.add.reduceat(m.astype(np.uint32), begin) for m in (counts == 1, counts == 2, counts > 2)]
            _write(
                folder, f"context-{part:05d}", keys, np.minimum(counts, 2**32 - 1).astype(np.uint32), context[begin], np.add.reduceat(counts, begin).astype(np.uint64), *kinds
            )
            stats.append(_of_counts(counts))
            words.append(keys.astype(np.uint32))
        if not words:
            return
        word, count = np.unique(np.concatenate(words), return_counts=True)
        batch = _packed(word.astype(np.uint64) << np.uint64(32), count, (word >> shift).astype(np.int64))
        total = np.array(stats, np.int64).sum(axis=0).tolist()
        for k in range(4):
            values = pa.array([total[k], *[0] * (batch.num_rows - 1)], pa.int64())
            batch = batch.append_column(f"n{k + 1}", values)
        yield batch

    return run


def _words(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, keys, counts in _merged(batches):
            _write(folder, f"word-{part:05d}", (keys >> np.uint64(32)).astype(np.uint32), counts.astype(np.uint64))
            kinds = [int((counts == 1).sum()), int((counts == 2).sum()), int((counts > 2).sum())]
            row = [part, len(keys), int(counts.sum()), *kinds, *_of_counts(counts)]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in row], [*"pvt", "k1", "k2", "k3", "n1", "n2", "n3", "n4"])

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """The three discounts from the numbers of counts of one to four; 0.5, 1 and 1.5 where these are too few."""
    if not (n1 and n2 and n3 and n4):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(d, 0.0), float(k + 1)) for k, d in enumerate((1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)))


@dataclass(frozen=True)
class Model:
    """Where a model's files are, and the few numbers that hold for all of it."""

    folder: str
    bits: int
    discount: tuple[float, float, float]
    word_discount: tuple[float, float, float]
    continuations: int
    unseen: float  # the weight of the uniform distribution, over the words and one for all unseen ones, in the lower order
    vocabulary: int


def train(docs: DataFrame, text_col: str = "text") -> Model:
    """Counts the texts of all rows and writes the model to the shared folder.

    Null, empty and wordless texts count for nothing; an empty table gives a
    model that knows no word.  Counts are exact but that words whose 32-bit
    hashes are equal are one.
    """
    spark = docs.sparkSession
    uri = shared_dir(spark, "kneser-ney")
    folder = local_path(uri)
    # as many ranges as partitions, several over; their number follows the setting that follows the data
    bits = min(16, max(8, math.ceil(math.log2(4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))))
    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(_counter(bits), _PACKED)
    words = counted.repartition("part").mapInArrow(_builder(folder, bits), _PACKED + ", n1 long, n2 long, n3 long, n4 long")
    words = stored(words, "kneser-ney-words")
    n = words.agg(*(F.coalesce(F.sum(f"n{k}"), F.lit(0)).alias(f"n{k}") for k in range(1, 5))).first()
    merged = words.select("part", "high", "low", "counts").repartition("part").mapInArrow(
        _words(folder), ", ".join(f"{c} long" for c in ["p", "v", "t", "k1", "k2", "k3", "n1", "n2", "n3", "n4"])
    )
    w = merged.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ["v", "t", "k1", "k2", "k3", "n1", "n2", "n3", "n4"])).first()
    lower = discounts(w.n1, w.n2, w.n3, w.n4)
    unseen = sum(d * k for d, k in zip(lower, (w.k1, w.k2, w.k3))) / w.t if w.t else 1.0
    return Model(folder, bits, discounts(n.n1, n.n2, n.n3, n.n4), lower, w.t, unseen, w.v)


class Lookup:
    """A worker's view of a model: files are mapped when first needed."""

    def __init__(self, model: Model):
        self.model = model
        self.files: OrderedDict[str, list[np.ndarray] | None] = OrderedDict()

    def _file(self, name: str) -> list[np.ndarray] | None:
        if name not in self.files:
            path = os.path.join(self.model.folder, name)
            self.files[name] = _read(path) if os.path.exists(path) else None
            if len(self.files) > OPEN_FILES:
                self.files.popitem(last=False)
        self.files.move_to_end(name)
        return self.files[name]

    def _by_part(self, sorted_keys: np.ndarray, shift: int, name: str):
        part = (sorted_keys >> np.uint64(shift)).astype(np.int64)
        begin = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(part)]):
            yield slice(a, b), self._file(f"{name}-{int(part[a]):05d}")

    @staticmethod
    def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        return at, table[at] == keys

    @staticmethod
    def _discounted(counts: np.ndarray, discount: tuple[float, float, float]) -> np.ndarray:
        taken = np.array([0.0, *discount])[np.minimum(counts, 3).astype(np.int64)]
        return np.maximum(counts - taken, 0.0)

    def word_probability(self, words: np.ndarray) -> np.ndarray:
        """Of sorted 32-bit words (as uint64), in the lower order."""
        m = self.model
        out = np.zeros(len(words))
        if m.continuations:
            for s, file in self._by_part(words, 32 - m.bits, "word"):
                if file is not None:
                    at, there = self._find(file[0], words[s].astype(np.uint32))
                    out[s] = np.where(there, self._discounted(file[1][at].astype(float), m.word_discount), 0.0)
            out /= m.continuations
        return out + m.unseen / (m.vocabulary + 1)

    def probability(self, keys: np.ndarray) -> np.ndarray:
        """Of sorted distinct bigram keys."""
        m = self.model
        words, back = np.unique(keys & np.uint64(0xFFFFFFFF), return_inverse=True)
        lower = self.word_probability(words)[back]
        out = lower.copy()
        for s, file in self._by_part(keys, 64 - m.bits, "context"):
            if file is None:
                continue
            table, counts, contexts, totals, one, two, more = file
            c_at, known = self._find(contexts, (keys[s] >> np.uint64(32)).astype(np.uint32))
            k_at, there = self._find(table, keys[s])
            total = totals[c_at].astype(float)
            own = np.where(there, self._discounted(counts[k_at].astype(float), m.discount), 0.0)
            left = m.discount[0] * one[c_at] + m.discount[1] * two[c_at] + m.discount[2] * more[c_at]
            out[s] = np.where(known, (own + left * lower[s]) / total, lower[s])
        return out


def _scorer(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(model)
        for batch in batches:
            for part in slices(batch, "text", COUNT_BYTES):
                keys, first = bigrams(normalised(part.column("text")))
                n = np.diff(first)
                total = np.zeros(len(n))
                if len(keys):
                    distinct, back = np.unique(keys, return_inverse=True)
                    logs = np.concatenate([[0.0], np.cumsum(np.log(lookup.probability(distinct))[back])])
                    total = logs[first[1:]] - logs[first[:-1]]
                empty = n == 0
                with np.errstate(all="ignore"):
                    perplexity = np.exp(-total / n)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n), pa.array(total), pa.array(perplexity, mask=empty)], ["doc_id", "n_tokens", "log_prob", "perplexity"]
                )

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, log_prob, perplexity) of every row, in one scan without a shuffle.

    ``n_tokens`` counts the words and the end marker.  Null, empty and wordless
    texts have 0 tokens, log probability 0 and a null perplexity.  Repeated
    rows and null ids are scored as any other; other columns are ignored.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(_scorer(model), "doc_id long, n_tokens long, log_prob double, perplexity double")


def perplexity(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`score` of the rows under a model of the same rows."""
    return score(docs, train(docs, text_col), id_col, text_col)
