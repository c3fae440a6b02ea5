"""Packing documents into training sequences by cutting-stock column generation.

Documents longer than a sequence are cut; what is left of each falls into one
of a fixed number of length classes.  On the driver, whose input is only the
histogram of the classes, a linear program over patterns (how many of each
class make one sequence) is solved by column generation: its dual prices make
a knapsack problem, solved by dynamic programming, and its solution is the
next pattern.  The program's solution is rounded down and the rest, less than
one sequence a pattern, is filled first-fit decreasing.

Every document gets a rank in its class, from counts of partitions and a sort
in each, and a pattern takes ranges of ranks; so documents find their
sequences by a join with the small table of ranges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siltstone.llm.common import as_strings, released, slices, stored
from siltstone.llm.tokens import VOCABULARY, encode


def knapsack(value: np.ndarray, size: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The best value, and how many of each item, of an unbounded knapsack with integer sizes."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        fits = np.flatnonzero((size <= c) & (value > 0))
        if len(fits):
            gain = best[c - size[fits]] + value[fits]
            k = int(np.argmax(gain))
            if gain[k] > best[c] + 1e-12:
                best[c], took[c] = gain[k], fits[k]
    counts, c = np.zeros(len(size), np.int64), capacity
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            counts[took[c]] += 1
            c -= int(size[took[c]])
    return float(best[capacity]), counts


def inverted(a: np.ndarray) -> np.ndarray:
    """The inverse by elimination with row pivots.

    Written out, since the linear algebra library's threads may never wake in
    a process that has started a JVM after they were made.
    """
    m = len(a)
    both = np.concatenate([a.astype(float), np.eye(m)], axis=1)
    for k in range(m):
        pivot = k + int(np.argmax(np.abs(both[k:, k])))
        if pivot != k:
            both[[k, pivot]] = both[[pivot, k]]
        both[k] /= both[k, k]
        factor = both[:, k].copy()
        factor[k] = 0.0
        both -= factor[:, None] * both[k]
    return both[:, m:]


def column_generation(size: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 20_000, slack: float = 1e-7) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (one in each row) and how often each is used, in the linear program's optimum.

    The optimum is within a share ``slack``, by the bound that prices give;
    ``RuntimeError`` if it is not after ``rounds`` columns.
    Demands are scaled, and changed by less than a millionth, each by another
    share, so that no two ratios are equal and the simplex method cannot turn
    in circles; the returned solution is that of the given demands.  The
    inverse is made anew every few rounds, as updates of it gather errors.
    """
    m = len(size)
    if not m:
        return np.zeros((0, 0), np.int64), np.zeros(0)
    basis = np.diag((capacity // size).astype(float))
    asked = demand / demand.max() + np.random.default_rng(1).uniform(1e-7, 1e-6, m)
    inverse = inverted(basis)
    for k in range(rounds):
        x = np.maximum((inverse * asked).sum(axis=1), 0.0)
        worth, pattern = knapsack(inverse.sum(axis=0), size, capacity)
        if worth <= 1 + slack:
            break
        direction = (inverse * pattern).sum(axis=1)
        rising = direction > 1e-9
        ratio = np.full(m, np.inf)
        ratio[rising] = x[rising] / direction[rising]
        out = int(np.argmin(ratio))
        basis[:, out] = pattern
        if k % 20 == 19:
            inverse = inverted(basis)
        else:
            row = inverse[out] / direction[out]
            inverse = inverse - direction[:, None] * row
            inverse[out] = row
    else:
        raise RuntimeError(f"the linear program has no optimum after {rounds} columns")
    return basis.T.round().astype(np.int64), np.maximum((inverted(basis) * demand).sum(axis=1), 0.0)


def plan(classes: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns {class: how many} with their numbers of sequences, that hold exactly the documents counted."""
    size = np.array(sorted(classes), np.int64)
    if not len(size):
        return []
    demand = np.array([classes[int(s)] for s in size], np.int64)
    patterns, x = column_generation(size, demand.astype(float), capacity)
    used: list[tuple[np.ndarray, int]] = []
    left = demand.copy()
    for k in np.argsort(-x, kind="stable").tolist():
        p = patterns[k]
        n = int(np.floor(x[k] + 1e-9))
        if n and p.any():
            n = min(n, int((left[p > 0] // p[p > 0]).min()))
        if n > 0 and p.any():
            used.append((p, n))
            left = left - n * p
    # first-fit decreasing, by counts: the largest first, each sequence filled as far as it goes
    while left.any():
        p, room = np.zeros(len(size), np.int64), capacity
        for k in range(len(size) - 1, -1, -1):
            p[k] = min(left[k], room // size[k])
            room -= p[k] * size[k]
        n = int((left[p > 0] // p[p > 0]).min())
        used.append((p, n))
        left = left - n * p
    return [({int(s): int(c) for s, c in zip(size, p) if c}, n) for p, n in used]


def word_count(text: Column) -> Column:
    """The length of a text in words, divided by white space, for those who pack words."""
    return F.regexp_count(text, F.lit(r"\S+"))


def _token_counter(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                _, first = encode(as_strings(part.column("text")).to_pylist(), path)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(first))], ["doc_id", "n_tokens"])

    return run


def token_lengths(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens) of every row: the tokens of its whole text.  Null and empty texts have none."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(released(_token_counter(vocabulary)), "doc_id long, n_tokens long")


def pack(
    docs: DataFrame, capacity: int = 2048, step: int = 16, length: Column | None = None, id_col: str = "doc_id", text_col: str = "text", rows_a_part: int = 200_000,
    vocabulary: str = VOCABULARY,
) -> DataFrame:
    """(doc_id, piece, start, length, sequence, slot): where each piece of each document goes.

    A piece is ``length`` tokens from ``start``; ``slot`` is its place in the
    sequence.  The lengths in a sequence, each rounded up to ``step``, are at
    most ``capacity``.  ``length`` is the column of a row's length, where it is
    known; the tokens of the whole text under ``vocabulary`` if none is given.
    Texts longer than a sequence, however long, are cut into full pieces and a
    rest.  Documents of no length (null and empty texts) have no piece.
    Repeated rows are packed each; null ids too.  Pieces of equal class are
    ranked by hash, id and place, those that are equal in all in any order.
    Other columns are ignored; an empty table gives an empty result.
    """
    if capacity % step:
        raise ValueError("capacity must be a multiple of step")
    spark = docs.sparkSession
    if length is None:
        docs, id_col, length = token_lengths(docs, vocabulary, id_col, text_col), "doc_id", F.col("n_tokens")
    size = F.coalesce(length, F.lit(0)).cast("long")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), size.alias("size")).where("size > 0")
    pieces = own.select("doc_id", "size", F.explode(F.expr(f"sequence(0L, (size - 1) DIV {capacity})")).alias("piece"))
    pieces = pieces.select("doc_id", "piece", (F.col("piece") * capacity).alias("start"), F.least(F.col("size") - F.col("piece") * capacity, F.lit(capacity)).alias("length"))
    pieces = stored(pieces.withColumn("class", F.ceil(F.col("length") / step).cast("int")), "pieces")
    counts = {r["class"]: r["n"] for r in pieces.groupBy("class").agg(F.count("*").alias("n")).collect()}
    parts = max(1, sum(counts.values()) // rows_a_part)
    rows, sequence = [], 0
    taken = dict.fromkeys(counts, 0)
    for pattern, n in plan(counts, capacity // step):
        before = 0
        for c in sorted(pattern, reverse=True):
            rows.append((c, taken[c], taken[c] + n * pattern[c], pattern[c], sequence, before))
            taken[c] += n * pattern[c]
            before += pattern[c]
        sequence += n
    ranges = spark.createDataFrame(rows, "r_class int, r_from long, r_to long, r_each long, r_sequence long, r_before long")
    placed = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)))
    held = placed.groupBy("class", "part").agg(F.count("*").alias("n"))
    offsets = stored(
        held.select(F.col("class").alias("o_class"), F.col("part").alias("o_part"), (F.sum("n").over(W.partitionBy("class").orderBy("part")) - F.col("n")).alias("offset")),
        "packing-offsets",
    )
    within = F.row_number().over(W.partitionBy("class", "part").orderBy("doc_id", "piece", "length")) - 1
    ranked = placed.withColumn("within", within).join(offsets, (F.col("class") == F.col("o_class")) & (F.col("part") == F.col("o_part")))
    ranked = ranked.select("doc_id", "piece", "start", "length", "class", (F.col("within") + F.col("offset")).alias("rank"))
    # the table of ranges is bounded by the number of classes
    found = ranked.join(F.broadcast(ranges), (F.col("class") == F.col("r_class")) & (F.col("rank") >= F.col("r_from")) & (F.col("rank") < F.col("r_to")))
    at = F.col("rank") - F.col("r_from")
    return found.select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"),
        (F.col("r_sequence") + F.expr("(rank - r_from) DIV r_each")).alias("sequence"), (F.col("r_before") + at % F.col("r_each")).alias("slot"),
    )
