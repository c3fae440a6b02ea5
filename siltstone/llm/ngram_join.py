"""N-gram Jaccard self-join with PartEnum signatures.

A document is the set of hashes of its n consecutive words.

Scheme.  Sizes are cut into bands of ratio two.  Each band hashes the feature
domain into partitions of three parts.  Sets that differ little agree, in some
partition, on some two of its three parts; the signature of each two of three
parts (band, partition, which two, and the elements in them) is what such sets
share.  All features take part, whatever the size of the set.  The number of
partitions is the least for which a pair at the threshold, of the sizes at the
top of a band, shares no signature with a probability of :data:`MISS` at most;
more similar pairs are missed far more rarely.  A set also enumerates
signatures in the scheme of the band below, where a partner may be.
Signatures of parts that hold nothing say nothing and are left out.

Sets that share a signature form a run.  Joining each with the run's least
member only (its centre) keeps the work linear in a run: two sets with a
shared signature have a common centre, and the pair is compared at the least
centre that they have in common, once.  Documents with equal sets are one node
of the join.  A centre with many sets is cut into blocks, each pair of blocks
being a group of its own, so no task holds more than two blocks.

Comparison is in two steps.  Each node has a small parity map of its set: the
number of bits in which two maps differ is at most the number of features in
which the sets differ, so pairs that differ in too many bits are dropped
without an error.  Texts of what remains go to the groups and are compared
exactly.  A group returns the number of links of each of its nodes, and no
more edges than connect what is connected: never its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import mix, ngram_hashes, normalised, released, slices, stored, word_hashes

#: Copies with a few words changed are above this; unrelated texts are far below.
THRESHOLD = 0.55
#: Sizes below this are one band, in which every feature is a partition of its own.
SMALL = 16
#: The most that the probability of missing a pair at the threshold may be.
MISS = 1e-6
#: Sets of one centre that are compared with each other in one group; a group of two blocks has twice as many.
BLOCK = 1024
_M = np.uint64(0x9E3779B97F4A7C15)
#: Up to this size the list of documents to compare is sent to every task; beyond, it is joined by a shuffle.
BROADCAST_BYTES = 64 << 20


def feature_sets(strings: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-gram hashes of normalised texts, by text and ascending, and each text's first."""
    words, first = word_hashes(strings)
    gram, text = ngram_hashes(words, first, n)
    order = np.lexsort((gram, text))
    gram, text = gram[order], text[order]
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (text[1:] != text[:-1])
    gram, text = gram[new], text[new]
    return gram, np.searchsorted(text, np.arange(len(strings) + 1))


def set_ids(gram: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit id of each set (0 for an empty one); equal sets have equal ids."""
    total = np.zeros(len(gram) + 1, np.uint64)
    np.cumsum(mix(gram ^ _M), out=total[1:])
    size = np.diff(first).astype(np.uint64)
    ids = mix((total[first[1:]] - total[first[:-1]]) * np.uint64(3) + size)
    return np.where(size > 0, np.maximum(ids, np.uint64(1)), np.uint64(0))


def band_of(size: np.ndarray) -> np.ndarray:
    """0 for small sets, else the band [SMALL * 2**(i-1), SMALL * 2**i)."""
    return np.where(size < SMALL, 0, np.floor(np.log2(np.maximum(size, SMALL) / SMALL)).astype(np.int64) + 1)


@lru_cache(1000)
def partitions_of(band: int, threshold: float) -> int:
    """The number of first-level partitions of a band's scheme, by the probability of a miss."""
    size = SMALL * 2**band
    differ = 2 * size * (1 - threshold) / (1 + threshold)
    for n in range(2, size + 2):
        clean = math.exp(-differ / (3 * n))
        if (1 - (3 * clean**2 - 2 * clean**3)) ** n <= MISS:
            break
    return n


def signatures(gram: np.ndarray, first: np.ndarray, ids: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """All signatures of the sets, and the id of the set that each belongs to."""
    size = np.diff(first)
    band = band_of(size)
    out_sig, out_id = [], []
    lower = np.where(band > 0, np.where(band == 1, SMALL, SMALL * 2.0 ** (band - 1)), np.inf)
    # the set itself in its own scheme, and in the one below where a partner may be that small
    for own in (True, False):
        chosen = (size > 0) if own else (band > 0) & (size * threshold < lower)
        for b in np.unique(band[chosen]).tolist():
            scheme = b if own else b - 1
            rows = np.flatnonzero(chosen & (band == b))
            count = size[rows]
            at = np.repeat(first[rows] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            features = gram[at]
            row = np.repeat(np.arange(len(rows)), count)
            if scheme == 0:
                out_sig.append(mix(features ^ np.uint64(0x5EED)))
                out_id.append(ids[rows][row])
                continue
            parts = 3 * partitions_of(scheme, threshold)
            slot = row * parts + ((mix(features) >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)
            content = np.zeros(len(rows) * parts, np.uint64)
            np.add.at(content, slot, mix(features * _M + np.uint64(1)))
            held = np.zeros(len(content), bool)
            held[slot] = True
            content, held = content.reshape(-1, 3), held.reshape(-1, 3)
            where = np.tile(np.arange(parts // 3, dtype=np.uint64), len(rows))
            owner = np.repeat(ids[rows], parts // 3)
            for which, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
                keep = held[:, i] | held[:, j]
                tag = mix(where[keep] * np.uint64(4) + np.uint64(which) + (np.uint64(scheme) << np.uint64(40)))
                out_sig.append(mix(mix(content[keep, i] + tag) * _M + content[keep, j]))
                out_id.append(owner[keep])
    if not out_sig:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate(out_sig), np.concatenate(out_id)


def parity_maps(gram: np.ndarray, first: np.ndarray) -> list[bytes]:
    """Of each set, the parities of the numbers of features by bit; at least two bits for each feature."""
    size = np.diff(first)
    width = np.maximum(64, 2 ** np.ceil(np.log2(np.maximum(2 * size, 1))).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(width)])
    bit = (mix(gram + _M) & np.repeat(width - 1, size).astype(np.uint64)).astype(np.int64) + np.repeat(begin[:-1], size)
    parity = np.packbits((np.bincount(bit, minlength=int(begin[-1])) & 1).astype(np.uint8), bitorder="little").tobytes()
    return [parity[a:b] for a, b in zip((begin[:-1] // 8).tolist(), (begin[1:] // 8).tolist())]


def _members(n: int):
    """Rows of (doc_id, text_hash, node, size, parity); the node of a text without n-grams is 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                gram, first = feature_sets(normalised(part.column("text")), n)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), part.column("text_hash"), pa.array(set_ids(gram, first).view(np.int64)),
                        pa.array(np.diff(first).astype(np.int32)), pa.array(parity_maps(gram, first), pa.binary()),
                    ],
                    ["doc_id", "text_hash", "node", "size", "parity"],
                )

    return run


def _signer(n: int, threshold: float, bits: int):
    """Rows of (bucket, signatures, set ids) as packed arrays; equal sets of one task are signed once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.uint64)
        for batch in batches:
            for part in slices(batch, "text"):
                gram, first = feature_sets(normalised(part.column("text")), n)
                ids = set_ids(gram, first)
                _, once = np.unique(ids, return_index=True)
                mask = np.zeros(len(ids), bool)
                mask[once] = True
                mask &= ~np.isin(ids, seen)
                seen = np.union1d(seen, ids)
                size = np.where(mask, np.diff(first), 0)
                begin = np.concatenate([[0], np.cumsum(size)])
                kept = gram[np.repeat(first[:-1] - begin[:-1], size) + np.arange(begin[-1])]
                sig, owner = signatures(kept, begin, ids, threshold)
                bucket = (sig >> np.uint64(64 - bits)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                sig, owner, bucket = sig[order], owner[order], bucket[order]
                begin = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
                cuts = list(zip(begin.tolist(), [*begin[1:].tolist(), len(bucket)]))
                # with the bucket, 40 more bits tell signatures apart
                rest = sig << np.uint64(bits)
                high = (rest >> np.uint64(32)).astype(np.uint32)
                low = ((rest >> np.uint64(24)) & np.uint64(0xFF)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[begin].astype(np.int32)), *(pa.array([x[a:b].tobytes() for a, b in cuts], pa.binary()) for x in (high, low, owner))],
                    ["bucket", "high", "low", "owners"],
                )

    return run


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition's signatures, each run's least set (its centre) with every set in it."""
    by: dict[int, list[tuple[bytes, bytes, bytes]]] = {}
    for batch in batches:
        cols = [c.to_pylist() for c in batch.columns]
        for bucket, high, low, owners in zip(*cols):
            by.setdefault(bucket, []).append((high, low, owners))
    for parts in by.values():
        high = np.frombuffer(b"".join(p[0] for p in parts), np.uint32)
        low = np.frombuffer(b"".join(p[1] for p in parts), np.uint8)
        owner = np.frombuffer(b"".join(p[2] for p in parts), np.uint64)
        parts.clear()
        sig = (high.astype(np.uint64) << np.uint64(8)) | low
        order = np.argsort(sig)
        sig = sig[order]
        same = sig[1:] == sig[:-1]
        multi = np.zeros(len(sig), bool)
        multi[1:] = same
        multi[:-1] |= same
        sig, owner = sig[multi], owner[order][multi]
        if not len(sig):
            continue
        begin = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        least = np.minimum.reduceat(owner, begin)
        most = np.maximum.reduceat(owner, begin)
        length = np.diff(np.concatenate([begin, [len(sig)]]))
        real = np.repeat(least != most, length)
        edge = np.stack([np.repeat(least, length)[real], owner[real]], axis=1)
        edge = np.unique(np.ascontiguousarray(edge).view([("c", "<u8"), ("n", "<u8")]).ravel())
        if len(edge):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ascontiguousarray(edge["c"]).view(np.int64)), pa.array(np.ascontiguousarray(edge["n"]).view(np.int64))], ["centre", "node"]
            )


_GROUP = ["centre", "lo", "hi"]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The groups of batches that are sorted by centre and its two blocks."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        keys = [batch.column(k).to_numpy(zero_copy_only=False) for k in _GROUP]
        cuts = np.concatenate([[0], np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1, [batch.num_rows]])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            piece = batch.slice(a, b - a)
            if rest and any(rest[0].column(name)[0].as_py() != k[a] for name, k in zip(_GROUP, keys)):
                yield pa.Table.from_batches(rest)
                rest = []
            rest.append(piece)
    if rest:
        yield pa.Table.from_batches(rest)


def _across(group: pa.Table, order: np.ndarray) -> np.ndarray | None:
    """Which block each member is in, where the group is of two blocks and only pairs across them are its own."""
    if group.column("lo")[0].as_py() == group.column("hi")[0].as_py():
        return None
    return group.column("block").to_numpy()[order]


def _earlier(centre: int, centres: pa.ChunkedArray) -> np.ndarray:
    """For the members of a centre's group, a row of bits: which lesser centres each has."""
    column = centres.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    counts = np.diff(column.offsets.to_numpy())
    row = np.repeat(np.arange(len(column)), counts)
    less = values < np.uint64(centre & (1 << 64) - 1)
    values, row = values[less], row[less]
    known, which, times = np.unique(values, return_inverse=True, return_counts=True)
    shared = times > 1
    number = np.cumsum(shared) - 1
    bits = np.zeros((len(column), (int(shared.sum()) + 63) // 64 or 1), np.uint64)
    use = shared[which]
    bit = number[which[use]]
    np.bitwise_or.at(bits, (row[use], bit // 64), np.uint64(1) << (bit % 64).astype(np.uint64))
    return bits


def _near(size: np.ndarray, parity: list[bytes], a: int, until: int, threshold: float) -> np.ndarray:
    """Which of the sets after ``a`` up to ``until`` can be similar to it, by their parity maps."""
    out = np.zeros(until - a - 1, bool)
    own = np.frombuffer(parity[a], np.uint64)
    most = (size[a] + size[a + 1 : until]) * (1 - threshold) / (1 + threshold) + 1e-9
    width = np.array([len(p) for p in parity[a + 1 : until]])
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        maps = np.frombuffer(b"".join(parity[a + 1 + k] for k in at.tolist()), np.uint64).reshape(len(at), -1)
        while maps.shape[1] > len(own):
            half = maps.shape[1] // 2
            maps = maps[:, :half] ^ maps[:, half:]
        out[at] = np.bitwise_count(maps ^ own).sum(axis=1, dtype=np.int64) <= most[at]
    return out


_PLAUSIBLE = ["doc_id", "text_hash", "node", "copies", "centres", *_GROUP, "block"]


def _plausible(threshold: float):
    """Drops the members of a centre's group that have no partner there that can be similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            m = group.num_rows
            if m < 2:
                continue
            bits = _earlier(group.column("centre")[0].as_py(), group.column("centres"))
            size = group.column("size").to_numpy()
            order = np.lexsort((group.column("node").to_numpy(), size))
            bits, size = bits[order], size[order]
            parity = group.column("parity").to_pylist()
            parity = [parity[k] for k in order.tolist()]
            block = _across(group, order)
            keep = np.zeros(m, bool)
            for a in range(m - 1):
                end = int(np.searchsorted(size, size[a] / threshold + 1e-9, "right"))
                if end <= a + 1:
                    continue
                good = _near(size, parity, a, end, threshold)
                good &= ~(bits[a + 1 : end] & bits[a]).any(axis=1)
                if block is not None:
                    good &= block[a + 1 : end] != block[a]
                if good.any():
                    keep[a] = True
                    keep[a + 1 : end] |= good
            if keep.any():
                yield from group.select(_PLAUSIBLE).take(pa.array(np.sort(order[keep]))).combine_chunks().to_batches()

    return run


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each node that a task has."""
    seen: set[int] = set()
    for batch in batches:
        nodes = batch.column("node").to_pylist()
        new = [k for k, x in enumerate(nodes) if not (x in seen or seen.add(x))]
        if new:
            yield batch.take(pa.array(new))


def _featured(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Texts replaced by their features; rows whose text is not that of the node, as hashes can be equal by chance, go."""
    for batch in batches:
        for part in slices(batch, "text"):
            gram, first = feature_sets(normalised(part.column("text")), n)
            blobs = pa.array([gram[a:b].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist())], pa.large_binary())
            own = part.column("node").to_numpy().view(np.uint64) == set_ids(gram, first)
            names = [*_GROUP, "block", "node", "copies", "centres"]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), blobs], [*names, "features"]).filter(pa.array(own))


def _compare(threshold: float, n: int, counted: bool):
    """Exact comparison of the pairs that a group is the one to compare.

    Rows are (node_a, node_b, null), edges that connect what is similar, and,
    where ``counted``, (node, null, links), the number of documents that the
    node is similar to in this group.  Without it, pairs that other edges
    connect already are not compared.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(_featured(batches, n)):
            m = group.num_rows
            if m < 2:
                continue
            _, once = np.unique(group.column("node").to_numpy(), return_index=True)
            if len(once) < m:
                group, m = group.take(pa.array(once)), len(once)
            bits = _earlier(group.column("centre")[0].as_py(), group.column("centres"))
            node, copies = group.column("node").to_numpy(), group.column("copies").to_numpy()
            sets = group.column("features").to_pylist()
            size = np.array([len(s) // 8 for s in sets])
            order = np.lexsort((node, size))
            block = _across(group, order)
            bits, node, size, copies = bits[order], node[order], size[order], copies[order]
            _, flat = np.unique(np.frombuffer(b"".join(sets[k] for k in order.tolist()), np.uint64), return_inverse=True)
            del sets, group
            first = np.concatenate([[0], np.cumsum(size)])
            mark = np.zeros(int(flat.max()) + 1, np.uint8)
            label, links = np.arange(m), np.zeros(m, np.int64)
            a_out, b_out = [], []
            for a in range(m - 1):
                # partners of at least this size, up to the largest that can be similar
                end = int(np.searchsorted(size, size[a] / threshold + 1e-9, "right"))
                if end <= a + 1:
                    continue
                open_ = ~(bits[a + 1 : end] & bits[a]).any(axis=1)
                if block is not None:
                    open_ &= block[a + 1 : end] != block[a]
                if not counted:
                    open_ &= label[a + 1 : end] != label[a]
                if not open_.any():
                    continue
                mark[flat[first[a] : first[a + 1]]] = 1
                both = np.add.reduceat(mark[flat[first[a + 1] : first[end]]], first[a + 1 : end] - first[a + 1], dtype=np.int64)
                mark[flat[first[a] : first[a + 1]]] = 0
                total = size[a] + size[a + 1 : end] - both
                ok = a + 1 + np.flatnonzero(open_ & (both >= threshold * total - 1e-9))
                if not len(ok):
                    continue
                links[a] += copies[ok].sum()
                links[ok] += copies[a]
                joined, where = np.unique(label[ok], return_index=True)
                new = joined != label[a]
                if new.any():
                    a_out.append(np.full(int(new.sum()), node[a]))
                    b_out.append(node[ok[where[new]]])
                    label[np.isin(label, joined[new])] = label[a]
            if a_out:
                a, b = np.concatenate(a_out), np.concatenate(b_out)
                yield _edges(a, b, np.zeros(len(a), np.int64))
            if counted and links.any():
                yield _edges(node[links > 0], None, links[links > 0])

    return run


def _edges(a: np.ndarray, b: np.ndarray | None, links: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.nulls(len(a), pa.int64()) if b is None else pa.array(b), pa.array(links)], ["node_a", "node_b", "links"])


def similar_nodes(docs: DataFrame, threshold: float, n: int, id_col: str, text_col: str, counted: bool, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, node) of all rows, and the edges and link counts of :func:`_compare`."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    # as many ranges of signatures as partitions, several over; their number follows the setting that follows the data
    ranges = min(20, max(8, math.ceil(math.log2(4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))))
    known = stored(source.mapInArrow(released(_members(n)), "doc_id long, text_hash long, node long, size int, parity binary"), "ngram-members")
    runs = source.select("text").mapInArrow(released(_signer(n, threshold, ranges)), "bucket int, high binary, low binary, owners binary").repartition("bucket")
    stars = stored(runs.mapInArrow(released(_stars), "centre long, node long").distinct(), "ngram-stars")
    large = stars.groupBy("centre").agg(F.count("*").alias("m")).where(F.col("m") > block).select("centre", F.expr(f"CAST((m + {block - 1}) DIV {block} AS INT)").alias("blocks"))
    own = F.struct("centre", F.coalesce("blocks", F.lit(1)).alias("blocks"))
    centres = stars.join(large, "centre", "left").groupBy("node").agg(F.collect_list(own).alias("own"))
    # one row stands for all copies: the least, by id and text
    least = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "text_hash", "size", "parity")
    one = known.where("node <> 0").groupBy("node").agg(F.count("*").alias("copies"), F.min(least).alias("m")).select("node", "copies", "m.*")
    spread = centres.join(one, "node").withColumn("centres", F.col("own.centre")).withColumn("o", F.explode("own"))
    spread = spread.withColumn("block", F.expr("CAST(pmod(xxhash64(node), o.blocks) AS INT)")).withColumn("other", F.explode(F.expr("sequence(0, o.blocks - 1)")))
    spread = spread.select(
        "doc_id", "text_hash", "node", "copies", "centres", "size", "parity", F.col("o.centre").alias("centre"),
        F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block",
    )
    kinds = "doc_id long, text_hash long, node long, copies long, centres array<long>, centre long, lo int, hi int, block int"
    grouped = spread.repartition(*_GROUP).sortWithinPartitions(*_GROUP)
    owned = stored(grouped.mapInArrow(released(_plausible(threshold)), kinds), "ngram-groups")
    wanted = owned.groupBy("node").agg(
        F.first("doc_id").alias("w_id"), F.first("text_hash").alias("w_hash"), F.first("copies").alias("copies"), F.first("centres").alias("centres"),
        F.collect_list(F.struct(*_GROUP, "block")).alias("groups"),
    )
    wanted = stored(wanted, "ngram-wanted")
    held = wanted.agg(F.coalesce(F.sum(40 + 8 * F.size("centres") + 24 * F.size("groups")), F.lit(0))).first()[0]
    texts = source.join(F.broadcast(wanted) if held <= BROADCAST_BYTES else wanted, (F.col("text_hash") == F.col("w_hash")) & F.col("doc_id").eqNullSafe(F.col("w_id")))
    kinds = "node long, copies long, centres array<long>, groups array<struct<centre:long,lo:int,hi:int,block:int>>, text string"
    texts = texts.select("node", "copies", "centres", "groups", "text").mapInArrow(released(_once), kinds)
    compared = (
        texts.select(F.explode("groups").alias("g"), "node", "copies", "centres", "text")
        .select("g.*", "node", "copies", "centres", "text")
        .repartition(*_GROUP)
        .sortWithinPartitions(*_GROUP)
        .mapInArrow(released(_compare(threshold, n, counted)), "node_a long, node_b long, links long")
    )
    return known.select("doc_id", "text_hash", "node"), stored(compared, "ngram-edges")


def _least_connected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all edges (u, v) of a small graph, by label propagation with halved paths."""
    held = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches if b.num_rows]
    if not held:
        return
    u, v = (np.concatenate([h[k] for h in held]) for k in (0, 1))
    nodes, code = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v = code[: len(u)], code[len(u) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        least = np.minimum(label[u], label[v])
        # the roots of both ends, and the ends, take the lesser label
        for at in (label[u], label[v], u, v):
            np.minimum.at(label, at, least)
        label = label[label]
        if (label == before).all():
            break
    other = np.flatnonzero(label != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[other]), pa.array(nodes[label[other]])], ["node", "root"])


def connected(edges: DataFrame, max_rounds: int = 200, local_edges: int = 1 << 20) -> DataFrame:
    """(node, root): each node of undirected (a, b) edges with the least node that it is connected to.

    At most ``local_edges`` edges, which are counted first, are solved by one
    task.  More alternate the two star operations on edges, each a group-by,
    until nothing changes; the rounds grow with the logarithm of the
    component.  ``RuntimeError`` if anything still changes after ``max_rounds``.
    """
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "components")
    if e.count() <= local_edges:
        return stored(e.coalesce(1).mapInArrow(released(_least_connected), "node long, root long"), "components")
    before = None
    for _ in range(max_rounds):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # minima are joined back rather than kept with a node's list of neighbours, which has no bound
        near = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(near, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        e = stored(small, "components")
        now = e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
    raise RuntimeError(f"components still change after {max_rounds} rounds")


def _classes(members: DataFrame, found: DataFrame) -> DataFrame:
    """(node, missing, first_id, first_hash, n_links) of nodes with copies or links: their class's least row, by id and text."""
    least = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "text_hash")
    nodes = members.where("node <> 0").groupBy("node").agg(F.count("*").alias("copies"), F.min(least).alias("least"))
    roots = connected(found.where("node_b IS NOT NULL").select(F.col("node_a").alias("a"), F.col("node_b").alias("b")))
    links = found.where("node_b IS NULL").groupBy(F.col("node_a").alias("node")).agg(F.sum("links").alias("links"))
    # a root is in its own class too, though no row of roots says so
    roots = roots.union(roots.select("root", "root")).distinct()
    alone = nodes.join(roots, "node", "left").join(links, "node", "left").where("copies > 1 OR root IS NOT NULL")
    alone = stored(alone.select("node", "copies", "least", F.coalesce("root", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links")), "ngram-nodes")
    first = alone.groupBy("root").agg(F.min("least").alias("first"))
    return alone.join(first, "root").select("node", F.col("first.doc_id").alias("first_id"), F.col("first.text_hash").alias("first_hash"), (F.col("links") + F.col("copies") - 1).alias("n_links"))


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, n: int = 3, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(doc_id, class_id, n_links) of every row: its class of similar documents, and how many it is similar to.

    Two rows are linked if the n-gram Jaccard similarity of their texts is at
    least ``threshold``.  ``n_links`` counts the other rows that a row is
    linked with, copies each; ``class_id`` is the least id of all that it is
    connected to by links, its own if by none.  Comparison is exact; a link at
    the threshold is lost with a probability of :data:`MISS`, and one of more
    similar texts almost never.

    Words are runs of letters and digits, lower-cased.  A text of fewer than n
    words, but one at least, has one n-gram.  Null, empty and wordless texts
    have no n-gram and no link.  Repeated rows and rows of one id with several
    texts are rows like any other; a row with a null id too: it counts as a
    link, and the class of null ids only has a null ``class_id``.  Very long
    texts are sets like any other.  Other columns are ignored; an empty table
    gives an empty result.
    """
    members, found = similar_nodes(docs, threshold, n, id_col, text_col, True, block)
    classes = _classes(members, found)
    # rows without words are many and have no partner: they take no part in the join
    linked = members.where("node <> 0").join(classes, "node", "left")
    linked = linked.select("doc_id", F.expr("CASE WHEN n_links IS NULL THEN doc_id ELSE first_id END").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return linked.unionByName(members.where("node = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def deduplicate(docs: DataFrame, threshold: float = THRESHOLD, n: int = 3, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row of each class of :func:`jaccard_join`, all columns kept: that of the least id.

    Rows are judged, not ids: of rows that repeat an id with the same text one
    stays; of one id's several texts each is judged by itself; rows with a null
    id come last in a class.  Among rows of one id the least hash of the text
    stays, among repeated rows any.  Rows without n-grams (null, empty and
    wordless texts) all stay.  An empty table gives an empty result.
    """
    members, found = similar_nodes(docs, threshold, n, id_col, text_col, False, block)
    own = stored(members.where("node <> 0").join(_classes(members, found), "node"), "ngram-classes")
    first = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_hash") == F.col("first_hash"))
    names = [F.col("doc_id").alias("__gone_id"), F.col("text_hash").alias("__gone_hash")]
    gone = stored(own.where(~first).select(*names).distinct(), "ngram-gone")
    # as a hash table, a row takes some 48 bytes; beyond the bound, texts are shuffled
    if gone.count() * 48 <= BROADCAST_BYTES:
        gone = F.broadcast(gone)
    keyed = docs.withColumns({"__row_id": F.col(id_col).cast("long"), "__row_hash": F.xxhash64(F.col(text_col))})
    same = F.col("__row_id").eqNullSafe(F.col("__gone_id")) & (F.col("__row_hash") == F.col("__gone_hash"))
    kept = keyed.join(gone, same, "left_anti")
    repeated = stored(own.where(first).select(*names).groupBy("__gone_id", "__gone_hash").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "ngram-repeated")
    if not repeated.isEmpty():
        single = kept.join(repeated, same, "left_anti")
        kept = single.unionByName(kept.join(repeated, same, "left_semi").dropDuplicates(["__row_id", "__row_hash"]))
    return kept.drop("__row_id", "__row_hash")
