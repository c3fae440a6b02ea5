"""Graph operators on edge relations (src, dst).

A graph of at most :data:`LOCAL_EDGES` edges (:data:`LOCAL_NAMES` where nodes
are not whole numbers), which are counted first, is solved by one task with
arrays.  A larger one is solved by iterated joins: an
iteration keeps what is new, anti-joined with what is known, and writes it to
the shared folder, so plans stay short and lost executors cost one round.
Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from siltstone.storage import stored

#: The parts of a growing relation are merged into one after so many rounds.
COMPACT = 8
#: Graphs of up to this many edges (and given nodes) are solved by one task, in arrays of whole numbers.
LOCAL_EDGES = 1 << 24
#: The same for names of other types, whose length is not known, and for components, which are searched node by node.
LOCAL_NAMES = 1 << 20


def _merged(parts: list[DataFrame], what: str) -> list[DataFrame]:
    if len(parts) < COMPACT:
        return parts
    return [stored(reduce(DataFrame.unionByName, parts), what)]


def _numbered(columns: list[pa.ChunkedArray]) -> tuple[pa.Array, list[np.ndarray]]:
    """(all values in order, the columns as 32-bit numbers of values); the list is emptied on the way."""
    kind = columns[0].type
    if not pa.types.is_integer(kind):
        names = pc.unique(pa.chunked_array([c for x in columns for c in x.chunks], kind)).sort()
        return names, [pc.index_in(x, names).to_numpy().astype(np.int32) for x in columns]
    values = [columns.pop(0).to_numpy().astype(np.int64, copy=False) for _ in range(len(columns))]
    some = [v for v in values if len(v)]
    low, high = min(int(v.min()) for v in some), max(int(v.max()) for v in some)
    if high - low < 1024 + 4 * sum(map(len, some)):
        # keys without wide gaps: a table by key
        seen = np.zeros(high - low + 1, bool)
        for v in some:
            seen[v - low] = True
        names = np.flatnonzero(seen) + low
        code = np.cumsum(seen, dtype=np.int32) - np.int32(1)
        number = lambda v: code[v - low]
    else:
        names = np.unique(np.concatenate([np.unique(v) for v in some]))
        number = lambda v: np.searchsorted(names, v).astype(np.int32)
    return pa.array(names).cast(kind), [number(values.pop(0)) for _ in range(len(values))]


class Local:
    """A small graph as arrays: nodes are numbers in the order of their names."""

    def __init__(self, batches: Iterable[pa.RecordBatch]):
        parts: dict[str, list[pa.Array]] = {"src": [], "dst": [], "given": [], "nodes": []}
        for batch in batches:
            s, d = batch.column("src"), batch.column("dst")
            with_s, with_d = s.is_valid(), d.is_valid()
            inner = pc.and_(with_s, with_d)
            parts["src"].append(s.filter(inner))
            parts["dst"].append(d.filter(inner))
            # rows without a source, and without a target
            parts["given"].append(d.filter(pc.and_not(with_d, with_s)))
            parts["nodes"].append(s.filter(pc.and_not(with_s, with_d)))
        self.rows = sum(map(len, (*parts["src"], *parts["given"], *parts["nodes"])))
        if not self.rows:
            return
        kind = parts["src"][0].type
        self.names, codes = _numbered([pa.chunked_array(parts.pop(k), kind) for k in ("src", "dst", "given", "nodes")])
        s, d, self.given, self.nodes = codes
        del codes
        self.n = len(self.names)
        order = np.argsort(s, kind="stable")
        self.dst = d[order]
        del d
        self.src = s[order]
        del s, order
        self.first = np.concatenate([[0], np.cumsum(np.bincount(self.src, minlength=self.n))])

    def after(self, front: np.ndarray) -> np.ndarray:
        """The numbers of the edges that leave the front."""
        begin, count = self.first[front], self.first[front + 1] - self.first[front]
        return np.repeat(begin - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())

    def depths(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nodes reached from the given ones, their distance and least parent (-1)."""
        depth, parent = np.full(self.n, -1, np.int32), np.full(self.n, -1, np.int32)
        front = np.unique(self.given)
        depth[front] = k = 0
        while len(front):
            k += 1
            e = self.after(front)
            e = e[depth[self.dst[e]] < 0]
            e = e[np.lexsort((self.src[e], self.dst[e]))]
            front, at = np.unique(self.dst[e], return_index=True)
            depth[front], parent[front] = k, self.src[e][at]
        found = np.flatnonzero(depth >= 0)
        return found, depth[found], parent[found]

    def layers(self) -> tuple[np.ndarray, np.ndarray]:
        """The longest way to each node; nodes on cycles and behind them are in one last layer."""
        into = np.bincount(self.dst, minlength=self.n)
        layer = np.full(self.n, -1, np.int32)
        front, k = np.flatnonzero(into == 0), 0
        while len(front):
            layer[front] = k
            k += 1
            hit = self.dst[self.after(front)]
            np.subtract.at(into, hit, 1)
            hit = np.unique(hit)
            front = hit[into[hit] == 0]
        layer[layer < 0] = k
        return np.arange(self.n), layer

    def components(self) -> np.ndarray:
        """Of each node, the least node of its strongly connected component (Tarjan's search, without recursion)."""
        index, low, out = np.full(self.n, -1), np.zeros(self.n, np.int64), np.full(self.n, -1)
        dst, first = self.dst.tolist(), self.first.tolist()
        on, stack, count = np.zeros(self.n, bool), [], 0
        for start in range(self.n):
            if index[start] >= 0:
                continue
            work = [(start, first[start])]
            while work:
                v, at = work.pop()
                if index[v] < 0:
                    index[v] = low[v] = count
                    count += 1
                    stack.append(v)
                    on[v] = True
                down = False
                while at < first[v + 1]:
                    w = dst[at]
                    if index[w] < 0:
                        work.append((v, at))
                        work.append((w, first[w]))
                        down = True
                        break
                    if on[w]:
                        low[v] = min(low[v], low[w])
                    at += 1
                if down:
                    continue
                if low[v] == index[v]:
                    group = []
                    while not group or group[-1] != v:
                        group.append(stack.pop())
                        on[group[-1]] = False
                    out[group] = min(group)
                for u, _ in work[-1:]:
                    low[u] = min(low[u], low[v])
        return out


def _is_small(*parts: DataFrame, most: int | None = None) -> bool:
    """Whether stored tables have few enough rows for one task; they are counted from their files' footers."""
    if most is None:
        most = LOCAL_EDGES if isinstance(parts[0].schema[0].dataType, IntegralType) else LOCAL_NAMES
    return sum(p.count() for p in parts) <= most


def _locally(edges: DataFrame, given: DataFrame | None, nodes: DataFrame | None, schema: str, solve: Callable[[Local], list]) -> DataFrame:
    """Solves a small graph in one task; columns of node numbers, marked by a tuple (numbers,), become names."""
    kind = edges.schema["src"].dataType
    rows = edges.select("src", "dst")
    if given is not None:
        rows = rows.union(given.select(F.lit(None).cast(kind).alias("src"), F.col(given.columns[0]).alias("dst")))
    if nodes is not None:
        rows = rows.union(nodes.select(F.col(nodes.columns[0]).alias("src"), F.lit(None).cast(kind).alias("dst")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = Local(batches)
        if not graph.rows:
            return
        columns = []
        for c in solve(graph):
            if isinstance(c, tuple):
                c = graph.names.take(pa.array(c[0], mask=c[0] < 0))
            columns.append(c if isinstance(c, pa.Array) else pa.array(c))
        yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in schema.split(", ")])

    return rows.coalesce(1).mapInArrow(run, schema)


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def reach(edges: DataFrame, seeds: DataFrame, hops: int = 1) -> DataFrame:
    """(node): all nodes reached from the seeds (their first column), seeds too.

    In a large graph each round goes up to ``hops`` edges further, in one job:
    one for wide fronts, more for long chains.
    """
    e = stored(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct(), "reach-edges")
    first = stored(seeds.select(F.col(seeds.columns[0]).alias("node")).where("node IS NOT NULL").distinct(), "reach")
    if _is_small(e, first):
        return stored(_locally(e, first, None, f"node {e.schema['src'].dataType.simpleString()}", lambda g: [(g.depths()[0],)]), "reach")
    e = e.repartition("src").persist()
    try:
        known, front = [first], first
        while True:
            step, steps = front, []
            for _ in range(hops):
                step = step.join(e, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
                steps.append(step)
            seen = reduce(DataFrame.unionByName, known)
            front = stored(reduce(DataFrame.unionByName, steps).distinct().join(seen, "node", "left_anti"), "reach")
            if front.isEmpty():
                return seen
            known = _merged([*known, front], "reach")
    finally:
        e.unpersist()


def depths(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node, depth, parent): distance from the nearest seed, and the least node one step nearer (null for seeds)."""
    kind = edges.schema["src"].dataType.simpleString()
    e = stored(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct(), "depths-edges")
    first = stored(seeds.select(F.col(seeds.columns[0]).alias("node")).where("node IS NOT NULL").distinct(), "depths")
    if _is_small(e, first):

        def solve(g: Local) -> list:
            node, depth, parent = g.depths()
            return [(node,), depth, (parent,)]

        return stored(_locally(e, first, None, f"node {kind}, depth int, parent {kind}", solve), "depths")
    e = e.repartition("src").persist()
    try:
        known = [first.select("node", F.lit(0).alias("depth"), F.lit(None).cast(kind).alias("parent"))]
        front, depth = known[0], 0
        while True:
            depth += 1
            step = front.select("node").join(e, F.col("node") == F.col("src")).groupBy("dst").agg(F.min("src").alias("parent"))
            seen = reduce(DataFrame.unionByName, known)
            front = stored(step.select(F.col("dst").alias("node"), F.lit(depth).alias("depth"), "parent").join(seen.select("node"), "node", "left_anti"), "depths")
            if front.isEmpty():
                return seen
            known = _merged([*known, front], "depths")
    finally:
        e.unpersist()


def shortest_chain(edges: DataFrame, seeds: DataFrame, target: object) -> list:
    """The nodes of a shortest way from a seed to the target; empty where there is none.

    Only the chain comes to the driver, one look-up for each node of it.
    """
    found = stored(depths(edges, seeds), "chain")
    chain: list = []
    node = target
    while node is not None:
        row = found.where(F.col("node") == node).first()
        if row is None:
            return []
        chain.append(node)
        node = row["parent"]
    return chain[::-1]


def layers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, layer): 0 where no edge comes in, else one more than the last predecessor's layer.

    Nodes on cycles, and behind them, are in one layer after all others.  A
    round of a large graph subtracts the edges that leave the last layer from
    the numbers of edges that come in; edges are read for that layer only.
    """
    kind = edges.schema["src"].dataType.simpleString()
    nodes = stored(nodes.select(F.col(nodes.columns[0]).cast(kind).alias("node")).distinct(), "layers-nodes")
    e = edges.select("src", "dst").distinct()
    e = stored(e.join(nodes, F.col("src") == F.col("node"), "left_semi").join(nodes, F.col("dst") == F.col("node"), "left_semi"), "layers-edges")
    if _is_small(e, nodes):

        def solve(g: Local) -> list:
            node, layer = g.layers()
            return [(node,), layer]

        return stored(_locally(e, None, nodes, f"node {kind}, layer int", solve), "layers")
    e = e.repartition("src").persist()
    try:
        into = stored(nodes.join(e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("into")), "node", "left").na.fill(0, ["into"]), "layers")
        known: list[DataFrame] = []
        layer = 0
        while True:
            free = stored(into.where("into = 0").select("node", F.lit(layer).alias("layer")), "layers")
            if free.isEmpty():
                return reduce(DataFrame.unionByName, [*known, into.select("node", F.lit(layer).alias("layer"))])
            less = free.join(e, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("less"))
            into = into.where("into > 0").join(less, "node", "left").select("node", (F.col("into") - F.coalesce("less", F.lit(0))).alias("into"))
            into = stored(into, "layers")
            known = _merged([*known, free], "layers")
            layer += 1
    finally:
        e.unpersist()


def fan_io(nodes: DataFrame, edges: DataFrame, most_in: int = 5, most_out: int = 10) -> DataFrame:
    """(node, fan_in, fan_out, high): distinct neighbours of each node."""
    e = edges.select("src", "dst").distinct()
    fan_in = e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("fan_in"))
    fan_out = e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("fan_out"))
    out = nodes.select(F.col(nodes.columns[0]).alias("node")).join(fan_in, "node", "left").join(fan_out, "node", "left").na.fill(0, ["fan_in", "fan_out"])
    return out.withColumn("high", (F.col("fan_in") > most_in) | (F.col("fan_out") > most_out))


def affected(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """(node): what depends on the changed nodes, these left out."""
    seeds = changed.select(F.col(changed.columns[0]).alias("node")).distinct()
    return reach(reversed_edges(edges), seeds).join(seeds, "node", "left_anti")


def coordination_gaps(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """(consumer, changed): edges into changed nodes from nodes that are not."""
    seeds = changed.select(F.col(changed.columns[0]).alias("changed")).distinct()
    into = edges.join(seeds, F.col("dst") == F.col("changed"))
    return into.join(seeds.select(F.col("changed").alias("also")), F.col("src") == F.col("also"), "left_anti").select(F.col("src").alias("consumer"), "changed").distinct()


def paths(edges: DataFrame, start: DataFrame, max_depth: int = 10, backward: bool = False) -> DataFrame:
    """(path): simple paths along edges from each start node, to a node without a further edge or of ``max_depth`` edges.

    Backward paths go against the edges and are listed from their far end.
    """
    e = reversed_edges(edges) if backward else edges
    e = stored(e.select("src", "dst").distinct(), "paths")
    front = stored(start.select(F.array(F.col(start.columns[0])).alias("path")), "paths")
    ended: list[DataFrame] = []
    for _ in range(max_depth):
        last = F.element_at("path", -1)
        step = front.join(e, (last == F.col("src")) & ~F.array_contains("path", F.col("dst")), "left")
        step = stored(step.select("path", "dst"), "paths")
        ended.append(step.where("dst IS NULL").select("path"))
        front = step.where("dst IS NOT NULL").select(F.concat("path", F.array("dst")).alias("path"))
        if front.isEmpty():
            break
    out = reduce(DataFrame.unionByName, [*ended, front])
    return out.select(F.reverse("path").alias("path")) if backward else out


def cyclic_core(edges: DataFrame) -> DataFrame:
    """The edges that are left when nodes without an edge in, or out, are taken away again and again."""
    e = stored(edges.select("src", "dst").where("src <> dst").distinct(), "core")
    n = e.count()
    while True:
        inner = e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        inner = inner.join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
        e = stored(inner, "core")
        before, n = n, e.count()
        if n == before:
            return e


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the strongly connected components of two nodes or more, each by its least node.

    In a large graph: every node takes the least node that reaches it as its
    colour, the nodes of a colour that reach its least node back are one
    component, and what is left is coloured again.
    """
    kind = edges.schema["src"].dataType.simpleString()
    e = stored(edges.select("src", "dst").where("src <> dst").distinct(), "components")
    if _is_small(e, most=LOCAL_NAMES):

        def solve(g: Local) -> list:
            own = g.components()
            many = np.flatnonzero(np.bincount(own, minlength=g.n)[own] > 1)
            return [(many,), (own[many],)]

        return stored(_locally(e, None, None, f"node {kind}, component {kind}", solve), "components")
    e = cyclic_core(e)
    found: list[DataFrame] = []
    while not e.isEmpty():
        colour = stored(e.select(F.col("src").alias("node")).union(e.select("dst")).distinct().withColumn("colour", F.col("node")), "colours")
        while True:
            least = e.join(colour, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("least"))
            after = stored(colour.join(least, "node", "left").select("node", F.least("colour", "least").alias("colour"), (F.col("least") < F.col("colour")).alias("new")), "colours")
            colour, done = after.select("node", "colour"), after.where("new").isEmpty()
            if done:
                break
        inner = e.join(colour.withColumnsRenamed({"node": "src", "colour": "c"}), "src").join(colour.withColumnsRenamed({"node": "dst", "colour": "d"}), "dst").where("c = d")
        inner = stored(inner.select("src", "dst"), "colours")
        back = reach(reversed_edges(inner), colour.where("node = colour").select("node"))
        found.append(stored(colour.join(back, "node", "left_semi").select("node", F.col("colour").alias("component")), "components"))
        e = e.join(back.withColumnRenamed("node", "src"), "src", "left_anti").join(back.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst")
        e = cyclic_core(e)
    if not found:
        return edges.select(F.col("src").alias("node"), F.col("dst").alias("component")).limit(0)
    every = reduce(DataFrame.unionByName, found)
    return every.join(every.groupBy("component").agg(F.count("*").alias("n")).where("n > 1"), "component", "left_semi").select("node", "component")


def cycles(edges: DataFrame, max_length: int = 4) -> DataFrame:
    """(cycle): simple cycles of at most ``max_length`` nodes, each once, its least node first; of components without one, a shortest cycle.

    So every node that is on a cycle of any length is in a component that is
    reported.  The cycle of a component without a short one goes through its
    least node; of equally short ones it is that of the least last node, and of
    the least node before each other.
    """
    own = components(edges)
    inner = edges.select("src", "dst").where("src <> dst").distinct()
    inner = inner.join(own.withColumnsRenamed({"node": "src", "component": "c"}), "src").join(own.withColumnsRenamed({"node": "dst", "component": "d"}), "dst")
    e = stored(inner.where("c = d").select("src", "dst", F.col("c").alias("component")), "cycles")
    front = e.where("src < dst").select("component", F.array("src", "dst").alias("path"))
    step = e.select("src", "dst")
    found: list[DataFrame] = []
    for length in range(2, max_length + 1):
        last = F.element_at("path", -1)
        found.append(front.join(step, (last == F.col("src")) & (F.col("dst") == F.col("path")[0]), "left_semi"))
        if length < max_length:
            onward = front.join(step, last == F.col("src")).where((F.col("dst") > F.col("path")[0]) & ~F.array_contains("path", F.col("dst")))
            front = stored(onward.select("component", F.concat("path", F.array("dst")).alias("path")), "cycles")
    short = stored(reduce(DataFrame.unionByName, found), "cycles")
    long = stored(e.join(short, "component", "left_anti"), "cycles")
    out = short.select(F.col("path").alias("cycle"))
    if long.isEmpty():
        return out
    d = stored(depths(long, long.select("component").distinct()), "cycles")
    last = long.where("dst = component").join(d, F.col("src") == F.col("node")).groupBy("component").agg(F.min(F.struct("depth", "src")).alias("m"))
    chain = stored(last.select("component", F.col("m.src").alias("at"), F.array("m.src").alias("path")), "cycles")
    while not chain.where("at <> component").isEmpty():
        back = chain.join(d.select("node", "parent"), F.col("at") == F.col("node"), "left")
        before = F.coalesce("parent", "at")
        chain = stored(back.select("component", before.alias("at"), F.when(F.col("parent").isNull(), F.col("path")).otherwise(F.concat(F.array("parent"), "path")).alias("path")), "cycles")
    return out.unionByName(chain.select(F.col("path").alias("cycle")))


def module_graph(imports: DataFrame, packages: DataFrame) -> DataFrame:
    """(src, dst, symbols) among the known packages, without loops; symbols a sorted list (``*`` where none is known)."""
    known = packages.select(F.col(packages.columns[0]).alias("pkg")).distinct()
    both = imports.join(known.select(F.col("pkg").alias("src_pkg")), "src_pkg", "left_semi").join(known.select(F.col("pkg").alias("dst_pkg")), "dst_pkg", "left_semi")
    names = F.array_sort(F.collect_set("symbol")) if "symbol" in imports.columns else F.array().cast("array<string>")
    grouped = both.where("src_pkg <> dst_pkg").groupBy(F.col("src_pkg").alias("src"), F.col("dst_pkg").alias("dst"))
    out = grouped.agg(names.alias("symbols")) if "symbol" in imports.columns else grouped.agg(F.count("*").alias("n")).withColumn("symbols", names).drop("n")
    return out.withColumn("symbols", F.when(F.size("symbols") > 0, F.col("symbols")).otherwise(F.array(F.lit("*"))))


def impact_report(nodes: DataFrame, edges: DataFrame, changed: DataFrame) -> DataFrame:
    """One row: changed, affected, blast_radius, gaps, max_fan_in of the changed nodes, first layer hit."""
    # the edges are used four times
    edges = stored(edges.select("src", "dst").distinct(), "impact-edges")
    hit = stored(affected(edges, changed), "impact")
    fan = fan_io(nodes, edges).join(changed.select(F.col(changed.columns[0]).alias("node")).distinct(), "node", "left_semi")
    one = changed.select(F.countDistinct(changed.columns[0]).alias("changed"))
    touched = layers(nodes, edges).join(changed.select(F.col(changed.columns[0]).alias("node")).distinct(), "node", "left_semi")
    return (
        one.crossJoin(hit.agg(F.count("*").alias("affected")))
        .crossJoin(coordination_gaps(edges, changed).agg(F.count("*").alias("gaps")))
        .crossJoin(fan.agg(F.coalesce(F.max("fan_in"), F.lit(0)).alias("max_fan_in")))
        .crossJoin(touched.agg(F.min("layer").cast("int").alias("first_layer")))
        .withColumn("blast_radius", F.col("changed") + F.col("affected"))
    )


def status(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(fn, status) of (fn, pkg, is_root) nodes: dead if not reached from a root, unused if no other package calls it, else used."""
    # the edges are used twice
    edges = stored(edges.select("src", "dst").distinct(), "status-edges")
    live = reach(edges, nodes.where("is_root").select("fn")).select(F.col("node").alias("fn"), F.lit(1).alias("live"))
    caller = nodes.select(F.col("fn").alias("src"), F.col("pkg").alias("src_pkg"))
    callee = nodes.select(F.col("fn").alias("dst"), F.col("pkg").alias("dst_pkg"))
    external = edges.join(caller, "src").join(callee, "dst").where("src_pkg <> dst_pkg").select(F.col("dst").alias("fn"), F.lit(1).alias("external")).distinct()
    joined = nodes.join(live, "fn", "left").join(external, "fn", "left")
    return joined.select("fn", F.when(F.col("live").isNull(), "dead").when(F.col("external").isNull(), "unused").otherwise("used").alias("status"))


def callers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(fn, callers, external): the names of direct callers, and how many are of another package."""
    a = nodes.select(F.col("fn").alias("src"), F.col("name").alias("caller"), F.col("pkg").alias("a_pkg"))
    b = nodes.select(F.col("fn").alias("dst"), F.col("pkg").alias("b_pkg"))
    joined = edges.join(a, "src").join(b, "dst")
    return joined.groupBy(F.col("dst").alias("fn")).agg(
        F.array_join(F.sort_array(F.collect_list("caller")), ",").alias("callers"), F.count_if(F.col("a_pkg") != F.col("b_pkg")).alias("external")
    )


def lookup(nodes: DataFrame, symbol: str) -> DataFrame:
    """The first node, by package and name, that a symbol names: by name, ``pkg.name``, or its last component."""
    full = F.concat("pkg", F.lit("."), "name")
    hit = (F.col("name") == symbol) | (full == symbol) | full.endswith("/" + symbol) | F.col("name").endswith("." + symbol)
    return nodes.where(hit).orderBy("pkg", "name", "fn").limit(1)
