"""Queries of the graph operators, over the call graph of parts and the import graph of nations."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import scalar as S
from siltstone.operators import analyzers as A
from siltstone.operators import graph as G
from siltstone.schema import Catalog
from siltstone.sources import golang as go
from siltstone.sources.tables import CALLS_SQL, CHANGED_SQL, IMPORTS_SQL, call_graph, changed_functions, imports, layered_graph, module_imports, table

catalog = Catalog()
_REACH = "live AS (SELECT fn FROM nodes WHERE is_root UNION SELECT dst FROM live JOIN edges ON src = fn)"
_UP = "dag AS (SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM edges)"


@catalog.add("grf01_reachability", f"WITH RECURSIVE {CALLS_SQL}, {_REACH} SELECT fn FROM live")
def grf01(spark, sf_dir):
    nodes, edges = call_graph(spark, sf_dir)
    return G.reach(edges, nodes.where("is_root").select("fn")).withColumnRenamed("node", "fn")


@catalog.add("grf01_dead_functions", f"""WITH RECURSIVE {CALLS_SQL}, {_REACH} SELECT 'function "' || name || '" is never reached' AS message, 'deadcode' AS analyzer, 'dead-code' AS category, 'warning' AS severity, 'DC001' AS rule_id FROM nodes WHERE fn NOT IN (SELECT fn FROM live)""")
def grf01_dead(spark, sf_dir):
    return A.dead_functions(*call_graph(spark, sf_dir)).select(*_KINDS)


@catalog.add("grf02_function_identity", "SELECT p_partkey, p_brand || '.' || p_type || '.' || p_name AS fn_key, count(*) OVER (PARTITION BY p_brand, p_type, p_name) AS declared FROM part")
def grf02(spark, sf_dir):
    p = table(spark, sf_dir, "part", "p_partkey", "p_brand", "p_type", "p_name")
    key = p.select("p_partkey", F.concat_ws(".", "p_brand", "p_type", "p_name").alias("fn_key"))
    return key.join(key.groupBy("fn_key").agg(F.count("*").alias("declared")), "fn_key").select("p_partkey", "fn_key", "declared")


def _cycles_sql(edges: str) -> str:
    """Simple cycles of up to four, and for components without one the shortest through the least node; ``edges`` defines imports."""
    return f"""WITH RECURSIVE {edges}, r AS (SELECT src_pkg AS a, dst_pkg AS b FROM imports UNION SELECT r.a, dst_pkg FROM r JOIN imports ON src_pkg = r.b),
c AS (SELECT x.a AS node, least(x.a, min(x.b)) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a),
e AS (SELECT DISTINCT src_pkg, dst_pkg, s.component FROM imports JOIN c s ON s.node = src_pkg JOIN c d ON d.node = dst_pkg WHERE s.component = d.component AND src_pkg <> dst_pkg),
w AS (SELECT component, [src_pkg, dst_pkg] AS p FROM e WHERE src_pkg < dst_pkg UNION ALL SELECT w.component, list_append(p, dst_pkg) FROM w JOIN e ON src_pkg = p[len(p)] WHERE len(p) < 4 AND dst_pkg > p[1] AND NOT list_contains(p, dst_pkg)),
k AS (SELECT w.component, p FROM w JOIN e ON src_pkg = p[len(p)] AND dst_pkg = p[1]),
v AS (SELECT DISTINCT component, [component] AS p FROM e WHERE component NOT IN (SELECT component FROM k) UNION ALL SELECT v.component, list_append(p, dst_pkg) FROM v JOIN e ON src_pkg = p[len(p)] WHERE NOT list_contains(p, dst_pkg)),
z AS (SELECT v.component, p, row_number() OVER (PARTITION BY v.component ORDER BY len(p), list_reverse(p)) AS n FROM v JOIN e ON src_pkg = p[len(p)] AND dst_pkg = p[1] WHERE len(p) > 1)
SELECT array_to_string(p, ' -> ') || ' -> ' || p[1] AS message, {{}} FROM (SELECT p FROM k UNION ALL SELECT p FROM z WHERE n = 1)"""


def _kinds(analyzer: str, category: str, severity: str, rule: str) -> str:
    return f"'{analyzer}' AS analyzer, '{category}' AS category, '{severity}' AS severity, '{rule}' AS rule_id"


_KINDS = ["message", "analyzer", "category", "severity", "rule_id"]


@catalog.add("grf03_import_cycles", _cycles_sql(IMPORTS_SQL).format(_kinds("dependencies", "dependencies", "critical", "DE001")))
def grf03(spark, sf_dir):
    return A.import_cycles(imports(spark, sf_dir)).select(*_KINDS)


#: Nations re-export the next one of their seven.
_ALIASES = "imports AS (SELECT 'n' || n_nationkey AS src_pkg, 'n' || (n_nationkey - n_nationkey % 7 + (n_nationkey + 1) % 7) AS dst_pkg FROM nation)"


@catalog.add("grf04_reexport_cycles", _cycles_sql(_ALIASES).format(_kinds("re-export-cycles", "dependencies", "warning", "RC001")))
def grf04(spark, sf_dir):
    n = table(spark, sf_dir, "nation", "n_nationkey")
    files = n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("folder"), F.concat(F.lit("n"), F.expr("n_nationkey - n_nationkey % 7 + (n_nationkey + 1) % 7").cast("string")).alias("next"))
    src = F.concat(F.lit("package "), "folder", F.lit('\n\nimport T "'), "next", F.lit('"\n\ntype A = T\n'))
    found = go.extract(files.select(F.concat("folder", F.lit("/a.go")).alias("file"), src.alias("src")))
    return A.alias_cycles(go.reexports(found.withColumn("folder", F.col("package")))).select(*_KINDS)


@catalog.add("grf05_build_module_graph", "SELECT src, dst, string_agg(symbol, ',' ORDER BY symbol) AS symbols FROM (SELECT DISTINCT 'p' || a.l_suppkey AS src, 'p' || p_size AS dst, p_brand AS symbol FROM lineitem a JOIN part ON l_partkey = p_partkey WHERE p_size IN (SELECT s_suppkey FROM supplier) AND l_suppkey IN (SELECT s_suppkey FROM supplier) AND l_suppkey <> p_size) GROUP BY src, dst")
def grf05(spark, sf_dir):
    known = table(spark, sf_dir, "supplier", "s_suppkey").select(F.concat(F.lit("p"), F.col("s_suppkey").cast("string")).alias("pkg"))
    return G.module_graph(module_imports(spark, sf_dir), known).select("src", "dst", F.array_join("symbols", ",").alias("symbols"))


@catalog.add("grf06_fan_io", f"WITH {CALLS_SQL}, i AS (SELECT dst AS fn, count(*) AS n FROM edges GROUP BY 1), o AS (SELECT src AS fn, count(*) AS n FROM edges GROUP BY 1) SELECT nodes.fn AS node, coalesce(i.n, 0) AS fan_in, coalesce(o.n, 0) AS fan_out, coalesce(i.n, 0) > 5 OR coalesce(o.n, 0) > 10 AS high FROM nodes LEFT JOIN i ON i.fn = nodes.fn LEFT JOIN o ON o.fn = nodes.fn")
def grf06(spark, sf_dir):
    return G.fan_io(*call_graph(spark, sf_dir))


@catalog.add("grf07_partition_layers", f"WITH RECURSIVE {CALLS_SQL}, {_UP}, w AS (SELECT fn, 0 AS layer FROM nodes UNION SELECT dst, layer + 1 FROM w JOIN dag ON src = fn) SELECT fn AS node, max(layer) AS layer FROM w GROUP BY fn")
def grf07(spark, sf_dir):
    nodes, edges = layered_graph(spark, sf_dir)
    return G.layers(nodes.select("fn"), edges)


_AFFECTED = f"{CHANGED_SQL}, up AS (SELECT fn FROM changed UNION SELECT src FROM up JOIN edges ON dst = fn)"


@catalog.add("grf08_affected_closure", f"WITH RECURSIVE {CALLS_SQL}, {_AFFECTED} SELECT fn AS node FROM up WHERE fn NOT IN (SELECT fn FROM changed)")
def grf08(spark, sf_dir):
    return G.affected(call_graph(spark, sf_dir)[1], changed_functions(spark, sf_dir))


@catalog.add("grf09_changed_to_packages", "SELECT DISTINCT lang AS pkg, source AS file FROM documents WHERE source IN (SELECT 'src' || p_size * 3 FROM part)")
def grf09(spark, sf_dir):
    from siltstone.operators.relational import changed_packages

    files = table(spark, sf_dir, "documents", "source", "lang").select(F.col("lang").alias("pkg"), F.concat(F.lit("all/"), "source").alias("file")).distinct()
    changed = table(spark, sf_dir, "part", "p_size").select(F.concat(F.lit("old/src"), (F.col("p_size") * 3).cast("string")).alias("file"))
    return changed_packages(files, changed).select("pkg", S.base_name(F.col("file")).alias("file"))


@catalog.add("grf10_impact_closure", f"WITH RECURSIVE {CALLS_SQL}, {_AFFECTED} SELECT fn, is_root AS in_diff FROM nodes WHERE fn IN (SELECT fn FROM up) AND fn NOT IN (SELECT fn FROM changed)")
def grf10(spark, sf_dir):
    nodes, edges = call_graph(spark, sf_dir)
    hit = G.affected(edges, changed_functions(spark, sf_dir)).select(F.col("node").alias("fn"))
    return nodes.join(hit, "fn", "left_semi").select("fn", F.col("is_root").alias("in_diff"))


@catalog.add("grf11_coordination_gaps", f"WITH {CALLS_SQL}, {CHANGED_SQL} SELECT src AS consumer, dst AS changed FROM edges WHERE dst IN (SELECT fn FROM changed) AND src NOT IN (SELECT fn FROM changed)")
def grf11(spark, sf_dir):
    return G.coordination_gaps(call_graph(spark, sf_dir)[1], changed_functions(spark, sf_dir))


@catalog.add(
    "grf12_impact_report",
    f"""WITH RECURSIVE {CALLS_SQL}, {_UP}, {CHANGED_SQL}, up AS (SELECT fn FROM changed UNION SELECT src FROM up JOIN dag ON dst = fn),
    w AS (SELECT fn, 0 AS layer FROM nodes UNION SELECT dst, layer + 1 FROM w JOIN dag ON src = fn), l AS (SELECT fn, max(layer) AS layer FROM w GROUP BY fn)
    SELECT (SELECT count(*) FROM changed) AS changed, (SELECT count(*) FROM up) - (SELECT count(*) FROM changed) AS affected, (SELECT count(*) FROM up) AS blast_radius,
    (SELECT count(*) FROM dag WHERE dst IN (SELECT fn FROM changed) AND src NOT IN (SELECT fn FROM changed)) AS gaps,
    coalesce((SELECT max(n) FROM (SELECT count(*) AS n FROM dag WHERE dst IN (SELECT fn FROM changed) GROUP BY dst)), 0) AS max_fan_in, (SELECT min(layer) FROM l WHERE fn IN (SELECT fn FROM changed)) AS first_layer""",
)
def grf12(spark, sf_dir):
    nodes, edges = layered_graph(spark, sf_dir)
    return G.impact_report(nodes.select("fn"), edges, changed_functions(spark, sf_dir))


def _paths_sql(a, b):
    return f"""WITH RECURSIVE {CALLS_SQL}, {CHANGED_SQL}, w AS (SELECT [fn] AS p FROM changed UNION ALL SELECT list_append(p, {b}) FROM w JOIN edges ON {a} = p[len(p)] WHERE len(p) <= 10 AND NOT list_contains(p, {b}))
    SELECT array_to_string({{}}, '>') AS path FROM w WHERE len(p) = 11 OR NOT EXISTS (SELECT 1 FROM edges WHERE {a} = p[len(p)] AND NOT list_contains(p, {b}))"""


@catalog.add("grf13_trace_callers", _paths_sql("dst", "src").format("list_reverse(p)"))
def grf13(spark, sf_dir):
    return G.paths(call_graph(spark, sf_dir)[1], changed_functions(spark, sf_dir), backward=True).select(F.array_join("path", ">").alias("path"))


@catalog.add("grf14_trace_callees", _paths_sql("src", "dst").format("p"))
def grf14(spark, sf_dir):
    return G.paths(call_graph(spark, sf_dir)[1], changed_functions(spark, sf_dir)).select(F.array_join("path", ">").alias("path"))


@catalog.add("grf15_shortest_chain", f"WITH RECURSIVE {CALLS_SQL}, w AS (SELECT fn, 0 AS d FROM nodes WHERE is_root UNION SELECT dst, d + 1 FROM w JOIN edges ON src = fn WHERE d < 60), m AS (SELECT fn, min(d) AS depth FROM w GROUP BY fn) SELECT m.fn AS node, m.depth, min(p.fn) AS parent FROM m LEFT JOIN edges ON dst = m.fn LEFT JOIN m p ON p.fn = src AND p.depth = m.depth - 1 GROUP BY ALL")
def grf15(spark, sf_dir):
    nodes, edges = call_graph(spark, sf_dir)
    return G.depths(edges, nodes.where("is_root").select("fn"))


@catalog.add("grf16_explain_status", f"WITH RECURSIVE {CALLS_SQL}, {_REACH}, x AS (SELECT DISTINCT dst FROM edges JOIN nodes a ON a.fn = src JOIN nodes b ON b.fn = dst WHERE a.pkg <> b.pkg) SELECT fn, CASE WHEN fn NOT IN (SELECT fn FROM live) THEN 'dead' WHEN fn NOT IN (SELECT dst FROM x) THEN 'unused' ELSE 'used' END AS status FROM nodes")
def grf16(spark, sf_dir):
    return G.status(*call_graph(spark, sf_dir))


@catalog.add("grf17_potential_callers", f"WITH {CALLS_SQL} SELECT b.fn, string_agg(a.name, ',' ORDER BY a.name) AS callers, count(*) FILTER (a.pkg <> b.pkg) AS external FROM edges JOIN nodes a ON a.fn = src JOIN nodes b ON b.fn = dst GROUP BY b.fn")
def grf17(spark, sf_dir):
    return G.callers(*call_graph(spark, sf_dir))


@catalog.add("grf18_symbol_lookup", f"WITH {CALLS_SQL} SELECT fn, name, pkg FROM nodes WHERE name = 'fn17' OR pkg || '.' || name = 'fn17' ORDER BY pkg, name, fn LIMIT 1")
def grf18(spark, sf_dir):
    return G.lookup(call_graph(spark, sf_dir)[0], "fn17").select("fn", "name", "pkg")


@catalog.add("jon11_inspect_symbol", f"WITH {CALLS_SQL} SELECT fn, name, (SELECT count(*) FROM edges WHERE dst = fn) AS callers, (SELECT count(*) FROM edges WHERE src = fn) AS callees FROM nodes")
def jon11(spark, sf_dir):
    nodes, edges = call_graph(spark, sf_dir)
    fan = G.fan_io(nodes.select("fn"), edges).select(F.col("node").alias("fn"), F.col("fan_in").alias("callers"), F.col("fan_out").alias("callees"))
    return nodes.select("fn", "name").join(fan, "fn")
