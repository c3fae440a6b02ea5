"""Operator inputs from the tables of a warehouse folder.

Each function has a twin in SQL (``*_SQL``), a list of common table
expressions for an independent check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.schema import FINDING_COLUMNS, SECRETS


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table of the folder, with the named columns only."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def _file() -> Column:
    return F.concat(F.lit("src/"), F.coalesce("source", F.lit("none")), F.lit("/"), F.coalesce("lang", F.lit("xx")), F.lit("/f"), F.expr("doc_id DIV 50").cast("string"), F.lit(".go"))


def _finding(analyzer: str, category: str, severity, message, detail, suggestion: str, rule: str) -> Column:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        F.lit(analyzer).alias("analyzer"), F.lit(category).alias("category"), as_col(severity).alias("severity"), as_col(message).alias("message"),
        as_col(detail).alias("detail"), F.lit(suggestion).alias("suggestion"), F.lit(rule).alias("rule_id"),
    )


def by_ratio(x: Column, limit: int, warning: float, critical: float) -> Column:
    """Severity by how far a measure is beyond its limit."""
    return F.when(x >= limit * critical, "critical").when(x >= limit * warning, "warning").otherwise("hint")


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings over documents: one document is a declaration, fifty are a file.

    Two scans of the texts; what leaves them is a hash and a few numbers.  First
    copies are the least ids of hashes, found by partial aggregation; only rows
    whose hash has several are joined with them.  Labels come by a join on the id.
    """
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source", "n_chars")
    text = F.coalesce("text", F.lit(""))
    seen = docs.select(
        "doc_id", _file().alias("file"), F.expr("doc_id - doc_id DIV 50 * 50 + 1").cast("int").alias("line"), F.length(text).cast("int").alias("size"),
        (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).cast("int").alias("breaks"), F.sha2(text, 256).alias("hash"),
        F.array(*(text.rlike(p) for _, _, p in SECRETS)).alias("secret"), text.rlike(r"[a-z]_[a-z]").alias("snake"),
    )
    hashes = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))
    firsts = hashes.groupBy("hash").agg(F.min("doc_id").alias("original"), F.count("*").alias("n")).where("n > 1").drop("n")
    seen = seen.join(firsts, "hash", "left").drop("hash")
    labels = table(spark, sf_dir, "labels", "doc_id", "quality", "toxic").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    seen = seen.join(labels, "doc_id", "left")
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    rules = [
        (F.col("secret")[k], _finding("security", "code-smell", "critical", F.concat(F.lit(what + " in "), name), "", "move it out of the text", rule))
        for k, (rule, what, _) in enumerate(SECRETS)
    ]
    size, breaks = F.col("size"), F.col("breaks")
    rules += [
        (size > 2000, _finding("large-functions", "code-smell", by_ratio(size, 2000, 2, 4), F.concat(F.lit("function "), name, F.lit(" is long")), F.concat(size.cast("string"), F.lit(" characters")), "split it", "LF001")),
        (breaks > 10, _finding("complexity", "complexity", by_ratio(breaks, 10, 2, 3), F.concat(F.lit("function "), name, F.lit(" has complexity "), breaks.cast("string")), F.concat(F.lit("lines "), breaks.cast("string")), "simplify it", "CX001")),
        (F.col("original") < F.col("doc_id"), _finding("duplication", "duplication", "warning", F.concat(F.lit("copy of d"), F.col("original").cast("string")), "", "extract it", "DP001")),
        (F.col("toxic") == 1, _finding("deadcode", "dead-code", "warning", F.concat(F.lit('function "'), name, F.lit('" is never reached')), "", "remove it", "DC001")),
        (F.col("quality") == 0, _finding("unused", "unused", "hint", F.concat(F.lit('exported "'), name, F.lit('" is not used elsewhere')), "", "unexport it", "UU001")),
        (F.col("snake"), _finding("naming", "code-smell", "info", F.concat(F.lit('name "'), name, F.lit('" has an underscore')), "", "rename it", "NM001")),
    ]
    found = F.filter(F.array(*(F.when(ok, f) for ok, f in rules)), lambda x: x.isNotNull())
    rows = seen.select("file", "line", (F.col("line") + F.col("breaks")).alias("end_line"), F.explode(found).alias("f"))
    return rows.select("f.analyzer", "f.category", "f.severity", "f.message", "f.detail", "file", "line", "end_line", F.lit(1).alias("col"), "f.suggestion", "f.rule_id").select(*FINDING_COLUMNS)


_q = lambda s: "'" + s.replace("'", "''") + "'"
_SECRET_SQL = " UNION ALL ".join(
    f"SELECT doc_id, 'security' AS analyzer, 'code-smell' AS category, 'critical' AS severity, {_q(what + ' in d')} || doc_id AS message, '' AS detail, 'move it out of the text' AS suggestion, {_q(rule)} AS rule_id FROM seen WHERE regexp_matches(t, {_q(p)})"
    for rule, what, p in SECRETS
)
FINDINGS_SQL = f"""
seen AS (
  SELECT doc_id, coalesce(text, '') AS t, 'src/' || coalesce(source, 'none') || '/' || coalesce(lang, 'xx') || '/f' || (doc_id // 50) || '.go' AS file,
         doc_id - doc_id // 50 * 50 + 1 AS line, length(coalesce(text, '')) AS size, len(string_split(coalesce(text, ''), chr(10))) - 1 AS breaks FROM documents
), marked AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id
), firsts AS (SELECT t, min(doc_id) AS original FROM seen GROUP BY t
), raised AS (
  {_SECRET_SQL}
  UNION ALL SELECT doc_id, 'large-functions', 'code-smell', CASE WHEN size >= 8000 THEN 'critical' WHEN size >= 4000 THEN 'warning' ELSE 'hint' END, 'function d' || doc_id || ' is long', size || ' characters', 'split it', 'LF001' FROM seen WHERE size > 2000
  UNION ALL SELECT doc_id, 'complexity', 'complexity', CASE WHEN breaks >= 30 THEN 'critical' WHEN breaks >= 20 THEN 'warning' ELSE 'hint' END, 'function d' || doc_id || ' has complexity ' || breaks, 'lines ' || breaks, 'simplify it', 'CX001' FROM seen WHERE breaks > 10
  UNION ALL SELECT doc_id, 'duplication', 'duplication', 'warning', 'copy of d' || original, '', 'extract it', 'DP001' FROM seen JOIN firsts USING (t) WHERE original < doc_id
  UNION ALL SELECT doc_id, 'deadcode', 'dead-code', 'warning', 'function "d' || doc_id || '" is never reached', '', 'remove it', 'DC001' FROM seen JOIN marked USING (doc_id) WHERE toxic = 1
  UNION ALL SELECT doc_id, 'unused', 'unused', 'hint', 'exported "d' || doc_id || '" is not used elsewhere', '', 'unexport it', 'UU001' FROM seen JOIN marked USING (doc_id) WHERE quality = 0
  UNION ALL SELECT doc_id, 'naming', 'code-smell', 'info', 'name "d' || doc_id || '" has an underscore', '', 'rename it', 'NM001' FROM seen WHERE regexp_matches(t, '[a-z]_[a-z]')
), findings AS (
  SELECT analyzer, category, severity, message, detail, file, CAST(line AS INTEGER) AS line, CAST(line + breaks AS INTEGER) AS end_line, 1 AS col, suggestion, rule_id
  FROM raised JOIN (SELECT doc_id, file, line, breaks FROM seen) USING (doc_id)
), ranked AS (
  SELECT *, CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 WHEN 'info' THEN 2 WHEN 'hint' THEN 3 ELSE 4 END AS rank,
         CASE severity WHEN 'critical' THEN 25 WHEN 'warning' THEN 8 WHEN 'info' THEN 2 WHEN 'hint' THEN 1 ELSE 0 END AS weight FROM findings
)"""


def call_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): parts are functions; every line item is a call, from its part to one whose key follows from its own.

    A part calls those of twice its key, or that of the least key of its five,
    so there are few distinct calls however many items there are.
    nodes: fn, name, pkg, is_root; edges: src, dst, distinct and without loops.
    """
    part = table(spark, sf_dir, "part", "p_partkey", "p_brand", "p_size")
    nodes = part.select(F.col("p_partkey").alias("fn"), F.concat(F.lit("fn"), F.col("p_partkey").cast("string")).alias("name"), F.col("p_brand").alias("pkg"), (F.col("p_size") == 50).alias("is_root"))
    items = table(spark, sf_dir, "lineitem", "l_partkey", "l_suppkey", "l_linenumber")
    dst = F.expr("CASE WHEN l_suppkey % 7 = 0 THEN l_partkey - l_partkey % 5 ELSE 2 * l_partkey + l_linenumber % 2 END")
    calls = items.select(F.col("l_partkey").alias("src"), dst.alias("dst")).distinct()
    return nodes, calls.where("src <> dst").join(nodes.select(F.col("fn").alias("dst")), "dst", "left_semi").select("src", "dst")


CALLS_SQL = """
nodes AS (SELECT p_partkey AS fn, 'fn' || p_partkey AS name, p_brand AS pkg, p_size = 50 AS is_root FROM part
), edges AS (
  SELECT DISTINCT src, dst FROM (
    SELECT l_partkey AS src, CASE WHEN l_suppkey % 7 = 0 THEN l_partkey - l_partkey % 5 ELSE 2 * l_partkey + l_linenumber % 2 END AS dst FROM lineitem
  ) WHERE src <> dst AND dst IN (SELECT p_partkey FROM part)
)"""


def layered_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The call graph with every edge from the lesser to the greater key, so that it has no cycle."""
    nodes, edges = call_graph(spark, sf_dir)
    return nodes, edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def changed_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds of a change: the largest parts."""
    part = table(spark, sf_dir, "part", "p_partkey", "p_size")
    return part.where("p_size >= 48").select(F.col("p_partkey").alias("fn"))


CHANGED_SQL = "changed AS (SELECT p_partkey AS fn FROM part WHERE p_size >= 48)"


def symbols(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(symbols, uses): customers are exported symbols of their nation; every order is a use of the first of its customer's four.

    One symbol in three that are used is used by its own nation only.
    """
    customer = table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    nation = F.concat(F.lit("nation"), F.col("c_nationkey").cast("string"))
    own = customer.select(F.col("c_custkey").alias("symbol"), F.col("c_name").alias("name"), nation.alias("owner_pkg"), F.col("c_mktsegment").alias("kind"))
    orders = table(spark, sf_dir, "orders", "o_custkey", "o_totalprice").select(
        F.expr("o_custkey - o_custkey % 4").alias("symbol"), F.concat(F.lit("nation"), F.expr("CAST(floor(o_totalprice / 10000) AS INT)").cast("string")).alias("pkg")
    )
    # distinct uses first: orders of one customer are many
    uses = orders.distinct().join(own.select("symbol", "owner_pkg"), "symbol")
    uses = uses.select("symbol", F.expr("CASE WHEN symbol % 12 = 0 THEN owner_pkg ELSE pkg END").alias("using_pkg"))
    return own, uses


SYMBOLS_SQL = """
symbols AS (SELECT c_custkey AS symbol, c_name AS name, 'nation' || c_nationkey AS owner_pkg, c_mktsegment AS kind FROM customer
), uses AS (
  SELECT c_custkey AS symbol, CASE WHEN c_custkey % 12 = 0 THEN 'nation' || c_nationkey ELSE 'nation' || CAST(floor(o_totalprice / 10000) AS INTEGER) END AS using_pkg
  FROM orders JOIN customer ON c_custkey = o_custkey - o_custkey % 4
)"""


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src_pkg, dst_pkg): every line item is an import by its customer's nation.

    Nations import the fifth one after them, or the first of their five, or
    the first of some five by the supplier's nation: there is a tight group of
    packages, and four rings of five.
    """
    t = lambda name, *cols: table(spark, sf_dir, name, *cols)
    nation = t("nation", "n_nationkey", "n_name", "n_regionkey").join(t("region", "r_regionkey", "r_name"), F.col("n_regionkey") == F.col("r_regionkey"))
    place = lambda k, name: nation.select(F.col("n_nationkey").alias(k), F.concat(F.lower("r_name"), F.lit("/"), F.lower("n_name")).alias(name))
    items = t("lineitem", "l_orderkey", "l_suppkey", "l_linenumber").join(t("orders", "o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    items = items.join(t("customer", "c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier", "s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    dst = F.expr("CASE l_linenumber % 3 WHEN 0 THEN (c_nationkey + 5) % 25 WHEN 1 THEN c_nationkey - c_nationkey % 5 ELSE s_nationkey % 5 * 5 END")
    keys = items.select(F.col("c_nationkey").alias("a"), dst.alias("b")).where("a <> b").distinct()
    return keys.join(place("a", "src_pkg"), "a").join(place("b", "dst_pkg"), "b").select("src_pkg", "dst_pkg")


IMPORTS_SQL = """
places AS (SELECT n_nationkey AS k, lower(r_name) || '/' || lower(n_name) AS place FROM nation JOIN region ON n_regionkey = r_regionkey
), imports AS (
  SELECT DISTINCT a.place AS src_pkg, b.place AS dst_pkg FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN places a ON a.k = c_nationkey
  JOIN places b ON b.k = CASE l_linenumber % 3 WHEN 0 THEN (c_nationkey + 5) % 25 WHEN 1 THEN c_nationkey - c_nationkey % 5 ELSE s_nationkey % 5 * 5 END
  WHERE a.place <> b.place
)"""


def module_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src_pkg, dst_pkg, symbol): every line item is an import by its supplier of the package of its part's size, for the brand."""
    name = lambda c: F.concat(F.lit("p"), F.col(c).cast("string"))
    items, part = table(spark, sf_dir, "lineitem", "l_partkey", "l_suppkey"), table(spark, sf_dir, "part", "p_partkey", "p_size", "p_brand")
    return items.join(part, F.col("l_partkey") == F.col("p_partkey")).select(name("l_suppkey").alias("src_pkg"), name("p_size").alias("dst_pkg"), F.col("p_brand").alias("symbol"))


#: (package, must_not_use): suffixes of package paths.
RULES = [("nation_1", "nation_6"), ("nation_3", "africa/nation_0"), ("nation_9", "europe/nation_3"), ("nation_20", "nation_30"), ("nation_2", "nation_4")]
RULES_SQL = "rules AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in RULES) + ") v(package, must_not_use))"


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "package string, must_not_use string")


#: Ownership rules in order; the last that matches a path counts.
OWNERS = [("*", ["@all"]), ("src/src1/", ["@one", "@two"]), ("*.go", ["@code"]), ("/src/src2", ["@two"]), ("/src/src3", []), ("src/*/fr/*", ["@fr"]), ("/src/src4/de", ["@four", "@de"])]
