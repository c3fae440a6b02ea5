"""Queries of the sources: files are made of table rows, so that SQL can say what is in them."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import relational as R
from siltstone.schema import Catalog
from siltstone.sources import golang as go
from siltstone.sources import text as T
from siltstone.sources.tables import OWNERS, table

catalog = Catalog()


def _lines(rows, key, texts):
    """(file, line, text) of a few lines for each row."""
    return rows.select(F.col(key).cast("string").alias("file"), F.posexplode(F.array(*texts)).alias("at", "text")).select("file", (F.col("at") + 1).alias("line"), "text")


def _modules(spark, sf_dir):
    # a small row becomes thirteen lines
    p = go.dealt(table(spark, sf_dir, "part", "p_partkey", "p_brand", "p_type", "p_size"), per_task=1 << 16)
    lit, size = F.lit, F.col("p_size").cast("string")
    texts = [
        F.concat(lit("module example.org/"), "p_brand"), lit(""), F.concat(lit("go 1."), size), lit("require ("), F.concat(lit("\ta.org/"), "p_type", lit(" v1.0.0")),
        F.concat(lit("\tb.org/"), "p_type", lit(" v0."), size, lit(".0 // indirect")), lit(")"), F.concat(lit("require c.org/x v"), size), lit("replace ("),
        F.concat(lit("\ta.org/"), "p_type", lit(" => ../"), "p_brand"), lit(")"), lit("replace d.org/y v1.0.0 => e.org/z v2.0.0"), lit("// the end"),
    ]
    return _lines(p, "p_partkey", texts)


@catalog.add("src02_collect_stats", "SELECT count(DISTINCT p_brand) AS packages, count(*) AS files, CAST(sum(p_size % 4 + 2) AS BIGINT) AS decls, CAST(sum(p_size % 4 + 1) AS BIGINT) AS functions, count(*) AS types FROM part")
def src02(spark, sf_dir):
    p = go.dealt(table(spark, sf_dir, "part", "p_partkey", "p_brand", "p_size"))
    functions = F.array_join(F.transform(F.sequence(F.lit(0), F.col("p_size") % 4), lambda k: F.concat(F.lit("func f"), k.cast("string"), F.lit("() {}\n"))), "")
    src = F.concat(F.lit("package "), F.replace("p_brand", F.lit("#"), F.lit("x")), F.lit("\n\ntype T struct{}\n\n"), functions)
    found = go.extract(p.select(F.concat(F.col("p_partkey").cast("string"), F.lit(".go")).alias("file"), src.alias("src")), "package", "n_decls", "n_types", "funcs.name")
    return R.project_stats(found.select("package", "file", "n_decls", "n_types", F.size("funcs").alias("n_funcs")))


@catalog.add(
    "src04_go_mod_require",
    """SELECT CAST(p_partkey AS VARCHAR) AS file, 5 AS line, 'a.org/' || p_type AS module, 'v1.0.0' AS version, FALSE AS indirect FROM part
    UNION ALL SELECT CAST(p_partkey AS VARCHAR), 6, 'b.org/' || p_type, 'v0.' || p_size || '.0 // indirect', TRUE FROM part UNION ALL SELECT CAST(p_partkey AS VARCHAR), 8, 'c.org/x', 'v' || p_size, FALSE FROM part""",
)
def src04(spark, sf_dir):
    return T.requirements(_modules(spark, sf_dir))


@catalog.add("src05_go_mod_replace", "SELECT CAST(p_partkey AS VARCHAR) AS file, 10 AS line, 'a.org/' || p_type AS old_path, '../' || p_brand AS new_path FROM part UNION ALL SELECT CAST(p_partkey AS VARCHAR), 12, 'd.org/y', 'e.org/z v2.0.0' FROM part")
def src05(spark, sf_dir):
    return T.replacements(_modules(spark, sf_dir))


@catalog.add("src06_go_mod_project_info", "SELECT CAST(p_partkey AS VARCHAR) AS file, 'example.org/' || p_brand AS module, '1.' || p_size AS go_version, CAST(3 AS BIGINT) AS requirements FROM part")
def src06(spark, sf_dir):
    return T.project_info(_modules(spark, sf_dir))


@catalog.add("src07_git_log_churn", "SELECT 'u' || user_id || '.go' AS file, count(*) AS commits FROM events WHERE date_trunc('second', ts) >= '2024-01-15' GROUP BY 1")
def src07(spark, sf_dir):
    """Each event is a commit of one file; a log for each user."""
    e = table(spark, sf_dir, "events", "event_id", "user_id", "ts").withColumn("user", F.col("user_id").cast("string"))
    head = F.concat(F.lit("commit "), F.lower(F.hex("event_id")), F.lit(" "), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    lines = F.array(head, F.concat(F.lit("u"), "user", F.lit(".go")), F.lit(""))
    rows = e.select("user", "event_id", F.posexplode(lines).alias("at", "text")).select(F.col("user").alias("file"), (F.col("event_id") * 3 + F.col("at")).alias("line"), "text")
    return T.git_log_files(rows, "2024-01-15").groupBy("file").agg(F.count("*").alias("commits"))


@catalog.add("src08_git_diff_changed", "SELECT DISTINCT source || '/' || lang AS file FROM documents")
def src08(spark, sf_dir):
    d = table(spark, sf_dir, "documents", "source", "lang")
    lines = d.select(F.explode(F.array(F.concat(F.lit(" "), "source", F.lit("/"), "lang", F.lit("\r")), F.lit(""))).alias("text"))
    return T.git_diff_files(lines)


_OWNER_ROWS = " UNION ALL ".join(f"SELECT CAST(n_nationkey AS VARCHAR) AS file, {k} AS rule_idx, '{p}' AS pattern, '{','.join(o)}' AS owners FROM nation" for k, (p, o) in enumerate(OWNERS))


@catalog.add("src09_codeowners_parse", _OWNER_ROWS)
def src09(spark, sf_dir):
    n = table(spark, sf_dir, "nation", "n_nationkey")
    texts = [F.lit("# who owns what"), F.lit("")] + [F.lit(" ".join([p, *o])) for p, o in OWNERS]
    return T.ownership(_lines(n, "n_nationkey", texts)).select("file", "rule_idx", "pattern", F.array_join("owners", ",").alias("owners"))


@catalog.add("src13_suppressions_parse", "SELECT CAST(p_partkey AS VARCHAR) AS file, d AS decl_line, 'ignore' AS type, 'naming' AS analyzer FROM part, (VALUES (0), (4)) v(d) UNION ALL SELECT CAST(p_partkey AS VARCHAR), 4, 'keep', '*' FROM part")
def src13(spark, sf_dir):
    p = table(spark, sf_dir, "part", "p_partkey")
    rows = _lines(p, "p_partkey", [F.lit("//siltstone:ignore naming"), F.lit("// plain"), F.lit("//siltstone:keep")]).withColumn("decl_line", F.lit(4))
    return T.suppressions(rows).select("file", "decl_line", "type", "analyzer")


@catalog.add("src14_generated_files", "SELECT source AS file, bool_or(lang = 'fr') AS generated FROM documents GROUP BY source")
def src14(spark, sf_dir):
    d = table(spark, sf_dir, "documents", "source", "lang")
    path = F.concat(F.lit("a/"), F.when(F.col("lang") == "fr", "gen/").otherwise("hand/"), "source")
    return d.select("source", T.is_generated_path(path).alias("g")).groupBy(F.col("source").alias("file")).agg(F.bool_or("g").alias("generated"))


@catalog.add("src15_platform_imports", "SELECT DISTINCT 'a.org/' || p_brand AS import_path FROM part WHERE p_partkey NOT IN (SELECT l_partkey * 2 FROM lineitem) AND p_partkey % 10 <> 0")
def src15(spark, sf_dir):
    p = table(spark, sf_dir, "part", "p_partkey", "p_brand")
    name = F.concat(F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 10 == 0, "_test.go").otherwise("_windows.go"))
    files = p.select(name.alias("file"), F.concat(F.lit('package a\n\nimport (\n\tb "a.org/'), "p_brand", F.lit('"\n)\n')).alias("src"))
    loaded = table(spark, sf_dir, "lineitem", "l_partkey").select(F.concat((F.col("l_partkey") * 2).cast("string"), F.lit("_windows.go")).alias("file"))
    return go.unloaded_imports(files, loaded)


@catalog.add("src16_test_file_probe", "SELECT lang || '/' || doc_id || '.go' AS file, lang IN (SELECT lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)) AS folder_tested, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS file_tested FROM documents")
def src16(spark, sf_dir):
    d = table(spark, sf_dir, "documents", "doc_id", "lang")
    name = lambda end: F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(end)).alias("file")
    tests = d.join(table(spark, sf_dir, "labels", "doc_id", "toxic").where("toxic = 1"), "doc_id", "left_semi").select(name("_test.go"))
    return R.test_probe(d.select(name(".go")).union(tests))
