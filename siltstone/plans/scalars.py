"""Queries of the scalar functions, over documents, parts, customers and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import scalar as S
from siltstone.schema import Catalog
from siltstone.sources.tables import FINDINGS_SQL, findings, table

catalog = Catalog()
_PATH_SQL = "SELECT doc_id, 'src/' || source || '/' || lang || '/f' || doc_id || '.go' AS path FROM documents"
_NAME_SQL = "SELECT p_partkey, replace(lower(p_name), ' ', '_') || '_' || lower(p_brand) AS name FROM part"


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("src/"), "source", F.lit("/"), "lang", F.lit("/f"), F.col("doc_id").cast("string"), F.lit(".go"))
    return table(spark, sf_dir, "documents", "doc_id", "source", "lang").select("doc_id", path.alias("path"))


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.replace(F.lower("p_name"), F.lit(" "), F.lit("_")), F.lit("_"), F.lower("p_brand"))
    return table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand").select("p_partkey", name.alias("name"))


@catalog.add("scl01_short_path", f"SELECT doc_id, regexp_extract(path, '([^/]*/[^/]*/[^/]*)$', 1) AS short FROM ({_PATH_SQL})")
def scl01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).select("doc_id", S.short_path(F.col("path")).alias("short"))


@catalog.add("scl02_last_segment", f"SELECT doc_id, regexp_extract(path, '([^/]*)$', 1) AS segment FROM ({_PATH_SQL})")
def scl02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).select("doc_id", S.last_segment(F.col("path")).alias("segment"))


_REST = "list_transform(string_split(name, '_')[2:], lambda w: upper(w[1:1]) || {}(w[2:]))"


@catalog.add("scl03_to_camel", f"SELECT p_partkey, string_split(name, '_')[1] || array_to_string({_REST.format('')}, '') AS camel FROM ({_NAME_SQL})")
def scl03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir).select("p_partkey", S.to_camel(F.col("name")).alias("camel"))


@catalog.add("scl04_to_pascal", f"SELECT p_partkey, array_to_string(list_transform(string_split(name, '_'), lambda w: upper(w[1:1]) || w[2:]), '') AS pascal FROM ({_NAME_SQL})")
def scl04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir).select("p_partkey", S.to_pascal(F.col("name")).alias("pascal"))


@catalog.add("scl05_to_camel_lower", f"SELECT p_partkey, string_split(upper(name), '_')[1] || array_to_string({_REST.format('lower').replace('(name', '(upper(name)')}, '') AS camel FROM ({_NAME_SQL})")
def scl05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir).select("p_partkey", S.to_camel_lower(F.upper("name")).alias("camel"))


@catalog.add("scl06_is_all_caps", "SELECT c_custkey, regexp_matches(c_mktsegment, '^[A-Z0-9_]*[A-Z][A-Z0-9_]*$') AND c_mktsegment NOT IN ('BUILDING') AS caps FROM customer")
def scl06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment").select("c_custkey", S.is_all_caps(F.col("c_mktsegment"), ["BUILDING"]).alias("caps"))


@catalog.add("scl07_grade_for", "SELECT p_partkey, CASE WHEN p_size * 2 >= 90 THEN 'A' WHEN p_size * 2 >= 80 THEN 'B' WHEN p_size * 2 >= 70 THEN 'C' WHEN p_size * 2 >= 60 THEN 'D' WHEN p_size * 2 >= 50 THEN 'E' ELSE 'F' END AS grade FROM part")
def scl07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part", "p_partkey", "p_size").select("p_partkey", S.grade_for(F.col("p_size") * 2).alias("grade"))


@catalog.add("scl08_severity_rank", f"WITH {FINDINGS_SQL} SELECT severity, rank, count(*) AS n FROM ranked GROUP BY ALL")
def scl08(spark: SparkSession, sf_dir: str) -> DataFrame:
    severity = S.parse_severity(F.upper("severity"))
    return findings(spark, sf_dir).groupBy(severity.alias("severity"), S.severity_rank(severity).alias("rank")).agg(F.count("*").alias("n"))


@catalog.add(
    "scl09_levels",
    f"""WITH {FINDINGS_SQL} SELECT severity, CASE severity WHEN 'critical' THEN 'error' WHEN 'warning' THEN 'warning' ELSE 'note' END AS sarif,
    CASE severity WHEN 'critical' THEN 'blocker' WHEN 'warning' THEN 'major' WHEN 'info' THEN 'minor' ELSE 'info' END AS climate, rank + 1 AS lsp,
    CASE severity WHEN 'critical' THEN '✗' WHEN 'warning' THEN '!' WHEN 'info' THEN 'i' ELSE '·' END AS icon, count(*) AS n FROM ranked GROUP BY ALL""",
)
def scl09(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("severity")
    n = findings(spark, sf_dir).groupBy("severity").agg(F.count("*").alias("n"))
    return n.select("severity", S.sarif_level(s).alias("sarif"), S.codeclimate_severity(s).alias("climate"), S.lsp_severity(s).alias("lsp"), S.icon(s).alias("icon"), "n")


@catalog.add("scl10_fingerprint", f"WITH {FINDINGS_SQL} SELECT file, line, rule_id, sha256(file || ':' || line || ':' || rule_id) AS fingerprint FROM findings")
def scl10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark, sf_dir).select("file", "line", "rule_id", S.fingerprint(F.col("file"), F.col("line"), F.col("rule_id")).alias("fingerprint"))


@catalog.add("scl11_extract_between", f"WITH {FINDINGS_SQL} SELECT file, line, rule_id, message, CASE WHEN message LIKE '%function %' THEN string_split(substr(message, instr(message, 'function ') + 9), ' ')[1] ELSE '' END AS fn FROM findings")
def scl11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark, sf_dir).select("file", "line", "rule_id", "message", S.extract_between(F.col("message"), "function ", " ").alias("fn"))


@catalog.add("scl12_extract_symbol", f"""WITH {FINDINGS_SQL} SELECT file, line, rule_id, CASE WHEN regexp_matches(message, '"[^"]*"') THEN regexp_extract(message, '"([^"]*)"', 1) ELSE string_split(message, ' ')[1] END AS symbol FROM findings""")
def scl12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark, sf_dir).select("file", "line", "rule_id", S.extract_symbol(F.col("message")).alias("symbol"))


_COMPLEXITY_SQL = "CAST(CASE WHEN regexp_extract(detail, '([0-9]+)[^0-9]*$', 1) NOT IN ('', '0') THEN regexp_extract(detail, '([0-9]+)[^0-9]*$', 1) WHEN regexp_extract(message, '([0-9]+)[^0-9]*$', 1) <> '' THEN regexp_extract(message, '([0-9]+)[^0-9]*$', 1) ELSE '0' END AS BIGINT)"


@catalog.add("scl13_trailing_number", f"WITH {FINDINGS_SQL} SELECT file, line, rule_id, {_COMPLEXITY_SQL} AS number FROM findings")
def scl13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark, sf_dir).select("file", "line", "rule_id", S.complexity_of(F.col("detail"), F.col("message")).cast("long").alias("number"))


@catalog.add("scl14_owners_match", f"SELECT doc_id, regexp_matches(path, '^(src/src1/|.*[.]go$)') AS a, contains(path, 'src/src1/') AS b, starts_with(path, 'src/src2') AS c, regexp_matches(path, '^src/[^/]*/fr/[^/]*$') AS d FROM ({_PATH_SQL})")
def scl14(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = lambda p: F.col("path").rlike(S.owners_regex(p))
    return _paths(spark, sf_dir).select("doc_id", hit("*.go").alias("a"), hit("src/src1/").alias("b"), hit("/src/src2").alias("c"), hit("src/*/fr/*").alias("d"))


@catalog.add("scl15_parse_rule", "SELECT p_partkey, lower(p_brand) AS package, lower(p_type) AS must_not_use FROM part")
def scl15(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = table(spark, sf_dir, "part", "p_partkey", "p_brand", "p_type").select("p_partkey", F.concat(F.lower("p_brand"), F.lit("  must not import  "), F.lower("p_type")).alias("rule"))
    package, other = S.parse_rule(F.col("rule"))
    return rule.select("p_partkey", package.alias("package"), other.alias("must_not_use"))


@catalog.add("scl16_is_operational", "SELECT event_id, event_type IN ('click') AS operational FROM events")
def scl16(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.col("event_type"), F.when(F.col("event_type") == "click", F.lit("_debug ")).otherwise(F.lit("_mode")))
    return table(spark, sf_dir, "events", "event_id", "event_type").select("event_id", S.is_operational(name).alias("operational"))


@catalog.add("scl17_looks_like_sql", r"SELECT doc_id, regexp_matches(lower(text), '\b(select|insert|update|delete|from|where|join|values|set|drop|create|alter)\b') AS sql FROM documents")
def scl17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", S.looks_like_sql(F.col("text")).alias("sql"))


@catalog.add("scl18_format_duration", "SELECT p_partkey, CASE WHEN p_size * 7 // 60 > 0 THEN (p_size * 7 // 60) || 'h ' || (p_size * 7 % 60) || 'm' ELSE (p_size * 7 % 60) || 'm' END AS minutes, CASE WHEN p_size * 40 < 1000 THEN (p_size * 40) || 'ms' ELSE (p_size * 40 // 1000) || 's' END AS millis FROM part")
def scl18(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    return table(spark, sf_dir, "part", "p_partkey", "p_size").select("p_partkey", S.format_minutes(size * 7).alias("minutes"), S.format_millis(size * 40).alias("millis"))


@catalog.add("scl19_snapshot_name", "SELECT event_id, strftime(ts, '%Y-%m-%d-%H%M%S') || '.json' AS name FROM events")
def scl19(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events", "event_id", "ts").select("event_id", S.snapshot_name(F.col("ts")).alias("name"))


@catalog.add(
    "scl20_effort_confidence",
    f"""WITH {FINDINGS_SQL}, g AS (SELECT file, category, count(*) FILTER (severity = 'critical') AS c, count(*) FILTER (severity = 'warning') AS w, count(*) AS n FROM findings GROUP BY ALL)
    SELECT file, category, CASE category WHEN 'dead-code' THEN 'S' WHEN 'complexity' THEN 'L' ELSE 'M' END AS effort, CASE WHEN c > 0 OR w >= 3 THEN 'high' WHEN w > 0 OR n >= 5 THEN 'medium' ELSE 'low' END AS confidence FROM g""",
)
def scl20(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = findings(spark, sf_dir).groupBy("file", "category").agg(F.count_if(F.col("severity") == "critical").alias("c"), F.count_if(F.col("severity") == "warning").alias("w"), F.count("*").alias("n"))
    return g.select("file", "category", S.effort_for(F.col("category")).alias("effort"), S.confidence_for(F.col("c"), F.col("w"), F.col("n")).alias("confidence"))


@catalog.add("scl21_truncate", "SELECT doc_id, CASE WHEN octet_length(encode(text)) > 80 THEN text[1:77] || '...' ELSE text END AS cut FROM documents")
def scl21(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", S.truncate(F.col("text"), 80).alias("cut"))


@catalog.add("scl22_uri_path", f"SELECT doc_id, path, 'file://' || path AS uri FROM ({_PATH_SQL})")
def scl22(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = S.path_to_uri(F.col("path"))
    return _paths(spark, sf_dir).select("doc_id", S.uri_to_path(uri).alias("path"), uri.alias("uri"))


@catalog.add(
    "scl23_linter_maps",
    "SELECT event_id, CASE event_type WHEN 'click' THEN 'complexity' WHEN 'view' THEN 'security' ELSE 'unused' END AS analyzer, CASE event_type WHEN 'view' THEN 'critical' ELSE 'warning' END AS severity FROM events",
)
def scl23(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("event_type") == "click", "gocyclo").when(F.col("event_type") == "view", "gosec").otherwise("U1000")
    return table(spark, sf_dir, "events", "event_id", "event_type").select("event_id", S.linter_analyzer(name).alias("analyzer"), S.linter_severity(name).alias("severity"))


@catalog.add("scl24_func_names", "SELECT p_partkey, p_brand || '.' || upper(p_name[1:1]) AS clean, '(' || p_brand || ').' || upper(p_name[1:1]) AS label FROM part")
def scl24(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.upper(F.substring("p_name", 1, 1))
    full = F.concat(F.lit("example.org/shop.(*"), "p_brand", F.lit(")."), name)
    return table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand").select("p_partkey", S.clean_func_name(full).alias("clean"), S.func_label(F.concat(F.lit("*"), "p_brand"), name).alias("label"))
