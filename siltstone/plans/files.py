"""Queries that go by files: sources made of table rows, reports, baselines and snapshots written and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.config import RULE_PACKS
from siltstone.operators import relational as R
from siltstone.operators import reports as P
from siltstone.schema import Catalog
from siltstone.sources import golang as go
from siltstone.sources import sinks
from siltstone.sources.tables import FINDINGS_SQL, findings, table
from siltstone.storage import shared_dir

catalog = Catalog()
W = f"WITH {FINDINGS_SQL}"


def _sources(spark, sf_dir):
    """A Go file for each part: a function with as many branches, in a loop, as the part's size."""
    p = go.dealt(table(spark, sf_dir, "part", "p_partkey", "p_name", "p_size"))
    name = F.concat(F.lit("Make"), F.col("p_partkey").cast("string"))
    branch = F.lit("\t\tif a > 1 && a < 9 {\n\t\t\tuse(a)\n\t\t}\n")
    src = F.concat(
        F.lit("package made\n\nimport \"fmt\"\n\n// "), "p_name", F.lit("\nfunc "), name, F.lit("(a int) int {\n\tfor a < 10 || done() {\n"), F.repeat(branch, F.col("p_size")),
        F.lit('\t}\n\tfmt.Println("'), "p_name", F.lit('")\n\treturn a\n}\n'),
    )
    return p.select(F.concat(F.lit("made/"), F.col("p_partkey").cast("string"), F.lit(".go")).alias("file"), src.alias("src"))


@catalog.add("src01_load_packages", "SELECT 'made/' || p_partkey || '.go' AS file, 'made' AS package, 'fmt' AS imports, 'Make' || p_partkey AS name, 6 AS line, 11 + 3 * p_size AS end_line FROM part")
def src01(spark, sf_dir):
    found = go.extract(_sources(spark, sf_dir), "package", "imports", "funcs.name", "funcs.line", "funcs.end_line")
    return found.select("file", "package", F.array_join("imports.path", ",").alias("imports"), F.explode("funcs").alias("f")).select("file", "package", "imports", "f.name", "f.line", "f.end_line")


@catalog.add("anl02_cognitive", "SELECT 'made/' || p_partkey || '.go' AS file, 3 + 2 * p_size AS cyclomatic, 2 + 2 * p_size AS cognitive, 3 AS stmt_count FROM part")
def anl02(spark, sf_dir):
    f = go.exploded(go.extract(_sources(spark, sf_dir), "package", "funcs.cyclomatic", "funcs.cognitive", "funcs.stmt_count"), "funcs")
    return f.select("file", "cyclomatic", "cognitive", "stmt_count")


@catalog.add("snk01_json", f"{W} SELECT file, line, rule_id, message, CASE WHEN detail <> '' THEN detail END AS detail FROM findings")
def snk01(spark, sf_dir):
    rows = sinks.json_rows(findings(spark, sf_dir))
    return rows.select(F.from_json("json", "file string, line int, rule_id string, message string, detail string").alias("j")).select("j.*")


@catalog.add("snk02_text", f"{W} SELECT file, count(*) AS n, string_agg('  ' || CASE severity WHEN 'critical' THEN '✗' WHEN 'warning' THEN '!' WHEN 'info' THEN 'i' ELSE '·' END || ' ' || line || ' ' || message || chr(10) || '      -> ' || suggestion, chr(10) ORDER BY line, rule_id, message) AS block FROM findings GROUP BY file")
def snk02(spark, sf_dir):
    return sinks.text_blocks(findings(spark, sf_dir))


@catalog.add("snk07_markdown", f"{W} SELECT 'severity' AS section, severity AS key, count(*) AS n FROM findings GROUP BY severity UNION ALL SELECT 'analyzer', analyzer, count(*) FROM findings GROUP BY analyzer UNION ALL SELECT 'category', category, count(*) FROM findings GROUP BY category UNION ALL SELECT 'total', '', count(*) FROM findings")
def snk07(spark, sf_dir):
    return sinks.markdown(findings(spark, sf_dir))


_BASELINE = f"{W} SELECT file, line, rule_id, analyzer, severity FROM findings WHERE severity <> 'hint'"


@catalog.add("snk12_baseline_save", _BASELINE)
@catalog.add("src11_baseline_load", _BASELINE)
def snk12(spark, sf_dir):
    where = shared_dir(spark, "baseline")
    sinks.save_baseline(R.severity_filter(findings(spark, sf_dir), "info"), where)
    return sinks.load_baseline(spark, where).select("file", "line", "rule_id", "analyzer", "severity")


_SNAPSHOTS = f"""{W}, s AS (SELECT '2024-01-02T00:00:00Z' AS timestamp, greatest(0, 100 - sum(weight)) AS score, count(*) AS n FROM ranked WHERE rank = 0 UNION ALL SELECT '2024-01-01T00:00:00Z', greatest(0, 100 - sum(weight)), count(*) FROM ranked)
SELECT timestamp, CAST(score AS BIGINT) AS score, n AS findings_count FROM s"""


@catalog.add("snk13_snapshot_save", _SNAPSHOTS)
@catalog.add("src12_snapshots_load", _SNAPSHOTS)
@catalog.add("str04_append_snapshots", _SNAPSHOTS)
def snk13(spark, sf_dir):
    where = shared_dir(spark, "snapshots")
    found = findings(spark, sf_dir)
    sinks.save_snapshot(R.severity_filter(found, "critical"), where, "2024-01-02T00:00:00Z")
    sinks.save_snapshot(found, where, "2024-01-01T00:00:00Z")
    return sinks.load_snapshots(spark, where).select("timestamp", "score", "findings_count")


@catalog.add("snk14_pr_comment", f"{W} SELECT s AS severity, (SELECT count(*) FROM findings WHERE severity = s) AS n FROM (VALUES ('critical'), ('warning'), ('info'), ('hint')) v(s) UNION ALL SELECT 'total', count(*) FROM findings")
def snk14(spark, sf_dir):
    return P.zero_filled(findings(spark, sf_dir))


_PACKS = ", ".join(f"('{n}', '{a}', '{b}')" for n, pack in RULE_PACKS.items() for a, b in pack["rules"])


@catalog.add("act04_rule_packs", f"SELECT n_name, pack, package FROM nation, (VALUES {_PACKS}) v(pack, package, other) WHERE other = 'cmd' GROUP BY ALL")
def act04(spark, sf_dir):
    rows = [(n, a, b) for n, pack in RULE_PACKS.items() for a, b in pack["rules"]]
    packs = spark.createDataFrame(rows, "pack string, package string, other string").dropDuplicates()
    return table(spark, sf_dir, "nation", "n_name").crossJoin(F.broadcast(packs.where("other = 'cmd'"))).select("n_name", "pack", "package")
