"""Queries over findings: filters, joins, scores, rankings and report rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import scalar as S
from siltstone.operators import relational as R
from siltstone.operators import reports as P
from siltstone.plans.scalars import _COMPLEXITY_SQL
from siltstone.schema import OVERLAP_KINDS, Catalog
from siltstone.sources import sinks
from siltstone.sources.tables import FINDINGS_SQL, OWNERS, findings, table

catalog = Catalog()
W = f"WITH {FINDINGS_SQL}"
_ROW = "analyzer, severity, file, line, rule_id"
_cols = ["analyzer", "severity", "file", "line", "rule_id"]
_GRADE = "CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' WHEN score >= 50 THEN 'E' ELSE 'F' END AS grade"


def baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the sources that were analysed before: all but French ones."""
    return findings(spark, sf_dir).where(~F.col("file").contains("/fr/"))


_BASE = "baseline AS (SELECT * FROM findings WHERE NOT contains(file, '/fr/'))"


def changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with a toxic document are the changed ones."""
    return findings(spark, sf_dir).where("rule_id = 'DC001'").select("file").distinct()


_CHANGED = "changed AS (SELECT DISTINCT file FROM findings WHERE rule_id = 'DC001')"


def suppressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directives made of documents: an English one hides naming below it, a long one all of its file."""
    d = findings(spark, sf_dir)
    ignore = d.where("rule_id = 'NM001' AND file LIKE '%/en/%'").select("file", F.col("line").alias("decl_line"), F.lit("ignore").alias("type"), F.col("analyzer"))
    whole = d.where("rule_id = 'LF001' AND severity = 'critical'").select("file", F.lit(0).alias("decl_line"), F.lit("ignore-all").alias("type"), F.lit("").alias("analyzer"))
    keep = d.where("rule_id = 'DP001'").select("file", F.col("line").alias("decl_line"), F.lit("keep").alias("type"), F.lit("deadcode").alias("analyzer"))
    return ignore.unionByName(whole).unionByName(keep)


_SUPPRESS = """suppressions AS (
  SELECT file, line AS decl_line, 'ignore' AS type, analyzer FROM findings WHERE rule_id = 'NM001' AND contains(file, '/en/')
  UNION ALL SELECT file, 0, 'ignore-all', '' FROM findings WHERE rule_id = 'LF001' AND severity = 'critical'
  UNION ALL SELECT file, line, 'keep', 'deadcode' FROM findings WHERE rule_id = 'DP001')"""


@catalog.add("flt01_severity_filter", f"{W} SELECT {_ROW} FROM ranked WHERE rank <= 1")
def flt01(spark, sf_dir):
    return R.severity_filter(findings(spark, sf_dir), "warning").select(*_cols)


@catalog.add("flt02_analyzer_select", f"{W} SELECT {_ROW} FROM findings WHERE analyzer IN ('security', 'duplication')")
def flt02(spark, sf_dir):
    return R.select_analyzers(findings(spark, sf_dir), ["security", "duplication", "no-such"]).select(*_cols)


@catalog.add("flt03_suppress_filter", f"{W}, {_SUPPRESS} SELECT {_ROW} FROM findings f WHERE NOT EXISTS (SELECT 1 FROM suppressions s WHERE s.file = f.file AND (s.type = 'ignore-all' OR (f.line >= s.decl_line - 1 AND s.analyzer IN ('*', f.analyzer))))")
def flt03(spark, sf_dir):
    return R.not_suppressed(findings(spark, sf_dir), suppressions(spark, sf_dir)).select(*_cols)


@catalog.add("flt04_stale_suppressions", f"{W}, {_SUPPRESS} SELECT file, decl_line, type, analyzer FROM suppressions s WHERE NOT EXISTS (SELECT 1 FROM findings f WHERE s.file = f.file AND (s.type = 'ignore-all' OR (s.type = 'keep' AND f.analyzer IN ('deadcode', 'unused') AND f.line >= s.decl_line - 1) OR (s.type = 'ignore' AND f.analyzer = s.analyzer AND f.line >= s.decl_line - 1)))")
def flt04(spark, sf_dir):
    return R.stale_suppressions(suppressions(spark, sf_dir), findings(spark, sf_dir))


@catalog.add("flt05_glob_match", f"{W} SELECT {_ROW} FROM findings WHERE regexp_matches(file, '^src/.*/f1[^/]*[.]go$')")
def flt05(spark, sf_dir):
    return findings(spark, sf_dir).where(S.glob_match(F.col("file"), "src/**/f1*.go")).select(*_cols)


@catalog.add("flt06_pkg_has_suffix", f"{W} SELECT {_ROW} FROM findings WHERE regexp_extract(file, '^(.*)/[^/]*$', 1) LIKE '%/src1/fr'")
def flt06(spark, sf_dir):
    package = F.regexp_extract("file", "^(.*)/[^/]*$", 1)
    return findings(spark, sf_dir).where(S.has_suffix(package, F.lit("src1/fr"))).select(*_cols)


_SUFFIX_SQL = "CASE analyzer WHEN 'naming' THEN '_test.go' WHEN 'duplication' THEN '.md' WHEN 'complexity' THEN '_linux.go' ELSE '.go' END"


def _sources(spark, sf_dir):
    ending = S.choose(F.col("analyzer"), {"naming": "_test.go", "duplication": ".md", "complexity": "_linux.go"}, ".go")
    return findings(spark, sf_dir).select(F.concat(F.regexp_replace("file", "[.]go$", ""), ending).alias("path")).distinct()


@catalog.add("flt07_non_source_file", f"{W} SELECT DISTINCT regexp_replace(file, '[.]go$', '') || {_SUFFIX_SQL} AS path FROM findings WHERE analyzer NOT IN ('naming', 'duplication')")
def flt07(spark, sf_dir):
    from siltstone.sources.text import is_source_path

    return _sources(spark, sf_dir).where(is_source_path(F.col("path")))


@catalog.add("flt08_should_check_file", f"{W} SELECT DISTINCT regexp_replace(file, '[.]go$', '') || {_SUFFIX_SQL} AS path FROM findings WHERE analyzer NOT IN ('naming', 'duplication', 'complexity')")
def flt08(spark, sf_dir):
    from siltstone.sources.text import is_portable_path

    return _sources(spark, sf_dir).where(is_portable_path(F.col("path")))


@catalog.add("flt09_filter_by_target", f"{W} SELECT {_ROW} FROM findings WHERE file = 'd12' OR file LIKE '%/d12' OR contains(message, 'd12') OR contains(detail, 'd12')")
def flt09(spark, sf_dir):
    return R.for_target(findings(spark, sf_dir), "d12").select(*_cols)


@catalog.add("flt10_changed_files_filter", f"{W}, {_CHANGED} SELECT {_ROW} FROM findings SEMI JOIN changed USING (file)")
def flt10(spark, sf_dir):
    return R.in_changed(findings(spark, sf_dir), changed(spark, sf_dir)).select(*_cols)


@catalog.add("jon01_baseline_diff", f"{W}, {_BASE} SELECT {_ROW} FROM findings f WHERE NOT EXISTS (SELECT 1 FROM baseline b WHERE b.file = f.file AND b.line = f.line AND b.rule_id = f.rule_id AND b.analyzer = f.analyzer)")
def jon01(spark, sf_dir):
    return R.baseline_diff(findings(spark, sf_dir), baseline(spark, sf_dir)).select(*_cols)


_KINDS = ", ".join(f"('{a}', '{b}', '{k}')" for a, b, k in OVERLAP_KINDS)


@catalog.add("jon02_xref_overlap", f"{W} SELECT k.kind, a.file, a.line, a.rule_id AS first_rule, b.rule_id AS second_rule, b.line AS second_line FROM findings a JOIN findings b USING (file) JOIN (VALUES {_KINDS}) k(x, y, kind) ON a.analyzer = k.x AND b.analyzer = k.y WHERE a.line <= b.end_line AND a.end_line >= b.line")
def jon02(spark, sf_dir):
    return R.overlaps(findings(spark, sf_dir))


_ATTR = "CASE WHEN file IN (SELECT file FROM changed) THEN 'introduced' ELSE 'pre-existing' END AS attribution"


@catalog.add("jon03_audit_attribution", f"{W}, {_CHANGED} SELECT {_ROW}, {_ATTR} FROM findings")
def jon03(spark, sf_dir):
    return R.attribute(findings(spark, sf_dir), changed(spark, sf_dir)).select(*_cols, "attribution")


@catalog.add("jon04_audit_verdict", f"{W}, {_CHANGED}, a AS (SELECT severity, {_ATTR} FROM findings) SELECT count(*) FILTER (attribution = 'introduced') AS introduced, count(*) FILTER (attribution <> 'introduced') AS pre_existing, CASE WHEN count(*) FILTER (attribution = 'introduced' AND severity = 'critical') > 0 THEN 'fail' WHEN count(*) FILTER (attribution = 'introduced' AND severity = 'warning') > 0 THEN 'warn' ELSE 'pass' END AS verdict FROM a")
def jon04(spark, sf_dir):
    return R.verdict(R.attribute(findings(spark, sf_dir), changed(spark, sf_dir)))


_OWNER_CASE = """CASE WHEN starts_with(file, 'src/src4/de') THEN 6 WHEN regexp_matches(file, '^src/[^/]*/fr/[^/]*$') THEN 5 WHEN starts_with(file, 'src/src3') THEN 4
  WHEN starts_with(file, 'src/src2') THEN 3 ELSE 2 END"""
_OWNER_NAMES = "['@all', '@one,@two', '@code', '@two', '', '@fr', '@four,@de']"


@catalog.add("jon05_owners_last_match", f"{W} SELECT DISTINCT file, {_OWNER_CASE} AS rule_idx, {_OWNER_NAMES}[{_OWNER_CASE} + 1] AS owners FROM findings")
def jon05(spark, sf_dir):
    return R.last_match(findings(spark, sf_dir), OWNERS).select("file", "rule_idx", F.array_join("owners", ",").alias("owners"))


@catalog.add("jon06_owners_group", f"{W}, o AS (SELECT file, count(*) AS n, {_OWNER_NAMES}[{_OWNER_CASE} + 1] AS owners FROM findings GROUP BY ALL), e AS (SELECT unnest(string_split(CASE WHEN owners = '' THEN '(unowned)' ELSE owners END, ',')) AS owner, n FROM o) SELECT owner, CAST(sum(n) AS BIGINT) AS findings, count(*) AS files FROM e GROUP BY owner")
def jon06(spark, sf_dir):
    return R.by_owner(findings(spark, sf_dir), OWNERS)


@catalog.add("jon11_inspect_file", f"{W} SELECT file, count(*) AS findings, CAST(greatest(0, 100 - sum(weight)) AS BIGINT) AS score, max({_OWNER_NAMES}[{_OWNER_CASE} + 1]) AS owners FROM ranked GROUP BY file")
def jon11(spark, sf_dir):
    f = findings(spark, sf_dir)
    owned = R.last_match(f, OWNERS).select(F.col("file").alias("o"), F.array_join("owners", ",").alias("owners"))
    return P.file_scores(f).select("file", "findings", "score").join(owned, F.col("file") == F.col("o")).drop("o")


@catalog.add("jon12_hover_lookup", f"{W} SELECT {_ROW} FROM findings WHERE file = 'src/src7/en/f0.go' AND line <= 40 AND end_line >= 40")
def jon12(spark, sf_dir):
    return R.at_line(findings(spark, sf_dir), "src/src7/en/f0.go", 40).select(*_cols)


_SUMMARY = f"""{W} SELECT 'severity' AS dimension, severity AS value, count(*) AS n FROM findings GROUP BY severity UNION ALL SELECT 'analyzer', analyzer, count(*) FROM findings GROUP BY analyzer
UNION ALL SELECT 'category', category, count(*) FROM findings GROUP BY category UNION ALL SELECT 'total', '', count(*) FROM findings"""


@catalog.add("agg01_summary_counts", _SUMMARY)
@catalog.add("agg15_mcp_impact_counts", _SUMMARY)
def agg01(spark, sf_dir):
    return P.summary(findings(spark, sf_dir))


@catalog.add("agg02_penalty", f"{W} SELECT CAST(coalesce(sum(weight), 0) AS BIGINT) AS penalty FROM ranked")
def agg02(spark, sf_dir):
    return P.penalty(findings(spark, sf_dir))


@catalog.add("agg03_health_score", f"{W}, p AS (SELECT category, count(*) AS findings, CAST(sum(weight) AS BIGINT) AS penalty FROM ranked GROUP BY category), s AS (SELECT *, greatest(0, 100 - penalty) AS score FROM p) SELECT *, {_GRADE} FROM s")
def agg03(spark, sf_dir):
    return P.health_by_category(findings(spark, sf_dir))


@catalog.add("agg03_health_total", f"{W}, p AS (SELECT CAST(sum(weight) AS BIGINT) AS penalty FROM ranked), s AS (SELECT *, greatest(0, 100 - penalty) AS score FROM p) SELECT *, {_GRADE} FROM s")
def agg03_total(spark, sf_dir):
    return P.health(findings(spark, sf_dir))


_BY_CATEGORY = ", ".join(f"CAST(coalesce(sum(weight) FILTER (category = '{c}'), 0) AS BIGINT) AS penalty_{c.replace('-', '_')}" for c in ("dead-code", "unused", "complexity", "duplication", "dependencies", "architecture", "code-smell"))
_BY_SEVERITY = ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in ("critical", "warning", "info", "hint"))


@catalog.add("agg04_file_scores", f"{W}, p AS (SELECT file, count(*) AS findings, {_BY_SEVERITY}, {_BY_CATEGORY}, CAST(greatest(0, 100 - sum(weight)) AS BIGINT) AS score FROM ranked GROUP BY file) SELECT *, {_GRADE} FROM p")
def agg04(spark, sf_dir):
    return P.file_scores(findings(spark, sf_dir))


@catalog.add(
    "agg05_vital_signs",
    f"""{W}, c AS (SELECT *, CASE WHEN category = 'complexity' THEN {_COMPLEXITY_SQL} END AS cx FROM ranked), p AS (SELECT count(*) AS findings, {_BY_SEVERITY}, CAST(coalesce(sum(weight), 0) AS BIGINT) AS penalty,
    count(*) FILTER (category = 'dead-code') AS dead_code, count(*) FILTER (category = 'duplication') AS duplication, count(*) FILTER (category = 'unused') AS unused,
    coalesce(round(avg(cx) FILTER (cx > 0), 6), 0.0) AS avg_complexity, CAST(coalesce(max(cx), 0) AS BIGINT) AS max_complexity, (SELECT greatest(count(*), 1) FROM documents) AS functions FROM c),
    s AS (SELECT *, CAST(greatest(0, 100 - floor(sqrt(penalty * 100.0 / functions) * 10)) AS BIGINT) AS score FROM p) SELECT *, {_GRADE} FROM s""",
)
def agg05(spark, sf_dir):
    return P.vital_signs(findings(spark, sf_dir), table(spark, sf_dir, "documents", "doc_id"))


@catalog.add("agg06_extract_complexity", f"{W} SELECT file, line, {_COMPLEXITY_SQL} AS complexity FROM findings WHERE category = 'complexity'")
def agg06(spark, sf_dir):
    return findings(spark, sf_dir).where("category = 'complexity'").select("file", "line", S.complexity_of(F.col("detail"), F.col("message")).cast("long").alias("complexity"))


@catalog.add(
    "agg07_refactoring_targets",
    f"""{W}, c AS (SELECT *, CASE WHEN category = 'complexity' THEN {_COMPLEXITY_SQL} END AS cx FROM ranked), g AS (SELECT file, category, sum(weight) AS w FROM c GROUP BY ALL),
    lead AS (SELECT file, category FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY w DESC, category) AS k FROM g) WHERE k = 1),
    p AS (SELECT file, CAST(greatest(0, 100 - sum(weight)) AS BIGINT) AS score, sum(weight) AS penalty, count(*) FILTER (severity = 'critical') AS c, count(*) FILTER (severity = 'warning') AS w, count(*) AS n FROM c GROUP BY file)
    SELECT file, score, category, CASE category WHEN 'dead-code' THEN 'S' WHEN 'complexity' THEN 'L' ELSE 'M' END AS effort, CASE WHEN c > 0 OR w >= 3 THEN 'high' WHEN w > 0 OR n >= 5 THEN 'medium' ELSE 'low' END AS confidence
    FROM p JOIN lead USING (file) ORDER BY score, penalty DESC, file LIMIT 20""",
)
def agg07(spark, sf_dir):
    return P.targets(findings(spark, sf_dir)).select("file", "score", "category", "effort", "confidence")


@catalog.add(
    "agg08_regression",
    f"""{W}, {_BASE}, c AS (SELECT category, count(*) AS n FROM findings GROUP BY 1), b AS (SELECT category, count(*) AS n FROM baseline GROUP BY 1),
    j AS (SELECT coalesce(c.category, b.category) AS category, coalesce(b.n, 0) AS baseline, coalesce(c.n, 0) AS current FROM c FULL JOIN b ON c.category = b.category)
    SELECT *, current - baseline AS delta, '' AS outcome FROM j WHERE current <> baseline
    UNION ALL SELECT 'all', CAST(sum(baseline) AS BIGINT), CAST(sum(current) AS BIGINT), CAST(sum(current) - sum(baseline) AS BIGINT), CASE WHEN sum(current) - sum(baseline) > 0 THEN 'fail' ELSE 'pass' END FROM j""",
)
def agg08(spark, sf_dir):
    return P.regression(findings(spark, sf_dir), baseline(spark, sf_dir))


def snapshots(spark, sf_dir):
    """A score for each day of events."""
    e = table(spark, sf_dir, "events", "ts", "value", "event_type")
    per = e.groupBy(F.to_date("ts").alias("day")).agg(F.count_if(F.col("event_type") == "click").alias("c"), F.count("*").alias("n"))
    return per.select(F.date_format("day", "yyyy-MM-dd").alias("ts"), F.floor(F.col("c") * 100 / F.col("n")).cast("long").alias("score"))


_SNAP = "snapshots AS (SELECT strftime(ts, '%Y-%m-%d') AS ts, CAST(floor(count(*) FILTER (event_type = 'click') * 100 / count(*)) AS BIGINT) AS score FROM events GROUP BY 1)"


@catalog.add("agg09_trends", f"WITH {_SNAP}, t AS (SELECT count(*) AS points, arg_min(score, ts) AS first_score, arg_max(score, ts) AS last_score FROM snapshots) SELECT *, CASE WHEN points >= 2 THEN last_score - first_score ELSE 0 END AS delta, CASE WHEN points < 2 OR abs(last_score - first_score) <= 5 THEN 'stable' WHEN last_score > first_score THEN 'improving' ELSE 'declining' END AS direction FROM t")
def agg09(spark, sf_dir):
    return P.trend(snapshots(spark, sf_dir))


@catalog.add("agg10_sparkline", f"WITH {_SNAP} SELECT string_agg(substr('▁▂▃▄▅▆▇█', CAST(greatest(0, least(7, floor(score * 8 / 101))) AS INTEGER) + 1, 1), '' ORDER BY ts) AS sparkline FROM snapshots")
def agg10(spark, sf_dir):
    return P.sparkline(snapshots(spark, sf_dir))


@catalog.add("agg11_timings", f"{W}, e AS (SELECT analyzer, CAST(count(DISTINCT file) AS BIGINT) AS elapsed_ms, count(*) AS findings FROM findings GROUP BY 1) SELECT *, row_number() OVER (ORDER BY elapsed_ms DESC, analyzer DESC) = 1 AS slowest FROM e")
def agg11(spark, sf_dir):
    f = findings(spark, sf_dir)
    # one millisecond a file stands for a measured time, so that the result is the same every time
    return P.timings(f, f.groupBy("analyzer").agg(F.countDistinct("file").alias("elapsed_ms")))


@catalog.add(
    "agg12_walkthrough",
    f"""{W}, m AS (SELECT CAST(sum(CASE severity WHEN 'critical' THEN 5 WHEN 'warning' THEN 2 ELSE 1 END) AS BIGINT) AS m FROM findings), s AS (
    SELECT 1 AS step, 'overview' AS title, count(*) AS findings FROM findings UNION ALL SELECT 2, 'critical', count(*) FROM findings WHERE severity = 'critical' UNION ALL SELECT 3, 'dead code', count(*) FROM findings WHERE analyzer = 'deadcode'
    UNION ALL SELECT 4, 'complexity', count(*) FROM findings WHERE category = 'complexity' UNION ALL SELECT 5, 'duplication', count(*) FROM findings WHERE category = 'duplication'
    UNION ALL SELECT 6, 'security', count(*) FROM findings WHERE analyzer = 'security' UNION ALL SELECT 7, 'next', count(*) FROM findings)
    SELECT step, title, findings, CASE WHEN m // 60 > 0 THEN (m // 60) || 'h ' || (m % 60) || 'm' ELSE m || 'm' END AS estimate FROM s, m WHERE findings > 0 OR step IN (1, 7)""",
)
def agg12(spark, sf_dir):
    return P.walkthrough(findings(spark, sf_dir))


@catalog.add("agg13_zero_filled", f"{W} SELECT s AS severity, (SELECT count(*) FROM findings WHERE severity = s) AS n FROM (VALUES ('critical'), ('warning'), ('info'), ('hint')) v(s) UNION ALL SELECT 'total', count(*) FROM findings")
def agg13(spark, sf_dir):
    return P.zero_filled(findings(spark, sf_dir))


@catalog.add("srt01_ordered_findings", f"{W} SELECT {_ROW}, message FROM findings")
def srt01(spark, sf_dir):
    return R.ordered_findings(findings(spark, sf_dir)).select(*_cols, "message")


@catalog.add("srt02_top_k", f"{W} SELECT {_ROW}, message FROM ranked ORDER BY rank, file, line, rule_id, message LIMIT 10")
@catalog.add("snk09_pr_summary", f"{W} SELECT {_ROW}, message FROM ranked ORDER BY rank, file, line, rule_id, message LIMIT 10")
def srt02(spark, sf_dir):
    return R.top_k(findings(spark, sf_dir), 10, S.severity_rank(F.col("severity")), "file", "line", "rule_id", "message").select(*_cols, "message")


@catalog.add("srt03_severity_order", f"{W} SELECT severity, rank, count(*) AS n FROM ranked GROUP BY ALL")
def srt03(spark, sf_dir):
    rank = S.severity_rank(F.col("severity"))
    return findings(spark, sf_dir).groupBy("severity", rank.alias("rank")).agg(F.count("*").alias("n")).orderBy("rank")


@catalog.add("set01_union_all", f"{W} SELECT {_ROW} FROM findings WHERE analyzer = 'security' UNION ALL SELECT {_ROW} FROM findings WHERE analyzer = 'naming'")
def set01(spark, sf_dir):
    f = findings(spark, sf_dir)
    return R.union_all([f.where("analyzer = 'security'"), f.where("analyzer = 'naming'")]).select(*_cols)


@catalog.add("set02_difference", f"{W} SELECT DISTINCT file FROM findings WHERE file NOT IN (SELECT file FROM findings WHERE severity = 'critical')")
def set02(spark, sf_dir):
    f = findings(spark, sf_dir)
    return R.difference(f.select("file"), f.where("severity = 'critical'"), "file")


@catalog.add("set03_union_distinct", f"{W} SELECT DISTINCT file FROM findings WHERE analyzer IN ('naming', 'duplication')")
def set03(spark, sf_dir):
    f = findings(spark, sf_dir)
    return R.union_distinct([f.where("analyzer = 'naming'"), f.where("analyzer = 'duplication'")], "file")


@catalog.add("win03_first_last", f"{W} SELECT DISTINCT file, first_value(rule_id) OVER w AS first, last_value(rule_id) OVER (PARTITION BY file ORDER BY line, rule_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last FROM findings WINDOW w AS (PARTITION BY file ORDER BY line, rule_id)")
def win03(spark, sf_dir):
    return P.first_last(findings(spark, sf_dir), "file", "line", "rule_id")


@catalog.add("win05_last_match_wins", f"{W} SELECT DISTINCT file, {_OWNER_CASE} AS rule_idx FROM findings")
def win05(spark, sf_dir):
    return R.last_match(findings(spark, sf_dir), OWNERS).select("file", "rule_idx")


@catalog.add("snk03_sarif", f"{W} SELECT rule_id, CASE severity WHEN 'critical' THEN 'error' WHEN 'warning' THEN 'warning' ELSE 'note' END AS level, file, line, message FROM findings")
def snk03(spark, sf_dir):
    r = sinks.sarif_results(findings(spark, sf_dir))
    return r.select("ruleId", "level", F.col("locations")[0]["physicalLocation"].alias("p"), "message.text").select(F.col("ruleId").alias("rule_id"), "level", F.col("p.artifactLocation.uri").alias("file"), F.col("p.region.startLine").alias("line"), F.col("text").alias("message"))


@catalog.add("snk04_codeclimate", f"{W} SELECT sha256(file || ':' || line || ':' || rule_id) AS fingerprint, CASE severity WHEN 'critical' THEN 'blocker' WHEN 'warning' THEN 'major' WHEN 'info' THEN 'minor' ELSE 'info' END AS severity, message AS description FROM findings")
def snk04(spark, sf_dir):
    return sinks.codeclimate_issues(findings(spark, sf_dir)).select("fingerprint", "severity", "description")


@catalog.add("snk05_compact", f"{W} SELECT upper(severity) || '|' || analyzer || '|' || file || ':' || line || '|' || rule_id || '|' || message AS row FROM findings UNION ALL SELECT 'TOTAL ' || count(*) || ' critical ' || count(*) FILTER (severity = 'critical') || ' warning ' || count(*) FILTER (severity = 'warning') || ' info ' || count(*) FILTER (severity = 'info') || ' hint ' || count(*) FILTER (severity = 'hint') FROM findings")
def snk05(spark, sf_dir):
    return sinks.compact_lines(findings(spark, sf_dir)).select("row")


@catalog.add("snk06_grouped", f"{W} SELECT file, count(*) AS n, string_agg('[' || category || '] ' || message, chr(10) ORDER BY line, rule_id, message) AS block FROM findings GROUP BY file")
def snk06(spark, sf_dir):
    return sinks.grouped_blocks(findings(spark, sf_dir))


@catalog.add("snk08_pr_decision", f"{W}, n AS (SELECT count(*) FILTER (severity = 'critical') AS c, count(*) FILTER (severity = 'warning') AS w, CAST(greatest(0, 100 - sum(weight)) AS BIGINT) AS score FROM ranked) SELECT score, c = 0 AS no_critical, score >= 70 AS healthy, CASE WHEN c > 0 OR score < 70 THEN 'failure' WHEN w > 0 THEN 'neutral' ELSE 'success' END AS decision FROM n")
def snk08(spark, sf_dir):
    return sinks.pr_decision(findings(spark, sf_dir))


@catalog.add("snk10_impact_counts", f"{W} SELECT count(*) AS findings, {_BY_SEVERITY}, count(DISTINCT file) AS files, count(DISTINCT category) AS categories FROM findings")
def snk10(spark, sf_dir):
    return sinks.impact_counts(findings(spark, sf_dir))


@catalog.add(
    "snk11_next_steps",
    f"""{W}, s AS (SELECT 1 AS o, 'remove unreachable functions' AS action, 'high' AS priority, count(*) AS n FROM findings WHERE category = 'dead-code' UNION ALL SELECT 2, 'refactor complex functions', 'high', count(*) FROM findings WHERE category = 'complexity'
    UNION ALL SELECT 3, 'extract copies', 'medium', count(*) FROM findings WHERE category = 'duplication' UNION ALL SELECT 4, 'tidy dependencies', 'medium', count(*) FROM findings WHERE category = 'dependencies'
    UNION ALL SELECT 0, 'review security', 'critical', count(*) FROM findings WHERE contains(lower(category || ' ' || message || ' ' || rule_id), 'security')
    UNION ALL SELECT 5, 'fix names', 'low', count(*) FROM findings WHERE contains(lower(category || ' ' || message || ' ' || rule_id), 'naming')) SELECT action, priority, n FROM s WHERE n > 0 ORDER BY o LIMIT 5""",
)
def snk11(spark, sf_dir):
    return P.next_steps(findings(spark, sf_dir))


@catalog.add("snk15_lsp_diagnostics", f"{W} SELECT file, count(*) AS n, CAST(min(line) - 1 AS INTEGER) AS first_line, min(rank) + 1 AS worst FROM ranked GROUP BY file")
def snk15(spark, sf_dir):
    d = sinks.lsp_diagnostics(findings(spark, sf_dir), findings(spark, sf_dir).select("file").distinct())
    return d.select("file", F.size("diagnostics").cast("long").alias("n"), F.array_min(F.transform("diagnostics", lambda x: x["line"])).alias("first_line"), F.array_min(F.transform("diagnostics", lambda x: x["severity"])).alias("worst"))


@catalog.add(
    "act01_fix_plan",
    f"""{W} SELECT file, line, rule_id, CASE WHEN analyzer = 'deadcode' THEN 'remove' WHEN analyzer = 'unused-deps' THEN 'remove-import' WHEN analyzer = 'naming' THEN 'unexport' ELSE 'add-suppression' END AS change,
    analyzer NOT IN ('unused-deps', 'naming') AS safe FROM findings WHERE analyzer IN ('deadcode', 'unused-deps', 'naming') OR severity IN ('critical', 'warning')""",
)
def act01(spark, sf_dir):
    from siltstone.operators.actions import fix_plan

    return fix_plan(findings(spark, sf_dir)).select("file", "line", "rule_id", "change", "safe")


@catalog.add("act03_fix_preview", f"{W} SELECT {_ROW}, suggestion FROM findings WHERE suggestion <> '' AND analyzer = 'duplication'")
def act03(spark, sf_dir):
    from siltstone.operators.actions import fix_preview

    return fix_preview(findings(spark, sf_dir), "duplication").select(*_cols, "suggestion")
