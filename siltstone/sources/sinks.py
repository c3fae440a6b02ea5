"""Report formats as rows; a document is put together from them only when it is written."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import scalar as S
from siltstone.operators import relational as R
from siltstone.operators import reports as P
from siltstone.schema import FINDING_COLUMNS, SEVERITIES


def json_rows(findings: DataFrame) -> DataFrame:
    """(json) of each finding; empty and zero fields are left out."""
    present = [F.when((F.col(c) != "") if t == "string" else (F.col(c) != 0), F.col(c)).alias(c) for c, t in findings.select(*FINDING_COLUMNS).dtypes]
    return findings.select(F.to_json(F.struct(*present)).alias("json"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """One result object of the 2.1.0 format for each finding."""
    location = F.struct(
        F.struct(
            F.struct(F.col("file").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine")).alias("region")
        ).alias("physicalLocation")
    )
    return findings.select(F.col("rule_id").alias("ruleId"), S.sarif_level(F.col("severity")).alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(location).alias("locations"))


def codeclimate_issues(findings: DataFrame) -> DataFrame:
    location = F.struct(F.col("file").alias("path"), F.struct(F.col("line").alias("begin")).alias("lines"))
    return findings.select(
        F.lit("issue").alias("type"), F.col("rule_id").alias("check_name"), F.col("message").alias("description"), F.array(F.col("category")).alias("categories"),
        S.codeclimate_severity(F.col("severity")).alias("severity"), S.fingerprint(F.col("file"), F.col("line"), F.col("rule_id")).alias("fingerprint"), location.alias("location"),
    )


def compact_lines(findings: DataFrame) -> DataFrame:
    """(file, line, row): a line for each finding and, last, one with the totals."""
    where = F.concat(F.col("file"), F.lit(":"), F.col("line").cast("string"))
    rows = findings.select("file", "line", F.concat_ws("|", F.upper("severity"), "analyzer", where, "rule_id", "message").alias("row"))
    n = findings.agg(F.count("*").alias("total"), *P.severity_counts())
    text = [F.lit("TOTAL"), F.col("total").cast("string")]
    for s in SEVERITIES:
        text += [F.lit(s), F.col(s).cast("string")]
    total = n.select(F.lit(None).cast("string").alias("file"), F.lit(None).cast("int").alias("line"), F.concat_ws(" ", *text).alias("row"))
    return rows.unionByName(total)


def grouped_blocks(findings: DataFrame) -> DataFrame:
    """(file, n, block): the findings of each file by line."""
    text = F.concat(F.lit("["), "category", F.lit("] "), "message")
    rows = F.sort_array(F.collect_list(F.struct("line", "rule_id", "message", text.alias("text"))))
    return findings.groupBy("file").agg(F.count("*").alias("n"), F.array_join(F.transform(rows, lambda r: r["text"]), "\n").alias("block"))


def text_blocks(findings: DataFrame) -> DataFrame:
    """(file, n, block): as :func:`grouped_blocks`, with icons, lines and suggestions."""
    hint = F.when(F.col("suggestion") != "", F.concat(F.lit("\n      -> "), "suggestion")).otherwise("")
    text = F.concat(F.lit("  "), S.icon(F.col("severity")), F.lit(" "), F.col("line").cast("string"), F.lit(" "), "message", hint)
    rows = F.sort_array(F.collect_list(F.struct("line", "rule_id", "message", text.alias("text"))))
    return findings.groupBy("file").agg(F.count("*").alias("n"), F.array_join(F.transform(rows, lambda r: r["text"]), "\n").alias("block"))


def pr_decision(findings: DataFrame, least: int = 70) -> DataFrame:
    """One row: score, the gates, and failure, neutral (there are warnings) or success."""
    n = findings.agg(F.count_if(F.col("severity") == "critical").alias("c"), F.count_if(F.col("severity") == "warning").alias("w"), F.coalesce(F.sum(S.severity_weight(F.col("severity"))), F.lit(0)).alias("p"))
    n = n.withColumn("score", F.greatest(F.lit(0), 100 - F.col("p")).cast("long"))
    decision = F.when((F.col("c") > 0) | (F.col("score") < least), "failure").when(F.col("w") > 0, "neutral").otherwise("success")
    return n.select("score", (F.col("c") == 0).alias("no_critical"), (F.col("score") >= least).alias("healthy"), decision.alias("decision"))


def impact_counts(findings: DataFrame) -> DataFrame:
    return findings.agg(F.count("*").alias("findings"), *P.severity_counts(), F.countDistinct("file").alias("files"), F.countDistinct("category").alias("categories"))


def lsp_diagnostics(findings: DataFrame, open_files: DataFrame) -> DataFrame:
    """(file, diagnostics) with positions from 0; an empty list for open files without a finding."""
    line = F.greatest(F.col("line") - 1, F.lit(0)).cast("int")
    end = F.greatest(R.end_of(F.col("line"), F.col("end_line")) - 1, F.lit(0)).cast("int")
    row = F.struct(line.alias("line"), end.alias("end_line"), S.lsp_severity(F.col("severity")).alias("severity"), F.col("rule_id").alias("code"), F.col("message").alias("message"))
    per = findings.groupBy("file").agg(F.sort_array(F.collect_list(row)).alias("diagnostics"))
    joined = open_files.select("file").distinct().join(per, "file", "full_outer")
    return joined.select("file", F.coalesce("diagnostics", F.expr("CAST(array() AS array<struct<line:int,end_line:int,severity:int,code:string,message:string>>)")).alias("diagnostics"))


def markdown(findings: DataFrame) -> DataFrame:
    """(section, key, n): the tables of a Markdown report."""
    return P.summary(findings).select(F.col("dimension").alias("section"), F.col("value").alias("key"), "n")


def write_lines(rows: DataFrame, path: str) -> None:
    """A one-column table as text files."""
    rows.write.mode("overwrite").text(path)


def write_json(findings: DataFrame, path: str) -> None:
    """Findings as JSON lines; an empty table writes an empty folder."""
    write_lines(json_rows(findings), path)


def save_baseline(findings: DataFrame, path: str) -> None:
    """The keys of a baseline, as JSON lines."""
    findings.select(*R.BASELINE_KEYS, "severity", "category", "message").write.mode("overwrite").json(path)


def load_baseline(spark, path: str) -> DataFrame:
    """A stored baseline; empty where there is none."""
    schema = "file string, line int, rule_id string, analyzer string, severity string, category string, message string"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def save_snapshot(findings: DataFrame, path: str, timestamp: str) -> None:
    """Appends (timestamp, score, grade, findings) of now."""
    h = P.health(findings).crossJoin(findings.agg(F.count("*").alias("findings_count")))
    h.select(F.lit(timestamp).alias("timestamp"), "score", "grade", "findings_count").coalesce(1).write.mode("append").json(path)


def load_snapshots(spark, path: str) -> DataFrame:
    """All snapshots of a folder by time; malformed ones are left out."""
    schema = "timestamp string, score long, grade string, findings_count long"
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).where("timestamp IS NOT NULL").orderBy("timestamp")


def pr_comment(findings: DataFrame) -> str:
    """A comment in Markdown of the decision, the counts and the first ten findings."""
    d = pr_decision(findings).first()
    counts = {r["severity"]: r["n"] for r in P.zero_filled(findings).collect()}
    top = R.top_k(findings, 10, S.severity_rank(F.col("severity")), "file", "line", "rule_id", "message").collect()
    lines = [f"### Code health: {d['score']} ({d['decision']})", "", "| severity | findings |", "|---|---|"]
    lines += [f"| {s} | {n} |" for s, n in counts.items()]
    lines += ["", *(f"- **{r['severity']}** `{r['file']}:{r['line']}` {r['message']}" for r in top)]
    return "\n".join(lines)


def report(findings: DataFrame, tool: str = "siltstone") -> str:
    """A whole report as one JSON document, for a bounded number of findings; use the row formats for more."""
    rows = [json.loads(r["json"]) for r in json_rows(R.ordered_findings(findings)).collect()]
    h = P.health(findings).first()
    summary: dict = {}
    for r in P.summary(findings).collect():
        summary.setdefault(r["dimension"], {})[r["value"]] = r["n"]
    return json.dumps({"tool": tool, "findings": rows, "summary": summary, "healthScore": {"score": h["score"], "grade": h["grade"]}}, indent=2)


FORMATS = {
    "json": json_rows, "sarif": sarif_results, "codeclimate": codeclimate_issues, "compact": compact_lines, "grouped": grouped_blocks, "text": text_blocks,
    "markdown": markdown, "pr-decision": pr_decision, "impact": impact_counts, "next-steps": P.next_steps,
    "pr-summary": lambda f: R.top_k(f, 10, S.severity_rank(F.col("severity")), "file", "line", "rule_id", "message"),
}


def formatted(findings: DataFrame, kind: str) -> DataFrame:
    """The rows of a report format."""
    if kind not in FORMATS:
        raise ValueError(f"format must be one of {sorted(FORMATS)}")
    return FORMATS[kind](findings)
