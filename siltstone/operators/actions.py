"""What could be done about findings; plans only, nothing is edited."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import scalar as S
from siltstone.schema import FINDING_COLUMNS


def fix_plan(findings: DataFrame) -> DataFrame:
    """(file, line, rule_id, symbol, change, safe) of findings that something can be done about."""
    a = F.col("analyzer")
    change = (
        F.when(a == "deadcode", "remove").when(a == "unused-deps", "remove-import").when(a == "naming", "unexport").when(F.col("severity").isin("critical", "warning"), "add-suppression")
    )
    rows = findings.select("file", "line", "rule_id", S.extract_symbol(F.col("message")).alias("symbol"), change.alias("change")).where("change IS NOT NULL")
    return rows.withColumn("safe", F.col("change").isin("remove", "add-suppression"))


def fix_preview(findings: DataFrame, analyzer: str | None = None) -> DataFrame:
    """Findings with a suggestion, of one analyzer if it is named."""
    rows = findings.where(F.coalesce("suggestion", F.lit("")) != "")
    return (rows.where(F.col("analyzer") == analyzer) if analyzer else rows).select(*FINDING_COLUMNS)
