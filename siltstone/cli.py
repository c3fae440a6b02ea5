"""Commands: ``python -m siltstone.cli COMMAND ...``; each prints rows or a document of one plan."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone import config as C
from siltstone.operators import actions, graph
from siltstone.operators import relational as R
from siltstone.operators import reports as P
from siltstone.plans import analyze as engine
from siltstone.sources import sinks
from siltstone.sources import text as T


def session() -> SparkSession:
    return SparkSession.builder.appName("siltstone").config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def settings(a: argparse.Namespace) -> C.Config:
    """File settings, then those of the command line."""
    where = None if a.no_config else a.config or C.find(a.path)
    c = C.Config()
    if where:
        with open(where, encoding="utf-8") as f:
            c = C.from_text(f.read())
    if a.rule_pack:
        c = C.with_pack(c, a.rule_pack)
    if a.analyzers:
        c = replace(c, enabled=tuple(a.analyzers.split(",")))
    if a.severity:
        c = replace(c, min_severity=C.severity(a.severity))
    return c


def rows_text(df: DataFrame) -> str:
    """Tab-separated rows of a report, which is bounded by what a terminal is for."""
    return "\n".join(["\t".join(df.columns), *("\t".join("" if x is None else str(x) for x in r) for r in df.toLocalIterator())])


def _found(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return engine.run(spark, a.path, settings(a), sinks.load_baseline(spark, a.baseline) if a.baseline else None)


def _analyze(spark, a):
    found = _found(spark, a)
    text = sinks.report(found) if a.format == "report" else rows_text(sinks.formatted(found, a.format))
    return text, int(not found.where("severity = 'critical'").isEmpty())


def _changed(spark, a) -> DataFrame:
    return spark.createDataFrame([(x,) for x in a.changed.split(",") if x], "file string")


def _audit(spark, a):
    v = R.verdict(R.attribute(_found(spark, a), _changed(spark, a)))
    return rows_text(v), int(v.first()["verdict"] == "fail")


def _regression(spark, a):
    c = settings(a)
    r = P.regression(engine.run(spark, a.path, c), sinks.load_baseline(spark, a.baseline), a.tolerance)
    return rows_text(r), int(r.where("outcome = 'fail'").count() > 0)


def _baseline(spark, a):
    sinks.save_baseline(engine.run(spark, a.path, settings(a)), a.baseline)
    return "saved", 0


def _snapshot(spark, a):
    import datetime

    sinks.save_snapshot(_found(spark, a), a.snapshots, datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ"))
    return "saved", 0


def _trends(spark, a):
    s = sinks.load_snapshots(spark, a.snapshots).withColumnRenamed("timestamp", "ts")
    return rows_text(P.trend(s).crossJoin(P.sparkline(s))), 0


def _trace(spark, a):
    nodes, edges = engine.call_graph(engine.load(spark, a.path))
    start = graph.lookup(nodes, a.symbol).select("fn")
    return rows_text(graph.paths(edges, start, a.max_depth, backward=a.direction == "callers").select(F.array_join("path", " -> ").alias("path"))), 0


def _explain(spark, a):
    nodes, edges = engine.call_graph(engine.load(spark, a.path))
    hit = graph.lookup(nodes, a.symbol)
    joined = hit.select("fn", "name", "pkg").join(graph.status(nodes, edges), "fn").join(graph.callers(nodes, edges), "fn", "left")
    return rows_text(joined), 0


def _impact(spark, a):
    f = engine.load(spark, a.path)
    edges = f.imports().select(F.col("src_pkg").alias("src"), F.col("dst_pkg").alias("dst"))
    packages = f.found.select(F.col("folder").alias("pkg"), "file")
    hit = R.changed_packages(packages, _changed(spark, a)).select("pkg").distinct()
    return rows_text(graph.impact_report(packages.select("pkg").distinct(), edges, hit)), 0


def _owners(spark, a):
    lines = T.ownership(T.read_lines(spark, a.path, "CODEOWNERS")).orderBy("rule_idx").collect()
    return rows_text(R.by_owner(_found(spark, a), [("!" * r.is_negation + r.pattern, list(r.owners)) for r in lines])), 0


def _public_api(spark, a):
    own, uses = engine.exported_symbols(engine.load(spark, a.path))
    return rows_text(P.public_api(own.select("symbol", "owner_pkg").distinct(), uses)), 0


def _guard(spark, a):
    f, c = engine.load(spark, a.path), settings(a)
    rules = spark.createDataFrame(list(c.rules), "package string, must_not_use string")
    return rows_text(R.guard_report(f.found.select(F.col("folder").alias("pkg")).distinct(), f.imports(), rules)), 0


def _vital_signs(spark, a):
    return rows_text(P.vital_signs(_found(spark, a), engine.load(spark, a.path).of("funcs"))), 0


def _of_findings(make: Callable[[DataFrame], DataFrame]):
    return lambda spark, a: (rows_text(make(_found(spark, a))), 0)


def _inspect(spark, a):
    return rows_text(R.for_target(_found(spark, a), a.symbol)), 0


COMMANDS: dict[str, Callable] = {
    "analyze": _analyze, "audit": _audit, "regression": _regression, "baseline": _baseline, "snapshot": _snapshot, "trends": _trends, "trace": _trace, "explain": _explain,
    "impact": _impact, "owners": _owners, "public-api": _public_api, "guard": _guard, "vital-signs": _vital_signs, "inspect": _inspect, "health": _of_findings(P.health), "file-scores": _of_findings(P.file_scores),
    "xref": _of_findings(R.overlaps), "targets": _of_findings(P.targets), "walkthrough": _of_findings(P.walkthrough), "fix": _of_findings(actions.fix_plan),
    "pr-comment": lambda spark, a: (sinks.pr_comment(_found(spark, a)), 0), "list": lambda spark, a: ("\n".join(engine.ANALYZERS), 0),
    "rule-packs": lambda spark, a: ("\n".join(C.RULE_PACKS), 0),
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="siltstone")
    p.add_argument("command", choices=sorted(COMMANDS))
    p.add_argument("path", nargs="?", default=".")
    p.add_argument("--format", default="compact", choices=[*sinks.FORMATS, "report"])
    p.add_argument("--config")
    p.add_argument("--no-config", action="store_true")
    p.add_argument("--analyzers", default="")
    p.add_argument("--severity")
    p.add_argument("--rule-pack")
    p.add_argument("--baseline", default="")
    p.add_argument("--snapshots", default="snapshots")
    p.add_argument("--changed", default="", help="changed files, with commas between")
    p.add_argument("--symbol", default="")
    p.add_argument("--max-depth", type=int, default=10)
    p.add_argument("--direction", default="callers", choices=["callers", "callees"])
    p.add_argument("--tolerance", type=int, default=0)
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    text, code = COMMANDS[a.command](spark or session(), a)
    print(text)
    return code


if __name__ == "__main__":
    sys.exit(main())
