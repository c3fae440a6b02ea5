"""Aggregations of findings into scores, rankings and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siltstone.functions import scalar as S
from siltstone.schema import CATEGORIES, SEVERITIES

SEVERITY = F.col


def weighted(findings: DataFrame) -> DataFrame:
    return findings.withColumn("weight", S.severity_weight(F.col("severity")))


def severity_counts() -> list[Column]:
    return [F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES]


def summary(findings: DataFrame) -> DataFrame:
    """(dimension, value, n): findings in total, by severity, by analyzer and by category; one scan."""
    sets = findings.groupingSets([["severity"], ["analyzer"], ["category"], []], "severity", "analyzer", "category").agg(
        F.count("*").alias("n"), F.grouping("severity").alias("gs"), F.grouping("analyzer").alias("ga"), F.grouping("category").alias("gc")
    )
    dimension = F.when(F.col("gs") == 0, "severity").when(F.col("ga") == 0, "analyzer").when(F.col("gc") == 0, "category").otherwise("total")
    return sets.select(dimension.alias("dimension"), F.coalesce("severity", "analyzer", "category", F.lit("")).alias("value"), "n")


def penalty(findings: DataFrame) -> DataFrame:
    return findings.agg(F.coalesce(F.sum(S.severity_weight(F.col("severity"))), F.lit(0)).cast("long").alias("penalty"))


def health(findings: DataFrame) -> DataFrame:
    """One row: penalty, score = 100 - penalty but 0 at least, grade."""
    score = F.greatest(F.lit(0), 100 - F.col("penalty")).cast("long")
    return penalty(findings).select("penalty", score.alias("score"), S.grade_for(score).alias("grade"))


def health_by_category(findings: DataFrame) -> DataFrame:
    """(category, penalty, score, grade) of each category with findings: the flagship query."""
    each = findings.groupBy("category").agg(F.sum(S.severity_weight(F.col("severity"))).cast("long").alias("penalty"), F.count("*").alias("findings"))
    score = F.greatest(F.lit(0), 100 - F.col("penalty")).cast("long")
    return each.select("category", "findings", "penalty", score.alias("score"), S.grade_for(score).alias("grade"))


def file_scores(findings: DataFrame) -> DataFrame:
    """Per file with findings: their number, by severity, penalty by category, score and grade."""
    weight = S.severity_weight(F.col("severity"))
    per = findings.groupBy("file").agg(
        F.count("*").alias("findings"), *severity_counts(),
        *(F.sum(F.when(F.col("category") == c, weight).otherwise(0)).cast("long").alias(f"penalty_{c.replace('-', '_')}") for c in CATEGORIES),
        F.sum(weight).cast("long").alias("penalty"),
    )
    score = F.greatest(F.lit(0), 100 - F.col("penalty")).cast("long")
    return per.withColumn("score", score).withColumn("grade", S.grade_for(score)).drop("penalty")


def vital_signs(findings: DataFrame, functions: DataFrame) -> DataFrame:
    """One row: counts, complexity, and a score by penalty per hundred functions (``functions``: one row each)."""
    c = F.when(F.col("category") == "complexity", S.complexity_of(F.col("detail"), F.col("message")))
    one = findings.agg(
        F.count("*").alias("findings"), *severity_counts(), F.coalesce(F.sum(S.severity_weight(F.col("severity"))), F.lit(0)).cast("long").alias("penalty"),
        F.count_if(F.col("category") == "dead-code").alias("dead_code"), F.count_if(F.col("category") == "duplication").alias("duplication"),
        F.count_if(F.col("category") == "unused").alias("unused"),
        F.coalesce(F.round(F.avg(F.when(c > 0, c)), 6), F.lit(0.0)).alias("avg_complexity"), F.coalesce(F.max(c), F.lit(0)).cast("long").alias("max_complexity"),
    )
    n = functions.agg(F.greatest(F.count("*"), F.lit(1)).alias("functions"))
    scaled = F.floor(F.sqrt(F.col("penalty") * 100.0 / F.col("functions")) * 10)
    score = F.greatest(F.lit(0), 100 - scaled).cast("long")
    return one.crossJoin(n).withColumn("score", score).withColumn("grade", S.grade_for(score))


def targets(findings: DataFrame, k: int = 20) -> DataFrame:
    """The k files with the worst scores, and what to do with each.

    Category is the one with the most penalty, the first by name of equals.
    """
    weight = S.severity_weight(F.col("severity"))
    c = S.complexity_of(F.col("detail"), F.col("message"))
    own = findings.select("file", "category", "severity", "line", weight.alias("weight"), F.when(F.col("category") == "complexity", c).alias("complexity"), S.extract_between(F.col("message"), "function ", " ").alias("fn"))
    by_category = own.groupBy("file", "category").agg(
        F.sum("weight").alias("w"), F.count("*").alias("n"), F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") == "warning").alias("warning"),
        F.max(F.struct(F.col("complexity"), F.col("fn"))).alias("worst"), F.min(F.when(F.col("line") > 0, F.col("line"))).alias("line"),
    )
    of = lambda cat, x: F.coalesce(F.max(F.when(F.col("category") == cat, x)), F.lit(0))
    per = by_category.groupBy("file").agg(
        F.sum("w").alias("penalty"), F.sum("n").alias("findings"), F.sum("critical").alias("critical"), F.sum("warning").alias("warning"),
        F.min(F.struct((-F.col("w")).alias("w"), F.col("category"))).alias("lead"), of("dead-code", F.col("n")).alias("dead"), of("duplication", F.col("n")).alias("copies"),
        F.max(F.when(F.col("category") == "complexity", F.col("worst"))).alias("worst"), F.max(F.when(F.col("category") == "duplication", F.col("line"))).alias("line"),
    )
    score = F.greatest(F.lit(0), 100 - F.col("penalty")).cast("long")
    best = per.withColumn("score", score).orderBy("score", F.desc("penalty"), "file").limit(k)
    category = F.col("lead.category")
    fn, cx = F.coalesce("worst.fn", F.lit("")), F.coalesce("worst.complexity", F.lit(0))
    text = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    s = lambda name: F.col(name).cast("string")
    advice = (
        F.when(category == "dead-code", text("remove ", s("dead"), " functions"))
        .when((category == "complexity") & (fn != "") & (cx > 0), text("refactor ", fn, " (", cx.cast("string"), ")"))
        .when(category == "complexity", "simplify functions")
        .when(category == "duplication", text("extract the block at line ", s("line")))
        .otherwise(text("look at ", s("findings"), " findings"))
    )
    evidence = F.array_join(
        F.array_compact(
            F.array(
                F.when(F.col("critical") > 0, text(s("critical"), " critical")), F.when((cx > 0) & (fn != ""), text("complexity ", cx.cast("string"))),
                F.when(F.col("copies") > 0, text(s("copies"), " copies")), F.when(F.col("dead") > 0, text(s("dead"), " dead")), text("score ", s("score")),
            )
        ), "; ",
    )
    return best.select(
        "file", "score", category.alias("category"), S.effort_for(category).alias("effort"),
        S.confidence_for(F.col("critical"), F.col("warning"), F.col("findings")).alias("confidence"), evidence.alias("evidence"), advice.alias("recommendation"),
    )


def regression(current: DataFrame, baseline: DataFrame, tolerance: int = 0) -> DataFrame:
    """(category, baseline, current, delta, outcome): categories that changed, and one row, category ``all``, with the outcome."""
    count = lambda df, name: df.groupBy("category").agg(F.count("*").alias(name))
    both = count(current, "current").join(count(baseline, "baseline"), "category", "full_outer")
    both = both.select("category", F.coalesce("baseline", F.lit(0)).alias("baseline"), F.coalesce("current", F.lit(0)).alias("current"))
    both = both.withColumn("delta", F.col("current") - F.col("baseline"))
    total = both.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("baseline", "current", "delta"))).withColumn("category", F.lit("all"))
    outcome = F.when(F.col("category") != "all", "").when(F.col("delta") > tolerance, "fail").when(F.col("delta") > 0, "warn").otherwise("pass")
    return both.where("delta <> 0").unionByName(total).select("category", "baseline", "current", "delta", outcome.alias("outcome"))


def trend(snapshots: DataFrame) -> DataFrame:
    """One row of (ts, score) snapshots: first, last, delta and direction (more than five up or down)."""
    one = snapshots.agg(F.count("*").alias("points"), F.min_by("score", "ts").alias("first_score"), F.max_by("score", "ts").alias("last_score"))
    delta = F.when(F.col("points") >= 2, F.col("last_score") - F.col("first_score")).otherwise(0)
    return one.select("points", "first_score", "last_score", delta.alias("delta"), F.when(delta > 5, "improving").when(delta < -5, "declining").otherwise("stable").alias("direction"))


def sparkline(snapshots: DataFrame) -> DataFrame:
    """One row: a bar for each (ts, score), by time."""
    points = F.sort_array(F.collect_list(F.struct("ts", S.sparkline_block(F.col("score")).alias("bar"))))
    return snapshots.agg(F.array_join(F.transform(points, lambda p: p["bar"]), "").alias("sparkline"))


def walkthrough(findings: DataFrame) -> DataFrame:
    """(step, title, findings, minutes): what to look at, in order, without empty steps, and the whole with an estimate."""
    steps = [
        (2, "critical", F.col("severity") == "critical"), (3, "dead code", F.col("analyzer") == "deadcode"), (4, "complexity", F.col("category") == "complexity"),
        (5, "duplication", F.col("category") == "duplication"), (6, "security", F.col("analyzer") == "security"),
    ]
    minutes = S.choose(F.col("severity"), {"critical": 5, "warning": 2, "info": 1, "hint": 1}, 0)
    one = findings.agg(F.count("*").alias("n1"), F.coalesce(F.sum(minutes), F.lit(0)).cast("long").alias("minutes"), *(F.count_if(ok).alias(f"n{k}") for k, _, ok in steps))
    rows = [F.struct(F.lit(1).alias("step"), F.lit("overview").alias("title"), F.col("n1").alias("findings"))]
    rows += [F.when(F.col(f"n{k}") > 0, F.struct(F.lit(k).alias("step"), F.lit(t).alias("title"), F.col(f"n{k}").alias("findings"))) for k, t, _ in steps]
    rows += [F.struct(F.lit(7).alias("step"), F.lit("next").alias("title"), F.col("n1").alias("findings"))]
    return one.select(F.explode(F.array_compact(F.array(*rows))).alias("r"), "minutes").select("r.*", S.format_minutes(F.col("minutes")).alias("estimate"))


def next_steps(findings: DataFrame, k: int = 5) -> DataFrame:
    """(action, priority, n): at most k actions, the most urgent first."""
    named = lambda word: F.lower(F.concat_ws(" ", "category", "message", "rule_id")).contains(word)
    category = lambda c: F.col("category") == c
    rules = [
        (1, "remove unreachable functions", "high", category("dead-code")), (2, "refactor complex functions", "high", category("complexity")),
        (3, "extract copies", "medium", category("duplication")), (4, "tidy dependencies", "medium", category("dependencies")),
        (0, "review security", "critical", named("security")), (5, "fix names", "low", named("naming")),
    ]
    one = findings.agg(*(F.count_if(ok).alias(f"n{o}") for o, _, _, ok in rules))
    steps = [F.when(F.col(f"n{o}") > 0, F.struct(F.lit(o).alias("o"), F.lit(a).alias("action"), F.lit(p).alias("priority"), F.col(f"n{o}").alias("n"))) for o, a, p, _ in rules]
    return one.select(F.explode(F.array_compact(F.array(*steps))).alias("s")).select("s.*").orderBy("o").limit(k).drop("o")


def zero_filled(findings: DataFrame) -> DataFrame:
    """(severity, n): all severities, also those without findings, and ``total``."""
    one = findings.agg(*severity_counts(), F.count("*").alias("total"))
    return one.select(F.explode(F.array(*(F.struct(F.lit(s).alias("severity"), F.col(s).alias("n")) for s in [*SEVERITIES, "total"]))).alias("r")).select("r.*")


def timings(findings: DataFrame, elapsed: DataFrame) -> DataFrame:
    """(analyzer, elapsed_ms, findings, slowest) of (analyzer, elapsed_ms), the slowest marked."""
    n = findings.groupBy("analyzer").agg(F.count("*").alias("findings"))
    joined = elapsed.join(n, "analyzer", "left").select("analyzer", "elapsed_ms", F.coalesce("findings", F.lit(0)).alias("findings"))
    top = joined.agg(F.max_by("analyzer", F.struct("elapsed_ms", "analyzer")).alias("top"))
    return joined.crossJoin(top).select("analyzer", "elapsed_ms", "findings", (F.col("analyzer") == F.col("top")).alias("slowest"))


def public_api(symbols: DataFrame, uses: DataFrame) -> DataFrame:
    """(symbol, class, used_by): confirmed where another package uses a symbol, accidental where only its own does, else unused."""
    by = uses.groupBy("symbol").agg(F.sort_array(F.collect_set("using_pkg")).alias("pkgs"))
    joined = symbols.join(by, "symbol", "left")
    pkgs = F.coalesce("pkgs", F.array().cast("array<string>"))
    others = F.array_except(pkgs, F.array("owner_pkg"))
    kind = F.when(F.size(others) > 0, "confirmed").when(F.size(pkgs) > 0, "accidental").otherwise("unused")
    return joined.select("symbol", kind.alias("class"), F.array_join(others, ",").alias("used_by"))


def coverage(functions: DataFrame, tested: DataFrame) -> DataFrame:
    """(pkg, functions, tested, percent): per package, how many functions (pkg, fn) are among the tested (fn)."""
    hit = functions.join(tested.select(F.col("fn"), F.lit(1).alias("t")).distinct(), "fn", "left")
    per = hit.groupBy("pkg").agg(F.count("*").alias("functions"), F.count("t").alias("tested"))
    return per.withColumn("percent", F.round(F.coalesce(F.try_divide(F.col("tested") * 100.0, F.col("functions")), F.lit(0.0)), 6))


def ratio_to_max(rows: DataFrame, n: str) -> DataFrame:
    """Rows with ``percent`` of the largest value; the maximum is an aggregate joined back, not a window over all rows."""
    most = rows.agg(F.max(n).alias("most"))
    return rows.crossJoin(F.broadcast(most)).withColumn("percent", F.floor(F.col(n) * 100 / F.col("most")).cast("long")).drop("most")


def first_last(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, first, last) value by order."""
    w = W.partitionBy(key).orderBy(order, value)
    return rows.select(key, F.first(value).over(w).alias("first"), F.last(value).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("last")).distinct()
