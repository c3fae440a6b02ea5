"""Relational operators on findings and facts: filters, differences, overlaps, pattern joins, rankings.

All are lazy plans.  Rows with null keys match nothing unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siltstone.functions import scalar as S
from siltstone.schema import FINDING_COLUMNS, OVERLAP_KINDS, SEVERITIES

BASELINE_KEYS = ["file", "line", "rule_id", "analyzer"]


def severity_filter(findings: DataFrame, least: str) -> DataFrame:
    """Findings at least as severe as ``least``; an unknown ``least`` keeps all, and so does an unknown severity its row."""
    if least not in SEVERITIES:
        return findings
    rank = S.severity_rank(F.col("severity"), None)
    return findings.where(rank.isNull() | (rank <= SEVERITIES.index(least)))


def select_analyzers(findings: DataFrame, names: list[str]) -> DataFrame:
    """Findings of the named analyzers; no name means all."""
    return findings.where(F.col("analyzer").isin(names)) if names else findings


def not_suppressed(findings: DataFrame, suppressions: DataFrame, strict_scope: bool = False) -> DataFrame:
    """Findings that no directive hides.

    ``suppressions`` has file, decl_line, type and analyzer.  ``ignore-all``
    hides a file's findings; others those of their analyzer (``*``: any) from
    the line before the declaration to the end of the file.  With
    ``strict_scope``, only on that line, the comment's or the declaration's.
    """
    f, s = findings.alias("f"), suppressions.select(F.col("file").alias("s_file"), "decl_line", "type", F.col("analyzer").alias("s_analyzer")).alias("s")
    reach = F.col("line") >= F.col("decl_line") - 1
    if strict_scope:
        reach &= (F.col("line") <= F.col("decl_line")) | (F.col("decl_line") == 0)
    hit = (F.col("type") == "ignore-all") | (reach & ((F.col("s_analyzer") == "*") | (F.col("s_analyzer") == F.col("f.analyzer"))))
    return f.join(s, (F.col("f.file") == F.col("s_file")) & hit, "left_anti")


def stale_suppressions(suppressions: DataFrame, findings: DataFrame) -> DataFrame:
    """Directives that hide nothing; ``keep`` counts for dead and unused code only."""
    s = suppressions.alias("s")
    f = findings.select(F.col("file").alias("f_file"), F.col("line").alias("f_line"), F.col("analyzer").alias("f_analyzer")).alias("f")
    kept = (F.col("s.type") == "keep") & F.col("f_analyzer").isin("deadcode", "unused") & (F.col("f_line") >= F.col("s.decl_line") - 1)
    other = (F.col("s.type") == "ignore") & ((F.col("s.analyzer") == "*") | (F.col("s.analyzer") == F.col("f_analyzer"))) & (F.col("f_line") >= F.col("s.decl_line") - 1)
    return s.join(f, (F.col("s.file") == F.col("f_file")) & ((F.col("s.type") == "ignore-all") | kept | other), "left_anti")


def for_target(findings: DataFrame, target: str) -> DataFrame:
    """Findings of a file (its path or the end of one), or of a symbol that message or detail name."""
    hit = (F.col("file") == target) | F.col("file").endswith("/" + target) | F.col("message").contains(target) | F.col("detail").contains(target)
    return findings.where(hit)


def in_changed(findings: DataFrame, changed: DataFrame) -> DataFrame:
    """Findings whose file, by path or base name, is among the changed files (column file)."""
    keys = changed.select(F.explode(F.array("file", S.base_name(F.col("file")))).alias("c_key")).distinct()
    # only a changed path without a folder can equal a base name
    return findings.join(keys, F.col("file") == F.col("c_key"), "left_semi")


def baseline_diff(current: DataFrame, baseline: DataFrame, keys: list[str] = BASELINE_KEYS) -> DataFrame:
    """Rows of ``current`` whose keys ``baseline`` lacks; null keys are equal."""
    old = baseline.select(*(F.col(k).alias(f"b_{k}") for k in keys)).distinct()
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"b_{k}"))
    return current.join(old, same, "left_anti")


def end_of(line: Column, end: Column) -> Column:
    return F.when(F.coalesce(end, F.lit(0)) == 0, line).otherwise(end)


def overlaps(findings: DataFrame, kinds: list[tuple[str, str, str]] = OVERLAP_KINDS) -> DataFrame:
    """(kind, file, line, first_rule, second_rule, second_line): findings of two analyzers on overlapping lines of a file."""
    pairs = findings.sparkSession.createDataFrame(kinds, "a_analyzer string, b_analyzer string, kind string")
    used = findings.where(F.col("analyzer").isin(sorted({x for a, b, _ in kinds for x in (a, b)})))
    end = end_of(F.col("line"), F.col("end_line"))
    a = used.select(F.col("file"), F.col("analyzer").alias("a_analyzer"), F.col("line").alias("line"), end.alias("a_end"), F.col("rule_id").alias("first_rule"))
    b = used.select(F.col("file"), F.col("analyzer").alias("b_analyzer"), F.col("line").alias("second_line"), end.alias("b_end"), F.col("rule_id").alias("second_rule"))
    # the kinds are a handful of literals; their side names what the right side may be, so the join stays an equi-join
    left = a.join(F.broadcast(pairs), "a_analyzer")
    hit = left.join(b, ["file", "b_analyzer"]).where((F.col("line") <= F.col("b_end")) & (F.col("a_end") >= F.col("second_line")))
    return hit.select("kind", "file", "line", "first_rule", "second_rule", "second_line")


def attribute(findings: DataFrame, changed: DataFrame) -> DataFrame:
    """Findings with ``attribution``: introduced where the file (by path or base name) is changed, else pre-existing."""
    keys = changed.select(F.explode(F.array("file", S.base_name(F.col("file")))).alias("c_key"), F.lit("introduced").alias("hit")).distinct()
    return findings.join(keys, F.col("file") == F.col("c_key"), "left").select(*findings.columns, F.coalesce("hit", F.lit("pre-existing")).alias("attribution"))


def verdict(attributed: DataFrame) -> DataFrame:
    """One row: fail with an introduced critical finding, warn with an introduced warning, else pass."""
    new = F.col("attribution") == "introduced"
    n = attributed.agg(
        F.count_if(new).alias("introduced"), F.count_if(~new).alias("pre_existing"),
        F.count_if(new & (F.col("severity") == "critical")).alias("c"), F.count_if(new & (F.col("severity") == "warning")).alias("w"),
    )
    return n.select("introduced", "pre_existing", F.when(F.col("c") > 0, "fail").when(F.col("w") > 0, "warn").otherwise("pass").alias("verdict"))


def last_match(paths: DataFrame, patterns: list[tuple[str, list[str]]]) -> DataFrame:
    """(file, rule_idx, pattern, owners): each distinct path with the last ownership rule that matches it.

    A pattern with a leading ``!`` takes the owners away.  The rules are
    literals of the plan: a single scan evaluates them all, the last first,
    with no join.
    """
    files = paths.select("file").distinct()
    chosen = None
    for k in reversed(range(len(patterns))):
        pattern, owners = patterns[k]
        negated = pattern.startswith("!")
        hit = F.col("file").rlike(S.owners_regex(pattern.removeprefix("!")))
        names = F.array(*(F.lit(o) for o in owners)).cast("array<string>") if owners and not negated else F.array().cast("array<string>")
        value = F.struct(F.lit(k).alias("rule_idx"), F.lit(pattern).alias("pattern"), names.alias("owners"))
        chosen = F.when(hit, value) if chosen is None else chosen.when(hit, value)
    if chosen is None:
        return files.selectExpr("file", "CAST(NULL AS INT) AS rule_idx", "CAST(NULL AS STRING) AS pattern", "CAST(NULL AS ARRAY<STRING>) AS owners")
    return files.select("file", chosen.alias("m")).select("file", "m.rule_idx", "m.pattern", "m.owners")


def by_owner(findings: DataFrame, patterns: list[tuple[str, list[str]]]) -> DataFrame:
    """(owner, findings, files): a file of several owners counts for each; of none, for ``(unowned)``."""
    per = findings.groupBy("file").agg(F.count("*").alias("n"))
    owned = last_match(per, patterns).select(F.col("file").alias("o_file"), "owners")
    none = F.array(F.lit("(unowned)"))
    names = F.when(F.size(F.coalesce("owners", F.array().cast("array<string>"))) == 0, none).otherwise(F.col("owners"))
    spread = per.join(owned, F.col("file") == F.col("o_file")).select(F.explode(names).alias("owner"), "n")
    return spread.groupBy("owner").agg(F.sum("n").alias("findings"), F.count("*").alias("files"))


def at_line(findings: DataFrame, file: str, line: int) -> DataFrame:
    """Findings of a file whose lines hold the given one."""
    return findings.where((F.col("file") == file) & (F.col("line") <= line) & (end_of(F.col("line"), F.col("end_line")) >= line))


def rule_violations(imports: DataFrame, rules: DataFrame) -> DataFrame:
    """Imports that a rule forbids: (src_pkg, dst_pkg, package, must_not_use); suffixes match at slashes.

    Each package path is expanded into its suffixes, so the join is by
    equality and neither side need be small.
    """
    tails = lambda c: F.transform(F.sequence(F.lit(1), F.size(F.split(c, "/"))), lambda k: S.components(c, -k))
    src = imports.select("src_pkg", "dst_pkg", F.explode(tails(F.col("src_pkg"))).alias("package"))
    hit = src.join(rules, "package").where(S.has_suffix(F.col("dst_pkg"), F.col("must_not_use")))
    return hit.select("src_pkg", "dst_pkg", "package", "must_not_use")


def uncovered_packages(packages: DataFrame, rules: DataFrame) -> DataFrame:
    """Packages (column pkg) that no rule names on either side; none where there is no rule."""
    named = rules.select(F.explode(F.array("package", "must_not_use")).alias("suffix")).distinct()
    some = named.agg(F.count("*").alias("n")).where("n > 0").select(F.lit(1).alias("one"))
    tails = F.transform(F.sequence(F.lit(1), F.size(F.split("pkg", "/"))), lambda k: S.components("pkg", -k))
    covered = packages.select("pkg", F.explode(tails).alias("suffix")).join(named, "suffix").select("pkg").distinct()
    return packages.join(covered, "pkg", "left_anti").join(some, F.lit(True), "left_semi").select("pkg")


def prefix_unused(modules: DataFrame, used: DataFrame, boundary: bool = True) -> DataFrame:
    """Modules (column module) that no import (column path) equals or has as a prefix.

    With ``boundary`` the prefix must end at a slash: imports are expanded into
    their prefixes and joined by equality.  Without, any prefix counts; the
    first character, and then the prefix of a module's own length, are joined.
    """
    if boundary:
        heads = F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda k: S.components("path", k))
        known = used.select(F.explode(heads).alias("module")).distinct()
        return modules.join(known, "module", "left_anti")
    # lengths of modules by their first character: a path makes as many prefixes as there are lengths, of any size
    lengths = modules.select(F.substring("module", 1, 1).alias("c"), F.length("module").alias("n")).distinct()
    heads = used.select("path").distinct().withColumn("c", F.explode(F.array_distinct(F.array(F.lit(""), F.substring("path", 1, 1)))))
    known = heads.join(lengths, "c").where("length(path) >= n").select(F.expr("substring(path, 1, n)").alias("module")).distinct()
    return modules.join(known, "module", "left_anti")


def duplicate_pairs(blocks: DataFrame) -> DataFrame:
    """Pairs of a block with the first one of equal hash: (hash, file, line, end_line, first_file, first_line).

    ``blocks`` has hash, file, line, end_line and decl.  Blocks that overlap
    the first one in its file, or are of its declaration, make no pair; equal
    locations count once.  Groups of one are dropped before the window.
    """
    groups = W.partitionBy("hash")
    order = groups.orderBy("file", "line", "end_line", "decl")
    first = lambda c: F.first(c).over(order)
    w = blocks.withColumn("n", F.count("*").over(groups)).where("n > 1")
    w = w.select("hash", "file", "line", "end_line", "decl", first("file").alias("first_file"), first("line").alias("first_line"), first("end_line").alias("first_end"), first("decl").alias("first_decl"), F.row_number().over(order).alias("k"))
    same_file = F.col("file") == F.col("first_file")
    overlap = same_file & (F.col("line") <= F.col("first_end")) & (F.col("end_line") >= F.col("first_line"))
    pairs = w.where((F.col("k") > 1) & ~overlap & ~(same_file & (F.col("decl") == F.col("first_decl"))))
    return pairs.select("hash", "file", "line", "end_line", "first_file", "first_line").dropDuplicates(["file", "line", "first_file", "first_line"])


def windows(rows: DataFrame, tokens: str, n: int, keep: list[str]) -> DataFrame:
    """Every n consecutive items of an array column: keep columns, ``at`` (from 0) and ``window``."""
    at = F.when(F.size(tokens) >= n, F.sequence(F.lit(0), F.size(tokens) - n)).otherwise(F.array().cast("array<int>"))
    return rows.select(*keep, tokens, F.explode(at).alias("at")).select(*keep, "at", F.slice(tokens, F.col("at") + 1, n).alias("window"))


def top_k(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows; the order should be total, so that ties don't change the result."""
    return rows.orderBy(*order).limit(k)


def ordered_findings(findings: DataFrame) -> DataFrame:
    return findings.orderBy("file", "line", "rule_id", "message")


def union_all(parts: list[DataFrame]) -> DataFrame:
    """The rows of all analyzers, repeated ones kept."""
    out = parts[0].select(*FINDING_COLUMNS)
    for p in parts[1:]:
        out = out.unionByName(p.select(*FINDING_COLUMNS))
    return out


def difference(rows: DataFrame, gone: DataFrame, *keys: str) -> DataFrame:
    """The rows, once each, whose keys ``gone`` does not have; null keys are equal to each other."""
    own = gone.select(*(F.col(k).alias(f"g_{k}") for k in keys)).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"g_{k}")) for k in keys]
    return rows.distinct().join(own, same, "left_anti")


def union_distinct(parts: list[DataFrame], *columns: str) -> DataFrame:
    """The columns' values in any part, once each: imports of syntax, of packages and of files that were not loaded."""
    out = parts[0].select(*columns)
    for p in parts[1:]:
        out = out.unionByName(p.select(*columns))
    return out.distinct()


def project_stats(facts: DataFrame) -> DataFrame:
    """One row of (package, file, n_decls, n_types, n_funcs) facts: packages, files, decls, functions, types."""
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)
    return facts.agg(
        F.countDistinct("package").alias("packages"), F.countDistinct("file").alias("files"), total("n_decls", "decls"), total("n_funcs", "functions"), total("n_types", "types")
    )


def coverage_gaps(functions: DataFrame, tests: DataFrame, calls: DataFrame) -> DataFrame:
    """Functions (pkg, name, ...) of packages for which there is neither a ``TestName`` nor a call from a test.

    tests: pkg, name of test functions; calls: pkg, name that test functions call.
    """
    named = tests.where(F.col("name").startswith("Test")).select("pkg", F.expr("substring(name, 5)").alias("name"))
    covered = named.unionByName(calls.select("pkg", "name")).distinct()
    return functions.join(covered, ["pkg", "name"], "left_anti").select(*functions.columns)


def test_probe(files: DataFrame) -> DataFrame:
    """(file, folder_tested, file_tested) of the source files (column file): whether their folder, and they themselves, have a test file."""
    folder = F.regexp_replace("file", "(^|/)[^/]*$", "")
    tests = files.where(F.col("file").endswith("_test.go"))
    folders = tests.select(folder.alias("t_folder")).distinct().withColumn("in_folder", F.lit(True))
    siblings = tests.select(F.regexp_replace("file", "_test[.]go$", ".go").alias("t_file")).distinct().withColumn("itself", F.lit(True))
    own = files.where(~F.col("file").endswith("_test.go")).select("file").distinct().withColumn("folder", folder)
    joined = own.join(folders, F.col("folder") == F.col("t_folder"), "left").join(siblings, F.col("file") == F.col("t_file"), "left")
    return joined.select("file", F.coalesce("in_folder", F.lit(False)).alias("folder_tested"), F.coalesce("itself", F.lit(False)).alias("file_tested"))


def file_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change) of two snapshots of (path, mtime): added, modified or deleted."""
    b = before.select(F.col("path").alias("b_path"), F.col("mtime").alias("b_mtime"))
    joined = after.join(b, F.col("path") == F.col("b_path"), "full_outer")
    change = F.when(F.col("b_path").isNull(), "added").when(F.col("path").isNull(), "deleted").when(F.col("mtime") != F.col("b_mtime"), "modified")
    return joined.select(F.coalesce("path", "b_path").alias("path"), change.alias("change")).where("change IS NOT NULL")


def _tails(path: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(F.split(path, "/"))), lambda k: S.components(path, -k))


def applicable_rules(packages: DataFrame, rules: DataFrame) -> DataFrame:
    """(pkg, package, must_not_use, as_source): the rules that name a package (column pkg) on either side; by equality of suffixes."""
    tails = packages.select("pkg", F.explode(_tails(F.col("pkg"))).alias("suffix"))
    sides = rules.select("package", "must_not_use", F.col("package").alias("suffix"), F.lit(True).alias("source"))
    sides = sides.unionByName(rules.select("package", "must_not_use", F.col("must_not_use").alias("suffix"), F.lit(False).alias("source")))
    return tails.join(sides, "suffix").groupBy("pkg", "package", "must_not_use").agg(F.bool_or("source").alias("as_source"))


def guard_report(packages: DataFrame, imports: DataFrame, rules: DataFrame) -> DataFrame:
    """(pkg, package, must_not_use, as_source, violations): the rules for each package, and how often it breaks them."""
    broken = rule_violations(imports, rules).groupBy(F.col("src_pkg").alias("pkg"), "package", "must_not_use").agg(F.count("*").alias("violations"))
    return applicable_rules(packages, rules).join(broken, ["pkg", "package", "must_not_use"], "left").na.fill(0, ["violations"])


def boundaries(imports: DataFrame, rules: DataFrame) -> DataFrame:
    """(pkg, imports, rules): what each package imports, and how many rules name it."""
    per = imports.groupBy(F.col("src_pkg").alias("pkg")).agg(F.array_join(F.sort_array(F.collect_set("dst_pkg")), ",").alias("imports"))
    n = applicable_rules(per.select("pkg"), rules).groupBy("pkg").agg(F.count("*").alias("rules"))
    return per.join(n, "pkg", "left").na.fill(0, ["rules"])


def changed_packages(files: DataFrame, changed: DataFrame) -> DataFrame:
    """Rows of files (pkg, file) whose path or base name is that of a changed file; by equality of base names."""
    names = changed.select(S.base_name(F.col("file")).alias("c_name")).distinct()
    return files.join(names, S.base_name(F.col("file")) == F.col("c_name"), "left_semi")
