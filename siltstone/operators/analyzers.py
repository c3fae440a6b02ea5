"""Analyzers: fact tables in, findings out.  Each is one lazy plan.

Facts are DataFrames with the columns named in each docstring; others are
ignored.  Thresholds are parameters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siltstone.functions import scalar as S
from siltstone.operators import graph as G
from siltstone.operators import relational as R
from siltstone.schema import FINDING_COLUMNS, INITIALISMS, SECRETS, TODO
from siltstone.storage import stored


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def finding(rows: DataFrame, analyzer: str, category: str, severity, rule, message, detail="", suggestion: str = "", line="line", end_line="end_line") -> DataFrame:
    """Rows with file (and lines, where they have them) as findings."""
    own = lambda c: F.col(c).cast("int") if c in rows.columns else F.lit(0)
    file = F.col("file") if "file" in rows.columns else F.lit("")
    return rows.select(
        F.lit(analyzer).alias("analyzer"), F.lit(category).alias("category"), _col(severity).alias("severity"), _col(message).alias("message"), _col(detail).alias("detail"),
        file.alias("file"), own(line).alias("line"), own(end_line).alias("end_line"), own("col").alias("col"), F.lit(suggestion).alias("suggestion"), _col(rule).alias("rule_id"),
    ).select(*FINDING_COLUMNS)


def _text(*parts) -> Column:
    return F.concat(*(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))


def _graded(x: Column, limit: int, warning: float, critical: float, otherwise: str = "hint") -> Column:
    return F.when(x >= limit * critical, "critical").when(x >= limit * warning, "warning").otherwise(otherwise)


def complexity(decls: DataFrame, most: int = 15, most_cognitive: int = 20) -> DataFrame:
    """decls: file, name, recv, line, end_line, cyclomatic, cognitive.  One finding a function, the cyclomatic one first."""
    label = S.func_label(F.col("recv"), F.col("name"))
    a = decls.where(F.col("cyclomatic") > most)
    b = decls.where(~(F.col("cyclomatic") > most) & (F.col("cognitive") > most_cognitive))
    first = finding(a, "complexity", "complexity", _graded(F.col("cyclomatic"), most, 2, 3), "CX001", _text(label, " has cyclomatic complexity ", F.col("cyclomatic")), _text("cognitive ", F.col("cognitive")), "split the function")
    second = finding(b, "complexity", "complexity", _graded(F.col("cognitive"), most_cognitive, 2, 3), "CX002", _text(label, " has cognitive complexity ", F.col("cognitive")), _text("cyclomatic ", F.col("cyclomatic")), "flatten the function")
    return first.unionByName(second)


def large_functions(decls: DataFrame, most: int = 50) -> DataFrame:
    """decls: file, name, recv, line, end_line, is_generated, and makes_command where known.  More lines than ``most``; twice and four times are worse.

    Constructors of commands, which are long for their texts, are exempt.
    """
    lines = F.col("end_line") - F.col("line") + 1
    if "makes_command" in decls.columns:
        decls = decls.where("NOT makes_command")
    rows = decls.where(~F.col("is_generated")).withColumn("lines", lines).where(F.col("lines") > most)
    grade = F.when(F.col("lines") > most * 4, "critical").when(F.col("lines") > most * 2, "warning").otherwise("hint")
    return finding(rows, "large-functions", "code-smell", grade, "LF001", _text(S.func_label(F.col("recv"), F.col("name")), " has ", F.col("lines"), " lines"), "", "split the function")


def naming(names: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """names: file, line, name, exported; aliases: file, line, alias, import_path."""
    n = F.col("name")
    rows = names.select("*", F.filter(F.array(*(F.when(n.contains(x), F.lit(x)) for x in INITIALISMS)), lambda x: x.isNotNull()).alias("bad"))
    snake = rows.where(n.contains("_") & ~n.startswith("_") & ~n.rlike("_(?:test|mock)$"))
    caps = rows.where(F.col("exported") & S.is_all_caps(n, [x.upper() for x in INITIALISMS]))
    mixed = rows.select("file", "line", "name", F.explode("bad").alias("bad"))
    out = finding(snake, "naming", "code-smell", "hint", "NM001", _text(n, " has underscores"), S.to_camel(n), "rename it")
    out = out.unionByName(finding(caps, "naming", "code-smell", "hint", "NM002", _text(n, " is all capitals"), "", "rename it"))
    out = out.unionByName(finding(mixed, "naming", "code-smell", "hint", "NM004", _text(n, " has ", F.col("bad")), F.upper("bad"), "rename it"))
    if aliases is not None:
        same = aliases.where(F.col("alias") == S.last_segment(F.col("import_path")))
        out = out.unionByName(finding(same, "naming", "code-smell", "hint", "NM003", _text("alias ", F.col("alias"), " says nothing new"), "", "drop the alias"))
    return out


def todos(comments: DataFrame) -> DataFrame:
    """comments: file, line, text."""
    return finding(comments.where(F.col("text").rlike(TODO)), "security", "code-smell", "info", "SC010", F.substring("text", 1, 200), "", "do it or file it")


def secrets(texts: DataFrame) -> DataFrame:
    """texts (comments and literals): file, line, text.  A finding for each pattern that a text matches; one scan."""
    hits = F.array(*(F.when(F.col("text").rlike(p), F.struct(F.lit(rule).alias("rule"), F.lit(what).alias("what"))) for rule, what, p in SECRETS))
    rows = texts.select("file", "line", F.explode(F.array_compact(hits)).alias("hit"))
    return finding(rows, "security", "code-smell", "critical", F.col("hit.rule"), F.col("hit.what"), "", "move it out of the code")


def unsafe_use(selectors: DataFrame) -> DataFrame:
    """selectors: file, line, x, sel."""
    return finding(selectors.where("x = 'unsafe'"), "security", "code-smell", "warning", "SC020", _text("unsafe.", F.col("sel")), "", "avoid it")


def sql_text(calls: DataFrame) -> DataFrame:
    """calls: file, line, selector, args (kind, text): query text put together from parts that are not constant."""
    at = F.when(F.col("selector").isin("Exec", "Query", "QueryRow", "Prepare"), 0).when(F.col("selector").isin("ExecContext", "QueryContext", "QueryRowContext", "PrepareContext"), 1)
    rows = calls.withColumn("at", at).where(F.col("at").isNotNull() & (F.size("args") > F.col("at"))).withColumn("arg", F.get(F.col("args"), F.col("at")))
    bad = rows.where(F.col("arg.kind").isin("sprintf", "concat") & S.looks_like_sql(F.col("arg.text")))
    return finding(bad, "security", "code-smell", "critical", "SC030", _text("query text is put together for ", F.col("selector")), "", "use parameters")


def self_recursion(decls: DataFrame, first_calls: DataFrame) -> DataFrame:
    """decls: decl_id, file, line, name, recv_name; first_calls (the first statement's call): decl_id, qualifier, selector."""
    c = first_calls.select(F.col("decl_id").alias("c_id"), F.coalesce("qualifier", F.lit("")).alias("qualifier"), "selector")
    rows = decls.join(c, (F.col("decl_id") == F.col("c_id")) & (F.col("name") == F.col("selector")) & (F.coalesce("recv_name", F.lit("")) == F.col("qualifier")))
    return finding(rows, "self-recursion", "code-smell", "critical", "SR001", _text(F.col("name"), " calls itself first"), "", "add a way out")


def thin_wrappers(decls: DataFrame) -> DataFrame:
    """decls: file, line, end_line, name, stmt_count, calls_only (callee of the only call), exempt."""
    rows = decls.where((F.col("stmt_count") <= 2) & F.col("calls_only").isNotNull() & ~F.col("exempt"))
    return finding(rows, "thin-wrappers", "code-smell", "hint", "TW001", _text(F.col("name"), " only calls ", F.col("calls_only")), "", "inline it")


def feature_flags(build_tags: DataFrame, lookups: DataFrame) -> DataFrame:
    """build_tags: file, line, text (comments before the package clause); lookups: file, line, name, in_condition."""
    tags = build_tags.where(F.col("text").rlike(r"^//(?:go:build| ?\+build)\b"))
    env = lookups.where(F.col("in_condition") & ~S.is_operational(F.col("name")))
    out = finding(tags, "feature-flags", "code-smell", "info", "FF001", _text("build tag ", F.col("text")))
    return out.unionByName(finding(env, "feature-flags", "code-smell", "info", "FF002", _text("flag ", F.col("name"), " switches code")))


def registered_flags(calls: DataFrame) -> DataFrame:
    """calls: file, line, qualifier, selector, literal: every flag that is registered."""
    rows = calls.where(F.col("literal").isNotNull() & (F.col("qualifier") == "flag") & F.col("selector").isin("Bool", "Duration", "Float64", "Int", "String"))
    return finding(rows, "dead-flags", "dead-code", "warning", "DF002", _text("flag ", F.col("literal"), " is registered"))


def external_users(uses: DataFrame, symbols: DataFrame) -> DataFrame:
    """(symbol, using_pkg), distinct, by other packages than the owner."""
    own = symbols.select("symbol", "owner_pkg")
    return uses.join(own, "symbol").where("using_pkg <> owner_pkg").select("symbol", "using_pkg").distinct()


def propagated(users: DataFrame, type_refs: DataFrame) -> DataFrame:
    """Users of a symbol use what its signature names (owner, ref), and so on until nothing is new."""
    known = front = stored(users.distinct(), "users")
    refs = stored(type_refs.select("owner", "ref").distinct(), "users")
    while True:
        step = front.join(refs, F.col("symbol") == F.col("owner")).select(F.col("ref").alias("symbol"), "using_pkg").distinct()
        front = stored(step.join(known, ["symbol", "using_pkg"], "left_anti"), "users")
        if front.isEmpty():
            return known
        known = stored(known.unionByName(front), "users")


def unused_exports(symbols: DataFrame, users: DataFrame) -> DataFrame:
    """symbols: symbol, name, owner_pkg; those that no other package uses."""
    rows = symbols.join(users.select("symbol").distinct(), "symbol", "left_anti")
    return finding(rows, "unused", "unused", "hint", "UU001", _text('exported "', F.col("name"), '" is used by no other package'), "", "unexport it")


def api_surface(symbols: DataFrame, uses: DataFrame, implements: DataFrame) -> DataFrame:
    """Exported symbols outside internal packages that only their own package uses (info) or none (warning); interfaces' methods are exempt."""
    by = uses.groupBy("symbol").agg(F.collect_set("using_pkg").alias("pkgs"))
    rows = symbols.where(~F.col("owner_pkg").contains("/internal/")).join(implements.select("symbol").distinct(), "symbol", "left_anti").join(by, "symbol", "left")
    pkgs = F.coalesce("pkgs", F.array().cast("array<string>"))
    rows = rows.withColumn("others", F.size(F.array_except(pkgs, F.array("owner_pkg")))).withColumn("all", F.size(pkgs)).where("others = 0")
    return finding(rows, "api-surface", "unused", F.when(F.col("all") > 0, "info").otherwise("warning"), "AS001", _text(F.col("name"), " need not be exported"))


def dead_constants(constants: DataFrame, uses: DataFrame) -> DataFrame:
    """constants: symbol, name (exported ones); those in no use (symbol) at all."""
    rows = constants.join(uses.select("symbol").distinct(), "symbol", "left_anti")
    return finding(rows, "dead-flags", "dead-code", "info", "DF001", _text("constant ", F.col("name"), " is not used"))


def unused_fields(fields: DataFrame, selections: DataFrame) -> DataFrame:
    """fields: owner, name, exported, embedded, is_generated; selections: name of every field that is selected or set by its name."""
    own = fields.where("NOT exported AND NOT embedded AND NOT is_generated")
    rows = own.join(selections.select("name").distinct(), "name", "left_anti")
    return finding(rows, "unused-members", "unused", "info", "UM001", _text("field ", F.col("owner"), ".", F.col("name"), " is not used"))


def unimplemented_methods(iface_methods: DataFrame, methods: DataFrame) -> DataFrame:
    """iface_methods: owner, name; methods: name of every method of a type, those of tests too.  Methods go by name."""
    rows = iface_methods.join(methods.select("name").distinct(), "name", "left_anti")
    return finding(rows, "unused-members", "unused", "info", "UM002", _text("method ", F.col("owner"), ".", F.col("name"), " has no implementation"))


def unused_files(candidates: DataFrame, loaded: DataFrame, key: str = "file") -> DataFrame:
    """candidates and loaded: file; files on disk, of the kind that packages are made of, that no package has.

    ``key`` is the column that tells files apart where several have one path.
    """
    rows = candidates.join(loaded.select(key).distinct(), key, "left_anti")
    return finding(rows, "unused-files", "unused", "warning", "UF001", _text("file ", F.col("file"), " is not used"))


def unused_modules(requirements: DataFrame, imports: DataFrame) -> DataFrame:
    """requirements: file, line, module, indirect; imports: path."""
    rows = R.prefix_unused(requirements.where("NOT indirect"), imports)
    return finding(rows, "unused-deps", "unused", "warning", "UD001", _text("module ", F.col("module"), " is not imported"), "", "remove it")


def unused_replacements(replacements: DataFrame, imports: DataFrame) -> DataFrame:
    """replacements: file, line, old_path; any prefix counts."""
    rows = R.prefix_unused(replacements.withColumnRenamed("old_path", "module"), imports, boundary=False)
    return finding(rows, "unused-overrides", "unused", "warning", "UO001", _text("replacement of ", F.col("module"), " has no effect"), "", "remove it")


def architecture(imports: DataFrame, rules: DataFrame) -> DataFrame:
    rows = R.rule_violations(imports, rules)
    return finding(rows, "architecture", "architecture", "critical", "AR001", _text(F.col("src_pkg"), " must not import ", F.col("dst_pkg")), _text(F.col("package"), " / ", F.col("must_not_use")))


def boundary_coverage(packages: DataFrame, rules: DataFrame) -> DataFrame:
    return finding(R.uncovered_packages(packages, rules), "boundary-coverage", "architecture", "info", "BC001", _text("no rule names ", F.col("pkg")))


def body_blocks(bodies: DataFrame, least: int = 6) -> DataFrame:
    """bodies: file, decl, line, end_line, tokens, stmt_count -> blocks hashed whole."""
    rows = bodies.where(F.col("stmt_count") >= least)
    return rows.select(F.sha2(F.array_join("tokens", "|"), 256).alias("hash"), "file", "line", "end_line", "decl")


def window_blocks(statements: DataFrame, least: int = 6) -> DataFrame:
    """statements: file, decl, line, tokens (one for each top-level statement, each of one line) -> blocks of ``least`` statements hashed."""
    rows = R.windows(statements, "tokens", least, ["file", "decl", "line"])
    line = F.col("line") + F.col("at")
    return rows.select(F.sha2(F.array_join("window", "\n"), 256).alias("hash"), "file", line.alias("line"), (line + least - 1).alias("end_line"), "decl")


def duplication(blocks: DataFrame) -> DataFrame:
    rows = R.duplicate_pairs(blocks)
    return finding(rows, "duplication", "duplication", "warning", "DP001", _text("copy of ", F.col("first_file"), ":", F.col("first_line")), "", "extract it")


def hotspots(functions: DataFrame, files: DataFrame, least_lines: int = 10, least_functions: int = 3) -> DataFrame:
    """functions: file, cyclomatic; files: file, lines."""
    per = functions.groupBy("file").agg(F.sum("cyclomatic").alias("total"), F.count("*").alias("n"))
    rows = per.join(files, "file").where((F.col("lines") >= least_lines) & (F.col("n") >= least_functions))
    rows = rows.withColumn("density", F.col("total") / F.col("lines")).withColumn("average", F.col("total") / F.col("n")).where("density > 0.5 OR average > 15")
    grade = F.when((F.col("density") > 2) | (F.col("average") > 30), "critical").when((F.col("density") > 1) | (F.col("average") > 20), "warning").otherwise("info")
    return finding(rows, "hotspots", "complexity", grade, "HS001", _text(F.col("file"), " is dense"), _text("total ", F.col("total"), " functions ", F.col("n")))


def churn(commits: DataFrame, least: int = 50, most: int = 100) -> DataFrame:
    """commits: file, one row for each commit that touched it, and is_source where known; the share of the busiest file of any kind is the detail."""
    keys = ["file", "is_source"] if "is_source" in commits.columns else ["file"]
    n = commits.groupBy(*keys).agg(F.count("*").alias("n"))
    top = n.agg(F.max("n").alias("top"))
    rows = (n.where("is_source") if len(keys) > 1 else n).where(F.col("n") >= least).crossJoin(F.broadcast(top))
    grade = F.when(F.col("n") > most, "critical").when(F.col("n") > least, "warning").otherwise("info")
    return finding(rows, "churn", "code-smell", grade, "CH001", _text("changed ", F.col("n"), " times"), _text(F.floor(F.col("n") * 100 / F.col("top")), "%"))


def fan_out(imports: DataFrame, most: int = 20) -> DataFrame:
    n = imports.groupBy("src_pkg").agg(F.countDistinct("dst_pkg").alias("n")).where((F.col("n") > most) & ~S.last_segment(F.col("src_pkg")).isin("cli", "cmd", "command", "commands"))
    return finding(n, "dependencies", "dependencies", "warning", "DE002", _text(F.col("src_pkg"), " imports ", F.col("n"), " packages"))


def dead_functions(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes: fn, name, is_root (and file, line)."""
    live = G.reach(edges, nodes.where("is_root").select("fn")).select(F.col("node").alias("fn"))
    rows = nodes.where("NOT is_root").join(live, "fn", "left_anti")
    return finding(rows, "deadcode", "dead-code", "warning", "DC001", _text('function "', F.col("name"), '" is never reached'), "", "remove it")


def import_cycles(imports: DataFrame, max_length: int = 4) -> DataFrame:
    found = G.cycles(imports.select(F.col("src_pkg").alias("src"), F.col("dst_pkg").alias("dst")), max_length)
    return finding(found, "dependencies", "dependencies", "critical", "DE001", F.concat(F.array_join("cycle", " -> "), F.lit(" -> "), F.col("cycle")[0]))


def alias_cycles(aliases: DataFrame, max_length: int = 4) -> DataFrame:
    """aliases: src_pkg, dst_pkg of type aliases that name an import."""
    found = G.cycles(aliases.select(F.col("src_pkg").alias("src"), F.col("dst_pkg").alias("dst")), max_length)
    return finding(found, "re-export-cycles", "dependencies", "warning", "RC001", F.concat(F.array_join("cycle", " -> "), F.lit(" -> "), F.col("cycle")[0]))


def numbered(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Rows with ``k``, their number in their group."""
    return rows.withColumn("k", F.row_number().over(W.partitionBy(key).orderBy(*order)))
