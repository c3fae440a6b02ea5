"""The analysis of a folder of sources: facts once, then one lazy plan for each analyzer, then one union."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.config import Config
from siltstone.functions import scalar as S
from siltstone.operators import analyzers as A
from siltstone.operators import relational as R
from siltstone.schema import CATEGORIES, FINDING
from siltstone.sources import golang as go
from siltstone.sources import text as T
from siltstone.storage import stored


@dataclass
class Facts:
    """Fact relations that the analyzers share; all are read from the stored facts."""

    spark: SparkSession
    path: str
    found: DataFrame
    modules: DataFrame
    git_log: DataFrame | None = None
    #: the facts of test files
    tests: DataFrame | None = None
    #: (file, src) of all source files, for what was not loaded
    sources: DataFrame | None = None

    def of(self, what: str) -> DataFrame:
        return go.exploded(self.found, what)

    def functions(self) -> DataFrame:
        f = self.of("funcs").join(self.found.select("file", "is_generated", "folder"), "file")
        return f.withColumn("fn", F.concat_ws(":", "file", F.col("line").cast("string")))

    def imports(self) -> DataFrame:
        """(src_pkg, dst_pkg) within the module: folders and import paths below its name."""
        name = T.project_info(self.modules).agg(F.min("module").alias("module"))
        i = self.of("imports").join(self.found.select("file", "folder"), "file").crossJoin(F.broadcast(name))
        own = i.where(F.col("path").startswith(F.concat("module", F.lit("/"))))
        return own.select(F.col("folder").alias("src_pkg"), F.expr("substring(path, length(module) + 2)").alias("dst_pkg")).distinct()


def load(spark: SparkSession, path: str, git_log: DataFrame | None = None, ignore: tuple[str, ...] = ()) -> Facts:
    """Reads and parses a folder once; (file, pattern) of ``ignore`` are left out."""
    files = go.read_sources(spark, path).withColumn("file", F.regexp_replace("file", "^file:/*" + S.glob_to_regex(path.strip("/"))[1:-1] + "/", ""))
    for pattern in ignore:
        files = files.where(~S.glob_match(F.col("file"), pattern))
    found = go.extract(files).join(files.select("file", "is_generated", "has_build_constraint"), "file")
    found = found.withColumn("folder", F.when(F.col("file").contains("/"), F.regexp_replace("file", "/[^/]*$", "")).otherwise("."))
    found = stored(found.withColumn("is_test", F.col("file").endswith("_test.go")), "facts")
    lines = T.read_lines(spark, path, "go.mod")
    return Facts(spark, path, found.where("NOT is_test"), lines, git_log, found.where("is_test"), files.select("file", "src"))


def _complexity(f: Facts, c: Config) -> DataFrame:
    return A.complexity(f.functions(), c.max_cyclomatic, c.max_cognitive)


def _large(f: Facts, c: Config) -> DataFrame:
    return A.large_functions(f.functions(), c.max_function_lines)


def _naming(f: Facts, c: Config) -> DataFrame:
    names = f.of("names").select("file", "line", "name", "exported").unionByName(f.of("funcs").select("file", "line", "name", "exported"))
    aliases = f.of("imports").where("alias <> ''").select("file", "line", "alias", F.col("path").alias("import_path"))
    return A.naming(names, aliases)


def _security(f: Facts, c: Config) -> DataFrame:
    comments, literals = f.of("comments").select("file", "line", "text"), f.of("literals").select("file", "line", "text")
    return R.union_all([A.todos(comments), A.secrets(comments.unionByName(literals)), A.unsafe_use(f.of("selectors")), A.sql_text(f.of("calls"))])


def _self_recursion(f: Facts, c: Config) -> DataFrame:
    d = f.functions().withColumn("decl_id", F.col("fn"))
    return A.self_recursion(d.select("decl_id", "file", "line", "end_line", "name", "recv_name"), d.select("decl_id", F.col("first_qualifier").alias("qualifier"), F.col("first_call").alias("selector")).where("selector IS NOT NULL"))


def _thin(f: Facts, c: Config) -> DataFrame:
    d = f.functions()
    own = F.lower(F.substring("name", 1, 1)).eqNullSafe(F.substring("wraps", 1, 1)) & (F.substring("name", 2, 1 << 20) == F.substring("wraps", 2, 1 << 20))
    exempt = own | F.col("name").isin("Clean", "Format", "String", "Stringer", "Value", "init", "main") | (F.col("recv") != "")
    return A.thin_wrappers(d.select("file", "line", "end_line", "name", "stmt_count", F.col("wraps").alias("calls_only"), exempt.alias("exempt")))


def _flags(f: Facts, c: Config) -> DataFrame:
    looks = f.of("calls").where("(qualifier = 'os' AND selector = 'Getenv') OR (qualifier = 'flag' AND selector IN ('Bool', 'String', 'Int'))")
    looks = looks.where("size(args) > 0 AND args[0].kind = 'constant'").select("file", "line", F.col("args")[0]["text"].alias("name"), "in_condition")
    return A.feature_flags(f.of("comments").where("before_package").select("file", "line", "text"), looks)


def _dead_flags(f: Facts, c: Config) -> DataFrame:
    calls = f.of("calls").select("file", "line", "qualifier", "selector", F.when(F.expr("size(args) > 0 AND args[0].kind = 'constant'"), F.col("args")[0]["text"]).alias("literal"))
    own, uses = exported_symbols(f)
    segment = S.last_segment(F.col("folder"))
    # a package uses its own constants by their plain names
    words = f.of("funcs").select("file", F.explode("refs").alias("name")).union(f.found.select("file", F.explode("refs").alias("name"))).distinct()
    inside = words.join(f.found.select("file", segment.alias("pkg")), "file").select(F.concat_ws(".", "pkg", "name").alias("symbol"))
    return A.registered_flags(calls).unionByName(A.dead_constants(own.where("kind = 'const'"), uses.select("symbol").union(inside)))


def _members(f: Facts, c: Config) -> DataFrame:
    fields = f.of("fields").join(f.found.select("file", "is_generated"), "file")
    methods = f.of("funcs").where("recv <> ''").select("name")
    if f.tests is not None:
        methods = methods.union(go.exploded(f.tests, "funcs").where("recv <> ''").select("name"))
    return A.unused_fields(fields, f.of("selectors").select(F.col("sel").alias("name"))).unionByName(A.unimplemented_methods(f.of("iface_methods"), methods))


def _files(f: Facts, c: Config) -> DataFrame:
    """Files that could be of a package and are not: those whose names, or folders, the builder passes over, and those without a package clause."""
    candidates = f.found.where(T.is_portable_path(F.col("file")) & ~F.col("has_build_constraint"))
    return A.unused_files(candidates.select("file"), f.found.where("package IS NOT NULL AND error IS NULL AND NOT file RLIKE '(^|/)[_.]'"))


def _reexports(f: Facts, c: Config) -> DataFrame:
    name = T.project_info(f.modules).agg(F.min("module").alias("module"))
    own = go.reexports(f.found).crossJoin(F.broadcast(name))
    return A.alias_cycles(own.where(F.col("dst_pkg").startswith(F.concat("module", F.lit("/")))).select("src_pkg", F.expr("substring(dst_pkg, length(module) + 2)").alias("dst_pkg")))


def _dependencies(f: Facts, c: Config) -> DataFrame:
    imports = f.imports()
    return R.union_all([A.import_cycles(imports), A.fan_out(imports)])


def _unused_deps(f: Facts, c: Config) -> DataFrame:
    return A.unused_modules(T.requirements(f.modules), f.of("imports").select("path"))


def _overrides(f: Facts, c: Config) -> DataFrame:
    return A.unused_replacements(T.replacements(f.modules), f.of("imports").select("path"))


def call_graph(f: Facts) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) by name: a function refers to those of its package, and to methods and exported ones of any, that it names."""
    d = f.functions()
    root = F.col("name").isin("main", "init") | F.col("exported")
    nodes = d.select("fn", "name", F.col("folder").alias("pkg"), "recv", root.alias("is_root"), "exported", "file", "line", "end_line")
    refs = d.select(F.col("fn").alias("src"), F.col("folder").alias("src_folder"), F.explode("refs").alias("ref"))
    to = nodes.select(F.col("fn").alias("dst"), F.col("name").alias("ref"), F.col("pkg").alias("dst_pkg"), ((F.col("recv") != "") | F.col("exported")).alias("anywhere"))
    edges = refs.join(to, "ref").where("(src_folder = dst_pkg OR anywhere) AND src <> dst").select("src", "dst").distinct()
    return nodes, edges


def _deadcode(f: Facts, c: Config) -> DataFrame:
    nodes, edges = call_graph(f)
    # package-level variables are set before main runs; a method that is named anywhere may be called through a value
    early = f.found.select(F.col("folder").alias("pkg"), F.explode("refs").alias("name")).distinct()
    nodes = nodes.join(early.withColumn("e", F.lit(True)), ["pkg", "name"], "left").withColumn("is_root", F.col("is_root") | F.coalesce("e", F.lit(False))).drop("e")
    named = f.of("selectors").select(F.col("sel").alias("name")).distinct()
    nodes = nodes.join(named.withColumn("m", F.lit(True)), "name", "left").withColumn("is_root", F.col("is_root") | ((F.col("recv") != "") & F.coalesce("m", F.lit(False)))).drop("m")
    return A.dead_functions(nodes, edges)


def _duplication(f: Facts, c: Config) -> DataFrame:
    d = f.functions().withColumn("decl", F.col("fn"))
    whole = A.body_blocks(d, c.min_duplicate)
    n = c.min_duplicate
    w = d.where(F.size("windows") >= n).select("file", "decl", "stmt_lines", "stmt_ends", "windows", F.explode(F.sequence(F.lit(0), F.size("windows") - n)).alias("at"))
    at = F.col("at")
    w = w.select(F.sha2(F.concat(F.lit("w"), F.array_join(F.slice("windows", at + 1, n), "\n")), 256).alias("hash"), "file", F.get("stmt_lines", at).alias("line"), F.get("stmt_ends", at + n - 1).alias("end_line"), "decl")
    return A.duplication(whole.unionByName(w.where(F.col("end_line") - F.col("line") + 1 >= n)))


def _hotspots(f: Facts, c: Config) -> DataFrame:
    return A.hotspots(f.functions().where("has_body"), f.found.select("file", (F.col("end_line") - F.col("package_line") + 1).alias("lines")))


def _architecture(f: Facts, c: Config) -> DataFrame:
    return A.architecture(f.imports(), _rules(f, c))


def _rules(f: Facts, c: Config) -> DataFrame:
    return f.spark.createDataFrame(list(c.rules), "package string, must_not_use string")


def _boundary(f: Facts, c: Config) -> DataFrame:
    return A.boundary_coverage(f.found.select(F.col("folder").alias("pkg")).distinct(), _rules(f, c))


def exported_symbols(f: Facts) -> tuple[DataFrame, DataFrame]:
    """(symbols, uses) by name: a package uses what it selects from the last segment, or alias, of an import."""
    d = f.functions().where("exported AND recv = '' AND NOT is_generated")
    d = d.select("file", "line", "name", F.lit("func").alias("kind"), F.col("folder").alias("owner_pkg"), F.col("signature").alias("types"), F.lit(False).alias("injected"))
    n = f.of("names").where("exported").join(f.found.select("file", "folder", "is_generated"), "file").where("NOT is_generated")
    n = n.select("file", "line", "name", "kind", F.col("folder").alias("owner_pkg"), "types", "injected")
    own = d.unionByName(n).withColumn("symbol", F.concat_ws(".", S.last_segment(F.col("owner_pkg")), "name"))
    sel = f.of("selectors").join(f.found.select("file", F.col("folder").alias("using_pkg")), "file")
    uses = sel.join(_aliases(f), ["file", "x"]).select(F.concat_ws(".", "pkg", "sel").alias("symbol"), "using_pkg").distinct()
    return own, uses


def _aliases(f: Facts) -> DataFrame:
    """(file, x, pkg): by which name a file knows the last segment of an import."""
    return f.of("imports").select("file", F.when(F.col("alias") == "", S.last_segment(F.col("path"))).otherwise(F.col("alias")).alias("x"), S.last_segment(F.col("path")).alias("pkg"))


def type_refs(f: Facts, own: DataFrame) -> DataFrame:
    """(owner, ref): the symbols that the signature or type of a symbol names."""
    named = own.select("file", F.col("symbol").alias("owner"), S.last_segment(F.col("owner_pkg")).alias("own_pkg"), F.explode("types").alias("t"))
    named = named.withColumn("x", F.when(F.col("t").contains("."), F.substring_index("t", ".", 1))).join(_aliases(f), ["file", "x"], "left")
    return named.select("owner", F.concat_ws(".", F.when(F.col("x").isNull(), F.col("own_pkg")).otherwise(F.coalesce("pkg", "x")), F.substring_index("t", ".", -1)).alias("ref")).distinct()


def implementers(f: Facts) -> DataFrame:
    """(symbol): types that have, by name, all methods of some interface of the sources."""
    wanted = f.of("iface_methods").join(f.found.select("file", "folder"), "file").select(F.concat_ws(".", "folder", "owner").alias("iface"), "name").distinct()
    has = f.functions().where("recv <> ''").select(F.concat_ws(".", S.last_segment(F.col("folder")), F.replace("recv", F.lit("*"), F.lit(""))).alias("symbol"), "name").distinct()
    n = wanted.groupBy("iface").agg(F.count("*").alias("n"))
    return wanted.join(has, "name").groupBy("iface", "symbol").agg(F.count("*").alias("m")).join(n, "iface").where("m = n").select("symbol").distinct()


def _unused(f: Facts, c: Config) -> DataFrame:
    own, uses = exported_symbols(f)
    users = A.propagated(A.external_users(uses, own), type_refs(f, own))
    return A.unused_exports(own.where("NOT injected"), users)


def _surface(f: Facts, c: Config) -> DataFrame:
    own, uses = exported_symbols(f)
    return A.api_surface(own.withColumn("owner_pkg", F.concat(F.lit("/"), "owner_pkg", F.lit("/"))), uses.withColumn("using_pkg", F.concat(F.lit("/"), "using_pkg", F.lit("/"))), implementers(f))


def _churn(f: Facts, c: Config) -> DataFrame:
    if f.git_log is None:
        return f.spark.createDataFrame([], FINDING)
    return A.churn(f.git_log.select("file", T.is_source_path(F.col("file")).alias("is_source")))


@dataclass(frozen=True)
class Analyzer:
    """What the registry knows of an analyzer: its name, the category of its findings, what it looks for, and how."""

    name: str
    category: str
    description: str
    run: Callable[[Facts, Config], DataFrame]


class Registry(dict):
    """Analyzers by name, in the order in which they were registered."""

    def register(self, name: str, category: str, description: str, run: Callable[[Facts, Config], DataFrame]) -> None:
        if name in self:
            raise ValueError(f"{name} is registered already")
        if category not in CATEGORIES:
            raise ValueError(f"category must be one of {CATEGORIES}")
        self[name] = Analyzer(name, category, description, run)


ANALYZERS = Registry()
for _analyzer in (
    ("deadcode", "dead-code", "functions that nothing reaches", _deadcode),
    ("unused", "unused", "exported symbols that no other package uses", _unused),
    ("complexity", "complexity", "functions with many branches", _complexity),
    ("duplication", "duplication", "copies of blocks of statements", _duplication),
    ("dependencies", "dependencies", "cycles and wide fans of imports", _dependencies),
    ("architecture", "architecture", "imports that a rule forbids", _architecture),
    ("unused-deps", "unused", "required modules that nothing imports", _unused_deps),
    ("large-functions", "code-smell", "functions of many lines", _large),
    ("hotspots", "complexity", "files that are dense with branches", _hotspots),
    ("security", "code-smell", "secrets, unsafe code, query text put together", _security),
    ("naming", "code-smell", "names against the language's habits", _naming),
    ("thin-wrappers", "code-smell", "functions that only call another", _thin),
    ("churn", "code-smell", "files that change often", _churn),
    ("boundary-coverage", "architecture", "packages that no rule names", _boundary),
    ("feature-flags", "code-smell", "build tags and switches", _flags),
    ("self-recursion", "code-smell", "functions that call themselves first", _self_recursion),
    ("unused-overrides", "unused", "replaced modules that nothing imports", _overrides),
    ("dead-flags", "dead-code", "flags that are registered and constants that nothing uses", _dead_flags),
    ("api-surface", "unused", "exports that need not be", _surface),
    ("unused-members", "unused", "fields that nothing selects and methods that nothing implements", _members),
    ("unused-files", "unused", "files that belong to no package", _files),
    ("re-export-cycles", "dependencies", "packages that re-export each other", _reexports),
):
    ANALYZERS.register(*_analyzer)


def analyze(facts: Facts, config: Config = Config()) -> DataFrame:
    """The findings of all chosen analyzers, without filters.

    Each analyzer is a job of its own whose findings are stored: what is
    filtered and reported later is a scan of findings, planned quickly.
    """
    chosen = config.analyzers(list(ANALYZERS))
    if not chosen:
        return facts.spark.createDataFrame([], FINDING)
    return R.union_all([stored(ANALYZERS[n].run(facts, config), f"findings-{n}") for n in chosen])


def suppressions(facts: Facts) -> DataFrame:
    return T.suppressions(facts.of("comments").select("file", "line", "text", "decl_line"))


def run(spark: SparkSession, path: str, config: Config = Config(), baseline: DataFrame | None = None, git_log: DataFrame | None = None) -> DataFrame:
    """Findings of a folder: analysed, then without the suppressed, the less severe and the known ones."""
    facts = load(spark, path, git_log, config.ignore)
    found = R.not_suppressed(analyze(facts, config), suppressions(facts))
    found = R.severity_filter(found, config.min_severity)
    return found if baseline is None else R.baseline_diff(found, baseline)
