"""Operators on small fixtures: rules, edge cases, properties."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from siltstone.functions import scalar as S
from siltstone.operators import actions, analyzers, graph
from siltstone.operators import relational as R
from siltstone.operators import reports as P
from siltstone.schema import FINDING, FINDING_COLUMNS
from siltstone.sources import sinks
from siltstone.sources import text as T
from siltstone.streaming import streams


def rows(df, *cols):
    return sorted(tuple(r[c] for c in (cols or df.columns)) for r in df.collect())


@pytest.fixture(scope="module")
def some(spark):
    made = [
        ("deadcode", "dead-code", "warning", 'function "a" is never reached', "", "x/a.go", 10, 12, 1, "remove it", "DC001"),
        ("duplication", "duplication", "warning", "copy", "", "x/a.go", 12, 20, 1, "extract it", "DP001"),
        ("security", "code-smell", "critical", "token", "", "x/b.go", 3, 0, 1, "", "SC003"),
        ("naming", "code-smell", "hint", 'name "b_c"', "", "x/b.go", 4, None, 1, "rename it", "NM001"),
        ("complexity", "complexity", "info", "function f has complexity 31", "cognitive 0", "y/c.go", 1, 90, 1, "", "CX001"),
    ]
    return spark.createDataFrame(made, FINDING)


def nothing(spark):
    return spark.createDataFrame([], FINDING)


def test_severity_filter(some):
    assert R.severity_filter(some, "warning").count() == 3
    assert R.severity_filter(some, "no such").count() == 5


def test_baseline_of_itself_is_empty(spark, some):
    assert R.baseline_diff(some, some).count() == 0
    assert R.baseline_diff(some, nothing(spark)).count() == 5


def test_suppressions_reach_to_the_end_of_the_file(spark, some):
    s = spark.createDataFrame([("x/a.go", 11, "ignore", "deadcode"), ("x/b.go", 0, "ignore-all", "")], "file string, decl_line int, type string, analyzer string")
    assert rows(R.not_suppressed(some, s), "rule_id") == [("CX001",), ("DP001",)]
    assert R.stale_suppressions(s, some).count() == 0
    assert R.stale_suppressions(s, nothing(spark)).count() == 2


def test_overlap_takes_an_end_of_zero_as_the_line(some):
    assert rows(R.overlaps(some), "kind", "line", "second_line") == [("duplicate-and-dead", 12, 10)]


def test_owners_last_match_wins_and_negation_clears(spark):
    f = spark.createDataFrame([("docs/a.go",), ("src/b.go",), ("src/deep/c.md",)], "file string")
    got = dict(rows(R.last_match(f, [("*.go", ["@go"]), ("/src/deep", ["@deep"]), ("docs/", ["@docs"]), ("!docs/a.go", [])]), "file", "owners"))
    assert got == {"docs/a.go": [], "src/b.go": ["@go"], "src/deep/c.md": ["@deep"]}
    assert R.last_match(f, []).where("owners IS NULL").count() == 3


def test_ownership_pattern_star_stays_in_a_folder(spark):
    f = spark.createDataFrame([("a/b.go",), ("a/b/c.go",)], "file string")
    assert f.where(F.col("file").rlike(S.owners_regex("a/*"))).count() == 1


def test_glob(spark):
    f = spark.createDataFrame([("a/b/c_test.go",), ("c.go",), ("a/x.go",)], "p string")
    assert f.where(S.glob_match(F.col("p"), "**/*_test.go")).count() == 1
    assert f.where(S.glob_match(F.col("p"), "?.go")).count() == 2


def test_reports_of_nothing(spark):
    empty = nothing(spark)
    assert P.health(empty).first()["score"] == 100
    assert P.health(empty).first()["grade"] == "A"
    assert P.vital_signs(empty, empty).first()["score"] == 100
    assert json.loads(sinks.report(empty))["findings"] == []
    assert rows(P.zero_filled(empty), "n") == [(0,)] * 5
    assert P.file_scores(empty).count() == 0 and P.targets(empty).count() == 0
    assert sinks.pr_decision(empty).first()["decision"] == "success"
    assert R.verdict(R.attribute(empty, empty.select("file"))).first()["verdict"] == "pass"


def test_vital_signs_and_targets(spark, some):
    v = P.vital_signs(some, some).first()
    assert v["penalty"] == 25 + 8 + 8 + 2 + 1 and v["max_complexity"] == 31
    assert 0 <= v["score"] <= 100
    worst = P.targets(some).collect()
    assert [r["file"] for r in worst] == ["x/b.go", "x/a.go", "y/c.go"]
    assert worst[2]["recommendation"] == "refactor f (31)"


def test_target_category_tie_goes_by_name(some):
    assert {r["file"]: r["category"] for r in P.targets(some).collect()}["x/a.go"] == "dead-code"


def test_formats(some):
    for kind in sinks.FORMATS:
        assert sinks.formatted(some, kind).count() > 0
    with pytest.raises(ValueError):
        sinks.formatted(some, "no such")
    assert "score" in P.health(some).columns and "critical" in sinks.pr_comment(some)


def test_baseline_and_snapshots_on_disk(spark, some, tmp_path):
    where = str(tmp_path / "base")
    assert sinks.load_baseline(spark, where).count() == 0
    sinks.save_baseline(some, where)
    assert R.baseline_diff(some, sinks.load_baseline(spark, where)).count() == 0
    shots = str(tmp_path / "shots")
    for day in ("2024-01-02T00:00:00Z", "2024-01-01T00:00:00Z"):
        sinks.save_snapshot(some, shots, day)
    (tmp_path / "shots" / "bad.json").write_text("{not json")
    assert [r["timestamp"][:10] for r in sinks.load_snapshots(spark, shots).collect()] == ["2024-01-01", "2024-01-02"]


def test_fix_plan(some):
    assert dict(rows(actions.fix_plan(some), "rule_id", "change"))["DC001"] == "remove"
    assert actions.fix_preview(some, "naming").count() == 1


EDGES = [(1, 2), (2, 3), (3, 1), (3, 4), (5, 6)]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, "src long, dst long")


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame([(k,) for k in range(1, 8)], "node long")


def test_reach(spark, edges):
    seed = spark.createDataFrame([(2,), (None,)], "node long")
    assert rows(graph.reach(edges, seed)) == [(1,), (2,), (3,), (4,)]
    assert graph.reach(edges, seed.where("node > 9")).count() == 0


def test_reach_grows_with_edges(spark, edges):
    seed = spark.createDataFrame([(5,)], "node long")
    more = edges.union(spark.createDataFrame([(6, 7)], edges.schema))
    assert set(rows(graph.reach(edges, seed))) < set(rows(graph.reach(more, seed)))


def test_long_chain(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(30)], "src long, dst long")
    seed = spark.createDataFrame([(0,)], "node long")
    assert graph.reach(chain, seed).count() == 31
    assert graph.shortest_chain(chain, seed, 3) == [0, 1, 2, 3]
    assert graph.shortest_chain(chain, seed, 99) == []


def test_layers_put_cycles_last(edges, nodes):
    assert rows(graph.layers(nodes, edges)) == [(1, 2), (2, 2), (3, 2), (4, 2), (5, 0), (6, 1), (7, 0)]


def test_cycles(spark, edges):
    more = edges.union(spark.createDataFrame([(2, 1), (4, 4)], edges.schema))
    assert rows(graph.cycles(more)) == [([1, 2],), ([1, 2, 3],)]


def test_paths_and_gaps(spark, edges):
    start = spark.createDataFrame([(4,)], "node long")
    assert rows(graph.paths(edges, start, 2, backward=True)) == [([2, 3, 4],)]
    assert rows(graph.affected(edges, start)) == [(1,), (2,), (3,)]
    assert rows(graph.coordination_gaps(edges, start)) == [(3, 4)]


def test_module_graph_without_symbols(spark):
    i = spark.createDataFrame([("a", "b"), ("a", "z"), ("a", "a")], "src_pkg string, dst_pkg string")
    assert rows(graph.module_graph(i, spark.createDataFrame([("a",), ("b",)], "p string"))) == [("a", "b", ["*"])]


def test_duplicate_pairs_leave_out_overlaps(spark):
    b = spark.createDataFrame([("h", "f", 1, 3, "d1"), ("h", "f", 2, 4, "d1"), ("h", "g", 7, 9, "d2"), ("k", "g", 1, 3, "d3")], "hash string, file string, line int, end_line int, decl string")
    assert rows(R.duplicate_pairs(b), "file", "line", "first_line") == [("g", 7, 1)]


def test_rules_match_at_slashes(spark):
    i = spark.createDataFrame([("app/web", "app/db"), ("myweb", "db"), ("app/web", "xdb")], "src_pkg string, dst_pkg string")
    r = spark.createDataFrame([("web", "db")], "package string, must_not_use string")
    assert rows(R.rule_violations(i, r), "src_pkg", "dst_pkg") == [("app/web", "app/db")]
    p = spark.createDataFrame([("app/web",), ("lone",)], "pkg string")
    assert rows(R.uncovered_packages(p, r)) == [("lone",)]
    assert R.uncovered_packages(p, r.where("package = ''")).count() == 0


@pytest.mark.parametrize("kind, gap", [("int", 1), ("bigint", 7919), ("string", 1)])
def test_arrays_and_joins_give_the_same_graph(spark, monkeypatch, kind, gap):
    # keys of both signs, with wide gaps or without
    as_kind = lambda k: k.withColumns({c: F.expr(f"CAST(({c} - 20) * {gap} AS {kind})") for c in k.columns})
    edges = as_kind(spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (9, 4), (9, 30), (30, 31)], "src bigint, dst bigint"))
    seeds, nodes = as_kind(spark.createDataFrame([(1,), (50,)], "node bigint")), as_kind(spark.createDataFrame([(k,) for k in (1, 2, 3, 4, 9, 30, 31, 60)], "node bigint"))
    solve = lambda: [sorted(map(str, df.collect())) for df in (graph.depths(edges, seeds), graph.layers(nodes, edges))]
    local = solve()
    monkeypatch.setattr(graph, "LOCAL_EDGES", 0)
    monkeypatch.setattr(graph, "LOCAL_NAMES", 0)
    assert local == solve() and [len(x) for x in local] == [5, 8]


def test_graphs_of_millions_of_numbers_are_solved_in_one_task(spark):
    some = spark.createDataFrame([(1,)], "node bigint")
    assert graph._is_small(spark.range(3_000_000)) and not graph._is_small(spark.range(3_000_000).selectExpr("CAST(id AS string) AS src"))
    assert not graph._is_small(spark.range(1 << 24), some)


def test_reports_scan_the_edges_once(spark, tmp_path):
    spark.range(1, 50).selectExpr("id AS src", "id + 1 AS dst").write.parquet(str(tmp_path / "e"))
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    edges = spark.read.parquet(str(tmp_path / "e")).mapInArrow(seen, "src bigint, dst bigint")
    nodes = spark.range(1, 51).selectExpr("id AS fn", "'p' || id % 2 AS pkg", "id = 1 AS is_root")
    assert graph.impact_report(nodes.select("fn"), edges, nodes.where("fn = 50").select("fn")).first().affected == 49
    assert read.value == 49
    assert {r.status for r in graph.status(nodes, edges).collect()} == {"unused", "used"}
    assert read.value == 98


def test_prefixes(spark):
    m = spark.createDataFrame([("a.org/x",), ("a.org/xy",)], "module string")
    u = spark.createDataFrame([("a.org/xyz",), ("a.org/x/y",)], "path string")
    assert rows(R.prefix_unused(m, u)) == [("a.org/xy",)]
    assert R.prefix_unused(m, u, boundary=False).count() == 0


def test_analyzers_give_findings(spark):
    d = spark.createDataFrame([("f", "g", "*T", 1, 300, 46, 9, False), ("f", "h", None, 1, 60, 15, 41, False)], "file string, name string, recv string, line int, end_line int, cyclomatic int, cognitive int, is_generated boolean")
    c = analyzers.complexity(d)
    assert c.columns == FINDING_COLUMNS
    assert rows(c, "rule_id", "severity") == [("CX001", "critical"), ("CX002", "warning")]
    assert rows(analyzers.large_functions(d), "severity") == [("critical",), ("hint",)]


def test_self_recursion_needs_the_same_receiver(spark):
    d = spark.createDataFrame([(1, "f", 1, "a", None), (2, "f", 5, "b", "t")], "decl_id int, file string, line int, name string, recv_name string")
    c = spark.createDataFrame([(1, None, "a"), (2, "u", "b")], "decl_id int, qualifier string, selector string")
    assert rows(analyzers.self_recursion(d, c), "line") == [(1,)]


def test_module_file(spark):
    text = ["module a.b/c", "go 1.22", "require (", "  x.y/z v1.2.3", "  q.r/s v0.1.0 // indirect", ")", "replace (", "x.y/z => ../z", ")", "require k.l/m v1.0.0"]
    lines = spark.createDataFrame([("go.mod", k + 1, t) for k, t in enumerate(text)], "file string, line int, text string")
    assert rows(T.requirements(lines), "module", "indirect") == [("k.l/m", False), ("q.r/s", True), ("x.y/z", False)]
    assert rows(T.replacements(lines), "old_path", "line") == [("x.y/z", 8)]
    assert rows(T.project_info(lines), "module", "go_version", "requirements") == [("a.b/c", "1.22", 3)]


def test_module_files_are_laid_into_partitions_by_their_lines(spark, monkeypatch):
    monkeypatch.setattr(T, "LINES_PER_TASK", 100)
    text = ["module a.b/c", "go 1.22", "require (", "x.y/z v1.2.3", "// none v1", "alone", ")", "require k.l/m v1.0.0"]
    lines = spark.createDataFrame([(f"{f}/go.mod", k + 1, t) for f in range(50) for k, t in enumerate(text)] + [("e/go.mod", 1, "")], "file string, line int, text string")
    found = T.project_info(lines)
    assert found.rdd.getNumPartitions() == 5
    assert found.count() == 51
    assert rows(found.where("requirements > 0").select("module", "go_version", "requirements").distinct()) == [("a.b/c", "1.22", 2)]
    assert [tuple(r) for r in found.where("file = 'e/go.mod'").collect()] == [("e/go.mod", None, None, 0)]


def test_read_lines(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "OWNERS").write_text("# x\n*.go @a @b\n!docs/ @c\n")
    got = T.ownership(T.read_lines(spark, str(tmp_path), "OWNERS"))
    assert rows(got, "rule_idx", "pattern", "is_negation") == [(0, "*.go", False), (1, "docs/", True)]


def test_config():
    got = T.parse_config("severity:\n  min: info\nanalyzers:\n  enabled:\n    - naming\n    - 'churn'\n  most: 3\nrules: [a, b]\n")
    assert got == {"severity": {"min": "info"}, "analyzers": {"enabled": ["naming", "churn"], "most": 3}, "rules": ["a", "b"]}


def test_paths_of_sources(spark):
    p = spark.createDataFrame([("a/b.go",), ("a/b_test.go",), ("a/b_linux.go",), ("vendor/x.go",), ("docs/a.go",), ("README.md",)], "p string")
    assert rows(p.where(T.is_portable_path(F.col("p")))) == [("a/b.go",), ("docs/a.go",)]
    assert rows(p.where(T.is_source_path(F.col("p")))) == [("a/b.go",), ("a/b_linux.go",), ("vendor/x.go",)]


def test_debounce_on_a_stream(spark, tmp_path):
    made = [("a", f"2024-01-01 00:00:0{k}") for k in (0, 1, 5)] + [("b", "2024-01-01 00:10:00")]
    source = spark.createDataFrame(made, "key string, ts string").withColumn("ts", F.to_timestamp("ts"))
    source.write.parquet(str(tmp_path / "in"))
    stream = streams.debounced(streams.watch(spark, str(tmp_path / "in"), "key string, ts timestamp"), "2 seconds")
    q = stream.writeStream.format("memory").queryName("bursts").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    # what the watermark has not passed is given out later
    assert rows(spark.table("bursts"), "key", "changes") == [("a", 1), ("a", 2)]
    assert streams.debounced(source, "2 seconds").count() == 3


def test_reanalysis_of_batches(spark, some, tmp_path):
    some.write.parquet(str(tmp_path / "in"))
    stream = streams.watch(spark, str(tmp_path / "in"), FINDING)
    streams.reanalyse(stream, lambda b: R.severity_filter(b, "warning"), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_file_changes(spark):
    s = "path string, mtime int"
    a, b = spark.createDataFrame([("x", 1), ("y", 1)], s), spark.createDataFrame([("x", 2), ("z", 1)], s)
    assert rows(R.file_changes(a, b)) == [("x", "modified"), ("y", "deleted"), ("z", "added")]
