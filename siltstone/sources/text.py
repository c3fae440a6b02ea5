"""Readers of text files: module files, ownership files, rules, paths.

Files are rows (file, line, text), as :func:`read_lines` gives them; block
state is a running sum by line within a file, so files are read in parallel.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

OTHER_FILES = r"(?i)\.(?:md|txt|json|ya?ml|toml|lock|sum|mod|sh|css|html|svg|png|jpe?g)$|(?:^|/)(?:Makefile|Dockerfile|LICENSE|CHANGELOG)$"
PLATFORMS = "_(?:linux|darwin|windows|freebsd|netbsd|openbsd|solaris|plan9|js|wasm|amd64|arm|arm64|386|riscv64)"


def stripped(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def read_lines(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(file, line, text) of the files below a folder; lines from 1."""
    whole = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=True)
    files = whole.select(F.col("_metadata.file_path").alias("file"), F.col("value"))
    return files.select("file", F.posexplode(F.split("value", "\r?\n")).alias("at", "text")).select("file", (F.col("at") + 1).alias("line"), "text")


def is_source_path(path: Column) -> Column:
    """Neither a test nor documentation, data or configuration."""
    return ~path.rlike(r"_test\.go$") & ~path.rlike(OTHER_FILES) & ~path.rlike("^(?:docs|[.]github)/")


def is_portable_path(path: Column) -> Column:
    """A Go file for every platform, outside folders that hold no code of the project, and no test."""
    return path.rlike(r"\.go$") & ~path.rlike(rf"(?:_test|{PLATFORMS})\.go$") & ~path.rlike(r"(?:^|/)(?:vendor|\.git|node_modules|testdata)/")


def is_generated_path(path: Column) -> Column:
    return path.rlike("/(?:storedb|sqlc|mocks?|gen|generated)/")


def has_build_constraint(head: Column) -> Column:
    """Whether one of the first ten lines is a build constraint."""
    return F.exists(F.slice(F.split(head, "\n"), 1, 10), lambda x: x.rlike(r"^//(?:go:build| ?\+build)\b"))


#: Lines that one task sorts.
LINES_PER_TASK = 1 << 18


def _bodies(lines: DataFrame, word: str) -> DataFrame:
    """(file, line, t, body) of all lines: stripped, and what they have of one-line and block statements that begin with a word.

    Files are laid into a number of partitions that grows with the lines, so
    what a task sorts does not.
    """
    lines = lines.repartition(max(1, -(-lines.count() // LINES_PER_TASK)), "file")
    text = stripped(F.col("text"))
    opens = text.rlike(rf"^{word}\s*\($")
    closes = text == ")"
    begins = text.rlike(r"^\w+\s*\($")
    along = W.partitionBy("file").orderBy("line")
    # a line is inside the block whose opening line is the last one that opened or closed any
    state = F.last(F.when(opens, True).when(begins | closes, False), True).over(along)
    rows = lines.select("file", "line", text.alias("t"), F.coalesce(state, F.lit(False)).alias("inside"), opens.alias("opens"))
    single = F.col("t").rlike(rf"^{word}\s+[^(]")
    body = F.when(single, F.regexp_replace("t", rf"^{word}\s+", "")).when(F.col("inside") & ~F.col("opens"), F.col("t"))
    return rows.select("file", "line", "t", body.alias("body"))


_STATED = "body IS NOT NULL AND body <> '' AND NOT startswith(body, '//')"


def _statements(lines: DataFrame, word: str) -> DataFrame:
    """(file, line, body) of the one-line and block statements that begin with a word."""
    return _bodies(lines, word).select("file", "line", "body").where(_STATED)


def requirements(lines: DataFrame) -> DataFrame:
    """(file, line, module, version, indirect) of module files."""
    rows = _statements(lines, "require")
    parts = F.split("body", r"\s+", 2)
    return rows.select("file", "line", parts[0].alias("module"), parts[1].alias("version"), F.col("body").contains("// indirect").alias("indirect")).where("version IS NOT NULL")


def replacements(lines: DataFrame) -> DataFrame:
    """(file, line, old_path, new_path) of module files."""
    rows = _statements(lines, "replace").where(F.col("body").contains("=>"))
    side = lambda k: stripped(F.split("body", "=>", 2)[k])
    return rows.select("file", "line", F.split(side(0), r"\s+")[0].alias("old_path"), side(1).alias("new_path"))


def project_info(lines: DataFrame) -> DataFrame:
    """(file, module, go_version, requirements) of module files.

    One aggregate over the files' lines, which are together and in order already.
    """
    t = F.col("t")
    return _bodies(lines, "require").groupBy("file").agg(
        F.max(F.when(t.rlike(r"^module\s"), F.regexp_extract(t, r"^module\s+(\S+)", 1))).alias("module"),
        F.max(F.when(t.rlike(r"^go\s"), F.regexp_extract(t, r"^go\s+(\S+)", 1))).alias("go_version"),
        F.count_if(F.expr(_STATED) & (F.size(F.split("body", r"\s+", 2)) > 1)).alias("requirements"),
    )


def git_log_files(lines: DataFrame, since: str | None = None) -> DataFrame:
    """(commit, ts, file) of the output of ``git log --name-only --date=iso-strict --pretty=format:'commit %H %ad'`` as (file, line, text) rows.

    The commit of a file's line is the last commit line before it in the same
    output; ``since`` leaves out earlier commits.
    """
    head = r"^commit ([0-9a-f]+) (\S+)$"
    along = W.partitionBy("file").orderBy("line")
    found = F.when(F.col("text").rlike(head), F.struct(F.regexp_extract("text", head, 1).alias("commit"), F.regexp_extract("text", head, 2).alias("ts")))
    rows = lines.withColumn("c", F.last(found, True).over(along)).where(~F.col("text").rlike(head) & (F.col("text") != "") & F.col("c").isNotNull())
    rows = rows.select("c.commit", F.to_timestamp("c.ts").alias("ts"), F.col("text").alias("file"))
    return rows if since is None else rows.where(F.col("ts") >= F.lit(since).cast("timestamp"))


def git_diff_files(lines: DataFrame) -> DataFrame:
    """(file): the files that the output of ``git diff --name-only`` names, as rows with text."""
    return lines.select(stripped(F.col("text")).alias("file")).where("file <> ''").distinct()


def ownership(lines: DataFrame) -> DataFrame:
    """(file, rule_idx, pattern, owners, is_negation) of ownership files."""
    t = stripped(F.col("text"))
    rows = lines.select("file", "line", t.alias("t")).where("t <> '' AND NOT startswith(t, '#')")
    parts = F.split(F.regexp_replace("t", "^!", ""), r"\s+")
    order = W.partitionBy("file").orderBy("line")
    return rows.select("file", (F.row_number().over(order) - 1).alias("rule_idx"), parts[0].alias("pattern"), F.slice(parts, 2, 1 << 20).alias("owners"), F.col("t").startswith("!").alias("is_negation"))


_DIRECTIVE = r"^//\s*siltstone:(keep|ignore-all|ignore)\b[ \t]*(\S*)"


def suppressions(comments: DataFrame) -> DataFrame:
    """(file, comment_line, decl_line, type, analyzer, text) of comments (file, line, text, decl_line).

    A directive that ignores one analyzer holds for its file too, from line 0.
    """
    kind, name = F.regexp_extract("text", _DIRECTIVE, 1), F.regexp_extract("text", _DIRECTIVE, 2)
    rows = comments.select("file", F.col("line").alias("comment_line"), F.coalesce("decl_line", F.lit(0)).alias("decl_line"), kind.alias("type"), name.alias("analyzer"), stripped(F.col("text")).alias("text")).where("type <> ''")
    rows = rows.withColumn("analyzer", F.when((F.col("type") == "ignore") & (F.col("analyzer") == ""), "*").when(F.col("type") == "keep", "*").otherwise(F.col("analyzer")))
    lines = F.when((F.col("type") == "ignore") & (F.col("analyzer") != "*"), F.array_distinct(F.array(F.lit(0), "decl_line"))).otherwise(F.array("decl_line"))
    return rows.withColumn("decl_line", F.explode(lines))


def parse_config(text: str) -> dict:
    """A small subset of YAML: nested mappings by indentation, lists of scalars, scalars."""
    root: dict = {}
    stack: list[tuple[int, dict | list]] = [(-1, root)]
    waiting: tuple[dict, str] | None = None
    for raw in text.splitlines():
        line = re.sub(r"(^|\s)#.*$", "", raw).rstrip()
        if not line.strip():
            continue
        depth = len(line) - len(line.lstrip())
        body = line.strip()
        if waiting and depth > stack[-1][0] or (waiting and body.startswith("- ") and depth >= stack[-1][0]):
            holder, key = waiting
            holder[key] = [] if body.startswith("- ") else {}
            stack.append((depth - 1 if body.startswith("- ") else depth - 1, holder[key]))
        waiting = None
        while len(stack) > 1 and depth <= stack[-1][0]:
            stack.pop()
        top = stack[-1][1]
        if body.startswith("- "):
            if isinstance(top, list):
                top.append(_scalar(body[2:]))
        elif isinstance(top, dict) and ":" in body:
            key, _, value = body.partition(":")
            if value.strip():
                top[key.strip()] = _scalar(value.strip())
            else:
                top[key.strip()] = None
                waiting = (top, key.strip())
    return root


def _scalar(text: str):
    text = text.strip()
    if text.startswith("[") and text.endswith("]"):
        return [_scalar(x) for x in text[1:-1].split(",") if x.strip()]
    if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"":
        return text[1:-1]
    if re.fullmatch(r"-?\d+", text):
        return int(text)
    return {"true": True, "false": False, "null": None}.get(text, text)
