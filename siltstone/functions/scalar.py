"""Scalar functions as Column expressions; all stay in the JVM.

A null argument gives null unless said otherwise.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.schema import GRADES, SEVERITIES, SQL_WORDS, WEIGHTS


def choose(key: Column, table: dict[str, object], otherwise: object = None) -> Column:
    """The table's value of a key."""
    out = None
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(otherwise))


def short_path(path: Column, parts: int = 3) -> Column:
    """The last components of a path; shorter paths as they are."""
    split = F.split(path, "/")
    return F.when(F.size(split) > parts, F.array_join(F.slice(split, -parts, parts), "/")).otherwise(path)


def last_segment(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def components(path: Column | str, k: Column) -> Column:
    """The first k components of a path, or with a negative k the last ones."""
    return F.call_function("substring_index", F.col(path) if isinstance(path, str) else path, F.lit("/"), k)


def base_name(path: Column) -> Column:
    return last_segment(path)


def _capitalised(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, 2, 1 << 30))


def to_camel(name: Column) -> Column:
    """snake_case joined; the first letter of each later part is a capital, the rest stays."""
    parts = F.split(name, "_")
    rest = F.transform(F.slice(parts, 2, 1 << 20), _capitalised)
    return F.concat(F.element_at(parts, 1), F.array_join(rest, ""))


def to_pascal(name: Column) -> Column:
    """As :func:`to_camel`, the first letter a capital too."""
    return _capitalised(to_camel(name))


def to_camel_lower(name: Column) -> Column:
    """As :func:`to_camel`, the rest of each later part in lower case."""
    parts = F.split(name, "_")
    rest = F.transform(F.slice(parts, 2, 1 << 20), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30))))
    return F.concat(F.element_at(parts, 1), F.array_join(rest, ""))


def is_all_caps(name: Column, allowed: list[str]) -> Column:
    """Capitals, digits and underscores only, and no allowed initialism."""
    return name.rlike(r"^[A-Z0-9_]*[A-Z][A-Z0-9_]*$") & ~name.isin(allowed)


def grade_for(score: Column) -> Column:
    out = None
    for least, grade in GRADES:
        out = F.when(score >= least, grade) if out is None else out.when(score >= least, grade)
    return out.otherwise("F")


def severity_weight(severity: Column) -> Column:
    return choose(severity, WEIGHTS, 0)


def severity_rank(severity: Column, unknown: int | None = 4) -> Column:
    return choose(severity, {s: k for k, s in enumerate(SEVERITIES)}, unknown)


def parse_severity(text: Column) -> Column:
    """The severity that a text names; an unknown one, and null, is a hint."""
    low = F.lower(F.trim(text))
    return F.when(low.isin(SEVERITIES), low).otherwise("hint")


def sarif_level(severity: Column) -> Column:
    return choose(severity, {"critical": "error", "warning": "warning"}, "note")


def codeclimate_severity(severity: Column) -> Column:
    return choose(severity, {"critical": "blocker", "warning": "major", "info": "minor", "hint": "info"}, "info")


def lsp_severity(severity: Column) -> Column:
    return choose(severity, {"critical": 1, "warning": 2, "info": 3, "hint": 4}, 3)


def icon(severity: Column) -> Column:
    return choose(severity, {"critical": "✗", "warning": "!", "info": "i", "hint": "·"}, "?")


def fingerprint(file: Column, line: Column, rule: Column) -> Column:
    return F.sha2(F.concat_ws(":", file, line.cast("string"), rule), 256)


def extract_between(text: Column, start: str, end: str) -> Column:
    """What is between the first start and the next end (or the text's end); empty without a start."""
    at = F.instr(text, start)
    tail = F.substring(text, at + len(start), F.length(text))
    return F.when(at > 0, F.substring_index(tail, end, 1)).otherwise(F.lit(""))


def extract_symbol(message: Column) -> Column:
    """The first text in double quotes, else the first word, else empty."""
    quoted = F.regexp_extract(message, '"([^"]*)"', 1)
    return F.when(message.rlike('"[^"]*"'), quoted).otherwise(F.regexp_extract(message, r"(\S+)", 1))


def trailing_number(text: Column) -> Column:
    """The last run of digits as a number; 0 without one."""
    digits = F.regexp_extract(text, r"([0-9]+)[^0-9]*$", 1)
    return F.when(digits == "", 0).otherwise(F.substring(digits, -9, 9).cast("int"))


def complexity_of(detail: Column, message: Column) -> Column:
    """The last number of the detail, or, where that is not positive, of the message."""
    d, m = F.coalesce(trailing_number(detail), F.lit(0)), F.coalesce(trailing_number(message), F.lit(0))
    return F.when(d > 0, d).otherwise(m)


def glob_to_regex(pattern: str) -> str:
    """A path glob as a regular expression; ``*`` and ``?`` stay within a component, ``**`` does not."""
    out, k = "", 0
    while k < len(pattern):
        c = pattern[k]
        if pattern[k : k + 2] == "**":
            out, k = out + ".*", k + 2
            continue
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and "]" in pattern[k + 1 :]:
            end = pattern.index("]", k + 1)
            out += "[" + pattern[k + 1 : end].replace("\\", "\\\\") + "]"
            k = end
        else:
            out += re.sub(r"([^\w/])", r"\\\1", c)
        k += 1
    return f"^{out}$"


def glob_match(path: Column, pattern: str) -> Column:
    """Whether a glob matches a path, or, without ``**``, its base name."""
    regex = glob_to_regex(pattern)
    return path.rlike(regex) if "**" in pattern else path.rlike(regex) | base_name(path).rlike(regex)


def owners_regex(pattern: str) -> str:
    """An ownership pattern as one regular expression on paths.

    With a wildcard: the whole path, or the base name where the pattern has no
    slash.  With a leading slash: a prefix of the path.  With a trailing one:
    a folder of that ending anywhere.  Else: the path, what is under it, or a
    path that ends in it.
    """
    if "*" in pattern:
        inner = glob_to_regex(pattern)[1:-1]
        return f"^{inner}$" if "/" in pattern else f"^(?:.*/)?{inner}$"
    plain = lambda s: re.sub(r"([^\w/])", r"\\\1", s)
    if pattern.startswith("/"):
        return "^" + plain(pattern[1:])
    if pattern.endswith("/"):
        stem = plain(pattern[:-1])
        return f"{stem}/|^{stem}$"
    return f"^{plain(pattern)}(?:/|$)|/{plain(pattern)}$"


def parse_rule(text: Column) -> tuple[Column, Column]:
    """(package, must_not_use) of "A must not import B"; nulls where it is no such rule."""
    parts = F.split(text, " must not import ", 2)
    ok = F.size(parts) == 2
    return F.when(ok, F.trim(parts[0])), F.when(ok, F.trim(parts[1]))


def is_operational(name: Column) -> Column:
    """Environment variables that switch no feature."""
    return F.upper(F.trim(name)).rlike("(_READ_?ONLY|_DEBUG|_VERBOSE)$")


def looks_like_sql(text: Column) -> Column:
    return F.lower(text).rlike(r"\b(?:" + "|".join(SQL_WORDS) + r")\b")


def format_minutes(minutes: Column) -> Column:
    """``2h 5m``, or ``5m`` below an hour."""
    h, m = F.floor(minutes / 60).cast("long"), (minutes % 60).cast("long")
    return F.when(h > 0, F.concat(h.cast("string"), F.lit("h "), m.cast("string"), F.lit("m"))).otherwise(F.concat(m.cast("string"), F.lit("m")))


def format_millis(ms: Column) -> Column:
    """Whole milliseconds below a second, else whole seconds."""
    return F.when(ms < 1000, F.concat(ms.cast("long").cast("string"), F.lit("ms"))).otherwise(F.concat(F.floor(ms / 1000).cast("string"), F.lit("s")))


def snapshot_name(at: Column) -> Column:
    return F.concat(F.date_format(at, "yyyy-MM-dd-HHmmss"), F.lit(".json"))


def effort_for(category: Column) -> Column:
    return choose(category, {"dead-code": "S", "duplication": "M", "complexity": "L", "security": "XL"}, "M")


def confidence_for(critical: Column, warning: Column, total: Column) -> Column:
    return F.when((critical > 0) | (warning >= 3), "high").when((warning > 0) | (total >= 5), "medium").otherwise("low")


def truncate(text: Column, most: int) -> Column:
    """Texts of more than ``most`` bytes cut, with an ellipsis, to as many characters."""
    return F.when(F.octet_length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def uri_to_path(uri: Column) -> Column:
    return F.regexp_replace(uri, "^file://", "")


def path_to_uri(path: Column) -> Column:
    return F.concat(F.lit("file://"), path)


#: Checks of other linters, and the analyzer that does what they do.
LINTERS = {
    "U1000": ("unused", "warning"), "unused": ("unused", "warning"), "deadcode": ("deadcode", "warning"), "gocyclo": ("complexity", "warning"),
    "cyclop": ("complexity", "warning"), "gocognit": ("complexity", "warning"), "dupl": ("duplication", "warning"), "funlen": ("large-functions", "info"),
    "gosec": ("security", "critical"), "revive": ("naming", "hint"), "depguard": ("architecture", "critical"), "godox": ("security", "info"),
}


def linter_analyzer(name: Column) -> Column:
    return choose(name, {k: a for k, (a, _) in LINTERS.items()})


def linter_severity(name: Column) -> Column:
    return choose(name, {k: s for k, (_, s) in LINTERS.items()}, "hint")


def clean_func_name(full: Column) -> Column:
    """``pkg/path.(*Type).Method`` and the like as ``Type.Method``; plain functions by their name."""
    tail = last_segment(full)
    return F.regexp_replace(F.regexp_replace(tail, r"^[^.()]*\.", ""), r"[()*]", "")


def func_label(recv: Column, name: Column) -> Column:
    """``(Recv).Name`` or ``Name``; the pointer mark of the receiver goes; "unknown" without a name."""
    own = F.regexp_replace(F.coalesce(recv, F.lit("")), r"^\*", "")
    return F.when(F.coalesce(name, F.lit("")) == "", "unknown").when(own == "", name).otherwise(F.concat(F.lit("("), own, F.lit(")."), name))


def has_suffix(package: Column, suffix: Column) -> Column:
    """Whether a package path is, or ends at a slash in, the suffix."""
    return (package == suffix) | package.endswith(F.concat(F.lit("/"), suffix))


def sparkline_block(score: Column) -> Column:
    """One of eight bars for a score from 0 to 100."""
    at = F.greatest(F.lit(0), F.least(F.lit(7), F.floor(score * 8 / 101))).cast("int")
    return F.element_at(F.array(*(F.lit(c) for c in "▁▂▃▄▅▆▇█")), at + 1)
