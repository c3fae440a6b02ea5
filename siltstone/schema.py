"""The relations that operators read and write, and the constants of the rules."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

#: The one output row of every analyzer.
FINDING_COLUMNS = ["analyzer", "category", "severity", "message", "detail", "file", "line", "end_line", "col", "suggestion", "rule_id"]
FINDING = (
    "analyzer string, category string, severity string, message string, detail string, file string, "
    "line int, end_line int, col int, suggestion string, rule_id string"
)

SEVERITIES = ["critical", "warning", "info", "hint"]
WEIGHTS = {"critical": 25, "warning": 8, "info": 2, "hint": 1}
CATEGORIES = ["dead-code", "unused", "complexity", "duplication", "dependencies", "architecture", "code-smell"]
GRADES = [(90, "A"), (80, "B"), (70, "C"), (60, "D"), (50, "E")]

#: Analyzer pairs whose overlapping findings are reported together, and as what.
OVERLAP_KINDS = [
    ("duplication", "deadcode", "duplicate-and-dead"),
    ("duplication", "unused", "duplicate-and-unused"),
    ("complexity", "large-functions", "complex-and-large"),
    ("security", "deadcode", "security-and-dead"),
]

#: (rule, what it is, pattern); written so that RE2 and Java read it alike.
SECRETS = [
    ("SC001", "API key in the text", r"(?i)api[-_]?key\s*[=:]\s*['\"][0-9a-z]{20,}['\"]"),
    ("SC002", "password in the text", r"(?i)(?:pass(?:wor|w)d|pwd)\s*[=:]\s*['\"][^'\"]{4,}['\"]"),
    ("SC003", "token in the text", r"(?i)(?:bearer|secret|token)\s*[=:]\s*['\"][-.\w]{20,}['\"]"),
    ("SC004", "cloud access key", r"AKIA[A-Z0-9]{16}"),
    ("SC005", "private key", r"-----BEGIN (?:(?:DSA|EC|RSA) )?PRIVATE KEY-----"),
]
TODO = r"\b(?:BUG|XXX|HACK|FIXME|TODO)\b[\s:]"
#: Initialisms that should be all capitals, as they are when they are not.
INITIALISMS = ["Api", "Html", "Http", "Https", "Id", "Ip", "Json", "Sql", "Ssl", "Tcp", "Udp", "Url", "Xml"]
SQL_WORDS = ["select", "insert", "update", "delete", "from", "where", "join", "values", "set", "drop", "create", "alter"]


@dataclass
class Catalog:
    """Queries by name, and the SQL of those that SQL can express."""

    queries: dict[str, Callable[[SparkSession, str], DataFrame]] = field(default_factory=dict)
    sql: dict[str, str] = field(default_factory=dict)

    def add(self, name: str, sql: str | None = None):
        """Registers the decorated function under ``name``."""

        def register(f):
            if name in self.queries:
                raise ValueError(f"{name} is registered already")
            self.queries[name] = f
            if sql is not None:
                self.sql[name] = sql
            return f

        return register

    def merge(self, *others: Catalog) -> Catalog:
        for other in others:
            for name, f in other.queries.items():
                self.add(name, other.sql.get(name))(f)
        return self
