"""Settings of an analysis, from defaults, a file and the caller, the later ones first."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, replace

from siltstone.schema import SEVERITIES
from siltstone.sources.text import parse_config

FILE_NAMES = [".siltstone.yaml", ".siltstone.yml"]


@dataclass(frozen=True)
class Config:
    enabled: tuple[str, ...] = ()
    disabled: tuple[str, ...] = ()
    min_severity: str = "warning"
    ignore: tuple[str, ...] = ()
    rules: tuple[tuple[str, str], ...] = ()
    max_cyclomatic: int = 15
    max_cognitive: int = 20
    max_function_lines: int = 50
    min_duplicate: int = 6
    extra: dict = field(default_factory=dict)

    def analyzers(self, known: list[str]) -> list[str]:
        """The enabled ones (all, if none is named) in their order, without the disabled ones; unknown names are dropped."""
        wanted = [n for n in self.enabled if n in known] if self.enabled else list(known)
        return [n for n in wanted if n not in self.disabled]


#: Layers of common designs: which may not use which.
RULE_PACKS: dict[str, dict] = {
    "clean-architecture": {"rules": [("domain", "infrastructure"), ("domain", "interfaces"), ("usecase", "infrastructure"), ("usecase", "interfaces")], "max_cyclomatic": 10},
    "hexagonal": {"rules": [("core", "adapters"), ("core", "ports/http"), ("ports", "adapters")], "max_cyclomatic": 12},
    "microservice": {"rules": [("service", "handler"), ("repository", "handler"), ("repository", "service")], "max_cyclomatic": 15},
    "library": {"rules": [("pkg", "cmd"), ("internal", "cmd")], "max_cyclomatic": 12, "max_function_lines": 40},
    "monolith": {"rules": [("model", "controller"), ("model", "view")], "max_cyclomatic": 20},
}


def with_pack(config: Config, name: str) -> Config:
    """The settings with a rule pack: its rules added once each, its limits taken over."""
    if name not in RULE_PACKS:
        raise ValueError(f"rule packs are {sorted(RULE_PACKS)}")
    pack = dict(RULE_PACKS[name])
    rules = tuple(dict.fromkeys([*config.rules, *pack.pop("rules")]))
    return replace(config, rules=rules, **pack)


def parse_rule(text: str) -> tuple[str, str]:
    """("A", "B") of "A must not import B"."""
    left, found, right = text.partition(" must not import ")
    if not found or not left.strip() or not right.strip():
        raise ValueError(f"not a rule: {text!r}")
    return left.strip(), right.strip()


def severity(text: str) -> str:
    low = text.strip().lower()
    if low not in SEVERITIES:
        raise ValueError(f"severity must be one of {SEVERITIES}")
    return low


def from_text(text: str) -> Config:
    """Settings of a file; unknown keys are kept in ``extra``."""
    d = parse_config(text)
    a, limits = d.get("analyzers") or {}, d.get("thresholds") or {}
    c = Config(
        enabled=tuple(a.get("enabled") or ()), disabled=tuple(a.get("disabled") or ()), ignore=tuple(d.get("ignore") or ()),
        rules=tuple(parse_rule(r) for r in d.get("rules") or ()), extra={k: v for k, v in d.items() if k not in ("analyzers", "thresholds", "ignore", "rules", "severity")},
    )
    least = (d.get("severity") or {}).get("min")
    known = {k: v for k, v in limits.items() if k in ("max_cyclomatic", "max_cognitive", "max_function_lines", "min_duplicate")}
    return replace(c, **known, **({"min_severity": severity(least)} if least else {}))


def find(folder: str) -> str | None:
    """The settings file of a folder or the nearest one above."""
    at = os.path.abspath(folder)
    while True:
        for name in FILE_NAMES:
            if os.path.exists(os.path.join(at, name)):
                return os.path.join(at, name)
        if os.path.dirname(at) == at:
            return None
        at = os.path.dirname(at)


#: Names of other linters' checks in a list of theirs, to analyzers here.
def migrated(checks: list[str]) -> Config:
    """Settings that do what other linters' checks do; unknown checks are dropped."""
    from siltstone.functions.scalar import LINTERS

    return Config(enabled=tuple(dict.fromkeys(LINTERS[c][0] for c in checks if c in LINTERS)))
