"""Style rules: the data type, rule files, overlays and their validation. Rules are metadata and stay on the driver."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property
from pathlib import Path
from typing import Any

import yaml

from quillspark.functions.regex import Untranslatable, to_java
from quillspark.operators.builtin_rules import builtin_entries, overlay_entries

SEVERITIES = ("warn", "info")
DETECTORS = ("repeated_openings", "negative_listing", "manufactured_staccato", "fragmented_header", "boldface_density", "connector_openers")
MAX_DEPTH = 16
#: Names that stand for rule sets of this package.
BUILTIN, ANTI_AI = "builtin", "anti-ai"

_REQUIRED = ("id", "severity", "detector", "message")
_ALLOWED = (*_REQUIRED, "exceptions", "enabled")


class RuleError(ValueError):
    """A rule file that cannot be used."""


@dataclass(frozen=True)
class Rule:
    id: str
    severity: str
    detector: str
    message: str
    exceptions: tuple[str, ...] = ()

    @property
    def named(self) -> bool:
        return self.detector in DETECTORS

    @cached_property
    def java(self) -> str:
        return to_java(self.detector)


def _text(raw: Mapping[str, Any], field: str, where: str) -> str:
    value = raw.get(field)
    if not isinstance(value, str) or not value.strip():
        raise RuleError(f"{where}: {field!r} must be a nonempty string")
    return value


def make_rule(raw: Any, where: str) -> Rule:
    if not isinstance(raw, Mapping):
        raise RuleError(f"{where} must be a mapping")
    absent = [f for f in _REQUIRED if f not in raw]
    if absent:
        raise RuleError(f"{where} lacks {', '.join(absent)}")
    fields = {f: _text(raw, f, where) for f in _REQUIRED}
    if fields["severity"] not in SEVERITIES:
        raise RuleError(f"{where}: severity {fields['severity']!r} is none of {', '.join(SEVERITIES)}")
    exceptions = raw.get("exceptions", [])
    if not isinstance(exceptions, list) or not all(isinstance(x, str) for x in exceptions):
        raise RuleError(f"{where}: exceptions must be a list of strings")
    rule = Rule(**fields, exceptions=tuple(exceptions))
    if not rule.named:
        if re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", rule.detector):
            raise RuleError(f"{where}: {rule.detector!r} is no named detector; a word is written as (?i)\\bword\\b")
        try:
            rule.java  # noqa: B018
        except (re.error, Untranslatable) as error:
            raise RuleError(f"{where}: unusable pattern: {error}") from error
    return rule


def read_yaml(path: Path) -> Any:
    try:
        return yaml.safe_load(path.read_text(encoding="utf-8"))
    except OSError as error:
        raise RuleError(f"cannot read rules from {path}: {error}") from error
    except (yaml.YAMLError, UnicodeDecodeError) as error:
        raise RuleError(f"{path} is no valid YAML: {error}") from error


def _entries(path: Path) -> tuple[list[Any], Any]:
    """A file's own entries and what it extends."""
    document = read_yaml(path)
    entries = document.get("rules") if isinstance(document, Mapping) else document
    if not isinstance(entries, list):
        raise RuleError(f"{path} must be a list of rules, or a mapping with such a list as 'rules'")
    return entries, document.get("extends") if isinstance(document, Mapping) else None


def merge_overlay(base: Sequence[Any], overlay: Sequence[Any], where: str) -> list[Any]:
    """An ordered upsert by id: fields replaced in place, disabled rules dropped, new ones appended."""
    merged: dict[Any, Any] = {(x.get("id") if isinstance(x, Mapping) else None) or ("", n): x for n, x in enumerate(base)}
    met: set[str] = set()
    for n, entry in enumerate(overlay):
        if not isinstance(entry, Mapping):
            raise RuleError(f"{where}: entry {n} must be a mapping")
        rule_id = _text(entry, "id", f"{where}: entry {n}")
        extra = sorted(str(k) for k in entry if k not in _ALLOWED)
        if extra:
            raise RuleError(f"{where}: {rule_id!r} has unknown fields: {', '.join(extra)}")
        if rule_id in met:
            raise RuleError(f"{where}: {rule_id!r} occurs twice")
        met.add(rule_id)
        fields = {k: v for k, v in entry.items() if k != "enabled"}
        off = entry.get("enabled") is False
        if rule_id in merged and off:
            del merged[rule_id]
        elif rule_id in merged:
            merged[rule_id] = {**merged[rule_id], **fields}
        elif off:
            raise RuleError(f"{where}: {rule_id!r} is disabled but not known")
        else:
            absent = [f for f in _REQUIRED if f not in entry]
            if absent:
                raise RuleError(f"{where}: new rule {rule_id!r} lacks {', '.join(absent)}")
            merged[rule_id] = fields
    return list(merged.values())


def effective_entries(path: str | Path) -> list[Any]:
    """Entries of a rule file after its chain of ``extends``, or of a rule set of this package."""
    if path == BUILTIN:
        return list(builtin_entries())
    if path == ANTI_AI:
        return merge_overlay(builtin_entries(), overlay_entries(), ANTI_AI)
    layers: list[tuple[list[Any], Path]] = []
    base: list[Any] | None = None
    at, passed = Path(path).resolve(), set()
    while True:
        if len(passed) >= MAX_DEPTH + 1:
            raise RuleError(f"'extends' goes deeper than {MAX_DEPTH} files at {at}")
        passed.add(at)
        entries, parent = _entries(at)
        layers.append((entries, at))
        if parent is None:
            break
        if not isinstance(parent, str) or not parent.strip():
            raise RuleError(f"'extends' of {at} must be a nonempty string")
        if parent == BUILTIN:
            base = list(builtin_entries())
            break
        target = (at.parent / parent).resolve()
        if not target.is_file():
            raise RuleError(f"'extends' of {at} names no file: {target}")
        if target in passed:
            raise RuleError(f"'extends' of {at} leads back to {target}")
        at = target
    out = layers.pop()[0] if base is None else base
    while layers:
        entries, where = layers.pop()
        out = merge_overlay(out, entries, str(where))
    return list(out)


def load_rules(path: str | Path = BUILTIN) -> list[Rule]:
    rules: list[Rule] = []
    for n, raw in enumerate(effective_entries(path)):
        name = raw.get("id") if isinstance(raw, Mapping) else None
        rules.append(make_rule(raw, f"rule {name!r}" if isinstance(name, str) and name.strip() else f"rule at {n}"))
    ids = [r.id for r in rules]
    again = sorted({x for x in ids if ids.count(x) > 1})
    if again:
        raise RuleError(f"rule ids occur twice: {', '.join(again)}")
    return rules


def rules_version(path: str | Path = BUILTIN) -> Any:
    if path in (BUILTIN, ANTI_AI):
        return 1
    document = read_yaml(Path(path))
    return document.get("version") if isinstance(document, Mapping) else None


def fingerprint(rules: Sequence[Rule]) -> str:
    """SHA-256 over the rules' fields, in order."""
    digest = hashlib.sha256()
    for r in rules:
        digest.update(("\0".join((r.id, r.severity, r.detector, r.message, "")) + "\x01".join(r.exceptions)).encode() + b"\x02")
    return digest.hexdigest()
