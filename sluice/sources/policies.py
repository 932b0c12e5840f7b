"""Policy sources: strict YAML files with positions in errors, and the registry of sources."""

from __future__ import annotations

import hashlib
import os
from abc import ABC, abstractmethod
from pathlib import Path
from typing import Any

import yaml

from sluice.functions.catalogue import ACTIONS, CATEGORIES
from sluice.plans.policy import DETECTORS, Policy, Rule


class PolicySchemaError(ValueError):
    """A policy file that does not fit the schema; the message has file, line, column, field and value."""


class PolicySource(ABC):
    """load() returns a policy or raises; a source never falls back to allowing everything."""

    @abstractmethod
    def load(self) -> Policy: ...


class _Reader:
    """Checks YAML nodes against the schema, and collects every problem with its position."""

    def __init__(self, path: Path) -> None:
        self.path, self.problems = path, []

    def wrong(self, node: yaml.Node, field: str, what: str) -> None:
        value = getattr(node, "value", None) if isinstance(node, yaml.ScalarNode) else f"a {node.id}"
        at = node.start_mark
        self.problems.append(f"  line {at.line + 1}, column {at.column + 1} ({field or '<root>'}): {what}; got {value!r}")

    def mapping(self, node: yaml.Node, field: str, known: tuple[str, ...], needed: tuple[str, ...] = ()) -> dict[str, yaml.Node]:
        if not isinstance(node, yaml.MappingNode):
            self.wrong(node, field, "a mapping is needed")
            return {}
        out = {}
        for key, value in node.value:
            if key.value in known:
                out[key.value] = value
            else:
                self.wrong(key, f"{field}.{key.value}".lstrip("."), "unknown field")
        for name in needed:
            if name not in out:
                self.wrong(node, f"{field}.{name}".lstrip("."), "the field is missing")
        return out

    def scalar(self, node: yaml.Node, field: str, kind: type | tuple[type, ...], what: str) -> Any:
        value = yaml.SafeLoader("").construct_object(node) if isinstance(node, yaml.ScalarNode) else node
        if not isinstance(value, kind) or isinstance(value, bool) and kind not in (bool, (bool, type(None))):
            self.wrong(node, field, f"{what} is needed")
            return None
        return value

    def rule(self, node: yaml.Node, field: str) -> Rule | None:
        before = len(self.problems)
        parts = self.mapping(node, field, ("category", "action", "min_confidence", "audit_only"), ("category", "action"))
        values: dict[str, Any] = {}
        for name, allowed in (("category", CATEGORIES), ("action", ACTIONS)):
            if name in parts:
                values[name] = self.scalar(parts[name], f"{field}.{name}", str, "text")
                if values[name] is not None and values[name] not in allowed:
                    self.wrong(parts[name], f"{field}.{name}", f"one of {', '.join(allowed)} is needed")
        if "min_confidence" in parts:
            values["min_confidence"] = self.scalar(parts["min_confidence"], f"{field}.min_confidence", (int, float), "a number")
            if values["min_confidence"] is not None and not 0 <= values["min_confidence"] <= 1:
                self.wrong(parts["min_confidence"], f"{field}.min_confidence", "a number from 0 to 1 is needed")
        if "audit_only" in parts:
            values["audit_only"] = self.scalar(parts["audit_only"], f"{field}.audit_only", (bool, type(None)), "true, false or null")
        return Rule(**values) if len(self.problems) == before else None

    def policy(self, node: yaml.Node | None) -> Policy:
        if not isinstance(node, yaml.MappingNode):
            raise PolicySchemaError(f"policy file: {self.path}\n  line 1, column 1 (<root>): a mapping is needed")
        parts = self.mapping(node, "", ("name", "version", "detectors", "rules", "audit_only"), ("name",))
        values: dict[str, Any] = {}
        for name, kind, what in (("name", str, "text"), ("version", str, "text"), ("audit_only", bool, "true or false")):
            if name in parts:
                values[name] = self.scalar(parts[name], name, kind, what)
        detectors = dict.fromkeys(DETECTORS, True)
        if "detectors" in parts:
            for name, toggle in self.mapping(parts["detectors"], "detectors", DETECTORS).items():
                inner = self.mapping(toggle, f"detectors.{name}", ("enabled",))
                if "enabled" in inner:
                    detectors[name] = self.scalar(inner["enabled"], f"detectors.{name}.enabled", bool, "true or false")
        rules = parts.get("rules")
        if rules is not None and not isinstance(rules, yaml.SequenceNode):
            self.wrong(rules, "rules", "a list is needed")
            rules = None
        made = [self.rule(x, f"rules.{k}") for k, x in enumerate(rules.value if rules is not None else [])]
        if self.problems:
            raise PolicySchemaError("\n".join([f"policy file: {self.path}", *self.problems]))
        return Policy(**values, detectors=detectors, rules=tuple(made))


class YamlPolicy(PolicySource):
    def __init__(self, path: str | Path) -> None:
        self.path = Path(path)

    def load(self) -> Policy:
        if not self.path.is_file():
            raise FileNotFoundError(f"no policy file at {self.path}")
        try:
            node = yaml.compose(self.path.read_text(encoding="utf-8"), Loader=yaml.SafeLoader)
        except yaml.YAMLError as e:
            raise PolicySchemaError(f"policy file: {self.path}\n  {e}") from e
        return _Reader(self.path).policy(node)


class GitPolicy(PolicySource):
    """A place for policies kept in a repository; loading is not built."""

    def __init__(self, location: str) -> None:
        self.location = location

    def load(self) -> Policy:
        raise NotImplementedError("policies from a git manifest are not supported")


def policy_source(name: str | None = None, path: str | None = None) -> PolicySource:
    """The source of that name, in any case; by default SLUICE_POLICY_SOURCE and SLUICE_POLICY_PATH, then local_yaml."""
    name = (name or os.environ.get("SLUICE_POLICY_SOURCE") or "local_yaml").strip().lower()
    path = path or os.environ.get("SLUICE_POLICY_PATH") or "policy.yaml"
    if name == "local_yaml":
        return YamlPolicy(path)
    if name == "git_manifest":
        return GitPolicy(path)
    if name in ("purview_dlp", "icap"):
        raise NotImplementedError(f"policy source {name} needs a commercial service and is not supported")
    raise ValueError(f"unknown policy source {name!r}")


def policy_hash(path: str | Path) -> str:
    """sha256:<hex> of the file's bytes, or sha256:unknown."""
    try:
        return "sha256:" + hashlib.sha256(Path(path).read_bytes()).hexdigest()
    except OSError:
        return "sha256:unknown"


def dump(policy: Policy) -> str:
    """The policy as YAML that YamlPolicy reads back."""
    rules = []
    for r in policy.rules:
        rule: dict[str, Any] = {"category": r.category, "action": r.action}
        if r.min_confidence:
            rule["min_confidence"] = r.min_confidence
        if r.audit_only is not None:
            rule["audit_only"] = r.audit_only
        rules.append(rule)
    body = {"name": policy.name, "version": policy.version, "audit_only": policy.audit_only, "detectors": {k: {"enabled": v} for k, v in policy.detectors.items()}, "rules": rules}
    return yaml.safe_dump(body, sort_keys=False)
