"""Command line: init, validate-policy, policy-diff, doctor."""

from __future__ import annotations

import argparse
import importlib.util
import os
import shutil
import sys
from pathlib import Path

from sluice.plans.policy import SHIPPED, Policy
from sluice.sources.policies import PolicySchemaError, YamlPolicy, dump


def init(path: str, template: str, strict: bool) -> int:
    if Path(path).exists():
        print(f"{path} exists; it is not overwritten", file=sys.stderr)
        return 1
    policy = SHIPPED[template]
    Path(path).write_text(dump(policy.strict() if strict else policy), encoding="utf-8")
    return 0


def validate(path: str) -> int:
    """0 valid, 1 against the schema, 2 unreadable."""
    try:
        policy = YamlPolicy(path).load()
    except PolicySchemaError as e:
        print(e, file=sys.stderr)
        return 1
    except OSError as e:
        print(e, file=sys.stderr)
        return 2
    print(f"{path}: policy {policy.name} v{policy.version}, {len(policy.rules)} rules")
    return 0


def changes(old: Policy, new: Policy) -> list[str]:
    """What changes from one policy to the other, a line each; the last of rules with equal category and floor counts."""
    keyed = lambda p: {(r.category, r.min_confidence): r for r in p.rules}
    a, b = keyed(old), keyed(new)
    shown = lambda k: f"{k[0]} from {k[1]:.2f}"
    audited = lambda r: " (audit only)" if r.audit_only else ""
    out = [f"detector {n}: {old.detectors[n]} -> {new.detectors[n]}" for n in old.detectors if old.detectors[n] != new.detectors[n]]
    out += [f"added {shown(k)}: {r.action}{audited(r)}" for k, r in b.items() if k not in a]
    out += [f"removed {shown(k)}: {r.action}{audited(r)}" for k, r in a.items() if k not in b]
    both = [k for k in a if k in b]
    out += [f"action of {shown(k)}: {a[k].action} -> {b[k].action}" for k in both if a[k].action != b[k].action]
    out += [f"audit_only of {shown(k)}: {a[k].audit_only} -> {b[k].audit_only}" for k in both if a[k].audit_only != b[k].audit_only]
    return out


def diff(old: str, new: str) -> int:
    try:
        found = changes(YamlPolicy(old).load(), YamlPolicy(new).load())
    except (OSError, ValueError) as e:
        print(e, file=sys.stderr)
        return 2
    print("\n".join(found) or "The policies are equivalent.")
    return 0


def doctor(path: str | None) -> int:
    """What a run needs, a line each: a policy that loads and turns on detectors that need no model here, the Python
    packages of the workers, and Java for Spark. 0 if nothing is missing."""
    wrong = 0

    def say(what: str, why: str = "") -> None:
        nonlocal wrong
        wrong += bool(why)
        print(f"{'FAIL' if why else 'ok'}  {what}{': ' if why else ''}{why}")

    if path is not None:
        try:
            policy = YamlPolicy(path).load()
            on = [n for n, v in policy.detectors.items() if v and n != "normalization"]
            say(f"policy {path}", "" if on else "it turns on no detector")
            if models := [n for n in on if n != "regex"]:
                print(f"note  the models {', '.join(models)} must be given to the plan")
        except (OSError, ValueError) as e:
            say(f"policy {path}", str(e))
    for name in ("pyspark", "pyarrow", "pandas", "numpy", "yaml"):
        say(f"package {name}", "" if importlib.util.find_spec(name) else "not installed")
    java = shutil.which("java") or (os.environ.get("JAVA_HOME") and shutil.which("java", path=os.path.join(os.environ["JAVA_HOME"], "bin")))
    say("java", "" if java else "not found on PATH or in JAVA_HOME")
    return int(wrong > 0)


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="sluice")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("init", help="write a shipped policy to a new file")
    one.add_argument("path")
    one.add_argument("--template", choices=sorted(SHIPPED), default="default")
    one.add_argument("--strict", action="store_true", help="block credentials that the template tokenizes")
    commands.add_parser("validate-policy").add_argument("path")
    two = commands.add_parser("policy-diff")
    two.add_argument("old")
    two.add_argument("new")
    commands.add_parser("doctor", help="say what a run still needs").add_argument("--policy")
    a = parser.parse_args(args)
    if a.command == "doctor":
        return doctor(a.policy)
    if a.command == "init":
        return init(a.path, a.template, a.strict)
    return validate(a.path) if a.command == "validate-policy" else diff(a.old, a.new)


if __name__ == "__main__":
    sys.exit(main())
