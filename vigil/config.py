"""Rule and path files of a user, and what is done with them."""

from __future__ import annotations

import os
from collections.abc import Callable

from vigil.functions import fixed, rulefile
from vigil.functions.rulefile import RuleSet
from vigil.operators.rules import KINDS, compile_rules
from vigil.sources.discover import unknown_histories

FOLDER = "vigil"
DEFAULTS = {"ignore": fixed.IGNORE_RULES, "check": fixed.MATCH_RULES, "path": fixed.HISTORY_PATHS, "deep_path": fixed.TRANSCRIPT_PATHS}


def user_folder(env: dict[str, str]) -> str:
    if env.get("XDG_CONFIG_HOME"):
        return os.path.join(env["XDG_CONFIG_HOME"], FOLDER)
    home = env.get("HOME") or env.get("USERPROFILE")
    if not home:
        raise ValueError("neither XDG_CONFIG_HOME nor HOME is set")
    return os.path.join(home, ".config", FOLDER)


def system_folder(env: dict[str, str]) -> str:
    return os.path.join(env.get("HOMEBREW_PREFIX", "/usr"), "share", FOLDER)


def is_deep(group: str) -> bool:
    return group == "deep" or group.startswith("deep.")


def group_lines(folder: str, kind: str) -> list[str]:
    """Lines of a kind's files (kind.*.rules), in byte order of their names.
    Files whose group is deep belong to the deep kinds."""
    if not os.path.isdir(folder):
        return []
    base, deep = kind.removeprefix("deep_"), kind.startswith("deep_")
    out: list[str] = []
    for name in sorted(os.listdir(folder), key=os.fsencode):
        if name.startswith(base + ".") and name.endswith(".rules"):
            group = name[len(base) + 1 : -len(".rules")]
            if is_deep(group) == deep:
                with open(os.path.join(folder, name), encoding="utf-8") as file:
                    out += file.read().split("\n")
    return out


def read_rules(*folders: str) -> list[tuple[str, str, str, int]]:
    """The rule table of some folders, in order; none at all is an error."""
    rules = compile_rules({kind: [x for f in folders for x in group_lines(f, kind)] for kind in KINDS})
    if not rules:
        raise FileNotFoundError(f"no rules in {', '.join(folders)}; run init first")
    return rules


def compiled(folder: str) -> str:
    """Where the compiled rules of a folder are."""
    return os.path.join(folder, "rules.bin")


def scan_rules(folder: str) -> RuleSet:
    """The compiled rules, which every scan uses."""
    if not os.path.exists(compiled(folder)):
        raise FileNotFoundError("no compiled rules found; run config init")
    return rulefile.read(compiled(folder))


def init(folder: str, overwrite: Callable[[str], bool] = lambda path: False) -> list[str]:
    """Write the default files that aren't there yet, and others anew where
    ``overwrite`` agrees to it."""
    os.makedirs(folder, exist_ok=True)
    out = []
    for kind, values in DEFAULTS.items():
        base = kind.removeprefix("deep_")
        path = os.path.join(folder, f"{base}.{'deep' if kind.startswith('deep_') else 'default'}.rules")
        if not os.path.exists(path) or overwrite(path):
            with open(path, "w", encoding="utf-8") as file:
                file.write("\n".join(values) + "\n")
            out.append(path)
    return out


def edit(folder: str, kind: str, pattern: str, remove: bool = False) -> bool:
    """Add a pattern to a kind's local file, or take its first line with that
    pattern out; whether anything changed."""
    path = os.path.join(folder, f"{kind}.local.rules")
    lines: list[str] = []
    if os.path.exists(path):
        with open(path, encoding="utf-8") as file:
            lines = file.read().splitlines()
    at = next((i for i, x in enumerate(lines) if x.strip() == pattern.strip()), None)
    if remove == (at is None):
        return False
    if remove:
        del lines[at]
    else:
        lines.append(pattern.strip())
    os.makedirs(folder, exist_ok=True)
    with open(path, "w", encoding="utf-8") as file:
        file.write("".join(x + "\n" for x in lines))
    return True


def discover(folder: str, env: dict[str, str], rules: list[tuple]) -> list[str]:
    """History files in the home folder that no path rule names."""
    from vigil.sources.discover import expand

    paths = [p for k, _, p, _ in rules if k == "path"]
    known = [expand(p, env) for p in paths if not p.startswith("!")]
    return unknown_histories(env["HOME"], known, [expand(p[1:], env) for p in paths if p.startswith("!")])


def status(rules: list[tuple]) -> list[str]:
    """The rules under a heading for each kind, with their number."""
    out: list[str] = []
    for kind in KINDS:
        own = [f"  {match} {pattern}" for k, match, pattern, _ in sorted(rules, key=lambda r: r[3]) if k == kind]
        out += [f"{kind} ({len(own)})", *own]
    return out
