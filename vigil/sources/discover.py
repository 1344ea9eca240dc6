"""Finding the files to scan, on the driver."""

from __future__ import annotations

import os
import stat


def expand(path: str, env: dict[str, str], cwd: str | None = None) -> str:
    """A leading ~/ is the home folder; relative paths start at ``cwd``."""
    if path.startswith("~/"):
        home = env.get("HOME") or env.get("USERPROFILE") or ""
        path = os.path.join(home, path[2:]) if home else path
    return os.path.normpath(os.path.join(cwd or os.getcwd(), path))


def within(path: str, root: str) -> bool:
    return path == root or path.startswith(root.rstrip("/") + "/")


def _regular(path: str) -> bool:
    try:
        return stat.S_ISREG(os.lstat(path).st_mode)
    except OSError:
        return False


def walk(root: str, strict: bool = False) -> list[str]:
    """Regular files below a folder, sorted; symbolic links are left alone."""
    out: list[str] = []

    def failed(error):
        if strict:
            raise error

    for folder, folders, names in os.walk(root, onerror=failed):
        folders.sort()
        out += [p for n in sorted(names) if _regular(p := os.path.join(folder, n))]
    return out


def _readable(path: str) -> bool:
    return os.access(path, os.R_OK)


def _found(path: str) -> list[str]:
    if os.path.isdir(path):
        return walk(path)
    return [path] if os.path.exists(path) and _readable(path) else []


def _rules(rules: list[str], env: dict, cwd) -> tuple[list[str], list[str]]:
    wanted = [expand(r, env, cwd) for r in rules if not r.startswith("!")]
    return wanted, [expand(r[1:].strip(), env, cwd) for r in rules if r.startswith("!") and r[1:].strip()]


def histories(rules: list[str], env: dict[str, str], cwd: str | None = None) -> list[str]:
    """History files: HISTFILE first, then the path rules in order; what is
    excluded, missing or closed to us drops out, repeats go."""
    wanted, excluded = _rules(rules, env, cwd)
    if env.get("HISTFILE"):
        wanted.insert(0, expand(env["HISTFILE"], env, cwd))
    found = [f for p in wanted for f in _found(p)]
    return list(dict.fromkeys(f for f in found if not any(within(f, x) for x in excluded)))


def explicit(paths: list[str], env: dict[str, str], cwd: str | None = None) -> list[str]:
    """Files named by hand: exclusions don't apply and a missing path raises."""
    out: list[str] = []
    for p in paths:
        full = expand(p, env, cwd)
        if os.path.isdir(full):
            out += walk(full, strict=True)
        else:
            with open(full, "rb"):
                out.append(full)
    return list(dict.fromkeys(out))


def transcripts(roots: list[str], env: dict[str, str], cwd: str | None = None, strict: bool = False) -> list[tuple[str, int]]:
    """(file, index of its root): a file under several roots belongs to the
    longest, ties to the first."""
    wanted, excluded = _rules(roots, env, cwd)
    files = explicit(wanted, env, cwd) if strict else list(dict.fromkeys(f for p in wanted for f in _found(p)))
    if not strict:
        files = [f for f in files if not any(within(f, x) for x in excluded)]
    rank = lambda f: max((len(r), -i) for i, r in enumerate(wanted) if within(f, r))
    return [(f, -rank(f)[1]) for f in files]


def unknown_histories(home: str, known: list[str], excluded: list[str]) -> list[str]:
    """Files .*history in the home folder that no rule names yet."""
    names = sorted(n for n in os.listdir(home) if n.startswith(".") and n.endswith("history"))
    paths = [os.path.join(home, n) for n in names]
    return [p for p in paths if _regular(p) and p not in known and not any(within(p, x) for x in excluded)]
