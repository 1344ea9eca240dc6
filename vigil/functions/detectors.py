"""Detectors: from a command to an array of candidates, each one expression.

A candidate is a struct (token, det_type, keyword, search, placeholder,
auth_header, credential_url, known_format, private_key, size). Detectors are
kept in REGISTRY in their fixed order; on a token found twice the earlier one
wins. All of them are native and need no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigil.functions import fixed
from vigil.functions.text import BLANK, NAME, any_of, ascii_lower, quoted, starts_with_any

FLAGS = ("keyword", "search", "placeholder", "auth_header", "credential_url", "known_format", "private_key")
CANDIDATE = "struct<token:string,det_type:string," + ",".join(f"{f}:boolean" for f in FLAGS) + ",size:int>"
_NONE = f"array<{CANDIDATE}>"

ASSIGNMENT = rf"""(?:^|(?<=[{BLANK}"'(\[{{?&;]))[{NAME}]+=(?:"[^"]*"?|'[^']*'?|[^{BLANK}"'&#]+)"""
PURE_EXPANSION = rf"^[{BLANK}]*(?:\$(?:\{{[^}}]+\}}|[A-Za-z_][A-Za-z0-9_]*)[{BLANK}]*)+$"
#: The form of scheme://user:password@host; the password is the token.
URL_PASSWORD = rf"""[A-Za-z][A-Za-z0-9+.\-]*://[^{BLANK}/:@'"]*:([^{BLANK}@'"/]+)@"""


def candidate(token: Column, det_type: str, size: Column | None = None, **flags) -> Column:
    values = [F.coalesce(flags[f], F.lit(False)).alias(f) if isinstance(flags.get(f), Column) else F.lit(bool(flags.get(f, False))).alias(f) for f in FLAGS]
    size = F.octet_length(token) if size is None else size
    return F.struct(token.alias("token"), F.lit(det_type).alias("det_type"), *values, size.cast("int").alias("size"))


def _present(items: list[Column]) -> Column:
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def is_reference(token: Column) -> Column:
    """$NAME, ${NAME} and <name> stand for secrets, they aren't any."""
    return F.left(token, F.lit(1)).isin("$", "<")


def is_placeholder(value: Column) -> Column:
    return (value == "") | starts_with_any(ascii_lower(value), fixed.PLACEHOLDERS)


def is_sensitive(name: Column) -> Column:
    return ascii_lower(name).rlike(any_of(fixed.SENSITIVE_WORDS))


def _first_of(command: Column, literals, suffix: str) -> Column:
    """The first of the literals, in list order, that the command contains."""
    return F.get(F.filter(F.lit([x + suffix for x in literals]), lambda x: F.contains(command, x)), 0)


def private_keys(command: Column) -> Column:
    """A key block's first line, or else the name of a public key's algorithm."""
    marker = _first_of(command, fixed.KEY_MARKERS, "")
    algorithm = _first_of(command, fixed.SSH_ALGORITHMS, " ")
    found = F.when(marker.isNotNull(), candidate(marker, "private_key", private_key=True)).when(
        algorithm.isNotNull(), candidate(algorithm, "ssh_key", F.lit(20), private_key=True)
    )
    return _present([found])


def assignments(command: Column) -> Column:
    """Every name=value as struct (name, value); quotes around values taken off."""

    def cut(match: Column) -> Column:
        name = F.substring_index(match, "=", 1)
        value = F.substring(match, F.length(name) + 2, F.length(match))
        quote = F.left(value, F.lit(1))
        inner = F.substring(value, F.lit(2), F.length(value))
        closed = F.when((F.right(inner, F.lit(1)) == quote) & (F.length(value) > 1), F.substring(inner, F.lit(1), F.length(inner) - 1)).otherwise(inner)
        return F.struct(name.alias("name"), F.when(quote.isin('"', "'"), closed).otherwise(value).alias("value"))

    def once_more(pair: Column) -> Column:
        value, quote = pair["value"], F.left(pair["value"], F.lit(1))
        paired = quote.isin('"', "'") & (F.right(value, F.lit(1)) == quote) & (F.length(value) >= 2)
        return F.struct(pair["name"].alias("name"), F.when(paired, F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value).alias("value"))

    return F.transform(F.transform(F.regexp_extract_all(command, F.lit(ASSIGNMENT), F.lit(0)), cut), once_more)


def inline_assign(command: Column) -> Column:
    search = starts_with_any(command, fixed.SEARCH_COMMANDS)
    fit = F.filter(assignments(command), lambda p: is_sensitive(p["name"]) & ~p["value"].rlike(PURE_EXPANSION))
    return F.transform(fit, lambda p: candidate(p["value"], "inline_assign", keyword=True, search=search, placeholder=is_placeholder(p["value"])))


def _values(command: Column, flags, stop: str = " \"'") -> Column:
    """What follows the first occurrence of each flag, up to a stop character."""
    rest = lambda flag: F.substring(command, F.position(flag, command) + F.length(flag), F.length(command))
    return F.transform(F.filter(F.lit(list(flags)), lambda flag: F.contains(command, flag)), lambda flag: F.regexp_extract(rest(flag), f"^[^{stop}]*", 0))


def _usable(token: Column) -> Column:
    return (token != "") & ~is_reference(token)


def auth_header(command: Column) -> Column:
    return F.transform(F.filter(_values(command, fixed.AUTH_PREFIXES, "\"' \\\\"), _usable), lambda t: candidate(t, "auth_header", keyword=True, auth_header=True))


def auth_userinfo(command: Column) -> Column:
    values = F.filter(_values(command, fixed.USERINFO_FLAGS), lambda v: F.contains(v, F.lit(":")))
    tokens = F.transform(values, lambda v: F.substring(v, F.position(F.lit(":"), v) + 1, F.length(v)))
    return F.transform(F.filter(tokens, _usable), lambda t: candidate(t, "auth_userinfo", keyword=True, auth_header=True))


def cli_flags(command: Column) -> Column:
    at = F.position(F.lit("-p"), command)
    free = (at == 1) | ((at > 1) & (F.substring(command, at - 1, F.lit(1)) == " "))
    short = F.when(free, F.regexp_extract(F.substring(command, at + 2, F.length(command)), "^[^ \"']+", 0)).otherwise("")
    tokens = F.concat(_values(command, fixed.SECRET_FLAGS), F.array(short))
    return F.transform(F.filter(tokens, _usable), lambda t: candidate(t, "cli_flag_secret", keyword=True))


def credential_url(command: Column) -> Column:
    tokens = F.filter(F.regexp_extract_all(command, F.lit(URL_PASSWORD), F.lit(1)), lambda t: ~is_reference(t))
    return F.transform(tokens, lambda t: candidate(t, "credential_url", keyword=True, credential_url=True))


def known_token_pattern(prefixes) -> str:
    return rf"(?<![{NAME}])(?:{any_of(prefixes)})[{NAME}]{{{fixed.MIN_TAIL},}}"


def known_token(command: Column) -> Column:
    """Tokens with a provider's prefix. A prefix that ends with a dot reaches
    over what would be a boundary, so such prefixes are looked for apart."""
    names = [p for p, _ in fixed.PREFIX_HINTS]
    plain, dotted = [p for p in names if "." not in p], [p for p in names if "." in p]
    tokens = F.concat(*[F.regexp_extract_all(command, F.lit(known_token_pattern(ps)), F.lit(0)) for ps in (plain, dotted)])

    def placeholder(token: Column) -> Column:
        # The first prefix in order that leaves enough behind it speaks.
        own = F.filter(F.lit(names), lambda p: F.startswith(token, p) & (F.length(token) >= F.length(p) + fixed.MIN_TAIL))
        return F.coalesce(is_placeholder(F.substring(token, F.length(F.get(own, 0)) + 1, F.length(token))), F.lit(False))

    return F.transform(tokens, lambda t: candidate(t, "known_token", known_format=True, placeholder=placeholder(t)))


#: Stage name and detector, in the order in which they claim tokens.
REGISTRY: list[tuple[str, Callable[[Column], Column]]] = [
    ("keys", private_keys),
    ("assign", inline_assign),
    ("auth", auth_header),
    ("userinfo", auth_userinfo),
    ("flags", cli_flags),
    ("url", credential_url),
    ("known", known_token),
]


def candidates(command: Column, registry=None, mask: Column | None = None) -> Column:
    """All candidates of a command, in stage order, repeats included. With the
    ``mask`` of ``triggers`` a built-in detector runs only where its stage can
    fire, and others on every command that isn't ignored."""
    found = [detect(command) for _, detect in (registry or REGISTRY)]
    if mask is not None:
        bits = [1 << len(REGISTRY) + 1] * len(found) if registry else [1 << i for i in range(len(found))]
        found = [F.when(mask.bitwiseAND(F.lit(bit)) != 0, f).otherwise(F.array().cast(_NONE)) for bit, f in zip(bits, found)]
    return F.concat(*found)
