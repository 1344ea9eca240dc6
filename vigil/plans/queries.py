"""Registered queries of the scanner, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil import sinks
from vigil.functions import detectors as D
from vigil.functions import fixed
from vigil.functions.redact import redact_token as redact
from vigil.functions.score import severity_name
from vigil.functions.text import entropy, first_place, window
from vigil.operators import deep, fix, lines
from vigil.operators import rules as R
from vigil.operators.scan import match_rules as match_with
from vigil.operators.scan import scan, severity_counts, visible
from vigil.plans import corpora
from vigil.plans.corpora import COMMANDS, PATHS, PIECES, RULES, TEXT, commands, over, pieces, quoted_json

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def quoted_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def alternation(values) -> str:
    """An RE2 alternation of literals, inside an SQL string."""
    special = set(".*+?()[]{}|^$/\\")
    return "|".join("".join("\\" + c if c in special else c for c in v) for v in values).replace("'", "''")


# --- the scan in SQL, stage by stage ---

_B = "[ \\t\\n\\x0B\\f\\r]"
_IGNORED = " OR ".join(f"starts_with(command, '{r.removeprefix('prefix:')}')" for r in fixed.IGNORE_RULES)
_PREFIXES = [p for p, _ in fixed.PREFIX_HINTS]

BASE_CTE = f"cmds AS MATERIALIZED ({COMMANDS}), live AS MATERIALIZED (SELECT * FROM cmds WHERE NOT ({_IGNORED}))"
ASSIGN_CTE = f"""
raw_assign AS (
  SELECT key, unnest(regexp_extract_all(command, '(?:^|[ \\t\\n\\x0B\\f\\r"''(\\[{{?&;])([A-Za-z0-9_-]+=(?:"[^"]*"?|''[^'']*''?|[^ \\t\\n\\x0B\\f\\r"''&#]+))', 1)) AS m,
    regexp_matches(command, '^({alternation(fixed.SEARCH_COMMANDS)})') AS search
  FROM live
), assign AS (
  SELECT key, search, split_part(m, '=', 1) AS name, trim(substr(m, strpos(m, '=') + 1), '"''') AS value FROM raw_assign
), assign_hit AS (
  SELECT key, 1 AS stage, value AS token, 'inline_assign' AS det_type, TRUE AS kw, search,
    value = '' OR regexp_matches(lower(value), '^({alternation(fixed.PLACEHOLDERS)})') AS ph, FALSE AS hdr, FALSE AS url, FALSE AS known, FALSE AS pk
  FROM assign WHERE regexp_matches(lower(name), '{alternation(fixed.SENSITIVE_WORDS)}')
    AND NOT regexp_matches(value, '^[ \\t]*(\\$(\\{{[^}}]+\\}}|[A-Za-z_][A-Za-z0-9_]*)[ \\t]*)+$')
)"""


def _flag_rows(flags, stop: str, stage: int, det_type: str, hdr: str, after_colon: bool = False) -> str:
    parts = []
    for i, flag in enumerate(flags):
        value = f"regexp_extract(command, '{alternation([flag])}([^{stop}]*)', 1)"
        if after_colon:
            value = f"CASE WHEN strpos({value}, ':') > 0 THEN substr({value}, strpos({value}, ':') + 1) ELSE '' END"
        parts.append(
            f"SELECT key, {stage} + {i} AS stage, {value} AS token, '{det_type}' AS det_type, TRUE AS kw, FALSE AS search, FALSE AS ph, {hdr} AS hdr, FALSE AS url, FALSE AS known, FALSE AS pk FROM live"
        )
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE token <> '' AND left(token, 1) NOT IN ('$', '<')"


FLAG_CTE = f"""
auth_hit AS ({_flag_rows(fixed.AUTH_PREFIXES, '"'' \\\\', 10, 'auth_header', 'TRUE')}),
user_hit AS ({_flag_rows(fixed.USERINFO_FLAGS, ' "' + "''", 20, 'auth_userinfo', 'TRUE', True)}),
flag_hit AS ({_flag_rows(fixed.SECRET_FLAGS, ' "' + "''", 30, 'cli_flag_secret', 'FALSE')}
  UNION ALL SELECT key, 39, regexp_extract(substr(command, strpos(command, '-p') + 2), '^[^ "'']+'), 'cli_flag_secret', TRUE, FALSE, FALSE, FALSE, FALSE, FALSE, FALSE
  FROM live WHERE strpos(command, '-p') > 0 AND (strpos(command, '-p') = 1 OR substr(command, strpos(command, '-p') - 1, 1) = ' ')
    AND regexp_matches(substr(command, strpos(command, '-p') + 2), '^[^ "''$<]')),
url_hit AS (
  SELECT key, 40 AS stage, unnest(regexp_extract_all(command, '[A-Za-z][A-Za-z0-9+.-]*://[^ \\t\\n/:@''"]*:([^ \\t\\n@''"/]+)@', 1)) AS token, 'credential_url' AS det_type,
    TRUE AS kw, FALSE AS search, FALSE AS ph, FALSE AS hdr, TRUE AS url, FALSE AS known, FALSE AS pk FROM live
)"""
KNOWN_CTE = f"""
raw_known AS (
  SELECT key, unnest(regexp_extract_all(command, '(?:^|[^A-Za-z0-9_-])((?:{alternation(_PREFIXES)})[A-Za-z0-9_-]{{8,}})', 1)) AS token FROM live
), known_hit AS (
  SELECT key, 50 AS stage, token, 'known_token' AS det_type, FALSE AS kw, FALSE AS search,
    regexp_matches(lower(regexp_replace(token, '^({alternation(_PREFIXES)})', '')), '^({alternation(fixed.PLACEHOLDERS)})') AS ph, FALSE AS hdr, FALSE AS url, TRUE AS known, FALSE AS pk
  FROM raw_known
)"""
_MARKER = "CASE " + " ".join(f"WHEN contains(command, '{m}') THEN '{m}'" for m in fixed.KEY_MARKERS) + " END"
_ALGORITHM = "CASE " + " ".join(f"WHEN contains(command, '{a} ') THEN '{a} '" for a in fixed.SSH_ALGORITHMS) + " END"
KEY_CTE = f"""
key_hit AS (
  SELECT key, 0 AS stage, coalesce({_MARKER}, {_ALGORITHM}) AS token, CASE WHEN {_MARKER} IS NOT NULL THEN 'private_key' ELSE 'ssh_key' END AS det_type,
    FALSE AS kw, FALSE AS search, FALSE AS ph, FALSE AS hdr, FALSE AS url, FALSE AS known, TRUE AS pk
  FROM live WHERE coalesce({_MARKER}, {_ALGORITHM}) IS NOT NULL
)"""
SCORE_CTE = """
hits AS MATERIALIZED (
  SELECT * FROM key_hit UNION ALL SELECT * FROM assign_hit UNION ALL SELECT * FROM auth_hit UNION ALL SELECT * FROM user_hit
  UNION ALL SELECT * FROM flag_hit UNION ALL SELECT * FROM url_hit UNION ALL SELECT * FROM known_hit
), first_hits AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key, token ORDER BY stage) AS rn FROM hits) WHERE rn = 1
), bits AS (
  SELECT *, CASE WHEN pk THEN 0.0 ELSE list_entropy(string_split(token, '')) END AS e FROM first_hits
), points AS (
  SELECT *, CAST(kw AS INT) * 3 + CAST(e >= 3.5 - 1e-9 AS INT) * 3 + CAST(CASE WHEN det_type = 'ssh_key' THEN 20 ELSE strlen(token) END >= 20 AS INT) * 2
    + CAST(hdr AS INT) * 2 + CAST(url AS INT) * 2 + CAST(known AS INT) * 4 + CAST(pk AS INT) * 6 - CAST(search AS INT) * 2 - CAST(ph AS INT) * 3 AS score FROM bits
), scored AS MATERIALIZED (
  SELECT *, CASE WHEN score <= 2 THEN 0 WHEN score <= 4 THEN 1 WHEN score <= 6 THEN 2 ELSE 3 END AS rank FROM points
)"""
_CHECKS = "(VALUES " + ", ".join(f"({i}, '{p}')" for i, p in enumerate(fixed.MATCH_RULES)) + ") r(ord, pattern)"
_CHARS = "[A-Za-z0-9._/-]*"
RULE_CTE = f"""
rule_raw AS (
  SELECT key, r.ord, regexp_extract(substr(command, 1, strpos(command, pattern) - 1), '{_CHARS}$') || pattern
    || regexp_extract(substr(command, strpos(command, pattern) + length(pattern)), '^{_CHARS}') AS token
  FROM live JOIN {_CHECKS} ON contains(command, pattern)
), rule_hit AS (
  SELECT key, 100 + ord AS stage, token, 'config_check' AS det_type, 0.0 AS e, 7 AS score, 3 AS rank FROM rule_raw
  WHERE NOT EXISTS (SELECT 1 FROM scored s WHERE s.key = rule_raw.key AND s.token = rule_raw.token AND s.rank = 3)
), findings AS MATERIALIZED (
  SELECT key, stage, token, det_type, e, score, rank FROM scored UNION ALL SELECT * FROM rule_hit
)"""
SCAN = "WITH " + ", ".join([BASE_CTE, ASSIGN_CTE, FLAG_CTE, KNOWN_CTE, KEY_CTE, SCORE_CTE, RULE_CTE])
_NAME = "CASE rank WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' ELSE 'ignore' END"
_HINT = (
    "coalesce("
    + ", ".join(f"CASE WHEN starts_with(token, '{p}') THEN '{h}' END" for p, h in sorted(fixed.PREFIX_HINTS, key=lambda x: -len(x[0])))
    + ", "
    + ", ".join(f"CASE WHEN det_type = '{k}' THEN '{h}' END" for k, h in fixed.TYPE_HINTS)
    + f", '{fixed.DEFAULT_HINT}')"
)


def _mask(t: str) -> str:
    each = f"(CASE WHEN length({t}) > 8 THEN least(4, length({t}) // 4) ELSE 1 END)"
    return (
        f"CASE WHEN length({t}) <= 2 * {each} THEN repeat('*', length({t})) WHEN length({t}) <= 32 THEN left({t}, {each}) || repeat('*', length({t}) - 2 * {each}) || right({t}, {each}) "
        f"ELSE left({t}, {each}) || repeat('*', (29 - 2 * {each}) // 2) || '...' || repeat('*', 29 - 2 * {each} - (29 - 2 * {each}) // 2) || right({t}, {each}) END"
    )


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = R.of_kind(R.default_rules(), "ignore")
    return commands(spark, sf_dir).where(~R.matches_any(F.col("command"), rules))


def _each(df: DataFrame, array) -> DataFrame:
    return df.select("key", F.explode(array).alias("c")).select("key", "c.token", "c.det_type")


def _detector(name: str, cte: str, hit: str):
    detect = getattr(D, name)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _each(_live(spark, sf_dir), detect(F.col("command")))

    run.__name__ = f"detect_{name}"
    run.__doc__ = f"Candidates of one detector over the command corpus: {name}."
    return query(f"WITH {BASE_CTE}, {cte} SELECT key, token, det_type FROM {hit}")(run)


for _name, _cte, _hit in (
    ("private_keys", KEY_CTE, "key_hit"), ("inline_assign", ASSIGN_CTE, "assign_hit"), ("auth_header", FLAG_CTE, "auth_hit"), ("auth_userinfo", FLAG_CTE, "user_hit"),
    ("cli_flags", FLAG_CTE, "flag_hit"), ("credential_url", FLAG_CTE, "url_hit"), ("known_token", KNOWN_CTE, "known_hit"),
):
    _detector(_name, _cte, _hit)


@query("SELECT o_orderkey AS key, round(list_entropy(string_split(md5(CAST(o_orderkey AS STRING)), '')), 6) AS bits FROM orders")
def entropy_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shannon entropy of one token for each order."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    token = F.md5(F.col("o_orderkey").cast("string").cast("binary"))
    return orders.select(F.col("o_orderkey").alias("key"), F.round(entropy(token), 6).alias("bits"))


@query("SELECT doc_id, CASE WHEN strlen(text) > 0 THEN round(list_entropy(regexp_extract_all(hex(encode(text)), '..')), 6) ELSE 0.0 END AS bits FROM documents")
def entropy_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shannon entropy of the bytes of every whole document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.round(entropy(F.col("text")), 6).alias("bits"))


@query(f"WITH {BASE_CTE}, {ASSIGN_CTE} SELECT key, name, value FROM assign")
def assign_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every name=value of the commands, sensitive or not."""
    return _live(spark, sf_dir).select("key", F.explode(D.assignments(F.col("command"))).alias("p")).select("key", "p.name", "p.value")


@query(f"WITH {BASE_CTE} SELECT key, command FROM live")
def ignore_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands that no ignore rule matches: an anti-join with the rule table."""
    table = R.rule_table(spark, R.default_rules()).where("kind = 'ignore'")
    return R.anti_match(commands(spark, sf_dir), table).select("key", "command")


_RULES = [("exact", "export PASSWORD=changeme"), ("prefix", "psql "), ("substring", "zz9_"), ("substring", "ssh-rsa"), ("prefix", "git status --short 9")]
_RULE_SQL = "(VALUES " + ", ".join(f"({i}, '{m}', '{p}')" for i, (m, p) in enumerate(_RULES)) + ") r(rule_ord, match_kind, pattern)"


@query(
    f"""WITH {BASE_CTE}, hit AS (
  SELECT key, rule_ord, pattern, command, CASE match_kind WHEN 'substring' THEN strpos(command, pattern) ELSE 1 END AS place
  FROM live JOIN {_RULE_SQL} ON CASE match_kind WHEN 'exact' THEN command = pattern WHEN 'prefix' THEN starts_with(command, pattern) ELSE contains(command, pattern) END
) SELECT key, CAST(rule_ord AS BIGINT) AS rule_ord, regexp_extract(substr(command, 1, place - 1), '{_CHARS}$') || pattern || regexp_extract(substr(command, place + length(pattern)), '^{_CHARS}') AS token FROM hit"""
)
def match_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each command and matching rule, with the grown token."""
    table = R.rule_table(spark, [("check", m, p, i) for i, (m, p) in enumerate(_RULES)])
    return match_with(_live(spark, sf_dir), table).select("key", "rule_ord", "token")


_MANY = f"""WITH {BASE_CTE}, rules AS MATERIALIZED ({RULES}), hit AS MATERIALIZED (
  SELECT key, CAST(ord AS BIGINT) AS rule_ord, pattern, command, CASE match_kind WHEN 'substring' THEN strpos(command, pattern) ELSE 1 END AS place
  FROM live JOIN rules ON CASE match_kind WHEN 'exact' THEN command = pattern WHEN 'prefix' THEN starts_with(command, pattern) ELSE contains(command, pattern) END
)"""


@query(f"{_MANY} SELECT key, rule_ord, regexp_extract(substr(command, 1, place - 1), '{_CHARS}$') || pattern || regexp_extract(substr(command, place + length(pattern)), '^{_CHARS}') AS token FROM hit")
def match_rule_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each command and matching rule of a table that grows with the
    data, a rule for each customer."""
    return match_with(_live(spark, sf_dir), corpora.rules(spark, sf_dir)).select("key", "rule_ord", "token")


@query(f"{_MANY} SELECT key, command FROM live WHERE key NOT IN (SELECT key FROM hit)")
def anti_rule_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands that no rule of that table matches."""
    return R.anti_match(_live(spark, sf_dir), corpora.rules(spark, sf_dir)).select("key", "command")


_PREFIX_VALUES = "(VALUES " + ", ".join(f"({i}, '{p}')" for i, p in enumerate(_PREFIXES)) + ") p(ord, prefix)"


@query(
    f"""WITH {BASE_CTE}, runs AS (
  SELECT key, unnest(list_concat(regexp_extract_all(command, '(?:^|[^A-Za-z0-9_-])([A-Za-z0-9_-]+)', 1), regexp_extract_all(command, '(?:^|[^A-Za-z0-9_-])(hvb\\.[A-Za-z0-9_-]+)', 1))) AS token FROM live
) SELECT key, token, prefix FROM runs JOIN {_PREFIX_VALUES} ON starts_with(token, prefix) AND length(token) >= length(prefix) + 8"""
)
def known_token_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of token characters joined with the provider prefixes, by their
    first character and then by the whole prefix. A prefix that ends with a dot
    reaches over two runs, which also count each for itself."""
    known = R.hint_table(spark).where("key_kind = 'prefix'").select(F.col("key").alias("prefix"), F.left("key", F.lit(1)).alias("initial"))
    parts = [rf"(?<![{D.NAME}])[{D.NAME}]+", *[rf"(?<![{D.NAME}]){D.quoted(p)}[{D.NAME}]+" for p, _ in fixed.PREFIX_HINTS if p.endswith(".")]]
    runs = F.concat(*[F.regexp_extract_all("command", F.lit(p), F.lit(0)) for p in parts])
    found = _live(spark, sf_dir).select("key", F.explode(runs).alias("token")).withColumn("first", F.left("token", F.lit(1)))
    # The prefix table is a fixed list of the package.
    fit = (F.col("first") == F.col("initial")) & F.startswith("token", F.col("prefix")) & (F.length("token") >= F.length("prefix") + fixed.MIN_TAIL)
    return found.join(F.broadcast(known), fit).select("key", "token", "prefix")


@query(f"{SCAN} SELECT key, det_type, token, CAST(score AS INT) AS score, {_NAME} AS severity, round(e, 6) AS bits FROM findings")
def score_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings of the command corpus, ignored ones too, with their scores."""
    found = scan(commands(spark, sf_dir), redact=False)
    return found.select("key", "det_type", "token", "score", "severity", F.round("entropy", 6).alias("bits"))


@query(f"{SCAN} SELECT count(*) FILTER (rank = 3) AS high, count(*) FILTER (rank = 2) AS medium, count(*) FILTER (rank = 1) AS low, count(*) FILTER (rank > 0) AS total FROM findings")
def severity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible findings by severity."""
    return severity_counts(scan(commands(spark, sf_dir), redact=False))


@query(f"{SCAN} SELECT key, det_type, token FROM findings WHERE rank >= 2")
def severity_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of medium severity or above."""
    return visible(scan(commands(spark, sf_dir), redact=False), "medium").select("key", "det_type", "token")


@query(
    f"""WITH {", ".join([BASE_CTE, ASSIGN_CTE, FLAG_CTE, KNOWN_CTE, KEY_CTE])},
hits AS (SELECT key, stage, token, det_type FROM known_hit UNION ALL SELECT key, 60, token, 'again' FROM known_hit UNION ALL SELECT key, stage, token, det_type FROM url_hit
  UNION ALL SELECT key, 70, token, 'again' FROM url_hit)
SELECT key, token, det_type FROM (SELECT *, row_number() OVER (PARTITION BY key, token ORDER BY stage) AS rn FROM hits) WHERE rn = 1"""
)
def dedup_first_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of candidates with one token the first stage's, without a shuffle."""
    from vigil.functions.score import first_by_token

    command = F.col("command")
    again = lambda detect: lambda c: F.transform(detect(c), lambda x: x.withField("det_type", F.lit("again")))
    staged = [("url", D.credential_url), ("known", D.known_token), ("known again", again(D.known_token)), ("url again", again(D.credential_url))]
    rows = _live(spark, sf_dir).select("key", D.candidates(command, staged).alias("all"))
    return _each(rows, first_by_token(F.col("all")))


@query(f"{SCAN} SELECT key, det_type, token, {_HINT} AS hint FROM findings")
def hint_longest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hint of each finding: longest prefix, then type, then default."""
    return scan(commands(spark, sf_dir), redact=False).select("key", "det_type", "token", F.col("recommendation").alias("hint"))


@query(f"SELECT key, {_mask('t')} AS masked FROM (SELECT o_orderkey AS key, left(md5(CAST(o_orderkey AS STRING)) || md5(CAST(o_orderkey + 1 AS STRING)), 1 + o_orderkey % 64) AS t FROM orders)")
def redact_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks of tokens of 1 to 64 characters."""
    rows = over(spark, sf_dir, "SELECT o_orderkey AS key, left(md5(CAST(o_orderkey AS STRING)) || md5(CAST(o_orderkey + 1 AS STRING)), 1 + o_orderkey % 64) AS t FROM orders")
    return rows.select("key", redact(F.col("t")).alias("masked"))


@query(
    f"""{SCAN}, single AS (SELECT key, max(token) AS token FROM findings GROUP BY key HAVING count(DISTINCT token) = 1)
SELECT s.key, left(command, strpos(command, token) - 1) || {_mask('token')} || CASE WHEN strpos(command, token) + length(token) <= length(command) THEN '...' ELSE '' END AS redacted,
  CAST(strpos(command, token) - 1 AS INT) AS start FROM single s JOIN live l ON l.key = s.key
WHERE strpos(substr(command, strpos(command, token) + length(token)), token) = 0"""
)
def redact_command(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked commands that hold one secret, once: all that this SQL states.
    ``redact_findings`` has the rows of every command with findings."""
    found = scan(commands(spark, sf_dir))
    again = F.contains(F.substring("command", F.col("match_start") + F.col("match_len") + 1, F.length("command")), F.col("token"))
    one = found.groupBy("key").agg(F.count_distinct("token").alias("n"), F.min("redacted").alias("redacted"), F.min("redacted_start").alias("start"), F.max(again).alias("again"))
    return one.where("n = 1 AND NOT again").select("key", "redacted", "start")


@query(
    f"""{SCAN}, cut AS (
  SELECT t.key, length(token) AS n, string_split(command, token) AS parts FROM (SELECT DISTINCT key, token FROM findings WHERE token <> '') t JOIN live l ON l.key = t.key
), spot AS (SELECT key, n, parts, unnest(range(1, len(parts))) AS k FROM cut),
span AS (SELECT key, length(array_to_string(parts[1:k], '')) + (k - 1) * n AS a, length(array_to_string(parts[1:k], '')) + k * n AS b FROM spot),
marked AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY key ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens FROM span),
island AS (
  SELECT key, min(a) AS a, max(b) AS b FROM (SELECT *, sum(opens) OVER (PARTITION BY key ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM marked) GROUP BY key, island
), gap AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY key ORDER BY a), 0) AS done FROM island),
piece AS (SELECT g.key, a, b, command, substr(command, done + 1, a - done) AS before, substr(command, a + 1, b - a) AS t FROM gap g JOIN live l ON l.key = g.key),
shown AS (SELECT *, {_mask('t')} AS m FROM piece),
placed AS (SELECT *, sum(length(before) + length(m)) OVER (PARTITION BY key ORDER BY a) - length(m) AS at FROM shown),
whole AS (SELECT key, string_agg(before || m, '' ORDER BY a) || CASE WHEN max(b) < max(length(command)) THEN '...' ELSE '' END AS redacted FROM shown GROUP BY key)
SELECT f.key, f.det_type, f.token, coalesce(w.redacted, l.command) AS redacted, CAST(coalesce(p.at, 0) AS INT) AS start, CAST(coalesce(length(p.m), 0) AS INT) AS length
FROM findings f JOIN live l ON l.key = f.key LEFT JOIN whole w ON w.key = f.key
LEFT JOIN placed p ON p.key = f.key AND f.token <> '' AND strpos(l.command, f.token) > p.a AND strpos(l.command, f.token) <= p.b"""
)
def redact_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The masked command of every finding, ignored ones too: all occurrences
    of all tokens of the command, and where the finding's own mask is."""
    found = scan(commands(spark, sf_dir))
    return found.select("key", "det_type", "token", "redacted", F.col("redacted_start").alias("start"), F.col("redacted_len").alias("length"))


@query(
    """WITH t AS (SELECT doc_id, text, length(text) AS n, strpos(text, 'the') - 1 AS p FROM documents WHERE strpos(text, 'the') > 0),
w AS (SELECT *, greatest(p - 60, 0) AS a, least(p + 3 + 60, n) AS b FROM t)
SELECT doc_id, CASE WHEN strlen(text) <= 160 THEN text ELSE CASE WHEN a > 0 THEN '…' ELSE '' END || substr(text, a + 1, b - a) || CASE WHEN b < n THEN '…' ELSE '' END END AS snippet FROM w"""
)
def window_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows around a match in long texts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    at = first_place(F.col("text"), F.lit("the"))
    return docs.where(F.contains("text", F.lit("the"))).select("doc_id", window(F.col("text"), at, F.lit(3), 160, 60).alias("snippet"))


@query(f"{SCAN} SELECT {_NAME} AS severity, 'orders' AS file, key + 1 AS line, NULL::BIGINT AS timestamp, det_type, CAST(score AS INT) AS score, {_HINT} AS recommendation FROM findings WHERE rank > 0")
def ndjson_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings written as JSON lines and read again (the command left out)."""
    text = sinks.json_lines(visible(scan(commands(spark, sf_dir))))
    kind = "severity string, file string, line long, timestamp long, det_type string, command string, score int, recommendation string"
    return text.select(F.from_json("value", kind).alias("r")).select("r.severity", "r.file", "r.line", "r.timestamp", "r.det_type", "r.score", "r.recommendation")


@query(
    """SELECT doc_id, CAST(i AS BIGINT) AS line, raw FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE raw <> ''"""
)
def physical_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered lines of every document that aren't empty."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return lines.text_pieces(lines.physical_lines(docs)).select("doc_id", "line", "raw")


_EXTENDED_SQL = """SELECT o_orderkey AS key, CASE o_orderkey % 4 WHEN 0 THEN ': ' || (1700000000 + o_orderkey) || ':0;ls ' || o_orderkey WHEN 1 THEN 'cd ' || o_orderkey
  WHEN 2 THEN ': x:0;bad ' || o_orderkey ELSE ': 12:3;' END AS raw FROM orders"""


@query(f"SELECT key, CASE WHEN key % 4 = 0 THEN 1700000000 + key END AS ts, CASE WHEN key % 4 = 0 THEN 'ls ' || key ELSE raw END AS command FROM ({_EXTENDED_SQL})")
def shell_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of plain and extended shell histories."""
    return lines.shell_entries(over(spark, sf_dir, _EXTENDED_SQL)).select("key", "ts", "command")


_FISH = """SELECT CAST(o_orderkey % 97 AS STRING) AS file, o_orderkey * 3 + i AS line, CASE i WHEN 0 THEN '- cmd: make ' || o_orderkey
  WHEN 1 THEN CASE WHEN o_orderkey % 5 = 0 THEN '  when: soon' ELSE '  when: ' || (1600000000 + o_orderkey) END ELSE '  paths:' END AS raw
FROM orders"""


def _fish(spark: SparkSession, sf_dir: str) -> DataFrame:
    return over(spark, sf_dir, _FISH.replace("FROM orders", "FROM orders CROSS JOIN (VALUES (0), (1), (2)) t(i)"))


@query("SELECT CAST(o_orderkey % 97 AS STRING) AS file, o_orderkey * 3 AS line, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 1600000000 + o_orderkey END AS ts, 'make ' || o_orderkey AS command FROM orders")
def fish_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of fish histories, put together from their lines."""
    return lines.fish_entries(_fish(spark, sf_dir)).select("file", "line", "ts", "command")


@query("SELECT CAST(o_orderkey % 97 AS STRING) AS file, o_orderkey * 3 + i AS line, o_orderkey * 3 AS span_start, o_orderkey * 3 + 2 AS span_end FROM orders CROSS JOIN (VALUES (0), (1), (2)) t(i)")
def fix_fish_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Physical spans of fish entries."""
    return fix.fish_spans(_fish(spark, sf_dir)).select("file", "line", "span_start", "span_end")


_CONTINUED = """SELECT CAST(o_orderkey % 97 AS STRING) AS file, o_orderkey AS line, 'step ' || o_orderkey || CASE WHEN o_orderkey % 7 < 3 THEN chr(92) ELSE '' END AS raw FROM orders"""


_SHELL_SPANS = f"""WITH l AS ({_CONTINUED}), o AS (
  SELECT *, CASE WHEN coalesce(right(lag(raw) OVER (PARTITION BY file ORDER BY line), 1) = chr(92), FALSE) THEN 0 ELSE 1 END AS opens FROM l
), i AS (SELECT *, sum(opens) OVER (PARTITION BY file ORDER BY line) AS island FROM o),
s AS (SELECT *, min(line) OVER (PARTITION BY file, island) AS span_start, max(line) OVER (PARTITION BY file, island) AS span_end FROM i)"""


@query(f"{_SHELL_SPANS} SELECT file, line, span_start, span_end FROM s")
def fix_shell_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Physical spans of entries that backslashes continue."""
    return fix.shell_spans(over(spark, sf_dir, _CONTINUED)).select("file", "line", "span_start", "span_end")


@query(f"{_SHELL_SPANS} SELECT file, line, raw FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE b.file = a.file AND b.line % 11 = 0 AND a.line BETWEEN b.span_start AND b.span_end)")
def fix_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that stay when every span with a line divisible by 11 goes."""
    rows = over(spark, sf_dir, _CONTINUED)
    spans = fix.shell_spans(rows).where("line % 11 = 0").select("file", "span_start", "span_end").distinct()
    return fix.remaining_lines(rows, spans).select("file", "line", "raw")


@query(
    f"""{SCAN}, placed AS (SELECT key, key + 1 AS line, (key + 1) - (key + 1) % 3 AS span_start, stage, token FROM findings WHERE rank > 0)
SELECT span_start, count(DISTINCT line) AS hit_lines, min(line) AS line, arg_min(command, placed.key) AS "full" FROM placed JOIN live ON live.key = placed.key GROUP BY span_start"""
)
def fix_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct physical spans with a finding, the first finding of each."""
    entries = commands(spark, sf_dir)
    found = visible(scan(entries))
    start = F.col("line") - F.col("line") % 3
    spans = entries.select("file", "line", start.alias("span_start"), (start + 2).alias("span_end"))
    best = fix.removal_candidates(found, spans)
    hits = found.groupBy(start.alias("at")).agg(F.count_distinct("line").alias("hit_lines"))
    return best.join(hits, F.col("span_start") == F.col("at")).select("span_start", "hit_lines", "line", "full")


_FORMAT_SQL = """CASE WHEN path LIKE '%.jsonl' THEN CASE WHEN contains(p, '/.codex/history.jsonl') THEN 'codex_history' WHEN contains(p, '/.codex/sessions/') THEN 'codex_session'
  WHEN contains(p, '/.claude/history.jsonl') THEN 'claude_history' WHEN contains(p, '/.claude/projects/') THEN 'claude' WHEN contains(p, '/.gemini/tmp/') THEN 'gemini_jsonl'
  WHEN contains(p, '/.copilot/session-state/') THEN 'copilot' ELSE 'jsonl' END
  WHEN path LIKE '%.json' THEN CASE WHEN contains(p, '/.gemini/tmp/') THEN 'gemini_json' ELSE 'json' END WHEN path LIKE '%.md' OR path LIKE '%.markdown' THEN 'markdown' ELSE 'text' END"""


@query(
    f"""WITH q AS (SELECT page_id, path, replace(path, chr(92), '/') AS p FROM ({PATHS})), f AS (SELECT page_id, path, {_FORMAT_SQL} AS format FROM q)
SELECT page_id, path, format, CASE WHEN format IN ('json', 'gemini_json') THEN 'JSON document(s)' WHEN format IN ('markdown', 'text') THEN 'record(s)' ELSE 'JSONL record(s)' END AS unit FROM f"""
)
def format_for_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcript formats by path, and what their records are called."""
    rows = over(spark, sf_dir, PATHS).withColumn("format", deep.format_for_path(F.col("path")))
    return rows.select("page_id", "path", "format", deep.malformed_unit(F.col("format")).alias("unit"))


_EXCLUDED = ("/home/u/.codex/sessions", "/data/x.json", "/home/u/.gemini")
_ROOTS = ("/home/u", "/home/u/.claude", "/home/u/.claude/projects", "/data", "/home/u/.codex/sessions", "/home")


@query(
    f"SELECT page_id, path FROM ({PATHS}) p WHERE NOT EXISTS (SELECT 1 FROM (VALUES {', '.join(f'({chr(39)}{x}{chr(39)})' for x in _EXCLUDED)}) e(root) WHERE path = root OR starts_with(path, root || '/'))"
)
def path_exclusion_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths under no excluded root."""
    gone = spark.createDataFrame([(x,) for x in _EXCLUDED], "root string")
    return deep.outside(over(spark, sf_dir, PATHS), gone).select("page_id", "path")


@query(
    f"""SELECT path, root, CAST(ord AS INT) AS root_ord FROM (SELECT path, root, ord, row_number() OVER (PARTITION BY path ORDER BY length(root) DESC, ord) AS rn
FROM (SELECT DISTINCT path FROM ({PATHS})) JOIN (VALUES {', '.join(f"({i}, '{x}')" for i, x in enumerate(_ROOTS))}) r(ord, root) ON path = root OR starts_with(path, root || '/')) WHERE rn = 1"""
)
def root_longest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest root each path lies under."""
    roots = spark.createDataFrame([(x, i) for i, x in enumerate(_ROOTS)], "root string, root_ord int")
    return deep.root_of(over(spark, sf_dir, PATHS).select("path").distinct(), roots)


#: Messages inside arrays inside objects, with what JSON must escape; every seventh record is cut.
_NESTED = f"""SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 7 = 6 THEN left(record, length(record) - 1) ELSE record END AS record FROM (
  SELECT conv_id, turn, '{{"role": ' || QUOTED(role) || ', "at": {{"conv": ' || conv_id || ', "names": ["n' || conv_id || '", ' || QUOTED(t) || ', ""]}}, "deep": [{{"k": [[[[[[' || QUOTED(t) || ', 1e400]]]]]]}}]}}' AS record
  FROM (SELECT conv_id, turn, role, {TEXT} AS t FROM conversations WHERE role IS NOT NULL) a) b"""
_LEAVES = "json_tree(CASE WHEN json_valid(record) THEN record END) t WHERE t.type = 'VARCHAR') WHERE json_extract_string(atom, '$') <> ''"


@query(f"SELECT conv_id, turn, json_extract_string(atom, '$') AS leaf FROM (SELECT conv_id, turn, t.atom FROM ({quoted_json(_NESTED, spark=False)}), {_LEAVES}")
def json_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All string leaves of nested records that hold the messages' texts."""
    from vigil.operators.json_tree import string_leaves

    return string_leaves(over(spark, sf_dir, _NESTED), "record", ["conv_id", "turn"])


#: Properties of events with strings beside their numbers.
_PROPS = """SELECT event_id, '{"own": ' || props || ', "type": ' || QUOTED(event_type) || ', "user": ["u' || user_id || '", {"' || event_type || '": "' || user_id || '-' || event_id || '"}]}' AS record
  FROM events WHERE event_type IS NOT NULL AND props IS NOT NULL"""


@query(
    f"""SELECT event_id, json_extract_string(atom, '$') AS leaf FROM (SELECT event_id, t.atom FROM ({quoted_json(_PROPS, spark=False)}), {_LEAVES}"""
)
def json_leaves_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """String leaves of the events' properties beside their types and users;
    numbers aren't leaves."""
    from vigil.operators.json_tree import string_leaves

    return string_leaves(over(spark, sf_dir, _PROPS), "record", ["event_id"])


_EVENTS = "SELECT o_orderkey AS key, ['user.typed', 'prompt.x', 'assistant.reasoning', 'assistant.said', 'tool.start', 'tool.request', 'tool.done', 'session'][1 + o_orderkey % 8] AS kind FROM orders"


@query(
    f"""SELECT key, kind, CASE WHEN kind LIKE 'user.%' OR kind LIKE 'prompt.%' THEN 'user_input' WHEN kind LIKE '%reason%' THEN 'reasoning' WHEN kind LIKE 'assistant.%' THEN 'assistant'
WHEN kind LIKE 'tool.%' AND (kind LIKE '%start%' OR kind LIKE '%request%') THEN 'tool_call' WHEN kind LIKE 'tool.%' THEN 'tool_output' ELSE 'stored_context' END AS source FROM ({_EVENTS})"""
)
def transcript_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a transcript by event type."""
    rows = over(spark, sf_dir, _EVENTS.replace("[1 + o_orderkey % 8]", "[o_orderkey % 8]").replace("SELECT o_orderkey AS key, [", "SELECT o_orderkey AS key, array(").replace("][", ")["))
    return rows.select("key", "kind", deep.event_source(F.col("kind")).alias("source"))


@query(f"SELECT file, line, source FROM ({PIECES}) WHERE source IN ({quoted_list(('user_input', 'tool_call', 'tool_output', 'stored_context'))})")
def content_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of the parts that are scanned by default."""
    return deep.scanned_sources(pieces(spark, sf_dir)).select("file", "line", "source")


_RECORDS = f"""SELECT conv_id, turn, '{{"role": ' || QUOTED(role) || ', "text": ' || QUOTED(t) || CASE WHEN (conv_id * 31 + turn) % 11 = 0 THEN '' WHEN (conv_id + turn) % 13 = 0 THEN ', "n": 0' || turn || '}}' ELSE ', "n": ' || turn || '}}' END AS record
  FROM (SELECT conv_id, turn, role, {TEXT} AS t FROM conversations) a"""


@query(f"SELECT conv_id, count(*) AS records, count(*) FILTER (NOT json_valid(record)) AS malformed FROM ({quoted_json(_RECORDS, spark=False)}) WHERE record IS NOT NULL GROUP BY conv_id")
def malformed_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Malformed records of each file, among all."""
    from vigil.operators.json_tree import malformed

    rows = over(spark, sf_dir, _RECORDS).where("record IS NOT NULL")
    return rows.groupBy("conv_id").agg(F.count("*").alias("records"), F.count_if(malformed("record")).alias("malformed"))


_TOKENS = f"""WITH p AS ({PIECES}), t AS (
  SELECT file, line, source, unnest(regexp_extract_all(text, '(?:^|[^A-Za-z0-9_-])((?:ghp_|glpat-|npm_)[A-Za-z0-9_-]{{8,}})', 1)) AS token FROM p WHERE source <> 'assistant'
), s AS (SELECT DISTINCT file, line, source, token, 4 + 2 + 3 * CAST(list_entropy(string_split(token, '')) >= 3.5 - 1e-9 AS INT) AS score FROM t)"""


@query(
    f"""{_TOKENS} SELECT file, {_mask('token')} AS token, 'known_token' AS det_type, CASE WHEN max(score) >= 7 THEN 'high' ELSE 'medium' END AS severity, count(*) AS count, arg_min(source, line) AS source FROM s GROUP BY file, s.token"""
)
def deep_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct secrets of each transcript."""
    groups = deep.deep_groups(deep.deep_findings(pieces(spark, sf_dir)))
    return groups.select("file", "token", "det_type", "severity", "count", "source")


@query(f"{_TOKENS} SELECT count(*) AS secrets, count(DISTINCT file) AS files FROM (SELECT DISTINCT file, token FROM s)")
def deep_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct secrets and files with any."""
    return deep.totals(deep.deep_groups(deep.deep_findings(pieces(spark, sf_dir))))


@query(
    f"""{SCAN.replace("cmds AS MATERIALIZED (", "cmds0 AS MATERIALIZED (", 1).replace("live AS MATERIALIZED (SELECT * FROM cmds WHERE", "cmds AS MATERIALIZED (SELECT key, command || CASE key % 5 WHEN 0 THEN ' # allow' WHEN 1 THEN ' # deny' ELSE '' END AS command FROM cmds0), live AS MATERIALIZED (SELECT * FROM cmds WHERE", 1)}
SELECT c.key, CASE WHEN command LIKE '%# allow' THEN TRUE WHEN command LIKE '%# deny' THEN FALSE ELSE NOT EXISTS (SELECT 1 FROM findings f WHERE f.key = c.key AND rank >= 2) END AS allowed FROM cmds c"""
)
def hook_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each command may enter the history."""
    from vigil.streaming.scan import gate

    mark = F.when(F.col("key") % 5 == 0, " # allow").when(F.col("key") % 5 == 1, " # deny").otherwise("")
    rows = commands(spark, sf_dir).withColumn("command", F.concat("command", mark))
    return gate(rows).select("key", "allowed")


@query(f"{SCAN} SELECT key, det_type, token, {_NAME} AS severity FROM findings WHERE rank > 0")
def stream_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan as a stream over all there is, through files."""
    from vigil.streaming.scan import run_available, stream_findings

    schema = spark.read.parquet(f"{sf_dir}/orders.parquet").schema
    orders = spark.readStream.schema(schema).parquet(f"{sf_dir}/order[s].parquet")
    sql = COMMANDS.replace("FROM orders", "FROM {orders}")
    entries = spark.sql(sql, orders=orders)
    found = stream_findings(entries, redact=False).select("key", "det_type", "token", "severity")
    return run_available(spark, found)


@query(f"{SCAN} SELECT det_type, {_NAME} AS severity, count(*) AS n, count(DISTINCT token) AS tokens, min(score)::INT AS low, max(score)::INT AS high FROM findings GROUP BY det_type, rank")
def findings_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by type and severity."""
    found = scan(commands(spark, sf_dir), redact=False)
    groups = found.groupBy("det_type", "severity_rank").agg(F.count("*").alias("n"), F.count_distinct("token").alias("tokens"), F.min("score").alias("low"), F.max("score").alias("high"))
    return groups.withColumn("severity", severity_name(F.col("severity_rank"))).drop("severity_rank")


@query("SELECT doc_id, i AS line, strlen(raw) >= 4096 AS oversized FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)")
def oversized_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are too long to scan, under a limit of 4096 bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = lines.physical_lines(docs)
    return rows.select("doc_id", "line", lines.oversized(F.col("raw"), 4096).alias("oversized"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """High findings of the command corpus."""
    return visible(scan(commands(spark, sf_dir)), "high").select("key", "file", "line", "det_type", "score", "severity", "redacted", "recommendation")
