"""The registered queries of this subpackage: each applies one operator, with
its production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the public vocabulary files are; a parameter of every query that uses one.
PACKAGE = "public_tokenizers"


def vocabulary(name: str) -> str:
    import importlib

    return importlib.import_module(PACKAGE).path(name)


def split_pattern() -> str:
    import importlib

    return importlib.import_module(PACKAGE).PATTERN


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every page as a WARC record and read the archive back."""
    from vigil.llm.warc import archive_round_trip

    found = archive_round_trip(spark, table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), q AS (
  SELECT page_id, octet_length(payload) AS n, sha1(payload) AS d, payload FROM p
), r AS (
  SELECT page_id, n, d, max(page_id) OVER (PARTITION BY d, n) AS keeper FROM q
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> keeper THEN keeper END AS refers_to
FROM r
"""


def fold(doc_id, count: int):
    """Which of ``count`` folds a row is in, by the CRC-32 of its id as text."""
    return F.crc32(doc_id.cast("string").cast("binary")) % count


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by code lengths under per-language models."""
    from vigil.llm.ppm import LanguageIdentifier

    docs = table(spark, sf_dir, "documents")
    model = LanguageIdentifier.fit(spark, docs.where(fold(F.col("doc_id"), 5) != 0), key="doc_id")
    found = model.predict(docs.select("doc_id", "text"), out="language")
    held_out = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "language.lang_pred", "language.score")


def _joined(spans: str):
    parts = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string")))
    return F.array_join(parts, ",")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: base patterns and induced contexts."""
    from vigil.llm.pii import KINDS, Extractor

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = Extractor(spark).find(docs)
    count = lambda kind: F.size(F.filter("found.base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(_joined("found.base"), 256).alias("base_sha256"),
        _joined("found.spans").alias("spans"),
        F.size("found.spans").cast("long").alias("n_spans"),
    )


def op4_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every document by byte-level BPE ranks and decode the ids again."""
    from vigil.llm.bpe import ByteBPE

    codec = ByteBPE(spark, vocabulary("byte_bpe_multi_50k.tiktoken"), split_pattern())
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return codec.round_trip(docs).select("doc_id", F.col("coded.*"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document and the verdict of risk-controlled rules."""
    from vigil.llm.quality_rules import apply_rules

    found = apply_rules(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in windows of ten benchmark words."""
    from vigil.llm.decontaminate import find_passages

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_passages(spark, docs, table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("leaks.hits", F.lit(0).cast("long"), lambda a, s: a + s["word_end"] - s["word"])
    return found.select(
        "doc_id",
        F.col("leaks.n_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size("leaks.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("leaks.items", ","), 256).alias("items_sha256"),
        (F.size("leaks.hits") > 0).alias("contaminated"),
    )


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learnt from positives and unlabelled texts."""
    from vigil.llm.pu_quality import QualityClassifier

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learn = fold(F.col("doc_id"), 4) != 2
    model = QualityClassifier.fit(spark, docs.where(learn), table(spark, sf_dir, "labels").where(learn))
    held_out = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    found = model.score(docs).withColumn("held_out", held_out)
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose word pairs are at least 0.8 similar."""
    from vigil.llm.near_duplicates import NearDuplicates

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return NearDuplicates(spark, shingle=2, similarity=0.8).find(docs)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents' ids to token files and read them back."""
    from vigil.llm.token_files import token_files

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_files(spark, docs, vocabulary("byte_bpe_50k.json"), end_id=2)


#: Tools that the derived calls name, and the schemas of their arguments.
TOOLS = {
    "search": {"type": "object", "properties": {"query": {"type": "string", "minLength": 1}, "limit": {"type": "integer", "minimum": 1, "maximum": 40}}, "required": ["query"], "additionalProperties": False},
    "combine": {"type": "object", "properties": {"left": {}, "right": {}}, "required": ["left", "right"], "additionalProperties": False},
}


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message of the dialogues and of the tool calls and results derived
    from them, as canonical JSON, with calls linked, validated and ordered."""
    from vigil.llm.chat import ChatFormatter, dialogue_calls

    return ChatFormatter(spark, TOOLS).format(dialogue_calls(table(spark, sf_dir, "conversations")))


OP10_SQL = """
WITH RECURSIVE c AS (
  SELECT conv_id, turn, role, text, coalesce(len(string_split(text, ' ')), 0) AS pieces FROM conversations
), u AS (
  SELECT DISTINCT conv_id, turn FROM c WHERE role = 'user'
), chain AS (
  SELECT u.conv_id, u.turn, 1 AS level FROM u JOIN u AS before ON before.conv_id = u.conv_id AND before.turn = u.turn - 2 WHERE u.turn IN (2, 3)
  UNION ALL
  SELECT u.conv_id, u.turn, chain.level + 1 FROM u JOIN chain ON chain.conv_id = u.conv_id AND u.turn = chain.turn + 2
), calls AS (
  SELECT c.*, CASE WHEN text <> '' AND pieces BETWEEN 1 AND 40 THEN 0 ELSE 1 END AS bad FROM c WHERE role = 'user'
), results AS (
  SELECT c.*, u.turn IS NOT NULL AS linked FROM c LEFT JOIN u ON u.conv_id = c.conv_id AND u.turn = c.turn - 1 WHERE role = 'assistant'
)
SELECT conv_id, 4 * turn AS turn, role, 'plain' AS kind, false AS linked, 4 * turn AS order_turn, -1 AS order_level, -1 AS order_index,
       CAST(0 AS BIGINT) AS n_calls, CAST(0 AS BIGINT) AS n_invalid,
       '{"content":' || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || ',"role":' || to_json(role) || '}' AS json
FROM c
UNION ALL
SELECT conv_id, 4 * turn + 1, 'assistant', 'call', false, 4 * turn + 1, -1, -1, CASE WHEN turn >= 2 THEN 2 ELSE 1 END, bad,
       '{"content":null,"role":"assistant","tool_calls":[{"arguments":{"limit":' || pieces || ',"query":' || coalesce(CAST(to_json(text) AS VARCHAR), 'null')
       || '},"id":"u' || turn || '","name":"search"}' || CASE WHEN turn >= 2 THEN ',{"arguments":{"left":{"$ref":"'
       || CASE WHEN turn >= 4 THEN 's' ELSE 'u' END || (turn - 2) || '"},"right":{"$ref":"u' || turn || '"}},"id":"s' || turn || '","name":"combine"}' ELSE '' END || ']}'
FROM calls
UNION ALL
SELECT conv_id, 4 * turn + 2, 'tool', 'result', linked, CASE WHEN linked THEN 4 * (turn - 1) + 1 ELSE 4 * turn + 2 END, CASE WHEN linked THEN 0 ELSE -1 END,
       CASE WHEN linked THEN 0 ELSE -1 END, 0, 0,
       '{"content":' || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || ',"role":"tool","tool_call_id":"u' || (turn - 1) || '"}'
FROM results
"""


def chat_tool_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every derived call with its level, verdict and result."""
    from vigil.llm.chat import ChatFormatter, dialogue_calls

    found = ChatFormatter(spark, TOOLS).link(dialogue_calls(table(spark, sf_dir, "conversations")))
    return found.select("conv_id", "call_id", "name", "call_turn", "valid", F.size("errors").alias("n_errors"), "duplicate", "level", "result_turn")


#: The recursion follows each chain of calls.
CHAT_TOOL_LINKS_SQL = OP10_SQL[: OP10_SQL.index("SELECT conv_id, 4 * turn AS turn")] + """
SELECT calls.conv_id, 'u' || calls.turn AS call_id, 'search' AS name, 4 * calls.turn + 1 AS call_turn, bad = 0 AS valid, CAST(bad AS INT) AS n_errors,
       false AS duplicate, 0 AS level, min(4 * r.turn + 2) AS result_turn
FROM calls LEFT JOIN results AS r ON r.conv_id = calls.conv_id AND r.turn = calls.turn + 1 GROUP BY ALL
UNION ALL
SELECT calls.conv_id, 's' || calls.turn, 'combine', 4 * calls.turn + 1, true, 0, false, chain.level, NULL
FROM calls LEFT JOIN chain ON chain.conv_id = calls.conv_id AND chain.turn = calls.turn WHERE calls.turn >= 2
"""


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's whitened components, a row for each."""
    from vigil.llm.whitening import Whitener

    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = Whitener(spark, components=32).fit(rows)
    shares = F.array(*[F.lit(float(e) / model.trace) for e in model.values]).cast("array<double>")
    each = model.apply(rows).select("vec_id", "white.deviation", F.posexplode(F.arrays_zip(F.col("white.values").alias("whitened"), shares.alias("explained"))).alias("at", "c"))
    return each.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "c.whitened", "c.explained", F.lit(model.identity_error).alias("identity_error")
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, from all vectors."""
    from vigil.llm.hard_negatives import HardNegatives

    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return HardNegatives(spark).mine(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


OP12_SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM e AS a JOIN e AS b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.other_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY s.score DESC, s.other_id) AS INT) AS rank,
       s.other_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 100 * s.score BETWEEN 30 * p.score AND 90 * p.score
QUALIFY rank <= 10
"""


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages of 13 words that an earlier one holds."""
    from vigil.llm.repeats import SubstringDedup

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = SubstringDedup(spark, width=13).remove(docs)
    return found.select("doc_id", "repeats.n_words", "repeats.n_removed", F.sha2("repeats.kept", 256).alias("kept_sha256"))


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS words FROM d, unnest(range(1, len(w) - 11)) AS t(i)
), seen AS (
  SELECT doc_id, i, min(doc_id) OVER (PARTITION BY words) < doc_id AS again FROM win
), gone AS (
  SELECT doc_id, list_distinct(flatten(list(range(i, i + 13)))) AS at FROM seen WHERE again GROUP BY doc_id
), left_over AS (
  SELECT d.doc_id, len(w) AS n, CASE WHEN gone.at IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone.at, i)) END AS kept
  FROM d LEFT JOIN gone ON gone.doc_id = d.doc_id
)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(n - len(kept) AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM left_over
"""


def queries() -> dict:
    """One query for each operator, and the links of op10's calls."""
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)} | {"chat_tool_links": chat_tool_links}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1_SQL, "op10_chat": OP10_SQL, "chat_tool_links": CHAT_TOOL_LINKS_SQL, "op12_hard_negatives": OP12_SQL, "op13_substring_dedup": OP13_SQL}
