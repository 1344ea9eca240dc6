"""From raw documents to token ids: five stages, each one operator of vigil.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's docs. All but the last return the
columns of ``documents``; texts that a stage changes get a new ``n_chars``.
Extra columns pass through under their own names, rows that repeat are handled
one by one, and empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm import queries as q
from vigil.session import materialize


def _counted(docs: DataFrame) -> DataFrame:
    """Bring n_chars in line with the text, where there is such a column."""
    if "n_chars" not in docs.columns:
        return docs
    kind = dict(docs.dtypes)["n_chars"]
    return docs.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(kind)).otherwise(F.col("n_chars")))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier doesn't reject: those
    that score 0.7 or more. Null and empty texts have a score like any other;
    equal texts have equal scores."""
    from vigil.llm.pu_quality import QualityClassifier

    learn = q.fold(F.col("doc_id"), 4) != 2
    model = QualityClassifier.fit(spark, docs.where(learn), q.table(spark, sf_dir, "labels").where(learn))
    name = "_score"
    while name in docs.columns:
        name += "_"
    return model.score(docs, out=name).where(F.col(name) >= 0.7).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the least
    doc_id. Texts without words and rows without doc_id stay."""
    from vigil.llm.near_duplicates import NearDuplicates

    return NearDuplicates(spark, shingle=5, similarity=0.8).keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages they share with the benchmark. Null texts
    stay null, and a text that is a passage as a whole becomes a line break."""
    from vigil.llm.decontaminate import remove_passages

    return _counted(remove_passages(spark, docs, q.table(spark, sf_dir, "benchmark")))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by the name of its kind. Null texts
    stay null; of overlapping spans the first is named."""
    from vigil.llm.pii import Extractor

    return _counted(Extractor(spark).mask(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every document; none for null and empty texts."""
    from vigil.llm.bpe import ByteBPE

    codec = ByteBPE(spark, q.vocabulary("byte_bpe_multi_50k.tiktoken"), q.split_pattern())
    coded = codec.encode(docs.select("doc_id", "text"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality_classifier", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("pii", pii),
    ("byte_level_bpe", tokens),
]

#: SQL can't express the classifier, the similarity groups or the merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = q.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(spark, stage(spark, docs, sf_dir), name)
    return docs
