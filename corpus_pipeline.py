"""The corpus pipeline: stages over documents, each a DataFrame of what it keeps, written and read again between stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specgrain.llm.common import materialize, table
from specgrain.llm.decontamination import leaks
from specgrain.llm.near_dups import near_duplicates
from specgrain.llm.quality import quality_scores
from specgrain.llm.sentencepieces import encode_documents
from specgrain.llm.suffix_dedup import strip_repeats


def _free(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have."""
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    return name


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, doesn't reject.

    A score depends on the text alone, so a rejection holds for an id (null too) with a text: other rows of the id stay. A null or empty text is scored like any
    other. All rows stay where nothing was learnt (no label of a document, an empty table), or where all texts score 0.5.
    """
    name = _free(docs, "_text")
    keyed = docs.withColumn(name, F.xxhash64(F.coalesce("text", F.lit(""))))
    scored = quality_scores(keyed, table(spark, sf_dir, "labels"), keep=(name,))
    if scored.where("score <> 0.5").isEmpty():
        return docs
    rejected = scored.where("predicted = 0").select(F.col("doc_id").alias("id"), F.col(name).alias("hash")).distinct()
    return keyed.join(rejected, keyed["doc_id"].eqNullSafe(rejected["id"]) & (keyed[name] == rejected["hash"]), "left_anti").select(*docs.columns)


def near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that with the smallest doc_id, the first such row if it is repeated, and any row if all ids are null.

    Rows are numbered in a table first, as ids may be null or repeated. Null and empty texts are one group: one of them stays. An empty table gives no rows.
    """
    name = _free(docs, "_row")
    rows = materialize(docs.withColumn(name, F.monotonically_increasing_id()), "pipeline-rows")
    ranked = rows.select(F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col(name).alias("c")).alias("key"), "text")
    kept = near_duplicates(ranked, key="key").where("kept").select(F.col("doc_id.c").alias(name))
    return rows.join(kept, name, "left_semi").select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the bytes of 100-byte strings that start earlier too; n_chars follows the text.

    Of rows with one doc_id none is earlier, so repeated rows stay equal; a null id is earlier than all others; a null text becomes empty; an empty table gives no rows.
    """
    return strip_repeats(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item.

    Each id (null too) with a text is judged by itself, so another row of a leaking id stays unless it leaks too, and repeated rows go or stay together. Null and empty texts
    hold nothing and stay; with an empty benchmark all rows stay.
    """
    name = _free(docs, "_key")
    keyed = docs.withColumn(name, F.xxhash64("doc_id", "text"))
    leaking = leaks(keyed, table(spark, sf_dir, "benchmark"), key=name).select(F.col("doc_id").alias(name)).distinct()
    return keyed.join(leaking, name, "left_anti").select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids and round_trip of every row left: null ids and repeated rows too; a null or empty text has no pieces."""
    import public_tokenizers

    return encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality classifier", quality),
    ("near duplicates", near_dups),
    ("repeated passages", repeated_passages),
    ("benchmark decontamination", decontamination),
    ("sentencepiece encoding", encoding),
]

#: The stages train models and merge tokens; SQL can't express them. tests/llm hold them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the last one's rows."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name.replace(' ', '-')}")
    return docs
