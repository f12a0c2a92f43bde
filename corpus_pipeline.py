"""A corpus pipeline of training-data operators: each stage is written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import jaccard_join, language_id, sentencepiece_codec, source_mixing, suffix_dedup
from millrace.llm.common import materialise


COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _aside(docs: DataFrame) -> DataFrame:
    """Extra columns under names that no operator adds, so that a stage gives them back as they came."""
    return docs.toDF(*(n if n in COLUMNS else f"extra_{k}" for k, n in enumerate(docs.columns)))


def _back(out: DataFrame, own: DataFrame, docs: DataFrame) -> DataFrame:
    return out.select(*own.columns).toDF(*docs.columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go; a null language becomes the predicted one.

    A null text and one without a letter are rejected. Repeated rows are judged alike, each by itself. An empty table stays empty; extra
    columns, whatever their names, pass.
    """
    own = _aside(docs)
    model = language_id.fit(own, F.lit(True))
    judged = language_id.predict(own, model).filter(~F.col("lang_rejected"))
    return _back(judged.withColumn("lang", F.coalesce("lang", "lang_pred")), own, docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents that link by five-word shingles at 0.8 or more, the least id of each group stays.

    Null and empty texts link with nothing and stay; so do rows that share the id that stays, and rows without an id. An empty table stays
    empty; extra columns, whatever their names, pass.
    """
    own = _aside(docs)
    return _back(jaccard_join.one_of_each_group(own), own, docs)


def remove_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes covered by a 100-byte string that starts earlier go; a character that loses a byte goes whole.

    No row goes: a null text stays null, an emptied one is empty. Rows that share an id are one document; null ids come last. ``n_chars``,
    where there is such a column, is counted again for texts that changed. An empty table stays empty; extra columns, whatever their
    names, pass.
    """
    own = _aside(docs)
    left = suffix_dedup.remove_repeats(own)
    left = left.withColumn("text", F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept_text")))
    if "n_chars" in own.columns:
        left = left.withColumn("n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.char_length("text").cast("long")))
    return _back(left, own, docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and the last time as far, as the mixture of the sources takes them.

    Null and empty texts have no words, so nothing is taken of them. A null source is one source, the last. An empty table stays empty;
    extra columns, whatever their names, pass.
    """
    own = _aside(docs)
    return _back(source_mixing.mixed_documents(own), own, docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text; (doc_id, ids, n_tokens). A null or empty text has the end id alone; each row gives a row, whatever its id; extra
    columns are left out."""
    return sentencepiece_codec.encode_documents(docs).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("language_id", identify_language),
    ("jaccard_join", drop_near_duplicates),
    ("suffix_dedup", remove_repeated_strings),
    ("source_mixing", mix_sources),
    ("sentencepiece", encode),
]

#: The stages learn models, sort suffixes and look up merges, which SQL doesn't express; tests compare them with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"stage-{name}")
    return docs
