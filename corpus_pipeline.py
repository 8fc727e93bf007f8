"""A corpus pipeline over ``documents``: language ID, line dedup, near-dedup, decontamination, BPE.

Each stage is (name, function) with a function of (spark, docs, sf_dir); its result is written as Parquet and
read again as the next stage's docs.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import bpe, decontaminate, langid, line_dedup, simhash
from lectern.llm.common import free_names, own_columns, read_table, shared_dir

#: Documents whose language is less certain than this are rejected, as are those without letters.
LEAST_CERTAIN = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a recognised language; learned from the labelled rows of this stage's input.

    Null texts and texts without letters go.  Rows that repeat a doc_id are judged each by its own text, rows without one
    too; where nothing is labelled, nothing is recognised and nothing stays.
    """
    used = F.coalesce(langid.in_training(F.col("doc_id")), F.lit(True))
    tables = langid.train(docs.select("doc_id", "text", "lang").where(used))
    lang, score = free_names(docs, "lang_pred", "lang_score")
    kept = langid.predict(docs, tables).where((F.col(lang) != "und") & (F.col(score) >= LEAST_CERTAIN))
    return kept.select(*own_columns(docs))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that a document with a smaller doc_id holds; a document that loses every line goes.

    Nulls, repeated rows and rows without a doc_id are as in ``line_dedup.dedup_lines``; ``n_chars`` follows the text.
    """
    n_lines, n_dropped, kept_text = (F.col(c) for c in free_names(docs, *line_dedup.RESULTS))
    kept = line_dedup.dedup_lines(docs).where((n_dropped == 0) | (kept_text != ""))
    columns = {"text": F.when(n_dropped > 0, kept_text).otherwise(F.col("text")).alias("text")}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(n_dropped > 0, F.char_length(kept_text)).otherwise(F.col("n_chars")).cast("long").alias("n_chars")
    return kept.select(*[columns.get(c, F.col(f"`{c}`")) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: the one with the smallest doc_id.

    Five-word shingles and a similarity of 0.8; a text of fewer words is one shingle, wordless texts are one group.
    """
    return simhash.without_copies(docs, size=5, least=0.8)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item.

    Null and empty texts and rows without a doc_id stay, as they hold none; rows that repeat a doc_id are one document
    and go together.  An empty benchmark drops nothing.
    """
    return decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with digests of the ids and of the decoded text: a row for each row, null texts as empty."""
    coded = bpe.encode_decode(docs)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", dedup_lines),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminated),
    ("bpe", encode),
]

#: Language ID, XXH64 fingerprints and BPE are beyond SQL: tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    root = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        out.write.parquet(f"{root}/{i}-{name}")
        docs = spark.read.parquet(f"{root}/{i}-{name}")
    return docs
