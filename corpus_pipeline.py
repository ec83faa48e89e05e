"""A corpus pipeline of five of the training-data operators; each stage is written and reread as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm import decontam, langid, minhash, mixing, secret_scan
from stratalog.llm.common import drop_saved, id_fold, save, scratch, table
from stratalog.session import ship

#: Up to so many contaminated ids are broadcast; beyond, the anti-join shuffles.
BROADCAST_IDS = 1_000_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without an identifiable language; the model learns from the labelled rows outside the held-out fold.

    Null texts and texts without a letter go; a tie goes to the first language by name; rows without an id are judged like others;
    repeated rows stay repeated or all go; texts of any length are read whole; an empty table stays empty.
    """
    ship(spark)
    model = langid.train(docs.where(id_fold(F.col("doc_id"), 3) != 1))
    return langid.keep_identified(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies (five-word shingles, similarity 0.8 or more).

    Rows without an id and documents without words link with nothing and stay. Of rows that share an id and a text, and of several texts
    of one id, one stays: that first by text. An empty table stays empty.
    """
    ship(spark)
    kept = minhash.near_duplicates(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    several = save(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("doc_id"), "nd-several")
    rows = docs.join(kept, "doc_id").select(*docs.columns)
    first = rows.join(several, "doc_id").groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.struct(F.coalesce("text", F.lit("")), F.to_json(F.struct(*docs.columns)))).alias("row")).select("row.*")
    return rows.join(several, "doc_id", "left_anti").select(*docs.columns).unionByName(first).unionByName(docs.where("doc_id is null"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage, re-parameterised ones included.

    Rows without an id and null texts stay; rows that share a flagged id all go; an empty table stays empty.
    """
    flagged = save(decontam.contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct(), "dc-flagged")
    return docs.join(F.broadcast(flagged) if flagged.count() <= BROADCAST_IDS else flagged, "doc_id", "left_anti").select(*docs.columns)


def scan_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret in the texts; all rows stay, repeated ones and those without an id or text too."""
    ship(spark)
    return secret_scan.redact_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes words of, with their text and all columns, and how many words it takes (``taken``).

    A null source is a source of its own; null and empty texts have no words and go; exact copies share what is taken of them; an empty
    table stays empty.
    """
    return mixing.mix_rows(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("secret_scan", scan_secrets),
    ("mixing", mix_sources),
]

#: Learnt languages and guess costs have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each cut off from the one before by a table in the shared folder.

    What a stage left there beside its result goes when the stage is done, and its input with it.
    """
    docs, written = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch(spark):
            after = save(stage(spark, docs, sf_dir), f"pipeline-{name}", keep=True)
        if written is not None:
            drop_saved(written)
        docs = written = after
    return docs
