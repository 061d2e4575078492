"""A training corpus from raw documents: five stages, each one operator of ``cohortforge.llm``.

Every stage reads all that its predecessor kept and its decision takes effect:
toxic documents go, documents without a clear language go, one document of each
near-duplicate class stays, personal data is replaced in the texts (``n_chars``
follows), and what is left is packed into sequences.  All stages but the last
return the columns of their input, which are those of ``documents``.

Defined results: a null or wordless text has nothing to score, and goes in the
language stage as a text without letters; repeated rows and rows that share a
doc_id are rows of their own (of equal texts the smallest doc_id stays, nulls
last, then any one row); texts of any length are read whole; columns beyond those
of ``documents`` are kept by all stages but the last, whatever their names; an
empty table gives empty stages.

SQL can't express these stages, so ``ORACLE_SQL`` is None; ``tests/llm`` holds
the pipeline against brute-force versions of its stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortforge.llm import chosen_path, deobfuscate, language_fusion, packing, pii_vote
from cohortforge.llm.arrow_text import unused_name
from cohortforge.llm.shipping import ship
from cohortforge.llm.word_tokens import load_definition, public_vocabulary
from cohortforge.sources.staging import stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose restored text scores below 0.5."""
    model, scorer = deobfuscate.learn(ship(spark), docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return deobfuscate.reject_toxic(docs, model, scorer)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters whose language is clear from text, declared language and source."""
    ship(spark)
    model = language_fusion.TextModel.collect(language_fusion.count_languages(docs))
    return language_fusion.keep_known(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each similarity class: the smallest doc_id."""
    ship(spark)
    return chosen_path.keep_one(docs)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in the text replaced by its kind."""
    ship(spark)
    was = unused_name(docs, "length_before")
    changed = pii_vote.redact(docs.withColumn(was, F.length("text")))
    grown = F.coalesce(F.length("text") - F.col(was), F.lit(0))
    return changed.withColumn("n_chars", (F.col("n_chars") + grown).cast(docs.schema["n_chars"].dataType)).drop(was)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    ship(spark)
    return packing.pack_texts(docs, load_definition(public_vocabulary()))


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", replace_personal_data),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline_{name}")
    return docs
