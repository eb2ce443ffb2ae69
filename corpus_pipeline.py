"""A corpus for training: quality, language, near duplicates, contamination, packing.

Each stage works on all that the one before it kept, and returns the columns of ``documents``; the
last returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.llm import decontaminate, jaccard, languages, packing, quality
from keepsake.llm.common import crc_rest, set_aside, table
from keepsake.llm.queries import tokenizer
from keepsake.session import stage_table


def rejects_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier finds more likely good than bad. It learns from the labels of
    rows that are not held out; without any label every document scores 0.5 and stays."""
    rest = crc_rest(F.col("doc_id"), 3)
    network = quality.train(docs, table(spark, sf_dir, "labels"), rest.isin(0, 2))
    own, back = set_aside(docs, ["score", "predicted"])
    return quality.score(own, network).filter(F.col("predicted") == 1).select(back)


def rejects_no_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which one language makes up at least a third; what has no letters goes. A text
    with passages in other languages stays, as long as one of them stands out."""
    model = languages.train(docs, crc_rest(F.col("doc_id"), 5) > 0)
    own, back = set_aside(docs, ["score", "lang_pred"])
    found = languages.predict(own, model)
    return found.filter(
        (F.col("lang_pred") != languages.UNKNOWN) & (F.col("score") >= 1 / 3)
    ).select(back)


def drops_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five words are similar by 0.8 or more."""
    return jaccard.keep_one(docs, jaccard.Spec(words=5, percent=80))


def drops_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth stands in windows of 13 benchmark words."""
    return decontaminate.without_documents(docs, table(spark, sf_dir, "benchmark"))


def packs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the sequences that training reads, with their ids' checksum."""
    packed = packing.pack(docs, tokenizer("byte_bpe_50k.json"), capacity=2048, end_id=0)
    return packed.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [
    ("quality", rejects_low_quality),
    ("language", rejects_no_language),
    ("near duplicates", drops_near_duplicates),
    ("decontamination", drops_contaminated),
    ("packing", packs),
]

#: A learned classifier and a tokenizer are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
