"""A corpus made ready for training: five stages, each over all that the one before kept.

Documents that the quality classifier rejects go; of near duplicates one stays; personal data becomes pseudonyms; the
rest is laid out in the order of a mix with target weights per source; and packed into sequences in that order.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowgrain.llm import mixing, packing, pii, quality, simhash
from rowgrain.session import checkpoint_folder

#: The key of the pseudonyms in the registered pipeline; a real corpus gets a secret one.
PSEUDONYM_KEY = "registered pipeline"


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Four words to a shingle; documents are near duplicates at four or fewer differing bits of 64."""
    return simhash.keep_first(docs, simhash.SimHash(words=4, words64=1, distance=4))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.pseudonymised(docs, PSEUDONYM_KEY).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows in the order of the mix: files, and rows in them, follow one another."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = mixing.placed(docs)
    return placed.repartitionByRange(parts, "slot", "in_block").sortWithinPartitions("slot", "in_block").select(*docs.columns)


def in_stored_order(docs: DataFrame) -> DataFrame | None:
    """``doc_id, text, position``: the place of a row among the files it was written to, gapless where they are read whole.

    Files follow one another by the number of the task that wrote them.  None where the rows do not come from files.
    """
    try:
        rows = docs.select("doc_id", "text", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    except AnalysisException:
        return None
    sizes = rows.groupBy("_file").agg((F.max("_at") + 1).alias("_size"))  # one row per file
    before = Window.orderBy(F.regexp_extract("_file", r"part-(\d+)[^/]*$", 1).try_cast("long"), "_file").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_file", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    return rows.join(F.broadcast(starts), "_file").select("doc_id", "text", (F.col("_start") + F.col("_at")).alias("position"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences in the order in which the stage before wrote the rows; rows that were not written go in that of the scan."""
    stored, cap = in_stored_order(docs), packing.Capacity(tokens=2048)
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    if stored is None:
        return packing.pack_documents(docs, tokenizer, cap)
    return packing.pack_documents(stored, tokenizer, cap, position="position")


STAGES = [("quality", good), ("near_duplicates", distinct), ("pii", private), ("mixing", mixed), ("packing", packed)]

#: Fingerprints, Feistel networks and packing are beyond SQL; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written as Parquet and read again by the next."""
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(path := f"{folder}/{k}-{name}")
            docs = spark.read.parquet(path)
    return docs
