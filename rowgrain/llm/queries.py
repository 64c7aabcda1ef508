"""One registered query per operator, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rowgrain.llm import alignment, imatch, language, mixing, packing, pii, pivots, quality, simhash, suffixes, token_counts, token_files, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The key of the pseudonyms in the registered queries; a real corpus gets a secret one.
PSEUDONYM_KEY = "registered queries"


@query("op1_pii_pseudonyms")
def op1(spark, sf):
    return pii.pseudonymised(table(spark, sf, "documents"), PSEUDONYM_KEY)


@query("op2_token_files")
def op2(spark, sf):
    return token_files.written_and_read(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end=2)


@query("op3_embedding_near_duplicates")
def op3(spark, sf):
    return vectors.near_duplicates(table(spark, sf, "embeddings"), cosine=0.9)


@query("op4_pfair_mixing")
def op4(spark, sf):
    mixed = mixing.mix(table(spark, sf, "documents"))
    return mixed.select("doc_id", "source", "block", "release", "deadline", "slot", "in_block", "position", "mixed")


@query("op5_simhash_near_duplicates")
def op5(spark, sf):
    return simhash.near_duplicates(table(spark, sf, "documents"), simhash.SimHash(words=4, words64=1, distance=4))


@query("op6_suffix_intervals")
def op6(spark, sf):
    return suffixes.removed(table(spark, sf, "documents"), length=400, text=True)


@query("op7_token_counts")
def op7(spark, sf):
    return token_counts.token_counts(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


@query("op8_vector_best_fit_packing")
def op8(spark, sf):
    return packing.pack_documents(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"), packing.Capacity(tokens=2048))


@query("op9_quality_factorisation_machine")
def op9(spark, sf):
    return quality.judged(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op10_imatch_fingerprints")
def op10(spark, sf):
    return imatch.edit_test(table(spark, sf, "documents"))


@query("op11_pivot_table_clusters", pivots.clusters_sql())
def op11(spark, sf):
    return pivots.clusters(table(spark, sf, "embeddings"))


@query("op12_language_centroids")
def op12(spark, sf):
    return language.predicted(table(spark, sf, "documents"))


@query("op13_tokenizer_alignment")
def op13(spark, sf):
    return alignment.align(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
