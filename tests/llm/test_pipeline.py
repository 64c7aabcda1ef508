"""The pipeline against plain versions of its stages, and the registered queries as a whole."""

import sys

import pytest
from pyspark.sql import functions as F

from conftest import ROOT
from helpers import SMALL, awkward, documents, nothing, rows_of
from test_links import expected

sys.path.insert(0, ROOT)
import __spark_entry__ as entry_module  # noqa: E402
import corpus_pipeline  # noqa: E402
from rowgrain.llm import mixing, packing, queries  # noqa: E402
from rowgrain.llm.tokens import Pieces  # noqa: E402
import public_tokenizers  # noqa: E402


def test_registered():
    names = set(entry_module.queries())
    assert {k.split("_")[0] for k in queries.QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(queries.QUERIES) | {"pipeline"} <= names
    assert "pipeline" not in entry_module.oracle_sql()


def test_stages(spark):
    docs = documents(spark)
    given, labels = rows_of(docs), rows_of(spark.read.parquet(f"{SMALL}/labels.parquet"))
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        before = rows_of(kept) if name != "packing" else None
        out = stage(spark, kept, SMALL)
        rows = out.collect()
        if name == "packing":
            break
        assert out.columns == docs.columns
        ids = [r.doc_id for r in rows]
        assert len(ids) == len(set(ids)) and set(ids) <= set(before)
        now = {r.doc_id: r for r in rows}
        if name == "quality":
            judged = [(labels[i].quality, i in now) for i in given if i in labels]
            assert sum(q == k for q, k in judged) / len(judged) > 0.97
        if name == "near_duplicates":
            want = expected({i: r.text for i, r in before.items()}, 4)
            assert set(now) == {i for i, (_, component) in want.items() if component == i} < set(before)
        if name == "pii":
            assert ids and set(ids) == set(before) and any(now[i].text != before[i].text for i in ids)
        if name == "mixing":
            assert {i: tuple(r) for i, r in now.items()} == {i: tuple(r) for i, r in before.items()}
        kept = spark.createDataFrame(rows, docs.schema)
    lib = Pieces(public_tokenizers.path("word_bpe_49k.json"))
    want = {r.doc_id: len(x) + 1 for r, x in zip(kept.collect(), lib.ids([r.text for r in kept.collect()]))}
    got = {}
    for r in rows:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want


def test_sequences_follow_the_mix_in_reread_files(spark, tmp_path):
    text = F.when(F.col("doc_id") % 7 == 0, F.concat_ws(" ", *["text"] * 40)).otherwise(F.col("text"))
    docs = documents(spark).withColumn("text", F.substring(text, 1, 40_000))
    position = {r.doc_id: r.position for r in mixing.mix(docs).select("doc_id", "position").collect()}
    corpus_pipeline.mixed(spark, docs, SMALL).write.parquet(f"{tmp_path}/mixed")
    reread = spark.read.parquet(f"{tmp_path}/mixed").repartition(5, "text")
    rows = corpus_pipeline.packed(spark, reread, SMALL).collect()
    first = {}
    for r in rows:
        first[r.sequence_id] = min(first.get(r.sequence_id, (1 << 40, 0)), (position[r.doc_id], r.piece))
    assert any(r.length == 2048 for r in rows) and {r.doc_id for r in rows} == set(position)
    assert [first[s] for s in sorted(first)] == sorted(first.values())
    at = docs.join(spark.createDataFrame(list(position.items()), "doc_id long, position long"), "doc_id")
    small = packing.pack_documents(at, public_tokenizers.path("word_bpe_49k.json"), position="position", shard=16).collect()
    shards = {}
    for r in small:
        shards.setdefault(r.sequence_id, set()).add(position[r.doc_id] // 16)
    assert all(len(x) == 1 for x in shards.values())
    assert [min(shards[s]) for s in sorted(shards)] == sorted(min(x) for x in shards.values())


def test_run(spark):
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert rows and {r.doc_id for r in rows} < set(rows_of(documents(spark)))


@pytest.mark.parametrize("make", [awkward, nothing])
def test_stages_on_awkward_rows(spark, make):
    docs = make(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        out.count()
        if name != "packing":
            assert set(out.columns) <= set(docs.columns)


def test_packing_follows_the_order_that_was_stored(spark, tmp_path):
    docs = documents(spark).withColumn("text", F.substring("text", 1, 3000))
    ids = sorted((r.doc_id for r in docs.select("doc_id").collect()), reverse=True)
    docs.repartitionByRange(3, F.col("doc_id").desc()).sortWithinPartitions(F.col("doc_id").desc()).write.parquet(f"{tmp_path}/down")
    place = {d: n for n, d in enumerate(ids)}
    reread = spark.read.parquet(f"{tmp_path}/down")
    assert {r.doc_id: r.position for r in corpus_pipeline.in_stored_order(reread).collect()} == place
    first = {}
    for r in corpus_pipeline.packed(spark, reread, SMALL).collect():
        first[r.sequence_id] = min(first.get(r.sequence_id, 1 << 40), place[r.doc_id])
    assert len(first) > 1 and [first[s] for s in sorted(first)] == sorted(first.values())
    assert corpus_pipeline.in_stored_order(spark.createDataFrame(docs.limit(3).collect(), docs.schema)) is None
