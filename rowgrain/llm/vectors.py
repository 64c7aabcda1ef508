"""Near-duplicate embeddings: random-hyperplane sign hashing in several tables, then the exact cosine.

Two vectors at angle ``t`` have one sign bit equal with probability ``1 - t / pi``.  The bits of a table follow the
number of vectors, so that a bucket of unrelated vectors keeps its size, and the number of tables follows from the
bits, the cosine asked for and the recall.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowgrain.llm.links import components, linked_in_buckets, with_components
from rowgrain.session import cut_lineage

#: Unrelated vectors in a bucket, on average.
BUCKET_ROWS = 128
#: Probability of meeting in some table for a pair just at the threshold.
RECALL = 0.995


def tables_and_bits(n: int, cosine: float, recall: float = RECALL) -> tuple[int, int]:
    """Tables and bits per table for ``n`` vectors."""
    bits = max(4, math.ceil(math.log2(max(n, BUCKET_ROWS) / BUCKET_ROWS)))
    meet = (1 - math.acos(cosine) / math.pi) ** bits
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet))), bits


def _hashed(dim: int, tables: int, bits: int, seed: int):
    """Rows of ``id, copies, vector`` with one row per table; ``data``: the vector, then its code in every table."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = np.random.Generator(np.random.PCG64(seed)).standard_normal((dim, tables * bits))
        weight = 1 << np.arange(bits, dtype=np.int64)
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                n = part.num_rows
                x = np.frombuffer(b"".join(part["vector"].to_pylist()), dtype="<f8").reshape(n, dim)
                codes = ((x @ planes > 0).reshape(n, tables, bits) @ weight).astype("<i8")
                data = np.concatenate([x.view(np.uint8).reshape(n, -1), codes.view(np.uint8).reshape(n, -1)], axis=1)
                rows = pa.array(np.repeat(np.arange(n), tables))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.tile(np.arange(tables, dtype=np.int32), n)), pa.array(codes.ravel()), part["id"].take(rows),
                     part["copies"].take(rows), pa.array([r.tobytes() for r in data], pa.binary()).take(rows)],
                    names=["table", "key", "id", "copies", "data"],
                )

    return work


def _close(dim: int, cosine: float):
    """Unit vectors with a cosine of at least ``cosine``, accepted in the first table where they meet only."""

    def compare(data: np.ndarray, i: np.ndarray, j: np.ndarray, table: np.ndarray) -> np.ndarray:
        x = np.ascontiguousarray(data[:, : 8 * dim]).view("<f8")
        codes = np.ascontiguousarray(data[:, 8 * dim:]).view("<i8")
        out = np.einsum("ij,ij->i", x[i], x[j]) >= cosine
        at = np.flatnonzero(out)
        meet = codes[i[at]] == codes[j[at]]
        out[at] = np.argmax(meet, axis=1) == table[at]
        return out

    return compare


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, recall: float = RECALL, seed: int = 7) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``vectors (vec_id, embedding)``.

    Equal vectors are one node with copies, so a frequent vector costs nothing.  NULL, zero and empty vectors, and
    those with NULL or non-finite components, have no links; how large or small finite components are makes no
    difference.  Vectors of different lengths have no cosine, so each length is searched by itself, one after the
    other.  ``component_id`` is the smallest ``vec_id`` reachable.  Rows with
    a NULL ``vec_id`` have no links and are returned with NULL names; ``vec_id`` is a key otherwise.  Other columns
    are ignored; an empty table gives an empty result.
    """
    v = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(finite & F.exists(v, lambda x: x != 0) & F.col("vec_id").isNotNull(), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(usable, v).alias("v")).withColumn("value", F.xxhash64("v"))
    # A node is a vector with all its copies; the hash of the vector only shortens the key.
    reps = cut_lineage(
        rows.filter("v is not null").groupBy("value", "v").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"))
    )
    # As many rows as lengths.
    sizes = reps.groupBy(F.size("v").alias("dim")).count().orderBy("dim").collect()
    searched = [_found(reps.filter(F.size("v") == s["dim"]), s["dim"], s["count"], cosine, recall, seed) for s in sizes]
    if not searched:
        none = F.col("vec_id")
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), none.alias("component_id"), (none == none).alias("kept"))
    found = cut_lineage(reduce(DataFrame.unionByName, searched))
    links = found.groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("others"))
    roots = components(found.filter("a <> b").select("a", "b")).withColumnRenamed("node", "id")
    nodes = (
        reps.drop("v", "value").join(links, "id", "left").join(roots, "id", "left")
        .filter("copies > 1 or others is not null")
        .select(F.col("id").alias("rep"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "id").alias("component"))
    )
    # Copies find their node through the vector; its hash alone would do but for collisions.
    named = reps.select("value", "v", F.col("id").alias("rep")).join(nodes, "rep").drop("rep").withColumn(
        "value", F.struct("value", "v")).drop("v")
    looked = with_components(rows.select("vec_id", F.struct("value", "v").alias("value")), "value", named)
    component = F.coalesce("component", "vec_id")
    return looked.select(
        "vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        (F.col("vec_id") == component).alias("kept"),
    )


def _found(reps: DataFrame, dim: int, n: int, cosine: float, recall: float, seed: int) -> DataFrame:
    """``(a, b, links)`` among the ``n`` nodes ``reps (id, copies, v)`` of one length."""
    tables, bits = tables_and_bits(n, cosine, recall)

    def unit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b["v"].flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, dim)
            x = x / np.abs(x).max(axis=1, keepdims=True)
            x = (x / np.sqrt((x * x).sum(axis=1, keepdims=True))).astype("<f8")
            yield pa.RecordBatch.from_arrays(
                [b["id"], b["copies"], pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "copies", "vector"]
            )

    units = reps.select("id", "copies", "v").mapInArrow(unit, "id long, copies long, vector binary")
    keyed = units.mapInArrow(_hashed(dim, tables, bits, seed), "table int, key long, id long, copies long, data binary")
    return linked_in_buckets(keyed, _close(dim, cosine))
