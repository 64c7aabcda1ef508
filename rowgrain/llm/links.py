"""Links between rows that share a bucket, and the connected components of links.

Rows meet in buckets.  A bucket of any size is cut into blocks of at most
about ``BLOCK`` rows, and each pair of blocks is a unit of work of its own, so
that no task holds more than two blocks and a frequent bucket is spread over
the cluster.  A unit of work compares its rows in numpy and returns a forest
of links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowgrain.session import cut_lineage

#: Rows in a block of a large bucket; a task holds two blocks and a record batch.
BLOCK = 1024
#: Ways in which the rows of a frequent key are dealt out in joins.
SALTS = 16

#: Gets fixed-width rows as a byte matrix, two index arrays and the table of each pair; says which pairs are linked.
Compare = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row reachable from each of ``n`` rows over links ``a``-``b``."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if np.array_equal(before, root):
            return root


def runs_of(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole runs of equal keys from sorted record batches: tables with a run number per row."""
    rest: pa.Table | None = None

    def numbered(t: pa.Table) -> np.ndarray:
        change = np.zeros(t.num_rows, dtype=np.int64)
        for k in keys:
            v = t[k].to_numpy()
            change[1:] |= v[1:] != v[:-1]
        return np.cumsum(change)

    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if rest is None else pa.concat_tables([rest, t]).combine_chunks()
        if t.num_rows == 0:
            continue
        run = numbered(t)
        cut = int(np.searchsorted(run, run[-1]))
        rest = t.slice(cut)
        if cut:
            yield t.slice(0, cut), run[:cut]
    if rest is not None and rest.num_rows:
        yield rest, numbered(rest)


def _linked(compare: Compare):
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, run in runs_of(batches, ["table", "key", "p", "q"]):
            n = t.num_rows
            data = np.frombuffer(b"".join(t["data"].to_pylist()), dtype=np.uint8).reshape(n, -1)
            table, block, same = t["table"].to_numpy(), t["block"].to_numpy(), (t["p"].to_numpy() == t["q"].to_numpy())
            found = []
            i, d = np.arange(n), 1
            while True:
                i = i[: np.searchsorted(i, n - d)]
                i = i[run[i] == run[i + d]]
                if not i.size:
                    break
                at = i[same[i] | (block[i] != block[i + d])]
                at = at[compare(data, at, at + d, table[at])] if at.size else at
                if at.size:
                    found.append((at, at + d))
                d += 1
            if not found:
                continue
            a, b = (np.concatenate(x) for x in zip(*found))
            ids, copies = t["id"].to_numpy(), t["copies"].to_numpy()
            root = forest(n, a, b)
            links = np.bincount(a, copies[b], n) + np.bincount(b, copies[a], n)
            at = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[at]), pa.array(ids[root[at]]), pa.array(links[at].astype(np.int64))], names=["a", "b", "links"]
            )

    return work


def linked_in_buckets(rows: DataFrame, compare: Compare, block: int = BLOCK) -> DataFrame:
    """Compare all rows that share a bucket; ``(a, b, links)``: a row, the first row of its tree, linked copies.

    ``rows``: ``table int, key long`` (the bucket), ``id long, copies long, data binary`` (of one width).  The trees
    connect exactly the rows that the links connect.  A pair that meets in several tables is counted in each, unless
    ``compare`` accepts it in one of them only.
    """
    key = ["table", "key"]
    # The salt gives each side of the join a shuffle of its own, so that Spark can split a frequent bucket.
    sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    salted = rows.withColumn("salt", F.xxhash64(*key))
    sized = salted.join(sizes.withColumn("salt", F.xxhash64(*key)), [*key, "salt"]).drop("salt")
    blocks = F.ceil(F.col("n") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64("id", F.lit(block)), blocks).cast("int")
    other = F.explode(F.sequence(F.lit(0), blocks - 1))
    units = (
        sized.withColumn("block", own).withColumn("other", other)
        .select(*key, F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "id", "copies", "data")
    )
    order = [*key, "p", "q"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = units.repartition(parts, *order).sortWithinPartitions(*order, "block", "id")
    return dealt.mapInArrow(_linked(compare), "a long, b long, links long")


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges (a long, b long)``: the smallest node reachable.

    Large-star and small-star rounds: each node's neighbours are linked to the smallest of them until nothing moves.
    Every round ends in the shared checkpoint folder.  Minima are combined before the shuffle, and the rows of a hub
    are dealt out by salt.
    """
    salt = F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")
    salts = F.explode(F.array(*[F.lit(i) for i in range(SALTS)]))

    def starred(e: DataFrame, keep: str) -> DataFrame:
        """Link each neighbour ``v`` of ``u`` that ``keep`` accepts to the smallest of ``u`` and all of its neighbours."""
        low = e.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).withColumn("salt", salts)
        return (
            e.withColumn("salt", salt).join(low, ["u", "salt"]).filter(keep)
            .select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        )

    def both(e: DataFrame) -> DataFrame:
        return e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))

    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    e, state = cut_lineage(e), None
    while True:
        large = starred(both(e), "v > u").distinct()
        # Small star: larger end to smaller neighbours; the node itself is linked to the smallest one too.
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        own = down.groupBy("u").agg(F.min("v").alias("v"))
        e = cut_lineage(starred(down, "true").unionByName(own).distinct())
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == state:
            break
        state = now
    low = e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    roots = low.select(F.col("component").alias("node"), "component").distinct()
    return low.unionByName(roots)


def with_components(docs: DataFrame, by: str, found: DataFrame) -> DataFrame:
    """``docs`` with ``component`` of the value in column ``by``, NULL where it has no link.

    The rows of a frequent value are dealt out by salt.
    """
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
    spread = found.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    return docs.withColumn("_salt", salt).join(spread, [by, "_salt"], "left").drop("_salt")
