"""Centroid clustering in whole numbers, with distances pruned by a table of pivot distances.

The distances of every vector to a few fixed pivots are worked out once and stored with it.  In each round the same
distances of the centroids bound every distance between vector and centroid from below, by the triangle inequality;
only centroids whose bound does not exceed the best distance so far get an exact distance.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowgrain.session import checkpoint_folder

#: Components below this keep squared distances of 64 components, and sums of 2**36 rows, within 64 bits.
NARROW = 1 << 27
#: Digits in which sums of larger components travel.
LIMB = 24
_LONG = (1 << 63) - 1


@dataclass(frozen=True)
class Clustering:
    """``clusters`` start as the vectors with the smallest SHA-256 of ``seed:vec_id``.  ``pivots`` are chosen far apart
    among the ``sample`` vectors that follow from the same order; they decide the cost, never the result."""

    clusters: int = 8
    rounds: int = 10
    dim: int = 64
    scale: int = 1024
    seed: int = 3
    pivots: int = 12
    sample: int = 512


def exact(vector: list[float], scale: int) -> list[int]:
    """``floor(scale * x)`` in whole numbers, also where the product is beyond a double."""
    return [math.floor(x * scale) if abs(x) < 2.0**52 else int(x) * scale for x in vector]


def narrow_ints(x: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Components as 64-bit numbers, and which rows have small ones alone."""
    with np.errstate(over="ignore"):
        y = np.floor(x * float(scale))
    small = (np.abs(y) < NARROW).all(1)
    return np.where(small[:, None], y, 0).astype(np.int64), small


def choose_pivots(x: np.ndarray, n: int) -> np.ndarray:
    """Each further pivot is the vector with the greatest sum of distances to those before it."""
    picked, total = [0], np.zeros(len(x))
    for _ in range(min(n, len(x)) - 1):
        total += np.sqrt(((x - x[picked[-1]]) ** 2).sum(1))
        left = total.copy()
        left[picked] = -1
        picked.append(int(left.argmax()))
    return x[picked]


def nearest(x: np.ndarray, table: np.ndarray, centroids: np.ndarray, to_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Cluster and squared distance of each row, and how many exact distances that took.

    ``table``: distances of rows to pivots; ``to_pivots``: those of centroids.  Bounds are lowered by more than the
    rounding of a root, so no centroid is lost; ties go to the smaller number.
    """
    n, k = len(x), len(centroids)
    bound = np.zeros((n, k))
    for p in range(table.shape[1]):
        np.maximum(bound, np.abs(table[:, p, None] - to_pivots[:, p]) - 1e-9 * (table[:, p, None] + to_pivots[:, p]), out=bound)
    bound = bound**2 * (1 - 1e-9)
    first = bound.argmin(1)
    at = np.full(n, -1, dtype=np.int64)
    best = np.full(n, _LONG, dtype=np.int64)
    spent = 0
    for turn in range(k + 1):  # the centroid with the smallest bound, then the others in order
        for c in range(k) if turn == 0 else [turn - 1]:
            rows = np.flatnonzero(first == c) if turn == 0 else np.flatnonzero((first != c) & (bound[:, c] <= best))
            if not len(rows):
                continue
            spent += len(rows)
            d = x[rows] - centroids[c]
            d = np.einsum("ij,ij->i", d, d)
            better = (d < best[rows]) | ((d == best[rows]) & (c < at[rows]))
            at[rows[better]], best[rows[better]] = c, d[better]
    return at, best, spent


def nearest_plainly(v: list[int], centroids: list[list[int]]) -> tuple[int, int]:
    d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids]
    at = min(range(len(d)), key=d.__getitem__)
    return at, d[at]


def _roots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.stack([((x - p) ** 2).sum(1) for p in pivots], 1).astype(np.float64)) if len(pivots) else np.zeros((len(x), 0))


def _table(dim: int, scale: int, pivots: np.ndarray):
    """Components as small numbers (or the vector itself, where they are not small), and distances to pivots."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b["v"].flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, dim)
            y, small = narrow_ints(x, scale)
            far = _roots(y, pivots)
            yield pa.RecordBatch.from_arrays(
                [b["vec_id"], pa.array([r.tobytes() if s else None for r, s in zip(y.astype("<i4"), small)], pa.binary()),
                 pa.array([None if s else r.tobytes() for r, s in zip(x, small)], pa.binary()), pa.array([r.tobytes() for r in far], pa.binary())],
                names=["vec_id", "small", "large", "far"])

    return work


class _Round:
    """Nearest centroids of record batches of the table."""

    def __init__(self, how: Clustering, pivots: np.ndarray, centroids: list[list[int]]):
        self.how, self.centroids = how, centroids
        self.easy = all(abs(x) < NARROW for c in centroids for x in c)
        if self.easy:
            self.c = np.array(centroids, dtype=np.int64).reshape(-1, how.dim)
            self.far = _roots(self.c, pivots)

    def __call__(self, b: pa.RecordBatch) -> tuple[tuple[np.ndarray, ...], list[tuple[int, list[int], int, int]]]:
        """Rows of small components: places, components, clusters and squared distances; and one by one the others."""
        small = b["small"].is_valid().to_numpy(zero_copy_only=False)
        pick = np.flatnonzero(small)
        x = np.frombuffer(b"".join(b["small"].take(pa.array(pick)).to_pylist()), dtype="<i4").reshape(-1, self.how.dim).astype(np.int64)
        others = [(i, exact(np.frombuffer(b["large"][i].as_py(), dtype="<f8").tolist(), self.how.scale)) for i in np.flatnonzero(~small).tolist()]
        if self.easy:
            far = np.frombuffer(b"".join(b["far"].take(pa.array(pick)).to_pylist()), dtype="<f8").reshape(len(pick), -1)
            at, best, _ = nearest(x, far, self.c, self.far)
        else:
            others += zip(pick.tolist(), x.tolist())
            pick, x, at, best = pick[:0], x[:0], np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        return (pick, x, at, best), [(i, v, *nearest_plainly(v, self.centroids)) for i, v in others]


def limbs(value: int) -> list[int]:
    """Digits of a whole number, the last one signed."""
    out = []
    while not -NARROW < value < NARROW:
        out.append(value & ((1 << LIMB) - 1))
        value >>= LIMB
    return [*out, value]


def _sums(round_: _Round):
    """``cluster, component, limb, total`` of a task; component -1 counts rows, -2 adds up distances."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dim, k = round_.how.dim, len(round_.centroids)
        total = np.zeros((k, dim), dtype=np.int64)
        count = np.zeros(k, dtype=np.int64)
        spread = [0] * k
        extra: dict[tuple[int, int, int], int] = {}
        for b in batches:
            (_, x, at, best), others = round_(b)
            count += np.bincount(at, minlength=k)
            np.add.at(total, at, x)
            for shift, part in ((0, best & 0xFFFFFFFF), (32, best >> 32)):  # whole numbers beyond 64 bits
                each = np.zeros(k, dtype=np.int64)
                np.add.at(each, at, part)
                spread = [s + (e << shift) for s, e in zip(spread, each.tolist())]
            for _, v, c, d in others:
                count[c] += 1
                spread[c] += d
                for j, value in enumerate(v):
                    for level, digit in enumerate(limbs(value)):
                        extra[c, j, level] = extra.get((c, j, level), 0) + digit
        for (c, j), x in np.ndenumerate(total):
            extra[c, j, 0] = extra.get((c, j, 0), 0) + int(x)
        for c in range(k):
            extra[c, -1, 0] = int(count[c])
            for level, digit in enumerate(limbs(spread[c])):
                extra[c, -2, level] = digit
        keys = list(extra)
        yield pa.RecordBatch.from_arrays(
            [pa.array([key[i] for key in keys], pa.int32()) for i in range(3)] + [pa.array(list(extra.values()), pa.int64())],
            names=["cluster", "component", "limb", "total"])

    return work


def _totals(table: DataFrame, round_: _Round) -> dict[tuple[int, int], int]:
    """Sums of all rows: at most clusters x (components + 2) x digits rows come to the driver."""
    got = table.mapInArrow(_sums(round_), "cluster int, component int, limb int, total long")
    out: dict[tuple[int, int], int] = {}
    for r in got.groupBy("cluster", "component", "limb").agg(F.sum("total").alias("total")).collect():
        out[r.cluster, r.component] = out.get((r.cluster, r.component), 0) + (r.total << LIMB * r.limb)
    return out


def _assigned(round_: _Round, within: list[int], digest: list[str]):
    fits = lambda x: x if x <= _LONG else None

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (pick, _, near, d), others = round_(b)
            at, best = np.zeros(b.num_rows, dtype=np.int64), np.zeros(b.num_rows, dtype=object)
            at[pick], best[pick] = near, d
            for i, _, c, far in others:
                at[i], best[i] = c, far
            yield pa.RecordBatch.from_arrays(
                [b["vec_id"], pa.array(at.astype(np.int32)), pa.array([fits(x) for x in best.tolist()], pa.int64()), pa.array([fits(within[c]) for c in at.tolist()], pa.int64()),
                 pa.array([fits(sum(within))] * b.num_rows, pa.int64()), pa.array([digest[c] for c in at.tolist()], pa.string())],
                names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return work


def clusters(vectors: DataFrame, how: Clustering = Clustering()) -> DataFrame:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` for every usable row of ``vectors (vec_id, embedding)``.

    Vectors of another length than ``dim``, and those that are NULL or hold NULL or non-finite components, are left
    out.  Rows with a NULL ``vec_id`` are assigned but never start a cluster (without others there is none); repeated rows count as often as given, and
    of starts with one number the smaller vector comes first.  With fewer vectors than clusters each starts one; an
    empty table gives an empty result.  Components may have any size; a distance or sum beyond a long is NULL.  Other
    columns are ignored.
    """
    spark = vectors.sparkSession
    v = F.transform("embedding", lambda x: x.cast("double"))
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter((F.size("v") == how.dim) & finite)
    order = F.sha2(F.concat(F.lit(f"{how.seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.filter("vec_id is not null").orderBy(order, "vec_id", "v").limit(how.clusters + how.sample).collect()
    start = [exact(r.v, how.scale) for r in first]
    centroids = start[: how.clusters]
    kind = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not centroids:
        return spark.createDataFrame([], kind)
    easy = [x for x in start if all(abs(a) < NARROW for a in x)]
    pivots = choose_pivots(np.array(easy, dtype=np.int64), how.pivots) if easy else np.empty((0, how.dim), dtype=np.int64)

    path = f"{checkpoint_folder(spark)}/pivots-{uuid.uuid4().hex}"
    rows.mapInArrow(_table(how.dim, how.scale, pivots), "vec_id long, small binary, large binary, far binary").write.parquet(path)
    table = spark.read.parquet(path)
    for _ in range(how.rounds):
        total = _totals(table, _Round(how, pivots, centroids))
        centroids = [[total[c, j] // total[c, -1] for j in range(how.dim)] if total.get((c, -1)) else old for c, old in enumerate(centroids)]
    last = _Round(how, pivots, centroids)
    total = _totals(table, last)
    within = [total.get((c, -2), 0) for c in range(len(centroids))]
    digest = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return table.mapInArrow(_assigned(last, within, digest), kind)


def clusters_sql(how: Clustering = Clustering()) -> str:
    """The same as SQL over a table ``embeddings``, for components of ordinary size: plain distances in every round."""
    near = "list_sum(list_transform(list_zip(v.q, c.q), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"

    def assigned(n: int) -> str:
        return f"""a{n} AS MATERIALIZED (
  SELECT row, any_value(vec_id) AS vec_id, any_value(q) AS q, min(struct_pack(d := d, c := c)) AS best
  FROM (SELECT v.row, v.vec_id, v.q, c.c, CAST({near} AS BIGINT) AS d FROM v, c{n} c) GROUP BY row)"""

    def moved(n: int) -> str:
        return f"""c{n} AS MATERIALIZED (
  SELECT old.c, coalesce(new.q, old.q) AS q FROM c{n - 1} old LEFT JOIN (
    SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS q FROM (
      SELECT c, i, sum(x) AS s, count(*) AS n
      FROM (SELECT best.c AS c, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM a{n - 1}) GROUP BY c, i)
    GROUP BY c) new ON new.c = old.c)"""

    steps = []
    for n in range(how.rounds + 1):
        steps += ([moved(n)] if n else []) + [assigned(n)]
    joined = ",\n".join(steps)
    r = how.rounds
    return f"""WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor({how.scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE len(embedding) = {how.dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {how.dim}),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{how.seed}:' || vec_id), vec_id, q) - 1 AS c, q FROM v WHERE vec_id IS NOT NULL
  QUALIFY c < {how.clusters}),
{joined}
SELECT vec_id, CAST(best.c AS INTEGER) AS cluster, best.d AS distance,
  CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM a{r} JOIN c{r} c ON c.c = best.c"""
