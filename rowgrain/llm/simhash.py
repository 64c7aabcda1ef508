"""Near-duplicate documents by SimHash, with a pigeonring filter before the full distance.

A fingerprint has ``64 * words64`` bits; a bit is set where over half of the
document's shingle hashes have it.  Two ways lead to candidates.

``complete``: for a distance of at most ``n`` in ``m`` segments laid in a
ring, some start has every chain of ``l`` segments within ``l * n / m``
differences.  With ``m = n + 1`` that start segment is equal, the next has at
most one difference, so one of its halves is equal, and the two after the
start have at most two, so one third of the third segment is equal.  Start,
half and third make the bucket keys: no pair within the distance is lost.

``sampled``: for distances that are large against the bits no such key is
selective.  Keys are then random bits of the fingerprint, in as many tables as
a pair at the similarity asked for needs to meet with probability ``recall``.

Either way the chains are checked first on candidates, then the full distance.

With a ``similarity`` the distance only proposes: documents it connects are compared by their sets of shingles, and
linked where the exact similarity (Jaccard) is reached.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowgrain.functions.columns import fresh
from rowgrain.llm.links import SALTS, components, forest, linked_in_buckets, runs_of, with_components
from rowgrain.session import cut_lineage

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_BITS = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)
#: Shingles whose bits are unpacked at once.
_AT_ONCE = 1 << 16
#: Nodes without a document number are numbered from here.
NAMELESS = 1 << 62
#: Shingle sets in a block of a large group, and shared shingles that are compared at once.
SETS, TERMS = 128, 8192


@dataclass(frozen=True)
class SimHash:
    """``words`` per shingle, ``words64`` 64-bit words per fingerprint, links at ``distance`` or fewer bits.

    ``segments`` on the ring (default: one more than the distance).  ``tables`` and ``key_bits`` choose sampled keys;
    without them keys are complete.  With a ``similarity`` the fingerprint is that of the distinct shingles, and only
    sets at least so similar are linked.
    """

    words: int = 5
    words64: int = 1
    distance: int = 4
    segments: int = 0
    tables: int = 0
    key_bits: int = 16
    seed: int = 42
    similarity: float = 0.0

    @classmethod
    def for_similarity(cls, rows: int, similarity: float = 0.8, words: int = 5, words64: int = 4, recall: float = 0.999) -> SimHash:
        """Find pairs of shingle-set similarity (Jaccard) ``similarity`` among ``rows`` documents.

        Keys have so many bits that about four unrelated documents share one.  The similarity's cosine gives the share
        of differing bits; the distance adds three standard deviations of the estimate, so that 998 in 1,000 pairs just
        at the similarity become candidates, and nearly all above it.  The sets of shingles decide.
        """
        share = math.acos(2 * similarity / (1 + similarity)) / math.pi
        bits, key_bits = 64 * words64, max(8, math.ceil(math.log2(max(rows, 4) / 4)))
        distance = round(bits * share + 3 * math.sqrt(bits * share * (1 - share)))
        tables = math.ceil(math.log(1 - recall) / math.log(1 - (1 - share) ** key_bits))
        return cls(words, words64, distance, 32, tables, key_bits, similarity=similarity)

    @property
    def ring(self) -> list[tuple[int, int]]:
        m = self.segments or self.distance + 1
        edges = [round(i * 64 * self.words64 / m) for i in range(m + 1)]
        return list(zip(edges, edges[1:]))


def shingle_hashes(text: str, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every shingle, repeats included; the whole sequence where there are fewer words; none without words."""
    found = WORD.findall(text.translate(LOWER))
    if not found:
        return np.empty(0, dtype=np.uint64)
    raw = " ".join(found).encode("utf-8", "surrogatepass")
    ends = np.append(np.flatnonzero(np.frombuffer(raw, dtype=np.uint8) == 32), len(raw))
    k = min(words, len(found))
    starts = np.append(0, ends[: len(found) - k] + 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(raw[s:e], seed) for s, e in zip(starts, ends[k - 1:].tolist())], dtype=np.uint64)


def fingerprint(hashes: np.ndarray, words64: int = 1) -> np.ndarray:
    """Bytes of the fingerprint, most significant bit first; further words come from mixing the hashes again."""
    out = []
    for w in range(words64):
        h = hashes
        if w:
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15 + 2 * w)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            h = h ^ (h >> np.uint64(32))
        raw = h.astype(">u8").view(np.uint8).reshape(-1, 8)
        set_ = sum(
            (np.unpackbits(raw[i:i + _AT_ONCE], axis=1).sum(0, dtype=np.int64) for i in range(0, len(raw), _AT_ONCE)),
            np.zeros(64, dtype=np.int64),
        )
        out.append(np.packbits(2 * set_ > len(h)))
    return np.concatenate(out)


def fingerprints(docs: DataFrame, how: SimHash) -> DataFrame:
    """``(doc_id, text_hash, fp binary)`` for every document; no words: zero."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [fingerprint(shingle_hashes(t or "", how.words, how.seed), how.words64).tobytes() for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["text_hash"], pa.array(fp, pa.binary())], names=["doc_id", "text_hash", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(work, f"doc_id {kind}, text_hash long, fp binary")


def shingle_set(text: str | None, how: SimHash) -> np.ndarray:
    return np.unique(shingle_hashes(text or "", how.words, how.seed))


def set_fingerprints(docs: DataFrame, how: SimHash) -> DataFrame:
    """``(doc_id, text_hash, fp, node)``: fingerprint and digest of each document's set of shingles."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t, how) for t in b["text"].to_pylist()]
            fp, node = [fingerprint(x, how.words64).tobytes() for x in sets], [xxhash.xxh128_digest(x.tobytes()) for x in sets]
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], b["text_hash"], pa.array(fp, pa.binary()), pa.array(node, pa.binary())], names=["doc_id", "text_hash", "fp", "node"]
            )

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(work, "doc_id long, text_hash long, fp binary, node binary")


def _alike(similarity: float):
    """Links between the sets of each unit, as a forest."""

    def shared(sets: list[np.ndarray]) -> np.ndarray:
        """Size of the intersection of any two sets."""
        out = np.zeros((len(sets), len(sets)), dtype=np.float32)
        _, term, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        kept = n[term] > 1
        term, row = (np.cumsum(n > 1) - 1)[term[kept]], row[kept]
        order = np.argsort(term, kind="stable")
        term, row = term[order], row[order]
        for lo in range(0, int(term[-1]) + 1 if len(term) else 0, TERMS):
            a, b = np.searchsorted(term, [lo, lo + TERMS])
            has = np.zeros((len(sets), TERMS), dtype=np.float32)
            has[row[a:b], term[a:b] - lo] = 1
            out += has @ has.T
        return out

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = (b.slice(lo, SETS) for b in batches for lo in range(0, b.num_rows, SETS))
        for t, run in runs_of(small, ["component", "p", "q"]):
            ids, lists = t["id"].to_numpy(), t["shingles"].combine_chunks()
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.diff(run, prepend=-1, append=-1))
            for lo, hi in zip(edges.tolist(), edges[1:].tolist()):
                sets = [flat[ends[k]:ends[k + 1]] for k in range(lo, hi)]
                size = np.array([len(x) for x in sets])
                both = shared(sets).astype(np.float64)
                union = size[:, None] + size[None, :] - both
                a, b = np.nonzero(np.triu(both / np.maximum(union, 1) >= similarity, 1))
                root, own = forest(hi - lo, a, b), ids[lo:hi]
                at = np.flatnonzero(root != np.arange(hi - lo))
                yield pa.RecordBatch.from_arrays([pa.array(own[at]), pa.array(own[root[at]])], names=["a", "b"])

    return work


def exact_links(docs: DataFrame, nodes: DataFrame, how: SimHash) -> DataFrame:
    """``(a, b)`` between ``nodes (component, id, k, text_hash)`` of one component: trees of the pairs at ``similarity``.

    ``k, text_hash`` name a document of the node.  First all meet the node that the component is named by; that is
    enough for groups of near copies.  Nodes that are not linked to it then meet all others, block by block.
    """

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(lo, 1024) for b in batches for lo in range(0, b.num_rows, 1024)):
            sets = [shingle_set(t, how).view(np.int64) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["component"], b["id"], pa.array(sets, pa.list_(pa.int64()))], names=["component", "id", "shingles"])

    keyed = docs.select(F.coalesce("doc_id", F.lit(NAMELESS)).alias("k"), F.xxhash64("text").alias("text_hash"), "text")
    sets = cut_lineage(keyed.join(nodes, ["k", "text_hash"]).select("component", "id", "text").mapInArrow(work, "component long, id long, shingles array<long>"))
    salt, salts = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"), F.explode(F.array(*[F.lit(i) for i in range(SALTS)]))
    first = sets.filter("id = component").dropDuplicates(["id"]).select("component", F.col("shingles").alias("of"), salts.alias("salt"))
    both = F.size(F.array_intersect("shingles", "of"))
    near = both / F.greatest(F.size("shingles") + F.size("of") - both, F.lit(1)) >= how.similarity
    star = cut_lineage(
        sets.withColumn("salt", salt).join(first, ["component", "salt"])
        .select("component", "id", ((F.col("id") == F.col("component")) | near).alias("near"))
    )
    counts = star.groupBy("component").agg(
        F.ceil(F.count_if("near") / SETS).cast("int").alias("n_near"), F.ceil(F.count_if(~F.col("near")) / SETS).cast("int").alias("n_far")
    ).filter("n_far > 0")
    # Units of work: two blocks of far nodes, or one of them and one of near nodes, which has a number below zero.
    left = (
        sets.join(star.dropDuplicates(["id"]), ["component", "id"]).withColumn("salt", salt)
        .join(counts.withColumn("salt", salts), ["component", "salt"])
        .withColumn("own", F.pmod(F.xxhash64("id", F.lit(SETS)), F.when(F.col("near"), F.col("n_near")).otherwise(F.col("n_far"))).cast("int"))
    )
    units = F.expr(
        "if(near, transform(sequence(0, n_far - 1), o -> named_struct('p', o, 'q', -1 - own)), concat("
        "transform(sequence(0, n_far - 1), o -> named_struct('p', least(own, o), 'q', greatest(own, o))),"
        "transform(sequence(0, n_near - 1), o -> named_struct('p', own, 'q', -1 - o))))"
    )
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["component", "p", "q"]
    dealt = left.select("component", "id", "shingles", F.explode(units).alias("u")).select("component", "u.p", "u.q", "id", "shingles")
    found = dealt.repartition(parts, *order).sortWithinPartitions(*order).mapInArrow(_alike(how.similarity), "a long, b long")
    return star.filter("near and id <> component").select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(found)


def within(how: SimHash):
    """Compare for buckets: the chains of some start within their budgets, then the full distance."""
    ring, n = how.ring, how.distance
    m, parts = len(ring), []
    for lo, hi in ring:
        mask = np.zeros(64 * how.words64, dtype=np.uint8)
        mask[lo:hi] = 1
        first, last = lo // 8, (hi + 7) // 8
        parts.append((first, last, np.packbits(mask)[first:last]))

    def compare(data: np.ndarray, i: np.ndarray, j: np.ndarray, table: np.ndarray) -> np.ndarray:
        x = data[i] ^ data[j]
        diff = np.stack([_BITS[x[:, a:b] & mask].sum(1, dtype=np.int32) for a, b, mask in parts])
        alive = np.ones((m, len(i)), dtype=bool)  # by start
        chain = np.zeros((m, len(i)), dtype=np.int32)
        for length in range(1, m + 1):
            chain += np.roll(diff, 1 - length, axis=0)
            alive &= chain * m <= length * n
        kept = np.flatnonzero(alive.any(0))
        out = np.zeros(len(i), dtype=bool)
        out[kept] = diff[:, kept].sum(0) <= n
        return out

    return compare


def keys(how: SimHash) -> list[list[int]]:
    """Bit positions of each bucket key."""
    if how.tables:
        draw = random.Random(how.seed)
        return [sorted(draw.sample(range(64 * how.words64), how.key_bits)) for _ in range(how.tables)]
    ring = [list(range(a, b)) for a, b in how.ring]
    if len(ring) != how.distance + 1:
        raise ValueError("complete keys need one segment more than the distance")

    def cut(x: list[int], n: int) -> list[list[int]]:
        return [x[round(k * len(x) / n):round((k + 1) * len(x) / n)] for k in range(n)]

    m = len(ring)
    halves = [(ring[s], h, s) for s in range(m) for h in (cut(ring[(s + 1) % m], 2) if m > 1 else [[]])]
    return [a + h + third for a, h, s in halves for third in (cut(ring[(s + 2) % m], 3) if m > 2 else [[]])]


def bucketed(reps: DataFrame, how: SimHash) -> DataFrame:
    """One row per fingerprint and key, for :func:`links.linked_in_buckets`."""
    at = np.array([p + [-1] * (max(map(len, keys(how))) - len(p)) for p in keys(how)])
    weight = np.where(at >= 0, 1 << np.arange(at.shape[1], dtype=np.int64)[None, :], 0)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                n = part.num_rows
                fp = np.frombuffer(b"".join(part["fp"].to_pylist()), dtype=np.uint8).reshape(n, -1)
                bits = np.unpackbits(fp, axis=1).astype(np.int64)
                key = np.stack([bits[:, p] @ w for p, w in zip(at, weight)], axis=1)
                row = np.repeat(np.arange(n), len(at))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.tile(np.arange(len(at), dtype=np.int32), n)), pa.array(key.ravel()),
                     part["id"].take(pa.array(row)), pa.array(np.ones(n * len(at), dtype=np.int64)), part["fp"].take(pa.array(row))],
                    names=["table", "key", "id", "copies", "data"],
                )

    return reps.select("id", "fp").mapInArrow(work, "table int, key long, id long, copies long, data binary")


def near_duplicates(docs: DataFrame, how: SimHash = SimHash(), names: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs (doc_id, text)``.

    Documents with one fingerprint (with a similarity: one set of shingles) are one node, so copies cost nothing.  ``component_id`` is the smallest ``doc_id``
    reachable over links.  A NULL text counts as empty; an empty one has the fingerprint zero and is linked like any
    other.  Rows with a NULL ``doc_id`` take part, but a component is only named by one of them if it
    has no other, and then its name is NULL.  Repeated rows come back repeated; other columns are ignored; an empty table gives an empty result.
    ``names``: the columns that name a row, of ``doc_id`` and ``text_hash``.
    """
    docs, exact = docs.withColumn("doc_id", F.col("doc_id").cast("long")), how.similarity > 0
    fps = cut_lineage(set_fingerprints(docs, how) if exact else fingerprints(docs, how))
    by = ["node", "fp"] if exact else ["fp"]  # the fingerprint follows from the set
    # A node is numbered by its smallest document; one without any, above all of them.
    nameless = F.shiftrightunsigned(F.xxhash64(by[0]), 2).bitwiseOR(F.lit(NAMELESS))
    kept = [F.coalesce(F.min("doc_id"), nameless).alias("id"), F.count(F.lit(1)).alias("n")]
    if exact:
        k = F.coalesce("doc_id", F.lit(NAMELESS))
        kept += [F.min(k).alias("k"), F.min_by("text_hash", k).alias("text_hash")]
    reps = cut_lineage(fps.groupBy(*by).agg(*kept))
    edges = linked_in_buckets(bucketed(reps, how), within(how)).filter("a <> b").select("a", "b")
    if exact:
        nodes = reps.join(components(edges).withColumnRenamed("node", "id"), "id").select("component", "id", "k", "text_hash")
        edges = exact_links(docs.select("doc_id", "text"), nodes, how)
    found = reps.join(components(edges).withColumnRenamed("node", "id"), "id", "left")
    # Alone, a document is its own component and needs no lookup.
    shared = found.filter("n > 1 or component is not null").select(by[0], F.coalesce("component", "id").alias("component"))
    named = F.coalesce("component", "doc_id")
    return with_components(fps, by[0], shared).select(
        *names, F.lower(F.hex("fp")).alias("fingerprint"), F.when(named < NAMELESS, named).alias("component_id")
    )


def keep_first(docs: DataFrame, how: SimHash) -> DataFrame:
    """``docs`` with one document of each group of near duplicates, the one with the smallest ``doc_id``.

    Columns as given.  Rows with a NULL ``doc_id`` stay; rows that share ``doc_id`` and text stay or go together, and
    those that share the ``doc_id`` alone are judged each by its own text.
    """
    k, text = fresh(docs.columns, "_doc", "_text")
    gone = near_duplicates(docs, how, ("doc_id", "text_hash")).filter("doc_id <> component_id").select(
        F.col("doc_id").alias(k), F.col("text_hash").alias(text)).distinct()
    named = docs.withColumns({k: F.col("doc_id").cast("long"), text: F.xxhash64("text")})
    return named.join(gone, [k, text], "left_anti").select(*docs.columns)
