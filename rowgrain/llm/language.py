"""Language of a text: TF-IDF vectors of letter n-grams against several clustered centroids per language.

Texts are lower-cased, everything but letters becomes one space, and n-grams of one to three characters are hashed into
a fixed number of buckets.  A bounded sample of labelled texts per language is clustered by cosine; a text gets the
language of the nearest centroid.  It is rejected where it lies farther from it than texts of its length that the
language was learnt from.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowgrain.session import cut_lineage

UNKNOWN = "und"
#: Characters turned into n-grams at once.
SLICE = 1 << 20
#: Classes of length: powers of two of the number of n-grams.
CLASSES = 32


@dataclass(frozen=True)
class Centroids:
    """``per_language``: texts of a language that are learnt from at most, so the fit holds ``languages`` times as many
    and the model ``languages * clusters * buckets`` numbers at most; more languages are an error.  ``tail``: share of
    a language's own texts that may lie beyond its limit, which ``slack`` widens; ``least``: texts of one length class
    that a limit of its own takes; ``share``: of a language's texts, that a cluster holds at least (0.25 at most, so
    that one of four always stays)."""

    buckets: int = 1 << 13
    per_language: int = 1000
    languages: int = 256
    clusters: int = 4
    share: float = 0.05
    rounds: int = 8
    tail: float = 0.01
    slack: float = 1.1
    least: int = 30
    sharpness: float = 20.0
    seed: int = 5


class Grams:
    """Hashed n-grams of texts."""

    def __init__(self, buckets: int):
        self.shift = np.uint32(32 - buckets.bit_length() + 1)
        self.buckets = buckets
        self.letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)

    def counts(self, text: str | None) -> np.ndarray | None:
        """Occurrences per bucket; None for a text without letters."""
        total = np.zeros(self.buckets, dtype=np.int64)
        before, in_word, some = np.array([32], dtype=np.uint32), False, False
        text = f"{text or ''} "  # the last word ends too
        for lo in range(0, len(text), SLICE):
            c = np.frombuffer(text[lo:lo + SLICE].lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
            letter = self.letter[c]
            # Letters, and one space after each word.
            keep = letter | np.append(in_word, letter[:-1])
            new = np.where(letter, c, 32).astype(np.uint32)[keep]
            in_word, some = bool(letter[-1]), some or bool(letter.any())
            s = np.concatenate([before, new])
            for n, mix in ((1, 0x9E3779B1), (2, 0x85EBCA77), (3, 0xC2B2AE3D)):
                first = len(before) - n + 1  # n-grams that end in this slice
                at = np.arange(max(first, 0), len(s) - n + 1)
                h = np.full(len(at), n, dtype=np.uint32)
                for k in range(n):
                    h = (h ^ s[at + k]) * np.uint32(mix)
                    h ^= h >> np.uint32(15)
                total += np.bincount((h * np.uint32(0x27D4EB2F)) >> self.shift, minlength=self.buckets)
            before = s[-2:]
        return total if some else None


def unit(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF rows of length one."""
    x = np.log1p(counts) * idf
    return (x / np.maximum(np.sqrt((x * x).sum(-1, keepdims=True)), 1e-12)).astype(np.float32)


def length_class(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(counts.sum(-1), 1)).astype(int), CLASSES - 1)


def clustered(x: np.ndarray, how: Centroids) -> np.ndarray:
    """Centroids of unit rows by cosine; each further start is the row farthest from those before it.  Clusters of a
    few outliers go: a text in two languages would pull others to the wrong one."""
    starts = [int((x @ x.mean(0)).argmax())]
    near = x @ x[starts[0]]
    for _ in range(min(how.clusters, len(x)) - 1):
        starts.append(int(near.argmin()))
        near = np.maximum(near, x @ x[starts[-1]])
    c = x[starts].copy()
    for _ in range(how.rounds):
        at = (x @ c.T).argmax(1)
        for k in range(len(c)):
            own = x[at == k]
            if len(own):
                mean = own.mean(0)
                c[k] = mean / max(float(np.sqrt((mean * mean).sum())), 1e-12)
    return c[np.bincount((x @ c.T).argmax(1), minlength=len(c)) >= how.share * len(x)]


def limits(distance: np.ndarray, length: np.ndarray, how: Centroids) -> np.ndarray:
    """Greatest distance by class of length.  Classes with few texts take the limit of the next shorter one that has
    enough; texts shorter than any learnt from are not rejected."""
    out = np.ones(CLASSES)
    for k in range(CLASSES):
        own = distance[length == k]
        out[k] = min(1.0, float(np.quantile(own, 1 - how.tail)) * how.slack) if len(own) >= how.least else out[k - 1] if k else 1.0
    return out


@dataclass
class Model:
    idf: np.ndarray
    languages: list[str]
    owner: np.ndarray
    centroids: np.ndarray
    limits: np.ndarray

    def judge(self, counts: np.ndarray, how: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Language number, score, distance, and whether the row is rejected."""
        near = unit(counts, self.idf) @ self.centroids.T
        best = np.full((len(counts), len(self.languages)), -1.0)
        for k, lang in enumerate(self.owner.tolist()):
            np.maximum(best[:, lang], near[:, k], out=best[:, lang])
        at = best.argmax(1)
        rows = np.arange(len(at))
        distance = np.clip(1 - best[rows, at], 0, 1)
        share = 1 / np.exp(how.sharpness * (best - best[rows, at, None])).sum(1)
        return at, share, distance, distance > self.limits[at, length_class(counts)]


def held_out(doc_id: Column) -> Column:
    """Rows that are never learnt from; NULL numbers among them."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


def fit(docs: DataFrame, how: Centroids = Centroids()) -> Model | None:
    """Learn from at most ``how.per_language`` texts of each language outside the held-out fifth, chosen by a hash of
    their number.  None where no text has a language and letters."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    draw = F.xxhash64("doc_id", F.lit(how.seed))
    first = lambda rows, order: rows.withColumn("_rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("_rank") <= how.per_language).drop("_rank")
    numbers = known.select("doc_id", "lang").distinct()
    sizes = cut_lineage(numbers.groupBy("lang").agg(F.count(F.lit(1)).alias("_size")))
    if sizes.limit(how.languages + 1).count() > how.languages:
        raise ValueError(f"more than {how.languages} languages")
    # About twice as many as are wanted go on of a frequent language, so that none fills the task that ranks them.
    low = F.pmod(draw, F.lit(1 << 40)).cast("double") * F.col("_size") < F.lit(2.0 * how.per_language * (1 << 40))
    drawn = numbers.join(F.broadcast(sizes), "lang").filter(low).drop("_size")
    picked = cut_lineage(first(drawn, [draw, "doc_id"]))
    texts = known.select("doc_id", "lang", "text").join(F.broadcast(picked), ["doc_id", "lang"])  # languages * per_language rows at most

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(how.buckets)
        for b in batches:
            rows = [(d, lang, c) for d, lang, t in zip(b["doc_id"].to_pylist(), b["lang"].to_pylist(), b["text"].to_pylist()) if (c := grams.counts(t)) is not None]
            at = [np.flatnonzero(c).astype(np.int32) for *_, c in rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], b["doc_id"].type), pa.array([r[1] for r in rows], pa.string()), pa.array(at, pa.list_(pa.int32())),
                 pa.array([r[2][a] for r, a in zip(rows, at)], pa.list_(pa.int64()))], names=["doc_id", "lang", "at", "n"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    # One number may stand for many rows, so the bound is applied once more.
    found = texts.mapInArrow(work, f"doc_id {kind}, lang string, at array<int>, n array<long>")
    sample = cut_lineage(first(found, [draw, "doc_id", F.xxhash64("at", "n")]))
    total = sample.count()
    if not total:
        return None
    df = np.zeros(how.buckets)
    for r in sample.select(F.explode("at").alias("at")).groupBy("at").count().collect():  # a row per bucket
        df[r["at"]] = r["count"]
    idf = np.log((1 + total) / (1 + df)) + 1

    def learnt(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("doc_id", kind="stable")
        counts = np.zeros((len(part), how.buckets), dtype=np.int32)
        for k, (at, n) in enumerate(zip(part["at"], part["n"])):
            counts[k, at] = n
        x = unit(counts, idf)
        c = clustered(x, how)
        limit = limits(1 - (x @ c.T).max(1), length_class(counts), how)
        return pd.DataFrame({"lang": part["lang"].iloc[0], "cluster": range(len(c)), "centroid": [r.tobytes() for r in c], "limits": [limit.tobytes()] * len(c)})

    got = sample.groupBy("lang").applyInPandas(learnt, "lang string, cluster int, centroid binary, limits binary").collect()
    got.sort(key=lambda r: (r.lang, r.cluster))
    languages = sorted({r.lang for r in got})
    limit = {r.lang: np.frombuffer(r["limits"]) for r in got}
    return Model(idf, languages, np.array([languages.index(r.lang) for r in got]), np.stack([np.frombuffer(r.centroid, dtype=np.float32) for r in got]),
                 np.stack([limit[x] for x in languages]))


def identify(docs: DataFrame, model: Model | None, how: Centroids = Centroids(), name_rejected: bool = True) -> DataFrame:
    """All columns of ``docs`` with ``lang_pred, score, distance, rejected``, which replace columns of those names.

    ``rejected``: no letters, or farther from the nearest centroid than the language's own texts of that length.  A
    text without letters is ``und``; with ``name_rejected`` off so is every rejected one.  ``score`` is the share of the
    language among all, by closeness; 0 for ``und``.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = ["lang_pred", "score", "distance", "rejected"]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, m = Grams(how.buckets), sent.value
        for b in batches:
            n = b.num_rows
            lang, score, distance, rejected = [UNKNOWN] * n, np.zeros(n), np.ones(n), np.ones(n, dtype=bool)
            texts = b.column(text_at).to_pylist()
            for lo in range(0, n, 64):
                rows = [(i, c) for i, t in enumerate(texts[lo:lo + 64], lo) if m is not None and (c := grams.counts(t)) is not None]
                if not rows:
                    continue
                at, s, d, far = m.judge(np.stack([c for _, c in rows]), how)
                for k, (i, _) in enumerate(rows):
                    distance[i], rejected[i] = d[k], far[k]
                    if name_rejected or not far[k]:
                        lang[i], score[i] = m.languages[at[k]], s[k]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score), pa.array(distance), pa.array(rejected)], names=[*b.schema.names, *names])

    given = docs.drop(*names)
    text_at = given.columns.index("text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema)
    return given.mapInArrow(work, f"{fields}, lang_pred string, score double, distance double, rejected boolean")


def predicted(docs: DataFrame, how: Centroids = Centroids()) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, distance, rejected)`` for every row of ``docs (doc_id, text, lang)``.

    A NULL text, and one without a letter, is ``und`` with score 0, and so is every text where none could be learnt
    from.  Rows with a NULL ``doc_id`` or ``lang`` are not learnt from.  Repeated rows come back as often as given;
    other columns are ignored; an empty table gives an empty result.
    """
    judged = identify(docs.select("doc_id", "text"), fit(docs, how), how)
    return judged.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "distance", "rejected")
