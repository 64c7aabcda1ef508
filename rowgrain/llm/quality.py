"""Quality classifier: a factorisation machine over hashed words, structure statistics and size.

The score is a logistic function of a bias, one weight per feature, and all pairwise interactions of features through
vectors of low rank.  Interactions are summed in linear time: half of (sum of vectors) squared minus the sum of squared
vectors.  It is fitted on a bounded sample of labelled rows and sent to every task.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


@dataclass(frozen=True)
class FM:
    """``buckets`` for words, ``rank`` of the interactions, and at most ``sample`` labelled rows to fit on."""

    buckets: int = 1 << 14
    rank: int = 8
    sample: int = 16_000
    epochs: int = 8
    batch: int = 128
    rate: float = 0.05
    decay: float = 1e-4
    seed: int = 3


_BINS = 16
#: Upper limits of each statistic; a statistic is cut into equal bins up to its limit.
_LIMITS = {
    "upper": 1.0, "punctuation": 0.3, "symbols": 0.3, "digits": 0.2, "high_bytes": 0.5, "distinct": 1.0, "top": 0.5, "repeats": 0.5,
    "word_length": 16.0, "capitals": 1.0, "ended": 1.0, "line_length": 400.0, "distinct_lines": 1.0, "log_words": 12.0, "log_bytes": 16.0,
    "symbol_words": 1.0, "shouted": 1.0, "separators": 0.6,
}


def _classes() -> np.ndarray:
    kind = np.zeros(256, dtype=np.intp)
    for c in range(256):
        s = chr(c)
        kind[c] = 5 if c >= 128 else 1 if s.isupper() else 2 if s.islower() else 3 if s.isdigit() else 4 if s in ".,;:'\"?-()" else 0 if c <= 32 else 6
    return kind


_CLASS = _classes()


def statistics(text: str) -> list[float]:
    """Structure and size of a text, each between 0 and 1 of its limit."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    n = len(raw)
    count = np.bincount(_CLASS[raw], minlength=7) / max(n, 1)
    words = text.split()
    w = max(len(words), 1)
    seen = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    value = {
        "upper": count[1], "digits": count[3], "punctuation": count[4], "high_bytes": count[5], "symbols": count[6],
        "distinct": len(seen) / w, "top": max(seen.values(), default=0) / w, "repeats": sum(map(eq, words, words[1:])) / w,
        "word_length": len(text) / w, "capitals": sum(map(str.istitle, words)) / w, "ended": sum(x.endswith((".", ",")) for x in words) / w,
        "line_length": n / max(len(lines), 1), "distinct_lines": len(set(lines)) / max(len(lines), 1),
        "log_words": np.log2(w), "log_bytes": np.log2(n + 1),
        "symbol_words": sum(not (x[-1].isalnum() or x[-1] in ".,") for x in words) / w,
        "shouted": sum(map(str.isupper, words)) / w, "separators": sum(len(x) == 1 and not x.isalnum() for x in words) / w,
    }
    return [min(float(value[k]) / limit, 1.0) for k, limit in _LIMITS.items()]


def features(text: str | None, how: FM) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values: bins of the statistics, the statistics themselves, and words of unit length."""
    text = text or ""
    stats = statistics(text)
    n = len(stats)
    at = [how.buckets + k * _BINS + min(int(s * _BINS), _BINS - 1) for k, s in enumerate(stats)]
    at += range(how.buckets + n * _BINS, how.buckets + n * _BINS + n)
    value = [0.5] * n + stats
    words = Counter(text.lower().split())
    if words:
        at += [zlib.crc32(w.encode("utf-8", "surrogatepass")) % how.buckets for w in words]
        tf = np.log1p(np.fromiter(words.values(), dtype=np.float64, count=len(words)))
        value += (tf / np.sqrt((tf * tf).sum())).tolist()
    return np.array(at, dtype=np.int64), np.array(value, dtype=np.float64)


@dataclass
class Model:
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def margins(self, at: np.ndarray, value: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Margins of rows that begin at ``first``, and each row's sum of vectors."""
        v = self.factor[at] * value[:, None]
        total = np.add.reduceat(v, first)
        pairs = 0.5 * (total**2 - np.add.reduceat(v * v, first)).sum(1)
        return self.bias + np.add.reduceat(self.weight[at] * value, first) + pairs, total

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not rows:
            return np.empty(0)
        at, value, first = _flat(rows)
        return 1 / (1 + np.exp(-np.clip(self.margins(at, value, first)[0], -30, 30)))


def _flat(rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(a) for a, _ in rows])
    return np.concatenate([a for a, _ in rows]), np.concatenate([v for _, v in rows]), np.cumsum(sizes) - sizes


def train(rows: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, how: FM) -> Model:
    """Adaptive gradient descent on the logistic loss.  Without rows every score is one half."""
    size = how.buckets + len(_LIMITS) * (_BINS + 1)
    draw = np.random.Generator(np.random.PCG64(how.seed))
    m = Model(0.0, np.zeros(size), draw.normal(0, 0.02, (size, how.rank)))
    if not rows:
        m.factor[:] = 0
        return m
    m.bias = float(np.log((label.sum() + 1) / (len(label) - label.sum() + 1)))
    gw, gv, gb = np.full(size, 1e-3), np.full((size, how.rank), 1e-3), 1e-3
    for _ in range(how.epochs):
        order = draw.permutation(len(rows))
        for lo in range(0, len(order), how.batch):
            pick = order[lo:lo + how.batch]
            at, value, first = _flat([rows[i] for i in pick])
            margin, total = m.margins(at, value, first)
            error = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - label[pick]
            row = np.repeat(np.arange(len(pick)), np.diff(np.append(first, len(at))))
            e = error[row] * value
            used, place = np.unique(at, return_inverse=True)
            dw = np.bincount(place, e, len(used)) / len(pick) + how.decay * m.weight[used]
            each = e[:, None] * (total[row] - m.factor[at] * value[:, None])
            dv = np.stack([np.bincount(place, each[:, f], len(used)) for f in range(how.rank)], 1) / len(pick) + how.decay * m.factor[used]
            gw[used] += dw**2
            gv[used] += dv**2
            m.weight[used] -= how.rate * dw / np.sqrt(gw[used])
            m.factor[used] -= how.rate * dv / np.sqrt(gv[used])
            db = error.mean()
            gb += db**2
            m.bias -= how.rate * db / np.sqrt(gb)
    return m


def held_out(doc_id: Column) -> Column:
    """Rows that are never learnt from; NULL numbers among them."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, how: FM = FM()) -> Model:
    """Learn from at most ``how.sample`` labelled rows outside the held-out third, chosen by a hash of their number.

    Rows with a NULL label are not used; of several labels of one number the smallest counts, and of several texts all.
    """
    known = labels.filter(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("label"))
    sample = known.orderBy(F.xxhash64("doc_id", F.lit(how.seed)), "doc_id").limit(how.sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # how.sample rows at most

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [features(t, how) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], b["label"].cast(pa.int32()), pa.array([a.astype("<i4").tobytes() for a, _ in got], pa.binary()),
                 pa.array([v.astype("<f4").tobytes() for _, v in got], pa.binary())], names=["doc_id", "label", "at", "value"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = texts.select("doc_id", "text", "label").mapInArrow(work, f"doc_id {kind}, label int, at binary, value binary")
    # One number may stand for many rows, so the bound is applied once more; the fit itself is the work of one task.
    bounded = got.orderBy(F.xxhash64("doc_id", F.lit(how.seed)), "doc_id", "at", "value").limit(how.sample).coalesce(1)

    def learnt(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [r for b in batches for r in zip(*(b[c].to_pylist() for c in ("doc_id", "at", "value", "label")))]
        held.sort(key=lambda r: r[:3])
        rows = [(np.frombuffer(at, "<i4").astype(np.int64), np.frombuffer(value, "<f4").astype(np.float64)) for _, at, value, _ in held]
        m = train(rows, np.array([r[3] for r in held], dtype=np.float64), how)
        yield pa.RecordBatch.from_arrays(
            [pa.array([m.bias]), pa.array([m.weight.tobytes()], pa.binary()), pa.array([m.factor.tobytes()], pa.binary())], names=["bias", "weight", "factor"])

    found = bounded.mapInArrow(learnt, "bias double, weight binary, factor binary").collect()  # the model alone
    if not found:
        return train([], np.empty(0), how)
    return Model(found[0].bias, np.frombuffer(found[0].weight), np.frombuffer(found[0].factor).reshape(-1, how.rank))


def score(docs: DataFrame, model: Model, how: FM = FM()) -> DataFrame:
    """All columns of ``docs`` and ``score``, which replaces a column of that name."""
    sent = docs.sparkSession.sparkContext.broadcast((model.bias, model.weight.astype(np.float32), model.factor.astype(np.float32)))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*sent.value)
        for b in batches:
            texts = b.column(at).to_pylist()
            out = [m.scores([features(t, how) for t in texts[lo:lo + 64]]) for lo in range(0, len(texts), 64)]
            s = pa.array(np.concatenate(out) if out else np.empty(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, s], names=[*b.schema.names, "score"])

    given = docs.drop("score")
    at = given.columns.index("text")
    return given.mapInArrow(work, StructType([*given.schema.fields, StructField("score", DoubleType())]))


def judged(docs: DataFrame, labels: DataFrame, how: FM = FM()) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs (doc_id, text)``.

    A NULL text is scored as empty.  Repeated rows come back as often as given; other columns are ignored; an empty
    table gives an empty result.
    """
    scored = score(docs.select("doc_id", "text"), fit(docs, labels, how), how)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, how: FM = FM(), least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with a score of at least ``least``; columns as given."""
    return score(docs, fit(docs, labels, how), how).filter(F.col("score") >= least).select(*docs.columns)
