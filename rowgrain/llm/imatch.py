"""I-Match document fingerprints from several randomised subsets of a lexicon.

The lexicon holds the terms whose document frequency lies in a band; its lower edge is a share of all documents, so
the lexicon has at most (mean distinct terms per document) / share terms whatever the size of the corpus, and can be
sent to every task.  A fingerprint has one code per subset: the hash of the document's distinct lexicon terms that
are in the subset, in sorted order.  Subsets of several densities serve short and long documents.
The first code is of all terms, so that only a text without terms has zeros alone.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct terms that a task gathers before it passes their counts on.
TERMS = 300_000
#: Hex digits of a subset's code; all zero where no term is in the subset.
DIGITS = 4


@dataclass(frozen=True)
class IMatch:
    """``low`` and ``high``: shares of documents between which a term counts.  ``densities``: share of the lexicon in a
    subset, as negative powers of two; ``subsets`` of each.  Documents with fewer than ``least`` lexicon terms use all
    of their terms."""

    low: float = 0.001
    high: float = 0.3
    densities: tuple[int, ...] = (3, 4, 5, 6, 7, 8, 10, 12)
    subsets: int = 8
    least: int = 4
    seed: int = 11


def terms(text: str | None) -> set[str]:
    return set(text.lower().split()) if text else set()


def lexicon(docs: DataFrame, how: IMatch) -> list[str]:
    """Terms in the band, counted over all documents; in a fixed order."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[str] = Counter()

        def counted() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["term", "n"])

        for b in batches:
            for t in b["text"].to_pylist():
                n.update(terms(t))
                if len(n) > TERMS:
                    yield counted()
                    n.clear()
        yield counted()

    total = docs.count()
    df = docs.select("text").mapInArrow(work, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    band = df.filter((F.col("n") >= how.low * total) & (F.col("n") <= how.high * total) & (F.col("n") > 1))
    return sorted(r.term for r in band.select("term").collect())


def term_rows(words: Iterable[str], how: IMatch) -> np.ndarray:
    """Hash of each term, and a bit per subset that says whether it holds the term."""
    words = list(words)
    out = np.empty((len(words), 2), dtype=np.uint64)
    for k, w in enumerate(words):
        raw = w.encode("utf-8", "surrogatepass")
        draw = np.frombuffer(hashlib.blake2b(raw, digest_size=64, salt=how.seed.to_bytes(8, "little")).digest() * 4, dtype="<u4")
        mask = 0
        for s in range(len(how.densities) * how.subsets):
            if (int(draw[s % 16]) * (2 * s + 0x9E3779B1) >> 7) & ((1 << how.densities[s // how.subsets]) - 1) == 0:
                mask |= 1 << s
        out[k] = xxhash.xxh64_intdigest(raw, how.seed), mask
    return out


class Fingerprinter:
    """Fingerprints of texts for one lexicon."""

    def __init__(self, words: list[str], how: IMatch):
        self.how, self.n = how, len(how.densities) * how.subsets
        self.place = {w: i for i, w in enumerate(words)}
        self.rows = term_rows(words, how).reshape(-1, 2)

    def __call__(self, text: str | None) -> str:
        found = terms(text)
        place = self.place
        at = [p for p in map(place.get, found) if p is not None]
        if len(at) >= self.how.least:
            rows = self.rows[np.sort(np.array(at))]
        else:  # too few terms in the band: all of them, in sorted order
            rows = term_rows(sorted(found), self.how).reshape(-1, 2)
        # A row per subset; the hashes of its terms lie one after the other.
        bits = np.unpackbits(rows[:, 1].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little", count=self.n)
        subset, term = np.divmod(np.flatnonzero(np.ascontiguousarray(bits.T).view(bool)), max(len(rows), 1))
        raw, ends = rows[term, 0].tobytes(), (8 * np.cumsum(np.bincount(subset, minlength=self.n))).tolist()
        code, lo = [], 0
        for s, hi in enumerate(ends):
            code.append(f"{1 + xxhash.xxh64_intdigest(raw[lo:hi], s) % (16**DIGITS - 1):0{DIGITS}x}" if hi > lo else "0" * DIGITS)
            lo = hi
        whole = f"{1 + xxhash.xxh64_intdigest(rows[:, 0].tobytes(), self.n) % (16**DIGITS - 1):0{DIGITS}x}" if len(rows) else "0" * DIGITS
        return "".join([whole, *code])


def likeness(a: str, b: str, how: IMatch = IMatch(), evidence: int = 8) -> float:
    """Share of subsets whose codes agree, among those with terms of either document; 1 for equal fingerprints.

    The sparsest subsets are taken first, as one changed term spoils least of them, and denser ones until ``evidence``
    subsets have terms.
    """
    if a == b:
        return 1.0
    none, step = "0" * DIGITS, how.subsets * DIGITS
    agree = held = 0
    for hi in range(len(a), 0, -step):  # the code of all terms is left for the end
        codes = [(a[i:i + DIGITS], b[i:i + DIGITS]) for i in range(max(hi - step, 0), hi, DIGITS)]
        held += sum(p != none or q != none for p, q in codes)
        agree += sum(p == q != none for p, q in codes)
        if held >= evidence:
            break
    return agree / held if held else 0.0


def fingerprints(docs: DataFrame, how: IMatch = IMatch()) -> DataFrame:
    """``(doc_id, fingerprint)`` for every row of ``docs (doc_id, text)``."""
    words = docs.sparkSession.sparkContext.broadcast(lexicon(docs, how))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Fingerprinter(words.value, how)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([make(t) for t in b["text"].to_pylist()], pa.string())], names=["doc_id", "fingerprint"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, fingerprint string")


def ranges(docs: DataFrame, parts: int) -> DataFrame:
    """``(part, k, guest, text)``: documents by ranges of ``doc_id``, each range with its successor's first document.

    ``k``: the ``doc_id``, or the smallest number for NULL.  After the last document comes the first.
    """
    k = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    keyed = docs.select(k.alias("k"), "text")
    cuts = keyed.select(F.percentile_approx("k", [i / parts for i in range(1, parts)], 10_000)).first()[0] if parts > 1 else []
    cuts = sorted(set(cuts or []))
    # The number of cuts that lie below.
    part = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col("k"))) if cuts else F.lit(0)
    dealt = keyed.withColumn("part", part.cast("int"))
    first = sorted((r["part"], r["k"]) for r in dealt.groupBy("part").agg(F.min("k").alias("k")).collect())
    if not first:
        return dealt.select("part", "k", F.lit(False).alias("guest"), "text")
    after = [(k, first[i - 1][0]) for i, (_, k) in enumerate(first)]
    to = F.coalesce(*[F.when(F.col("k") == k, F.lit(p)) for k, p in after])
    guests = keyed.filter(F.col("k").isin([k for k, _ in after])).select(to.cast("int").alias("part"), "k", F.lit(True).alias("guest"), "text")
    return dealt.select("part", "k", F.lit(False).alias("guest"), "text").unionByName(guests)


def edited(text: str, after: str) -> str:
    """The last quarter of the code points replaced by the first as many of the text that follows."""
    n = len(text) // 4
    return text[: len(text) - n] + after[:n]


def edit_test(docs: DataFrame, how: IMatch = IMatch(), parts: int | None = None) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and how like they are; and how like the next document's.

    A NULL or empty text has no terms: all codes are zero.  Rows of one number stand in a fixed order.  Rows with a NULL
    number come first.  Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    words = spark.sparkContext.broadcast(lexicon(docs, how))
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts are compressed for the shuffle, and with their length in front."""
        for b in batches:
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in b["text"].to_pylist()]
            short = [len(r).to_bytes(8, "little") + pa.compress(r, "zstd", asbytes=True) if r else b"" for r in raw]
            yield pa.RecordBatch.from_arrays([b["part"], b["guest"], b["k"], pa.array(short, pa.binary())], names=["part", "guest", "k", "raw"])

    # Twice as many ranges as tasks, so that tasks with several of them are more alike.
    rows = ranges(docs, 2 * parts).select("part", "guest", "k", "text").mapInArrow(packed, "part int, guest boolean, k long, raw binary")
    rows = rows.repartition(parts, "part").sortWithinPartitions("part", "guest", "k", "raw")
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Fingerprinter(words.value, how)
        last = None  # part, k, text, fingerprint: waits for its successor
        for b in batches:
            out = []
            for part, k, guest, raw in zip(*(b[c].to_pylist() for c in ("part", "k", "guest", "raw"))):
                size = int.from_bytes(raw[:8], "little")
                text = pa.decompress(raw[8:], size, "zstd", asbytes=True).decode("utf-8", "surrogatepass") if raw else ""
                if last is not None and last[0] != part:
                    last = None
                if guest and last is None:
                    continue
                own = make(text)
                if last is not None:
                    _, key, before, its = last
                    changed = edited(before, text)
                    ends = make(changed)
                    digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
                    number = None if key == -(1 << 63) else key
                    out.append((number, len(before), digest, its, ends, likeness(its, ends, how), likeness(its, own, how)))
                last = None if guest else (part, k, text, own)
            cols = list(zip(*out)) or [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

    return rows.mapInArrow(
        work, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
