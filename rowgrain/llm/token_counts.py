"""Token counts per document without ids: each distinct pre-token is encoded once.

A task cuts its texts, and turns them into one row per distinct pre-token with the documents it is in and how often.
These rows meet by pre-token; there the pieces of each distinct pre-token are counted once and multiplied with the
frequencies, and the products are summed per document.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowgrain.llm.links import runs_of
from rowgrain.llm.tokens import Pieces

#: Document and pre-token pairs that a task gathers before it passes them on.
PAIRS = 2_000_000
#: Documents whose sums travel in one row: so many low bits of a row's number.
CHUNK = 9
_POSTING = np.dtype([("row", "<i8"), ("n", "<i4")])
_SUM = np.dtype([("at", "<u2"), ("n", "<i8")])
_META = np.dtype([("row", "<i8"), ("doc_id", "<i8"), ("valid", "u1"), ("n_bytes", "<i8")])


def _by_chunk(rows: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Chunks of ascending rows, and where each begins and ends."""
    chunk = rows >> CHUNK
    edges = np.flatnonzero(np.diff(chunk, prepend=-1, append=-1)).tolist()
    return chunk[edges[:-1]], list(zip(edges, edges[1:]))


def _postings(path: str):
    names = ["word", "post", "chunk"]

    def rows(index: dict[str, int], where: list[int], row: list[int], n: list[int]) -> pa.RecordBatch:
        w = np.array(where, dtype=np.int64)
        order = np.argsort(w, kind="stable")
        post = np.empty(len(w), dtype=_POSTING)
        post["row"], post["n"] = np.array(row, dtype=np.int64)[order], np.array(n, dtype=np.int64)[order]
        ends = np.cumsum(np.bincount(w, minlength=len(index))) * _POSTING.itemsize
        offsets = np.concatenate([[0], ends]).astype(np.int32)
        packed = pa.Array.from_buffers(pa.binary(), len(index), [None, pa.py_buffer(offsets), pa.py_buffer(post)])
        return pa.RecordBatch.from_arrays([pa.array(list(index), pa.string()), packed, pa.nulls(len(index), pa.int64())], names=names)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(path)
        next_row = TaskContext.get().partitionId() << 33
        index: dict[str, int] = {}
        where: list[int] = []
        row: list[int] = []
        n: list[int] = []
        for b in batches:
            texts = b["text"].to_pylist()
            if not texts:
                continue
            meta = np.zeros(len(texts), dtype=_META)
            meta["row"] = np.arange(next_row, next_row + len(texts))
            meta["doc_id"], meta["valid"] = b["doc_id"].fill_null(0).to_numpy(), b["doc_id"].is_valid().to_numpy(zero_copy_only=False)
            meta["n_bytes"] = [len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts]
            chunk, spans = _by_chunk(meta["row"])
            packed = pa.array([meta[a:z].tobytes() for a, z in spans], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.nulls(len(spans), pa.string()), packed, pa.array(chunk)], names=names)
            for r, t in enumerate(texts, next_row):
                if not t:
                    continue
                count = Counter(pieces.pretokens(t))
                where += [index.setdefault(w, len(index)) for w in count]
                n += count.values()
                row += [r] * len(count)
                if len(where) >= PAIRS:
                    yield rows(index, where, row, n)
                    index, where, row, n = {}, [], [], []
            next_row += len(texts)
        if where:
            yield rows(index, where, row, n)

    return work


def _multiplied(path: str):
    """Multiply frequencies with piece counts, and add up per document as far as a task can."""

    def sums(row: list[np.ndarray], n: list[np.ndarray]) -> pa.RecordBatch:
        r, at = np.unique(np.concatenate(row), return_inverse=True)
        out = np.empty(len(r), dtype=_SUM)
        out["at"], out["n"] = r & ((1 << CHUNK) - 1), np.bincount(at, np.concatenate(n), len(r))
        chunk, spans = _by_chunk(r)
        packed = pa.array([out[a:z].tobytes() for a, z in spans], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(chunk), pa.nulls(len(spans), pa.binary()), packed], names=["chunk", "meta", "sums"])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(path)
        known: dict[str, int] = {}
        row: list[np.ndarray] = []
        n: list[np.ndarray] = []
        held = 0
        for b in batches:
            own = b.filter(b["chunk"].is_valid())
            yield pa.RecordBatch.from_arrays([own["chunk"], own["post"], pa.nulls(own.num_rows, pa.binary())], names=["chunk", "meta", "sums"])
            rest = b.filter(b["word"].is_valid())
            if not rest.num_rows:
                continue
            words = rest["word"].to_pylist()
            new = list({w for w in words if w not in known})
            known.update(zip(new, pieces.counts(new)))
            post = rest["post"].to_pylist()
            got = np.frombuffer(b"".join(post), dtype=_POSTING)
            each = np.array([known[w] for w in words], dtype=np.int64)
            row.append(got["row"])
            n.append(got["n"] * np.repeat(each, [len(p) // _POSTING.itemsize for p in post]))
            held += len(got)
            if held >= PAIRS:
                yield sums(row, n)
                row, n, held = [], [], 0
        if held:
            yield sums(row, n)

    return work


def _summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Totals of the documents of a chunk."""
    for t, run in runs_of(batches, ["chunk"]):
        metas, parts = t["meta"].to_pylist(), t["sums"].to_pylist()
        edges = np.flatnonzero(np.diff(run, prepend=-1, append=-1)).tolist()
        for a, z in zip(edges, edges[1:]):
            meta = np.frombuffer(b"".join([m for m in metas[a:z] if m]), dtype=_META)
            part = np.frombuffer(b"".join([p for p in parts[a:z] if p]), dtype=_SUM)
            total = np.bincount(part["at"], part["n"], 1 << CHUNK).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(meta["doc_id"].astype(np.int64), mask=meta["valid"] == 0), pa.array(meta["n_bytes"].astype(np.int64)),
                 pa.array(total[meta["row"] & ((1 << CHUNK) - 1)])], names=["doc_id", "n_bytes", "n_tokens"],
            )


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` for every row of ``docs (doc_id, text)``.

    ``tokenizer``: a file of the tokenizers library.  A NULL or empty text has no bytes and no tokens.  Rows are told
    apart by place, so repeated rows and NULL numbers come back as often as given.  Other columns are ignored.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = given.mapInArrow(_postings(tokenizer), "word string, post binary, chunk long")
    met = rows.repartition(parts, "word", "chunk").mapInArrow(_multiplied(tokenizer), "chunk long, meta binary, sums binary")
    sums = met.repartition(parts, "chunk").sortWithinPartitions("chunk").mapInArrow(_summed, "doc_id long, n_bytes long, n_tokens long")
    return sums.withColumn("over_limit", F.col("n_tokens") > limit)
