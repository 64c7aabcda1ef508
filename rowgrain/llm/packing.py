"""Best-fit packing of documents into sequences under several capacities at once.

A document takes tokens, one place in the document count, and attention cost (the square of its length).  Pieces go
in order of falling size to the open sequence that fits best under every capacity: the one with the smallest weighted
product of what is left in it and what the piece takes (``dot``), or with the smallest weighted norm of what would be
left (``norm``).  Full pieces are sequences of their own; the others are packed with those of the documents next to
them in the input, in shards of a bounded number of documents, so that a sequence keeps the mix of its input and a
shard leaves about one sequence far from full.  The input's order is that of the scan, or that of a column of positions,
by which sequences are then numbered too.  Where tokens leave room for fewer sequences, the least full ones are packed
anew by a bounded search for the fullest.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowgrain.llm.tokens import Pieces
from rowgrain.session import cut_lineage

#: Documents packed together; a document has one piece at most that is not full.
SHARD = 8192
#: Bits for the piece in a sequence number made of a position and a piece.
PIECE_BITS = 24


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds.  ``documents`` and ``attention`` of None never bind.  With ``alone`` the attention capacity
    may be below the cost of a full piece: a piece that exceeds it by itself has a sequence of its own."""

    tokens: int = 2048
    documents: int | None = None
    attention: int | None = None
    weights: tuple[float, float, float] = (1.0, 0.05, 0.2)
    rule: str = "norm"
    alone: bool = False

    def limits(self) -> np.ndarray:
        """As many documents as tokens, and the cost of one full document, cannot be exceeded within the tokens."""
        return np.array([self.tokens, self.documents or self.tokens, self.attention or self.tokens**2], dtype=np.float64)

    def __post_init__(self):
        if self.rule not in ("dot", "norm"):
            raise ValueError(f"no such rule: {self.rule}")
        if self.attention is not None and self.attention < self.tokens**2 and not self.alone:
            raise ValueError("a full piece must fit the attention capacity, or stand alone")


def best_fit(lengths: np.ndarray, cap: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece, the least full sequences packed anew where that saves any."""
    return refined(lengths, cap, *_by_falling_size(lengths, cap))


def _by_falling_size(lengths: np.ndarray, cap: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """Ties go to the sequence opened first."""
    limit = cap.limits()
    weight = np.array(cap.weights)
    order = np.argsort(-lengths, kind="stable")
    bins, offset = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    left = np.empty((len(lengths), 3))
    names = np.empty(len(lengths), dtype=np.int64)
    n_open, n_bins = 0, 0
    smallest = lengths.min() if len(lengths) else 0
    for step, at in enumerate(order.tolist()):
        size = float(lengths[at])
        take = np.array([size, 1.0, size * size])
        free = left[:n_open]
        fit = np.flatnonzero((free >= take).all(1))
        if len(fit):
            share, part = free[fit] / limit, take / limit
            score = ((share * part) @ weight) if cap.rule == "dot" else (((share - part) ** 2) @ weight)
            b = int(fit[np.argmin(score)])
        else:
            b = n_open
            left[b], names[b] = limit, n_bins
            n_open, n_bins = n_open + 1, n_bins + 1
        bins[at], offset[at] = names[b], limit[0] - left[b, 0]
        left[b] -= take
        if step % 256 == 255:  # sequences that nothing fits any more leave the list
            keep = np.flatnonzero((left[:n_open, 0] >= smallest) & (left[:n_open, 1] >= 1))
            left[: len(keep)], names[: len(keep)] = left[keep], names[keep]
            n_open = len(keep)
    return bins, offset


#: Sequences packed anew after best-fit where there may be one too many, and steps of the search for each.
AGAIN, STEPS = 64, 1000


def _fullest(sizes: list[int], count: dict[int, int], left: list[float]) -> list[int]:
    """Pieces that fill what is left of a sequence as far as a bounded search finds, under every capacity.

    ``sizes``: lengths still there, falling; ``count``: how many of each.
    """
    best: list[int] = []
    best_sum, steps = 0, 0
    goal = left[0]

    def search(at: int, tokens: float, documents: float, attention: float, chosen: list[int], total: int) -> bool:
        nonlocal best, best_sum, steps
        if total > best_sum:
            best, best_sum = chosen[:], total
        if best_sum == goal:
            return True
        for k in range(at, len(sizes)):
            s = sizes[k]
            if s > tokens or s * s > attention or documents < 1 or chosen.count(s) >= count[s]:
                continue
            steps += 1
            if steps > STEPS:
                return True
            if search(k, tokens - s, documents - 1, attention - s * s, [*chosen, s], total + s):
                return True
        return False

    search(0, *left, [], 0)
    return best


def refined(lengths: np.ndarray, cap: Capacity, bins: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pack the least full sequences anew, each filled as far as possible from its largest piece on, where that saves any.

    Nothing is done where the tokens leave no sequence to save.
    """
    n = int(bins.max()) + 1 if len(bins) else 0
    limit = cap.limits()
    if n <= -(-int(lengths.sum()) // cap.tokens):
        return bins, offset
    full = np.bincount(bins, lengths, n)
    again = np.sort(np.argsort(full, kind="stable")[:AGAIN])
    rows = np.flatnonzero(np.isin(bins, again))
    of: dict[int, list[int]] = {}
    for i in rows[::-1].tolist():
        of.setdefault(int(lengths[i]), []).append(i)
    packed: list[list[int]] = []
    while of:
        sizes = sorted(of, reverse=True)
        first = sizes[0]
        count = {s: len(x) - (s == first) for s, x in of.items()}
        left = [float(limit[0] - first), float(limit[1] - 1), float(limit[2] - first * first)]
        chosen = [first, *_fullest([s for s in sizes if count[s]], count, left)]
        packed.append([of[s].pop() for s in chosen])
        of = {s: x for s, x in of.items() if x}
    if len(packed) >= len(again):
        return bins, offset
    bins, offset = bins.copy(), offset.copy()
    for name, members in zip(again.tolist(), packed):
        at = 0
        for i in members:
            bins[i], offset[i] = name, at
            at += int(lengths[i])
    return np.unique(bins, return_inverse=True)[1], offset


def numbered(cut: DataFrame) -> DataFrame:
    """Rows numbered without gaps: scan partitions leave some, and shards of numbers would be as many as partitions."""
    part = F.shiftright("row", 33)
    rows = cut.groupBy(part.alias("part")).agg((F.max(F.col("row").bitwiseAND((1 << 33) - 1)) + 1).alias("n"))
    # One row per partition of the scan.
    before = rows.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    joined = cut.withColumn("part", part).join(F.broadcast(before), "part")
    return joined.withColumn("row", F.col("before") + F.col("row").bitwiseAND((1 << 33) - 1)).select(*cut.columns)


def pieces(docs: DataFrame, tokenizer: str, tokens: int = 2048, end: int = 0, position: str | None = None) -> DataFrame:
    """``(row, doc_id, piece, start, length, ids_crc32)``: each document's ids and the end id, cut at ``tokens``.

    ``row`` is the number in the column ``position``, or follows the scan.
    """

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib = Pieces(tokenizer)
        next_row = TaskContext.get().partitionId() << 33
        stop = np.array([end], dtype="<u4")
        for b in batches:
            out = []
            rows = b["row"].to_pylist() if position else range(next_row, next_row + b.num_rows)
            next_row += b.num_rows
            for row, d, ids in zip(rows, b["doc_id"].to_pylist(), lib.ids(b["text"].to_pylist())):
                ids = np.concatenate([ids, stop])
                for k, s in enumerate(range(0, len(ids), tokens)):
                    part = ids[s:s + tokens]
                    out.append((row, d, k, s, len(part), zlib.crc32(part.tobytes())))
            cols = list(zip(*out)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds)], names=["row", "doc_id", "piece", "start", "length", "ids_crc32"]
            )

    schema = "row long, doc_id long, piece int, start long, length long, ids_crc32 long"
    return docs.select("doc_id", "text", *([F.col(position).alias("row")] if position else [])).mapInArrow(work, schema)


def pack(cut: DataFrame, cap: Capacity = Capacity(), shard: int = SHARD, by_row: bool = False) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows of ``row, piece, length``; at most ``shard`` rows are packed at once.

    Sequences are numbered with gaps; ``by_row``: all in the order of the first row in each, full ones included.
    """
    first = F.shiftleft("row", PIECE_BITS) + F.col("piece")
    alone = F.col("length") == cap.tokens
    # Full pieces need no partner; their numbers are negative, those of the shards are not.
    single = cut.filter(alone).withColumns({
        "sequence_id": first if by_row else F.lit(-1) - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long"),
    })
    dealt = cut.filter(~alone).withColumn("shard", F.floor(F.col("row") / shard).cast("long"))

    def packed(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["row", "piece"], kind="stable")
        lengths = part["length"].to_numpy()
        bins, offset = best_fit(lengths, cap)
        if not by_row:
            return part.assign(sequence_id=part["shard"].to_numpy() * shard + bins, offset=offset)
        _, head = np.unique(bins, return_index=True)  # the first row of each sequence; bins count from 0
        number = (part["row"].to_numpy() << PIECE_BITS) + part["piece"].to_numpy()
        return part.assign(sequence_id=number[head][bins], offset=offset)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema)
    mixed = dealt.groupBy("shard").applyInPandas(packed, f"{fields}, sequence_id long, offset long").drop("shard")
    return single.unionByName(mixed)


def pack_documents(docs: DataFrame, tokenizer: str, cap: Capacity = Capacity(), end: int = 0, position: str | None = None, shard: int = SHARD) -> DataFrame:
    """One row per piece of every row of ``docs (doc_id, text)``: its place in a sequence.

    With a column ``position``, gapless from 0, neighbours are those by position, and ascending ``sequence_id`` follows
    the first position in each sequence; without, neighbours are those of the scan.

    A NULL or empty text is the end id alone.  Repeated rows and NULL numbers are packed like any other.  Other
    columns are ignored; an empty table gives an empty result.
    """
    cut = cut_lineage(pieces(docs, tokenizer, cap.tokens, end, position))
    return pack(cut if position else numbered(cut), cap, shard, position is not None).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
