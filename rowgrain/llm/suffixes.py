"""Removal of byte strings of a minimum length that occur more than once, by suffix intervals.

Every window of ``LENGTH`` bytes is filed under one of its own ``GRAM``-byte strings, the one with the smallest hash
(the last of equals), so equal windows are filed alike wherever they stand.  Windows of a document that are filed
under one place form a fragment.  Fragments that share their string meet; the others, most of the text, cannot hold a
repeated window and are let go.

Fragments that meet are laid one after the other and their suffixes sorted.  On the Burrows-Wheeler transform of that
order, common prefixes come from intervals by increasing length: a boundary between two rows at length ``l`` gives, by
one backward step, the boundaries at ``l + 1``.  The expansion goes breadth-first from what the sort already tells and
stops at the minimum length; rows still not parted are repeated.

A string with many fragments is split again by longer stretches of text that its windows must share, down to single
windows, so that no task ever holds more than ``HOT`` fragments of one string and no pair of fragments is compared.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowgrain.llm.links import runs_of, with_components
from rowgrain.session import checkpoint_folder, cut_lineage

GRAM = 32
#: Fragments of one string that are sorted together; more are split by longer shared stretches.
HOT = 512
#: Windows in a piece at each further split.
STEPS = (46, 6, 1)
#: Bytes of fragments that are sorted together, and bytes of text hashed together: what a processor's cache holds.
BUNDLE, TEXT = 1 << 18, 1 << 17
#: Bytes of fragments that a task gathers to find equal ones, and documents whose fragments are unpacked at once.
HELD, DOCS = 8 << 20, 256
_PLACE = np.dtype([("row", "<i8"), ("at", "<i8")])


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ``GRAM`` bytes at each place, by doubling."""
    h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    width, base = 1, 0xD6E8FEB86659FD93
    while width < GRAM:
        h = h[: len(h) - width] * np.uint64(base) + h[width:]
        h ^= h >> np.uint64(29)
        width, base = 2 * width, base * base % (1 << 64)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(30))


def filed(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash at each place, and the place each window of ``length`` bytes is filed under."""
    hashes = gram_hashes(data)
    if len(data) < length:
        return hashes, np.empty(0, dtype=np.int64)
    place = np.arange(len(hashes), dtype=np.uint64)
    low = (hashes & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - place)
    window, width = length - GRAM + 1, 1
    while 2 * width <= window:
        low = np.minimum(low[: len(low) - width], low[width:])
        width *= 2
    low = np.minimum(low[: len(hashes) - window + 1], low[window - width: window - width + len(hashes) - window + 1])
    return hashes, (np.uint64(0xFFFFFFFF) - (low & np.uint64(0xFFFFFFFF))).astype(np.int64)


def fragments(texts: list[bytes], length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each text its number, and per fragment: hash of its string, its place, first window and number of windows."""
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= TEXT):
            size += len(texts[hi])
            hi += 1
        first = np.cumsum([0, *map(len, texts[lo:hi])])
        data = np.frombuffer(b"".join(texts[lo:hi]), dtype=np.uint8)
        if len(data) >= length:
            hashes, place = filed(data, length)
            for k in range(lo, hi):
                a, b = int(first[k - lo]), int(first[k - lo + 1])
                if b - a < length:
                    continue
                own = place[a:b - length + 1]
                starts = np.flatnonzero(np.diff(own, prepend=-1))
                at = own[starts]
                yield k, hashes[at].view(np.int64), at - a, starts, np.diff(starts, append=len(own))
        lo = hi


def suffix_order(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Places in the order of their suffixes to at least ``depth`` bytes; where rows part within the last depth known
    below ``depth``, and that depth."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, dtype=np.uint8)]).astype(np.uint64)
    key = np.zeros(n, dtype=np.uint64)
    for k in range(8):
        key = key << np.uint64(8) | padded[k:k + n]
    known, rank = 8, None
    while True:
        order = np.argsort(key)  # rows alike so far may stand in any order
        parted = np.concatenate([[True], np.diff(key[order]) != 0])
        fresh = np.empty(n, dtype=np.int64)
        fresh[order] = np.cumsum(parted) - 1
        if known >= depth and rank is not None:
            before = np.concatenate([[True], np.diff(rank[order]) != 0])
            return order, before, known // 2
        rank = fresh
        after = np.zeros(n, dtype=np.int64)
        after[: max(n - known, 0)] = rank[known:] + 1
        key = rank.astype(np.uint64) << np.uint64(32) | after.astype(np.uint64)
        known *= 2


def repeated_classes(text: np.ndarray, length: int) -> np.ndarray:
    """A class for each place: equal where the ``length`` bytes from there on are equal.

    Bytes past the end count as zeros, and zeros as smallest.
    """
    order, parted, level = suffix_order(text, length)
    before = text[order - 1]  # the transform; the text is taken as a ring
    # Rows by the byte before them, in order: row k is reached by one step back from row back[k].
    back = np.argsort(before, kind="stable")
    same = np.concatenate([[False], before[back[1:]] == before[back[:-1]]])
    open_ = np.flatnonzero(~parted & same)
    # Row k parts from row k - 1 one byte later than anything parts between the rows they come from.
    high, low = back[open_], back[open_ - 1]
    sums = np.cumsum(parted, dtype=np.int32)
    hit = sums[high] > sums[low]
    while level < length and hit.any():
        new, level = open_[hit], level + 1
        parted[new] = True
        open_, high, low = open_[~hit], high[~hit], low[~hit]
        if len(new) * 8 < len(open_):  # few new boundaries: look rows up among them
            hit = np.searchsorted(new, high, side="right") > np.searchsorted(new, low, side="right")
        else:
            fresh = np.zeros(len(text), dtype=np.int32)
            fresh[new] = 1
            sums = np.cumsum(fresh, dtype=np.int32)
            hit = sums[high] > sums[low]
    out = np.empty(len(text), dtype=np.int64)
    out[order] = np.cumsum(parted) - 1
    return out


def repeated_windows(pieces: list[bytes], windows: np.ndarray, copies: np.ndarray, length: int) -> list[np.ndarray]:
    """Which of the first ``windows`` places of each piece start a string that another place (or copy) starts too."""
    first = np.cumsum([0, *[len(p) + 1 for p in pieces]])
    text = np.frombuffer(b"\x00".join(pieces) + b"\x00", dtype=np.uint8)
    classes = repeated_classes(text, length)
    weight = np.zeros(len(text), dtype=np.int64)
    for k in range(len(pieces)):
        weight[first[k]:first[k] + windows[k]] = copies[k]
    total = np.bincount(classes, weight)
    return [total[classes[first[k]:first[k] + windows[k]]] > 1 for k in range(len(pieces))]


_PIECE = "key long, n long, windows int, offset int, piece binary, members binary"
_NAMES = ["key", "n", "windows", "offset", "piece", "members"]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    cols = list(zip(*rows)) or [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=_NAMES)


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))


def _anchored(length: int):
    """Rows of the index: each document's fragments by string."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(lo, DOCS) for b in batches for lo in range(0, b.num_rows, DOCS)):
            row = b["row"].to_numpy()
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in b["text"].to_pylist()]
            got = list(fragments(texts, length))
            if got:
                rows = np.repeat(row[[k for k, *_ in got]], [len(f[1]) for f in got])
                key, place, start, n = (np.concatenate([f[c] for f in got]) for c in range(1, 5))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(rows), pa.array(place), pa.array(start), pa.array(n.astype(np.int32))],
                    names=["key", "row", "place", "start", "windows"],
                )

    return work


def _numbered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows numbered by place."""
    row = TaskContext.get().partitionId() << 33
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + b.num_rows)), *b.columns], names=["row", *b.schema.names])
        row += b.num_rows


def _cut_out(length: int):
    """Fragments of documents that share a string with another fragment; equal ones of a task once, with members.

    ``n``: how many fragments of all documents share the string.
    """

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        size = 0

        def out() -> pa.RecordBatch:
            return _batch([(key, *rest, np.array(m, dtype=_PLACE).tobytes()) for (key, *rest), m in held.items()])

        for b in (b.slice(lo, DOCS) for b in batches for lo in range(0, b.num_rows, DOCS)):
            for row, text, hits in zip(b["row"].to_pylist(), b["text"].to_pylist(), b["hits"].to_pylist()):
                raw = text.encode("utf-8", "surrogatepass")
                for h in hits:
                    s, n = h["start"], h["windows"]
                    piece = raw[s:s + n - 1 + length]
                    got = held.get(k := (h["key"], h["n"], n, h["place"] - s, piece))
                    if got is None:
                        held[k] = [(row, s)]
                        size += len(piece)
                    else:
                        got.append((row, s))
                if size > HELD:
                    yield out()
                    held.clear()
                    size = 0
        if held:
            yield out()

    return work


def _split(step: int, length: int):
    """Pieces of at most ``step`` windows, on a grid fixed to their string, keyed by the bytes all windows of a cell share."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held: dict[tuple, list[bytes]] = {}
            for n, off, piece, members in zip(*(b[c].to_pylist() for c in ("windows", "offset", "piece", "members"))):
                # Window i starts ``off - i`` bytes before the string; cells are counted in that distance.
                i = 0
                while i < n:
                    cell = (off - i) // step
                    j = min(n, off - cell * step + 1)  # the last window of the cell, and one
                    core = piece[off - cell * step:off - (cell * step + step - 1) + length]
                    key = xxhash.xxh64_intdigest(core, cell & 0xFFFF) - (1 << 63)
                    moved = np.frombuffer(members, dtype=_PLACE).copy()
                    moved["at"] += i
                    held.setdefault((key, j - i, off - i, piece[i:j - 1 + length]), []).append(moved.tobytes())
                    i = j
            yield _batch([(key, None, n, off, piece, b"".join(m)) for (key, n, off, piece), m in held.items()])

    return work


def _cut_and_split(step: int, length: int):
    """Both in one Python process: two would stand beside each other in every task."""
    cut, split = _cut_out(length), _split(step, length)
    return lambda batches: split(cut(batches))


def _found(length: int):
    """Spans of repeated windows, ``(row, first, last)``, from pieces sorted by key."""

    def spans(pieces: list[bytes], windows: list[int], members: list[bytes]) -> pa.RecordBatch:
        where = [np.frombuffer(m, dtype=_PLACE) for m in members]
        flags = repeated_windows(pieces, np.array(windows), np.array([len(w) for w in where]), length)
        row, first, last = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for w, f in zip(where, flags):
            for a, b in _runs(f):
                row.append(w["row"])
                first.append(w["at"] + a)
                last.append(w["at"] + b - 1 + length)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (row, first, last)], names=["row", "first", "last"])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: list[bytes] = []
        windows: list[int] = []
        members: list[bytes] = []
        size = 0
        for t, run in runs_of(batches, ["key"]):
            p, w, m = (t[c].to_pylist() for c in ("piece", "windows", "members"))
            equal: list[tuple[int, np.ndarray]] = []
            edges = np.flatnonzero(np.diff(run, prepend=-1, append=-1))
            for a, b in zip(edges.tolist(), edges[1:].tolist()):
                own: dict[tuple[bytes, int], list[bytes]] = {}
                for k in range(a, b):
                    own.setdefault((p[k], w[k]), []).append(m[k])
                if len(own) == 1:
                    # Equal windows have one key: alone, none is repeated; of several equal fragments, each is.
                    at = np.frombuffer(b"".join(m[a:b]), dtype=_PLACE)
                    if len(at) > 1:
                        equal.append((w[a], at))
                    continue
                pieces += [k for k, _ in own]
                windows += [k for _, k in own]
                members += [b"".join(x) for x in own.values()]
                size += sum(len(k) for k, _ in own)
                if size > BUNDLE:
                    yield spans(pieces, windows, members)
                    pieces, windows, members, size = [], [], [], 0
            if equal:
                at, n = np.concatenate([x for _, x in equal]), np.repeat([k for k, _ in equal], [len(x) for _, x in equal])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (at["row"], at["at"], at["at"] + n - 1 + length)], names=["row", "first", "last"]
                )
        if pieces:
            yield spans(pieces, windows, members)

    return work


def _copies(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        copies = pa.array([len(m) // _PLACE.itemsize for m in b["members"].to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([b["key"], b["piece"], b["members"], copies], names=["key", "piece", "members", "copies"])


def _salted(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """A join in which Spark can split a frequent key: both sides get a shuffle of their own."""
    salt = F.xxhash64(*on)
    return left.withColumn("salt", salt).join(right.withColumn("salt", salt), [*on, "salt"]).drop("salt")


def repeated_spans(pieces: DataFrame, split: DataFrame, length: int, hot: int = HOT) -> DataFrame:
    """``(row, first, last)`` of repeated bytes in ``pieces`` and in ``split``.

    ``split`` holds the pieces of frequent keys after the first step; those that are frequent still are split further.
    """
    parts = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spans = "row long, first long, last long"

    def found(some: DataFrame) -> DataFrame:
        return some.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_found(length), spans)

    out = found(pieces)
    for step in [*STEPS[1:], None]:
        split = cut_lineage(split)
        if split.isEmpty():
            return out
        sizes = split.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        pieces = _salted(split, sizes, ["key"]).select(*_NAMES)
        if step is not None:
            out = out.unionByName(found(pieces.filter(F.col("n") <= hot)))
            split = pieces.filter(F.col("n") > hot).mapInArrow(_split(step, length), _PIECE).drop("n")
    # Single windows: pieces with one key are equal, so counting them is enough.
    single = pieces.mapInArrow(_copies, "key long, piece binary, members binary, copies long")
    twice = single.groupBy("key", "piece").agg(F.sum("copies").alias("copies")).filter("copies > 1").drop("copies")
    return out.unionByName(_salted(single, twice, ["key", "piece"]).mapInArrow(_members(length), spans))


def _members(length: int):
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = np.frombuffer(b"".join(b["members"].to_pylist()), dtype=_PLACE)
            yield pa.RecordBatch.from_arrays([pa.array(w["row"]), pa.array(w["at"]), pa.array(w["at"] + length)], names=["row", "first", "last"])

    return work


def _kept(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for d, text, spans in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), b["spans"].to_pylist()):
            raw, kept, at, removed, runs = text.encode("utf-8", "surrogatepass"), [], 0, 0, 0
            reach = None
            for s in sorted((s["first"], s["last"]) for s in spans or []):
                if reach is None or s[0] > reach:
                    runs += 1
                    kept.append(raw[at:s[0]])
                    removed += s[1] - s[0]
                    reach = at = s[1]
                elif s[1] > reach:
                    removed += s[1] - reach
                    reach = at = s[1]
            kept.append(raw[at:])
            left = b"".join(kept)
            out.append((d, len(raw), removed, runs, hashlib.sha256(left).hexdigest(), left.decode("utf-8", "replace")))
        cols = list(zip(*out)) or [[]] * 6
        kinds = [b.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)


def removed(docs: DataFrame, length: int = 400, hot: int = HOT, text: bool = False) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` for every row of ``docs (doc_id, text)``.

    A byte is removed if some string of ``length`` bytes over it also starts anywhere else, in this or another row,
    overlaps included; what is left of other matches does not matter.  Texts are UTF-8; a NULL text is empty.  Rows are
    told apart by a number of their own, written once with the texts and read from there by all that follows, so
    repeated rows and NULL numbers are documents like any other.  Other columns are ignored; an empty table gives an empty result.

    With ``text`` a column of that name follows with what is left.  Where a match cut through a character, the bytes
    left of it are shown as U+FFFD there; the checksum has them as they are.
    """
    if length < 2 * GRAM:
        raise ValueError(f"the length must be {2 * GRAM} at least")
    spark = docs.sparkSession
    folder = f"{checkpoint_folder(spark)}/suffixes-{uuid.uuid4().hex}"

    def saved(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    kind = docs.schema["doc_id"].dataType.simpleString()
    numbered = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_numbered, f"row long, doc_id {kind}, text string")
    numbered = saved(numbered, "texts")
    index = saved(numbered.select("row", "text").mapInArrow(_anchored(length), "key long, row long, place long, start long, windows int"), "index")
    shared = index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    hits = _salted(index, shared, ["key"]).groupBy("row").agg(F.collect_list(F.struct("key", "n", "place", "start", "windows")).alias("hits"))
    # Texts that are equal as a whole: the first stands for all in what follows, and all are removed.
    digest = numbered.select("row", F.sha2("text", 256).alias("sha256"))
    twins = digest.groupBy("sha256").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("copies")).filter("copies > 1").drop("copies")
    first = with_components(digest, "sha256", twins).filter("first is not null").select("row", "first")
    plain = numbered.withColumns({"n_bytes": F.octet_length("text").cast("long"), "sha256": F.sha2("text", 256)})
    seen = plain.join(hits.join(first, "row", "full"), "row", "left")
    part = F.col("hits").isNotNull() & (F.col("first").isNull() | ((F.col("first") == F.col("row"))))
    whole = F.col("first").isNotNull() & (F.col("n_bytes") >= length)
    # From here on only documents that share a string are kept with their text, or those of which something is left.
    marked = saved(seen.withColumns({"text": F.when(part | ~whole if text else part, F.col("text")), "hits": F.when(part, F.col("hits"))}), "documents")

    def with_hits(frequent: bool) -> DataFrame:
        own = F.filter("hits", lambda h: (h["n"] > hot) if frequent else (h["n"] <= hot))
        return marked.select("row", "text", own.alias("hits")).filter(F.size("hits") > 0)

    pieces = with_hits(False).mapInArrow(_cut_out(length), _PIECE)
    split = with_hits(True).mapInArrow(_cut_and_split(STEPS[0], length), _PIECE).drop("n")
    spans = repeated_spans(pieces, split, length, hot).groupBy("row").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    search = marked.filter(F.col("hits").isNotNull() & ~whole).select("row", "doc_id", "text").join(spans, "row", "left")
    done = search.select("doc_id", "text", "spans").mapInArrow(
        _kept, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string"
    )
    rest = marked.filter(F.col("hits").isNull() | whole)
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    out = done.unionByName(rest.select(
        "doc_id", "n_bytes", F.when(whole, F.col("n_bytes")).otherwise(F.lit(0)).alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.lit(0)).cast("long").alias("n_spans"), F.when(whole, nothing).otherwise(F.col("sha256")).alias("kept_sha256"),
        F.when(whole, F.lit("")).otherwise(F.col("text")).alias("text"),
    ))
    return out if text else out.drop("text")
