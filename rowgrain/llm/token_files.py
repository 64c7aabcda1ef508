"""Token ids in compressed files: adaptive context mixing and a range coder.

A file is a table of blocks; each block stands alone.  Its model starts anew, and it carries its length and a
checksum.  In a block, the two ids before predict the next one, and so does the one before; how often each was right,
as sure as both are and agreeing or not, is learnt on the way and decides how the two and the frequencies of the block
share the code.  An id that neither predicts is coded by its frequency among such ids, a new one by its length and
bits.  Frequencies and rates of success are refreshed every few steps, in whole numbers or by single roundings, so that
every machine decodes alike.

The ids of a block go in up to ``_SIDE`` consecutive lanes that share its model and its words.  All lanes of ``GROUP``
blocks are coded side by side in numpy by a range coder without carries (rANS): what is coded last is decoded first.
"""

from __future__ import annotations

import functools
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowgrain.llm.tokens import Pieces
from rowgrain.session import checkpoint_folder, cut_lineage

MAGIC = b"RGT2"
#: Ids in a block, and blocks coded side by side.
BLOCK, LANES = 8192, 1024
_HEAD = np.dtype([("magic", "S4"), ("n", "<u4"), ("crc32", "<u4"), ("words", "<u4")])
_DOC = np.dtype([("doc_id", "<i8"), ("ordinal", "<i8"), ("part", "<u4"), ("parts", "<u4"), ("n", "<u4"), ("valid", "u1")])

#: Lanes of a block at most, and blocks whose models are held together (what a processor's cache holds).
_SIDE, GROUP = 16, 128
#: Widths of a choice between the guesses and of an id by frequency; least state of a lane.
_ONE_BITS, _SLOT_BITS = 12, 13
_ONE, _SLOTS, _LOW = 1 << _ONE_BITS, 1 << _SLOT_BITS, 1 << 16
_WIDTH = (1 << 14) - 1
#: Bits of the places of guesses after one id and after two; a guess is its id times eight and how sure it is.
_SIZES = (12, 13)
_SHIFTS = tuple(np.uint32(32 - b) for b in _SIZES)
_HASH1, _HASH2 = np.uint32(0x9E3779B1), np.uint32(0x42B2AE35)
#: Distinct ids of a block with a frequency of their own; new ones are coded by the length of ``id + 1`` and its bits.
_KNOWN, _CLASSES = 4096, 17
_CLASS = np.floor(np.log2(np.arange(1, (1 << 16) + 1))).astype(np.int64)
#: States: how sure the guess after two ids is (of 8), the one after one id, and whether they agree.
_STATES = 128
_S2, _S1, _SAME = (np.arange(_STATES) >> 3) & 7, np.arange(_STATES) & 7, np.arange(_STATES) >> 6 == 1
_MAY2, _MAY1 = _S2 > 0, (_S1 > 0) & ~(_SAME & (_S2 > 0))
#: Rates of success to begin with, and the number of cases they count for.
_PRIOR2 = np.where(_MAY2, _ONE * 4 * (_S2 + 2 * _SAME) // (4 * _S2 + 8 * _SAME + 6), 0)
_PRIOR1 = np.where(_MAY1, (_ONE - _PRIOR2) * _S1 // (2 * _S1 + 3), 0)
_TRUST = 8


class _Model:
    """Predictions of blocks coded side by side, each from what it has seen of its own ids.

    ``steps`` and ``lanes`` of each block; steps do not rise from block to block.
    """

    def __init__(self, steps: np.ndarray, lanes: np.ndarray):
        self.blocks = len(steps)
        self.block = np.repeat(np.arange(self.blocks), lanes)
        # Lanes that still run at each step.
        self.open = np.cumsum(lanes)[np.searchsorted(-steps, -np.arange(int(steps.max(initial=0))), side="left") - 1]
        self.seen = [np.zeros(self.blocks << b, dtype=np.int32) for b in _SIZES]
        self.base = [(self.block << b).astype(np.uint32) for b in _SIZES]
        self.slot = (self.block << _SLOT_BITS).astype(np.int64)
        self.state = self.block * _STATES
        self.outcomes = np.zeros(3 * _STATES * self.blocks, dtype=np.int64)
        self.keys = np.empty(0, dtype=np.int32)
        self.refresh()

    def places(self, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the guesses after the ids ``two, one`` are kept, by ``one`` alone and by both; last axis: lanes."""
        n, hashed = one.shape[-1], one * _HASH1
        both = hashed + two * _HASH2
        return tuple(((h >> s) + b[:n]).astype(np.int64) for h, s, b in zip((hashed, both), _SHIFTS, self.base))

    def learn(self, order: int, at: np.ndarray, entry: np.ndarray, x: np.ndarray) -> None:
        """A guess that came true is surer; one that failed is half as sure or gives way.  ``x``: ids times eight."""
        sure = entry & 7
        failed = np.where(sure <= 1, x | 1, entry - (sure + 1 >> 1))
        self.seen[order][at] = np.where((entry ^ x) < 8, np.minimum(entry + 1, x | 7), failed)  # of lanes at one place the last stays

    def choices(self, at: np.ndarray, e1: np.ndarray, e2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """State of each lane: how sure both guesses are, and whether they are the same; frequencies of the guess after two ids, and of both."""
        state = self.state[at] + ((e2 & 7) << 3 | e1 & 7) + (((e1 ^ e2) < 8) << 6)
        odds = self.odds.take(state)
        return state, odds & 0xFFFF, odds >> 16

    def taken(self, at: np.ndarray, e1: np.ndarray, e2: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """State, what came (0: the guess after two ids, 1: the one after one, 2: neither), and the frequencies."""
        state, f2, both = self.choices(at, e1, e2)
        took = np.where(((e2 ^ x) < 8) & (f2 > 0), 0, np.where(((e1 ^ x) < 8) & (both > f2), 1, 2))
        return state, took, f2, both

    def refresh(self, state: np.ndarray | None = None, took: np.ndarray | None = None, keys: np.ndarray | None = None) -> None:
        """Learn from the steps since the last time: states with what was taken, and ids (below their block) not guessed."""
        if state is not None:
            self.outcomes += np.bincount(3 * state + took, minlength=len(self.outcomes))
            self.keys = np.sort(np.concatenate([self.keys, keys.astype(np.int32)]))
        seen = self.outcomes.reshape(self.blocks, _STATES, 3)
        total = seen.sum(2) + _TRUST
        f2 = np.where(_MAY2, np.clip((seen[:, :, 0] * _ONE + _TRUST * _PRIOR2) // total, 1, _ONE - 2), 0)
        f1 = np.where(_MAY1, np.minimum(np.maximum((seen[:, :, 1] * _ONE + _TRUST * _PRIOR1) // total, 1), _ONE - 1 - f2), 0)
        self.odds = (f2 | (f2 + f1) << 16).ravel()
        # Distinct ids of each block, with their numbers; a block with too many codes the others as new.
        at = np.flatnonzero(np.concatenate([np.ones(min(len(self.keys), 1), dtype=bool), self.keys[1:] != self.keys[:-1]]))
        count, key = np.diff(at, append=len(self.keys)), self.keys[at].astype(np.int64)
        of = key >> 16
        size = np.bincount(of, minlength=self.blocks)
        if size.max(initial=0) > _KNOWN:
            kept = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) < _KNOWN
            of, key, count = of[kept], key[kept], count[kept]
            size = np.minimum(size, _KNOWN)
        # Classes for ids that are new come first, as likely as ids of theirs were new before.
        new = 1 + np.bincount(of * _CLASSES + _CLASS[key & 0xFFFF], minlength=self.blocks * _CLASSES).reshape(self.blocks, _CLASSES)
        ends = np.cumsum(2 * count - 1)
        past = np.concatenate([[0], ends])[np.cumsum(size)]
        before, new = np.concatenate([[0], past[:-1]]), np.cumsum(new, axis=1)
        scale = (_SLOTS - size - _CLASSES) / (past - before + new[:, -1])
        head = (new * scale[:, None]).astype(np.int64) + np.arange(1, _CLASSES + 1)
        head[:, -1] = np.where(size > 0, head[:, -1], _SLOTS)
        first = np.cumsum(size) - size
        ends = ((ends + np.repeat(new[:, -1] - before, size)) * np.repeat(scale, size)).astype(np.int64)
        ends += np.arange(_CLASSES + 1, len(ends) + _CLASSES + 1) - np.repeat(first, size)
        full = np.flatnonzero(size)
        ends[first[full] + size[full] - 1] = _SLOTS
        start = np.empty_like(ends)
        start[1:] = ends[:-1]
        start[first[full]] = head[full, -1]
        starts = np.concatenate([np.zeros((self.blocks, 1), dtype=np.int64), head[:, :-1]], axis=1)
        # Each symbol as number, start and width.
        self.first = np.cumsum(size + _CLASSES) - size - _CLASSES
        self.known, self.key = np.arange(len(key)) + np.repeat(self.first + _CLASSES - first, size), key
        self.symbols = np.empty(len(key) + _CLASSES * self.blocks, dtype=np.int64)
        self.symbols[self.known] = (key & 0xFFFF) + _CLASSES << 28 | start << 14 | ends - start
        self.symbols[self.first[:, None] + np.arange(_CLASSES)] = np.arange(_CLASSES) << 28 | starts << 14 | head - starts

    def slots(self) -> np.ndarray:
        """The symbol at each place of each block."""
        return np.repeat(np.arange(len(self.symbols), dtype=np.int32), self.symbols & _WIDTH)


def _laid(sizes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of blocks by falling steps; steps and lanes of each."""
    n = np.array(sizes, dtype=np.int64)
    lanes = np.minimum(np.maximum(n >> 8, 1), _SIDE) * (n > 0)
    steps = -(-n // np.maximum(lanes, 1))
    order = np.argsort(-steps, kind="stable")
    return order, steps[order], lanes[order]


def _spans(steps: int) -> list[tuple[int, int]]:
    """Steps between two refreshes of a model, which become rarer."""
    if not steps:
        return []
    ends = [4]
    while ends[-1] < steps:
        ends.append(max(ends[-1] + 4, ends[-1] * 5 // 4))
    return list(zip([0, *ends[:-1]], [*ends[:-1], steps]))


def _live(open_: np.ndarray, *rows: np.ndarray) -> list[np.ndarray]:
    """Lane of each id of some steps, and the rows of those steps, without the lanes that are at their end."""
    n = open_[0]
    at = np.tile(np.arange(n), len(open_))
    rows = [r[:, :n].ravel() for r in rows]
    if open_[-1] == n:
        return [at, *rows]
    live = at < np.repeat(open_, n)
    return [at[live], *[r[live] for r in rows]]


def _encoded(blocks: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each block the last states of its lanes, and their words in the order in which they are read."""
    order, steps, lanes = _laid([len(b) for b in blocks])
    model = _Model(steps, lanes)
    n, longest = len(model.block), int(steps.max(initial=0))
    ids = np.zeros((longest + 2, n), dtype=np.uint32)  # two steps of zeros first
    lane = 0
    for i, t, s in zip(order, steps, lanes):
        flat = np.zeros(t * s, dtype=np.uint32)  # the last lane is filled up with zeros
        flat[: len(blocks[i])] = blocks[i]
        ids[2:t + 2, lane:lane + s] = flat.reshape(s, t).T
        lane += s
    symbol = np.zeros(model.blocks << 16, dtype=np.int32)  # of each id in its block; 0: not known
    todo = []
    for lo, hi in _spans(longest):
        one, two = model.places(ids[lo + 1:hi + 1], ids[lo:hi])
        x8 = (ids[lo + 2:hi + 2] << 3).astype(np.int32)
        e1, e2 = np.zeros((2, hi - lo, n), dtype=np.int32)
        for t in range(hi - lo):
            k = model.open[lo + t]
            e1[t, :k] = a = model.seen[0].take(one[t, :k])
            e2[t, :k] = b = model.seen[1].take(two[t, :k])
            model.learn(0, one[t, :k], a, x8[t, :k])
            model.learn(1, two[t, :k], b, x8[t, :k])
        at, e1, e2, x8 = _live(model.open[lo:hi], e1, e2, x8)
        ends = np.cumsum(model.open[lo:hi])
        sure = np.flatnonzero((e1 | e2) & 7)
        a, b, x = e1[sure], e2[sure], x8[sure]
        state, took, f2, both = model.taken(at[sure], a, b, x)
        start = np.where(took == 0, 0, np.where(took == 1, f2, both))
        width = np.where(took == 0, f2, np.where(took == 1, both, _ONE)) - start
        new = np.ones(len(at), dtype=bool)
        new[sure] = took == 2
        new = np.flatnonzero(new)
        who = at[new]
        block, x = model.block[who], x8[new].astype(np.int64) >> 3
        keys = block << 16 | x
        symbol[model.key] = model.known
        found = symbol.take(keys)
        bits = np.where(found == 0, _CLASS[x], 0)
        found = model.symbols.take(np.where(found == 0, model.first[block] + bits, found))
        todo.append((at[sure], start.astype(float), width.astype(float), np.searchsorted(sure, ends),
                     who, (found >> 14 & _WIDTH).astype(float), (found & _WIDTH).astype(float), np.searchsorted(new, ends), bits, (x + 1 - (1 << bits)).astype(float)))
        if hi < longest:
            model.refresh(state, took, keys)
    state, words, owners = np.full(n, float(_LOW)), [], []

    def push(x: np.ndarray, block: np.ndarray, start: np.ndarray, width: np.ndarray, scale: np.ndarray | float) -> np.ndarray:
        """States with one more symbol; all are whole numbers below 2**53."""
        full = np.flatnonzero(x >= width * (65536.0 * _LOW / scale))
        if full.size:
            high = np.floor(x[full] / 65536)
            words.append((x[full] - high * 65536).astype("<u2"))
            owners.append(block[full])
            x[full] = high
        return x + np.floor(x / width) * (scale - width) + start

    owner = model.block.astype(np.uint16)
    while todo:
        sure, start, width, ends, who, start0, width0, ends0, bits, rest = todo.pop()
        for t in range(len(ends) - 1, -1, -1):
            a, b = ends0[t - 1] if t else 0, ends0[t]
            if b > a:
                some = who[a:b]
                x, mine = state[some], owner[some]
                raw = np.flatnonzero(bits[a:b])
                if raw.size:
                    x[raw] = push(x[raw], mine[raw], rest[a:b][raw], np.ones(len(raw)), (1 << bits[a:b][raw]).astype(float))
                state[some] = push(x, mine, start0[a:b], width0[a:b], float(_SLOTS))
            a, b = ends[t - 1] if t else 0, ends[t]
            if b > a:
                some = sure[a:b]
                state[some] = push(state[some], owner[some], start[a:b], width[a:b], float(_ONE))
    # The last that was written is read first; what one step wrote, by lane.
    owners, words = (np.concatenate([np.empty(0, np.uint16), *x[::-1]]) for x in (owners, words))
    words = words[np.argsort(owners, kind="stable")].astype("<u2")
    ends = np.cumsum(np.bincount(owners, minlength=model.blocks))
    made: list = [None] * len(blocks)
    lane = 0
    for k, (i, s) in enumerate(zip(order, lanes)):
        made[i] = state[lane:lane + s].astype("<u4"), words[ends[k - 1] if k else 0:ends[k]]
        lane += s
    return made


def _decoded(blocks: list[tuple[int, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Ids from their number and what :func:`_encoded` gives."""
    order, steps, lanes = _laid([b[0] for b in blocks])
    model = _Model(steps, lanes)
    n, longest = len(model.block), int(steps.max(initial=0))
    state = np.concatenate([np.empty(0, "<u4"), *[blocks[i][1] for i in order]]).astype(np.int64)
    stream = np.concatenate([*[blocks[i][2] for i in order], np.zeros(1, "<u2")]).astype(np.int64)
    used = np.cumsum([0, *[len(blocks[i][2]) for i in order]])[:-1].astype(np.int64)
    ids = np.zeros((longest + 2, n), dtype=np.uint32)

    def pull(x: np.ndarray, block: np.ndarray) -> None:
        low = np.flatnonzero(x < _LOW)
        if low.size:
            who = block[low]
            number = np.bincount(who, minlength=model.blocks)
            place = np.arange(len(low)) + (used - np.cumsum(number) + number)[who]
            used[:] += number
            x[low] = x[low] << 16 | stream.take(place, mode="clip")

    for lo, hi in _spans(longest):
        e1, e2 = np.zeros((2, hi - lo, n), dtype=np.int32)
        slots = model.slots()
        for t in range(hi - lo):
            k = model.open[lo + t]
            one, two = model.places(ids[lo + t + 1, :k], ids[lo + t, :k])
            e1[t, :k] = a = model.seen[0].take(one)
            e2[t, :k] = b = model.seen[1].take(two)
            got, new = np.empty(k, dtype=np.int64), np.ones(k, dtype=bool)
            sure = np.flatnonzero((a | b) & 7)
            if sure.size:
                g1, g2 = a[sure], b[sure]
                _, f2, both = model.choices(sure, g1, g2)
                x = state[sure]
                slot = x & _ONE - 1
                hit2, none = slot < f2, slot >= both
                start = np.where(hit2, 0, np.where(none, both, f2))
                x = (np.where(hit2, f2, np.where(none, _ONE, both)) - start) * (x >> _ONE_BITS) + slot - start
                pull(x, model.block[sure])
                state[sure], got[sure], new[sure] = x, np.where(hit2, g2, g1) >> 3, none
            who = np.flatnonzero(new)
            if who.size:
                y, mine = state[who], model.block[who]
                slot = y & _SLOTS - 1
                s = model.symbols.take(slots.take(model.slot[who] + slot))
                y = (s & _WIDTH) * (y >> _SLOT_BITS) + slot - (s >> 14 & _WIDTH)
                pull(y, mine)
                value = (s >> 28) - _CLASSES
                raw = np.flatnonzero(value < 0)
                if raw.size:
                    bits, z = value[raw] + _CLASSES, y[raw]
                    value[raw] = (1 << bits) - 1 + (z & (1 << bits) - 1) & 0xFFFF
                    z >>= bits
                    pull(z, mine[raw])
                    y[raw] = z
                got[who], state[who] = value, y
            ids[lo + t + 2, :k] = got
            x8 = (got << 3).astype(np.int32)
            model.learn(0, one, a, x8)
            model.learn(1, two, b, x8)
        if hi < longest:
            at, e1, e2, x = _live(model.open[lo:hi], e1, e2, ids[lo + 2:hi + 2].astype(np.int64))
            sure = np.flatnonzero((e1 | e2) & 7)
            new = np.ones(len(at), dtype=bool)
            states, took = model.taken(at[sure], e1[sure], e2[sure], (x[sure] << 3).astype(np.int32))[:2]
            new[sure] = took == 2
            model.refresh(states, took, model.block[at[new]] << 16 | x[new])
    if (state != _LOW).any():  # each lane ends where its coder began
        raise ValueError("a block of token ids is damaged")
    made: list = [None] * len(blocks)
    lane = 0
    for i, t, s in zip(order, steps, lanes):
        made[i] = ids[2:t + 2, lane:lane + s].T.ravel()[: blocks[i][0]].astype("<u4")
        lane += s
    return made


def encode(blocks: list[np.ndarray]) -> list[bytes]:
    """Each block of ids below 65,536 as bytes."""
    if any(len(b) and int(b.max()) > 0xFFFF for b in blocks):
        raise ValueError("ids must be below 65,536")
    made: list = [b""] * len(blocks)
    by_size = sorted(range(len(blocks)), key=lambda i: len(blocks[i]))
    for lo in range(0, len(blocks), GROUP):
        some = by_size[lo:lo + GROUP]
        for i, (state, words) in zip(some, _encoded([blocks[i] for i in some])):
            head = np.array([(MAGIC, len(blocks[i]), zlib.crc32(blocks[i].astype("<u4").tobytes()), len(words))], dtype=_HEAD)
            made[i] = head.tobytes() + state.tobytes() + words.tobytes()
    return made


def decode(blocks: list[bytes]) -> list[np.ndarray]:
    """The ids of each block, after a look at its checksum."""
    parts, heads = [], []
    for b in blocks:
        head = np.frombuffer(b, dtype=_HEAD, count=1)[0]
        if head["magic"] != MAGIC:
            raise ValueError("not a block of token ids")
        n, words = int(head["n"]), int(head["words"])
        lanes = int(_laid([n])[2][0])
        if len(b) != _HEAD.itemsize + 4 * lanes + 2 * words:
            raise ValueError("a block of token ids is damaged")
        heads.append(head)
        parts.append((n, np.frombuffer(b, "<u4", lanes, _HEAD.itemsize), np.frombuffer(b, "<u2", words, _HEAD.itemsize + 4 * lanes)))
    made: list = [np.empty(0, dtype="<u4")] * len(blocks)
    by_size = sorted(range(len(parts)), key=lambda i: parts[i][0])
    for lo in range(0, len(parts), GROUP):
        some = by_size[lo:lo + GROUP]
        for i, ids in zip(some, _decoded([parts[i] for i in some])):
            if zlib.crc32(ids.tobytes()) != int(heads[i]["crc32"]):
                raise ValueError("a block of token ids is damaged")
            made[i] = ids
    return made


def write(docs: DataFrame, tokenizer: str, path: str, end: int, block: int = BLOCK, lanes: int = LANES) -> None:
    """Encode ``docs (doc_id, text)`` and write blocks in ascending ``doc_id`` order (NULL first, ties by text).

    A document's ids are those of its text (NULL: none) and ``end``.  Documents longer than a block go over several;
    others are kept whole.  ``path`` is a folder that all executors reach.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = [F.col("doc_id").asc_nulls_first()]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dealt = rows.repartitionByRange(parts, *key).sortWithinPartitions(*key, "text")

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib, shard = Pieces(tokenizer), TaskContext.get().partitionId()
        stop = np.array([end], dtype="<u4")
        ids: list[list[np.ndarray]] = [[]]
        index: list[list[tuple]] = [[]]
        held = done = ordinal = 0

        def coded() -> pa.RecordBatch:
            nonlocal ids, index, held, done
            n = [sum(map(len, b)) for b in ids]
            data = encode([np.concatenate(b) for b in ids])
            out = pa.RecordBatch.from_arrays(
                [pa.array([shard] * len(ids), pa.int32()), pa.array(range(done, done + len(ids)), pa.int64()), pa.array(n, pa.int64()),
                 pa.array([np.array(d, dtype=_DOC).tobytes() for d in index], pa.binary()), pa.array(data, pa.binary())],
                names=["shard", "block", "n_ids", "docs", "data"],
            )
            done, held, ids, index = done + len(ids), 0, [[]], [[]]
            return out

        for b in batches:
            for d, x in zip(b["doc_id"].to_pylist(), lib.ids(b["text"].to_pylist())):
                x = np.concatenate([x, stop])
                cut = [x[s:s + block] for s in range(0, len(x), block)]
                for k, piece in enumerate(cut):
                    if held and held + len(piece) > block:
                        if len(ids) == lanes:
                            yield coded()
                        else:
                            ids.append([])
                            index.append([])
                            held = 0
                    ids[-1].append(piece)
                    index[-1].append((d or 0, ordinal, k, len(cut), len(piece), d is not None))
                    held += len(piece)
                ordinal += 1
        if held:
            yield coded()

    dealt.mapInArrow(work, "shard int, block long, n_ids long, docs binary, data binary").write.parquet(path)


def _times(m: list[int], v: int) -> int:
    out = 0
    for bit, row in enumerate(m):
        if v >> bit & 1:
            out ^= row
    return out


@functools.cache
def _zero_bytes(power: int) -> list[int]:
    """What ``2 ** power`` zero bytes make of a checksum, by repeated squaring."""
    if power == -3:
        return [0xEDB88320] + [1 << i for i in range(31)]  # one zero bit
    half = _zero_bytes(power - 1)
    return [_times(half, row) for row in half]


def crc32_joined(a: int, b: int, n: int) -> int:
    """Checksum of two strings one after the other, from theirs and the length of the second.

    ``n`` zero bytes after the first are a linear map of its checksum.
    """
    for power in range(n.bit_length()):
        if n >> power & 1:
            a = _times(_zero_bytes(power), a)
    return a ^ b


def read(spark: SparkSession, path: str, lanes: int = LANES) -> DataFrame:
    """``(shard, ordinal, doc_id, part, parts, n, ids binary)`` for every piece of a document, decoded and checked."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, lanes):
                some = b.slice(lo, lanes)
                index = [np.frombuffer(d, dtype=_DOC) for d in some["docs"].to_pylist()]
                ids = decode(some["data"].to_pylist())
                doc = np.concatenate(index)
                shard = np.repeat(some["shard"].to_numpy(), [len(d) for d in index])
                raw = pa.py_buffer(np.concatenate(ids).tobytes())
                ends = np.concatenate([[0], np.cumsum(doc["n"].astype(np.int64))]) * 4
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard), pa.array(doc["ordinal"].astype(np.int64)), pa.array(doc["doc_id"].astype(np.int64), mask=doc["valid"] == 0),
                     pa.array(doc["part"].astype(np.int32)), pa.array(doc["parts"].astype(np.int32)), pa.array(doc["n"].astype(np.int64)),
                     pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(ends.astype(np.int32)), raw])],
                    names=["shard", "ordinal", "doc_id", "part", "parts", "n", "ids"],
                )

    blocks = spark.read.parquet(path).select("shard", "docs", "data")
    return blocks.mapInArrow(work, "shard int, ordinal long, doc_id long, part int, parts int, n long, ids binary")


def digests(pieces: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` from the pieces that :func:`read` gives, which are decoded once."""
    own = cut_lineage(pieces.withColumn("crc", F.crc32("ids")).drop("ids"))
    whole = own.filter("parts = 1").select("shard", "ordinal", "doc_id", "n", "crc")

    def joined(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part")
        crc = 0
        for c, n in zip(rows["crc"], rows["n"]):
            crc = crc32_joined(crc, int(c), int(n) * 4)
        first = rows.iloc[:1][["shard", "ordinal", "doc_id"]]
        return first.assign(n=rows["n"].sum(), crc=crc)

    cut = own.filter("parts > 1").groupBy("shard", "ordinal").applyInPandas(joined, "shard int, ordinal long, doc_id long, n long, crc long")
    docs = whole.unionByName(cut)
    # A shard has a bounded number of documents, and there is one row per shard.
    shards = docs.groupBy("shard").agg(F.sum("n").alias("size"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = shards.select("shard", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    return docs.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(starts, "shard").select(
        "doc_id", (F.col("first") + F.col("inside")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32")
    )


def written_and_read(docs: DataFrame, tokenizer: str, end: int) -> DataFrame:
    """Write ``docs`` to a new folder among the shared ones, read it back, and return :func:`digests`.

    Repeated rows and NULL numbers are documents like any other.  Other columns are ignored; an empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    path = f"{checkpoint_folder(spark)}/token-ids-{uuid.uuid4().hex}"
    write(docs, tokenizer, path, end)
    return digests(read(spark, path))
