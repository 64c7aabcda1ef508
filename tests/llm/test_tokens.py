"""Token ids, files, counts and packing against the tokenizers library."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from helpers import awkward, documents, nothing, rows_of
from rowgrain.llm import packing, token_counts, token_files, tokens

FILES = {k: public_tokenizers.path(k) for k in ("byte_bpe_50k.json", "word_bpe_49k.json")}


def library(name, texts):
    lib = Tokenizer.from_file(FILES[name])
    return [np.array(e.ids, dtype="<u4") for e in lib.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("name", FILES)
def test_ids_and_counts_are_the_librarys(name):
    draw = random.Random(1)
    letters = list("aAbZé ÉßÞµª²½9 \n\t\r'st're.,!?<|>ñ日Σİ\x1c\xa0\x85 ' ") + ["<|endoftext|>", "<|startoftext|>", "'ll", " \n", "  "]
    texts = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 25))) for _ in range(4000)] + [None, ""]
    pieces, want = tokens.Pieces(FILES[name]), library(name, texts)
    assert all(np.array_equal(a, b) for a, b in zip(pieces.ids(texts), want))
    assert [sum(pieces.counts(pieces.pretokens(t or ""))) for t in texts] == [len(w) for w in want]


def test_a_full_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 3)
    texts = ["one two three four five six seven, eight"] * 2
    assert all(np.array_equal(a, b) for a, b in zip(tokens.Pieces(FILES["word_bpe_49k.json"]).ids(texts), library("word_bpe_49k.json", texts)))


def test_blocks_round_trip():
    draw = np.random.default_rng(3)
    blocks = [np.empty(0, dtype="<u4"), np.array([65535], dtype="<u4"), np.zeros(3000, dtype="<u4"), draw.integers(0, 65536, 700).astype("<u4")]
    blocks += [np.minimum(draw.zipf(1.3, n), 50000).astype("<u4") for n in (1, 17, 1000, 1000)]
    coded = token_files.encode(blocks)
    assert all(np.array_equal(a, b) for a, b in zip(blocks, token_files.decode(coded)))
    assert token_files.encode([blocks[6]])[0] == coded[6], "a block stands alone"
    assert len(coded[2]) < 150 and len(token_files.encode([])) == len(token_files.decode([])) == 0
    broken = bytearray(coded[6])
    broken[40] ^= 4
    with pytest.raises(ValueError, match="damaged"):
        token_files.decode([bytes(broken)])
    with pytest.raises(ValueError, match="not a block"):
        token_files.decode([b"x" * 40])


def test_context_lowers_the_size():
    ids = np.tile(np.random.default_rng(1).integers(0, 50000, 300), 10).astype("<u4")
    assert len(token_files.encode([ids])[0]) < len(ids) * 2 / 3


def test_lanes_share_a_block(monkeypatch):
    """A block takes a sixteenth of its ids in steps: its lanes go side by side, and so do its neighbours."""
    plain, calls = token_files._Model.learn, []
    monkeypatch.setattr(token_files._Model, "learn", lambda self, *rest: calls.append(1) or plain(self, *rest))
    draw = np.random.default_rng(5)
    blocks = [np.minimum(draw.zipf(1.2, n), 60000).astype("<u4") for n in (8192, 8000, 300, 1)]
    coded = token_files.encode(blocks)
    assert len(calls) == 2 * 512
    assert all(np.array_equal(a, b) for a, b in zip(blocks, token_files.decode(coded))) and len(calls) == 4 * 512


def test_odd_blocks():
    draw = np.random.default_rng(8)
    blocks = [draw.permutation(65536)[:20000].astype("<u4"), np.arange(255, 700, dtype="<u4"), np.full(257, 65535, dtype="<u4")]
    blocks += [np.tile(draw.integers(0, 9, 40), k).astype("<u4") for k in range(1, 30)]
    assert all(np.array_equal(a, b) for a, b in zip(blocks, token_files.decode(token_files.encode(blocks))))
    assert [len(b) for b in token_files.decode(token_files.encode([np.empty(0, dtype="<u4")]))] == [0]
    with pytest.raises(ValueError, match="below 65,536"):
        token_files.encode([np.array([65536], dtype="<u4")])
    coded = token_files.encode(blocks[:3])
    for k in range(16, len(coded[1]), 7):
        broken = bytearray(coded[1])
        broken[k] ^= 1 << k % 8
        with pytest.raises(ValueError, match="damaged"):
            token_files.decode([coded[0], bytes(broken)])
    with pytest.raises(ValueError, match="damaged"):
        token_files.decode([coded[1][:-2]])


def test_stretches_are_looked_up_together(monkeypatch):
    """Only the first stretch of a text, and those that end in white space, are cut by themselves; small batches change nothing."""
    draw = random.Random(2)
    words = ["one", "two,", "x\ny", "\nz", "end\n", "\t", "Émile's", "7up", "...", "a\r\n"]
    texts = [" ".join(draw.choice(words) for _ in range(draw.randint(0, 40))) for _ in range(300)] + ["", " ", " a", "a ", "\n a"]
    plain, calls = tokens.Pieces._chunk, []
    monkeypatch.setattr(tokens.Pieces, "_chunk", lambda self, chunk: calls.append(chunk) or plain(self, chunk))
    want = library("byte_bpe_50k.json", texts)
    assert all(np.array_equal(a, b) for a, b in zip(tokens.Pieces(FILES["byte_bpe_50k.json"]).ids(texts), want))
    assert len(calls) <= len(texts) + 5
    monkeypatch.setattr(tokens, "TOGETHER", 100)
    monkeypatch.setattr(tokens, "CACHE", 5)
    assert all(np.array_equal(a, b) for a, b in zip(tokens.Pieces(FILES["byte_bpe_50k.json"]).ids(texts), want))


def test_joined_checksums():
    a, b = b"some bytes", b"and others" * 9
    for x, y in ((a, b), (b, a), (a, b""), (b"", b)):
        assert token_files.crc32_joined(zlib.crc32(x), zlib.crc32(y), len(y)) == zlib.crc32(x + y)


def digests(texts, name="byte_bpe_50k.json", end=2):
    start, out = 0, []
    for ids in library(name, texts):
        ids = np.append(ids, end).astype("<u4")
        out.append((start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_files_of_documents(spark):
    docs = documents(spark)
    got = rows_of(token_files.written_and_read(docs, FILES["byte_bpe_50k.json"], end=2))
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    assert [(got[i].start, got[i].n_tokens, got[i].ids_crc32) for i, _ in rows] == digests([t for _, t in rows])


def test_pieces_are_decoded_once(spark, tmp_path):
    """Starts and digests both need every piece; the files are read and decoded once for them."""
    seen = spark.sparkContext.accumulator(0)
    token_files.write(documents(spark), FILES["byte_bpe_50k.json"], f"{tmp_path}/ids", end=2, block=512)
    pieces = token_files.read(spark, f"{tmp_path}/ids")

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    n = pieces.count()
    assert token_files.digests(pieces.mapInArrow(counted, pieces.schema)).count() == documents(spark).count()
    assert seen.value == n


def test_files_of_awkward_rows(spark):
    df = awkward(spark)
    got = token_files.written_and_read(df, FILES["byte_bpe_50k.json"], end=2).collect()
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or "") for r in df.collect()))
    want = sorted((i if known else None or -1, *d) for (known, i, _, _), d in zip(rows, digests([r[3] for r in rows])))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.start, r.n_tokens, r.ids_crc32) for r in got) == sorted(
        (i if known else -1, *d) for (known, i, _, _), d in zip(rows, digests([r[3] for r in rows])))
    assert len(want) == len(got)
    assert token_files.written_and_read(nothing(spark), FILES["byte_bpe_50k.json"], end=2).count() == 0


def test_counts(spark):
    for df in (documents(spark), awkward(spark)):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        want = sorted((i if i is not None else -1, len((t or "").encode()), len(x), len(x) > 100) for (i, t), x in zip(rows, library("word_bpe_49k.json", [t for _, t in rows])))
        got = token_counts.token_counts(df, FILES["word_bpe_49k.json"], limit=100).collect()
        assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want
    assert token_counts.token_counts(nothing(spark), FILES["word_bpe_49k.json"]).count() == 0


def test_small_flushes_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "PAIRS", 50)
    df = documents(spark).limit(20)
    want = {r.doc_id: len(x) for r, x in zip(df.collect(), library("word_bpe_49k.json", [r.text for r in df.collect()]))}
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(df, FILES["word_bpe_49k.json"]).collect()} == want


def fits(rows, cap):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for sequence in by.values():
        at = 0
        for r in sorted(sequence, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= cap.tokens
        assert cap.documents is None or len(sequence) <= cap.documents
        assert cap.attention is None or sum(r.length**2 for r in sequence) <= cap.attention
    return len(by)


@pytest.mark.parametrize("cap", [packing.Capacity(256), packing.Capacity(256, rule="dot"), packing.Capacity(256, documents=2, attention=256**2)])
def test_packing(spark, cap):
    for df in (documents(spark), awkward(spark)):
        got = packing.pack_documents(df, FILES["word_bpe_49k.json"], cap).collect()
        n = fits(got, cap)
        rows = df.collect()
        want = []
        for r, ids in zip(rows, library("word_bpe_49k.json", [r.text for r in rows])):
            ids = np.append(ids, 0).astype("<u4")
            want += [(r.doc_id if r.doc_id is not None else -1, s // 256, s, len(ids[s:s + 256]), zlib.crc32(ids[s:s + 256].tobytes())) for s in range(0, len(ids), 256)]
        assert sorted((r.doc_id if r.doc_id is not None else -1, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
        if cap.documents is None:
            assert n <= 1.03 * sum(w[3] for w in want) / 256 + 8
    assert packing.pack_documents(nothing(spark), FILES["word_bpe_49k.json"], cap).count() == 0


def test_best_fit_against_the_best_possible():
    draw = np.random.default_rng(6)
    for rule in ("dot", "norm"):
        whole = np.concatenate([draw.multinomial(100 - 4, [0.25] * 4) + 1 for _ in range(60)])  # sixty full sequences
        bins, offset = packing.best_fit(whole, packing.Capacity(100, rule=rule))
        assert bins.max() + 1 <= 62
        assert np.bincount(bins, whole).max() <= 100
    with pytest.raises(ValueError):
        packing.Capacity(10, attention=50)
    with pytest.raises(ValueError):
        packing.Capacity(10, rule="worst")


def test_refined_packing_over_many_draws():
    for seed in range(30):
        draw = np.random.default_rng(seed)
        whole = np.concatenate([draw.multinomial(100 - 4, [0.25] * 4) + 1 for _ in range(60)])
        for rule in ("dot", "norm"):
            cap = packing.Capacity(100, rule=rule)
            bins, offset = packing.best_fit(whole, cap)
            assert bins.max() + 1 <= 62
            for b in range(bins.max() + 1):
                own = np.flatnonzero(bins == b)
                own = own[np.argsort(offset[own])]
                assert len(own) and whole[own].sum() <= 100
                assert (offset[own] == np.append(0, np.cumsum(whole[own])[:-1])).all()


def test_capacities_that_bind():
    lengths = np.array([60, 50, 40, 30, 20, 10] * 10)
    for cap in (packing.Capacity(100, documents=2), packing.Capacity(100, attention=3000, alone=True), packing.Capacity(100, 3, 2600, rule="dot", alone=True)):
        bins, offset = packing.best_fit(lengths, cap)
        limit = cap.limits()
        for b in range(bins.max() + 1):
            own = lengths[bins == b]
            assert own.sum() <= limit[0] and len(own) <= limit[1]
            # A piece whose cost alone is beyond the limit has no company.
            assert (own**2).sum() <= limit[2] or len(own) == 1
    assert packing.best_fit(lengths, packing.Capacity(100, documents=2))[0].max() + 1 >= 30


def test_sequences_do_not_depend_on_the_partitions_of_the_scan(spark):
    draw = np.random.default_rng(4)
    rows = [(i, " ".join(["word"] * int(n))) for i, n in enumerate(draw.integers(20, 200, 600))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    path = public_tokenizers.path("word_bpe_49k.json")
    used = [packing.pack_documents(docs.repartition(n), path).select("sequence_id").distinct().count() for n in (1, 60)]
    assert abs(used[0] - used[1]) <= 1
