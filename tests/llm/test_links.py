"""Links, components, SimHash and embeddings against comparison of all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from helpers import awkward, components, documents, nothing, rows_of
from rowgrain.llm import links, simhash, vectors


def plain_fingerprint(text, words, seed=42):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [found[i:i + words] for i in range(max(len(found) - words + 1, 1))] if found else []
    h = [xxhash.xxh64_intdigest(" ".join(s).encode(), seed) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def expected(docs, distance):
    ids = sorted(docs)
    fp = [plain_fingerprint(docs[i], 4) for i in ids]
    pairs = [(a, b) for a in range(len(ids)) for b in range(a) if (fp[a] ^ fp[b]).bit_count() <= distance]
    return {i: (f"{f:016x}", ids[c]) for i, f, c in zip(ids, fp, components(len(ids), pairs))}


def test_simhash_equals_all_pairs(spark):
    docs = documents(spark)
    got = simhash.near_duplicates(docs, simhash.SimHash(words=4)).collect()
    want = expected({r.doc_id: r.text for r in docs.collect()}, 4)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == want


@pytest.mark.parametrize("distance", [1, 2, 4])
def test_complete_keys_miss_no_pair(distance):
    draw = random.Random(distance)
    how = simhash.SimHash(distance=distance)
    at = simhash.keys(how)
    compare = simhash.within(how)
    for _ in range(400):
        a = draw.getrandbits(64)
        b = a
        for bit in draw.sample(range(64), draw.randint(0, distance + 1)):
            b ^= 1 << bit
        x = np.array([list(v.to_bytes(8, "big")) for v in (a, b)], dtype=np.uint8)
        bits = np.unpackbits(x, axis=1)
        near = (a ^ b).bit_count() <= distance
        assert compare(x, np.array([0]), np.array([1]), np.array([0]))[0] == near
        assert not near or any((bits[0, p] == bits[1, p]).all() for p in at)


def test_rows_of_one_number_go_by_their_own_text(spark):
    a, b = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    docs = spark.createDataFrame([(1, a, 0), (2, a, 1), (2, b, 2), (3, b, 3), (None, a, 4), (4, None, 5), (5, "", 6)], "doc_id long, text string, _doc int")
    for how in (simhash.SimHash(words=4), simhash.SimHash.for_similarity(7)):
        kept = simhash.keep_first(docs, how)
        assert kept.columns == docs.columns and sorted(r._doc for r in kept.collect()) == [0, 2, 4, 5]


def test_large_buckets_come_in_blocks(spark):
    draw = random.Random(3)
    center = draw.getrandbits(64)
    values = sorted({center ^ sum(1 << b for b in draw.sample(range(64), draw.randint(0, 3))) for _ in range(150)})
    rows = [(0, 7, i, 1, bytearray(v.to_bytes(8, "big"))) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "table int, key long, id long, copies long, data binary")
    pairs = [(a, b) for a in range(len(values)) for b in range(a) if (values[a] ^ values[b]).bit_count() <= 4]
    want = components(len(values), pairs)
    degree = [sum(i in p for p in pairs) for i in range(len(values))]
    for block in (1000, 20, 7):
        found = links.linked_in_buckets(df, simhash.within(simhash.SimHash()), block).cache()
        comp = {r.node: r.component for r in links.components(found.select("a", "b")).collect()}
        assert [comp.get(i, i) for i in range(len(values))] == want
        assert {r.a: r.n for r in found.groupBy("a").sum("links").toDF("a", "n").collect()} == {i: d for i, d in enumerate(degree) if d}


def test_components_of_paths_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 180)] + [(200, 201), (201, 202), (202, 200), (5, 5)]
    draw = random.Random(2)
    edges = [e if draw.random() < 0.5 else e[::-1] for e in edges]
    draw.shuffle(edges)
    got = {r.node: r.component for r in links.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 180)}, **{i: 200 for i in range(200, 203)}}
    assert got == want
    assert links.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_of_awkward_rows(spark):
    got = simhash.near_duplicates(awkward(spark), simhash.SimHash(words=4)).collect()
    assert len(got) == awkward(spark).count()
    zero = [r for r in got if r.fingerprint == "0" * 16]
    assert {r.doc_id for r in zero} == {0, 1, 2, 3, None} and {r.component_id for r in zero} == {0}
    assert {r.component_id for r in got if r.doc_id in (6, 7)} == {6}
    assert simhash.near_duplicates(nothing(spark)).count() == 0


def test_similar_documents_are_found_and_one_stays(spark):
    draw = random.Random(8)
    made, names = [], []
    for g in range(30):
        words = [f"w{draw.randint(0, 5000)}" for _ in range(300)]
        made.append(" ".join(words))
        names.append(g)
        for _ in range(2):  # three words changed: similarity about 0.9
            copy = list(words)
            for i in draw.sample(range(300), 3):
                copy[i] = "changed"
            made.append(" ".join(copy))
            names.append(g)
    docs = spark.createDataFrame([(i, t, n, "extra") for i, (t, n) in enumerate(zip(made, names))], "doc_id long, text string, g int, component string")
    how = simhash.SimHash.for_similarity(len(made))
    kept = simhash.keep_first(docs, how)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 90, 3))
    assert simhash.keep_first(awkward(spark), how).count() > 0 and simhash.keep_first(nothing(spark), how).count() == 0


def test_the_similarity_decides_on_both_sides(spark):
    draw = random.Random(12)
    made, link = [], []
    for g in range(60):  # 80 of 100 shingles shared, or of 101
        for more in (20, 21):
            words = [f"w{draw.getrandbits(40)}" for _ in range(84 + more)]
            made += [" ".join(words[:84]), " ".join(words)]
            link.append(more == 20)
    own = [" ".join(f"{c}{draw.getrandbits(40)}" for _ in range(20)) for c in "ab"]
    made += [f"{'x ' * 500}{own[0]}", f"{'x ' * 500}{own[1]}"]  # one fingerprint with repeats, other sets
    link.append(False)
    lines = [" ".join(f"w{draw.getrandbits(40)}" for _ in range(30)) for _ in range(4)]
    made += [" ".join(lines), " ".join([lines[0]] * 40 + lines[1:])]  # one line repeated
    link.append(True)
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    got = rows_of(simhash.near_duplicates(docs, simhash.SimHash.for_similarity(len(made))))
    assert [got[2 * g + 1].component_id == 2 * g for g in range(len(link))] == link


def test_exact_links_of_a_chained_group_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SETS", 7)
    draw = random.Random(4)
    base = [f"w{draw.getrandbits(40)}" for _ in range(150)]
    made = []
    for _ in range(60):
        words = list(base)
        at, n = draw.randint(0, 150 - 40), draw.randint(1, 40)
        words[at:at + n] = [f"w{draw.getrandbits(40)}" for _ in range(n)]
        made.append(" ".join(words))
    sets = [set(simhash.shingle_set(t, simhash.SimHash()).tolist()) for t in made]
    pairs = [(a, b) for a in range(60) for b in range(a) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    want = components(60, pairs)
    assert 2 < len(set(want)) < 58
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    nodes = docs.selectExpr("0L as component", "doc_id as id", "doc_id as k", "xxhash64(text) as text_hash")
    edges = simhash.exact_links(docs, nodes, simhash.SimHash(similarity=0.8)).collect()
    assert components(60, [(r.a, r.b) for r in edges]) == want


def test_vectors_equal_all_pairs(spark):
    draw = np.random.default_rng(4)
    x = draw.normal(size=(400, 16))
    x[100:160] = x[0] + draw.normal(scale=0.05, size=(60, 16))  # a dense group
    x[160:200] = x[1]  # copies
    x[200:260] = x[np.arange(2, 62)] + draw.normal(scale=0.25, size=(60, 16))  # around the threshold
    rows = [(int(i), v.tolist(), 1) for i, v in enumerate(x)]
    rows += [(400, None, 0), (401, [0.0] * 16, 0), (402, [float("nan")] + [1.0] * 15, 0), (403, [None] + [1.0] * 15, 0), (404, [float("inf")] + [1.0] * 15, 0), (405, [], 0)]
    rows += [(406, (x[1] * 3).tolist(), 0), (407, [1.0], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component int")
    got = {r.vec_id: r for r in vectors.near_duplicates(df, recall=0.99999).collect()}
    usable = list(range(400)) + [406]
    v = np.array([rows[i][1] for i in usable])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    near = v @ v.T >= 0.9
    np.fill_diagonal(near, False)
    want = components(len(usable), np.argwhere(near).tolist())
    for k, i in enumerate(usable):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (near[k].sum(), usable[want[k]], usable[want[k]] == i)
    for i in (400, 401, 402, 403, 404, 405, 407):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_vectors_of_any_scale_and_length(spark):
    pairs = [[1e200, 0.0], [1e200, 1e190], [1e-200, 0.0], [2e-200, 0.0], [0.0, 5e-324], [0.0, -1e308], [1.0, 0.0, 0.0], [1.0, 0.1, 0.0], [1.0]]
    df = spark.createDataFrame(list(enumerate(pairs)), "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(df, recall=0.99999).collect()}
    assert got == {0: (3, 0), 1: (3, 0), 2: (3, 0), 3: (3, 0), 4: (0, 4), 5: (0, 5), 6: (1, 6), 7: (1, 6), 8: (0, 8)}


def test_repeated_and_unnamed_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.01]), (None, [1.0, 0.0])], "vec_id long, embedding array<double>")
    got = vectors.near_duplicates(df).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id) for r in got) == [(0, 0, None), (1, 2, 1), (1, 2, 1), (2, 2, 1)]


def test_recall_rule():
    tables, bits = vectors.tables_and_bits(10**9, 0.9)
    assert bits == 23 and 150 < tables < 250
