"""Small tables for the training-data operators: given documents, and rows made to be awkward."""

from __future__ import annotations

import random

SMALL = "/root/testdata/sf0.001"
AWKWARD = "doc_id long, text string, lang string, source string, n_chars long, score string, slot string, shard int, key string, fp int, row int, spans int"


def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


def awkward(spark, schema=AWKWARD):
    """NULLs in every column, empty and very long texts, repeated rows and texts, clashing column names."""
    draw = random.Random(5)
    words = ["alpha", "Beta", "gamma,", "delta.", "épsilon", "日本", "7", "x-y", "<|endoftext|>", "a@b.example.org"]
    long = " ".join(draw.choice(words) for _ in range(20_000))
    texts = [None, "", " ", "\n\t ", "one", "one two three four", long, long, long[:5000], "\x00\x01 odd\x012 " + long[:900], "tail 42.1.2.3"]
    out = [(i, t, "en", "s0", len(t or ""), "x", "y", 1, "k", 2, 3, 4) for i, t in enumerate(texts)]
    out += [(None, "one", None, None, None, None, None, None, None, None, None, None), (None, None, *[None] * 10), out[4], out[7], out[7]]
    return spark.createDataFrame(out, schema)


def nothing(spark, schema=AWKWARD):
    return spark.createDataFrame([], schema)


def components(n, pairs):
    """Smallest member reachable from each of ``n`` members."""
    up = list(range(n))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]
