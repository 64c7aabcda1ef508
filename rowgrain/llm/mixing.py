"""Mixing sources to target weights by Pfair scheduling, with DataFrame functions only.

Each source's rows are cut into blocks.  Block ``k`` (from 1) of a source of weight ``w`` is released at slot
``floor((k - 1) / w)`` and due by slot ``ceil(k / w)``; in each slot the released block due first is taken.  At any
slot the blocks taken from a source that still has some differ from its weight times the slots by less than one.

The schedule is worked out period by period, each in a row of its own: how many blocks were taken before a period
follows from the weights alone (:func:`with_taken`).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowgrain.session import cut_lineage

#: Slots that are scheduled in one row; with more sources, as many as there are sources.
PERIOD = 1000
#: Slots of a mix at most.  Shares times slots stay below 2 ** 62, with at most 2 ** FINE shares in all.
SLOTS, FINE = 1 << 31, 48
#: Rows of one source that are numbered in one group.
CHUNK = 4096


def whole_shares(weights: Mapping[str, float], period: int = PERIOD) -> dict[str, int]:
    """Weights as whole shares of a period, by largest remainder; each source gets one at least."""
    if not weights or any(not w > 0 for w in weights.values()):
        raise ValueError("every source needs a weight above zero")
    if len(weights) > period:
        raise ValueError("more sources than slots in a period")
    total = sum(weights.values())
    exact = {s: w * period / total for s, w in weights.items()}
    share = {s: max(1, int(x)) for s, x in exact.items()}
    names = sorted(exact, key=lambda s: (share[s] - exact[s], s))
    i = 0
    while (rest := period - sum(share.values())) != 0:
        s = names[i % len(names)] if rest > 0 else max((s for s in share if share[s] > 1), key=lambda s: (share[s] - exact[s], share[s], s))
        share[s] += 1 if rest > 0 else -1
        i += 1
    return share


def with_taken(rows: DataFrame, name: str, t: str, total: int) -> DataFrame:
    """Adds ``name``: how many blocks of each source are taken before slot ``t``; ``w`` has the shares, ``total`` in all.

    Share times slots, rounded up for as many sources as fill the slots and down for the others.  Up go those whose
    pending block is due first, as far as the slots since these blocks were released have room beside the blocks due
    before ``t``.  Some schedule keeps every window and has such a state at ``t``, and among these states the one with
    the most blocks of early due slots leaves enough room after ``t``.
    """
    d = f"{total}L"
    state = f"""transform(transform(w, (x, i) -> named_struct('x', x, 'i', i, 'k', x * {t} div {d}, 'open', x * {t} % {d} > 0)), s -> named_struct(
        'x', s.x, 'i', s.i, 'k', s.k, 'open', s.open, 'release', s.k * {d} div s.x, 'due', ((s.k + 1) * {d} + s.x - 1) div s.x))"""
    pending = "array_sort(transform(filter(_all, s -> s.open), s -> named_struct('due', s.due, 'x', -s.x, 'i', s.i, 'release', s.release)))"
    room = f"""transform(_open, c -> {t} - c.release - aggregate(_all, 0L, (n, s) -> n + greatest(0L, s.k - (s.x * c.release + {d} - 1) div {d})))"""
    up = f"""aggregate(_open, named_struct('room', _room, 'left', {t} - aggregate(_all, 0L, (n, s) -> n + s.k), 'up', cast(array() as array<int>)),
        (st, c) -> transform(array(transform(st.room, (v, m) -> v - if(_open[m].release <= c.release, 1L, 0L))), u -> if(
            st.left > 0 and array_min(u) >= 0, named_struct('room', u, 'left', st.left - 1, 'up', array_append(st.up, c.i)), st))[0],
        st -> st.up)"""
    rows = rows.withColumn("_all", F.expr(state)).withColumn("_open", F.expr(pending)).withColumn("_room", F.expr(room)).withColumn("_up", F.expr(up))
    taken = "transform(_all, s -> s.k + if(array_contains(_up, s.i), 1L, 0L))"
    return rows.withColumn(name, F.expr(taken)).drop("_all", "_open", "_room", "_up")


def schedule(spark: SparkSession, shares: Mapping[str, int], slots: int | None = None, period: int | None = None) -> DataFrame:
    """``(source, k, slot, release, deadline)``: the slot of each source's ``k``-th block and its window, all from 0.

    Weights are the shares over their sum.  ``slots`` (default: the sum) in rows of ``period`` slots, each a fold with
    the blocks taken so far as its state.
    """
    names, total = sorted(shares), sum(shares.values())
    slots = slots or total
    n, d, period = len(names), F.lit(total).cast("long"), min(period or slots, slots)
    count = -(-slots // period)
    rows = spark.range(0, count, 1, min(count, int(spark.conf.get("spark.sql.shuffle.partitions")))).select(
        (F.col("id") * period).alias("t0"), F.least((F.col("id") + 1) * period, F.lit(slots).cast("long")).alias("t1"),
        F.array(*[F.lit(shares[s]).cast("long") for s in names]).alias("w"),
    )
    rows = with_taken(with_taken(rows, "first", "t0", total), "last", "t1", total)
    w, last, t1 = F.col("w"), F.col("last"), F.col("t1")

    def div(a: Column, b: Column) -> Column:
        return F.call_function("div", a, b)

    def step(state: Column, slot: Column) -> Column:
        taken = state["taken"]

        def due(i: Column) -> Column:
            done, share = F.element_at(taken, i), F.element_at(w, i)
            released = (done < F.element_at(last, i)) & (done * d < (slot + 1) * share)  # floor(done * total / share) <= slot
            # Due slot first, which the end of the row is for all; of equal ones the block whose successor has less room, then by name.
            ends = div((done + 1) * d + share - 1, share)
            return F.when(released, F.struct(F.least(ends, t1).alias("e"), ends.alias("d"), (-share).alias("w"), i.alias("i")))

        best = F.array_min(F.filter(F.transform(F.sequence(F.lit(1), F.lit(n)), due), lambda x: x.isNotNull()))["i"]
        now = F.transform(taken, lambda x, i: x + F.when(i + 1 == best, F.lit(1)).otherwise(F.lit(0)).cast("long"))
        entry = F.struct(best.alias("i"), F.element_at(taken, best).alias("k"), slot.cast("long").alias("slot"))
        return F.struct(now.alias("taken"), F.concat(state["out"], F.array(entry)).alias("out"))

    zero = F.expr("named_struct('taken', first, 'out', cast(array() as array<struct<i:int,k:bigint,slot:bigint>>))")
    made = rows.select("w", F.explode(F.aggregate(F.sequence(F.col("t0"), t1 - 1), zero, step, lambda s: s["out"])).alias("e"))
    source, k, share = F.element_at(F.array(*[F.lit(s) for s in names]), F.col("e.i")), F.col("e.k"), F.element_at(w, F.col("e.i"))
    return made.select(
        source.alias("source"), k.alias("k"), F.col("e.slot").alias("slot"),
        div(k * d, share).alias("release"), div((k + 1) * d + share - 1, share).alias("deadline"),
    )


def numbered(rows: DataFrame, group: str, order: str, chunks: int) -> DataFrame:
    """Adds ``_n``: a running number from 0 within each group (never NULL) by the number in ``order``, a hash.

    A frequent group is numbered in ``chunks`` parts, moved apart by the sizes of the parts before.
    """
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(order), F.lit(chunks)).cast("long"))
    sizes = dealt.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(group, "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    here = dealt.withColumn("_own", F.row_number().over(Window.partitionBy(group, "_part").orderBy(order)))
    return (
        here.join(offsets, [group, "_part"]).withColumn("_n", F.col("_before") + F.col("_own") - 1)
        .drop("_part", "_before", "_own")
    )


ADDED = ("block", "release", "deadline", "slot", "in_block", "mixed")


def placed(docs: DataFrame, weights: Mapping[str, float] | None = None, block: int = 32, period: int = PERIOD, chunk: int = CHUNK) -> DataFrame:
    """All rows of ``docs (doc_id, text, source)`` with their slot in the mix; ``slot, in_block`` is the order.

    Adds ``block`` (of the source, from 0), ``release`` and ``deadline`` (slots), ``slot`` (taken in), ``in_block`` and
    ``mixed``: true while every source still has blocks.  Columns of these names are replaced.  No row is dropped:
    where a source runs out its slots stay empty and the others keep their weights among themselves.

    ``weights`` by source; sources without one get the smallest given.  By default the square root of the number of
    rows, which lifts small sources.  A NULL source is a source of its own, named by the empty string here and equal
    to it.  Rows within a source are in hashed order; only equal rows tie.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.drop(*ADDED).withColumns({"_source": F.coalesce(F.col("source").cast("string"), F.lit("")), "_h": F.xxhash64("doc_id", "text")})
    # One row per source.
    counts = {r["_source"]: r["n"] for r in rows.groupBy("_source").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return docs.drop(*ADDED).select("*", *[F.lit(None).cast("boolean" if c == "mixed" else "long").alias(c) for c in ADDED])
    weights = weights or {s: n**0.5 for s, n in counts.items()}
    given = {s: weights.get(s, min(weights.values())) for s in counts}
    whole_shares(given, len(given))  # refuses weights that are none
    blocks = {s: -(-n // block) for s, n in counts.items()}
    period, total = max(period, len(counts)), sum(given.values())
    slots = max((blocks[s] + 2) * total / given[s] for s in counts)
    if not slots + period < SLOTS:
        raise ValueError(f"with these weights the mix has more than {SLOTS} slots")
    slots = -(-int(slots + 1) // period) * period
    shares = whole_shares(given, 1 << min(FINE, 61 - slots.bit_length()))
    ends = F.create_map(*[F.lit(x) for s, n in blocks.items() for x in (s, n)])
    steps = cut_lineage(schedule(spark, shares, slots, period).withColumn("_end", F.element_at(ends, F.col("source"))).filter("k <= _end"))
    empty = steps.filter("k = _end").agg(F.min("slot")).first()[0]  # the first slot left empty
    seq = numbered(rows, "_source", "_h", max(1, -(-sum(counts.values()) // chunk)))
    seq = seq.withColumns({"block": F.floor(F.col("_n") / block).cast("long"), "in_block": F.pmod("_n", F.lit(block)).cast("long")})
    plan = steps.select(F.col("source").alias("_source"), F.col("k").alias("block"), "slot", "release", "deadline")
    out = seq.join(plan, ["_source", "block"])
    return out.withColumn("mixed", F.col("slot") < F.lit(empty)).select(*[c for c in docs.columns if c not in ADDED], *ADDED)


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, block: int = 32, period: int = PERIOD, chunk: int = CHUNK) -> DataFrame:
    """:func:`placed` with ``position``, gapless over the whole mix, from 0."""
    rows = placed(docs.drop("position"), weights, block, period, chunk)
    # Rows before a slot: those of the runs of slots before it, and those before it in its run.
    rows = rows.withColumn("_run", F.floor(F.col("slot") / max(1, chunk // block)).cast("long"))
    runs = rows.groupBy("_run").agg(F.count(F.lit(1)).alias("_size")).withColumn("_top", F.floor(F.col("_run") / 1024).cast("long"))
    # Two levels of sums, so that no task takes the list of all runs.
    upper = runs.groupBy("_top").agg(F.sum("_size").alias("_sum"))

    def before(column: str, order: str, by: Window | None = None) -> Column:
        w = by.orderBy(order) if by is not None else Window.orderBy(order)
        return F.coalesce(F.sum(column).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    tops = upper.select("_top", before("_sum", "_top").alias("_above"))
    starts = (
        runs.withColumn("_low", before("_size", "_run", Window.partitionBy("_top"))).join(tops, "_top")
        .select("_run", (F.col("_low") + F.col("_above")).alias("_start"))
    )
    own = F.row_number().over(Window.partitionBy("_run").orderBy("slot", "in_block"))
    return (
        rows.withColumn("_row", own).join(starts, "_run").withColumn("position", F.col("_start") + F.col("_row") - 1)
        .select(*rows.drop("_run").columns, "position")
    )
