"""Reading, writing, and the streaming forms of insert and upsert."""

import datetime as dt

from pyspark.sql import functions as F

from rowgrain import from_rows, read
from rowgrain.sources import tables as tb
from rowgrain.streaming import keyed


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_write_and_read_back(spark, tmp_path):
    f = from_rows(spark, [(1, "a"), (2, "b")], "k int, v string", "k", entity_key="k", verify=True)
    tb.write(f, str(tmp_path / "t"))
    again = read(spark, str(tmp_path / "t"), "k")
    assert rows(again.df) == rows(f.df) and again.grain == {"k"}
    tb.write(spark.createDataFrame([(1,), (1,)], "x int"), str(tmp_path / "d"), distinct=True)
    assert spark.read.parquet(str(tmp_path / "d")).count() == 1
    tb.write(f, str(tmp_path / "csv"), fmt="csv")
    assert read(spark, str(tmp_path / "csv"), "k", fmt="csv", schema="k int, v string").count() == 2
    tb.write_report(f.rows_per_grain(), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 2


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path):
    spark.sql("DROP TABLE IF EXISTS grain_a")
    spark.sql("DROP TABLE IF EXISTS grain_b")
    make = lambda n: from_rows(spark, [(i, i * n) for i in range(40)], f"k int, v{n} int", "k")
    conf = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(conf)
    try:
        spark.conf.set(conf, "-1")
        for name, n in (("grain_a", 1), ("grain_b", 2)):
            tb.save_bucketed(make(n), name, 4, mode="overwrite")
        joined = tb.table(spark, "grain_a", "k").join(tb.table(spark, "grain_b", "k"), "k")
        assert joined.count() == 40
        assert "Exchange" not in joined.df._jdf.queryExecution().sparkPlan().toString()
        assert "Exchange hashpartitioning" not in joined.df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(conf, before)
        spark.sql("DROP TABLE IF EXISTS grain_a")
        spark.sql("DROP TABLE IF EXISTS grain_b")


def test_views(spark):
    tb.register(spark, some_view=from_rows(spark, [(1,)], "k int", "k"))
    assert spark.sql("SELECT * FROM some_view").count() == 1
    tb.drop(spark, "some_view")
    assert not spark.catalog.tableExists("some_view")


def at(minute):
    return dt.datetime(2024, 1, 1, 0, minute)


def stream(spark, folder, schema="k int, t timestamp, v string"):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def put(spark, folder, data, schema="k int, t timestamp, v string"):
    spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(str(folder))


def run(query):
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def test_insert_stream_keeps_the_first_row(spark, tmp_path):
    put(spark, tmp_path / "in", [(1, at(0), "first"), (2, at(1), "x")])
    put(spark, tmp_path / "in", [(1, at(2), "second"), (3, at(3), "y")])
    out = keyed.insert_stream(stream(spark, tmp_path / "in"), ["k"], "t", "10 minutes")
    run(out.writeStream.format("memory").queryName("inserted").outputMode("append").start())
    got = spark.table("inserted")
    assert got.count() == 3 and got.select("k").distinct().count() == 3


def test_duplicates_per_window(spark, tmp_path):
    put(spark, tmp_path / "in", [(1, at(0), "a"), (1, at(1), "b"), (2, at(2), "c")])
    put(spark, tmp_path / "in", [(9, at(59), "late")])
    out = keyed.rows_per_key_stream(stream(spark, tmp_path / "in"), ["k"], "t", "1 minute", "10 minutes")
    run(out.writeStream.format("memory").queryName("dups").outputMode("append").start())
    assert [(r.k, r.n_rows) for r in spark.table("dups").collect()] == [(1, 2)]


def test_upsert_stream(spark, tmp_path):
    put(spark, tmp_path / "in", [(1, at(0), "old"), (2, at(1), "x")])
    put(spark, tmp_path / "in", [(1, at(5), "new"), (3, at(6), "y"), (3, at(7), "z")])
    stored = []

    def current():
        return spark.read.parquet(stored[-1]) if stored else None

    def store(df, number):
        path = str(tmp_path / f"state-{number}")
        df.write.mode("overwrite").parquet(path)
        stored.append(path)

    step = keyed.upsert_batches(current, store, ["k"], [F.col("t").desc()])
    run(stream(spark, tmp_path / "in").writeStream.foreachBatch(step).option("checkpointLocation", str(tmp_path / "cp")).start())
    final = {r.k: r.v for r in spark.read.parquet(stored[-1]).collect()}
    assert set(final) == {1, 2, 3} and final[2] == "x" and final[3] == "z"
    assert len(stored) == 2


def files(folder):
    return {p: p.stat().st_mtime_ns for p in folder.glob("rows/_part=*/*.parquet")}


def test_upsert_rewrites_the_parts_of_its_keys_only(spark, tmp_path):
    put(spark, tmp_path / "in", [(k, at(0), "old") for k in range(200)] + [(None, at(0), "old")])
    put(spark, tmp_path / "in", [(3, at(5), "a"), (3, at(6), "b"), (7, at(5), "c"), (None, at(5), "d"), (900, at(5), "e")])
    seen = []
    keep = keyed.upsert_into(str(tmp_path / "table"), ["k"], [F.col("t").desc()], parts=32)

    def step(batch, number):
        keep(batch, number)
        seen.append(files(tmp_path / "table"))

    run(stream(spark, tmp_path / "in").writeStream.foreachBatch(step).option("checkpointLocation", str(tmp_path / "cp")).start())
    final = {r.k: r.v for r in keyed.stored(spark, str(tmp_path / "table")).collect()}
    changed = {3: "b", 7: "c", None: "d", 900: "e"}
    assert final == {**{k: "old" for k in range(200)}, **changed}
    first, second = seen
    parts = lambda found: {p.parent.name for p in found}
    assert len(parts(first)) >= 30  # nearly all of 32
    assert 1 <= len(parts(set(second) - set(first))) <= len(changed)
    assert parts(set(first) - set(second)) <= parts(set(second) - set(first))
    assert all(first[p] == second[p] for p in set(first) & set(second))


def test_a_repeated_batch_ends_the_same(spark, tmp_path):
    schema = "k int, t timestamp, v string"
    step = keyed.upsert_into(str(tmp_path), ["k"], [F.col("t").desc()], parts=4)
    step(spark.createDataFrame([], schema), 0)
    assert not (tmp_path / "rows").exists()
    step(spark.createDataFrame([(k, at(0), "old") for k in range(20)], schema), 1)
    batch = spark.createDataFrame([(1, at(1), "new"), (50, at(1), "new")], schema)
    step(batch, 2)
    want = rows(keyed.stored(spark, str(tmp_path)))
    assert len(want) == 21
    # As if the driver had died while the new folders were put in place: one of them is gone.
    (lost,) = {p.parent for p in files(tmp_path) if p.parent.name == f"_part={part_of(spark, 1)}"}
    lost.rename(tmp_path / "gone")
    assert len(rows(keyed.stored(spark, str(tmp_path)))) < 21
    step(batch, 2)
    assert rows(keyed.stored(spark, str(tmp_path))) == want
    step(batch, 2)
    assert rows(keyed.stored(spark, str(tmp_path))) == want


def part_of(spark, k):
    return spark.range(1).select(F.pmod(F.xxhash64(F.lit(k)), F.lit(4))).first()[0]


def test_checkpoint_folder_of_the_session_is_used(spark, tmp_path, monkeypatch):
    from rowgrain.session import cut_lineage

    if spark.sparkContext.getCheckpointDir() is None:
        spark.conf.set("spark.checkpoint.dir", str(tmp_path / "shared"))
    df = cut_lineage(spark.range(5).selectExpr("id * 2 as x"))
    assert rows(df) == [(0,), (2,), (4,), (6,), (8,)]
    assert "Scan ExistingRDD" in df._jdf.queryExecution().executedPlan().toString()
    frame = from_rows(spark, [(1, 2)], "k int, v int", "k").checkpoint()
    assert frame.grain == {"k"} and rows(frame.df) == [(1, 2)]
