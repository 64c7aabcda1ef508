"""Tables in and out, with their declarations."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession

from rowgrain.frame import GrainedFrame
from rowgrain.operators.verify import duplicates, null_counts
from rowgrain.spec import FD, GrainError, GrainSpec, columns


class KeyViolation(GrainError):
    """The rows contradict the declared grain."""


def source(
    df: DataFrame,
    grain: str | Sequence[str],
    entity_key: str | Sequence[str] | None = None,
    measures: Iterable[str] = (),
    fds: Iterable[tuple[Sequence[str], Sequence[str]]] = (),
    alternatives: Iterable[Sequence[str]] = (),
    kind: str | None = None,
    verify: bool = False,
) -> GrainedFrame:
    """Declare what a row of ``df`` stands for.

    Measures get this grain as their home.  With ``verify`` two jobs check that
    the key is set and unique, as a primary key would.
    """
    g = columns(grain)
    spec = GrainSpec(
        grain=g,
        entity_key=None if entity_key is None else columns(entity_key),
        alternatives=tuple(columns(a) for a in alternatives),
        fds=tuple(FD.of(a, b) for a, b in fds),
        measures={m: g for m in measures},
        kind=kind,
    )
    frame = GrainedFrame(df, spec)
    if verify:
        check_key(df, g)
    return frame


def check_key(df: DataFrame, grain: Iterable[str]) -> None:
    nulls = null_counts(df, sorted(grain)).filter("n_null > 0").limit(1).collect()
    if nulls:
        raise KeyViolation(f"{nulls[0].n_null} NULLs in key column {nulls[0].column_name}")
    twice = duplicates(df, grain).limit(1).collect()
    if twice:
        raise KeyViolation(f"key occurs more than once: {twice[0].asDict()}")


def read(spark: SparkSession, path: str, grain, fmt: str = "parquet", schema=None, **declared) -> GrainedFrame:
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    return source(reader.load(path), grain, **declared)


def table(spark: SparkSession, name: str, grain, **declared) -> GrainedFrame:
    return source(spark.table(name), grain, **declared)


def from_rows(spark: SparkSession, rows: Sequence, schema, grain, **declared) -> GrainedFrame:
    """Rows held in the program, for small literal tables."""
    return source(spark.createDataFrame(rows, schema), grain, **declared)


def write(
    frame: GrainedFrame | DataFrame, path: str, mode: str = "errorifexists", fmt: str = "parquet",
    partition_by: Sequence[str] = (), distinct: bool = False,
) -> None:
    """Store a result.  ``distinct`` is skipped where a declared grain makes rows distinct already."""
    df = frame.df if isinstance(frame, GrainedFrame) else frame
    if distinct and not isinstance(frame, GrainedFrame):
        df = df.distinct()
    df.write.mode(mode).format(fmt).partitionBy(*partition_by).save(path)


def save_bucketed(frame: GrainedFrame, name: str, buckets: int, keys: Sequence[str] | None = None, mode: str = "errorifexists") -> None:
    """Store as a table bucketed by a key, so that later joins on it need no shuffle."""
    by = sorted(frame.grain) if keys is None else list(keys)
    frame.df.write.mode(mode).bucketBy(buckets, *by).sortBy(*by).saveAsTable(name)


def write_report(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Aggregated results as JSON lines."""
    df.write.mode(mode).json(path)


def register(spark: SparkSession, **frames: GrainedFrame | DataFrame) -> None:
    for name, f in frames.items():
        (f.df if isinstance(f, GrainedFrame) else f).createOrReplaceTempView(name)


def drop(spark: SparkSession, *names: str) -> None:
    for name in names:
        spark.catalog.dropTempView(name)
