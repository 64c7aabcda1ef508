"""Small column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def key(cols: Iterable[str]) -> Column:
    """The whole key as one value; a NULL inside it counts as a value of its own."""
    names = sorted(cols)
    return F.struct(*names) if names else F.struct(F.lit(0).alias("_none"))


def position(df: DataFrame, name: str) -> Column | None:
    """A number that grows with an ordering column, or None where there is no such number."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.NumericType):
        return F.col(name).cast("double")
    if isinstance(dtype, T.DateType):
        return F.expr(f"datediff(`{name}`, date'1970-01-01')").cast("double")
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(name).cast("double")
    if isinstance(dtype, T.TimestampNTZType):
        # From the parts, so that no time zone of the session comes in.
        t = F.col(name)
        days = F.datediff(t.cast("date"), F.lit("1970-01-01").cast("date"))
        return (days * 86400 + F.hour(t) * 3600 + F.minute(t) * 60).cast("double") + F.extract(F.lit("SECOND"), t).cast("double")
    return None


def money(col: Column | str, scale: int = 2) -> Column:
    """Exact decimal, so that a sum does not depend on the order of the rows."""
    c = F.col(col) if isinstance(col, str) else col
    return c.cast(T.DecimalType(18, scale))


def code(prefix: str, number: Column, width: int) -> Column:
    """A text code such as ``C00042``."""
    return F.concat(F.lit(prefix), F.lpad(number.cast("string"), width, "0"))


def digit(number: Column, divisor: int, base: int) -> Column:
    """One digit of a mixed-radix counter, starting at 1."""
    return (whole_division(number, divisor) % F.lit(base) + F.lit(1)).cast("long")


def whole_division(a: Column, b: Column | int) -> Column:
    """Division of whole numbers without a detour through floating point."""
    return F.call_function("div", a, F.lit(b))


def hashed(parts: Sequence[Column | str], modulus: int) -> Column:
    """A repeatable stand-in for a random value that depends on ``parts`` only."""
    return F.pmod(F.xxhash64(*parts), F.lit(modulus)).cast("int")


def fresh(df_columns: Iterable[str], *wanted: str) -> list[str]:
    """Helper column names that no table column has."""
    taken = set(df_columns)
    out = []
    for name in wanted:
        while name in taken:
            name = "_" + name
        taken.add(name)
        out.append(name)
    return out


def references(df: DataFrame, expr: Column) -> set[str] | None:
    """Columns of ``df`` that an expression reads, from Spark's analysis; None where that cannot be told.  No job runs."""
    if not hasattr(df, "_jdf"):
        return None
    found = df.select(expr.alias("_read"))._jdf.queryExecution().analyzed().references().iterator()
    names = set()
    while found.hasNext():
        names.add(found.next().name())
    return names if names <= set(df.columns) else None
