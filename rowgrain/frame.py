"""A DataFrame that knows its grain.

Each method runs one ordinary DataFrame operation and works out the grain of
the result from column names.  Asking for a grain, or being refused, never
starts a job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import replace
from functools import wraps

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowgrain.functions.columns import references
from rowgrain.operators import aggregates as ag
from rowgrain.operators import joins as jn
from rowgrain.operators import ordered as od
from rowgrain.operators import keys as key_checks
from rowgrain.session import cut_lineage
from rowgrain.spec import (
    FD, EQUAL, Columns, FanTrap, GrainError, GrainLost, GrainMismatch, GrainSpec,
    MissingColumns, closure, columns, compare_grains, join_grain, minimal_sets, outer_join_grain,
)


class GrainedFrame:
    """An immutable pair of a DataFrame and its ``GrainSpec``."""

    __slots__ = ("df", "spec", "_sides")

    def __init__(self, df: DataFrame, spec: GrainSpec, sides: tuple[DataFrame, DataFrame] | None = None):
        """``sides``: the two inputs of which ``df`` is the inner join on all columns of one name."""
        object.__setattr__(self, "df", df)
        object.__setattr__(self, "spec", spec.check(df.columns))
        object.__setattr__(self, "_sides", sides)

    def __setattr__(self, *_):
        raise AttributeError("a GrainedFrame does not change; every method returns a new one")

    def __repr__(self) -> str:
        return f"GrainedFrame(grain={sorted(self.grain)}, columns={self.df.columns})"

    # What it is --------------------------------------------------------------

    @property
    def grain(self) -> Columns:
        return self.spec.grain

    @property
    def entity_key(self) -> Columns | None:
        return self.spec.entity_key

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    @property
    def fds(self) -> tuple[FD, ...]:
        return self.spec.all_fds(self.df.columns)

    @property
    def grain_arity(self) -> int:
        return len(self.grain)

    @property
    def entity_key_arity(self) -> int:
        return len(self.entity_key or ())

    def compare(self, other: "GrainedFrame | Iterable[str]") -> str:
        """How this grain stands to another, under the declared dependencies."""
        if isinstance(other, GrainedFrame):
            return compare_grains(self.grain, other.grain, (*self.spec.fds, *other.spec.fds))
        return compare_grains(self.grain, other, self.spec.fds)

    def expect_grain(self, *target: str) -> "GrainedFrame":
        """Refuse to go on unless the grain is the one a report needs."""
        wanted = columns(target)
        if self.grain != wanted and wanted not in self.spec.alternatives:
            raise GrainMismatch(f"grain is {sorted(self.grain)}, asked for {sorted(wanted)}")
        return self

    def check(self) -> DataFrame:
        """The declared grain measured on the rows: unique, and no column of it can go."""
        return key_checks.accept_grain(self.df, self.grain)

    def checkpoint(self) -> "GrainedFrame":
        """Store the rows in the shared checkpoint folder and go on from there."""
        return self._with(cut_lineage(self.df), clustered=None)

    def _with(self, df: DataFrame, **changes) -> "GrainedFrame":
        return GrainedFrame(df, replace(self.spec, **changes))

    # Rows and columns --------------------------------------------------------

    def where(self, condition: Column | str) -> "GrainedFrame":
        return self._with(self.df.filter(condition))

    def select(self, *cols: str) -> "GrainedFrame":
        """Keep some columns; the grain has to be among them."""
        lost = sorted(self.grain - set(cols))
        if lost:
            raise GrainLost(f"projection drops grain columns: {', '.join(lost)}")
        return GrainedFrame(self.df.select(*cols), self.spec.restricted(cols))

    def project_distinct(self, *cols: str) -> "GrainedFrame":
        """Distinct rows of some columns.  No shuffle where the grain is among them already."""
        if self.grain <= set(cols):
            return self.select(*cols)
        spec = replace(self.spec.restricted(cols), grain=columns(cols), alternatives=(), homes={}, clustered=columns(cols))
        if spec.entity_key and not spec.entity_key <= spec.grain:
            spec = replace(spec, entity_key=None)
        return GrainedFrame(self.df.select(*cols).distinct(), spec)

    def extend(self, **exprs: Column) -> "GrainedFrame":
        """Add columns computed from the row; grain columns cannot be overwritten.

        A computed column is at home where the columns it comes from are, all
        taken together, so a measure stays guarded under another name.
        """
        over = sorted(self.grain & set(exprs))
        if over:
            raise GrainLost(f"would overwrite grain columns: {', '.join(over)}")
        hit = set(exprs)
        measures = {m: h for m, h in self.spec.measures.items() if m not in hit}
        fds = tuple(fd for fd in self.spec.fds if not (fd.lhs | fd.rhs) & hit)
        alternatives = tuple(a for a in self.spec.alternatives if not a & hit)
        homes = {c: h for c, h in self.spec.homes.items() if c not in hit}
        if len(set(map(self.spec.home, self.columns))) > 1 or self.repeated_measures():
            for name, expr in exprs.items():
                used = references(self.df, expr)
                if used is None:  # cannot be told, so all columns
                    used = set(self.columns)
                if used:
                    homes[name] = frozenset().union(*map(self.spec.home, used))
        return self._with(self.df.withColumns(exprs), measures=measures, homes=homes, fds=fds, alternatives=alternatives)

    def rename(self, names: Mapping[str, str]) -> "GrainedFrame":
        after = [names.get(c, c) for c in self.df.columns]
        if len(set(after)) != len(after):
            raise GrainError("two columns would get the same name")
        return GrainedFrame(self.df.withColumnsRenamed(dict(names)), self.spec.renamed(names))

    def map_rows(self, exprs: Mapping[str, Column], grain: Sequence[str], order: Sequence[str]) -> "GrainedFrame":
        """New rows from old ones; rows that fall on one new grain keep the first by ``order``."""
        keep = [F.struct(*order).alias("_order")]
        df = self.df.select(*keep, *[e.alias(n) for n, e in exprs.items()])
        first = df.groupBy(*grain).agg(
            F.min_by(F.struct(*[n for n in exprs if n not in grain] or [F.lit(1).alias("_none")]), "_order").alias("_row")
        )
        rest = [F.col("_row")[n].alias(n) for n in exprs if n not in grain]
        return GrainedFrame(first.select(*grain, *rest), GrainSpec(columns(grain)))

    def grain_rows(self) -> DataFrame:
        """The grains alone.  They are unique by declaration, so there is no distinct."""
        return self.df.select(*sorted(self.grain))

    def entities(self, *cols: str, key: Sequence[str] | None = None) -> "GrainedFrame":
        """One row per entity with columns that depend on the entity only.

        ``key``: another key than the declared one, such as that of a joined table.
        """
        ek = self._need_entity_key() if key is None else columns(key)
        wanted = sorted(ek) + [c for c in cols if c not in ek]
        loose = sorted(set(cols) - closure(ek, self.spec.fds))
        if loose and self.grain != ek:
            raise GrainError(f"not known to depend on the entity key alone: {', '.join(loose)}")
        df = self.df.select(*wanted)
        if self.grain != ek:
            df = df.distinct()
        spec = self.spec.restricted(wanted)
        return GrainedFrame(df, replace(spec, grain=ek, entity_key=ek, alternatives=(), measures={}, homes={}))

    def factor(self, determinant: Sequence[str], dependent: Sequence[str]) -> tuple["GrainedFrame", "GrainedFrame"]:
        """Split off columns that depend on ``determinant``; joining the two gives the frame back."""
        if set(dependent) & self.grain:
            raise GrainLost("grain columns cannot be split off")
        dim = self.df.select(*determinant, *dependent).distinct()
        rest = self.select(*[c for c in self.df.columns if c not in dependent])
        return rest, GrainedFrame(dim, GrainSpec(columns(determinant), clustered=columns(dim.columns)))

    def _need_entity_key(self) -> Columns:
        if not self.entity_key:
            raise GrainError("no entity key declared")
        return self.entity_key

    # Joins -------------------------------------------------------------------

    def join(self, other: "GrainedFrame", on: str | jn.Pairs, how: str = "inner") -> "GrainedFrame":
        """Equi-join.  ``on`` holds names, or pairs (left name, right name).

        Every measure keeps the grain it was declared at, so adding it up after
        a join that repeats its rows is refused (see ``aggregate``).  Outer
        joins against a side with several rows per key are run in parts, so
        that a very frequent key can be split.
        """
        names = jn.plan_names(self.columns, other.columns, on)
        left, right = self.spec.renamed(names.left), other.spec.renamed(names.right)
        jk = frozenset(names.keys)
        left_once, right_once = left.grain <= jk, right.grain <= jk
        native = {"inner": True, "left": right_once, "right": left_once, "full": left_once and right_once}
        if how not in native:
            raise ValueError(f"no such join: {how}")
        # A side grouped by the key is not shuffled again, which would keep Spark from splitting the other one.
        stuck = (left.clustered == jk and not right_once) or (right.clustered == jk and not left_once)
        if native[how]:
            df = jn.equi_join(self.df, other.df, on, how, own_shuffle=stuck)
        else:
            df = jn.outer_join_by_parts(self.df, other.df, on, how)
        if how == "inner":
            picked = join_grain(left.grain, right.grain, jk)
            keys = {picked.grain}
            if picked.alternative:
                keys.add(picked.alternative)
            for a in (left.grain, *left.alternatives):
                for b in (right.grain, *right.alternatives):
                    more = join_grain(a, b, jk)
                    keys |= {more.grain} | ({more.alternative} if more.alternative else set())
            keys = minimal_sets(keys)
            grain = picked.grain if picked.grain in keys else keys[0]
            alternatives = tuple(k for k in keys if k != grain)
        else:
            grain = outer_join_grain(left.grain, right.grain, jk, how)
            alternatives = ()
        fds = _join_fds(
            (left, [names.left.get(c, c) for c in self.columns], how in ("right", "full")),
            (right, [names.right.get(c, c) for c in other.columns], how in ("left", "full")),
            jk,
        )
        entity = left.entity_key if left.entity_key and left.entity_key <= grain else None
        homes = {
            **right.other_homes(names.right.get(c, c) for c in other.columns),
            **left.other_homes(names.left.get(c, c) for c in self.columns),
        }
        # Only where both sides repeat a key is the join larger than they are.
        many = how == "inner" and not left_once and not right_once
        sides = (self.df.withColumnsRenamed(dict(names.left)), other.df.withColumnsRenamed(dict(names.right))) if many else None
        return GrainedFrame(
            df, GrainSpec(grain, entity, alternatives, fds, {**left.measures, **right.measures}, homes, clustered=jk), sides
        )

    def natural_join(self, other: "GrainedFrame") -> "GrainedFrame":
        """Join on all shared columns; sharing none is an error rather than a product."""
        return self.join(other, jn.natural_keys(self.df, other.df))

    def join_same_grain(self, other: "GrainedFrame", on: str | Sequence[str]) -> "GrainedFrame":
        """One-to-one join: equal grains, and the whole grain in the key."""
        if self.compare(other) != EQUAL:
            raise GrainMismatch(f"{sorted(self.grain)} is not {sorted(other.grain)}")
        if not self.grain <= columns(on):
            raise FanTrap(f"joining on {sorted(columns(on))} only would repeat rows of {sorted(self.grain)}")
        return self.join(other, on)

    def full_join_totals(self, other: "GrainedFrame", on: Sequence[str], default=0) -> "GrainedFrame":
        """Full join of two aggregates at one grain; absent measures become ``default``."""
        if self.grain != other.grain or self.grain != columns(on):
            raise GrainMismatch("both sides must have the join key as their grain")
        out = self.join(other, on, "full")
        filled = {m: F.coalesce(F.col(m), F.lit(default)) for m in out.spec.measures}
        return GrainedFrame(out.df.withColumns(filled), out.spec) if filled else out

    def theta_join(self, other: "GrainedFrame", condition: Column, equal: str | jn.Pairs = (), grid=None) -> "GrainedFrame":
        """Join on any condition over the result names; every grain column of both sides is needed."""
        if equal:
            joined = self.join(other, equal)
            return joined.where(condition)
        return self._paired(other, jn.theta_join(self.df, other.df, condition, grid=grid))

    def range_join(
        self, other: "GrainedFrame", at: str, low: str, high: str, closed: str = "both", equal: str | jn.Pairs = (), open_ends: bool = False
    ) -> "GrainedFrame":
        """Each row with the intervals of ``other`` that its ``at`` lies in; the grain is that of a theta join."""
        df = jn.range_join(self.df, other.df, at, low, high, closed, equal, open_ends)
        if not equal:
            return self._paired(other, df)
        joined = self.join(other, equal)
        return GrainedFrame(df.select(*joined.columns), joined.spec)

    def product(self, other: "GrainedFrame", grid=None) -> "GrainedFrame":
        return self._paired(other, jn.product(self.df, other.df, grid))

    def _paired(self, other: "GrainedFrame", df: DataFrame) -> "GrainedFrame":
        lnames, rnames = jn.disjoint_names(self.df, other.df)
        left, right = self.spec.renamed(lnames), other.spec.renamed(rnames)
        fds = _join_fds(
            (left, [lnames.get(c, c) for c in self.columns], False),
            (right, [rnames.get(c, c) for c in other.columns], False),
            frozenset(),
        )
        homes = {
            **right.other_homes(rnames.get(c, c) for c in other.columns), **left.other_homes(lnames.get(c, c) for c in self.columns),
        }
        return GrainedFrame(
            df, GrainSpec(left.grain | right.grain, left.entity_key, (), fds, {**left.measures, **right.measures}, homes)
        )

    def semi_join(self, other: "GrainedFrame | DataFrame", on: str | jn.Pairs) -> "GrainedFrame":
        return self._with(jn.semi_join(self.df, _plain(other), on, *self._unique_sides(other, on)))

    def anti_join(self, other: "GrainedFrame | DataFrame", on: str | jn.Pairs) -> "GrainedFrame":
        return self._with(jn.anti_join(self.df, _plain(other), on, *self._unique_sides(other, on)))

    def _unique_sides(self, other: "GrainedFrame | DataFrame", on: str | jn.Pairs) -> tuple[bool, bool]:
        """Is each key there once, on the right and on the left?"""
        pairs = jn.key_pairs(on)
        right = isinstance(other, GrainedFrame) and other.grain <= {b for _, b in pairs}
        left = self.grain <= {a for a, _ in pairs}
        # A right side grouped by the key would keep Spark from splitting the left one.
        grouped = isinstance(other, GrainedFrame) and other.spec.clustered == {b for _, b in pairs}
        return right and (left or not grouped), left

    # Aggregation -------------------------------------------------------------

    def repeated_measures(self) -> dict[str, Columns]:
        """Columns whose home grain differs from the frame's: adding them up double-counts."""
        fds = self.fds
        homes = {**self.spec.homes, **self.spec.measures}
        away = {h for h in set(homes.values()) if compare_grains(h, self.grain, fds) != EQUAL}
        return {c: h for c, h in homes.items() if h in away}

    def aggregate(self, keys: str | Sequence[str], **aggs: ag.Agg) -> "GrainedFrame":
        """Group; the grain becomes the grouping columns.

        Sums, averages and counts of a measure are refused where the measure's
        home grain is not the frame's grain.  Minimum, maximum and distinct
        count do not change when rows repeat, so they are always allowed.

        Grouping a many-to-many join by its key does not make the pairs (see ``ag.over_join``).
        """
        keys = [keys] if isinstance(keys, str) else list(keys)
        missing = sorted((set(keys) | {a.column for a in aggs.values() if a.column}) - set(self.columns))
        if missing:
            raise MissingColumns(f"not in the table: {', '.join(missing)}")
        repeated = self.repeated_measures()
        for name, a in aggs.items():
            if not a.repeat_safe and a.column in repeated:
                raise FanTrap(
                    f"{name}: {a.kind}({a.column}) would count rows of grain "
                    f"{sorted(repeated[a.column])} repeatedly at grain {sorted(self.grain)}"
                )
        exprs = [a.expression().alias(n) for n, a in aggs.items()]
        if self._sides and exprs and set(keys) == self.spec.clustered and all(a.kind in ag.JOINABLE for a in aggs.values()):
            df = ag.over_join(*self._sides, keys, aggs)
        else:
            df = self.df.groupBy(*keys).agg(*exprs) if exprs else self.df.select(*keys).distinct()
        grain = columns(keys)
        spec = replace(self.spec.restricted(keys), grain=grain, alternatives=(), kind=None,
                       measures={n: grain for n in aggs}, homes={}, clustered=grain)
        return GrainedFrame(df, spec)

    def aggregate_to(self, target: Sequence[str], **aggs: ag.Agg) -> "GrainedFrame":
        """Group to a target grain, which has to be coarser than the present one."""
        if not columns(target) <= closure(self.grain, self.fds):
            raise GrainMismatch(f"{sorted(target)} is not determined by the grain {sorted(self.grain)}")
        return self.aggregate(list(target), **aggs)

    def count(self) -> int:
        return self.df.count()

    def rows_per_grain(self) -> DataFrame:
        return self.df.groupBy(*sorted(self.grain)).count()

    def collect_groups(self, keys: Sequence[str], order: Sequence[str], piece_rows: int = ag.PIECE_ROWS) -> "GrainedFrame":
        df = ag.collect_groups(self.df, keys, order, piece_rows)
        return GrainedFrame(df, GrainSpec(columns(keys) | {"piece"}))

    # One row per key ---------------------------------------------------------

    def latest(self, order: Sequence[str], keys: Sequence[str] | None = None) -> "GrainedFrame":
        """Coarsen versions or events to one row per entity: the newest row, whole."""
        keys = sorted(self._need_entity_key()) if keys is None else list(keys)
        df = od.latest_per_key(self.df, keys, order)
        return self._reduced_to(df, keys)

    def first_per(self, keys: Sequence[str], order: Sequence[Column | str]) -> "GrainedFrame":
        return self._reduced_to(od.first_per_key(self.df, list(keys), order), keys)

    def _reduced_to(self, df: DataFrame, keys: Sequence[str]) -> "GrainedFrame":
        grain = columns(keys)
        entity = self.entity_key if self.entity_key and self.entity_key <= grain else None
        repeated = self.repeated_measures()
        measures = {m: h if m in repeated else grain for m, h in self.spec.measures.items()}
        homes = {c: h for c, h in self.spec.homes.items() if c in repeated}
        return self._with(
            df, grain=grain, entity_key=entity, alternatives=(), measures=measures, homes=homes, kind=None, clustered=grain
        )

    def top(self, n: int, *order: Column | str) -> "GrainedFrame":
        return self._with(self.df.orderBy(*order).limit(n), clustered=None)

    def distinct(self) -> "GrainedFrame":
        """Rows are distinct already, since the grain is a key: nothing to do."""
        return self

    # Windows -----------------------------------------------------------------

    def previous(self, order: Sequence[str], cols: Sequence[str], name: str = "previous", **kw) -> "GrainedFrame":
        df = od.previous_row(self.df, sorted(self._need_entity_key()), order, cols, name, **kw)
        return self._with(df)

    def following(self, order: Sequence[str], cols: Sequence[str], name: str = "following", **kw) -> "GrainedFrame":
        df = od.next_row(self.df, sorted(self._need_entity_key()), order, cols, name, **kw)
        return self._with(df)


def _plain(x: GrainedFrame | DataFrame) -> DataFrame:
    return x.df if isinstance(x, GrainedFrame) else x


def _join_fds(left, right, jk: Columns) -> tuple[FD, ...]:
    """Dependencies that hold after a join.

    On a side that may be filled with NULLs the key columns come from the other
    side, so there every dependency also needs the key on its left.
    """
    out = []
    for spec, cols, may_be_null in (left, right):
        for fd in (*spec.fds, *[FD(k, frozenset(cols)) for k in (spec.grain, *spec.alternatives)]):
            out.append(FD(fd.lhs | jk, fd.rhs) if may_be_null else fd)
    return tuple(dict.fromkeys(out))


def requires_grain(*expected: str, entity_key: Sequence[str] | None = None, kind: str | None = None) -> Callable:
    """Decorator: the first argument must be a frame of this grain, or the call is refused."""
    wanted = columns(expected)

    def wrap(fn):
        @wraps(fn)
        def call(frame: GrainedFrame, *args, **kw):
            if not isinstance(frame, GrainedFrame):
                raise TypeError(f"{fn.__name__} needs a GrainedFrame")
            if wanted and frame.grain != wanted:
                raise GrainMismatch(f"{fn.__name__} needs grain {sorted(wanted)}, got {sorted(frame.grain)}")
            if entity_key is not None and frame.entity_key != columns(entity_key):
                raise GrainMismatch(f"{fn.__name__} needs entity key {sorted(entity_key)}")
            if kind is not None and frame.spec.kind != kind:
                raise GrainMismatch(f"{fn.__name__} needs a table of kind {kind}, got {frame.spec.kind}")
            return fn(frame, *args, **kw)

        return call

    return wrap


def safe_join_aggregate(inputs: Sequence[tuple[GrainedFrame, Mapping[str, ag.Agg]]], target: Sequence[str]) -> GrainedFrame:
    """Bring every input to the target grain first, then join one-to-one.

    This is the order that keeps totals right; joining first would repeat rows.
    """
    parts = [frame.aggregate_to(target, **aggs) for frame, aggs in inputs]
    out = parts[0]
    for part in parts[1:]:
        out = out.full_join_totals(part, list(target))
    return out.expect_grain(*target)
