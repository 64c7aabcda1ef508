"""What one row of a table stands for, kept as plain column sets.

Everything here looks at column names only.  No function starts a Spark job, so
a wrong grain is refused before any data is read.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace

Columns = frozenset[str]


class GrainError(ValueError):
    """Base of every refusal made on the schema alone."""


class MissingColumns(GrainError):
    """A declared column is not in the table."""


class GrainLost(GrainError):
    """An operation would drop or overwrite a column of the grain."""


class GrainMismatch(GrainError):
    """The grain worked out differs from the one that was asked for."""


class FanTrap(GrainError):
    """A measure would be added up at a finer grain than its own."""


def columns(cols: str | Iterable[str]) -> Columns:
    return frozenset([cols] if isinstance(cols, str) else cols)


# Grain order -----------------------------------------------------------------

EQUAL, FINER, COARSER, INCOMPARABLE = "equal", "finer", "coarser", "incomparable"


def compare_grains(a: Iterable[str], b: Iterable[str], fds: Iterable["FD"] = ()) -> str:
    """``a`` is finer than ``b`` when its columns determine those of ``b``."""
    fds = tuple(fds)
    a, b = columns(a), columns(b)
    a_to_b, b_to_a = b <= closure(a, fds), a <= closure(b, fds)
    if a_to_b and b_to_a:
        return EQUAL
    if a_to_b:
        return FINER
    if b_to_a:
        return COARSER
    return INCOMPARABLE


def meet(*grains: Iterable[str]) -> Columns:
    """The coarsest grain that is at least as fine as all of them."""
    return frozenset().union(*map(columns, grains))


def common_grain(*grains: Iterable[str]) -> Columns:
    """The finest grain to which all of them can be rolled up."""
    first, *rest = map(columns, grains)
    return first.intersection(*rest)


# Functional dependencies -----------------------------------------------------

@dataclass(frozen=True)
class FD:
    """Rows that agree on ``lhs`` agree on ``rhs``."""

    lhs: Columns
    rhs: Columns

    @staticmethod
    def of(lhs: str | Iterable[str], rhs: str | Iterable[str]) -> "FD":
        return FD(columns(lhs), columns(rhs))

    def renamed(self, names: Mapping[str, str]) -> "FD":
        return FD(rename_set(self.lhs, names), rename_set(self.rhs, names))


def closure(cols: Iterable[str], fds: Iterable[FD]) -> Columns:
    """All columns fixed once ``cols`` are fixed."""
    known, fds = set(cols), list(fds)
    while True:
        gained = [fd for fd in fds if fd.lhs <= known and not fd.rhs <= known]
        if not gained:
            return frozenset(known)
        for fd in gained:
            known |= fd.rhs


def determines(lhs: Iterable[str], rhs: Iterable[str], fds: Iterable[FD]) -> bool:
    return columns(rhs) <= closure(lhs, fds)


def rename_set(cols: Iterable[str], names: Mapping[str, str]) -> Columns:
    return frozenset(names.get(c, c) for c in cols)


# Grain of a join -------------------------------------------------------------

@dataclass(frozen=True)
class JoinGrain:
    """Both candidate keys of an inner equi-join and the one preferred."""

    f1: Columns
    f2: Columns
    relation: str
    grain: Columns

    @property
    def alternative(self) -> Columns | None:
        """The other candidate, when it is irreducible too."""
        if self.relation != INCOMPARABLE:
            return None
        return self.f2 if self.grain == self.f1 else self.f1


def key_relation(g1: Iterable[str], g2: Iterable[str], jk: Iterable[str]) -> str:
    """How the two grains compare inside the join key."""
    p1, p2 = columns(g1) & columns(jk), columns(g2) & columns(jk)
    if p1 == p2:
        return "equal"
    if p1 < p2:
        return "proper_subset"
    if p1 > p2:
        return "proper_superset"
    return INCOMPARABLE


def join_grain(g1: Iterable[str], g2: Iterable[str], jk: Iterable[str]) -> JoinGrain:
    """Grain of an inner join: one side's grain, plus what the other adds outside the key.

    Starting from the side that holds less of its grain inside the join key
    gives the smaller set; the rest of the other side's key part is redundant.
    """
    g1, g2, jk = columns(g1), columns(g2), columns(jk)
    f1, f2 = g1 | (g2 - jk), g2 | (g1 - jk)
    relation = key_relation(g1, g2, jk)
    if relation == "proper_superset":
        grain = f2
    elif relation == INCOMPARABLE and len(f2) < len(f1):
        grain = f2
    else:
        grain = f1
    return JoinGrain(f1, f2, relation, grain)


def outer_join_grain(g1: Iterable[str], g2: Iterable[str], jk: Iterable[str], how: str) -> Columns:
    """The preserved side goes first; a full join needs both grains and the key."""
    g1, g2, jk = columns(g1), columns(g2), columns(jk)
    if how == "left":
        return g1 | (g2 - jk)
    if how == "right":
        return g2 | (g1 - jk)
    if how == "full":
        return g1 | g2 | jk
    raise ValueError(f"not an outer join: {how}")


def minimal_sets(sets: Iterable[Columns]) -> tuple[Columns, ...]:
    """Drop every set that contains another one."""
    sets = set(sets)
    kept = [s for s in sets if not any(o < s for o in sets)]
    return tuple(sorted(kept, key=lambda s: (len(s), sorted(s))))


# The declaration carried by a frame ------------------------------------------

@dataclass(frozen=True)
class GrainSpec:
    """Grain, entity key, other keys, dependencies and the home grain of each measure."""

    grain: Columns
    entity_key: Columns | None = None
    alternatives: tuple[Columns, ...] = ()
    fds: tuple[FD, ...] = ()
    measures: Mapping[str, Columns] = field(default_factory=dict)
    #: Home grain of further columns where it is not the grain itself.
    homes: Mapping[str, Columns] = field(default_factory=dict)
    kind: str | None = None
    #: Columns the rows were last shuffled by, as far as known; matters for joins with frequent keys.
    clustered: Columns | None = None

    def check(self, available: Iterable[str]) -> "GrainSpec":
        available = set(available)
        needed = set(self.grain) | set(self.entity_key or ()) | set(self.measures)
        for alt in self.alternatives:
            needed |= alt
        missing = sorted(needed - available)
        if missing:
            raise MissingColumns(f"not in the table: {', '.join(missing)}")
        if self.entity_key is not None and not self.entity_key <= self.grain:
            raise GrainError(
                f"entity key {sorted(self.entity_key)} is not part of the grain {sorted(self.grain)}"
            )
        return self

    def renamed(self, names: Mapping[str, str]) -> "GrainSpec":
        return replace(
            self,
            grain=rename_set(self.grain, names),
            entity_key=None if self.entity_key is None else rename_set(self.entity_key, names),
            alternatives=tuple(rename_set(a, names) for a in self.alternatives),
            fds=tuple(fd.renamed(names) for fd in self.fds),
            measures={names.get(m, m): rename_set(h, names) for m, h in self.measures.items()},
            homes={names.get(c, c): rename_set(h, names) for c, h in self.homes.items()},
            clustered=None if self.clustered is None else rename_set(self.clustered, names),
        )

    def restricted(self, kept: Iterable[str]) -> "GrainSpec":
        """Keep what still makes sense when only ``kept`` columns remain.

        A home-grain column that goes away stays in the home under a name no
        column can have, so the measure can never look at home again.
        """
        kept = set(kept)
        gone = lambda h: frozenset(c if c in kept else f"dropped:{c}" for c in h)
        return replace(
            self,
            entity_key=self.entity_key if self.entity_key and self.entity_key <= kept else None,
            alternatives=tuple(a for a in self.alternatives if a <= kept),
            fds=tuple(FD(fd.lhs, fd.rhs & kept) for fd in self.fds if fd.lhs <= kept and fd.rhs & kept),
            measures={m: gone(h) for m, h in self.measures.items() if m in kept},
            homes={c: gone(h) for c, h in self.homes.items() if c in kept},
            clustered=self.clustered if self.clustered and self.clustered <= kept else None,
        )

    def home(self, column: str) -> Columns:
        """The grain at which a value of the column is one fact: where it was read, whatever was joined since."""
        return self.measures.get(column) or self.homes.get(column) or self.grain

    def other_homes(self, available: Iterable[str]) -> dict[str, Columns]:
        """The home of every column that is not a measure, written down before the grain changes."""
        return {c: self.home(c) for c in available if c not in self.measures}

    def all_fds(self, available: Iterable[str]) -> tuple[FD, ...]:
        """Declared dependencies plus: every key determines the whole row."""
        whole = frozenset(available)
        keys = (self.grain, *self.alternatives)
        return self.fds + tuple(FD(k, whole) for k in keys)
