"""Units of a declared dataflow: lineage, the two-stage split around some models, execution on a DataFrame.

A unit names the columns it reads and writes and the models it needs.  The graph
is small and lives on the driver; the data side of a split is a parquet stage.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import cycle

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Unit:
    name: str
    reads: tuple[str, ...] = ()
    writes: tuple[str, ...] = ()
    models: tuple[str, ...] = ()
    run: Callable[[DataFrame], DataFrame] | None = field(default=None, compare=False)


def edges(units: list[Unit]) -> set[tuple[int, int]]:
    """(producer, consumer): a consumer hangs on the last earlier writer of each column it reads."""
    writer: dict[str, int] = {}
    out = set()
    for k, u in enumerate(units):
        out |= {(writer[c], k) for c in u.reads if c in writer}
        writer |= dict.fromkeys(u.writes, k)
    return out


def writers(units: list[Unit]) -> dict[str, list[int]]:
    out: dict[str, list[int]] = defaultdict(list)
    for k, u in enumerate(units):
        for c in u.writes:
            out[c].append(k)
    return dict(out)


def reach(links: set[tuple[int, int]], start: set[int], forward: bool = True) -> set[int]:
    """Everything downstream (or upstream) of the start."""
    step = defaultdict(set)
    for a, b in links:
        step[a if forward else b].add(b if forward else a)
    seen, todo = set(start), list(start)
    while todo:
        for k in step[todo.pop()] - seen:
            seen.add(k)
            todo.append(k)
    return seen


def depends(units: list[Unit], models: set[str]) -> set[int]:
    """The least set of units that holds every unit which

    * needs one of the models,
    * reads a column that a unit of the set wrote last before it, or
    * writes anew a column whose first reader in the set changed it.
    """
    wrote_last: list[dict[str, int]] = []
    so_far: dict[str, int] = {}
    for k, u in enumerate(units):
        wrote_last.append({c: so_far[c] for c in u.reads if c in so_far})
        so_far |= dict.fromkeys(u.writes, k)

    def follows(k: int, inside: set[int]) -> bool:
        return bool(models & set(units[k].models)) or not inside.isdisjoint(wrote_last[k].values())

    def changes(k: int, inside: set[int]) -> bool:
        readers = {c: min((j for j in inside if c in units[j].reads), default=k) for c in units[k].writes}
        return any(j < k and c in units[j].writes for c, j in readers.items())

    inside: set[int] = set()
    for rule in cycle((follows, changes)):  # a column's first reader is known once all followers are
        grown = inside
        while more := {k for k in range(len(units)) if k not in grown and rule(k, grown)}:
            grown = grown | more
            if rule is changes:
                break
        if grown == inside and rule is changes:
            return inside
        inside = grown
    return inside


def split(units: list[Unit], models: set[str]) -> tuple[list[Unit], list[Unit]]:
    """(units that depend on the models, units whose result can be cached), each in order."""
    inside = depends(units, models)
    return [u for k, u in enumerate(units) if k in inside], [u for k, u in enumerate(units) if k not in inside]


def needed_columns(stage: list[Unit], later: list[Unit], available: list[str]) -> list[str]:
    """Columns a cached stage must keep: those a later unit reads before any later unit writes them."""
    made: set[str] = set()
    need: set[str] = set()
    for u in later:
        need |= set(u.reads) - made
        made |= set(u.writes)
    return [c for c in available if c in need]


def execute(df: DataFrame, units: list[Unit]) -> DataFrame:
    for u in units:
        missing = [c for c in u.reads if c not in df.columns]
        if missing:
            raise ValueError(f"unit {u.name} lacks {missing}")
        df = u.run(df) if u.run else df
    return df
