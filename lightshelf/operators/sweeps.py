"""Sweeps that go on from where they stood: each stage has a mark, the version of the table up to which it has seen the rows.

A stage reads the rows written since its mark (buckets that nothing has touched
are not opened), those that share its key with them if what it does depends on
others of the key, or all if it depends on all; without new rows it does nothing.  It yields rows that
differ, or keys that go.  They are written with the stage's new mark in one step, so
that a sweep that is broken off goes on with the stage that failed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lightshelf.operators.lineage import written
from lightshelf.operators.upkeep import ordered
from lightshelf.sources.tables import CHANGED, BucketedTable


@dataclass(frozen=True)
class SweepStage:
    """`change` gives from the rows in scope those that are to be written; with `removes`, those whose keys go."""

    name: str
    change: Callable[[DataFrame], DataFrame]
    scope: str | None = None  # a column whose rows belong together, or "*" for all
    removes: bool = False
    after: tuple[str, ...] = ()


def in_scope(table: BucketedTable, stage: SweepStage, mark: int) -> DataFrame | None:
    """The rows that a stage looks at after its mark, None if there is nothing new."""
    new = table.since(mark)
    if stage.scope is None or new.isEmpty():
        return new if stage.scope is None else None
    if stage.scope == "*":
        return table.read()
    keys = new.where(F.col(stage.scope).isNotNull()).select(stage.scope).distinct()
    return table.read().join(keys, stage.scope, "left_semi")


def sweep(table: BucketedTable, stages: list[SweepStage], apply: bool = True) -> list[dict]:
    """What each stage read, and how many rows it would change or did change."""
    out = []
    for stage in ordered(stages):
        held = table.manifest()
        mark = held["marks"].get(stage.name, 0)
        rows = in_scope(table, stage, mark) if held["version"] > mark else None
        if rows is None:
            out.append({"stage": stage.name, "read": 0, "changes": 0})
            continue
        rows = rows.drop(CHANGED)
        changes = written(stage.change(rows).select(*rows.columns))
        n = changes.count()
        out.append({"stage": stage.name, "read": rows.count(), "changes": n})
        if not apply:
            continue
        marks = {stage.name: held["version"] + 1}
        if stage.removes:
            table.write(changes.select(*table.keys).distinct(), lambda old, new: old.join(new, table.keys, "left_anti"), marks)
        else:
            table.upsert(changes, marks)
    return out
