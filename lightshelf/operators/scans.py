"""Order-bound columns within groups of which one may hold most rows: two passes over parts of a group's order.

Groups above `rows` rows are cut into parts along their order at approximate
quantiles, so that a part is a plain function of the row and nothing need be
written.  Windows run within parts.  What they must know of the parts before or
after, such as a last anchor, the row before or a running count, is aggregated for
each part of a large group, handed on over the parts (few rows for each group), and
sent to all tasks: there are no more parts than rows / `rows`, times a small factor.

If no group is large, windows run by group and nothing is handed on.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from lightshelf.operators.lineage import written

#: Rows up to which a group is one part.
PART_ROWS = 1 << 20
#: Relative error of the quantiles, as its inverse.
ACCURACY = 10_000


@dataclass
class Parts:
    """Rows with the number `_part` of their part; `order` begins with the column along which groups are cut."""

    rows: DataFrame
    by: list[str]
    order: list[str]
    cut: bool

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.by, *(["_part"] if self.cut else [])).orderBy(*self.order)

    def place(self) -> Column:
        """A row's place in the order of its group, to be compared only."""
        return F.struct(*self.order)

    def with_rows(self, rows: DataFrame) -> Parts:
        return Parts(rows, self.by, self.order, self.cut)

    def carried(self, before: dict[str, tuple[str, Column]] | None = None, after: dict[str, tuple[str, Column]] | None = None) -> Parts:
        """Columns with what the parts before and after hold: for each name how values merge ("max", "min" or "sum") and their aggregate in a part."""
        wanted = {**(before or {}), **(after or {})}
        if not self.cut:
            kinds = {f.name: f.dataType for f in self.rows.agg(*[c.alias(n) for n, (_, c) in wanted.items()]).schema}
            return self.with_rows(self.rows.withColumns({n: F.lit(None).cast(k) for n, k in kinds.items()}))
        each = self.rows.where("_large").groupBy(*self.by, "_part").agg(*[c.alias(n) for n, (_, c) in wanted.items()])
        over = Window.partitionBy(*self.by).orderBy("_part")
        frames = {n: over.rowsBetween(Window.unboundedPreceding, -1) for n in before or {}} | {n: over.rowsBetween(1, Window.unboundedFollowing) for n in after or {}}
        handed = each.select(*[F.col(c).alias(f"_{c}_") for c in self.by], F.col("_part").alias("_part_"), *[getattr(F, how)(n).over(frames[n]).alias(n) for n, (how, _) in wanted.items()])
        handed = written(handed)  # a row for each part
        same = [F.col(c).eqNullSafe(F.col(f"_{c}_")) for c in self.by] + [F.col("_part") == F.col("_part_")]
        joined = self.rows.join(F.broadcast(handed), same, "left")
        return self.with_rows(joined.drop("_part_", *[f"_{c}_" for c in self.by]))

    def done(self) -> DataFrame:
        return self.rows.drop("_part", "_large")


def in_parts(df: DataFrame, by: list[str], order: list[str], along: Column | None = None, rows: int | None = None) -> Parts:
    """`df` cut along the number `along` (the first column of `order`, if none is given), which must not fall where the order goes on.

    Rows without that number lie in the first part, so the order should have nulls first.
    """
    most = rows or PART_ROWS
    counts = df.groupBy(*by).agg(F.count("*").alias("_n"))
    largest = counts.agg(F.max("_n")).first()[0]
    if (largest or 0) <= most:
        return Parts(df.withColumn("_part", F.lit(0)).withColumn("_large", F.lit(False)), by, order, False)
    large = written(counts.where(F.col("_n") > most))  # no more than rows / most
    along = F.col(order[0]) if along is None else along
    n = -(-2 * largest // most)
    named = large.select(*[F.col(c).alias(f"_{c}_") for c in by])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}_")) for c in by]
    quantiles = df.withColumn("_along", along).join(F.broadcast(named), same).groupBy(*[f"_{c}_" for c in by])
    bounds = written(quantiles.agg(F.array_distinct(F.percentile_approx("_along", F.array(*[F.lit(i / n) for i in range(1, n)]), ACCURACY)).alias("_bounds")))
    placed = df.withColumn("_along", along).join(F.broadcast(bounds), same, "left")  # a row for each large group
    part = F.coalesce(F.size(F.filter("_bounds", lambda b: b <= F.col("_along"))), F.lit(0))
    flagged = placed.withColumn("_part", F.when(F.col("_bounds").isNull() | F.col("_along").isNull(), 0).otherwise(part)).withColumn("_large", F.col("_bounds").isNotNull())
    return Parts(flagged.drop("_along", "_bounds", *[f"_{c}_" for c in by]), by, order, True)


def last_before(parts: Parts, value: Column, name: str) -> Parts:
    """The last value that is not null of the rows before, in the order of the group."""
    held = F.max(F.when(value.isNotNull(), F.struct(parts.place().alias("at"), value.alias("v"))))
    found = parts.carried(before={"_c": ("max", held)})
    own = F.last(value, ignorenulls=True).over(found.window().rowsBetween(Window.unboundedPreceding, -1))
    return found.with_rows(found.rows.withColumn(name, F.coalesce(own, F.col("_c.v"))).drop("_c"))


def first_after(parts: Parts, value: Column, name: str) -> Parts:
    """The first value that is not null of the rows after, in the order of the group."""
    held = F.min(F.when(value.isNotNull(), F.struct(parts.place().alias("at"), value.alias("v"))))
    found = parts.carried(after={"_c": ("min", held)})
    own = F.first(value, ignorenulls=True).over(found.window().rowsBetween(1, Window.unboundedFollowing))
    return found.with_rows(found.rows.withColumn(name, F.coalesce(own, F.col("_c.v"))).drop("_c"))


def running_sum(parts: Parts, value: Column, name: str) -> Parts:
    """Sum of the values up to each row, its own included."""
    found = parts.with_rows(parts.rows.withColumn("_v", value)).carried(before={"_c": ("sum", F.sum("_v"))})
    own = F.sum("_v").over(found.window().rowsBetween(Window.unboundedPreceding, 0))
    return found.with_rows(found.rows.withColumn(name, own + F.coalesce("_c", F.lit(0))).drop("_c", "_v"))


def group_total(parts: Parts, value: Column, name: str) -> Parts:
    """Sum of the values of the whole group."""
    found = parts.with_rows(parts.rows.withColumn("_v", value)).carried(before={"_b": ("sum", F.sum("_v"))}, after={"_a": ("sum", F.sum("_v"))})
    own = F.sum("_v").over(found.window().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return found.with_rows(found.rows.withColumn(name, own + F.coalesce("_b", F.lit(0)) + F.coalesce("_a", F.lit(0))).drop("_a", "_b", "_v"))


def row_numbers(df: DataFrame, by: list[str], order: list[str], name: str = "rn", along: Column | None = None, rows: int | None = None) -> DataFrame:
    """Place of each row in its group, from 1."""
    return running_sum(in_parts(df, by, order, along, rows), F.lit(1), name).done()
