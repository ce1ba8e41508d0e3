"""Ordered scans over groups of any size.

What a row's rule remembers is the last value before it in its group's order, or a sum so far: both combine from part to
part. A group with more rows than a task should hold is cut, at bounds of the whole order taken from a sample, into segments; each
segment is scanned on its own, its last value or sum is aggregated beside it, and what came before a segment is carried to it. A
hot group thus takes many tasks, and a group that isn't cut costs what a window costs.

The bounds of all groups together are ``MOST`` at most, so the tables of bounds and of what is carried may be broadcast whatever the
input's size. They are taken once and are constants of the plan: a task that runs again finds the same segments. Rows equal in
all order columns fall into one segment.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows above which a group is cut, and about so many a segment has.
ROWS = 1_000_000
#: Segments of all groups together: beyond ROWS * MOST rows segments grow instead.
MOST = 4096
#: Sampled rows a segment that bounds are taken from.
SAMPLED = 32
#: The segment of rows whose group isn't cut.
WHOLE = -1


def joined(df: DataFrame, small: DataFrame, on: list[str]) -> DataFrame:
    """``df`` with what ``small``, a table of proven bound, has for its row of equal ``on``, nulls equal too; null where it has none."""
    other = small.select(*[F.col(c).alias(f"_on{i}") for i, c in enumerate(on)], *[c for c in small.columns if c not in on])
    same = [F.col(c).eqNullSafe(F.col(f"_on{i}")) for i, c in enumerate(on)]
    return df.join(F.broadcast(other), same, "left").drop(*[f"_on{i}" for i in range(len(on))])


@dataclass(frozen=True)
class Cuts:
    """Where large groups are cut: of each ``by`` its sorted bounds (structs of ``order``), with the powers of two up to their number, falling."""

    by: list[str]
    order: list[str]
    table: DataFrame | None

    def rows(self, df: DataFrame) -> DataFrame:
        """``df``, or any part of it, with _segment."""
        if self.table is None:
            return df.withColumn("_segment", F.lit(WHOLE))
        key, bounds = F.struct(*self.order), F.col("_bounds")
        # the number of bounds up to the key, power of two by power of two; beyond the last bound there is null
        place = F.aggregate("_powers", F.lit(0), lambda n, p: n + F.when(F.get(bounds, n + p - 1) <= key, p).otherwise(0))
        rows = joined(df, self.table, self.by)
        return rows.withColumn("_segment", F.when(bounds.isNull(), WHOLE).otherwise(place)).drop("_bounds", "_powers")


def cuts_of(df: DataFrame, by: list[str], order: list[str], rows: int = ROWS) -> Cuts:
    """The cuts of groups of more than ``rows`` rows. Groups are counted, with map-side sums; only if some are too large, their order is sampled."""
    sizes = df.groupBy(*by).agg(F.count("*").alias("_n"))
    total, largest = sizes.agg(F.sum("_n"), F.max("_n")).head()
    if not largest or largest <= rows:
        return Cuts(by, order, None)
    most = max(rows, math.ceil(total / MOST))
    hot = df.sparkSession.createDataFrame(sizes.where(F.col("_n") > most).toArrow())  # total / most rows at most
    if not hot.head(1):
        return Cuts(by, order, None)
    taken = joined(df.select(*by, *[c for c in order if c not in by]), hot, by).where("_n is not null")
    taken = taken.sample(min(1.0, SAMPLED / most), seed=17)
    some = taken.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*order))).alias("_all"), F.max("_n").alias("_n"))  # SAMPLED rows a segment
    parts = F.greatest(F.lit(1), F.least(F.ceil(F.col("_n") / most), F.size("_all"))).cast("int")
    inner = F.filter(F.sequence(F.lit(0), parts), lambda i: (i > 0) & (i < parts))
    bounds = F.array_distinct(F.transform(inner, lambda i: F.get(F.col("_all"), F.floor(i * F.size("_all") / parts).cast("int"))))
    powers = F.transform(F.sequence(F.floor(F.log2(F.size("_bounds"))).cast("int"), F.lit(0), F.lit(-1)), lambda i: F.call_function("shiftleft", F.lit(1), i))
    table = some.select(*by, bounds.alias("_bounds")).where(F.size("_bounds") > 0).withColumn("_powers", powers)
    return Cuts(by, order, df.sparkSession.createDataFrame(table.toArrow()))


@dataclass(frozen=True)
class Scan:
    """Rows with _segment, scanned by ``by`` in ``order``. ``cuts`` may be those of a coarser grouping."""

    rows: DataFrame
    by: list[str]
    order: list[str]
    cut: bool

    @classmethod
    def of(cls, df: DataFrame, by: list[str], order: list[str], rows: int = ROWS, cuts: Cuts | None = None) -> Scan:
        cuts = cuts or cuts_of(df, by, order, rows)
        return cls(cuts.rows(df), by, order, cuts.table is not None)

    def _over(self) -> Window:
        return Window.partitionBy(*self.by, "_segment").orderBy(*self.order)

    def _carried(self, rows: DataFrame, end: Column, over: Column) -> DataFrame:
        """``rows`` with _carry: ``over`` (a column of _end, what ``end`` aggregates of each segment) over all earlier segments of the group."""
        ends = rows.where(F.col("_segment") != WHOLE).groupBy(*self.by, "_segment").agg(end.alias("_end"))
        before = Window.partitionBy(*self.by).orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
        return joined(rows, ends.select(*self.by, "_segment", over.over(before).alias("_carry")), [*self.by, "_segment"])

    def with_last(self, name: str, value: Column) -> Scan:
        """With ``name``: the last ``value`` before the row that isn't null."""
        rows = self.rows.withColumn("_value", value)
        inside = F.last("_value", ignorenulls=True).over(self._over().rowsBetween(Window.unboundedPreceding, -1))
        if not self.cut:
            return Scan(rows.withColumn(name, inside).drop("_value"), self.by, self.order, False)
        end = F.max(F.when(F.col("_value").isNotNull(), F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(self.order)], "_value")))
        rows = self._carried(rows, end, F.last("_end._value", ignorenulls=True))
        return Scan(rows.withColumn(name, F.coalesce(inside, "_carry")).drop("_value", "_carry"), self.by, self.order, True)

    def with_sum(self, name: str, value: Column) -> Scan:
        """With ``name``: the sum of ``value`` up to and with the row."""
        rows = self.rows.withColumn("_value", value)
        inside = F.sum("_value").over(self._over().rowsBetween(Window.unboundedPreceding, 0))
        if not self.cut:
            return Scan(rows.withColumn(name, inside).drop("_value"), self.by, self.order, False)
        rows = self._carried(rows, F.sum("_value"), F.sum("_end"))
        kind = rows.select(inside.alias("x")).schema["x"].dataType
        return Scan(rows.withColumn(name, (inside + F.coalesce("_carry", F.lit(0))).cast(kind)).drop("_value", "_carry"), self.by, self.order, True)

    def done(self) -> DataFrame:
        return self.rows.drop("_segment")
