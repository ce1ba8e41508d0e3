"""Rules: boolean Spark SQL expressions over a sample, with helpers that remember earlier samples.

A rule that gives null is a rule error, never a match. Stateful helpers are window columns over an explicit order, for keys of
moderate size, or ordered calls, whose groups may be of any size.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sampletide.functions.segments import ROWS, Cuts, Scan, cuts_of

#: Helpers that remember; stream rules may not use them, event rules may.
STATEFUL = ("sequence", "complete")


def check_rule(df: DataFrame, rule: str, schema: T.StructType | None = None) -> Column:
    """The rule as a column; it must be boolean over ``df``, whose columns must be ``schema`` if one is given."""
    if schema is not None and df.schema != schema:
        raise ValueError("the samples have another schema than the rule was made for")
    kind = df.select(F.expr(rule).alias("rule")).schema["rule"].dataType
    if not isinstance(kind, T.BooleanType):
        raise ValueError(f"a rule must be boolean, this one is {kind.simpleString()}: {rule}")
    return F.expr(rule)


def is_static(df: DataFrame, rule: str) -> bool:
    """Whether the rule needs no sample: the optimizer turns it into a constant."""
    plan = df.select(F.expr(rule).alias("rule"))._jdf.queryExecution().optimizedPlan().toString()
    return any(f"[{x} AS rule" in plan for x in ("true", "false"))


def over(by: list[str], order: list[str]):
    return Window.partitionBy(*by).orderBy(*order)


def sequence(value: Column, direction: str, by: list[str], order: list[str], reached: Column | None = None) -> Column:
    """Whether ``value`` keeps the order of the last one before it: first true, equal allowed, null stays null.

    Numbers and text have separate states. Rows not ``reached`` are null and leave the state alone.
    """
    if direction not in ("asc", "desc"):
        raise ValueError("the order is asc or desc")
    value = value if reached is None else F.when(reached, value)
    last = F.last(value, ignorenulls=True).over(over(by, order).rowsBetween(Window.unboundedPreceding, -1))
    return F.when(value.isNotNull(), F.coalesce(value >= last if direction == "asc" else value <= last, F.lit(True)))


def complete(value: Column, step: float, by: list[str], order: list[str], reached: Column | None = None) -> Column:
    """Whether ``value`` is the last one plus ``step``: first true, a gap is false once, null stays null."""
    value = value if reached is None else F.when(reached, value)
    last = F.last(value, ignorenulls=True).over(over(by, order).rowsBetween(Window.unboundedPreceding, -1))
    return F.when(value.isNotNull(), F.coalesce(value == last + F.lit(step), F.lit(True)))


@dataclass(frozen=True)
class Ordered:
    """A stateful call over groups of any size: what ``sequence`` (kind asc or desc) or ``complete`` says, by a scan that spreads over tasks.

    It is asked, and remembers, only where ``reached`` is true and the earlier calls named in ``after`` have said so.
    """

    kind: str
    value: Column
    by: list[str]
    order: list[str]
    step: float = 1
    reached: Column | None = None
    rows: int = ROWS
    after: tuple[str, ...] = ()

    def on(self, scan: Scan, name: str) -> Scan:
        """``scan`` with the answer as column ``name``; it must be by the call's columns."""
        if self.kind not in ("asc", "desc", "complete"):
            raise ValueError("the kind is asc, desc or complete")
        value = self.value
        for condition in ([] if self.reached is None else [self.reached]) + [F.col(c) for c in self.after]:
            value = F.when(condition, value)
        scan = scan.with_last("_last", value)
        last = F.col("_last")
        answer = {"asc": value >= last, "desc": value <= last, "complete": value == last + F.lit(self.step)}[self.kind]
        rows = scan.rows.withColumn(name, F.when(value.isNotNull(), F.coalesce(answer, F.lit(True)))).drop("_last")
        return Scan(rows, scan.by, scan.order, scan.cut)


#: Lots that the keys of a group are dealt to when its first ones are looked for.
LOTS = 64


def admitted_keys(df: DataFrame, by: list[str], key: str, order: list[str], most: int) -> DataFrame:
    """With admitted: false for keys first seen after ``most`` others of the group (0: no bound). A null key is a key, a null in ``by`` a group.

    The first ``most`` of each lot of a group's keys are taken before those of all lots, so no task gets more than ``LOTS * most`` of a group.
    """
    if most == 0:
        return df.withColumn("admitted", F.lit(True))
    first = df.groupBy(*by, key).agg(F.min(F.struct(*order)).alias("_first")).withColumn("_lot", F.pmod(F.xxhash64(key), F.lit(LOTS)))
    for group in ([*by, "_lot"], by):
        rank = F.row_number().over(Window.partitionBy(*group).orderBy("_first", key))
        first = first.withColumn("_rank", rank).where(F.col("_rank") <= most)
    names = [*by, key]
    chosen = first.select(*[F.col(c).alias(f"_on{i}") for i, c in enumerate(names)], F.lit(True).alias("admitted"))
    rows = df.join(chosen, [F.col(c).eqNullSafe(F.col(f"_on{i}")) for i, c in enumerate(names)], "left")
    return rows.drop(*[f"_on{i}" for i in range(len(names))]).withColumn("admitted", F.coalesce("admitted", F.lit(False)))


def key_epochs(df: DataFrame, by: list[str], order: list[str], ttl: str, rows: int = ROWS) -> DataFrame:
    """With epoch: it grows when a key was idle longer than ``ttl``, so state grouped by it starts anew. A key's rows are spread as by ``Scan``."""
    scan = Scan.of(df, by, order, rows).with_last("_before", F.col(order[0]))
    idle = F.col(order[0]) - F.col("_before") > F.expr(f"interval {ttl}")
    return scan.with_sum("epoch", F.coalesce(idle, F.lit(False)).cast("int")).done().drop("_before")


@dataclass(frozen=True)
class Rule:
    """A SQL expression over sample columns and the named helpers, which are columns or ordered calls made beforehand, each of what the earlier ones gave."""

    expression: str
    helpers: dict[str, Column | Ordered] = field(default_factory=dict)

    def column(self, df: DataFrame, name: str = "matched") -> DataFrame:
        known: dict[tuple, Cuts] = {}  # calls of one grouping and order share their cuts
        for helper, value in self.helpers.items():
            if isinstance(value, Ordered):
                place = (*value.by, None, *value.order, value.rows)
                known[place] = known.get(place) or cuts_of(df, value.by, value.order, value.rows)
                df = value.on(Scan.of(df, value.by, value.order, cuts=known[place]), helper).done()
            else:
                df = df.withColumn(helper, value)
        return df.withColumn(name, check_rule(df, self.expression)).drop(*self.helpers)


def field_of(sample: Column, path: str, kind: str = "double") -> Column:
    """A field of a VARIANT sample if it has that kind of value there; no text is read as a number."""
    value = F.try_variant_get(sample, path, "variant")
    names = {"double": "BIGINT|DOUBLE|DECIMAL.*|FLOAT", "string": "STRING", "boolean": "BOOLEAN"}[kind]
    return F.when(F.schema_of_variant(value).rlike(f"^({names})$"), F.try_variant_get(sample, path, kind))


def late(ts: Column, as_of: Column, allowed: str) -> Column:
    return as_of - ts > F.expr(f"interval {allowed}")
