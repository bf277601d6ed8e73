"""The feature matrix at many dates from one pass over the facts.

``feature_matrix`` reads all purchases and lines for one ``as_of``; a training set wants the matrix at
hundreds of dates. Here each table is reduced once to cells, one per customer and day, and the windows
of all dates are read off the cells:

* **Cells.** The dates share a time of day, so every window of every date begins and ends on one grid
  of days. A cell is either the inside of a day (odd number) or the instant at its start (even number),
  as windows hold both of their ends. The number is arithmetic on the time: the reduction is an
  ordinary aggregate with a map-side step, and a customer with a third of all rows shrinks to its days.
* **Counts and sums** are differences of one running sum per customer: a probe row stands at the end of
  each date and before the start of each of its windows.
* **Largest values.** Time is cut into blocks as long as the window. A window begins in one block and
  ends in the next, so its maximum is the larger of a running maximum from the window's start to the end
  of the first block and one from the start of the second block to the date.
* **Distinct values.** A value counts from its cell until the window has passed or the same value comes
  again (which counts anew): plus one at the cell, minus one behind, in the same running sum.

All windows are partitioned by customer, so one exchange serves them. The work is linear in cells and
dates; a task holds a customer's cells of a partition sorted, never in an array.

A row counts at a date if its time is not after it, as the MART rule at that date decides; rows without a
time count at none. Customers are those given, at every date.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from . import features as X

DAY = timedelta(days=1)


class Grid:
    """The dates, numbered on the grid of days that their common time of day spans."""

    def __init__(self, dates: Iterable):
        got = sorted({d if isinstance(d, datetime) else datetime.fromisoformat(str(d)) for d in dates})
        if not got:
            raise ValueError("no dates")
        if len({d.time() for d in got}) > 1:
            raise ValueError("the dates must share one time of day")
        self.origin, self.dates = got[0], got

    def number(self, date: datetime) -> int:
        return 2 * ((date - self.origin) // DAY)

    def cell(self, time: Column) -> Column:
        """Twice the day, plus one inside of it: a row at the very start of a day stands on the boundary."""
        since = F.unix_micros(time) - F.unix_micros(F.lit(f"{self.origin:%Y-%m-%d %H:%M:%S.%f}").cast("timestamp"))
        day = F.lit(DAY // timedelta(microseconds=1))
        return F.floor(since / day) * 2 + (F.pmod(since, day) != 0).cast("long")

    def column(self) -> Column:
        """The dates as an array of (as_of, date number)."""
        return F.array(*[F.struct(F.lit(f"{d:%Y-%m-%d %H:%M:%S.%f}").cast("timestamp").alias("as_of"),
                                  F.lit(self.number(d)).cast("long").alias("until")) for d in self.dates])


def _cells(rows: DataFrame, measures, grid: Grid) -> DataFrame:
    """One row per customer, cell and value of a distinct measure: its count and, by column, the sum, the
    number of values and the maximum."""
    keys = sorted({m.of for m in measures if m.reduce == "distinct"})
    sums = sorted({m.of for m in measures if m.reduce in ("share", "mean", "any")})
    tops = sorted({m.of for m in measures if m.reduce == "max"})
    at = rows.withColumn("at", grid.cell(F.col("purchase_dt"))).where(F.col("at") <= grid.number(grid.dates[-1]))
    return at.groupBy("customer_id", "at", *keys).agg(
        F.count(F.lit(1)).alias("rows"), *[F.sum(c).alias(f"sum_{c}") for c in sums],
        *[F.count(c).alias(f"held_{c}") for c in sums], *[F.max(c).alias(f"max_{c}") for c in tops])


def _passed(cells: DataFrame, measure, days: int) -> DataFrame:
    """The rise and fall of a distinct count: up at a value's cell, down where the window has left it or
    the value comes again."""
    same = Window.partitionBy("customer_id", measure.of).orderBy("at")
    gone = F.least(F.col("at") + 2 * days + 1, F.lead("at").over(same))
    held = cells.where(F.col(measure.of).isNotNull()).groupBy("customer_id", measure.of, "at").agg(F.lit(1).alias("_")).withColumn("gone", gone)
    step = F.explode(F.array(F.struct(F.col("at").alias("at"), F.lit(1).alias("step")), F.struct(F.col("gone").alias("at"), F.lit(-1).alias("step"))))
    return held.select("customer_id", step.alias("s")).select("customer_id", "s.at", F.col("s.step").cast("long").alias(f"step_{measure.name}"))


def _maxima(cells: DataFrame, probes: DataFrame, measure, days: int) -> DataFrame:
    """(customer, as_of, maximum) over each date's window, from running maxima of two blocks."""
    width, value = 2 * days, f"max_{measure.of}"
    ends = probes.select("customer_id", "as_of", F.explode(F.array(
        F.struct((F.col("until") - width).alias("at"), F.lit("from").alias("end")),
        F.struct(F.col("until").alias("at"), F.lit("to").alias("end")))).alias("e")).select("customer_id", "as_of", "e.at", "e.end", F.lit(None).cast("double").alias("v"))
    marks = cells.select("customer_id", F.lit(None).cast("timestamp").alias("as_of"), "at", F.lit(None).cast("string").alias("end"), F.col(value).alias("v"))
    block = Window.partitionBy("customer_id", F.floor(F.col("at") / width))
    # a range frame takes in every row of the same cell, so a probe meets its own cell's values
    to = F.max("v").over(block.orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    since = F.max("v").over(block.orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    got = marks.unionByName(ends).withColumns({"_to": to, "_from": since}).where("end IS NOT NULL")
    return got.groupBy("customer_id", "as_of").agg(F.max(F.when(F.col("end") == "to", F.col("_to")).otherwise(F.col("_from"))).alias(measure.name))


def reduced_at(rows: DataFrame, customers: DataFrame, measures, grid: Grid, profile: C.FeatureProfile) -> DataFrame:
    """(customer_id, as_of) with every measure as of that date, for the given customers (unique)."""
    cells = _cells(rows, measures, grid)
    windows = sorted({m.window for m in measures if m.window and m.reduce in ("count", "any")})
    counted = [c for c in cells.columns if c == "rows" or c.startswith(("sum_", "held_"))]
    distinct = [m for m in measures if m.reduce == "distinct"]

    probes = customers.select("customer_id", F.explode(grid.column()).alias("d")).select("customer_id", "d.as_of", "d.until")

    def place(window: int, at: Column, turn: int) -> Column:
        return F.struct(F.lit(window).alias("window"), at.alias("at"), F.lit(turn).alias("turn"))

    places = F.array(place(0, F.col("until"), 1), *[place(w, F.col("until") - 2 * profile.days(w), -1) for w in windows])
    asked = probes.select("customer_id", "as_of", F.explode(places).alias("p")).select("customer_id", "as_of", "p.window", "p.at", "p.turn")
    steps = cells.select("customer_id", "at", *counted)
    for m in distinct:
        steps = steps.unionByName(_passed(cells, m, profile.days(m.window)), allowMissingColumns=True)
    running = [c for c in steps.columns if c not in ("customer_id", "at")]

    # at one place: the starts of windows, then the cells, then the ends of dates
    line = Window.partitionBy("customer_id").orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    told = steps.withColumn("turn", F.lit(0)).unionByName(asked, allowMissingColumns=True)
    told = told.withColumns({c: F.coalesce(F.sum(c).over(line), F.lit(0)) for c in running}).where("as_of IS NOT NULL")

    def until(c: str) -> Column:
        return F.max(F.when(F.col("window") == 0, F.col(c)))

    def inside(c: str, window: int | None) -> Column:
        return until(c) - F.max(F.when(F.col("window") == window, F.col(c))) if window else until(c)

    def column(m) -> Column:
        return {
            "count": lambda: inside("rows", m.window),
            "share": lambda: F.try_divide(until(f"sum_{m.of}"), until(f"held_{m.of}")),
            "mean": lambda: F.try_divide(until(f"sum_{m.of}"), until(f"held_{m.of}")),
            "any": lambda: (inside(f"sum_{m.of}", m.window) > 0).cast("int"),
            "distinct": lambda: until(f"step_{m.name}"),
        }[m.reduce]().alias(m.name)

    out = told.groupBy("customer_id", "as_of").agg(*[column(m) for m in measures if m.reduce != "max"])
    for m in measures:
        if m.reduce == "max":
            out = out.join(_maxima(cells, probes, m, profile.days(m.window)), ["customer_id", "as_of"], "left")
    return out


def feature_history(customers: DataFrame, purchases: DataFrame, products: DataFrame, items: DataFrame,
                    dates: Iterable, profile: C.FeatureProfile = C.RETAIL, inputs_final: bool = True) -> DataFrame:
    """``as_of`` and the feature matrix at each of ``dates`` (of one time of day; repeated ones count once).

    Lines that no window of any date can hold are dropped before the product join."""
    grid = Grid(dates)
    base = X.customers_base(customers, inputs_final)
    longest = max(profile.days(m.window) for m in X.ITEM_MEASURES)
    recent = items.where(F.col("purchase_dt").cast("timestamp") >= X._begin(grid.dates[0], longest))
    last = grid.dates[-1]
    bought = X.purchase_flags(purchases, last, profile, inputs_final)
    lines = X.item_flags(X.items_enriched(recent, products, inputs_final), last, profile)
    at = base.select("customer_id", F.explode(grid.column()).alias("d")).select("customer_id", "d.as_of")
    p = reduced_at(bought, base, X.PURCHASE_MEASURES, grid, profile)
    i = reduced_at(lines, base, X.ITEM_MEASURES, grid, profile)
    return X.assemble(at, p, i, profile, keys=("customer_id", "as_of"))
