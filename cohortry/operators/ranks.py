"""Order statistics without a one-task sort: running totals, exact quantiles by selection, ranks and positions.

A window over a whole table would pull it into one task. Instead the ordering column is cut into ranges whose limits
are plain numbers found beforehand, so every branch of a plan, every retry and every lost executor agrees on them.
Rows are ordered inside their range only, and each range starts from the total of the ranges before it. That table of
totals has one row per range. Equal values are counted together before they are ordered, so one value shared by most
rows is a single row by then.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortry.session import range_count
from cohortry.sources.scratch import keep


def numeric_limits(df: DataFrame, columns: Sequence[str], width: int | None = None) -> dict[str, list[float]]:
    """Range limits for numeric columns, one pass for all of them; by default as many ranges as the rows call for."""
    width = width or range_count(df.sparkSession, df.count())
    steps = [i / width for i in range(1, width)]
    found = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).approxQuantile(
        list(columns), steps, 1.0 / (4 * width)
    )
    return {c: sorted({float(x) for x in limits}) for c, limits in zip(columns, found)}


def key_limits(df: DataFrame, column: str) -> list:
    """Range limits for a unique key of any orderable type: the keys of an evenly hashed thin slice.

    The slice holds about one key per range whatever the table's size. It only places the limits; every row is still
    processed.
    """
    rows = df.count()
    width = range_count(df.sparkSession, rows)
    every = max(1, rows // width)
    slice_ = df.select(column).filter(F.pmod(F.xxhash64(column), F.lit(every)) == 0).distinct()
    return sorted(r[0] for r in slice_.collect())


def _limit_array(limits: Sequence) -> Column:
    """The limits as one array literal. Numbers go over as text in one piece, which is much faster for hundreds."""
    if all(isinstance(x, float) for x in limits):
        return F.expr(f"array({', '.join(f'{x!r}D' for x in limits)})").cast("array<double>")
    return F.array(*[F.lit(x) for x in limits])


def _halvings(limits: int) -> list[int]:
    """The strides of a binary search among so many limits."""
    return [1 << i for i in reversed(range(limits.bit_length()))]


def _limits_below(limits: Column, most: int, value: Column) -> Column:
    """How many of the ascending limits are below a value, by halving. None for null."""
    strides = F.array(*[F.lit(s) for s in _halvings(most)])
    found = F.aggregate(strides, F.lit(0), lambda at, s: F.when(F.get(limits, at + s - 1) < value, at + s).otherwise(at))
    return F.coalesce(found, F.lit(0))  # never null, or joins by range would filter one side and share no exchange


def range_of(value: Column, limits: Sequence) -> Column:
    """Index of the range a value falls in. Equal values always share a range."""
    if not limits:
        return F.lit(0)
    return _limits_below(_limit_array(limits), len(limits), value)


def stack(df: DataFrame, names: Sequence[str], keep: Sequence[str | Column] = ()) -> DataFrame:
    """One row per known value: ``feature`` (index into ``names``), ``value`` and the kept columns."""
    entries = [
        F.struct(F.lit(i).alias("feature"), F.col(n).cast("double").alias("value")) for i, n in enumerate(names)
    ]
    return df.select(*keep, F.inline(F.array(*entries))).filter(F.col("value").isNotNull())


def stacked_range(limits: dict[str, list[float]], names: Sequence[str]) -> Column:
    """Range index of stacked values, by the limits of their own feature."""
    most = max((len(limits[n]) for n in names), default=0)
    if not most:
        return F.lit(0)
    table = F.array(*[_limit_array(limits[n]) for n in names])
    return _limits_below(F.element_at(table, F.col("feature") + 1), most, F.col("value"))


def running_totals(
    counts: DataFrame,
    keys: Sequence[str],
    order: str,
    measures: Sequence[str],
    bucket: Column,
    following: bool = False,
) -> DataFrame:
    """Add ``<measure>_before`` (sum over smaller rows of the same keys) and ``<measure>_all`` (sum over all of them).

    ``counts`` must hold distinct (keys, order) rows; ``bucket`` must grow with ``order``. With ``following``, the
    next larger value of the same keys is added as ``<order>_next`` and its measures as ``<measure>_next``, null for the largest.
    The row after the last one of a range is the first one of the next range that has any, so each range also sends its first row.
    """
    keys = list(keys)
    placed = counts.withColumn("_range", bucket)
    by_range = Window.partitionBy(*keys).orderBy("_range")
    earlier = by_range.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(*keys)
    row = F.struct(F.col(order).alias("order"), *measures)
    starts = (
        placed.groupBy(*keys, "_range")
        .agg(*([F.min(row).alias("_first")] if following else []), *[F.sum(m).alias(m) for m in measures])
        .select(
            *keys,
            "_range",
            *([F.lead("_first").over(by_range).alias("_next_first")] if following else []),
            *[F.coalesce(F.sum(m).over(earlier), F.lit(0)).alias(f"_{m}_start") for m in measures],
            *[F.sum(m).over(everything).alias(f"{m}_all") for m in measures],
        )
    )
    in_order = Window.partitionBy(*keys, "_range").orderBy(order)
    inside = in_order.rowsBetween(Window.unboundedPreceding, -1)
    local = placed.select(
        "*",
        *[F.coalesce(F.sum(m).over(inside), F.lit(0)).alias(f"_{m}_in") for m in measures],
        *([F.lead(row).over(in_order).alias("_next")] if following else []),
    )
    after = F.coalesce("_next", "_next_first") if following else None
    return local.join(starts, [*keys, "_range"]).select(
        *counts.columns,
        *[(F.col(f"_{m}_start") + F.col(f"_{m}_in")).alias(f"{m}_before") for m in measures],
        *[f"{m}_all" for m in measures],
        *([after["order"].alias(f"{order}_next"), *[after[m].alias(f"{m}_next") for m in measures]] if following else []),
    )


def value_positions(df: DataFrame, keys: Sequence[str], value: str, limits: Sequence | None = None) -> DataFrame:
    """Distinct values per key with ``n``, ``n_before`` and ``n_all``. Null keys and values take no part."""
    keys = list(keys)
    known = df.dropna(subset=[*keys, value])
    if limits is None:
        limits = numeric_limits(known, [value])[value]
    counts = known.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return running_totals(counts, keys, value, ["n"], range_of(F.col(value), limits))


def average_rank(before: Column, ties: Column) -> Column:
    return before + (ties + 1) / 2


def beside(rows: DataFrame, groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with the columns of their group's row in a kept table; without keys, of its only row.

    The files tell Spark how large the table is, so few groups are broadcast and many are joined by a shuffle, without a hint.
    """
    if keys:
        return rows.join(groups, list(keys))
    only = groups.select(F.struct("*")).scalar()
    return rows.select("*", *[only[c].alias(c) for c in groups.columns])


def bracketed_rows(known: DataFrame, brackets: DataFrame, keys: Sequence[str], value: str, shares: int) -> DataFrame:
    """The rows inside a bracket, once for each bracket they are in. An end that is null is open."""
    x = F.col(value)
    inside = [F.coalesce(x >= F.col(f"_low{i}"), F.lit(True)) & F.coalesce(x <= F.col(f"_high{i}"), F.lit(True)) for i in range(shares)]
    entry = [F.when(c, F.struct(F.lit(i).alias("_share"), F.col(f"_below{i}").alias("_below"))) for i, c in enumerate(inside)]
    return beside(known, brackets, keys).filter(reduce(or_, inside)).select(*keys, value, "n", F.inline(F.array_compact(F.array(*entry))))


ACCURACY = 10_000  # a bracket reaches over about 4 of so many rows of its group


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact quantiles per group, interpolated between neighbours, by selection: ``keys, n`` and a column a share. Nulls take no part.

    A sketch brackets each quantile between two values of the group; one more pass counts the rows below and inside. Only the values
    inside a bracket, about 4 rows in ``ACCURACY``, are counted by value, shuffled and put in order. A bracket that does not hold its
    quantile's place, whatever the reason, is opened to the whole group, so the result never rests on the sketch. Per group
    the plan moves a few numbers; the result is kept, one row a group. Without keys an empty table gives one row of nulls.
    """
    keys, names = list(keys), list(shares)
    known = df.dropna(subset=[*keys, value]).select(*keys, value)
    steps = [x for s in shares.values() for x in (max(0.0, s - 2 / ACCURACY), min(1.0, s + 2 / ACCURACY))]
    sketch = keep(known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(value, steps, ACCURACY).alias("_q")))
    x, lows, highs = F.col(value), [F.get("_q", F.lit(2 * i)) for i in range(len(names))], [F.get("_q", F.lit(2 * i + 1)) for i in range(len(names))]
    counts = beside(known, sketch, keys).groupBy(*keys).agg(
        F.max("n").alias("n"),
        *[F.max(low).alias(f"_low{i}") for i, low in enumerate(lows)],
        *[F.max(high).alias(f"_high{i}") for i, high in enumerate(highs)],
        *[F.count_if(x < low).alias(f"_below{i}") for i, low in enumerate(lows)],
        *[F.count_if(x <= high).alias(f"_through{i}") for i, high in enumerate(highs)],
    )

    def place(i: int) -> Column:
        return F.lit(shares[names[i]]) * (F.col("n") - 1)

    def held(i: int) -> Column:
        return (F.col(f"_below{i}") <= F.floor(place(i))) & (F.col(f"_through{i}") > F.ceil(place(i)))

    brackets = keep(
        counts.select(
            *keys, "n",
            *[F.when(held(i), F.col(f"_{end}{i}")).alias(f"_{end}{i}") for i in range(len(names)) for end in ("low", "high")],
            *[F.when(held(i), F.col(f"_below{i}")).otherwise(F.lit(0)).alias(f"_below{i}") for i in range(len(names))],
        )
    )
    near = bracketed_rows(known, brackets, keys, value, len(names))
    counted = near.groupBy(*keys, "_share", value).agg(F.count(F.lit(1)).alias("_rows"), F.max("n").alias("n"), F.max("_below").alias("_below"))
    earlier = Window.partitionBy(*keys, "_share").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("_before", F.col("_below") + F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))

    def at(i: int, index: Column) -> Column:
        here = (F.col("_share") == i) & (F.col("_before") <= index) & (index < F.col("_before") + F.col("_rows"))
        return F.max(F.when(here, x))

    rows = placed.groupBy(*keys).agg(
        F.max("n").alias("n"),
        *[at(i, F.floor(place(i))).alias(f"_lo{i}") for i in range(len(names))],
        *[at(i, F.ceil(place(i))).alias(f"_hi{i}") for i in range(len(names))],
    )

    def between(i: int) -> Column:
        low, high = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        return (low + (high - low) * (place(i) - F.floor(place(i)))).alias(names[i])

    return keep(rows.select(*keys, "n", *[between(i) for i in range(len(names))]))
