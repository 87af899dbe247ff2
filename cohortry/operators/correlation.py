"""Pearson and Spearman correlation of the customer features."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.functions.columns import significance_mark
from cohortry.functions.tails import t_two_sided_of
from cohortry.operators.ranks import average_rank, numeric_limits, running_totals, stack, stacked_range

# The correlated features.
CORRELATED = [
    "frequency",
    "avg_delay_days",
    "avg_freight_ratio",
    "avg_review_score",
    "avg_payment_installments",
    "avg_order_value",
    "total_spent",
    "avg_item_count",
]
COMMON = 1000  # a value that holds more than this part of its feature's rows is common; a feature has fewer such values


def comoments(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Per pair of columns, over the rows where both are known: ``x, y, n, r``. One pass for all pairs.

    Sums of the columns and their products are taken per pattern of missing values, of which there are few however many rows; each
    pair then adds up the patterns that miss neither. So a sum serves many pairs, and the aggregate stays small enough for
    generated code. Values are taken from each column's mean, found in a pass before, which keeps the sums well conditioned; a
    constant column is taken from its value, so that its variance is exactly 0. ``r`` is null for a constant and without rows.
    """
    names = list(dict.fromkeys(n for pair in pairs for n in pair))
    number = {n: F.col(f"`{n}`").cast("double") for n in names}
    ends = df.agg(*[f(c).alias(f"{k}{i}") for i, c in enumerate(number.values()) for k, f in (("m", F.avg), ("a", F.min), ("b", F.max))]).first()
    centre = [ends[f"a{i}"] if ends[f"a{i}"] == ends[f"b{i}"] else ends[f"m{i}"] for i in range(len(names))]
    at = {n: i for i, n in enumerate(names)}
    missing = [F.when(c.isNull(), F.lit(1 << i).cast("decimal(38,0)") if i > 61 else F.lit(1 << i).cast("long")).otherwise(0) for i, c in enumerate(number.values())]
    shifted = df.select(reduce(add, missing).alias("pattern"), *[(c - F.lit(centre[i] or 0.0)).alias(f"x{i}") for i, c in enumerate(number.values())])
    products_ = sorted({(i, i) for i in range(len(names))} | {tuple(sorted((at[a], at[b]))) for a, b in pairs})
    sums = shifted.groupBy("pattern").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(f"x{i}").alias(f"s{i}") for i in range(len(names))],
        *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}_{j}") for i, j in products_],
    )

    def entry(a: str, b: str) -> Column:
        i, j = at[a], at[b]
        values = {"x": F.lit(a), "y": F.lit(b), "n": F.col("n"), "sx": F.col(f"s{i}"), "sy": F.col(f"s{j}"), "xx": F.col(f"p{i}_{i}"), "yy": F.col(f"p{j}_{j}")}
        return F.struct(*[v.alias(k) for k, v in values.items()], F.col(f"p{min(i, j)}_{max(i, j)}").alias("xy"))

    stacked = sums.select(F.inline(F.array(*[entry(a, b) for a, b in pairs])))  # a pattern that misses a column has no sums of it
    both = F.col("xy").isNotNull()
    total = stacked.groupBy("x", "y").agg(
        F.coalesce(F.sum(F.when(both, F.col("n"))), F.lit(0)).alias("n"),
        *[F.sum(F.when(both, F.col(c))).alias(c) for c in ("sx", "sy", "xx", "yy", "xy")],
    )

    def central(product_: str, a: str, b: str) -> Column:
        return F.col(product_) - F.try_divide(F.col(a) * F.col(b), F.col("n"))

    spread = F.sqrt(F.greatest(central("xx", "sx", "sx"), F.lit(0.0))) * F.sqrt(F.greatest(central("yy", "sy", "sy"), F.lit(0.0)))
    return total.select("x", "y", "n", F.try_divide(central("xy", "sx", "sy"), spread).alias("r"))


def _both_orders(pairs: DataFrame, names: Sequence[str]) -> DataFrame:
    """From ``x, y, r`` of each pair to (var_x, var_y, r) rows for both orders and the diagonal."""
    diagonal = [F.struct(F.lit(n).alias("var_x"), F.lit(n).alias("var_y"), F.lit(1.0).alias("r")) for n in names]
    ways = [F.struct(F.col(a).alias("var_x"), F.col(b).alias("var_y"), "r") for a, b in (("x", "y"), ("y", "x"))]
    return pairs.select(F.inline(F.array(*ways))).unionByName(pairs.sparkSession.range(1).select(F.inline(F.array(*diagonal))))


def pearson_matrix(df: DataFrame, names: Sequence[str] = CORRELATED) -> DataFrame:
    """All pairs in one pass, each over the rows where both values are known."""
    return _both_orders(comoments(df, list(combinations(names, 2))), names)


def pearson_target(df: DataFrame, target: str, names: Sequence[str] = CORRELATED) -> DataFrame:
    """Correlation of each feature with a target: r, number of pairs, two-sided p, mark; strongest first."""
    rows = comoments(df, [(target, n) for n in names if n != target]).select(F.col("y").alias("variable"), "r", "n")
    t = F.col("r") * F.sqrt(F.try_divide(F.col("n") - 2, 1 - F.col("r") * F.col("r")))
    return (
        rows.withColumn("p", F.when(F.abs("r") >= 1, F.lit(0.0)).otherwise(t_two_sided_of(t, F.col("n") - 2.0)))
        .withColumn("mark", significance_mark(F.col("p")))
        .orderBy(F.abs("r").desc(), "variable")
    )


def null_scopes(df: DataFrame, names: Sequence[str]) -> dict[str, str]:
    """For each feature the first one that is missing in exactly the same rows; empty for a feature that is never missing."""
    counts = [F.count_if(F.col(n).isNull()).alias(n) for n in names]
    differ = [F.count_if(F.col(a).isNull() != F.col(b).isNull()).alias(f"{a}|{b}") for a, b in combinations(names, 2)]
    row = df.agg(*counts, *differ).first()
    scopes: dict[str, str] = {}
    for i, n in enumerate(names):
        same = [m for m in names[:i] if not row[f"{m}|{n}"]]
        scopes[n] = "" if not row[n] else scopes[same[0]] if same else n
    return scopes


def _rank_name(name: str, other: str, scopes: dict[str, str]) -> str:
    """Which rank of a feature a pair uses: among the rows that know the other feature, if other rows may miss that one."""
    return f"{name}~{'' if scopes[other] == scopes[name] else scopes[other]}"


def feature_ranks(df: DataFrame, names: Sequence[str], scopes: dict[str, str], key: str) -> DataFrame:
    """Average ranks of the features, one row per key.

    ``<feature>~`` ranks all rows that know the feature; ``<feature>~<other>`` only those that also know the other, and is null for
    the rest. The features are stacked, so their distinct values are counted and put in order in one go: a value shared by most rows
    is a single row by then. Rows look their ranks up by value: common values, fewer than ``COMMON`` a feature, in a broadcast
    table, the others by a shuffle in which no value is hot.
    """
    others = ["", *sorted({o for o in scopes.values() if o})]
    stacked = stack(
        df,
        names,
        [
            key,
            F.lit(1).cast("bigint").alias("in~"),
            *[F.col(o).isNotNull().cast("bigint").alias(f"in~{o}") for o in others if o],
        ],
    )
    counts = stacked.groupBy("feature", "value").agg(*[F.sum(f"in~{o}").alias(f"n~{o}") for o in others])
    placed = running_totals(
        counts, ["feature"], "value", [f"n~{o}" for o in others], stacked_range(numeric_limits(df, names), names)
    )
    lookup = placed.select(
        "feature",
        "value",
        (F.col("n~") * COMMON > F.col("n~_all")).alias("common"),
        *[average_rank(F.col(f"n~{o}_before"), F.col(f"n~{o}")).alias(f"rank~{o}") for o in others],
    )
    common = F.broadcast(lookup.filter("common").drop("common"))
    rare = lookup.filter("not common").drop("common")
    value = ["feature", "value"]
    ranked = stacked.join(common, value).unionByName(stacked.join(common.select(*value), value, "left_anti").join(rare, value))
    return (
        ranked.select(key, "feature", *[F.when(F.col(f"in~{o}") == 1, F.col(f"rank~{o}")).alias(f"rank~{o}") for o in others])
        .groupBy(key)
        .agg(
            *[
                F.max(F.when(F.col("feature") == i, F.col(f"rank~{o}"))).alias(f"{n}~{o}")
                for i, n in enumerate(names)
                for o in others
                if not o or o != scopes[n]
            ]
        )
    )


def spearman_matrix(df: DataFrame, names: Sequence[str] = CORRELATED, key: str = "customer_unique_id") -> DataFrame:
    """Rank correlation of all pairs, ranked anew within the rows where both values are known."""
    scopes = null_scopes(df, names)
    ranks = feature_ranks(df, names, scopes, key)

    pairs = {(_rank_name(a, b, scopes), _rank_name(b, a, scopes)): (a, b) for a, b in combinations(names, 2)}
    found = comoments(ranks, list(pairs))
    named = found.select(
        *[F.substring_index(c, "~", 1).alias(c) for c in ("x", "y")], "r"
    )
    return _both_orders(named, names)


def compare_methods(df: DataFrame, target: str = "avg_order_value", names: Sequence[str] = CORRELATED) -> DataFrame:
    """Pearson and Spearman correlation with the target side by side."""
    pearson = pearson_matrix(df, names).filter((F.col("var_x") == target) & (F.col("var_y") != target))
    spearman = spearman_matrix(df, names).filter(F.col("var_x") == target)
    return (
        pearson.select(F.col("var_y").alias("variable"), F.col("r").alias("pearson"))
        .join(spearman.select(F.col("var_y").alias("variable"), F.col("r").alias("spearman")), "variable")
        .orderBy(F.abs("pearson").desc(), "variable")
    )
