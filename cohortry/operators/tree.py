"""A depth-limited classification tree with exact split points, grown level by level.

Each level first counts its training rows per (node, feature, range of values, class), a small table. The gaps between ranges are
judged on it exactly, and for each range an upper bound says how good a gap inside it could be. Rows are counted by value, shuffled and
put in order only in ranges whose bound reaches the best gap known for their node; every gap in them is judged, and the best gap of
each node comes back to the driver, one row per node of the level. Rows find their node through plain comparisons with the
splits chosen so far, so nothing is rewritten between levels.

The bound: purity is a convex function of the class counts on the left, and these move within the box spanned by the rows before the range
and those in it, so its largest value is at one of the box's four corners.

Rows with missing predictors are trained on and predicted like any others. At each gap they are tried on either side, and apart from all
known values; the better place is the split's. Where a node has no missing values of its feature, later ones go to the larger side.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortry.operators.classify import LABEL, PREDICTORS
from cohortry.operators.ranks import numeric_limits, stack, stacked_range
from cohortry.sources.scratch import keep

MAX_DEPTH = 4
MIN_SPLIT = 100
MIN_LEAF = 50
ROOT = 1
CLASSES = ["n0", "n1"]
LEAST_RANGES, MOST_RANGES = 64, 4096  # of a feature; the square root of the rows in between
ROUNDING = 1e-9  # a bound may fall short of a purity computed in another order by this part


@dataclass
class Node:
    """A node and the counts of its training rows by class. Children of node i are 2i and 2i + 1."""

    number: int
    counts: tuple[int, int]
    feature: int | None = None
    threshold: float | None = None  # infinite: all known values go left
    missing_left: bool = False

    @property
    def depth(self) -> int:
        return self.number.bit_length() - 1


@dataclass
class Tree:
    predictors: tuple[str, ...]
    weights: tuple[float, float]
    nodes: dict[int, Node] = field(default_factory=dict)

    def weighted(self, node: Node) -> tuple[float, float]:
        return node.counts[0] * self.weights[0], node.counts[1] * self.weights[1]

    def gini(self, node: Node) -> float:
        w0, w1 = self.weighted(node)
        total = w0 + w1
        return 1 - (w0 * w0 + w1 * w1) / (total * total)

    def node_of(self, number: int = ROOT) -> Column:
        """The leaf a row belongs to."""
        node = self.nodes[number]
        if node.feature is None:
            return F.lit(number)
        value = F.col(self.predictors[node.feature])
        goes_left = F.coalesce(value <= F.lit(node.threshold), F.lit(node.missing_left))
        return F.when(goes_left, self.node_of(2 * number)).otherwise(self.node_of(2 * number + 1))

    def prediction(self) -> Column:
        ones = [n.number for n in self.nodes.values() if n.feature is None and self.weighted(n)[1] > self.weighted(n)[0]]
        return self.node_of().isin(ones).cast("int") if ones else F.lit(0)

    def importances(self) -> list[float]:
        gains = [0.0] * len(self.predictors)
        for node in self.nodes.values():
            if node.feature is not None:
                for part, sign in ((node, 1), (self.nodes[2 * node.number], -1), (self.nodes[2 * node.number + 1], -1)):
                    gains[node.feature] += sign * sum(self.weighted(part)) * self.gini(part)
        total = sum(gains)
        return [g / total if total else 0.0 for g in gains]


def _purity(left: Sequence[str], weights: tuple[float, float]) -> str:
    """SQL of the weighted purity of both sides by the class counts on the left; an empty side has 0."""
    sides = []
    for c0, c1 in (left, [f"(n{i}_node - {c})" for i, c in enumerate(left)]):
        w0, w1 = f"({c0} * {weights[0]!r}D)", f"({c1} * {weights[1]!r}D)"
        sides.append(f"coalesce(try_divide({w0} * {w0} + {w1} * {w1}, {w0} + {w1}), 0D)")
    return " + ".join(sides)


MISSING = [f"(n{i}_node - n{i}_all)" for i in (0, 1)]


def _sides(weights: tuple[float, float], min_leaf: int) -> Column:
    """The admissible splits at a gap, as an array: missing values on the right, on the left, or apart from all known ones."""
    below = [f"(n{i}_before + n{i})" for i in (0, 1)]
    some = f"{MISSING[0]} + {MISSING[1]} > 0"
    larger_left = f"2 * ({below[0]} + {below[1]}) > n0_node + n1_node"

    def split(option: int, when: str, cut: str, left: list[str], missing_left: str) -> str:
        fits = f"{left[0]} + {left[1]} >= {min_leaf} AND n0_node + n1_node - {left[0]} - {left[1]} >= {min_leaf}"
        values = {
            "option": option, "cut": cut, "left0": left[0], "left1": left[1], "right0": f"n0_node - {left[0]}", "right1": f"n1_node - {left[1]}",
            "missing_left": missing_left, "purity": _purity(left, weights),
        }
        return f"IF({when} AND {fits}, named_struct({', '.join(f"'{k}', {v}" for k, v in values.items())}), NULL)"

    gap, middle = "value_next IS NOT NULL", "value / 2 + value_next / 2"
    options = [
        split(0, gap, middle, below, f"IF({some}, false, {larger_left})"),
        split(1, f"{gap} AND {some}", middle, [f"({b} + {m})" for b, m in zip(below, MISSING)], "true"),
        split(2, f"value_next IS NULL AND {some}", "double('infinity')", ["n0_all", "n1_all"], "false"),
    ]
    return F.expr(f"array_compact(array({', '.join(options)}))")


def _best_splits(gaps: DataFrame, weights: tuple[float, float], min_leaf: int) -> DataFrame:
    """The best split of each node: largest weighted purity of both sides; then the first feature, the lowest value, and missing
    values on the right before the left."""
    best = F.max_by(
        F.struct("feature", "cut", "missing_left", "left0", "left1", "right0", "right1"),
        F.struct("purity", -F.col("feature"), -F.col("value"), -F.col("option")),
    )
    return (
        gaps.select("node", "feature", "value", F.inline(_sides(weights, min_leaf)))
        .groupBy("node")
        .agg(best.alias("best"))
        .select("node", "best.*")
    )


def _class_counts(label: str) -> list[Column]:
    return [F.count_if(F.col(label) == i).alias(c) for i, c in enumerate(CLASSES)]


def ranged_counts(placed: DataFrame, label: str, sizes: dict[int, tuple[int, int]]) -> DataFrame:
    """Per (node, feature, range): class counts, smallest and largest value; counts before the range and in all, and the next range's
    smallest value as ``value_next``, so a row is also the gap behind the range's largest value. One row a range. ``sizes`` are the
    nodes' counts by class, known and missing values together."""
    of_node = [F.create_map(*[F.lit(x) for n, c in sizes.items() for x in (n, c[i])])[F.col("node")] for i in (0, 1)]
    whole = Window.partitionBy("node", "feature")
    order = whole.orderBy("_range")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.groupBy("node", "feature", "_range")
        .agg(*_class_counts(label), F.min("value").alias("least"), F.max("value").alias("value"))
        .select(
            "*",
            F.lead("least").over(order).alias("value_next"),
            *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in CLASSES],
            *[F.sum(c).over(whole).alias(f"{c}_all") for c in CLASSES],
            *[t.alias(f"{c}_node") for t, c in zip(of_node, CLASSES)],
        )
    )


TOTALS = [f"{c}_{x}" for c in CLASSES for x in ("before", "all", "node")]


def open_ranges(ranges: DataFrame, weights: tuple[float, float], min_leaf: int) -> DataFrame:
    """The ranges in which a gap could be as good as the best gap between ranges of the same node, with their counts before and in all."""
    before, after = [[f"{c}_before" for c in CLASSES], [f"({c}_before + {c})" for c in CLASSES]]
    corners = [[x, y] for x in (before[0], after[0]) for y in (before[1], after[1])]
    corners += [[f"({x} + {m})" for x, m in zip(c, MISSING)] for c in corners]
    bound = f"greatest({', '.join(_purity(c, weights) for c in corners)})"
    most_left = f"{after[0]} + {after[1]} + {MISSING[0]} + {MISSING[1]}"
    most_right = f"n0_node + n1_node - {before[0]} - {before[1]}"
    best = F.max(F.array_max(_sides(weights, min_leaf)["purity"])).over(Window.partitionBy("node"))
    return (
        ranges.select("*", F.expr(bound).alias("_bound"), best.alias("_best"))
        .filter(f"least < value AND {most_left} >= {min_leaf} AND {most_right} >= {min_leaf}")
        .filter(f"_best IS NULL OR _bound >= _best * (1 - {ROUNDING}D)")
        .select("node", "feature", "_range", *TOTALS)
    )


def inner_gaps(placed: DataFrame, opened: DataFrame, label: str) -> DataFrame:
    """The gaps between neighbouring values inside the open ranges. Only their rows are shuffled, counted by value."""
    place = ["node", "feature", "_range"]
    order = Window.partitionBy(*place).orderBy("value")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    counted = placed.join(opened, place).groupBy(*place, "value").agg(*_class_counts(label), *[F.max(t).alias(t) for t in TOTALS])
    return counted.select(
        *place, "value", F.lead("value").over(order).alias("value_next"), *CLASSES,
        *[(F.col(f"{c}_before") + F.coalesce(F.sum(c).over(earlier), F.lit(0))).alias(f"{c}_before") for c in CLASSES],
        *[f"{c}_{x}" for c in CLASSES for x in ("all", "node")],
    ).filter("value_next is not null")


def grow_tree(
    train: DataFrame,
    predictors: Sequence[str] = PREDICTORS,
    label: str = LABEL,
    max_depth: int = MAX_DEPTH,
    min_split: int = MIN_SPLIT,
    min_leaf: int = MIN_LEAF,
) -> Tree:
    """Grow a tree with balanced class weights on the training rows with a label (gini criterion)."""
    rows = train.dropna(subset=[label])
    sizes = rows.agg(F.count_if(F.col(label) == 0).alias("n0"), F.count_if(F.col(label) == 1).alias("n1")).first()
    n0, n1 = sizes["n0"], sizes["n1"]
    width = min(MOST_RANGES, max(LEAST_RANGES, math.isqrt(n0 + n1)))
    limits = numeric_limits(rows, predictors, width)
    tree = Tree(tuple(predictors), ((n0 + n1) / (2 * n0) if n0 else 0.0, (n0 + n1) / (2 * n1) if n1 else 0.0))
    tree.nodes[ROOT] = Node(ROOT, (n0, n1))
    for depth in range(max_depth):
        open_nodes = [
            n.number for n in tree.nodes.values() if n.depth == depth and sum(n.counts) >= min_split and min(n.counts) > 0
        ]
        if not open_nodes:
            break
        placed = stack(
            rows.withColumn("node", tree.node_of()).filter(F.col("node").isin(open_nodes)), predictors, ["node", label]
        ).withColumn("_range", stacked_range(limits, predictors))
        sizes = {n: tree.nodes[n].counts for n in open_nodes}
        ranges = keep(ranged_counts(placed, label, sizes))
        gaps = ranges.drop("least").unionByName(inner_gaps(placed, open_ranges(ranges, tree.weights, min_leaf), label))
        for best in _best_splits(gaps, tree.weights, min_leaf).collect():
            node = tree.nodes[best["node"]]
            node.feature, node.threshold, node.missing_left = best["feature"], best["cut"], best["missing_left"]
            left, right = 2 * node.number, 2 * node.number + 1
            tree.nodes[left] = Node(left, (best["left0"], best["left1"]))
            tree.nodes[right] = Node(right, (best["right0"], best["right1"]))
    return tree


def predict_tree(rows: DataFrame, tree: Tree) -> DataFrame:
    """All rows with the predicted class ``predicted``."""
    return rows.withColumn("predicted", tree.prediction())


def importance_table(spark: SparkSession, tree: Tree) -> DataFrame:
    """Features by their share of the total gain in purity, largest first."""
    rows = sorted(zip(tree.predictors, tree.importances()), key=lambda pair: (-pair[1], pair[0]))
    return spark.createDataFrame(
        [(i + 1, name, share) for i, (name, share) in enumerate(rows)], "rank int, feature string, importance double"
    )


def rule_table(spark: SparkSession, tree: Tree) -> DataFrame:
    """One row per node: its test (none for a leaf), where missing values go, purity, training rows by class and majority class."""
    rows = []
    for number in sorted(tree.nodes):
        node = tree.nodes[number]
        w0, w1 = tree.weighted(node)
        name = None if node.feature is None else tree.predictors[node.feature]
        rule = None if name is None else f"{name} is known" if math.isinf(node.threshold) else f"{name} <= {node.threshold:.3f}"
        missing = None if name is None else "left" if node.missing_left else "right"
        rows.append((number, node.depth, rule, name, node.threshold, missing, tree.gini(node), *node.counts, int(w1 > w0)))
    return spark.createDataFrame(
        rows,
        "node int, depth int, rule string, feature string, threshold double, missing string, gini double, n0 bigint, n1 bigint, "
        "prediction int",
    )
