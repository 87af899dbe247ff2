"""Near duplicates among embeddings by an inverted multi-index.

1. Vectors are scaled to unit length; equal vectors are one *representative* with a number of copies.
2. Each half of the vectors has a codebook of its own, fitted on a bounded sample. A vector's nearest centroids in both halves name
   its cell of the product grid.
3. To get from a vector q into the cells of centroid i, a neighbour must cross the plane between i and q's own centroid; the
   squared distances to these planes in both halves add up to a lower bound for a cell. Multi-sequence traversal takes cells in
   order of this bound and stops where the target recall is reached. A neighbour at the threshold is at squared distance
   2 - 2 * threshold, so at that bound the search would be exact; the stop is set lower, from pairs of known similarity.
4. Within a cell, its members are compared with all vectors that visit it, block against block, in double precision. A pair that
   meets in two cells counts in one of them. A block returns one row a vector with links, never pairs.
5. Connected components of the links are the classes.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import share, ship_by_value, small_batches
from cohortry.llm.components import connected
from cohortry.llm.topk import is_finite
from cohortry.sources.scratch import keep

ship_by_value(__name__)

THRESHOLD = 0.9
TARGET_RECALL = 0.99
SAMPLE_ROWS = 8192  # the most representatives the codebooks and the stop are fitted on
CELL_ROWS = 32  # members a cell should have on average
MOST_CENTROIDS = 512  # a half
ROUNDS = 12
BLOCK_ROWS = 1024
SAMPLE_BLOCK = 256
UNSURE = 1e-12  # cosines so near the threshold are computed again with exact sums


def unit_rows(flat: np.ndarray, lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows, zeros at the end of shorter ones, scaled by their largest component; and the rows of unit length.

    The first scaling is by a power of two, thus exact, and keeps squares of very large and very small numbers in range.
    """
    v = np.zeros((len(lengths), width))
    row = np.repeat(np.arange(len(lengths)), lengths)
    v[row, np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    _, power = np.frexp(np.abs(v).max(axis=1, initial=0.0))
    v = np.ldexp(v, -power[:, None])
    size = np.sqrt((v * v).sum(axis=1))
    return v, v / np.where(size > 0, size, 1.0)[:, None]


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    """The cosine of two vectors with exactly rounded sums."""
    dot = math.fsum((a * b).tolist())
    return dot / (math.sqrt(math.fsum((a * a).tolist())) * math.sqrt(math.fsum((b * b).tolist())))


# --- index -----------------------------------------------------------------------------------------------------


def fit_codebook(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """At most ``k`` centroids of the rows by Lloyd's rounds from evenly drawn distinct rows."""
    start = np.unique(x, axis=0)
    centres = start[np.sort(np.random.default_rng(seed).choice(len(start), min(k, len(start)), replace=False))]
    for _ in range(ROUNDS):
        nearest = distances(x, centres).argmin(axis=1)
        counts = np.bincount(nearest, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return np.unique(centres, axis=0)  # equal centroids would have no plane between them


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)[None, :], 0.0)


@dataclass
class MultiIndex:
    """Codebooks of the two halves, and the bound at which a traversal stops."""

    first: np.ndarray
    second: np.ndarray
    stop: float = 0.0

    def halves(self, u: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per half: the nearest centroid of each row, and the squared distance to the plane between it and each centroid."""
        at, out = self.first.shape[1], []
        for x, centres in ((u[:, :at], self.first), (u[:, at:], self.second)):
            d = distances(x, centres)
            own = d.argmin(axis=1)
            apart = np.sqrt(distances(centres, centres))[own]
            gap = np.maximum(d - d[np.arange(len(d)), own][:, None], 0.0)
            out.append((own, np.where(apart > 0, gap / (2 * np.where(apart > 0, apart, 1.0)), 0.0) ** 2))
        return out

    def cell(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return i * len(self.second) + j

    def traverse(self, bounds1: np.ndarray, bounds2: np.ndarray) -> list[int]:
        """Cells in order of their bound up to the stop: the sequences of both halves are walked together by a heap."""
        order1, order2 = np.argsort(bounds1, kind="stable"), np.argsort(bounds2, kind="stable")
        a, b = bounds1[order1].tolist(), bounds2[order2].tolist()
        heap, out = [(a[0] + b[0], 0, 0)], []
        while heap:
            bound, i, j = heapq.heappop(heap)
            if bound > self.stop:
                break
            out.append(int(self.cell(order1[i], order2[j])))
            if j + 1 < len(b):
                heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(a):
                heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
        return out


def stop_for(index: MultiIndex, u: np.ndarray, threshold: float, recall: float, seed: int = 0) -> float:
    """The bound up to which traversal finds a share ``recall`` of pairs at the threshold.

    Measured on one partner a sampled vector, at exactly the threshold in an even direction (nearer ones are found more easily), and
    on the pair of each sampled vector within the sample that is hardest to find; the larger bound holds. A pair is found if
    either visits the other's cell.
    """
    noise = np.random.default_rng(seed).normal(size=u.shape)
    noise -= (noise * u).sum(axis=1)[:, None] * u
    size = np.sqrt((noise * noise).sum(axis=1))[:, None]
    partner = threshold * u + math.sqrt(1 - threshold**2) * noise / np.where(size > 0, size, 1.0)
    (own1, b1), (own2, b2) = index.halves(u)
    (p1, c1), (p2, c2) = index.halves(partner)
    at = np.arange(len(u))
    even = np.minimum(b1[at, p1] + b2[at, p2], c1[at, own1] + c2[at, own2])
    hardest = [np.empty(0)]
    for q in np.array_split(at, -(-len(u) // SAMPLE_BLOCK)):
        pair = (u[q] @ u.T >= threshold) & (q[:, None] != at[None, :])
        to, back = b1[q][:, own1] + b2[q][:, own2], (b1[:, own1[q]] + b2[:, own2[q]]).T
        worst = np.where(pair, np.minimum(to, back), -1.0).max(axis=1)
        hardest.append(worst[worst >= 0])
    return max(float(np.quantile(x, recall)) if len(x) else 0.0 for x in (even, np.concatenate(hardest)))


def fit_index(reps: DataFrame, count: int, width: int, threshold: float, recall: float) -> MultiIndex:
    """Codebooks and stop from the ``SAMPLE_ROWS`` representatives with the smallest digests, an even sample."""
    rows = reps.select("vector").orderBy("digest").limit(SAMPLE_ROWS).collect()
    _, u = unit_rows(np.array([x for r in rows for x in r["vector"]], float), np.array([len(r["vector"]) for r in rows], np.int64), width)
    k = min(MOST_CENTROIDS, max(1, math.ceil(math.sqrt(count / CELL_ROWS))))
    half = width // 2
    index = MultiIndex(fit_codebook(u[:, :half], k, 1), fit_codebook(u[:, half:], k, 2))
    index.stop = stop_for(index, u, threshold, recall)
    return index


# --- tasks -----------------------------------------------------------------------------------------------------


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float), np.diff(column.offsets.to_numpy())


def _digests(width: int):
    """A digest of each vector as doubles, null for a zero vector; +0 and -0 are the same number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            flat, lengths = _lists(b.column(1))
            v, _ = unit_rows(flat, lengths, width)
            whole = np.zeros_like(v)
            row = np.repeat(np.arange(len(lengths)), lengths)
            whole[row, np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat + 0.0
            digests = [blake2b(w.tobytes(), digest_size=16).digest() if x.any() else None for w, x in zip(whole, v)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(digests, pa.binary())], names=["vec_id", "vector", "digest"])

    return run


def _visits(shared, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: MultiIndex = shared()
        for b in small_batches(batches):
            _, u = unit_rows(*_lists(b.column(2)), width)
            (own1, bounds1), (own2, bounds2) = index.halves(u)
            cells = [index.traverse(x, y) for x, y in zip(bounds1, bounds2)]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(index.cell(own1, own2), pa.int64()), pa.array(cells, pa.list_(pa.int64()))],
                names=["node", "copies", "vector", "home", "visits"],
            )

    return run


def linked(a: np.ndarray, ua: np.ndarray, b: np.ndarray, ub: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of a and b have a cosine of at least the threshold. ``ua`` and ``ub`` are the same rows at unit length."""
    c = ua @ ub.T
    out = c >= threshold
    for i, j in zip(*np.nonzero(np.abs(c - threshold) < UNSURE)):
        out[i, j] = cosine(a[i], b[j]) >= threshold
    return out


def _unit(table: pa.Table, width: int, threshold: float) -> pa.Table:
    """Links between a block of a cell's members and a block of its visitors, the members themselves among them.

    Two members meet twice in their cell and count where the first has the smaller node. A member and a visitor from elsewhere
    that visit each other's cells meet in both and count in the smaller cell.
    """
    cell = table.column("cell")[0].as_py()
    member = table.column("member").to_numpy(zero_copy_only=False).astype(bool)
    node, home = table.column("node").to_numpy(), table.column("home").to_numpy()
    copies, visits = table.column("copies").to_numpy(), table.column("visits").to_pylist()
    v, u = unit_rows(*_lists(table.column("vector").combine_chunks()), width)
    at, by = np.nonzero(member)[0], np.nonzero(~member)[0]
    if not len(at) or not len(by):
        return pa.table({"node": pa.array([], pa.int64()), "root": pa.array([], pa.int64()), "links": pa.array([], pa.int64())})
    found = linked(v[at], u[at], v[by], u[by], threshold)
    same = home[by] == cell
    found[:, same] &= node[at][:, None] < node[by][same][None, :]
    for j in np.nonzero(~same & found.any(axis=0))[0]:
        other = home[by[j]]
        if other < cell:
            found[:, j] &= [other not in visits[i] for i in at]
    links = np.zeros(len(node), np.int64)
    links[at], links[by] = found @ copies[by], copies[at] @ found
    nodes, place = np.unique(node, return_inverse=True)
    i, j = np.nonzero(found)
    x, y = place[at[i]], place[by[j]]
    root = np.arange(len(nodes))
    while True:
        after = root.copy()
        np.minimum.at(after, x, root[y])
        np.minimum.at(after, y, root[x])
        after = after[after]
        if (after == root).all():
            break
        root = after
    total = np.zeros(len(nodes), np.int64)
    np.add.at(total, place, links)
    has = total > 0
    return pa.table({"node": nodes[has], "root": nodes[root[has]], "links": total[has]})


# --- operator --------------------------------------------------------------------------------------------------


def _links(reps: DataFrame, index: MultiIndex, width: int, threshold: float) -> DataFrame:
    """``node, root, links`` of blocks: a vector's links there, and the smallest node it hangs together with there."""
    spark, kind = reps.sparkSession, dict(reps.dtypes)["vector"]
    placed = keep(
        reps.select("node", "copies", "vector").mapInArrow(
            _visits(share(spark, index), width), f"node long, copies long, vector {kind}, home long, visits array<long>"
        )
    )
    per_cell = placed.select("home", F.explode("visits").alias("cell")).groupBy("cell").agg(
        F.count("*").alias("v"), F.count_if(F.col("home") == F.col("cell")).alias("m")
    )
    blocks = per_cell.filter("m > 0 and v > 1").select(  # at most MOST_CENTROIDS**2 rows
        "cell",
        F.ceil(F.col("m") / BLOCK_ROWS).cast("int").alias("member_blocks"),
        F.ceil(F.col("v") / BLOCK_ROWS).cast("int").alias("visitor_blocks"),
    )

    def dealt(blocks_: str):
        return F.pmod(F.xxhash64("node"), F.col(blocks_)).cast("int")

    def every(blocks_: str):
        return F.sequence(F.lit(0), F.col(blocks_) - 1)

    columns = ["node", "copies", "vector", "home", "visits"]
    small = F.broadcast(blocks)
    members = placed.join(small, F.col("home") == F.col("cell")).select(
        "cell", dealt("member_blocks").alias("mb"), F.explode(every("visitor_blocks")).alias("vb"), F.lit(True).alias("member"), *columns
    )
    visitors = (
        placed.select(*columns, F.explode("visits").alias("cell"))
        .withColumn("visits", F.array().cast("array<long>"))  # only members' lists are asked for
        .join(small, "cell")
        .select("cell", F.explode(every("member_blocks")).alias("mb"), dealt("visitor_blocks").alias("vb"), F.lit(False).alias("member"), *columns)
    )
    units = members.unionByName(visitors).groupBy("cell", "mb", "vb")
    return keep(units.applyInArrow(lambda t: _unit(t, width, threshold), "node long, root long, links long"))


def near_duplicates(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, recall: float = TARGET_RECALL
) -> DataFrame:
    """One row per vector: its id, ``n_links`` (other rows linked directly), ``component_id`` (smallest id reachable by links, its
    own included) and ``kept`` (whether that is its own id).

    Pairs found by the index are linked if their cosine in double precision is at least ``threshold``; none below it is. Equal vectors
    are always found, other pairs with at least the target recall, measured against all pairs in the tests. Vectors that are null,
    zero or empty, or hold a null, NaN or infinite component, link with nothing and are their own component. A shorter
    vector stands for one with zeros at its end. Every row is a vector: rows of one id with different vectors are told apart,
    repeated rows are copies. Null ids take part; a component without any other id has a null one, and its rows are kept. Rows of one
    id are kept or not together within a component. Other columns are not read. An empty table gives an empty result.
    """
    id_, vector = F.col(f"`{id_col}`"), F.col(f"`{vector_col}`")
    element = "float" if dict(rows.dtypes)[vector_col] == "array<float>" else "double"  # single precision moves in half the bytes
    sought = F.when(is_finite(vector), F.transform(vector, lambda x: x.cast(element)))
    read = rows.select(id_.alias("vec_id"), sought.alias("vector"))
    some = read.filter("vector is not null")
    width = some.agg(F.max(F.size("vector"))).first()[0] or 0
    kind = some.schema["vec_id"].dataType.simpleString()
    sketched = keep(some.mapInArrow(_digests(width), f"vec_id {kind}, vector array<{element}>, digest binary"))
    reps = keep(
        sketched.filter("digest is not null")
        .groupBy("digest")
        .agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    count = reps.count()
    alone = read.filter("vector is null").select("vec_id").unionByName(sketched.filter("digest is null").select("vec_id"))
    out = alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if count:
        links = _links(reps, fit_index(reps, count, width, threshold, recall), width, threshold)
        total = links.groupBy("node").agg(F.sum("links").alias("links"))
        roots = connected(links.select(F.col("node").alias("u"), F.col("root").alias("v")))
        classed = reps.select("node", "digest", "vec_id", "copies").join(total, "node", "left").join(roots, "node", "left")
        classed = keep(classed.withColumn("root", F.coalesce("root", "node")))
        least = classed.groupBy("root").agg(F.min("vec_id").alias("component_id"))
        decided = classed.join(least, "root").select(
            "digest", "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
        )
        known = sketched.filter("digest is not null").select("vec_id", "digest")
        out = known.join(decided, "digest").select("vec_id", "n_links", "component_id").unionByName(out)
    return out.select(
        F.col("vec_id").alias(id_col), "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept")
    )
