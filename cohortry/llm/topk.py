"""Exact top-k search by inner product: exhaustive term-at-a-time accumulation.

The query vectors are taken in blocks of bounded size; each block is broadcast and every candidate row is scored against it
where it lies. Within a task, a batch of candidates is turned into postings (per dimension the rows with a weight and their
weights). A query row scatters weight times postings into a dense array of scores, one dimension after the other; the best k
of the array are selected by partition and merged into the task's best so far. Only k rows per query and task are shuffled,
for the final merge.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortry.llm.common import lend, ship_by_value
from cohortry.sources.scratch import fresh_path, keep

ship_by_value(__name__)

SCALE = 256
QUERY_EVERY = 50
K = 5
QUERY_BLOCK = 4096
CANDIDATE_ROWS = 8192
LONGEST_SQUARE = 2.0**63 * 0.999


def quantised(vector: Column) -> Column:
    """floor(256 * x) of each component as a long, x taken as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))


def is_finite(vector: Column) -> Column:
    fine = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    return vector.isNotNull() & F.coalesce(F.forall(vector, fine), F.lit(False))


def _square(vector: Column) -> Column:
    """Upper bound of the square of a quantised vector's length. No sum of products of two vectors, nor any part of it, passes the greatest."""
    return F.aggregate(vector, F.lit(0.0), lambda total, x: total + F.pow(F.abs(x.cast("double")) * SCALE + 1, F.lit(2.0)))


class Queries:
    """A block of queries as sparse rows."""

    def __init__(self, rows: list):
        self.ids = np.array([r["vec_id"] for r in rows], np.int64)
        vectors = [np.array(r["v"], np.int64) for r in rows]
        self.terms = [np.nonzero(v)[0] for v in vectors]
        self.weights = [v[t] for v, t in zip(vectors, self.terms)]


def postings_of(lengths: np.ndarray, flat: np.ndarray) -> list[tuple[np.ndarray | slice, np.ndarray]]:
    """Per dimension the candidates with a weight there, and the weights. A shorter vector has no weight beyond its end."""
    n, width = len(lengths), int(lengths.max(initial=0))
    row = np.repeat(np.arange(n), lengths)
    dim = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    some = flat != 0
    row, dim, weight = row[some], dim[some], flat[some]
    order = np.argsort(dim, kind="stable")
    ends = np.searchsorted(dim[order], np.arange(width + 1))
    out = []
    for t in range(width):
        at = order[ends[t] : ends[t + 1]]
        out.append((slice(None) if len(at) == n else row[at], weight[at]))
    return out


def accumulate(terms: np.ndarray, weights: np.ndarray, postings: list, n: int) -> np.ndarray:
    """Scores of all n candidates for one query."""
    scores = np.zeros(n, np.int64)
    for t, w in zip(terms, weights):
        if t < len(postings):
            rows, values = postings[t]
            scores[rows] += w * values
    return scores


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    at = np.arange(len(scores))
    if len(scores) > k:
        at = at[scores >= np.partition(scores, len(scores) - k)[len(scores) - k]]
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def _search(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared()
        top = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in queries.ids]
        for whole in batches:
            for lo in range(0, whole.num_rows, CANDIDATE_ROWS):
                b = whole.slice(lo, CANDIDATE_ROWS)
                ids, lists = b.column(0).to_numpy(zero_copy_only=False), b.column(1)
                postings = postings_of(np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(zero_copy_only=False))
                for q, own in enumerate(queries.ids):
                    scores = accumulate(queries.terms[q], queries.weights[q], postings, len(ids))
                    others = ids != own
                    s, i = np.concatenate([top[q][0], scores[others]]), np.concatenate([top[q][1], ids[others]])
                    at = best(s, i, k)
                    top[q] = (s[at], i[at])
        n = [len(s) for s, _ in top]
        if sum(n):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(queries.ids, n)),
                    pa.array(np.concatenate([i for _, i in top])),
                    pa.array(np.concatenate([s for s, _ in top])),
                ],
                names=["query_id", "vec_id", "score"],
            )

    return run


def top_k(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, every: int = QUERY_EVERY) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row whose id is divisible by ``every``, its k best other rows.

    Vectors that are null or hold a null, NaN or infinite component take no part, nor do rows with a null id. An empty vector
    scores 0 everywhere. Rows with the query's id are its own; other repeated rows are candidates each, and appear as often.
    Of several query rows with one id the greatest vector asks. Scores are 64-bit integers; vectors so long that a score could pass
    them raise ``OverflowError``. Queries without any other row, and empty tables, give no rows. Other columns are not read.
    Each block of queries is a job of its own whose result is written to the shared folder, so neither the plan nor the driver grows with
    the number of blocks.
    """
    spark, vector = rows.sparkSession, F.col(f"`{vector_col}`")
    fine = rows.filter(is_finite(vector) & F.col(f"`{id_col}`").isNotNull())
    longest = fine.agg(F.max(_square(vector))).first()[0] or 0.0
    if longest >= LONGEST_SQUARE:
        raise OverflowError("scores of these vectors may pass 64 bits")
    usable = fine.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), quantised(vector).alias("v"))
    asked = usable.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.max("v").alias("v"))
    blocks = max(1, -(-rows.filter(F.col(f"`{id_col}`") % every == 0).count() // QUERY_BLOCK))
    dealt = keep(asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).repartitionByRange("block"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = fresh_path(spark)
    for i in range(blocks):
        queries, free = lend(spark, Queries(dealt.filter(F.col("block") == i).orderBy("vec_id").collect()))
        part = usable.mapInArrow(_search(queries, k), "query_id long, vec_id long, score long")
        ranked = part.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        ranked.select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(found)
        free()
    return spark.read.schema("query_id long, rank int, vec_id long, score long").parquet(found)


SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x::DOUBLE) OR isinf(x::DOUBLE))) = 0),
q AS (SELECT vec_id, max(v) AS v FROM v WHERE vec_id % {QUERY_EVERY} = 0 GROUP BY vec_id),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: coalesce(p[1] * p[2], 0))), 0)::BIGINT AS score
  FROM q JOIN v c ON c.vec_id <> q.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {K}
"""
