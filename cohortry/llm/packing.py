"""Packing by optimal length buckets.

Documents are cut into pieces of at most ``max_tokens`` tokens. A global histogram of piece lengths, which has at most
``max_tokens`` rows, feeds a dynamic program that chooses the bucket boundaries with the least padding over all pieces. Within
each bucket, pieces are numbered without gaps and laid into batches of as many rows as the token budget allows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortry.llm.token_counts import build_automaton, read_ranks, with_token_counts
from cohortry.sources.scratch import keep

MAX_TOKENS = 2048
BUCKETS = 8
TOKEN_BUDGET = 16_384
PARCEL = 4096  # rows alike that are numbered as one
SLICE_ROWS = 500_000


def token_count(text: Column) -> Column:
    """White-space separated tokens of a text, none for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\s]+")), F.lit(0)).cast("long")


def best_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bucket limits that minimise the padding, the sum over all pieces of limit minus length.

    Dynamic program over the distinct lengths in ascending order; of equal choices the smaller limits win. The best last cut moves
    only upwards with the limit, so each is searched between those of its neighbours: memory is linear in the number of lengths.
    """
    m = len(lengths)
    if not m:
        return []
    n = np.concatenate([[0], np.cumsum(counts)])
    total = np.concatenate([[0], np.cumsum(lengths * counts)])
    limit = np.concatenate([[0], lengths])
    best, choices = None, []  # best[i]: least padding of the first k - 1 + i lengths in k - 1 buckets
    for k in range(1, min(buckets, m) + 1):
        best, back = _one_more_bucket(best, k, m - k + 1, n, total, limit)
        choices.append(back)
    out, j = [], m
    for k in range(len(choices), 0, -1):
        out.append(int(limit[j]))
        j = int(choices[k - 1][j - k])
    return out[::-1]


def _one_more_bucket(
    best: np.ndarray | None, k: int, size: int, n: np.ndarray, total: np.ndarray, limit: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Least padding of the first k .. m lengths in k buckets, and where the last bucket starts.

    Every second open position at a time, between the cuts of the positions already known.
    """
    j = np.arange(k, k + size)
    if best is None:
        return limit[j] * n[j] - total[j], np.zeros(size, np.int64)
    cut, out = np.zeros(size, np.int64), np.zeros(size, np.int64)  # cuts count from k - 1

    def settle(at: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        width = high - low + 1
        first = np.cumsum(width) - width
        i = np.arange(width.sum()) + np.repeat(low - first, width)
        end = np.repeat(at + k, width)
        padding = best[i] + limit[end] * (n[end] - n[i + k - 1]) - (total[end] - total[i + k - 1])
        out[at] = np.minimum.reduceat(padding, first)
        cut[at] = np.minimum.reduceat(np.where(padding == np.repeat(out[at], width), i, size), first)

    settle(np.array([0]), np.array([0]), np.array([0]))
    step = 1 << (size - 1).bit_length()
    while step := step // 2:
        at = np.arange(step, size, 2 * step)
        after = np.minimum(at + step, size - 1)
        settle(at, cut[at - step], np.where(at + step < size, np.minimum(cut[after], at), at))
    return out, cut + k - 1


def pieces(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = MAX_TOKENS, vocabulary: str | None = None
) -> DataFrame:
    """``doc_id, piece, start, n_tokens``: consecutive pieces that cover the whole document.

    Tokens are white-space separated words, or with the path of a vocabulary its pieces, as ``token_counts`` counts them.
    """
    two = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    if vocabulary is None:
        counted = two.select("doc_id", token_count(F.col("text")).alias("n"))
    else:
        counted = with_token_counts(two, "c", build_automaton(read_ranks(vocabulary))).select("doc_id", F.col("c.tokens").alias("n"))
    last = F.greatest(F.ceil(F.col("n") / max_tokens) - 1, F.lit(0))
    cut = counted.select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("piece"))
    start = F.col("piece") * max_tokens
    return cut.select("doc_id", "piece", start.alias("start"), F.least(F.col("n") - start, F.lit(max_tokens)).cast("long").alias("n_tokens"))


def _slice_digits(rows: int) -> int:
    """Hexadecimal digits that give every slice of the order about ``SLICE_ROWS`` rows at most."""
    digits = 1
    while 16**digits * SLICE_ROWS < rows:
        digits += 1
    return digits


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_tokens: int = MAX_TOKENS,
    buckets: int = BUCKETS,
    token_budget: int = TOKEN_BUDGET,
    vocabulary: str | None = None,
) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, n_tokens, bucket_len, batch, slot``.

    A batch of a bucket has ``token_budget // bucket_len`` slots; only the last batch of a bucket can have fewer pieces. Pieces
    are numbered by the md5 of id (empty for null), piece, length and parcel, joined by slashes. Rows alike in id, piece and length are
    counted first and numbered in parcels of ``PARCEL``, so that no task numbers all rows of one id or without one, and each row gets
    a slot. A document without tokens (null, empty, blank) has one piece of no tokens with null bucket, batch and slot. Null ids are
    allowed. Columns other than the two named are not read. Empty tables give empty results.
    """
    if token_budget < max_tokens:
        raise ValueError("a batch must have room for the longest piece")
    cut = pieces(docs, id_col, text_col, max_tokens, vocabulary)
    alike = keep(cut.groupBy("doc_id", "piece", "start", "n_tokens").agg(F.count("*").alias("rows")))
    histogram = alike.filter("n_tokens > 0").groupBy("n_tokens").agg(F.sum("rows").alias("rows")).orderBy("n_tokens").collect()  # at most max_tokens rows
    counts = np.array([r["rows"] for r in histogram], np.int64)
    limits = best_boundaries(np.array([r["n_tokens"] for r in histogram], np.int64), counts, buckets)
    bucket = F.lit(None).cast("long")
    for limit in reversed(limits):
        bucket = F.when(F.col("n_tokens") <= limit, F.lit(limit).cast("long")).otherwise(bucket)
    parcel = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / PARCEL)))
    parcels = alike.select("*", parcel.alias("parcel")).withColumn("rows", F.least(F.col("rows") - F.col("parcel") * PARCEL, F.lit(PARCEL)))
    place = F.md5(F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "piece", "n_tokens", "parcel").cast("binary"))
    full = (
        parcels.filter("n_tokens > 0")
        .select("*", bucket.alias("bucket_len"), place.alias("place"))
        .withColumn("slice", F.substring("place", 1, _slice_digits(int(counts.sum()))))
    )
    sizes = full.groupBy("bucket_len", "slice").agg(F.sum("rows").alias("rows"))
    earlier = Window.partitionBy("bucket_len").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("bucket_len", "slice", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"))  # one row a slice
    inside = Window.partitionBy("bucket_len", "slice").orderBy("place", "doc_id", "piece", "n_tokens", "parcel")
    ahead = F.coalesce(F.sum("rows").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1))
    per_batch = F.floor(F.lit(token_budget) / F.col("bucket_len"))
    placed = (
        full.withColumn("ahead", ahead)
        .join(offsets, ["bucket_len", "slice"])
        .select("*", copies.alias("copy"))
        .withColumn("rank", F.col("before") + F.col("ahead") + F.col("copy"))
        .select(
            "doc_id", "piece", "start", "n_tokens", "bucket_len",
            F.floor(F.col("rank") / per_batch).alias("batch"), (F.col("rank") % per_batch).alias("slot"),
        )
    )
    none = F.lit(None).cast("long")
    empty = parcels.filter("n_tokens = 0").select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    bare = empty.select("doc_id", "piece", "start", "n_tokens", none.alias("bucket_len"), none.alias("batch"), none.alias("slot"))
    return placed.unionByName(bare).withColumnRenamed("doc_id", id_col)


def _sql() -> str:
    """Piece lengths, the dynamic program step by step, and ranks by one window a bucket."""
    steps = [
        "d1 AS (SELECT h.i AS j, h.l * h.n_sum - h.l_sum AS cost, 0::BIGINT AS back FROM h)"
    ] + [
        f"d{k} AS (SELECT h.i AS j, min(p.cost + h.l * (h.n_sum - g.n_sum) - (h.l_sum - g.l_sum)) AS cost, "
        f"arg_min(p.j, (p.cost + h.l * (h.n_sum - g.n_sum) - (h.l_sum - g.l_sum)) * 100000 + p.j) AS back "
        f"FROM h JOIN d{k - 1} p ON p.j < h.i JOIN h g ON g.i = p.j GROUP BY h.i)"
        for k in range(2, BUCKETS + 1)
    ]
    walk = " UNION ALL ".join(f"SELECT {k} AS k, j, back FROM d{k}" for k in range(1, BUCKETS + 1))
    return f"""
WITH RECURSIVE counted AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\\s]+'))::BIGINT AS n FROM documents),
cut AS (SELECT doc_id, piece, piece * {MAX_TOKENS} AS start, least(n - piece * {MAX_TOKENS}, {MAX_TOKENS})::BIGINT AS n_tokens
  FROM (SELECT doc_id, n, unnest(generate_series(0, greatest(ceil(n / {MAX_TOKENS}::DOUBLE)::BIGINT - 1, 0))) AS piece FROM counted)),
c AS (SELECT n_tokens AS l, count(*) AS n FROM cut WHERE n_tokens > 0 GROUP BY 1),
h AS (SELECT row_number() OVER (ORDER BY l) AS i, l, (sum(n) OVER (ORDER BY l))::BIGINT AS n_sum, (sum(l * n) OVER (ORDER BY l))::BIGINT AS l_sum FROM c),
{', '.join(steps)},
steps AS ({walk}),
path AS (SELECT least({BUCKETS}, (SELECT count(*) FROM h)) AS k, (SELECT max(i) FROM h) AS j
  UNION ALL SELECT path.k - 1, steps.back FROM path JOIN steps ON steps.k = path.k AND steps.j = path.j WHERE path.k > 1),
limits AS (SELECT h.l AS lim FROM path JOIN h ON h.i = path.j),
full_ AS (SELECT cut.*, (SELECT min(lim) FROM limits WHERE lim >= n_tokens) AS bucket_len,
  (row_number() OVER (PARTITION BY doc_id, piece, n_tokens) - 1) // {PARCEL} AS parcel FROM cut WHERE n_tokens > 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY bucket_len
  ORDER BY md5(coalesce(doc_id::VARCHAR, '') || '/' || piece || '/' || n_tokens || '/' || parcel), doc_id NULLS FIRST, piece, n_tokens, parcel) - 1 AS r,
  {TOKEN_BUDGET} // bucket_len AS per FROM full_)
SELECT doc_id, piece, start, n_tokens, bucket_len, (r // per)::BIGINT AS batch, (r % per)::BIGINT AS slot FROM ranked
UNION ALL SELECT doc_id, piece, start, n_tokens, NULL, NULL, NULL FROM cut WHERE n_tokens = 0
"""


SQL = _sql()
