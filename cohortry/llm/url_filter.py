"""URL filters by Bloom filter cascades.

Rules are keys of a host and a path prefix (``example.org/es/``). A url fits a rule if its host is the rule's or a subdomain of
it and its path starts with the rule's path; so the keys a url can fit are its host suffixes with as many labels, and its path
prefixes of such length, as some rule has. All such keys of the corpus are its *key universe*. A cascade encodes a list exactly
over that universe: level 0 holds the listed keys, level 1 the other keys that pass level 0, level 2 the listed keys that pass
level 1, and so on until a level lets nothing of the other side through. A key's first failing level tells its side. The
filters, whose size follows the list and not the corpus, are broadcast; judging a url takes no join.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.llm.bloom import Bloom, bits_for, build, key_hash
from cohortry.llm.common import share, ship_by_value, with_arrow_column
from cohortry.sources.scratch import keep

ship_by_value(__name__)

#: Verdict and key.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
UNLISTED = "allow"
MOST_BITS = 1 << 30  # 128 MB; a list that needs more is refused
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z in lower case. Empty without ``://`` or url."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end. Empty without ``://`` or url."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def shapes_of(keys: Sequence[str]) -> list[tuple[int, int]]:
    """Number of host labels and length of the path of each key, distinct."""
    return sorted({(k.partition("/")[0].count(".") + 1, len(k) - len(k.partition("/")[0])) for k in keys})


def keys_of(host: Column, path: Column, shapes: Sequence[tuple[int, int]]) -> Column:
    """The keys of a url that have one of the shapes, as an array."""
    labels = F.size(F.split(host, "[.]"))
    found = [
        F.when((host != "") & (labels >= n) & (F.length(path) >= size), F.concat(F.substring_index(host, ".", -n), F.substring(path, 1, size)))
        for n, size in shapes
    ]
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def _each_hash(keys: Column, seed: int) -> Column:
    return F.transform(keys, lambda k: key_hash(k, seed))


def _passing(keys: DataFrame, level: Bloom) -> DataFrame:
    shared = share(keys.sparkSession, level)

    def start():
        here = shared()
        return lambda cols: pa.array(here.passes(cols[0].to_numpy(zero_copy_only=False)))

    return with_arrow_column(keys, [key_hash(F.col("key"), level.seed)], start, T.StructField("_in", T.BooleanType())).filter("_in").drop("_in")


def build_cascade(universe: DataFrame, listed: DataFrame, seed: int = 0, most: int = 100) -> list[Bloom]:
    """The levels that tell the keys ``listed`` from all others of ``universe`` (both: a column ``key``, distinct)."""
    inside = keep(universe.join(listed, "key", "left_semi"))
    outside = universe.join(listed, "key", "left_anti")
    n, others = inside.count(), outside.count()
    levels: list[Bloom] = []
    encoded, rest = inside, outside
    while n:
        if len(levels) == most:
            raise RuntimeError(f"the cascade did not end within {most} levels")
        rate = 0.5 if levels else min(0.5, max(1e-9, math.sqrt(0.5) * n / max(1, others)))
        if bits_for(n, rate) > MOST_BITS:
            raise ValueError(f"a list of {n} keys needs more than {MOST_BITS} bits; split the list")
        levels.append(build(encoded, n, rate, seed + len(levels), MOST_BITS))
        encoded, rest = keep(_passing(rest, levels[-1])), encoded
        n = encoded.count()
    return levels


def is_listed(levels: list[Bloom], hashes: list[np.ndarray]) -> np.ndarray:
    """Exact membership of keys of the universe, from their hashes for each level."""
    size = len(hashes[0]) if hashes else 0
    side, open_ = np.zeros(size, bool), np.ones(size, bool)
    for i, (level, h) in enumerate(zip(levels, hashes)):
        fails = open_ & ~level.passes(h)
        side[fails] = i % 2 == 1  # fails a level of listed keys: not listed; one of others: listed
        open_ &= ~fails
    side[open_] = len(levels) % 2 == 1
    return side


def with_membership(df: DataFrame, keys: str, levels: list[Bloom], name: str) -> DataFrame:
    """Append the array of those of the array column ``keys`` that are listed."""
    if not levels:
        return df.withColumn(name, F.array().cast("array<string>"))
    shared = share(df.sparkSession, levels)
    hashed = [_each_hash(F.col(keys), level.seed) for level in levels]

    def start():
        here = shared()

        def compute(cols: list[pa.Array]) -> pa.Array:
            flat = [np.asarray(c.flatten().to_numpy(zero_copy_only=False), np.int64) for c in cols[1:]]
            listed = is_listed(here, flat)
            ends = cols[0].offsets.to_numpy()
            ends = ends - ends[0]
            chosen = cols[0].flatten().filter(pa.array(listed))
            counts = np.concatenate([[0], np.cumsum(listed)])[ends].astype(np.int32)
            return pa.ListArray.from_arrays(counts, chosen)

        return compute

    return with_arrow_column(df, [F.col(keys), *hashed], start, T.StructField(name, T.ArrayType(T.StringType())))


def _with_verdict(keys: Column, verdict: str) -> Column:
    return F.transform(keys, lambda k: F.struct(F.length(k).alias("n"), k.alias("key"), F.lit(verdict).alias("verdict")))


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: id, ``host``, ``path``, ``rule`` (the longest that fits, else null) and ``verdict``.

    Of two fitting rules of equal length the greater string wins; a key with both verdicts blocks. A url that no rule fits is
    on no list and allowed. A null url, or one without ``://``, has an empty host and path, which no rule fits. Every row is
    judged by its url alone, repeated rows and null ids too. Other columns are not read.
    """
    spark = pages.sparkSession
    url = F.col(f"`{url_col}`")
    parts = pages.select(F.col(f"`{id_col}`").alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    keyed = parts.withColumn("keys", keys_of(F.col("host"), F.col("path"), shapes_of([k for _, k in rules])))
    universe = keep(keyed.select(F.explode("keys").alias("key")).distinct())
    blocks = {k for v, k in rules if v == "block"}
    lists = {"block": sorted(blocks), "allow": sorted({k for v, k in rules if v == "allow"} - blocks)}
    for i, (verdict, keys) in enumerate(lists.items()):
        listed = spark.createDataFrame([(k,) for k in keys], "key string")
        keyed = with_membership(keyed, "keys", build_cascade(universe, listed, seed=1000 * (i + 1)), verdict)
    fits = F.concat(*[_with_verdict(F.col(v), v) for v in lists])
    return keyed.withColumn("best", F.array_max(fits)).select(
        F.col("id").alias(id_col), "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.verdict", F.lit(UNLISTED)).alias("verdict")
    )


_FITS = [
    f"((host = '{k.partition('/')[0]}' OR ends_with(host, '.{k.partition('/')[0]}')) AND starts_with(path, '/{k.partition('/')[2]}'))"
    for _, k in RULES
]
SQL = f"""
WITH parts AS (SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
longest AS (SELECT *, list_max(list_filter([{', '.join(f"CASE WHEN {f} THEN {{'n': {len(k)}, 'key': '{k}', 'verdict': '{v}'}} END" for f, (v, k) in zip(_FITS, RULES))}],
    lambda x: x IS NOT NULL)) AS best FROM parts)
SELECT page_id, host, path, best.key AS rule, coalesce(best.verdict, '{UNLISTED}') AS verdict FROM longest
"""
