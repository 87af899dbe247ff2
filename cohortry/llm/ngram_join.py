"""N-gram Jaccard self-join with Bayesian candidate pruning (method: BayesLSH with exact verification).

1. Texts are reduced to their words; texts of equal word sequence are one *representative* with a number of copies.
2. Each representative gets MinHash values over its five-word shingles. Representatives that agree in all values of some
   band are joined by an edge to the band bucket's smallest member (linear in the bucket, hot buckets included), and
   connected components of these edges hold every pair that shares a bucket, and more.
3. A large component is dealt into groups by buckets. Each group has a *centre*, a set of shingles, and its members lie in *rings* by
   what they share with it. Exact bounds by these counts tell of two rings that all pairs between them are links, which are then counted
   and not made, or that none is.
4. Rings are cut into blocks of bounded size; two blocks are one unit of work if some bucket has members in both and the bounds leave their rings
   open. Within a unit, pairs are compared a few MinHash values at a time. With m of n values equal and a uniform prior, the similarity's posterior is
   Beta(m + 1, n - m + 1); a pair is dropped once P(similarity >= threshold) falls below the tolerance. Every pair that
   survives all values is verified on the full shingle sets.
5. A unit returns one row per member that has links: its number of links and the smallest member it is connected to in the
   unit. Pairs are never rows. Components of these rows, and of the links that were counted, are the classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from cohortry.llm.bloom import build, key_hash
from cohortry.llm.common import free_name, share, ship_by_value, small_batches, word_text
from cohortry.llm.components import connected, with_least
from cohortry.sources.scratch import keep

WORDS = 5
THRESHOLD = 0.8
TOLERANCE = 1e-7
BANDS, ROWS = 40, 6  # a pair at 0.8 misses every band with probability (1 - 0.8**6)**40 = 5e-6
STEP = 16  # MinHash values compared at a time
BLOCK_MEMBERS = 64
BLOCK_SHINGLES = 1_000_000
SCALE = 1_000_000  # the threshold is compared in whole millionths
LEVELS = 1024  # steps of nearness to a centre, so many for the part a text may share with it
CACHED_WORDS = 100_000
FILTER_BITS = 1 << 27  # most bits (16 MB) of the filter that holds back texts without candidates

ship_by_value(__name__)


class _WordHash(dict):
    """Hashes of words, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(words: list[str], hashes: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a shorter text is one shingle of all its words."""
    n, k = len(words), min(WORDS, len(words))
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    acc = h[: n - k + 1].copy()
    for j in range(1, k):
        acc = acc * np.uint64(0x9E3779B97F4A7C15) + h[j : n - k + 1 + j]
    acc ^= acc >> np.uint64(31)
    acc *= np.uint64(0xBF58476D1CE4E5B9)
    acc ^= acc >> np.uint64(29)
    return np.unique(acc)


FACTORS, OFFSETS = np.random.default_rng(20240229).integers(0, 2**32, (2, BANDS * ROWS), dtype=np.uint32)
FACTORS |= np.uint32(1)


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    """The least value of the shingles under each of the hash functions."""
    h, least = (shingles >> np.uint64(32)).astype(np.uint32), np.full(BANDS * ROWS, 2**32 - 1, np.uint32)
    for i in range(0, len(h), 128):  # small enough for the processor's cache
        np.minimum(least, (h[i : i + 128, None] * FACTORS + OFFSETS).min(axis=0), out=least)
    return least


def band_keys(signature: np.ndarray) -> np.ndarray:
    acc = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for column in signature.reshape(BANDS, ROWS).T.astype(np.uint64):
        acc = (acc ^ column) * np.uint64(0x94D049BB133111EB)
        acc ^= acc >> np.uint64(32)
    return acc.view(np.int64)


def digest_of(words: Column) -> Column:
    """16 bytes of the sha256 of a text's words."""
    return F.substring(F.unhex(F.sha2(words.cast("binary"), 256)), 1, 16)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = _WordHash()
    for b in small_batches(batches):
        sizes, bands = [], []
        for text in b.column(2).to_pylist():
            s = shingle_set(text.split(), hashes)
            sizes.append(len(s))
            bands.append(band_keys(min_hashes(s)) if len(s) else np.empty(0, np.int64))
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in bands])]).astype(np.int32)
        flat = np.concatenate([np.empty(0, np.int64), *bands])
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(offsets, flat)],
            names=["doc_id", "digest", "shingles", "bands"],
        )


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles and MinHash values of the texts."""
    hashes = _WordHash()
    names = ["node", "copies"]
    for b in small_batches(batches):
        sets = [shingle_set(t.split(), hashes) for t in b.column("words").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                *[b.column(c) for c in names],
                pa.array([s.tobytes() for s in sets], pa.binary()),
                pa.array([min_hashes(s).tobytes() for s in sets], pa.binary()),
            ],
            names=[*names, "shingles", "signature"],
        )


def least_matches(threshold: float, tolerance: float) -> dict[int, int]:
    """For n compared values, the fewest equal ones with which a pair stays: P(Beta(m+1, n-m+1) >= t) = P(Bin(n+1, t) <= m)."""
    out = {}
    for n in range(STEP, BANDS * ROWS + 1, STEP):
        mass, total, m = (1 - threshold) ** (n + 1), 0.0, 0
        while True:
            total += mass
            if total >= tolerance:
                break
            mass *= (n + 1 - m) / (m + 1) * threshold / (1 - threshold)
            m += 1
        out[n] = m
    return out


def surviving_pairs(a: np.ndarray, b: np.ndarray, pairs: tuple[np.ndarray, np.ndarray], threshold: float, tolerance: float):
    """The pairs (rows of a, rows of b) that the incremental comparison does not drop."""
    i, j = pairs
    equal, limits = np.zeros(len(i), np.int64), least_matches(threshold, tolerance)
    for k in range(0, BANDS * ROWS, STEP):
        equal += (a[i, k : k + STEP] == b[j, k : k + STEP]).sum(axis=1)
        stay = equal >= limits[k + STEP]
        i, j, equal = i[stay], j[stay], equal[stay]
    return i, j


def _common(one: np.ndarray, values: np.ndarray, owners: np.ndarray, members: int) -> np.ndarray:
    """Number of shingles a set shares with each member, by the members' sorted postings."""
    lo, hi = np.searchsorted(values, one, "left"), np.searchsorted(values, one, "right")
    n = hi - lo
    at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    return np.bincount(owners[at], minlength=members)


def linked(left: list[np.ndarray], right: list[np.ndarray], sig_l, sig_r, same: bool, threshold: float, tolerance: float) -> np.ndarray:
    """Boolean matrix of the pairs with Jaccard similarity of at least the threshold."""
    out = np.zeros((len(left), len(right)), bool)
    nl, nr = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    scale, least = SCALE, round(threshold * SCALE)
    fits = np.minimum(nl[:, None], nr[None, :]) * scale >= least * np.maximum(nl[:, None], nr[None, :])
    i, j = surviving_pairs(sig_l, sig_r, np.nonzero(np.triu(fits, 1) if same else fits), threshold, tolerance)
    if len(i):
        values, owners = np.concatenate(right), np.repeat(np.arange(len(right)), nr)
        order = np.argsort(values, kind="stable")
        values, owners = values[order], owners[order]
        for r in np.unique(i):
            js = j[i == r]
            both = _common(left[r], values, owners, len(right))[js]
            out[r, js] = both * scale >= least * (nl[r] + nr[js] - both)
    return out


def _unit(table: pa.Table, threshold: float, tolerance: float) -> pa.Table:
    """Links among the members of one block, or between those of two."""
    nodes, first = np.unique(table.column("node").to_numpy(), return_index=True)
    rows = table.take(pa.array(first))
    copies, chunk = rows.column("copies").to_numpy(), rows.column("chunk").to_numpy()
    sets = [np.frombuffer(x, np.uint64) for x in rows.column("shingles").to_pylist()]
    sig = np.stack([np.frombuffer(x, np.uint32) for x in rows.column("signature").to_pylist()])
    same = table.column("lo")[0].as_py() == table.column("hi")[0].as_py()
    at = np.arange(len(nodes))
    a = at if same else at[chunk == table.column("lo")[0].as_py()]
    b = at if same else at[chunk == table.column("hi")[0].as_py()]
    found = np.zeros((len(nodes), len(nodes)), bool)
    if len(a) and len(b):
        found[np.ix_(a, b)] = linked([sets[x] for x in a], [sets[x] for x in b], sig[a], sig[b], same, threshold, tolerance)
    found |= found.T
    root = at.copy()
    while True:
        after = np.minimum(root, np.where(found, root[None, :], len(nodes)).min(axis=1))
        if (after == root).all():
            break
        root = after
    has = found.any(axis=1)
    return pa.table({"node": nodes[has], "root": nodes[root[has]], "links": (found * copies[None, :]).sum(axis=1)[has].astype(np.int64)})


def _centre(table: pa.Table) -> pa.Table:
    """The shingles that more than half of a group's sampled members hold. Any set would give right bounds; this one is near to many."""
    sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
    values, n = np.unique(np.concatenate(sets), return_counts=True)
    return pa.table({"home": table.column("home")[:1], "centre": pa.array([values[2 * n > len(sets)].tobytes()], pa.binary())})


def _nearness(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many shingles each member shares with its centre, and the size of that."""
    for b in small_batches(batches):
        both, sizes = [], []
        for one, centre in zip(b.column("set"), b.column("centre")):
            a, c = np.frombuffer(one.as_py(), np.uint64), np.frombuffer(centre.as_py() or b"", np.uint64)
            both.append(len(np.intersect1d(a, c, assume_unique=True)))
            sizes.append(len(c))
        kept = ["home", "node", "copies", "shingles"]
        yield pa.RecordBatch.from_arrays(
            [*[b.column(c) for c in kept], pa.array(both, pa.int64()), pa.array(sizes, pa.int64())], names=[*kept, "inside", "size"]
        )


def _rings(homed: DataFrame, signed: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Members ``node, copies, home, ring, chunk`` of large components, and ``home, ring, other, all``: the rings that need no comparison, all linked or none.

    Of n shingles of a member, i lie in the centre of c and x outside. Two members share at least i + i' - c, at most i + x' or i' + x.
    They are linked if S * shared >= L * (n + n'), with L the threshold and S one more, in whole numbers. With f = S * i - L * n and g = S * x - L * n:
    they are if f + f' >= S * c, and are not if f + g' < 0 or f' + g < 0. Rings are ranges of f and tell with their extremes.
    """
    least = round(threshold * SCALE)
    whole = SCALE + least
    parts = homed.groupBy("home").agg(_blocks_for().alias("parts"))
    dealt = homed.join(parts, "home").withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    dealt = dealt.join(signed.select("node", F.col("shingles").alias("set")), "node")
    # one part of each group is an even sample of at most about a block; the centre goes to each part, not to one task
    centres = dealt.filter("part = 0").select("home", F.col("set").alias("shingles")).groupBy("home").applyInArrow(_centre, "home long, centre binary")
    sent = centres.join(parts, "home").select("home", "centre", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    near = dealt.join(sent, ["home", "part"], "left").select("home", "node", "copies", "shingles", "set", "centre")
    told = near.mapInArrow(_nearness, "home long, node long, copies long, shingles long, inside long, size long").select(
        "home",
        "node",
        "copies",
        "shingles",
        (F.col("size") * whole).alias("enough"),
        (F.col("inside") * whole - F.col("shingles") * least).alias("f"),
        ((F.col("shingles") - F.col("inside")) * whole - F.col("shingles") * least).alias("g"),
    )
    step = F.floor(F.col("f") * LEVELS / F.col("enough")).cast("int")
    told = keep(told.withColumn("level", F.when(F.col("enough") > 0, F.greatest(step, F.lit(-LEVELS))).otherwise(0)))
    levels = told.groupBy("home", "level").agg(
        F.count("*").alias("members"),
        F.sum("shingles").alias("shingles"),
        F.sum("copies").alias("copies"),
        F.max("enough").alias("enough"),
        F.min("f").alias("f0"),
        F.max("f").alias("f1"),
        F.max("g").alias("g1"),
    )
    before = Window.partitionBy("home").orderBy("level").rowsBetween(Window.unboundedPreceding, -1)  # a few thousand levels a group at most
    filled = [F.floor(F.coalesce(F.sum(c).over(before), F.lit(0)) / n) for c, n in (("members", BLOCK_MEMBERS), ("shingles", BLOCK_SHINGLES))]
    levels = keep(levels.withColumn("ring", (filled[0] + filled[1]).cast("long")))
    rings = levels.groupBy("home", "ring").agg(
        F.greatest(F.ceil(F.sum("members") / BLOCK_MEMBERS), F.ceil(F.sum("shingles") / BLOCK_SHINGLES)).cast("int").alias("parts"),
        F.sum("copies").alias("copies"),
        F.max("enough").alias("enough"),
        F.min("f0").alias("f0"),
        F.max("f1").alias("f1"),
        F.max("g1").alias("g1"),
    )
    placed = told.join(levels.select("home", "level", "ring"), ["home", "level"]).join(rings.select("home", "ring", "parts"), ["home", "ring"])
    cut = placed.select(
        "node", "copies", "home", "ring", F.xxhash64("home", "ring", F.pmod(F.xxhash64("node"), "parts").cast("int")).alias("chunk")
    )
    to = rings.select("home", F.col("ring").alias("other"), F.col("copies").alias("others"), *[F.col(c).alias(f"{c}_") for c in ("f0", "f1", "g1")])
    every, none = F.expr("f0 + f0_ >= enough and enough > 0"), F.expr("f1 + g1_ < 0 or f1_ + g1 < 0")
    decided = rings.join(to, "home").select("home", "ring", "other", "others", every.alias("all"), none.alias("none")).filter("all or none")
    return keep(cut), keep(decided.select("home", "ring", "other", "others", "all"))


def _sure_links(cut: DataFrame, decided: DataFrame) -> DataFrame:
    """``node, root, links`` of the pairs of rings that are linked throughout.

    A ring that is linked to any other is linked to the nearest one, and this one within itself: so all hang on one member of it.
    """
    linked_rings = decided.filter("all").groupBy("home", "ring").agg(F.sum("others").alias("others"), F.max(F.col("ring") == F.col("other")).alias("own"))
    top = linked_rings.groupBy("home").agg(F.max("ring").alias("ring"))
    root = cut.join(top, ["home", "ring"]).groupBy("home").agg(F.min("node").alias("root"))
    found = cut.join(linked_rings.join(root, "home"), ["home", "ring"])
    return found.select("node", "root", (F.col("others") - F.when(F.col("own"), F.col("copies")).otherwise(0)).alias("links"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    words = word_text(F.col(f"`{text_col}`"))
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), words.alias("words")).select("doc_id", digest_of(F.col("words")).alias("digest"), "words")


def _texts(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``digest, words`` of the wanted representatives (``doc_id, digest``), one row each.

    A Bloom filter of their ids holds the other texts back before anything is shuffled; rows without an id pass if a wanted one has none.
    Copies are folded where they lie, so a text that stands under one id, or none, any number of times is sent once a task.
    """
    ids = wanted.filter("doc_id is not null").select(F.col("doc_id").alias("key"))
    shared = share(docs.sparkSession, build(ids, wanted.count(), 0.01, 8, FILTER_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted_ids = shared()
        for b in batches:
            passes = wanted_ids.passes(b.column(2).to_numpy(zero_copy_only=False)) | b.column(0).is_null().to_numpy(zero_copy_only=False)
            yield b.filter(pa.array(passes)).select(["doc_id", "text"])

    two = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    if wanted.filter("doc_id is null").isEmpty():
        two = two.filter("doc_id is not null")
    possible = two.withColumn("h", key_hash(F.col("doc_id"), 8)).mapInArrow(run, two.schema)
    return _keyed(possible, "doc_id", "text").groupBy("digest").agg(F.first("words").alias("words"))


def _id_field(docs: DataFrame, id_col: str) -> T.StructField:
    return T.StructField("doc_id", next(f.dataType for f in docs.schema.fields if f.name == id_col))


def _blocks_for() -> Column:
    """Aggregate: how many blocks members call for, by their number and their shingles."""
    return F.greatest(F.ceil(F.count("*") / BLOCK_MEMBERS), F.ceil(F.sum("shingles") / BLOCK_SHINGLES)).cast("int")


def _classes(docs: DataFrame, id_col: str, text_col: str, threshold: float, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """Sketches of all documents (doc_id, digest), and the representatives with links and class: digest, class, n_links."""
    keyed = _keyed(docs, id_col, text_col)
    fields = [T.StructField("digest", T.BinaryType()), T.StructField("shingles", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))]
    sketches = keep(keyed.mapInArrow(_sketch, T.StructType([_id_field(docs, id_col), *fields])))
    grouped = (
        sketches.filter("shingles > 0")
        .groupBy("digest")  # the least known id: min passes over nulls
        .agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("shingles").alias("shingles"), F.first("bands").alias("bands"))
    )
    reps = keep(grouped.withColumn("node", F.monotonically_increasing_id()))

    banded = reps.select("node", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.min("node").alias("v"), F.count("*").alias("n")).filter("n > 1").drop("n")
    near = banded.join(shared, "key").select(F.col("node").alias("u"), "v")
    members = connected(near).select("node", F.col("root").alias("component")).join(reps.drop("bands"), "node")
    members = keep(members)
    size = members.groupBy("component").agg(_blocks_for().alias("blocks"))
    whole = members.join(size.filter("blocks = 1"), "component").select(F.xxhash64("component", F.lit(-1)).alias("chunk"), "node")
    signed = keep(
        _texts(docs, members, id_col, text_col).join(members.select("node", "copies", "digest"), "digest").mapInArrow(
            _signatures, "node long, copies long, shingles binary, signature binary"
        )
    )
    large = members.join(size.filter("blocks > 1").select("component"), "component").select("node", "copies", "shingles")
    near_by = keep(near.unionByName(near.select(F.col("v").alias("u"), "v").distinct()).groupBy("u").agg(F.min("v").alias("home")))
    heads = near_by.select("home").distinct().join(near_by.select(F.col("u").alias("home"), F.col("home").alias("head")), "home")
    homed = large.join(near_by.withColumnRenamed("u", "node"), "node").join(heads, "home")
    homed = keep(homed.select("node", "copies", "shingles", F.col("head").alias("home")))
    cut, decided = _rings(homed, signed, threshold)
    placed = keep(whole.unionByName(cut.select("chunk", "node")))
    met = banded.join(shared.select("key"), "key").join(cut.select("node", "chunk"), "node").select("key", "chunk").distinct()
    pairs = met.select("key", F.col("chunk").alias("lo")).join(met.select("key", F.col("chunk").alias("hi")), "key").filter("lo <= hi")
    at = cut.select("chunk", "home", "ring").distinct()
    sided = pairs.select("lo", "hi").distinct().join(at.withColumnRenamed("chunk", "lo"), "lo")
    sided = sided.join(at.select(F.col("chunk").alias("hi"), F.col("home").alias("home_"), F.col("ring").alias("other")), "hi")
    known = decided.select("home", F.col("home").alias("home_"), "ring", "other")
    open_ = sided.join(known, ["home", "home_", "ring", "other"], "left_anti").select("lo", "hi")
    pairs = keep(open_.unionByName(whole.select(F.col("chunk").alias("lo"), F.col("chunk").alias("hi")).distinct()))
    sides = pairs.select("lo", "hi", F.col("lo").alias("chunk")).unionByName(pairs.filter("lo < hi").select("lo", "hi", F.col("hi").alias("chunk")))
    units = signed.join(placed, "node").join(sides, "chunk")
    compared = units.groupBy("lo", "hi").applyInArrow(lambda t: _unit(t, threshold, tolerance), "node long, root long, links long")
    links = keep(compared.unionByName(_sure_links(cut, decided)))

    total = links.groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected(links.select(F.col("node").alias("u"), F.col("root").alias("v")))
    linked_reps = reps.select("node", "digest", "doc_id", "copies").join(total, "node", "left").join(roots, "node", "left")
    linked_reps = linked_reps.withColumn("root", F.coalesce("root", "node"))
    named = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "digest")
    told = with_least(linked_reps.select("root", named.alias("name"), "digest", "copies", "links"), "root", "name", "class", "digest")
    decided = keep(told.select("digest", "class", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    return sketches.select("doc_id", "digest"), decided


def jaccard_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, tolerance: float = TOLERANCE
) -> DataFrame:
    """One row per document: its id, ``class_id`` (smallest id among the documents it is linked to, directly or through
    others) and ``n_links`` (number of other documents with similarity of at least the threshold).

    Every row is a document: a repeated row is a copy of the first, and rows of one id with different texts are told apart by these. A
    null or wordless text has no links and is its own class. A text of fewer than five words is one shingle. Rows with a
    null id take part like any others; a class without any other id has a null one. Other columns are not read, whatever their
    names. An empty table gives an empty result.
    """
    sketches, decided = _classes(docs, id_col, text_col, threshold, tolerance)
    return sketches.join(decided, "digest", "left").select(
        F.col("doc_id").alias(id_col),
        F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("class.doc_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def one_of_each(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, tolerance: float = TOLERANCE
) -> DataFrame:
    """The documents without near copies: of each class one stays, that with the smallest id, whole rows, same columns.

    Rows without an id are compared like the others and stay only where their class has no id at all. Of rows with equal id and words
    one stays. Rows with a null text or without words always stay.
    """
    sketches, decided = _classes(docs, id_col, text_col, threshold, tolerance)
    mark = free_name(docs.columns, "_digest")
    marked = docs.withColumn(mark, digest_of(word_text(F.col(f"`{text_col}`"))))
    folded = sketches.groupBy("doc_id", "digest").agg(F.count("*").alias("n"))  # first, so that the join may split a digest of many copies
    counted = keep(
        folded.join(decided.select("digest", "class"), "digest").select(
            F.col("doc_id").alias("_k1"),
            F.col("digest").alias("_k2"),
            ((F.col("class.digest") == F.col("digest")) & F.col("class.doc_id").eqNullSafe(F.col("doc_id"))).alias("stays"),
            "n",
        )
    )
    same = F.col(f"`{id_col}`").eqNullSafe(F.col("_k1")) & (F.col(mark) == F.col("_k2"))
    left = marked.join(counted.filter("not stays").select("_k1", "_k2"), same, "left_anti")
    repeated = counted.filter("stays and n > 1").select("_k1", "_k2")
    if repeated.isEmpty():
        return left.drop(mark)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = left.join(repeated, same, "left_semi").groupBy(F.col(f"`{id_col}`").alias("_k1"), F.col(mark).alias("_k2")).agg(
        F.min_by(whole, F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])).alias("_row")
    )
    return left.join(repeated, same, "left_anti").drop(mark).unionByName(one.select("_row.*"))
