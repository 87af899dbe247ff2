"""Benchmark decontamination: a BM25 inverted index of test items, queried by every training passage.

The index holds, for each term, the items with an integer impact: the term's BM25 weight in the item, scaled so that an
item's impacts sum to about ``ONE``. A passage's score for an item is the sum of the impacts of the terms they share, and
all items above the threshold are retrieved. Items are laid out in blocks with the maximum impact of each term per block
(block-max WAND): of each block, the cheapest terms are set aside as long as their maxima together stay below half the
threshold, since they can lift nothing to the threshold alone. Only postings of the other terms are read; a block is scored
exactly only if the maxima found, with all that was set aside, can reach the threshold. Nothing above the threshold is lost.

Retrieved pairs are then verified: the item's question and its answer must each overlap the passage by word n-grams. Where edited
copies are asked for, a pair is also accepted if few word edits turn the whole item into a stretch of the passage.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.llm.common import free_name, share, ship_by_value, with_arrow_column, word_text
from cohortry.sources.scratch import keep

ship_by_value(__name__)

K1, B = 1.2, 0.75
ONE = 65536
SCORE = 0.6  # share of the item's own score
OVERLAP = 0.8  # share of the n-grams of the question, and of the answer
NGRAM = 5
EDITS = 0.2  # share of the words of an item that may be replaced, left out or added in an edited copy
LEAST_STRIDE = 64  # passages are two strides long; an item's stride is the least of 64, 128, 256, … that is no shorter than it
BLOCK_ITEMS = 4
SHARD_POSTINGS = 2_000_000  # postings of the index broadcast at a time
CHUNK_WORDS = 400_000
LAST_SENTENCE = r"(?s)^(.*[.!?])\s+(\S.*)$"


def _words(text: Column) -> Column:
    return F.filter(F.split(word_text(text), " "), lambda w: w != "")


def _stride(words: Column) -> Column:
    return F.when(words <= LEAST_STRIDE, F.lit(LEAST_STRIDE)).otherwise(
        LEAST_STRIDE * F.pow(F.lit(2), F.length(F.bin(F.floor((words - 1) / LEAST_STRIDE)))).cast("int")
    )


def build_index(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The items (slot, item_id, words, question, answer) and the postings (slot, term, impact).

    The answer is the last sentence, the question what precedes it; a single sentence is all question. Repeated rows are one
    item, rows of one id with different texts are items of the same id. Rows without an id or without words take no part.
    Both carry ``stride``, half the length of the passages that an item is looked for in.
    """
    text = F.col("text")
    named = items.select(F.col(f"`{id_col}`").alias("item_id"), F.col(f"`{text_col}`").alias("text")).filter("item_id is not null").distinct()
    split = named.withColumn("cut", F.regexp_extract(text, LAST_SENTENCE, 1) != "")
    slots = keep(
        split.select(
            F.monotonically_increasing_id().alias("slot"),
            "item_id",
            _words(text).alias("words"),
            F.when(F.col("cut"), _words(F.regexp_extract(text, LAST_SENTENCE, 1))).otherwise(_words(text)).alias("question"),
            F.when(F.col("cut"), _words(F.regexp_extract(text, LAST_SENTENCE, 2))).otherwise(F.array().cast("array<string>")).alias("answer"),
        )
        .filter(F.size("words") > 0)
        .withColumn("stride", _stride(F.size("words")))
    )
    whole = slots.agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("len")).first()
    n, mean = whole["n"], whole["len"] or 1.0
    tf = slots.select("slot", F.size("words").alias("len"), F.explode("words").alias("term")).groupBy("slot", "len", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    weight = (
        F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / mean))
    )
    weighed = keep(tf.join(df, "term").select("slot", _stride(F.col("len")).alias("stride"), "term", weight.alias("w")))
    own = weighed.groupBy("slot").agg(F.sum("w").alias("own"))
    postings = keep(weighed.join(own, "slot").select("slot", "stride", "term", F.floor(F.col("w") / F.col("own") * ONE + 0.5).cast("long").alias("impact")))
    return slots, postings


def _grams(words: list[str]) -> list[tuple[str, ...]]:
    k = min(NGRAM, len(words))
    return sorted({tuple(words[i : i + k]) for i in range(len(words) - k + 1)}) if k else []


def _spread(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All positions of the ranges, one range after the other."""
    n = ends - starts
    return np.repeat(starts - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())


@dataclass
class Shard:
    """Part of the index in memory: some of the items with all of their postings."""

    vocabulary: dict[str, int]
    item_ids: list
    questions: list
    answers: list
    wholes: list
    starts: np.ndarray  # of each term's postings
    items: np.ndarray
    impacts: np.ndarray
    lead_starts: np.ndarray  # of each term's (block, greatest impact) that are read first
    lead_blocks: np.ndarray
    lead_impacts: np.ndarray
    aside: np.ndarray  # of each block, the sum of the maxima set aside
    stride: int
    least: int

    def scores(self, terms: np.ndarray, block: int) -> np.ndarray:
        """Exact scores of a block's items for a set of terms."""
        at = _spread(self.starts[terms], self.starts[terms + 1])
        items = self.items[at] - block * BLOCK_ITEMS
        inside = (items >= 0) & (items < BLOCK_ITEMS)
        return np.bincount(items[inside], self.impacts[at][inside], minlength=BLOCK_ITEMS).astype(np.int64)


def make_shard(slots: list, postings: list, stride: int, score: float) -> Shard:
    """Lay out the items (slot, item_id, words, question, answer) and postings (slot, term, impact) of one shard."""
    slots = sorted(slots, key=lambda r: r["slot"])
    place = {r["slot"]: i for i, r in enumerate(slots)}
    terms = sorted({p["term"] for p in postings})
    vocabulary = {t: i for i, t in enumerate(terms)}
    rows = np.array(sorted((vocabulary[p["term"]], place[p["slot"]], p["impact"]) for p in postings), np.int64).reshape(-1, 3)
    term, item, impact = rows.T
    starts = np.searchsorted(term, np.arange(len(terms) + 1))
    least = -int(-score * ONE // 1)

    blocks = -(-len(slots) // BLOCK_ITEMS)
    key, at = np.unique(term * blocks + item // BLOCK_ITEMS, return_inverse=True)
    top = np.zeros(len(key), np.int64)
    np.maximum.at(top, at, impact)
    t, b = key // blocks, key % blocks
    order = np.lexsort((top, b))  # per block, cheapest first
    running = np.cumsum(top[order])
    first = np.searchsorted(b[order], np.arange(blocks))
    before = np.concatenate([[0], running])[first]
    lead = np.empty(len(key), bool)
    lead[order] = running - before[b[order]] > least // 2
    aside = np.bincount(b[~lead], top[~lead], minlength=blocks).astype(np.int64)
    return Shard(
        vocabulary, [r["item_id"] for r in slots], [_grams(r["question"]) for r in slots], [_grams(r["answer"]) for r in slots], [r["words"] for r in slots],
        starts, item, impact, np.searchsorted(t[lead], np.arange(len(terms) + 1)), b[lead], top[lead], aside, stride, least,
    )


def candidate_blocks(shard: Shard, lengths: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Passages (document, number within it) and blocks whose upper bound reaches the threshold.

    ``ids`` are the term numbers of the words of all documents in a row (-1: not in the index), ``lengths`` the documents'.
    """
    s, blocks = shard.stride, len(shard.aside)
    windows = np.maximum(-(-(lengths - 2 * s) // s), 0) + 1
    base = np.concatenate([[0], np.cumsum(windows)])
    read_first = np.diff(shard.lead_starts) > 0
    at = np.nonzero((ids >= 0) & read_first[ids])[0]
    doc = np.searchsorted(np.cumsum(lengths), at, "right")
    k = (at - (np.cumsum(lengths) - lengths)[doc]) // s
    inside, earlier = k < windows[doc], k > 0
    passage = np.concatenate([(base[doc] + k)[inside], (base[doc] + k - 1)[earlier]])
    terms = len(shard.vocabulary)
    pairs = np.unique(passage * terms + np.concatenate([ids[at][inside], ids[at][earlier]]))
    passage, term = pairs // terms, pairs % terms
    lo, hi = shard.lead_starts[term], shard.lead_starts[term + 1]
    cells = _spread(lo, hi)
    key, where = np.unique(np.repeat(passage, hi - lo) * blocks + shard.lead_blocks[cells], return_inverse=True)
    bound = np.bincount(where, shard.lead_impacts[cells], minlength=len(key)) + shard.aside[key % blocks]
    key = key[bound >= shard.least]
    passage = key // blocks
    doc = np.searchsorted(base, passage, "right") - 1
    return doc, passage - base[doc], key % blocks


def _overlap(grams: list[tuple[str, ...]], passage: list[str], seen: dict[int, set]) -> float:
    if not grams:
        return 1.0
    k = len(grams[0])
    if k not in seen:
        seen[k] = set(zip(*[passage[i:] for i in range(k)]))
    return sum(g in seen[k] for g in grams) / len(grams)


def word_edits(item: list[str], passage: list[str]) -> int:
    """Fewest words to replace, leave out or add so that the item is a stretch of the passage (bit-parallel, a bit a word)."""
    places: dict[str, int] = {}
    for i, w in enumerate(item):
        places[w] = places.get(w, 0) | 1 << i
    full, top = (1 << len(item)) - 1, 1 << len(item) - 1
    more, fewer = full, 0  # whether the distance rises or falls from one word of the item to the next
    now = best = len(item)
    for w in passage:
        here = places.get(w, 0)
        flat = (((here & more) + more) ^ more) | here
        up, down = fewer | full & ~(flat | more), more & flat
        now += bool(up & top) - bool(down & top)
        best = min(best, now)
        up, down, here = up << 1, down << 1, here | fewer
        more, fewer = (down | ~(here | up)) & full, up & here & full
    return best


def leaks_of(shard: Shard, texts: list[list[str]], edits: float = 0.0) -> list[list[tuple]]:
    """For each document (list of words) its verified items: (item_id, score, question overlap, answer overlap).

    With ``edits``, also those with at most this share of their words edited.
    """
    out: list[dict] = [{} for _ in texts]
    if not shard.item_ids:
        return [[] for _ in texts]
    lengths = np.array([len(w) for w in texts], np.int64)
    lookup = shard.vocabulary.get
    ids = np.concatenate([np.empty(0, np.int64), *[np.fromiter(map(lookup, w, repeat(-1)), np.int64, len(w)) for w in texts]])
    ends = np.cumsum(lengths)
    s, last, seen = shard.stride, None, {}
    for doc, k, block in zip(*candidate_blocks(shard, lengths, ids)):
        lo = ends[doc] - lengths[doc] + k * s
        terms = np.unique(ids[lo : min(lo + 2 * s, ends[doc])])
        scores = shard.scores(terms[terms >= 0], block)
        for i in np.nonzero(scores >= shard.least)[0]:
            if last != (doc, k):
                last, seen = (doc, k), {}
            item = block * BLOCK_ITEMS + i
            passage = texts[doc][k * s : k * s + 2 * s]
            q, a = _overlap(shard.questions[item], passage, seen), _overlap(shard.answers[item], passage, seen)
            whole = shard.wholes[item]
            if (q >= OVERLAP and a >= OVERLAP) or (edits and word_edits(whole, passage) <= edits * len(whole)):
                name, found = shard.item_ids[item], (int(scores[i]), q, a)
                out[doc][name] = tuple(map(max, out[doc].get(name, found), found))
    return [[(name, *best) for name, best in d.items()] for d in out]


def _chunks(texts: list[str]):
    """Documents as lists of words, so many at a time that they have about CHUNK_WORDS words."""
    part, words = [], 0
    for t in texts:
        part.append(t.split())
        words += len(part[-1])
        if words >= CHUNK_WORDS:
            yield part
            part, words = [], 0
    yield part


def with_leaks(docs: DataFrame, items: DataFrame, name: str, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", score: float = SCORE, edits: float = 0.0) -> DataFrame:
    """The documents with an array column ``name`` of (item_id, score, question_overlap, answer_overlap).

    Items are looked for in passages of twice their own stride, so a long item does not widen the passages of others. The index is
    broadcast in shards of one stride and at most about ``SHARD_POSTINGS`` postings; each shard is one more step over the same
    rows, without an exchange. ``edits`` is the share of an item's words that may be edited in a copy. A null, empty or wordless
    text leaks nothing. Every row is judged by its text alone.
    """
    spark = docs.sparkSession
    slots, postings = build_index(items, item_id, item_text)
    sizes = postings.groupBy("stride").count().orderBy("stride").collect()  # strides double: one row per doubling
    shards = [(r["stride"], i, n) for r in sizes for n in [-(-r["count"] // SHARD_POSTINGS)] for i in range(n)]
    id_type = slots.schema["item_id"].dataType
    hit = T.StructType(
        [T.StructField("item_id", id_type), T.StructField("score", T.LongType()), T.StructField("question_overlap", T.DoubleType()), T.StructField("answer_overlap", T.DoubleType())]
    )
    columns, parts = docs.columns, []
    words = word_text(F.col(f"`{text_col}`"))
    for stride, i, n in shards:
        mine = (F.col("stride") == stride) & (F.pmod(F.xxhash64("slot"), F.lit(n)) == i)
        shard = make_shard(
            slots.filter(mine).select("slot", "item_id", "words", "question", "answer").collect(), postings.filter(mine).collect(), stride, score
        )
        part = free_name([*columns, name, *parts], f"_leaks{len(parts)}")
        docs = with_arrow_column(docs, [words], _finder(share(spark, shard), edits), T.StructField(part, T.ArrayType(hit)))
        parts.append(part)
    found = F.concat(*[F.col(f"`{p}`") for p in parts]) if parts else F.array().cast(T.ArrayType(hit))
    return docs.select(*[F.col(f"`{c}`") for c in columns], found.alias(name))


def _finder(shared: Callable[[], Shard], edits: float) -> Callable:
    names = ["item_id", "score", "question_overlap", "answer_overlap"]

    def start():
        shard = shared()
        first = pa.string() if isinstance(next(iter(shard.item_ids), 0), str) else pa.int64()
        kind = pa.list_(pa.struct(list(zip(names, [first, pa.int64(), pa.float64(), pa.float64()]))))

        def compute(cols: list[pa.Array]) -> pa.Array:
            rows = [hits for part in _chunks(cols[0].to_pylist()) for hits in leaks_of(shard, part, edits)]
            return pa.array([[dict(zip(names, h)) for h in hits] for hits in rows], kind)

        return compute

    return start


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", edits: float = 0.0) -> DataFrame:
    """One row per document and leaked item: ids, best score, best overlaps. Documents without leaks have no row.

    Rows of equal document id are folded to one row per item; documents with a null id share the null id. Columns other than
    those named are not read. ``edits`` is the share of an item's words that may be edited in a copy; the SQL has none.
    """
    two = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias("_text"))
    found = with_leaks(two, items, "_hits", "_text", item_id, item_text, edits=edits).select(id_col, F.explode("_hits").alias("h"))
    return found.groupBy(id_col, F.col("h.item_id").alias("item_id")).agg(
        F.max("h.score").alias("score"), F.max("h.question_overlap").alias("question_overlap"), F.max("h.answer_overlap").alias("answer_overlap")
    )


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that leak no item, copies with a share of up to ``EDITS`` of edited words included: whole rows, same columns."""
    name = free_name(docs.columns, "_leaks")
    return with_leaks(docs, items, name, text_col, edits=EDITS).filter(F.size(F.col(f"`{name}`")) == 0).drop(name)


_GAPS = r"'[^\p{L}\p{M}\p{N}]+'"


def _sql_words(text: str) -> str:
    return f"list_filter(string_split(trim(regexp_replace(lower({text}), {_GAPS}, ' ', 'g')), ' '), lambda w: w <> '')"


def _sql_grams(words: str) -> str:
    k = f"least({NGRAM}, len({words}))"
    return f"CASE WHEN len({words}) = 0 THEN [] ELSE list_distinct(list_transform(generate_series(1, len({words}) - {k} + 1), lambda i: array_to_string({words}[i : i + {k} - 1], ' '))) END"


def _sql_overlap(grams: str) -> str:
    return f"CASE WHEN len({grams}) = 0 THEN 1.0::DOUBLE ELSE len(list_filter({grams}, lambda g: contains(p.body, ' ' || g || ' ')))::DOUBLE / len({grams}) END"


_CUT = "'(?s)^(.*[.!?])\\s+(\\S.*)$'"
SQL = f"""
WITH named AS (SELECT DISTINCT item_id, text FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
parts AS (SELECT row_number() OVER (ORDER BY item_id, text) AS slot, item_id, {_sql_words('text')} AS words,
    CASE WHEN regexp_extract(text, {_CUT}, 1) <> '' THEN {_sql_words(f'regexp_extract(text, {_CUT}, 1)')} ELSE {_sql_words('text')} END AS question,
    CASE WHEN regexp_extract(text, {_CUT}, 1) <> '' THEN {_sql_words(f'regexp_extract(text, {_CUT}, 2)')} ELSE []::VARCHAR[] END AS answer
  FROM named),
items AS (SELECT slot, item_id, len(words) AS n, words, {_sql_grams('question')} AS question, {_sql_grams('answer')} AS answer FROM parts WHERE len(words) > 0),
whole AS (SELECT count(*) AS n, avg(n) AS mean FROM items),
strided AS (SELECT *, CASE WHEN n <= {LEAST_STRIDE} THEN {LEAST_STRIDE} ELSE {LEAST_STRIDE} * (1 << length(bin((n - 1) // {LEAST_STRIDE}))) END AS s FROM items),
tf AS (SELECT slot, n AS len, term, count(*) AS tf FROM (SELECT slot, n, unnest(words) AS term FROM items) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
weighed AS (SELECT slot, term, ln(1 + (whole.n - df + 0.5) / (df + 0.5)) * tf * {K1 + 1} / (tf + {K1} * ({1 - B} + {B} * len / mean)) AS w
  FROM tf JOIN df USING (term) CROSS JOIN whole),
postings AS (SELECT slot, s, term, floor(w / sum(w) OVER (PARTITION BY slot) * {ONE} + 0.5)::BIGINT AS impact FROM weighed JOIN strided USING (slot)),
docs AS (SELECT doc_id, row_number() OVER () AS row_no, {_sql_words("coalesce(text, '')")} AS words FROM documents),
passages AS (SELECT doc_id, row_no, s, k, words[k * s + 1 : k * s + 2 * s] AS words
  FROM (SELECT doc_id, row_no, words, s, unnest(generate_series(0, greatest(ceil((len(words) - 2 * s) / s::DOUBLE), 0)::BIGINT)) AS k FROM docs CROSS JOIN (SELECT DISTINCT s FROM strided))),
terms AS (SELECT DISTINCT row_no, s, k, term FROM (SELECT row_no, s, k, unnest(words) AS term FROM passages)),
scored AS (SELECT row_no, s, k, slot, sum(impact)::BIGINT AS score FROM terms JOIN postings USING (s, term) GROUP BY ALL HAVING sum(impact) >= {-int(-SCORE * ONE // 1)}),
bodies AS (SELECT doc_id, row_no, s, k, ' ' || array_to_string(words, ' ') || ' ' AS body FROM passages),
judged AS (SELECT doc_id, item_id, score, {_sql_overlap('i.question')} AS q, {_sql_overlap('i.answer')} AS a
  FROM scored JOIN bodies p USING (row_no, s, k) JOIN items i USING (slot))
SELECT doc_id, item_id, max(score) AS score, max(q) AS question_overlap, max(a) AS answer_overlap
FROM judged WHERE q >= {OVERLAP} AND a >= {OVERLAP} GROUP BY ALL
"""
