import math
import random
from collections import Counter

from cohortry.llm import decontaminate as D

from .helpers import words_of

ITEMS = [
    (1, "The old harbour master counted seven red lanterns. What colour were the lanterns? They were bright red indeed."),
    (2, "One sentence item without an end that nobody ever answers properly"),
    (3, "one two three four five six seven. eight nine ten"),
    (4, None),
    (5, "  ... "),
    (None, "an item without an id that stands in a document all the same here"),
    (3, "one two three four five six seven. eight nine ten"),
    (6, "The old harbour master sold eleven blue lanterns. Who sold them? The harbour master sold them."),
]
FILLER = " ".join(f"filler{i % 37} word{i % 11} the master" for i in range(60))
DOCS = [
    (10, f"{FILLER} {ITEMS[0][1]} {FILLER}"),
    (11, FILLER),
    (12, None),
    (13, ""),
    (14, ITEMS[1][1].upper() + "!"),
    (15, FILLER * 40 + " " + ITEMS[2][1] + " " + ITEMS[7][1]),
    (15, FILLER * 40 + " " + ITEMS[2][1] + " " + ITEMS[7][1]),
    (16, "one two three four five six seven. then something else entirely"),
    (None, ITEMS[0][1]),
]


def brute_force(docs, items):
    """All passages against all items with floating-point BM25 and plain sets."""
    named = {(i, t): words_of(t) for i, t in items if i is not None and words_of(t)}
    n, mean = len(named), sum(map(len, named.values())) / len(named)
    strides = {key: next(s for s in (D.LEAST_STRIDE << e for e in range(60)) if s >= len(ws)) for key, ws in named.items()}
    df = Counter(w for ws in named.values() for w in set(ws))
    weights = {}
    for key, ws in named.items():
        tf = Counter(ws)
        raw = {
            w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c * (D.K1 + 1) / (c + D.K1 * (1 - D.B + D.B * len(ws) / mean)) for w, c in tf.items()
        }
        weights[key] = {w: math.floor(x / sum(raw.values()) * D.ONE + 0.5) for w, x in raw.items()}
    out = {}
    for doc, text in docs:
        ws = words_of(text)
        for (item, body), w in weights.items():
            stride = strides[item, body]
            for k in range(max(-(-(len(ws) - 2 * stride) // stride), 0) + 1):
                passage = ws[k * stride : k * stride + 2 * stride]
                score = sum(w.get(t, 0) for t in set(passage))
                if score < D.SCORE * D.ONE:
                    continue
                cut = body.rstrip()
                at = max((i for i in range(len(cut) - 1) if cut[i] in ".!?" and cut[i + 1].isspace()), default=-1)
                parts = [words_of(cut[: at + 1]), words_of(cut[at + 1 :])] if at >= 0 else [words_of(cut), []]
                shares = []
                for p in parts:
                    g = min(5, len(p))
                    grams = {tuple(p[i : i + g]) for i in range(len(p) - g + 1)} if g else set()
                    here = {tuple(passage[i : i + g]) for i in range(len(passage) - g + 1)}
                    shares.append(len(grams & here) / len(grams) if grams else 1.0)
                if min(shares) >= D.OVERLAP:
                    old = out.get((doc, item), (0, 0.0, 0.0))
                    out[doc, item] = tuple(map(max, old, (score, *shares)))
    return out


def found(spark, docs=DOCS, items=ITEMS):
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, _in0 int, _hits string")
    i = spark.createDataFrame([(*r, 2) for r in items], "item_id long, text string, slot int")
    rows = D.leaks(d, i).collect()
    assert len(rows) == len({(r["doc_id"], r["item_id"]) for r in rows})
    return {(r["doc_id"], r["item_id"]): (r["score"], r["question_overlap"], r["answer_overlap"]) for r in rows}


def test_leaks_as_by_brute_force(spark):
    got = found(spark)
    assert got == brute_force(DOCS, ITEMS)
    assert set(got) == {(10, 1), (14, 2), (15, 3), (15, 6), (None, 1)}


def test_shards_change_nothing(spark, monkeypatch):
    want = found(spark)
    monkeypatch.setattr(D, "SHARD_POSTINGS", 15)
    monkeypatch.setattr(D, "CHUNK_WORDS", 50)
    assert found(spark) == want


def test_generated_documents_as_by_brute_force(spark):
    base = "/root/testdata/sf0.001"
    docs, items = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/benchmark.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = brute_force(rows, [(r["item_id"], r["text"]) for r in items.collect()])
    got = {(r["doc_id"], r["item_id"]): (r["score"], r["question_overlap"], r["answer_overlap"]) for r in D.leaks(docs, items).collect()}
    assert got == want and len(got) > 0


def test_a_long_item_changes_no_other(spark):
    """Answer and question of an item 600 words apart are no leak, whatever else is in the benchmark; the long item is found."""
    rng = random.Random(8)
    long = " ".join("".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(5000))
    apart = "eight nine ten " + " ".join(f"between{i}" for i in range(600)) + " one two three four five six seven."
    docs = [(1, apart), (2, f"{FILLER} {long} {FILLER}"), (3, long[: len(long) // 2]), (4, ITEMS[2][1]), (5, f"{FILLER} {ITEMS[0][1]}")]
    alone, more = found(spark, docs), found(spark, docs, [*ITEMS, (9, long)])
    assert set(alone) == {(4, 3), (5, 1)} and set(more) == {*alone, (2, 9)}
    assert more == brute_force(docs, [*ITEMS, (9, long)])


def test_sql_with_items_of_all_lengths(spark):
    import duckdb

    rng = random.Random(9)
    items = [*ITEMS, *[(20 + n, " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))) for n in (63, 64, 65, 128, 129, 300)]]
    docs = [*DOCS, *[(100 + i, f"{FILLER} {t} {FILLER}") for i, (_, t) in enumerate(items) if t]]
    db = duckdb.connect()
    db.register("documents", spark.createDataFrame(docs, "doc_id long, text string").toArrow())
    db.register("benchmark", spark.createDataFrame(items, "item_id long, text string").toArrow())
    want = {tuple(r[:2]): tuple(r[2:]) for r in db.execute(D.SQL).fetchall()}
    assert want == found(spark, docs, items) == brute_force(docs, items) and len(want) >= 12


def test_empty_tables(spark):
    assert found(spark, docs=[]) == {}
    assert found(spark, items=[]) == {}


def test_clean_keeps_whole_rows(spark):
    d = spark.createDataFrame([(*r, 1, "x") for r in DOCS], "doc_id long, text string, _leaks int, `a b` string")
    i = spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = D.clean(d, i)
    assert kept.columns == d.columns and sorted(r["doc_id"] for r in kept.collect()) == [11, 12, 13, 16]


def edits_by_recurrence(item, passage):
    before = [0] * (len(passage) + 1)
    for i, x in enumerate(item):
        now = [i + 1]
        for j, y in enumerate(passage):
            now.append(min(before[j] + (x != y), before[j + 1] + 1, now[j] + 1))
        before = now
    return min(before)


def test_word_edits_as_by_recurrence():
    rng = random.Random(4)
    for _ in range(500):
        a, b = [[rng.choice("abcd") for _ in range(rng.randint(least, 90))] for least in (1, 0)]
        assert D.word_edits(a, b) == edits_by_recurrence(a, b)


def test_edited_copies_are_cleaned_away(spark):
    """One or two words replaced anywhere, the answer included; a third of the words is another text."""
    words = [t.split() for t in (ITEMS[0][1], ITEMS[7][1])]
    docs, at = [], 0
    for w in words:
        for i in range(len(w)):
            for also in (i, (i + 5) % len(w)):
                docs.append((at := at + 1, " ".join([FILLER, *["changed" if j in (i, also) else x for j, x in enumerate(w)], FILLER])))
    other = [(1000, " ".join([FILLER, *["changed" if j % 3 == 0 else x for j, x in enumerate(words[0])], FILLER])), (1001, FILLER)]
    d, i = spark.createDataFrame(docs + other, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert [r["doc_id"] for r in D.clean(d, i).orderBy("doc_id").collect()] == [1000, 1001]
    assert {r["doc_id"] for r in D.leaks(d, i, edits=D.EDITS).collect()} == {n for n, _ in docs}
