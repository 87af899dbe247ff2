"""The stages by brute force, each on what its predecessor kept."""

import functools

import corpus_pipeline as P
from cohortry.llm import quality, token_counts

from .helpers import classes_by_brute_force, words_of
from .test_decontaminate import brute_force as leaks_by_brute_force

BASE = "/root/testdata/sf0.001"


def test_stages_by_brute_force(spark):
    docs = spark.read.parquet(f"{BASE}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{BASE}/benchmark.parquet").collect()]
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    results, now = {}, docs
    for name, stage in P.STAGES:
        before = now
        now = stage(spark, before, BASE).persist()
        results[name] = now
        if name != "packing":
            assert now.columns == docs.columns and now.dtypes == docs.dtypes
    ids = {name: [r["doc_id"] for r in df.select("doc_id").collect()] for name, df in results.items()}
    keep = {r["doc_id"] for r in quality.quality_scores(docs).filter("keep").collect()}
    assert set(ids["quality_filter"]) == keep and 0 < len(keep) < len(rows)
    left = [(i, rows[i]) for i in sorted(keep)]
    classes = classes_by_brute_force(left)
    unique = {left[i][0] for i, (c, _) in classes.items() if c == left[i][0]}
    assert sorted(ids["near_duplicates"]) == sorted(unique) and len(unique) < len(keep)
    leaking = {d for d, _ in leaks_by_brute_force([(i, rows[i]) for i in unique], items)}
    assert sorted(ids["decontamination"]) == sorted(unique - leaking) and leaking
    assert set(ids["packing"]) == unique - leaking
    tokens = {r["doc_id"]: r["n"] for r in results["packing"].groupBy("doc_id").sum("n_tokens").withColumnRenamed("sum(n_tokens)", "n").collect()}
    vocabulary = set(token_counts.read_ranks())
    longest = max(map(len, vocabulary))

    @functools.cache
    def pieces_by_hand(word):
        n, at = 0, 0
        while at < len(word):
            at = next(e for e in range(min(len(word), at + longest), at, -1) if word[at:e] in vocabulary)
            n += 1
        return n

    assert all(tokens[i] == sum(pieces_by_hand(b" " + w.encode()) for w in rows[i].split()) for i in unique - leaking)
    assert [words_of(rows[i]) for i in unique - leaking]


def test_odd_tables(spark):
    odd = [(1, None), (2, ""), (3, "Quite a plain sentence, which stands twice in this table of ours."), (3, "Quite a plain sentence, which stands twice in this table of ours."), (None, "A sentence whose row has no id at all, yet it is good.")]
    docs = spark.createDataFrame([(*r, i, "c", "d") for i, r in enumerate(odd)], "doc_id long, text string, _quality int, _leaks string, _doc string")
    now = docs
    for name, stage in P.STAGES:
        now = stage(spark, now, BASE)
        if name != "packing":
            assert now.columns == docs.columns
        spark.sparkContext.setJobDescription(name)
    assert sorted((r["doc_id"] or -1 for r in now.collect())) == [-1, 3]
    none = docs.limit(0)
    for _, stage in P.STAGES:
        none = stage(spark, none, BASE)
    assert none.count() == 0


def test_run(spark):
    assert P.run(spark, BASE).count() > 0
