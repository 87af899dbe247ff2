import math

import numpy as np
import pytest

from cohortry.llm import quality as Q

BASE = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    """The labels are never seen in training: they judge the result."""
    docs, labels = spark.read.parquet(f"{BASE}/documents.parquet"), spark.read.parquet(f"{BASE}/labels.parquet")
    rows = Q.quality_scores(docs).join(labels, "doc_id").select("quality", "keep", "label_score").toPandas()
    good, bad = rows[rows.quality == 1], rows[rows.quality == 0]
    assert good.keep.mean() > 0.99 and (~bad.keep.astype(bool)).mean() > 0.9
    assert (good.label_score > 0.5).mean() > 0.99 and (bad.label_score < 0.5).mean() > 0.9


def test_label_model_as_by_rows():
    """The fit over pattern counts is the fit over single documents, and finds the accuracies that made the votes."""
    rng = np.random.default_rng(3)
    n, k = 20_000, len(Q.LABELLERS)
    bad = rng.random(n) < 0.2
    hits = np.linspace(0.3, 0.9, k)
    accused = rng.random((n, k)) < np.where(bad[:, None], hits[None, :], 0.002)
    votes = np.where(rng.random((n, k)) < 0.1, Q.ABSTAIN, np.where(accused, Q.BAD, Q.GOOD))
    pattern = votes @ (3 ** np.arange(k - 1, -1, -1))
    assert (Q.votes_of(pattern) == votes).all()
    unique, counts = np.unique(pattern, return_counts=True)
    model = Q.fit_label_model(unique, counts)
    by_row = Q.fit_label_model(pattern, np.ones(n))
    assert abs(model.prior - 0.2) < 0.02 and np.abs(model.accuses[1] - hits).max() < 0.03
    assert np.allclose(model.accuses, by_row.accuses, atol=1e-6)
    assert ((model.posterior(pattern) < 0.5) == bad).mean() > 0.99


def votes_at(rng, n, alarms):
    """Bad rows, one in seven, and votes: labellers accuse bad rows at rates from 0.3 to 0.9, good ones at the rates given."""
    k = len(Q.LABELLERS)
    bad = rng.random(n) < 0.14
    accused = rng.random((n, k)) < np.where(bad[:, None], np.linspace(0.3, 0.9, k)[None, :], np.asarray(alarms)[None, :])
    return bad, np.where(rng.random((n, k)) < 0.1, Q.ABSTAIN, np.where(accused, Q.BAD, Q.GOOD))


def fitted(votes):
    pattern = votes @ (3 ** np.arange(len(Q.LABELLERS) - 1, -1, -1))
    unique, counts = np.unique(pattern, return_counts=True)
    return pattern, Q.fit_label_model(unique, counts)


@pytest.mark.parametrize("rate", [0.002, 0.01, 0.02, 0.05, 0.1])
def test_false_alarms_outweigh_their_prior(rate):
    """A labeller that accuses more good documents than the prior says is estimated at what it does."""
    alarms = np.full(len(Q.LABELLERS), 0.002)
    alarms[3] = rate
    bad, votes = votes_at(np.random.default_rng(17), 60_000, alarms)
    pattern, model = fitted(votes)
    assert np.abs(model.rates[0] - alarms).max() < 0.001 + 0.03 * rate
    assert np.abs(model.rates[1] - np.linspace(0.3, 0.9, len(alarms))).max() < 0.03
    called = model.posterior(pattern) < 0.5
    assert called[~bad].mean() < 0.005 and called[bad].mean() > 0.97


def by_definition(rows, alarm=0.002):
    """The label model row by row and vote by vote, in plain numbers: P(good) of each row, rates of bad votes by class without the prior."""
    k, n = len(rows[0]), len(rows)
    share, rates = 0.1, {"good": [alarm] * k, "bad": [0.4] * k}

    def chance(row, kind):
        return math.prod(r if v == "b" else 1 - r for v, r in zip(row, rates[kind]) if v != "-")

    found = {}
    for _ in range(250):
        good = [(1 - share) * g / ((1 - share) * g + share * b) for g, b in ((chance(r, "good"), chance(r, "bad")) for r in rows)]
        share = (sum(1 - p for p in good) + 0.5) / (n + 1)
        for kind, part, extra in (("good", good, n), ("bad", [1 - p for p in good], 0)):
            told = [[sum(p for p, r in zip(part, rows) if r[j] == letter) + 0.5 for letter in "bg"] for j in range(k)]
            found[kind] = [b / (b + g) for b, g in told]
            rates[kind] = [(b + alarm * extra) / (b + g + extra) for b, g in told]
    return good, found


def test_posteriors_by_brute_force():
    alarms = [0.002, 0.03, 0.002, 0.002, 0.05, 0.002, 0.002]
    _, votes = votes_at(np.random.default_rng(23), 400, alarms)
    pattern, model = fitted(votes)
    good, rates = by_definition(["".join("-gb"[v] for v in row) for row in votes])
    assert np.allclose(model.posterior(pattern), good, atol=1e-5)
    assert np.allclose(model.rates, [rates["good"], rates["bad"]], atol=1e-5)


def test_label_scores_of_the_query_by_brute_force(spark):
    rows = Q.quality_scores(spark.read.parquet(f"{BASE}/documents.parquet")).filter("votes is not null").select("votes", "label_score").collect()
    good, _ = by_definition([r["votes"] for r in rows])
    assert np.allclose([r["label_score"] for r in rows], good, atol=1e-4)


def test_scorer_learns_a_linear_rule():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2000, 40)).astype(np.float32) / 6
    bad = (x @ rng.normal(size=40) > 0).astype(float)
    w = Q.fit_scorer(x[:1500], bad[:1500])
    assert (((x[1500:] @ w[:-1] + w[-1]) > 0) == (bad[1500:] > 0.5)).mean() > 0.93


ODD = [
    (1, None), (2, ""), (3, " \n "), (4, "Short one."), (4, "Short one."), (None, "No id but a fine sentence all the same."), (5, "퟿ \U0001f600 ok"),
    (6, "BUY!! NOW!! CHEAP!! " * 400), (7, "one line of prose after another, " * 2 + "which ends here.\n" + "Word after word it goes on. " * 3), (8, "go " * 20_000),
]


def test_odd_documents(spark):
    docs = spark.createDataFrame([(*r, 9, "c") for r in ODD], "doc_id long, text string, _quality int, keep string")
    rows = Q.quality_scores(docs).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        if r["doc_id"] in (1, 2, 3):
            assert (r["votes"], r["score"], r["keep"]) == (None, 0.0, False)
        else:
            assert 0 < r["score"] < 1 and len(r["votes"]) == len(Q.LABELLERS)
    kept = Q.accepted(docs)
    assert kept.columns == docs.columns and not {1, 2, 3} & {r["doc_id"] for r in kept.collect()}


def test_tables_without_words(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert Q.quality_scores(none).count() == 0 and Q.accepted(none).count() == 0
    blank = spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string")
    assert [r["keep"] for r in Q.quality_scores(blank).collect()] == [False, False]


def test_sample_is_bounded_by_distinct_texts(spark):
    docs = spark.createDataFrame([(i, "the very same text in every row here") for i in range(300)] + [(999, "another text")], "doc_id long, text string")
    rows = Q.quality_scores(docs, sample_rows=2).select("score").distinct().count()
    assert rows <= 2


HAN = "的一是不了人我在有他这中大来上国个到说们为子和你地出道也时年得就那要下以生会自着去之过家学对可里后小么心多天而能好都然没日于起还发成事只作当想看文无开手十用主行方又如前所本见经头面"
THAI = "กขคงจชซญดตถทธนบปผพฟมยรลวสหอะาิีึืุูเแโใไ"


def in_script(letters, seed, stretches=40):
    """Clean text without blanks between its words."""
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list(letters), rng.integers(9, 30))) + "。" for _ in range(stretches))


def test_word_length_in_characters_of_spaced_scripts():
    vote = lambda text: Q.votes_of([Q.pattern_of(Q.statistics(text)[0])])[0, [x[0] for x in Q.LABELLERS].index("odd word length")]
    assert vote(in_script(HAN, 1)) == vote(in_script(THAI, 2)) == Q.ABSTAIN
    assert vote("преподаватель достопримечательность рассказывает " * 20 + "и он " * 20) == Q.GOOD  # 17 bytes a word
    assert vote("каждый охотник желает знать где сидит фазан " * 10) == Q.GOOD
    assert vote("x" * 40 + " " + "ab" * 30 + " " + "plain " + "q" * 25 + " " + "0f" * 16 + " z" + " w" * 16 + "k" * 400) == Q.BAD


def test_clean_source_of_a_third_in_another_script_is_kept(spark):
    docs = spark.read.parquet(f"{BASE}/documents.parquet").select("doc_id", "text")
    n = docs.count() // 2
    more = spark.createDataFrame([(-1 - i, in_script(HAN if i % 2 else THAI, i)) for i in range(n)], docs.schema)
    rows = Q.quality_scores(docs.unionByName(more)).toPandas()
    assert len(rows) == 3 * n
    labels = spark.read.parquet(f"{BASE}/labels.parquet").toPandas()
    other, rest = rows[rows.doc_id < 0], rows[rows.doc_id >= 0].merge(labels, on="doc_id")
    assert (other.label_score > 0.5).all() and other.keep.mean() > 0.99
    assert rest[rest.quality == 1].keep.mean() > 0.99 and (~rest[rest.quality == 0].keep.astype(bool)).mean() > 0.9


def test_very_long_clean_document_is_kept(spark):
    docs = spark.read.parquet(f"{BASE}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{BASE}/labels.parquet")
    good = [r["text"] for r in docs.join(labels, "doc_id").filter("quality = 1").orderBy("doc_id").select("text").collect()]
    words = sorted({w for t in good for w in t.split()})
    draw = np.random.default_rng(11).zipf(1.1, 600_000)
    book = " ".join(words[i - 1] for i in draw[draw <= len(words)][:300_000])  # words as frequent as in prose
    assert len(book.split()) == 300_000 and 1 - len(set(book.split())) / 300_000 > 0.8
    stuck = " ".join(book.split()[:2500] * 40)  # many words, but the same again and again
    rows = {r["doc_id"]: r for r in Q.quality_scores(docs.unionByName(spark.createDataFrame([(-1, book), (-2, stuck)], docs.schema))).filter("doc_id < 0").collect()}
    poor = [x[0] for x in Q.LABELLERS].index("poor in words")
    assert rows[-1]["keep"] and rows[-1]["label_score"] > 0.5 and rows[-1]["votes"][poor] != "b"
    assert rows[-2]["votes"][poor] == "b"
