import random

import numpy as np
import pytest

from cohortry.llm import ngram_join as J
from cohortry.llm.components import connected

from .helpers import classes_by_brute_force, shingles_of, words_of

RNG = random.Random(11)
WORDS = [f"w{i}" for i in range(400)]


def text(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


def edited(t, k):
    w = t.split()
    for _ in range(k):
        w[RNG.randrange(len(w))] = RNG.choice(WORDS)
    return " ".join(w)


LONG = text(150)
ROWS = [
    *[(i, edited(LONG, RNG.randrange(0, 4))) for i in range(24)], (100, LONG), (101, LONG.upper() + "!"), (102, text(60)), (103, text(60)),
    (104, "tiny text"), (105, "tiny, text."), (106, "tiny"), (107, None), (108, ""), (109, " ?! "), (107, None), (110, text(30_000)), (None, LONG), (102, "other words under one id"),
    (None, "nobody's words twice here"), (None, "nobody's words twice here"), (None, "Nobody s words, twice here!"), (120, "four times the same"), (120, "four times the same"),
]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(*r, 1, "n") for r in rows], "doc_id long, text string, node int, class string").repartition(3)


def expected(rows):
    """(id, class id, links), -1 for null. The class id is the least known id."""
    big = 1 << 40
    found = classes_by_brute_force([(big if i is None else i, t) for i, t in rows])
    back = lambda i: -1 if i is None or i == big else i
    return sorted((back(rows[i][0]), back(c), n) for i, (c, n) in found.items())


def test_classes_as_by_brute_force(spark):
    got = sorted(tuple(-1 if v is None else v for v in r) for r in J.jaccard_classes(frame(spark)).collect())
    assert got == expected(ROWS)


def test_blocks_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK_MEMBERS", 3)
    got = sorted(tuple(-1 if v is None else v for v in r) for r in J.jaccard_classes(frame(spark)).collect())
    assert got == expected(ROWS)


def test_generated_documents_as_by_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sorted(tuple(r) for r in J.jaccard_classes(docs).collect())
    assert got == expected([(r["doc_id"], r["text"]) for r in docs.collect()]) and any(n for _, _, n in got)


def test_one_of_each(spark):
    df = frame(spark)
    kept = J.one_of_each(df)
    assert kept.columns == df.columns
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], " ".join(words_of(r["text"]))) for r in kept.collect())
    assert len(got) == len(set(got)) + 1  # the two rows of 107 without words
    want = set()
    by_row = classes_by_brute_force([((1 << 40) if i is None else i, t) for i, t in ROWS])
    for k, (id_, t) in enumerate(ROWS):
        if by_row[k][0] == ((1 << 40) if id_ is None else id_) or not shingles_of(t):
            want.add((-1 if id_ is None else id_, " ".join(words_of(t))))
    assert set(got) == want


def test_different_texts_under_one_id(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(WORDS) for _ in range(30)) for _ in range(400)]
    rows = [(7, t) for t in texts for _ in range(2)] + [(None, t) for t in texts[:50]] + [(None, "one text without an id " * 3)] * 400
    got = sorted(tuple(-1 if v is None else v for v in r) for r in J.jaccard_classes(frame(spark, rows)).collect())
    assert got == sorted([(7, 7, 2 if i < 50 else 1) for i in range(400) for _ in range(2)] + [(-1, 7, 2)] * 50 + [(-1, -1, 399)] * 400)
    kept = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"]) for r in J.one_of_each(frame(spark, rows)).collect())
    assert kept == sorted([(7, t) for t in texts] + [(-1, "one text without an id " * 3)])


def test_a_chain_is_not_compared_all_against_all(spark, monkeypatch):
    """Texts that share words with the next one only: blocks meet where a bucket joins them, and no link is lost."""
    monkeypatch.setattr(J, "BLOCK_MEMBERS", 4)
    words = [f"c{i}" for i in range(2000)]
    rows = [(i, " ".join(words[i * 4 : i * 4 + 60])) for i in range(160)]
    seen, own = [], J.keep

    def watched(df):
        kept = own(df)
        if kept.columns == ["lo", "hi"]:
            seen.append(kept.count())
        return kept

    monkeypatch.setattr(J, "keep", watched)
    got = sorted(tuple(r) for r in J.jaccard_classes(frame(spark, rows)).collect())
    assert got == expected(rows) and max(r[2] for r in got) == 2
    assert seen[0] < 0.3 * 40 * 41 / 2  # blocks of 4 of 160, each with each, would be 820


def units_of(spark, monkeypatch, rows):
    """The result and the number of units of work."""
    seen, own = [], J.keep

    def watched(df):
        kept = own(df)
        if kept.columns == ["lo", "hi"]:
            seen.append(kept.count())
        return kept

    with monkeypatch.context() as m:
        m.setattr(J, "keep", watched)
        m.setattr(J, "BLOCK_MEMBERS", 8)
        return sorted(tuple(r) for r in J.jaccard_classes(frame(spark, rows)).collect()), seen[0]


def test_units_of_a_group_of_near_copies_grow_with_it(spark, monkeypatch):
    """All are links by what they share with their centre, so none is compared: there were 4 times the units for twice the members."""
    rng, units = random.Random(8), []
    base = [rng.choice(WORDS) for _ in range(200)]
    for n in (200, 400):
        rows = [(i, " ".join(base[: (at := rng.randrange(200))] + [f"x{i % (n - 20)}"] + base[at + 1 :])) for i in range(n)]
        got, made = units_of(spark, monkeypatch, rows)
        assert got == [(i, 0, n - 1) for i in range(n)]
        units.append(made)
    assert units[1] <= 2.5 * max(units[0], 4)


def test_rings_near_and_far_from_the_centre_as_by_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    bases = [[rng.choice(WORDS) for _ in range(n)] for n in (120, 60)]
    bases.append(bases[0][:90] + [rng.choice(WORDS) for _ in range(40)])  # shares buckets with the first, but no link
    rows = []
    for i in range(330):
        w = list(bases[i % 3])
        for _ in range(min(int(rng.expovariate(0.4)), 14)):
            w[rng.randrange(len(w))] = rng.choice(WORDS[: 40 if i % 2 else 400])
        rows += [(i, " ".join(w + WORDS[: rng.choice((0, 0, 0, 15))]))] * rng.choice((1, 1, 1, 2))
    got, made = units_of(spark, monkeypatch, rows)
    assert got == expected(rows) and made > 10


def test_empty_table(spark):
    assert J.jaccard_classes(frame(spark, []).coalesce(1)).count() == 0
    assert J.one_of_each(frame(spark, [])).count() == 0


def test_pruning_limits():
    """P(similarity >= t) after m of n equal values, integrated numerically, is below the tolerance just under the limit."""
    t, tolerance = 0.8, 1e-3
    x = np.linspace(0, 1, 200_001)
    for n, m in J.least_matches(t, tolerance).items():
        for k, below in ((m - 1, True), (m, False)):
            if k >= 0:
                with np.errstate(divide="ignore"):
                    logs = k * np.log(x) + (n - k) * np.log(1 - x)
                density = np.exp(np.nan_to_num(logs - logs[1:-1].max(), neginf=-np.inf))
                assert (density[x >= t].sum() / density.sum() < tolerance) == below


def test_min_hash_estimates_similarity():
    a = np.unique(np.random.default_rng(1).integers(0, 2**63, 3000).astype(np.uint64))
    b = np.concatenate([a[:2700], np.random.default_rng(2).integers(0, 2**63, 300).astype(np.uint64)])
    estimate = (J.min_hashes(a) == J.min_hashes(b)).mean()
    assert abs(estimate - 2700 / 3300) < 0.1


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(i, i + 1) for i in range(0, 40) if i % 9] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)] + [(500, i) for i in range(501, 560)]
    root = {x: x for e in edges for x in e}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = dict(tuple(r) for r in connected(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
