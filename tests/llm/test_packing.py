from itertools import combinations

import numpy as np
import pytest

from cohortry.llm import packing as P


def padding(limits, lengths, counts):
    return sum(n * (min(x for x in limits if x >= length) - length) for length, n in zip(lengths, counts))


@pytest.mark.parametrize("seed", range(8))
def test_boundaries_are_optimal(seed):
    rng = np.random.default_rng(seed)
    m = int(rng.integers(1, 9))
    lengths, counts = np.sort(rng.choice(np.arange(1, 40), m, replace=False)), rng.integers(1, 20, m)
    for buckets in (1, 2, 3, 5):
        got = P.best_boundaries(lengths, counts, buckets)
        every = [c for c in combinations(lengths.tolist(), min(buckets, m)) if c[-1] == lengths[-1]]
        assert tuple(got) in every and padding(got, lengths, counts) == min(padding(c, lengths, counts) for c in every)
    assert P.best_boundaries(np.array([], np.int64), np.array([], np.int64), 3) == []


ROWS = [
    (1, "a b c"), (2, ""), (3, None), (4, " \n "), (5, "w " * 23), (6, "one"), (6, "one"), (None, "no id here"), (7, "x " * 9), (7, "x " * 4), (8, " long\tline of\nwords"),
    *[(100 + i, "t " * (i % 7 + 1)) for i in range(60)],
]


def test_plan_covers_everything(spark):
    df = spark.createDataFrame([(*r, 0, "s") for r in ROWS], "doc_id long, text string, batch int, bucket_len string")
    rows = P.pack(df, max_tokens=10, buckets=3, token_budget=25).collect()
    want = {}
    for i, t in ROWS:
        n = len([w for w in (t or "").replace(" ", "_").split()])
        want.setdefault(i, []).append(n)
    for i, sizes in want.items():
        mine = [r for r in rows if r["doc_id"] == i]
        assert sum(r["n_tokens"] for r in mine) == sum(sizes)
        assert len(mine) == sum(max(1, -(-n // 10)) for n in sizes)
        assert all(r["start"] == 10 * r["piece"] and r["n_tokens"] <= 10 for r in mine)
    placed = [r for r in rows if r["n_tokens"]]
    assert all(r["bucket_len"] is None and r["batch"] is None and r["slot"] is None for r in rows if not r["n_tokens"])
    assert len({(r["bucket_len"], r["batch"], r["slot"]) for r in placed}) == len(placed)
    limits = sorted({r["bucket_len"] for r in placed})
    assert len(limits) == 3 and all(r["bucket_len"] == min(x for x in limits if x >= r["n_tokens"]) for r in placed)
    for limit in limits:
        slots = sorted((r["batch"], r["slot"]) for r in placed if r["bucket_len"] == limit)
        assert slots == [divmod(i, 25 // limit) for i in range(len(slots))]


def test_empty_table_and_small_budget(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert P.pack(df).count() == 0
    with pytest.raises(ValueError):
        P.pack(df, max_tokens=10, token_budget=9)


@pytest.mark.parametrize("seed", range(6))
def test_boundaries_of_many_lengths(seed):
    """Against the plain program over all cuts, ties to the smaller limits."""
    rng = np.random.default_rng(seed)
    lengths = np.sort(rng.choice(np.arange(1, 900), 300, replace=False))
    counts = rng.integers(1, 4 if seed % 2 else 100_000, len(lengths))
    n, total, limit = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(lengths * counts)]), np.concatenate([[0], lengths])
    best, backs = {0: 0}, []
    for _ in range(7):
        after, back = {}, {}
        for j in range(1, len(limit)):
            some = [(best[i] + limit[j] * (n[j] - n[i]) - (total[j] - total[i]), i) for i in best if i < j]
            if some:
                after[j], back[j] = min(some)
        best, backs = after, [*backs, back]
    want, j = [], len(lengths)
    for back in reversed(backs):
        want.append(int(limit[j]))
        j = back[j]
    assert P.best_boundaries(lengths, counts, 7) == want[::-1]


def test_boundaries_in_linear_memory():
    import tracemalloc

    lengths = np.arange(1, 131_073)
    counts = np.random.default_rng(0).integers(1, 1000, len(lengths))
    tracemalloc.start()
    limits = P.best_boundaries(lengths, counts, 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(limits) == 4 and limits[-1] == 131_072 and peak < 200e6


def test_rows_without_id_are_numbered_in_parcels(spark, monkeypatch):
    """A third of the rows has no id and the same length; results do not depend on the number of slices."""
    monkeypatch.setattr(P, "PARCEL", 16)
    rows = [(None if i % 3 == 0 else i, "w " * (5 if i % 3 == 0 else i % 9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    plain = sorted(P.pack(df, max_tokens=6, buckets=2, token_budget=20).collect(), key=str)
    monkeypatch.setattr(P, "SLICE_ROWS", 10)
    assert sorted(P.pack(df.repartition(5), max_tokens=6, buckets=2, token_budget=20).collect(), key=str) == plain
    assert len([r for r in plain if r["doc_id"] is None]) == 1000
    for limit in {r["bucket_len"] for r in plain if r["n_tokens"]}:
        slots = sorted((r["batch"], r["slot"]) for r in plain if r["bucket_len"] == limit)
        assert slots == [divmod(i, 20 // limit) for i in range(len(slots))]


def test_pieces_of_a_vocabulary(spark, tmp_path):
    import base64

    from cohortry.llm.token_counts import token_counts

    path = tmp_path / "v.tiktoken"
    path.write_text("\n".join(f"{base64.b64encode(t).decode()} {i}" for i, t in enumerate([b" ", b"a", b"b", b"ab", b" a", b"bab"])))
    df = spark.createDataFrame([(1, "ab abab bbbb"), (2, "a"), (3, ""), (4, None), (5, "zz " * 9)], "doc_id long, text string")
    want = {r["doc_id"]: r["n_tokens"] for r in token_counts(df, vocabulary=str(path)).collect()}
    got = P.pack(df, max_tokens=3, buckets=2, token_budget=6, vocabulary=str(path)).groupBy("doc_id").sum("n_tokens").collect()
    assert {r[0]: r[1] for r in got} == want and want[1] == 9 and want[5] == 9
