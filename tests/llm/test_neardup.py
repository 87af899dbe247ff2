import math

import numpy as np
import pytest

from cohortry.llm import neardup as N

NAN, INF = float("nan"), float("inf")


def frame(spark, rows, kind="float"):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], f"vec_id long, embedding array<{kind}>, kept int, component_id int")


def brute_force(rows, threshold=0.9, single=True):
    """Per row: id, links, smallest id of its component, kept. All pairs."""
    def usable(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)

    width = max((len(v) for _, v in rows if usable(v)), default=0)
    u = {}
    for i, (_, v) in enumerate(rows):
        if usable(v):
            x = np.array([*v, *[0.0] * (width - len(v))], np.float32 if single else float).astype(float)
            x = x / np.abs(x).max()
            u[i] = x / np.linalg.norm(x)
    root, links, at = list(range(len(rows))), [0] * len(rows), list(u)

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for k, a in enumerate(at):
        for b in at[:k]:
            if u[a] @ u[b] >= threshold:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    least = {}
    for i, (id_, _) in enumerate(rows):
        r = find(i)
        known = [x for x in (id_, least.get(r)) if x is not None]
        least[r] = min(known) if known else None
    return sorted([(id_, links[i], least[find(i)], id_ == least[find(i)]) for i, (id_, _) in enumerate(rows)], key=str)


def planted(n=400, width=24, seed=5):
    """Random vectors with copies, scaled copies and neighbours at chosen cosines, some just above and below the threshold."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, width))
    rows = [list(map(float, v)) for v in base]
    for i in range(0, n, 4):
        v = base[i] / np.linalg.norm(base[i])
        w = rng.normal(size=width)
        w -= (w @ v) * v
        w /= np.linalg.norm(w)
        for c in (0.99, 0.93, 0.905, 0.895):
            rows.append(list(map(float, 3 * (c * v + math.sqrt(1 - c * c) * w))))
        rows += [rows[i], list(map(float, 2 * base[i]))]
    order = rng.permutation(len(rows))
    return [(int(k), rows[j]) for k, j in enumerate(order)]


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


ODD = [(5000, None), (5001, [NAN, 1.0]), (5002, [INF]), (5003, [None, 1.0]), (5004, []), (5005, [0.0, -0.0]), (None, [1.0] * 24), (None, [1.0] * 24),
       (None, [1.0, -1.0] * 12), (5006, [1.0]), (5007, [2.0, 0.0]), (5007, [0.0, 0.0, 1.0]), (5008, [1e38] * 24), (5009, [1e-38] * 24)]


def test_recall_and_no_link_below(spark):
    rows = planted()
    want, have = brute_force(rows), got(N.near_duplicates(frame(spark, rows)))
    links = {r[0]: r[1] for r in want}
    assert all(r[1] <= links[r[0]] for r in have)
    assert sum(r[1] for r in have) >= 0.97 * sum(links.values())  # target recall is 0.99 at the threshold itself


@pytest.mark.parametrize("rows", [planted(60), [*planted(60, seed=6), *ODD], [], ODD[:6], [(1, [1.0]), (2, [2.0]), (3, [-1.0])]], ids=["plain", "odd", "empty", "none", "width 1"])
def test_one_cell_is_brute_force(spark, rows, monkeypatch):
    monkeypatch.setattr(N, "CELL_ROWS", 1_000_000)  # one cell: every pair is compared
    monkeypatch.setattr(N, "BLOCK_ROWS", 64)
    assert got(N.near_duplicates(frame(spark, rows))) == [tuple(r) for r in brute_force(rows)]


def test_pairs_that_meet_twice_count_once(spark, monkeypatch):
    monkeypatch.setattr(N, "CELL_ROWS", 4)
    monkeypatch.setattr(N, "BLOCK_ROWS", 16)
    monkeypatch.setattr(N, "stop_for", lambda *a, **k: 0.2)  # exact: no neighbour is farther than this
    rows = [*planted(100, seed=8), *ODD]
    assert got(N.near_duplicates(frame(spark, rows).repartition(7))) == [tuple(r) for r in brute_force(rows)]


def test_a_third_of_all_rows_in_one_group(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=16)]) for i in range(3000)]
    centre = rng.normal(size=16)
    rows += [(3000 + i, [float(x) for x in centre + 0.02 * rng.normal(size=16)]) for i in range(1500)] + [(9000 + i, rows[0][1]) for i in range(1500)]
    out = {r["vec_id"]: r for r in N.near_duplicates(frame(spark, rows)).collect()}
    assert all(out[3000 + i]["n_links"] == 1499 and out[3000 + i]["component_id"] == 3000 for i in range(1500))
    assert all(out[9000 + i]["n_links"] >= 1500 and out[9000 + i]["component_id"] <= 0 for i in range(1500))


def test_doubles_out_of_range_of_squares(spark):
    rows = [(1, [1e200, 1e200]), (2, [1e-200, 1e-200]), (3, [1e200, -1e200]), (4, [5e-324, 5e-324]), (5, [1e308, 1.7e308])]
    assert got(N.near_duplicates(frame(spark, rows, "double"))) == [tuple(r) for r in brute_force(rows, single=False)]


def test_traversal_is_in_order_and_complete():
    rng = np.random.default_rng(4)
    index = N.MultiIndex(rng.normal(size=(6, 3)), rng.normal(size=(5, 4)), 0.4)
    b1, b2 = rng.random(6), rng.random(5)
    cells = index.traverse(b1, b2)
    bound = {int(index.cell(i, j)): b1[i] + b2[j] for i in range(6) for j in range(5)}
    assert [bound[c] for c in cells] == sorted(v for v in bound.values() if v <= 0.4)


def test_the_bound_is_a_lower_bound():
    rng = np.random.default_rng(7)
    u = rng.normal(size=(300, 10))
    u /= np.linalg.norm(u, axis=1)[:, None]
    index = N.MultiIndex(N.fit_codebook(u[:, :5], 6, 1), N.fit_codebook(u[:, 5:], 6, 2))
    (own1, b1), (own2, b2) = index.halves(u)
    far = ((u[:, None, :] - u[None, :, :]) ** 2).sum(axis=2)
    assert (b1[:, own1] + b2[:, own2] <= far + 1e-9).all()
