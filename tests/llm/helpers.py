"""What the tests of the operators share."""

import re

GAPS = re.compile(r"[\W_]+")


def words_of(text):
    return GAPS.sub(" ", (text or "").lower()).split()


def shingles_of(text, k=5):
    w = words_of(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def classes_by_brute_force(rows, threshold=0.8):
    """{position: (class id, links)} of (id, text) rows by comparing all pairs."""
    sets = [shingles_of(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    links = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    least = {}
    for i, (id_, _) in enumerate(rows):
        least[find(i)] = min(id_, least.get(find(i), id_))
    return {i: (least[find(i)], links[i]) for i in range(len(rows))}
