import random

import pytest

from cohortry.llm import token_counts as K


def greedy(word, first, inner):
    n, at, vocabulary = 0, 0, first
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in vocabulary), None)
        if end is None:
            return 1
        n, at, vocabulary = n + 1, end, inner
    return n


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("prefix", [b"", b"##"])
def test_automaton_is_greedy_longest_match(seed, prefix):
    rng = random.Random(seed)
    word = lambda most: bytes(rng.choice(b"abc") for _ in range(rng.randint(1, most)))
    plain = {word(5) for _ in range(12)} | ({b"a", b"b"} if seed % 2 else set())
    inside = {word(4) for _ in range(8)} if prefix else plain
    auto = K.build_automaton([*plain, *[prefix + w for w in inside]] if prefix else plain, prefix)
    for _ in range(2000):
        w = word(14)
        assert auto.pieces(w) == greedy(w, plain, inside), w


def test_counts_with_the_public_vocabulary(spark):
    pieces = set(K.read_ranks())
    texts = ["The cat sat, antidisestablishmentarianism!", "", None, "  \n\t ", "über naïve \U0001f600", "x" * 5000, "a b " * 1000, "The cat sat, antidisestablishmentarianism!"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "one", 1)], "doc_id long, text string, n_tokens int")
    got = {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in K.token_counts(df).collect()}
    for i, t in [*enumerate(texts), (None, "one")]:
        split = (t or "").split()
        assert got[i] == (len(split), sum(greedy(b" " + w.encode(), pieces, pieces) for w in split)), t
    assert K.token_counts(df.limit(0)).count() == 0
