"""Word-piece counts by a linear longest-match automaton.

Greedy longest-match-first tokenisation of a word is simulated on the trie of the vocabulary without building pieces (Song et
al. 2021). Each trie node carries a failure link, the node for what remains of its string once the greedy pieces that fit have
been popped, and the precomputed number of those pieces. So every character is read once and a word's number of pieces is the
sum of the popped counts on its way.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.llm.common import ship_by_value, with_arrow_column

ship_by_value(__name__)

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CACHED_WORDS, CACHED_BYTES = 300_000, 64
NOWHERE = -1


def read_ranks(path: str = VOCABULARY) -> list[bytes]:
    """The byte strings of a file of base64 tokens and ranks, one a line. The file is read by the driver."""
    return [base64.b64decode(line.split()[0]) for line in Path(path).read_bytes().splitlines() if line.strip()]


@dataclass
class Automaton:
    """Transitions (node << 8 | byte -> node), and per node its failure link and the number of pieces popped by it."""

    steps: dict[int, int]
    fail: list[int]
    popped: list[int]
    inner: int  # where a word goes on after a piece

    def pieces(self, word: bytes) -> int:
        """Number of pieces of a word; one, for the unknown word, if the vocabulary cannot spell it."""
        steps, fail, popped = self.steps, self.fail, self.popped
        node, n = 0, 0
        for byte in word:
            while (after := steps.get(node << 8 | byte)) is None:
                n += popped[node]
                node = fail[node]
                if node == NOWHERE:
                    return 1
            node = after
        while node != self.inner and node != 0:
            n += popped[node]
            node = fail[node]
            if node == NOWHERE:
                return 1
        return n


def build_automaton(vocabulary: Iterable[bytes], continuation: bytes = b"") -> Automaton:
    """Automaton of a vocabulary. With a continuation prefix (``##``), pieces that have it are those inside a word.

    Without one, every piece may stand anywhere in a word. Empty pieces are ignored.
    """
    steps: dict[int, int] = {}
    token, children = [False], [[]]

    def insert(piece: bytes, node: int) -> int:
        for byte in piece:
            after = steps.get(node << 8 | byte)
            if after is None:
                after = steps[node << 8 | byte] = len(token)
                token.append(False)
                children.append([])
                children[node].append(byte)
            node = after
        return node

    inner = 0
    if continuation:
        inner = len(token)
        token.append(False)
        children.append([])
    for piece in vocabulary:
        inside = bool(continuation) and piece.startswith(continuation)
        rest = piece[len(continuation) :] if inside else piece
        if rest:
            token[insert(rest, inner if inside else 0)] = True
    fail, popped = [NOWHERE] * len(token), [0] * len(token)
    queue = [0] if inner == 0 else [0, inner]
    for node in queue:  # breadth first: the links of shorter strings are known
        for byte in children[node]:
            child = steps[node << 8 | byte]
            queue.append(child)
            if token[child]:
                fail[child], popped[child] = inner, 1
                continue
            n, at = popped[node], fail[node]
            while at != NOWHERE and (at << 8 | byte) not in steps:
                n, at = n + popped[at], fail[at]
            if at != NOWHERE:
                fail[child], popped[child] = steps[at << 8 | byte], n
    return Automaton(steps, fail, popped, inner)


class _Counts(dict):
    """Pieces of words, remembered up to a bound of short words."""

    def __init__(self, automaton: Automaton, mark: bytes):
        self.automaton, self.mark = automaton, mark

    def __missing__(self, word: str) -> int:
        raw = word.encode("utf-8", "surrogatepass")
        n = self.automaton.pieces(self.mark + raw)
        if len(raw) <= CACHED_BYTES:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = n
        return n


COUNTED = T.StructType([T.StructField("words", T.LongType()), T.StructField("tokens", T.LongType())])


def with_token_counts(df: DataFrame, name: str, automaton: Automaton, text_col: str = "text", mark: bytes = b" ") -> DataFrame:
    """Append a struct ``words, tokens``. Words are what white space separates; ``mark`` is put before each.

    Null, empty and blank texts have no words and no tokens. Whole texts are read; all columns and rows pass through.
    """
    size = len(automaton.steps)
    packed = df.sparkSession.sparkContext.broadcast(
        (
            np.fromiter(automaton.steps.keys(), np.int64, size),
            np.fromiter(automaton.steps.values(), np.int32, size),
            np.array(automaton.fail, np.int32), np.array(automaton.popped, np.int32), automaton.inner,
        )
    )

    def start():
        keys, values, fail, popped, inner = packed.value
        counts = _Counts(Automaton(dict(zip(keys.tolist(), values.tolist())), fail.tolist(), popped.tolist(), inner), mark)

        def compute(cols: list[pa.Array]) -> pa.Array:
            words, tokens = [], []
            for text in cols[0].to_pylist():
                split = text.split() if text else []
                words.append(len(split))
                tokens.append(sum(map(counts.__getitem__, split)))
            return pa.StructArray.from_arrays([pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=["words", "tokens"])

        return compute

    return with_arrow_column(df, [F.col(f"`{text_col}`")], start, T.StructField(name, COUNTED))


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, n_words, n_tokens`` of every row; repeated rows and null ids each keep their row. Other columns are not read."""
    two = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    counted = with_token_counts(two, "c", build_automaton(read_ranks(vocabulary)))
    return counted.select(F.col("id").alias(id_col), F.col("c.words").alias("n_words"), F.col("c.tokens").alias("n_tokens"))
