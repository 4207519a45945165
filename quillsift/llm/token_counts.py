"""Numbers of greedy word pieces by a linear longest-match automaton.

The vocabulary is a trie with failure links (Song et al., "Fast WordPiece
Tokenization", 2021).  Where greedy matching can go no further, the failure
link leads to the state reached after the pieces that the match pops; only
their number is kept at the link, so a word's pieces are counted in one pass
over its bytes and never built.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsift.llm.packing import byte_alphabet
from quillsift.llm.shared import as_bytes, fresh

#: Words remembered by a worker; it forgets all of them beyond that.
REMEMBERED = 500_000


class Automaton:
    """Counts the pieces of words under greedy longest match, left to right."""

    def __init__(self, pieces: Iterable[bytes]):
        self.go: list[dict[int, int]] = [{}]
        is_piece = [False]
        for piece in pieces:
            at = 0
            for symbol in piece:
                at = self.go[at].setdefault(symbol, len(self.go))
                if at == len(self.go):
                    self.go.append({})
                    is_piece.append(False)
            is_piece[at] = at > 0
        # Where matching goes on if a node has no edge for the next symbol (None: nowhere), and how many pieces are popped on the way.
        self.fail: list[int | None] = [None] * len(self.go)
        self.popped = [0] * len(self.go)
        queue = deque([0])
        while queue:
            parent = queue.popleft()
            for symbol, node in self.go[parent].items():
                queue.append(node)
                if is_piece[node]:
                    self.fail[node], self.popped[node] = 0, 1
                    continue
                at, pieces_popped = self.fail[parent], self.popped[parent]
                while at is not None and symbol not in self.go[at]:
                    pieces_popped += self.popped[at]
                    at = self.fail[at]
                if at is not None:
                    self.fail[node], self.popped[node] = self.go[at][symbol], pieces_popped

    def count(self, word: bytes) -> int:
        """Pieces of a word; 1 for a word that can't be cut into pieces (an unknown)."""
        go, fail, popped = self.go, self.fail, self.popped
        at = n = 0
        for symbol in word:
            while symbol not in go[at]:
                if fail[at] is None:
                    return 1
                n += popped[at]
                at = fail[at]
            at = go[at][symbol]
        while at:
            if fail[at] is None:
                return 1
            n += popped[at]
            at = fail[at]
        return n


class Counts(dict):
    """Pieces of words, each with the space before it, under the vocabulary of a byte-level tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        byte_of = byte_alphabet()
        self.automaton = Automaton(bytes(map(byte_of.__getitem__, token)) for token in vocab if all(c in byte_of for c in token))

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = n = self.automaton.count(b" " + word)
        return n


_loaded: dict[str, Counts] = {}


def _counts(path: str) -> Counts:
    if path not in _loaded:
        _loaded[path] = Counts(path)
    return _loaded[path]


def count_tokens(docs: DataFrame, vocabulary: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_words`` and ``n_tokens`` (longs): words between ASCII white space, and their greedy longest-match pieces.

    ``vocabulary`` is the path of a byte-level tokenizer file, read by the
    executors; every token is a piece, words begin with a space.  Null and
    empty texts have none of either; all other columns pass through (those of
    these two names are replaced), rows stay as they are.
    """

    @F.pandas_udf("struct<n_words:bigint,n_tokens:bigint>")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        pieces = _counts(vocabulary).__getitem__
        for batch in batches:
            words = [t.split() for t in batch]
            yield pd.DataFrame({"n_words": list(map(len, words)), "n_tokens": [sum(map(pieces, w)) for w in words]}, dtype="int64")

    (found,) = fresh(docs, "counts")
    return docs.withColumn(found, counted(as_bytes(F.col(text_col)))).withColumns({c: F.col(found)[c] for c in ("n_words", "n_tokens")}).drop(found)
