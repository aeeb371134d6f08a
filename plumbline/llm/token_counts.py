"""Greedy word-piece token counts by a linear longest-match automaton that never builds the pieces.

The vocabulary is a byte trie. Where no edge fits, a node's failure link names the node for what is left after popping the
longest pieces, and a precomputed count says how many pieces were popped, so a word costs time in proportion to its length.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Marks the end of a word in the trie.
END = 256


class LongestMatch:
    """Piece counts of words: greedy, always the longest vocabulary entry that fits.

    pieces: (bytes, ends a word) entries; an entry that ends a word matches only at a word's end and is preferred there to
    an equally long one that doesn't. Where no entry fits, the word counts as 1 (one unknown token).
    """

    def __init__(self, pieces: Iterable[tuple[bytes, bool]]):
        self.next: list[dict[int, int]] = [{}]
        ends: list[bool] = [False]
        for piece, last in [(b"", True), *pieces]:  # a lone end mark: nothing is left of the word
            node = 0
            for b in [*piece, END] if last else piece:
                to = self.next[node].get(b)
                if to is None:
                    to = self.next[node][b] = len(self.next)
                    self.next.append({})
                    ends.append(False)
                node = to
            ends[node] = True
        self._link(ends)

    def _link(self, ends: list[bool]) -> None:
        """Failure link and popped pieces of each node, breadth first: a piece's own node pops itself and fails to the root."""
        n = len(self.next)
        self.fail, self.popped = [-1] * n, [0] * n
        queue = [(0, b, to) for b, to in self.next[0].items()]
        for _, b, v in queue:
            if ends[v]:
                self.fail[v], self.popped[v] = 0, int(b != END)
        order = [v for _, _, v in queue]
        for u in order:
            for b, v in self.next[u].items():
                if ends[v]:
                    self.fail[v], self.popped[v] = 0, 1
                else:
                    z, popped = self.fail[u], self.popped[u]
                    while z != -1 and b not in self.next[z]:
                        popped += self.popped[z]
                        z = self.fail[z]
                    if z != -1:
                        self.fail[v], self.popped[v] = self.next[z][b], popped
                order.append(v)

    def count(self, word: bytes) -> int:
        if not word:
            return 0
        node, total, nxt, fail, popped = 0, 0, self.next, self.fail, self.popped
        for b in (*word, END):
            while b not in nxt[node]:
                if fail[node] == -1:
                    return 1
                total += popped[node]
                node = fail[node]
            node = nxt[node][b]
        while node:
            if fail[node] == -1:
                return 1
            total += popped[node]
            node = fail[node]
        return total


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes as: printable ones stand for themselves, the rest follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def read_vocabulary(path: str, suffix: str = "</w>") -> list[tuple[bytes, bool]]:
    """Entries of a tokenizers file whose words end in ``suffix``; special tokens stay out."""
    with open(path, encoding="utf-8") as f:
        vocab, letters, out = json.load(f)["model"]["vocab"], _byte_letters(), []
    for w in vocab:
        last = w.endswith(suffix) and w != suffix
        stem = w[: -len(suffix)] if last else w
        if stem and all(c in letters for c in stem):
            out.append((bytes(letters[c] for c in stem), last))
    return out


_AUTOMATA: dict[str, LongestMatch] = {}


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", memo_words: int = 200_000) -> DataFrame:
    """Per document: id, n_words, n_tokens, n_bytes. Words are runs of non-blank bytes of the text with A-Z lower-cased.

    vocabulary: path of a tokenizers file that every worker can read. One pass without a shuffle; a worker keeps one
    automaton and counts of at most ``memo_words`` distinct words. Null and empty texts count 0; repeated rows and null
    ids are counted row by row; other columns are ignored.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if vocabulary not in _AUTOMATA:
            _AUTOMATA[vocabulary] = LongestMatch(read_vocabulary(vocabulary))
        automaton, memo = _AUTOMATA[vocabulary], {}

        def of(text: str | None) -> tuple[int, int, int]:
            raw = (text or "").encode()
            words = raw.lower().split()
            if len(memo) > memo_words:
                memo.clear()
            for w in set(words).difference(memo):
                memo[w] = automaton.count(w)
            return len(words), sum(map(memo.__getitem__, words)), len(raw)

        for batch in batches:
            yield pd.DataFrame([(i, *of(t)) for i, t in zip(batch["_id"], batch["_t"], strict=True)], columns=["id", "n_words", "n_tokens", "n_bytes"]).astype({"id": "Int64"} if kind == "bigint" else {})

    kind = dict(docs.dtypes)[id_col]
    return docs.selectExpr(f"`{id_col}` AS _id", f"`{text_col}` AS _t").mapInPandas(count, f"id {kind}, n_words long, n_tokens long, n_bytes long").withColumnRenamed("id", id_col)
