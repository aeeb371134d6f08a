"""Benchmark decontamination with a generalised suffix automaton over the words of all benchmark items."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_BYTES, materialize


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORD_BYTES).split()


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences. It tells, while words stream by, the longest suffix that occurs in an item.

    window: words that make a match; an item of fewer words (but not none) matches as a whole.
    """

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int):
        self.window, self.ids = window, [i for i, _ in items]
        self.vocabulary: dict[bytes, int] = {}
        self.next, self.link, self.length = [{}], [-1], [0]
        ends: list[tuple[int, int, int]] = []  # (state, words of the item up to there, item)
        for k, (_, words) in enumerate(items):
            state = 0
            for n, w in enumerate(words, 1):
                state = self._extend(state, self.vocabulary.setdefault(w, len(self.vocabulary)))
                if n >= window or n == len(words):
                    ends.append((min(n, window), k, state))
        self.shortest = min((n for n, _, _ in ends), default=0)
        self._mark(ends)

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:  # the sequence is there already: at its own state, or split off that state now
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        cur = self._new({}, length[last] + 1)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p == -1:
            link[cur] = 0
        else:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _new(self, edges: dict[int, int], n: int) -> int:
        self.next.append(edges)
        self.link.append(0)
        self.length.append(n)
        return len(self.next) - 1

    def _clone(self, p: int, c: int, q: int) -> int:
        clone = self._new(dict(self.next[q]), self.length[p] + 1)
        self.link[clone] = self.link[q]
        self.link[q] = clone
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _mark(self, ends: list[tuple[int, int, int]]) -> None:
        """found[state]: (words, items) of the windows that are suffixes of the state's longest string, longest first."""
        own: dict[int, dict[int, set[int]]] = {}
        for n, k, state in ends:
            while self.length[self.link[state]] >= n:  # the state whose strings include the last n words
                state = self.link[state]
            own.setdefault(state, {}).setdefault(n, set()).add(k)
        self.found: list[tuple[tuple[int, frozenset[int]], ...]] = [()] * len(self.next)
        for v in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            mine = tuple((n, frozenset(own[v][n])) for n in sorted(own[v], reverse=True)) if v in own else ()
            self.found[v] = mine + self.found[self.link[v]]

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Merged word ranges [start, end) inside occurrences of windows, and the items (by number) whose windows occur."""
        ranges: list[tuple[int, int]] = []
        items: set[int] = set()
        if not self.shortest or len(words) < self.shortest:
            return ranges, items
        ids = np.fromiter((self.vocabulary.get(w, -1) for w in words), np.int64, len(words))
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (ids >= 0).view(np.int8), [0]))))
        nxt, link, length, found = self.next, self.link, self.length, self.found
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a < self.shortest:  # words that no item has break every match
                continue
            state = matched = 0
            for at, c in enumerate(ids[a:b].tolist(), a + 1):
                while state and c not in nxt[state]:
                    state = link[state]
                    matched = length[state]
                if c in nxt[state]:
                    state, matched = nxt[state][c], matched + 1
                longest = 0
                for n, ks in found[state]:
                    if n <= matched:
                        longest = longest or n
                        items |= ks
                if longest:
                    start = at - longest
                    while ranges and ranges[-1][1] >= start:
                        start = min(start, ranges.pop()[0])
                    ranges.append((start, at))
        return ranges, items


def excise(text: str, ranges: list[tuple[int, int]]) -> str:
    """text without the given word ranges, as far as separators between words go."""
    raw = text.encode()
    flat = np.frombuffer(raw.translate(WORD_BYTES), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flat.view(np.int8), [0]))))
    starts, ends = edges[::2], edges[1::2]
    out, at = [], 0
    for a, b in ranges:
        out.append(raw[at : starts[a]])
        at = int(ends[b - 1])
    return b"".join([*out, raw[at:]]).decode()


def automata(benchmark: DataFrame, window: int, item_col: str = "item_id", text_col: str = "text", shard_words: int = 200_000) -> list[Broadcast]:
    """Pickled automata of about shard_words item words each, broadcast one after another.

    Distinct items are dealt by hash and executors build the automata, so the driver holds one at a time (some tens of MB) and no item.
    """
    spark = benchmark.sparkSession

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield pd.DataFrame({"i": x["i"], "t": x["t"], "n": [len(words_of(t)) for t in x["t"]]})

    items = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).alias("t")).distinct()
    items = materialize(items.mapInPandas(counted, "i string, t string, n long").where("n > 0"), "benchmark-items")
    total = items.agg(F.sum("n")).first()[0] or 0
    shards = -(-total // shard_words)

    def build(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        made = SuffixAutomaton([(i, words_of(t)) for i, t in sorted(zip(x["i"], x["t"], strict=True), key=lambda r: (r[0] is None, r))], window)
        return pd.DataFrame({"shard": [key[0]], "automaton": [pickle.dumps(made, pickle.HIGHEST_PROTOCOL)]})

    dealt = items.withColumn("shard", F.pmod(F.xxhash64("i", "t"), F.lit(max(1, shards))).cast("int"))
    built = materialize(dealt.groupBy("shard").applyInPandas(build, "shard int, automaton binary"), "automata")
    one = lambda s: built.where(F.col("shard") == s).collect()
    return [spark.sparkContext.broadcast(pickle.loads(r["automaton"])) for s in range(shards) for r in one(s)]


def _each(shards: list[Broadcast]) -> Iterator[SuffixAutomaton]:
    """The automata in turn. Of several the worker holds one at a time, read anew from its local copy; a single one stays."""
    for b in shards:
        yield b.value
        if len(shards) > 1 and b._path is not None:
            del b._value


def _scan(batches: Iterator[list], shards: list[Broadcast], chunk: int) -> Iterator[list[tuple[int, list[int], set[str]]]]:
    """For each batch of texts a list of (words, merged starts and ends of hits in turn, item ids).

    With several automata, batches are held until they have ``chunk`` characters, and then meet each automaton in turn.
    """
    held: list[list] = []

    def flush() -> Iterator[list[tuple[int, list[int], set[str]]]]:
        out = [[(0, [], set()) for _ in x] for x in held]
        for n, a in enumerate(_each(shards)):
            for x, rows in zip(held, out, strict=True):
                for k, t in enumerate(x):
                    words = words_of(t)
                    ranges, found = a.hits(words)
                    _, flat, items = rows[k]
                    items |= {a.ids[i] for i in found if a.ids[i] is not None}
                    rows[k] = (len(words), _merge(flat, ranges) if n else [v for r in ranges for v in r], items)
            del a
        if not shards:
            out = [[(len(words_of(t)), [], set()) for t in x] for x in held]
        held.clear()
        yield from out

    size = 0
    for x in batches:
        held.append(x)
        size += sum(len(t) for t in x if t)
        if len(shards) < 2 or size >= chunk:
            yield from flush()
            size = 0
    yield from flush()


def _merge(flat: list[int], ranges: list[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for a, b in sorted([*zip(flat[::2], flat[1::2], strict=True), *ranges]):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def _limit(coverage: float) -> Fraction:
    if not 0 < coverage <= 1:
        raise ValueError(f"coverage must be over 0 and at most 1, not {coverage}")
    return Fraction(str(coverage))


def _hit(flat: list[int]) -> int:
    return sum(flat[1::2]) - sum(flat[::2])


def _over(hit: int, words: int, limit: Fraction) -> bool:
    """Whether hit words are at least the limit's share of words, in whole numbers."""
    return hit > 0 and hit * limit.denominator >= words * limit.numerator


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, coverage: float = 0.05, shard_words: int = 200_000, chunk: int = 32 << 20, with_clean_text: bool = False, span_words: int = 13) -> DataFrame:
    """Per document: id, n_words, ranges (starts and ends of hit word ranges in turn), n_hit, items (ids as sorted strings), contaminated.

    A word is hit inside any occurrence of ``window`` consecutive words of an item (or of a whole shorter item);
    a document is contaminated if hit words are at least ``coverage`` (over 0, at most 1; compared exactly) of its words. with_clean_text
    adds clean_text, the text without the ranges that exceed a limit: those of ``span_words`` words or more, and all of them in a contaminated
    document. Documents stream past broadcast automata in one pass without a shuffle. An automaton holds about ``shard_words``
    item words; a larger benchmark makes several, which a worker reads one at a time for each ``chunk`` characters of text.

    Null texts have no words and no hits; items without words never occur; null or repeated ids are judged row by row;
    repeated items count once by id; an empty benchmark leaves all documents clean; other columns are ignored.
    """
    kind, limit = dict(docs.dtypes)[id_col], _limit(coverage)
    shards = automata(benchmark, window, item_col, item_text_col, shard_words)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[pd.DataFrame] = []

        def texts() -> Iterator[list]:
            for x in batches:
                kept.append(x if with_clean_text else x[["id"]])
                yield x["t"].tolist()

        for rows in _scan(texts(), shards, chunk):
            x, hit = kept.pop(0), [_hit(f) for _, f, _ in rows]
            over = [_over(h, n, limit) for h, (n, _, _) in zip(hit, rows, strict=True)]
            cols = {"id": x["id"], "n_words": [n for n, _, _ in rows], "ranges": [f for _, f, _ in rows], "n_hit": hit, "items": [sorted(i) for _, _, i in rows], "contaminated": over}
            if with_clean_text:
                cut = [[(a, b) for a, b in zip(f[::2], f[1::2], strict=True) if o or b - a >= span_words] for o, (_, f, _) in zip(over, rows, strict=True)]
                cols["clean_text"] = [excise(t or "", c) for t, c in zip(x["t"], cut, strict=True)]
            yield pd.DataFrame(cols).astype({"id": "Int64"} if kind == "bigint" else {})

    schema = f"id {kind}, n_words long, ranges array<int>, n_hit long, items array<string>, contaminated boolean" + ", clean_text string" * with_clean_text
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInPandas(run, schema).withColumnRenamed("id", id_col)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, coverage: float = 0.05, shard_words: int = 200_000, chunk: int = 32 << 20) -> DataFrame:
    """docs without contaminated rows (see contamination); all columns and all other rows stay. Every row is judged by its own text, in place."""
    limit = _limit(coverage)
    shards = automata(benchmark, window, item_col, item_text_col, shard_words)

    @F.pandas_udf("boolean")
    def clean(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pa.default_memory_pool().release_unused()  # what earlier tasks of a reused worker have left
        for rows in _scan((x.tolist() for x in texts), shards, chunk):
            yield pd.Series([not _over(_hit(f), n, limit) for n, f, _ in rows], dtype=bool)

    return docs.where(clean(F.col(text_col)))
