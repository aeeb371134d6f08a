"""Packs tokenised documents into few sequences without cutting them: each goes where the squared counts of open sequences per gap become smallest."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .packing import WordTokenizer

_TOKENIZERS: dict[str, WordTokenizer] = {}


class SumOfSquares:
    """Open sequences by gap (tokens that still fit). With n(g) of them at gap g, a piece of s tokens turns a gap g into g - s,
    which changes the sum of n(g)^2 by 2 (n(g - s) - n(g) + 1), or 1 - 2 n(g) where g = s: full sequences don't count. Of the gaps that fit, the one of
    the least change is taken, the smallest of equal ones. A sequence is opened only if no gap fits: opening one more early
    can lower the sum, but the number of sequences is what is to be small."""

    def __init__(self, window: int):
        self.window, self.opened = window, 0
        self.n = np.zeros(window + 1, np.int64)
        self.open_: list[list[int]] = [[] for _ in range(window + 1)]

    def place(self, size: int) -> tuple[int, int]:
        """Sequence number and offset of the next piece, which has 1 to window tokens."""
        n, most = self.n, self.window
        here = n[size:most]
        gap = most
        if here.any():
            change = 2 * (n[: most - size] - here + 1)
            change[0] -= 1  # it closes the sequence: no new gap is counted
            gap = size + int(np.argmin(np.where(here > 0, change, np.iinfo(np.int64).max)))
        if gap == most:
            number = self.opened
            self.opened += 1
        else:
            number = self.open_[gap].pop()
            n[gap] -= 1
        if left := gap - size:
            self.open_[left].append(number)
            n[left] += 1
        return number, most - gap


def pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", window: int = 4096, end_id: int = 1, with_ids: bool = False, memo_words: int = 500_000) -> DataFrame:
    """Documents as pieces of at most window tokens: id, piece, start, length, ids_crc32, place (a number of its own); with_ids adds the ids.

    A worker keeps the ids of memo_words words, some 0.4 KB each.
    """
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        pa.default_memory_pool().release_unused()  # what earlier tasks of a reused worker have left
        if vocabulary not in _TOKENIZERS:
            _TOKENIZERS[vocabulary] = WordTokenizer(vocabulary, memo_words)
        tokenizer, place = _TOKENIZERS[vocabulary], TaskContext.get().partitionId() << 40
        names = ["id", "piece", "start", "length", "ids_crc32", "place"] + ["ids"] * with_ids
        for x in batches:
            out = []
            for i, t in zip(x["id"], tokenizer.ids_of(x["t"]), strict=True):
                ids = np.append(t, np.uint32(end_id)).astype("<u4")
                for k in range(0, len(ids), window):
                    cut = ids[k : k + window]
                    out.append((None if pd.isna(i) else i, k // window, k, len(cut), zlib.crc32(cut.tobytes()), place) + ((cut.tolist(),) if with_ids else ()))
                    place += 1
            yield pd.DataFrame(out, columns=names).astype({"id": "Int64"} if kind == "bigint" else {})

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    return source.mapInPandas(run, f"id {kind}, piece int, start long, length long, ids_crc32 long, place long" + ", ids array<long>" * with_ids)


def pack_whole(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", window: int = 4096, end_id: int = 1, group_pieces: int = 50_000, with_ids: bool = False) -> DataFrame:
    """Pieces of documents in sequences of at most ``window`` tokens: id, piece, start, length, ids_crc32, sequence_id, offset.

    A document's tokens are those of its whole text and end_id; only one of more than window tokens is cut, into whole windows
    and a rest. Pieces (a few numbers each, no text) are written to the shared folder, dealt at random into groups of about
    group_pieces and placed longest first; a group leaves one or two sequences unfilled, whatever the lengths of its input
    partitions. Placing depends on the group's pieces alone, so a task that is run again gives the same. sequence_id is the
    group's number times 2^40 plus a running number. with_ids adds the ids of each piece. vocabulary: a path that all workers
    can read. Null text is empty: end_id alone. Repeated rows and null ids are packed like other rows; other columns are
    ignored; an empty table gives no pieces.
    """
    cut = materialize(pieces(docs, vocabulary, id_col, text_col, window, end_id, with_ids), "pieces")
    groups = max(1, -(-cut.count() // group_pieces))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        first, packer = TaskContext.get().partitionId() << 40, SumOfSquares(window)
        for x in batches:
            at = np.array([packer.place(s) for s in x["length"].tolist()], np.int64).reshape(-1, 2)
            yield x.drop(columns="place").assign(sequence_id=first + at[:, 0], offset=at[:, 1])

    dealt = cut.repartition(groups, F.xxhash64("place")).sortWithinPartitions(F.desc("length"), "place")
    shape = f"id {dict(docs.dtypes)[id_col]}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids + ", sequence_id long, offset long"
    return dealt.mapInPandas(run, shape).withColumnRenamed("id", id_col)
