"""Packs tokenised documents into fixed windows: shallow length combinations, non-negative least squares, greedy rest."""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import count, groupby, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The vocabulary's fixed splitting rule (contractions, runs of letters, single digits, runs of others) for words of PLAIN letters, one a line.
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zÀ-ÖØ-öø-ž]+|[0-9]|[^\sa-z0-9À-ÖØ-öø-ž]+|\n")
PLAIN = re.compile(r"[\n\x21-\x7eÀ-ÖØ-öø-įı-ž]+")
#: Stands for the end of a word among ids; no vocabulary is that large.
_END = 0xFFFFFFFF
#: The steps before the model in a tokenizers file to which _SPLIT and PLAIN apply (fixed values); a file with others is used as a whole.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
PRETOKENIZERS = ["Split", "ByteLevel"]
SPLITTING = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def splits_by_rule(path: str) -> bool:
    """Whether the tokenizers file at path normalises and splits text by the rule that _SPLIT and PLAIN write out, before a byte-level BPE with word ends."""
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    before = (made.get("normalizer") or {}).get("normalizers", [])
    cut = (made.get("pre_tokenizer") or {}).get("pretokenizers", [])
    blanks = [(x["pattern"], x["content"]) for x in before if x["type"] == "Replace"] == [({"Regex": r"\s+"}, " ")]
    rule = [(x["pattern"], x["behavior"], x["invert"]) for x in cut if x["type"] == "Split"] == [({"Regex": SPLITTING}, "Removed", True)]
    plain = not any(x.get("add_prefix_space") for x in cut) and made["model"]["type"] == "BPE" and bool(made["model"].get("end_of_word_suffix"))
    return [x["type"] for x in before] == NORMALIZERS and [x["type"] for x in cut] == PRETOKENIZERS and blanks and rule and plain


class _Pieces(dict):
    """Ids of a word's pieces as bytes of 32-bit numbers, worked out by the BPE model when first asked for."""

    def __init__(self, model):
        self.model = model
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.letters = str.maketrans({b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)})
        self.reset()

    def reset(self) -> None:
        self.clear()
        self["\n"] = array("I", [_END]).tobytes()

    def __missing__(self, s: str) -> bytes:
        written = s if s.isascii() else s.encode().decode("latin-1").translate(self.letters)
        ids = self[s] = array("I", [t.id for t in self.model.tokenize(written)]).tobytes()
        return ids


class WordTokenizer:
    """Token ids of texts by a tokenizers file, word by word with a memo.

    Blanks always end a token of such a vocabulary, so a text's ids are those of its blank-separated words in turn. A word
    of ASCII and Latin letters below U+017F is split here and only its pieces go to the BPE model; any other word, and a word
    that holds a literal of an added token, goes through the tokenizer as a whole. A file that splits by another rule (see splits_by_rule)
    is used on whole texts. The unknown words of some texts are learnt together. Beyond memo_words words the half met less often is
    forgotten, which costs time to learn them again and nothing else.
    """

    def __init__(self, path: str, memo_words: int = 200_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.by_word = Tokenizer.from_file(path), splits_by_rule(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pieces, self.memo_words = _Pieces(self.tokenizer.model), memo_words
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.size, self.texts = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32)
        self._number([])

    def _number(self, words: list[bytes]) -> None:
        """Numbers words from 0; asking for another word gives it the next number."""
        self.number: defaultdict[bytes, int] = defaultdict(count(len(words)).__next__, zip(words, range(len(words)), strict=True))

    def _plain(self, s: str) -> bool:
        return PLAIN.fullmatch(s) is not None and not any(a in s for a in self.added)

    def words(self, raw: list[bytes]) -> np.ndarray:
        """Ids of the words in turn, each followed by _END."""
        lines = b"\n".join([*raw, b""]).decode()
        if self._plain(lines):
            return np.frombuffer(b"".join(map(self.pieces.__getitem__, _SPLIT.findall(lines.lower()))), np.uint32)
        if len(raw) == 1:
            return np.array([*self.tokenizer.encode(lines[:-1], add_special_tokens=False).ids, _END], np.uint32)
        plain = [self._plain(w.decode()) for w in raw]
        if not any(plain):
            return np.concatenate([self.words([w]) for w in raw])
        runs = [[w for _, w in g] for _, g in groupby(zip(plain, raw, strict=True), key=lambda x: x[0])]
        return np.concatenate([self.words(r) for r in runs])

    def _learn(self, n: int) -> None:
        """Learns the words from number n on."""
        new = len(self.number) - n
        found = self.words(list(islice(reversed(self.number), new))[::-1])
        last = found == _END
        ends = np.flatnonzero(last) - np.arange(new)
        found = found[~last]
        while self.used + len(found) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while n + new > len(self.start):
            self.start, self.size, self.texts = (np.concatenate((x, np.zeros_like(x))) for x in (self.start, self.size, self.texts))
        self.size[n : n + new] = np.diff(ends, prepend=0)
        self.start[n : n + new] = self.used + ends - self.size[n : n + new]
        self.texts[n : n + new] = 0
        self.flat[self.used : self.used + len(found)] = found
        self.used += len(found)

    def _forget(self) -> None:
        n = len(self.number)
        kept = np.sort(np.argpartition(-self.texts[:n], n // 2)[: n // 2])
        words = list(self.number)
        self._number([words[i] for i in kept.tolist()])
        flat = self._gather(kept)
        self.size[: len(kept)], self.texts[: len(kept)] = self.size[kept], self.texts[kept] >> 1
        self.start[: len(kept)] = np.cumsum(self.size[: len(kept)]) - self.size[: len(kept)]
        self.flat[: len(flat)], self.used = flat, len(flat)
        self.pieces.reset()

    def _gather(self, at: np.ndarray) -> np.ndarray:
        size = self.size[at]
        ends = np.cumsum(size, dtype=np.int64)
        return self.flat[np.repeat(self.start[at] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]

    def ids(self, text: str | None) -> np.ndarray:
        return self._of([text])[0]

    def ids_of(self, texts: Iterable[str | None], chars: int = 1 << 22) -> Iterator[np.ndarray]:
        """Ids of each text in turn; texts are looked at together, up to about ``chars`` characters at a time."""
        some: list[str | None] = []
        held = 0
        for t in texts:
            some.append(t)
            held += len(t or "")
            if held >= chars:
                yield from self._of(some)
                some, held = [], 0
        yield from self._of(some)

    def _of(self, texts: list[str | None]) -> list[np.ndarray]:
        if not self.by_word:
            return [np.array(self.tokenizer.encode(t or "", add_special_tokens=False).ids, np.uint32) for t in texts]
        # Arrow splits and numbers the words of all texts, so only distinct ones become Python objects; an empty word has no ids
        split = pc.ascii_split_whitespace(pa.array([t or "" for t in texts], pa.large_string()))
        coded = split.flatten().dictionary_encode()
        if len(self.number) > self.memo_words:
            self._forget()
        n, distinct = len(self.number), coded.dictionary.cast(pa.large_binary()).to_pylist()
        own = np.fromiter(map(self.number.__getitem__, distinct), np.int64, len(distinct))
        if len(self.number) > n:
            self._learn(n)
        self.texts[own] += 1
        at = own[coded.indices.to_numpy(zero_copy_only=False)]
        ends = np.concatenate(([0], np.cumsum(self.size[at], dtype=np.int64)))
        return np.split(self._gather(at), ends[split.offsets.to_numpy()[1:-1]]) if texts else []


@lru_cache(maxsize=4)
def patterns(bins: int, depth: int) -> np.ndarray:
    """Every multiset of at most depth bin sizes that fills a window of ``bins`` steps: one column each, counts by bin size 1..bins."""
    out: list[list[int]] = []

    def grow(rest: int, least: int, left: int, sizes: list[int]) -> None:
        if rest == 0:
            out.append(sizes)
        elif left:
            for s in range(least, rest + 1):
                grow(rest - s, s, left - 1, [*sizes, s])

    grow(bins, 1, depth, [])
    table = np.zeros((bins, len(out)))
    for j, sizes in enumerate(out):
        for s in sizes:
            table[s - 1, j] += 1
    return table


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by the active-set method: the passive set grows by the steepest column and shrinks at the bounds.

    After ``rounds`` columns it stops with what it has: still x >= 0, and what the plan lacks then is packed greedily.
    """
    x, passive = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    tol = 1e-9 * max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(rounds):
        gradient = a.T @ (b - a @ x)
        gradient[passive] = -np.inf
        j = int(np.argmax(gradient))
        if gradient[j] <= tol:
            break
        passive[j] = True
        while True:
            z = np.zeros_like(x)
            z[passive] = np.linalg.lstsq(a[:, passive], b, rcond=None)[0]
            low = passive & (z <= tol)
            if not low.any():
                break
            step = float(np.min(x[low] / np.maximum(x[low] - z[low], 1e-300)))
            x += step * (z - x)
            passive &= x > tol
            x[~passive] = 0
        x = z
    return x


def plan(lengths: np.ndarray, window: int, step: int, depth: int) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (document, start, length) for documents of the given lengths; every token is in exactly one.

    Whole windows of long documents stand alone. The remaining lengths, in bins of ``step``, are matched with combinations
    that fill a window: least squares against their histogram, rounded down. What a sequence still lacks, and all documents
    left over, are filled greedily in order, cutting at the window. Sequences are full but for at most one rest, which is
    cut into powers of two, so nothing is padded.
    """
    done: list[list[tuple[int, int, int]]] = []
    rest: list[tuple[int, int, int]] = []
    for d, n in enumerate(lengths.tolist()):
        whole = n // window * window
        done += [[(d, s, window)] for s in range(0, whole, window)]
        if n > whole:
            rest.append((d, whole, n - whole))
    bins = window // step
    stock: list[list[tuple[int, int, int]]] = [[] for _ in range(bins + 1)]
    for piece in sorted(rest, key=lambda p: (p[2], p[0])):
        stock[-(-piece[2] // step)].append(piece)
    table = patterns(bins, depth)
    repeats = np.floor(nnls(table, np.array([len(s) for s in stock[1:]], float)) + 1e-6).astype(int)
    open_: list[list[tuple[int, int, int]]] = []
    for j in np.flatnonzero(repeats):
        sizes = np.repeat(np.arange(1, bins + 1), table[:, j].astype(int))
        for _ in range(repeats[j]):
            if any(len(stock[s]) < c for s, c in zip(*np.unique(sizes, return_counts=True), strict=True)):
                break
            open_.append([stock[s].pop() for s in sizes])
    loose = [p for s in stock for p in s][::-1]
    while open_ or loose:
        seq = open_.pop(0) if open_ else []
        lack = window - sum(n for _, _, n in seq)
        while lack and (loose or open_):
            if not loose:
                loose += open_.pop()  # its documents fill the gaps of the others
            d, s, n = loose.pop()
            take = min(n, lack)
            seq.append((d, s, take))
            lack -= take
            if take < n:
                loose.append((d, s + take, n - take))
        if not lack:
            done.append(seq)
            continue
        while seq:  # the last tokens: the largest power of two each time
            full = 1 << (sum(n for _, _, n in seq).bit_length() - 1)
            part: list[tuple[int, int, int]] = []
            while full:
                d, s, n = seq.pop(0)
                take = min(n, full)
                part.append((d, s, take))
                full -= take
                if take < n:
                    seq.insert(0, (d, s + take, n - take))
            done.append(part)
    return done


_TOKENIZERS: dict[str, WordTokenizer] = {}

PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", window: int = 2048, end_id: int = 1, step: int = 64, depth: int = 3, block_tokens: int = 2_000_000, block_docs: int = 4096, with_ids: bool = False, memo_words: int = 200_000) -> DataFrame:
    """Pieces of documents packed into sequences of ``window`` tokens: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's tokens are those of its whole text and end_id. Documents are packed in blocks of at most block_docs
    documents or about block_tokens tokens of an input partition, so memory is bounded and nothing is shuffled; a block
    pads nothing (see plan). sequence_id is the partition's number times 2^40 plus a running number. with_ids adds the ids of
    each piece. vocabulary: a path that all workers can read. A worker keeps the ids of memo_words words, some 0.4 KB each. Null text is empty: a document of end_id alone. Repeated rows
    and null ids are packed like other rows; other columns are ignored; an empty table gives no pieces.
    """
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        pa.default_memory_pool().release_unused()  # what earlier tasks of a reused worker have left
        if vocabulary not in _TOKENIZERS:
            _TOKENIZERS[vocabulary] = WordTokenizer(vocabulary, memo_words)
        tokenizer, sequence = _TOKENIZERS[vocabulary], TaskContext.get().partitionId() << 40
        ids: list = []
        tokens: list[np.ndarray] = []
        held = 0

        def flush() -> pd.DataFrame:
            nonlocal sequence, held
            out = []
            for seq in plan(np.array([len(t) for t in tokens], np.int64), window, step, depth):
                at = 0
                for d, s, n in seq:
                    piece = tokens[d][s : s + n]
                    out.append((ids[d], s, n, zlib.crc32(piece.astype("<u4").tobytes()), len(tokens[d]), sequence, at) + ((piece.tolist(),) if with_ids else ()))
                    at += n
                sequence += 1
            ids.clear(), tokens.clear()
            held = 0
            names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
            return pd.DataFrame(out, columns=names).astype({"id": "Int64"} if kind == "bigint" else {})

        for x in batches:
            for i, t in zip(x["id"], tokenizer.ids_of(x["t"]), strict=True):
                got = np.append(t, np.uint32(end_id)).astype(np.uint32)
                if ids and (held + len(got) > block_tokens or len(ids) >= block_docs):
                    yield flush()
                ids.append(None if pd.isna(i) else i)
                tokens.append(got)
                held += len(got)
        if ids:
            yield flush()

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    return source.mapInPandas(run, f"id {kind}, {PIECES}" + ", ids array<long>" * with_ids).withColumnRenamed("id", id_col)
