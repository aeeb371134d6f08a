import itertools
import random
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from plumbline.llm.packing import WordTokenizer, nnls, pack, patterns, plan

PATH = public_tokenizers.path("word_bpe_49k.json")
PLAIN = Tokenizer.from_file(PATH)


@lru_cache(maxsize=1)
def _kept():
    return WordTokenizer(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("aA'sdtl ll,.1² ½ªºİſΣσς中́̌\n\t\x1c\xa0")), max_size=40))
def test_word_ids_equal_the_tokenizer(text):
    assert _kept().ids(text).tolist() == PLAIN.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("aAb .1 \t\n\x0b\x0c\r\x1c\x1f\x85\xa0\u2003\u3000\x00")), max_size=12)), max_size=9), st.sampled_from([1, 7, 1000]))
def test_texts_together_equal_the_tokenizer(texts, chars):
    got = list(_kept().ids_of(texts, chars))
    assert [g.tolist() for g in got] == [PLAIN.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_forgetting_changes_nothing():
    small, rng = WordTokenizer(PATH, memo_words=50), random.Random(2)
    texts = [" ".join("".join(rng.choices("abcé1'", k=rng.randint(1, 4))) for _ in range(rng.randint(0, 30))) for _ in range(200)]
    assert [g.tolist() for g in small.ids_of(texts, 60)] == [PLAIN.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(small.number) < 200


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<|startoftext|>", "<|endoftext|>", "<|", "|>", "endoftext", "Hello", "ß", " ", "\n", "'s", "42", "<|ENDOFTEXT|>"]), max_size=12))
def test_literals_of_added_tokens(parts):
    text = "".join(parts)
    assert _kept().ids(text).tolist() == PLAIN.encode(text, add_special_tokens=False).ids


def test_patterns_fill_the_window():
    table = patterns(8, 3)
    assert (table.T @ np.arange(1, 9) == 8).all() and table.sum(axis=0).max() == 3
    brute = {tuple(sorted(c)) for n in (1, 2, 3) for c in itertools.product(range(1, 9), repeat=n) if sum(c) == 8}
    assert table.shape[1] == len(brute)


def test_nnls_meets_the_optimality_conditions():
    rng = np.random.default_rng(1)
    for _ in range(20):
        a, b = rng.random((12, 30)), rng.random(12) * 10 - 2
        x = nnls(a, b)
        gradient = a.T @ (b - a @ x)
        assert (x >= 0).all() and gradient.max() < 1e-5 and abs(gradient @ x) < 1e-4


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 700), max_size=60))
def test_plan_loses_nothing_and_pads_nothing(lengths):
    seqs = plan(np.array(lengths, np.int64), 256, 16, 3)
    got = defaultdict(list)
    for seq in seqs:
        n = sum(k for _, _, k in seq)
        assert n == 256 or (n < 256 and n & (n - 1) == 0)
        for d, s, k in seq:
            got[d].append((s, k))
    for d, n in enumerate(lengths):
        at = 0
        for s, k in sorted(got[d]):
            assert s == at and k > 0
            at += k
        assert at == n


def test_round_trip(frame, odd_texts):
    rng = random.Random(8)
    docs = odd_texts + [(90, "<|endoftext|>"), (91, "a<|startoftext|>b <|endoftext|>")] + [(100 + i, " ".join(rng.choices(["the", "Über", "naïve,", "x1y22", "don't", "…"], k=rng.randint(0, 900)))) for i in range(40)]
    rows = pack(frame(docs), PATH, block_docs=9, with_ids=True).collect()
    want = sorted((i or -1, tuple(PLAIN.encode(t or "", add_special_tokens=False).ids + [1])) for i, t in docs)
    seqs = defaultdict(list)
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids) > 0
        seqs[r.sequence_id].append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 2048
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id or -1].append(r)
    assert sum(r.length for r in rows) == sum(len(t) for _, t in want)
    unique = {i: t for i, t in want if sum(j == i for j, _ in want) == 1}
    for i, t in unique.items():
        pieces = sorted(by_doc[i], key=lambda r: r.start)
        assert tuple(x for p in pieces for x in p.ids) == t and {p.doc_tokens for p in pieces} == {len(t)}


def test_empty_table(frame):
    assert pack(frame([]), PATH).collect() == []


def test_forgotten_words_are_learnt_again():
    rng = random.Random(4)
    words = [rng.choice(["", "É", "x"]) + "".join(rng.choices("abcdeß中'1.", k=rng.randint(1, 7))) for _ in range(400)]
    small = WordTokenizer(PATH, memo_words=50)
    for _ in range(60):
        text = " ".join(rng.choices(words, k=30) + words[:10])
        assert small.ids(text).tolist() == PLAIN.encode(text, add_special_tokens=False).ids
        assert len(small.number) <= 100


def test_a_file_with_another_rule_is_used_as_a_whole(tmp_path):
    with open(PATH, encoding="utf-8") as f:
        text = f.read()
    other = tmp_path / "other.json"
    other.write_text(text.replace("'s|'t|'re|'ve|'m|'ll|'d|", "'re|", 1), encoding="utf-8")
    assert WordTokenizer(PATH).by_word
    mine, whole = WordTokenizer(str(other)), Tokenizer.from_file(str(other))
    assert not mine.by_word
    for t in ("it's 42 O'Neil words", "", None, "naïve <|endoftext|> x"):
        assert mine.ids(t).tolist() == whole.encode(t or "", add_special_tokens=False).ids
