import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from plumbline.llm.bestfit import SumOfSquares, pack_whole

PATH = public_tokenizers.path("word_bpe_49k.json")


def brute(sizes, window):
    """The rule word for word: for each gap that fits, the sum of squares after placing; the smallest gap of the least one."""
    gaps, out = [], []
    for s in sizes:
        best = None
        for g in sorted({g for g in gaps if g >= s}):
            after = list(gaps)
            after[after.index(g)] = g - s
            score = sum(after.count(x) ** 2 for x in set(after) if x)
            if best is None or score < best[0]:
                best = (score, g)
        if best is None:
            gaps.append(window - s)
            out.append(0)
        else:
            gaps[gaps.index(best[1])] = best[1] - s
            out.append(window - best[1])
    return len(gaps), out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 24), max_size=40))
def test_placing_equals_the_rule(sizes):
    packer = SumOfSquares(24)
    got = [packer.place(s) for s in sizes]
    assert (packer.opened, [at for _, at in got]) == brute(sizes, 24)
    used = defaultdict(int)
    for (n, at), s in zip(got, sizes, strict=True):
        assert at == used[n]
        used[n] += s
        assert used[n] <= 24


def test_few_sequences():
    rng = np.random.default_rng(3)
    sizes = np.sort(np.minimum(4096, rng.lognormal(6.3, 1, 20_000).astype(int) + 1))[::-1]
    packer = SumOfSquares(4096)
    for s in sizes.tolist():
        packer.place(s)
    assert packer.opened <= -(-int(sizes.sum()) // 4096) + 2


def check(rows, texts, window, most_over=None):
    plain, by_doc, by_seq = Tokenizer.from_file(PATH), defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    want = defaultdict(list)
    for i, t in texts:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 1]
        want[i] += [(k // window, k, len(ids[k : k + window]), zlib.crc32(np.array(ids[k : k + window], "<u4").tobytes())) for k in range(0, len(ids), window)]
    assert {i: sorted((r.piece, r.start, r.length, r.ids_crc32) for r in v) for i, v in by_doc.items()} == {i: sorted(v) for i, v in want.items()}
    for v in by_seq.values():
        at = 0
        for r in sorted(v, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
    return len(by_seq), sum(n for v in want.values() for _, _, n, _ in v)


def test_round_trip_on_odd_rows(frame, odd_texts):
    for window in (4096, 64):
        sequences, tokens = check(pack_whole(frame(odd_texts), PATH, window=window, group_pieces=100).collect(), odd_texts, window)
        assert sequences <= tokens // window + 14


def test_groups_leave_few_unfilled(frame):
    rng = random.Random(1)
    texts = [(i, " ".join(rng.choices(["the", "word", "sequences", "Wörter", "42"], k=rng.randint(1, 90)))) for i in range(1200)]
    sequences, tokens = check(pack_whole(frame(texts, 20), PATH, window=256, group_pieces=400).collect(), texts, 256)
    assert sequences <= -(-tokens // 256) + 2 * 3


def test_ids_and_empty(frame):
    got = pack_whole(frame([(1, "hello world"), (2, None)]), PATH, with_ids=True).collect()
    assert {r.doc_id: r.ids for r in got} == {1: [*Tokenizer.from_file(PATH).encode("hello world", add_special_tokens=False).ids, 1], 2: [1]}
    assert pack_whole(frame([(1, "x")]).limit(0), PATH).collect() == []
