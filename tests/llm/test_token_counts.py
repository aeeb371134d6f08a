import random

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm.token_counts import LongestMatch, read_vocabulary, token_counts


def brute(vocab, word):
    """Greedy longest match by slicing; None if some position fits no piece."""
    at, n = 0, 0
    while at < len(word):
        for to in range(min(len(word), at + 130), at, -1):
            if (to == len(word) and (word[at:to], True) in vocab) or (word[at:to], False) in vocab:
                break
        else:
            return 1
        at, n = to, n + 1
    return n


@settings(max_examples=200, deadline=None)
@given(st.sets(st.tuples(st.text("abc", min_size=2, max_size=5).map(str.encode), st.booleans()), max_size=12), st.text("abc", min_size=1, max_size=20).map(str.encode))
def test_random_vocabularies(pieces, word):
    vocab = pieces | {(bytes([b]), False) for b in b"ab"}
    assert LongestMatch(sorted(vocab)).count(word) == brute(vocab, word)


def test_public_vocabulary_and_odd_texts(frame, odd_texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    vocab = set(read_vocabulary(path))
    rng = random.Random(1)
    docs = odd_texts + [(50 + i, " ".join("".join(rng.choices("etaoinshrdéß.,!", k=rng.randint(1, 14))) for _ in range(40))) for i in range(20)]
    got = sorted((r.doc_id or -1, r.n_words, r.n_tokens, r.n_bytes) for r in token_counts(frame(docs), path).collect())
    n = {w: brute(vocab, w) for _, t in docs for w in (t or "").encode().lower().split()}
    want = [(i or -1, len(w), sum(map(n.get, w)), len((t or "").encode())) for i, t in docs for w in [(t or "").encode().lower().split()]]
    assert got == sorted(want)
    assert token_counts(frame([]), path).collect() == []
