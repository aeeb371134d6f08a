import random

import corpus_pipeline
import numpy as np
import pandas as pd

from plumbline.llm import common, shingles
from plumbline.llm.shingles import linked, shingle_set
from plumbline.llm.simhash import drop_near_copies, near_duplicates
from tests.llm.test_simhash import roots, slow_fingerprint


def slow_set(text, k=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def mutants(seed, groups=10, copies=8):
    rng = random.Random(seed)
    vocab = [f"v{i}" for i in range(400)]
    out = []
    for _ in range(groups):
        base = rng.choices(vocab, k=rng.choice([6, 60, 300]))
        out.append(" ".join(base))
        for _ in range(copies):
            w = list(base)
            for at in rng.sample(range(len(w)), max(1, int(len(w) * rng.choice([0.01, 0.02, 0.03, 0.05])))):
                w[at] = rng.choice(vocab)
            out.append(" ".join(w))
    return list(enumerate(out, 100))


def similar_pairs(docs):
    s = {i: slow_set(t) for i, t in docs}
    return [(a, b) for a in s for b in s if a < b and s[a] and s[b] and 5 * len(s[a] & s[b]) >= 4 * len(s[a] | s[b])]


def test_linked_equals_brute_force():
    texts = [t for _, t in mutants(1)]
    a, b = linked([shingle_set(t) for t in texts], 0.8)
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == set(similar_pairs(list(enumerate(texts))))


def test_similar_texts_share_a_component(frame, odd_texts):
    docs = mutants(2) + [(900, "one two three four five six seven one two three four five six seven one two three"), (901, "one two three four five six seven one two three four five six seven")]
    fp = {i: slow_fingerprint(t) for i, t in docs}
    near = [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 4]
    similar = similar_pairs(docs)
    assert sum((fp[a] ^ fp[b]).bit_count() > 4 for a, b in similar) > 20
    want = roots(sorted(fp), near + similar)
    got = {r.doc_id: r.component_id for r in near_duplicates(frame(docs), similarity=0.8).collect()}
    assert got == want
    kept = sorted(r.doc_id for r in drop_near_copies(frame(docs + odd_texts), similarity=0.8).where("doc_id >= 100").collect())
    assert kept == sorted(set(want.values()))


def test_blocks_hold_every_pair(spark, frame):
    from plumbline.llm.common import materialize
    from plumbline.llm.shingles import similar_links
    from plumbline.llm.simhash import fingerprints

    docs = mutants(3, 3, 20)
    rows = materialize(fingerprints(frame(docs), bands=True), "f")
    fp = {i: int(np.uint64(slow_fingerprint(t)).astype(np.int64)) for i, t in docs}
    want = roots(sorted(set(fp.values())), [(fp[a], fp[b]) for a, b in similar_pairs(docs)])
    for options in ({}, {"class_sets": 4, "block": 3}, {"class_shingles": 100, "block": 512}):
        found = [tuple(r) for r in similar_links(frame(docs), rows, "doc_id", "text", **options).collect()]
        assert roots(sorted(set(fp.values())), found) == want


def test_stage_drops_similar_texts(frame, tmp_path):
    docs = mutants(4)
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(None, frame(docs), str(tmp_path)).collect()}
    assert not [p for p in similar_pairs(docs) if set(p) <= kept]


def test_sets_are_made_in_parts():
    """One Arrow batch of long texts leaves in several parts: a task doesn't hold the sets of a whole batch."""
    texts = ["one two three four five six " * 40_000, None, "a b c d e f " * 200_000, "", "short text"] * 2
    found = list(shingles.whole_sets(iter([pd.DataFrame({"t": texts})])))
    assert len(found) > 1 and sum(map(len, found)) == len(texts)
    assert [n for x in found for n in x["sh"]] == [shingles.set_id(shingles.shingle_set(t)) for t in texts]
    assert [len(x) for x in common.in_parts(iter([pd.DataFrame({"t": ["aaa", "b", None, "cccc", ""]}), pd.DataFrame({"t": []})]), chars=4)] == [2, 2, 1]
