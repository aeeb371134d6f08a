import random

import numpy as np
import xxhash

from plumbline.llm.components import components
from plumbline.llm.simhash import drop_near_copies, fingerprint, links, meet, near_duplicates


def slow_fingerprint(text, k=4):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(nodes, pairs):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def classes(root):
    """The sets of nodes with a common root."""
    out = {}
    for x, r in root.items():
        out.setdefault(r, set()).add(x)
    return sorted(map(sorted, out.values()))


def clustered(seed, n):
    rng = random.Random(seed)
    fps = [rng.getrandbits(64) for _ in range(n // 4)]
    while len(set(fps)) < n:
        f = rng.choice(fps)
        for b in rng.sample(range(64), rng.randint(1, 6)):
            f ^= 1 << b
        fps.append(f)
    return sorted(set(fps))


def test_links_equal_brute_force(spark):
    fps = clustered(3, 400)
    want = roots(range(len(fps)), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(f,) for f in signed], "fp long").repartition(3)
    for options in ({}, {"per_task": 100, "block": 5_000}):
        got = {r.node: r.root for r in components(links(df, len(fps), **options)).collect()}
        assert classes({f: got.get(f, f) for f in signed}) == classes({signed[i]: r for i, r in want.items()})


def test_meet_needs_every_part_once():
    fps = np.array(clustered(4, 120), np.uint64)
    place = {f: i for i, f in enumerate(fps.view(np.int64).tolist())}
    pairs = [(place[a], place[b]) for p in range(64) for a, b in zip(*(x.tolist() for x in meet(fps, 2, 8, p, 6, 1000)), strict=True)]
    want = [(i, j) for i in range(len(fps)) for j in range(i) if int(fps[i] ^ fps[j]).bit_count() <= 4]
    assert roots(range(len(fps)), pairs) == roots(range(len(fps)), want)


def test_documents(frame, odd_texts):
    rng = random.Random(2)
    base = [" ".join(rng.choices([f"v{i}" for i in range(50)], k=200)) for _ in range(12)]
    docs = odd_texts + [(100 + 3 * i + j, t if j == 0 else t + " tail" * j) for i, t in enumerate(base) for j in range(3)]
    got = near_duplicates(frame(docs)).collect()
    fp = [slow_fingerprint(t) for _, t in docs]
    assert sorted((r.doc_id or -1, r.fp % (1 << 64)) for r in got) == sorted((i or -1, f) for (i, _), f in zip(docs, fp, strict=True))
    ids = sorted({i for i, _ in docs if i is not None})
    some = [(i, f) for (i, _), f in zip(docs, fp, strict=True) if i is not None]
    want = roots(ids, [(a, b) for a, f in some for b, g in some if a < b and (f ^ g).bit_count() <= 4])
    assert all(r.component_id == want[r.doc_id] for r in got if r.doc_id is not None)
    kept = sorted(r.doc_id for r in drop_near_copies(frame(docs)).where("doc_id IS NOT NULL").collect())
    assert kept == sorted(set(want.values()))


def test_long_path_and_empty(spark, frame):
    path = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    assert {r.root for r in components(path).collect()} == {0} and components(path).count() == 300
    assert near_duplicates(frame([])).collect() == []
    assert fingerprint("") == 0 and fingerprint("One two") == slow_fingerprint("one TWO")
