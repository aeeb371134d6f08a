"""Filtering operators judge rows, not ids: repeated ids with other texts, repeated rows and null ids, as multisets against brute force."""

import random
import zlib
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from plumbline.llm import common
from plumbline.llm.decontamination import drop_contaminated
from plumbline.llm.exact_dedup import drop_exact_copies
from plumbline.llm.quality import drop_rejected
from plumbline.llm.simhash import drop_near_copies
from tests.llm.test_decontamination import brute as contamination_of
from tests.llm.test_exact_dedup import normal
from tests.llm.test_quality import corpus as quality_corpus
from tests.llm.test_shingles import mutants, similar_pairs
from tests.llm.test_simhash import roots, slow_fingerprint

BIG = 1 << 60


@pytest.fixture(params=["broadcast", "slots"])
def way(request, monkeypatch):
    """Both ways in which verdicts reach their rows."""
    if request.param == "slots":
        monkeypatch.setattr(common, "BROADCAST_ROWS", 1)
    return request.param


def rows_of(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


REPEATED = [(1, "same"), (1, "same"), (2, "a b c d e"), (2, "only here"), (3, "A b c d e"), (None, "a B c d e"), (None, "nobody"), (None, "nobody"), (4, None), (4, ""), (5, "SAME"), (5, "same")]


def test_exact_copies(frame, odd_texts, way):
    pairs = REPEATED + odd_texts + [(random.Random(i).randrange(6), f"text {i % 9}") for i in range(60)]
    groups = defaultdict(list)
    for i, t in pairs:
        groups[normal(t)].append(i)
    want = Counter((max(ids, key=lambda i: -1 if i is None else i), t) for t, ids in groups.items())
    got = drop_exact_copies(frame(pairs))
    assert got.columns == frame(pairs).columns
    assert Counter((i, normal(t)) for i, t in rows_of(got).elements()) == want


def test_unique_texts_of_a_shared_id_stay(frame):
    got = rows_of(drop_exact_copies(frame([(1, "same"), (1, "same"), (2, "a b c d e"), (2, "only here"), (3, "A b c d e")])))
    assert got == Counter([(1, "same"), (2, "only here"), (3, "A b c d e")])


def near_kept(pairs, similarity):
    """Brute force: one row a component of texts, that of the smallest id."""
    texts = sorted({t or "" for _, t in pairs})
    fp = [slow_fingerprint(t) for t in texts]
    links = [(a, b) for a in range(len(texts)) for b in range(a) if (fp[a] ^ fp[b]).bit_count() <= 4]
    links += similar_pairs(list(enumerate(texts))) if similarity else []
    root = roots(range(len(texts)), links)
    groups = defaultdict(list)
    for i, t in pairs:
        groups[root[texts.index(t or "")]].append((BIG if i is None else i, t or ""))
    return {k: (min(i for i, _ in g), {t for i, t in g if i == min(j for j, _ in g)}) for k, g in groups.items()}


@pytest.mark.parametrize("similarity", [None, 0.8])
def test_near_copies(frame, odd_texts, way, similarity):
    short = [(i, t) for i, t in odd_texts if t is None or len(t) < 40_000]
    pairs = REPEATED + short + [(100 + (i % 30), t) for i, t in mutants(7, 4, 6)]
    got = sorted((BIG if i is None else i, t or "") for i, t in rows_of(drop_near_copies(frame(pairs), similarity=similarity)).elements())
    want = sorted(near_kept(pairs, similarity).values(), key=lambda v: (v[0], min(v[1])))
    assert sorted(i for i, _ in got) == [i for i, _ in want]
    left = list(got)
    for i, some in want:
        left.remove(next(x for x in left if x[0] == i and x[1] in some))
    assert not left


def test_contaminated(spark, frame):
    item = " ".join(f"q{i}" for i in range(20))
    bench = spark.createDataFrame([(7, item), (7, item), (8, None)], "item_id long, text string")
    pairs = [(2, item), (2, "clean text"), (None, item), (None, "clean too"), (3, "clean text"), (3, "clean text"), (4, None), (5, "")]
    for words in (200_000, 5):
        got = drop_contaminated(frame(pairs), bench, shard_words=words)
        assert got.columns == frame(pairs).columns and rows_of(got) == Counter(p for p in pairs if not contamination_of(p[1], [(7, item)], 13)[3])


def test_rejected(spark, frame, way):
    docs, labels = quality_corpus(400)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    truth = {i: q for i, q, _ in labels}
    good, bad = next(t for i, t in docs if truth[i]), next(t for i, t in docs if not truth[i])
    pairs = docs + [(9001, good), (9001, bad), (9002, good), (9002, good), (None, good), (None, bad)]
    got = rows_of(drop_rejected(frame(pairs), known))
    assert (got[(9001, good)], got[(9001, bad)], got[(9002, good)], got[(None, good)], got[(None, bad)]) == (1, 0, 2, 1, 0)
    held = [(i, t) for i, t in docs if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum((p in got) == bool(truth[p[0]]) for p in held) >= 0.95 * len(held)


def test_pipeline_stages_keep_one_of_each(spark, frame, tmp_path):
    docs, labels = quality_corpus(300)
    item = " ".join(f"q{i}" for i in range(30))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    pairs = docs + docs[:40] + [(i, docs[(i + 7) % 300][1]) for i in range(0, 60, 3)] + [(5, docs[9][1] + " " + item), (5, item)]
    left = common.materialize(corpus_pipeline.quality(spark, frame(pairs), str(tmp_path)), "q")
    kept = rows_of(left)
    assert not kept - Counter(pairs) and all(kept[p] == n for p, n in Counter(pairs).items() if p in kept)
    left = common.materialize(corpus_pipeline.exact_dedup(spark, left, str(tmp_path)), "e")
    groups = defaultdict(list)
    for i, t in kept:
        groups[normal(t)].append(i)
    assert Counter((i, normal(t)) for i, t in rows_of(left).elements()) == Counter((max(g), t) for t, g in groups.items())
    before = list(rows_of(left))
    left = common.materialize(corpus_pipeline.near_dedup(spark, left, str(tmp_path)), "n")
    want = near_kept(before, 0.8)
    assert sorted(i for i, _ in rows_of(left).elements()) == sorted(i for i, _ in want.values())
    before = rows_of(left)
    left = corpus_pipeline.decontamination(spark, left, str(tmp_path))
    assert rows_of(left) == Counter({p: n for p, n in before.items() if not contamination_of(p[1], [(1, item)], 13)[3]})
