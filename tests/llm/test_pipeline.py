import random
from collections import defaultdict

import corpus_pipeline
from tests.llm.test_decontamination import brute as contaminated
from tests.llm.test_decontamination import words
from tests.llm.test_shingles import similar_pairs
from tests.llm.test_simhash import roots, slow_fingerprint

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(12)
    vocab = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(300)]
    text = lambda n: " ".join(rng.choices(vocab, k=n)).capitalize() + "."
    items = [(i, text(rng.choice([8, 20, 30]))) for i in range(5)]
    docs, labels = [], []

    def add(t, good=1):
        docs.append((len(docs), t, "en", "s", len(t or "")))
        labels.append((docs[-1][0], good, 0))

    for i in range(160):
        t = text(rng.randint(60, 300))
        add(t)
        if i % 8 == 0:
            add(t.upper() if i % 16 else t)
        if i % 10 == 0:
            add(t + " " + vocab[i])
        if i % 9 == 0:
            add(t + " " + items[i % 5][1])
        if i % 4 == 0:
            add(" ".join(w + "***" if i % 8 else w.upper() + "!!" for w in t.split()), 0)
    add(None), add("")
    return docs, labels, items


def test_stages_equal_brute_force(spark, tmp_path):
    docs, labels, items = corpus()
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    left = {r.doc_id: r.text for r in corpus_pipeline.quality(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)).collect()}
    bad = {i for i, q, _ in labels if not q}
    assert len(bad & set(left)) <= 2 and len(set(left) | bad) >= len(docs) - 4

    lowered = defaultdict(list)
    for i, t in left.items():
        lowered["".join(c.lower() if c.isascii() else c for c in t or "")].append(i)
    left = {max(g): left[max(g)] for g in lowered.values()}
    fp = {i: slow_fingerprint(t) for i, t in left.items()}
    near = [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 4]
    root = roots(sorted(left), near + similar_pairs(sorted(left.items())))
    left = {i: left[i] for i in sorted(set(root.values()))}
    left = {i: t for i, t in left.items() if not contaminated(t, items, 13)[3]}
    assert any(words(t) for t in left.values())

    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} == set(left)
    for i in left:
        pieces = sorted((r.start, r.length, r.doc_tokens) for r in rows if r.doc_id == i)
        assert sum(n for _, n, _ in pieces) == pieces[0][2] and all(a + n == b for (a, n, _), (b, _, _) in zip(pieces, pieces[1:], strict=False))


def test_columns_stay(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a", "en", "s", 1)], SCHEMA)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for some in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, some, str(tmp_path))
            assert out.columns == docs.columns and out.count() == some.count()
