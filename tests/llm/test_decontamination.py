import random
import re

import pytest

from plumbline.llm.decontamination import SuffixAutomaton, _scan, contamination, drop_contaminated, excise

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, window):
    w, hit, found = words(text), set(), set()
    for i, t in items:
        p = words(t)
        n = min(window, len(p))
        grams = {tuple(p[k : k + n]) for k in range(len(p) - n + 1)} if n else set()
        for k in range(len(w) - n + 1):
            if n and tuple(w[k : k + n]) in grams:
                hit.update(range(k, k + n))
                found.add(str(i))
    return len(w), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w)


def cases(seed, window):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(6)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(0, 3 * window)))) for i in range(25)] + [(90, None), (91, "..."), (3, "W1 w2, w1-w2 w1")]
    docs = []
    for i in range(150):
        parts = [" ".join(rng.choices(vocab + ["Zq", "é"], k=rng.randint(0, 60)))]
        if rng.random() < 0.7:
            parts.append((rng.choice(items)[1] or "").upper())
        docs.append((i, rng.choice([" ", ". "]).join(parts)))
    return items, docs


def check(spark, frame, odd_texts, seed, window, shard_words, **options):
    items, docs = cases(seed, window)
    docs = docs + [(1000 + k, t) for k, (_, t) in enumerate(odd_texts)] + [(None, items[5][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_hit, r["items"], r.contaminated) for r in contamination(frame(docs), bench, window=window, shard_words=shard_words, **options).collect())
    assert got == sorted((i if i is not None else -1, *brute(t, items, window)) for i, t in docs)


def test_equals_brute_force(spark, frame, odd_texts):
    check(spark, frame, odd_texts, 1, 4, 200_000)


def test_many_automata_give_the_same(spark, frame, odd_texts):
    for chunk in (1, 1 << 20):
        check(spark, frame, odd_texts, 2, 5, 120, chunk=chunk)


def test_several_automata_are_read_one_at_a_time():
    class Copy:
        """A broadcast as a worker sees it."""

        def __init__(self, n):
            self._path, self.n = "p", n

        @property
        def value(self):
            self._value = SuffixAutomaton([(str(self.n), [b"a", b"b", b"%d" % self.n])], 2)
            return self._value

    shards = [Copy(n) for n in range(6)]
    rows = list(_scan(iter([["a b 3"], ["a b 5 b", None]]), shards, 1 << 20))
    assert [[(n, f, sorted(i)) for n, f, i in x] for x in rows] == [[(3, [0, 3], list("012345"))], [(4, [0, 3], list("012345")), (0, [], [])]]
    assert not any(hasattr(s, "_value") for s in shards)


def test_coverage_is_compared_exactly(spark, frame):
    item = " ".join(f"q{i}" for i in range(13))
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    docs = frame([(n, item + " x" * (n - 13)) for n in (13, 30, 32, 33, 43, 44, 260, 261)])
    for coverage, last in ((0.4, 32), (0.3, 43), (0.05, 260), (1, 13)):
        got = {r.doc_id for r in contamination(docs, bench, coverage=coverage).where("contaminated").collect()}
        assert got == {n for n in (13, 30, 32, 33, 43, 44, 260, 261) if n <= last}
    for coverage in (0, -0.1, 1.5):
        with pytest.raises(ValueError, match="coverage"):
            contamination(docs, bench, coverage=coverage)


def test_spans_over_a_limit_are_cut(spark, frame):
    bench = spark.createDataFrame([(1, "one two three"), (2, " ".join(f"q{i}" for i in range(15)))], "item_id long, text string")
    long = " ".join(f"x{i}" for i in range(400))
    docs = frame([(1, f"{long} one two three."), (2, f"{long} " + " ".join(f"q{i}" for i in range(15))), (3, "one two three four"), (4, f"{long} one two three.")])
    clean = {r.doc_id: r.clean_text for r in contamination(docs, bench, with_clean_text=True).collect()}
    assert clean == {1: f"{long} one two three.", 2: f"{long} ", 3: " four", 4: f"{long} one two three."}
    assert {r.doc_id: r.clean_text for r in contamination(docs, bench, with_clean_text=True, span_words=3).collect()}[1] == f"{long} ."


def test_removal(spark, frame):
    item = " ".join(f"q{i}" for i in range(20))
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    docs = frame([(1, f"Start here. {item}. End."), (2, "clean words"), (3, " ".join(f"x{i}" for i in range(400)) + " " + item), (4, None)])
    assert sorted(r.doc_id for r in drop_contaminated(docs, bench).collect()) == [2, 3, 4]
    clean = {r.doc_id: r.clean_text for r in contamination(docs, bench, with_clean_text=True).collect()}
    assert clean[1] == "Start here. . End." and clean[2] == "clean words" and clean[4] == ""
    assert excise("a b c", [(0, 1), (2, 3)]) == " b "


def test_empty_tables(spark, frame):
    none = spark.createDataFrame([], "item_id long, text string")
    assert contamination(frame([]), none).collect() == []
    assert [r.contaminated for r in contamination(frame([(1, "a b")]), none).collect()] == [False]
