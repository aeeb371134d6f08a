import hashlib
import math
import re
import zlib
from collections import Counter

from plumbline.llm.resampling import ranked, resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "item_id long, text string"


def features(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return [zlib.crc32(f.encode()) % 10000 for f in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]


def brute(docs, target, percent=25, least=20):
    s, t = Counter(b for _, x in docs for b in features(x)), Counter(b for x in target for b in features(x))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000))))
    out = []
    for i, x in docs:
        f = features(x)
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f)) // len(f) if f else 0
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in out if r[1] >= 2 * least - 1), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    drawn = Counter()
    rank = {}
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        rank[(*r, drawn[r])] = k + 1
        drawn[r] += 1
    seen, full = Counter(), []
    for r in out:
        full.append((*r, rank.get((*r, seen[r]))))
        seen[r] += 1
    return sorted(full, key=repr)


def rows(df):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in df.collect()), key=repr)


def docs_of(odd_texts):
    long = [(100 + i, " ".join(f"Word{(i * k) % 37}" for k in range(10 + i))) for i in range(60)]
    return long + odd_texts + long[50:] + long[50:] + [(None, long[40][1]), (55, long[45][1])]


def test_draw_equals_brute_force(spark, frame, odd_texts):
    docs, target = docs_of(odd_texts), ["word1 word2 word3", "Word5, word7", None, ""]
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(target)], SCHEMA)
    assert rows(resample(frame(docs), bench)) == brute(docs, target)
    assert rows(resample(frame(docs), bench, percent=60, least_words=1)) == brute(docs, target, 60, 1)
    assert rows(resample(frame(docs), bench.limit(0))) == brute(docs, [])


def test_no_documents(spark, frame):
    bench = spark.createDataFrame([(1, "a b")], SCHEMA)
    assert resample(frame([(1, "x")]).limit(0), bench).collect() == []
    assert rows(resample(frame([(1, None), (2, "")]), bench)) == brute([(1, None), (2, "")], ["a b"])


def test_places_go_by_ranges(spark):
    df = spark.range(5000).selectExpr("id", "(id * 7919) % 503 AS k")
    got = ranked(df, ["k", "id"], "place")
    assert [r.id for r in got.orderBy("place").collect()] == [r.id for r in df.orderBy("k", "id").collect()]
    assert sorted(r.place for r in got.collect()) == list(range(1, 5001))
