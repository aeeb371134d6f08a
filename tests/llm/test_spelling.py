import random
import re
import zlib
from collections import Counter
from itertools import combinations

from plumbline.llm import spelling


def lowered(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute(docs, least_letters=5, least_count=3, noise=97):
    n = Counter()
    for i, t in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = lowered(w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if noise and h % noise == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = {w: k for w, k in n.items() if len(w) >= least_letters and k >= least_count}
    near = {w: [] for w in n}
    alphabet = sorted(set("".join(n)))
    for w in n:
        others = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in alphabet} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in alphabet}
        near[w] = [o for o in others - {w} if o in n]
    form = {}
    for w in n:
        best = min(near[w], key=lambda o: (-n[o], o), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n[form[w]] if form[w] else -1) for w in n)


def rows(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in df.collect())


def corpus(seed=4, docs=80):
    rng = random.Random(seed)
    stems = ["".join(rng.choices("abcdeéß÷À", k=rng.randint(4, 8))) for _ in range(25)]
    words = []
    for s in stems:
        words += [s] * rng.choice([2, 8, 40])
        for _ in range(6):
            i, c = rng.randrange(len(s)), rng.choice("abcdeéß")
            words += [rng.choice([s[:i] + s[i + 1 :], s[:i] + c + s[i:], s[:i] + c + s[i + 1 :]])] * rng.choice([1, 3, 5])
    return [(i, rng.choice([" ", ", ", "1"]).join(w.capitalize() if w.isascii() and rng.random() < 0.1 else w for w in rng.choices(words, k=60))) for i in range(docs)]


def test_variants_equal_brute_force(frame, odd_texts):
    docs = corpus() + odd_texts + [(77, "Repeated repeated")] * 3 + [(5, "no id here"), (None, "nobody nobody nobody")]
    got = rows(spelling.spelling_variants(frame(docs)))
    assert got == brute(docs) and sum(1 for r in got if r[1]) > 10
    docs = [d for d in docs if d not in odd_texts or len(d[1] or "") < 40_000]  # brute force makes every neighbour of a word
    assert rows(spelling.spelling_variants(frame(docs), noise=7, least_count=1)) == brute(docs, least_count=1, noise=7)


def test_chains_of_forms_end_at_the_root(frame):
    chain, text = ["aaaaab", "aaaabb", "aaabbb", "aabbbb", "abbbbb", "bbbbbb"], []
    for k, w in enumerate(chain):
        text += [w] * (3 << k)
    got = rows(spelling.spelling_variants(frame([(1, " ".join(text))]), noise=0))
    assert got == brute([(1, " ".join(text))], noise=0) and {r[2] for r in got} == {"bbbbbb"}


def test_words_of_the_same_letters(spark, frame):
    """Thousands of words share a key: they meet by the order of what remains, so candidates don't grow with the square of the group."""
    rng, words = random.Random(2), set()
    while len(words) < 3000:
        words.add("".join(rng.sample("abcdefgh", 8)))
    more = {w[:3] + "x" + w[4:] for w in list(words)[:300]} | {w[:-1] for w in list(words)[:300]}
    docs = [(1, " ".join(words | more))]
    got = rows(spelling.spelling_variants(frame(docs), noise=0, least_count=1, group=16))
    assert got == brute(docs, least_count=1, noise=0)
    assert rows(spelling.spelling_variants(frame(docs), noise=0, least_count=1, group=1)) == got


def test_long_words(frame):
    long = "".join(random.Random(1).choices("abc", k=700))
    docs = [(1, " ".join([long] * 20 + [long[:350] + long[351:]] * 5 + [long[:-1] + "z"] * 3 + [long[::-1]] * 4))]
    got = rows(spelling.spelling_variants(frame(docs), noise=0))
    assert got == brute(docs, noise=0) and rows(spelling.spelling_variants(frame(docs), noise=0, group=1)) == got
    assert sorted(r[4] for r in got) == [0, 1, 1, 2] and sum(r[1] == long for r in got) == 2


def test_letters_meet_at_one_value():
    letters = [*range(97, 123), *range(0xC0, 0x100)]
    sums = [a**4 + b**4 for a, b in combinations(letters, 2)] + [2 * a**4 for a in letters]
    assert len(sums) == len(set(sums))


def test_no_words(frame):
    assert rows(spelling.spelling_variants(frame([(1, None), (2, ""), (3, "a b c 1 2")]))) == []
    assert rows(spelling.spelling_variants(frame([(1, "x")]).limit(0))) == []
