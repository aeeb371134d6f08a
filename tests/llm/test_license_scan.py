import random
import re

from plumbline.llm.license_scan import BASE, scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(text):
    words, places = WORD.findall(lowered(text)), []
    for t in BASE:
        p = t.text.split()
        places += [(i, t.label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    return len(words), sorted(i for i, _ in places), sorted({x for _, x in places})


def texts():
    rng, bits = random.Random(5), ["GNU", "general", "public", "license", "apache", "CC", "by", "MIT", "License", "the", "cc-by", "é", "gnu general public license"]
    return [(100 + i, rng.choice([" ", ", ", "\n"]).join(rng.choices(bits, k=rng.randint(1, 60)))) for i in range(120)]


def test_base_phrases_equal_brute_force(frame, odd_texts):
    docs = texts() + odd_texts
    got = sorted((r.doc_id or -1, r.n_words, tuple(r.starts), tuple(r.base_labels)) for r in scan(frame(docs)).collect())
    want = sorted((i or -1, n, tuple(s), tuple(b)) for i, t in docs for n, s, b in [brute(t)])
    assert got == want


def test_further_labels_need_their_key_phrase(frame):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated files"
    rows = {r.doc_id: r for r in scan(frame([(1, mit), (2, mit.replace("granted", "given")), (3, "Mozilla Public License 2.0"), (4, "license public mozilla"), (5, "x The MIT License")])).collect()}
    assert [rows[i].labels for i in range(1, 6)] == [["mit"], [], ["mpl"], [], ["mit"]]
    assert rows[5].score == 1.0 and rows[4].score == 0.0 and 0.8 <= rows[1].score < 1.0


def test_empty_table(frame):
    assert scan(frame([])).collect() == []
