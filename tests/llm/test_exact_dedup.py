import hashlib
import re
from collections import defaultdict

from plumbline.llm.exact_dedup import drop_exact_copies, exact_dedup


def normal(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def documents(odd_texts):
    pairs = list(odd_texts)
    for i in range(60):  # equal lengths, equal prefixes, equal texts
        pairs.append((100 + i, "Prefix " * 60 + f"{i % 7}{'ÀB' if i % 2 else 'Àb'}"))
    return pairs


def test_equals_brute_force(frame, odd_texts):
    pairs = documents(odd_texts)
    groups = defaultdict(list)
    for i, t in pairs:
        groups[normal(t)].append(i)
    want = []
    for i, t in pairs:
        ids = groups[normal(t)]
        keep = max((x for x in ids if x is not None), default=None)
        want.append((i or -1, keep or -1, len(ids), i == keep, hashlib.sha256(normal(t).encode()).hexdigest()))
    for bits in (1 << 22, 1 << 15):
        got = sorted((r.doc_id or -1, r.keep_id or -1, r.group_size, r.kept, bytes(r.digest).hex()) for r in exact_dedup(frame(pairs), digest_all=True, bitmap_bits=bits).collect())
        assert got == sorted(want)


def test_unique_rows_are_settled_without_a_full_hash(frame):
    rows = {r.doc_id: r for r in exact_dedup(frame([(1, "a"), (2, "bb"), (3, "BB"), (4, "x" * 600 + "1"), (5, "y" * 600 + "1")])).collect()}
    assert rows[1].digest is None and rows[4].digest is None and rows[5].digest is None and rows[2].digest == rows[3].digest is not None
    assert [rows[i].kept for i in range(1, 6)] == [True, False, True, True, True]


def test_rows_of_the_kept_documents(frame, odd_texts):
    kept = drop_exact_copies(frame(odd_texts))
    assert kept.columns == frame(odd_texts).columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 2, 3, 6, 7, 8, 9, 10, 11]


def test_empty_table(frame):
    assert exact_dedup(frame([])).collect() == []
