import io
import random

import pytest
import zstandard

from plumbline.llm import common
from plumbline.llm.warc import ArchiveError, ArchiveWriter, make_record, payload_digest, read_archive, read_archives, read_record, write_archives

SCHEMA = "page_id long, url string, html string, id long, sha1 string, archive string, payload string"


def pages(n):
    rng = random.Random(3)
    out = [(i, f"http://h/{i % 7}?q={i}", "<html><body>" + " ".join(rng.choices(["alpha", "beta", "gamma", "é"], k=rng.randint(0, 300))) + "</body></html>") for i in range(n)]
    same = "<p>same</p>"
    return out + [(1000, None, same), (1007, "http://a b\r\nX: y", same), (1003, "u", same), (1100, "u", None), (1101, "u", ""), (1102, None, "x" * 300_000), (None, "u", "no id"), (1200, "u", "twice"), (1200, "u", "twice")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, None, "s", "a", "p") for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("broadcast", [200_000, 1])
def test_round_trip(spark, monkeypatch, broadcast):
    monkeypatch.setattr(common, "BROADCAST_ROWS", broadcast)
    rows = pages(700)
    got = read_archives(write_archives(frame(spark, rows), archive_bytes=20_000)).collect()
    best = {}
    for i, _, html in rows:
        key = html or ""
        best[key] = max(best.get(key, -1), -1 if i is None else i)
    want = []
    for i, _, html in rows:
        raw, to = (html or "").encode(), best[html or ""]
        revisit = to != -1 and i != to
        want.append((i or -1, len(raw), payload_digest(raw), "revisit" if revisit else "response", to if revisit else -1, None if revisit else raw))
    assert sorted((r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type, -1 if r.refers_to is None else r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got) == sorted(want)
    assert len({r.archive for r in got}) > 3 and {r.url for r in got if r.page_id == 1007} == {"http://a%20b%0D%0AX:%20y"}


def archive(records):
    out = io.BytesIO()
    out.close, raw = lambda: None, out
    w = ArchiveWriter(out)
    for r in records:
        w.add(r)
    w.close()
    return raw.getvalue()


def test_dictionary_leads_and_frames_stand_alone():
    records = [make_record(i, "u", f"<html>{'common text ' * 20}{i}</html>".encode()) for i in range(300)]
    raw = archive(records)
    assert raw[:4] == b"\x5d\x2a\x4d\x18" and [r["page_id"] for r in read_archive(io.BytesIO(raw), chunk=7)] == list(range(300))
    size = int.from_bytes(raw[4:8], "little")
    packed = zstandard.ZstdCompressor().compress(raw[8 : 8 + size])
    assert len(list(read_archive(io.BytesIO(raw[:4] + len(packed).to_bytes(4, "little") + packed + raw[8 + size :])))) == 300
    few = archive(records[:3])
    assert few[:4] == b"\x28\xb5\x2f\xfd" and len(list(read_archive(io.BytesIO(few)))) == 3


def test_broken_archives_are_refused():
    good = make_record(1, "u", b"payload")
    for bad in (good.replace(b"WARC/1.1", b"WARX/1.1"), good[:-1], good.replace(b"payload", b"pay1oad"), good.replace(b"WARC-Date", b"Date"), good.replace(b"urn:page:1", b"urn:x")):
        with pytest.raises(ArchiveError):
            read_record(bad)
    with pytest.raises(ArchiveError):
        list(read_archive(io.BytesIO(archive([good])[:-3])))
    assert read_record(make_record(None, None, b"abc", refers_to=5)) | {"url": None} == {"page_id": None, "url": None, "record_type": "revisit", "refers_to": 5, "payload_bytes": 3, "payload_digest": payload_digest(b"abc"), "payload": None}


def test_empty_table(spark):
    assert read_archives(write_archives(frame(spark, []).limit(0))).collect() == []
