"""WARC archives in Zstandard: a dictionary in the leading skippable frame, then one frame a record."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, group_lookup, materialize, new_path

#: Fixed values of the format: the magic number of the frame that holds the dictionary, and the profile of revisit records.
DICTIONARY_MAGIC = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Records whose blocks a dictionary is trained on, at most; and bytes of them.
SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES = 200, 1 << 20, 32 << 10


class ArchiveError(ValueError):
    """An archive or a record breaks the format."""


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """A response record, or the revisit of page ``refers_to``: the HTTP head with the payload's full length, but no payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 2000-01-01T00:00:00Z"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines.append(f"WARC-Payload-Digest: sha1:{payload_digest(payload)}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(raw: bytes, what: str) -> tuple[str, dict[str, str]]:
    first, *lines = raw.decode().split("\r\n")
    out = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon:
            raise ArchiveError(f"{what} header without a colon: {line[:60]!r}")
        out[name.strip().lower()] = value.strip()
    return first, out


def _page(value: str) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d*)>", value)
    if not m:
        raise ArchiveError(f"bad record id {value[:60]!r}")
    return int(m[1]) if m[1] else None


def read_record(raw: bytes) -> dict:
    """Validates one record (version, needed headers, lengths, digest) and returns its fields; payload is None for a revisit."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    version, h = _headers(head, "WARC")
    if not gap or version not in ("WARC/1.0", "WARC/1.1"):
        raise ArchiveError(f"not a WARC record: {version[:20]!r}")
    for name in ("warc-type", "warc-record-id", "warc-date", "warc-payload-digest", "content-length"):
        if name not in h:
            raise ArchiveError(f"no {name}")
    n = int(h["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ArchiveError(f"block of {len(rest) - 4} bytes, {n} announced")
    http, gap, payload = rest[:n].partition(b"\r\n\r\n")
    status, fields = _headers(http, "HTTP")
    if not gap or not status.startswith("HTTP/"):
        raise ArchiveError("block is no HTTP response")
    size, digest, kind = int(fields["content-length"]), h["warc-payload-digest"].removeprefix("sha1:"), h["warc-type"]
    if kind == "response" and (len(payload) != size or payload_digest(payload) != digest):
        raise ArchiveError("payload differs from its length or digest")
    if kind == "revisit" and (payload or "warc-refers-to" not in h):
        raise ArchiveError("revisit with a payload or without a reference")
    if kind not in ("response", "revisit"):
        raise ArchiveError(f"unknown type {kind[:20]!r}")
    return {"page_id": _page(h["warc-record-id"]), "url": h.get("warc-target-uri"), "record_type": kind, "refers_to": _page(h["warc-refers-to"]) if kind == "revisit" else None, "payload_bytes": size, "payload_digest": digest, "payload": payload if kind == "response" else None}


def _train(records: list[bytes]) -> bytes:
    """A dictionary for records like these; empty if they are too few or too alike to train one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, records, level=3).as_bytes() if len(records) >= 16 else b""
    except zstandard.ZstdError:
        return b""


class ArchiveWriter:
    """Writes frames to a binary file. The first records are held back to train the dictionary that leads the file."""

    def __init__(self, out, level: int = 3):
        self.out, self.level, self.held, self.compress = out, level, [], None
        self.records = self.bytes = 0

    def add(self, record: bytes) -> None:
        self.records += 1
        if self.compress is None:
            self.held.append(record)
            if len(self.held) >= SAMPLE_RECORDS or sum(map(len, self.held)) >= SAMPLE_BYTES:
                self._begin()
        else:
            self._put(self.compress(record))

    def _put(self, raw: bytes) -> None:
        self.out.write(raw)
        self.bytes += len(raw)

    def _begin(self) -> None:
        trained = _train([r[:65_536] for r in self.held])
        if trained:
            self._put(struct.pack("<II", DICTIONARY_MAGIC, len(trained)) + trained)
        dictionary = zstandard.ZstdCompressionDict(trained) if trained else None
        self.compress = zstandard.ZstdCompressor(level=self.level, dict_data=dictionary, write_checksum=True).compress
        for record in self.held:
            self._put(self.compress(record))
        self.held = []

    def close(self) -> None:
        if self.compress is None:
            self._begin()
        self.out.close()


def read_archive(source, chunk: int = 1 << 20) -> Iterator[dict]:
    """Records of an archive, read chunk by chunk: only one frame and one chunk are held. The dictionary frame may be missing, raw or compressed."""
    data = source.read(8)
    dictionary = None
    if len(data) == 8 and struct.unpack("<I", data[:4])[0] == DICTIONARY_MAGIC:
        size = struct.unpack("<I", data[4:])[0]
        raw = source.read(size)
        if len(raw) != size:
            raise ArchiveError("dictionary frame is cut off")
        if raw[:4] == b"\x28\xb5\x2f\xfd":
            raw = zstandard.ZstdDecompressor().decompress(raw)
        dictionary, data = zstandard.ZstdCompressionDict(raw), b""
    decompressor = zstandard.ZstdDecompressor(dict_data=dictionary)
    while True:
        data = data or source.read(chunk)
        if not data:
            return
        frame, parts = decompressor.decompressobj(), []
        while not frame.eof:
            if not data and not (data := source.read(chunk)):
                raise ArchiveError("last frame is cut off")
            parts.append(frame.decompress(data))
            data = frame.unused_data if frame.eof else b""
        yield read_record(b"".join(parts))


def _store(path: str):
    """File system and path within it of a folder that all executors share."""
    from pyarrow import fs

    if re.match(r"file:/(?!//)", path):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def write_archives(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", archive_bytes: int = 64 << 20, least_revisit: int = 0) -> DataFrame:
    """Writes one record a page and returns the manifest (archive, records, bytes), itself written in the folder.

    Of pages with equal payloads of at least least_revisit bytes, that of the largest id is the response and the others
    revisit it. Who revisits whom is settled on narrow rows (id, SHA-1, length); html stays in place unless the revisits
    are too many to broadcast, and then only pages in their slots move (see common.attach). Each task writes archives of about archive_bytes under names of its own; only archives in
    the manifest count, so a repeated or lost task leaves no wrong record. Null html is an empty payload; repeated rows get
    a record each; a null id is written as such; control characters and blanks in a URL are percent-encoded; other columns
    are ignored; an empty table gives an empty manifest.
    """
    folder = folder or new_path(pages.sparkSession, "warc")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("html"))
    keyed = rows.select("id", F.unhex(F.sha1("html")).alias("sha1"), F.octet_length("html").cast("long").alias("n"))
    narrow = materialize(keyed.where(F.col("n") >= least_revisit).withColumn("row", F.monotonically_increasing_id()), "digests")
    found = group_lookup(narrow, ["sha1", "n"], [("refers_to", "max", "id")], spread="row")
    revisits = found.where("refers_to IS NOT NULL AND NOT (id <=> refers_to)").select(F.col("id").alias("page"), "sha1", "refers_to").distinct()
    typed = attach(rows, {"page": F.col("id"), "sha1": F.unhex(F.sha1("html"))}, materialize(revisits, "revisits")).select("id", "url", "html", "refers_to")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, at = _store(folder)
        store.create_dir(at, recursive=True)
        writer, name, done = None, "", []

        def close() -> None:
            writer.close()
            done.append((f"{folder}/{name}", writer.records, writer.bytes))

        for b in batches:
            for i, url, html, to in zip(b["id"].astype("Int64"), b["url"], b["html"], b["refers_to"].astype("Int64"), strict=True):
                if writer is None:
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    writer = ArchiveWriter(store.open_output_stream(f"{at}/{name}", compression=None))
                writer.add(make_record(None if pd.isna(i) else int(i), url, html, None if pd.isna(to) else int(to)))
                if writer.bytes >= archive_bytes:
                    close()
                    writer = None
        if writer is not None:
            close()
        yield pd.DataFrame(done, columns=["archive", "records", "bytes"])

    manifest = typed.mapInPandas(write, "archive string, records long, bytes long")
    manifest.write.parquet(f"{folder}/manifest")
    return pages.sparkSession.read.parquet(f"{folder}/manifest")


RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, archive string"


def read_archives(manifest: DataFrame, with_payload: bool = True, batch_records: int = 256, batch_bytes: int = 4 << 20) -> DataFrame:
    """Records of the archives that the manifest lists, validated; payload (binary) is null for revisits. A task streams its archives."""
    names = [c.split()[0] for c in RECORD.split(", ")] + ["payload"] * with_payload

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def frame(rows: list[dict]) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})

        for b in batches:
            for archive, expected in zip(b["archive"], b["records"], strict=True):
                store, at = _store(archive)
                rows, held, seen = [], 0, 0
                with store.open_input_stream(at, compression=None) as source:
                    for record in read_archive(source):
                        seen += 1
                        held += len(record["payload"] or b"") * with_payload
                        rows.append(record | {"archive": archive})
                        if len(rows) >= batch_records or held >= batch_bytes:
                            yield frame(rows)
                            rows, held = [], 0
                if seen != expected:
                    raise ArchiveError(f"{archive} has {seen} records, not {expected}")
                if rows:
                    yield frame(rows)

    schema = RECORD + ", payload binary" * with_payload
    parts = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return manifest.repartition(parts, "archive").mapInPandas(read, schema)
