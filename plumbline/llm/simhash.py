"""SimHash near-duplicates, linked by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 2r bits have a common variant within r bits of each, so each fingerprint emits all
its variants within r bits and equal variants meet. Variants are dealt by a linear (XOR) checksum. As checksum(f ^ mask) is
checksum(f) ^ checksum(mask), a fingerprint is sent once to each part that has variants of it, and the part makes just those
variants itself. With the usual 64 parts each gets every fingerprint (8 bytes), 512 bytes a fingerprint in place of the 16 KB
of its 2,081 variants; more parts are needed only beyond some millions of fingerprints, and then more bytes travel.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, in_parts, materialize, settle_rows, table_lookup
from .components import components, local_roots
from .shingles import band_keys, set_id, shingle_set, similar_links

#: Shingles whose hashes are held at once.
BLOCK = 1 << 15


def fingerprint(text: str | None, words: int = 4) -> int:
    """64-bit SimHash, unsigned, of the word shingles of a text with A-Z lower-cased; 0 without words."""
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    whole, k = b" ".join(w), min(words, len(w))
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    a, b = starts[: len(w) - k + 1].tolist(), ends[k - 1 :].tolist()
    set_bits, digest = np.zeros(64, np.int64), xxhash.xxh64_digest
    for at in range(0, len(a), BLOCK):
        raw = b"".join([digest(whole[x:y], 42) for x, y in zip(a[at : at + BLOCK], b[at : at + BLOCK], strict=True)])
        set_bits += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(set_bits * 2 > len(a)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, bands: bool = False, digests: bool = False) -> DataFrame:
    """(id, fp) of every row, fp as a signed long; one pass over whole texts. With ``bands`` also row, sh, shingles and keys (see shingles), with ``digests`` the text's SHA-256."""

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in in_parts(batches):
            fp = np.array([fingerprint(t, words) for t in x["t"]], np.uint64).view(np.int64)
            out = pd.DataFrame({"id": x["id"].astype("Int64"), "fp": fp})
            if bands:
                out["row"] = x["row"]
                sets = [shingle_set(t) for t in x["t"]]
                out["sh"], out["shingles"], out["keys"] = [set_id(s) for s in sets], [len(s) for s in sets], [band_keys(s) for s in sets]
            if digests:
                out["digest"] = [hashlib.sha256((t or "").encode()).digest() for t in x["t"]]
            yield out

    row = [F.xxhash64(F.col(id_col).cast("long"), F.col(text_col)).alias("row")] * bands
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"), *row)
    return source.mapInPandas(hashed, "id long, fp long" + ", row long, sh long, shingles long, keys array<long>" * bands + ", digest binary" * digests)


def masks(radius: int) -> np.ndarray:
    """All 64-bit words with at most radius bits set."""
    return np.array([sum(1 << b for b in c) for n in range(radius + 1) for c in combinations(range(64), n)], np.uint64)


def checksum(v: np.ndarray, bits: int) -> np.ndarray:
    """Linear checksum: XOR of a fixed pseudo-random number of ``bits`` bits for each bit that is set."""
    column = np.random.default_rng(20_081).integers(0, 1 << 30, 64).astype(np.int64)
    out = np.zeros(len(v), np.int64)
    for b in range(64):
        out ^= np.where((v >> np.uint64(b)) & np.uint64(1), column[b], 0)
    return out & ((1 << bits) - 1)


def meet(fps: np.ndarray, radius: int, bits: int, part: int, part_bits: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among distinct fingerprints by the variants whose checksum of part_bits bits is part.

    Variants are made ``block`` at a time or so, by ``bits`` bits of checksum. Members of a group of equal variants are
    linked to one of them; as all of them lie within ``radius`` of the variant, that keeps them connected without all
    pairs. Each link is verified by counting differing bits. Returned are fingerprints and their roots within the part, as signed longs.
    """
    flips = masks(radius)
    flip_sum, own = checksum(flips, bits), checksum(fps, bits)
    order = np.argsort(own, kind="stable")
    fps, own = fps[order], own[order]
    ends = np.searchsorted(own, np.arange((1 << bits) + 1))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for q in range(part, 1 << bits, 1 << part_bits):
        need = flip_sum ^ q
        spans = [(m, ends[c], ends[c + 1]) for m, c in zip(flips, need, strict=True) if ends[c] < ends[c + 1]]
        if not spans:
            continue
        variant = np.concatenate([fps[s:e] ^ m for m, s, e in spans])
        ordered = np.sort(variant)
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if not len(twice):
            continue
        met = np.flatnonzero(np.isin(variant, twice))
        who = np.concatenate([np.arange(s, e) for _, s, e in spans])[met]
        variant = variant[met]
        o = np.lexsort((who, variant))
        who, variant = who[o], variant[o]
        first = np.concatenate(([True], variant[1:] != variant[:-1]))
        head = who[np.flatnonzero(first)[np.cumsum(first) - 1]]
        pair = np.unique(np.stack((head, who))[:, ~first], axis=1)
        close = np.bitwise_count(fps[pair[0]] ^ fps[pair[1]]) <= 2 * radius
        found.append((fps[pair[0][close]].view(np.int64), fps[pair[1][close]].view(np.int64)))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return local_roots(np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found]))


def links(distinct: DataFrame, n: int, max_bits: int = 4, per_task: int = 16_000_000, block: int = 1_000_000) -> DataFrame:
    """Links (a, b) between the fingerprints of distinct (fp), n rows: every two fingerprints within max_bits are connected.

    The parts of the checksum space decide a task's load: 64 parts at least, more while the cluster has room for more tasks and
    a part still makes over per_task variants, and so many that a part gets per_task fingerprints at most (8 bytes each).
    Within a task, variants are made in blocks.
    """
    radius = (max_bits + 1) // 2
    flips = masks(radius)
    part_bits, room = 6, 2 * distinct.sparkSession.sparkContext.defaultParallelism
    while 1 << part_bits < room and n * len(flips) >> part_bits > per_task:
        part_bits += 1
    while n * len(np.unique(checksum(flips, part_bits))) / (1 << part_bits) > per_task:
        part_bits += 1
    bits = part_bits
    while n * len(flips) / (1 << bits) > block and bits < part_bits + 12:
        bits += 1
    reach = np.unique(checksum(flips, part_bits))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            fp = x["fp"].to_numpy(np.int64)
            own = checksum(fp.view(np.uint64), part_bits)
            order = np.argsort(own, kind="stable")
            fp, own = fp[order], own[order]
            cls, start = np.unique(own, return_index=True)
            to: dict[int, list[bytes]] = {}
            for c, some in zip(cls.tolist(), np.split(fp, start[1:]), strict=True):
                raw = some.tobytes()
                for p in (reach ^ c).tolist():
                    to.setdefault(p, []).append(raw)
            yield pd.DataFrame({"part": list(to), "fps": [b"".join(v) for v in to.values()]})

    def join(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        fps = np.frombuffer(b"".join(x["fps"]), np.uint64)
        a, b = meet(fps, radius, bits, int(key[0]), part_bits, block)
        return pd.DataFrame({"a": a, "b": b})

    return distinct.select("fp").mapInPandas(deal, "part int, fps binary").groupBy("part").applyInPandas(join, "a long, b long")


def _classes(docs: DataFrame, id_col: str, text_col: str, words: int, max_bits: int, similarity: float | None, digests: bool) -> tuple[DataFrame, DataFrame]:
    """Rows (id, fp, n, perhaps digest) and, per fingerprint, the component's smallest id and its best row (both materialised).

    The best row is that of the smallest id, then of the smallest digest; rows with a null id come last.
    """
    made = fingerprints(docs, id_col, text_col, words, similarity is not None, digests)
    rows = materialize(made.withColumn("n", F.monotonically_increasing_id()), "fingerprints")
    place = F.struct(F.col("id").isNull().alias("z"), "id", *["digest"] * digests)
    nodes = materialize(rows.groupBy("fp").agg(F.min("id").alias("low"), F.min(place).alias("best")), "nodes")
    pairs = links(nodes, nodes.count(), max_bits)
    if similarity is not None:
        pairs = pairs.unionByName(similar_links(docs, rows, id_col, text_col, similarity=similarity))
    roots = components(pairs)
    members = materialize(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()).join(nodes, F.col("node") == F.col("fp")).select("fp", "root", "low", "best"), "members")
    whole = members.groupBy("root").agg(F.min("low").alias("component_id"), F.min("best").alias("chosen"))
    of = table_lookup(members.select("fp", "root"), whole, ["root"], spread="fp").select("fp", "component_id", "chosen")
    every = nodes.join(of, "fp", "left").select("fp", F.coalesce("component_id", "low").alias("component_id"), F.coalesce("chosen", "best").alias("chosen"))
    return rows, materialize(every, "components")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, max_bits: int = 4, similarity: float | None = None) -> DataFrame:
    """Per document: id, fp (signed long), component_id (the smallest id reachable over links, itself included).

    Two documents are linked if their fingerprints differ in at most max_bits bits, and with ``similarity`` also if their
    sets of five-word shingles have at least that Jaccard similarity (verified on whole texts). Fingerprints are the nodes, so a
    group of copies costs one. Texts without words have fingerprint 0 and link like any other. Null text counts as empty. Rows
    with a null id link others like any row, but never name a component: that of null ids only has none. Rows with a
    repeated id are judged by their own texts. Ids must fit a long; other columns are ignored.
    """
    rows, table = _classes(docs, id_col, text_col, words, max_bits, similarity, False)
    out = table_lookup(rows.select("id", "fp", "n"), table.select("fp", "component_id"), ["fp"], spread="n")
    return out.select(F.col("id").alias(id_col), "fp", "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, max_bits: int = 4, similarity: float | None = None) -> DataFrame:
    """docs with exactly one row of each component (see near_duplicates), one of its smallest id; all columns stay.

    Rows are judged by id and text together, so rows that share an id but not a component are judged apart. Null ids are
    larger than all others. Of rows with the smallest id that of the smallest digest stays, and one of rows equal in both.
    """
    rows, table = _classes(docs, id_col, text_col, words, max_bits, similarity, True)
    found = table_lookup(rows.select("id", "fp", "digest", "n"), table.select("fp", "chosen"), ["fp"], spread="n")
    stays = F.struct(F.col("id").isNull().alias("z"), "id", "digest").eqNullSafe(F.col("chosen"))
    verdicts = found.groupBy("id", "digest").agg(F.bool_and(stays).alias("once"), F.count("*").alias("rows")).where("NOT once OR rows > 1")
    key, digest = free_name(docs, "_id"), free_name(docs, "_digest")
    verdicts = materialize(verdicts.select(F.col("id").alias(key), F.col("digest").alias(digest), "once"), "near-verdicts")
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return settle_rows(docs, {key: F.col(id_col).cast("long"), digest: F.unhex(F.sha2(text, 256))}, verdicts)
