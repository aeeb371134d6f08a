"""Verified near copies: pairs of texts whose sets of word shingles have a Jaccard similarity of at least a threshold.

Candidates come from banded MinHash (BANDS bands of ROWS values): a pair of similarity 0.8 shares no band once in 2e7. Every link
between sets of different names is then verified on the whole sets of both texts. A set's name is the XXH64 of all its shingles' XXH64; sets
of one name count as equal, unverified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, group_lookup, in_parts, materialize, may_hold
from .components import components, local_roots

BANDS, ROWS = 32, 4

_FACTORS = np.random.default_rng(20_082).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text with A-Z lower-cased; a shorter text is one shingle, one without words has none."""
    w = (text or "").encode().lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    k, digest = min(words, len(w)), xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(b" ".join(w[i : i + k]), 42) for i in range(len(w) - k + 1)), np.uint64, len(w) - k + 1))


def set_id(s: np.ndarray) -> int:
    """Signed 64-bit name of a shingle set."""
    return xxhash.xxh64_intdigest(s.tobytes(), 7) - (1 << 63)


def band_keys(s: np.ndarray, block: int = 256) -> list[int]:
    """One signed key a band; none for the empty set."""
    if not len(s):
        return []
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), block):
        low = np.minimum(low, (s[at : at + block, None] * _FACTORS).min(axis=0))
    return [xxhash.xxh64_intdigest(b.tobytes(), n) - (1 << 63) for n, b in enumerate(low.reshape(BANDS, ROWS))]


def whole_sets(batches: Iterator[pd.DataFrame], words: int = 5) -> Iterator[pd.DataFrame]:
    """sh and raw: name and hashes of each text's set, some millions of characters at a time."""
    for x in in_parts(batches):
        made = [shingle_set(t, words) for t in x["t"]]
        yield pd.DataFrame({"sh": [set_id(s) for s in made], "raw": [s.tobytes() for s in made]})


def linked(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (a < b) of all pairs of sets whose Jaccard similarity is at least ``similarity``."""
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    _, which = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(which, kind="stable")
    holders, starts = owner[order], np.searchsorted(which[order], np.arange(which.max(initial=-1) + 2))
    own = np.split(which, np.cumsum(size)[:-1])
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for i, mine in enumerate(own):
        n = starts[mine + 1] - starts[mine]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[mine], n)
        both = np.bincount(holders[at], minlength=len(sets))
        j = np.flatnonzero(both >= similarity * (size[i] + size - both) - 1e-9)
        j = j[j > i]
        found.append((np.full(len(j), i), j))
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def similar_links(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str, words: int = 5, similarity: float = 0.8, block: int = 512, class_sets: int = 2048, class_shingles: int = 1 << 21) -> DataFrame:
    """Links (a, b) that connect the fingerprints of texts that are similar; rows are (fp, row, sh, shingles, keys) of docs, row a hash of id and text.

    Copies count once. Sets that share a bucket, directly or over others, are a class. One of at most class_sets sets and class_shingles
    shingles is compared by one task. A larger class is compared by buckets: those of at most ``block`` sets by one task each, larger
    ones dealt into chunks of about ``block`` by hash, with a task for each pair of chunks; so no task holds more, and no pair that shares a
    bucket is left out. A task links each node to the smallest it is connected with. Of the candidates alone are texts read again, where they are.
    """
    worded = rows.where("size(keys) > 0")
    sets = worded.groupBy("sh").agg(F.min("fp").alias("node"), F.max("fp").alias("high"), F.min("row").alias("row"), F.first("shingles").alias("shingles"), F.first("keys").alias("keys"))
    sets = materialize(sets, "sets")
    several = materialize(sets.where("node < high").select(F.col("sh").alias("_sh"), F.col("node").alias("b")), "set-fingerprints")
    equal = attach(worded.select("sh", F.col("fp").alias("a")), {"_sh": F.col("sh")}, several).where("a <> b").select("a", "b").distinct()

    banded = sets.select("sh", F.explode("keys").alias("key"))
    sizes = materialize(banded.groupBy(F.col("key").alias("_key")).agg(F.count("*").alias("n")).where("n > 1"), "bucket-sizes")
    members = materialize(attach(banded, {"_key": F.col("key")}, sizes).where("n IS NOT NULL").select("key", "sh", "n"), "bucket-members")
    to_low = group_lookup(members, ["key"], [("low", "min", "sh")], spread="sh")
    roots = components(to_low.select(F.col("sh").alias("a"), F.col("low").alias("b")))
    classes = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()).select(F.col("node").alias("sh"), "root")
    classes = materialize(classes.join(sets.select("sh", "shingles"), "sh"), "classes")
    sized = group_lookup(classes, ["root"], [("n", "count", "sh"), ("total", "sum", "shingles")], spread="sh")
    fits = (F.col("n") <= class_sets) & (F.col("total") <= class_shingles)
    whole_class = sized.where(fits).select(F.col("root").alias("task"), "sh")
    apart = members.join(sized.where(~fits).select("sh"), "sh", "left_semi")
    small = apart.where(F.col("n") <= block).groupBy("key").agg(F.sort_array(F.collect_list("sh")).alias("all")).select("all").distinct()
    small = small.select(F.xxhash64("all").alias("task"), F.explode("all").alias("sh"))
    last = f"CAST(ceil(n / {block}) AS INT) - 1"
    chunk = apart.where(F.col("n") > block).withColumn("c", F.expr(f"CAST(pmod(xxhash64(sh), {last} + 1) AS INT)"))
    chunk = chunk.select("key", "sh", "c", F.explode(F.expr(f"sequence(0, {last})")).alias("o"))
    large = chunk.select(F.xxhash64("key", F.least("c", "o"), F.greatest("c", "o")).alias("task"), "sh")
    tasks = materialize(whole_class.unionByName(small).unionByName(large), "bucket-tasks")

    wanted = materialize(classes.select("sh").join(sets.select("sh", "row", "node"), "sh"), "candidates")
    some = may_hold(docs.select(F.col(text_col).alias("t"), F.xxhash64(F.col(id_col).cast("long"), F.col(text_col)).alias("row")), F.col("row"), wanted.select("row"))

    full = some.select("t").mapInPandas(lambda batches: whole_sets(batches, words), "sh long, raw binary").dropDuplicates(["sh"]).join(wanted.select("sh", "node"), "sh")

    def verify(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        a, b = linked([np.frombuffer(r, np.uint64) for r in x["raw"]], similarity)
        node = x["node"].to_numpy(np.int64)
        a, b = local_roots(node[a], node[b])
        return pd.DataFrame({"a": a, "b": b})

    return tasks.join(full, "sh").select("task", "node", "raw").groupBy("task").applyInPandas(verify, "a long, b long").unionByName(equal)
