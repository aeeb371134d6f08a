"""Exact dedup by progressive refinement: length, then prefix hash, then full hash. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, flag_slots, free_name, group_lookup, materialize, settle_rows, shared_slots, slot_count


def _digest(text: Column) -> Column:
    """SHA-256 of the normalised text, binary; null counts as empty."""
    return F.unhex(F.sha2(ascii_lower(text).cast("binary"), 256))


def _refine(docs: DataFrame, id_col: str, text_col: str, digest_all: bool, prefix_chars: int, bits: int | None) -> DataFrame:
    """(id, survives, digest, n): whether the row's length and prefix are shared; n is a running number. Materialised."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    bits = bits or slot_count(rows.count())
    length = rows.withColumn("len", F.octet_length("t").cast("long"))
    by_length = materialize(shared_slots(length.select(F.xxhash64("len").alias("h")), bits), "dedup-len")
    second = flag_slots(length, by_length, F.xxhash64("len"), "s1", bits)
    prefix = F.xxhash64(F.col("len"), ascii_lower(F.left(F.col("t"), F.lit(prefix_chars))))
    by_prefix = materialize(shared_slots(second.where("s1").select(prefix.alias("h")), bits), "dedup-prefix")
    third = flag_slots(second.withColumn("p", prefix), by_prefix, F.col("p"), "s2", bits)
    survives, full = F.col("s1") & F.col("s2"), _digest(F.col("t"))
    digest = full if digest_all else F.when(survives, full)
    return materialize(third.select("id", survives.alias("survives"), digest.alias("digest"), F.monotonically_increasing_id().alias("n")), "dedup-hash")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = False, prefix_chars: int = 256, bitmap_bits: int | None = None, salts: int = 64) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, digest (binary SHA-256 of the normalised text).

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the row with the
    largest id stays (kept). Three refinements, each a scan that keeps only what the next needs: (1) rows alone in
    their length's slot are unique; (2) of the others, rows alone in their (length, prefix hash) slot are unique;
    (3) only the rest has its full text hashed and grouped. Which slots are shared comes from bitmaps of 8 slots a row or more
    (64 MB at most, broadcast; from 64 M rows on a slot holds more rows), so the text itself is never shuffled; a false survivor only costs
    a hash. digest is null for rows settled early, unless digest_all asks for the hash of every row.

    Null ids: a group of null ids only has a null keep_id and all its rows are kept. Repeated rows (same id and text)
    count in group_size and are kept or dropped alike. Empty input gives an empty result; other columns are ignored.
    """
    hashed = _refine(docs, id_col, text_col, digest_all, prefix_chars, bitmap_bits)
    alone = hashed.where(~F.col("survives")).select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "digest")
    out = alone.unionByName(_groups(hashed, salts).select("id", "keep_id", "group_size", "digest"))
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")


def _groups(hashed: DataFrame, salts: int) -> DataFrame:
    return group_lookup(hashed.where("survives").select("id", "digest", "n"), ["digest"], [("keep_id", "max", "id"), ("group_size", "count", "digest")], spread="n", salts=salts)


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 256, bitmap_bits: int | None = None, salts: int = 64) -> DataFrame:
    """docs with exactly one row of each group of equal texts, one of the largest id; all columns stay.

    Rows are judged by id and text together, so rows that share an id but not a text are judged apart. Of rows equal in id and
    text one stays, whatever their other columns. Null ids are smaller than all others.
    """
    grouped = _groups(_refine(docs, id_col, text_col, False, prefix_chars, bitmap_bits), salts)
    verdicts = grouped.groupBy("id", "digest").agg(F.bool_and(F.col("id").eqNullSafe(F.col("keep_id"))).alias("once"), F.count("*").alias("n")).where("NOT once OR n > 1")
    key, digest = free_name(docs, "_id"), free_name(docs, "_digest")
    verdicts = materialize(verdicts.select(F.col("id").alias(key), F.col("digest").alias(digest), "once"), "dedup-verdicts")
    return settle_rows(docs, {key: F.col(id_col), digest: _digest(F.col(text_col))}, verdicts)


__all__ = ["drop_exact_copies", "exact_dedup"]
