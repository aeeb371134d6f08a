"""Shared pieces of the corpus operators: shared-folder tables, ASCII lower-casing, skew-proof group lookups."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a side may have to be broadcast; above it the same join is shuffled.
BROADCAST_ROWS = 200_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: bytes.translate table: A-Z to a-z, every ASCII byte that is neither digit nor letter to a space.
WORD_BYTES = bytes((b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32) for b in range(256))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary one in local mode and an error on a cluster."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="plumbline-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the application's own folder, which may be removed when the application has ended."""
    return f"{shared_dir(spark)}/plumbline-{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: lineage ends there, and a lost executor costs a re-read only."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_parts(batches: Iterator[pd.DataFrame], text: str = "t", chars: int = 1 << 22) -> Iterator[pd.DataFrame]:
    """All rows of the batches in turn, in parts of about ``chars`` characters of text (a longer text is a part of its own), so that what a
    task derives from texts is held for a part and not for Arrow's whole batch."""
    pa.default_memory_pool().release_unused()  # what earlier tasks of a reused worker have left
    for x in batches:
        first, held = 0, 0
        for n, t in enumerate(x[text]):
            held += len(t or "")
            if held >= chars:
                yield x.iloc[first : n + 1].reset_index(drop=True)
                first, held = n + 1, 0
        if first < len(x):
            yield x.iloc[first:].reset_index(drop=True)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; null becomes empty. Pure ASCII text takes the fast built-in lower()."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores in front, so that it clashes with no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def _salt(rows: DataFrame, spread: str, salts: int) -> DataFrame:
    return rows.withColumn("_salt", F.pmod(F.xxhash64(F.col(spread)), F.lit(salts)).cast("int"))


def _to_rows(salted: DataFrame, part: DataFrame, whole: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Brings whole (a row a key) to the rows by way of part (at most one row a key and salt), so that no key meets all its rows at once."""
    new = [c for c in whole.columns if c not in keys]
    p, w = part.select(*keys, "_salt").alias("p"), whole.alias("w")
    back = p.join(w, [F.col(f"p.{k}").eqNullSafe(F.col(f"w.{k}")) for k in keys], how).select(*[F.col(f"p.{k}") for k in [*keys, "_salt"]], *[F.col(f"w.{n}") for n in new])
    r, b = salted.alias("r"), back.alias("b")
    on = [F.col(f"r.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys] + [F.col("r._salt") == F.col("b._salt")]
    return r.join(b, on).select(*[F.col(f"r.{c}") for c in salted.columns if c != "_salt"], *[F.col(f"b.{n}") for n in new])


def group_lookup(rows: DataFrame, keys: list[str], aggs: list[tuple[str, str, str]], spread: str, salts: int = 64) -> DataFrame:
    """rows plus aggregates of their group, with no task that holds a whole group.

    aggs: (new column, "sum" | "max" | "min" | "count", column). Rows are dealt by (keys, salt), the salt taken
    from a hash of ``spread``; groups are summed up per (keys, salt), then per key, and the sums go back to at most
    ``salts`` rows a key before they meet the rows. Null keys form a group. Give it materialised rows: it reads them twice.
    """
    f = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count}
    salted = _salt(rows, spread, salts)
    part = salted.groupBy(*keys, "_salt").agg(*[f[how](c).alias(f"_p{i}") for i, (_, how, c) in enumerate(aggs)])
    whole = part.groupBy(*keys).agg(*[f["sum" if how == "count" else how](f"_p{i}").alias(name) for i, (name, how, _) in enumerate(aggs)])
    return _to_rows(salted, part, whole, keys, "inner")


def table_lookup(rows: DataFrame, table: DataFrame, keys: list[str], spread: str, salts: int = 64) -> DataFrame:
    """rows plus the other columns of table (one row a key; null where there is none), dealt as in group_lookup."""
    salted = _salt(rows, spread, salts)
    return _to_rows(salted, salted.select(*keys, "_salt").distinct(), table, keys, "left")


#: Bits of a slot bitmap come in rows of 32,768 (4 KB): Spark's bitmap functions work on such buckets.
BUCKET_BITS = 32_768

#: Bits of the largest bitmap that is broadcast (64 MB).
MOST_BITS = 1 << 29


def slot_count(rows: int, per_row: int = 8) -> int:
    """Slots of a bitmap for so many rows: a power of two with per_row slots a row or more, as far as MOST_BITS goes."""
    return min(MOST_BITS, max(1 << 20, 1 << max(0, rows * per_row - 1).bit_length()))


def slots(keys: DataFrame, bits: int, least: int = 1) -> DataFrame:
    """Bitmap (bucket, bits) of the hash slots that ``least`` rows or more of keys(h) fall into; at most bits / 8 bytes whatever the input."""
    used = keys.groupBy(F.pmod(F.col("h"), F.lit(bits)).alias("s")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    # dealt by bucket before they are set, so that each bucket's bits are made once and not once a partition
    bucketed = used.select(F.expr("s div 32768").alias("bucket"), F.expr("s % 32768").alias("bit")).repartition("bucket")
    return bucketed.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))


def shared_slots(keys: DataFrame, bits: int) -> DataFrame:
    return slots(keys, bits, 2)


def _bit(bits: Column, slot: Column) -> Column:
    """Whether the slot's bit is set; false where the bucket has no bitmap."""
    at = slot % BUCKET_BITS
    byte = F.conv(F.hex(F.substring(bits, (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))


def named(cols) -> list[Column]:
    """Columns by name, whatever the names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in cols]


def flag_slots(rows: DataFrame, bitmap: DataFrame, h: Column, name: str, bits: int) -> DataFrame:
    """rows plus whether the slot of their hash h is set; the bitmap is broadcast (bits / 8 bytes at most)."""
    slot, bucket, word = (free_name(rows, n) for n in ("_slot", "_bucket", "_word"))
    side = F.broadcast(bitmap.select(F.col("bucket").alias(bucket), F.col("bits").alias(word)))
    wide = rows.withColumn(slot, F.pmod(h, F.lit(bits))).join(side, F.expr(f"{slot} div 32768") == F.col(bucket), "left")
    return wide.select(*named(rows.columns), _bit(F.col(word), F.col(slot)).alias(name))


def may_hold(docs: DataFrame, key: Column, ids: DataFrame) -> DataFrame:
    """The rows of docs whose key is in ids (one column, materialised), and a few others, in place: by broadcast of the ids if they are few, else of a bitmap."""
    n, mark, only = ids.count(), free_name(docs, "_mark"), F.col(ids.columns[0])
    if n <= BROADCAST_ROWS:
        side = ids.where(only.isNotNull()).select(only.alias(mark)).distinct()
        return docs.join(F.broadcast(side), key == F.col(mark), "left_semi")
    bits = slot_count(n)
    bitmap = materialize(slots(ids.select(F.xxhash64(only).alias("h")), bits), "id-slots")
    return flag_slots(docs, bitmap, F.xxhash64(key), mark, bits).where(F.col(mark)).select(*named(docs.columns))


def attach(docs: DataFrame, on: dict[str, Column], table: DataFrame, salts: int = 16) -> DataFrame:
    """docs plus the columns of table (materialised; one row a key): its keys as worked out for the row, its others null where there is no such key.

    on: the keys of table and what they are in docs; null keys are equal. No column of table may be named as one of docs (see
    free_name). A table of at most BROADCAST_ROWS rows is broadcast and docs stay in place. Else a bitmap of its keys is
    broadcast (8 slots a key, 64 MB at most): rows outside stay in place, and only rows whose slot is set go through a
    shuffle, dealt by key and a salt from their partition's number, so that a key of very many rows is spread.
    """
    keys, new = list(on), [c for c in table.columns if c not in on]
    keyed, n = docs.withColumns(on), table.count()

    def join(rows: DataFrame, side: DataFrame, by: list[str]) -> DataFrame:
        r, t = rows.alias("r"), side.alias("t")
        cols = [F.col("r.`" + c.replace("`", "``") + "`") for c in [*docs.columns, *keys]]
        return r.join(t, [F.col(f"r.{k}").eqNullSafe(F.col(f"t.{k}")) for k in by], "left").select(*cols, *[F.col(f"t.{c}") for c in new])

    if n <= BROADCAST_ROWS:
        return join(keyed, F.broadcast(table), keys)
    bits, mark, salt = slot_count(n), free_name(keyed, "_mark"), free_name(keyed, "_salt")
    h = F.xxhash64(*keys)
    bitmap = materialize(slots(table.select(h.alias("h")), bits), "key-slots")
    flagged = flag_slots(keyed, bitmap, h, mark, bits)
    kinds = dict(table.dtypes)
    near = flagged.where(~F.col(mark)).select(*named([*docs.columns, *keys]), *[F.lit(None).cast(kinds[c]).alias(c) for c in new])
    far = flagged.where(mark).withColumn(salt, F.pmod(F.spark_partition_id(), F.lit(salts)))
    wide = table.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return near.unionAll(join(far, wide.hint("shuffle_hash"), [*keys, salt]))


def settle_rows(docs: DataFrame, on: dict[str, Column], verdicts: DataFrame) -> DataFrame:
    """docs after verdicts(keys of on, once boolean; materialised): rows of a key whose once is false go, of a key whose once is true one row stays.

    Rows without a verdict stay where they are. Only rows of which all but one go are grouped, each task by itself first.
    """
    once = free_name(docs, "_once")
    marked = attach(docs, on, verdicts.withColumnRenamed("once", once))
    cols = named(docs.columns)
    kept = marked.where(F.col(once).isNull()).select(*cols)
    if not verdicts.where("once").limit(1).count():
        return kept
    one = marked.where(once).groupBy(*on).agg(F.first(F.struct(*cols)).alias("_row"))
    return kept.unionAll(one.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns]))
