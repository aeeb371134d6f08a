"""Draws the documents that look most like a target: importance weights from hashed n-gram counts, a noise per document, the highest sums. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, free_name, materialize
from .license_scan import words_of


def grams(words: Column, longest: int) -> Column:
    """All runs of 1 to longest consecutive words, each joined by one space, repeats kept."""
    runs = [words]
    for k in range(2, longest + 1):
        left = F.greatest(F.size(words) - (k - 1), F.lit(0))
        runs.append(F.zip_with(F.slice(runs[-1], F.lit(1), left), F.slice(words, F.lit(k), left), lambda a, b: F.concat(a, F.lit(" "), b)))
    return F.concat(*runs)


def bucket_counts(texts: DataFrame, text_col: str, name: str, buckets: int, longest: int) -> DataFrame:
    """bucket, and under ``name`` the features of all texts in it: summed up within each task before the shuffle, at most ``buckets`` rows."""
    feature = texts.select(words_of(F.col(text_col)).alias("w")).select(F.explode(grams(F.col("w"), longest)).alias("f"))
    return feature.groupBy(F.pmod(F.crc32("f"), F.lit(buckets)).cast("int").alias("bucket")).agg(F.count("*").alias(name))


def gains(docs: DataFrame, target: DataFrame, text_col: str = "text", buckets: int = 10_000, longest: int = 2) -> DataFrame:
    """bucket, s, t, gain: a row for every bucket, from the counts s of docs and t of target over all their texts.

    gain is floor(1000 ln(((t + 1) / (T + buckets)) / ((s + 1) / (S + buckets)))) with the totals S and T.
    """
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    ours, theirs = bucket_counts(docs, text_col, "s", buckets, longest), bucket_counts(target, text_col, "t", buckets, longest)
    table = materialize(every.join(ours, "bucket", "left").join(theirs, "bucket", "left").na.fill(0, ["s", "t"]), "buckets")
    all_s, all_t = table.agg(F.sum("s"), F.sum("t")).first()
    ratio = (F.col("t") + 1.0) * F.lit(float(all_s + buckets)) / ((F.col("s") + 1.0) * F.lit(float(all_t + buckets)))
    return table.withColumn("gain", F.floor(1000 * F.log(ratio)))


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths: floor(-1000 ln(-ln u)), u from the first 32 bits of sha256 of seed and id. A null id counts as an empty string."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(u)))


def weights(docs: DataFrame, table: DataFrame, id_col: str = "doc_id", text_col: str = "text", longest: int = 2) -> DataFrame:
    """id, row (a number of its own), n_features, weight (mean gain of the features, rounded down; 0 without any), one row a row of docs.

    The gain table is broadcast if it has at most BROADCAST_ROWS rows. A document's features are summed up in the task that
    explodes them, so the shuffle carries one row a document, however long the text or common the word.
    """
    buckets = table.count()
    side = table.select(F.col("bucket").alias("_b"), "gain")
    side = F.broadcast(side) if buckets <= BROADCAST_ROWS else side
    source = docs.select(F.col(id_col).alias("_id"), F.monotonically_increasing_id().alias("_row"), words_of(F.col(text_col)).alias("_w"))
    feature = source.select("_id", "_row", F.explode_outer(grams(F.col("_w"), longest)).alias("_f"))
    met = feature.join(side, F.pmod(F.crc32("_f"), F.lit(buckets)).cast("int") == F.col("_b"), "left")
    per = met.groupBy("_row", "_id").agg(F.count("_f").alias("n_features"), F.sum("gain").alias("_g"))
    mean = F.when(F.col("n_features") > 0, F.expr("(_g - pmod(_g, n_features)) div n_features")).otherwise(F.lit(0)).cast("long")
    return per.select(F.col("_id").alias(id_col), F.col("_row").alias("row"), "n_features", mean.alias("weight"))


def ranked(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows plus their place (1, 2, 3, ...) in a total order, by a distributed sort: rows are sorted into ranges and written with their place in the
    range; the counts of the ranges (one number a range) are summed up and added. Rows of equal order keys share a range, so end ``order`` with a key of few equals."""
    part, at = free_name(rows, "_part"), free_name(rows, "_at")
    # the lower 33 bits of monotonically_increasing_id count the rows of a task
    placed = rows.orderBy(*order).withColumns({part: F.spark_partition_id(), at: F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    placed = materialize(placed, "sorted")
    sizes = placed.groupBy(part).agg(F.count("*").alias("_n"))
    starts = sizes.select(F.col(part).alias("_p"), (F.sum("_n").over(Window.orderBy(part)) - F.col("_n")).alias("_start"))  # a row a range
    return placed.join(F.broadcast(starts), F.col(part) == F.col("_p")).select(*[F.col(c) for c in rows.columns], (F.col("_start") + F.col(at) + 1).alias(name))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 25, least_words: int = 20, buckets: int = 10_000, longest: int = 2, seed: int = 7) -> DataFrame:
    """Every document with id, n_features, weight, score and rank: of the N of at least least_words words, floor(percent N / 100) of highest score are drawn.

    Features are runs of 1 to longest words, hashed by crc32 into buckets; score is weight plus noise of seed and id. rank is 1, 2, 3, ...
    in falling score for the drawn documents (ties to smaller ids, null ids last, then fewer features, then smaller weight) and null for the others.
    Null text has no features: weight 0. Every row counts, repeated ones too; two rows of one id have the same noise. An empty target leaves
    the weights to the rarity of the words. No documents, no rows. Other columns are ignored, whatever their names.
    """
    table = materialize(gains(docs, target, text_col, buckets, longest), "gains")
    # a text of w words has w + (w - 1) + ... features: those of least_words words
    least = sum(max(0, least_words - k) for k in range(longest))
    scored = weights(docs, table, id_col, text_col, longest)
    scored = materialize(scored.select(F.col(id_col).alias("_id"), "row", "n_features", "weight", (F.col("weight") + noise(F.col(id_col), seed)).alias("score")), "scored")
    fit = F.col("n_features") >= least
    drawn = scored.where(fit).count() * percent // 100
    place = ranked(scored, [F.desc(fit), F.desc("score"), F.asc_nulls_last("_id"), F.asc("n_features"), F.asc("weight"), F.asc("row")], "place")
    return place.select(F.col("_id").alias(id_col), "n_features", "weight", "score", F.when(F.col("place") <= drawn, F.col("place")).alias("rank"))
