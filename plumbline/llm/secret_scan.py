"""Secret scan with an incremental blob ledger: every version's content is addressed by its hash and scanned once per rule version."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, MOST_BITS, flag_slots, materialize, new_path, slot_count, slots, table_lookup

#: The base kinds, their patterns, and the group and least length that a match must have.
BASE_RULES = (
    ("assign", r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
)

#: Further kinds: token formats with a fixed prefix, and private-key headers.
MORE_RULES = (
    ("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 24),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
)

#: Literals of which a text must hold one (in lower case) to have any match of the kind; texts without are not searched.
_HINTS = {"assign": ("passw", "secret", "token", "apikey", "api_key"), "access": ("akia",), "github": ("gh",), "slack": ("xox",), "jwt": ("eyj",), "pem": ("-----begin ",)}

SPANS = "array<struct<start: int, rule: int, end: int, kind: string, base: boolean>>"

LEDGER = f"blob binary, rules string, spans {SPANS}"


class Rules:
    """A rule set. Its version is the hash of its content, so a changed rule makes every blob unseen again."""

    def __init__(self, base=BASE_RULES, more=MORE_RULES):
        self.rules = [(k, p, g, n, True) for k, p, g, n in base] + [(k, p, g, n, False) for k, p, g, n in more]
        self.version = hashlib.sha256(repr(self.rules).encode()).hexdigest()[:16]

    def find(self, text: str) -> list[tuple[int, int, int, str, bool]]:
        """Leftmost non-overlapping matches per kind that are long enough, by start, then rule; offsets in code points."""
        low, out = text.lower(), []
        for i, (kind, pattern, group, least, base) in enumerate(self.rules):
            if any(h in low for h in _HINTS.get(kind, ("",))):
                # a failing run of a one-class pattern holds no passing one, so short runs can be skipped by the search itself
                pattern = f"[0-9a-f]{{{least},}}" if pattern == "[0-9a-f]+" else pattern
                out += [(m.start(), i, m.end(), kind, base) for m in re.finditer(pattern, text) if len(m[group]) >= least]
        return sorted(out)


def open_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger's rows so far; none if nothing is there yet."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(LEDGER).parquet(path) if there else spark.createDataFrame([], LEDGER)


def scan_history(versions: DataFrame, ledger: str | None = None, path_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text", rules: Rules | None = None, broadcast_rows: int = BROADCAST_ROWS, most_bits: int = MOST_BITS) -> DataFrame:
    """One row per version: the path columns, blob (SHA-256 of the content, binary), spans (ascending by start, then rule).

    versions: every historical version of every path, one row each. Contents are addressed by hash; of each blob that the
    ledger has not seen under this rule version, one row is scanned and its findings are appended to the ledger
    (Parquet at ``ledger``; a fresh one in the shared folder if None). Findings then go to all paths of a blob. A
    run that dies before its append changes nothing, and one repeated after it scans nothing.

    No content goes through a shuffle: which rows to scan is settled on narrow rows (path hash, blob), and the chosen ones are
    found in place, by broadcast if at most broadcast_rows, else by a bitmap of 16 slots a chosen row (most_bits at most). One in 16 rows that
    aren't chosen is then scanned as well, more where most_bits makes the bitmap fuller, and the findings are thrown away. Whatever the
    number of unseen blobs, the texts are read twice (to be hashed, to be scanned) and the ledger is written once. Equal rows are scanned once a task.

    Null content counts as empty; null path columns and repeated rows keep their rows; other columns are ignored; an
    empty table gives no rows.
    """
    spark, rules = versions.sparkSession, rules or Rules()
    ledger = ledger or new_path(spark, "ledger")
    keys = [f"_k{i}" for i in range(len(path_cols))]
    keyed = versions.select(*[F.col(c).alias(k) for c, k in zip(path_cols, keys, strict=True)], F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    keyed = keyed.withColumns({"_blob": F.unhex(F.sha2(F.col("_t").cast("binary"), 256)), "_row": F.xxhash64(*keys)})
    history = materialize(keyed.select(*keys, "_blob", "_row", F.monotonically_increasing_id().alias("_n")), "history")
    seen = open_ledger(spark, ledger).where(F.col("rules") == rules.version)
    unseen = history.groupBy("_blob").agg(F.min("_row").alias("_row")).join(seen.select(F.col("blob").alias("_blob")), "_blob", "left_anti")
    unseen = materialize(unseen, "unseen")
    n = unseen.count()

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done: set[bytes] = set()
        for b in batches:
            fresh = [(k, t) for k, t in zip(b["_blob"], b["_t"], strict=True) if k not in done]
            fresh = list(dict(fresh).items())  # equal rows of a blob are scanned once a task
            done = done.union(k for k, _ in fresh) if len(done) < 100_000 else {k for k, _ in fresh}
            yield pd.DataFrame({"blob": [k for k, _ in fresh], "spans": [[dict(zip(("start", "rule", "end", "kind", "base"), s, strict=True)) for s in rules.find(t)] for _, t in fresh]})

    if n <= broadcast_rows:
        chosen = keyed.join(F.broadcast(unseen), ["_blob", "_row"], "left_semi")
    else:
        bits, h = min(most_bits, slot_count(n, 16)), F.xxhash64("_blob", "_row")
        bitmap = materialize(slots(unseen.select(h.alias("h")), bits), "unseen-slots")
        chosen = flag_slots(keyed, bitmap, h, "_chosen", bits).where("_chosen")
    found = chosen.select("_blob", "_t").mapInPandas(find, f"blob binary, spans {SPANS}")
    fresh = found.groupBy("blob").agg(F.first("spans").alias("spans")).join(unseen.select(F.col("_blob").alias("blob")), "blob", "left_semi")
    fresh.select("blob", F.lit(rules.version).alias("rules"), "spans").write.mode("append").parquet(ledger)
    known = open_ledger(spark, ledger).where((F.col("rules") == rules.version) & (F.size("spans") > 0)).select(F.col("blob").alias("_blob"), "spans").dropDuplicates(["_blob"])
    out = table_lookup(history, known, ["_blob"], spread="_n")
    return out.select(*[F.col(k).alias(c) for c, k in zip(path_cols, keys, strict=True)], F.col("_blob").alias("blob"), F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))
