"""Table plumbing around the benchmark: schema conformance, row ids, review, de-duplication, unions, splits, resume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip
from ..shared import free_name
from .ordering import numbered


def conform(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """df with missing columns added at their defaults; columns that are there stay as they are."""
    return df.withColumns({k: v for k, v in defaults.items() if k not in df.columns})


def to_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the schema's columns, in order: missing ones null, present ones cast (null where the value doesn't fit)."""
    return df.select(*[(F.col(f.name).try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])


def present(df: DataFrame, preferred: list[str]) -> DataFrame:
    """The preferred columns that df has, in that order."""
    return df.select(*[c for c in preferred if c in df.columns])


def review_kept(keep: Column) -> Column:
    return F.lower(strip(F.coalesce(keep, F.lit("")))) == "yes"


def repair_review(df: DataFrame, forced_no: DataFrame | None = None) -> DataFrame:
    """Cleans review_keep: an answer in the notes moves over if keep is empty, a known misspelling is put right, listed questions become "no".

    forced_no(structured_query): few rows; broadcast by the optimizer if its size allows.
    """
    df = conform(df, {c: F.lit("") for c in ("review_keep", "review_notes")})
    clean = lambda c: F.lower(strip(F.coalesce(F.col(c).cast("string"), F.lit(""))))
    df = df.withColumns({"review_keep": clean("review_keep"), "review_notes": clean("review_notes")})
    moved = F.when((F.col("review_keep") == "") & F.col("review_notes").isin("yes", "no", "yse"), F.col("review_notes")).otherwise(F.col("review_keep"))
    df = df.withColumn("review_keep", moved).replace({"yse": "yes"}, subset=["review_keep"])
    if forced_no is not None:
        listed = forced_no.select("structured_query").distinct().withColumn("_no", F.lit(True))
        df = df.join(listed, "structured_query", "left").withColumn("review_keep", F.when(F.col("_no"), "no").otherwise(F.col("review_keep"))).drop("_no")
    return df


def with_row_id(df: DataFrame, prefix: str, order: list[str], scope: str = "scene_id", name: str = "query_id") -> DataFrame:
    """Ids prefix0000, prefix0001, ... in a total order that begins with ``scope``; null scopes come last and keep their rows.

    Numbers come from a distributed sort (see ordering.numbered): no task has all rows of a scope, and any number of rows has ids.
    """
    number = free_name(df, "_number")
    return numbered(df, [scope, *order], number).withColumn(name, F.format_string(f"{prefix}%04d", number)).drop(number)


def first_by(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def last_by(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key: of duplicates the later one holds."""
    return first_by(df, keys, [F.col(order).desc()])


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def _or_stop(test: Column, message: Column) -> Column:
    """A filter that every row passes, or the query stops with the message."""
    return F.when(test, F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))


def _shown(text: str, keys: list[str]) -> Column:
    return F.concat(F.lit(text + " "), F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}))


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """df itself; the query that reads it stops if a key stands twice. Part of the plan: no job of its own, and rows are numbered as they come, not gathered."""
    again = free_name(df, "_again")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0)))
    return df.withColumn(again, place).where(_or_stop(F.col(again) == 1, _shown("duplicate key", keys))).drop(again)


def lookup(df: DataFrame, table: DataFrame, on: list[str], strict: bool = True) -> DataFrame:
    """Inner join; strict: the query that reads it stops at a row of df whose key is missing in table (a null key is missing everywhere). Part of the plan: no job of its own."""
    if not strict:
        return df.join(table, on)
    hit = free_name(table, free_name(df, "_hit"))
    return df.join(table.withColumn(hit, F.lit(True)), on, "left").where(_or_stop(F.col(hit).isNotNull(), _shown("missing key", on))).drop(hit)


def join_near(left: DataFrame, right: DataFrame, exact: list[str], near: list[str], tolerance: float = 1e-9, how: str = "left") -> DataFrame:
    """left with the further columns of right, joined on equal keys ``exact`` and number keys ``near`` that differ by at most ``tolerance``.

    Each number falls into a cell of the tolerance's width, and a row of right is sent to its own cell and the two beside it (per number
    key), so rows meet by equal cells and are then verified. NaN and null count as one missing value that equals itself alone, -0 equals 0, and
    infinities equal themselves. All matches are returned; a row of left without any stays in a left join. right's own key columns are left out.
    """
    if how not in ("left", "inner"):
        raise ValueError(f"unknown kind of join {how!r}")
    number = lambda t, c: F.col(f"{t}.{c}").cast("double")
    missing = lambda x: x.isNull() | F.isnan(x)
    rest = [c for c in right.columns if c not in [*exact, *near]]

    def celled(df: DataFrame, t: str, reach: int) -> DataFrame:
        out = df.alias(t)
        for i, c in enumerate(near):
            x = number(t, c)
            # beyond 2^53 cells numbers are further apart than a cell, so rounded ones are told apart by themselves
            at = x / tolerance if tolerance > 0 else x
            cell = F.when(missing(x), F.lit("missing")).when((F.abs(at) > 9e15) | F.lit(tolerance <= 0), (x + 0.0).cast("string"))
            around = F.array(*[(F.floor(at) + d).cast("string") for d in range(-reach, reach + 1)])
            out = out.withColumn(f"_cell{i}", F.explode(F.when(cell.isNotNull(), F.array(cell)).otherwise(around)))
        return out

    a, b = celled(left, "l", 0).alias("l"), celled(right, "r", 1).alias("r")
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in exact] + [F.col(f"l._cell{i}") == F.col(f"r._cell{i}") for i in range(len(near))]
    for c in near:
        x, y = number("l", c), number("r", c)
        on.append((missing(x) & missing(y)) | (x == y) | F.coalesce(F.abs(x - y) <= tolerance, F.lit(False)))
    return a.join(b, on, how).select(*[F.col(f"l.{c}") for c in left.columns], *[F.col(f"r.{c}") for c in rest])


def split(df: DataFrame, test: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that pass the test, and all others (null included)."""
    yes = F.coalesce(test, F.lit(False))
    return df.where(yes), df.where(~yes)


def pending(requests: DataFrame, done: DataFrame, key: str = "query_id") -> DataFrame:
    """Requests without a stored response."""
    return requests.join(done.select(key), key, "left_anti")


def summary(df: DataFrame, by: str, column: str, values: list[str]) -> DataFrame:
    """Counts by a pivoted column with a total, largest first."""
    out = df.groupBy(by).pivot(column, values).count().na.fill(0)
    return out.withColumn("total", sum((F.col(v) for v in values[1:]), F.col(values[0]))).orderBy(F.col("total").desc(), by)


#: Keys that ground truth and predictions share.
KEYS = ["query_id", "scene_id", "operator", "structured_query"]

#: Replies that stand for a failed call (fixed values).
ERRORS = ["RENDER_ERROR", "API_ERROR", "ERROR"]


def join_predictions(truth: DataFrame, **methods: DataFrame) -> DataFrame:
    """truth with the column ``pred`` of each method as pred_<method>; rows that every table has. Equal keys throughout, so each table is shuffled once."""
    out = truth
    for name, df in methods.items():
        out = out.join(df.select(*KEYS, F.col("pred").alias(f"pred_{name}")), KEYS)
    return out


def without_errors(df: DataFrame, reply: str) -> DataFrame:
    """Rows whose reply doesn't begin with the name of an error; missing replies stay."""
    failed = F.col(reply).rlike("^(" + "|".join(ERRORS) + ")")
    return df.where(~F.coalesce(failed, F.lit(False)))
