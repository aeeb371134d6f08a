"""Generation of benchmark questions: useful pairs, diverse top-k, negatives, positive/negative pairing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from . import spatial as S
from .ordering import numbered


def diverse_top_k(rows: DataFrame, scope: list[str], key: list[str | Column], order: list[Column], k: int = 3, fill: bool = True) -> DataFrame:
    """The first row of each key, in order, up to k rows a scope; with fill, the remaining rows follow in order until there are k.

    One pass: rows that come first within their key rank before all others.
    """
    first = Window.partitionBy(*scope, *key).orderBy(*order)
    out = rows.withColumn("_again", (F.row_number().over(first) > 1).cast("int"))
    if not fill:
        out = out.where("_again = 0")
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy(*scope).orderBy("_again", *order)))
    return out.where(F.col("rank") <= k).drop("_again")


def useful_pair(a: str, b: str) -> Column:
    """Furniture with a surface or a reference, or a surface with a reference; never two of one category."""
    furniture, surface, reference = (lambda v, group=g: F.col(v).isin(group) for g in (T.FURNITURE, T.SURFACES, T.REFERENCES))
    one = lambda u, v: (furniture(u) & (surface(v) | reference(v))) | (surface(u) & reference(v))
    return (F.col(a) != F.col(b)) & (one(a, b) | one(b, a))


def distance_candidates(objects: DataFrame, points: DataFrame, min_d: float = 0.10, max_d: float = 5.0, k: int = 3, strategy: str = "pruned", exclude_touching: bool = True) -> DataFrame:
    """Distance questions: useful pairs within [min_d, max_d] by surface distance, diverse by label pair, nearest first.

    Boxes further apart than max_d rule a pair out before its points are read. exclude_touching=False drops the lower limit.
    """
    p = S.pairs(objects, useful_pair("label_a", "label_b"), extra=("box",)).where(G.box_gap("a", "b") <= max_d)
    d = S.surface_distance(p, points, strategy).withColumn("centroid_distance", G.distance_3d("a", "b"))
    d = d.where((F.col("surface_distance") >= (min_d if exclude_touching else 0.0)) & (F.col("surface_distance") <= max_d))
    d = d.withColumns({"surface_distance_m": F.round("surface_distance", 6), "centroid_distance_m": F.round("centroid_distance", 6)})
    pair = [F.least("label_a", "label_b"), F.greatest("label_a", "label_b")]
    top = diverse_top_k(d, ["scene_id"], pair, [F.col("surface_distance_m"), F.col("ord_a"), F.col("ord_b")], k)
    args = F.col("object_a"), F.col("object_b")
    return top.select("scene_id", F.lit("distance").alias("operator"), "object_a", "label_a", "object_b", "label_b", "surface_distance_m", "centroid_distance_m", T.structured("distance", *args).alias("structured_query"), T.natural("distance", *args).alias("natural_query"), F.lit("candidate").alias("status"), "rank")


def nearest_candidates(objects: DataFrame, points: DataFrame, margin: float = 0.05, k: int = 3, targets: tuple[str, ...] = ("chair", "sofa", "bed"), strategy: str = "pruned", exclude_ambiguous: bool = True) -> DataFrame:
    """Nearest questions: surfaces and references against furniture categories with at least two members, clearest margin first."""
    c = S.reference_candidates(objects, F.col("label_norm").isin(T.SURFACES + T.REFERENCES), list(targets))
    m = S.margins(S.surface_distance(c, points, strategy), "surface_distance", margin if exclude_ambiguous else 0.0)
    m = m.withColumns({"target_order": F.array_position(F.array(*map(F.lit, targets)), F.col("label_b")), "margin_m": F.round("margin", 6)})
    top = diverse_top_k(m, ["scene_id"], ["object_a", "label_b"], [F.col("margin_m").desc(), F.col("ord_a"), F.col("target_order")], k, fill=False)
    args = F.col("object_a"), F.col("label_b")
    return top.select(
        "scene_id", F.lit("nearest").alias("operator"), F.col("object_a").alias("reference_object"), F.col("label_a").alias("reference_label"), F.col("label_b").alias("target_category"), "answer_object", F.round("answer_distance", 6).alias("answer_distance_m"),
        F.col("second_object").alias("second_best_object"), F.round("second_distance", 6).alias("second_best_distance_m"), F.col("margin_m").alias("margin_to_second_m"), T.structured("nearest", *args).alias("structured_query"), T.natural("nearest", *args).alias("natural_query"), F.lit("candidate").alias("status"), "rank",
    )


def between_candidates(objects: DataFrame, tau: float, k: int = 3) -> DataFrame:
    """Between questions: furniture between two surfaces, diverse by the object in the middle, in enumeration order."""
    t = S.between_triples(objects, F.col("label_norm").isin(T.FURNITURE), F.col("label_norm").isin(T.SURFACES)).where(G.between_xy("x", "a", "b", tau))
    top = diverse_top_k(t, ["scene_id"], ["object_x"], [F.col("ord_x"), F.col("ord_a"), F.col("ord_b")], k)
    args = F.col("object_x"), F.col("object_a"), F.col("object_b")
    return top.select("scene_id", F.lit("between").alias("operator"), "object_x", "label_x", "object_a", "label_a", "object_b", "label_b", F.lit(tau).alias("tau_between_m"), T.structured("between", *args).alias("structured_query"), T.natural("between", *args).alias("natural_query"), F.lit("candidate").alias("status"), "rank")


def aligned_candidates(objects: DataFrame, tau: float, k: int = 3) -> DataFrame:
    """Aligned questions: triples of known categories, three different ones first, diverse by their labels."""
    t = S.triples(objects.where(F.col("label_norm").isin(T.CATEGORIES))).where(G.aligned_xy("a", "b", "c", tau))
    t = t.withColumn("mixed_bonus", (F.size(F.array_distinct(F.array("label_a", "label_b", "label_c"))) == 3).cast("int"))
    signature = F.array_join(F.array_sort(F.array("label_a", "label_b", "label_c")), "|")
    order = [F.col("mixed_bonus").desc(), F.col("ord_a"), F.col("ord_b"), F.col("ord_c")]
    top = diverse_top_k(t, ["scene_id"], [signature], order, k)
    args = F.col("object_a"), F.col("object_b"), F.col("object_c")
    return top.select("scene_id", F.lit("aligned").alias("operator"), "object_a", "label_a", "object_b", "label_b", "object_c", "label_c", F.lit(tau).alias("tau_align_m"), "mixed_bonus", T.structured("aligned", *args).alias("structured_query"), T.natural("aligned", *args).alias("natural_query"), F.lit("candidate").alias("status"), "rank")


def _bound(questions: DataFrame, objects: DataFrame, names: str) -> DataFrame:
    """Adds the centroids of the named operands of each question; questions with an unknown operand fall out."""
    out = questions
    for n in names:
        out = out.join(objects.select(F.col("object_id").alias(f"object_{n}"), *[F.col(f"centroid_{k}").alias(f"{n}_{k}") for k in "xyz"]), f"object_{n}")
    return out


def between_negatives(positives: DataFrame, objects: DataFrame, default_tau: float = 0.30) -> DataFrame:
    """For each positive the first other furniture object of its scene, in enumeration order, that isn't between its ends.

    tau comes from the column tau_between_m; default_tau holds only if there is no such column: a null tau is met by nothing,
    so every object fails it. Positives without a negative fall out (see ``without_negative``).
    """
    tau = F.col("tau_between_m") if "tau_between_m" in positives.columns else F.lit(default_tau)
    q = _bound(positives.withColumn("_tau", tau.cast("double")), objects, "ab").withColumnRenamed("object_x", "positive_x")
    x = S.side(objects.where(F.col("label_norm").isin(T.FURNITURE)), "x")
    bad = q.drop("label_x").join(x, "scene_id").where("object_x <> positive_x").where(~F.coalesce(G.between_xy("x", "a", "b", F.col("_tau")), F.lit(False)))
    best = bad.groupBy("scene_id", "structured_query", "object_a", "object_b").agg(F.min(F.struct("ord_x", "object_x", "label_x")).alias("m"))
    args = F.col("m.object_x"), F.col("object_a"), F.col("object_b")
    return best.select("scene_id", F.col("structured_query").alias("pairing_group"), F.col("m.object_x").alias("object_x"), F.col("m.label_x").alias("label_x"), "object_a", "object_b", T.structured("between", *args).alias("structured_query"), T.natural("between", *args).alias("natural_query"), F.lit(0).alias("binary_label"))


def aligned_negatives(positives: DataFrame, objects: DataFrame, default_tau: float = 0.25) -> DataFrame:
    """For each positive the first other object of its scene that isn't in line with its first two objects. tau as in ``between_negatives``."""
    tau = F.col("tau_align_m") if "tau_align_m" in positives.columns else F.lit(default_tau)
    q = _bound(positives.withColumn("_tau", tau.cast("double")), objects, "ab").withColumnRenamed("object_c", "positive_c")
    c = S.side(objects.where(F.col("label_norm").isin(T.CATEGORIES)), "c")
    bad = q.drop("label_c").join(c, "scene_id").where("object_c NOT IN (object_a, object_b, positive_c)").where(~F.coalesce(G.aligned_xy("a", "b", "c", F.col("_tau")), F.lit(False)))
    best = bad.groupBy("scene_id", "structured_query", "object_a", "object_b").agg(F.min(F.struct("ord_c", "object_c", "label_c")).alias("m"))
    args = F.col("object_a"), F.col("object_b"), F.col("m.object_c")
    return best.select("scene_id", F.col("structured_query").alias("pairing_group"), "object_a", "object_b", F.col("m.object_c").alias("object_c"), F.col("m.label_c").alias("label_c"), T.structured("aligned", *args).alias("structured_query"), T.natural("aligned", *args).alias("natural_query"), F.lit(0).alias("binary_label"))


def without_negative(positives: DataFrame, negatives: DataFrame) -> DataFrame:
    """Positives for which no negative was found."""
    return positives.join(negatives.select(F.col("pairing_group").alias("structured_query")), "structured_query", "left_anti")


def above_examples(objects: DataFrame, min_gap: float = 0.10, k: int = 5) -> DataFrame:
    """The k clearest pairs of a scene with a's bottom at least min_gap over b's top, each as a positive and, turned round, a negative.

    pairing_group is above_<scene>_<running number over all scenes>.
    """
    w = Window.partitionBy("scene_id").orderBy(F.col("gap_z").desc(), "ord_a", "ord_b")
    top = S.above_pairs(objects).where(F.col("gap_z") >= min_gap).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    top = numbered(top, ["scene_id", "rank"], "_number").withColumn("pairing_group", F.format_string("above_%s_%04d", "scene_id", "_number"))

    def example(label: int, u: str, v: str) -> Column:
        args, sign = (F.col(f"object_{u}"), F.col(f"object_{v}")), 1 if label else -1
        return F.struct(
            F.concat("pairing_group", F.lit("__pos" if label else "__neg")).alias("binary_query_id"), args[0].alias("object_a"), F.col(f"label_{u}").alias("label_a"), args[1].alias("object_b"), F.col(f"label_{v}").alias("label_b"),
            F.round(F.col("gap_z") * sign, 4).alias("gap_z_m"), F.round(F.col(f"{u}_min_z"), 4).alias("aabb_min_z_a"), F.round(F.col(f"{v}_max_z"), 4).alias("aabb_max_z_b"), T.structured("above", *args).alias("structured_query"), T.natural("above", *args).alias("natural_query"), F.lit(label).alias("binary_label"),
        )

    return top.select("scene_id", F.lit("above").alias("operator"), "pairing_group", F.explode(F.array(example(1, "a", "b"), example(0, "b", "a"))).alias("e")).select("scene_id", "operator", "pairing_group", "e.*")
