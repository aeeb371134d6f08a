"""Scene-level tables: inventory, capabilities, ranking, stratified picking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Scenes to pick by room group, in this order (fixed values).
TARGETS = {"bedroom": 4, "living_room": 5, "office_study": 5, "mixed_other": 6}


def inventory(objects: DataFrame, scenes: DataFrame, min_objects: int = 8, min_categories: int = 3) -> DataFrame:
    """Per scene of scenes(scene_id, scene_type, ...): valid objects and categories, counts by category, and candidate flags."""
    v = F.col("is_valid_object")
    counts = objects.groupBy("scene_id").agg(
        F.count_if(v).alias("n_valid_objects"), F.count_distinct(F.when(v, F.col("label_norm"))).alias("n_valid_categories"), *[F.count_if(v & (F.col("label_norm") == c)).alias(f"n_valid_{c}") for c in T.CATEGORIES]
    )
    out = scenes.join(counts, "scene_id", "left").na.fill(0, [c for c in counts.columns if c != "scene_id"])
    out = out.withColumns({f"has_{k}": _sum(f"n_valid_{c}" for c in g) >= 1 for k, g in (("surface", T.SURFACES), ("furniture", T.FURNITURE), ("reference", T.REFERENCES))})
    out = out.withColumn("has_required_categories", F.col("has_surface") & F.col("has_furniture") & F.col("has_reference"))
    return out.withColumn("is_candidate", (F.col("n_valid_objects") >= min_objects) & (F.col("n_valid_categories") >= min_categories) & F.col("has_required_categories"))


def _sum(names):
    return reduce(lambda a, b: a + b, [F.col(n) for n in names])


def category_counts(objects: DataFrame) -> DataFrame:
    """Valid objects by scene and category, one column a category, 0 where there are none; unlabelled objects don't count."""
    return objects.where("is_valid_object AND label_norm IS NOT NULL").groupBy("scene_id").pivot("label_norm", T.CATEGORIES).count().na.fill(0)


def capabilities(objects: DataFrame, rules: str = "official") -> DataFrame:
    """Which questions a scene supports. Two fixed rule sets: "pilot" and the stricter "official"."""
    out = category_counts(objects).withColumns({"n_surface": _sum(T.SURFACES), "n_furniture": _sum(T.FURNITURE), "n_reference": _sum(T.REFERENCES)})
    s, f, r = F.col("n_surface"), F.col("n_furniture"), F.col("n_reference")
    if rules == "pilot":
        flags = {"distance": s >= 1, "nearest": (s >= 1) & (f >= 2), "between": s >= 2}
    elif rules == "official":
        flags = {"distance": (s >= 1) & (f + r >= 1), "nearest": (s + r >= 1) & (F.greatest(*T.FURNITURE) >= 2), "between": (s >= 2) & (f >= 1)}
    else:
        raise ValueError(f"unknown rules {rules!r}")
    return out.withColumns({f"supports_{k}": v for k, v in flags.items()}).withColumn("supports_aligned", s + f + r >= 3)


def rank_scenes(inventory_: DataFrame) -> DataFrame:
    """Candidate scenes with room group, family and selection score."""
    n = {c: F.col(f"n_valid_{c}") for c in T.CATEGORIES}
    flag = lambda cond: cond.cast("double")
    score = 2.0 * F.col("n_valid_categories") + 0.5 * F.col("n_valid_objects") + 1.5 * flag(n["chair"] >= 2) + 1.5 * flag(n["table"] + n["desk"] >= 2) + 1.0 * flag(n["door"] + n["cabinet"] + n["monitor"] >= 1)
    score = score + 0.5 * flag(n["sofa"] >= 1) + 0.5 * flag(n["bed"] >= 1) + 0.5 * flag(n["monitor"] >= 1)
    return inventory_.where("is_candidate").withColumns({"room_group": T.room_group(F.col("scene_type"), "ranking"), "family_id": T.family(F.col("scene_id")), "selection_score": score})


_BEST = ["selection_score", "n_valid_objects", "n_valid_categories"]


def _best():
    return [F.col(c).desc() for c in _BEST] + [F.col("scene_id")]


def best_per_family(pool: DataFrame) -> DataFrame:
    w = Window.partitionBy("family_id").orderBy(*_best())
    return pool.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def stratified_pick(pool: DataFrame, targets: dict[str, int] | None = None) -> DataFrame:
    """Scenes by group, in the targets' order: the best of each group whose families no earlier group took, one scene a family.

    Groups follow one another because a family may lie in several; each step is an anti-join on the families picked so far.
    """
    picked = None
    for group, n in (targets or TARGETS).items():
        rest = pool.where(F.col("room_group") == group)
        if picked is not None:
            rest = rest.join(picked.select("family_id").distinct(), "family_id", "left_anti").select(pool.columns)
        step = best_per_family(rest).orderBy(*_best()).limit(n)
        picked = step if picked is None else picked.unionByName(step)
    return picked


def backfill(picked: DataFrame, pool: DataFrame, total: int | None = None) -> DataFrame:
    """picked plus the best scenes of unused families until there are ``total`` (default: the sum of the targets)."""
    total = sum(TARGETS.values()) if total is None else total
    rest = pool.join(picked.select("scene_id"), "scene_id", "left_anti").join(picked.select("family_id").distinct(), "family_id", "left_anti").select(pool.columns)
    have = picked.agg(F.count("*").alias("have"))
    # a limit that depends on data: rank the remainder (at most ``total`` rows can be wanted) and compare with the count
    ranked = rest.orderBy(*_best()).limit(total).withColumn("_rn", F.row_number().over(Window.orderBy(*_best())))
    add = ranked.join(F.broadcast(have), F.col("_rn") <= total - F.col("have")).select(pool.columns)
    return picked.select(pool.columns).unionByName(add)
