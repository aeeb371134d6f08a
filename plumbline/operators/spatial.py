"""Set-oriented spatial operators: distances over lists of pairs, nearest objects, rankings, relations of pairs and triples."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G

CENTROID = ["centroid_x", "centroid_y", "centroid_z"]


def side(objects: DataFrame, prefix: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """Objects as one side of a pair: scene_id, object_<p>, label_<p>, ord_<p>, <p>_x/y/z (centroid), box bounds if asked for."""
    cols = [F.col("scene_id"), F.col("object_id").alias(f"object_{prefix}"), F.col("label_norm").alias(f"label_{prefix}"), F.col("ord").alias(f"ord_{prefix}")]
    cols += [F.col(f"centroid_{k}").alias(f"{prefix}_{k}") for k in "xyz"]
    if "box" in extra:
        cols += [F.col(f"aabb_{m}_{k}").alias(f"{prefix}_{m}_{k}") for m in ("min", "max") for k in "xyz"]
    return objects.select(*cols)


def pairs(objects: DataFrame, condition: Column | None = None, ordered: bool = False, extra: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of objects of a scene, a before b in enumeration order (both ways round if ordered). scene_id is an equi-key, so no nested loop."""
    a, b = side(objects, "a", extra), side(objects, "b", extra)
    on = F.col("ord_a") != F.col("ord_b") if ordered else F.col("ord_a") < F.col("ord_b")
    out = a.join(b, "scene_id").where(on)
    return out if condition is None else out.where(condition)


def triples(objects: DataFrame, most: int = 400) -> DataFrame:
    """Triples of objects of a scene in enumeration order. Cubic in a scene's objects, so a scene with an object numbered over ``most`` stops the query."""
    too_many = F.raise_error(F.format_string(f"scene %s has more than {most} objects: too many for triples", "scene_id")).cast("boolean")
    few = objects.where(F.when(F.col("ord") <= most, F.lit(True)).otherwise(too_many))
    return pairs(few).join(side(few, "c"), "scene_id").where("ord_b < ord_c")


def surface_distance(pairs_: DataFrame, points: DataFrame, strategy: str = "pruned", probes: int = 6, cell: float = 0.5, prune_above: int = 4096) -> DataFrame:
    """pairs_(object_a, object_b, ...) plus surface_distance: the least distance of a point of one object to one of the other.

    points(object_id, x, y, z). An object without points gives no row. Each distinct pair is computed once. Clouds are packed, a row an
    object, and meet the pair list in two joins; point pairs are then made and reduced to one row a pair within each task, so
    none of them is shuffled. Strategies, all exact: "exploded" takes all point pairs; "pruned" does so for pairs of at most ``prune_above``
    point pairs, and of larger clouds first drops the points that are further from the other's box than an upper bound from ``probes``
    points a side; "inplace" prunes alike and works each row's distance out within the row, for lists that hardly repeat a pair: the list is
    worked out once, and a repeated pair is computed again; "arrow" leaves a pair's clouds to numpy; "grid" is for clouds too large for one row: they are packed by cells of
    side ``cell``, and only cells that can hold the closest two meet; "scene" deals pairs and clouds by the scene_id of pairs_: a cloud
    goes once to each task that has pairs of its scene, not once a pair, and numpy finds the distances there.
    """
    keys = ["object_a", "object_b"]
    if strategy not in ("pruned", "inplace", "exploded", "arrow", "grid", "scene"):
        raise ValueError(f"unknown strategy {strategy!r}")
    if strategy == "scene":
        return pairs_.join(_scene_distance(pairs_.select("scene_id", *keys).distinct(), points), ["scene_id", *keys])
    todo = pairs_.select(*keys).distinct()
    if strategy == "grid":
        return pairs_.join(_grid_distance(todo, points, cell), keys)
    p = points.select("object_id", *[F.col(k).cast("double").alias(k) for k in "xyz"])
    bounds = [f(k).alias(f"{n}_{k}") for k in "xyz" for n, f in (("min", F.min), ("max", F.max))] if strategy in ("pruned", "inplace") else []
    packed = p.groupBy("object_id").agg(F.collect_list(F.struct("x", "y", "z")).alias("cloud"), *bounds)
    named = lambda s: packed.select(*[F.col(c).alias("object_" + s if c == "object_id" else f"_{s}_{c}") for c in packed.columns])
    both = (pairs_ if strategy == "inplace" else todo).join(named("a"), "object_a").join(named("b"), "object_b")
    near = [_near_points("a", "b", probes, prune_above).alias("_a_cloud"), _near_points("b", "a", probes, prune_above).alias("_b_cloud")] if bounds else []
    if strategy == "inplace":
        least = F.array_min(F.transform("_a_cloud", lambda u: F.array_min(F.transform("_b_cloud", lambda v: _d2(u, v)))))
        return both.select(*pairs_.columns, *near).select(*pairs_.columns, F.sqrt(least).alias("surface_distance"))
    if strategy == "arrow":
        found = both.mapInPandas(_least_by_numpy, "object_a string, object_b string, surface_distance double")
    else:
        if strategy == "pruned":
            both = both.select(*keys, *near)
        # outer: no cloud is empty, and a plain explode would infer filters that repeat the work for each point
        each = both.select(*keys, F.explode_outer("_a_cloud").alias("u"), "_b_cloud").select(*keys, "u", F.explode_outer("_b_cloud").alias("v"))
        found = each.groupBy(*keys).agg(F.sqrt(F.min(_d2(F.col("u"), F.col("v")))).alias("surface_distance"))
    return pairs_.join(found, keys)


def _d2(u: Column, v: Column) -> Column:
    return G.sq(u["x"] - v["x"]) + G.sq(u["y"] - v["y"]) + G.sq(u["z"] - v["z"])


def _near_points(s: str, other: str, probes: int, prune_above: int) -> Column:
    """Of a cloud only the points within the pair's upper bound of the other's box (the closest two are always among them); small clouds whole."""
    few = lambda s: F.slice(f"_{s}_cloud", 1, probes)
    bound = F.array_min(F.transform(few(s), lambda u: F.array_min(F.transform(few(other), lambda v: _d2(u, v))))) * (1 + 1e-9)
    gap = lambda u, k: F.greatest(F.lit(0.0), F.col(f"_{other}_min_{k}") - u[k], u[k] - F.col(f"_{other}_max_{k}"))
    # the bound is worked out once a row: it is the element of an array that the filter runs in
    near = F.transform(F.array(bound), lambda b: F.filter(f"_{s}_cloud", lambda u: G.sq(gap(u, "x")) + G.sq(gap(u, "y")) + G.sq(gap(u, "z")) <= b))[0]
    return F.when(F.size("_a_cloud") * F.size("_b_cloud") > prune_above, near).otherwise(F.col(f"_{s}_cloud"))


def _grid_distance(todo: DataFrame, points: DataFrame, cell: float) -> DataFrame:
    """Branch and bound over cells: a pair's bound is the least distance of two cells' first points; cells whose boxes are further apart are out."""
    p = points.select("object_id", *[F.col(k).cast("double") for k in "xyz"], F.array(*[F.floor(F.col(k) / cell) for k in "xyz"]).alias("cell"))
    blocks = p.groupBy("object_id", "cell").agg(F.collect_list(F.struct("x", "y", "z")).alias("cloud"), F.min(F.struct("x", "y", "z")).alias("first"), *[f(k).alias(f"{n}_{k}") for k in "xyz" for n, f in (("min", F.min), ("max", F.max))])
    name = lambda s, df: df.select(*[F.col(c).alias(("object_" + s) if c == "object_id" else f"{s}_{c}") for c in df.columns])
    heads, clouds = blocks.drop("cloud"), blocks.select("object_id", "cell", "cloud")
    keys = ["object_a", "object_b"]
    d2 = lambda u, v: G.sq(u["x"] - v["x"]) + G.sq(u["y"] - v["y"]) + G.sq(u["z"] - v["z"])
    cells = todo.join(name("a", heads), "object_a").join(name("b", heads), "object_b").withColumn("_d2", d2(F.col("a_first"), F.col("b_first")))
    bound = cells.groupBy(*keys).agg((F.min("_d2") * (1 + 1e-9)).alias("_bound"))
    near = cells.join(bound, keys).where(G.sq(G.box_gap("a", "b")) * (1 - 1e-9) <= F.col("_bound")).select(*keys, "a_cell", "b_cell")
    both = near.join(name("a", clouds), ["object_a", "a_cell"]).join(name("b", clouds), ["object_b", "b_cell"])
    each = both.select(*keys, F.explode("a_cloud").alias("u"), "b_cloud").select(*keys, "u", F.explode("b_cloud").alias("v"))
    return each.groupBy(*keys).agg(F.sqrt(F.min(d2(F.col("u"), F.col("v")))).alias("surface_distance"))


def _scene_distance(todo: DataFrame, points: DataFrame, share: int = 20_000) -> DataFrame:
    """Distances of todo(scene_id, object_a, object_b): a task has the pairs of a scene, or of a part of it where a scene has over ``share`` pairs, and the clouds they need."""
    parts = todo.groupBy("scene_id").agg(F.ceil(F.count("*") / share).cast("int").alias("_parts"))
    # by object_a, so that a part needs few clouds on that side
    dealt = todo.join(parts, "scene_id").withColumn("_part", F.pmod(F.xxhash64("object_a"), F.col("_parts")).cast("int"))
    needed = dealt.select("scene_id", "_part", F.explode(F.array("object_a", "object_b")).alias("object_id")).distinct()
    cloud = points.select("object_id", F.struct(*[F.col(k).cast("double").alias(k) for k in "xyz"]).alias("p")).groupBy("object_id").agg(F.collect_list("p").alias("cloud"))
    clouds = needed.join(cloud, "object_id").select(F.col("scene_id").alias("_of"), F.col("_part").alias("_of_part"), "object_id", "cloud")

    def run(pairs: pd.DataFrame, clouds: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        from .neighbours import nearest_points, xyz

        of = {o: xyz(c) for o, c in zip(clouds["object_id"], clouds["cloud"], strict=True)}
        rows = []
        for a, some in pairs[pairs["object_a"].isin(of) & pairs["object_b"].isin(of)].groupby("object_a"):
            u, others = of[a], some["object_b"].tolist()
            small = [b for b in others if len(u) * len(of[b]) <= 1 << 14]
            if small:  # all small clouds of a's partners in one go
                v = np.concatenate([of[b] for b in small])
                d = [np.subtract.outer(v[:, k], u[:, k]) for k in range(3)]
                least = (d[0] * d[0] + d[1] * d[1] + d[2] * d[2]).min(axis=1)
                starts = np.cumsum([0, *[len(of[b]) for b in small[:-1]]])
                rows += zip([a] * len(small), small, np.sqrt(np.minimum.reduceat(least, starts)).tolist(), strict=True)
            for b in set(others) - set(small):
                few, many = sorted((u, of[b]), key=len)
                rows.append((a, b, float(nearest_points(few, many)[1].min()) ** 0.5))
        out = pd.DataFrame(rows, columns=["object_a", "object_b", "surface_distance"])
        return out.assign(scene_id=pairs["scene_id"].iloc[0] if len(pairs) else None)[["scene_id", "object_a", "object_b", "surface_distance"]]

    keys = ["scene_id", "_part"]
    shape = f"scene_id {dict(todo.dtypes)['scene_id']}, object_a string, object_b string, surface_distance double"
    return dealt.select(*keys, "object_a", "object_b").groupBy(*keys).cogroup(clouds.groupBy("_of", "_of_part")).applyInPandas(run, shape)


def _least_by_numpy(batches: Iterator[pd.DataFrame], block: int = 2048) -> Iterator[pd.DataFrame]:
    import numpy as np

    for x in batches:
        out = []
        for a, b in zip(x["_a_cloud"], x["_b_cloud"], strict=True):
            u, v = sorted((np.array([(q["x"], q["y"], q["z"]) for q in c]) for c in (a, b)), key=len)
            out.append(min(float(((u[:, None, :] - v[None, i : i + block, :]) ** 2).sum(axis=2).min()) for i in range(0, len(v), block)) ** 0.5)
        yield pd.DataFrame({"object_a": x["object_a"], "object_b": x["object_b"], "surface_distance": out})


def reference_candidates(objects: DataFrame, references: Column, target_labels: list[str], exclude_reference: bool = True, extra: tuple[str, ...] = ()) -> DataFrame:
    """(reference, candidate) pairs of a scene for nearest questions: a is the reference, b a candidate of the target category label_b."""
    a = side(objects.where(references), "a", extra)
    b = side(objects.where(F.col("label_norm").isin(target_labels)), "b", extra)
    out = a.join(b, "scene_id")
    return out.where("object_a <> object_b") if exclude_reference else out


def _face_bound(a: str, b: str) -> Column:
    """An upper bound of the squared distance of two clouds from their tight boxes <a>_min_x, ...: each face of a box holds a point of its cloud, so
    no two clouds are further apart than the two points of two faces can be; the least over all pairs of faces."""
    low, high = (lambda p, k: F.col(f"{p}_min_{k}")), (lambda p, k: F.col(f"{p}_max_{k}"))
    whole = {k: F.greatest(G.sq(high(a, k) - low(b, k)), G.sq(high(b, k) - low(a, k))) for k in "xyz"}
    to = lambda v, p, k: F.greatest(G.sq(v - low(p, k)), G.sq(v - high(p, k)))
    # a face of a at value u of axis k and one of b at value v of axis l: those axes have their own terms, the others the whole one
    bounds = []
    for k in "xyz":
        for u in (low(a, k), high(a, k)):
            for m in "xyz":
                for v in (low(b, m), high(b, m)):
                    own = {k: G.sq(u - v)} if k == m else {k: to(u, b, k), m: to(v, a, m)}
                    x, y, z = (own.get(c, whole[c]) for c in "xyz")
                    bounds.append(x + y + z)
    return F.least(*bounds)


def reachable(candidates: DataFrame, keys: tuple[str, ...] = ("scene_id", "object_a", "label_b")) -> DataFrame:
    """The candidates that can be the nearest by surface of their question, and all that could tie with it; their boxes are left out.

    Judged by boxes alone, before a point is read: a candidate goes if its box is further from the reference's than the least upper bound over
    the question's candidates (see _face_bound). candidates(object_a, object_b, ..., a_min_x, ..., b_max_z), boxes tight around the clouds.
    """
    rest = [c for c in candidates.columns if c not in {f"{p}_{m}_{k}" for p in "ab" for m in ("min", "max") for k in "xyz"}]
    judged = candidates.select(*rest, G.sq(G.box_gap("a", "b")).alias("_low"), _face_bound("a", "b").alias("_high"))
    least = F.min("_high").over(Window.partitionBy(*keys))
    return judged.withColumn("_least", least).where(F.col("_low") * (1 - 1e-9) <= F.col("_least") * (1 + 1e-9)).select(*rest)


def nearest(candidates: DataFrame, distance: str, keys: tuple[str, ...] = ("scene_id", "object_a", "label_b")) -> DataFrame:
    """The nearest candidate of each question; of equal distances the first in enumeration order."""
    best = F.min(F.struct(F.col(distance).alias("d"), F.col("ord_b").alias("o"), F.col("object_b").alias("id")))
    return candidates.groupBy(*keys).agg(best.alias("m")).select(*keys, F.col("m.id").alias("answer_object"), F.col("m.d").alias("answer_distance"))


def ranking(candidates: DataFrame, keys: tuple[str, ...] = ("scene_id", "object_a", "label_b")) -> DataFrame:
    """All candidates of a question in order of centroid distance and of surface distance, and whether the winners agree."""
    order = lambda d: F.transform(F.array_sort(F.collect_list(F.struct(F.col(d).alias("d"), F.col("ord_b").alias("o"), F.col("object_b").alias("id")))), lambda s: s["id"])
    out = candidates.groupBy(*keys).agg(order("centroid_distance").alias("by_centroid"), order("surface_distance").alias("by_surface"))
    return out.withColumn("winner_same", F.col("by_centroid")[0].eqNullSafe(F.col("by_surface")[0]))


def margins(candidates: DataFrame, distance: str, least: float = 0.05, keys: tuple[str, ...] = ("scene_id", "object_a", "label_b")) -> DataFrame:
    """Best and second candidate of each question with at least two, where they differ by ``least`` or more."""
    w = Window.partitionBy(*keys).orderBy(distance, "ord_b")
    two = candidates.withColumn("rn", F.row_number().over(w)).where("rn <= 2")
    pick = lambda c, n: F.max(F.when(F.col("rn") == n, F.col(c)))
    out = two.groupBy(*keys).agg(
        F.max("ord_a").alias("ord_a"),
        F.max("label_a").alias("label_a"),
        pick("object_b", 1).alias("answer_object"),
        pick(distance, 1).alias("answer_distance"),
        pick("object_b", 2).alias("second_object"),
        pick(distance, 2).alias("second_distance"),
    )
    return out.where("second_object IS NOT NULL").withColumn("margin", F.col("second_distance") - F.col("answer_distance")).where(F.col("margin") >= least)


def neighbours(objects: DataFrame, k: int = 3) -> DataFrame:
    """The k nearest other objects of each object by centroid distance, in order."""
    w = Window.partitionBy("scene_id", "object_a").orderBy("centroid_distance", "ord_b")
    near = pairs(objects, ordered=True).withColumn("centroid_distance", G.distance_3d("a", "b")).withColumn("rank", F.row_number().over(w))
    return near.where(F.col("rank") <= k).select("scene_id", "object_a", "rank", "object_b", "centroid_distance")


def between_triples(objects: DataFrame, x: Column, ends: Column) -> DataFrame:
    """x of one kind with unordered pairs of another kind in its scene."""
    return pairs(objects.where(ends)).join(side(objects.where(x), "x"), "scene_id").where("object_x <> object_a AND object_x <> object_b")


def box_anchor(objects: DataFrame) -> DataFrame:
    """Objects whose anchor is the centre of their box instead of the centroid of their points."""
    return objects.withColumns({f"centroid_{k}": (F.col(f"aabb_min_{k}") + F.col(f"aabb_max_{k}")) / 2 for k in "xyz"})


def above_pairs(objects: DataFrame, tau: float = 0.0) -> DataFrame:
    """Ordered pairs of a scene with the height of a's bottom over b's top and whether a is above b."""
    out = pairs(objects, ordered=True, extra=("box",))
    return out.withColumn("gap_z", F.col("a_min_z") - F.col("b_max_z")).withColumn("is_above", G.above("a_min_z", "b_max_z", tau))


def answer_above(questions: DataFrame, objects: DataFrame, tau: float = 0.0) -> DataFrame:
    """questions(object_a, object_b, ...) plus is_above; null if an object is missing."""
    o = objects.select("object_id", "aabb_min_z", "aabb_max_z")
    a = o.select(F.col("object_id").alias("object_a"), F.col("aabb_min_z").alias("_lo"))
    b = o.select(F.col("object_id").alias("object_b"), F.col("aabb_max_z").alias("_hi"))
    return questions.join(a, "object_a", "left").join(b, "object_b", "left").withColumn("is_above", G.above("_lo", "_hi", tau)).drop("_lo", "_hi")
