"""Answers natural-language questions in bulk: parse, bind names to objects, run one operator pass per kind of question, format."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from . import spatial as S

# Fixed answer texts.
OUTSIDE = "Consulta fora do padrão esperado."
UNKNOWN = "Alias não encontrado."
NO_CANDIDATE = "Nenhum candidato válido encontrado."


def answer(questions: DataFrame, objects: DataFrame, points: DataFrame, tau_between: float = 0.30, tau_align: float = 0.25, strategy: str = "inplace") -> DataFrame:
    """questions(scene_id, question_id, text) to (scene_id, question_id, op, answer). objects have aliases (see operators.objects.aliases).

    Questions outside the grammar and unknown names get a sentence instead of an error. Any number of questions over any number of scenes
    is one job: a scene's objects travel as one row (tens of objects) and all names of a question are looked up in it; the pairs of
    distance questions and the candidates of nearest questions then go through one distance pass. Question ids are unique within a scene.
    """
    held = F.struct(F.col("object_id").alias("id"), F.col("label_norm").alias("label"), "ord", "alias", *[F.col(f"centroid_{k}").cast("double").alias(k) for k in "xyz"])
    scenes = objects.groupBy("scene_id").agg(F.collect_list(held).alias("all"))
    q = questions.withColumn("q", T.parse_query(F.col("text"))).select("scene_id", "question_id", "q.*").join(scenes, "scene_id", "left")
    slots = {"distance": "ab", "nearest": "a", "between": "xab", "aligned": "abc"}
    called = lambda s: F.get(F.filter("all", lambda o: o["alias"] == F.col(s)), 0)
    q = q.withColumns({f"_{s}": called(s) for s in "xabc"})
    missing = F.lit(False)
    for op, used in slots.items():
        for s in used:
            missing = missing | ((F.col("op") == op) & F.col(f"_{s}").isNull())
    q = q.withColumn("missing", missing)

    near = F.filter("all", lambda o: (o["label"] == F.col("category")) & (o["id"] != F.col("_a.id")))
    to = F.when(F.col("op") == "distance", F.array("_b")).when(F.col("op") == "nearest", near)
    pairs = q.where("op IN ('distance', 'nearest') AND NOT missing").select("scene_id", "question_id", F.col("_a.id").alias("object_a"), F.explode(to).alias("o"))
    pairs = pairs.select("scene_id", "question_id", "object_a", F.col("o.id").alias("object_b"), F.col("o.ord").alias("ord"), F.col("o.alias").alias("best"))
    least = F.min(F.struct(F.col("surface_distance").alias("d"), "ord", "best")).alias("m")
    found = S.surface_distance(pairs, points, strategy).groupBy("scene_id", "question_id").agg(least)

    flat = [F.col(f"_{s}.{k}").alias(f"{s}_{k}") for s in "xabc" for k in "xyz"]
    out = q.select("scene_id", "question_id", "op", "missing", *flat).join(found, ["scene_id", "question_id"], "left")
    text = (
        F.when(F.col("op").isNull(), OUTSIDE)
        .when(F.col("missing"), UNKNOWN)
        .when(F.col("op") == "distance", F.format_string("%.4f m", "m.d"))
        .when((F.col("op") == "nearest") & F.col("m").isNull(), NO_CANDIDATE)
        .when(F.col("op") == "nearest", F.format_string("%s, %.4f m", "m.best", "m.d"))
        .when(F.col("op") == "between", F.when(G.between_xy("x", "a", "b", tau_between), "sim").otherwise("não"))
        .when(F.col("op") == "aligned", F.when(G.aligned_xy("a", "b", "c", tau_align), "sim").otherwise("não"))
    )
    return out.select("scene_id", "question_id", F.coalesce("op", F.lit("none")).alias("op"), text.alias("answer"))
