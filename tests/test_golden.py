"""Published tables, small copies of which stand in tests/golden, worked out again by the operators."""

import os

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import bootstrap as B
from plumbline.operators import candidates as C
from plumbline.operators import evaluation as E
from plumbline.operators import scenes as S

AT = os.path.join(os.path.dirname(__file__), "golden")


def table(spark, name, schema=None):
    return spark.read.csv(f"{AT}/{name}.csv", header=True, inferSchema=schema is None, schema=schema, escape='"')


def ordered(spark):
    o = table(spark, "objects", "scene_id string, object_id string, label_norm string, centroid_x double, centroid_y double, centroid_z double")
    w = Window.partitionBy("scene_id").orderBy("label_norm", "object_id")
    return o.withColumns({"is_valid_object": F.lit(True), "ord": F.row_number().over(w)})


def test_capabilities_of_scenes(spark):
    want = table(spark, "capabilities")
    got = S.capabilities(ordered(spark)).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() == 20


def test_scores_and_groups_of_ranked_scenes(spark):
    want = table(spark, "ranked_scenes")
    got = S.rank_scenes(want.drop("room_group", "selection_score").withColumn("is_candidate", F.lit(True)))
    same = got.select("scene_id", F.col("room_group").alias("g"), F.col("selection_score").alias("s")).join(want, "scene_id").where("g = room_group AND abs(s - selection_score) < 1e-9")
    assert same.count() == want.count() == 139


@pytest.mark.parametrize("operator", ["between", "aligned"])
def test_relation_questions(spark, operator):
    want = {(r.scene_id, r.structured_query, r.natural_query) for r in table(spark, "relation_questions").where(F.col("operator") == operator).collect()}
    found = C.between_candidates(ordered(spark), TAUS["between"]) if operator == "between" else C.aligned_candidates(ordered(spark), TAUS["aligned"])
    got = {(r.scene_id, r.structured_query, r.natural_query) for r in found.collect()}
    assert got == want


#: Thresholds in metres of the published question lists (fixed values).
TAUS = {"between": 0.30, "aligned": 0.25}


def test_agreement_of_annotators(spark):
    v = table(spark, "votes")
    votes = E.long_votes(v, "ann_num", ["annotator_1", "annotator_2", "annotator_3"])
    kappa = {(r.rater_a[-1], r.rater_b[-1]): round(r.kappa, 4) for r in E.kappa_pairs(votes, "ann_num").collect()}
    assert kappa == {("1", "2"): 0.8992, ("1", "3"): 0.8492, ("2", "3"): 0.7462}
    right = {r.rater[-1]: round(r.accuracy, 3) for r in E.rater_accuracy(votes, v.select("ann_num", F.col("geometric_label").alias("truth")), "ann_num").collect()}
    assert right == {"1": 0.725, "2": 0.725, "3": 0.75}


def test_surface_against_centroid(spark):
    m = table(spark, "methods")
    d = E.compare(m.where("operator = 'distance'"), "surface_pred_distance_m", "centroid_pred_distance_m", "gt_distance_m").first()
    assert (d.n, round(d.mae_a, 6), round(d.mae_b, 6), round(d.medae_a, 6), round(d.medae_b, 6), round(d.mean_difference, 6)) == (45, 0.0, 0.868579, 0.0, 0.80017, 0.868579)
    nearest = m.where("operator = 'nearest'")
    assert nearest.count() == 48 and E.failures(nearest, "centroid_pred_answer_object", "gt_answer_object").count() == 0 == E.failures(nearest, "surface_pred_answer_object", "gt_answer_object").count()


def test_summaries_of_uncertainty(spark):
    ci = table(spark, "intervals").select(F.col("ci_width_95").alias("ci_width"), F.col("ci_relative_pct").alias("ci_width_pct"))
    s = B.summarise(ci).first()
    assert (s.n, s.mean_width, s.median_width, s.max_width, s.mean_width_pct) == (45, pytest.approx(0.012942073080274745), pytest.approx(0.0106335133314132), pytest.approx(0.0727089643478393), pytest.approx(4.24974036575633))
    w = table(spark, "winners").withColumn("gt_correct_point", F.col("gt_correct_point").cast("boolean"))
    n = B.summarise_nearest(w).first()
    assert (n.n, n.mean_stability, n.median_stability, n.min_stability, n.n_stable, n.n_correct) == (39, 1.0, 1.0, 1.0, 39, 39)


def test_questions_are_read_back(spark):
    q = table(spark, "relation_questions").select("operator", "structured_query", T.parse_structured(F.col("structured_query")).alias("q"))
    assert q.where("q.op = operator AND size(q.args) = 3").count() == q.count() == 88
