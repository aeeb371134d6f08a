"""Queries of the table pipeline: labels, inventory, capabilities, ranking and picking, review, ids, summaries, text parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import objects as O
from ..operators import relational as R
from ..operators.ordering import with_file_row
from ..operators import scenes as S
from .adapters import RAW, objects, objects_sql, read, valid_objects

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


_LABELS = [*[r for r in RAW if r], "Armchair", "big coffee table", "TV stand", "desk chair pad", "standing desk", "wardrobe", "sofa bed", "  Loveseat\t"]
_ORDERED = [(k, v) for v, ks in T.LABEL_MAP.items() for k in ks]


@query(
    "label_normalize",
    f"""WITH raw(i, raw) AS (VALUES {', '.join(f"({i}, E'{r}')".replace(chr(9), chr(92) + 't') for i, r in enumerate(_LABELS))}),
    m(o, k, c) AS (VALUES {', '.join(f"({i}, '{k}', '{v}')" for i, (k, v) in enumerate(_ORDERED))}),
    s AS (SELECT e.event_id, raw.raw, lower(trim(raw.raw, E' \\t\\n')) AS r FROM events e JOIN raw ON raw.i = e.event_id % {len(_LABELS)})
    SELECT s.event_id, coalesce((SELECT c FROM m WHERE k = s.r), (SELECT arg_min(c, o) FROM m WHERE contains(s.r, k))) AS label_norm, contains(s.r, ' ') AS two_words FROM s""",
)
def label_normalize(spark, sf_dir):
    raw = F.get(F.array(*map(F.lit, _LABELS)), (F.col("event_id") % len(_LABELS)).cast("int"))
    return read(spark, sf_dir, "events").select("event_id", T.normalize_label(raw).alias("label_norm"), F.contains(T.strip(raw), F.lit(" ")).alias("two_words"))


_TYPES = ["Bedroom / Hotel", "Living room / Lounge", "Office", "Conference Room", "Classroom", "Kitchen", "Guest Room", None]
_TYPE_SQL = "CASE s_suppkey % 8 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_TYPES) if t) + " END"


def _group_sql(col: str, rules: dict[str, list[str]]) -> str:
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(coalesce({col}, '')), '{w}')" for w in ws) + f" THEN '{g}'" for g, ws in rules.items()) + " ELSE 'mixed_other' END"


_INV = {"bedroom": ["bedroom", "guest room", "hotel room"], "living_room": ["living room", "lounge", "family room"], "office_study": ["office", "study", "conference room", "meeting room", "computer lab"]}
_RANK = {"bedroom": ["bedroom", "hotel"], "living_room": ["living room", "lounge", "family room"], "office_study": ["office", "study", "conference", "meeting room", "computer lab", "classroom"]}


@query("room_groups", f"WITH s AS (SELECT s_suppkey, {_TYPE_SQL} AS scene_type FROM supplier) SELECT s_suppkey, {_group_sql('scene_type', _INV)} AS inventory_group, {_group_sql('scene_type', _RANK)} AS ranking_group FROM s")
def room_groups(spark, sf_dir):
    t = F.get(F.array(*map(F.lit, _TYPES)), (F.col("s_suppkey") % 8).cast("int"))
    return read(spark, sf_dir, "supplier").select("s_suppkey", T.room_group(t, "inventory").alias("inventory_group"), T.room_group(t, "ranking").alias("ranking_group"))


_N = ", ".join(f"count(*) FILTER (invalid_reason = '' AND label_norm = '{c}') AS n_valid_{c}" for c in T.CATEGORIES)
_SUM = lambda names, p="n_valid_": " + ".join(f'"{p}{n}"' for n in names)
_SCENES = f"""{objects_sql()}, inv0 AS (SELECT scene_id, {_TYPE_SQL.replace('s_suppkey', 'min(instance_id_raw)')} AS scene_type, count(*) FILTER (invalid_reason = '') AS n_valid_objects, count(DISTINCT label_norm) FILTER (invalid_reason = '') AS n_valid_categories, {_N} FROM obj GROUP BY scene_id),
    inv1 AS (SELECT *, {_SUM(T.SURFACES)} >= 1 AS has_surface, {_SUM(T.FURNITURE)} >= 1 AS has_furniture, {_SUM(T.REFERENCES)} >= 1 AS has_reference FROM inv0),
    inv AS (SELECT *, has_surface AND has_furniture AND has_reference AS has_required_categories, n_valid_objects >= 8 AND n_valid_categories >= 3 AND has_surface AND has_furniture AND has_reference AS is_candidate FROM inv1)"""


def _inventory(spark, sf_dir):
    o = objects(spark, sf_dir)
    t = F.get(F.array(*map(F.lit, _TYPES)), (F.min("instance_id_raw") % 8).cast("int"))
    return S.inventory(o, o.groupBy("scene_id").agg(t.alias("scene_type")))


query("scene_inventory", f"{_SCENES} SELECT * FROM inv")(_inventory)

_CAP = f"""{objects_sql()}, k AS (SELECT scene_id, {', '.join(f"count(*) FILTER (label_norm = '{c}') AS \"{c}\"" for c in T.CATEGORIES)} FROM v GROUP BY scene_id),
    c AS (SELECT *, {_SUM(T.SURFACES, '')} AS n_surface, {_SUM(T.FURNITURE, '')} AS n_furniture, {_SUM(T.REFERENCES, '')} AS n_reference FROM k)"""


@query("capabilities_pilot", f"{_CAP} SELECT *, n_surface >= 1 AS supports_distance, n_surface >= 1 AND n_furniture >= 2 AS supports_nearest, n_surface >= 2 AS supports_between, n_surface + n_furniture + n_reference >= 3 AS supports_aligned FROM c")
def capabilities_pilot(spark, sf_dir):
    return S.capabilities(objects(spark, sf_dir), "pilot")


@query("capabilities_official", f"{_CAP} SELECT *, n_surface >= 1 AND n_furniture + n_reference >= 1 AS supports_distance, n_surface + n_reference >= 1 AND greatest(chair, sofa, bed) >= 2 AS supports_nearest, n_surface >= 2 AND n_furniture >= 1 AS supports_between, n_surface + n_furniture + n_reference >= 3 AS supports_aligned FROM c")
def capabilities_official(spark, sf_dir):
    return S.capabilities(objects(spark, sf_dir), "official")


_SCORE = "2.0 * n_valid_categories + 0.5 * n_valid_objects + 1.5 * (n_valid_chair >= 2)::INT + 1.5 * (n_valid_table + n_valid_desk >= 2)::INT + 1.0 * (n_valid_door + n_valid_cabinet + n_valid_monitor >= 1)::INT + 0.5 * (n_valid_sofa >= 1)::INT + 0.5 * (n_valid_bed >= 1)::INT + 0.5 * (n_valid_monitor >= 1)::INT"


@query("scene_rank", f"{_SCENES} SELECT scene_id, {_group_sql('scene_type', _RANK)} AS room_group, split_part(scene_id, '_', 1) AS family_id, ({_SCORE})::DOUBLE AS selection_score FROM inv WHERE is_candidate")
def scene_rank(spark, sf_dir):
    return S.rank_scenes(_inventory(spark, sf_dir)).select("scene_id", "room_group", "family_id", "selection_score")


# The pool to pick from: parts as scenes; three scenes make a family, which lies in several groups.
_POOL_COLS = ["scene_id", "family_id", "room_group", "selection_score", "n_valid_objects", "n_valid_categories"]
_GROUPS = ["bedroom", "living_room", "office_study", "mixed_other"]
_POOL = f"""WITH pool AS (SELECT printf('scene%04d_%02d', p_partkey // 3, p_partkey % 3) AS scene_id, printf('scene%04d', p_partkey // 3) AS family_id, [{', '.join(f"'{g}'" for g in _GROUPS)}][p_partkey % 4 + 1] AS room_group,
    (p_size / 2.0)::DOUBLE AS selection_score, p_size % 11 AS n_valid_objects, p_partkey % 5 AS n_valid_categories FROM part)"""
_B = "selection_score DESC, n_valid_objects DESC, n_valid_categories DESC, scene_id"


def _pick_sql(targets: dict[str, int]) -> str:
    out, used = "", "SELECT NULL AS family_id WHERE false"
    for i, (g, n) in enumerate(targets.items()):
        out += f""", b{i} AS (SELECT *, row_number() OVER (PARTITION BY family_id ORDER BY {_B}) AS rn FROM pool WHERE room_group = '{g}' AND family_id NOT IN ({used})),
            s{i} AS (SELECT {', '.join(_POOL_COLS)} FROM b{i} WHERE rn = 1 ORDER BY {_B} LIMIT {n})"""
        used = " UNION ALL ".join(f"SELECT family_id FROM s{j}" for j in range(i + 1))
    return out + ", picked AS (" + " UNION ALL ".join(f"SELECT * FROM s{j}" for j in range(len(targets))) + ")"


def _pool(spark, sf_dir):
    k = F.col("p_partkey")
    return (
        read(spark, sf_dir, "part")
        .select(
            F.format_string("scene%04d_%02d", F.expr("CAST(p_partkey div 3 AS INT)"), (k % 3).cast("int")).alias("scene_id"),
            F.format_string("scene%04d", F.expr("CAST(p_partkey div 3 AS INT)")).alias("family_id"),
            F.get(F.array(*map(F.lit, _GROUPS)), (k % 4).cast("int")).alias("room_group"),
            (F.col("p_size") / 2).alias("selection_score"),
            (F.col("p_size") % 11).alias("n_valid_objects"),
            (k % 5).alias("n_valid_categories"),
        )
    )


@query("scene_pick", f"{_POOL}{_pick_sql(S.TARGETS)} SELECT * FROM picked")
def scene_pick(spark, sf_dir):
    return S.stratified_pick(_pool(spark, sf_dir))


_SHORT = {"bedroom": 3, "living_room": 2}


@query("scene_backfill", f"{_POOL}{_pick_sql(_SHORT)}, r AS (SELECT * FROM pool WHERE scene_id NOT IN (SELECT scene_id FROM picked) AND family_id NOT IN (SELECT family_id FROM picked) ORDER BY {_B} LIMIT 8 - (SELECT count(*) FROM picked)) SELECT * FROM picked UNION ALL SELECT * FROM r")
def scene_backfill(spark, sf_dir):
    pool = _pool(spark, sf_dir)
    return S.backfill(S.stratified_pick(pool, _SHORT), pool, 8)


@query("best_per_family", f"{_POOL}, r AS (SELECT *, row_number() OVER (PARTITION BY family_id ORDER BY {_B}) AS rn FROM pool) SELECT {', '.join(_POOL_COLS)} FROM r WHERE rn = 1")
def best_per_family(spark, sf_dir):
    return S.best_per_family(_pool(spark, sf_dir))


# Review sheets: answers and notes from the kind of an event.
_SHEET = """WITH s AS (SELECT event_id, event_type AS structured_query, user_id AS scene_id, CASE event_id % 6 WHEN 0 THEN 'Yes ' WHEN 1 THEN '' WHEN 2 THEN NULL WHEN 3 THEN 'no' WHEN 4 THEN 'yse' ELSE 'YES' END AS k,
        CASE event_id % 4 WHEN 0 THEN ' yse' WHEN 1 THEN 'Yes' WHEN 2 THEN NULL ELSE 'unclear' END AS n FROM events),
    c AS (SELECT *, lower(trim(coalesce(k, ''))) AS keep, lower(trim(coalesce(n, ''))) AS notes FROM s),
    d AS (SELECT event_id, scene_id, structured_query, CASE WHEN keep = '' AND notes IN ('yes', 'no', 'yse') THEN notes ELSE keep END AS keep, notes FROM c),
    r AS (SELECT event_id, scene_id, structured_query, CASE WHEN structured_query = 'error' THEN 'no' WHEN keep = 'yse' THEN 'yes' ELSE keep END AS review_keep, notes AS review_notes FROM d)"""


def _sheet(spark, sf_dir):
    pick = lambda n, vs: F.get(F.array(*map(F.lit, vs)), (F.col("event_id") % n).cast("int"))
    s = read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("scene_id"), F.col("event_type").alias("structured_query"), pick(6, ["Yes ", "", None, "no", "yse", "YES"]).alias("review_keep"), pick(4, [" yse", "Yes", None, "unclear"]).alias("review_notes"))
    return R.repair_review(s, spark.createDataFrame([("error",)], "structured_query string"))


query("review_repair", f"{_SHEET} SELECT * FROM r")(_sheet)


@query("review_final", f"{_SHEET}, f AS (SELECT * FROM r WHERE review_keep = 'yes') SELECT *, printf('dev_q_%04d', row_number() OVER (ORDER BY scene_id, event_id) - 1) AS query_id FROM f")
def review_final(spark, sf_dir):
    return R.with_row_id(_sheet(spark, sf_dir).where(R.review_kept(F.col("review_keep"))), "dev_q_", ["event_id"])


def _master(orders, customers):
    d = orders.select(F.lit("distance").alias("operator"), F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("d"))
    n = customers.select(F.lit("nearest").alias("operator"), F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("c"))
    both = R.conform(d.unionByName(n, allowMissingColumns=True), {"review_keep": F.lit(""), "c": F.lit("never")})
    return R.with_row_id(both, "dev_q_", ["k"], scope="operator")


@query(
    "master_queries",
    """WITH u AS (SELECT 'distance' AS operator, o_orderkey AS k, o_totalprice AS d, NULL AS c FROM orders UNION ALL SELECT 'nearest', c_custkey, NULL, c_mktsegment FROM customer)
    SELECT *, '' AS review_keep, printf('dev_q_%04d', row_number() OVER (ORDER BY operator, k) - 1) AS query_id FROM u""",
)
def master_queries(spark, sf_dir):
    """Questions of two kinds, of all orders and all customers, with different columns in one table, missing columns null, with running ids."""
    return _master(read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer"))


@query("file_order_ids", "SELECT event_id, printf('dev_official_dn_%04d', row_number() OVER () - 1) AS query_id FROM events")
def file_order_ids(spark, sf_dir):
    """Ids by the order in which rows stand in their file."""
    rows = with_file_row(read(spark, sf_dir, "events"), "row")
    return rows.select("event_id", F.format_string("dev_official_dn_%04d", "row").alias("query_id"))


@query("op_scene_summary", "SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{t}') AS {t}" for t in ("click", "view", "error")) + ", count(*) FILTER (event_type IN ('click', 'view', 'error')) AS total FROM events GROUP BY user_id")
def op_scene_summary(spark, sf_dir):
    return R.summary(read(spark, sf_dir, "events"), "user_id", "event_type", ["click", "view", "error"])


@query("split_by_task", "SELECT event_type IN ('click', 'view') AS relational, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY 1")
def split_by_task(spark, sf_dir):
    parts = R.split(read(spark, sf_dir, "events"), F.col("event_type").isin("click", "view"))
    agg = [p.agg(F.lit(flag).alias("relational"), F.count("*").alias("n"), F.min("event_id").alias("first_id")) for p, flag in zip(parts, (True, False), strict=True)]
    return agg[0].unionByName(agg[1])


@query("last_duplicate_wins", "SELECT user_id, event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def last_duplicate_wins(spark, sf_dir):
    return R.last_by(read(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "value", "event_id")


@query("first_per_key", "SELECT l_orderkey, arg_min(l_quantity, l_linenumber * 1000000000::BIGINT + l_extendedprice) AS q, min(l_linenumber) AS l_linenumber FROM lineitem GROUP BY l_orderkey")
def first_per_key(spark, sf_dir):
    out = R.first_by(read(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_extendedprice"])
    return out.select("l_orderkey", F.col("l_quantity").alias("q"), "l_linenumber")


@query("duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return R.duplicates(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("pending_requests", "SELECT o_orderkey AS query_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def pending_requests(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"))
    return R.pending(orders, read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id")))


_PRICE = "CASE WHEN o_orderkey % 10 = 0 THEN NULL WHEN o_orderkey % 10 = 1 THEN CAST('nan' AS DOUBLE) ELSE o_totalprice END"


@query(
    "float_key_join",
    f"""WITH l AS (SELECT o_orderkey, o_custkey, {_PRICE} AS price FROM orders), r AS (SELECT o_orderkey AS other, o_custkey, {_PRICE} + CASE o_orderkey % 3 WHEN 0 THEN 0.0005 WHEN 1 THEN -0.0005 ELSE 0.01 END AS price FROM orders)
    SELECT l.o_orderkey, l.o_custkey, round(l.price, 6) AS price, other FROM l LEFT JOIN r ON l.o_custkey = r.o_custkey AND ((l.price IS NULL OR isnan(l.price)) AND (r.price IS NULL OR isnan(r.price)) OR (NOT isnan(l.price) AND abs(l.price - r.price) <= 0.001))""",
)
def float_key_join(spark, sf_dir):
    """Orders with those of the same customer and, within a tenth of a penny, the same price; missing prices equal each other."""
    o = read(spark, sf_dir, "orders")
    price = F.when(F.col("o_orderkey") % 10 == 0, None).when(F.col("o_orderkey") % 10 == 1, F.lit(float("nan"))).otherwise(F.col("o_totalprice").cast("double"))
    moved = price + F.when(F.col("o_orderkey") % 3 == 0, 0.0005).when(F.col("o_orderkey") % 3 == 1, -0.0005).otherwise(0.01)
    left = o.select("o_orderkey", "o_custkey", price.alias("price"))
    right = o.select(F.col("o_orderkey").alias("other"), "o_custkey", moved.alias("price"))
    return R.join_near(left, right, ["o_custkey"], ["price"], 0.001).withColumn("price", F.round("price", 6))


@query("decimal_answers", "SELECT event_id, replace(printf('%.2f', round(value, 4)), '.', ',') || ' m' AS answer FROM events")
def decimal_answers(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", T.decimal_comma(F.round("value", 4)).alias("answer"))


@query("json_lists", "SELECT o_custkey, to_json(list(o_orderpriority ORDER BY o_orderkey)) AS priorities, to_json(list(CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey END ORDER BY o_orderkey)) AS keys FROM orders GROUP BY o_custkey")
def json_lists(spark, sf_dir):
    rows = F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority")))
    o = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(rows.alias("r"))
    keys = F.transform("r", lambda x: F.when(x["o_orderkey"] % 4 > 0, x["o_orderkey"]))
    return o.select("o_custkey", T.json_list(F.col("r.o_orderpriority")).alias("priorities"), T.json_list(keys).alias("keys"))


@query("label_value_counts", f"{objects_sql()} SELECT label_norm, count(*) AS n, count(DISTINCT scene_id) AS scenes FROM obj GROUP BY label_norm")
def label_value_counts(spark, sf_dir):
    return objects(spark, sf_dir).groupBy("label_norm").agg(F.count("*").alias("n"), F.count_distinct("scene_id").alias("scenes"))


# ---- Text ----

_ID = "printf('%s__%s_%03d', 'scene' || l_orderkey, l_returnflag, l_linenumber)"


@query("object_id_parts", f"SELECT l_orderkey, l_linenumber, l_partkey, {_ID} AS object_id, l_returnflag AS label, l_returnflag || printf('_%03d', l_linenumber) AS short_id, 'distance(\"' || {_ID} || '\", \"x\")' AS q FROM lineitem")
def object_id_parts(spark, sf_dir):
    oid = T.object_id(F.concat(F.lit("scene"), F.col("l_orderkey").cast("string")), F.col("l_returnflag"), F.col("l_linenumber"))
    d = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", oid.alias("object_id"))
    return d.select("*", T.object_label(F.col("object_id")).alias("label"), T.short_id(F.col("object_id")).alias("short_id"), T.structured("distance", F.col("object_id"), F.lit("x")).alias("q"))


@query("slugs", "WITH t AS (SELECT doc_id, substr(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 80) AS s FROM documents) SELECT doc_id, CASE WHEN s = '' THEN 'query' ELSE s END AS slug FROM t")
def slugs(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.slugify(F.coalesce("text", F.lit(""))).alias("slug"))


@query("collapsed_text", "SELECT conv_id, turn, regexp_replace(trim(lower(text), E' \\n\\t\\r'), '\\s+', ' ', 'g') AS t FROM conversations")
def collapsed_text(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", T.collapse_blanks(F.col("text")).alias("t"))


@query("parse_structured", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE 'nearest' END AS op, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE o_orderstatus END AS a, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS b FROM orders")
def parse_structured(spark, sf_dir):
    text = F.when(F.col("o_orderkey") % 3 == 0, T.structured("nearest", F.col("o_orderstatus"), F.col("o_orderpriority"))).when(F.col("o_orderkey") % 3 == 1, T.structured("nearest", F.col("o_orderstatus"))).otherwise(F.lit("nearest(x, y)"))
    q = T.parse_structured(text)
    return read(spark, sf_dir, "orders").select("o_orderkey", q.alias("q")).select("o_orderkey", "q.op", F.get("q.args", F.lit(0)).alias("a"), F.get("q.args", F.lit(1)).alias("b"))


@query("extract_ids", "SELECT o_orderkey, o_orderstatus AS id1, CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE 'Z9' END AS id2 FROM orders")
def extract_ids(spark, sf_dir):
    reply = F.concat(F.lit("It is '"), F.col("o_orderstatus"), F.lit("', nope; \""), F.col("o_orderstatus"), F.lit("\"."), F.when(F.col("o_orderkey") % 2 == 1, "\n Z9,").otherwise(""))
    ids = T.extract_ids(reply, F.array(F.lit("O"), F.lit("F"), F.lit("P"), F.lit("Z9")), 2)
    return read(spark, sf_dir, "orders").select("o_orderkey", ids[0].alias("id1"), ids[1].alias("id2"))


@query("parse_number", "SELECT event_id, CASE WHEN round(value, 2) > 0 AND round(value, 2) <= 25 THEN round(value, 2) ELSE 1.5 END AS number FROM events")
def parse_number(spark, sf_dir):
    reply = F.concat(F.lit("cerca de "), F.replace(F.format_string("%.2f", F.round("value", 2)), F.lit("."), F.lit(",")), F.lit(" m; no 30, maybe 1.5"))
    return read(spark, sf_dir, "events").select("event_id", T.parse_number(reply).alias("number"))


@query(
    "parse_nearest_reply",
    f"{objects_sql()} SELECT object_id, CASE instance_id_raw % 4 WHEN 3 THEN NULL WHEN 2 THEN label_norm || printf('_%03d', instance_id_raw) ELSE object_id END AS matched FROM v",
)
def parse_nearest_reply(spark, sf_dir):
    """Replies: the exact id, a sentence with it, one with its short form only (matched against candidates with another prefix), nonsense."""
    i = F.col("instance_id_raw") % 4
    reply = F.when(i == 0, F.concat(F.lit(" "), "object_id")).when(i == 1, F.concat(F.lit("it is "), "object_id")).when(i == 2, F.concat(F.lit("see "), T.short_id(F.col("object_id")))).otherwise("?? none")
    candidates = F.array(F.concat(F.lit("zz__zz"), T.short_id(F.col("object_id"))), F.when(i == 2, F.concat(F.lit("q__"), T.short_id(F.col("object_id")))).otherwise(F.col("object_id")))
    m = T.match_id(reply, candidates)
    return valid_objects(spark, sf_dir).select("object_id", F.when(i == 2, T.short_id(m)).otherwise(m).alias("matched"))


@query("parse_yes_no", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 0 END AS answer FROM events")
def parse_yes_no(spark, sf_dir):
    reply = F.get(F.array(*map(F.lit, [" Sim, está.", "não, nunca", "YES", "Nao sei", "yes it is"])), (F.col("event_id") % 5).cast("int"))
    return read(spark, sf_dir, "events").select("event_id", T.parse_yes_no(reply).alias("answer"))


@query("object_sort_order", f"{objects_sql()} SELECT scene_id, object_id, ord FROM v")
def object_sort_order(spark, sf_dir):
    return O.valid(objects(spark, sf_dir)).select("scene_id", "object_id", "ord")


@query(
    "joined_predictions",
    """SELECT o_orderkey AS query_id, o_custkey AS scene_id, o_orderstatus AS operator, o_orderpriority AS structured_query, o_totalprice AS truth, o_totalprice * 2 AS pred_a, o_totalprice + 1 AS pred_b FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 = 0""",
)
def joined_predictions(spark, sf_dir):
    """Two methods, each with answers to some of the questions, beside the truth."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"), F.col("o_custkey").alias("scene_id"), F.col("o_orderstatus").alias("operator"), F.col("o_orderpriority").alias("structured_query"), F.col("o_totalprice").alias("truth"))
    a = o.where("query_id % 2 = 0").withColumn("pred", F.col("truth") * 2)
    return R.join_predictions(o, a=a, b=o.where("query_id % 3 = 0").withColumn("pred", F.col("truth") + 1))


@query("error_rows_dropped", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '2.5 m' END AS reply FROM events WHERE event_id % 4 < 2")
def error_rows_dropped(spark, sf_dir):
    reply = F.get(F.array(F.lit(None).cast("string"), F.lit("2.5 m"), F.lit("API_ERROR: timeout"), F.lit("RENDER_ERROR")), (F.col("event_id") % 4).cast("int"))
    return R.without_errors(read(spark, sf_dir, "events").select("event_id", reply.alias("reply")), "reply")


@query("numbered_list", f"{objects_sql()}, n AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY label_norm, object_id) AS number FROM v) SELECT scene_id, string_agg(printf('%d: %s -> %s', number, label_norm, object_id), chr(10) ORDER BY number) AS listing FROM n GROUP BY scene_id")
def numbered_list(spark, sf_dir):
    return O.numbered_list(valid_objects(spark, sf_dir))
