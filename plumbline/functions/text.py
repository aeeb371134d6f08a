"""Text functions: label and query normalisation, query grammar, reply parsing. All are Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- Fixed values: categories, label map (in its order), category groups, sentence templates ----

CATEGORIES = ["chair", "table", "desk", "sofa", "bed", "door", "cabinet", "monitor"]

LABEL_MAP = {
    "chair": ["chair", "office chair", "dining chair", "armchair", "desk chair"],
    "table": ["table", "dining table", "coffee table", "side table", "end table"],
    "desk": ["desk", "writing desk", "computer desk"],
    "sofa": ["sofa", "couch", "loveseat"],
    "bed": ["bed", "bunk bed", "single bed", "double bed"],
    "door": ["door"],
    "cabinet": ["cabinet", "cupboard", "storage cabinet", "kitchen cabinet"],
    "monitor": ["monitor", "tv", "television", "computer monitor", "display"],
}

FURNITURE, SURFACES, REFERENCES = ["chair", "sofa", "bed"], ["table", "desk"], ["door", "cabinet", "monitor"]

NATURAL = {
    "distance": "qual a distância entre %s e %s?",
    "nearest": "qual objeto da categoria %2$s está mais próximo de %1$s?",
    "between": "%s está entre %s e %s?",
    "aligned": "%s, %s e %s estão alinhados?",
    "above": "%s está acima de %s?",
}

GRAMMAR = [  # in the order in which they are tried; text after the question mark is ignored
    ("distance", r"^qual a distancia entre ([a-z0-9_]+) e ([a-z0-9_]+)\?", ["a", "b"]),
    ("nearest", r"^qual ([a-z_]+) esta mais proximo de ([a-z0-9_]+)\?", ["category", "a"]),
    ("between", r"^([a-z0-9_]+) esta entre ([a-z0-9_]+) e ([a-z0-9_]+)\?", ["x", "a", "b"]),
    ("aligned", r"^([a-z0-9_]+), ([a-z0-9_]+) e ([a-z0-9_]+) estao alinhados\?", ["a", "b", "c"]),
]

ACCENTS = {"distância": "distancia", "próximo": "proximo", "estão": "estao", "está": "esta"}

# ---- Normalisation ----


def strip(text: Column) -> Column:
    """Trims all blanks, tabs and line ends included."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def fold_accents(text: Column) -> Column:
    """Trimmed and lower-cased, with the grammar's accented words written plainly."""
    out = F.lower(strip(text))
    for accented, plain in ACCENTS.items():
        out = F.replace(out, F.lit(accented), F.lit(plain))
    return out


def collapse_blanks(text: Column) -> Column:
    return F.regexp_replace(strip(F.lower(text)), r"\s+", " ")


def slugify(text: Column, length: int = 80) -> Column:
    """Lower-case words joined by underscores, at most ``length`` characters; "query" if nothing is left.

    Only the shortest head with length + 1 letters or digits matters (all of a text that has fewer), so the replacing stops there.
    """
    head = F.regexp_extract(F.lower(text), f"^(?:[^a-z0-9]*+[a-z0-9]){{0,{length + 1}}}", 0)
    s = F.substring(F.regexp_replace(F.regexp_replace(head, "[^a-z0-9]+", "_"), "^_", ""), 1, length)
    return F.when(F.coalesce(s, F.lit("")) == "", F.lit("query")).otherwise(s)


def decimal_comma(number: Column, digits: int = 2, unit: str = " m") -> Column:
    """An answer as it is shown: so many decimals after a comma, and the unit."""
    return F.concat(F.replace(F.format_string(f"%.{digits}f", number), F.lit("."), F.lit(",")), F.lit(unit))


def json_list(values: Column) -> Column:
    """A list written as JSON; null items stay null."""
    return F.to_json(values, {"ignoreNullFields": "false"})


def normalize_label(raw: Column, label_map: dict[str, list[str]] | None = None, allowed: list[str] | None = None) -> Column:
    """Category of a raw label: mapped exactly, or allowed itself, or that of the first mapped label (in the map's order) that it contains; else null."""
    label_map, allowed = label_map or LABEL_MAP, allowed or CATEGORIES
    s = F.lower(strip(raw))
    pairs = [(k, v) for v, ks in label_map.items() for k in ks]
    exact = F.create_map(*[F.lit(x) for p in pairs for x in p])
    ordered = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in pairs])
    part = F.get(F.filter(ordered, lambda e: F.contains(s, e["k"])), F.lit(0))["v"]
    return F.coalesce(F.try_element_at(exact, s), F.when(s.isin(allowed), s), part)


def room_group(scene_type: Column, rules: str = "inventory") -> Column:
    """Room group of a scene type; two fixed keyword lists, for the inventory and for ranking."""
    lists = {
        "inventory": [("bedroom", ["bedroom", "guest room", "hotel room"]), ("living_room", ["living room", "lounge", "family room"]), ("office_study", ["office", "study", "conference room", "meeting room", "computer lab"])],
        "ranking": [("bedroom", ["bedroom", "hotel"]), ("living_room", ["living room", "lounge", "family room"]), ("office_study", ["office", "study", "conference", "meeting room", "computer lab", "classroom"])],
    }[rules]
    s = F.coalesce(F.lower(strip(scene_type)), F.lit(""))
    out = F.lit("mixed_other")
    for group, words in reversed(lists):
        out = F.when(s.rlike("|".join(words)), group).otherwise(out)
    return out


def family(scene_id: Column) -> Column:
    return F.substring_index(scene_id, "_", 1)


def object_id(scene: Column, label: Column, instance: Column) -> Column:
    return F.format_string("%s__%s_%03d", scene, F.coalesce(label, F.lit("unknown")), instance.cast("int"))


def object_label(object_id_: Column) -> Column:
    return F.regexp_extract(object_id_, "__(.*)_[^_]*$", 1)


def short_id(object_id_: Column) -> Column:
    return F.element_at(F.split(object_id_, "__"), -1)


# ---- Rendering ----


def structured(op: str, *args: Column) -> Column:
    return F.format_string(f"{op}(" + ", ".join(['"%s"'] * len(args)) + ")", *args)


def natural(op: str, *args: Column) -> Column:
    return F.format_string(NATURAL[op], *args)


# ---- Parsing of queries ----


def parse_query(text: Column) -> Column:
    """struct<op, x, a, b, c, category> of a natural query; op is null outside the grammar."""
    s = fold_accents(text)
    fields = {k: F.lit(None).cast("string") for k in ("op", "x", "a", "b", "c", "category")}
    for op, pattern, names in reversed(GRAMMAR):
        hit = s.rlike(pattern)
        for k in fields:
            value = F.lit(op) if k == "op" else F.regexp_extract(s, pattern, names.index(k) + 1) if k in names else F.lit(None).cast("string")
            fields[k] = F.when(hit, value).otherwise(fields[k])
    return F.struct(*[v.alias(k) for k, v in fields.items()])


def parse_structured(text: Column) -> Column:
    """struct<op, args> of op("a", "b"[, "c"]); op is null if the text has another form."""
    form = r'^\s*([a-z]+)\(\s*("[^"]*"(?:\s*,\s*"[^"]*")*)\s*\)\s*$'
    ok = text.rlike(form)
    args = F.regexp_extract_all(F.regexp_extract(text, form, 2), F.lit('"([^"]*)"'), F.lit(1))
    return F.struct(F.when(ok, F.regexp_extract(text, form, 1)).alias("op"), F.when(ok, args).alias("args"))


# ---- Parsing of model replies ----


def extract_ids(reply: Column, valid: Column, n: int) -> Column:
    """The first n distinct valid ids of a reply, padded with nulls. Tokens end at blanks, commas and semicolons; quotes and stops around them go."""
    tokens = F.transform(F.split(F.coalesce(reply, F.lit("")), r"[\s,;]+"), lambda t: F.regexp_replace(t, "^[.,;\"']+|[.,;\"']+$", ""))
    found = F.array_distinct(F.filter(tokens, lambda t: F.array_contains(valid, t)))
    return F.array(*[F.get(found, F.lit(i)) for i in range(n)])


def parse_number(reply: Column, low: float = 0.0, high: float = 25.0) -> Column:
    """The first number over low and up to high, a decimal comma allowed; null if there is none."""
    found = F.regexp_extract_all(F.replace(reply, F.lit(","), F.lit(".")), F.lit(r"\b[0-9]+(?:\.[0-9]+)?\b"), F.lit(0))
    return F.get(F.filter(F.transform(found, lambda m: m.try_cast("double")), lambda v: (v > low) & (v <= high)), F.lit(0))


def match_id(reply: Column, candidates: Column) -> Column:
    """The candidate that a reply names: exactly, else the first that contains it or is contained, else the first whose short form it contains."""
    r = strip(reply)
    first = lambda test: F.get(F.filter(candidates, test), F.lit(0))
    return F.coalesce(first(lambda k: k == r), first(lambda k: F.contains(r, k) | F.contains(k, r)), first(lambda k: F.contains(r, short_id(k))))


def parse_yes_no(reply: Column) -> Column:
    """1 for yes, 0 for no, null for anything else."""
    s = F.lower(strip(reply))
    return F.when(F.startswith(s, F.lit("sim")) | (s == "yes"), 1).when(F.startswith(s, F.lit("não")) | F.startswith(s, F.lit("nao")) | (s == "no"), 0)


def unordered_match(a: Column, b: Column, ga: Column, gb: Column) -> Column:
    """Whether {a, b} and {ga, gb} are the same two ids; false if any is null."""
    return F.coalesce((F.least(a, b) == F.least(ga, gb)) & (F.greatest(a, b) == F.greatest(ga, gb)) & a.isNotNull() & b.isNotNull() & ga.isNotNull() & gb.isNotNull(), F.lit(False))
