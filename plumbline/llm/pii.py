"""Personal data by candidate gradient boosting. DataFrame functions only on the path over documents.

Generators (regular expressions with high recall, whose matches may overlap) propose spans. Format and context features of
each candidate go through boosted trees, compiled to a walk over constant arrays; a threshold per kind, calibrated for precision, selects
redactions. Candidates of the base kinds that pass their format rules are always selected.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boosting import Node, boost, calibrated_thresholds, predict, walk_sql


@dataclass(frozen=True)
class Generator:
    kind: str
    #: Java regex. Possessive, and anchored by what stands before, so that a scan is linear in the text.
    pattern: str
    #: Cheap test that every text with a match passes: SQL over column t.
    gate: str
    #: SQL test of a match m; base kinds are selected by it alone.
    rule: str
    base: bool = False


_OCTET = "0*(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
_LUHN = """aggregate(sequence(1, length(d)), 0, (a, i) -> a + CASE WHEN i % 2 = 1 THEN CAST(substr(d, -i, 1) AS INT)
    WHEN CAST(substr(d, -i, 1) AS INT) > 4 THEN 2 * CAST(substr(d, -i, 1) AS INT) - 9 ELSE 2 * CAST(substr(d, -i, 1) AS INT) END) % 10 = 0"""

#: Base kinds in their fixed order, then further kinds. A match starts where the character before can't belong to it, or
#: where the last match ended (\\G): that is where a leftmost search without those tests would start it as well.
GENERATORS = (
    Generator("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "contains(t, '@')", "true", True),
    Generator("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"t RLIKE '[0-9]\\.[0-9]{1,}\\.[0-9]'", rf"m RLIKE '^{_OCTET}(\\.{_OCTET}){{3}}$'", True),
    Generator("card", r"(?<![0-9])[0-9](?:[ -]?[0-9]){13,}+", r"t RLIKE '(?<![0-9])[0-9](?:[ -]?[0-9]){13}'", f"length(d) BETWEEN 14 AND 19 AND ({_LUHN})", True),
    Generator("phone", r"\+[0-9][ ().0-9-]+[0-9]", "contains(t, '+')", "length(d) BETWEEN 10 AND 15", True),
    Generator("ssn", r"(?<![0-9A-Za-z-])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![0-9A-Za-z-])", r"t RLIKE '[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}'", "true"),
    Generator("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"t RLIKE '[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4} ?[A-Z0-9]{4}'", "true"),
    Generator("tel", r"(?<![0-9+().-])(?:\([0-9]{3}\) ?|[0-9]{3}[. -])[0-9]{3}[. -][0-9]{4}(?![0-9-])", r"t RLIKE '[0-9]{3}[. -][0-9]{4}'", "true"),
    Generator("masked", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]{2,64}+ ?(?:\[at\]|\(at\)) ?[A-Za-z0-9-]{2,63}+(?: ?(?:\[dot\]|\(dot\)) ?[A-Za-z0-9-]{2,63}+|\.[A-Za-z0-9-]{2,63}+)++", "(contains(t, '[at]') OR contains(t, '(at)'))", "true"),
)

#: Words that speak for a kind when they stand within CONTEXT characters before a candidate, and words that speak against any.
CONTEXT = 40
CUES = {
    "ssn": "ssn|social security|social sec", "iban": "iban|account|bank|konto|compte|cuenta",
    "tel": "phone|telephone|tel|call|fax|mobile|cell|contact", "masked": "mail|email|contact|write|reach",
}
AGAINST = "order|invoice|part|serial|version|isbn|model|ticket|page|figure"


def _word(words: str) -> str:
    """A pattern for any of the words, standing as a word."""
    return f"(^|[^a-z])({words})([^a-z]|$)"


#: Features: kind, digits, distinct digits, characters, blanks, cue before, counter-cue before, capital or digit glued after, first digit,
#: whether the kind's own format rule holds, and spelled-out dots.
NAMES = ["kind", "digits", "distinct", "length", "blanks", "cue", "against", "glued", "first", "valid", "dots"]

#: Format rules of the further kinds that a regular expression can check: allowed number ranges, a last label of letters.
FORMATS = {"ssn": "^(?!000|666|9)[0-9]{3}[- ](?!00)[0-9]{2}[- ](?!0000)[0-9]{4}$", "tel": "^[(]?[2-9][0-9]{2}[^0-9]+[2-9][0-9]{2}[^0-9][0-9]{4}$", "masked": "[^A-Za-z0-9-][A-Za-z]{2,24}$"}
_MOD97 = """aggregate(split(concat(substr(replace(m, ' ', ''), 5), substr(replace(m, ' ', ''), 1, 4)), ''), 0,
    (a, c) -> IF(ascii(c) < 58, (a * 10 + ascii(c) - 48) % 97, (a * 100 + ascii(c) - 55) % 97)) = 1"""


def _features_sql(n: int, before: str, after: str) -> list[str]:
    """SQL of the features of the match m of generator number n; d holds its digits."""
    cue, kind = CUES.get(GENERATORS[n].kind, "@"), GENERATORS[n].kind
    return [
        f"{n}", "length(d)", "size(array_distinct(split(d, '')))", "length(m)", "length(m) - length(replace(m, ' ', ''))", f"CAST(lower({before}) RLIKE '{_word(cue)}' AS INT)",
        f"CAST(lower({before}) RLIKE '{_word(AGAINST)}' AS INT)", f"CAST({after} RLIKE '^[A-Z0-9]' AS INT)", "IF(length(d) = 0, -1, CAST(substr(d, 1, 1) AS INT))",
        f"CAST({_MOD97} AS INT)" if kind == "iban" else f"CAST(m RLIKE '{FORMATS[kind]}' AS INT)", "size(split(m, '[(\\\\[]dot')) - 1",
    ]


def mod97(match: str) -> int:
    """The remainder that is 1 for a right account number."""
    s = match.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def features(n: int, match: str, before: str, after: str) -> list[float]:
    """The same features in plain Python, for training and tests."""
    d, kind = re.sub("[^0-9]", "", match), GENERATORS[n].kind
    cue = CUES.get(kind, "@")
    valid = mod97(match) == 1 if kind == "iban" else bool(re.search(FORMATS[kind], match))
    # splitting an empty text gives one empty piece
    return [n, len(d), max(1, len(set(d))), len(match), match.count(" "), int(bool(re.search(_word(cue), before.lower()))), int(bool(re.search(_word(AGAINST), before.lower()))), int(bool(re.match("[A-Z0-9]", after))), int(d[0]) if d else -1, int(valid), len(re.split(r"[(\[]dot", match)) - 1]


def _digits(rng: random.Random, n: int) -> str:
    return "".join(rng.choices("0123456789", k=n))


def _personal(rng: random.Random, kind: str) -> str:
    """A made-up value of a kind that keeps the kind's format."""
    sep = rng.choice("- ")
    if kind == "ssn":
        return f"{rng.choice([*range(1, 666), *range(667, 900)]):03d}{sep}{rng.randint(1, 99):02d}{sep}{rng.randint(1, 9999):04d}"
    if kind == "tel":
        area = str(rng.randint(200, 999))
        return rng.choice([f"({area}) ", area + rng.choice("-. ")]) + f"{rng.randint(200, 999)}{rng.choice('-. ')}{_digits(rng, 4)}"
    if kind == "iban":
        country, letters, numbers = rng.choice([("DE", 0, 18), ("GB", 4, 14), ("FR", 0, 23), ("ES", 0, 20), ("NL", 4, 10), ("IT", 1, 22)])
        rest = "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ", k=letters)) + _digits(rng, numbers)
        whole = f"{country}{98 - mod97(country + '00' + rest):02d}{rest}"
        return " ".join(whole[i : i + 4] for i in range(0, len(whole), 4)) if rng.random() < 0.5 else whole
    name = lambda: "".join(rng.choices("abcdefghilmnoprstu", k=rng.randint(2, 9)))
    at, dot = rng.choice(["[at]", "(at)", " [at] ", " (at) "]), rng.choice(["(dot)", "[dot]", " (dot) ", " [dot] ", "."])
    return name() + rng.choice(["", "." + name()]) + at + name() + dot + rng.choice(["com", "org", "net", "de", "example"])


def _other(rng: random.Random, kind: str) -> str:
    """Something of the same shape that is no personal data: part numbers, codes, repeated digits, prose in brackets."""
    sep = rng.choice("- ")
    if kind == "ssn":
        one = _digits(rng, 3) + sep + _digits(rng, 2) + sep + _digits(rng, 4)
    elif kind == "tel":
        one = _digits(rng, 3) + rng.choice("-. ") + _digits(rng, 3) + rng.choice("-. ") + _digits(rng, 4)
    elif kind == "iban":
        return "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ", k=2)) + _digits(rng, 2) + rng.choice(["", " "]).join(["", *[_digits(rng, 4) for _ in range(rng.randint(3, 6))]])
    else:
        word = lambda: rng.choice(["look", "met", "noon", "items", "index", "the", "v2", "row", "it", "then", "next", "4"])
        return f"{word()} {rng.choice(['(at)', '[at]'])} {word()}{rng.choice(['.', '.', ' (dot) '])}{word()}"
    return re.sub("[0-9]", rng.choice("0123456789"), one) if rng.random() < 0.25 else one


def planted(rng: random.Random, n: int, words: tuple[str, ...] = ("the", "of", "was", "on", "file", "and", "for", "she", "a")) -> tuple[str, tuple[int, int] | None]:
    """A text around a made-up value of kind n, personal or not, and the personal span. Cue words stand before many of the first and few of the second."""
    kind, true = GENERATORS[n].kind, rng.random() < 0.5
    match = _personal(rng, kind) if true else _other(rng, kind)
    cue, against = rng.random() < (0.8 if true else 0.04), rng.random() < (0.02 if true else 0.45)
    said = [*rng.choices(words, k=rng.randint(1, 8)), *([rng.choice(CUES[kind].split("|"))] if cue else []), *([rng.choice(AGAINST.split("|"))] if against else []), *rng.choices(words, k=rng.randint(0, 2))]
    # a masked address starts where its first word does, so a word before it never belongs to it
    before = " ".join(said) + (": " if cue or against else " ")
    return before + match + rng.choice([" ", ". ", ", ", "\n"] if true else [" ", ". ", ", ", ""]) + " ".join(rng.choices(words, k=3)), (len(before), len(before) + len(match)) if true else None


def proposed(n: int, text: str) -> list[tuple[int, int]]:
    """Spans that generator n proposes, in plain Python."""
    return [m.span() for m in re.finditer(GENERATORS[n].pattern.replace(r"|\G)", ")"), text)]


def _examples(rng: random.Random, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the first ``count`` candidates that the generators propose in texts with planted values."""
    kinds, x, y = [n for n, g in enumerate(GENERATORS) if not g.base], [], []
    while len(x) < count:
        n = rng.choice(kinds)
        text, truth = planted(rng, n)
        for s, e in proposed(n, text):
            x.append(features(n, text[s:e], text[max(0, s - CONTEXT) : s], text[e : e + 1]))
            y.append((s, e) == truth)
    return np.array(x[:count], float), np.array(y[:count], float)


@lru_cache(maxsize=4)
def model(examples: int = 3000, seed: int = 11, precision: float = 0.97) -> tuple[tuple[Node, ...], dict[int, float]]:
    """Trees and thresholds by kind. Trained on ``examples`` candidates that the generators propose in made-up texts (fixed, seeded);
    thresholds are calibrated on as many others."""
    rng = random.Random(seed)
    trees = boost(*_examples(rng, examples))
    x, y = _examples(rng, examples)
    return tuple(trees), calibrated_thresholds(predict(trees, x), y, x[:, 0].astype(int), precision)


def matches(text: Column, pattern: str, block: int = 64) -> Column:
    """Leftmost non-overlapping matches as array<struct<start, m>>, in code points: lengths of the gaps and matches, summed up.

    Prefix sums go by blocks, so that work stays near linear in the number of matches.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    both = F.arrays_zip(gaps.alias("g"), found.alias("m"))  # the last gap has no match
    steps = F.transform(both, lambda b: b["g"] + F.coalesce(F.char_length(b["m"]), F.lit(0)))
    packed = F.struct(both.alias("b"), steps.alias("s"))

    def offsets(v: Column) -> Column:
        n = F.size(v["s"])
        sums = F.transform(F.sequence(F.lit(0), ((n - 1) / block).cast("int")), lambda k: F.aggregate(F.slice(v["s"], k * block + 1, block), F.lit(0), lambda a, c: a + c))
        w = F.struct(v["b"].alias("b"), v["s"].alias("s"), sums.alias("u"))
        return F.transform(F.array(w), lambda z: F.transform(z["u"], lambda _, k: F.aggregate(F.slice(z["u"], 1, k), F.lit(0), lambda a, c: a + c)))[0]

    def spans(v: Column) -> Column:
        z = F.struct(v["b"].alias("b"), v["s"].alias("s"), offsets(v).alias("o"))
        return F.transform(
            F.array(z),
            lambda z: F.filter(
                F.transform(
                    z["b"],
                    lambda b, i: F.struct(
                        (F.get(z["o"], (i / block).cast("int")) + F.aggregate(F.slice(z["s"], (i / block).cast("int") * block + 1, i % block), F.lit(0), lambda a, c: a + c) + b["g"]).alias("start"),
                        b["m"].alias("m"),
                    ),
                ),
                lambda x: x["m"].isNotNull(),
            ),
        )[0]

    return F.transform(F.array(packed), spans)[0]


def settle(d: DataFrame) -> DataFrame:
    """Of the spans in x (ascending by start) those that overlap no better one: of a higher score, or the same and a lower kind_no.

    Each span meets four neighbours on each side. A span further away overlaps only if the earlier of the two is long, that is,
    reaches over the start of the fifth span after it; long spans (y) meet all.
    """
    better = "e -> e.start < c.end AND c.start < e.end AND (e.score > c.score OR (e.score = c.score AND e.kind_no < c.kind_no))"
    long = "coalesce(get(x, i + 5).start < c.end, false)"
    d = d.withColumn("y", F.expr(f"IF(size(x) < 6, slice(x, 1, 0), filter(x, (c, i) -> {long}))"))
    near = f"filter(x, (c, i) -> NOT exists(slice(x, greatest(1, i - 3), 9), {better}))"
    whole = f"filter(x, (c, i) -> NOT exists(slice(x, greatest(1, i - 3), 9), {better}) AND NOT exists(y, {better}) AND NOT ({long} AND exists(x, {better})))"
    return d.withColumn("x", F.expr(f"CASE WHEN size(x) = 0 THEN x WHEN size(y) = 0 THEN {near} ELSE {whole} END")).drop("y")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", precision: float = 0.97) -> DataFrame:
    """Per document: id and spans, an array of (start, kind_no, end, kind, base) in code points, ascending, end exclusive.

    Base kinds (email, ip, card, phone) are the leftmost non-overlapping matches that pass their rule. Further kinds (ssn, iban,
    tel, masked) are selected by the trees at a threshold for ``precision`` by kind, unless they overlap a base span or
    a better one. Null and empty texts have no spans; rows are judged one by one, so repeated rows and null ids
    change nothing; other columns are ignored. One pass, no shuffle.
    """
    trees, limits = model(precision=precision)
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    d = apart(d, ["id", "t"], {f"g{n}": F.when(F.expr(g.gate), matches(F.col("t"), g.pattern)) for n, g in enumerate(GENERATORS)})
    empty, made = "CAST(array() AS ARRAY<STRUCT<start: INT, kind_no: INT, end: INT, kind: STRING, base: BOOLEAN, f: ARRAY<DOUBLE>>>)", []
    for n, g in enumerate(GENERATORS):
        digits = "transform(array(named_struct('m', v.m, 'd', regexp_replace(v.m, '[^0-9]', ''))), z -> {})[0]"
        before, after = f"substr(t, greatest(1, v.start - {CONTEXT - 1}), least({CONTEXT}, v.start))", "substr(t, v.start + length(v.m) + 1, 1)"
        inputs = "CAST(array() AS ARRAY<DOUBLE>)" if g.base else digits.format(f"array({', '.join(f'CAST({_bound(f)} AS DOUBLE)' for f in _features_sql(n, before, after))})")
        one = f"named_struct('start', v.start, 'kind_no', {n}, 'end', v.start + length(v.m), 'kind', '{g.kind}', 'base', {str(g.base).lower()}, 'f', {inputs})"
        made.append(f"IF(g{n} IS NULL, {empty}, transform(filter(g{n}, v -> {digits.format(_bound(g.rule))}), v -> {one}))")
    joined = lambda base: f"concat({', '.join(m for m, g in zip(made, GENERATORS, strict=True) if g.base == base)})"
    d = apart(d, ["id"], {"b": f"array_sort(transform({joined(True)}, {_SPAN}))", "c": joined(False)})
    least = f"array({', '.join(f'{limits.get(n, np.inf) if np.isfinite(limits.get(n, np.inf)) else 1e300!r}D' for n in range(len(GENERATORS)))})"
    scored = f"transform(filter(c, c -> NOT exists(b, e -> e.start < c.end AND c.start < e.end)), c -> named_struct('start', c.start, 'kind_no', c.kind_no, 'end', c.end, 'kind', c.kind, 'base', c.base, 'score', {walk_sql(list(trees), 'c.f')}))"
    none = "CAST(array() AS ARRAY<STRUCT<start: INT, kind_no: INT, end: INT, kind: STRING, base: BOOLEAN, score: DOUBLE>>)"
    d = apart(d, ["id", "b"], {"x": f"IF(size(c) = 0, {none}, array_sort(filter({scored}, c -> c.score >= {least}[c.kind_no])))"})
    d = apart(settle(d), ["id"], {"spans": f"IF(size(x) = 0, b, array_sort(concat(b, transform(x, {_SPAN}))))"})
    return d.withColumnRenamed("id", id_col)


_SPAN = "s -> named_struct('start', s.start, 'kind_no', s.kind_no, 'end', s.end, 'kind', s.kind, 'base', s.base)"


def apart(d: DataFrame, keep: list[str], cols: dict[str, Column | str]) -> DataFrame:
    """The columns ``keep`` of d and new ones of Columns or SQL texts, behind an explode of one struct a row.

    The optimizer moves no expression and no filter through an explode. So whatever is asked of the new columns later, each
    is worked out once a row and stands once in the plan; without this, a filter on them would be repeated with all that
    they are made of, at every step below.
    """
    made = [(F.expr(c) if isinstance(c, str) else c).alias(n) for n, c in cols.items()]
    out = d.select(*keep, F.explode_outer(F.array(F.struct(*made))).alias("_apart"))
    return out.select(*keep, *[F.col("_apart")[n].alias(n) for n in cols])


def _bound(sql: str) -> str:
    """m and d as fields of the lambda variable z."""
    return re.sub(r"(?<![\w.'\[])([md])(?=[,) ])", r"z.\1", sql)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", precision: float = 0.97) -> DataFrame:
    """docs with every selected span of the text replaced by its kind in angle brackets; rows and other columns stay. Null texts stay null.

    Spans are found again from the text itself, so rows need no key.
    """
    row = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("id"), F.col(text_col).alias("text"))
    found = scan(row, "id", "text", precision)
    return found.select(*[F.col("id")[c].alias(c) if c != text_col else _cut(F.col("id")[c], F.col("spans")).alias(c) for c in docs.columns])


def _cut(text: Column, spans: Column) -> Column:
    """Overlapping spans count as one place, named after the first."""
    acc = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(a: Column, s: Column) -> Column:
        fresh = s["start"] >= a["at"]
        parts = F.when(fresh, F.concat(a["parts"], F.array(F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.concat(F.lit("<"), s["kind"], F.lit(">"))))).otherwise(a["parts"])
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), parts.alias("parts"))

    out = F.aggregate(spans, acc, step, lambda a: F.concat(F.array_join(a["parts"], ""), F.substring(text, a["at"] + 1, F.char_length(text))))
    return F.when(text.isNotNull() & (F.size(spans) > 0), out).otherwise(text)
