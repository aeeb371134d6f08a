"""Licence scan with a positional rare-token index. DataFrame functions only.

Every template (a licence phrase or the opening of a licence text) is posted in an index under its rarest words, rare by
their inverse document frequency over the whole corpus. Of a file, only the words that the index holds are looked up;
each posting proposes one alignment (file position less template position); alignments are intersected with the
template's other words at the same relative positions, and count if the weighted share of agreeing words is high enough
and the template's mandatory key phrase stands word for word.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: Runs of these characters separate words (after lower-casing A-Z).
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    #: Words of the text that must stand consecutively and unchanged; all of it by default.
    key: str = ""
    base: bool = False


#: The base phrases and their labels.
BASE = (
    Template("gpl", "gnu general public license", base=True),
    Template("apache", "apache license", base=True),
    Template("cc-by", "cc by", base=True),
    Template("mit", "mit license", base=True),
)

#: Further labels: openings of well-known licence texts with the phrase that identifies each.
FURTHER = (
    Template("agpl", "gnu affero general public license"),
    Template("lgpl", "gnu lesser general public license"),
    Template("mpl", "mozilla public license"),
    Template("epl", "eclipse public license"),
    Template("cc0", "cc0 1 0 universal"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    Template("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance", "licensed under the apache license"),
)

#: Alignments travel as template * 2^40 + start, so that equal ones are removed by a hash set.
_SHIFT = 1 << 40


def words_of(text: Column) -> Column:
    """Words of a text as an array; none for null or empty text."""
    return F.array_remove(F.split(ascii_lower(text), SEPARATORS), "")


def idf(docs: DataFrame, vocabulary: list[str], text_col: str = "text") -> dict[str, float]:
    """Inverse document frequency of the given words over all documents: one count per word reaches the driver."""
    seen = docs.select(F.explode(F.array_distinct(F.filter(words_of(F.col(text_col)), lambda w: w.isin(vocabulary)))).alias("w"))
    rows = seen.groupBy("w").count().collect()  # len(vocabulary) rows at most
    n, df = docs.count(), {r["w"]: r["count"] for r in rows}
    return {w: math.log((n + 1) / (df.get(w, 0) + 1)) + 1e-3 for w in vocabulary}


def _sql(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = BASE + FURTHER, posted_words: int = 3, agreement: float = 0.8) -> DataFrame:
    """Per document: id, n_words, starts (ascending word positions of base phrases), base_labels, labels (sorted arrays), score.

    score is the best weighted agreement of a verified alignment, 0 without one and 1 for a whole phrase. Base templates
    must agree in every word and are posted under their single rarest word, so each of their places is found exactly
    once; others are posted under ``posted_words`` words. Null text has no words. Null or repeated ids and extra columns
    change nothing: rows are judged one by one. Work per file is linear in its words plus its postings; nothing is
    shuffled except one count per vocabulary word.
    """
    toks = [t.text.split() for t in templates]
    vocabulary = sorted({w for t in toks for w in t})
    weight = idf(docs, vocabulary, text_col)
    postings: dict[str, list[tuple[int, int]]] = {}
    for i, (t, words) in enumerate(zip(templates, toks, strict=True)):
        rare = sorted(range(len(words)), key=lambda k: (-weight[words[k]], k))
        for k in rare[: 1 if t.base or not t.key else posted_words]:
            postings.setdefault(words[k], []).append((i, k))
    index = "map(" + ", ".join(f"{_sql(w)}, array({', '.join(f'{i * _SHIFT - k}L' for i, k in p)})" for w, p in sorted(postings.items())) + ")"
    body, key = [], []
    for t, words in zip(templates, toks, strict=True):
        total = sum(weight[w] for w in words)
        body.append("array(" + ", ".join(f"struct({k} AS o, {_sql(w)} AS w, {weight[w] / total:.12f}D AS x)" for k, w in enumerate(words)) + ")")
        k0 = next(i for i in range(len(words)) if words[i : i + len(t.key.split())] == t.key.split()) if t.key else 0
        key.append("array(" + ", ".join(f"struct({k0 + j} AS o, {_sql(w)} AS w)" for j, w in enumerate(t.key.split() or words)) + ")")
    lengths = f"array({', '.join(str(len(w)) for w in toks)})"
    labels = f"array({', '.join(_sql(t.label) for t in templates)})"
    base = [i for i, t in enumerate(templates) if t.base]
    anchors = sorted(postings)

    d = docs.select(F.col(id_col), words_of(F.col(text_col)).alias("_w"))
    at = F.filter(F.transform("_w", lambda w, i: F.when(w.isin(anchors), i).otherwise(F.lit(-1))), lambda i: i >= 0)
    d = d.select(id_col, "_w", F.size("_w").cast("long").alias("n_words"), at.alias("_at"))
    # candidates: template * 2^40 + start; a start below 0 would borrow from the template number and is cut first
    found = f"""array_distinct(flatten(transform(_at, i -> transform(
        filter({index}[_w[i]], p -> i + (p - ({_SHIFT}L * CAST(ceil(p / {_SHIFT}D) AS BIGINT))) >= 0), p -> p + i))))"""
    d = d.withColumn("_c", F.expr(f"CASE WHEN size(_at) = 0 THEN CAST(array() AS ARRAY<BIGINT>) ELSE {found} END"))
    scored = f"""transform(_c, c -> struct(CAST(c div {_SHIFT}L AS INT) AS t, CAST(c % {_SHIFT}L AS INT) AS s,
        aggregate(array({', '.join(body)})[CAST(c div {_SHIFT}L AS INT)], 0D, (a, e) -> a + IF(get(_w, CAST(c % {_SHIFT}L AS INT) + e.o) <=> e.w, e.x, 0D)) AS x,
        forall(array({', '.join(key)})[CAST(c div {_SHIFT}L AS INT)], e -> get(_w, CAST(c % {_SHIFT}L AS INT) + e.o) <=> e.w) AS k))"""
    d = d.withColumn("_v", F.expr(f"CASE WHEN size(_c) = 0 THEN NULL ELSE filter({scored}, v -> v.k AND v.x >= {agreement}D) END"))
    none = "CAST(array() AS ARRAY<STRING>)"
    in_base = f"v.t IN ({', '.join(map(str, base))})" if base else "false"
    return d.select(
        id_col,
        "n_words",
        F.expr(f"CASE WHEN _v IS NULL THEN CAST(array() AS ARRAY<INT>) ELSE array_sort(transform(filter(_v, v -> {in_base}), v -> v.s)) END").alias("starts"),
        F.expr(f"CASE WHEN _v IS NULL THEN {none} ELSE array_sort(array_distinct(transform(filter(_v, v -> {in_base}), v -> {labels}[v.t]))) END").alias("base_labels"),
        F.expr(f"CASE WHEN _v IS NULL THEN {none} ELSE array_sort(array_distinct(transform(_v, v -> {labels}[v.t]))) END").alias("labels"),
        F.expr("CASE WHEN _v IS NULL THEN 0D ELSE least(1D, coalesce(round(array_max(transform(_v, v -> v.x)), 9), 0D)) END").alias("score"),
        F.expr(f"CASE WHEN _v IS NULL THEN CAST(array() AS ARRAY<STRUCT<label: STRING, start: INT, words: INT>>) ELSE transform(_v, v -> struct({labels}[v.t] AS label, v.s AS start, {lengths}[v.t] AS words)) END").alias("places"),
    )
