"""DuckDB SQL of the queries that SQL can express, from the operators' fixed values (words, patterns, templates) alone."""

from __future__ import annotations

from .license_scan import BASE, FURTHER
from .secret_scan import BASE_RULES, MORE_RULES

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _quoted(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def license_scan(posted_words: int = 3, agreement: float = 0.8) -> str:
    """Every alignment of a template at one of its rarest words, judged word by word."""
    templates = BASE + FURTHER
    words, labels = [], []
    for t, one in enumerate(templates):
        body, key = one.text.split(), one.key.split()
        k0 = next(i for i in range(len(body)) if body[i : i + len(key)] == key) if key else 0
        words += [f"({t}, {k}, {_quoted(w)}, {k0 <= k < k0 + (len(key) or len(body))})" for k, w in enumerate(body)]
        labels.append(f"({t}, {_quoted(one.label)}, {one.base}, {1 if one.base or not key else posted_words})")
    return f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
        p AS (SELECT r, unnest(w) AS word, unnest(range(0, len(w))) AS i FROM d),
        tw(t, k, word, in_key) AS (VALUES {', '.join(words)}),
        tl(t, label, base, posted) AS (VALUES {', '.join(labels)}),
        df AS (SELECT word, count(DISTINCT r) AS n FROM p WHERE word IN (SELECT word FROM tw) GROUP BY word),
        idf AS (SELECT word, ln(((SELECT count(*) FROM documents) + 1) / (coalesce(n, 0) + 1)) + 1e-3 AS x FROM (SELECT DISTINCT word FROM tw) LEFT JOIN df USING (word)),
        tx AS (SELECT t, k, word, in_key, round(x / sum(x) OVER (PARTITION BY t), 12) AS share, row_number() OVER (PARTITION BY t ORDER BY x DESC, k) AS place FROM tw JOIN idf USING (word)),
        c AS (SELECT DISTINCT r, t, i - k AS s FROM p JOIN tx USING (word) JOIN tl USING (t) WHERE place <= posted AND i >= k),
        v AS (SELECT c.r, t, s, sum(CASE WHEN p.word IS NULL THEN 0 ELSE share END) AS x FROM c JOIN tx USING (t) LEFT JOIN p ON p.r = c.r AND p.i = s + k AND p.word = tx.word
              GROUP BY c.r, t, s HAVING bool_and(NOT in_key OR p.word IS NOT NULL) AND sum(CASE WHEN p.word IS NULL THEN 0 ELSE share END) >= {agreement}),
        f AS (SELECT r, count(*) FILTER (base) AS n_base, min(s) FILTER (base) AS first_word, max(s) FILTER (base) AS last_word,
              string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, least(1, round(max(x), 9)) AS score
              FROM v JOIN tl USING (t) GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
               coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
        FROM d LEFT JOIN f USING (r)"""


def secret_scan() -> str:
    """Matches of each kind; the k-th starts where the gaps before it and the matches before it end."""
    kinds = []
    for n, (kind, pattern, group, least) in enumerate(BASE_RULES + MORE_RULES):
        # a run of hexadecimal digits is too short or passes as a whole
        p = _quoted(f"[0-9a-f]{{{least},}}" if pattern == "[0-9a-f]+" else pattern)
        kinds.append(f"""SELECT r, '{kind}' AS kind, {n} AS place, {n < len(BASE_RULES)} AS base, sum(len(g) + len(m)) OVER (PARTITION BY r ORDER BY k) - len(m) AS s, len(m) AS n
            FROM (SELECT r, unnest(range(1, len(ms) + 1)) AS k, unnest(ms) AS m, unnest(regexp_split_to_array(t, {p})[1 : len(ms)]) AS g
                  FROM (SELECT r, t, regexp_extract_all(t, {p}) AS ms FROM d) WHERE len(ms) > 0)
            QUALIFY len(regexp_extract(m, {p}, {group})) >= {least}""")
    text = lambda where: f"coalesce(string_agg(concat(kind, ':', s, ':', s + n), ',' ORDER BY s, place){where}, '')"
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k, *_ in BASE_RULES)
    return f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
        f AS ({' UNION ALL '.join(kinds)}),
        a AS (SELECT r, {counts}, {text(' FILTER (base)')} AS base_spans, {text('')} AS spans FROM f GROUP BY r)
        SELECT doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k, *_ in BASE_RULES)}, sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM d LEFT JOIN a USING (r)"""


#: 20 bits, five hexadecimal digits, are four letters of base32.
WARC = """
    WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
    q AS (SELECT page_id, octet_length(encode(h)) AS n, sha1(h) AS x FROM p),
    w AS (SELECT *, max(page_id) OVER (PARTITION BY x) AS m FROM q)
    SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
           array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               CAST((CAST('0x' || substr(x, 1 + 5 * (k // 4), 5) AS BIGINT) >> (15 - 5 * (k % 4))) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
           CASE WHEN m IS NOT NULL AND page_id IS DISTINCT FROM m THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN page_id IS DISTINCT FROM m THEN m END AS refers_to
    FROM w"""

#: Windows of documents of every length that an item's windows have, joined with those of the items.
DECONTAMINATION = f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
    b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
    bi AS (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
    bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS s FROM bi),
    di AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d JOIN (SELECT DISTINCT n FROM bw) ON len(w) >= n),
    m AS (SELECT r, i, n, item_id FROM (SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS s FROM di) JOIN bw USING (n, s)),
    h AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT r, i, n FROM m)) GROUP BY r),
    f AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM m WHERE item_id IS NOT NULL) GROUP BY r)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN h USING (r) LEFT JOIN f USING (r)"""

EXACT_DEDUP = f"""
    WITH t AS (SELECT doc_id, sha256({_LOWER}) AS text_sha256 FROM documents)
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = max(doc_id) OVER w AS kept, text_sha256
    FROM t WINDOW w AS (PARTITION BY text_sha256)"""


def _crc_step(n: int) -> int:
    """The CRC-32 remainder of a half byte."""
    for _ in range(4):
        n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
    return n


def crc32(s: str) -> str:
    """CRC-32 of a string's UTF-8 bytes, half a byte at a time: the lower half, which the hexadecimal form has second, comes first."""
    halves = f"list_transform(range(0, 2 * octet_length(encode({s}))), lambda k: CAST(instr('123456789ABCDEF', substr(hex(encode({s})), CAST(k + 2 - 2 * (k % 2) AS BIGINT), 1)) AS BIGINT))"
    table = "[" + ", ".join(map(str, map(_crc_step, range(16)))) + "]"
    return f"xor(list_reduce({halves}, lambda c, h: xor(c >> 4, {table}[(xor(c, h) & 15) + 1]), 4294967295), 4294967295)"


#: Two words are near if one is the other less a letter, or both less a letter at one place are equal; each place of every word is tried.
SPELLING = f"""
    WITH RECURSIVE o AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[a-z\u00C0-\u00FF]+')) AS w FROM documents),
    c AS (SELECT w, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w AS s, count(*) AS k FROM o GROUP BY ALL),
    h AS (SELECT w, k, {{crc}} AS h FROM c),
    e AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, k FROM h),
    v AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM e WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
    d AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
    p AS (SELECT d.word, v.word AS other, v.n AS m FROM d JOIN v ON d.rest = v.word
          UNION SELECT v.word, d.word, d.n FROM d JOIN v ON d.rest = v.word
          UNION SELECT a.word, b.word, b.n FROM d a JOIN d b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word),
    f AS (SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS form, max(m) AS form_n FROM p GROUP BY word),
    t AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * v.n THEN form END AS form, CASE WHEN form_n >= 2 * v.n THEN form_n END AS form_n FROM v LEFT JOIN f ON v.word = f.word),
    r AS (SELECT word, word AS at FROM t UNION ALL SELECT r.word, t.form FROM r JOIN t ON r.at = t.word WHERE t.form IS NOT NULL)
    SELECT t.word, t.form, r.at AS root, t.n, t.n_near, t.form_n
    FROM t JOIN r ON t.word = r.word JOIN t e ON r.at = e.word WHERE e.form IS NULL"""

RESAMPLING = f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
    df AS (SELECT r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM d),
    b AS (SELECT {_WORDS} AS w FROM benchmark),
    bf AS (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM b),
    h AS (SELECT f, {{crc}} % 10000 AS bucket FROM (SELECT f FROM df UNION SELECT f FROM bf)),
    s AS (SELECT bucket, count(*) AS s FROM df JOIN h USING (f) GROUP BY bucket),
    t AS (SELECT bucket, count(*) AS t FROM bf JOIN h USING (f) GROUP BY bucket),
    g AS (SELECT bucket, CAST(floor(1000 * ln(CAST((coalesce(t, 0) + 1) * ((SELECT count(*) FROM df) + 10000) AS DOUBLE) / CAST((coalesce(s, 0) + 1) * ((SELECT count(*) FROM bf) + 10000) AS DOUBLE))) AS BIGINT) AS gain
          FROM s LEFT JOIN t USING (bucket)),
    m AS (SELECT r, count(*) AS n, CAST(sum(gain) AS BIGINT) AS x FROM df JOIN h USING (f) JOIN g USING (bucket) GROUP BY r),
    w AS (SELECT r, doc_id, coalesce(n, 0) AS n_features, coalesce((x - ((x % n) + n) % n) // n, 0) AS weight, CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS u FROM d LEFT JOIN m USING (r)),
    z AS (SELECT r, doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((u + 0.5) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score FROM w),
    k AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS rank, count(*) OVER () AS all_n FROM z WHERE n_features >= 39)
    SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 25 * all_n // 100 THEN rank END AS rank
    FROM z LEFT JOIN k USING (r)"""

ORACLE_SQL: dict[str, str] = {
    "op2_license_scan": license_scan(),
    "op6_secret_scan": secret_scan(),
    "op7_warc": WARC,
    "op8_decontamination": DECONTAMINATION,
    "op9_exact_dedup": EXACT_DEDUP,
    "op12_spelling_variants": SPELLING.replace("{crc}", crc32("s")),
    "op13_resampling": RESAMPLING.replace("{crc}", crc32("f")),
}
