"""SQL twins of the operators that SQL can express, on the same tables."""

from __future__ import annotations

from facetmill.llm import importance, license_scan

_UPPER = "".join(chr(c) for c in range(65, 91))
_SPACE = r"[\x20\x09-\x0D]+"


def _rows(rows: list[tuple]) -> str:
    cell = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)


def license_sql(documents: str = "documents") -> str:
    """SQL for the rows of ``license_scan.scan``: the same index and votes, by joins on words."""
    words = [license_scan.words_of(t) for _, t, _ in license_scan.TEMPLATES]
    phrase = lambda label: " AND ".join(f"w[p + {k}] = '{x}'" for k, x in enumerate(license_scan.BASE[label].split(), 1))
    base = " UNION ALL ".join(f"SELECT doc_id, '{label}' AS label, p FROM (SELECT doc_id, w, unnest(range(len(w))) AS p FROM d) WHERE {phrase(label)}" for label in license_scan.BASE)
    return f"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM {documents}),
template(tid, label, n, pick) AS (VALUES {_rows([(i, label, len(w), license_scan.picked(w)) for i, ((label, _, _), w) in enumerate(zip(license_scan.TEMPLATES, words))])}),
word(tid, i, word) AS (VALUES {_rows([(t, i, x) for t, w in enumerate(words) for i, x in enumerate(w) if len(x) > 1])}),
key_phrase(tid, phrase) AS (VALUES {_rows([(t, p) for t, (_, _, phrases) in enumerate(license_scan.TEMPLATES) for p in phrases])}),
place AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM d),
frequency AS (SELECT word, count(DISTINCT doc_id) AS df FROM place WHERE word IN (SELECT word FROM word) GROUP BY 1),
ranked AS (SELECT tid, word, row_number() OVER (PARTITION BY tid ORDER BY coalesce(df, 0), length(word) DESC, word) AS r FROM (SELECT DISTINCT tid, word FROM word) LEFT JOIN frequency USING (word)),
posting AS (SELECT tid, i, word, count(*) OVER (PARTITION BY tid) AS m FROM word JOIN ranked USING (tid, word) JOIN template USING (tid) WHERE r <= pick),
vote AS (SELECT doc_id, tid, pos - i AS place, count(*) AS votes, any_value(m) AS m FROM place JOIN posting USING (word) GROUP BY 1, 2, 3 HAVING count(*) >= greatest(2, ceil({license_scan.AGREE} * any_value(m)))),
near AS (SELECT doc_id, tid, votes / m AS share, ' ' || array_to_string(w[greatest(place - {license_scan.AROUND}, 0) + 1 : greatest(place - {license_scan.AROUND}, 0) + n + {2 * license_scan.AROUND}], ' ') || ' ' AS said FROM vote JOIN d USING (doc_id) JOIN template USING (tid)),
matched AS (SELECT doc_id, label, max(share) AS share FROM near JOIN template USING (tid) JOIN key_phrase USING (tid) WHERE contains(said, ' ' || phrase || ' ') GROUP BY 1, 2),
base AS ({base}),
b AS (SELECT doc_id, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY 1),
l AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM matched UNION SELECT doc_id, label FROM base) GROUP BY 1),
s AS (SELECT doc_id, max(share) AS share FROM matched GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN s USING (doc_id)"""


#: The base expressions as the contract words them, for engines without look-behind.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def pii_base_sql(documents: str = "documents") -> str:
    """SQL for the base columns of ``pii.find``."""
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN (length({digits}) - i) % 2 = 0 THEN CAST({digits}[i] AS INTEGER) ELSE (2 * CAST({digits}[i] AS INTEGER)) % 10 + CAST({digits}[i] AS INTEGER) // 5 END)) % 10 = 0"
    valid = {
        "email": "true",
        "ip": "len(list_filter(string_split(m, '.'), lambda p: coalesce(try_cast(ltrim(p, '0') AS INTEGER), CASE WHEN ltrim(p, '0') = '' THEN 0 ELSE 999 END) > 255)) = 0",
        "card": f"length({digits}) BETWEEN 16 AND 19 AND {luhn}",
        "phone": f"length({digits}) BETWEEN 8 AND 15",
    }
    found = lambda k, p: f"SELECT doc_id, '{k}' AS kind, {list(PLAIN).index(k)} AS k, unnest(regexp_extract_all(t, '{p}')) AS m, unnest(range(1, len(regexp_extract_all(t, '{p}')) + 1)) AS i, regexp_split_to_array(t, '{p}') AS rest FROM d WHERE regexp_matches(t, '{p}')"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM {documents}),
f AS ({" UNION ALL ".join(found(k, p) for k, p in PLAIN.items())}),
p AS (SELECT doc_id, kind, k, m, sum(length(m)) OVER (PARTITION BY doc_id, kind ORDER BY i) - length(m) + list_sum(list_transform(rest[1:i], lambda x: length(x))) AS a FROM f),
s AS (SELECT doc_id, kind, k, CAST(a AS BIGINT) AS a, CAST(a AS BIGINT) + length(m) AS b FROM p WHERE CASE kind {" ".join(f"WHEN '{k}' THEN {v}" for k, v in valid.items())} END),
c AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in PLAIN)}, sha256(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY k, a)) AS base_sha256 FROM s GROUP BY 1)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in PLAIN)}, coalesce(base_sha256, sha256('')) AS base_sha256 FROM d LEFT JOIN c USING (doc_id)"""


def rules_base_sql(documents: str = "documents") -> str:
    """SQL for the base columns of ``quality_rules.judge``."""
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM {documents}),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '{_SPACE}'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
five AS (SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
twice AS (SELECT doc_id, i FROM five QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2), (3), (4)) AS l(k) GROUP BY 1),
c AS (SELECT doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM w LEFT JOIN covered USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c"""


def dedup_sql(length: int = 400, documents: str = "documents") -> str:
    """SQL for the rows of ``substring_dedup.deduplicate``: every string of so many bytes, in hexadecimal."""

    def covered(name: str, size: int) -> str:
        return f"""{name}_all AS (SELECT doc_id, i, hash(substr(h, 2 * i - 1, {2 * size})) AS s FROM (SELECT doc_id, h, unnest(range(1, n - {size} + 2)) AS i FROM d WHERE n >= {size})),
{name}_twice AS (SELECT s FROM {name}_all GROUP BY 1 HAVING count(*) > 1),
{name}_start AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= {size} THEN 0 ELSE 1 END AS fresh FROM {name}_all WHERE s IN (SELECT s FROM {name}_twice)),
{name} AS (SELECT doc_id, min(i) AS a, max(i) + {size - 1} AS b FROM (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM {name}_start) GROUP BY doc_id, run)"""

    return f"""WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM {documents}),
{covered("cut", length)},
bounds AS (SELECT doc_id, a, b FROM cut UNION ALL SELECT doc_id, n + 1, n + 1 FROM d),
piece AS (SELECT doc_id, a, substr(h, 2 * coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) + 1, 2 * (a - 1 - coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0))) AS p FROM bounds JOIN d USING (doc_id)),
kept AS (SELECT doc_id, sha256(unhex(string_agg(p, '' ORDER BY a))) AS kept_sha256 FROM piece GROUP BY 1),
c AS (SELECT doc_id, CAST(sum(b - a + 1) AS BIGINT) AS n_removed, count(*) AS n_spans FROM cut GROUP BY 1)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN c USING (doc_id)"""


def jaccard_sql(width: int = 3, percent: int = 90, documents: str = "documents") -> str:
    """SQL for the rows of ``jaccard_join.jaccard_components``: all pairs that share a shingle."""
    return f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{_SPACE}'), lambda x: x <> '') AS w FROM {documents}),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i+{width - 1}], ' ')) AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {width - 2}, 2))) AS i FROM w WHERE len(w) > 0)),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
common AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c FROM s p JOIN s q ON p.x = q.x AND p.doc_id < q.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM common JOIN z za ON za.doc_id = a JOIN z zb ON zb.doc_id = b WHERE 100 * c >= {percent} * (za.n + zb.n - c)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(a, b) AS (SELECT a, b FROM edge UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a),
root AS (SELECT a AS doc_id, min(least(a, b)) AS root FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(root, doc_id) AS component_id FROM {documents} LEFT JOIN z USING (doc_id) LEFT JOIN root USING (doc_id)"""


def importance_sql(documents: str = "documents", benchmark: str = "benchmark") -> str:
    """SQL for the rows of ``importance.resample`` with runs of one word: the checksum of every distinct
    word byte by byte from its table of remainders."""
    b = importance.BUCKETS
    found = lambda t: f"regexp_extract_all(translate(coalesce({t}, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""WITH table_of AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
d AS (SELECT doc_id, row_number() OVER () AS r, {found("text")} AS w FROM {documents}),
place AS (SELECT r, unnest(w) AS word FROM d),
wanted AS (SELECT unnest({found("text")}) AS word FROM {benchmark}),
word AS MATERIALIZED (SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(strlen(word)), lambda k: ('0x' || substr(hex(encode(word)), 2 * k + 1, 2))::BIGINT)),
  lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1])), 4294967295) % {b} AS bucket FROM (SELECT word FROM place UNION SELECT word FROM wanted), table_of),
source AS (SELECT bucket, count(*) AS s FROM place JOIN word USING (word) GROUP BY 1),
target AS (SELECT bucket, count(*) AS t FROM wanted JOIN word USING (word) GROUP BY 1),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM place) + {b}) / ((s + 1)::DOUBLE * ((SELECT count(*) FROM wanted) + {b}))))::BIGINT AS gain FROM source LEFT JOIN target USING (bucket)),
weighed AS (SELECT r, sum(gain)::BIGINT AS weight FROM place JOIN word USING (word) JOIN gain USING (bucket) GROUP BY 1),
scored AS (SELECT doc_id, len(w) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{importance.SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN weighed USING (r)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {importance.LEAST_WORDS} ORDER BY score DESC, doc_id NULLS FIRST) AS k FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= {importance.LEAST_WORDS} AND k <= (SELECT count(*) FROM scored WHERE n_features >= {importance.LEAST_WORDS}) * {importance.PERCENT} // 100 THEN k END AS rank FROM ranked"""
