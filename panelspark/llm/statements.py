"""DuckDB statements with the results of the text queries that SQL expresses."""

from __future__ import annotations

from panelspark.llm.mixing import LARGEST_MEAN
from panelspark.llm.quality import FENCES, WINDOW
from panelspark.llm.secret_scan import BASE_RULES, RULES

# Fixed value: the reversed polynomial of CRC-32.
CRC_POLYNOMIAL = 3988292384

_WORD = r"[^\x20\x09-\x0D]+"


def _quality() -> str:
    rates = {m: f"{top} * 1000 // greatest({bottom}, 1)" for m, (top, bottom, *_) in FENCES.items()}
    values = " UNION ALL ".join(
        f"SELECT lang, source, '{m}' AS measure, {rate} AS v FROM rows WHERE NOT base_failed" for m, rate in rates.items()
    )
    levels = {"0": ["lang", "source"], "1": ["lang"], "2": []}
    parts = []
    for level, groups in levels.items():
        key = "".join(f"{g}, " for g in groups)
        cells = ", ".join(
            f"max(CASE WHEN measure = '{m}' THEN "
            + (f"q75 + {width} * (q75 - q50) + {margin}" if upper else f"q25 - {width} * (q50 - q25) - {margin}")
            + f" END) AS f_{m}"
            for m, (_, _, upper, width, margin) in FENCES.items()
        )
        parts.append(f"""
merged{level} AS (SELECT {key} measure, bucket, count(*) AS n FROM sketch GROUP BY ALL),
ranked{level} AS (SELECT *, sum(n) OVER (PARTITION BY {key} measure ORDER BY bucket) AS upto,
  sum(n) OVER (PARTITION BY {key} measure) AS size FROM merged{level}),
points{level} AS (SELECT {key} measure, size,
  min(CASE WHEN 100 * upto >= 25 * size THEN bucket END) AS q25,
  min(CASE WHEN 100 * upto >= 50 * size THEN bucket END) AS q50,
  min(CASE WHEN 100 * upto >= 75 * size THEN bucket END) AS q75 FROM ranked{level} GROUP BY ALL),
fence{level} AS (SELECT {key} max(size) AS size, {cells} FROM points{level} GROUP BY {key.rstrip(', ') or '()'})""")

    def chosen(m: str) -> str:
        return (
            f"CASE WHEN f0.size >= 50 THEN f0.f_{m} WHEN f0.size IS NULL THEN NULL "
            f"WHEN f1.size >= 50 THEN f1.f_{m} ELSE f2.f_{m} END"
        )

    tests = " AND ".join(f"{rates[m]} {'<=' if FENCES[m][2] else '>='} {chosen(m)}" for m in FENCES)
    return f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
worded AS (SELECT *, regexp_extract_all(text, '{_WORD}') AS words FROM docs),
spots AS (SELECT rid, words, unnest(range(1, len(words) - {WINDOW - 2})) AS p0 FROM worded WHERE len(words) >= {WINDOW}),
wins AS (SELECT rid, p0, array_to_string(words[p0 : p0 + {WINDOW - 1}], ' ') AS win FROM spots),
twice AS (SELECT rid, unnest(list(p0)) AS p0 FROM wins GROUP BY rid, win HAVING count(*) > 1),
covered AS (SELECT rid, count(DISTINCT spot) AS n FROM
  (SELECT rid, unnest(range(p0, p0 + {WINDOW})) AS spot FROM twice) GROUP BY rid),
lines AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM docs),
again AS (SELECT rid, sum(c - 1) AS n FROM (SELECT rid, line, count(*) AS c FROM lines
  WHERE regexp_matches(line, '{_WORD}') GROUP BY rid, line) GROUP BY rid),
measured AS (SELECT rid, doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words,
  CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols FROM worded),
rows AS (SELECT measured.*, CAST(coalesce(again.n, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
  n_words < 20 OR 100 * coalesce(covered.n, 0) > 30 * n_words AS base_failed
  FROM measured LEFT JOIN again USING (rid) LEFT JOIN covered USING (rid)),
measures AS ({values}),
sketch AS (SELECT lang, source, measure,
  (v >> CAST(greatest(length(bin(v)) - 7, 0) AS BIGINT)) << CAST(greatest(length(bin(v)) - 7, 0) AS BIGINT) AS bucket FROM measures),
{','.join(parts)}
SELECT doc_id, rows.lang, rows.source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce({tests}, true) AS kept
FROM rows LEFT JOIN fence0 AS f0 ON rows.lang IS NOT DISTINCT FROM f0.lang AND rows.source IS NOT DISTINCT FROM f0.source
LEFT JOIN fence1 AS f1 ON rows.lang IS NOT DISTINCT FROM f1.lang LEFT JOIN fence2 AS f2 ON true
"""


def _mix(seed: int = 17, alpha: float = 0.5) -> str:
    draw = f"CAST('0x' || substr(md5('{seed}|' || part || '|' || doc_id), 1, 13) AS BIGINT) / 4503599627370496.0"
    return f"""
WITH docs AS (SELECT doc_id, source FROM documents),
sizes AS (SELECT source, CAST(count(*) AS DOUBLE) AS n FROM docs GROUP BY source),
rates AS (SELECT source, round((SELECT sum(n) FROM sizes) * pow(n, {alpha}) / (SELECT sum(pow(n, {alpha})) FROM sizes) / n, 9) AS rate FROM sizes),
parted AS (SELECT *, CAST(greatest(ceil(rate / {LARGEST_MEAN}), 1) AS INTEGER) AS parts FROM rates),
means AS (SELECT *, rate / parts AS mean FROM parted),
steps AS (SELECT source, rate, mean, parts, unnest(range(0, CAST(ceil(mean + 12 * sqrt(mean) + 30) AS BIGINT) + 1)) AS k FROM means),
cdf AS (SELECT source, rate, parts, k,
  sum(CASE WHEN mean > 0 THEN exp(k * ln(mean) - mean - lgamma(k + 1)) WHEN k = 0 THEN 1 ELSE 0 END)
    OVER (PARTITION BY source ORDER BY k) AS upto FROM steps),
tables AS (SELECT source, rate, parts, list(upto ORDER BY k) AS upto FROM cdf GROUP BY ALL),
drawn AS (SELECT doc_id, docs.source, rate, upto, unnest(range(1, parts + 1)) AS part
  FROM docs JOIN tables ON docs.source IS NOT DISTINCT FROM tables.source),
counted AS (SELECT doc_id, source, rate,
  sum(len(list_filter(upto, lambda x: x <= {draw}))) AS n FROM drawn GROUP BY ALL)
SELECT d.*, rate AS mix_rate, CAST(copy AS INTEGER) AS mix_copy,
  md5('{seed} place|' || c.doc_id || '|' || copy) AS mix_place
FROM (SELECT *, unnest(range(0, CAST(n AS BIGINT))) AS copy FROM counted) c JOIN documents d ON d.doc_id = c.doc_id
"""


def _secrets() -> str:
    parts, cells = [], []
    for number, rule in enumerate(RULES):
        pattern = rule.pattern.replace("'", "''")
        parts.append(f"""
split{number} AS (SELECT rid, regexp_extract_all(text, '{pattern}', 0) AS whole,
  regexp_extract_all(text, '{pattern}', {rule.group}) AS part, string_split_regex(text, '{pattern}') AS pieces FROM docs),
match{number} AS (SELECT rid, unnest(range(1, len(whole) + 1)) AS i, unnest(whole) AS m, unnest(part) AS p, unnest(pieces[1 : len(whole)]) AS before
  FROM split{number} WHERE len(whole) > 0),
span{number} AS (SELECT rid, {number} AS number, '{rule.kind}' AS kind, length(m) AS size, length(p) AS deep,
  sum(length(before) + length(m)) OVER (PARTITION BY rid ORDER BY i) AS till FROM match{number})""")
        cells.append(
            f"SELECT rid, number, kind, till - size AS start, till AS stop FROM span{number} WHERE deep >= {rule.least}"
        )
    counts = ", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE_RULES)
    sums = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE_RULES)
    told = "string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, number)"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
{','.join(parts)},
spans AS ({' UNION ALL '.join(cells)}),
found AS (SELECT rid, {sums}, {told} FILTER (number < {len(BASE_RULES)}) AS base, {told} AS spans FROM spans GROUP BY rid)
SELECT doc_id, {counts}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN found USING (rid)
"""


def _trie() -> str:
    return f"""
WITH RECURSIVE step(n, k, c) AS (
  SELECT i, 0, i::BIGINT FROM range(256) t(i)
  UNION ALL
  SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor({CRC_POLYNOMIAL}, c >> 1) ELSE c >> 1 END FROM step WHERE k < 8
),
crc AS (SELECT list(c ORDER BY n) AS codes FROM step WHERE k = 8),
own AS (
  SELECT conv_id, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS item,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS place
  FROM conversations
),
convs AS (
  SELECT conv_id, list(item ORDER BY place) AS items,
    coalesce(xor(list_reduce(
      list_prepend(4294967295, list_transform(range(1, 1 + length(conv_id::VARCHAR)), lambda i: ascii(substr(conv_id::VARCHAR, i, 1))::BIGINT)),
      lambda a, b: xor(a >> 8, codes[1 + (xor(a, b) & 255)])), 4294967295) % 9, 0) AS h
  FROM own, crc GROUP BY conv_id, codes
),
rebuilt AS (
  SELECT c.conv_id, coalesce(b.items, [])[1:c.h] || c.items[c.h + 1:] AS items
  FROM convs c LEFT JOIN convs b ON b.conv_id = c.conv_id - c.conv_id % 5
),
reached AS (
  SELECT conv_id, d AS depth, items[1:d] AS head, d = len(items) AS ended
  FROM rebuilt, unnest(range(0, len(items) + 1)) t(d)
),
nodes AS (
  SELECT depth, head, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ended), '')) AS ends_sha256,
    (count(*) - 1) * CASE WHEN depth = 0 THEN 0 ELSE octet_length(encode(head[depth].text)) END AS own
  FROM reached GROUP BY depth, head
),
tops AS (
  SELECT n.*, p.conv_id AS parent_conv_id, p.head AS up
  FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.head = n.head[1:n.depth - 1]
),
children AS (SELECT up AS head, count(*) AS n_children FROM tops WHERE up IS NOT NULL GROUP BY up),
full_nodes AS (
  SELECT t.*, coalesce(c.n_children, 0) AS n_children FROM tops t LEFT JOIN children c ON c.head = t.head
),
below AS (
  SELECT n.head[1:d] AS head, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(own) AS saved_tokens
  FROM full_nodes n, unnest(range(0, n.depth + 1)) t(d) GROUP BY 1
)
SELECT n.conv_id, n.depth, n.parent_conv_id, n.n_convs, n.n_children, b.n_leaves, b.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM full_nodes n JOIN below b ON b.head = n.head
"""


def all_statements() -> dict[str, str]:
    return {
        "op1_quality_rules": _quality(),
        "op6_source_mix": _mix(),
        "op7_secret_scan": _secrets(),
        "op13_prefix_trie": _trie(),
    }
