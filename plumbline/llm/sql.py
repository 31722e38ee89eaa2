"""DuckDB SQL of the queries that SQL can express. The others (models, vocabularies, suffix arrays, page trees) are tested by brute force."""

from __future__ import annotations

from plumbline.llm import decontaminate as D

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Every pair that shares a shingle, then all that can be reached by links.
OP1 = rf"""WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, len(g) AS n FROM s),
u AS (SELECT doc_id, unnest(g) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n i ON i.doc_id = x JOIN n j ON j.doc_id = y WHERE 100 * c >= 85 * (i.n + j.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, min(y) AS component_id FROM n JOIN r ON r.x = n.doc_id GROUP BY ALL"""

OP8 = """WITH h AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS sha FROM pages),
g AS (SELECT sha, max(page_id) AS leader FROM h GROUP BY sha)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((CAST('0x' || substr(sha, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = leader THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> leader THEN leader END AS refers_to, CAST(NULL AS VARCHAR) AS problem FROM h JOIN g USING (sha)"""


def _list(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _templates(name: str, source: str, key: str) -> str:
    numbers, units = _list(D.NUMBER_WORDS), _list(D.UNITS)
    return rf"""{name}_w AS (SELECT {key} AS id, text, list_filter(string_split_regex(text, '{D.SPACE}'), lambda w: regexp_matches(w, '[\p{{L}}\p{{N}}]')) AS words
    FROM (SELECT DISTINCT {key}, text FROM {source} WHERE text IS NOT NULL)),
{name}_c AS (SELECT *, list_transform(words, lambda w: regexp_replace(w, '{D.AROUND}', '', 'g')) AS cores FROM {name}_w),
{name} AS (SELECT id, text, cores, list_transform(range(1, len(cores) + 1), lambda i:
    CASE WHEN regexp_matches(cores[i], '{D.MARKED}') THEN
      CASE WHEN regexp_matches(cores[i], '{D.NUMBER}') THEN '<number>' WHEN regexp_matches(cores[i], '{D.QUANTITY}') THEN '<quantity>'
        WHEN i > 1 AND regexp_matches(cores[i], '{D.NAME}') AND NOT regexp_matches(words[i - 1], '{D.SENTENCE_END}') THEN '<name>' ELSE lower(cores[i]) END
    WHEN cores[i] IN {numbers} THEN '<number>'
    WHEN cores[i] IN {units} AND i > 1 AND (regexp_matches(cores[i - 1], '{D.NUMBER}') OR lower(cores[i - 1]) IN {numbers}) THEN '<unit>'
    ELSE cores[i] END) AS canon FROM {name}_c)"""


OP3 = f"""WITH {_templates("t", "documents", "doc_id")},
{_templates("b", "benchmark", "item_id")},
tw AS (SELECT id, text, cores, i AS place, array_to_string(canon[i:i + 4], ' ') AS win FROM t, unnest(range(1, len(canon) - 3)) x(i)),
bw AS (SELECT id, text, i AS place, array_to_string(canon[i:i + 4], ' ') AS win FROM b, unnest(range(1, len(canon) - 3)) x(i)
  WHERE len(list_filter(canon[i:i + 4], lambda c: NOT starts_with(c, '<'))) >= 3),
totals AS (SELECT id, text, count(*) AS n_windows FROM bw GROUP BY ALL),
lines AS (SELECT tw.id AS doc_id, tw.text AS doc_text, bw.id AS item_id, bw.text AS item_text, tw.place - bw.place AS shift, list_distinct(list(bw.place)) AS places
  FROM tw JOIN bw USING (win) GROUP BY ALL),
pairs AS (SELECT doc_id, doc_text, item_id, item_text, len(list_distinct(flatten(list(places)))) AS n_matched,
  arg_max({{'shift': shift, 'places': places}}, len(places) * 1000000000 - shift) AS best FROM lines GROUP BY ALL),
enough AS (SELECT p.*, n_windows FROM pairs p JOIN totals t ON t.id IS NOT DISTINCT FROM p.item_id AND t.text = p.item_text WHERE n_matched >= n_windows * 0.5),
slots AS (SELECT e.*, b.cores AS ic, t.cores AS dc, list_filter(list_distinct(flatten(list_transform(best.places, lambda p: range(p, p + 5)))), lambda p: starts_with(b.canon[p], '<')) AS s
  FROM enough e JOIN b ON b.id IS NOT DISTINCT FROM e.item_id AND b.text = e.item_text JOIN t ON t.id IS NOT DISTINCT FROM e.doc_id AND t.text = e.doc_text),
vals AS (SELECT *, list_transform(s, lambda p: lower(ic[p])) AS a, list_transform(s, lambda p: lower(dc[p + best.shift])) AS z FROM slots),
judged AS (SELECT *, len(list_distinct(list_transform(range(1, len(s) + 1), lambda k: a[k] || ' ' || z[k]))) AS kinds FROM vals)
SELECT doc_id, item_id, CAST(n_windows AS BIGINT) AS n_windows, CAST(n_matched AS BIGINT) AS n_matched, CAST(len(s) AS BIGINT) AS n_slots,
  CAST(len(list_filter(range(1, len(s) + 1), lambda k: a[k] <> z[k])) AS BIGINT) AS changed_slots,
  kinds = len(list_distinct(a)) AND kinds = len(list_distinct(z)) AS consistent,
  kinds = len(list_distinct(a)) AND kinds = len(list_distinct(z)) AS contaminated FROM judged"""

OP11 = r"""WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS n FROM d GROUP BY t)
SELECT doc_id, keep_id, CAST(n AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)"""



def _vector_codes(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    near = """a{r} AS MATERIALIZED (SELECT rid, label, vec_id, v.p, any_value(v.x) AS x, min(d * 1000 + e) % 1000 AS e, min(d) AS d FROM (
  SELECT v.*, c.e, list_sum(list_transform(range(1, len(v.x) + 1), lambda i: (v.x[i] - c.c[i]) * (v.x[i] - c.c[i]))) AS d FROM v JOIN c{r} c ON v.p = c.p) v GROUP BY rid, label, vec_id, v.p)"""
    mean = """s{r} AS MATERIALIZED (SELECT p, e, list(t ORDER BY i) AS t, any_value(n) AS n FROM (
  SELECT p, e, i, CAST(sum(x[i]) AS BIGINT) AS t, count(*) AS n FROM a{r}, unnest(range(1, len(x) + 1)) u(i) GROUP BY p, e, i) GROUP BY p, e),
c{n} AS MATERIALIZED (SELECT c.p, c.e, CASE WHEN s.n IS NULL THEN c.c ELSE list_transform(s.t, lambda z: (z - ((z % s.n) + s.n) % s.n) // s.n) END AS c
  FROM c{r} c LEFT JOIN s{r} s ON c.p = s.p AND c.e = s.e)"""
    steps = [near.format(r=0)]
    for r in range(rounds):
        steps += [mean.format(r=r, n=r + 1), near.format(r=r + 1)]
    cut = f"x[p * len(x) // {parts} + 1 : (p + 1) * len(x) // {parts}]"
    return f"""WITH w AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (SELECT rid, vec_id, label, p, {cut} AS x FROM w, unnest(range({parts})) u(p)),
c0 AS MATERIALIZED (SELECT p, e, {cut} AS c FROM (SELECT x, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM w), unnest(range({parts})) u(p) WHERE e < {entries}),
{", ".join(steps)},
o AS (SELECT rid, vec_id, label, string_agg(lower(lpad(to_hex(e), 2, '0')), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY rid, vec_id, label),
l AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM o GROUP BY label),
b AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, code, error, label_error, codebooks_sha256 FROM o JOIN l ON o.label IS NOT DISTINCT FROM l.label, b"""


SQL = {"op1_ngram_jaccard": OP1, "op3_benchmark_decontamination": OP3, "op8_warc": OP8, "op11_exact_dedup": OP11, "op12_vector_codes": _vector_codes()}
