"""SQL text for the checks of the text operators (tokens, attribute hits, pair scores)."""

from __future__ import annotations

from plumbline.functions import lexicon as L


def quoted(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def spelled(t: str) -> str:
    return f"CASE {t} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in L.SPELLING.items()) + f" ELSE {t} END"


def stem(s: str) -> str:
    def ends(*suffixes):
        return "(" + " OR ".join(f"ends_with({s}, '{x}')" for x in suffixes) + ")"

    def cut(n):
        return f"left({s}, length({s}) - {n})"

    size = f"length({s})"
    return f"""CASE WHEN {size} > 6 AND {ends('ations')} THEN {cut(6)} WHEN {size} > 5 AND {ends('ation')} THEN {cut(5)}
      WHEN {size} > 5 AND {ends('ities')} THEN {cut(5)} || 'y' WHEN {size} > 4 AND {ends('ity')} THEN {cut(3)}
      WHEN {size} > 5 AND {ends('ness')} THEN {cut(4)} WHEN {size} > 5 AND {ends('ive')} THEN {cut(3)} WHEN {size} > 5 AND {ends('ing')} THEN {cut(3)}
      WHEN {size} > 4 AND {ends('ed')} THEN CASE WHEN ends_with({cut(2)}, 'c') THEN {cut(2)} || 'e' ELSE {cut(2)} END
      WHEN {size} > 4 AND {ends('ches', 'shes', 'sses', 'xes', 'zes')} THEN {cut(2)} WHEN {size} > 3 AND {ends('es')} THEN {cut(1)}
      WHEN {size} > 3 AND {ends('s')} THEN {cut(1)} ELSE {s} END"""


def tokens(name: str, source: str, key: str, text: str) -> str:
    """CTEs ending in ``name(key, tok)``: the distinct token set of each text."""
    stop = quoted(L.STOP_TOKENS)
    return f"""{name}_r AS (SELECT DISTINCT {key}, unnest(regexp_extract_all(lower(replace({text}, '_', ' ')), '[a-z0-9]+')) AS raw FROM {source}),
{name}_s AS (SELECT {key}, {spelled('raw')} AS s FROM {name}_r WHERE length(raw) > 1 AND raw NOT IN {stop}),
{name}_t AS (SELECT {key}, {stem('s')} AS t FROM {name}_s),
{name} AS (SELECT DISTINCT {key}, {spelled('t')} AS tok FROM {name}_t WHERE length({spelled('t')}) > 1 AND {spelled('t')} NOT IN {stop})"""


LEXICON = (
    "lex_raw AS (SELECT * FROM (VALUES "
    + ", ".join(f"('{a}', '{t}')" for a, terms in L.ATTRIBUTES.items() for t in terms)
    + ") v(attr, raw)), lex AS (SELECT DISTINCT attr, "
    + spelled(f"({stem('(' + spelled('raw') + ')')})")
    + " AS term FROM lex_raw), weak AS (SELECT DISTINCT "
    + spelled(f"({stem('w')})")
    + " AS term FROM (SELECT unnest(["
    + ", ".join(f"'{w}'" for w in L.WEAK_TOKENS)
    + "]) AS w))"
)


def hits(name: str, toks: str, key: str) -> str:
    return f"{name} AS (SELECT {key}, attr, tok FROM {toks} JOIN lex ON tok = term)"


def overlap(name: str, pairs: str, left: str, lkey: str, right: str, rkey: str) -> str:
    """``name(lkey, rkey, attrs, terms, listing)`` over the pairs whose attribute sets meet."""
    return f"""{name}_u AS (
  SELECT p.{lkey}, p.{rkey}, l.attr, l.tok FROM {pairs} p JOIN {left} l ON l.{lkey} = p.{lkey}
    WHERE EXISTS (SELECT 1 FROM {right} r WHERE r.{rkey} = p.{rkey} AND r.attr = l.attr)
  UNION SELECT p.{lkey}, p.{rkey}, r.attr, r.tok FROM {pairs} p JOIN {right} r ON r.{rkey} = p.{rkey}
    WHERE EXISTS (SELECT 1 FROM {left} l WHERE l.{lkey} = p.{lkey} AND l.attr = r.attr)),
{name}_a AS (SELECT {lkey}, {rkey}, attr, count(*) AS n, string_agg(tok, ', ' ORDER BY tok) AS toks FROM {name}_u GROUP BY ALL),
{name} AS (SELECT {lkey}, {rkey}, count(*) AS attrs, CAST(sum(n) AS BIGINT) AS terms, string_agg(attr || '(' || toks || ')', '; ' ORDER BY attr) AS listing FROM {name}_a GROUP BY ALL)"""


def shared(name: str, pairs: str, left: str, lkey: str, right: str, rkey: str) -> str:
    """``name(lkey, rkey, strong, weak, toks)``: shared tokens of the pairs."""
    return f"""{name} AS (SELECT p.{lkey}, p.{rkey}, count(*) FILTER (l.tok NOT IN (SELECT term FROM weak)) AS strong,
  count(*) FILTER (l.tok IN (SELECT term FROM weak)) AS weak, string_agg(l.tok, ',' ORDER BY l.tok) AS toks,
  string_agg(l.tok, ',' ORDER BY l.tok) FILTER (l.tok NOT IN (SELECT term FROM weak)) AS strong_toks
  FROM {pairs} p JOIN {left} l ON l.{lkey} = p.{lkey} JOIN {right} r ON r.{rkey} = p.{rkey} AND r.tok = l.tok GROUP BY ALL)"""


def consensus(channels: list[str], visual: str | None, graph: str | None, terms: str) -> str:
    """Two channels, or only the attribute channels with enough terms (no encoder)."""
    count = " + ".join(f"CAST({c} AS INTEGER)" for c in channels)
    others = " OR ".join(c for c in channels if c not in (visual, graph)) or "false"
    only_graph = f"(({count}) = 1 AND {graph} AND {terms} >= 2)" if graph else "false"
    return f"(({count}) >= 2 OR (NOT ({others}) AND {terms} >= 3) OR {only_graph})"


NEG, RESET = quoted(L.NEGATIONS), quoted(L.RESETS)


def affirmed(name: str, source: str, key: str, text: str, targets) -> str:
    """``name(key, yes)``: an anomaly word of ``targets`` outside a negated span."""
    return f"""{name}_w AS (SELECT {key}, unnest(range(len(w))) AS i, unnest(w) AS raw FROM (
   SELECT {key}, regexp_extract_all({text}, '[a-z0-9]+') AS w FROM {source})),
{name}_s AS (SELECT {key}, i, {spelled('raw')} AS s FROM {name}_w), {name}_t AS (SELECT {key}, i, {stem('s')} AS t FROM {name}_s),
{name}_n AS (SELECT {key}, i, {spelled('t')} AS tok FROM {name}_t),
{name}_c AS (SELECT {key}, tok, max(CASE WHEN tok IN {NEG} THEN i END) OVER w AS neg, max(CASE WHEN tok IN {RESET} THEN i END) OVER w AS reset,
   max(CASE WHEN tok IN {quoted(L.BENIGN_HOLE_WORDS)} THEN 1 END) OVER v AS benign FROM {name}_n
   WINDOW w AS (PARTITION BY {key} ORDER BY i ROWS BETWEEN 18 PRECEDING AND 1 PRECEDING), v AS (PARTITION BY {key} ORDER BY i ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)),
{name} AS (SELECT {key}, bool_or(tok IN {quoted(targets)} AND NOT (tok = 'hole' AND coalesce(benign, 0) = 1) AND NOT (neg IS NOT NULL AND neg > coalesce(reset, -1))) AS yes FROM {name}_c GROUP BY {key})"""
