"""SQL that computes the registered queries' results in another engine."""

from __future__ import annotations

from folioline.operators import gate, grouping, listings, requests, templates
from folioline.plans import views
from folioline.sources.tables import (
    LARGE_MODEL,
    MEDIUM_MODEL,
    MODEL_RATES,
    SMALL_MODEL,
    TIER_MODELS,
)


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values: list[str]) -> str:
    return "[" + ", ".join(_text(v) for v in values) + "]"


def _gap(x: str, digits: int) -> str:
    """Midpoint minus value, times 2 * 10^digits, exact in this order."""
    twice = 2 * 10**digits
    terms = [1 << b for b in range(twice.bit_length() - 1, -1, -1) if twice >> b & 1]
    steps = "".join(f" - {t}::DOUBLE * ({x})" for t in terms)
    return f"((2 * floor(({x}) * {10**digits}::DOUBLE) + 1){steps})"


def _round(x: str, digits: int = 1) -> str:
    low = f"floor(({x}) * {10**digits}::DOUBLE)"
    gap = _gap(x, digits)
    return (
        f"((CASE WHEN {gap} < 0 THEN {low} + 1 WHEN {gap} > 0 THEN {low} "
        f"ELSE {low} + (CAST({low} AS BIGINT) % 2) END) / {10**digits}::DOUBLE)"
    )


def _fixed(x: str, digits: int) -> str:
    whole = (
        f"CAST(floor(({x}) * {10**digits}::DOUBLE) + "
        f"(CASE WHEN {_gap(x, digits)} <= 0 THEN 1 ELSE 0 END) AS BIGINT)"
    )
    return (
        f"(({whole} // {10**digits})::VARCHAR || '.' || "
        f"lpad(({whole} % {10**digits})::VARCHAR, {digits}, '0'))"
    )


def _tier(score: str) -> str:
    return (
        f"CASE WHEN {score} > 80 THEN 'clear' WHEN {score} >= 50 THEN 'blurry' "
        "ELSE 'very_blurry' END"
    )


_MEAN_TENTHS = "(CAST(sum(CAST(round(quality_score * 10) AS BIGINT)) AS DOUBLE) / 10::DOUBLE) / count(*)"

_DOC_PAGES = """
dp AS (
  SELECT doc_id, source || '.pdf' AS document, source AS stem, text,
         row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page,
         count(*) OVER (PARTITION BY source) AS page_count
  FROM documents)"""

_WORDS = """
raw_words AS (
  SELECT doc_id, unnest(string_split_regex(text, '[ \\t\\r\\n]+')) AS word,
         generate_subscripts(string_split_regex(text, '[ \\t\\r\\n]+'), 1) AS word_no
  FROM documents),
words AS (
  SELECT doc_id, length(regexp_replace(word, '\\s+', '', 'g')) AS chars,
         CASE WHEN (doc_id + word_no) % 97 = 0 THEN NULL
              ELSE doc_id * 37 % 101 - 20 + word_no * 17 % 41 END AS c
  FROM raw_words),
good AS (SELECT doc_id, chars, least(c, 100) AS c FROM words WHERE chars > 0 AND c >= 0),
sums AS (
  SELECT doc_id, count(*) AS n, sum(chars) AS ch,
         count(*) FILTER (c >= 30) AS rn, sum(chars) FILTER (c >= 30) AS rch,
         sum(c * chars) FILTER (c >= 30) AS weighted
  FROM good GROUP BY doc_id),
mean AS (
  SELECT d.doc_id, coalesce(weighted::DOUBLE / rch::DOUBLE, 0::DOUBLE) AS mean,
         coalesce(n, 0)::DOUBLE AS n, coalesce(ch, 0)::DOUBLE AS ch,
         coalesce(rn, 0)::DOUBLE AS rn, coalesce(rch, 0)::DOUBLE AS rch
  FROM documents d LEFT JOIN sums s USING (doc_id)),
raw_score AS (
  SELECT *, least(mean * least(1::DOUBLE, rch / 120::DOUBLE), 100::DOUBLE) AS raw FROM mean),
quality AS (
  SELECT doc_id, {score} AS quality_score, n, ch, rn, rch, {mean} AS mean FROM raw_score)""".format(
    score=_round("raw"), mean=_round("mean")
)

_ROUTE = (
    "CASE "
    + _tier("quality_score")
    + "".join(f" WHEN {_text(t)} THEN {_text(m)}" for t, m in TIER_MODELS.items())
    + " END"
)

_NORMALIZED = (
    "trim(regexp_replace(regexp_replace(translate(lower(strip_accents({x})), '-_01', '  ol'), "
    "'[^\\p{{L}}\\p{{N}}\\s]', '', 'g'), '\\s+', ' ', 'g'))"
)


_PAGE_TEXT = "CASE WHEN doc_id % 53 = 0 THEN ' ' || chr(10) ELSE text END"


def _gate_cte() -> str:
    text = _PAGE_TEXT
    branches = "".join(
        f" WHEN contains(norm, ' {norm} ') THEN {_text(marker)}"
        for marker, norm in zip(
            views.EXACT_MARKERS, ["licensed under", "mit license", "all rights reserved"]
        )
    )
    return f"""
normed AS (
  SELECT doc_id, {text} AS page_text,
         ' ' || {_NORMALIZED.format(x=text)} || ' ' AS norm FROM documents),
hits AS (
  SELECT doc_id, trim(page_text, ' ' || chr(9) || chr(10) || chr(13)) = '' AS blank,
         CASE{branches} END AS marker FROM normed),
gate AS (
  SELECT doc_id,
    CASE WHEN blank THEN 'unclear' WHEN marker IS NOT NULL THEN 'yes' ELSE 'no' END AS verdict,
    CASE WHEN NOT blank AND marker IS NOT NULL THEN 'matched ''' || marker || '''' ELSE '' END
      AS raw_reply,
    CASE WHEN blank THEN {_text(gate.REASON_BLANK)}
         WHEN marker IS NOT NULL
         THEN 'no_need_page field ''' || marker || ''' matched (similarity 1.00)'
         ELSE {_text(gate.REASON_NO_MATCH)} END AS reason
  FROM hits)"""


_GATE = _gate_cte()

# Matching blocks are found by recursion: the longest common one, then what is left and right of it.
def _fuzzy_gate(markers: str, text: str) -> str:
    return f"""WITH RECURSIVE
{markers},
pages AS (SELECT doc_id, {text} AS page_text FROM documents),
normed AS (
  SELECT doc_id, coalesce(trim(page_text, ' ' || chr(9) || chr(10) || chr(13)), '') = '' AS blank,
         {_NORMALIZED.format(x='page_text')} AS norm FROM pages),
exact AS (
  SELECT doc_id, min(ord) AS ord FROM normed JOIN markers m
  ON contains(' ' || normed.norm || ' ', ' ' || m.norm || ' ') WHERE NOT blank GROUP BY doc_id),
tokens AS (
  SELECT doc_id, string_split(norm, ' ') AS w FROM normed
  WHERE NOT blank AND norm <> '' AND doc_id NOT IN (SELECT doc_id FROM exact)),
chunks AS (
  SELECT DISTINCT doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS chunk
  FROM tokens, (SELECT DISTINCT k FROM markers)),
-- A ratio is 2 m / (la + lb), with m at most the smaller count of each letter: nothing below 0.85 stays.
pairs AS (
  SELECT ord, m.norm AS a, c.chunk AS b FROM markers m JOIN (SELECT DISTINCT k, chunk FROM chunks) c USING (k)
  WHERE length(c.chunk) BETWEEN floor(length(m.norm) * 0.85 / 1.15) AND ceil(length(m.norm) * 1.15 / 0.85)
    AND 2 * list_sum(list_transform(list_distinct(string_split(m.norm, '')),
          lambda x: least(length(m.norm) - length(replace(m.norm, x, '')), length(c.chunk) - length(replace(c.chunk, x, '')))))
        >= 0.85 * (length(m.norm) + length(c.chunk)) - 1e-9),
-- The longest common block, first in the marker, then in the chunk; then the same left and right of it.
blocks AS (
  SELECT ord, a, b, 1 AS alo, length(a) + 1 AS ahi, 1 AS blo, length(b) + 1 AS bhi, 0 AS size, 0 AS i, 0 AS j FROM pairs
  UNION ALL
  SELECT ord, a, b, alo, ahi, blo, bhi, best.size, -best.i, -best.j FROM (
    SELECT ord, a, b, alo, ahi, blo, bhi,
      list_max(flatten(flatten(list_transform(range(alo, ahi), lambda i: list_transform(range(blo, bhi), lambda j:
        list_transform(list_filter(range(1, least(ahi - i, bhi - j) + 1), lambda n: substr(a, i, n) = substr(b, j, n)),
          lambda n: {{'size': n, 'i': -i, 'j': -j}})))))) AS best
    FROM (
      SELECT ord, a, b, unnest([
        {{'alo': CASE WHEN size = 0 THEN alo ELSE alo END, 'ahi': CASE WHEN size = 0 THEN ahi ELSE i END,
          'blo': blo, 'bhi': CASE WHEN size = 0 THEN bhi ELSE j END}},
        {{'alo': CASE WHEN size = 0 THEN ahi ELSE i + size END, 'ahi': ahi,
          'blo': CASE WHEN size = 0 THEN bhi ELSE j + size END, 'bhi': bhi}}], recursive := true)
      FROM blocks) WHERE alo < ahi AND blo < bhi) WHERE best IS NOT NULL),
ratios AS (SELECT ord, b AS chunk, 2 * sum(size)::DOUBLE / (length(a) + length(b)) AS ratio FROM blocks GROUP BY ord, a, b),
best AS (
  SELECT doc_id, arg_max({{'ord': r.ord, 'ratio': ratio}}, {{'ratio': ratio, 'first': -r.ord}}) AS top
  FROM chunks c JOIN markers m USING (k) JOIN ratios r ON r.ord = m.ord AND r.chunk = c.chunk
  WHERE ratio >= 0.85 GROUP BY doc_id),
found AS (
  SELECT n.doc_id, blank, coalesce(e.ord, top.ord) AS ord,
         CASE WHEN e.ord IS NOT NULL THEN '1.00' ELSE printf('%.2f', top.ratio) END AS ratio
  FROM normed n LEFT JOIN exact e USING (doc_id) LEFT JOIN best USING (doc_id))
SELECT doc_id,
  CASE WHEN blank THEN 'unclear' WHEN marker IS NOT NULL THEN 'yes' ELSE 'no' END AS verdict,
  CASE WHEN NOT blank AND marker IS NOT NULL THEN 'matched ''' || marker || '''' ELSE '' END AS raw_reply,
  CASE WHEN blank THEN 'page has no OCR text (unreadable)'
       WHEN marker IS NOT NULL
       THEN 'no_need_page field ''' || marker || ''' matched (similarity ' || ratio || ')'
       ELSE 'no no_need_page field matched' END AS reason
FROM found LEFT JOIN markers USING (ord)"""


_FUZZY_GATE = _fuzzy_gate(
    """markers(ord, marker, norm, k) AS (VALUES
  (0, 'licenced under', 'licenced under', 2), (1, 'MIT license', 'mit license', 2),
  (2, 'all right reserved', 'all right reserved', 3))""",
    _PAGE_TEXT,
)
_FUZZY_GATE_MANY = _fuzzy_gate(
    f"""firsts AS (
  SELECT row_number() OVER (ORDER BY item_id) - 1 AS ord,
         array_to_string(regexp_extract_all(text, '[^ \\t\\r\\n]+')[1:3], ' ') AS marker
  FROM benchmark WHERE text IS NOT NULL),
markers AS (
  SELECT ord, marker, norm, len(string_split(norm, ' ')) AS k
  FROM (SELECT ord, marker, {_NORMALIZED.format(x='marker')} AS norm FROM firsts) WHERE norm <> '')""",
    "text",
)
_EXACT_GATE_MANY = f"""
WITH parts AS (
  SELECT item_id, unnest(string_split(text, '.')) AS part, generate_subscripts(string_split(text, '.'), 1) AS place
  FROM benchmark WHERE text IS NOT NULL),
named AS (
  SELECT row_number() OVER (ORDER BY item_id, place) AS ord, trim(part, ' ' || chr(9) || chr(10) || chr(13)) AS marker
  FROM parts),
markers AS (
  SELECT ord, marker, norm FROM (SELECT *, {_NORMALIZED.format(x='marker')} AS norm FROM named) WHERE norm <> ''),
normed AS (
  SELECT doc_id, coalesce(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '') = '' AS blank,
         ' ' || {_NORMALIZED.format(x='text')} || ' ' AS norm FROM documents),
hits AS (
  SELECT doc_id, min(ord) AS ord FROM normed JOIN markers m ON contains(normed.norm, ' ' || m.norm || ' ')
  WHERE NOT blank GROUP BY doc_id)
SELECT doc_id,
  CASE WHEN blank THEN 'unclear' WHEN ord IS NOT NULL THEN 'yes' ELSE 'no' END AS verdict,
  coalesce('matched ''' || marker || '''', '') AS raw_reply,
  CASE WHEN blank THEN 'page has no OCR text (unreadable)'
       ELSE coalesce('no_need_page field ''' || marker || ''' matched (similarity 1.00)', 'no no_need_page field matched')
  END AS reason
FROM normed LEFT JOIN hits USING (doc_id) LEFT JOIN markers USING (ord)"""

_MODEL = (
    "CASE WHEN l_quantity = 1 THEN '' WHEN l_quantity = 2 THEN 'unknown/model' "
    f"WHEN l_returnflag = 'A' THEN {_text(SMALL_MODEL)} "
    f"WHEN l_returnflag = 'N' THEN {_text(MEDIUM_MODEL)} ELSE {_text(LARGE_MODEL)} END"
)

_LINES = f"""
lines AS (
  SELECT l_orderkey::VARCHAR || '.pdf' AS document, l_orderkey::VARCHAR AS stem,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
           l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus
         ) AS page,
         count(*) OVER (PARTITION BY l_orderkey) AS page_count,
         ((l_partkey * 7 + l_suppkey) % 1001)::DOUBLE / 10::DOUBLE AS quality_score,
         CASE WHEN l_quantity < 12 THEN NULL ELSE l_returnflag END AS value,
         {_MODEL} AS model, l_partkey AS input_tokens, l_suppkey AS output_tokens,
         l_quantity / 4 AS processing_time, l_discount > 0.02 AS success,
         CASE WHEN NOT l_discount > 0.02 THEN 'TimeoutError: part ' || l_partkey END AS error,
         CASE WHEN l_quantity >= 8 THEN l_returnflag END AS flag,
         CASE WHEN l_quantity < 20 THEN ' ' ELSE l_linestatus END AS status,
         CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
         CAST(l_partkey % 101 AS INT) AS confidence
  FROM lineitem)"""

_GROUPS = f"""{_LINES},
near AS (
  SELECT *, last_value(value IGNORE NULLS) OVER (PARTITION BY document ORDER BY page
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
            first_value(value IGNORE NULLS) OVER (PARTITION BY document ORDER BY page
              ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after
  FROM lines),
run AS (
  SELECT *, sum(CASE WHEN value IS NOT NULL AND value IS DISTINCT FROM before THEN 1 ELSE 0 END)
              OVER (PARTITION BY document ORDER BY page) AS segment
  FROM near),
firsts AS (
  SELECT document, value, min(segment) AS segment FROM run WHERE value IS NOT NULL
  GROUP BY document, value),
numbered AS (
  SELECT document, segment, row_number() OVER (PARTITION BY document ORDER BY segment) AS idx
  FROM firsts),
grouped AS (
  SELECT r.*, CASE WHEN r.value IS NOT NULL OR r.before = r.after THEN n.idx END AS document_index
  FROM run r LEFT JOIN numbered n USING (document, segment))"""

_COST = "decimal(38,12)"


def _rates(alias: str = "model") -> tuple[str, str]:
    sides = []
    for side in (0, 1):
        cases = "".join(f" WHEN {_text(m)} THEN {r[side]}::DOUBLE" for m, r in MODEL_RATES.items())
        sides.append(f"(CASE {alias}{cases} ELSE 0::DOUBLE END)")
    return sides[0], sides[1]


_IN, _OUT = _rates()


def _priced(source: str, keys: str) -> str:
    return f"""
priced AS (
  SELECT {keys}model, it AS input_tokens, ot AS output_tokens,
         it * {_IN} / 1000000 AS input_cost, ot * {_OUT} / 1000000 AS output_cost,
         it * {_IN} / 1000000 + ot * {_OUT} / 1000000 AS total_cost,
         {_IN} AS input_rate, {_OUT} AS output_rate
  FROM (SELECT {keys}model, sum(input_tokens)::BIGINT AS it, sum(output_tokens)::BIGINT AS ot
        FROM {source} WHERE model <> '' GROUP BY {keys}model))"""


_MONEY_SUMS = ", ".join(
    f"sum({c}::{_COST})::DOUBLE AS {c}" for c in ("input_cost", "output_cost", "total_cost")
)
_TOKEN_SUMS = (
    "sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens"
)

_ORDER_CALLS = f"""
calls AS (
  SELECT l_orderkey::VARCHAR || '.pdf' AS document, {_MODEL} AS model,
         l_partkey AS input_tokens, l_suppkey AS output_tokens FROM lineitem)"""

_ORDER_COSTS = f"{_ORDER_CALLS},{_priced('calls', 'document, ')}"

_STRUCT = "document, document_index"

_MERGED = f"""{_GROUPS},
fields AS (
  SELECT document, document_index, page, 0 AS ord, 'flag' AS name, flag AS value,
         'STRING' AS kind, confidence FROM grouped WHERE document_index IS NOT NULL
  UNION ALL
  SELECT document, document_index, page, 1, 'status', nullif(status, ' '), 'STRING', confidence
  FROM grouped WHERE document_index IS NOT NULL
  UNION ALL
  SELECT document, document_index, page, 2, 'cents', cents::VARCHAR, 'BIGINT', confidence
  FROM grouped WHERE document_index IS NOT NULL
  UNION ALL
  SELECT DISTINCT document, document_index, NULL::BIGINT, NULL::INT, 'due_date', NULL::VARCHAR,
         'VOID', 0 FROM grouped WHERE document_index IS NOT NULL),
merged AS (
  SELECT document, document_index,
         (CASE name WHEN 'status' THEN 1 WHEN 'flag' THEN 2 WHEN 'due_date' THEN 3 ELSE 4 END)
           ::BIGINT AS field_no,
         name, arg_min(value, page) FILTER (value IS NOT NULL) AS value,
         coalesce(arg_min(kind, page) FILTER (value IS NOT NULL), 'VOID') AS value_kind,
         coalesce(arg_min(confidence, page) FILTER (value IS NOT NULL), 0) AS confidence
  FROM fields GROUP BY document, document_index, name),
shown AS (
  SELECT *, CASE value_kind WHEN 'STRING' THEN '"' || value || '"' ELSE value END AS json
  FROM merged)"""

_DOCUMENTS = f"""{_MERGED},
inside AS (SELECT * FROM grouped WHERE document_index IS NOT NULL),
heads AS (
  SELECT {_STRUCT}, 'invoice-' || document_index || '.pdf' AS file, count(*) AS page_count,
         {_MEAN_TENTHS} AS mean_score,
         sum(processing_time::DECIMAL(28,6))::DOUBLE AS seconds,
         bool_or(success) AS extraction_success,
         string_agg(page::VARCHAR, ',' ORDER BY page) AS pages,
         string_agg('page ' || page || ': ' || error, ';' ORDER BY page)
           FILTER (error IS NOT NULL) AS errors,
         count(error) AS error_count
  FROM inside GROUP BY {_STRUCT}),
model_order AS (
  SELECT {_STRUCT}, model, min(page) AS first_page FROM inside WHERE model <> ''
  GROUP BY {_STRUCT}, model),
models AS (
  SELECT {_STRUCT}, string_agg(model, ',' ORDER BY first_page) AS models_used
  FROM model_order GROUP BY {_STRUCT}),
{_priced('inside', _STRUCT + ', ').strip()},
totals AS (
  SELECT {_STRUCT}, {_TOKEN_SUMS}, {_MONEY_SUMS} FROM priced GROUP BY {_STRUCT}),
sheets AS (
  SELECT {_STRUCT}, string_agg(name, ',' ORDER BY field_no) AS field_names,
         string_agg(coalesce(json, 'null'), ',' ORDER BY field_no) AS field_values,
         string_agg(confidence::VARCHAR, ',' ORDER BY field_no) AS field_scores,
         {_round("sum(confidence)::DOUBLE / count(*)")} AS confidence_score
  FROM merged m JOIN (SELECT {_STRUCT}, name, json FROM shown) USING ({_STRUCT}, name)
  GROUP BY {_STRUCT}),
docs AS (
  SELECT h.document, h.file, h.page_count, {_round("mean_score")} AS quality_score,
         {_tier(_round("mean_score"))} AS quality_tier, s.confidence_score,
         h.extraction_success, {_round("seconds", 2)} AS processing_time_seconds,
         h.pages, coalesce(m.models_used, '') AS models_used, h.errors, h.error_count,
         s.field_names, s.field_values, s.field_scores,
         coalesce(t.input_tokens, 0) AS input_tokens,
         coalesce(t.output_tokens, 0) AS output_tokens,
         coalesce(t.total_cost, 0) AS total_cost, document_index
  FROM heads h LEFT JOIN models m USING ({_STRUCT}) LEFT JOIN totals t USING ({_STRUCT})
  LEFT JOIN sheets s USING ({_STRUCT}))"""

_REPLY_BODY = (
    "'{\"user\":{\"value\":' || user_id || ',\"confidence\":\"90\"},\"k\":{\"value\":\"' || "
    "json_extract_string(props, '$.k') || '\",\"confidence\":' || (event_id % 103) || "
    "'},\"type\":\"' || event_type || '\",\"note\":{\"value\":null,\"confidence\":true}}'"
)

_FIELD_ROWS = """
entries AS (
  SELECT document, page, body, unnest(list_distinct_ordered) AS name,
         generate_subscripts(list_distinct_ordered, 1) - 1 AS ord
  FROM (SELECT *, json_keys(body) AS list_distinct_ordered FROM objects)),
split AS (
  SELECT document, page, ord, name, json_extract(body, '$."' || name || '"') AS entry
  FROM entries),
inner_values AS (
  SELECT document, page, ord, name,
         CASE WHEN json_type(entry) = 'OBJECT' AND list_contains(json_keys(entry), 'value')
              THEN json_extract(entry, '$.value') ELSE entry END AS v,
         CASE WHEN json_type(entry) = 'OBJECT' AND list_contains(json_keys(entry), 'value')
              THEN json_extract(entry, '$.confidence') END AS c
  FROM split),
parsed AS (
  SELECT document, page, ord::INT AS ord, name,
         CASE json_type(v) WHEN 'VARCHAR' THEN json_extract_string(v, '$')
              WHEN 'NULL' THEN NULL ELSE v::VARCHAR END AS value,
         CASE json_type(v) WHEN 'VARCHAR' THEN 'STRING' WHEN 'NULL' THEN 'VOID'
              WHEN 'UBIGINT' THEN 'BIGINT' ELSE json_type(v) END AS value_kind,
         CASE WHEN json_type(c) = 'BOOLEAN' THEN (c::VARCHAR = 'true')::INT
              WHEN json_type(c) IN ('UBIGINT', 'BIGINT', 'DOUBLE')
                AND c::VARCHAR::DOUBLE BETWEEN 0 AND 100
              THEN floor(c::VARCHAR::DOUBLE)::INT ELSE 0 END AS confidence
  FROM inner_values)"""

_REPLIES = f"""
objects AS (
  SELECT user_id::VARCHAR AS document, event_id AS page, {_REPLY_BODY} AS body
  FROM events WHERE event_id % 4 <> 3),{_FIELD_ROWS}"""


def _edge_replies() -> str:
    value = f"replace({_list(views.EDGE_VALUES)}[event_id % 6 + 1], '{{k}}', json_extract_string(props, '$.k'))"
    conf = f"{_list(views.EDGE_CONFIDENCES)}[event_id % 8 + 1]"
    # The repeated key keeps its place and its last value.
    return f"""
objects AS (
  SELECT user_id::VARCHAR AS document, event_id AS page,
         '{{"b":{{"other":1}},"a":{{"value":' || {value} || {conf} || '}},"plain":' || {value} || '}}'
           AS body
  FROM events),{_FIELD_ROWS}"""


_BUCKET = f"{_list(views.BUCKETS)}[page_id % 4 + 1]"
_FOLDER = (
    "CASE WHEN page_id % 4 <> 0 AND (page_id // 4) % 2 = 0 THEN 'd' || (page_id // 20) "
    "|| CASE WHEN page_id % 11 = 0 THEN '/inner' ELSE '' END ELSE '' END"
)
_STEM = "'p' || page_id"

_FILES = f"""
files AS (
  SELECT {_BUCKET} AS bucket, {_FOLDER} AS folder,
         {_STEM} || {_list(views.SUFFIXES)}[page_id % 5 + 1] AS name, {_STEM} AS stem,
         length(url)::BIGINT AS size, page_id FROM pages
  UNION ALL
  SELECT {_BUCKET}, {_FOLDER}, {_STEM} || '.json', {_STEM}, length(url)::BIGINT, page_id
  FROM pages WHERE page_id % 3 <> 0)"""

_RECORDS = f"""
records AS (
  SELECT {_BUCKET} AS bucket, {_FOLDER} AS folder, {_STEM} AS stem, page_id,
         CASE WHEN page_id % 7 = 0 THEN '{{"page":' || page_id WHEN page_id % 7 = 1 THEN '{{}}'
              WHEN page_id % 7 = 2 THEN '[' || page_id || ']'
              WHEN page_id % 7 < 5 THEN '{{"page":' || page_id || ',"cost":{{"by_model":{{}}}}}}'
              ELSE '{{"page":' || page_id || '}}' END AS record
  FROM pages WHERE page_id % 3 <> 0)"""

_REQUESTS = f"""
wanted AS (
  SELECT DISTINCT kind, CASE WHEN kind = 'input' THEN 'input' ELSE b END AS bucket, target FROM (
    SELECT CASE WHEN page_id % 6 < 2 THEN 'page' WHEN page_id % 6 = 2 THEN 'document'
                ELSE 'input' END AS kind, {_BUCKET} AS b,
           CASE page_id % 6 WHEN 0 THEN {_STEM} WHEN 1 THEN 'gone' || page_id
                WHEN 2 THEN 'd' || (page_id // 20) WHEN 3 THEN '../' || {_STEM}
                ELSE {_STEM} || '.pdf' END AS target
    FROM pages)),
matches AS (
  SELECT w.kind, w.bucket, w.target, f.folder, f.name FROM wanted w JOIN files f
  ON w.bucket = f.bucket AND NOT contains(w.target, '/') AND (
    (w.kind = 'input' AND f.folder = '' AND f.name = w.target) OR
    (w.kind = 'document' AND split_part(f.folder, '/', 1) = w.target) OR
    (w.kind = 'page' AND f.folder = ''
       AND f.name IN (w.target || '.png', w.target || '.json'))))"""


def _template_text() -> str:
    text = f"{_list(views.TEMPLATE_TEXTS)}[event_id % {len(views.TEMPLATE_TEXTS)} + 1]"
    return (
        f"nullif(replace(replace({text}, '{{t}}', event_type), '{{k}}', "
        "json_extract_string(props, '$.k')), '')"
    )


def _names(block: str) -> str:
    return (
        f"coalesce(CASE json_type({block}) WHEN 'OBJECT' THEN json_keys({block}) "
        f"WHEN 'ARRAY' THEN json_extract_string({block}, '$[*]') END, []::VARCHAR[])"
    )


_HELPERS = "$.\"multiple-docs\".\"same-words-every-pages\""
_TEMPLATES = f"""
raw AS (
  SELECT event_id AS template_id, {_template_text()} AS template FROM events),
texts AS (
  SELECT template_id, template,
         CASE WHEN json_valid(template) THEN template::JSON END AS t FROM raw),
blocks AS (
  SELECT template_id, template, t,
         CASE WHEN json_type(t) = 'OBJECT' AND list_contains(json_keys(t), 'extracted_fields')
              THEN json_extract(t, '$.extracted_fields') ELSE t END AS e,
         CASE WHEN json_type(t) = 'OBJECT' THEN json_extract(t, '$.no_need_page') END AS n,
         CASE WHEN json_type(t) = 'OBJECT' THEN json_extract(t, '{_HELPERS}') END AS s
  FROM texts),
names AS (
  SELECT template_id, t, e, n, {_names("e")} AS fields, {_names("n")} AS skips,
         {_names("s")} AS helpers FROM blocks)"""


def _json_object(names: str) -> str:
    kept = f"list_filter({names}, lambda x: trim(x) <> '')"
    return (
        f"'{{' || array_to_string(list_transform({kept}, lambda x: '\"' || x || '\":\"\"'), ',') "
        "|| '}'"
    )


def _quoted(names: str) -> str:
    return f"array_to_string(list_transform({names}, lambda x: '\"' || x || '\"'), ', ')"


def _prompt(fields: str, helpers: str) -> str:
    locked = f"len({fields}) > 0"
    extra = f"list_filter({helpers}, lambda x: NOT list_contains({fields}, x))"

    def fill(clause: str, names: str) -> str:
        before, after = clause.split("{fields}")
        return f"{_text(before)} || {_quoted(names)} || {_text(after)}"

    return " || ".join(
        [
            _text(requests.PROMPT_OPENING),
            f"CASE WHEN {locked} THEN {fill(requests.PROMPT_LOCKED, fields)} "
            f"ELSE {_text(requests.PROMPT_FREE)} END",
            f"CASE WHEN len({extra}) > 0 THEN {fill(requests.PROMPT_HELPERS, extra)} ELSE '' END",
            _text(requests.PROMPT_FORMAT),
            _text(requests.PROMPT_GROUNDING),
            f"CASE WHEN {locked} THEN '' ELSE {_text(requests.PROMPT_FREE_RULES)} END",
            _text(requests.PROMPT_CLOSING),
        ]
    )


def _model_request(model: str, text: str) -> str:
    prompt = _prompt("['k', 'type']", "['type', 'batch']")
    return (
        f"'{{\"model\":\"' || {model} || '\",\"messages\":[{{\"role\":\"user\",\"content\":["
        f"{{\"type\":\"text\",\"text\":' || to_json({prompt})::VARCHAR || '}},"
        "{\"type\":\"image_url\",\"image_url\":{\"url\":\"data:image/png;base64,' || "
        f"base64(encode({text})) || '\"}}}}]}}],\"max_tokens\":1000}}'"
    )


_RASTER = """
pixels AS (
  SELECT vec_id, label, p - 1 AS position, (p - 1) % 8 AS x, (p - 1) // 8 AS y,
         CAST(floor((greatest(-0.5::DOUBLE, least(0.5::DOUBLE, v::DOUBLE)) + 0.5::DOUBLE)
           * 255::DOUBLE) AS BIGINT) AS gray
  FROM (SELECT vec_id, label, unnest(embedding) AS v,
               generate_subscripts(embedding, 1) AS p FROM embeddings))"""

_LAPLACIAN = f"""{_RASTER},
near AS (
  SELECT vec_id, gray,
         lag(gray) OVER r AS l, lead(gray) OVER r AS ri, lag(gray) OVER c AS u, lead(gray) OVER c AS d
  FROM pixels WINDOW r AS (PARTITION BY vec_id, y ORDER BY x), c AS (PARTITION BY vec_id, x ORDER BY y)),
lap AS (
  SELECT vec_id, coalesce(l, ri) + coalesce(ri, l) + coalesce(u, d) + coalesce(d, u) - 4 * gray AS v
  FROM near),
sharp AS (
  SELECT vec_id, (count(*) * sum(v * v) - sum(v) * sum(v))::DOUBLE
           / (count(*) * count(*))::DOUBLE AS sharpness FROM lap GROUP BY vec_id)"""

_OTSU = f"""{_LAPLACIAN},
levels AS (
  SELECT vec_id, gray AS level, count(*) AS n, sum(gray) AS s FROM pixels GROUP BY vec_id, gray),
cum AS (
  SELECT vec_id, level, sum(n) OVER w AS below, sum(s) OVER w AS dark,
         sum(n) OVER a AS alln, sum(s) OVER a AS alls
  FROM levels WINDOW w AS (PARTITION BY vec_id ORDER BY level), a AS (PARTITION BY vec_id)),
between_class AS (
  SELECT vec_id, level,
    CASE WHEN below * (alln - below) > 0
      THEN (dark * (alln - below) - (alls - dark) * below)::DOUBLE
         * (dark * (alln - below) - (alls - dark) * below)::DOUBLE
         / (below * (alln - below))::DOUBLE ELSE 0 END AS b FROM cum),
best AS (
  SELECT vec_id, CASE WHEN b > 0 THEN level ELSE 0 END AS level,
         row_number() OVER (PARTITION BY vec_id ORDER BY b DESC, level) AS r
  FROM between_class),
spread AS (
  SELECT vec_id, any_value(label) AS label,
         sqrt((count(*) * sum(gray * gray) - sum(gray) * sum(gray))::DOUBLE
           / (count(*) * count(*))::DOUBLE) AS std FROM pixels GROUP BY vec_id)"""

_ANGLE = "(label - 3)::DOUBLE / 8"


def _page_name(extension: str) -> str:
    return (
        "stem || '_' || lpad(page::VARCHAR, greatest(length(page_count::VARCHAR), "
        f"length(page::VARCHAR))::INT, '0') || '{extension}'"
    )


def _usd(x: str) -> str:
    return (
        f"CASE WHEN {x} = 0 THEN '$0' WHEN {x} < 0.01::DOUBLE THEN '$' || {_fixed(x, 6)} "
        f"WHEN {x} < 1 THEN '$' || {_fixed(x, 4)} ELSE '$' || {_fixed(x, 2)} END"
    )


_META = {
    "document": "document", "file": "file", "page_count": "page_count::VARCHAR",
    "quality_score": "regexp_replace(quality_score::VARCHAR, '\\.0$', '')",
    "quality_tier": "quality_tier", "models_used": "replace(models_used, ',', ', ')",
    "confidence_score": "regexp_replace(confidence_score::VARCHAR, '\\.0$', '')",
    "extraction_success": "extraction_success::VARCHAR",
    "processing_time_seconds": "regexp_replace(processing_time_seconds::VARCHAR, '\\.0$', '')",
}


def _meta_rows() -> str:
    parts = [
        f"SELECT document AS record_document, file AS record_file, {position}::INT AS position, "
        f"{_text(label)} AS label, {_META[column]} AS text FROM docs"
        for position, (column, label) in enumerate(listings.META_LABELS, 1)
        if column in _META
    ]
    return " UNION ALL ".join(parts)


ORACLES: dict[str, str] = {
    "ocr_quality_route": f"""WITH {_DOC_PAGES}, {_WORDS}
SELECT document, page, quality_score, {_tier("quality_score")} AS quality_tier,
       quality_score AS ocr_confidence, n AS ocr_word_count, ch AS ocr_char_count,
       mean AS ocr_mean_confidence, rn AS ocr_readable_word_count, rch AS ocr_readable_char_count,
       {_ROUTE} AS model,
       'tier ''' || {_tier("quality_score")} || ''' (score ' || quality_score || ') -> ' || {_ROUTE}
         AS route_reason
FROM dp JOIN quality USING (doc_id)""",
    "document_quality": f"""WITH {_DOC_PAGES}, {_WORDS},
means AS (SELECT document, {_MEAN_TENTHS} AS m FROM dp JOIN quality USING (doc_id) GROUP BY document)
SELECT document, {_round("m")} AS quality_score, {_tier(_round("m"))} AS quality_tier FROM means""",
    "normalized_text": f"""SELECT doc_id, md5({_NORMALIZED.format(x="text")}) AS normalized
FROM documents""",
    "gate_fuzzy": _FUZZY_GATE,
    "gate_many_exact": _EXACT_GATE_MANY,
    "gate_many_fuzzy": _FUZZY_GATE_MANY,
    "gate_exact": f"WITH {_GATE} SELECT doc_id, verdict, raw_reply, reason FROM gate",
    "page_split_counts": f"""WITH {_GATE}
SELECT CASE verdict WHEN 'yes' THEN 'skip' WHEN 'no' THEN 'extract' ELSE 'review' END AS destination,
       count(*) AS pages FROM gate GROUP BY 1""",
    "single_document": f"""WITH {_DOC_PAGES}, {_WORDS}, {_GATE},
g AS (SELECT document, stem || '.pdf' AS file, count(*) AS page_count, min(page) AS first_page,
             max(page) AS last_page, {_MEAN_TENTHS} AS m
      FROM dp JOIN quality USING (doc_id) JOIN gate USING (doc_id) WHERE verdict = 'no'
      GROUP BY document, stem)
SELECT document, 1::BIGINT AS document_index, file, page_count, first_page, last_page,
       {_round("m")} AS quality_score, {_tier(_round("m"))} AS quality_tier FROM g""",
    "document_run_lines": f"""WITH {_DOC_PAGES}, {_GATE}
SELECT document, count(*) AS pages, count(*) FILTER (verdict = 'no') AS extracted,
       count(*) FILTER (verdict = 'yes') AS skipped, count(*) FILTER (verdict = 'unclear') AS review,
       max(CASE WHEN verdict = 'no' THEN 1 ELSE 0 END)::BIGINT AS documents
FROM dp JOIN gate USING (doc_id) GROUP BY document""",
    "call_price": f"""WITH {_LINES}
SELECT document, page, model, input_tokens, output_tokens, {_IN} AS input_rate,
       {_OUT} AS output_rate, input_tokens * {_IN} / 1000000 AS input_cost,
       output_tokens * {_OUT} / 1000000 AS output_cost,
       input_tokens * {_IN} / 1000000 + output_tokens * {_OUT} / 1000000 AS total_cost FROM lines""",
    "cost_by_document": f"""WITH {_ORDER_COSTS}
SELECT document, model, input_tokens, output_tokens, input_cost, output_cost, total_cost,
       input_rate, output_rate FROM priced
UNION ALL SELECT document, '(total)', {_TOKEN_SUMS}, {_MONEY_SUMS}, NULL, NULL
FROM priced GROUP BY document""",
    "cost_global": f"""WITH {_ORDER_COSTS},
m AS (SELECT model, {_TOKEN_SUMS}, {_MONEY_SUMS} FROM priced GROUP BY model)
SELECT model, input_tokens, output_tokens, input_cost, output_cost, total_cost,
       {_IN} AS input_rate, {_OUT} AS output_rate, false AS is_total FROM m
UNION ALL SELECT '(total)', {_TOKEN_SUMS}, {_MONEY_SUMS}, NULL, NULL, true FROM m""",
    "cost_global_stored": f"""WITH {_ORDER_COSTS},
m AS (SELECT model, {_TOKEN_SUMS}, {_MONEY_SUMS} FROM priced GROUP BY model)
SELECT model, input_tokens, output_tokens, input_cost, output_cost, total_cost,
       {_IN} AS input_rate, {_OUT} AS output_rate, false AS is_total FROM m
UNION ALL SELECT '(total)', {_TOKEN_SUMS}, {_MONEY_SUMS}, NULL, NULL, true FROM m""",
    "cost_block_count": f"""WITH {_ORDER_COSTS}
SELECT count(DISTINCT document) AS cost_blocks_scanned FROM priced""",
    "price_overrides": """SELECT replace(p_brand, '#', '/v') || '-' || p_partkey || '.1' AS model,
  CASE WHEN p_partkey % 3 <> 0 AND p_partkey % 2 = 0 AND p_partkey % 5 <> 0
       THEN (p_partkey % 40)::DOUBLE / 8 ELSE p_size::DOUBLE / 4 END AS input_rate,
  CASE WHEN p_partkey % 3 <> 0 AND p_partkey % 2 = 1 AND p_partkey % 5 <> 0
       THEN (p_partkey % 40)::DOUBLE / 8 ELSE p_size::DOUBLE / 2 END AS output_rate
FROM part""",
    "group_pages": f"""WITH {_GROUPS}
SELECT document, page, value, document_index,
       CASE WHEN document_index IS NULL THEN 'review' ELSE 'document' END AS destination
FROM grouped""",
    "document_manifest": f"""WITH {_GROUPS}
SELECT document, document_index, page AS source_page,
       row_number() OVER (PARTITION BY document, document_index ORDER BY page) AS position,
       'invoice-' || document_index || '.pdf' AS file
FROM grouped WHERE document_index IS NOT NULL""",
    "call_ingest": """SELECT user_id::VARCHAR AS document, event_id AS page,
       CASE WHEN event_id % 4 <> 3 THEN event_type ELSE '' END AS reply,
       CASE WHEN event_id % 5 <> 0 THEN user_id ELSE 0 END AS input_tokens,
       CASE WHEN event_id % 3 <> 0 THEN event_id % 1000 ELSE 0 END AS output_tokens
FROM events""",
    "parse_replies": f"""WITH {_REPLIES}
SELECT document, page, ord, name, value, value_kind, confidence FROM parsed""",
    "reply_edge_types": f"""WITH {_edge_replies()}
SELECT document, page, ord, name, value, value_kind, confidence FROM parsed""",
    "helper_split": f"""WITH {_REPLIES}
SELECT document, page, 'helper' AS kind, name, value FROM parsed WHERE name IN ('type', 'batch')
UNION ALL
SELECT document, page, 'field' AS kind, name, value FROM parsed WHERE name <> 'type'""",
    "helper_page_values": """SELECT user_id::VARCHAR AS document, event_id AS page,
       CASE WHEN event_id % 4 <> 3 THEN event_type END AS value FROM events""",
    "merge_fields": f"""WITH {_MERGED}
SELECT document, document_index, field_no, name, value, value_kind, confidence FROM merged""",
    "document_confidence": f"""WITH {_MERGED}
SELECT document, document_index, {_round("sum(confidence)::DOUBLE / count(*)")} AS confidence_score
FROM merged GROUP BY document, document_index""",
    "document_calls": f"""WITH {_DOCUMENTS}
SELECT document, document_index, processing_time_seconds, extraction_success, error_count,
       models_used FROM docs""",
    "document_errors": f"""WITH {_GROUPS}
SELECT document, document_index, page, 'page ' || page || ': ' || error AS error_line
FROM grouped WHERE document_index IS NOT NULL AND error IS NOT NULL""",
    "page_places": f"""WITH {_DOC_PAGES}, {_WORDS}, {_GATE},
lines AS (
  SELECT document, page, doc_id, CASE WHEN doc_id % 11 <> 0 THEN lang END AS value
  FROM dp JOIN gate USING (doc_id) JOIN (SELECT doc_id, lang FROM documents) USING (doc_id)
  WHERE verdict = 'no'){_GROUPS[len(_LINES):]}
SELECT dp.document, dp.page,
       CASE WHEN verdict = 'yes' THEN 'skip' WHEN document_index IS NULL THEN 'review' ELSE 'document' END
         AS destination,
       document_index, {_tier("quality_score")} AS quality_tier,
       CASE WHEN verdict = 'no' THEN {_ROUTE} END AS model
FROM dp JOIN quality USING (doc_id) JOIN gate USING (doc_id) LEFT JOIN grouped USING (doc_id)""",
    "skip_records": f"""WITH {_DOC_PAGES}, {_WORDS}, {_GATE}
SELECT document, page, {_page_name(".png")} AS image_file, quality_score,
       {_tier("quality_score")} AS quality_tier, true AS page_skipped, reason AS skip_reason,
       raw_reply AS split_reply, 0::DOUBLE AS confidence_score, false AS extraction_success,
       0::INT AS fields
FROM dp JOIN quality USING (doc_id) JOIN gate USING (doc_id) WHERE verdict = 'yes'""",
    "review_records": f"""WITH {_DOC_PAGES}, {_WORDS}, {_GATE}, {_GROUPS}
SELECT document, page, {_page_name(".png")} AS image_file, quality_score,
       {_tier("quality_score")} AS quality_tier, true AS manual_review, raw_reply AS split_reply,
       reason AS split_reason, 0::DOUBLE AS confidence_score, false AS extraction_success,
       NULL::VARCHAR AS model_used, NULL::DOUBLE AS processing_time_seconds, NULL::VARCHAR AS error,
       '' AS field_names, '' AS field_values, '' AS field_scores, NULL::DOUBLE AS total_cost,
       NULL::VARCHAR AS cost_models
FROM dp JOIN quality USING (doc_id) JOIN gate USING (doc_id) WHERE verdict = 'unclear'
UNION ALL
SELECT document, page, {_page_name(".png")}, quality_score, {_tier("quality_score")}, true,
       {_text(grouping.REVIEW_REPLY)}, {_text(grouping.REVIEW_REASON)}, confidence::DOUBLE,
       success, model, processing_time, error, 'flag,status,cents',
       coalesce('"' || flag || '"', 'null') || ',"' || status || '",' || cents,
       confidence || ',' || confidence || ',' || confidence,
       CASE WHEN model = '' THEN 0::DOUBLE ELSE
         input_tokens * {_IN} / 1000000 + output_tokens * {_OUT} / 1000000 END,
       model
FROM grouped WHERE document_index IS NULL""",
    "document_records": f"""WITH {_DOCUMENTS}
SELECT document, file, page_count, quality_score, quality_tier, confidence_score,
       extraction_success, processing_time_seconds, pages, models_used, errors, field_names,
       field_values, field_scores, input_tokens, output_tokens, total_cost FROM docs""",
    "meta_unpivot": f"WITH {_DOCUMENTS} {_meta_rows()}",
    "field_list": f"""WITH {_MERGED}
SELECT document, 'invoice-' || document_index || '.pdf' AS file, (field_no - 1)::INT AS position,
       name, json AS value, confidence FROM shown""",
    "cost_labels": f"""WITH {_ORDER_COSTS},
t AS (SELECT document, {_TOKEN_SUMS}, {_MONEY_SUMS}, count(*) AS models,
             max(input_rate) AS rate FROM priced GROUP BY document)
SELECT document, format('{{:,}}', input_tokens) AS input_label,
       CASE WHEN models = 1 THEN '$' || regexp_replace(rate::VARCHAR, '\\.0$', '') || '/1M'
            ELSE 'mixed' END AS rate_label,
       {_usd("total_cost")} AS total_label,
       {_usd("(total_cost * 1000::DOUBLE)")} AS per_thousand_label FROM t""",
    "page_labels": f"""WITH {_LINES}
SELECT document, page,
       CASE {_tier("quality_score")} WHEN 'clear' THEN 'Clear' WHEN 'blurry' THEN 'Blurry'
            ELSE 'Very blurry' END AS tier,
       'q' || CAST(floor(quality_score + 0.5::DOUBLE) AS BIGINT) AS badge,
       CASE WHEN confidence >= 60 THEN 'high' WHEN confidence > 0 THEN 'low' ELSE 'none' END AS band,
       CASE WHEN cents < 1024 THEN cents || ' B'
            WHEN cents < 1048576 THEN {_fixed("cents / 1024::DOUBLE", 1)} || ' KB'
            ELSE {_fixed("cents / 1048576::DOUBLE", 1)} || ' MB' END AS size,
       CASE WHEN page % 2 = 0 THEN 'Document - ' || page_count || ' page(s)'
            ELSE coalesce(nullif(model, ''), error, 'No extraction') END AS caption
FROM lines""",
    "run_summary": """WITH counts AS (
  SELECT l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_orderkey % 17 <> 0 GROUP BY l_orderkey)
SELECT count(n) AS succeeded, count(*) - count(n) AS failed,
       coalesce(sum(n), 0)::BIGINT AS total_pages,
       CASE WHEN count(*) > count(n) THEN 1 ELSE 0 END AS exit_code
FROM orders LEFT JOIN counts ON o_orderkey = k""",
    "input_scan": f"""WITH {_FILES}
SELECT name, size FROM files WHERE bucket = 'input' AND folder = '' AND lower(name) LIKE '_%.pdf'""",
    "bucket_listing": f"""WITH {_FILES}, {_RECORDS}
SELECT f.bucket, CASE WHEN f.folder = '' THEN 'page' ELSE 'document' END AS kind,
       CASE WHEN f.folder = '' THEN f.stem ELSE f.folder || '/' || f.stem END AS name,
       CASE WHEN f.folder = '' THEN f.name ELSE f.folder || '/' || f.name END AS file,
       CASE WHEN json_valid(r.record) THEN r.record ELSE '{{}}' END AS record
FROM files f LEFT JOIN records r USING (bucket, folder, stem)
WHERE f.bucket <> 'input' AND ((f.folder = '' AND f.name LIKE '%.png')
  OR (f.folder <> '' AND f.name LIKE '%.pdf'))""",
    "ranked_listing": f"""WITH {_FILES}, {_RECORDS}
SELECT bucket, kind, name, file, row_number() OVER (PARTITION BY bucket ORDER BY kind DESC, file) AS position FROM (
SELECT f.bucket, CASE WHEN f.folder = '' THEN 'page' ELSE 'document' END AS kind,
       CASE WHEN f.folder = '' THEN f.stem ELSE f.folder || '/' || f.stem END AS name,
       CASE WHEN f.folder = '' THEN f.name ELSE f.folder || '/' || f.name END AS file,
       CASE WHEN json_valid(r.record) THEN r.record ELSE '{{}}' END AS record
FROM files f LEFT JOIN records r USING (bucket, folder, stem)
WHERE f.bucket <> 'input' AND ((f.folder = '' AND f.name LIKE '%.png')
  OR (f.folder <> '' AND f.name LIKE '%.pdf')))""",
    "cost_sources": f"""WITH {_RECORDS}
SELECT bucket, folder, stem, record FROM records
WHERE page_id % 7 > 2 AND ((bucket = 'output' AND folder <> '' AND position('/' IN folder) = 0)
  OR (bucket = 'review' AND folder = '' AND page_id % 7 < 5))""",
    "record_lookup": f"""WITH {_RECORDS}
SELECT 'skip' AS bucket, CASE WHEN p.page_id % 13 = 0 THEN '../' ELSE '' END || 'p' || p.page_id AS stem,
       record, record IS NOT NULL AS found,
       CASE WHEN p.page_id % 13 = 0 THEN 'invalid' WHEN record IS NULL THEN 'not_found' ELSE 'found' END AS status
FROM pages p LEFT JOIN records r
ON r.bucket = 'skip' AND r.folder = '' AND r.stem = 'p' || p.page_id AND p.page_id % 13 <> 0""",
    "delete_by_key": f"""WITH {_FILES}, {_REQUESTS},
counts AS (SELECT kind, bucket, target, count(*) AS files FROM matches GROUP BY ALL)
SELECT kind, bucket, target, coalesce(files, 0) AS files,
       CASE WHEN contains(target, '/') THEN 'invalid' WHEN files > 0 THEN 'deleted'
            ELSE 'not_found' END AS status
FROM wanted LEFT JOIN counts USING (kind, bucket, target)""",
    "delete_survivors": f"""WITH {_FILES}, {_REQUESTS}
SELECT bucket, folder, name, size FROM files
WHERE (bucket, folder, name) NOT IN (SELECT (bucket, folder, name) FROM matches)""",
    "stored_deletes": f"""WITH {_FILES}, {_REQUESTS}
SELECT bucket, folder, name FROM files
WHERE name LIKE '%.json' AND (bucket, folder, name) NOT IN (SELECT (bucket, folder, name) FROM matches)""",
    "stored_clear": f"""WITH {_RECORDS}
SELECT bucket, count(*) AS records FROM records
WHERE bucket <> 'skip' AND NOT (bucket = 'input' AND folder <> '') GROUP BY bucket""",
    "clear_bucket": f"""WITH {_FILES}
SELECT bucket, count(DISTINCT CASE WHEN folder <> '' THEN 'd:' || split_part(folder, '/', 1) ELSE 'f:' || name END)
  AS removed FROM files
WHERE folder <> '' OR lower(name) LIKE '%.pdf'
  OR (bucket <> 'input' AND (lower(name) LIKE '%.png' OR lower(name) LIKE '%.json'))
GROUP BY bucket""",
    "upload_admission": """WITH u AS (
  SELECT o_orderkey AS upload_id,
    CASE o_orderkey % 6 WHEN 0 THEN 'scan/' || o_orderkey || '.pdf' WHEN 1 THEN o_orderkey || '.PDF'
      WHEN 2 THEN CASE o_orderkey % 24 WHEN 8 THEN '.' WHEN 20 THEN './.' ELSE '..' END
      WHEN 3 THEN o_orderkey || '.txt' WHEN 4 THEN 'a/b/' || o_orderkey || '.pdf/'
      ELSE 'a/../' || o_orderkey END AS filename,
    CASE o_orderkey % 6 WHEN 0 THEN o_orderkey || '.pdf' WHEN 1 THEN o_orderkey || '.PDF'
      WHEN 2 THEN CASE WHEN o_orderkey % 12 = 8 THEN '' ELSE '..' END
      WHEN 3 THEN o_orderkey || '.txt' WHEN 4 THEN o_orderkey || '.pdf'
      ELSE o_orderkey::VARCHAR END AS name
  FROM orders)
SELECT upload_id, filename, name,
       CASE WHEN name = '..' THEN 'invalid file name' WHEN lower(name) LIKE '%.pdf' THEN 'saved'
            ELSE '''' || name || ''' is not a PDF' END AS status FROM u""",
    "template_names": f"""WITH {_TEMPLATES}
SELECT template_id, array_to_string(fields, ',') AS extracted_fields,
       array_to_string(skips, ',') AS no_need_page, array_to_string(helpers, ',') AS same_words,
       helpers[1] AS group_field FROM names""",
    "template_normalise": f"""WITH {_TEMPLATES.replace(
        "AS template FROM events),", f"AS stored FROM events),", 1
    ).replace("SELECT template_id, template,\n         CASE WHEN json_valid(template) THEN template::JSON END AS t FROM raw",
              f"SELECT template_id, coalesce(stored, {_text(templates.EMPTY_TEMPLATE)}) AS template,\n         CASE WHEN json_valid(template) THEN template::JSON END AS t FROM raw")},
checked AS (SELECT *, coalesce(json_type(t) = 'OBJECT' AND json_type(json_extract(t, '$.extracted_fields')) = 'OBJECT'
  AND json_type(n) = 'OBJECT', false) AS accepted FROM names)
SELECT template_id, accepted,
       CASE WHEN accepted THEN '{{"extracted_fields":' || {_json_object("fields")}
         || ',"no_need_page":' || {_json_object("skips")}
         || ',"multiple-docs":{{"same-words-every-pages":' || {_json_object("helpers")} || '}}}}'
       END AS payload,
       CASE WHEN NOT accepted THEN 'expected ''extracted_fields'' and ''no_need_page'' objects' END
         AS detail
FROM checked""",
    "prompt_text": f"""WITH {_TEMPLATES}
SELECT template_id, md5({_prompt("fields", "helpers")}) AS prompt FROM names""",
    "model_requests": f"""WITH {_WORDS}, {_GATE}
SELECT doc_id, {_ROUTE} AS model, md5({_model_request(_ROUTE, "text")}) AS request
FROM quality JOIN gate USING (doc_id) JOIN documents USING (doc_id) WHERE verdict = 'no'""",
    "downscale_size": """WITH s AS (
  SELECT p_partkey, CAST(p_partkey * 37 % 4000 + 500 AS INT) AS w, p_size * 97 + 100 AS h FROM part)
SELECT p_partkey,
  CASE WHEN greatest(w, h) > 2048
       THEN round_even(w * (2048::DOUBLE / greatest(w, h)), 0)::INT ELSE w END AS width,
  CASE WHEN greatest(w, h) > 2048
       THEN round_even(h * (2048::DOUBLE / greatest(w, h)), 0)::INT ELSE h END AS height FROM s""",
    "skew_angle": """WITH s AS (
  SELECT user_id::VARCHAR AS document, event_id % 3 + 1 AS page, event_id * 7 % 300 - 20 AS dx,
         event_id * 13 % 61 - 30 AS dy, greatest(50, (event_id % 3 * 400 + 900) // 20) AS need
  FROM events),
a AS (SELECT document, page, degrees(atan2(dy, dx)) AS angle FROM s
      WHERE dx * dx + dy * dy >= need * need AND abs(degrees(atan2(dy, dx))) <= 45),
r AS (SELECT *, row_number() OVER (PARTITION BY document, page ORDER BY angle) AS i,
             count(*) OVER (PARTITION BY document, page) AS n FROM a)
SELECT document, page, round((max(angle) FILTER (i = (n + 1) // 2)
  + max(angle) FILTER (i = (n + 2) // 2)) / 2, 6) AS skew_angle FROM r GROUP BY document, page""",
    "luma": f"""WITH {_RASTER}
SELECT vec_id, position::INT AS position,
  floor(0.299::DOUBLE * gray + 0.587::DOUBLE * (255 - gray) + 0.114::DOUBLE * (gray * 7 % 256)
    + 0.5::DOUBLE)::SMALLINT AS luma FROM pixels""",
    "laplacian": f"""WITH {_RASTER}
SELECT vec_id, x::INT AS x, y, coalesce(l, ri) + coalesce(ri, l) + coalesce(u, d) + coalesce(d, u) - 4 * gray AS laplacian
FROM (SELECT vec_id, x, y, gray, lag(gray) OVER r AS l, lead(gray) OVER r AS ri, lag(gray) OVER c AS u, lead(gray) OVER c AS d
      FROM pixels WINDOW r AS (PARTITION BY vec_id, y ORDER BY x), c AS (PARTITION BY vec_id, x ORDER BY y))""",
    "sharpness": f"WITH {_LAPLACIAN} SELECT vec_id, sharpness FROM sharp",
    "otsu_threshold": f"""WITH {_OTSU}
SELECT vec_id, level::INT AS threshold, round(std, 9) AS std, std < 5 AS blank
FROM best JOIN spread USING (vec_id) WHERE r = 1""",
    "banded_measures": f"""WITH {_OTSU}
SELECT vec_id, sharpness, level::INT AS threshold, round(std, 9) AS std, std < 5 AS blank
FROM best JOIN spread USING (vec_id) JOIN sharp USING (vec_id) WHERE r = 1""",
    "enhancement_report": f"""WITH {_OTSU}
SELECT vec_id, {_ANGLE} AS deskew_angle,
  'grayscale;' || CASE WHEN sharpness < 50 THEN 'deblur(wiener+unsharp)'
    ELSE 'deblur(skipped: already sharp)' END || ';denoise(median);' ||
  CASE WHEN abs({_ANGLE}) >= 0.3::DOUBLE
    THEN 'deskew(' || CASE WHEN {_ANGLE} < 0 THEN '-' ELSE '+' END
      || printf('%.2f', {_round(f"abs({_ANGLE})", 2)}) || 'deg)'
    ELSE 'deskew(skipped: already straight)' END || ';contrast(CLAHE);' ||
  CASE WHEN std < 5 THEN 'binarize(skipped: blank page)' ELSE 'binarize(otsu)' END AS steps
FROM sharp JOIN spread USING (vec_id)""",
    "stream_costs": f"""WITH {_ORDER_CALLS},
c AS (SELECT model, input_tokens, output_tokens, input_tokens * {_IN} / 1000000 AS input_cost,
        output_tokens * {_OUT} / 1000000 AS output_cost,
        input_tokens * {_IN} / 1000000 + output_tokens * {_OUT} / 1000000 AS total_cost
      FROM calls WHERE model <> '')
SELECT model, {_TOKEN_SUMS}, {_MONEY_SUMS}, count(*) AS calls FROM c GROUP BY model""",
    "stream_documents": f"""WITH {_GROUPS}
SELECT document, page, value, document_index FROM grouped""",
    "stream_record_costs": f"""WITH last_lines AS (
  SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC) = 1),
{_ORDER_CALLS.replace('FROM lineitem', 'FROM last_lines').lstrip()},
c AS (SELECT model, input_tokens, output_tokens, input_tokens * {_IN} / 1000000 AS input_cost,
        output_tokens * {_OUT} / 1000000 AS output_cost,
        input_tokens * {_IN} / 1000000 + output_tokens * {_OUT} / 1000000 AS total_cost
      FROM calls WHERE model <> '')
SELECT model, {_TOKEN_SUMS}, {_MONEY_SUMS}, count(*) AS calls FROM c GROUP BY model""",
    "stream_ingest": f"""WITH {_GROUPS}
SELECT document, page, value, document_index FROM grouped""",
}

# What is stored reads back as what was made.
ORACLES["stored_listing"] = ORACLES["bucket_listing"]
ORACLES["stored_skip_records"] = ORACLES["skip_records"]
ORACLES["stored_document_records"] = f"""WITH {_DOCUMENTS}
SELECT regexp_replace(document, '\\.pdf$', '') AS folder, regexp_replace(file, '\\.pdf$', '') AS stem, document, file,
       page_count, quality_score, quality_tier, confidence_score, extraction_success, errors, total_cost FROM docs"""
