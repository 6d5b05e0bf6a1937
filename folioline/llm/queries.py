"""One query for each operator, over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioline.llm import (
    capture_index,
    embedding_dedup,
    fill_middle,
    hard_negatives,
    language_id,
    main_text,
    mixing,
    neighbours,
    packing,
    quality,
    shingle_join,
    substring_dedup,
    token_counts,
)

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The table has no time of capture: a page a second, in the order of ids.
    pages = table(spark, sf_dir, "pages").withColumn("seconds", F.col("page_id") + 1_704_067_200)
    index = capture_index.capture_index(capture_index.write_archives(pages))
    return index.select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "stamp"
    )


#: The table's URLs have a scheme, a host and a path, which may be empty.
_CAPTURES_SQL = r"""
WITH payloads AS (
  SELECT page_id, url, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
firsts AS (SELECT digest, min(page_id) AS first FROM payloads WHERE n >= 100 GROUP BY digest),
cut AS (
  SELECT *, regexp_extract(trim(coalesce(url, '')), '^[A-Za-z]+://([^/?#:]*)(:[0-9]+)?([^?#]*)(\?[^#]*)?', ['host', 'port', 'path', 'query']) AS u
  FROM payloads)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN first != page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first != page_id THEN first END AS refers_to,
       CASE WHEN coalesce(url, '') = '' THEN '' ELSE lower(
         array_to_string(list_reverse(string_split(regexp_replace(lower(u.host), '^www\.', ''), '.')), ',')
         || CASE WHEN u.port IN (':80', ':443') THEN '' ELSE u.port END || ')'
         || CASE WHEN u.path = '' THEN '/' ELSE u.path END || CASE WHEN u.query = '?' THEN '' ELSE u.query END) END AS url_key,
       strftime(make_timestamp((coalesce(page_id + 1704067200, 0)) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS stamp
FROM cut LEFT JOIN firsts USING (digest)"""


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.jaccard_classes(table(spark, sf_dir, "documents"), percent=90, width=3)


#: Target weights of the corpus: by domain, language within it, source within that.
MIX = mixing.Mix(
    weights={
        "domain": {"domain0": 5, "domain1": 3, "domain2": 2},
        "lang": {"en": 6, "de": 2, "fr": 1, "es": 1},
        "source": {"src0": 3},
    },
    share=(1, 1),
    max_epochs=2,
)


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mixing.select_mix(mixing.with_domain(docs), MIX)


def _level_sql(level: str, above: list[str]) -> str:
    """The children ``level`` of every node ``above``: the amount each one gets."""
    weights = MIX.weights[level]
    cases = " ".join(f"WHEN {level} = '{name}' THEN {weight}" for name, weight in weights.items())
    names = ", ".join([*above, level])
    same = " AND ".join(f"n.{a} IS NOT DISTINCT FROM p.{a}" for a in above) or "true"
    parent = f"given_{above[-1]}" if above else "root"
    return f"""
nodes_{level} AS (
  SELECT {names}, sum(tokens) * {MIX.max_epochs} AS capacity,
         max(CASE {cases} ELSE {MIX.default_weight} END) AS weight
  FROM leaves GROUP BY {names}),
pairs_{level} AS (
  -- For each child, what all siblings would take if they were filled up to its own level.
  SELECT n.*, p.given AS parent_given FROM nodes_{level} n JOIN {parent} p ON {same}),
levels_{level} AS (
  SELECT a.{level} AS level_of, {"".join(f"a.{x}, " for x in above)} a.parent_given, a.capacity, a.weight,
         sum(CASE WHEN b.capacity * a.weight <= a.capacity * b.weight THEN b.capacity ELSE 0 END) AS below,
         sum(CASE WHEN b.capacity * a.weight > a.capacity * b.weight THEN b.weight ELSE 0 END) AS open_weight
  FROM pairs_{level} a JOIN pairs_{level} b
    ON {" AND ".join(f"a.{x} IS NOT DISTINCT FROM b.{x}" for x in above) or "true"}
  GROUP BY ALL),
full_{level} AS (
  SELECT *, below * weight + open_weight * capacity <= parent_given * weight AS is_full FROM levels_{level}),
rest_{level} AS (
  SELECT {"".join(f"{x}, " for x in above)} max(parent_given) - coalesce(sum(capacity) FILTER (is_full), 0) AS amount,
         sum(weight) FILTER (NOT is_full) AS open_weight
  FROM full_{level} GROUP BY ALL),
given_{level} AS (
  SELECT {"".join(f"n.{x}, " for x in above)} n.level_of AS {level},
         (CASE WHEN is_full THEN capacity ELSE least(capacity, p.amount * weight // p.open_weight) END)::BIGINT AS given
  FROM full_{level} n JOIN rest_{level} p ON {same})"""


def _mix_sql() -> str:
    levels = list(MIX.levels)
    parts = [_level_sql(level, levels[:i]) for i, level in enumerate(levels)]
    leaf = ", ".join(levels)
    on = " AND ".join(f"l.{x} IS NOT DISTINCT FROM g.{x}" for x in levels)
    return f"""
WITH sized AS (
  SELECT doc_id, 'domain' || ascii(right(source, 1)) % 3 AS domain, lang, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS n_tokens
  FROM documents),
leaves AS (SELECT {leaf}, sum(n_tokens)::BIGINT AS tokens FROM sized GROUP BY {leaf}),
root AS (SELECT sum(tokens)::BIGINT AS given FROM leaves),{",".join(parts)},
epochs AS (
  SELECT l.*, e.epoch, least(l.tokens, g.given - e.epoch * l.tokens) AS quota
  FROM leaves l JOIN given_source g ON {on} CROSS JOIN (SELECT unnest(range({MIX.max_epochs})) AS epoch) e
  WHERE g.given > e.epoch * l.tokens),
placed AS (
  SELECT l.doc_id, {", ".join(f"l.{x}" for x in levels)}, g.epoch, l.n_tokens, g.tokens, g.quota,
         coalesce(sum(l.n_tokens) OVER (
           PARTITION BY {", ".join(f"l.{x}" for x in levels)}, g.epoch
           ORDER BY md5('{MIX.seed}:' || g.epoch || ':' || l.doc_id), l.doc_id
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place
  FROM sized l JOIN epochs g ON {on})
SELECT doc_id, {leaf}, epoch::INTEGER AS epoch, n_tokens, (epoch * tokens + place)::BIGINT AS start,
       least(n_tokens, quota - place)::BIGINT AS taken
FROM placed WHERE place < quota"""


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = language_id.learn(docs.where(~language_id.held_out()))
    found = language_id.predict(docs.select("doc_id", "text"), learned)
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = substring_dedup.cut_repeats(docs, width=35)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(table(spark, sf_dir, "pages"))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, TOKENIZER, ranks_path=RANKS)


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumn(
        "label", F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)")
    )
    return hard_negatives.mine(rows, F.col("vec_id") % 50 == 0, positives=5, negatives=3, scale=256)


_NEGATIVES_SQL = """
WITH own AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM own a JOIN own b ON a.vec_id % 50 = 0 AND a.vec_id != b.vec_id),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id,
       (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INTEGER AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3"""


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), WORD_TOKENIZER)
    return counted.withColumn("over_limit", F.col("n_tokens") > 2048)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_middle.fill_in_middle(table(spark, sf_dir, "documents"), seed=42, percent=50, spm_percent=80)
    return cut.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(fill_middle.restored(), 256).alias("restored_sha256"),
    )


#: The text comes back from its pieces, in their places in the text.
_FILL_SQL = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
  FROM documents),
drawn AS (
  SELECT doc_id, t, u, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS c1,
         ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS c2,
         ('0x' || h[25:32])::BIGINT % 100 < 80 AS suffix_first,
         t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
           OR ('0x' || h[17:24])::BIGINT % 100 >= 50 AS is_plain
  FROM cut),
parts AS (
  SELECT *, array_to_string(u[1:least(c1, c2)], '') AS p, array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') AS m,
         array_to_string(u[greatest(c1, c2) + 1:], '') AS s
  FROM drawn)
SELECT doc_id, n::BIGINT AS n, CASE WHEN is_plain THEN 'plain' WHEN suffix_first THEN 'spm' ELSE 'psm' END AS form,
       CASE WHEN NOT is_plain THEN length(p) END AS prefix_chars, CASE WHEN NOT is_plain THEN length(m) END AS middle_chars,
       sha256(CASE WHEN is_plain THEN t WHEN suffix_first THEN '<S>' || s || '<P>' || p || '<M>' || m
                   ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
       sha256(CASE WHEN is_plain THEN t ELSE p || m || s END) AS restored_sha256
FROM parts"""


def _components_sql(nodes: str, links: str) -> str:
    """CTEs ``reach`` and ``component``: the smallest id that links lead to, from (a, b) both ways."""
    return f"""
reach AS (
  SELECT {nodes.split()[0]} AS a, {nodes.split()[0]} AS b FROM {nodes.split()[1]}
  UNION
  SELECT r.a, l.b FROM reach r JOIN {links} l ON r.b = l.a),
component AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)"""


#: Sets of word triples, their overlaps by a join on the triples, and what links lead to.
_JACCARD_SQL = rf"""
WITH RECURSIVE
split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^ 	-
]+') AS w
  FROM documents),
grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE [array_to_string(w[i:i + 2], ' ') FOR i IN range(1, len(w) - 1)] END) AS gram
  FROM split),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n_both FROM grams x JOIN grams y USING (gram)
  WHERE x.doc_id != y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * n_both >= 90 * (x.n + y.n - n_both)),{_components_sql("doc_id documents", "links")}
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN component ON component.a = d.doc_id"""

#: A word goes if a repeated window begins at it or at one of the 34 words before it.
_WINDOWS_SQL = r"""
WITH split AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS w FROM documents),
starts AS (
  SELECT row, p, count(*) OVER (PARTITION BY seen) > 1 AS repeated
  FROM (SELECT row, p, array_to_string(w[p:p + 34], ' ') AS seen FROM (SELECT row, w, unnest(range(1, len(w) - 33)) AS p FROM split))),
words AS (SELECT row, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM split),
judged AS (
  SELECT row, p, word, coalesce(max(CASE WHEN repeated THEN p END) OVER (PARTITION BY row ORDER BY p) >= p - 34, false) AS gone
  FROM words LEFT JOIN starts USING (row, p)),
kept AS (
  SELECT row, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (NOT gone) AS text
  FROM judged GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (row)"""

_NEAR_VECTORS_SQL = f"""
WITH RECURSIVE
own AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x FOR x IN embedding IF x != 0]) > 0),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM own x JOIN own y ON x.label = y.label AND x.vec_id != y.vec_id
  WHERE list_cosine_similarity(x.v, y.v) >= 0.98),
number AS (SELECT a, count(*) AS n FROM links GROUP BY a),{_components_sql("vec_id embeddings", "links")}
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e LEFT JOIN number ON number.a = e.vec_id JOIN component ON component.a = e.vec_id"""


QUERIES = {
    "op1_warc_index": op1_warc_index,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_source_mixing": op3_source_mixing,
    "op4_language_id": op4_language_id,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_html_extraction": op6_html_extraction,
    "op7_nearest_neighbours": op7_nearest_neighbours,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_embedding_near_dedup": op9_embedding_near_dedup,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_token_counts": op12_token_counts,
    "op13_fill_in_middle": op13_fill_in_middle,
}
ORACLES: dict[str, str] = {
    "op1_warc_index": _CAPTURES_SQL,
    "op2_ngram_jaccard_join": _JACCARD_SQL,
    "op3_source_mixing": _mix_sql(),
    "op5_substring_dedup": _WINDOWS_SQL,
    "op9_embedding_near_dedup": _NEAR_VECTORS_SQL,
    "op11_hard_negatives": _NEGATIVES_SQL,
    "op13_fill_in_middle": _FILL_SQL,
}
