"""Registered queries of the thirteen operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paddock.llm import (
    containment, hard_negatives, kneser_ney, near_dedup, neighbours, piece_lattice, repetition, secret_owners, site_style, stream_vbyte, suffix_dedup,
    url_templates, word_runs,
)
from paddock.scratch import new_path
from paddock.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


OP3_SQL = """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), base AS (
  SELECT doc_id, w, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda a: length(a))), 0) AS word_chars,
    length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM t
), ln AS (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM base
), ld AS (
  SELECT doc_id, count(*) AS n_lines, sum(CASE WHEN r > 1 THEN 1 ELSE 0 END) AS n_dup_lines,
    sum(CASE WHEN r > 1 THEN length(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g')) ELSE 0 END) AS dup_line_chars
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS r FROM ln) GROUP BY doc_id
), wd AS (
  SELECT doc_id, unnest(w) AS a, generate_subscripts(w, 1) AS i, n_words FROM base
), pr AS (
  SELECT doc_id, i, a, n_words, {grams}
  FROM wd WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), fl AS (
  SELECT doc_id, i, a,
    CASE WHEN g3 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g3) > 1 THEN 1 ELSE 0 END AS f3, {flags}
  FROM pr
), cv AS (
  SELECT doc_id, length(a) AS c, max(f3) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS c3, {covers}
  FROM fl
), sm AS (
  SELECT doc_id, sum(c3) AS n_repeat_words, {sums} FROM cv GROUP BY doc_id
), j AS (
  SELECT b.doc_id, b.n_words, b.word_chars, b.n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    coalesce(n_lines, 0) AS n_lines, coalesce(dup_line_chars, 0) AS dup_line_chars, {outs}
  FROM base b LEFT JOIN ld ON b.doc_id = ld.doc_id LEFT JOIN sm ON b.doc_id = sm.doc_id
)
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
  CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_dup_lines > 30 * n_lines
    OR 100 * dup_line_chars > 20 * word_chars OR {limits}) AS kept,
  CAST(n_lines AS BIGINT) AS n_lines, CAST(dup_line_chars AS BIGINT) AS dup_line_chars, {casts}
FROM j
""".format(
    grams=", ".join(
        f"CASE WHEN i + {n - 1} <= n_words THEN concat_ws(' ', "
        + ", ".join("a" if k == 0 else f"lead(a, {k}) OVER o" for k in range(n))
        + f") END AS g{n}"
        for n in (3, *repetition.GRAM_PERCENT)
    ),
    flags=", ".join(
        f"CASE WHEN g{n} IS NOT NULL AND row_number() OVER (PARTITION BY doc_id, g{n} ORDER BY i) > 1 THEN 1 ELSE 0 END AS f{n}"
        for n in repetition.GRAM_PERCENT
    ),
    covers=", ".join(
        f"max(f{n}) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS c{n}"
        for n in repetition.GRAM_PERCENT
    ),
    sums=", ".join(f"sum(c{n} * c) AS d{n}" for n in repetition.GRAM_PERCENT),
    outs=", ".join(f"coalesce(d{n}, 0) AS d{n}" for n in repetition.GRAM_PERCENT),
    limits=" OR ".join(f"100 * d{n} > {p} * word_chars" for n, p in repetition.GRAM_PERCENT.items()),
    casts=", ".join(f"CAST(d{n} AS BIGINT) AS dup_chars_{n}" for n in repetition.GRAM_PERCENT),
)


@query("op3_repetition", OP3_SQL)
def op3_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_rules(table(spark, sf_dir, "documents"))


@query("op8_nearest_neighbours")
def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op4_kneser_ney")
def op4_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_minhash")
def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


_SHINGLES = """
  SELECT {key}, list_aggregate(list_slice(w, i, i + 4), 'string_agg', ' ') AS g FROM (
    SELECT {key}, w, unnest(range(1, CAST(greatest(len(w) - 3, 1) AS BIGINT))) AS i FROM (
      SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x20\\x09-\\x0D]+') AS w FROM {table}))
"""

OP5_SQL = f"""
WITH items AS (SELECT DISTINCT * FROM ({_SHINGLES.format(key="item_id", table="benchmark")})),
texts AS (SELECT DISTINCT * FROM ({_SHINGLES.format(key="doc_id", table="documents")})),
sizes AS (SELECT item_id, count(*) AS n FROM items GROUP BY item_id),
shared AS (SELECT doc_id, item_id, count(*) AS s FROM texts JOIN items USING (g) GROUP BY doc_id, item_id)
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(item_id AS BIGINT) AS item_id, CAST(n AS BIGINT) AS n_item_shingles, CAST(s AS BIGINT) AS n_shared
FROM shared JOIN sizes USING (item_id) WHERE 100 * s >= 80 * n
"""


@query("op5_containment", OP5_SQL)
def op5_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containment.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op6_stream_vbyte")
def op6_stream_vbyte(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    path = new_path(spark, "token-file")
    stream_vbyte.write(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    return stream_vbyte.read(spark, path).drop("ids")


def page_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_id, bad) by the document a page shows: the last number of its path is the doc_id."""
    _, path = url_templates.parts(F.col("url"))
    shown = pages.select("page_id", F.try_to_number(F.regexp_extract(path, "([0-9]{1,18})[^0-9/]*/?$", 1), F.lit("9" * 18)).cast("bigint").alias("doc_id"))
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)
    return shown.join(labels.select("doc_id", bad.alias("bad")), "doc_id").select("page_id", "bad")


@query("op10_url_templates")
def op10_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_templates.judge_urls(pages, page_labels(pages, table(spark, sf_dir, "labels")))


@query("op1_site_style")
def op1_site_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_style.main_text(table(spark, sf_dir, "pages"))


@query("op7_gumbel_lattice")
def op7_gumbel_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    return piece_lattice.sampled_segmentations(table(spark, sf_dir, "documents"), model)


@query("op2_suffix_array")
def op2_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_bytes(table(spark, sf_dir, "documents"))


def _matches(kind: str, pattern: str, group: int, texts: str = "t") -> str:
    """SQL for (r, start, end, kind, value) of all matches: a match starts after all parts and matches before it."""
    quoted = pattern.replace("'", "''")
    return f"""
  SELECT r, kind, CAST(upto - length(m) AS BIGINT) + base AS s, CAST(upto AS BIGINT) + base AS e, v FROM (
    SELECT r, {secret_owners.KINDS.index(kind)} AS kind, base, m, v, sum(length(p) + length(m)) OVER (PARTITION BY r, base ORDER BY i) AS upto FROM (
      SELECT r, base, unnest(ps[1:len(ms)]) AS p, unnest(ms) AS m, unnest(vs) AS v, generate_subscripts(ms, 1) AS i FROM (
        SELECT r, base, regexp_split_to_array(x, '{quoted}') AS ps, regexp_extract_all(x, '{quoted}') AS ms,
          regexp_extract_all(x, '{quoted}', {group}) AS vs FROM {texts}) WHERE len(ms) > 0))"""


_LIVE = (
    f"length(regexp_replace(v, '[^A-Za-z]', '', 'g')) >= {secret_owners.MIN_LETTERS} "
    f"AND length(regexp_replace(v, '[^0-9]', '', 'g')) >= {secret_owners.MIN_DIGITS} "
    f"AND len(list_distinct(string_split(lower(v), ''))) >= {secret_owners.MIN_DIFFERENT}"
)
_LINE = "coalesce(string_agg(CASE {when} THEN [{names}][kind + 1] || ':' || s || ':' || e END, ',' ORDER BY s, kind), '')"
_NAMES = ", ".join(f"'{k}'" for k in secret_owners.KINDS)

OP11_SQL = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS x, 0 AS base FROM documents),
assigned AS ({_matches("assign", secret_owners.ASSIGN, 2)}),
base AS (
  SELECT * FROM assigned WHERE length(v) >= {secret_owners.ASSIGN_VALUE} UNION ALL {_matches("access", secret_owners.ACCESS, 0)}
  UNION ALL {_matches("hex", secret_owners.HEX, 0)}
), ends AS (
  SELECT r, list(e ORDER BY s) AS es FROM assigned GROUP BY r
), between AS (
  SELECT r, unnest(regexp_split_to_array(x, '{secret_owners.ASSIGN.replace("'", "''")}')) AS x, unnest(list_prepend(0, coalesce(es, []))) AS base
  FROM t LEFT JOIN ends USING (r)
), tokens AS (
  SELECT * FROM ({_matches("owned", secret_owners.TOKEN, 0, "between")}) WHERE {_LIVE}
    AND NOT regexp_matches(v, '{secret_owners.ACCESS}|{secret_owners.HEX}')
), uses AS (
  SELECT * FROM base UNION ALL SELECT * FROM tokens
), owners AS (
  SELECT lower(v) AS h, count(DISTINCT coalesce('=' || source, '-')) AS n FROM uses JOIN t USING (r) GROUP BY 1
), judged AS (
  SELECT r, kind, s, e, n > {secret_owners.MAX_OWNERS} AS example, n <= {secret_owners.MAX_OWNERS} AND {_LIVE} AS live
  FROM uses JOIN owners ON lower(v) = h
), per AS (
  SELECT r, {_LINE.format(when="WHEN kind < 3", names=_NAMES)} AS base_line, {_LINE.format(when="WHEN kind < 3 OR live", names=_NAMES)} AS spans,
    {", ".join(f"count(CASE WHEN kind = {i} THEN 1 END) AS n_{k}" for i, k in enumerate(secret_owners.KINDS[:3]))},
    count(CASE WHEN live THEN 1 END) AS n_live, count(CASE WHEN example THEN 1 END) AS n_example
  FROM judged GROUP BY r
)
SELECT CAST(doc_id AS BIGINT) AS doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in secret_owners.KINDS[:3])},
  sha256(coalesce(base_line, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM t LEFT JOIN per USING (r)
"""


@query("op11_secret_owners", OP11_SQL)
def op11_secret_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_owners.secret_spans(table(spark, sf_dir, "documents")).drop("live")


OP12_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS uid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.uid, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score
  FROM v a JOIN v b ON a.uid <> b.uid WHERE a.vec_id % 100 = 0
), p AS (
  SELECT uid, anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id) <= 5
)
SELECT CAST(p.anchor_id AS BIGINT) AS anchor_id, CAST(positive_id AS BIGINT) AS positive_id,
  CAST(row_number() OVER (PARTITION BY p.uid, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
  CAST(s.vec_id AS BIGINT) AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON p.uid = s.uid AND NOT same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.uid, positive_id ORDER BY s.score DESC, s.vec_id) <= 10
"""


@query("op12_hard_negatives", OP12_SQL)
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("bigint") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


@query("op13_word_runs")
def op13_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_runs.periodic_runs(table(spark, sf_dir, "documents"), plant=True)
