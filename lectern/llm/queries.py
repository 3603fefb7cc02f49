"""The thin queries of the operators: whole tables in, whole results out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import bitplane_store, bottomk_dedup, cross_entropy, curriculum_mix, egrid_join, gga_packing, html_crf, license_rules, oph_fingerprint, piece_agenda, subword_quality, tiered_search, token_ids, turn_trie


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_crf.extract(_table(spark, sf_dir, "pages"))


def op2_egrid_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return egrid_join.near_vectors(_table(spark, sf_dir, "embeddings"))


def op3_gga_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gga_packing.pack_documents(_table(spark, sf_dir, "documents"), token_ids.vocabulary_path("byte_bpe_50k.json"))


def op4_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = subword_quality.classify(documents, _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", subword_quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op5_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = curriculum_mix.ordered(curriculum_mix.mix(_table(spark, sf_dir, "documents")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "position")


def op6_bottomk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bottomk_dedup.near_duplicates(_table(spark, sf_dir, "documents"), width=4)


def op7_bitplane_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = bitplane_store.write(_table(spark, sf_dir, "documents"), token_ids.vocabulary_path("word_bpe_49k.json"), end_id=2)
    return bitplane_store.read(spark, folder)


def op8_oph_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oph_fingerprint.fingerprints(_table(spark, sf_dir, "documents"))


def op9_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_rules.scan(_table(spark, sf_dir, "documents"))


def op10_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: the documents labelled good, without the held-out ones."""
    labels = _table(spark, sf_dir, "labels")
    return cross_entropy.score(_table(spark, sf_dir, "documents"), labels.where((F.col("quality") == 1) & ~subword_quality.held_out(F.col("doc_id"))))


def op11_piece_agenda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_agenda.digests(_table(spark, sf_dir, "documents"), token_ids.vocabulary_path("piece_bpe_32k.model"))


def op12_tiered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiered_search.rank_all(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("tier")


def op13_turn_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_trie.prefix_nodes(_table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_html_crf, op2_egrid_join, op3_gga_packing, op4_subword_quality, op5_curriculum_mix, op6_bottomk_dedup, op7_bitplane_store, op8_oph_fingerprint, op9_license_rules, op10_cross_entropy, op11_piece_agenda, op12_tiered_search, op13_turn_trie)}

#: CRC-32 of each byte, as SQL: eight times a shift and, where the last bit was set, the polynomial.
_CRC_TABLE = "SELECT range AS i, range AS x FROM range(256)"
for _ in range(8):
    _CRC_TABLE = f"SELECT i, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END AS x FROM ({_CRC_TABLE})"

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLE_SQL = {
    "op12_tiered_search": f"""
WITH docs AS (SELECT doc_id, {_TERMS} AS terms FROM documents),
sized AS (SELECT doc_id, len(terms) AS n, terms FROM docs WHERE len(terms) > 0),
totals AS (SELECT CAST(count(*) AS BIGINT) AS total, CAST(sum(n) AS BIGINT) AS length FROM sized),
counted AS (SELECT doc_id, n, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc_id, n, unnest(terms) AS term FROM sized) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * total + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w FROM counted, totals GROUP BY term, total),
impacts AS (SELECT doc_id, term, (1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * total) // length)) AS impact FROM counted, totals),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
scores AS (
  SELECT item_id, doc_id, CAST(sum(times * w * impact) AS BIGINT) AS score FROM asked JOIN weights USING (term) JOIN impacts USING (term) GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 20""",
    "op13_turn_trie": rf"""
WITH crc AS (SELECT list(x ORDER BY i) AS t FROM ({_CRC_TABLE})),
own AS (
  SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, role, text) AS l FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
hashed AS (
  SELECT conv_id, l, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) % 9 AS h FROM own, crc),
built AS (
  SELECT o.conv_id, list_concat(coalesce(b.l[1:o.h], []), o.l[o.h + 1:]) AS l FROM hashed o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 5),
members AS (SELECT conv_id, l[1:d] AS p, d, len(l) = d AS ends FROM (SELECT conv_id, l, unnest(range(0, len(l) + 1)) AS d FROM built)),
nodes AS (
  SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '') AS ends,
    CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * strlen(p[d].t) END AS saved
  FROM members GROUP BY p, d),
children AS (SELECT p[1:d - 1] AS p, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
whole AS (SELECT n.*, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN children c ON c.d = n.d AND c.p = n.p),
subtrees AS (
  SELECT p[1:k] AS p, k AS d, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved
  FROM (SELECT p, saved, n_children, unnest(range(0, d + 1)) AS k FROM whole) GROUP BY ALL)
SELECT w.conv_id, CAST(w.d AS BIGINT) AS depth, a.conv_id AS parent_conv_id, CAST(w.n_convs AS BIGINT) AS n_convs, CAST(w.n_children AS BIGINT) AS n_children,
  CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(w.ends) AS ends_sha256
FROM whole w JOIN subtrees s ON s.d = w.d AND s.p = w.p LEFT JOIN nodes a ON a.d = w.d - 1 AND a.p = w.p[1:w.d - 1]""",
    "op5_curriculum_mix": r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS hash FROM documents),
shares AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][turn + 1] AS weight, [0.5::DOUBLE, 0.0::DOUBLE, -0.5::DOUBLE][turn + 1] AS slope FROM (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS turn FROM sized GROUP BY source)),
levels AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 - coalesce(CAST(sum(source_size * 2) OVER (ORDER BY source_size * 2 / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE), 0))
    / sum(weight) OVER (ORDER BY source_size * 2 / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM shares),
goal AS (
  SELECT source, source_size, slope, CASE WHEN level <= source_size * 2 / weight
    THEN (SELECT arg_min(level, source_size * 2 / weight) FROM levels WHERE level <= source_size * 2 / weight) * weight ELSE CAST(source_size * 2 AS DOUBLE) END AS target FROM levels),
placed AS (
  SELECT s.doc_id, s.size, g.source_size, g.slope, g.target, CAST(floor(g.target + 0.5) AS BIGINT) AS asked,
    CAST(coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.hash, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source),
counted AS (SELECT *, CASE WHEN source_size > 0 THEN asked // source_size ELSE 0 END AS full_passes FROM placed),
cut AS (SELECT *, greatest(0, least(size, asked - full_passes * source_size - start)) AS rest FROM counted),
firsts AS (
  SELECT *, full_passes * size + rest AS taken, (start + (CASE WHEN full_passes > 0 THEN size ELSE rest END) / 2) / asked AS share FROM cut)
SELECT doc_id, size, source_size, target, CAST(taken AS BIGINT) AS taken,
  CASE WHEN taken > 0 THEN 2 * share / (1 + slope + sqrt(greatest(0.0, (1 + slope) * (1 + slope) - 4 * slope * share))) ELSE 2.0 END AS position
FROM firsts""",
}
