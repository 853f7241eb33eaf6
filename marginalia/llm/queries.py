"""One query per operator over its whole table, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from marginalia.llm import manifest, quality, toxicity, urlrules, warc
from marginalia.llm.collocations import collocations
from marginalia.llm.decontaminate import leaks
from marginalia.llm.extract import extract
from marginalia.llm.langid import identify
from marginalia.llm.linerules import BOILERPLATE, line_rules
from marginalia.llm.minhash import near_duplicates
from marginalia.llm.packing import pack
from marginalia.llm.shared import held
from marginalia.llm.vectors import near_vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(run):
        QUERIES[run.__name__] = run
        if sql:
            ORACLES[run.__name__] = sql
        return run

    return register


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@_query(r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s
  FROM words),
keyed AS (SELECT doc_id, s, md5(array_to_string(list_sort(s), chr(10))) AS h FROM sets),
nodes AS (SELECT h, any_value(s) AS s, min(doc_id) AS id FROM keyed WHERE len(s) > 0 GROUP BY h),
terms AS (SELECT id, unnest(s) AS t FROM nodes),
pairs AS (
  SELECT x.id AS a, y.id AS b, count(*) AS c FROM terms x JOIN terms y ON x.t = y.t AND x.id < y.id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN nodes x ON x.id = a JOIN nodes y ON y.id = b
  WHERE 100 * c >= 75 * (len(x.s) + len(y.s) - c)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS id, a AS root FROM ways UNION SELECT r.id, w.b FROM reach r JOIN ways w ON r.root = w.a),
roots AS (SELECT id, min(root) AS root FROM reach GROUP BY id)
SELECT k.doc_id, CAST(len(k.s) AS BIGINT) AS n_shingles,
  coalesce(r.root, n.id, k.doc_id) AS component_id, k.doc_id = coalesce(r.root, n.id, k.doc_id) AS kept
FROM keyed k LEFT JOIN nodes n ON len(k.s) > 0 AND n.h = k.h LEFT JOIN roots r ON r.id = n.id
""")
def op3_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(_table(spark, folder, "documents"))


@_query()
def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(_table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@_query()
def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return leaks(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


@_query()
def op1_html(spark: SparkSession, folder: str) -> DataFrame:
    return extract(_table(spark, folder, "pages"))


@_query(r"""
WITH text AS (
  SELECT CAST(floor(page_id / 1000) AS BIGINT) AS file, page_id, 'WARC/1.1' || chr(13) || chr(10)
    || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
    || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
    || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10)
    || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS r FROM pages),
laid AS (
  SELECT file, page_id, strlen(r) AS length, sha256(r) AS digest, CAST(coalesce(sum(strlen(r)) OVER (
    PARTITION BY file ORDER BY page_id, sha256(r) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
  FROM text)
SELECT file, "offset", CAST(length AS BIGINT) AS length,
  CASE WHEN substr(digest, 3, 1) IN ('0', '1', '2', '3', '4') THEN 'missing' ELSE 'altered' END AS status,
  digest AS first_digest,
  CASE WHEN substr(digest, 3, 1) IN ('0', '1', '2', '3', '4') THEN NULL ELSE sha256(digest || '!') END AS second_digest
FROM laid WHERE substr(digest, 1, 2) IN ('00', '10', '20', '30', '40', '50')
""")
def op8_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Audit of the pages' WARC records against a replica with damage derived from their digests."""
    records = held(warc.page_records(_table(spark, folder, "pages")))
    damaged = F.substring("digest", 1, 2).isin("00", "10", "20", "30", "40", "50")
    lost = damaged & F.substring("digest", 3, 1).isin("0", "1", "2", "3", "4")
    altered = F.when(damaged, F.sha2(F.concat("digest", F.lit("!")), 256)).otherwise(F.col("digest"))
    return warc.audit(records, records.filter(~lost).withColumn("digest", altered))


# The rules of the query.
URL_RULES = [
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/"),
]


@_query(r"""
WITH split AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
rules(verdict, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
  ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
fits AS (
  SELECT page_id, host, path, h || p AS rule, verdict,
    row_number() OVER (PARTITION BY page_id ORDER BY len(h) DESC NULLS LAST, len(p) DESC) AS k
  FROM split LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE k = 1
""")
def op10_urls(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "verdict string, host string, path string")
    return urlrules.judge(_table(spark, folder, "pages"), rules)


@_query()
def op4_langid(spark: SparkSession, folder: str) -> DataFrame:
    return identify(_table(spark, folder, "documents"))


@_query()
def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


@_query()
def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.score(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


@_query(r"""
WITH RECURSIVE usable AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
ways AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b
  ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT a AS id, a AS root FROM ways UNION SELECT r.id, w.b FROM reach r JOIN ways w ON r.root = w.a),
roots AS (SELECT id, min(root) AS root FROM reach GROUP BY id),
degree AS (SELECT a AS id, count(*) AS n FROM ways GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(root, vec_id) AS component_id, vec_id = coalesce(root, vec_id) AS kept
FROM embeddings LEFT JOIN roots r ON r.id = vec_id LEFT JOIN degree d ON d.id = vec_id
""")
def op2_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(_table(spark, folder, "embeddings"))


@_query(r"""
WITH RECURSIVE rows AS (
  SELECT *, coalesce('=' || lang, '') AS g, CAST(doc_id AS VARCHAR) AS i FROM documents),
crcs AS (
  SELECT i, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, len(i) + 1), lambda p: CAST(ascii(i[p]) AS BIGINT))),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)),
      lambda x, z: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))) AS c
  FROM (SELECT DISTINCT i FROM rows WHERE i IS NOT NULL)),
typed AS (
  SELECT r.*, coalesce(strlen(r.i) || ':' || r.i, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-') AS head,
    CASE WHEN xor(c, 4294967295) % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
      ELSE text END AS bad
  FROM rows r LEFT JOIN crcs USING (i)),
leaves AS (
  SELECT doc_id, g, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(bad) || ':' || bad, '-')) AS bad_leaf FROM typed),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY g) AS n
  FROM leaves),
nodes AS (
  SELECT 0 AS lvl, g, p, n, leaf AS d FROM placed
  UNION ALL
  SELECT lvl + 1, g, p // 8, (any_value(n) + 7) // 8, sha256(string_agg(d, '' ORDER BY p)) FROM nodes WHERE n > 1 GROUP BY lvl, g, p // 8),
subroots AS (SELECT g, d, row_number() OVER (ORDER BY g) - 1 AS p, count(*) OVER () AS n FROM nodes WHERE n = 1),
uppers AS (
  SELECT 0 AS lvl, p, n, d FROM subroots
  UNION ALL
  SELECT lvl + 1, p // 8, (any_value(n) + 7) // 8, sha256(string_agg(d, '' ORDER BY p)) FROM uppers WHERE n > 1 GROUP BY lvl, p // 8),
sides AS (
  SELECT a.lvl, a.g, a.p, coalesce(string_agg(b.d, '' ORDER BY b.p) FILTER (b.p < a.p), '') AS l,
    coalesce(string_agg(b.d, '' ORDER BY b.p) FILTER (b.p > a.p), '') AS r
  FROM nodes a JOIN nodes b ON a.lvl = b.lvl AND a.g = b.g AND a.p // 8 = b.p // 8 WHERE a.n > 1 GROUP BY a.lvl, a.g, a.p),
upper_sides AS (
  SELECT a.lvl, a.p, coalesce(string_agg(b.d, '' ORDER BY b.p) FILTER (b.p < a.p), '') AS l,
    coalesce(string_agg(b.d, '' ORDER BY b.p) FILTER (b.p > a.p), '') AS r
  FROM uppers a JOIN uppers b ON a.lvl = b.lvl AND a.p // 8 = b.p // 8 WHERE a.n > 1 GROUP BY a.lvl, a.p),
steps AS (
  SELECT g, q.p AS p, s.lvl, l, r FROM placed q JOIN sides s USING (g) WHERE s.p = q.p // CAST(8 ** s.lvl AS BIGINT)
  UNION ALL
  SELECT q.g, q.p, 1000 + s.lvl, l, r FROM placed q JOIN subroots t USING (g) JOIN upper_sides s ON s.p = t.p // CAST(8 ** s.lvl AS BIGINT)),
paths AS (SELECT g, p, list({'l': l, 'r': r} ORDER BY lvl) AS path FROM steps GROUP BY g, p),
folds AS (
  SELECT g, p, bad_leaf AS d, 1 AS k FROM placed
  UNION ALL
  SELECT f.g, f.p, sha256(path[k].l || d || path[k].r), k + 1 FROM folds f JOIN paths q ON q.g = f.g AND q.p = f.p WHERE k <= len(path)),
ends AS (SELECT g, p, max_by(d, k) AS folded_root FROM folds GROUP BY g, p)
SELECT q.doc_id, leaf, t.d AS subroot, u.d AS root,
  sha256(coalesce(array_to_string(list_transform(path, lambda s: s.l || s.r), ''), '')) AS proof_sha256,
  folded_root, folded_root = u.d AS verified
FROM placed q JOIN subroots t ON t.g = q.g JOIN uppers u ON u.n = 1 LEFT JOIN paths h ON h.g = q.g AND h.p = q.p JOIN ends e ON e.g = q.g AND e.p = q.p
""")
def op11_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return manifest.verified(_table(spark, folder, "documents"))


@_query(r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) AS p
  FROM words, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k),
counts AS (SELECT lang, k, p, array_to_string(p, ' ') AS phrase, count(*) AS f FROM grams GROUP BY lang, k, p HAVING count(*) >= 100),
cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, i, x.f AS l, y.f AS r, n,
    CAST(CAST(1000 AS HUGEINT) * c.f * n // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS i FROM counts WHERE k > 1) c JOIN totals USING (lang)
  JOIN counts x ON x.lang = c.lang AND x.p = c.p[:i] JOIN counts y ON y.lang = c.lang AND y.p = c.p[i + 1:]),
scored AS (SELECT lang, phrase, a, n, min(row(score, i, l, r)) AS best FROM cuts GROUP BY lang, phrase, a, n),
inner_parts AS (
  SELECT lang, f, p[i:i + m - 1] AS p FROM counts, (SELECT unnest(range(1, 5)) AS i), (SELECT unnest(range(2, 5)) AS m)
  WHERE m < k AND i + m - 1 <= k),
held AS (SELECT lang, array_to_string(p, ' ') AS phrase, max(f) AS most FROM inner_parts GROUP BY lang, p),
alone AS (
  SELECT s.*, row_number() OVER (PARTITION BY lang ORDER BY best[1] DESC, a DESC, phrase) AS rank
  FROM scored s LEFT JOIN held USING (lang, phrase) WHERE most IS NULL OR 100 * most < 100 * a)
SELECT lang, rank, phrase, a, best[3] AS l, best[4] AS r, n, best[1] AS score FROM alone WHERE rank <= 2000
""")
def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(_table(spark, folder, "documents"))


@_query(r"""
WITH words AS (
  SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
lines AS (
  SELECT id, line, pos, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS v
  FROM (SELECT id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM words)),
measured AS (
  SELECT *, len(v) AS n, len(list_filter(v, lambda x: regexp_full_match(x, '[|»›>•·]+'))) AS separators,
    len(regexp_extract_all(line, '[#*$%&|<>]')) AS symbols, list_sum(list_transform(v, lambda x: len(x))) AS letters,
    len(regexp_extract_all(line, '\p{Lu}')) AS capitals, len(regexp_extract_all(line, '[\p{Lu}\p{Ll}]')) AS cased,
    len(regexp_extract_all(line, '[!?][!?]+([\x20\x09-\x0D]|$)')) AS exclaimed,
    row_number() OVER (PARTITION BY id, line ORDER BY pos) > 1 AS repeated
  FROM lines WHERE len(v) > 0),
faults AS (
  SELECT id, CAST(count(*) FILTER (repeated) AS BIGINT) AS n_dup_lines, coalesce(sum(n) FILTER (
    (separators >= 3 AND 4 * separators >= n) OR 10 * symbols > letters OR (cased >= 20 AND 10 * capitals > 7 * cased)
    OR 3 * exclaimed > n OR (n >= 6 AND NOT regexp_matches(line, '[.,;:!?…。、]'))
    OR (n <= 30 AND regexp_matches(line, '(?i)BOILERPLATE'))), 0) AS lost
  FROM measured GROUP BY id),
windows AS (
  SELECT id, i, count(*) OVER (PARTITION BY id, x) AS often
  FROM (SELECT id, i, array_to_string(w[i:i + 7], ' ') AS x FROM (SELECT id, w, unnest(range(1, len(w) - 6)) AS i FROM words WHERE len(w) >= 8))),
covered AS (SELECT id, count(DISTINCT i + j) AS n FROM windows, range(0, 8) t(j) WHERE often > 1 GROUP BY id),
judged AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: len(x))), 0) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(c.n, 0) AS n_repeat_words, CAST(coalesce(lost, 0) AS BIGINT) AS n_lost_words
  FROM words LEFT JOIN faults f USING (id) LEFT JOIN covered c USING (id))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * n_lost_words <= 30 * n_words AS kept
FROM judged
""".replace("BOILERPLATE", BOILERPLATE))
def op13_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Verdicts; the cleaned text is given by its length."""
    rows = line_rules(_table(spark, folder, "documents"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lost_words", "base_failed", "kept"
    )
