"""The queries that apply each training-data operator to its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hnsw, language_id, line_dedup, mixing, packing, quality_fm, quality_rules, secret_scan, simhash, toxicity, url_filters, vector_codes, whitening
from .common import id_remainder, table


def tokenizer_path() -> str:
    """The vocabulary file that the packing query uses; an installed package holds it."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filters.judge(table(spark, sf_dir, "pages"), url_filters.rules_frame(spark, URL_RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return packing.ids_crc32(pieces).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    rest = id_remainder("doc_id", 5)
    model = language_id.train(docs.where(rest != 0))
    held = docs.select("doc_id", F.coalesce(rest == 0, F.lit(False)).alias("held_out"), "text")
    found = language_id.detect(held, model, ["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "lang_pred", "score", "n_langs")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    d = secret_scan.scan(docs, secret_scan.default_forest(spark))
    return d.select(
        "doc_id",
        F.size("secret_candidates").cast("long").alias("n_candidates"),
        F.size("secret_found").cast("long").alias("n_secrets"),
        "secret_found",
        F.crc32(F.col("secret_text").cast("binary")).alias("redacted_crc32"),
    )


def _held_out(name: str):
    return F.coalesce(id_remainder(name, 4) == 2, F.lit(False))


def op6_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    labels = table(spark, sf_dir, "labels")
    machine = quality_fm.train(docs, labels.where(id_remainder("doc_id", 4) != 2))
    scored = quality_fm.score(docs.withColumn("held_out", _held_out("doc_id")), machine, ["doc_id", "held_out"])
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(id_remainder("doc_id", 4) != 2))
    scored = toxicity.score(docs.withColumn("held_out", _held_out("doc_id")), model, ["doc_id", "held_out"])
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality_rules.train(docs, table(spark, sf_dir, "labels"))
    return quality_rules.apply(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicates(table(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(table(spark, sf_dir, "embeddings"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = line_dedup.create(docs)
    out = line_dedup.dedup_lines(docs, index, postings=index.postings)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": op1_url_filters,
    "op2_packing": op2_packing,
    "op3_mixing": op3_mixing,
    "op4_language_id": op4_language_id,
    "op5_secret_scan": op5_secret_scan,
    "op6_quality_fm": op6_quality_fm,
    "op7_simhash": op7_simhash,
    "op8_toxicity": op8_toxicity,
    "op9_quality_rules": op9_quality_rules,
    "op10_hnsw": op10_hnsw,
    "op11_vector_codes": op11_vector_codes,
    "op12_line_dedup": op12_line_dedup,
    "op13_whitening": op13_whitening,
}

_LINK = r"<link\b[^>]*\brel\s*=\s*[\"'']?canonical\b[^>]*\bhref\s*=\s*[\"'']?([^\"''\s>]+)"
_LINK_TURNED = r"<link\b[^>]*\bhref\s*=\s*[\"'']?([^\"''\s>]+)[^>]*\brel\s*=\s*[\"'']?canonical\b"
_REFRESH = r"<meta\b[^>]*\bhttp-equiv\s*=\s*[\"'']?refresh\b[^>]*\bcontent\s*=\s*[\"'']?[^\"''>]*?url\s*=\s*([^\"''\s>]+)"

URL_SQL = rf"""
WITH RECURSIVE
rules(action, rh, rp) AS (VALUES {", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in URL_RULES)}),
raw AS (SELECT url, unnest([coalesce(nullif(regexp_extract(html, '{_LINK}', 1, 'is'), ''), regexp_extract(html, '{_LINK_TURNED}', 1, 'is')), regexp_extract(html, '{_REFRESH}', 1, 'is')]) AS link
        FROM pages WHERE contains(url, '://')),
full_ AS (SELECT url, CASE WHEN contains(link, '://') THEN link
                           WHEN starts_with(link, '//') THEN regexp_extract(url, '^(.*?:)//', 1, 's') || link
                           WHEN starts_with(link, '/') THEN regexp_extract(url, '^(.*?://[^/?#]*)', 1, 's') || link
                           ELSE regexp_replace(regexp_extract(url, '^(.*?://[^/?#]*(?:[^?#]*/)?)', 1, 's'), '([^/])$', '\1/') || link END AS target
          FROM raw WHERE link <> ''),
ends AS (SELECT regexp_replace(url, '#.*$', '', 's') AS u, regexp_replace(target, '#.*$', '', 's') AS v FROM full_),
ties AS (SELECT u, v FROM ends WHERE u <> v UNION SELECT v, u FROM ends WHERE u <> v),
reach AS (SELECT u, v FROM ties UNION SELECT r.u, t.v FROM reach r JOIN ties t ON t.u = r.v),
everyone AS (SELECT DISTINCT url FROM pages WHERE url IS NOT NULL UNION SELECT u FROM ties),
parts AS (SELECT url, translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM everyone),
fits AS (SELECT url, rh || rp AS rule, action, row_number() OVER (PARTITION BY url ORDER BY length(rh || rp) DESC, length(rh) DESC, action) AS n
         FROM parts JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)),
own AS (SELECT url, rule, action FROM fits WHERE n = 1),
reached AS (SELECT DISTINCT r.u AS node FROM reach r JOIN own ON own.url = r.v AND own.action = 'block')
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(action, CASE WHEN node IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM pages LEFT JOIN parts USING (url) LEFT JOIN own USING (url) LEFT JOIN reached ON node = regexp_replace(url, '#.*$', '', 's')
"""

#: All pairs, which the tables of the comparison are small enough for.
EMBEDDING_SQL = """
WITH RECURSIVE
v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
      WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
          AND list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.95),
reach AS (SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON l.u = r.v),
least AS (SELECT u, min(v) AS m FROM reach GROUP BY u),
many AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
FROM embeddings LEFT JOIN least ON least.u = vec_id LEFT JOIN many ON many.u = vec_id
"""

#: A line's key as white space stripped and A-Z lower-cased.
LINE_SQL = """
WITH
lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place FROM documents),
keyed AS (SELECT doc_id, place, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
held AS (SELECT k, count(DISTINCT doc_id) AS n, max(doc_id) AS last FROM keyed WHERE length(k) >= 20 GROUP BY k),
judged AS (SELECT doc_id, place, line, coalesce(n >= 3 AND doc_id <> last, false) AS gone FROM keyed LEFT JOIN held USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""



def _codes_sql(rounds: int = vector_codes.ROUNDS) -> str:
    """Plain assignment of every part to every entry, round by round."""
    steps = []
    for i in range(rounds + 1):
        steps.append(
            f"a{i} AS MATERIALIZED (SELECT p.k, p.r, min([list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, b.e]) AS m FROM p JOIN b{i} b USING (k) GROUP BY p.k, p.r)"
        )
        if i < rounds:
            steps.append(f"s{i} AS (SELECT a.k, a.m[2] AS e, j, sum(p.v[j])::BIGINT AS s, count(*) AS n FROM a{i} a JOIN p USING (k, r), LATERAL (SELECT unnest(range(1, len(p.v) + 1)) AS j) GROUP BY ALL)")
            steps.append(f"u{i} AS (SELECT k, e, list((s - ((s % n) + n) % n) // n ORDER BY j) AS v FROM s{i} GROUP BY k, e)")
            steps.append(f"b{i + 1} AS MATERIALIZED (SELECT b.k, b.e, coalesce(u.v, b.v) AS v FROM b{i} b LEFT JOIN u{i} u USING (k, e))")
    return f"""
WITH
x AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS r, vec_id, label, list_transform(embedding, lambda c: floor(1024 * c::DOUBLE)::BIGINT) AS x FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
p AS MATERIALIZED (SELECT r, vec_id, label, k, x[k * len(x) // 4 + 1:(k + 1) * len(x) // 4] AS v FROM x, range(4) t(k)),
b0 AS MATERIALIZED (SELECT k, r AS e, v FROM p WHERE r < 256),
{", ".join(steps)},
e AS (SELECT p.vec_id, p.label, string_agg(printf('%02x', m[2]), '' ORDER BY k) AS code, sum(m[1])::BIGINT AS error FROM a{rounds} JOIN p USING (k, r) GROUP BY p.r, p.vec_id, p.label),
h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY k, e)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM e, h
"""


CODES_SQL = _codes_sql()

#: The others learn a model, hash or tokenize: tests hold them against brute force or held-out rows.
ORACLE_SQL: dict[str, str] = {"op1_url_filters": URL_SQL, "op10_hnsw": EMBEDDING_SQL, "op11_vector_codes": CODES_SQL, "op12_line_dedup": LINE_SQL}
