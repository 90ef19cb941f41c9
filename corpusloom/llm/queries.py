"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import balltrees, langid, licenses, media, packing, pieces, pivots, quality, repeats, resharding, simhash, toxicity, whitening
from .common import table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_length")


def op2_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resharding.op2(table(spark, sf_dir, "documents"))


def op3_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.op3(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.op5(table(spark, sf_dir, "documents"))


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_table(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op8(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op9(table(spark, sf_dir, "documents"))


def op10_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.op10(table(spark, sf_dir, "documents"))


def op11_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.top_k(table(spark, sf_dir, "embeddings"))


def op12_balltrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balltrees.mine(table(spark, sf_dir, "embeddings"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_packing, op2_flow, op3_jpeg, op4_simhash, op5_repeats, op6_pieces, op7_licenses, op8_segments, op9_line_frequency, op10_centroids, op11_pivots, op12_balltrees, op13_whitening)}


#: Windows of 400 bytes as 800 hexadecimal digits; equal hashes are equal windows.
OP5_SQL = r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
s AS (SELECT r, unnest(range(0, len(x) // 2 - 399)) AS i FROM d WHERE len(x) >= 800),
h AS (SELECT s.r, i, hash(substr(x, 2 * i + 1, 800)) AS h FROM s JOIN d USING (r)),
again AS (SELECT h FROM h GROUP BY h HAVING count(*) > 1),
hit AS (SELECT r, i FROM h JOIN again USING (h)),
runs AS (SELECT r, min(i) AS a, max(i) + 400 AS b FROM (SELECT r, i, sum(CASE WHEN i - p <= 400 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS g FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS p FROM hit)) GROUP BY r, g),
gaps AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM runs),
cut AS (SELECT g.r, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(x, CAST(2 * before + 1 AS BIGINT), CAST(2 * (a - before) AS BIGINT)), '' ORDER BY a) AS left_part, max(b) AS stop FROM gaps g JOIN d USING (r) GROUP BY g.r)
SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
sha256(CASE WHEN c.r IS NULL THEN unhex(x) ELSE unhex(left_part || substr(x, CAST(2 * stop + 1 AS BIGINT))) END) AS kept_sha256 FROM d LEFT JOIN cut c USING (r)"""

#: White space of a line is that of Python's str.split() as far as single bytes and the no-break space go.
OP9_SQL = r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS x FROM documents),
w AS (SELECT r, i, w FROM (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT r, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS ws FROM d))),
g AS (SELECT r, i, md5(concat_ws(' ', w, lead(w, 1) OVER p, lead(w, 2) OVER p, lead(w, 3) OVER p, lead(w, 4) OVER p)) AS h, lead(w, 4) OVER p IS NOT NULL AS whole FROM w WINDOW p AS (PARTITION BY r ORDER BY i)),
again AS (SELECT r, i FROM g WHERE whole QUALIFY count(*) OVER (PARTITION BY r, h) > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM again, range(5) t(k) GROUP BY r),
l AS (SELECT r, host, unnest(string_split(x, chr(10))) AS line, md5(x) AS whole FROM d),
lw AS (SELECT r, host, whole, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lw GROUP BY r),
norm AS (SELECT r, host, whole, n, md5(regexp_replace(trim(regexp_replace(lower(line), '[\x09-\x0D\x1C-\x20\x{85}\x{A0}]+', ' ', 'g')), '[0-9]+', '0', 'g')) AS k FROM lw),
common AS (SELECT host, k FROM norm GROUP BY host, k HAVING count(DISTINCT whole) > 50),
gone AS (SELECT r, sum(n) AS n FROM norm JOIN common USING (host, k) GROUP BY r),
b AS (SELECT d.r, doc_id, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS n_words, length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, len(regexp_extract_all(x, '[#*$%&|<>]')) AS n_symbols,
coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(gone.n, 0) AS gone FROM d LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN gone USING (r)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
NOT base_failed AND n_words - gone >= 0.2 * n_words AS kept, CAST(n_words - gone AS BIGINT) AS left_words FROM f"""


#: Vectors that take part, as floors of 256 times their components; row numbers keep repeated rows apart.
VECTORS_SQL = """v AS (SELECT r, vec_id, l, [floor(256 * CAST(c AS DOUBLE)) for c in embedding] AS x FROM (SELECT row_number() OVER () AS r, vec_id, embedding, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS l FROM embeddings)
WHERE embedding IS NOT NULL AND len([c for c in embedding if c IS NULL OR NOT isfinite(c)]) = 0)"""

OP11_SQL = f"""WITH {VECTORS_SQL},
s AS (SELECT q.r AS qr, q.vec_id AS query_id, v.vec_id, v.r AS r, CAST(list_inner_product(q.x, v.x) AS BIGINT) AS score FROM v q JOIN v ON q.r <> v.r WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY qr ORDER BY score DESC, vec_id NULLS LAST, r) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= 5"""

OP12_SQL = f"""WITH {VECTORS_SQL},
s AS (SELECT a.r AS ar, a.vec_id AS anchor_id, v.vec_id, v.r AS r, a.l = v.l AS same, CAST(list_inner_product(a.x, v.x) AS BIGINT) AS score FROM v a JOIN v ON a.r <> v.r WHERE a.vec_id % 50 = 0 AND a.l IS NOT NULL AND v.l IS NOT NULL),
p AS (SELECT ar, anchor_id, vec_id AS positive_id, r AS pr, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id NULLS LAST, r) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.ar, pr ORDER BY s.score DESC, s.vec_id NULLS LAST, s.r) AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON p.ar = s.ar WHERE NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score QUALIFY rank <= 3"""


def oracle_sql() -> dict[str, str]:
    return {"op11_pivots": OP11_SQL, "op12_balltrees": OP12_SQL, "op5_repeats": OP5_SQL, "op9_line_frequency": OP9_SQL}
