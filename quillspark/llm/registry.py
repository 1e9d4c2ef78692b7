"""The queries of this subpackage and their SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, chosen_path, html_text, lexicon_bpe, line_dedup, mih, ngram_join, packing, spelling, suffix_dedup, token_files, toxicity
from .runtime import table

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=400)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), BYTE_BPE, capacity=2048)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents"), BYTE_BPE)


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_components(table(spark, sf_dir, "documents"), n=4, num=85, den=100)


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.md5("text").alias("kept_md5"))


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mih.exact_topk(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mih.nearest(table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon_bpe.digests(table(spark, sf_dir, "documents"), WORD_BPE)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"), every=199, least_length=6, least_count=5, ratio=5)


def op12_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_duplicates(table(spark, sf_dir, "documents"), n=5, num=85, den=100)


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.digests(*centroids.cluster(table(spark, sf_dir, "embeddings"), k=16, rounds=3, dims=64, scale=64, seed=1))


QUERIES = {
    f.__name__: f
    for f in (op1_suffix_dedup, op2_best_fit_packing, op3_token_files, op4_ngram_join, op5_html_extraction, op6_line_dedup, op7_exact_topk, op8_neighbours, op9_toxicity, op10_bpe, op11_spelling_variants, op12_minhash_dedup, op13_centroids)
}

_NGRAM_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS s FROM w),
n AS (SELECT w.doc_id, count(g.s) AS n FROM w LEFT JOIN g USING (doc_id) GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT n.doc_id, n.n AS n_shingles, min(r.b) AS component_id FROM n JOIN r ON r.a = n.doc_id GROUP BY 1, 2
"""

_MINHASH_SQL = _NGRAM_SQL.replace("len(ws) < 4", "len(ws) < 5").replace("len(ws) - 2), lambda i: array_to_string(ws[i:i + 3]", "len(ws) - 3), lambda i: array_to_string(ws[i:i + 4]").replace("AS component_id FROM", "AS component_id, n.doc_id = min(r.b) AS kept FROM")

_LINE_SQL = r"""
WITH s AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS k FROM s),
w AS (SELECT doc_id, k, list_sort(list_distinct(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> ''))) AS ws FROM l),
n AS (SELECT ws, row_number() OVER (ORDER BY min((doc_id, k))) AS node, min((doc_id, k)) AS f, len(ws) AS n FROM w WHERE len(ws) > 0 GROUP BY ws),
t AS (SELECT node, n, f, unnest(ws) AS word FROM n),
p AS (SELECT a.node AS x, b.node AS y, a.n AS nx, b.n AS ny, count(*) AS c FROM t a JOIN t b ON a.word = b.word AND a.node < b.node AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n GROUP BY ALL),
g AS (SELECT DISTINCT y FROM p WHERE 5 * c >= 4 * (nx + ny - c)),
stay AS (SELECT f FROM n ANTI JOIN g ON n.node = g.y),
r AS (SELECT doc_id, k FROM w WHERE len(ws) > 0 AND (doc_id, k) NOT IN (SELECT f FROM stay)),
c AS (SELECT doc_id, list(k) AS gone FROM r GROUP BY 1)
SELECT s.doc_id, len(ls) AS n_lines, coalesce(len(gone), 0) AS n_removed,
  md5(array_to_string(list_filter(ls, lambda x, i: NOT list_contains(coalesce(gone, []), i - 1)), chr(10))) AS kept_md5
FROM s LEFT JOIN c USING (doc_id)
"""

_TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x > 0) AS code FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.code, c.code), lambda z: CAST(z[1] <> z[2] AS INTEGER))) AS INTEGER) AS distance
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank, vec_id, distance FROM d
QUALIFY rank <= 10
"""


_SPELLING_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT list(list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM (SELECT unnest(range(256)) AS i)),
r0 AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS w FROM documents),
r1 AS (SELECT id, w, count(*) AS n, hex(encode(id || ':' || w)) AS x FROM r0 WHERE length(w) >= 6 GROUP BY ALL),
r2 AS (SELECT w, n, list_transform(range(length(x) // 2), lambda i: 16 * strpos('123456789ABCDEF', x[2 * i + 1]) + strpos('123456789ABCDEF', x[2 * i + 2])) AS b FROM r1),
r3 AS (SELECT w, n, xor(list_reduce([4294967295] || b, lambda c, y: xor(c >> 8, t[1 + (xor(c, y) & 255)])), 4294967295) AS h FROM r2 CROSS JOIN bits),
r4 AS (SELECT CASE WHEN h % 199 = 0 THEN left(w, CAST(h % length(w) AS BIGINT)) || substr(w, CAST(h % length(w) AS BIGINT) + 2) ELSE w END AS word, n FROM r3),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM r4 WHERE length(word) >= 6 GROUP BY 1 HAVING sum(n) >= 5),
d AS (SELECT word, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM v)),
p AS (
  SELECT a.word, b.word AS near FROM d a JOIN d b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT d.word, v.word FROM d JOIN v ON d.rest = v.word UNION SELECT v.word, d.word FROM d JOIN v ON d.rest = v.word),
q AS (SELECT p.word, count(*) AS n_near, min({'l': -v.n, 'f': near}) AS best FROM p JOIN v ON v.word = near GROUP BY 1),
f AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.l >= 5 * v.n THEN best.f END AS form, CASE WHEN -best.l >= 5 * v.n THEN -best.l END AS form_n FROM v LEFT JOIN q USING (word)),
g AS (SELECT word, word AS root, form AS further FROM f UNION ALL SELECT g.word, f.word, f.form FROM g JOIN f ON g.further = f.word)
SELECT f.word, f.form, g.root, f.n, f.n_near, f.form_n FROM f JOIN g ON g.word = f.word AND g.further IS NULL
"""


def _centroids_sql(k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64) -> str:
    square = "CAST(list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
    steps = [f"""WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({scale}.0::DOUBLE * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS j, v AS c FROM v WHERE vec_id IS NOT NULL ORDER BY j LIMIT {k})"""]
    for t in range(rounds + 1):
        steps.append(f"a{t} AS (SELECT r, min((d, j)) AS best FROM (SELECT r, j, {square} AS d FROM v CROSS JOIN c{t}) GROUP BY r)")
        if t < rounds:
            steps.append(f"""u{t} AS (SELECT best[2] AS j, unnest(v) AS x, unnest(range(len(v))) AS i FROM a{t} JOIN v USING (r)),
s{t} AS (SELECT j, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM u{t} GROUP BY j, i),
m{t} AS (SELECT j, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM s{t} GROUP BY j),
c{t + 1} AS (SELECT j, coalesce(m{t}.c, c{t}.c) AS c FROM c{t} LEFT JOIN m{t} USING (j))""")
    return ",\n".join(steps) + f"""
SELECT vec_id, CAST(best[2] AS INTEGER) AS cluster, best[1] AS distance, CAST(sum(best[1]) OVER (PARTITION BY best[2]) AS BIGINT) AS cluster_inertia, CAST(sum(best[1]) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (r) JOIN c{rounds} ON j = best[2]
"""


ORACLE_SQL: dict[str, str] = {"op11_spelling_variants": _SPELLING_SQL, "op12_minhash_dedup": _MINHASH_SQL, "op13_centroids": _centroids_sql(), "op4_ngram_join": _NGRAM_SQL, "op6_line_dedup": _LINE_SQL, "op7_exact_topk": _TOPK_SQL}
