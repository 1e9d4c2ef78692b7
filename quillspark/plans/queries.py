"""Queries over the driver's tables and their twins in an SQL engine.

All documents, of any language, are the texts, ``source`` is the group; quality
labels make two sides.  Compared values are counts, exact steps, or rounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import discourse, lexical, shape
from ..functions import lexicons as L
from ..functions import text as T
from ..functions.folding import fold
from ..operators import bands, contrast, distance, panel, structure, syntax, vectors
from ..sources import replies
from ..sources.staged import staged
from . import fixtures, reports

QUERIES: dict = {}
SQL: dict[str, str] = {}

KEYS = ["doc_id"]
LONG_WORDS = 400


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("source").alias("grp"), "text")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents above the corpus word floor."""
    return documents(spark, sf_dir).where(F.regexp_count(T.prose(F.col("text")), F.lit(T.WORD)) > LONG_WORDS)


def sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").cast("int").alias("side"))
    return documents(spark, sf_dir).join(labels.where("quality is not null"), "doc_id")


# --- SQL building blocks -----------------------------------------------------


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words_sql(words: list[str]) -> str:
    return "(" + ", ".join(lit(w) for w in words) + ")"


def n_sql(column: str, *patterns: str) -> str:
    return "(" + " + ".join(f"len(regexp_extract_all({column}, {lit(p)}))" for p in patterns) + ")"


def prose_sql(text: str, joiner: str = "' '") -> str:
    body = f"regexp_replace(regexp_split_to_array(replace(coalesce({text}, ''), chr(160), ' '), {lit(T.BACK_MATTER)})[1], {lit(T.COMMENT)}, '', 'g')"
    split = f"regexp_split_to_array({body}, {lit(r'\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]')})"
    return f"array_to_string(list_filter({split}, lambda x: regexp_matches(x, {lit(T.KEPT_LINE)}) AND NOT regexp_matches(x, {lit(T.FOOTNOTE)})), {joiner})"


def sents_sql(text: str, least: int) -> str:
    marked = f"string_split(regexp_replace({text}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"
    return f"list_filter({marked}, lambda x: len(regexp_extract_all(x, '\\S+')) >= {least})"


PARENS = r"\([^)]*\)"


def no_parens_sql(text: str) -> str:
    return f"regexp_replace({text}, {lit(PARENS)}, '', 'g')"


def marked_sql(text: str) -> str:
    """Accented letters as underscores: the twin's word boundaries know ASCII only."""
    return f"regexp_replace({text}, '[À-ÖØ-öø-ÿĀ-ſ]', '_', 'g')"


DOCS = "docs AS (SELECT doc_id, source AS grp, text FROM documents)"
VIEWS = f"""{DOCS},
v0 AS (SELECT doc_id, grp, replace(coalesce(text, ''), chr(160), ' ') AS raw, {prose_sql('text')} AS p FROM docs),
v1 AS (SELECT *, replace({no_parens_sql('p')}, 'et al.', 'et al') AS pc FROM v0),
v2 AS (SELECT *, lower(pc) AS low, {marked_sql('lower(pc)')} AS marked, greatest({n_sql('pc', T.WORD)}, 1) AS words, {sents_sql('pc', 4)} AS sents FROM v1)"""
FIXED_VIEWS = VIEWS.replace(DOCS, f"{fixtures.sql('f_docs')}, docs AS (SELECT * FROM f_docs)")


def _count_sql() -> dict[str, str]:
    out = {n: n_sql("marked" if b == "low" and not any(r"\w" in p for p in ps) else b, *ps) for n, (b, ps) in L.SHAPE.items()}
    out["para_open_The"] = "len(list_filter(sents, lambda s: starts_with(s, 'The ')))"
    out["transition_open"] = f"len(list_filter(sents, lambda s: regexp_matches(s, {lit(L.TRANSITION_OPEN)})))"
    out["bold_run"] = f"len(list_filter(string_split(raw, chr(10)), lambda x: NOT regexp_matches(x, {lit(L.LIST_LINE)}) AND regexp_matches(x, {lit(L.BOLD_IN_LINE)})))"
    return out


COUNTS = _count_sql()
SHAPE_SELECT = ", ".join(f"CAST({e} AS BIGINT) AS {n}" for n, e in COUNTS.items())
FEATURES = VIEWS + f""",
v3 AS (SELECT *, CASE WHEN len(sents) > 0 THEN list_transform(sents, lambda s: CAST(len(regexp_extract_all(s, '\\S+')) AS DOUBLE)) ELSE [1.0::DOUBLE] END AS lens FROM v2),
v4 AS (SELECT *, list_sum(lens) / len(lens) AS m, list_sum(list_transform(lens, lambda x: x * x)) / len(lens) AS q FROM v3),
feats AS (SELECT doc_id, grp, floor(m * 10 + 0.5) / 10 AS mean_sent, floor(sqrt(greatest(q - m * m, 0)) / greatest(m, 1) * 100 + 0.5) / 100 AS burstiness_CV,
  CAST(floor(100.0 * len(list_filter(lens, lambda x: x < 8)) / greatest(len(sents), 1) + 0.5) AS DOUBLE) AS pct_short,
  {', '.join(f"CAST((200000 * {e} + words) // (2 * words) AS DOUBLE) / 100 AS {n}" for n, e in COUNTS.items())} FROM v4),
fl AS (UNPIVOT (SELECT * FROM feats) ON COLUMNS(* EXCLUDE (doc_id, grp)) INTO NAME feature VALUE value)"""
CORPUS = f"corp AS (SELECT * FROM docs WHERE {n_sql(prose_sql('text'), T.WORD)} > {LONG_WORDS})"
FW = f"""{DOCS}, {CORPUS},
t0 AS (SELECT doc_id, grp, regexp_extract_all(lower({no_parens_sql(prose_sql('text'))}), '[a-z]+') AS t FROM corp),
lex AS (SELECT unnest([{', '.join(lit(w) for w in L.FUNCTION_WORDS)}]) AS word),
u AS (SELECT doc_id, unnest(t) AS word FROM t0),
c AS (SELECT doc_id, word, count(*) AS n FROM u WHERE word IN (SELECT word FROM lex) GROUP BY ALL),
fw AS (SELECT t0.doc_id, grp, lex.word, greatest(len(t), 1) AS w, coalesce(n, 0) AS n, 1000.0::DOUBLE * coalesce(n, 0) / greatest(len(t), 1) AS rate FROM t0 CROSS JOIN lex LEFT JOIN c ON c.doc_id = t0.doc_id AND c.word = lex.word)"""
LOO = FW + """,
o AS (SELECT a.grp, a.doc_id, a.word, any_value(a.rate) AS rate, avg(b.rate) AS mean, CASE WHEN min(b.rate) = max(b.rate) THEN 0 ELSE stddev_pop(b.rate) END AS sd
  FROM fw a JOIN fw b ON a.grp = b.grp AND a.word = b.word AND a.doc_id <> b.doc_id GROUP BY 1, 2, 3),
z AS (SELECT *, CASE WHEN sd > 1e-9 THEN (rate - mean) / sd END AS z FROM o),
""" + f"delta AS (SELECT grp, doc_id, round(sum(abs(coalesce(z, 0))) / {len(L.FUNCTION_WORDS)}, 6) AS delta FROM z GROUP BY ALL)"


def _rounded_delta(spark, d):
    return distance.function_word_delta(corpus(spark, d), "grp", "doc_id").withColumn("delta", F.round("delta", 6))


# --- text, surface -----------------------------------------------------------


@query(f"WITH {DOCS} SELECT doc_id, CAST({n_sql(prose_sql('text'), T.WORD)} AS BIGINT) AS words FROM docs WHERE {n_sql(prose_sql('text'), T.WORD)} > {LONG_WORDS}")
def corpus_filter(spark, d):
    return corpus(spark, d).select("doc_id", F.regexp_count(T.prose(F.col("text")), F.lit(T.WORD)).cast("long").alias("words"))


@query(f"WITH {VIEWS} SELECT doc_id, CAST(words AS BIGINT) AS words, CAST(len(regexp_extract_all(low, '[a-z]+')) AS BIGINT) AS tokens, CAST(len(sents) AS BIGINT) AS sentences FROM v2")
def token_stats(spark, d):
    return shape.views(documents(spark, d), KEYS).select("doc_id", F.col("words").cast("long").alias("words"), F.size(T.tokens(F.col("low"))).cast("long").alias("tokens"), F.size("sents").cast("long").alias("sentences"))


@query(f"WITH {FIXED_VIEWS} SELECT doc_id, p AS prose, CAST(words AS BIGINT) AS words FROM v2")
def prose_views(spark, d):
    return shape.views(fixtures.frame(spark, "f_docs"), KEYS).select("doc_id", F.col("p").alias("prose"), F.col("words").cast("long").alias("words"))


@query(f"WITH {FEATURES} SELECT doc_id, mean_sent, burstiness_CV, pct_short FROM feats")
def sentence_rhythm(spark, d):
    return shape.features(documents(spark, d), KEYS).select("doc_id", "mean_sent", "burstiness_CV", "pct_short")


@query(f"WITH {VIEWS} SELECT doc_id, CAST(words AS BIGINT) AS words, {SHAPE_SELECT} FROM v2")
def shape_counts(spark, d):
    return shape.shape_counts(documents(spark, d), KEYS).withColumn("words", F.col("words").cast("long"))


@query(f"WITH {FIXED_VIEWS} SELECT doc_id, CAST(words AS BIGINT) AS words, {SHAPE_SELECT} FROM v2")
def shape_counts_golden(spark, d):
    return shape.shape_counts(fixtures.frame(spark, "f_docs"), KEYS).withColumn("words", F.col("words").cast("long"))


@query(f"WITH {FEATURES} SELECT doc_id, feature, value FROM fl")
def shape_rates(spark, d):
    return shape.long(shape.features(documents(spark, d), KEYS), KEYS)


_BASE = ", ".join(f"({lit(f)}, {L.DEFAULTS.get(f, L.MISSING_DEFAULT)}::DOUBLE, {L.BANDS.get(f, ('NULL', 'NULL'))[0]}, {L.BANDS.get(f, ('NULL', 'NULL'))[1]})" for f in L.FEATURES)
_RANK = "list_sort(list(value))[1 + CAST(round_even({q} * (count(*) - 1), 0) AS INTEGER)]"


@query(f"""WITH {FEATURES}, {CORPUS}, cf AS (SELECT * FROM fl WHERE doc_id IN (SELECT doc_id FROM corp)),
b(feature, base, lo, hi) AS (VALUES {_BASE}), g AS (SELECT grp, feature, count(*) AS n, {_RANK.format(q='0.8::DOUBLE')} AS p80 FROM cf GROUP BY ALL)
SELECT doc_id, sum(CASE WHEN lo IS NOT NULL THEN CAST(value < lo OR value > hi AS INTEGER) ELSE CAST(value > greatest(CASE WHEN n >= 8 THEN p80 ELSE base END, 0.1) AS INTEGER) END)::BIGINT AS flags
FROM cf JOIN b USING (feature) JOIN g USING (grp, feature) GROUP BY 1""")
def check_flags(spark, d):
    flags = bands.threshold_flags(shape.features(corpus(spark, d), ["grp", *KEYS]), "grp", KEYS)
    return flags.groupBy("doc_id").agg(F.sum(F.when(F.col("flag") != "ok", 1).otherwise(0)).alias("flags"))


@query(f"""WITH {FEATURES}, {CORPUS}, cf AS (SELECT * FROM fl WHERE doc_id IN (SELECT doc_id FROM corp) AND feature IN {words_sql(L.GLOSSED)}),
g AS (SELECT grp, feature, median(value) AS mid, {_RANK.format(q='0.25::DOUBLE')} AS p25, {_RANK.format(q='0.75::DOUBLE')} AS p75 FROM cf GROUP BY ALL)
SELECT doc_id, feature, value, p25, p75 FROM cf JOIN g USING (grp, feature) WHERE CASE WHEN feature IN {words_sql(L.LOWER_IS_TELL)} THEN value < 0.7::DOUBLE * mid ELSE value > 1.6::DOUBLE * mid + 0.2::DOUBLE END""")
def register_alignment(spark, d):
    return bands.alignment(shape.features(corpus(spark, d), ["grp", *KEYS]), "grp", KEYS).where("tells").select("doc_id", "feature", "value", "p25", "p75")


# --- function words ----------------------------------------------------------


@query(f"WITH {FW} SELECT doc_id, word, CAST(n AS BIGINT) AS n, CAST(w AS BIGINT) AS w FROM fw")
def fw_rates(spark, d):
    return distance.function_word_counts(corpus(spark, d), KEYS).select("doc_id", "word", "n", "w")


@query(f"WITH {FW} SELECT grp, word, round(avg(rate), 6) AS mean, round(stddev_pop(rate), 6) AS sd, count(*) AS n FROM fw GROUP BY ALL")
def fw_moments(spark, d):
    rates = distance.function_word_counts(corpus(spark, d), ["grp", *KEYS]).withColumn("rate", F.lit(1000.0) * F.col("n") / F.col("w"))
    return distance.group_moments(rates, "grp").select("grp", "word", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "n")


@query(f"WITH {LOO} SELECT * FROM delta")
def fw_delta_loo(spark, d):
    return _rounded_delta(spark, d)


@query(f"""WITH {LOO}, m AS (SELECT grp, median(delta) AS mid, count(*) AS n FROM delta GROUP BY 1),
k AS (SELECT grp, any_value(mid) AS mid, any_value(n) AS n, median(abs(delta - mid)) AS mad FROM delta JOIN m USING (grp) GROUP BY 1)
SELECT grp, doc_id, n, delta, CASE WHEN delta <= mid + 3 * 1.4826::DOUBLE * CASE WHEN mad = 0 THEN 1e-9 ELSE mad END THEN 'MIRRORS' ELSE 'OUTLIER' END AS verdict FROM delta JOIN k USING (grp) WHERE n >= 3""")
def fw_verdict(spark, d):
    return distance.verdicts(_rounded_delta(spark, d), "grp", "doc_id").select("grp", "doc_id", "n", "delta", "verdict")


@query(f"""WITH {LOO}, r AS (SELECT grp, doc_id, word, round(z, 6) AS zr FROM z WHERE round(z, 6) > 3)
SELECT grp, doc_id, CAST(row_number() OVER (PARTITION BY grp, doc_id ORDER BY zr DESC, word) AS INTEGER) AS rank, word, zr AS z FROM r QUALIFY rank <= 8""")
def overused_words(spark, d):
    return distance.overused(corpus(spark, d), "grp", "doc_id")


# --- folding and look-ups in lines ---------------------------------------------


@query("SELECT doc_id, md5(strip_accents(lower(coalesce(text, '')))) AS folded_md5 FROM documents")
def folded_texts(spark, d):
    return documents(spark, d).select("doc_id", F.md5(fold(F.coalesce("text", F.lit("")))).alias("folded_md5"))


_LINES = r"list_filter(regexp_split_to_array({}, '\n'), lambda x: length(x) >= 3)"


@query(f"""WITH b AS (SELECT DISTINCT unnest({_LINES.format("strip_accents(lower(text))")}) AS line FROM benchmark),
n AS (SELECT DISTINCT strip_accents(lower(unnest(regexp_extract_all(text, '[A-Z][a-zà-ÿ]{{3,}}')))) AS name FROM documents)
SELECT name, EXISTS (SELECT 1 FROM b WHERE contains(line, name)) AS found FROM n""")
def names_in_benchmark(spark, d):
    """Which capitalised words of the documents stand in a line of the benchmark."""
    lines = spark.read.parquet(f"{d}/benchmark.parquet").select(F.explode(F.split(fold(F.col("text")), "\n")).alias("line"))
    names = documents(spark, d).select(F.explode(T.tokens(F.col("text"), "[A-Z][a-zà-ÿ]{3,}")).alias("name")).distinct().select(fold(F.col("name")).alias("name")).distinct()
    known = structure.found_in_lines(names, lines, "name", "line", [])
    return names.join(known.withColumn("found", F.lit(True)), "name", "left").select("name", F.coalesce("found", F.lit(False)).alias("found"))


# --- lexical -----------------------------------------------------------------

_SYL = "greatest(len(regexp_extract_all(w, '[aeiouy]+')) - CASE WHEN ends_with(w, 'e') AND len(regexp_extract_all(w, '[aeiouy]+')) > 1 THEN 1 ELSE 0 END + CASE WHEN regexp_matches(w, '[^aeiouy]le$') THEN 1 ELSE 0 END, 1)"


@query(f"""WITH {VIEWS}, a AS (SELECT doc_id, list_transform(regexp_extract_all(p, '[A-Za-z]+'), lambda x: lower(x)) AS ws, len({sents_sql(no_parens_sql('p'), 3)}) AS ns FROM v0),
b AS (SELECT *, list_transform(ws, lambda w: {_SYL}) AS syl FROM a),
c AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS words, CAST(ns AS BIGINT) AS sentences, CAST(coalesce(list_sum(syl), 0) AS BIGINT) AS syllables, CAST(len(list_filter(syl, lambda x: x >= 3)) AS BIGINT) AS complex_words FROM b),
e AS (SELECT *, words::DOUBLE / greatest(sentences, 1) AS wps, syllables::DOUBLE / greatest(words, 1) AS spw, 100.0::DOUBLE * complex_words / greatest(words, 1) AS cx FROM (SELECT doc_id, words, sentences, syllables, complex_words FROM c))
SELECT doc_id, words, sentences, syllables, complex_words, round(206.835::DOUBLE - 1.015::DOUBLE * (greatest(words, 1)::DOUBLE / greatest(sentences, 1)) - 84.6::DOUBLE * spw, 6) AS flesch_ease,
  round(0.39::DOUBLE * (greatest(words, 1)::DOUBLE / greatest(sentences, 1)) + 11.8::DOUBLE * spw - 15.59::DOUBLE, 6) AS fk_grade, round(0.4::DOUBLE * ((greatest(words, 1)::DOUBLE / greatest(sentences, 1)) + cx), 6) AS gunning_fog FROM e""")
def readability(spark, d):
    rows = lexical.readability(documents(spark, d), KEYS)
    return rows.select("doc_id", "words", "sentences", "syllables", "complex_words", "flesch_ease", "fk_grade", "gunning_fog")


@query(f"""WITH {VIEWS}, a AS (SELECT doc_id, regexp_extract_all(lower(p), '[a-z'']+') AS t, list_filter(regexp_extract_all(lower(p), '[a-z]+'), lambda w: len(w) > 4) AS w FROM v0)
SELECT doc_id, CAST(len(t) AS BIGINT) AS tokens, CAST(len(list_filter(t, lambda x: x NOT IN {words_sql(L.FUNCTION_WORDS)})) AS BIGINT) AS content, CAST(len(w) AS BIGINT) AS long_tokens,
  CAST(len(list_filter(w, lambda x: regexp_matches(x, {lit(L.NOMINAL_SUFFIX)}) AND x NOT IN {words_sql(L.NOMINAL_STOP)})) AS BIGINT) AS nominal FROM a""")
def lexical_densities(spark, d):
    return lexical.densities(documents(spark, d), KEYS).select("doc_id", "tokens", "content", "long_tokens", "nominal")


def stems_sql(text: str) -> str:
    plain = f"regexp_replace(regexp_replace(replace({text}, chr(160), ' '), {lit(T.COMMENT)}, '', 'g'), {lit(r'[*`#>\[\]()]|\\[a-z]+')}, ' ', 'g')"
    words = f"list_filter(regexp_extract_all(lower({plain}), {lit(r"[a-z][a-z'\-]{2,}")}), lambda w: w NOT IN {words_sql(L.STEM_STOP)})"
    cases = " ".join(f"WHEN ends_with(w, {lit(s)}) AND len(w) >= {len(s) + 3} THEN left(w, len(w) - {len(s)})" for s in L.STEM_SUFFIXES)
    return f"list_transform({words}, lambda w: CASE {cases} ELSE w END)"


@query(f"""WITH {VIEWS}, a AS (SELECT doc_id, {stems_sql('p')} AS s FROM v0),
g AS (SELECT doc_id, unnest(list_transform(range(1, len(s) - 1), lambda i: s[i] || ' ' || s[i + 1] || ' ' || s[i + 2])) AS g FROM a),
c AS (SELECT doc_id, g, count(*) AS n FROM g GROUP BY ALL)
SELECT a.doc_id, CAST(coalesce(sum(n), 0) AS BIGINT) AS trigrams, CAST(coalesce(sum(CASE WHEN n > 1 THEN n ELSE 0 END), 0) AS BIGINT) AS repeated FROM a LEFT JOIN c USING (doc_id) GROUP BY 1""")
def trigram_repetition(spark, d):
    return lexical.trigram_repetition(documents(spark, d), KEYS).select("doc_id", "trigrams", "repeated")


@query(f"""WITH {VIEWS}, a AS (SELECT doc_id, {no_parens_sql('p')} AS pc FROM v0), b AS (SELECT doc_id, pc, lower(pc) AS low FROM a)
SELECT doc_id, CAST(len(regexp_extract_all(low, '[a-z]+')) AS BIGINT) AS tokens, CAST(greatest(len({sents_sql('pc', 4)}), 1) AS BIGINT) AS sentences, CAST({n_sql(marked_sql('low'), L.SUBORDINATORS)} AS BIGINT) AS subordinators,
  CAST({n_sql('low', ',')} AS BIGINT) AS commas, CAST(len(list_filter(regexp_extract_all(low, '[a-z]+'), lambda x: x IN {words_sql(L.FUNCTION_WORDS)})) AS BIGINT) AS function_words FROM b""")
def clause_profile(spark, d):
    return lexical.clause_profile(documents(spark, d), KEYS).select("doc_id", "tokens", "sentences", "subordinators", "commas", "function_words")


_RUN = """list_reduce([{'s': 0, 't': 0, 'r': 0, 'i': -1, 'p': -1}] || list({'s': 0, 't': 0, 'r': 0, 'i': i, 'p': p} ORDER BY i), lambda a, x:
  CASE WHEN a.t + CAST(x.p < a.s AS INTEGER) <= 0.72::DOUBLE * (x.i - a.s + 1) THEN {'s': x.i + 1, 't': 0, 'r': a.r + 1, 'i': x.i, 'p': x.p}
  ELSE {'s': a.s, 't': a.t + CAST(x.p < a.s AS INTEGER), 'r': a.r, 'i': x.i, 'p': x.p} END)"""
_DIVERSITY = f"""WITH {VIEWS}, a AS (SELECT doc_id, p, regexp_extract_all(lower(p), '[a-z]+') AS t FROM v0),
b AS (SELECT doc_id, 0 AS d, unnest(t) AS w, CAST(unnest(range(len(t))) AS INTEGER) AS i FROM a WHERE len(t) >= 50 UNION ALL SELECT doc_id, 1, unnest(list_reverse(t)), CAST(unnest(range(len(t))) AS INTEGER) FROM a WHERE len(t) >= 50),
c AS (SELECT doc_id, d, i, coalesce(lag(i) OVER (PARTITION BY doc_id, d, w ORDER BY i), -1) AS p FROM b),
e AS (SELECT doc_id, d, count(*)::DOUBLE AS n, {_RUN} AS z FROM c GROUP BY ALL),
f AS (SELECT doc_id, n, z.r + CASE WHEN n - z.s > 0 THEN (1 - z.t / greatest(n - z.s, 1.0::DOUBLE)) / (1 - 0.72::DOUBLE) ELSE 0 END AS runs FROM e),
g AS (SELECT doc_id, sum(CASE WHEN runs > 0 THEN n / runs ELSE n END) / 2 AS length FROM f GROUP BY 1),
h AS (SELECT a.doc_id, len(t) AS n, coalesce(floor(length * 10 + 0.5::DOUBLE) / 10, 0) AS mtld, list_transform({sents_sql(no_parens_sql('p'), 3)}, lambda s: CAST(len(regexp_extract_all(s, '\\S+')) AS DOUBLE)) AS lens FROM a LEFT JOIN g USING (doc_id)),
k AS (SELECT *, list_sum(lens) / len(lens) AS m, list_sum(list_transform(lens, lambda x: x * x)) / len(lens) AS q FROM h)
SELECT doc_id, mtld, CASE WHEN len(lens) < 2 OR n < 50 THEN 0 ELSE round(least(sqrt(greatest(q - m * m, 0)) / greatest(m, 1) / 1.2::DOUBLE, 1) * 50 + least(mtld / 120, 1) * 50, 2) END AS voice FROM k"""


@query(_DIVERSITY)
def lexical_diversity(spark, d):
    return discourse.voice(documents(spark, d), KEYS)


# --- discourse ---------------------------------------------------------------

_OPEN = f"len(list_filter(list_transform(string_split(regexp_replace(p, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: lower(regexp_extract(s, '^\\s*([A-Za-z]+)', 1))), lambda w: w IN {words_sql(L.IMPERATIVES)}))"
_DISCOURSE = {
    "words": n_sql("p", T.WORD), "sentences": "len(s)", "self_scores": n_sql("raw", L.SELF_SCORE), "connectives": n_sql("p", L.CONNECTIVE), "table_rows": n_sql("raw", r"(?m)^\s*\|"),
    "figure_refs": n_sql("raw", r"(?i)\b(?:figure|fig\.|table|tbl\.)\s*\d"), "appendix_headings": n_sql("raw", r"(?m)^##\s+(?:[A-Z]\b|Appendix\b)"),
    "proper_nouns": r"coalesce(list_sum(list_transform(s, lambda z: len(list_filter(regexp_extract_all(z, '[\p{L}\p{N}_][\p{L}\p{N}_''\-]*')[2:], lambda w: regexp_matches(w, '^[A-Z][a-z]'))))), 0)",
    "numerals": n_sql("p", r"\b\d+(?:[.,]\d+)?\b"), "examples": n_sql("p", L.EXAMPLE), "hedges": n_sql("p", L.HEDGE), "be_verbs": n_sql("p", *L.BE_VERB), "nominalisations": n_sql("p", L.NOMINALISATION),
    "prepositions": n_sql("p", L.PREPOSITION), "ad_words": n_sql("p", L.ADVERB, L.AD_ADJECTIVE), "waste": n_sql("p", L.WASTE), "stance": n_sql("p", *L.STANCE), "engagement": f"({n_sql('p', L.ENGAGEMENT, chr(92) + '?')} + {_OPEN})",
}
# an ASCII word boundary stands where a Unicode one does once accented letters are underscores
_DISCOURSE_SQL = ", v9 AS (SELECT * REPLACE (regexp_replace(p, '[\u00c0-\u024f]', '_', 'g') AS p) FROM v0), a AS (SELECT *, " + sents_sql(no_parens_sql("p"), 3) + " AS s FROM v9) SELECT doc_id, " + ", ".join(f"CAST({e} AS BIGINT) AS {n}" for n, e in _DISCOURSE.items()) + " FROM a"


@query(f"WITH {VIEWS} {_DISCOURSE_SQL}")
def discourse_counts(spark, d):
    return discourse.counts(documents(spark, d), KEYS)


@query(f"WITH {FIXED_VIEWS} {_DISCOURSE_SQL}")
def discourse_counts_golden(spark, d):
    return discourse.counts(fixtures.frame(spark, "f_docs"), KEYS)


_CAVEAT_SQL = f""", a AS (SELECT doc_id, {sents_sql(no_parens_sql('p'), 3)} AS s FROM v0), b AS (SELECT *, list_position(list_transform(s, lambda x: regexp_matches(x, {lit(L.PAYOFF)})), true) AS k FROM a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS sentences, CAST(len(list_filter(CASE WHEN coalesce(k, 0) > 0 THEN s[1:k - 1] ELSE s END, lambda x: regexp_matches(x, {lit(L.CAVEAT)}))) AS BIGINT) AS caveats FROM b"""


@query(f"WITH {VIEWS} {_CAVEAT_SQL}")
def caveat_order_documents(spark, d):
    return discourse.caveat_order(documents(spark, d), KEYS)


@query(f"WITH {FIXED_VIEWS} {_CAVEAT_SQL}")
def caveat_order(spark, d):
    return discourse.caveat_order(fixtures.frame(spark, "f_docs"), KEYS)


@query(f"""WITH {VIEWS}, a AS (SELECT doc_id, list_transform({sents_sql(no_parens_sql('p'), 3)}, lambda x: list_distinct(list_filter(regexp_extract_all(lower(x), {lit(r"[a-z][a-z'\-]+")}), lambda w: len(w) > 3 AND w NOT IN {words_sql(L.COHESION_STOP)}))) AS c FROM v0),
b AS (SELECT doc_id, list_filter(list_transform(range(1, len(c)), lambda i: CASE WHEN least(len(c[i]), len(c[i + 1])) > 0 THEN len(list_intersect(c[i], c[i + 1]))::DOUBLE / least(len(c[i]), len(c[i + 1])) END), lambda x: x IS NOT NULL) AS r FROM a)
SELECT doc_id, CAST(len(r) AS BIGINT) AS pairs, round(coalesce(list_sum(r), 0) / greatest(len(r), 1), 6) AS referential_cohesion FROM b""")
def cohesion(spark, d):
    return discourse.cohesion(documents(spark, d), KEYS)


_PARAGRAPHS = prose_sql("text", "chr(10)").replace("list_filter(regexp_split_to_array(", "list_filter(list_transform(regexp_split_to_array(", 1).replace(", lambda x: regexp_matches(x", ", lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x = '' OR regexp_matches(x", 1)
_MARKED_PARAGRAPHS = f"regexp_replace({_PARAGRAPHS}, '[\u00c0-\u024f]', '_', 'g')"
_SPREAD = "sqrt(greatest(list_sum(list_transform({0}, lambda x: x * x)) / len({0}) - (list_sum({0}) / len({0})) * (list_sum({0}) / len({0})), 0))"


@query(f"""WITH {VIEWS}, a AS (SELECT doc_id, regexp_replace(p, '[\u00c0-\u024f]', '_', 'g') AS p, regexp_split_to_array({_MARKED_PARAGRAPHS.replace('text', 'raw')}, '\\n\\s*\\n') AS paras FROM v0),
b AS (SELECT doc_id, {n_sql('p', L.HEDGE)} AS h, len({sents_sql(no_parens_sql('p'), 3)}) AS s, list_transform(paras, lambda y: {{'h': {n_sql('y', L.HEDGE)}, 's': len({sents_sql(no_parens_sql('y'), 3)})}}) AS z FROM a),
c AS (SELECT *, list_transform(list_filter(z, lambda q: q.s > 0), lambda q: q.h::DOUBLE / q.s) AS r FROM b)
SELECT doc_id, round(CASE WHEN s > 0 THEN h::DOUBLE / s ELSE 0 END, 6) AS hedge_mean,
  round(CASE WHEN s > 0 AND len(r) >= 2 AND list_sum(r) > 0 THEN {_SPREAD.format('r')} / (list_sum(r) / len(r)) ELSE 0 END, 6) AS hedge_spread FROM c""")
def hedge_rhythm(spark, d):
    return discourse.hedge_rhythm(documents(spark, d), KEYS)


_TASTE = f"""WITH {VIEWS.replace(DOCS, f"{DOCS}, {CORPUS}").replace("FROM docs)", "FROM corp)")},
n AS ({_DISCOURSE_SQL.replace(", v9 AS", "WITH v9 AS", 1)}),
k AS (WITH a AS (SELECT doc_id, {sents_sql(no_parens_sql('p'), 3)} AS s FROM v0), b AS (SELECT *, list_position(list_transform(s, lambda x: regexp_matches(x, {lit(L.PAYOFF)})), true) AS k FROM a)
  SELECT doc_id, len(list_filter(CASE WHEN coalesce(k, 0) > 0 THEN s[1:k - 1] ELSE s END, lambda x: regexp_matches(x, {lit(L.CAVEAT)}))) AS caveats, list_transform(s, lambda x: CAST(len(regexp_extract_all(x, '\\S+')) AS DOUBLE)) AS lens FROM b),
h AS (WITH a AS (SELECT doc_id, list_transform({sents_sql(no_parens_sql('p'), 3)}, lambda x: list_distinct(list_filter(regexp_extract_all(lower(x), {lit(r"[a-z][a-z'\-]+")}), lambda w: len(w) > 3 AND w NOT IN {words_sql(L.COHESION_STOP)}))) AS c FROM v0),
  b AS (SELECT doc_id, list_filter(list_transform(range(1, len(c)), lambda i: CASE WHEN least(len(c[i]), len(c[i + 1])) > 0 THEN len(list_intersect(c[i], c[i + 1]))::DOUBLE / least(len(c[i]), len(c[i + 1])) END), lambda x: x IS NOT NULL) AS r FROM a)
  SELECT doc_id, round(coalesce(list_sum(r), 0) / greatest(len(r), 1), 6) AS rc FROM b),
j AS (SELECT doc_id, grp, n.*, caveats, lens, rc, greatest(words, 1) AS w, CASE WHEN len(lens) > 0 THEN list_sum(lens) / len(lens) ELSE 0 END AS m, CASE WHEN len(lens) > 0 THEN {_SPREAD.format('lens')} ELSE 0 END AS dv,
  100.0::DOUBLE * nominalisations / greatest(words, 1) AS nom, 1000.0::DOUBLE * (proper_nouns + numerals + examples) / greatest(words, 1) AS con FROM v0 JOIN n USING (doc_id) JOIN k USING (doc_id) JOIN h USING (doc_id)),
m AS (SELECT doc_id, grp, caveats::DOUBLE AS caveat_before_payoff, round(1000.0::DOUBLE * connectives / w, 4) AS connective_density, round(1000.0::DOUBLE * (table_rows + figure_refs + appendix_headings) / w, 4) AS apparatus_load,
  round(con, 4) AS concreteness, round(nom, 4) AS nominalization, round(CASE WHEN len(lens) >= 2 AND words > 1 THEN ((1 - least(dv / greatest(m, 1), 1)) * 50 + least(m, 40) / 40 * 50 + least(round(nom, 2) * 5, 50) + greatest(0, 50 - least(round(con, 2), 50))) / 4 ELSE 0 END, 2) AS formality,
  CASE WHEN words > 1 THEN round(1000.0::DOUBLE * engagement / w, 4) ELSE 0 END AS engagement_markers, round(rc, 3) AS referential_cohesion FROM j),
u AS (UNPIVOT (SELECT * FROM m) ON COLUMNS(* EXCLUDE (doc_id, grp)) INTO NAME measure VALUE value),
g AS (SELECT grp, measure, min(value) AS low, max(value) AS high FROM u WHERE doc_id % 2 = 0 GROUP BY ALL)
SELECT grp, doc_id, measure, value, CASE WHEN CASE WHEN measure IN {words_sql([k for k, v in discourse.DIRECTIONS.items() if v == 'low_bad'])} THEN value >= low ELSE value <= high END THEN 'PASS' ELSE 'FAIL' END AS verdict FROM u JOIN g USING (grp, measure)"""


@query(_TASTE)
def taste_verdicts(spark, d):
    """Documents against the band of their group's exemplars, those of even id."""
    rows = discourse.measures(corpus(spark, d), ["grp", *KEYS])
    return discourse.against_band(rows, ["grp", *KEYS], discourse.exemplar_band(rows.where("doc_id % 2 = 0"), "grp"), "grp")


# --- two sides ---------------------------------------------------------------

SIDES = FEATURES + ", lab AS (SELECT fl.*, CAST(quality AS INTEGER) AS side FROM fl JOIN labels USING (doc_id) WHERE quality IS NOT NULL)"
AUC = SIDES + """, pr AS (SELECT a.feature, avg(CASE WHEN a.value > h.value THEN 1.0::DOUBLE WHEN a.value = h.value THEN 0.5 ELSE 0 END) AS auc FROM lab a JOIN lab h ON a.feature = h.feature AND a.side = 1 AND h.side = 0 GROUP BY 1)"""
_CATS = ", ".join(f"({lit(f)}, {lit(c)})" for f, c in {f: c for c, _, _, det in L.TAXONOMY for f in det.split()}.items())


@query(f"""WITH {AUC}, m AS (SELECT feature, median(value) FILTER (side = 0) AS mid0, median(value) FILTER (side = 1) AS mid1 FROM lab GROUP BY 1), cat(feature, category) AS (VALUES {_CATS})
SELECT feature, round(auc, 6) AS auc, round(mid0, 4) AS mid0, round(mid1, 4) AS mid1, category, CASE WHEN abs(auc - 0.5) >= 0.25 THEN 'strong' WHEN auc < 0.42 THEN 'invert' ELSE '' END AS mark FROM pr JOIN m USING (feature) LEFT JOIN cat USING (feature)""")
def feature_auc(spark, d):
    return contrast.feature_ranking(shape.features(sides(spark, d), [*KEYS, "side"]), "side", "doc_id")


@query(f"WITH {AUC}, cat(feature, category) AS (VALUES {_CATS}) SELECT category, round(avg(abs(round(auc, 6) - 0.5)), 6) AS support, count(*) AS n FROM pr JOIN cat USING (feature) GROUP BY 1")
def category_support(spark, d):
    return contrast.category_support(contrast.feature_ranking(shape.features(sides(spark, d), [*KEYS, "side"]), "side", "doc_id"))


@query(f"""WITH {AUC}, st AS (SELECT feature, auc > 0.5 AS up FROM pr WHERE abs(auc - 0.5) >= 0.1),
r AS (SELECT lab.*, up FROM lab JOIN st USING (feature)),
h AS (SELECT a.feature, a.doc_id, any_value(a.up) AS up, any_value(a.value) AS value, list_sort(list(b.value)) AS vs FROM r a JOIN r b ON a.feature = b.feature AND a.side = 0 AND b.side = 0 AND a.doc_id <> b.doc_id GROUP BY 1, 2),
a AS (SELECT x.feature, x.doc_id, any_value(x.up) AS up, any_value(x.value) AS value, list_sort(list(b.value)) AS vs FROM r x JOIN r b ON x.feature = b.feature AND x.side = 1 AND b.side = 0 GROUP BY 1, 2),
k AS (SELECT doc_id, 0 AS side, up, value, vs FROM h UNION ALL SELECT doc_id, 1, up, value, vs FROM a),
f AS (SELECT doc_id, side, sum(CASE WHEN up THEN CAST(value > vs[1 + CAST(round_even(0.8::DOUBLE * (len(vs) - 1), 0) AS INTEGER)] AS INTEGER) ELSE CAST(value < vs[1 + CAST(round_even(0.2::DOUBLE * (len(vs) - 1), 0) AS INTEGER)] AS INTEGER) END) AS flags FROM k GROUP BY ALL)
SELECT round((SELECT avg(CASE WHEN a.flags > h.flags THEN 1.0::DOUBLE WHEN a.flags = h.flags THEN 0.5 ELSE 0 END) FROM f a JOIN f h ON a.side = 1 AND h.side = 0), 6) AS auc,
  round((SELECT avg(CASE WHEN flags > (SELECT max(flags) FROM f WHERE side = 0) THEN 1.0::DOUBLE ELSE 0 END) FROM f WHERE side = 1), 6) AS strict_tpr""")
def loo_composite(spark, d):
    return contrast.loo_composite(shape.features(sides(spark, d), [*KEYS, "side"]), "side", "doc_id")


SIDE_DOCS = f"{DOCS}, sd AS (SELECT docs.*, CAST(quality AS INTEGER) AS side FROM docs JOIN labels USING (doc_id) WHERE quality IS NOT NULL)"


@query(f"""WITH {SIDE_DOCS}, u AS (SELECT side, unnest(regexp_extract_all(lower({prose_sql('text')}), {lit(r"[a-z][a-z'\-]+")})) AS word FROM sd),
w AS (SELECT word, count(*) FILTER (side = 0) AS c0, count(*) FILTER (side = 1) AS c1 FROM u GROUP BY 1), t AS (SELECT sum(c0) AS t0, sum(c1) AS t1 FROM w),
r AS (SELECT word, CAST(c1 AS BIGINT) AS c1, CAST(c0 AS BIGINT) AS c0, round((1000.0::DOUBLE * c1 / t1) / greatest(1000.0::DOUBLE * c0 / t0, 0.05), 6) AS ratio FROM w, t WHERE c1 >= greatest(6, 0.4::DOUBLE * (SELECT count(*) FROM sd WHERE side = 1)) AND len(word) > 3)
SELECT * FROM r WHERE ratio >= 2 ORDER BY ratio DESC, word LIMIT 24""")
def excess_words(spark, d):
    return contrast.excess_words(sides(spark, d), "side")


@query(f"""WITH {SIDE_DOCS}, u AS (SELECT side, unnest({stems_sql(prose_sql('text'))}) AS word FROM sd),
w AS (SELECT word, (count(*) FILTER (side = 0))::DOUBLE AS c0, (count(*) FILTER (side = 1))::DOUBLE AS c1 FROM u GROUP BY 1), t AS (SELECT sum(c0) AS t0, sum(c1) AS t1 FROM w),
a AS (SELECT *, 1000.0::DOUBLE * (c0 + c1) / (t0 + t1) AS a FROM w, t)
SELECT word, CAST(c1 AS BIGINT) AS c1, CAST(c0 AS BIGINT) AS c0, round(((ln(c1 + a) - ln(t1 + 1000 - c1 - a)) - (ln(c0 + a) - ln(t0 + 1000 - c0 - a))) / sqrt(1 / (c1 + a) + 1 / (c0 + a)), 5) AS z FROM a""")
def log_odds(spark, d):
    counts = contrast.term_counts(sides(spark, d), "side", lexical.stems(T.prose(F.col("text"))))
    return contrast.log_odds(counts, "side").withColumn("z", F.round("z", 5))


def _odds_sql(name: str, one: str, zero: str) -> str:
    return f"""{name} AS (SELECT word, ((ln(c1 + a) - ln(t1 + 1000 - c1 - a)) - (ln(c0 + a) - ln(t0 + 1000 - c0 - a))) / sqrt(1 / (c1 + a) + 1 / (c0 + a)) AS z FROM (
  SELECT *, 1000.0::DOUBLE * (c0 + c1) / (t0 + t1) AS a FROM (SELECT word, coalesce(sum(n) FILTER (role = '{zero}'), 0)::DOUBLE AS c0, coalesce(sum(n) FILTER (role = '{one}'), 0)::DOUBLE AS c1 FROM f_counts WHERE role IN ('{one}', '{zero}') GROUP BY 1),
  (SELECT sum(n) FILTER (role = '{zero}') AS t0, sum(n) FILTER (role = '{one}') AS t1 FROM f_counts)))"""


_OVERUSE = f"""{_odds_sql('dh', 'draft', 'human')}, {_odds_sql('mh', 'matched', 'human')}, {_odds_sql('dt', 'draft', 'on_topic')},
r AS (SELECT c.word, c.n, dh.z AS a, coalesce(mh.z, 0) AS b, coalesce(dt.z, 0) AS t, coalesce(zipf, 3.5) AS zipf FROM f_counts c JOIN dh USING (word) LEFT JOIN mh USING (word) LEFT JOIN dt USING (word) LEFT JOIN f_zipf USING (word) WHERE role = 'draft' AND c.n >= 3),
k AS (SELECT *, CASE WHEN a > 1.96 AND b > 1.5 AND zipf >= 3 THEN 'generic_slop' WHEN t > 1.96 AND n >= 5 THEN 'over_repetition' END AS channel FROM r)
SELECT channel, word, CAST(n AS BIGINT) AS n, round(CASE WHEN channel = 'generic_slop' THEN a ELSE t END, 4) AS z FROM k WHERE channel IS NOT NULL"""


@query(f"WITH {fixtures.sql('f_counts')}, {fixtures.sql('f_zipf')}, {_OVERUSE}")
def overuse_channels(spark, d):
    return contrast.overuse_channels(fixtures.frame(spark, "f_counts"), fixtures.frame(spark, "f_zipf"))


@query(f"""WITH rt AS (SELECT CASE WHEN role = 'assistant' THEN 'draft' ELSE 'human' END AS role, text FROM conversations
  UNION ALL SELECT 'on_topic', text FROM benchmark UNION ALL SELECT 'matched', text FROM documents),
f_counts AS (SELECT role, word, count(*) AS n FROM (SELECT role, unnest({stems_sql(prose_sql("coalesce(text, '')"))}) AS word FROM rt) GROUP BY ALL), f_zipf AS (SELECT '' AS word, 3.5::DOUBLE AS zipf WHERE false), {_OVERUSE}""")
def overuse_turns(spark, d):
    """Words that the assistant's turns over-use against the other turns, told
    apart by what documents and benchmark texts do."""
    turns = spark.read.parquet(f"{d}/conversations.parquet").select(F.when(F.col("role") == "assistant", "draft").otherwise("human").alias("role"), "text")
    others = [spark.read.parquet(f"{d}/{t}.parquet").select(F.lit(r).alias("role"), "text") for t, r in (("benchmark", "on_topic"), ("documents", "matched"))]
    return contrast.overuse_channels(reports.role_counts(turns.unionByName(others[0]).unionByName(others[1])))


REFERENCE_MODELS = ["first", "second"]


@query(f"""WITH {DOCS}, p AS (SELECT {prose_sql('text')} AS p FROM docs), t AS (SELECT {lit(reports.ASK_REFERENCE)} || substr(array_to_string(string_split_regex(trim(p, ' '), '\\s+')[1:25], ' '), 1, 200) AS prompt FROM p),
m AS (SELECT DISTINCT model, prompt FROM t, (VALUES {', '.join(f"({lit(m)})" for m in REFERENCE_MODELS)}) v(model) WHERE prompt IS NOT NULL)
SELECT sha256(model || chr(10) || prompt) AS key, model, prompt FROM m""")
def reference_requests(spark, d):
    """What would be asked for the references of every document's topic."""
    return replies.requests(reports.topic_prompts(documents(spark, d)), REFERENCE_MODELS)


@query()
def infer_syntax(spark, d):
    """The ranking of surface and syntax features together."""
    return reports.infer(sides(spark, d))["features"]


@query(f"""WITH {DOCS}, {CORPUS}, u AS (SELECT grp, unnest(regexp_extract_all(lower({prose_sql('text')}), '[a-z][a-z\\-]{{4,}}')) AS word FROM corp), c AS (SELECT grp, word, count(*) AS n FROM u GROUP BY ALL),
t AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY grp ORDER BY n DESC, word) <= 140)
SELECT grp, CAST(row_number() OVER (PARTITION BY grp ORDER BY n DESC, word) AS INTEGER) AS rank, word, n FROM t WHERE word NOT IN {words_sql(L.DICTION_STOP)} QUALIFY rank <= 25""")
def corpus_diction(spark, d):
    return contrast.diction(corpus(spark, d), "grp")


@query(f"WITH {FEATURES}, {CORPUS} SELECT grp, feature, round(median(value), 4) AS mid FROM fl WHERE doc_id IN (SELECT doc_id FROM corp) AND feature IN {words_sql(L.TEXTURE)} GROUP BY ALL HAVING median(value) <= 1")
def near_zero_texture(spark, d):
    return contrast.near_zero(shape.features(corpus(spark, d), ["grp", *KEYS]), "grp")


@query(f"""WITH {DOCS}, {CORPUS}, f AS (SELECT * FROM corp QUALIFY row_number() OVER (PARTITION BY grp ORDER BY doc_id) <= 6),
s AS (SELECT grp, doc_id, list_filter(string_split(regexp_replace({prose_sql('text')}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: len(regexp_extract_all(x, '\\S+')) BETWEEN 12 AND 38)[1:2] AS s FROM f)
SELECT grp, doc_id, unnest(s) AS sentence, CAST(unnest(range(len(s))) AS INTEGER) AS pos FROM s""")
def sentence_samples(spark, d):
    return contrast.sentence_samples(corpus(spark, d), "grp", "doc_id")


_CARD = f"""{fixtures.sql('f_cards')}, m AS (SELECT grp, count(*) AS n, {', '.join(f'coalesce(round(median({c}::DOUBLE), 2), 0) AS {c}' for c in bands.CARD_SHAPE + bands.CARD_SYNTAX + bands.CARD_HEADINGS)} FROM f_cards GROUP BY 1),
cards AS (SELECT grp, n, title_case AS h_case, colon AS h_colon, mean_words AS h_words, compound AS h_compound,
  round(nominal_rate + noun_rate / 5 + that_density, 1) AS info_density, round(first_person + pron_rate / 10, 1) AS involvement,
  round(meta_narration + metanarr_synt + hedge_modal / 5, 1) AS metadiscourse, round(vague_eval_adj + intensifier + not_but, 1) AS stance, round(abstract_subj + nominal_rate / 10, 1) AS abstraction,
  burstiness_CV AS rhythm_cv, mean_sent, CASE WHEN title_case < 0.3 THEN 'sentence-case' WHEN title_case > 0.6 THEN 'Title Case' ELSE 'mixed-case' END AS heading_case,
  CASE WHEN compound > 0.3 THEN 'content-announcing' ELSE 'topic-naming' END AS heading_style, CASE WHEN burstiness_CV > 0.4 THEN 'varied' ELSE 'uniform' END AS rhythm FROM m)"""


def _cards(spark):
    rows = fixtures.frame(spark, "f_cards")
    headings = rows.where("title_case is not null").select("grp", *bands.CARD_HEADINGS)
    return bands.register_card(rows.select("grp", *bands.CARD_SHAPE), rows.select("grp", *bands.CARD_SYNTAX), headings, "grp")


@query(f"WITH {_CARD} SELECT * FROM cards")
def register_card(spark, d):
    return _cards(spark)


@query(f"""WITH {_CARD}, l AS (UNPIVOT (SELECT grp, h_case::DOUBLE AS h_case, info_density::DOUBLE AS info_density, involvement::DOUBLE AS involvement, metadiscourse::DOUBLE AS metadiscourse, stance::DOUBLE AS stance, abstraction::DOUBLE AS abstraction FROM cards)
  ON h_case, info_density, involvement, metadiscourse, stance, abstraction INTO NAME dimension VALUE v)
SELECT dimension, max(CASE WHEN grp = 'g' THEN v END) AS a, max(CASE WHEN grp = 'h' THEN v END) AS b, round(max(CASE WHEN grp = 'g' THEN v END) - max(CASE WHEN grp = 'h' THEN v END), 2) AS lead FROM l GROUP BY 1""")
def register_differential(spark, d):
    return bands.register_differential(_cards(spark), "grp", "g", "h")


@query()
def register_card_documents(spark, d):
    """The card of every source, with the stand-in annotator's syntax rates."""
    docs = corpus(spark, d)
    repeated = staged(documents(spark, d).groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1 and doc_id is not null").select("doc_id"), "repeated")
    named = docs.where("doc_id is not null")
    if repeated.isEmpty():
        rates = syntax.card_rates(named, ["grp"])
    else:
        many = docs.join(repeated, "doc_id", "left_semi")
        rates = syntax.card_rates(named.join(repeated, "doc_id", "left_anti"), ["grp"])
        shared = syntax.rates(syntax.annotate(many, most=None)).join(many.select("doc_id", "grp"), "doc_id")
        rates = rates.unionByName(shared.select(*rates.columns))
    return bands.register_card(shape.features(docs, ["grp", *KEYS]), rates, structure.heading_features(docs, ["grp", *KEYS]), "grp")


# --- vectors -----------------------------------------------------------------


def _vectors(spark, d):
    """Every vector: labels from 5 on against the rest."""
    rows = spark.read.parquet(f"{d}/embeddings.parquet")
    return rows.select("vec_id", F.when(F.col("label") >= 5, 1).otherwise(0).alias("side"), "embedding")


_UNIT = "list_transform(embedding, lambda x: x::DOUBLE / greatest(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-12))"
_VEC = f"""vv AS (SELECT vec_id, CASE WHEN label >= 5 THEN 1 ELSE 0 END AS side, {_UNIT} AS v FROM embeddings),
uu AS (SELECT vec_id, side, unnest(v) AS x, unnest(range(len(v))) AS i FROM vv),
ss AS (SELECT side, i, sum(x) AS s FROM uu GROUP BY ALL),
pp AS (SELECT u.vec_id, u.side, p.side AS proto, u.x, CASE WHEN p.side = u.side THEN p.s - u.x ELSE p.s END AS y FROM uu u JOIN ss p ON p.i = u.i),
dd AS (SELECT vec_id, side, proto, sum(x * y) / greatest(sqrt(sum(y * y)), 1e-12) AS near FROM pp GROUP BY ALL),
mm AS (SELECT vec_id, side, sum(CASE WHEN proto = 1 THEN near ELSE -near END) AS margin FROM dd GROUP BY ALL)"""


_MARGINS = f"""WITH {_VEC}, th AS (SELECT (median(margin) FILTER (side = 0) + median(margin) FILTER (side = 1)) / 2 AS t FROM mm)
SELECT vec_id, side, round(margin, 6) AS margin, round(margin, 6) > round(t, 6) AS side_1 FROM mm, th"""


@query(_MARGINS)
def prototype_margins(spark, d):
    rows = _vectors(spark, d)
    return vectors.margin_verdicts(vectors.prototype_margins(rows, "vec_id", "side", "embedding"), "side", "vec_id")


_AXIS = """WITH e AS (SELECT vec_id, CASE WHEN label >= 5 THEN 1 ELSE 0 END AS side, embedding::DOUBLE[] AS v FROM embeddings),
u AS (SELECT vec_id, side, unnest(v) AS x, unnest(range(len(v))) AS i FROM e),
m AS (SELECT i, avg(x) FILTER (side = 1) - avg(x) FILTER (side = 0) AS a FROM u GROUP BY 1),
p AS (SELECT vec_id, sum(x * a) / (SELECT sqrt(sum(a * a)) FROM m) AS t FROM u JOIN m USING (i) GROUP BY 1)
SELECT 'first' AS feature, round(corr(t, v[1]), 6) AS r FROM p JOIN e USING (vec_id) UNION ALL SELECT 'second', round(corr(t, v[2]), 6) FROM p JOIN e USING (vec_id)"""


def _axis(rows: DataFrame) -> DataFrame:
    features = rows.select("vec_id", F.get("embedding", F.lit(0)).cast("double").alias("first"), F.get("embedding", F.lit(1)).cast("double").alias("second"))
    return vectors.axis_correlations(rows, "vec_id", "side", "embedding", features, ["first", "second"])


@query(_AXIS)
def axis_correlations(spark, d):
    return _axis(_vectors(spark, d))


@query()
def probe_r2(spark, d):
    """How well vectors tell their side and two made-up targets: a component with
    as much noise as signal, and noise alone."""
    rows = spark.read.parquet(f"{d}/embeddings.parquet").where("label is not null")
    noise = F.pmod(F.xxhash64("vec_id"), F.lit(2001)) / 1000.0 - 1.0
    spread = rows.select(F.stddev_pop(F.get("embedding", F.lit(0))).alias("s")).first().s or 1.0
    targets = {"side": F.when(F.col("label") >= 5, 1.0).otherwise(0.0), "half": F.get("embedding", F.lit(0)) / spread + noise * 3**0.5, "noise": noise}
    return vectors.probes(rows.withColumns(targets), "embedding", list(targets)).select("feature", F.round("r2", 3).alias("r2"))


@query()
def probe_features(spark, d):
    """How much of each surface feature of a document the vector of the same id
    tells: all features in one pass."""
    features = shape.features(documents(spark, d), KEYS)
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), "embedding").join(features, "doc_id")
    return vectors.probes(rows, "embedding", L.FEATURES).select("feature", F.round("r2", 3).alias("r2"))


_CHUNKS = f"""WITH {DOCS}, {CORPUS}, w AS (SELECT doc_id, regexp_split_to_array(trim(regexp_replace({no_parens_sql(prose_sql('text'))}, '\\s+', ' ', 'g')), ' ') AS w FROM corp),
c AS (SELECT doc_id, w, unnest(range(least(CAST(ceil(len(w) / 120.0) AS INTEGER), 48))) AS k FROM w)
SELECT doc_id, CAST(k AS INTEGER) AS chunk, md5(array_to_string(w[k * 120 + 1:k * 120 + 120], ' ')) AS digest FROM c"""


_BUDGET = 1200
_CUTS = f"""list_reduce([{{'i': -1, 'n': 0, 'c': []::INTEGER[]}}] || list_transform(rest, lambda x, i: {{'i': CAST(i - 1 AS INTEGER), 'n': CAST(len(x) + 2 AS INTEGER), 'c': []::INTEGER[]}}),
  lambda a, x: CASE WHEN a.n > 0 AND a.n + x.n > {_BUDGET} THEN {{'i': x.i, 'n': x.n, 'c': list_append(a.c, x.i)}} ELSE {{'i': x.i, 'n': a.n + x.n, 'c': a.c}} END)"""


@query(f"""WITH {DOCS}, t AS (SELECT doc_id, replace(coalesce(text, ''), '. ', '.' || chr(10) || chr(10)) AS text FROM docs), a AS (SELECT doc_id, text, string_split(text, chr(10) || chr(10)) AS p FROM t),
b AS (SELECT *, list_transform(p, lambda x: substr(x, CAST(greatest(ceil(len(x)::DOUBLE / {_BUDGET}) - 1, 0) * {_BUDGET} + 1 AS BIGINT))) AS rest FROM a WHERE length(text) > {_BUDGET}),
c AS (SELECT *, [0] || {_CUTS}.c || [len(p)] AS cuts FROM b),
s AS (SELECT doc_id, p, rest, unnest(list_zip(cuts[:-2], cuts[2:])) AS v FROM c),
e AS (SELECT doc_id, v[2] AS pos, 1 AS kind, 0 AS piece, trim(array_to_string(rest[v[1] + 1:v[2]], chr(10) || chr(10)), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)) AS text, len(p) AS n FROM s),
q AS (SELECT doc_id, i - 1 AS pos, p[i] AS x, unnest(range(CAST(greatest(ceil(len(p[i])::DOUBLE / {_BUDGET}) - 1, 0) AS BIGINT))) AS piece FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM b)),
u AS (SELECT doc_id, pos, kind, piece, text FROM e WHERE pos < n OR text <> '' UNION ALL SELECT doc_id, pos, 0, piece, substr(x, piece * {_BUDGET} + 1, {_BUDGET}) FROM q UNION ALL SELECT doc_id, 0, 0, 0, text FROM t WHERE length(text) <= {_BUDGET})
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos, kind, piece) - 1 AS INTEGER) AS part, md5(text) AS digest FROM u""")
def context_parts(spark, d):
    """Documents, each sentence a paragraph, in parts of 1200 characters."""
    docs = documents(spark, d).withColumn("text", F.replace("text", F.lit(". "), F.lit(".\n\n")))
    return panel.context_parts(docs, KEYS, _BUDGET).select("doc_id", "part", F.md5("text").alias("digest"))


@query(_CHUNKS)
def style_chunks(spark, d):
    return vectors.chunks(corpus(spark, d), KEYS).select("doc_id", F.col("chunk").cast("int").alias("chunk"), F.md5("text").alias("digest"))


@query(_CHUNKS.replace("least(CAST(ceil(len(w) / 120.0) AS INTEGER), 48)", "CAST(ceil(len(w) / 120.0) AS INTEGER)"))
def style_chunks_whole(spark, d):
    return vectors.chunks(corpus(spark, d), KEYS, most=None).select("doc_id", F.col("chunk").cast("int").alias("chunk"), F.md5("text").alias("digest"))


# --- structure ---------------------------------------------------------------

HEADED = fixtures.sql("f_headed")
_LATEX = r"\\[a-zA-Z]+\*?|[{}]"
_HEADS = f"""{HEADED}, hl AS (SELECT doc_id, grp, text, string_split(text, chr(10)) AS ls FROM f_headed),
hh AS (SELECT doc_id, grp, text, CASE WHEN len(list_filter(ls, lambda x: starts_with(x, '# '))) > 0 THEN trim(list_filter(ls, lambda x: starts_with(x, '# '))[1][3:]) ELSE trim(regexp_replace(regexp_extract(text, '\\\\title\\{{((?:[^{{}}]|\\{{[^}}]*)*)\\}}', 1), {lit(_LATEX)}, '', 'g')) END AS title,
  list_filter(list_concat(list_transform(list_filter(ls, lambda x: regexp_matches(x, '^###?\\s')), lambda x: trim(regexp_replace(x, '^#+\\s*\\d+(?:\\.\\d+)*\\.?\\s*', ''))),
  list_transform(regexp_extract_all(text, '\\\\(?:sub)?section\\*?\\{{([^}}]*)\\}}', 1), lambda x: trim(regexp_replace(x, {lit(_LATEX)}, '', 'g')))), lambda h: h <> '' AND lower(h) <> 'abstract') AS heads FROM hl)"""
_HEADS = _HEADS.replace("((?:[^{}]|\\{[^}]*)*)", "([^}]*)")


@query(f"WITH {_HEADS} SELECT doc_id, title, array_to_string(heads, '|') AS heads FROM hh")
def heading_lists(spark, d):
    return structure.headings(fixtures.frame(spark, "f_headed"), KEYS).select("doc_id", "title", F.array_join("heads", "|").alias("heads"))


_CONTENT = f"list_filter(regexp_extract_all(lower(h), {lit(r"[a-z][a-z'\-]{2,}")}), lambda w: w NOT IN {words_sql(L.NOMINAL_STOP)})"
_NOMINAL = f"(CASE WHEN len({_CONTENT}) > 0 THEN floor(len(list_filter({_CONTENT}, lambda w: regexp_matches(w, {lit(L.NOMINAL_SUFFIX)}))) * 100.0::DOUBLE / len({_CONTENT}) + 0.5) / 100 ELSE 0 END)"
_REST = f"regexp_extract_all(h, {lit(r"[A-Za-z][A-Za-z'\-]+")})[2:]"
_TITLE = f"(CASE WHEN len({_REST}) > 0 THEN floor(len(list_filter({_REST}, lambda w: regexp_matches(w, '^[A-Z]') AND lower(w) NOT IN {words_sql(L.TITLE_CASE_EXEMPT)})) * 100.0::DOUBLE / len({_REST}) + 0.5) / 100 ELSE 0 END)"


def _share_sql(source: str, test: str, of: str) -> str:
    return f"round(len(list_filter({source}, lambda h: {test}))::DOUBLE / {of}, 4)"


@query(f"""WITH {_HEADS}, aa AS (SELECT *, CASE WHEN title <> '' THEN list_concat([title], heads) ELSE heads END AS al, greatest(len(heads), 1) AS nh FROM hh), bb AS (SELECT *, len(al) AS na FROM aa WHERE len(al) > 0)
SELECT doc_id, round(list_sum(list_transform(al, lambda h: {_TITLE})) / na, 4) AS title_case, round(list_sum(list_transform(al, lambda h: len(regexp_extract_all(h, '\\S+'))::DOUBLE)) / na, 4) AS mean_words,
  round(list_sum(list_transform(al, lambda h: {_NOMINAL})) / na, 4) AS nominalization, {_share_sql('heads', "regexp_matches(lower(h), '\\b(?:and|or)\\b')", 'nh')} AS compound, {_share_sql('al', "regexp_matches(h, '(?i)^towards?\\b')", 'na')} AS toward,
  {_share_sql('al', "regexp_matches(lower(h), '\\bnot\\b')", 'na')} AS antithesis, {_share_sql('al', "contains(h, ':')", 'na')} AS colon, {_share_sql('al', "contains(h, '\"') OR contains(h, '“')", 'na')} AS quoted,
  {_share_sql('heads', "contains(h, ',')", 'na')} AS comma, {_share_sql('al', f"regexp_matches(h, {lit(L.SELF_CONGRATULATION)})", 'na')} AS selfcong, {_share_sql('al', f"regexp_matches(h, {lit(L.INTERROGATIVE)}) OR ends_with(h, '?')", 'na')} AS interrogative FROM bb""")
def heading_feats(spark, d):
    return structure.heading_features(fixtures.frame(spark, "f_headed"), KEYS)


@query(f"WITH {_HEADS}, e AS (SELECT doc_id, unnest(heads) AS h FROM hh) SELECT doc_id, h AS heading, {_NOMINAL} AS rate FROM e WHERE len({_CONTENT}) >= 2 AND {_NOMINAL} >= 0.6 AND lower(h) NOT IN {words_sql(L.STANDARD_HEADINGS)}")
def abstract_headings(spark, d):
    return structure.abstract_headings(fixtures.frame(spark, "f_headed"), KEYS)


@query()
def interrogative_headings(spark, d):
    return structure.interrogative_headings(fixtures.frame(spark, "f_headed"), KEYS)


@query()
def heading_flags(spark, d):
    docs = fixtures.frame(spark, "f_headed")
    rows = structure.heading_features(docs, ["grp", *KEYS])
    return structure.heading_flags(rows, "grp", KEYS).withColumn("rule", F.lit("mirror")).unionByName(structure.heading_flags(rows, "grp", KEYS, "conventions").withColumn("rule", F.lit("conventions")))


_SECTIONS = f"""{HEADED}, sp AS (SELECT doc_id, grp, string_split(regexp_replace(text, {lit(T.SECTION_LINE.replace('[^\\S\\n]+', '[ \\t]+'))}, chr(1) || '\\1\\2' || chr(1), 'g'), chr(1)) AS q FROM f_headed),
sec AS (SELECT doc_id, grp, CAST(k AS INTEGER) AS pos, trim(q[2 * k + 2]) AS title, q[2 * k + 3] AS body FROM (SELECT *, unnest(range((len(q) - 1) // 2)) AS k FROM sp))"""


@query(f"WITH {_SECTIONS} SELECT doc_id, pos, title, md5(body) AS body FROM sec")
def section_split(spark, d):
    return structure.sections(fixtures.frame(spark, "f_headed"), KEYS).select("doc_id", F.col("pos").cast("int").alias("pos"), "title", F.md5("body").alias("body"))


def _type_sql(genre: str, title: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower({title}), {lit(p)}) THEN {lit(n)}" for n, p in L.SECTION_TYPES[genre]) + " ELSE 'other' END"


_NAMED = "nm AS (SELECT *, trim(regexp_replace(title, '^\\d+(?:\\.\\d+)*\\.?\\s*', '')) AS name FROM sec)"


@query(f"""WITH {_SECTIONS}, {_NAMED}, k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM nm WHERE name <> '' AND lower(name) <> 'abstract')
SELECT doc_id, CAST(i AS INTEGER) AS i, name, {_type_sql('academic', 'name')} AS type, floor(i * 100.0::DOUBLE / n + 0.5) / 100 AS place FROM k""")
def section_order(spark, d):
    return structure.section_order(fixtures.frame(spark, "f_headed"), KEYS)


@query(f"""WITH {_SECTIONS}, kept AS (SELECT *, len(regexp_extract_all({prose_sql('body')}, '\\S+')) AS l FROM sec WHERE len(regexp_extract_all(body, '\\S+')) >= 30),
c AS (SELECT f.grp, f.doc_id, count(k.pos) AS k FROM f_headed f LEFT JOIN kept k USING (doc_id) GROUP BY ALL)
SELECT grp, n, CAST(floor(m) AS BIGINT) AS sections_mid, CAST(floor(l) AS BIGINT) AS length_mid FROM (SELECT grp, count(*) AS n, median(k) AS m FROM c GROUP BY 1) LEFT JOIN (SELECT grp, median(l) AS l FROM kept GROUP BY 1) USING (grp)""")
def structure_profile(spark, d):
    return structure.structure_profile(fixtures.frame(spark, "f_headed"), "grp", "doc_id")


@query(f"""WITH {_SECTIONS}, t AS (SELECT grp, doc_id, {_type_sql('essay', "regexp_replace(title, '^#*\\s*\\d*\\.?\\s*', '')")} AS ty FROM sec),
m AS (SELECT f.grp, f.doc_id, max(CAST(ty = 'hook' AS INTEGER)) AS a, max(CAST(ty = 'example' AS INTEGER)) AS b, max(CAST(ty = 'objection' AS INTEGER)) AS c FROM f_headed f LEFT JOIN t USING (doc_id) GROUP BY ALL)
SELECT grp, count(*) AS n, round(avg(coalesce(a, 0)), 4) AS hook_rate, round(avg(coalesce(b, 0)), 4) AS example_rate, round(avg(coalesce(c, 0)), 4) AS objection_rate FROM m GROUP BY 1""")
def essay_rates(spark, d):
    return structure.genre_rates(fixtures.frame(spark, "f_headed"), "grp", "doc_id", "essay")


@query(f"""WITH {_SECTIONS}, t AS (SELECT grp, doc_id, {_type_sql('design-doc', "regexp_replace(title, '^#*\\s*\\d*\\.?\\s*', '')")} AS ty FROM sec),
m AS (SELECT f.grp, f.doc_id, max(CAST(ty = 'motivation' AS INTEGER)) AS a, max(CAST(ty = 'tradeoff' AS INTEGER)) AS b, max(CAST(ty = 'consequence' AS INTEGER)) AS c FROM f_headed f LEFT JOIN t USING (doc_id) GROUP BY ALL)
SELECT grp, count(*) AS n, round(avg(coalesce(a, 0)), 4) AS motivation_rate, round(avg(coalesce(b, 0)), 4) AS tradeoff_rate, round(avg(coalesce(c, 0)), 4) AS consequence_rate FROM m GROUP BY 1""")
def design_doc_rates(spark, d):
    return structure.genre_rates(fixtures.frame(spark, "f_headed"), "grp", "doc_id", "design-doc")


@query()
def academic_rates(spark, d):
    docs = fixtures.frame(spark, "f_headed")
    return structure.genre_rates(docs, "grp", "doc_id", "academic").join(structure.related_position(docs, "grp", "doc_id").drop("n"), "grp", "left")


_GENRE_APPLIES = "a AS (SELECT *, greatest(2, n // 2) AS two, greatest(1, n // 2) AS one FROM g)"


@query(f"""WITH {fixtures.sql('f_genres')}, t AS (SELECT grp, text, lower({prose_sql('text')}) AS p FROM f_genres),
g AS (SELECT grp, count(*) AS n, count(*) FILTER (WHERE regexp_matches(text, {lit(L.README)})) AS readme, sum(len(text) - len(replace(text, '```', ''))) AS fences,
  1000.0 * sum({n_sql('p', L.VOICE)}) / greatest(1, sum({n_sql('p', r'[^ ]+')})) AS voiced, sum({n_sql('p', L.ARGUMENT)}) AS argued, count(*) FILTER (WHERE regexp_matches(text, {lit(L.ACADEMIC_MARK)})) AS papers,
  count(*) FILTER (WHERE regexp_matches(text, {lit(L.ACADEMIC_ANY)})) AS any_paper, count(*) FILTER (WHERE regexp_matches(text, {lit(L.ESSAY_NOT)})) AS not_essay,
  count(*) FILTER (WHERE regexp_matches(text, '(?m)^#{{1,4}}\\s')) AS headed, sum({n_sql('text', L.ARGUING)}) AS arguing, sum({n_sql('text', L.SPEAKING)}) AS speaking FROM t GROUP BY 1), {_GENRE_APPLIES}
SELECT grp, CASE WHEN readme > 0 THEN 'none' WHEN fences = 0 AND voiced >= 12 AND argued >= 4 THEN 'essay' WHEN papers >= two THEN 'academic'
  WHEN not_essay = 0 AND headed >= 1 AND arguing >= 3 AND speaking >= 10 THEN 'essay' WHEN headed >= one AND any_paper < two THEN 'design-doc' ELSE 'none' END AS genre FROM a""")
def genre_resolution(spark, d):
    return structure.resolve_genre(fixtures.frame(spark, "f_genres"), "grp")


@query()
def genre_resolution_documents(spark, d):
    return structure.resolve_genre(documents(spark, d), "grp")


@query(f"""WITH {_SECTIONS}, w AS (SELECT doc_id, greatest({n_sql(prose_sql('body'), T.WORD)}, 1) AS w FROM sec), c AS (SELECT doc_id, CASE WHEN count(*) >= 2 THEN round(stddev_pop(w) / avg(w), 6) ELSE 0 END AS v FROM w GROUP BY 1)
SELECT doc_id, coalesce(v, 0) AS section_cv FROM f_headed LEFT JOIN c USING (doc_id)""")
def section_lengths(spark, d):
    return structure.section_lengths_cv(fixtures.frame(spark, "f_headed"), KEYS)


_STEMMED = f"""st AS (SELECT doc_id, pos, regexp_replace(title, '^\\d+\\.?\\s*', '') AS name, {prose_sql('body')} AS p FROM sec), te AS (SELECT doc_id, pos, unnest({stems_sql('p')}) AS term, p FROM st)"""


@query(f"""WITH {_SECTIONS}, {_STEMMED}, big AS (SELECT doc_id, pos, name FROM st WHERE len(regexp_extract_all(p, '\\S+')) > 120), c AS (SELECT doc_id, pos, term, count(*) AS n FROM te SEMI JOIN big USING (doc_id, pos) GROUP BY ALL),
nm AS (SELECT doc_id, pos, sqrt(sum(n * n)) AS norm FROM c GROUP BY ALL), dt AS (SELECT a.doc_id, a.pos AS i, b.pos AS j, sum(a.n * b.n) AS dot FROM c a JOIN c b ON a.doc_id = b.doc_id AND a.term = b.term AND a.pos < b.pos GROUP BY ALL),
pr AS (SELECT a.doc_id, a.pos AS i, b.pos AS j, a.name AS first, b.name AS second, round(coalesce(dot / (x.norm * y.norm), 0), 2) AS cosine FROM big a JOIN big b ON a.doc_id = b.doc_id AND a.pos < b.pos JOIN nm x ON x.doc_id = a.doc_id AND x.pos = a.pos JOIN nm y ON y.doc_id = b.doc_id AND y.pos = b.pos LEFT JOIN dt ON dt.doc_id = a.doc_id AND dt.i = a.pos AND dt.j = b.pos)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, i, j) AS INTEGER) AS rank, first, second, cosine, cosine >= 0.6 AS restated FROM pr QUALIFY rank <= 6""")
def section_redundancy(spark, d):
    return structure.section_redundancy(fixtures.frame(spark, "f_headed"), "doc_id")


@query(f"""WITH {VIEWS}, w AS (SELECT doc_id, list_filter(regexp_split_to_array(trim(regexp_replace({no_parens_sql('p')}, '\\s+', ' ', 'g')), ' '), lambda x: x <> '') AS ws FROM v0),
b AS (SELECT doc_id, unnest(range(CAST(ceil(len(ws) / 150.0) AS BIGINT))) AS k, ws FROM w), t AS (SELECT doc_id, k, array_to_string(ws[150 * k + 1:150 * k + 150], ' ') AS body FROM b),
e AS (SELECT doc_id, k, unnest({stems_sql('body')}) AS term FROM t), c AS (SELECT doc_id, k, term, count(*) AS n FROM e GROUP BY ALL),
nm AS (SELECT doc_id, k, sqrt(sum(n * n)) AS norm FROM c GROUP BY ALL), dt AS (SELECT x.doc_id, x.k AS a, y.k AS b, sum(x.n * y.n) AS dot FROM c x JOIN c y ON x.doc_id = y.doc_id AND x.term = y.term AND x.k < y.k GROUP BY ALL),
pr AS (SELECT x.doc_id, x.k AS a, y.k AS b, round(coalesce(dot / (u.norm * v.norm), 0), 2) AS cosine FROM t x JOIN t y ON x.doc_id = y.doc_id AND x.k < y.k
  LEFT JOIN nm u ON u.doc_id = x.doc_id AND u.k = x.k LEFT JOIN nm v ON v.doc_id = y.doc_id AND v.k = y.k LEFT JOIN dt ON dt.doc_id = x.doc_id AND dt.a = x.k AND dt.b = y.k)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, a, b) AS INTEGER) AS rank, CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, cosine FROM pr QUALIFY rank <= 6""")
def block_redundancy(spark, d):
    return structure.block_redundancy(documents(spark, d), "doc_id")


@query(f"""WITH {_SECTIONS}, {_STEMMED}, la AS (SELECT doc_id, min(pos) AS fst FROM st WHERE regexp_matches(name, {lit(L.CONCLUSION_TITLE)}) GROUP BY 1),
s AS (SELECT te.doc_id, term, count(*) FILTER (pos = fst) AS c1, count(*) FILTER (pos <> fst AND len(regexp_extract_all(p, '\\S+')) > 80) AS c0 FROM te JOIN la USING (doc_id) GROUP BY ALL)
SELECT doc_id, round(sum(c0 * c1) / (sqrt(sum(c0 * c0)) * sqrt(sum(c1 * c1))), 2) AS cosine FROM s GROUP BY 1 HAVING sum(c0) > 0 AND sum(c1) > 0""")
def conclusion_restatement(spark, d):
    return structure.conclusion_restatement(fixtures.frame(spark, "f_headed"), "doc_id")


@query()
def densest_sections(spark, d):
    return structure.densest_sections(fixtures.frame(spark, "f_headed"), "doc_id")


@query(f"""WITH {fixtures.sql('f_cites')}, m AS (SELECT doc_id, unnest(regexp_extract_all(text, {lit(rf'({L.AUTHORS}\s*\(?{L.YEAR})\b')}, 1)) AS m FROM f_cites),
a AS (SELECT doc_id, trim(regexp_extract(m, {lit(rf'^({L.AUTHORS})\s*\(?({L.YEAR})')}, 1)) AS authors, regexp_extract(m, {lit(rf'({L.YEAR})$')}, 1) AS year FROM m),
b AS (SELECT *, regexp_replace(strip_accents(lower(regexp_replace(regexp_split_to_array(authors, '\\s+(?:and|&|et)\\b')[1], '[''’]s\\b', '', 'g'))), '[^a-z]', '', 'g') AS surname FROM a),
k AS (SELECT doc_id, strip_accents(lower(array_to_string(regexp_extract_all(text, '\\\\cite[a-z]*\\*?(?:\\[[^]]*\\])*\\{{([^}}]+)\\}}', 1), ' '))) AS keys, strip_accents(lower(coalesce(bib, ''))) AS bib FROM f_cites)
SELECT DISTINCT doc_id, authors || ' (' || year || ')' AS citation FROM b JOIN k USING (doc_id) WHERE len(surname) >= 3 AND surname NOT IN {words_sql(L.NOT_SURNAMES)} AND NOT contains(keys, surname) AND NOT contains(bib, surname)""")
def cite_suspects(spark, d):
    return structure.missing_citations(fixtures.frame(spark, "f_cites"), KEYS)


@query()
def overclaims(spark, d):
    return structure.overclaims(fixtures.frame(spark, "f_cites"), KEYS)


# --- syntax ------------------------------------------------------------------

TOK = fixtures.sql("f_tokens") + ", big AS (SELECT doc_id, sent_id FROM f_tokens GROUP BY ALL HAVING count(*) > 3)"
_BIGRAMS = TOK + """, ld AS (SELECT doc_id, pos AS pos1, lead(pos) OVER (PARTITION BY doc_id, sent_id ORDER BY i) AS pos2 FROM f_tokens SEMI JOIN big USING (doc_id, sent_id) WHERE pos NOT IN ('PUNCT', 'SPACE')),
bg AS (SELECT doc_id, pos1, pos2, count(*) AS n FROM ld WHERE pos2 IS NOT NULL GROUP BY ALL)"""


@query(f"WITH {_BIGRAMS} SELECT * FROM bg")
def pos_bigrams(spark, d):
    return syntax.bigrams(fixtures.frame(spark, "f_tokens"))


@query(f"""WITH {_BIGRAMS}, tt AS (SELECT doc_id, sum(n) AS total FROM bg GROUP BY 1), kk AS (SELECT DISTINCT pos1, pos2 FROM bg),
rr AS (SELECT tt.doc_id, pos1, pos2, coalesce(n, 0)::DOUBLE / total AS rate FROM tt CROSS JOIN kk LEFT JOIN bg USING (doc_id, pos1, pos2)),
oo AS (SELECT a.doc_id, a.pos1, a.pos2, any_value(a.rate) AS rate, avg(b.rate) AS mean, CASE WHEN min(b.rate) = max(b.rate) THEN 0 ELSE stddev_pop(b.rate) END AS sd FROM rr a JOIN rr b ON a.pos1 = b.pos1 AND a.pos2 = b.pos2 AND a.doc_id <> b.doc_id GROUP BY 1, 2, 3)
SELECT 'g' AS grp, doc_id, round(coalesce(avg(abs((rate - mean) / sd)) FILTER (sd > 1e-9), 0), 6) AS delta, count(*) FILTER (sd > 1e-9) AS bigrams FROM oo GROUP BY doc_id""")
def pos_delta(spark, d):
    rows = syntax.bigrams(fixtures.frame(spark, "f_tokens")).withColumn("grp", F.lit("g"))
    return distance.bigram_delta(rows, "grp", "doc_id").withColumn("delta", F.round("delta", 6))


_META = f"""ro AS (SELECT doc_id, sent_id, i AS root_i, lower(lemma) AS root FROM f_tokens WHERE head_i = i),
mk AS (SELECT t.doc_id, t.sent_id, max(CAST(dep IN ('nsubj', 'nsubjpass', 'csubj') AND lower(text) IN ('we', 'i') AS INTEGER)) AS fp, max(CAST(dep IN ('nsubj', 'nsubjpass', 'csubj') AND lower(lemma) IN {words_sql(L.DISCOURSE_NOUNS)} AS INTEGER)) AS disc,
  max(CAST(dep IN ('acomp', 'attr') AND (lower(lemma) IN {words_sql(L.STATUS_ADJECTIVES)} OR lower(lemma) IN {words_sql(L.PREDICATE_NOUNS)}) AS INTEGER)) AS pred, max(CAST(dep = 'neg' AS INTEGER)) AS neg
  FROM f_tokens t JOIN ro ON ro.doc_id = t.doc_id AND ro.sent_id = t.sent_id AND t.head_i = root_i AND t.i <> t.head_i GROUP BY ALL),
me AS (SELECT big.doc_id, big.sent_id, coalesce((root = 'be' AND pred = 1) OR ((fp = 1 OR disc = 1) AND root IN {words_sql(L.STANCE_VERBS)}) OR (fp = 1 AND root IN {words_sql(L.CLAIM_VERBS)} AND neg = 1), false) AS meta FROM big LEFT JOIN ro USING (doc_id, sent_id) LEFT JOIN mk USING (doc_id, sent_id))"""


@query(f"WITH {TOK}, {_META} SELECT * FROM me")
def meta_sentences(spark, d):
    return syntax.meta_sentences(fixtures.frame(spark, "f_tokens"))


@query(f"""WITH RECURSIVE {TOK}, up AS (SELECT doc_id, sent_id, i, head_i AS cur, CASE WHEN head_i = i THEN 0 ELSE 1 END AS d FROM f_tokens SEMI JOIN big USING (doc_id, sent_id) UNION ALL SELECT u.doc_id, u.sent_id, u.i, t.head_i, u.d + 1 FROM up u JOIN f_tokens t ON t.doc_id = u.doc_id AND t.i = u.cur AND t.head_i <> t.i)
SELECT doc_id, sent_id, CAST(max(d) AS INTEGER) AS depth FROM up GROUP BY ALL""")
def parse_depths(spark, d):
    return syntax.parse_depths(fixtures.frame(spark, "f_tokens"))


@query()
def syntax_rates(spark, d):
    return syntax.rates(fixtures.frame(spark, "f_tokens"))


@query()
def syntax_flags(spark, d):
    docs = corpus(spark, d)
    rows = syntax.rates(syntax.annotate(docs, most=None)).join(docs.select("doc_id", "grp"), "doc_id")
    return syntax.syntax_flags(rows, "grp", KEYS)


# --- panels ------------------------------------------------------------------


@query(f"SELECT * FROM (VALUES {', '.join(f'({lit(c)}, {lit(f)}, {lit(l)}, {len(d.split())})' for c, f, l, d in L.TAXONOMY)}) t(id, family, label, n_det)")
def taxonomy(spark, d):
    return panel.taxonomy(spark).select("id", "family", "label", F.size("det").alias("n_det"))


def _block_sql(rows: list) -> str:
    return lit("\n".join(f"{k}. {label} [{family}] — {L.PROBES[c][1]}." for k, (c, family, label, _) in enumerate(rows, 1)))


@query(f"SELECT 'all' AS asked, {_block_sql(L.TAXONOMY)} AS block UNION ALL SELECT 'judged', {_block_sql([t for t in L.TAXONOMY if not t[3]])}")
def judge_block(spark, d):
    whole = panel.judge_block(spark).withColumn("asked", F.lit("all"))
    return whole.unionByName(panel.judge_block(spark, only_judged=True).withColumn("asked", F.lit("judged")))


@query(f"SELECT * FROM (VALUES {', '.join(f'({lit(r)}, {k}, {lit(c)}, {lit(f)}, {lit(l)})' for r, ids in L.REGISTERS.items() for k, i in enumerate(ids.split()) for c, f, l, _ in L.TAXONOMY if c == i)}) t(register, pos, id, family, label)")
def register_categories(spark, d):
    return panel.registers(spark)


@query()
def candidate_harvest(spark, d):
    return panel.harvest(fixtures.frame(spark, "f_replies")).drop("ts")


@query("SELECT 'lone_tell' AS key, 1::BIGINT AS docs, 1::BIGINT AS judges, 1::BIGINT AS hits, 'Lone tell' AS label, false AS promote UNION ALL SELECT 'stacked_colons', 2, 2, 2, 'Stacked colons', true")
def candidate_review(spark, d):
    return panel.review(panel.harvest(fixtures.frame(spark, "f_replies")))


@query(f"""WITH {fixtures.sql('f_replies')}, s AS (SELECT doc, judge, CASE WHEN regexp_extract(reply, 'PROB_AI:\\s*(\\d+)', 1) <> '' THEN regexp_extract(reply, 'PROB_AI:\\s*(\\d+)', 1) ELSE nullif(regexp_extract(reply, '\\b(\\d{{1,3}})\\b', 1), '') END AS t FROM f_replies)
SELECT doc, judge, CAST(greatest(0, least(100, CAST(t AS BIGINT))) AS INTEGER) AS score FROM s WHERE t IS NOT NULL""")
def reply_scores(spark, d):
    return fixtures.frame(spark, "f_replies").select("doc", "judge", panel.score(F.col("reply")).alias("score")).where("score is not null")


@query()
def reply_json(spark, d):
    rows = fixtures.frame(spark, "f_replies").select("doc", panel.json_text(F.col("reply")).alias("json")).where("json is not null")
    return rows.withColumn("name", F.from_json("json", "categories array<struct<name string, score int>>")["categories"][0]["name"])


@query(f"WITH {fixtures.sql('f_ratings')} SELECT unit, count(rating) AS n, median(rating) AS mid, CASE WHEN count(rating) > 1 THEN max(rating) - min(rating) ELSE 0 END AS spread FROM f_ratings GROUP BY 1")
def category_scores(spark, d):
    return panel.category_scores(fixtures.frame(spark, "f_ratings"))


_JSON = "CAST(regexp_extract(reply, '(?s)(\\{.*\\})', 1) AS JSON)"
_ANSWERED = "reply IS NOT NULL AND regexp_extract(reply, '(?s)(\\{.*\\})', 1) <> ''"
_PROFILE = f"""{fixtures.sql('f_profiles')}, pj AS (SELECT grp, {_JSON} AS j FROM f_profiles WHERE {_ANSWERED}),
pc AS (SELECT grp, CAST(i AS INTEGER) AS pos, json_extract(j, '$.categories[' || i || ']') AS c FROM pj, range(20) r(i) WHERE i < json_array_length(j, '$.categories')),
pn AS (SELECT grp, pos, c->>'$.name' AS name, c->>'$.does' AS does, c->>'$.does_not' AS does_not, CAST(c->>'$.intensity' AS DOUBLE) AS intensity FROM pc QUALIFY row_number() OVER (PARTITION BY grp, c->>'$.name' ORDER BY pos) = 1)"""
_ALIGNED = f"""{_PROFILE}, {fixtures.sql('f_aligned')}, aj AS (SELECT doc_id, grp, judge, {_JSON} AS j FROM f_aligned WHERE {_ANSWERED}),
ac AS (SELECT doc_id, judge, i, json_extract(j, '$.categories[' || i || ']') AS c FROM aj, range(20) r(i) WHERE i < json_array_length(j, '$.categories')),
ar AS (SELECT doc_id, judge, c->>'$.name' AS name, CAST(c->>'$.alignment' AS DOUBLE) AS rating FROM ac QUALIFY row_number() OVER (PARTITION BY doc_id, judge, c->>'$.name' ORDER BY i DESC) = 1),
au AS (SELECT DISTINCT aj.doc_id, name FROM aj JOIN pn USING (grp)), al AS (SELECT au.doc_id, au.name, rating FROM au LEFT JOIN ar USING (doc_id, name))"""


@query(f"WITH {_PROFILE} SELECT * FROM pn")
def emergent_profile(spark, d):
    return panel.profile_categories(fixtures.frame(spark, "f_profiles"), "grp")


@query(f"WITH {_ALIGNED} SELECT doc_id, name, count(rating) AS n, round(median(rating), 1) AS mid, CASE WHEN count(rating) > 1 THEN max(rating) - min(rating) ELSE 0 END AS spread FROM al GROUP BY ALL")
def emergent_alignment(spark, d):
    return panel.profile_alignment(emergent_profile(spark, d), fixtures.frame(spark, "f_aligned"), "grp", "doc_id")["categories"]


@query(f"""WITH {_ALIGNED}, k AS (SELECT *, row_number() OVER () AS id FROM al WHERE rating IS NOT NULL),
o AS (SELECT a.doc_id, avg((a.rating - b.rating) ** 2) AS v FROM k a JOIN k b ON a.doc_id = b.doc_id AND a.name = b.name AND a.id < b.id GROUP BY 1),
e AS (SELECT a.doc_id, avg((a.rating - b.rating) ** 2) AS v FROM k a JOIN k b ON a.doc_id = b.doc_id AND a.id < b.id GROUP BY 1),
s AS (SELECT ids.doc_id, round(1 - o.v / e.v, 3) AS alpha FROM (SELECT DISTINCT doc_id FROM k) ids LEFT JOIN o USING (doc_id) LEFT JOIN e USING (doc_id))
SELECT doc_id, alpha, CASE WHEN alpha IS NULL THEN 'n/a' WHEN alpha >= 0.8 THEN 'strong' WHEN alpha >= 0.5 THEN 'moderate' ELSE 'low' END AS agreement FROM s""")
def emergent_agreement(spark, d):
    return panel.profile_alignment(emergent_profile(spark, d), fixtures.frame(spark, "f_aligned"), "grp", "doc_id")["agreement"]


@query(f"""WITH {fixtures.sql('f_ratings')}, k AS (SELECT *, row_number() OVER () AS id FROM f_ratings WHERE rating IS NOT NULL),
o AS (SELECT avg((a.rating - b.rating) ** 2) AS v FROM k a JOIN k b ON a.unit = b.unit AND a.id < b.id), e AS (SELECT avg((a.rating - b.rating) ** 2) AS v FROM k a JOIN k b ON a.id < b.id)
SELECT round(1 - o.v / e.v, 3) AS alpha, CASE WHEN 1 - o.v / e.v >= 0.8 THEN 'strong' WHEN 1 - o.v / e.v >= 0.5 THEN 'moderate' ELSE 'low' END AS agreement FROM o, e""")
def kripp_alpha(spark, d):
    return panel.interval_alpha(fixtures.frame(spark, "f_ratings"))


@query(f"""WITH {fixtures.sql('f_ratings')}, s AS (SELECT judge, list_sort(list(rating)) AS v FROM f_ratings WHERE rating IS NOT NULL GROUP BY 1)
SELECT judge, len(v) AS n, v[1] AS low, v[1 + CAST(round_even(0.25::DOUBLE * (len(v) - 1), 0) AS INTEGER)] AS p25, v[1 + CAST(round_even(0.5::DOUBLE * (len(v) - 1), 0) AS INTEGER)] AS mid, v[1 + CAST(round_even(0.75::DOUBLE * (len(v) - 1), 0) AS INTEGER)] AS p75, v[len(v)] AS high FROM s""")
def judge_bands(spark, d):
    return panel.judge_bands(fixtures.frame(spark, "f_ratings").withColumnRenamed("rating", "score"))


@query()
def baseline_place(spark, d):
    ratings = fixtures.frame(spark, "f_ratings").withColumnRenamed("rating", "score")
    return panel.place(ratings.where("unit = 'u1' and score is not null").select("judge", "score"), panel.judge_bands(ratings.where("unit <> 'u1'")))


@query(f"WITH {fixtures.sql('f_ratings')} SELECT unit AS dimension, count(rating) AS n, median(rating) AS mid, CASE WHEN count(rating) > 1 THEN max(rating) - min(rating) ELSE 0 END AS spread, CASE WHEN median(rating) >= 70 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM f_ratings GROUP BY 1")
def panel_verdict(spark, d):
    return panel.panel_verdict(fixtures.frame(spark, "f_ratings").withColumnRenamed("unit", "dimension"))
