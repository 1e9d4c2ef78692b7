import unicodedata

from pyspark.sql import functions as F

from quillspark.functions import folding
from quillspark.operators import structure


def plain(text):
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()


def test_fold_equals_compatibility_decomposition(spark):
    texts = ["Dvořák Erdős Sørensen Łukasiewicz Œuvre ÆGIR straße", "ﬁ ½ ① ㎏ Ǆ ĳ … 한국어 각 がぎ ﾊﾟ", "é ậ ấ", "𝐀𝔅ℂ x² H₂O", "", "plain ASCII", "\U0001F600 emoji ﷺ end"]
    texts += ["".join(chr(c) for c in range(k, k + 400) if not 0xD800 <= c < 0xE000) for k in (0xA0, 0x1E00, 0x2000, 0x3000, 0xAC00, 0xF900, 0xFB00, 0xFF00, 0x1D400)]
    rows = spark.createDataFrame(list(enumerate(texts)) + [(-1, None)], "id int, t string")
    got = {r.id: r.f for r in rows.select("id", folding.fold(F.col("t")).alias("f")).collect()}
    assert got.pop(-1) is None
    assert [got[i] for i in range(len(texts))] == [plain(t) for t in texts]


def test_names_found_in_lines_as_by_contains(spark):
    import random

    rng = random.Random(1)
    lines = [(rng.choice("xy"), "".join(rng.choice("abc ") for _ in range(rng.randint(0, 30)))) for _ in range(200)] + [("x", None), (None, "abcabc"), ("y", "the the the"), ("y", "the the the")]
    names = [(rng.choice("xyz"), "".join(rng.choice("abc") for _ in range(rng.randint(3, 7)))) for _ in range(300)] + [(None, "abc"), ("y", "the"), ("x", "the")]
    l, n = spark.createDataFrame(lines, "b string, line string").repartition(3), spark.createDataFrame(names, "b string, name string").repartition(4)
    got = sorted(tuple(r) for r in structure.found_in_lines(n, l, "name", "line", ["b"]).collect())
    assert got == sorted({(b, s) for b, s in names if b is not None and any(c == b and t is not None and s in t for c, t in lines)})
    shared = sorted(r.name for r in structure.found_in_lines(n, l, "name", "line", []).collect())
    assert shared == sorted({s for _, s in names if any(t is not None and s in t for _, t in lines)})
    assert structure.found_in_lines(n, l.where("false"), "name", "line", []).collect() == []


def test_citations_against_one_bibliography(spark):
    docs = spark.createDataFrame([(1, "Dvořák (2010) and Erdős (1959) and Novak (1999) and Smith (2001).", "x"), (2, None, "y"), (3, "\\cite{novak99} Novák (1999)", None)], "id int, text string, line string")
    lines = spark.createDataFrame([("author = {Dvorak}",), ("ERDŐS, P.",), (None,)], "line string")
    got = sorted(tuple(r) for r in structure.missing_citations(docs, ["id"], lines).collect())
    assert got == [(1, "Novak (1999)"), (1, "Smith (2001)")]
    assert len(structure.missing_citations(docs, ["id"], lines.where("false")).collect()) == 4


def test_plain_text_is_not_looked_up_character_by_character(spark):
    import time

    texts = spark.range(400, numPartitions=4).select(F.repeat(F.lit("Plain words "), 1000).alias("t")).union(spark.createDataFrame([("Ça ﬁn — ½",)], "t string"))
    rows = texts.select(F.sha2(folding.fold(F.col("t")), 256).alias("f"))
    rows.first()
    began = time.monotonic()
    assert rows.distinct().count() == 2
    assert time.monotonic() - began < 3
