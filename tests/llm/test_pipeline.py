"""The pipeline against brute force, stage by stage, and the SQL twins."""

import os
import random

import duckdb
import pytest

import corpus_pipeline
from quillspark.llm import registry, toxicity
from quillspark.llm.byte_bpe import byte_bpe
from tests.llm.test_dedup import brute_components, brute_lines, brute_repeats, text

import numpy as np

DATA = "/root/testdata/sf0.001"


def rows():
    rng = random.Random(21)
    texts = [text(rng, rng.randint(20, 120), 5000) for _ in range(40)]
    texts[3] = texts[1]
    texts[5] = texts[2].replace(" ", " new ", 1)
    passage = text(rng, 90, 5000)
    texts[7], texts[9] = text(rng, 30, 5000) + " " + passage, passage + " " + text(rng, 40, 5000)
    texts[11] = "a line of some words\n" + texts[12].replace(" ", "\n", 2)
    texts[13] = texts[14] + "\na line of some words"
    lines = [text(rng, 10, 5000) for _ in range(20)]
    texts[15] = "\n".join(lines)
    texts[16] = "\n".join([*lines[:9], text(rng, 10, 5000), *lines[10:]])  # a near copy that line dedup leaves one line of
    texts += ["", None, "You are an idiot and a moron, you stupid loser."]
    return [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]


def test_stages_equal_brute_force(spark, tmp_path):
    data = rows()
    sf = str(tmp_path)
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "n-gram Jaccard join", "suffix-array dedup", "best-fit packing"]
    stages = [f for _, f in corpus_pipeline.STAGES]

    def out(k, frame):
        frame.write.parquet(f"{sf}/{k}")
        return spark.read.parquet(f"{sf}/{k}")

    scorer = toxicity.Scorer(toxicity.Model())
    kept = [r for r in data if scorer.score(r[1]) < 0.5]
    one = out(0, stages[0](spark, docs, sf))
    assert {r.doc_id for r in one.collect()} == {r[0] for r in kept} and len(kept) == len(data) - 1
    lines = brute_lines([r[1] for r in kept], 4, 5)
    # documents left without a word go
    here = [k for k, (r, t) in enumerate(zip(kept, lines)) if t == r[1] or (t or "").strip()]
    assert len(here) < len(kept)
    kept, lines = [kept[k] for k in here], [lines[k] for k in here]
    two = out(1, stages[1](spark, one, sf))
    assert two.columns == docs.columns
    assert {r.doc_id: r.text for r in two.collect()} == {r[0]: t for r, t in zip(kept, lines)}
    # linked by what is left and by the texts before line dedup
    groups = brute_components(lines + [r[1] for r in kept], [r[0] for r in kept] * 2, 5, 4, 5)
    alive = {i for i, _, c in groups if i == c}
    three = out(2, stages[2](spark, two, sf))
    assert {r.doc_id for r in three.collect()} == alive and len(alive) < len(kept)
    left = {r[0]: (t or "") for r, t in zip(kept, lines) if r[0] in alive}
    expected = {}
    for (i, t), gone in zip(left.items(), brute_repeats([t.encode() for t in left.values()], corpus_pipeline.PASSAGE_BYTES)):
        stays = bytes(np.frombuffer(t.encode(), np.uint8)[~gone]).decode("utf-8", "ignore")
        if stays == t or stays.strip():
            expected[i] = stays
    four = out(3, stages[3](spark, three, sf))
    assert {r.doc_id: r.text for r in four.collect()} == expected
    pieces = stages[4](spark, four, sf).toPandas()
    encode = byte_bpe(registry.BYTE_BPE).encode
    assert pieces.groupby("doc_id")["length"].sum().to_dict() == {i: len(encode(t)) // 4 + 1 for i, t in expected.items()}
    ran = corpus_pipeline.run(spark, sf).toPandas()
    assert sorted(map(tuple, ran[["doc_id", "piece", "ids_crc32"]].values.tolist())) == sorted(map(tuple, pieces[["doc_id", "piece", "ids_crc32"]].values.tolist()))


def test_near_copies_go_by_text_and_not_by_id(spark, tmp_path):
    rng = random.Random(5)
    a, b, c, d = (text(rng, 40, 5000) for _ in range(4))
    data = [(1, a), (1, b), (2, a), (None, b), (None, c), (None, c), (3, d), (3, d), (None, ""), (None, None), (4, "")]
    rows = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in data], "doc_id long, text string, lang string, source string, n_chars long")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    found = corpus_pipeline.drop_near_copies(spark, rows, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in found) == sorted([(1, a), (1, b), (0, c), (3, d), (0, ""), (0, ""), (4, "")])


def test_stages_take_empty_tables_nulls_and_clashing_columns(spark, tmp_path):
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], kinds).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    long = " ".join(f"w{k}" for k in range(3000))
    data = [(None, None, None, None, None), (None, None, None, None, None), (1, "", "en", None, 0), (2, long, None, "s", 5), (2, long, None, "s", 5), (3, "p q", "en", "s", 3)]
    clash = "7L as size, 'x' as node, 'y' as d, 1 as n_lines, 2 as token, 3 as score, 'z' as _key, 4 as n_bytes"
    rows = spark.createDataFrame(data, kinds).selectExpr("*", *clash.split(", "))
    rows.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    packed = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    # of the repeated row one stays; null and empty texts pass as they are
    assert sorted(packed["doc_id"].dropna().astype(int)) == sorted([1, 3] + [2] * (packed["doc_id"] == 2).sum()) and packed["doc_id"].isna().sum() == 2
    assert packed[packed["doc_id"] == 1]["length"].tolist() == [1]


@pytest.mark.skipif(not os.path.exists(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_sql_twin(spark, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    expected = db.execute(registry.ORACLE_SQL[name]).df()
    found = registry.QUERIES[name](spark, DATA).toPandas()[list(expected.columns)]
    assert sorted(map(tuple, found.astype(str).values.tolist())) == sorted(map(tuple, expected.astype(str).values.tolist()))
