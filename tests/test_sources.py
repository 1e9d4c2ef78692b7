from quillspark.functions import shape
from quillspark.sources import config, corpus
from quillspark.streaming import features as streams


def test_folder_scan(spark, tmp_path):
    for name, text in [("b.md", "word " * 401), ("a.md", "short"), ("README.md", "word " * 500), (".x.md", "word " * 500), ("ai_1.md", "word " * 301), ("r.bib", "@book{k, author={Doe}}")]:
        (tmp_path / name).write_text(text)
    assert [r.stem for r in corpus.read_corpus(spark, str(tmp_path)).collect()] == ["b"]
    assert {r.stem for r in corpus.read_generated(spark, str(tmp_path)).collect()} == {"ai_1"}
    assert any("Doe" in r.line for r in corpus.read_bibliography(spark, str(tmp_path)).collect())


def test_log_and_cache(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame([("f", "j", 5)], corpus.BASELINE)
    corpus.append_log(rows, path)
    corpus.append_log(rows, path)
    assert corpus.read_log(spark, path, corpus.BASELINE).count() == 2
    kept = str(tmp_path / "kept")
    corpus.cached(rows, kept)
    assert corpus.cached(rows.limit(0), kept).count() == 1
    assert corpus.cached(rows.limit(0), kept, refresh=True).count() == 0


def test_env_file(tmp_path, monkeypatch):
    (tmp_path / ".env").write_text("# c\nJUDGES=a, b\nX='1'\n")
    monkeypatch.setenv("X", "2")
    env = config.load_env([str(tmp_path / "none"), str(tmp_path / ".env")])
    assert env["X"] == "1" and config.roster(env) == ["a", "b"]


def test_feature_stream_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"The point is clear, and it is {i}. We go on, not back, for now.") for i in range(9)], "doc_id int, text string")
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    docs.repartition(3).write.parquet(source)
    streamed = streams.feature_stream(streams.read_documents(spark, source, "doc_id int, text string", 1), ["doc_id"])
    streams.run_to_parquet(streamed, out, str(tmp_path / "check"))
    assert sorted(spark.read.parquet(out).collect()) == sorted(shape.features(docs, ["doc_id"]).collect())


def test_a_write_stopped_half_way_changes_nothing(spark, tmp_path):
    import os
    import shutil

    import pytest
    from pyspark.sql import functions as F

    from quillspark.sources import versions

    good = spark.range(100).repartition(4)
    broken = good.select(F.when(F.col("id") == 77, F.raise_error(F.lit("stopped"))).otherwise(F.col("id")).alias("id"))
    kept, log = str(tmp_path / "kept"), str(tmp_path / "log")
    with pytest.raises(Exception, match="stopped"):
        corpus.cached(broken, kept)
    assert versions.current(spark, kept) is None
    assert corpus.cached(good, kept).count() == 100
    with pytest.raises(Exception, match="stopped"):
        corpus.cached(broken, kept, refresh=True)
    # a writer that was killed leaves files behind, under a name that nothing reads
    last = versions.current(spark, kept)
    shutil.copytree(last, f"{kept}/{versions.HIDDEN}killed")
    os.remove(f"{kept}/{versions.HIDDEN}killed/_SUCCESS")
    assert corpus.cached(broken, kept).count() == 100 and versions.current(spark, kept) == last
    # readers of an older version keep it until it is pruned
    old = corpus.cached(good, kept)
    assert corpus.cached(good.limit(3), kept, refresh=True).count() == 3 and old.count() == 100
    versions.prune(spark, kept)
    assert [f for f in os.listdir(kept) if f.startswith("v")] == [os.path.basename(versions.current(spark, kept))]

    entry = spark.createDataFrame([("f", "j", 5), ("g", "j", 6)], corpus.BASELINE)
    failing = entry.withColumn("score", F.when(F.col("file") == "g", F.raise_error(F.lit("stopped"))).otherwise(F.col("score")))
    with pytest.raises(Exception, match="stopped"):
        corpus.append_log(failing, log, "day 1/a")
    assert corpus.append_log(entry, log, "day 1/a") and not corpus.append_log(entry, log, "day 1/a")
    assert corpus.append_log(entry, log, "day 1-a")
    shutil.copytree(f"{log}/batch-day%20.1%2f.a", f"{log}/{versions.HIDDEN}killed")
    assert corpus.read_log(spark, log, corpus.BASELINE).count() == 4


def test_writers_at_the_same_time_get_versions_of_their_own(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from quillspark.sources import versions

    path = str(tmp_path / "many")
    with ThreadPoolExecutor(4) as pool:
        made = list(pool.map(lambda k: versions.publish(spark.range(k + 1), path), range(6)))
    assert len(set(made)) == 6 and sorted(spark.read.parquet(m).count() for m in made) == [1, 2, 3, 4, 5, 6]
    with ThreadPoolExecutor(4) as pool:
        added = list(pool.map(lambda k: versions.add_once(spark.range(5), str(tmp_path / "once"), "b", "json"), range(4)))
    assert sum(added) == 1


def test_each_request_gets_one_reply_whatever_fails(spark, tmp_path):
    import hashlib
    import os
    from concurrent.futures import ThreadPoolExecutor

    from quillspark.sources import replies

    calls = str(tmp_path / "calls")
    os.makedirs(calls)

    def model(name):
        def ask(prompt):
            at = f"{calls}/{hashlib.sha256((name + prompt).encode()).hexdigest()}"
            with open(at, "a") as log:
                log.write("x")
            if int(at[-1], 16) % 2 and os.path.getsize(at) < 2:
                raise TimeoutError
            return f"{name} on {prompt}"

        return ask

    models, path = {"a": model("a"), "b": model("b"), "mute": lambda p: " "}, str(tmp_path / "replies")
    prompts = spark.createDataFrame([(f"p{k % 40}",) for k in range(120)] + [(None,)], "prompt string")
    wanted = replies.requests(prompts, ["a", "b"])
    assert wanted.count() == 80
    first = replies.fulfil(wanted, models, path, parts=3).collect()
    assert 20 < len(first) < 60
    second = replies.fulfil(wanted, models, path, parts=3).collect()
    assert len(second) == len({r.key for r in second}) == 80 and all(r.reply == f"{r.model} on {r.prompt}" for r in second)
    assert {r.key: r.reply for r in first}.items() <= {r.key: r.reply for r in second}.items()
    # who replied is never asked again, and who failed is asked until there is a reply
    failed = 80 - len(first)
    asked = sorted(os.path.getsize(f"{calls}/{f}") for f in os.listdir(calls))
    assert asked == [1] * len(first) + [2] * failed
    assert len(replies.fulfil(wanted, {"a": None, "b": None}, path, parts=3).collect()) == 80
    # a model that says nothing leaves its requests open; unknown models are passed over
    assert replies.fulfil(replies.requests(prompts, ["mute", "none"]), models, path, parts=2).count() == 0
    # runs at the same time
    both = str(tmp_path / "both")
    with ThreadPoolExecutor(2) as pool:
        for _ in pool.map(lambda _: replies.fulfil(wanted, {"a": str.upper, "b": str.upper}, both, parts=2).count(), range(2)):
            pass
    kept = [r.key for r in replies.replies(spark, both).collect()]
    assert len(kept) == len(set(kept)) == 80
    assert replies.fulfil(wanted.limit(0), models, str(tmp_path / "none")).count() == 0
