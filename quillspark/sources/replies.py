"""Replies of outside models, kept by the content they answer.

A request is a model and a prompt, its key the hash of both.  However often a
prompt comes up it is one request, and a request that has a reply is never sent
again: not by a later run, nor by one that goes on where another stopped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import versions

REQUESTS = "key string, model string, prompt string"
REPLIES = REQUESTS + ", reply string"


def request_key(model: Column, prompt: Column) -> Column:
    return F.sha2(F.concat_ws("\n", model, prompt), 256)


def requests(prompts: DataFrame, models: list[str], prompt: str = "prompt") -> DataFrame:
    """key, model and prompt of each prompt that isn't null, for every model, each
    once."""
    asked = prompts.where(F.col(prompt).isNotNull()).select(F.col(prompt).cast("string").alias("prompt")).distinct()
    each = asked.select(F.explode(F.array(*[F.lit(m) for m in models])).alias("model"), "prompt")
    return each.select(request_key(F.col("model"), F.col("prompt")).alias("key"), "model", "prompt")


def replies(spark: SparkSession, path: str) -> DataFrame:
    """All replies kept in a folder; none if it isn't there yet."""
    if not versions.batches(spark, path):
        return spark.createDataFrame([], REPLIES)
    return spark.read.schema(REPLIES).option("recursiveFileLookup", "true").parquet(path)


def _part(parts: int) -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int")


def fulfil(wanted: DataFrame, models: dict[str, Callable[[str], str]], path: str, parts: int = 16, at_once: int = 8) -> DataFrame:
    """Ask the models for the requests that have no reply, keep what they say, and
    return key, model, prompt and reply of the requests that have one.

    Requests go out part by part and a part's replies are kept in one step, so a
    run that is stopped loses one part.  A model that fails, or has nothing to say,
    leaves its request open for the next run.  A part's batch is named by how many
    the part has had: of two runs at the same time one keeps its replies, the other
    reads them.  ``at_once`` requests are under way together.  A task that is
    repeated asks again, but only one of its replies is kept."""
    spark = wanted.sparkSession
    wanted = wanted.where(F.col("model").isin(list(models))).dropDuplicates(["key"])

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            # a row at a time, so that no reply waits for others
            for key, model, prompt in batch[["key", "model", "prompt"]].itertuples(index=False):
                try:
                    reply = models[model](prompt)
                except Exception:
                    continue
                if reply and reply.strip():
                    yield pd.DataFrame({"key": [key], "model": [model], "prompt": [prompt], "reply": [reply]})

    # a count a part, so as many rows as there are parts
    open_ = wanted.join(replies(spark, path), "key", "left_anti")
    left = sorted(r.part for r in open_.select(_part(parts).alias("part")).distinct().collect())
    for part in left:
        had = sum(name.startswith(f"part-{part}-of-{parts}-") for name in versions.batches(spark, path))
        # read anew: another run may have kept replies meanwhile
        now = wanted.where(_part(parts) == part).join(replies(spark, path).select("key"), "key", "left_anti")
        said = now.select("key", "model", "prompt").repartition(at_once, "key").mapInPandas(ask, REPLIES)
        versions.add_once(said, path, f"part-{part}-of-{parts}-{had}", "parquet")
    return replies(spark, path).join(wanted.select("key"), "key", "left_semi")
