"""Panels of judges: replies, ratings, agreement, candidates.

Judges themselves are callables of the user's (prompt to reply) applied with
``ask``; everything after the reply is plain columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lexicons as L
from .bands import five_numbers


def ask(prompts: DataFrame, judges: dict[str, Callable[[str], str]], prompt: str = "prompt") -> DataFrame:
    """A reply per prompt and judge; a judge that fails gives null."""
    kept = [c for c in prompts.columns if c not in ("judge", "reply")]
    schema = ", ".join(f"`{n}` {t}" for n, t in prompts.select(*kept).dtypes) + ", judge string, reply string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, judge in judges.items():
                replies = []
                for p in batch[prompt]:
                    try:
                        replies.append(judge(p))
                    except Exception:
                        replies.append(None)
                yield batch.assign(judge=name, reply=replies)

    return prompts.select(*kept).mapInPandas(run, schema)


def taxonomy(spark) -> DataFrame:
    rows = [(i, c, f, l, d.split(), *L.PROBES[c]) for i, (c, f, l, d) in enumerate(L.TAXONOMY)]
    return spark.createDataFrame(rows, "pos int, id string, family string, label string, det array<string>, definition string, probe string")


def registers(spark) -> DataFrame:
    """The categories that mark each register, in order."""
    rows = [(r, k, c) for r, ids in L.REGISTERS.items() for k, c in enumerate(ids.split())]
    return spark.createDataFrame(rows, "register string, pos int, id string").join(taxonomy(spark).select("id", "family", "label"), "id", "left")


def coverage(spark) -> DataFrame:
    """Categories of each family, and those no feature covers."""
    t = taxonomy(spark)
    return t.groupBy("family").agg(F.count("*").alias("categories"), F.sum(F.when(F.size("det") == 0, 1).otherwise(0)).alias("judge_only"))


def judge_block(spark, only_judged: bool = False) -> DataFrame:
    """One text: the numbered categories a judge is asked about, each with its
    family and probe."""
    t = taxonomy(spark)
    t = t.where(F.size("det") == 0) if only_judged else t
    rows = t.withColumn("k", F.row_number().over(Window.orderBy("pos")))  # the 30 categories
    line = F.format_string("%d. %s [%s] — %s.", "k", "label", "family", "probe")
    return rows.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", line.alias("line")))), lambda z: z["line"]), "\n").alias("block"))


def candidate_key(label: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(label, F.lit(""))), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def harvest(replies: DataFrame, marker: str = "UNCATALOGUED", at: Column | None = None) -> DataFrame:
    """Candidates from "<marker>: label — span — why" lines of replies (columns
    doc, judge, venue, reply); known categories are skipped.  ts is the time of
    ``at``, or of the run."""
    ts = F.date_format(F.current_timestamp() if at is None else at, "yyyy-MM-dd'T'HH:mm:ss")
    pattern = rf"(?im)^\s*[-*\d.]*\s*{marker}:\s*(.+)$"
    rows = replies.select("doc", "judge", "venue", F.posexplode(F.regexp_extract_all("reply", F.lit(pattern), 1)).alias("pos", "m"))
    rows = rows.withColumn("m", F.trim("m")).where((F.col("m") != "") & ~F.regexp_replace(F.lower("m"), r"\.+$", "").isin("none", "n/a", "na"))
    parts = F.split("m", r"\s+(?:—|–|--|-)\s+", 3)
    label = F.substring(F.regexp_replace(F.trim(parts[0]), r"^[*`\"'.]+|[*`\"'.]+$", ""), 1, 80)
    rows = rows.select("doc", "judge", "venue", "pos", label.alias("label"), F.substring(F.coalesce(F.trim(F.get(parts, F.lit(1))), F.lit("")), 1, 240).alias("span"), F.substring(F.coalesce(F.trim(F.get(parts, F.lit(2))), F.lit("")), 1, 400).alias("why"))
    rows = rows.withColumn("key", candidate_key(F.col("label"))).where("key <> ''").withColumn("source", F.lit(marker.lower()))
    known = taxonomy(replies.sparkSession)
    known = known.select(candidate_key(F.col("label")).alias("key")).union(known.select(candidate_key(F.col("id")).alias("key"))).distinct()
    return rows.join(F.broadcast(known), "key", "left_anti").select(ts.alias("ts"), "key", "label", "source", "doc", "judge", "venue", "span", "why", "pos")


def review(candidates: DataFrame, least_docs: int = 1) -> DataFrame:
    """Recurrence of each candidate; promoted at two documents and two judges."""
    rows = candidates.groupBy("key").agg(F.count_distinct("doc").alias("docs"), F.count_distinct("judge").alias("judges"), F.count("*").alias("hits"), F.min("label").alias("label"))
    return rows.where(F.col("docs") >= least_docs).withColumn("promote", (F.col("docs") >= 2) & (F.col("judges") >= 2))


def json_text(reply: Column) -> Column:
    """The first JSON object or array of a reply, fences and prose dropped."""
    bare = F.regexp_replace(F.trim(F.regexp_replace(reply, "```(?:json)?", "")), "^`+|`+$", "")
    found = F.regexp_extract(bare, r"(?s)(\{.*\}|\[.*\])", 1)
    return F.when(found != "", found)


def score(reply: Column, label: str = "PROB_AI") -> Column:
    """A labelled number of a reply, else its first of up to three digits,
    clamped to 0..100; null without one."""
    labelled = F.regexp_extract(reply, rf"{label}:\s*(\d+)", 1)
    plain = F.regexp_extract(reply, r"\b(\d{1,3})\b", 1)
    text = F.when(labelled != "", labelled).when(plain != "", plain)
    # least and greatest skip nulls, so no number is told apart first
    return F.when(text.isNotNull(), F.least(F.lit(100), text.cast("decimal(38,0)")).cast("int"))


def category_scores(ratings: DataFrame) -> DataFrame:
    """Median and spread of each unit's ratings, nulls aside."""
    n = F.count("rating")
    return ratings.groupBy("unit").agg(n.alias("n"), F.median("rating").alias("mid"), F.when(n > 1, F.max("rating") - F.min("rating")).otherwise(0.0).alias("spread"))


PROFILE_JSON = "categories array<struct<name string, does string, does_not string, intensity double, example string>>, venue_voice string"
ALIGNMENT_JSON = "categories array<struct<name string, alignment double, verdict string, evidence string>>, summary string"


def profile_categories(replies: DataFrame, group: str) -> DataFrame:
    """The categories that a judge's reply names for a group, a row each: group,
    pos, name, does, does_not, intensity.  A reply that isn't JSON gives none; of
    categories of one name the first counts."""
    named = replies.select(group, F.posexplode(F.from_json(json_text(F.col("reply")), PROFILE_JSON)["categories"]).alias("pos", "c")).where("c.name is not null")
    first = named.groupBy(group, F.col("c.name").alias("name")).agg(F.min(F.struct("pos", "c.does", "c.does_not", "c.intensity")).alias("x"))
    return first.select(group, "x.pos", "name", "x.does", "x.does_not", "x.intensity")


def profile_alignment(categories: DataFrame, replies: DataFrame, group: str, key: str) -> dict[str, DataFrame]:
    """How drafts fit their group's categories, by judges' replies (group, key,
    judge, reply): median and spread by category, and agreement by draft.

    A category has a row for every draft a judge answered on; names outside the
    profile are left out, a judge's last word on a name counts, replies that
    aren't JSON are no judge's."""
    said = replies.select(group, key, "judge", F.from_json(json_text(F.col("reply")), ALIGNMENT_JSON)["categories"].alias("c")).where("c is not null")
    rated = said.select(key, "judge", F.posexplode("c").alias("at", "c")).groupBy(key, "judge", F.col("c.name").alias("name")).agg(F.max_by("c.alignment", "at").alias("rating"))
    units = said.select(group, key).distinct().join(categories.select(group, "name"), group)
    rows = units.join(rated, [key, "name"], "left")
    n = F.count("rating")
    spread = F.when(n > 1, F.max("rating") - F.min("rating")).otherwise(0.0)
    by_name = rows.groupBy(key, "name").agg(n.alias("n"), F.round(F.median("rating"), 1).alias("mid"), spread.alias("spread"))
    return {"categories": by_name, "agreement": interval_alpha(rows.withColumnRenamed("name", "unit"), [key])}


def interval_alpha(ratings: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Agreement alpha on the interval scale, pairs not weighted by unit size.

    Pair sums in closed form from counts, sums and squares; the label reads
    0.8 and 0.5 as its steps.  Null without a pair or without any spread."""
    by = by or []
    known = ratings.where("rating is not null")
    units = known.groupBy(*by, "unit").agg(F.count("*").alias("k"), F.sum("rating").alias("s"), F.sum(F.col("rating") * F.col("rating")).alias("q"))
    got = units.groupBy(*by).agg(
        F.sum(F.col("k") * F.col("q") - F.col("s") * F.col("s")).alias("do"), F.sum(F.col("k") * (F.col("k") - 1) / 2).alias("pairs"), F.sum("k").alias("n"), F.sum("s").alias("ts"), F.sum("q").alias("tq")
    )
    de = F.col("n") * F.col("tq") - F.col("ts") * F.col("ts")
    all_pairs = F.col("n") * (F.col("n") - 1) / 2
    usable = (F.col("pairs") > 0) & (de > 0)
    ratio = (F.col("do") / F.when(usable, F.col("pairs")).otherwise(1)) / F.when(usable, de / F.greatest(all_pairs, F.lit(1.0))).otherwise(1.0)
    rows = got.select(*by, F.when(usable, F.round(1 - ratio, 3)).alias("alpha"))
    return rows.withColumn("agreement", F.when(F.col("alpha").isNull(), "n/a").when(F.col("alpha") >= 0.8, "strong").when(F.col("alpha") >= 0.5, "moderate").otherwise("low"))


def judge_bands(scores: DataFrame) -> DataFrame:
    """Five-number band of each judge's ratings of a baseline corpus."""
    return five_numbers(scores.where("score is not null"), ["judge"], "score")


def place(scores: DataFrame, bands: DataFrame) -> DataFrame:
    """A draft's ratings against the bands: IN up to the highest."""
    rows = scores.join(bands, "judge")
    return rows.select("judge", "score", "low", "mid", "high", F.when(F.col("score") <= F.col("high"), "IN").otherwise("ABOVE").alias("verdict"))


def pending(files: DataFrame, done: DataFrame) -> DataFrame:
    """Files a resumable baseline still has to rate."""
    return files.join(done.select("file").distinct(), "file", "left_anti")


def panel_verdict(ratings: DataFrame, inverted: tuple[str, ...] = ("performed_rigor",)) -> DataFrame:
    """PASS of each dimension: median 70 or more, or 40 or less if inverted."""
    rows = category_scores(ratings.withColumnRenamed("dimension", "unit")).withColumnRenamed("unit", "dimension")
    passed = F.when(F.col("dimension").isin(*inverted), F.col("mid") <= 40).otherwise(F.col("mid") >= 70)
    return rows.select("dimension", "n", "mid", "spread", F.when(passed, "PASS").otherwise("FAIL").alias("verdict"))


def context_budget(context_tokens: int, reserve: int = 12000) -> int:
    """Characters of a text that a judge's context has room for."""
    return max(4000, context_tokens - reserve) * 4


WHITE = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
BLANK_ENDS = f"^[{WHITE}]+|[{WHITE}]+$"


def context_parts(docs: DataFrame, keys: list[str], budget: int) -> DataFrame:
    """keys, part (from 0) and text: each text in parts of at most ``budget``
    characters, cut at blank lines; a text that fits is one part, untouched.

    Paragraphs join a part while they and their blank lines fit; parts lose white
    space at their ends.  Of a longer paragraph, full pieces go out at once, before
    the part that is being filled, and the rest is a paragraph.  The cuts come from
    a fold over paragraph lengths that keeps the filled length and the cuts alone,
    so a text of any length takes linear time.  Null texts are empty ones."""
    rows = docs.select(*keys, F.coalesce("text", F.lit("")).alias("_text")).withColumn("_p", F.split("_text", "\n\n"))
    full = F.transform("_p", lambda x: F.greatest(F.ceil(F.length(x) / budget).cast("int") - 1, F.lit(0)))
    rows = rows.withColumn("_z", F.zip_with("_p", full, lambda x, m: F.struct(x.alias("x"), m.alias("m"))))
    rows = rows.withColumn("_rest", F.transform("_z", lambda z: F.substring(z["x"], z["m"] * budget + 1, F.length(z["x"]))))
    sizes = F.transform("_rest", lambda x, i: F.struct(i.alias("i"), (F.length(x) + 2).alias("n")))
    none = F.struct(F.lit(0).alias("filled"), F.array().cast("array<int>").alias("cuts"))

    def add(a: Column, x: Column) -> Column:
        ends = (a["filled"] > 0) & (a["filled"] + x["n"] > budget)
        cut = F.struct(x["n"].alias("filled"), F.array_append(a["cuts"], x["i"]).alias("cuts"))
        return F.when(ends, cut).otherwise(F.struct((a["filled"] + x["n"]).alias("filled"), a["cuts"].alias("cuts")))

    rows = rows.withColumn("_cuts", F.concat(F.array(F.lit(0)), F.aggregate(sizes, none, add, lambda a: a["cuts"]), F.array(F.size("_p"))))

    def entry(at: Column, kind: int, piece: Column, text: Column) -> Column:
        return F.struct(at.alias("at"), F.lit(kind).alias("kind"), piece.alias("piece"), text.alias("text"))

    spans = F.transform(F.sequence(F.lit(1), F.size("_cuts") - 1), lambda k: F.struct(F.get("_cuts", k - 1).alias("a"), F.get("_cuts", k).alias("b")))
    parts = F.transform(spans, lambda v: entry(v["b"], 1, F.lit(0), F.regexp_replace(F.array_join(F.slice("_rest", v["a"] + 1, v["b"] - v["a"]), "\n\n"), BLANK_ENDS, "")))
    # the last part goes if it is blank
    parts = F.filter(parts, lambda e: (e["at"] < F.size("_p")) | (e["text"] != ""))
    long = F.filter(F.transform("_z", lambda z, i: F.struct(i.alias("i"), z["m"].alias("m"), z["x"].alias("x"))), lambda z: z["m"] > 0)
    pieces = F.flatten(F.transform(long, lambda z: F.transform(F.sequence(F.lit(0), z["m"] - 1), lambda k: entry(z["i"], 0, k, F.substring(z["x"], k * budget + 1, F.lit(budget))))))
    every = F.transform(F.sort_array(F.concat(parts, pieces)), lambda e: e["text"])
    found = F.when(F.length("_text") <= budget, F.array("_text")).otherwise(every)
    return rows.select(*keys, F.posexplode(found).alias("part", "text"))


def fit_or_chunk(text: str, context_tokens: int, reserve: int = 12000) -> list[str]:
    """``context_parts`` of one text."""
    budget = context_budget(context_tokens, reserve)
    if len(text) <= budget:
        return [text]
    parts, now = [], ""
    for paragraph in text.split("\n\n"):
        full = max(-(-len(paragraph) // budget) - 1, 0) * budget
        parts += [paragraph[k: k + budget] for k in range(0, full, budget)]
        if now and len(now) + len(paragraph) - full + 2 > budget:
            parts.append(now.strip())
            now = ""
        now += paragraph[full:] + "\n\n"
    return parts + [now.strip()] if now.strip() else parts
