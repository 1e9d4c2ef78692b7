"""The training-corpus pipeline: each stage is one of the operators.

Rows may hold nulls in any column and repeat, and ids may repeat or be null; an
empty table gives an empty result.  Columns beyond those of ``documents`` are not
carried; texts are whole, however long.  Null and blank texts pass every
filtering stage unchanged, as there is nothing in them to reject; documents that
a stage leaves without any word go, as only blank text is left of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.llm import line_dedup, ngram_join, packing, suffix_dedup, toxicity
from quillspark.llm.filters import KeyFilter
from quillspark.llm.registry import BYTE_BPE
from quillspark.llm.runtime import stage, table

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


#: Bytes of the shortest passage that goes: over 50 words of any of the corpus's
#: languages are longer (51 words of invented English are about 315).
PASSAGE_BYTES = 225
BLANK = r"\A[ \t\n\r\x0b\f]*\z"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the grammar doesn't reject; null text counts as empty."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, keep=DOCUMENT_COLUMNS).where("predicted = 0").select(*DOCUMENT_COLUMNS)


def _documents(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*DOCUMENT_COLUMNS)


def _blank(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(BLANK)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat an earlier line, by doc_id (null
    first) and line number.  Documents all of whose words went go."""
    found = line_dedup.drop_repeated_lines(docs.select(*DOCUMENT_COLUMNS), num=4, den=5)
    return _documents(found.where((F.col("n_removed") == 0) | ~_blank(F.col("text"))))


def _texts_before(keyed: DataFrame, documents: DataFrame) -> DataFrame:
    """_key as doc_id, and the text in ``documents``, of rows whose text differs
    from it."""

    def single(rows: DataFrame, hashes: str) -> DataFrame:
        hashed = rows.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("h"))
        return hashed.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("h").alias(hashes)).where("n = 1").drop("n")

    changed = single(keyed, "now").join(single(documents, "then"), "doc_id").where("now <> then").select("doc_id")
    changed = stage(changed.join(keyed, "doc_id").select("doc_id", "_key"), "changed")
    # only these documents' texts are dealt out
    wanted = KeyFilter(changed.select(F.xxhash64("doc_id").alias("key")), changed.count())
    return documents.where(wanted.holds(F.xxhash64("doc_id"))).join(changed, "doc_id").select(F.col("_key").alias("doc_id"), "text")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by 0.8 or
    more of five-word shingles.

    Line dedup has taken what copies share out of all but the first, so documents
    are linked by their texts in ``documents`` as well as by what is left of them.
    An id that is null or repeated there has no such text.  Rows are told apart by
    id and text: those that share an id are linked by their texts only, and null
    ids come last in a group.  Of rows with the same id and text one stays; of
    rows without words, which nothing links, all."""
    docs = docs.select(*DOCUMENT_COLUMNS)
    keyed = docs.withColumn("_key", F.xxhash64("doc_id", "text"))
    before = _texts_before(keyed, table(spark, sf_dir, "documents").select("doc_id", "text"))
    texts = stage(keyed.select(F.col("_key").alias("doc_id"), "text").unionByName(before), "texts")
    groups = ngram_join.similar_components(texts, n=5, num=4, den=5)
    ids = keyed.select("_key", "doc_id").distinct()
    order = F.struct(F.col("ids.doc_id").isNull().alias("none"), F.col("ids.doc_id").alias("id"), F.col("ids._key").alias("key"))
    linked = groups.select("doc_id", "component_id").distinct().alias("g").join(ids.alias("ids"), F.col("g.doc_id") == F.col("ids._key"))
    stays = linked.groupBy("component_id").agg(F.min(order).alias("first")).select(F.col("first.key").alias("_key"))
    blank = _blank(F.col("text"))
    rank = Window.partitionBy("_key").orderBy("lang", "source", "n_chars")
    known = keyed.where(~blank).join(stays, "_key", "left_semi").withColumn("_row", F.row_number().over(rank)).where("_row = 1")
    return known.select(*DOCUMENT_COLUMNS).unionByName(docs.where(blank).select(*DOCUMENT_COLUMNS))


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of ``PASSAGE_BYTES`` bytes that occur
    elsewhere, wherever they occur; repeated rows are passages of each other.
    Documents all of whose words went go."""
    found = suffix_dedup.remove_repeats(docs, length=PASSAGE_BYTES, with_text=True, carry=["lang", "source"])
    return _documents(found.where((F.col("n_removed") == 0) | ~_blank(F.col("text"))))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each kept document goes; null text is empty, a lone end
    token."""
    return packing.pack(docs, BYTE_BPE, capacity=2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("suffix-array dedup", drop_passages),
    ("best-fit packing", pack_sequences),
]

#: Scores and tokenizers aren't SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stage(docs, name.replace(" ", "_"))
    return docs
