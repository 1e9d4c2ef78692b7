"""Line dedup by an exact set-similarity join, in DataFrame functions only.

A line's set holds its distinct words (cut at ASCII white space).  A line goes if
an earlier line, by (doc_id, line number) over the whole table, has the same set
or one of Jaccard similarity num / den or more; the first of each stays, and so
do lines without words.

Words are ordered by rarity: how often words of a word's cell of a count table
occur, ties by hash.  Lines post their prefixes under that order; words that
occur once are counted in the prefix but not posted, as no list of theirs can
hold two lines.  A pair is verified only if it passes the length filter, the
positional filter, and a bound from parity signatures of the sets (64 bits, 256
for long lines), none of which loses a match.

A line needs one earlier match to go, so no list of pairs is ever made:

1. Pivots.  A word's list is cut by size band, and lists of frequent words into
   as many parts as their count asks for.  Every line meets the first three
   lines and the line before it in each of its lists; the one with the nearest
   signature, over all lists, is verified.
2. The lines that still stand are joined with all earlier lines of their lists,
   and an aggregate keeps each line's nearest one.  It is verified; the lines
   whose candidate fails ask for the next few, then for more, until none has any
   left.

So a group of n near copies costs about n verified pairs.  Lines are read again
from the texts for those pairs alone.

Rows equal in doc_id and text are one document; of other rows that share a
doc_id, equal line numbers are ordered by hash.  A null doc_id sorts first; null
text stays null and has no lines; an empty table gives no rows.  Other columns
are carried along, but for columns named n_lines or n_removed, which the results
replace.  A set is named by a 64-bit hash, words by 64 bits (56 in the name and
the order).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .filters import KeyFilter, array_table, power_of_two
from .runtime import release, stage, unstage

#: Least and most cells of the word count table, a byte each: it follows the data
#: up to this bound on what tasks receive.  A fuller table orders less sharply,
#: results stay the same.
COUNT_CELLS = (1 << 16, 1 << 23)
#: Bytes of text for each cell.
CELL_BYTES = 64
#: Parts of the words whose lists are made one after the other: disk holds the
#: lists of one part.
PARTS = 4
#: Occurrences of a word for which its list is cut once more.
LIST_ROWS = 1 << 16
FIRSTS = 3
#: Candidates a line asks for after its nearest failed, and how much more it asks
#: for whenever all of those fail too.
NEXT, GROWTH = 32, 8

#: Words of a set from which on its signature has 256 bits.
LONG = 64
#: The 64-bit signature, and three quarters of the 256-bit one: the fourth is
#: what they lack of the first.
SIGNS = ["parity", "q0", "q1", "q2"]

SPACES = "\t\r\x0b\x0c"
MASK = (1 << 56) - 1
#: Keys below it belong to words that occur once.
SHARED = 1 << 56
AT = ["d", "t", "line_no"]


def _spaced(text: Column) -> Column:
    """White space inside lines as plain spaces; replacing scans bytes, where
    translating would look every character up."""
    for space in SPACES:
        text = F.replace(text, F.lit(space), F.lit(" "))
    return text


def _hashes(line: Column) -> Column:
    """Hashes of a line's distinct words."""
    return F.array_distinct(F.array_remove(F.transform(F.split(line, " "), lambda w: F.xxhash64(w)), F.xxhash64(F.lit(""))))


def _rarity(docs: DataFrame) -> tuple[DataFrame, int]:
    """How common the words of each cell are, on a log scale of 0 (once) to 120,
    and the number of cells."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells = power_of_two(COUNT_CELLS[0], size // CELL_BYTES, COUNT_CELLS[1])
    words = docs.select(F.explode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")).alias("word")).where("word <> ''")
    counts = words.groupBy(F.pmod(F.xxhash64("word"), F.lit(cells)).alias("cell")).count()
    return array_table(counts.select("cell", F.least(F.lit(120), F.floor(4 * F.log2("count"))).alias("value")), cells, "tinyint"), cells


def _ceil_share(n: Column, num: int, den: int) -> Column:
    return F.ceil(n * num / den - 1e-9).cast("int")


def _lines(docs: DataFrame, num: int, den: int) -> DataFrame:
    """Lines with the name, size and signature of their set, how many words that
    occur once lead its order, and the posted rest of its prefix."""
    rarity, width = _rarity(docs)
    cells = F.col("cells")
    keyed = F.transform(_hashes(F.col("line")), lambda h: F.shiftleft(F.get(cells, F.pmod(h, F.lit(width)).cast("int")).cast("long"), 56).bitwiseOR(h.bitwiseAND(F.lit(MASK))))
    lines = docs.select("d", "t", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    # tested on the line, as a test of the set would compute the set twice
    lines = lines.where(F.trim("line") != "").withColumn("cells", rarity.scalar())
    sets = lines.select(*AT, F.sort_array(keyed).alias("words")).withColumn("size", F.size("words"))
    length = F.col("size") - _ceil_share(F.col("size"), num, den) + 1
    # no other set is similar to one too small for a word to differ
    length = F.when(F.col("size") * den >= (F.col("size") + 1) * num, length).otherwise(0)
    sets = sets.select("*", F.xxhash64("words").alias("node"), F.slice("words", F.lit(1), length).alias("head"))
    sets = sets.withColumn("once", F.size(F.filter("head", lambda w: w < SHARED)))
    sets = sets.withColumn("prefix", F.slice("head", F.col("once") + 1, F.size("head")))
    posted = F.size("prefix") > 0

    def parity(words: Column) -> Column:
        return F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), w.bitwiseAND(F.lit(63)).cast("int"))))

    def quarter(k: int) -> Column:
        return F.when(posted & (F.col("size") >= LONG), parity(F.filter("words", lambda w: w.bitwiseAND(F.lit(192)) == 64 * k)))

    quarters = [quarter(k).alias(f"q{k}") for k in range(3)]
    return sets.select(*AT, "node", "size", F.when(posted, parity(F.col("words"))).alias("parity"), *quarters, "once", "prefix")


def _distance(a: str, b: str) -> Column:
    """A lower bound of the words not shared."""
    apart = [F.col(f"{a}{c}").bitwiseXOR(F.col(f"{b}{c}")) for c in SIGNS]
    quarters = [*apart[1:], apart[0].bitwiseXOR(apart[1]).bitwiseXOR(apart[2]).bitwiseXOR(apart[3])]
    return F.coalesce(sum((F.bit_count(q) for q in quarters[1:]), F.bit_count(quarters[0])), F.bit_count(apart[0]))


def _fits(a: str, b: str, num: int, den: int) -> Column:
    """Length, positional and signature filters for two postings."""
    size_a, size_b = F.col(f"{a}size"), F.col(f"{b}size")
    room = F.least(size_a - F.col(f"{a}place"), size_b - F.col(f"{b}place"))
    # the least overlap at the threshold, and so the most words not shared
    need = _ceil_share(size_a + size_b, num, num + den)
    return (F.least(size_a, size_b) * den >= F.greatest(size_a, size_b) * num) & (room >= need) & (_distance(a, b) <= size_a + size_b - 2 * need)


def _near(a: str, b: str) -> Column:
    """Rank of b among a's candidates: the nearest signature first, then by name."""
    return F.shiftleft(F.least(_distance(a, b), F.lit(127)).cast("long"), 56).bitwiseOR(F.col(f"{b}node").bitwiseAND(F.lit(MASK)))


def _earlier(a: str, b: str) -> Column:
    """Whether b's first line comes before a's."""
    d_a, d_b, l_a, l_b = (F.col(c) for c in (f"{a}d", f"{b}d", f"{a}line_no", f"{b}line_no"))
    within = (l_b < l_a) | ((l_b == l_a) & (F.col(f"{b}node") < F.col(f"{a}node")))
    return F.coalesce(d_b < d_a, d_b.isNull() & d_a.isNotNull()) | (d_a.eqNullSafe(d_b) & within)


def _posted(first: DataFrame, part: int = 0, parts: int = 1, more: tuple[str, ...] = ()) -> DataFrame:
    """Postings of one part of the words: a word, the node and what the filters
    read."""
    words = first.where(F.size("prefix") > 0).select("node", "d", "line_no", "size", *SIGNS, "once", *more, F.posexplode("prefix").alias("place", "word"))
    words = words.where(F.pmod(F.xxhash64("word"), F.lit(parts)) == part) if parts > 1 else words
    return words.withColumn("place", F.col("place") + F.col("once")).drop("once")


def _sided(rows: DataFrame, side: str) -> DataFrame:
    return rows.select("word", *[F.col(c).alias(f"{side}_{c}") for c in rows.columns if c != "word"])


def _nearest(rows: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """The nearest candidate x of every y."""
    return rows.groupBy("y").agg(F.min_by("x", "near").alias("x"), F.min("near").alias("near"), *[F.min(c).alias(c) for c in also])


def _pivots(first: DataFrame, part: int, num: int, den: int) -> DataFrame:
    """The nearest of the pivots that each line of one part's lists meets."""
    names = ["node", "size", *SIGNS, "place"]
    rows = _posted(first, part, PARTS)
    band = F.floor(F.log(F.col("size").cast("double")) / F.log(F.lit(den / num)))
    cuts = F.ceil(F.pow(F.lit(2.0), F.shiftright("word", 56) / 4.0) / LIST_ROWS).cast("long")
    # one key for word, band and cut: lists that share a key only offer more
    rows = rows.withColumn("list", F.xxhash64("word", band, F.pmod("node", cuts))).drop("word")
    # dealt out here, as the window's own exchange would carry each pivot beside its row
    rows = rows.repartition("list")
    by_list = Window.partitionBy("list").orderBy(F.col("d").asc_nulls_first(), "line_no", "node")
    so_far = by_list.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pivot = F.struct(*names)
    met = [F.nth_value(pivot, k + 1).over(so_far) for k in range(FIRSTS)] + [F.lag(pivot, 1).over(by_list)]
    rows = rows.select(*[F.col(c).alias(f"y_{c}") for c in names], *[m.alias(f"p{k}") for k, m in enumerate(met)])
    tried = []
    for k in range(FIRSTS + 1):
        p = f"p{k}."
        fits = F.col(f"{p}node").isNotNull() & (F.col(f"{p}node") != F.col("y_node")) & _fits("y_", p, num, den)
        tried.append(F.when(fits, F.struct(_near("y_", p).alias("near"), F.col(f"{p}node").alias("x"))))
    rows = rows.select(F.col("y_node").alias("y"), F.least(*tried).alias("best")).where("best is not null")
    return _nearest(rows.select("y", "best.x", "best.near"))


def _crossed(open_: DataFrame, other: DataFrame, num: int, den: int) -> DataFrame:
    """y, x and rank of all earlier lines that fit, other than those tried;
    ``open_`` postings also have star (a pivot tried) and tried (a rank)."""
    rows = _sided(open_, "y").join(_sided(other, "x"), "word").where(_earlier("y_", "x_") & _fits("y_", "x_", num, den))
    rows = rows.select(F.col("y_node").alias("y"), F.col("x_node").alias("x"), _near("y_", "x_").alias("near"), F.col("y_star").alias("star"), F.col("y_tried").alias("tried"))
    fresh = ~F.col("x").eqNullSafe(F.col("star")) & (F.col("tried").isNull() | (F.col("near") > F.col("tried")))
    return rows.where(fresh)


def _similar(docs: DataFrame, first: DataFrame, pairs: DataFrame, num: int, den: int) -> DataFrame:
    """The nodes y of those pairs (y, x) that reach the threshold."""
    nodes = pairs.select(F.col("y").alias("node")).unionByName(pairs.select(F.col("x").alias("node"))).distinct()
    holder = F.xxhash64("d", "t")
    asked = stage(nodes.join(first, "node").select("node", "size", F.xxhash64(*AT).alias("key"), holder.alias("holder")), "asked")
    # one bitmap tells documents and lines: those of no asked line are not cut up
    wanted = KeyFilter(asked.select(F.explode(F.array("key", "holder")).alias("key")), 2 * asked.count())
    lines = docs.where(wanted.holds(holder)).select("d", "t", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).select(F.xxhash64(*AT).alias("key"), "line")
    # repeated documents are one line a key before they are dealt out
    lines = lines.where(wanted.holds(F.col("key"))).groupBy("key").agg(F.first("line").alias("line"))
    found = stage(lines.join(asked.drop("holder"), "key").select("node", "size", "line"), "found")
    release(docs.sparkSession)
    y, x = (found.select(F.col("node").alias(c), F.col("size").alias(f"{c}_size"), F.col("line").alias(f"{c}_line")) for c in "yx")
    both = pairs.select("y", "x").join(y, "y").join(x, "x")
    common = F.size(F.array_intersect(_hashes(F.col("x_line")), _hashes(F.col("y_line"))))
    both = both.select("y", (F.col("x_size") + F.col("y_size")).alias("sizes"), common.alias("common"))
    out = stage(both.where(F.col("common") * den >= (F.col("sizes") - F.col("common")) * num).select(F.col("y").alias("node")).distinct(), "gone")
    wanted.drop()
    for table in (asked, found):
        unstage(table)
    release(docs.sparkSession)
    return out


def _staged_parts(make, name: str) -> DataFrame:
    """The parts' tables, made one after the other."""
    made = []
    for k in range(PARTS):
        made.append(stage(make(k), name))
        release(made[0].sparkSession)
    return reduce(DataFrame.unionByName, made)


def removed_lines(docs: DataFrame, num: int = 4, den: int = 5) -> DataFrame:
    """d (doc_id), t (hash of the text) and line_no of every line that goes."""
    spark = docs.sparkSession
    docs = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("t"), _spaced(F.col("text").cast("string")).alias("text"))
    lines = stage(_lines(docs, num, den), "lines")
    release(spark)
    first = lines.groupBy("node").agg(F.min(F.struct("d", "line_no", "t", "size", *SIGNS, "once", "prefix")).alias("f")).select("node", "f.*")
    first = stage(first, "first")
    # from here on only each set's first line keeps its prefix
    wide, lines = lines, stage(lines.select(*AT, "node"), "named")
    unstage(wide)
    release(spark)
    pivots = _staged_parts(lambda k: _pivots(first, k, num, den), "pivots")
    star = stage(_nearest(pivots), "star")
    unstage(pivots)
    gone = [_similar(docs, first, star, num, den)]
    tried = star.select(F.col("y").alias("node"), F.col("x").alias("star"))
    # one table holds those that still stand and the others, as a second would be as large again
    marked = first.join(gone[0].withColumn("went", F.lit(True)), "node", "left").join(tried, "node", "left").withColumn("tried", F.lit(None).cast("long"))
    marked = stage(marked, "marked")
    unstage(first)
    first = marked.drop("star", "tried", "went")
    rest = marked.where((F.size("prefix") > 0) & F.col("went").isNull()).drop("went")
    release(spark)

    def nearest_of(k: int) -> DataFrame:
        return _nearest(_crossed(_posted(rest, k, PARTS, ("star", "tried")), _posted(first, k, PARTS), num, den))

    crossed = _staged_parts(nearest_of, "crossed")
    pairs = stage(_nearest(crossed), "pairs")
    unstage(crossed)
    by_rank, asked_for, ask_next = Window.partitionBy("y").orderBy("near"), 1, NEXT
    while True:
        gone.append(_similar(docs, first, pairs, num, den))
        # lines that got fewer candidates than they asked for have no more
        last = pairs.groupBy("y").agg(F.max("near").alias("tried"), F.count("*").alias("k"))
        last = last.where(F.col("k") == asked_for).select(F.col("y").alias("node"), "tried").join(gone[-1], "node", "left_anti")
        asking = stage(rest.drop("tried").join(last, "node"), "asking")
        if asking.isEmpty():
            break
        asked_for, ask_next = ask_next, ask_next * GROWTH
        words = stage(asking.select(F.explode("prefix").alias("key")).distinct(), "words")
        wanted = KeyFilter(words, words.count())
        others = _posted(first).where(wanted.holds(F.col("word")))
        rows = _crossed(_posted(asking, more=("star", "tried")), others, num, den).select("y", "x", "near").distinct()
        unstage(pairs)
        pairs = stage(rows.withColumn("k", F.row_number().over(by_rank)).where(F.col("k") <= asked_for).drop("k"), "pairs")
        wanted.drop()
        for table in (asking, words):
            unstage(table)
        release(spark)
    later = reduce(DataFrame.unionByName, gone)
    stays = first.join(later, "node", "left_anti").select(*AT)
    keys = [lines[c].eqNullSafe(stays[c]) for c in AT]
    out = stage(lines.join(stays, keys, "left_anti").select(*AT), "removed")
    for table in (lines, marked, star, pairs, *gone):
        unstage(table)
    release(spark)
    return out


def without(lines: Column, gone: Column) -> Column:
    """The lines whose places ``gone`` doesn't hold, joined by newlines: a flag a
    line is made from the gaps between places, so the work is linear in the lines."""
    goes = F.array_sort(gone)
    before, after = F.concat(F.array(F.lit(-1)), goes), F.concat(goes, F.array(F.size(lines)))
    stays = F.flatten(F.zip_with(before, after, lambda a, b: F.array_append(F.array_repeat(F.lit(True), b - a - 1), F.lit(False))))
    return F.array_join(F.zip_with(lines, stays, lambda line, s: F.when(s, line)), "\n")


def drop_repeated_lines(docs: DataFrame, num: int = 4, den: int = 5) -> DataFrame:
    """``docs`` with the text of the lines that stay, and n_lines, n_removed."""
    gone = removed_lines(docs, num, den).groupBy("d", "t").agg(F.collect_set("line_no").alias("gone"))
    # columns are named through their tables: docs may have any other names
    text = docs["text"].cast("string")
    joined = docs.join(gone, docs["doc_id"].eqNullSafe(gone["d"]) & (F.xxhash64(docs["text"]) == gone["t"]), "left")
    lines = F.split(text, "\n")
    return joined.select(
        *[docs[c] for c in docs.columns if c not in ("text", "n_lines", "n_removed")],
        F.when(gone["gone"].isNull(), text).otherwise(without(lines, gone["gone"])).alias("text"),
        F.when(text.isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.when(gone["gone"].isNotNull(), F.size(gone["gone"])).otherwise(0).cast("long").alias("n_removed"),
    )
