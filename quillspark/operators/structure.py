"""Headings, sections, genres and citations of Markdown or LaTeX documents."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lexicons as L
from ..functions import text as T
from ..functions.folding import fold
from ..sources.staged import staged
from .similarity import WITHIN, cents, most_similar, most_similar_in_rows
from .vectors import chunks, word_blocks
from ..functions.lexical import plain, stemmed, stems

LATEX = r"\\[a-zA-Z]+\*?|[{}]"
NUMBERING = r"^#+\s*\d+(?:\.\d+)*\.?\s*|^#+\s*"


def _bare(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, LATEX, ""))


def _title(text: Column) -> Column:
    marked = F.filter(T.lines(text), lambda x: x.startswith("# "))
    plain = F.when(F.size(marked) > 0, F.trim(F.substring(F.get(marked, F.lit(0)), 3, 1 << 20)))
    latex = _bare(F.regexp_extract(text, r"\\title\{([^}]*)\}", 1))
    return F.when(F.coalesce(plain, F.lit("")) != "", plain).otherwise(latex)


def _unnumbered(line: Column) -> Column:
    """A heading line without its marks; numbering goes with them."""
    return F.trim(F.regexp_replace(line, r"^#+\s*\d+(?:\.\d+)*\.?\s*", ""))


def headings(docs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, title and the array of section headings (levels 2 and 3, LaTeX
    sections), "abstract" left out."""
    text = T.clean(F.col("text"))
    marked = F.transform(F.filter(T.lines(text), lambda x: x.rlike(r"^###?\s")), _unnumbered)
    latex = F.transform(F.regexp_extract_all(text, F.lit(r"\\(?:sub)?section\*?\{([^}]*)\}"), 1), _bare)
    kept = F.filter(F.concat(marked, latex), lambda h: (h != "") & (F.lower(h) != "abstract"))
    return docs.select(*keys, _title(text).alias("title"), kept.alias("heads"))


def title_case(h: Column) -> Column:
    """Capitalised share of the words after the first, some acronyms aside."""
    words = T.tokens(h, r"[A-Za-z][A-Za-z'\-]+")
    rest = F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0)))
    capital = F.size(F.filter(rest, lambda w: w.rlike("^[A-Z]") & ~F.lower(w).isin(L.TITLE_CASE_EXEMPT)))
    return F.when(F.size(rest) > 0, F.floor(capital * 100.0 / F.greatest(F.size(rest), F.lit(1)) + 0.5) / 100).otherwise(0.0)


def content_words(h: Column) -> Column:
    return F.filter(T.tokens(F.lower(h), r"[a-z][a-z'\-]{2,}"), lambda w: ~w.isin(L.NOMINAL_STOP))


def nominal_share(h: Column) -> Column:
    words = content_words(h)
    n = F.size(F.filter(words, lambda w: w.rlike(L.NOMINAL_SUFFIX)))
    return F.when(F.size(words) > 0, F.floor(n * 100.0 / F.greatest(F.size(words), F.lit(1)) + 0.5) / 100).otherwise(0.0)


def heading_features(docs: DataFrame, keys: list[str]) -> DataFrame:
    """Eleven heading measures; documents without headings give no row."""
    rows = headings(docs, keys).withColumn("all", F.when(F.col("title") != "", F.concat(F.array("title"), F.col("heads"))).otherwise(F.col("heads"))).where(F.size("all") > 0)
    na, nh = F.size("all"), F.greatest(F.size("heads"), F.lit(1))

    def share(array: str, test, of: Column) -> Column:
        return F.round(F.size(F.filter(array, test)) / of, 4)

    def mean(value) -> Column:
        return F.round(F.aggregate(F.transform("all", value), F.lit(0.0), lambda a, x: a + x) / na, 4)

    return rows.select(
        *keys, mean(title_case).alias("title_case"), mean(lambda h: T.spaced_words(h).cast("double")).alias("mean_words"), mean(nominal_share).alias("nominalization"),
        share("heads", lambda h: F.lower(h).rlike(r"\b(?:and|or)\b"), nh).alias("compound"), share("all", lambda h: h.rlike(r"(?i)^towards?\b"), na).alias("toward"),
        share("all", lambda h: F.lower(h).rlike(r"\bnot\b"), na).alias("antithesis"), share("all", lambda h: h.contains(":"), na).alias("colon"),
        share("all", lambda h: h.contains('"') | h.contains("“"), na).alias("quoted"), share("heads", lambda h: h.contains(","), na).alias("comma"),
        share("all", lambda h: h.rlike(L.SELF_CONGRATULATION), na).alias("selfcong"),
        share("all", lambda h: h.rlike(L.INTERROGATIVE) | h.endswith("?"), na).alias("interrogative"),
    )


def abstract_headings(docs: DataFrame, keys: list[str], least: float = 0.6, words: int = 2) -> DataFrame:
    """Headings that are mostly nominalisations, standard names aside."""
    rows = headings(docs, keys).select(*keys, F.explode("heads").alias("heading"))
    rows = rows.withColumn("rate", nominal_share(F.col("heading"))).where((F.size(content_words(F.col("heading"))) >= words) & (F.col("rate") >= least))
    return rows.where(~F.lower("heading").isin(L.STANDARD_HEADINGS))


def heading_strings(docs: DataFrame, keys: list[str]) -> DataFrame:
    """Section titles, captions and Markdown headings; the first level-1 heading
    counts as heading and as title."""
    text = T.clean(F.col("text"))
    sections = F.regexp_extract_all(text, F.lit(r"\\(?:sub){0,2}section\*?\{([^}]*)\}"), 1)
    captions = F.regexp_extract_all(text, F.lit(r"\\caption\{([^}]*)\}"), 1)
    marked = F.transform(F.filter(T.lines(text), lambda x: x.rlike(r"^#{1,4}\s")), _unnumbered)
    first = F.transform(F.slice(F.filter(T.lines(text), lambda x: x.startswith("# ")), 1, 1), lambda x: F.trim(F.substring(x, 3, 1 << 20)))
    bare = F.transform(F.concat(sections, captions, marked, first), lambda h: F.trim(F.regexp_replace(h, r"\\[a-zA-Z]+\*?|[{}$]", "")))
    return docs.select(*keys, F.posexplode(F.filter(bare, lambda h: h != "")).alias("pos", "heading"))


def interrogative_headings(docs: DataFrame, keys: list[str]) -> DataFrame:
    """Headings that ask (2) or open like a question (1)."""
    score = F.when(F.col("heading").endswith("?"), 2).when(F.col("heading").rlike(L.INTERROGATIVE), 1).otherwise(0)
    rows = heading_strings(docs, keys).where(~F.lower("heading").isin(L.STANDARD_HEADINGS)).withColumn("score", score)
    return rows.where("score > 0")


def heading_flags(features: DataFrame, group: str, keys: list[str], margin: str = "mirror") -> DataFrame:
    """Heading measures over their group's median by one of two margins."""
    names = [c for c in features.columns if c not in (group, *keys)]
    long = features.unpivot([group, *keys], names, "feature", "value")
    mid = long.groupBy(group, "feature").agg(F.median("value").alias("mid"))
    if margin == "mirror":
        limit = F.when(F.col("feature").isin("title_case", "mean_words", "compound"), 1.3 * F.col("mid") + 0.05).otherwise(F.col("mid"))
    else:
        limit = F.col("mid") + F.greatest(F.lit(0.1), 0.5 * F.col("mid"))
    return long.join(mid, [group, "feature"]).where(F.col("value") > limit).select(group, *keys, "feature", "value", "mid")


def sections(docs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pos, title and body; text before the first heading is dropped."""
    mark = "\u0001"
    marked = F.regexp_replace(T.clean(F.col("text")), T.SECTION_LINE, mark + "$1$2" + mark)
    parts = F.split(marked, mark)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.floor((F.size(parts) - 1) / 2).cast("int"), F.lit(1))), lambda i: F.struct(F.trim(F.get(parts, 2 * i - 1)).alias("title"), F.get(parts, 2 * i).alias("body")))
    return docs.select(*keys, F.when(F.size(parts) >= 3, pairs).otherwise(F.slice(pairs, 1, 0)).alias("s")).select(*keys, F.posexplode("s").alias("pos", "s")).select(*keys, "pos", "s.title", "s.body")


def section_type(title: Column, genre: str = "academic") -> Column:
    out = None
    for name, pattern in L.SECTION_TYPES[genre]:
        hit = F.lower(title).rlike(pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("other")


def section_order(docs: DataFrame, keys: list[str]) -> DataFrame:
    """Type and relative place of each section, "abstract" left out."""
    rows = sections(docs, keys).withColumn("name", F.trim(F.regexp_replace("title", r"^\d+(?:\.\d+)*\.?\s*", ""))).where("name <> '' and lower(name) <> 'abstract'")
    w = Window.partitionBy(*keys)
    rows = rows.withColumn("i", F.row_number().over(w.orderBy("pos")) - 1).withColumn("n", F.count("*").over(w))
    return rows.select(*keys, "i", "name", section_type(F.col("name")).alias("type"), (F.floor(F.col("i") * 100.0 / F.col("n") + 0.5) / 100).alias("place"))


def structure_profile(docs: DataFrame, group: str, key: str, least: int = 30) -> DataFrame:
    """Whole-number medians of section count and length of each group."""
    kept = sections(docs, [group, key]).where(T.spaced_words(F.col("body")) >= least)
    per = docs.select(group, key).join(kept.groupBy(group, key).agg(F.count("*").alias("k")), [group, key], "left")
    counts = per.groupBy(group).agg(F.count("*").alias("n"), F.floor(F.median(F.coalesce("k", F.lit(0)))).cast("long").alias("sections_mid"))
    lengths = kept.groupBy(group).agg(F.floor(F.median(T.spaced_words(T.prose(F.col("body"))))).cast("long").alias("length_mid"))
    return counts.join(lengths, group, "left")


def section_lengths_cv(docs: DataFrame, keys: list[str]) -> DataFrame:
    """Spread of section word counts; 0 for fewer than two sections."""
    rows = sections(docs, keys).withColumn("w", T.word_count(T.prose(F.col("body"))))
    got = rows.groupBy(*keys).agg(F.count("*").alias("k"), F.stddev_pop("w").alias("sd"), F.avg("w").alias("m"))
    joined = docs.select(*keys).join(got, keys, "left")
    return joined.select(*keys, F.coalesce(F.when(F.col("k") >= 2, F.round(F.col("sd") / F.col("m"), 6)), F.lit(0.0)).alias("section_cv"))


def _stem_counts(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    return rows.select(*keys, F.explode(stems(F.col(text))).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("n"))


def section_redundancy(docs: DataFrame, key: str, most: int = 6, over: int = 120) -> DataFrame:
    """The most similar pairs of a document's longer sections."""
    rows = sections(docs, [key]).withColumn("p", T.prose(F.col("body"))).where(T.spaced_words(F.col("p")) > over)
    rows = rows.select(key, F.col("pos").alias("part"), F.regexp_replace("title", r"^\d+\.?\s*", "").alias("name"), "p")
    found = most_similar(rows.select(key, "part"), _stem_counts(rows, [key, "part"], "p"), key, most)
    for side, name in (("a", "first"), ("b", "second")):
        found = found.join(rows.select(key, F.col("part").alias(side), F.col("name").alias(name)), [key, side])
    return found.select(key, "rank", "first", "second", "cosine", (F.col("cosine") >= 0.6).alias("restated"))


def block_redundancy(docs: DataFrame, key: str, words: int = 150, most: int = 6) -> DataFrame:
    """The most similar pairs of a document's blocks of so many words, for prose
    without headings; the last block may be shorter.

    A document of up to ``WITHIN`` blocks is one row from text to pairs, and nothing
    of it is dealt out."""
    docs = docs.where(F.col(key).isNotNull()).select(key, "text")
    shared = staged(docs.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(F.col(key).alias("_shared")), "shared")
    # rows that share a key have their blocks taken together
    split = []
    if not shared.isEmpty():
        split.append(chunks(docs.join(shared, F.col(key) == F.col("_shared"), "left_semi"), [key], words=words, most=None).select(key, F.col("chunk").alias("part"), "text"))
        docs = docs.join(shared, F.col(key) == F.col("_shared"), "left_anti")
    # a word and the space behind it are two characters
    large = F.coalesce(F.length("text"), F.lit(0)) >= 2 * words * WITHIN
    rows = staged(word_blocks(docs.where(large), [key], words, None), "rows")
    few = F.size("blocks") <= WITHIN
    split.append(rows.where(~few).select(key, F.posexplode("blocks").alias("part", "text")))
    own = word_blocks(docs.where(~large), [key], words, None).unionByName(rows.where(few))
    found = most_similar_in_rows(own.select(key, F.transform("blocks", plain).alias("texts")), key, stemmed, most)
    blocks = reduce(DataFrame.unionByName, split)
    if blocks.isEmpty():
        return found
    return found.unionByName(most_similar(blocks.select(key, "part"), _stem_counts(blocks, [key, "part"], "text"), key, most))


def conclusion_restatement(docs: DataFrame, key: str, over: int = 80) -> DataFrame:
    """Cosine of the first conclusion section with the longer other sections."""
    rows = sections(docs, [key]).withColumn("name", F.regexp_replace("title", r"^\d+\.?\s*", "")).withColumn("p", T.prose(F.col("body")))
    last = rows.where(F.col("name").rlike(L.CONCLUSION_TITLE)).groupBy(key).agg(F.min("pos").alias("at"))
    rows = rows.join(last, key)
    side = F.when(F.col("pos") == F.col("at"), 1).when(T.spaced_words(F.col("p")) > over, 0)
    counts = _stem_counts(rows.withColumn("side", side).where("side is not null"), [key, "side"], "p")
    wide = counts.groupBy(key, "term").agg(*[F.sum(F.when(F.col("side") == s, F.col("n")).otherwise(0)).alias(f"c{s}") for s in (0, 1)])
    sums = wide.groupBy(key).agg(F.sum(F.col("c0") * F.col("c1")).alias("dot"), F.sum(F.col("c0") * F.col("c0")).alias("n0"), F.sum(F.col("c1") * F.col("c1")).alias("n1"))
    return sums.where("n0 > 0 and n1 > 0").select(key, cents(F.col("dot") / (F.sqrt("n0") * F.sqrt("n1"))).alias("cosine"))


def densest_sections(docs: DataFrame, key: str, least: int = 80, most: int = 8) -> DataFrame:
    """A document's sections of at least so many raw words, hardest first."""
    from ..functions.lexical import readability

    rows = sections(docs, [key]).where(T.spaced_words(F.col("body")) >= least).withColumnRenamed("body", "text")
    graded = rows.select(key, "pos", "title").join(readability(rows, [key, "pos"]).select(key, "pos", "fk_grade"), [key, "pos"])
    top = Window.partitionBy(key).orderBy(F.desc("fk_grade"), "pos")
    return graded.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= most).select(key, "rank", "title", F.round("fk_grade", 1).alias("fk_grade"))


# Genres: a module is a name, a group predicate, and per-document marks whose
# mean over a group is a rate.  Modules can be registered at run time.
GENRES: dict[str, dict] = {}


def register_genre(name: str, applies: Callable[[], Column], marks: Callable[[], dict[str, Column]], sectype: str) -> None:
    """``applies``: an aggregate over a group's documents; ``marks``: aggregates
    over a document's rows of ``genre_marks`` (columns type_<section type>)."""
    GENRES[name] = {"applies": applies, "marks": marks, "sectype": sectype}


def _share(pattern: str) -> Column:
    return F.sum(F.when(F.col("text").rlike(pattern), 1).otherwise(0))


def _half() -> Column:
    return F.floor(F.count("*") / 2)


register_genre("academic", lambda: _share(L.ACADEMIC_MARK) >= F.greatest(F.lit(2), _half()), lambda: {"related_rate": F.col("type_related"), "conclusion_rate": F.col("type_conclusion")}, "academic")
register_genre(
    "essay",
    lambda: (_share(L.ESSAY_NOT) == 0) & (_share(r"(?m)^#{1,4}\s") >= 1) & (F.sum(F.regexp_count("text", F.lit(L.ARGUING))) >= 3) & (F.sum(F.regexp_count("text", F.lit(L.SPEAKING))) >= 10),
    lambda: {"hook_rate": F.col("type_hook"), "example_rate": F.col("type_example"), "objection_rate": F.col("type_objection")}, "essay",
)
register_genre(
    "design-doc",
    lambda: (_share(r"(?m)^#{1,4}\s") >= F.greatest(F.lit(1), _half())) & (_share(L.ACADEMIC_ANY) < F.greatest(F.lit(2), _half())),
    lambda: {"motivation_rate": F.col("type_motivation"), "tradeoff_rate": F.col("type_tradeoff"), "consequence_rate": F.col("type_consequence")}, "design-doc",
)


def resolve_genre(docs: DataFrame, group: str, forced: str | None = None) -> DataFrame:
    """The genre of each group, from all its documents.

    A forced name wins.  Next, one mark of a README anywhere in the group means
    none; then a group without code fences, with 12 or more first- and
    second-person words per 1000 of prose and 4 or more arguing words, is an
    essay; then the first registered module that applies.  Counts are sums over
    each document's own prose: a references heading ends its document only."""
    if forced:
        return docs.groupBy(group).agg(F.lit(forced).alias("genre"))
    rows = docs.withColumn("text", T.clean(F.col("text"))).withColumn("p", F.lower(T.prose(F.col("text"))))

    def total(pattern: str, column: str) -> Column:
        return F.sum(F.regexp_count(column, F.lit(pattern)))

    voiced = F.lit(1000) * total(L.VOICE, "p") / F.greatest(total(r"\S+", "p"), F.lit(1))
    out = F.when(_share(L.README) > 0, F.lit("none"))
    if "essay" in GENRES:
        out = out.when((total("```", "text") == 0) & (voiced >= 12) & (total(L.ARGUMENT, "p") >= 4), F.lit("essay"))
    for name, module in GENRES.items():
        out = out.when(module["applies"](), F.lit(name))
    return rows.groupBy(group).agg(out.otherwise("none").alias("genre"))


def genre_rates(docs: DataFrame, group: str, key: str, genre: str) -> DataFrame:
    """The rates a genre module measures on each group's documents."""
    module = GENRES[genre]
    strip = r"^\d+(?:\.\d+)*\.?\s*" if genre == "academic" else r"^#*\s*\d*\.?\s*"
    names = [n for n, _ in L.SECTION_TYPES[module["sectype"]]]
    typed = sections(docs, [group, key]).withColumn("type", section_type(F.regexp_replace("title", strip, ""), module["sectype"]))
    if genre == "academic":
        typed = typed.where(F.lower(F.trim(F.regexp_replace("title", strip, ""))) != "abstract")
    marks = typed.groupBy(group, key).agg(*[F.max(F.when(F.col("type") == n, 1.0).otherwise(0.0)).alias(f"type_{n}") for n in names])
    rows = docs.select(group, key).join(marks, [group, key], "left").fillna(0.0)
    return rows.groupBy(group).agg(F.count("*").alias("n"), *[F.round(F.avg(c), 4).alias(name) for name, c in module["marks"]().items()])


def related_position(docs: DataFrame, group: str, key: str) -> DataFrame:
    """Median place of the first related-work section in each group."""
    first = section_order(docs, [group, key]).where("type = 'related'").groupBy(group, key).agg(F.min("place").alias("place"))
    return first.groupBy(group).agg(F.round(F.median("place"), 2).alias("related_pos_mid"), F.count("*").alias("n"))


def genre_lines(docs: DataFrame, group: str, key: str, genre: str) -> DataFrame:
    """Each document beside its group by what a genre measures, a row a measure.

    ``flow`` has the types of its sections in the order in which they first come
    up.  A rate has yes or no for the document and the group's share of documents.
    ``related_position`` (academic) has the place of the document's first
    related-work section and the group's median; its note says earlier where the
    group places it more than 0.2 before, else in band."""
    module = GENRES[genre]
    if genre == "academic":
        order = section_order(docs, [group, key]).withColumnRenamed("i", "pos")
    else:
        order = sections(docs, [group, key]).withColumn("type", section_type(F.regexp_replace("title", r"^#*\s*\d*\.?\s*", ""), module["sectype"])).withColumn("place", F.lit(None).cast("double"))
    # a document's sections: one row each of a type and two numbers
    seen = order.groupBy(group, key, "type").agg(F.min("pos").alias("pos"), F.min("place").alias("place")).where("type <> 'other'")
    per = seen.groupBy(group, key).agg(F.sort_array(F.collect_list(F.struct("pos", "type", "place"))).alias("s"))
    per = docs.select(group, key).join(per, [group, key], "left").withColumn("types", F.coalesce(F.transform("s", lambda x: x["type"]), F.array().cast("array<string>")))
    rates = genre_rates(docs, group, key, genre).drop("n")
    names = [c for c in rates.columns if c != group]
    flow = F.struct(F.lit(0).alias("pos"), F.lit("flow").alias("measure"), F.array_join("types", " -> ").alias("draft"), F.lit(None).cast("double").alias("corpus"), F.lit("").alias("note"))
    said = [flow]
    rows = per.join(rates, group)
    for k, name in enumerate(names):
        has = F.array_contains("types", name.removesuffix("_rate"))
        said.append(F.struct(F.lit(k + 2).alias("pos"), F.lit(name.removesuffix("_rate")).alias("measure"), F.when(has, "yes").otherwise("no").alias("draft"), F.col(name).alias("corpus"), F.lit("").alias("note")))
    if genre == "academic":
        rows = rows.join(related_position(docs, group, key).select(group, "related_pos_mid"), group, "left")
        own = F.get(F.filter("s", lambda x: x["type"] == "related"), F.lit(0))["place"]
        note = F.when(F.col("related_pos_mid").isNull(), "").when(own > F.col("related_pos_mid") + 0.2, "earlier").otherwise("in band")
        place = F.struct(F.lit(1).alias("pos"), F.lit("related_position").alias("measure"), own.cast("string").alias("draft"), F.col("related_pos_mid").alias("corpus"), note.alias("note"))
        said.append(F.when(own.isNotNull(), place))
    return rows.select(group, key, F.explode(F.array_compact(F.array(*said))).alias("x")).select(group, key, "x.*")


def textual_citations(docs: DataFrame, keys: list[str]) -> DataFrame:
    """Author phrases with a year, as they stand in the text."""
    text = T.clean(F.col("text"))
    whole = F.regexp_extract_all(text, F.lit(rf"({L.AUTHORS}\s*\(?{L.YEAR})\b"), 1)
    rows = docs.select(*keys, F.posexplode(whole).alias("pos", "m"))
    return rows.select(*keys, "pos", F.trim(F.regexp_extract("m", rf"^({L.AUTHORS})\s*\(?({L.YEAR})", 1)).alias("authors"), F.regexp_extract("m", rf"({L.YEAR})$", 1).alias("year"))


def _grams(text: Column) -> Column:
    """The distinct trigrams of a text of three characters or more."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 2, F.lit(1))), lambda i: F.substring(text, i, F.lit(3))))


def found_in_lines(asked: DataFrame, lines: DataFrame, name: str, line: str, by: list[str]) -> DataFrame:
    """The distinct (by, name) that stand within a line of the same ``by``.  Names
    have three characters or more.

    An inverted index of the lines' trigrams, of those that names have: each name
    looks up its rarest trigram and is then searched for in those lines alone, so
    neither the lines nor the names are ever in one row or task.  Null ``by`` match
    nothing."""
    names = asked.select(*by, name).distinct()
    wanted = names.select(*by, name, F.explode(_grams(F.col(name))).alias("_gram"))
    numbered = lines.where(F.length(line) >= 3).select(*by, F.col(line).alias("_line"), F.xxhash64(line).alias("_id"))
    index = numbered.select(*by, "_id", F.explode(_grams(F.col("_line"))).alias("_gram")).join(wanted.select(*by, "_gram").distinct(), [*by, "_gram"], "left_semi").distinct()
    sizes = index.groupBy(*by, "_gram").agg(F.count("*").alias("_k"))
    rarest = wanted.join(sizes, [*by, "_gram"], "left").groupBy(*by, name).agg(F.min(F.struct(F.coalesce("_k", F.lit(0)).alias("k"), F.col("_gram").alias("gram"))).alias("_best"))
    rarest = rarest.where("_best.k > 0").select(*by, name, F.col("_best.gram").alias("_gram"))
    places = rarest.join(index, [*by, "_gram"]).select(*by, name, "_id").distinct()
    return places.join(numbered, [*by, "_id"]).where(F.col("_line").contains(F.col(name))).select(*by, name).distinct()


def missing_citations(docs: DataFrame, keys: list[str], lines: DataFrame | None = None) -> DataFrame:
    """Citations whose first surname stands in no cite key and no bibliography.

    ``lines`` has the lines of one bibliography for all documents (column line);
    without it ``docs`` has a bibliography each (column bib, may be null).
    Documents with a null key are left out."""
    cites = F.regexp_extract_all(T.clean(F.col("text")), F.lit(r"\\cite[a-z]*\*?(?:\[[^]]*\])*\{([^}]+)\}"), 1)
    cited = docs.select(*keys, fold(F.array_join(cites, " ")).alias("_keys"))
    first = F.regexp_replace(F.split(F.col("authors"), r"\s+(?:and|&|et)\b", 2)[0], r"['’]s\b", "")
    rows = textual_citations(docs, keys).withColumn("surname", F.regexp_replace(fold(first), "[^a-z]", ""))
    rows = rows.where((F.length("surname") >= 3) & ~F.col("surname").isin(L.NOT_SURNAMES)).join(cited, keys).where(~F.col("_keys").contains(F.col("surname")))
    by = keys if lines is None else []
    if lines is None:
        lines = docs.select(*keys, F.explode(F.split(F.coalesce("bib", F.lit("")), r"[\r\n]+")).alias("line"))
    known = found_in_lines(rows, lines.select(*by, fold(F.col("line")).alias("line")), "surname", "line", by)
    rows = rows.join(known, [*by, "surname"], "left_anti")
    return rows.select(*keys, F.format_string("%s (%s)", "authors", "year").alias("citation")).distinct()


def overclaims(docs: DataFrame, keys: list[str], most: int = 25, chars: int = 120) -> DataFrame:
    """Citations followed within three words by a verb that claims too much."""
    pattern = rf"((?:\\cite[a-z]*\{{[^}}]+\}}|{L.AUTHORS}\s*\({L.YEAR}\))(?:\s+\w+){{0,3}}?\s+{L.OVERCLAIM})\b"
    found = F.regexp_extract_all(T.clean(F.col("text")), F.lit(pattern), 1)
    rows = docs.select(*keys, F.posexplode(F.slice(found, 1, most)).alias("pos", "m"))
    return rows.select(*keys, "pos", F.substring(F.regexp_replace("m", r"\s+", " "), 1, chars).alias("span"))
