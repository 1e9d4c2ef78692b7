import random
import time
import tracemalloc

from quillspark.llm import html_text, toxicity
from quillspark.llm.runtime import stage_path

SCHEMA = "doc_id long, text string, score string"


def test_article_without_boilerplate():
    page = """<html><head><title>T</title><style>p{}</style><script>var a = "<p>no</p>";</script></head><body class="no-sidebar">
    <header><a href=/>Site</a></header><nav><ul><li><a href=/a>Menu</a></ul></nav><div class="cookie-notice">We use cookies</div><!-- <p>no</p> -->
    <article><header><h1>A  title &amp; more</h1></header><p>First <b>bold</b>
    line&nbsp;here &lt;tag&gt;<p>Short.</p><div class="ad">Buy</div><form><p>Mail</p></form><p>Last<br>one</p><section id="comments"><p>The reader says that it is good and all.</p></section></article>
    <aside>Side</aside><footer>&copy; all</footer></body></html>"""
    assert html_text.main_text(page) == "A title & more\nFirst bold line here <tag>\nShort.\nLast one"


def test_block_rules_without_container():
    good = "The cat sat on the mat and it was glad that the dog had gone to the end of the road with all of them."
    page = f"<body><div><a href=x>Home</a> <a href=y>News</a></div><p>{good}</p><p>Yes.</p><p>{good}</p><div><a href=1>{good}</a></div><p>Tail</p></body>"
    assert html_text.main_text(page) == f"{good}\nYes.\n{good}"


def test_pages_without_good_blocks_and_teaser_articles():
    assert html_text.main_text("<p>Short.</p><p>Two lines.</p><p><a href=x>Home</a></p><p>End</p>") == "Short.\nTwo lines."
    good = "The cat sat on the mat and it was glad that the dog had gone to the end of the road with all of them."
    teasers = "<article><a href=1>One more</a></article><article><p>Two</p></article>"
    assert html_text.main_text(f"<div><p>{good}</p><p>{good}</p></div><p><a href=0>More to read</a></p>{teasers}") == f"{good}\n{good}"
    assert html_text.main_text(f"<p>{good}</p><article><p>{good}</p><p>{good}</p></article>") == f"{good}\n{good}"


GOOD = "The cat sat on the mat and it was glad that the dog had gone to the end of the road with all of them."


def test_articles_that_are_not_the_article():
    page = f"<article><p>{GOOD}</p></article>"
    comment = "<article><p>A reader said that it was all very good and to the point.</p></article>"
    assert html_text.main_text(f'{page}<section id="comments"><ol class="comment-list"><li>{comment}</li></ol></section>') == GOOD
    assert html_text.main_text(f'<article><p>{GOOD}</p><div class="comments">{comment}</div></article>') == GOOD
    for other in ('<aside><article class="teaser"><p>More of it</p></article></aside>', "<article hidden><p>Not yet</p></article>", '<article class="comment"><p>Mine</p></article>', "<footer><article><p>Foot</p></article></footer>"):
        assert html_text.main_text(page + other) == html_text.main_text(other + page) == GOOD
    assert html_text.main_text(f"<nav><ul><li>Menu{page}") == GOOD  # the menu was never closed


def test_nothing_else_of_the_article_goes():
    parts = [f"<p>{GOOD}</p>", '<p><a href="x">All of this paragraph is a link</a></p>', "<ul><li><a href=y>Linked item</a></li></ul>", "<figure><img src=z><figcaption>A caption</figcaption></figure>",
             '<div class="header-image-caption"><p>Header image</p></div>', '<p class="notice-board">On the board</p>']
    text = [GOOD, "All of this paragraph is a link", "Linked item", "A caption", "Header image", "On the board"]
    assert html_text.main_text(f"<article>{''.join(parts)}<div class='cookie-notice'>Cookies</div></article>") == "\n".join(text)
    words = "東京の天気は晴れです。" * 20
    assert html_text.main_text(f"<div><a href=1>ホーム</a></div><p>{words}</p><p>{words}</p>") == f"{words}\n{words}"


def test_short_and_foreign_articles_stay():
    links = '<ul><li><a href=1>Home page</a></li><li><a href=2>More news</a></li></ul>'
    short = "<article><h1>Title</h1><p>Roses are red</p><p>Violets are blue</p></article>"
    assert html_text.main_text(f"{short}{links}<p>{GOOD}</p>") == "Title\nRoses are red\nViolets are blue"
    words = "東京の天気は晴れです。" * 30
    assert html_text.main_text(f"<p>{GOOD}</p>{links}<article><p>{words}</p></article>") == words
    assert html_text.main_text(f"<p>{GOOD}</p><p>Short end.</p>{links}") == f"{GOOD}\nShort end."
    assert html_text.main_text(f"{links}<h2>Heading</h2><p>{GOOD}</p>{links}<p>Imprint</p>") == f"Heading\n{GOOD}"


def test_boxes_of_an_article():
    for name in ("user-feedback", "response", "reader-responses", "comments"):
        assert html_text.main_text(f'<main><p>{GOOD}</p><div class="{name}"><p>{GOOD}</p></div></main>') == GOOD
    for name in ("alert", "social", "notice"):
        assert html_text.main_text(f'<article><p>{GOOD}</p><p class="{name}">Stays.</p></article>') == f"{GOOD}\nStays."
        assert html_text.main_text(f'<article><p>{GOOD}</p><div class="{name}">Goes.</div></article>') == GOOD
    assert html_text.main_text(f'<article><p>{GOOD}</p><div class="widget"><p>Stays.</p></div></article>') == f"{GOOD}\nStays."


def test_hostile_nesting_is_linear():
    began = time.time()
    for n in (250_000,):
        html_text.main_text("<b>" * n + "<nav>" + "<article></article>" * n)
        html_text.main_text("".join(f"<x{k} class=nav>" for k in range(n)) + "<article></article>" * n)
    assert time.time() - began < 60


def test_long_and_hostile_pages():
    began = time.time()
    for piece in ("<div></x>", "<span><p></p>", "<b><li></li>", "<a '", "</div><p>", "<!--", '<article><nav>'):
        html_text.main_text(piece * (500_000 // len(piece)))
    assert len(html_text.main_text("<article>" + f"<p>{GOOD}</p>" * 50_000)) == 50_000 * (len(GOOD) + 1) - 1
    assert time.time() - began < 60


def test_degenerate_pages(spark):
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<nav>a") == ""
    assert html_text.main_text("<article><p>cut off <a hre") == "cut off"
    rows = spark.createDataFrame([(1, "u", None, "x"), (1, "u", "<main>t</main>", "x")], "page_id long, url string, html string, text string")
    assert sorted(r.n_chars for r in html_text.extract(rows).collect()) == [0, 1]
    assert html_text.extract(rows.limit(0)).count() == 0


def test_grammar_reads_clauses():
    s = toxicity.Scorer(toxicity.Model({"zorg*": 4.0}))
    plain, aimed = s.clause("a zorgs here".split()), s.clause("you are a zorgs".split())
    denied, told = s.clause("you are not a zorgs".split()), s.clause("they said you are a zorgs".split())
    assert aimed > plain > denied and told < aimed
    assert s.clause("i will kill you".split()) >= 3 and s.clause("i kill time".split()) == 0
    assert s.clauses("A calm text. You zorg!\nAll well") and not s.clauses("xzorg is inside a word")


def test_composition_equals_parts():
    a = toxicity.Transducer().arc(0, 1, 1, plus=1.0).arc(1, 1, 0, times=0.5)
    b = toxicity.Transducer().arc(0, 2, 1).arc(1, 1, 1, times=0.1, plus=2.0)
    both, rng = toxicity.compose(a, b), random.Random(1)
    for _ in range(50):
        word = [rng.randrange(4) for _ in range(8)]
        x = y = z = 0
        for c in word:
            x, f, p = a.step(x, c)
            y, g, q = b.step(y, c)
            z, h, r = both.step(z, c)
            assert (h, r) == (f * g, p + q)


def corpus(rng, n):
    out = []
    for _ in range(n):
        words = [f"{rng.choice('bdfg')}{rng.choice('aeiou')}{rng.choice('lmnr')}{rng.randrange(99)}" for _ in range(rng.randint(5, 40))]
        label = int(rng.random() < 0.3)
        if label:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words)), rng.choice(["grukka", "velsto"]) + rng.choice(["", "n", "si", "ta"]))
        out.append((" ".join(words).replace("5 ", "5. "), label))
    return out


def test_learned_stems_hold_out(spark):
    rng = random.Random(8)
    rows = corpus(rng, 900)
    docs = spark.createDataFrame([(i, t, "x") for i, (t, _) in enumerate(rows)] + [(900, None, "x"), (901, "", "x")], SCHEMA)
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, rows=300)
    assert any(s.startswith("grukk") for s in model.stems) and len(model.stems) <= 4
    found = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    wrong = sum(found[i].predicted != y for i, (_, y) in enumerate(rows))
    assert wrong <= 9 and all(0 <= r.score <= 1 for r in found.values())
    assert found[900].score == found[901].score and found[900].predicted == 0


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "you are an idiot", "x"), (2, "a fine day", "x")], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()}
    assert got[1] > got[2]
    assert toxicity.score(docs.limit(0), toxicity.Model()).count() == 0


def test_stems_are_counted_by_tasks_and_texts_stay_out_of_the_driver(spark):
    rng = random.Random(11)
    data = [(k, " ".join(rng.choice(["ab" + rng.choice("cde"), "Zorg" + rng.choice("xyz"), 9 * "q" + "".join(rng.choices("rstuvw", k=9))]) for _ in range(6000)), k % 2) for k in range(60)]
    data += [(60, None, 1), (61, "", 0)]
    training = spark.createDataFrame([(t, y, k % 4 < 2) for k, t, y in data], "text string, toxic int, first boolean")
    expected = {}
    for every in (True, False):
        contexts, held = {}, {}
        for k, t, y in data:
            if every or k % 4 < 2:
                words = toxicity.WORD.findall((t or "").lower())
                for before, word in zip(["", *words], words):
                    for s in toxicity.stems(word):
                        held.setdefault((s, y), set()).add(k)
                        if y:
                            contexts.setdefault(s, set()).add(before)
        expected[every] = {s: (len(c), len(held.get((s, 1), ())), len(held.get((s, 0), ()))) for s, c in contexts.items()}
    found = toxicity.stem_counts(training).collect()
    assert {r.stem: (r.contexts, r.toxic, r.clean) for r in found} == {s: c for s, c in expected[True].items() if c[0] >= toxicity.LEAST_CONTEXTS} != {}
    assert all((r.contexts_h, r.toxic_h, r.clean_h) == expected[False].get(r.stem, (0, r.toxic_h, r.clean_h)) for r in found)
    docs = spark.createDataFrame([r[:2] for r in data], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in data], "doc_id long, toxic int")
    docs.write.mode("overwrite").parquet(path := stage_path(spark, "texts"))
    tracemalloc.start()
    toxicity.fit(spark.read.parquet(path), labels)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 << 20 < sum(len(t or "") for _, t, _ in data)
