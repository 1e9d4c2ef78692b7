import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import spelling

SCHEMA = "doc_id long, text string, word string, n int"


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def brute(docs, every=199, least_length=6, least_count=5, ratio=5):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    words = {w: c for w, c in n.items() if len(w) >= least_length and c >= least_count}
    rows, forms = [], {}
    for w in words:
        others = [x for x in words if near(w, x)]
        best = min(others, key=lambda x: (-words[x], x), default=None)
        forms[w] = best if best and words[best] >= ratio * words[w] else None
        rows.append([w, forms[w], w, words[w], len(others), words[forms[w]] if forms[w] else None])
    for r in rows:
        while forms[r[2]]:
            r[2] = forms[r[2]]
    return sorted(map(tuple, rows))


def result(spark, docs, **how):
    rows = spark.createDataFrame([(i, t, "x", 0) for i, t in docs], SCHEMA).repartition(3)
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(rows, **how).collect())


def corpus():
    rng = random.Random(3)
    stems = ["abandon", "abandons", "abanden", "großartig", "großartige", "École", "École", "letter", "litter", "latter", "ladder", "łódź", "naïvement", "consider", "considér", "con×ider"]
    docs = [(i, " ".join(rng.choice(stems) for _ in range(60))) for i in range(30)]
    docs += [(100 + i, f"{w} " * (2 * 5 ** k)) for i, (w, k) in enumerate([("aaaaaaaa", 1), ("aaaaaaab", 2), ("aaaaaabb", 3), ("aaaaabbb", 4)])]  # forms of forms
    docs += [(i, "WORDSMITH wordsmith's ÀÉÎÕÜ-àéîõü" * 9) for i in (200, 200, None, None)] + [(300, None), (301, ""), (302, "12 ! -")]
    docs += [(400, "ties tiesaa tiesab tiesac " * 6 + "tiesad " * 30 + "tiesae " * 30)]
    return docs


@pytest.mark.parametrize("group", [4096, 2])
def test_equals_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(spelling, "GROUP", group)
    docs = corpus()
    assert result(spark, docs) == brute(docs)
    deep = {r[0]: r[2] for r in result(spark, docs, every=1 << 33)}
    assert deep["aaaaaaaa"] == "aaaaabbb" and deep["tiesaa"] == "tiesad"


def test_other_parameters_and_short_words(spark, monkeypatch):
    monkeypatch.setattr(spelling, "GROUP", 3)
    rng = random.Random(4)
    docs = [(i, " ".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(200))) for i in range(12)]
    how = {"every": 5, "least_length": 1, "least_count": 2, "ratio": 2}
    assert result(spark, docs, **how) == brute(docs, **how)


def test_one_partition_of_many_words_is_split(spark, monkeypatch):
    # all words share both ends; no task sees over 16 of them but for clashing letters
    monkeypatch.setattr(spelling, "GROUP", 16)
    words = [f"prefix{a}{b}{c}suffix" for a in "abcde" for b in "abcde" for c in "abcde"]
    sizes = spelling._partitioned(spark.createDataFrame([(w, 5) for w in words], "word string, n long")).groupBy("key").count().collect()
    assert max(r["count"] for r in sizes) <= 16
    docs = [(1, " ".join(words * 5))]
    assert result(spark, docs, every=1 << 33) == brute(docs, every=1 << 33)


def test_very_long_text_and_empty_table(spark, monkeypatch):
    monkeypatch.setattr(spelling, "SLICE", 1000)
    monkeypatch.setattr(spelling, "HELD", 3)
    docs = [(7, "longword shortword Longwörd " * 5000 + "x" * 5000)]
    assert list(spelling._slices("ab cd")) == ["ab cd"]
    counted = Counter()
    for w, n in spelling._runs("7", docs[0][1], 1 << 33, 6):
        counted[w] += n
    assert counted == {"longword": 5000, "shortword": 5000, "longwörd": 5000, "x" * 5000: 1}
    assert result(spark, docs) == brute(docs)
    assert result(spark, []) == [] and result(spark, [(1, None)]) == []


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("abé", max_size=5), max_size=25))
def test_trie_pairs(words):
    words = sorted(words)
    found = list(spelling.trie_pairs(words))
    assert len(found) == len(set(found))
    assert set(found) == {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if near(a, b)}
