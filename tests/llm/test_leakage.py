import random

import pytest
from conftest import rows

from lociform.llm import leakage
from lociform.llm.leakage import extended, fingerprint_rows, fingerprints, folded, leaked_passages

WORDS = [f"w{i}" for i in range(40)]
rng = random.Random(5)
ITEM = [rng.choice(WORDS) + str(i) for i in range(60)]


@pytest.mark.parametrize(
    "text, want",
    [("Hello, World_2", "hello world 2"), ("a\\nb\\t\\\"c", "a b c"), ("x&lt;y&#x27;&amp;lt;z", "x y z"), ("lan⁠tern ab­c", "lantern abc"), ("w\\u200bord p&shy;q", "word pq"), ("é1", "1"), ("# a\n// b\n+ c\n- d", "a b c d"), ("", "")],
)
def test_words(text, want):
    assert folded(text).decode().split() == want.split()


def test_every_long_span_has_a_fingerprint():
    for seed in range(60):
        r = random.Random(seed)
        at, n = r.randrange(0, 31), 30
        doc = [f"n{r.random()}".replace(".", "") for _ in range(r.randrange(0, 40))] + ITEM[at : at + n] + [f"m{r.random()}".replace(".", "") for _ in range(r.randrange(0, 40))]
        own, place, value = fingerprints([" ".join(doc), " ".join(ITEM)])
        assert set(value[own == 0]) & set(value[own == 1])
        assert place.max() < 200 and place.min() >= 0


def test_long_texts_in_stretches_have_the_same_fingerprints():
    r = random.Random(7)
    texts = [" ".join(str(r.randrange(500)) for _ in range(n)) for n in (0, 10, 400, 3000)] + ["a " * 500, "x" * 5000 + " y" * 100]
    whole = {tuple(x) for x in zip(*map(list, fingerprints(texts)))}
    for size in (200, 1000, 7000):
        parts = list(zip(*map(list, fingerprints(texts, size=size))))
        assert len(parts) == len(set(parts)) and set(parts) == whole


def case(spark, texts, items=None, **k):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as item", "2 as place")
    tests = spark.createDataFrame(items or [("T", " ".join(ITEM))], "item_id string, item_text string")
    return leaked_passages(docs, "doc_id", "text", tests, "item_id", "item_text", **k)


def test_found_and_not_found(spark):
    changed = list(ITEM)
    changed[::25] = ["zz"] * len(changed[::25])
    texts = [
        "// " + "\n// ".join(ITEM), " ".join(ITEM[:30]).upper(), " ".join(ITEM[:29]), " ".join(ITEM[31:] + ["tail"]), " ".join(changed), None, "", " ".join(ITEM[::-1]),
        "x = \"" + "\\n".join(ITEM) + "\"", "​".join(" ".join(ITEM)), "filler " * 200_000 + " ".join(ITEM[5:40]) + " more" * 1000, " • ".join(ITEM), " ".join(ITEM[:29] + ["x"] + ITEM[29:]),
    ]
    got = {r.doc: (r.n_words, r.item_place) for r in case(spark, texts).collect()}
    assert got == {0: (60, 0), 1: (30, 0), 8: (60, 0), 9: (60, 0), 10: (35, 5), 11: (60, 0), 12: (31, 29)}


def test_repeats_many_items_and_shuffled_joins(spark, monkeypatch):
    monkeypatch.setattr(leakage, "BROADCAST_ROWS", 0)
    texts = [" ".join(ITEM)] * 3 + [" ".join(ITEM * 3)]
    items = [("A", " ".join(ITEM)), ("B", " ".join(ITEM[10:50])), ("A", " ".join(ITEM)), ("C", None), ("D", "too short")]
    got = rows(case(spark, texts, items).select("doc", "item", "n_words"))
    assert got == [(i, x, n) for i in range(4) for x, n in (("A", 60), ("B", 40))]
    assert case(spark, [" ".join(ITEM)], [("Z", "")]).count() == 0


def test_same_as_brute_force_on_the_corpus(spark):
    d = "/root/testdata/sf0.001"
    docs, items = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/eval_items.parquet")
    grams = {}
    for r in items.collect():
        w = folded(r.item_text).split()
        for p in range(len(w) - 29):
            grams.setdefault(b" ".join(w[p : p + 30]), set()).add(r.item_id)
    want = set()
    for r in docs.where("text is not null").collect():
        w = folded(r.text).split()
        for p in range(len(w) - 29):
            want |= {(r.doc_id, i) for i in grams.get(b" ".join(w[p : p + 30]), ())}
    got = {(r.doc, r.item) for r in leaked_passages(docs, "doc_id", "text", items, "item_id", "item_text").collect()}
    assert got == want


def test_text_that_repeats_itself(spark):
    """A million equal words against an item of equal words: one fingerprint each, and the whole item found."""
    docs, items = ["x " * 1_000_000, "y " + "a b c " * 3000, "x " * 29], [("X", "x " * 500), ("P", "q " + "a b c " * 40)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    assert fingerprint_rows(df, "doc_id", "text").count() <= 10
    assert rows(case(spark, docs, items)) == [(0, "X", 500, 0, 0), (1, "P", 120, 1, 1)]


@pytest.mark.parametrize("seed", range(40))
def test_extension_equals_brute_force(seed):
    r = random.Random(seed)
    words = ["a", "b", "c"] if seed % 2 else [f"w{i}" for i in range(30)]
    item = [r.choice(words) for _ in range(r.randrange(5, 60))] * (1 + seed % 3)
    doc = [r.choice([*words, "other"]) for _ in range(50)]
    for _ in range(3):
        a = r.randrange(len(item))
        doc += item[a : a + r.randrange(60)] + [r.choice(["other", "a"])]
    want = (0, 0, 0)
    for i in range(len(doc)):
        for j in range(len(item)):
            n = 0
            while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n]:
                n += 1
            if n > want[0]:
                want = (n, i, j)
    got = extended(" ".join(doc).encode(), [" ".join(item).encode(), b"", b"z"], 4, 10)
    assert got == [want if want[0] >= 10 else None, None, None]


def test_many_items_in_one_document(spark, monkeypatch):
    monkeypatch.setattr(leakage, "ITEMS", 2)
    items = [(f"T{i}", " ".join(ITEM[i : i + 40])) for i in range(9)]
    assert rows(case(spark, [" ".join(ITEM)], items).select("doc", "item", "n_words")) == [(0, f"T{i}", 40) for i in range(9)]
