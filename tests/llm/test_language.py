import numpy as np
import pytest

from lociform.llm import language as G

D = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return [spark.read.parquet(f"{D}/{t}.parquet").cache() for t in ("documents", "lang_labels", "lang_names")]


@pytest.fixture(scope="module")
def filters(tables):
    return G.fit_filters(*tables)


def test_no_gram_is_missed_and_few_are_made_up():
    rng = np.random.RandomState(1)
    grams, masks = rng.randint(0, 1 << 40, 20_000), rng.randint(1, 1 << 20, 20_000)
    f = G.Filters.build([str(i) for i in range(20)], grams, masks)
    first, second = f.slots_of(grams.astype(np.uint64))
    assert ((f.slots[first] & f.slots[second] & masks) == masks).all()
    others = rng.randint(1 << 40, 1 << 41, 100_000).astype(np.uint64)
    first, second = f.slots_of(others)
    assert (f.slots[first] & f.slots[second] & 1).astype(bool).mean() < 3 * f.false_rate[0] + 1e-3


def test_counts_equal_plain_counting():
    texts = ["int main;\n\n  return 0;\n", "x" * 2000 + "\nabcdef", ""]
    known = [b"\nint ", b"xxxxx", b"abcde", b"retur"]
    grams = np.array([int.from_bytes(g, "little") for g in known])
    f = G.Filters.build(["a", "b"], grams, np.array([1, 2, 1, 3]))
    f.false_rate = np.zeros(2)
    lines = G.read_lines(texts)
    got = {(int(o), int(n)): tuple(c) for o, n, c in zip(lines.of, lines.line_no, f.counts(lines)) if c.any()}
    assert got == {(0, 1): (1, 0), (0, 3): (1, 1), (1, 1): (0, 1996), (1, 2): (1, 0)}
    whole = [np.concatenate(x) for x in zip(*lines.grams(1 << 20))]
    for step in (1, 7, 300):
        assert all((np.concatenate(x) == w).all() for x, w in zip(zip(*lines.grams(step)), whole))


def test_smoothing_equals_viterbi():
    rng = np.random.RandomState(3)
    of = np.repeat([0, 1, 2], [1, 7, 12])
    scores = -rng.rand(20, 3) * 10
    got = G.smooth(scores, of, 4.0)
    for t in range(3):
        s = scores[of == t]
        best, back = s[0].copy(), []
        for row in s[1:]:
            step = best[:, None] - 4.0 * (1 - np.eye(3))
            back.append(step.argmax(0))
            best = step.max(0) + row
        path = [best.argmax()]
        for b in back[::-1]:
            path.append(b[path[-1]])
        want = path[::-1]
        cost = lambda p: s[np.arange(len(s)), p].sum() - 4.0 * (np.diff(p) != 0).sum()
        assert np.isclose(cost(got[of == t]), cost(np.array(want)))


def test_held_out_labels(spark, tables, filters):
    docs, labels, names = tables
    checked = {r.doc_id: r.lang_code for r in spark.read.parquet("/root/testdata/sf0.1/lang_labels.parquet").collect()}
    others = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = {}
    for r in G.document_languages(others, names, filters).collect():
        got.setdefault(r.doc_id, set()).add(r.lang_code)
    right = [got.get(i) == {c} for i, c in checked.items() if i in got]
    assert len(right) > 300 and np.mean(right) > 0.97


def test_edges(spark, tables, filters):
    names = tables[2]
    german = "Der Bericht liest alle Gewichte und behält die sortierten Dateien.\n"
    python = "def f(x):\n    return sorted(x.get('a', 1) for i, x in enumerate(y))\n    if not isinstance(x, dict):\n        continue\n"
    texts = [None, "", " \n\t", german * 20, german * 12 + "```\n" + python * 4 + "```\n" + german * 3, german * 12 + python, "﻿" + python * 3, ("x = " + "1," * 200_000)]
    docs = spark.createDataFrame([(i, t, "DE " if i == 3 else None, 9) for i, t in enumerate(texts)], "doc_id long, text string, lang string, main_code int")
    got = {}
    for r in G.document_languages(docs, names, filters).collect():
        got.setdefault(r.doc_id, []).append((r.lang_code, r.declared))
        assert 0 <= r.confidence <= 1
    assert got[3] == [("de", "de")] and sorted(x[0] for x in got[4]) == ["de", "python"] and got[5] == [("de", None)] and got[6] == [("python", None)]
    assert not {0, 1, 2} & set(got)
    found = {(r.doc_id, r.lang_code) for r in G.relabelled(docs, names, filters).collect()}
    assert (3, "de") not in found and {(4, "de"), (4, "python"), (5, "de"), (6, "python")} <= found
    parts = sorted(map(tuple, G.segment_languages(docs.where("doc_id = 4"), filters).select("segment_no", "lang_code").collect()))
    assert [p[1] for p in parts] == ["de", "python", "de"]
    assert G.document_languages(docs.limit(0), names, filters).count() == 0


def test_sample_is_bounded(tables):
    n = {r["lang_code"]: r["count"] for r in G.labelled_sample(*tables, per_language=5).groupBy("lang_code").count().collect()}
    assert len(n) == 20 and max(n.values()) <= 5


def test_scattered_lines_of_a_further_language(filters):
    german = "Der Bericht liest alle Gewichte und behält die sortierten Dateien.\n"
    python = "    return sorted(x.get('a', 1) for i, x in enumerate(y))\n    if not isinstance(x, dict):\n"
    whole = lambda own, more, n, k: "".join(own * 6 + more * k for _ in range(n))
    code = "    for key, item in self.items():\n        yield key, item[1]\n"
    texts = [
        whole(german, python, 2, 2), whole(german, python[: python.index("\n") + 1], 10, 1), whole(code, german, 10, 1), whole(code, german, 2, 4),
        german * 30, code * 30, whole(code, german, 7, 1),
        whole(code, "    # " + german, 10, 1), whole(code, "    print('" + german[:-1] + "')\n", 10, 1), whole(code, '    """' + german[:-1] + '"""\n', 10, 1),
        whole('<div class="a"><ul><li><a href="b.html">c</a></li></ul></div>\n', "<p>" + german[:-1] + "</p>\n", 10, 1),
    ]
    held = G.held_languages(texts, filters)
    got = {i: {filters.languages[int(k)] for k in g} for i, g in held.groupby("of")["lang"]}
    assert [got[i] for i in range(len(texts))] == [{"de", "python"}] * 4 + [{"de"}, {"python"}, {"python"}] + [{"python"}] * 3 + [{"html"}]


def test_filters_hold_their_own_language(spark):
    """Documents that hold another language too don't make its n-grams the first one's."""
    english, spanish = "The tool keeps the counts for both strands.\n", "La herramienta guarda las cuentas de las dos hebras.\n"
    texts = [("en", english)] * 45 + [("en", english + spanish)] * 3 + [("es", spanish)] * 40
    docs = spark.createDataFrame([(i, t, c) for i, (c, t) in enumerate(texts)], "doc_id long, text string, lang string")
    labels = docs.selectExpr("doc_id", "lang as lang_code")
    f = G.fit_filters(docs, labels, spark.createDataFrame([("en", "en"), ("es", "es")], "lang_code string, spelling string"))
    counts = f.counts(G.read_lines([english + spanish]))
    assert counts[0, 0] > 30 > 5 > counts[0, 1] and counts[1, 1] > 30 > 5 > counts[1, 0]


def test_filters_come_from_lines_in_the_documents_own_language(spark):
    """Texts that hold code make none of its n-grams the text's language's, however many do."""
    french, code = "Un petit script lit les comptes pour les deux brins.\n", "fit <- lm(token ~ window, data = layer)\n"
    texts = [("fr", french * 9)] * 40 + [("fr", french * 12 + code * 10)] * 12 + [("r", code * 10)] * 45
    docs = spark.createDataFrame([(i, t, c) for i, (c, t) in enumerate(texts)], "doc_id long, text string, lang string")
    names = spark.createDataFrame([("fr", "fr"), ("r", "r")], "lang_code string, spelling string")
    f = G.fit_filters(docs, docs.where("doc_id < 3").selectExpr("doc_id", "lang as lang_code"), names)
    counts = f.counts(G.read_lines([french + code]))
    assert counts[0, 0] > 30 > 5 > counts[0, 1] and counts[1, 1] > 30 > 5 > counts[1, 0]
    found = {(r.doc_id, r.lang_code) for r in G.relabelled(docs, names, f).collect()}
    assert found == {(i, c) for i in range(40, 52) for c in ("fr", "r")}


def test_blocks_of_a_further_language(filters):
    german = "Der Bericht liest alle Gewichte und behält die sortierten Dateien.\n"
    python = ["    for key, item in self.items():\n", "        yield key, item[1]\n", "    if not isinstance(x, dict):\n", "    return sorted(x.get('a', 1) for i, x in enumerate(y))\n"]
    for size in (1, 2, 3, 4, 6, 12):
        own = [python[i % 4] for i in range(12)]
        text = "".join(german * 5 + "".join(own[i : i + size]) for i in range(0, 12, size)) + german * 3
        assert {filters.languages[int(k)] for k in G.held_languages([text], filters)["lang"]} == {"de", "python"}, size


def test_sampling_in_parts_keeps_the_best(spark, tables, monkeypatch):
    want = {tuple(r) for r in G.labelled_sample(*tables, per_language=7).collect()}
    monkeypatch.setattr(G, "SAMPLE_PARTS", 1)
    assert want == {tuple(r) for r in G.labelled_sample(*tables, per_language=7).collect()}
