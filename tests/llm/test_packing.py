import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lociform.llm.packing import VOCABULARY, balance, container_report, pack, pack_documents
from lociform.llm.tokens import PATTERN, TokenCounter


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=200))
def test_no_container_overflows(sizes):
    place = pack(np.array(sizes), 100)
    assert np.bincount(place, weights=sizes).max() <= 100
    assert place.max() + 1 <= 2 * -(-sum(sizes) // 100) + 1


def test_lowest_cost_first():
    place, cost = balance(np.array([50, 40, 30, 20]), 100, tolerance=0.0)
    assert list(place) == [0, 1, 1, 0] and len(cost) == 2


def test_fill():
    sizes = np.random.RandomState(1).lognormal(6, 0.8, 4096).clip(1, 2048).astype(int)
    place = pack(sizes, 2048)
    assert sizes.sum() / ((place.max() + 1) * 2048) > 0.99


def test_counts_equal_the_tokenizer():
    import base64

    import tiktoken

    with open(VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    whole = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    counter = TokenCounter(VOCABULARY)
    texts = ["", " ", "a  b\n\n c\t", "it's 12345 x_y->z", "é ü ½ 漢字   x", "﻿int\r\n", "𝔘n!!?" * 50, "a" * 5000, "'S 'll"]
    assert [counter.count(t) for t in texts] == [len(whole.encode_ordinary(t)) for t in texts]
    assert counter.ends(texts[3])[-1] == counter.count(texts[3])


def test_rows(spark):
    words = "lorem ipsum dolor "
    data = [(1, words * 400), (2, words * 10), (3, ""), (4, None), (5, words * 100), (2, words * 10), (6, "x")]
    df = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "1 as container_id").coalesce(1)
    packed = pack_documents(df, "doc_id", "text", capacity=256, block=4)
    got = packed.collect()
    counter = TokenCounter(VOCABULARY)
    for doc, text in data[:3] + data[4:]:
        own = sorted((r.token_start, r.n_tokens) for r in got if r.ident == doc)
        n = counter.count(text)
        assert sum(k for _, k in own) == n * sum(d == doc for d, _ in data)
        assert n > 256 or all(k == n for _, k in own)
    used = {}
    for r in got:
        if r.container_id is not None:
            used[r.container_id] = used.get(r.container_id, 0) + r.n_tokens
    assert max(used.values()) <= 256 and [r.container_id for r in got if r.ident == 3] == [None]
    report = container_report(packed, 256).first()
    assert report.n_containers == len(used) and report.n_tokens == sum(used.values()) and 0 < report.share_filled <= 1
    assert pack_documents(df.limit(0), "doc_id", "text").count() == 0


def test_missing_vocabulary():
    with pytest.raises(FileNotFoundError):
        TokenCounter("/no/such/file")


def test_tolerance_fills_the_rest_and_keeps_costs_even():
    sizes = np.sort(np.random.RandomState(2).lognormal(6.3, 0.6, 4096).clip(80, 2048).astype(int))[::-1]
    least = -(-sizes.sum() // 2048)
    strict, even = (balance(sizes, 2048, tolerance=t)[1] for t in (0.0, 1 / 4))
    assert least <= len(even) <= 1.01 * least < len(strict)
    assert even.std() / even.mean() < strict.std() / strict.mean() < 0.06
    assert least <= pack(sizes, 2048).max() + 1 <= len(even)
