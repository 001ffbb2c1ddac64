import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from lociform.llm.splitting import plan_cuts, split_oversized


def pieces(seq, ends, overlap):
    starts = [0] + [max(0, e - overlap) for e in ends[:-1]]
    return [seq[a:b] for a, b in zip(starts, ends)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 260), st.integers(8, 30)), min_size=1, max_size=12), st.integers(0, 200))
def test_cuts(spans, tail):
    seq = "".join("A" * a + "N" * n for a, n in spans) + "C" * tail
    ends, forced = plan_cuts(seq, limit=120, overlap=20, grid=10)
    out = pieces(seq, ends, 20)
    assert all(len(p) <= 120 for p in out) and ends[-1] == len(seq)
    assert out[0] + "".join(p[20:] if len(out[0]) >= 20 else "" for p in out[1:]) == seq or len(out) == 1 or ends[0] < 20
    assert forced == (max(map(len, re.split("N{10,}", seq))) > 100)
    gaps = [m.span() for m in re.finditer("N{10,}", seq)]
    if not forced:
        assert all(any(a <= e <= b for a, b in gaps) for e in ends[:-1])


def test_rows(spark):
    rng = random.Random(2)
    long = "".join(rng.choice("ACGT") for _ in range(5000))
    gapped = "\n".join([long[:1500] + "N" * 12, "n" * 5 + "." * 5 + long[:1500], "\r"])
    data = [(1, long), (2, gapped), (3, long[:2000]), (4, None), (5, ""), (6, long[:1999] + " \n "), (1, long), (7, "N" * 300_000)]
    df = spark.createDataFrame(data, "read_id long, seq string").selectExpr("*", "1 as piece_no")
    got = split_oversized(df, "read_id", "seq").collect()
    kinds = {r.ident: r.cut_kind for r in got}
    assert kinds == {1: "forced", 2: "gap", 7: "gap"}
    one = sorted({(r.piece_no, r.piece_start, r.piece) for r in got if r.ident == 1})
    assert "".join(p if k == 1 else p[200:] for k, _, p in one) == long and all(len(p) <= 2000 for _, _, p in one)
    assert [long.index(p) for _, _, p in one] == [s for _, s, _ in one]
    assert sum(r.ident == 1 for r in got) == 2 * len(one)
    assert split_oversized(df.limit(0), "read_id", "seq").count() == 0


def test_even_pieces(spark):
    ends, _ = plan_cuts("A" * 4000, 2000, 200)
    sizes = [b - a for a, b in zip([0, *ends], ends)]
    assert len(sizes) == 3 and max(sizes) - min(sizes) <= 50
