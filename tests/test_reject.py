import pytest

from lociform.operators.reject import parse_records, rejected_records, valid_records

GOOD = ["chr1", "10", ".", "A", "C", "9.5", ".", "DP=3;FRAC=0.5;QD=2.0", "GT", "0/1"]


def line(**k):
    names = ["chrom", "pos", "id", "ref", "alt", "qual", "filter", "info", "keys", "call"]
    return "\t".join(k.get(n, v) for n, v in zip(names, GOOD))


CASES = {
    line(): None,
    line() + "\r": None,
    line(id='"a\tb"'): None,
    line(id='"a""b"'): None,
    line(id='""'): None,
    line(call='"0/1"'): None,
    line(qual="."): None,
    line(qual="1e3"): None,
    line(info='"DP=3;FRAC=1;QD=1e1;Note=""x"""'): None,
    line(id='a"b'): "quoting",
    line(id='"a'): "quoting",
    line(id='"a"b'): "quoting",
    line(call='0/1"'): "quoting",
    "a\tb": "columns",
    line() + "\t": "columns",
    "x" + "\t" * 30_000: "columns",
    line(pos="0"): "pos",
    line(pos="-4"): "pos",
    line(pos="1e6"): "pos",
    line(pos=""): "pos",
    line(pos=" 4"): "pos",
    line(pos="000"): "pos",
    line(qual="nan"): "qual",
    line(qual=""): "qual",
    line(qual="1.5f"): "qual",
    line(qual="-1"): "qual",
    line(qual="5."): "qual",
    line(info="DP=3;FRAC=1.5;QD=1"): "info",
    line(info="DP=3.0;FRAC=0.5;QD=1"): "info",
    line(info="DP4=3;FRAC=0.5;QD=1"): "info",
    line(info="DP=3;FRAC=0.5;QD="): "info",
    line(pos="0", qual="x"): "pos",
}


def table(spark, lines):
    return spark.createDataFrame(list(enumerate(lines)), "line_id long, line string").selectExpr("*", "'clash' as reason", "'clash' as pos")


def test_reasons(spark):
    lines = list(CASES)
    got = {r.ident: r.reason for r in parse_records(table(spark, lines), "line_id", "line").collect()}
    assert got == {i: CASES[t] for i, t in enumerate(lines)}


@pytest.mark.parametrize("text", [None, "", "  ", "\t \t", "#CHROM\tx", "##a", "\r"])
def test_no_records(spark, text):
    assert parse_records(table(spark, [text]), "line_id", "line").count() == 0


def test_typed_fields_and_raw_text(spark):
    lines = [line(id='"a\tb"', qual="1e3"), line(pos="x")]
    good, bad = valid_records(table(spark, lines), "line_id", "line").collect(), rejected_records(table(spark, lines), "line_id", "line").collect()
    assert (good[0].pos, good[0].qual, good[0].id) == (10, 1000.0, "a\tb")
    assert (bad[0].reason, bad[0].corrupt_text) == ("pos", lines[1])


def test_long_quotes_and_repeats(spark):
    text = line(id='"' + '""' * 100_000 + '"')
    got = parse_records(table(spark, [text, text, line(pos="9" * 25)]), "line_id", "line").orderBy("ident").collect()
    assert [r.reason for r in got] == [None] * 3 and got[2].pos is None


def test_empty_table(spark):
    assert parse_records(spark.createDataFrame([], "line_id long, line string"), "line_id", "line").count() == 0


def test_many_tabs_inside_quotes(spark):
    lines = [line(id='"' + "a\t" * 3_000 + '"'), line(id='"' + "a\t" * 3_000 + '"', pos="0"), "x" + "\t" * 3_000]
    got = parse_records(table(spark, lines), "line_id", "line").orderBy("ident").collect()
    assert [r.reason for r in got] == [None, "pos", "columns"] and got[0].id == "a\t" * 3_000 and got[0].pos == 10
