import re

from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lociform.operators.multivalue import SYMBOLIC, info_entry, sample_field, segmenter, split_fields, whole_values


def split(text, known=SYMBOLIC):
    return segmenter(tuple(known))(text)


def test_delimiters_quotes_and_brackets():
    assert split('G ; T ; <DEL:ME|ALU> ; "A" ; CCCG,,') == ["G", "T", "<DEL:ME|ALU>", "A", "CCCG"]
    assert split('"C|T/G"') == ["C", "T", "G"]
    assert split(" 1 , . ;; 3,") == ["1", ".", "3"]
    assert split("<X:new,one>,A") == ["<X:new,one>", "A"]
    assert split("") == [] and split(" ,;") == []


def test_known_values_hold_delimiters():
    assert split("salt, pepper, salt and vinegar, oil", ["salt and vinegar"]) == ["salt", "pepper", "salt and vinegar", "oil"]
    assert split("a b c d", ["a b", "b c d"]) == ["a", "b c d"]
    assert split("a b c", ["a b", "b c", "a b c"]) == ["a b c"]
    assert split("xa by", ["a b"]) == ["xa", "by"]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="AC,;|/ \"'.<>x", max_size=30))
def test_equals_plain_split_without_known_values(text):
    if "<" not in text and ">" not in text:
        assert split(text, []) == re.findall(r"[^,;|/\s\"']+", text)


def test_rows(spark):
    df = spark.createDataFrame([(1, "a,b"), (2, "a"), (3, None), (4, ""), (5, "x" * 50_000 + ",y"), (1, "a,b")], "id long, t string").withColumn("item", F.lit("clash"))
    got = rows(split_fields(df, "id", {"T": F.col("t")}).where("ident <> 5"))
    assert got == [(1, "T", 1, "a")] * 2 + [(1, "T", 2, "b")] * 2
    assert split_fields(df, "id", {"T": F.col("t")}).where("ident = 5").count() == 2
    assert split_fields(df.limit(0), "id", {"T": F.col("t")}).count() == 0


def test_entries_and_sample_fields(spark):
    info = ["DP=3;DP4=9 / 0 | 1;DP8=1", "DP4=1,2;INDEL;DP=3", "AC=1 | DP4=1|2|3|4 | QD=2", "XDP4=1,2", "INDEL;DP4=5, 6", None]
    df = spark.createDataFrame([(i,) for i in info], "info string")
    assert [r[0] for r in df.select(info_entry(F.col("info"), "DP4")).collect()] == ["9 / 0 | 1", "1,2", "1|2|3|4", None, "5, 6", None]
    df = spark.createDataFrame([("GT:AD", "0/1:3,4"), ("GT:PL", "0/1:9"), ("GT:AD", "0/1"), (None, "a")], "k string, s string")
    assert [r[0] for r in df.select(sample_field(F.col("k"), F.col("s"), "AD")).collect()] == ["3,4", None, None, None]


def test_dictionary_from_the_data_decides_the_rows(spark):
    """Without an entry of its dictionary, p6's operator cuts that value at its delimiters."""
    snps = spark.read.parquet("/root/testdata/sf0.01/dbsnp.parquet")
    known = whole_values(snps, F.col("alt"))
    split_with = lambda words: rows(split_fields(snps, "snp_id", {"ALT": F.col("alt")}, known=words, brackets=False))
    whole = split_with(known)
    assert known and all(v[0] == "<" and v[-1] == ">" for v in known)
    for gone in known:
        less = split_with(tuple(v for v in known if v != gone))
        assert less != whole and gone not in {r[3] for r in less} and gone in {r[3] for r in whole}


def test_dictionary_bounds_and_edges(spark):
    df = spark.createDataFrame([("<A|B>,<A|B>,<C>", "<D E>"), (None, None), ("", "<F,G>,<H"), ("x/y", "<'>")], "a string, b string")
    assert whole_values(df, F.col("a"), F.col("b")) == ("<'>", "<A|B>", "<D E>", "<F,G>")
    assert whole_values(df, F.col("a"), F.col("b"), most=3) is None
    assert whole_values(df.limit(0), F.col("a")) == ()
    assert segmenter(("<A|B>",), False)('"<A|B>" | <C|D>,<A|B') == ["<A|B>", "<C", "D>", "<A", "B"]
