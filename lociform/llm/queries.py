"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociform.llm import language
from lociform.llm.cutoff import cutoff_report, keep_fraction
from lociform.llm.leakage import leaked_passages
from lociform.llm.packing import container_report, pack_documents
from lociform.llm.sketch import merge_sketches, percentile_sketches, percentiles, rank_error
from lociform.llm.splitting import split_oversized
from lociform.operators.sequences import with_sequence
from lociform.operators.wide import number
from lociform.plans.tables import spread, table

QUERIES = {}
ORACLES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


# problem 1


def _scored_calls(spark: SparkSession, d: str) -> DataFrame:
    calls = table(spark, d, "vcf").select("rec_id", "chrom", "qual")
    scored = calls.where("qual is not null and not isnan(qual) and qual >= 0 and qual < double('infinity')")
    return with_sequence(scored, table(spark, d, "seq_dict"))


@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return keep_fraction(_scored_calls(spark, d), "seq_name", "qual", "rec_id", "0.3").select(F.col("ident").alias("rec_id"))


@query
def p1_cutoffs(spark: SparkSession, d: str) -> DataFrame:
    return cutoff_report(_scored_calls(spark, d), "seq_name", "qual", "rec_id", "0.3")


_P1 = """
with s as (
  select v.rec_id, d.chrom as source, v.qual from vcf v join seq_dict d
  on lower(trim(v.chrom)) in (lower(trim(d.chrom)), lower(trim(d.short_name)))
  where v.qual is not null and not isnan(v.qual) and v.qual >= 0 and v.qual < 'infinity'::double),
r as (select *, row_number() over (partition by source order by qual desc, rec_id) as p, count(*) over (partition by source) as n from s),
c as (select source, max(n) as n_scored, max((n * 3 + 9) // 10) as n_target, max(case when p = (n * 3 + 9) // 10 then qual end) as cutoff from r group by source)
"""
ORACLES["p1_found"] = _P1 + "select s.rec_id from s join c on s.source = c.source where s.qual >= c.cutoff"
ORACLES["p1_cutoffs"] = _P1 + (
    "select c.source, c.cutoff, c.n_scored, c.n_target, count(*) as n_kept from s join c on s.source = c.source where s.qual >= c.cutoff"
    " group by c.source, c.cutoff, c.n_scored, c.n_target"
)

# problem 3


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_oversized(spread(table(spark, d, "aligned_reads")), "read_id", "seq", limit=2000, overlap=200)


@query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d).where("piece_no = 1").select(F.col("ident").alias("read_id"), "cut_kind")


@query
def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d)


@query
def p3_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """Whether the pieces of each read keep to the limit and the overlap, and what they make put together again."""
    piece = F.struct("piece_no", "piece_start", "piece")
    reads = _pieces(spark, d).groupBy(F.col("ident").alias("read_id")).agg(F.array_sort(F.collect_list(piece)).alias("p"))
    shared = F.forall(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.right(F.get("p", i - 1)["piece"], F.lit(200)) == F.left(F.get("p", i)["piece"], F.lit(200)))
    placed = F.forall(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.get("p", i)["piece_start"] == F.get("p", i - 1)["piece_start"] + F.length(F.get("p", i - 1)["piece"]) - 200)
    whole = F.array_join(F.transform("p", lambda x, i: F.when(i == 0, x["piece"]).otherwise(F.substring(x["piece"], F.lit(201), F.length(x["piece"])))), "")
    return reads.select("read_id", F.length(whole).cast("long").alias("n_bases"), F.md5(whole).alias("digest"), F.forall("p", lambda x: F.length(x["piece"]) <= 2000).alias("fits"), (shared & placed).alias("overlaps"))


ORACLES["p3_rebuilt"] = r"""
select read_id, length(s) as n_bases, md5(s) as digest, true as fits, true as overlaps
from (select read_id, regexp_replace(seq, '\s+', '', 'g') as s from aligned_reads) where length(s) > 2000
"""
ORACLES["p3_found"] = r"""
select read_id, case when list_max(list_transform(regexp_split_to_array(s, '[Nn.]{10,}'), lambda x: length(x))) <= 1800 then 'gap' else 'forced' end as cut_kind
from (select read_id, regexp_replace(seq, '\s+', '', 'g') as s from aligned_reads) where length(s) > 2000
"""

# problem 4


def _run_values() -> dict:
    entry = lambda k: number(F.regexp_extract("info", rf"(?:^|[;|,\s]){k}\s*=\s*([^;|,\s]*)", 1))
    return {"DP": entry("DP"), "QD": entry("QD"), "QUAL": F.when(F.col("qual") >= 0, F.col("qual"))}


def _by_run(spark: SparkSession, d: str) -> DataFrame:
    return percentile_sketches(table(spark, d, "vcf").select("run_id", "info", "qual"), ["run_id"], _run_values())


@query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    p = percentiles(_by_run(spark, d), ["run_id"], [0.1, 0.5, 0.9])
    out = (
        "(field_tag = 'DP' and rank = 0.5 and (value < 20 or value > 60)) or (field_tag = 'QD' and rank = 0.1 and value < 18)"
        " or (field_tag = 'QUAL' and rank = 0.9 and value < 400)"
    )
    return p.where(out).select("run_id", "field_tag")


@query
def p4_run_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return percentiles(_by_run(spark, d), ["run_id"], [0.05, 0.25, 0.5, 0.75, 0.95])


@query
def p4_sequence_percentiles(spark: SparkSession, d: str) -> DataFrame:
    calls = with_sequence(table(spark, d, "vcf").select("chrom", "info", "qual"), table(spark, d, "seq_dict"))
    return percentiles(percentile_sketches(calls, ["seq_name"], _run_values()), ["seq_name"], [0.05, 0.25, 0.5, 0.75, 0.95])


@query
def p4_all_from_days(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles over everything, answered from the sketches of the single days."""
    calls = table(spark, d, "vcf").select(F.to_date("called_at").alias("day"), "info", "qual")
    days = percentile_sketches(calls, ["day"], _run_values())
    return percentiles(merge_sketches(days, []), [], [0.05, 0.25, 0.5, 0.75, 0.95])


@query
def p4_all_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Whether each answer of ``p4_all_from_days`` has its rank, within the sketch's bound, among all values."""
    answers = p4_all_from_days(spark, d)
    values = table(spark, d, "vcf").select(F.inline(F.array(*[F.struct(F.lit(f).alias("field_tag"), c.cast("double").alias("v")) for f, c in _run_values().items()])))
    known = values.where("v is not null and not isnan(v) and abs(v) <> double('infinity')").groupBy("field_tag", "v").agg(F.count(F.lit(1)).alias("k"))
    at = known.join(F.broadcast(answers), "field_tag").groupBy("field_tag", "rank", "n").agg(
        F.sum(F.when(F.col("v") < F.col("value"), F.col("k")).otherwise(0)).alias("below"), F.sum(F.when(F.col("v") <= F.col("value"), F.col("k")).otherwise(0)).alias("up_to")
    )
    bound = 2 * rank_error() * F.col("n")
    return at.select("field_tag", "n", "rank", ((F.col("below") <= F.col("rank") * F.col("n") + bound) & (F.col("up_to") >= F.col("rank") * F.col("n") - bound)).alias("within"))


_P4 = r"""
with e as (
  select run_id, regexp_extract(info, '(?:^|[;|,\s])DP\s*=\s*([^;|,\s]*)', 1) as dp, regexp_extract(info, '(?:^|[;|,\s])QD\s*=\s*([^;|,\s]*)', 1) as qd, qual
  from vcf),
v as (
  select run_id, 'DP' as field_tag, try_cast(dp as double) as v from e where regexp_full_match(dp, '[0-9.]+')
  union all select run_id, 'QD', try_cast(qd as double) from e where regexp_full_match(qd, '[0-9.]+')
  union all select run_id, 'QUAL', qual from e where qual >= 0 and not isnan(qual) and qual < 'infinity'::double)
"""
ORACLES["p4_found"] = _P4 + """
select run_id, field_tag from v group by run_id, field_tag
having (field_tag = 'DP' and (quantile_disc(v, 0.5) < 20 or quantile_disc(v, 0.5) > 60)) or (field_tag = 'QD' and quantile_disc(v, 0.1) < 18)
  or (field_tag = 'QUAL' and quantile_disc(v, 0.9) < 400)
"""
_RANKS = "[0.05, 0.25, 0.5, 0.75, 0.95]"
_P4_LIST = """
, q as (select {g}, field_tag, count(v) as n, quantile_disc(v, {r}) as vs from v group by {g}, field_tag)
select {g}, field_tag, n, cast(unnest({r}) as double) as rank, unnest(vs) as value from q
"""
ORACLES["p4_run_percentiles"] = _P4 + _P4_LIST.format(g="run_id", r=_RANKS)
_NAMED = "(select v.info, v.qual, d.chrom as seq_name from vcf v join seq_dict d on lower(trim(v.chrom)) in (lower(trim(d.chrom)), lower(trim(d.short_name))))"
ORACLES["p4_sequence_percentiles"] = _P4.replace("run_id", "seq_name").replace("from vcf", "from " + _NAMED) + _P4_LIST.format(g="seq_name", r=_RANKS)

ORACLES["p4_all_ranks"] = _P4 + f"select field_tag, count(v) as n, cast(unnest({_RANKS}) as double) as rank, true as within from v group by field_tag"

# problem 7


@query
def p7_packing(spark: SparkSession, d: str) -> DataFrame:
    return pack_documents(table(spark, d, "documents"), "doc_id", "text", capacity=2048).withColumnRenamed("ident", "doc_id")


@query
def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return container_report(pack_documents(table(spark, d, "documents"), "doc_id", "text", capacity=2048))


@query
def p7_whole(spark: SparkSession, d: str) -> DataFrame:
    """Whether each text's pieces follow each other and only a text longer than a container is cut, into as few as it needs."""
    own = p7_packing(spark, d).groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.max(F.col("token_start") + F.col("n_tokens")).alias("last"), F.count(F.lit(1)).alias("k"), F.countDistinct("piece_no").alias("u"))
    return own.select("doc_id", ((F.col("n") == F.col("last")) & (F.col("k") == F.greatest(F.ceil(F.col("n") / 2048), F.lit(1))) & (F.col("k") == F.col("u"))).alias("is_whole"))


@query
def p7_fit(spark: SparkSession, d: str) -> DataFrame:
    """Texts packed, and containers that hold too much."""
    each = p7_packing(spark, d).groupBy("container_id").agg(F.sum("n_tokens").alias("n"), F.count_if(F.col("piece_no") == 1).alias("k"))
    return each.agg(F.sum("k").alias("n_texts"), F.count_if(F.col("n") > 2048).alias("n_over"))


ORACLES["p7_whole"] = "select doc_id, true as is_whole from documents where text is not null"
ORACLES["p7_fit"] = "select count(*) as n_texts, cast(0 as bigint) as n_over from documents where text is not null"

# problem 8


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaked_passages(spread(table(spark, d, "documents")), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "item_text")


@query
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"))


@query
def p8_items(spark: SparkSession, d: str) -> DataFrame:
    per = _leaks(spark, d).groupBy(F.col("item").alias("item_id"))
    return per.agg(F.count(F.lit(1)).alias("n_docs"), F.max("n_words").alias("longest"), F.min("doc").alias("first_doc"))

# fixed values: characters that aren't seen, as themselves, as escapes and as entities
_UNSEEN = r"\x{00ad}\x{034f}\x{061c}\x{115f}\x{1160}\x{17b4}\x{17b5}\x{180b}-\x{180e}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{206f}\x{fe00}-\x{fe0f}\x{feff}\x{fff9}-\x{fffb}"
_HEX = "(?:0*ad|0*34f|0*61c|0*115f|0*1160|0*17b[45]|0*180[b-e]|0*200[b-f]|0*202[a-e]|0*206[0-9a-f]|0*fe0[0-9a-f]|0*feff|0*fff[9ab])"
_NAMED = "shy|zwnj|zwj|lrm|rlm|ZeroWidthSpace|NoBreak|ApplyFunction|InvisibleTimes|InvisibleComma|it|ic|af"
_CODES = "173|847|1564|4447|4448|606[89]|615[5-8]|820[3-7]|823[4-8]|828[89]|829[0-9]|830[0-3]|650(?:2[4-9]|3[0-9])|65279|6552[9]|6553[01]"
_P8 = rf"""
with t as (
  select 'doc' as side, row_number() over () as n, cast(doc_id as varchar) as id, text as x from documents where text is not null
  union all select 'item', row_number() over (), item_id, item_text from eval_items),
a as (select side, n, id, regexp_replace(x, '[{_UNSEEN}]+', '', 'g') as x from t),
b as (select side, n, id, regexp_replace(x, '\\+(?:u\{{?(?i:{_HEX})\}}?|x(?:ad|AD|aD|Ad))|&(?:amp;)*(?:#0*(?:{_CODES})|#[xX](?i:{_HEX})|{_NAMED});', '', 'g') as x from a),
c as (select side, n, id, regexp_replace(x, '\\+(?:u\{{?[0-9a-fA-F]{{4,6}}\}}?|x[0-9a-fA-F]{{2}}|[abefnrtv0])|&(?:amp;)*#?[A-Za-z0-9]{{1,31}};', ' ', 'g') as x from b),
w as (select side, n, id, list_transform(regexp_extract_all(x, '[A-Za-z0-9]+'), lambda v: lower(v)) as w from c),
u as (select side, n, id, len(w) as size, unnest(w) as v, generate_subscripts(w, 1) as i from w where len(w) >= 30),
h2 as (select *, hash(v, lead(v, 1) over o) as x2 from u window o as (partition by side, n order by i)),
h4 as (select *, hash(x2, lead(x2, 2) over o) as x4 from h2 window o as (partition by side, n order by i)),
h8 as (select *, hash(x4, lead(x4, 4) over o) as x8 from h4 window o as (partition by side, n order by i)),
h30 as (select *, hash(x8, lead(x8, 8) over o, lead(x8, 16) over o, lead(x4, 24) over o, lead(x2, 28) over o) as g from h8 window o as (partition by side, n order by i)),
g as (select side, n, id, i, g from h30 where i <= size - 29),
m as (select d.id as doc, e.id as item, d.n as dn, e.n as en, d.i, e.i as j from g d join g e on d.g = e.g where d.side = 'doc' and e.side = 'item'),
r as (select *, i - row_number() over (partition by dn, en, i - j order by i) as run from m),
s as (select doc, item, count(*) + 29 as n_words from r group by doc, item, dn, en, i - j, run)
"""
ORACLES["p8_found"] = _P8 + "select distinct cast(doc as bigint) as doc_id, item as item_id from m"
ORACLES["p8_items"] = _P8 + "select item as item_id, count(distinct doc) as n_docs, max(n_words) as longest, min(cast(doc as bigint)) as first_doc from s group by item"

# problem 9


def _language_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, language.Filters]:
    docs, names = spread(table(spark, d, "documents").select("doc_id", "text", "lang")), table(spark, d, "lang_names")
    return docs, names, language.fit_filters(docs, table(spark, d, "lang_labels"), names)


@query
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return language.relabelled(*_language_tables(spark, d))


@query
def p9_documents(spark: SparkSession, d: str) -> DataFrame:
    return language.document_languages(*_language_tables(spark, d))


@query
def p9_segments(spark: SparkSession, d: str) -> DataFrame:
    docs, _, filters = _language_tables(spark, d)
    return language.segment_languages(docs, filters)
