"""Queries of the core operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociform.functions import codes, stats, vcf_math
from lociform.operators import candidates, flanks, intervals, pileup, reads, reference, reject, vcf, vcf_filter, wide
from lociform.operators.multivalue import info_entry, sample_field, split_fields, whole_values
from lociform.operators.sequences import with_sequence
from lociform.plans.tables import materialized, spread, table

QUERIES = {}
ORACLES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _reads(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "aligned_reads"))


# problem 2


def _wide(spark: SparkSession, d: str) -> DataFrame:
    calls = table(spark, d, "vcf").where("info is null").select(F.col("rec_id").alias("call_id"))
    attrs = table(spark, d, "info_attrs").join(calls, "call_id", "left_semi")
    return wide.wide_table(attrs, "call_id", "attr", "val", "recorded_at", "attr_row_id")


@query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    cells = wide.attribute_cells(_wide(spark, d), ["DP", "FRAC", "QD"])
    return cells.select(F.col("entity").alias("call_id"), "attr", "val_milli")


@query
def p2_wide(spark: SparkSession, d: str) -> DataFrame:
    return _wide(spark, d).withColumnRenamed("entity", "call_id")


@query
def p2_wide_text(spark: SparkSession, d: str) -> DataFrame:
    """``p2_wide`` with its cast failures as one text, in order of the attributes."""
    entries = F.transform(F.array_sort(F.map_entries("cast_failures")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return p2_wide(spark, d).withColumn("cast_failures", F.array_join(entries, "\n"))


@query
def p2_unknown_attributes(spark: SparkSession, d: str) -> DataFrame:
    return wide.unknown_attributes(table(spark, d, "info_attrs"), "call_id", "attr", "val").withColumnRenamed("entity", "call_id")


ORACLES["p2_found"] = r"""
with a as (
  select call_id, regexp_replace(upper(trim(attr)), '^INFO[/.:]', '') as attr, trim(val, ' "''') as t, recorded_at, attr_row_id
  from info_attrs where call_id in (select rec_id from vcf where info is null)),
n as (
  select *, case when regexp_full_match(t, '[+-]?[0-9]+([.,][0-9]+)?([eE][+-]?[0-9]+)?%?')
    then try_cast(replace(replace(t, '%', ''), ',', '.') as double) / case when t like '%\%' escape '\' then 100 else 1 end end as v
  from a where attr in ('DP', 'FRAC', 'QD'))
select call_id, attr, cast(round(arg_max(v, (recorded_at, attr_row_id)) * 1000) as bigint) as val_milli from n where v is not null group by call_id, attr
"""

_NUMERIC = [k for k, t in wide.INFO_TYPES.items() if t != "string"]


def _wide_sql() -> str:
    names = ", ".join(f"('{k.lower()}', '{k}', {str(k in _NUMERIC).lower()})" for k in wide.INFO_TYPES)
    best = lambda k, c: f"max(best.{c}) filter (attr = '{k}')"
    whole = lambda k: f"case when {best(k, 'v')} = floor({best(k, 'v')}) then try_cast({best(k, 'v')} as int) end"
    value = {k: best(k, "val") if t == "string" else whole(k) if t == "int" else best(k, "v") for k, t in wide.INFO_TYPES.items()}
    lost = [f"'{k}=' || coalesce(max(failed) filter (attr = '{k}'), case when {value[k]} is null then {best(k, 'val')} end)" for k in sorted(wide.INFO_TYPES)]
    return rf"""
with names(low, attr, is_number) as (values {names}),
a as (select call_id, n.attr, is_number, val, trim(val, ' "''') as t, recorded_at, attr_row_id from info_attrs
  join names n on n.low = regexp_replace(lower(trim(info_attrs.attr)), '^info[/.:]', '') where call_id in (select rec_id from vcf where info is null)),
b as (select *, case when regexp_full_match(t, '[+-]?[0-9]+([.,][0-9]+)?([eE][+-]?[0-9]+)?%?')
    then try_cast(replace(replace(t, '%', ''), ',', '.') as double) / case when right(t, 1) = '%' then 100 else 1 end end as v from a),
g as (select *, case when is_number then v is not null else coalesce(trim(val), '') <> '' end as good from b),
r as (select call_id, attr, arg_max({{'val': val, 'v': v}}, (recorded_at, attr_row_id)) filter (good) as best, arg_max(val, (recorded_at, attr_row_id)) filter (not good and val is not null) as failed
  from g group by call_id, attr)
select call_id, {", ".join(f'{v} as "{k}"' for k, v in value.items())}, concat_ws(chr(10), {", ".join(lost)}) as cast_failures from r group by call_id
"""


ORACLES["p2_wide_text"] = _wide_sql()

ORACLES["p2_unknown_attributes"] = f"""
select call_id, attr, val from info_attrs where attr is null or regexp_replace(lower(trim(attr)), '^info[/.:]', '') not in ({', '.join(repr(k.lower()) for k in wide.INFO_TYPES)})
"""

# problem 5


@query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    bad = reject.rejected_records(table(spark, d, "vcf_lines"), "line_id", "line")
    return bad.select(F.col("ident").alias("line_id"), "reason")


@query
def p5_valid(spark: SparkSession, d: str) -> DataFrame:
    return reject.valid_records(table(spark, d, "vcf_lines"), "line_id", "line").withColumnRenamed("ident", "line_id")


_PARSED = r"""
with l as (select line_id, regexp_replace(line, '\r$', '') as s from vcf_lines),
r as (select line_id, regexp_replace(s, '(^|\t)"(?:[^"]|"")*"', '\1q', 'g') as b, s from l where not regexp_full_match(s, '\s*') and s not like '#%'),
w as (select *, regexp_full_match(s, '(?:"(?:[^"]|"")*"|[^"\t]*)(?:\t(?:"(?:[^"]|"")*"|[^"\t]*))*') as ok from r),
f as (select *, string_split(b, chr(9)) as x, regexp_extract_all(chr(9) || s, '\t("(?:[^"]|"")*"|[^"\t]*)', 1) as y from w),
g as (select *, list_transform(y, lambda t: case when t like '"%' then replace(t[2:-2], '""', '"') else t end) as z from f),
e as (select *, regexp_extract_all(';' || z[8], ';DP=([^;]*)', 1)[1] as dp, regexp_extract_all(';' || z[8], ';FRAC=([^;]*)', 1)[1] as fr,
  regexp_extract_all(';' || z[8], ';QD=([^;]*)', 1)[1] as qd from g),
c as (select line_id, case when not ok then 'quoting' when len(x) <> 10 then 'columns'
  when not regexp_full_match(z[2], '0*[1-9][0-9]*') then 'pos'
  when not (z[6] = '.' or regexp_full_match(z[6], '[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?')) then 'qual'
  when dp is null or fr is null or qd is null or not regexp_full_match(dp, '[0-9]+') or not regexp_full_match(fr, '[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?')
    or not regexp_full_match(qd, '[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?') or cast(fr as double) > 1 then 'info' end as reason, z from e)
"""
ORACLES["p5_found"] = _PARSED + "select line_id, reason from c where reason is not null"
ORACLES["p5_valid"] = _PARSED + "select line_id, " + ", ".join(
    f"try_cast(nullif(z[{i}], '.') as {'bigint' if f == 'pos' else 'double'}) as {f}" if f in ("pos", "qual") else f"nullif(z[{i}], '.') as {f}" for i, f in enumerate(reject.FIELDS, 1)
) + " from c where reason is null"

# problem 6


@query
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    keys, call = F.col("format_keys"), F.col("sample_call")
    fields = {"AD": sample_field(keys, call, "AD"), "PL": sample_field(keys, call, "PL"), "DP4": info_entry(F.col("info"), "DP4")}
    calls = split_fields(table(spark, d, "vcf"), "rec_id", fields, known=(), brackets=False)
    snps = table(spark, d, "dbsnp")
    alleles = whole_values(snps, F.col("alt"))
    known = split_fields(snps, "snp_id", {"ALT": F.col("alt")}, known=alleles or (), brackets=alleles is None)
    named = lambda df, name: df.select(F.lit(name).alias("source_table"), F.col("ident").alias("row_id"), "field_tag", "item_no", "item")
    return named(calls, "vcf").unionByName(named(known, "dbsnp"))


ORACLES["p6_found"] = r"""
with f as (
  select 'vcf' as source_table, rec_id as row_id, k as field_tag, string_split(sample_call, ':')[list_position(string_split(format_keys, ':'), k)] as t
  from vcf, (values ('AD'), ('PL')) as x(k) where list_position(string_split(format_keys, ':'), k) > 0
  union all select 'vcf', rec_id, 'DP4', regexp_extract(regexp_replace(info, '[;|,/\s]+(?:[A-Za-z][A-Za-z0-9]*=|INDEL(?:[;|,/\s]|$))', '~\0', 'g'), '(?:^|[;|,/\s])DP4=([^~]*)', 1) from vcf
  union all select 'dbsnp', snp_id, 'ALT', alt from dbsnp),
i as (select source_table, row_id, field_tag, regexp_extract_all(t, '<[^<>]*>|[^,;|/\s"'']+') as items from f)
select source_table, row_id, field_tag, unnest(range(1, len(items) + 1)) as item_no, unnest(items) as item from i where len(items) >= 2
"""

# The caller on the given tables. Positions, bases and qualities of its observations come from
# lineitem and part (a part is a position, a line item a base of a read that covers it).

_OBSERVED = """
with obs as (
  select concat('chr', cast(floor(p.p_partkey / 100) as int)) as chrom, l.l_partkey as pos, p.p_size % 4 as ref_code,
    case when l.l_partkey % 7 = 0 and l.l_orderkey % 2 = 0 then (p.p_size + 2) % 4 when l.l_partkey % 11 = 0 then (p.p_size + 1) % 4 else p.p_size % 4 end as code,
    case when l.l_quantity > 20 then 4 when l.l_quantity > 17 then 3 when l.l_quantity > 13 then 2 when l.l_quantity > 10 then 1 else 0 end as weight,
    l.l_linenumber % 2 = 1 as forward, l.l_orderkey, l.l_linenumber, l.l_suppkey
  from lineitem l join part p on l.l_partkey = p.p_partkey)
"""
_CLEAN = "replace(upper(regexp_replace(seq, '\\s+', '', 'g')), '.', 'N')"


def observed(spark: SparkSession, d: str) -> DataFrame:
    """Base observations: ``chrom, pos, ref_code, code, weight, forward`` and the line's keys."""
    l, p = table(spark, d, "lineitem"), table(spark, d, "part")
    rows = l.join(p, F.col("l_partkey") == F.col("p_partkey"))
    own = F.col("p_size") % 4
    code = F.when((F.col("l_partkey") % 7 == 0) & (F.col("l_orderkey") % 2 == 0), (F.col("p_size") + 2) % 4)
    return rows.select(
        F.concat(F.lit("chr"), F.floor(F.col("p_partkey") / 100).cast("int")).alias("chrom"), F.col("l_partkey").alias("pos"), own.alias("ref_code"),
        code.when(F.col("l_partkey") % 11 == 0, (F.col("p_size") + 1) % 4).otherwise(own).alias("code"),
        codes.quality_weight(F.col("l_quantity")).alias("weight"), (F.col("l_linenumber") % 2 == 1).alias("forward"),
        "l_orderkey", "l_linenumber", "l_suppkey",
    )


def observed_indels(spark: SparkSession, d: str, *keys: str) -> DataFrame:
    rows = observed(spark, d).where("(pos % 13 = 0 and l_linenumber % 3 = 0) or pos % 17 = 0")
    ins = (F.col("pos") % 13 == 0) & (F.col("l_linenumber") % 3 == 0)
    size = F.when(ins, 1 + F.col("l_suppkey") % 3).otherwise(1 + F.col("l_linenumber") % 2).cast("int")
    return rows.select("chrom", "pos", F.when(ins, "I").otherwise("D").alias("kind"), size.alias("length"), F.when(ins, F.repeat(F.lit("G"), size)).alias("seq"), "weight", *keys)


def reference_bases(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(F.concat(F.lit("chr"), F.floor(F.col("p_partkey") / 100).cast("int")).alias("chrom"), F.col("p_partkey").alias("pos"), (F.col("p_size") % 4).alias("ref_code"))


_REFERENCE = "select concat('chr', cast(floor(p_partkey / 100) as int)) as chrom, p_partkey as pos, p_size % 4 as ref_code from part"


@query
def reads_usable(spark: SparkSession, d: str) -> DataFrame:
    return reads.usable_reads(_reads(spark, d)).select("read_id", "forward", F.length("bases").alias("n_bases"))


_USABLE = f"""
with u as (
  select * from (select read_id, chrom, pos, cigar, qual, {_CLEAN} as bases, coalesce(flag, 0) as flag, mapq from aligned_reads)
  where coalesce(mapq, 0) >= 0 and chrom is not null and pos >= 1 and (flag & 1024) = 0 and bases not in ('', '*') and regexp_full_match(cigar, '([0-9]+[MIDNSHP=X])+')
    and coalesce(list_sum(list_transform(regexp_extract_all(cigar, '([0-9]+)[MIS]', 1), lambda x: cast(x as bigint))), 0) = length(bases)),
o as (select read_id, unnest(range(1, len(regexp_extract_all(cigar, '[0-9]+')) + 1)) as k, cast(unnest(regexp_extract_all(cigar, '[0-9]+')) as bigint) as n,
  unnest(regexp_extract_all(cigar, '[MIDNSHP=X]')) as op from u),
w as (select *, coalesce(sum(case when op in ('M', 'I', 'S') then n end) over (partition by read_id order by k rows between unbounded preceding and 1 preceding), 0) as r,
  coalesce(sum(case when op in ('M', 'D', 'N') then n end) over (partition by read_id order by k rows between unbounded preceding and 1 preceding), 0) as g from o)
"""
ORACLES["reads_usable"] = _USABLE + "select read_id, (flag & 16) = 0 as forward, cast(length(bases) as int) as n_bases from u"


@query
def reads_cigar_ops(spark: SparkSession, d: str) -> DataFrame:
    ops = _reads(spark, d).select(F.inline(reads.cigar_ops(F.col("cigar"))))
    return ops.groupBy("op").agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("bases"))


ORACLES["reads_cigar_ops"] = """
select op, count(*) as n, cast(sum(n) as bigint) as bases from (
  select cast(unnest(regexp_extract_all(cigar, '[0-9]+')) as bigint) as n, unnest(regexp_extract_all(cigar, '[MIDNSHP=X]')) as op from aligned_reads
  where regexp_full_match(cigar, '([0-9]+[MIDNSHP=X])+')) group by op
"""


@query
def reads_pileup(spark: SparkSession, d: str) -> DataFrame:
    piled = pileup.pileup(reads.aligned_bases(_reads(spark, d)))
    return piled.select("chrom", "pos", *[F.col(x)[k].alias(f"{x}{k}") for x in "wfr" for k in range(4)])


_WEIGHT = "case when q is null or q < 0 or q >= 128 then 0 when least(q, 40) > 20 then 4 when q > 17 then 3 when q > 13 then 2 when q > 10 then 1 else 0 end"
ORACLES["reads_pileup"] = _USABLE + f"""
, m as (select w.*, u.chrom, u.pos, u.bases, u.qual, u.flag, unnest(range(cast(greatest(r, 5) as bigint), cast(least(r + n, length(bases) - 5) as bigint))) as i from w join u using (read_id) where op = 'M'),
b as (select chrom, pos + g + i - r as pos, substr(bases, cast(i + 1 as bigint), 1) as base, qual[cast(i + 1 as bigint)] as q, (flag & 16) = 0 as fwd from m),
c as (select chrom, pos, case base when 'C' then 1 when 'G' then 2 when 'N' then 2 when 'T' then 3 else 0 end as code, {_WEIGHT} as weight, fwd from b)
select chrom, cast(pos as bigint) as pos, """ + ", ".join(
    [f"cast(coalesce(sum(weight) filter (code = {k}), 0) as bigint) as w{k}" for k in range(4)]
    + [f"count(*) filter (code = {k} and fwd) as f{k}" for k in range(4)] + [f"count(*) filter (code = {k} and not fwd) as r{k}" for k in range(4)]
) + " from c group by chrom, pos"


@query
def reads_indels(spark: SparkSession, d: str) -> DataFrame:
    return pileup.indel_pileup(reads.read_indels(_reads(spark, d)))


ORACLES["reads_indels"] = _USABLE + f"""
, e as (select read_id, max(least(r + n, length(bases) - 5) - 1) as last_m from w join u using (read_id) where op = 'M' and least(r + n, length(bases) - 5) > greatest(r, 5) group by read_id),
x as (select w.*, u.chrom, u.pos, u.bases, u.qual from w join u using (read_id) join e using (read_id)
  where op in ('I', 'D') and n <= 255 and r <= last_m and r >= 5 and (op = 'D' or r + n < length(bases))),
y as (select chrom, cast(pos + g as bigint) as pos, op as kind, cast(n as int) as length, case when op = 'I' then substr(bases, cast(r + 1 as bigint), n) end as seq,
  list_transform(range(cast(r as bigint), cast(r + case when op = 'I' then n else 1 end as bigint)), lambda k: qual[k + 1]) as qs from x),
z as (select *, list_sum(list_transform(qs, lambda q: {_WEIGHT})) // len(qs) > 1 as high from y)
select chrom, pos, kind, length, seq, count(*) filter (high) as hq, count(*) filter (not high) as lq from z group by chrom, pos, kind, length, seq
"""


@query
def reads_soft_clips(spark: SparkSession, d: str) -> DataFrame:
    return pileup.clip_counts(reads.soft_clips(_reads(spark, d)))


ORACLES["reads_soft_clips"] = _USABLE + """
, s as (select chrom, cast(case when r > 0 then pos + g - 1 else pos + g end as bigint) as pos, r > 0 as later from w join u using (read_id) where op = 'S' and n >= 5)
select chrom, pos, count(*) filter (later) as left_count, count(*) filter (not later) as right_count from s group by chrom, pos
"""


@query
def reads_qc(spark: SparkSession, d: str) -> DataFrame:
    return reads.alignment_qc(_reads(spark, d))


ORACLES["reads_qc"] = f"""
with r as (select *, nullif(nullif({_CLEAN}, ''), '*') as bases from aligned_reads where (coalesce(flag, 0) & 1024) = 0),
t as (select *, coalesce(list_sum(list_transform(regexp_extract_all(cigar, '([0-9]+)M', 1), lambda x: cast(x as bigint))), 0) as m,
  chrom is null or coalesce(pos, 0) < 1 or cigar is null or cigar = '*' as unplaced from r)
select count(*) as total_reads, count(*) filter (unplaced) as unaligned_reads, count(*) filter (cigar like '%S%' and regexp_matches(cigar, '[1-9][0-9]*S')) as softclipped_reads,
  cast(sum(length(bases)) as bigint) as total_read_length, cast(sum(m) filter (not unplaced) as bigint) as total_aligned_length, cast(null as bigint) as target_aligned_length from t
"""


@query
def reads_qc_targets(spark: SparkSession, d: str) -> DataFrame:
    """The quality report with the aligned bases that lie within 500 positions of a call."""
    calls = with_sequence(table(spark, d, "vcf").select("chrom", "pos"), table(spark, d, "seq_dict"))
    near = calls.select(F.col("seq_name").alias("chrom"), F.greatest(F.col("pos") - 500, F.lit(1)).alias("start"), (F.col("pos") + 501).alias("end"))
    return reads.alignment_qc(_reads(spark, d), intervals.merged(near))


ORACLES["reads_qc_targets"] = _USABLE + """
, m as (select u.chrom, u.pos + g as a, n from w join u using (read_id) where op = 'M'),
b as (select chrom, unnest(range(cast(a as bigint), cast(a + n as bigint))) as pos from m),
c as (select distinct s.chrom, v.pos from vcf v join seq_dict s on lower(trim(v.chrom)) in (lower(trim(s.chrom)), lower(trim(s.short_name)))),
t as (select distinct chrom, unnest(range(greatest(pos - 500, 1), pos + 501)) as pos from c), h as (select count(*) as target_aligned_length from b join t using (chrom, pos)),
q as (""" + ORACLES["reads_qc"].replace(", cast(null as bigint) as target_aligned_length", "") + """)
select q.*, h.target_aligned_length from q, h
"""


@query
def pileup_base(spark: SparkSession, d: str) -> DataFrame:
    piled = pileup.site_totals(pileup.pileup(observed(spark, d)))
    arrays = [F.col(x)[k].alias(f"{x}{k}") for x in "wfr" for k in range(4)]
    return piled.select("chrom", "pos", *arrays, "weight", "forward", "reverse", "gc", "g", "is_saturated")


_PILED = _OBSERVED + ", piled as (select chrom, pos, " + ", ".join(
    [f"cast(coalesce(sum(weight) filter (code = {k}), 0) as bigint) as w{k}" for k in range(4)]
    + [f"count(*) filter (code = {k} and forward) as f{k}" for k in range(4)] + [f"count(*) filter (code = {k} and not forward) as r{k}" for k in range(4)]
) + ", cast(sum(weight) as bigint) as weight, count(*) filter (forward) as forward, count(*) filter (not forward) as reverse, max(case when code in (1, 2) then 1 else 0 end) as gc, max(case when code = 2 then 1 else 0 end) as g from obs group by chrom, pos)"
ORACLES["pileup_base"] = _PILED + " select *, greatest(f0, f1, f2, f3, r0, r1, r2, r3) >= 65532 or greatest(w0, w1, w2, w3) >= 65535 as is_saturated from piled"


@query
def pileup_retracted(spark: SparkSession, d: str) -> DataFrame:
    """Pileup after taking back the observations of open orders' first lines."""
    rows = observed(spark, d).select("chrom", "pos", "code", "weight", "forward", "l_linenumber")
    left = pileup.retract(rows.drop("l_linenumber"), rows.where("l_linenumber = 1").drop("l_linenumber"))
    return left.select("chrom", "pos", *[F.col(x)[k].alias(f"{x}{k}") for x in "wfr" for k in range(4)])


ORACLES["pileup_retracted"] = _OBSERVED.replace("l.l_partkey = p.p_partkey)", "l.l_partkey = p.p_partkey where l.l_linenumber <> 1)") + "select chrom, pos, " + ", ".join(
    [f"cast(coalesce(sum(weight) filter (code = {k}), 0) as bigint) as w{k}" for k in range(4)]
    + [f"count(*) filter (code = {k} and forward) as f{k}" for k in range(4)] + [f"count(*) filter (code = {k} and not forward) as r{k}" for k in range(4)]
) + " from obs group by chrom, pos"

_INDELS = _OBSERVED + """
, ind as (select chrom, pos, case when pos % 13 = 0 and l_linenumber % 3 = 0 then 'I' else 'D' end as kind,
    cast(case when pos % 13 = 0 and l_linenumber % 3 = 0 then 1 + l_suppkey % 3 else 1 + l_linenumber % 2 end as int) as length, weight
  from obs where (pos % 13 = 0 and l_linenumber % 3 = 0) or pos % 17 = 0),
cnt as (select chrom, pos, kind, length, case when kind = 'I' then repeat('G', length) end as seq, count(*) filter (weight > 1) as hq, count(*) filter (weight <= 1) as lq
  from ind group by chrom, pos, kind, length)
"""


@query
def pileup_indels(spark: SparkSession, d: str) -> DataFrame:
    return pileup.indel_pileup(observed_indels(spark, d))


ORACLES["pileup_indels"] = _INDELS + "select * from cnt"


def _first_lines(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = observed_indels(spark, d, "l_linenumber")
    return rows.drop("l_linenumber"), rows.where("l_linenumber = 1").drop("l_linenumber")


@query
def pileup_indels_retracted(spark: SparkSession, d: str) -> DataFrame:
    """Indel counts after taking back those of open orders' first lines."""
    return pileup.retract_indels(*_first_lines(spark, d))


ORACLES["pileup_indels_retracted"] = _INDELS.replace("from obs where", "from obs where l_linenumber <> 1 and (").replace("or pos % 17 = 0),", "or pos % 17 = 0)),") + "select * from cnt"


@query
def pileup_indels_realigned(spark: SparkSession, d: str) -> DataFrame:
    """Indel counts with those of the first lines added once more inside a stretch of positions."""
    return pileup.realign_indels(*_first_lines(spark, d), 50, 150)


ORACLES["pileup_indels_realigned"] = _INDELS.replace("cnt as (", "twice as (select *, l_linenumber as n from ind union all select *, l_linenumber from ind where l_linenumber = 1 and pos between 50 and 150),\ncnt as (").replace(
    "as int) as length, weight\n", "as int) as length, weight, l_linenumber\n"
).replace("from ind group by", "from twice group by") + "select * from cnt"


@query
def pileup_top_indels(spark: SparkSession, d: str) -> DataFrame:
    top = pileup.top_indels(pileup.indel_pileup(observed_indels(spark, d)))
    return top.select("chrom", "pos", "total_hq", "total_lq", F.posexplode("indels").alias("place", "x")).select("chrom", "pos", "total_hq", "total_lq", "place", "x.*")


ORACLES["pileup_top_indels"] = _INDELS + """
, a as (select chrom, greatest(pos - 1, 1) as pos, kind, length, seq, hq, lq from cnt),
k as (select *, row_number() over (partition by chrom, pos order by hq + lq desc, kind desc, length, seq) - 1 as place,
  sum(hq) over (partition by chrom, pos) as th, sum(lq) over (partition by chrom, pos) as tl from a)
select chrom, pos, cast(th as bigint) as total_hq, cast(tl as bigint) as total_lq, cast(place as int) as place, kind, length, seq, hq, lq from k where place < 2
"""


@query
def pileup_support(spark: SparkSession, d: str) -> DataFrame:
    return pileup.position_support(pileup.pileup(observed(spark, d)), pileup.indel_pileup(observed_indels(spark, d)))


ORACLES["pileup_support"] = _INDELS + """
select chrom, pos, cast(sum(n) as bigint) as support from (
  select chrom, pos, count(*) as n from obs group by chrom, pos union all select chrom, pos, hq + lq from cnt where kind = 'D') group by chrom, pos
"""


@query
def pileup_info(spark: SparkSession, d: str) -> DataFrame:
    info = pileup.position_info(pileup.pileup(observed(spark, d)), pileup.indel_pileup(observed_indels(spark, d)))
    return info.select("chrom", "pos", F.col("w")[0].alias("w0"), F.coalesce(F.size("indels"), F.lit(0)).alias("n_indels"), F.col("indels")[0]["kind"].alias("kind"), F.col("indels")[0]["length"].alias("length"))


ORACLES["pileup_info"] = _INDELS + """
, p as (select chrom, pos, cast(coalesce(sum(weight) filter (code = 0), 0) as bigint) as w0 from obs group by chrom, pos),
i as (select chrom, pos, count(*) as n, first(kind order by hq + lq desc, kind, length) as kind, first(length order by hq + lq desc, kind, length) as length from cnt group by chrom, pos)
select p.chrom, p.pos, w0, cast(coalesce(n, 0) as int) as n_indels, kind, length from p left join i on p.chrom = i.chrom and p.pos = i.pos
"""


@query
def pileup_depth_histogram(spark: SparkSession, d: str) -> DataFrame:
    share = F.col("forward") / (F.col("forward") + F.col("reverse"))
    return pileup.share_histogram(pileup.site_totals(pileup.pileup(observed(spark, d))), share)


ORACLES["pileup_depth_histogram"] = _PILED + " select cast(floor(forward / (forward + reverse) * 100 + 0.4999) as int) as bin, count(*) as n from piled group by bin"


@query
def pileup_coverage(spark: SparkSession, d: str) -> DataFrame:
    lengths = reference_bases(spark, d).groupBy("chrom").agg(F.count(F.lit(1)).alias("length"))
    return pileup.coverage(pileup.pileup(observed(spark, d)), lengths)


ORACLES["pileup_coverage"] = _PILED + f"""
, n as (select chrom, count(*) as length from ({_REFERENCE}) group by chrom), c as (select chrom, count(*) as covered from piled group by chrom)
select n.chrom, coalesce(covered, 0) as covered, length, coalesce(covered, 0) / length < 0.1 as is_sparse from n left join c on n.chrom = c.chrom
"""



@query
def pileup_realigned(spark: SparkSession, d: str) -> DataFrame:
    """Pileup with the observations of the first lines added once more inside a stretch of positions."""
    rows = observed(spark, d).select("chrom", "pos", "code", "weight", "forward", "l_linenumber")
    more = pileup.realign(rows.drop("l_linenumber"), rows.where("l_linenumber = 1").drop("l_linenumber"), 50, 150)
    return more.select("chrom", "pos", *[F.col(x)[k].alias(f"{x}{k}") for x in "wfr" for k in range(4)])


ORACLES["pileup_realigned"] = _OBSERVED + ", twice as (select * from obs union all select * from obs where l_linenumber = 1 and pos between 50 and 150) select chrom, pos, " + ", ".join(
    [f"cast(coalesce(sum(weight) filter (code = {k}), 0) as bigint) as w{k}" for k in range(4)]
    + [f"count(*) filter (code = {k} and forward) as f{k}" for k in range(4)] + [f"count(*) filter (code = {k} and not forward) as r{k}" for k in range(4)]
) + " from twice group by chrom, pos"


@query
def reads_clips_less_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Clips of all reads less those of the reads marked as duplicates."""
    r = _reads(spark, d)
    unmarked = r.withColumn("flag", F.col("flag").bitwiseAND(~1024))
    return pileup.clip_counts(reads.soft_clips(unmarked), reads.soft_clips(unmarked.where(r["flag"].bitwiseAND(1024) != 0)))


ORACLES["reads_clips_less_duplicates"] = ORACLES["reads_soft_clips"]

# regions


def _regions(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    start = F.col("o_custkey") * 10 + F.col("o_orderkey") % 100
    rows = o.select(F.concat(F.lit("chr"), (F.col("o_custkey") % 5).cast("string")).alias("chrom"), start.alias("start"), (start + 1 + F.floor("o_totalprice") % 15).alias("end"))
    return intervals.normalised(rows, "bed")


_REGIONS = """
with g as (select concat('chr', cast(o_custkey % 5 as varchar)) as chrom, o_custkey * 10 + o_orderkey % 100 as s, cast(floor(o_totalprice) as bigint) % 15 as k from orders),
reg as (select chrom, s + 1 as a, s + k + 2 as b from g),
f as (select *, max(b) over (partition by chrom order by a, b rows between unbounded preceding and 1 preceding) as reach from reg),
h as (select *, sum(case when reach is null or a >= reach then 1 else 0 end) over (partition by chrom order by a, b rows unbounded preceding) as grp from f),
mer as (select chrom, min(a) as a, max(b) as b from h group by chrom, grp)
"""


@query
def regions_merged(spark: SparkSession, d: str) -> DataFrame:
    return intervals.merged(_regions(spark, d), tile=1 << 12).withColumnsRenamed({"start": "first_pos", "end": "end_pos"})


ORACLES["regions_merged"] = _REGIONS + "select chrom, a as first_pos, b as end_pos from mer"


@query
def regions_margin(spark: SparkSession, d: str) -> DataFrame:
    wide = intervals.with_margin(_regions(spark, d), 3)
    return wide.groupBy("chrom").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end") - F.col("start")).alias("positions"))


ORACLES["regions_margin"] = _REGIONS.replace("s + 1 as a, s + k + 2 as b", "greatest(s + 1 - 3, 1) as a, s + k + 2 + 3 as b") + "select chrom, count(*) as n, cast(sum(b - a) as bigint) as positions from mer group by chrom"


@query
def regions_clipped(spark: SparkSession, d: str) -> DataFrame:
    lengths = _regions(spark, d).groupBy("chrom").agg(F.floor(F.max("end") * 0.9).alias("length"))
    cut = intervals.clipped(_regions(spark, d), lengths)
    return cut.groupBy("chrom").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end") - F.col("start")).alias("positions"), F.max("end").alias("last"))


ORACLES["regions_clipped"] = _REGIONS + """
, n as (select chrom, cast(floor(max(b) * 0.9) as bigint) as length from reg group by chrom),
c as (select r.chrom, greatest(a, 1) as a, least(b, length + 1) as b from reg r join n on r.chrom = n.chrom)
select chrom, count(*) as n, cast(sum(b - a) as bigint) as positions, max(b) as last from c where a < b group by chrom
"""


@query
def regions_restrict(spark: SparkSession, d: str) -> DataFrame:
    """Pileup positions that lie in any region of their sequence."""
    p = table(spark, d, "part").select(F.concat(F.lit("chr"), (F.col("p_partkey") % 5).cast("string")).alias("chrom"), F.col("p_partkey").alias("pos"), "p_brand")
    return intervals.points_in_regions(p, _regions(spark, d), size=256)


ORACLES["regions_restrict"] = _REGIONS + """
select chrom, pos, p_brand from (select concat('chr', cast(p_partkey % 5 as varchar)) as chrom, p_partkey as pos, p_brand from part) p
where exists (select 1 from mer where mer.chrom = p.chrom and p.pos >= a and p.pos < b)
"""


@query
def regions_soft_clips(spark: SparkSession, d: str) -> DataFrame:
    """Soft clips that lie within the margin of a call's position, both ends included."""
    clips = pileup.clip_counts(reads.soft_clips(_reads(spark, d)))
    calls = with_sequence(table(spark, d, "vcf").select("chrom", "pos"), table(spark, d, "seq_dict"))
    near = intervals.normalised(calls.select(F.col("seq_name").alias("chrom"), (F.col("pos") - 1001).alias("start"), (F.col("pos") + 999).alias("end")))
    return intervals.points_in_regions(clips, near)


ORACLES["regions_soft_clips"] = ORACLES["reads_soft_clips"].replace("select chrom, pos, count", "\n, q as (select chrom, pos, count") + """)
select * from q where exists (select 1 from vcf v join seq_dict s on lower(trim(v.chrom)) in (lower(trim(s.chrom)), lower(trim(s.short_name)))
  where s.chrom = q.chrom and q.pos >= v.pos - 1000 and q.pos < v.pos + 1000)
"""

@query
def calls_soft_clips(spark: SparkSession, d: str) -> DataFrame:
    """Soft clips at each call's own position."""
    clips = pileup.clip_counts(reads.soft_clips(_reads(spark, d)))
    return pileup.clips_at(_named_calls(spark, d).select("rec_id", "chrom", "pos"), clips)


ORACLES["calls_soft_clips"] = _USABLE + """
, s as (select chrom, cast(case when r > 0 then pos + g - 1 else pos + g end as bigint) as pos from w join u using (read_id) where op = 'S' and n >= 5),
q as (select chrom, pos, count(*) as n from s group by chrom, pos)
select v.rec_id, d.chrom, v.pos, coalesce(q.n, 0) as n_clips from vcf v join seq_dict d on lower(trim(v.chrom)) in (lower(trim(d.chrom)), lower(trim(d.short_name))) left join q on q.chrom = d.chrom and q.pos = v.pos
"""

# the model


@query
def bias_by_base(spark: SparkSession, d: str) -> DataFrame:
    piled = pileup.pileup(observed(spark, d)).select("chrom", "pos", stats.strand_bias("f", "r").alias("s"), stats.base_quality_bias("w", "f", "r").alias("q"))
    each = F.arrays_zip("s", "q")
    return piled.select("chrom", "pos", F.posexplode(each).alias("code", "x")).select("chrom", "pos", "code", F.round("x.s", 6).alias("sb"), F.round("x.q", 6).alias("bqb"))


def _fisher_sql(a: str, b: str, c: str, d: str, keep: str) -> str:
    """SQL of the two-tailed test of a 2 x 2 table; ``keep`` compares p with the observed table's own."""
    ln = lambda x: f"lgamma({x} + 1)"
    row, col, n = f"({a} + {b})", f"({a} + {c})", f"({a} + {b} + {c} + {d})"
    p = lambda x: f"exp({ln(row)} + {ln(f'{n} - {row}')} + {ln(col)} + {ln(f'{n} - {col}')} - {ln(n)} - {ln(x)} - {ln(f'{row} - {x}')} - {ln(f'{col} - {x}')} - {ln(f'{n} - {row} - {col} + {x}')})"
    support = f"range(greatest(0, {row} + {col} - {n}), least({row}, {col}) + 1)"
    rest = f"list_filter(list_transform(list_filter({support}, lambda x: x <> {a}), lambda x: {p('x')}), lambda p: p < {p(a)} * {keep})"
    return f"case when {n} = 0 then 1.0 else coalesce(list_sum({rest}), 0) + {p(a)} end"


_ALLELES = ", l as (" + " union all ".join(f"select chrom, pos, {k} as code, w{k} as w, f{k} as f, r{k} as r from piled" for k in range(4)) + ")"
ORACLES["bias_by_base"] = (
    _PILED + _ALLELES
    + f" select chrom, pos, cast(code as int) as code, round(least(1.0, {_fisher_sql('f', 'r', '((f + r) // 2)', '((f + r) // 2)', '(1 - 1e-7)')}), 6) as sb,"
    + f" round(least(1.0, {_fisher_sql('w', '(4 * (f + r))', '(4 * (f + r))', '(4 * (f + r))', '(1 - 1e-7)')}), 6) as bqb from l"
)


@query
def fisher_tails(spark: SparkSession, d: str) -> DataFrame:
    """All tails of strand by allele for every position: reference against other bases."""
    rows = observed(spark, d).groupBy("chrom", "pos").agg(*[
        F.count_if((F.col("code") == F.col("ref_code")) & F.col("forward")).alias("a"), F.count_if((F.col("code") == F.col("ref_code")) & ~F.col("forward")).alias("b"),
        F.count_if((F.col("code") != F.col("ref_code")) & F.col("forward")).alias("c"), F.count_if((F.col("code") != F.col("ref_code")) & ~F.col("forward")).alias("d"),
    ])
    x = rows.withColumn("t", stats.fisher_all("a", "b", "c", "d"))
    return x.select("chrom", "pos", *[F.round(f"t.{k}", 6).alias(f"p_{k}") for k in ("two", "below")], F.round(stats.ln_binomial(F.col("a") + F.col("b"), F.col("a")), 6).alias("ln_ways"), F.round(stats.chi2_yates(*map(F.col, "abcd")), 6).alias("distance"), F.round(stats.chi2_density(1, F.col("a") / 10 + 0.1), 6).alias("density"))


_CHI = lambda cell, row, col: f"case when ({row}) * ({col}) > 0 then power(abs({cell} - ({row}) * ({col}) / (a + b + c + d)) - 0.5, 2) / (({row}) * ({col}) / (a + b + c + d)) else 0 end"
ORACLES["fisher_tails"] = _OBSERVED + f"""
, t as (select chrom, pos, count(*) filter (code = ref_code and forward) as a, count(*) filter (code = ref_code and not forward) as b,
  count(*) filter (code <> ref_code and forward) as c, count(*) filter (code <> ref_code and not forward) as d from obs group by chrom, pos)
select chrom, pos, round({_fisher_sql('a', 'b', 'c', 'd', '(1 + 1e-9)')}, 6) as p_two, round({_fisher_sql('a', 'b', 'c', 'd', '(1 - 1e-7)')}, 6) as p_below,
  round(lgamma(a + b + 1) - lgamma(a + 1) - lgamma(b + 1), 6) as ln_ways, round({_CHI('a', 'a + b', 'a + c')} + {_CHI('b', 'a + b', 'b + d')} + {_CHI('c', 'c + d', 'a + c')} + {_CHI('d', 'c + d', 'b + d')}, 6) as distance,
  round(least(1, exp(-(a / 10 + 0.1) / 2) / sqrt(2 * pi() * (a / 10 + 0.1))), 6) as density from t
"""


@query
def genotype_names(spark: SparkSession, d: str) -> DataFrame:
    rows = observed(spark, d).groupBy("ref_code", "code").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("ref_code", "code", codes.genotype_code(F.col("ref_code"), F.col("code")).alias("genotype"), "n")


ORACLES["genotype_names"] = _OBSERVED + "select ref_code, code, cast(4 * least(ref_code, code) - least(ref_code, code) * (least(ref_code, code) - 1) / 2 + greatest(ref_code, code) - least(ref_code, code) as int) as genotype, count(*) as n from obs group by ref_code, code"


def _called_sites(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    counts = pileup.indel_pileup(observed_indels(spark, d))
    piled = pileup.with_indel_saturation(pileup.pileup(observed(spark, d)), counts)
    top = pileup.top_indels(counts)
    return piled, top, reference.chunks_of_bases(reference_bases(spark, d))


@query
def genotype_calls(spark: SparkSession, d: str) -> DataFrame:
    calls = candidates.genotyped(candidates.sites(*_called_sites(spark, d)))
    digits = [candidates.scientific(F.col(c)).alias(c) for c in ("best_p", "second_p", "p_d")]
    return calls.select("chrom", "pos", "ref", "gt", *digits)


def _model_sql() -> str:
    """SQL of the sixteen likelihoods, posteriors and the call, for sites (chrom, pos, ref_code, w array of 6)."""
    spec = []  # genotype, allele, other allele, kind of count, share expected, exponent
    for g, (a, b) in enumerate(codes.PAIRS):
        e = 0.0125 if a == b else 0.01
        if a == b:
            spec += [(g, a, b, "hit", 1 - e, 1.0), (g, a, b, "rest", e, 1.0)]
        else:
            spec += [(g, a, b, "half", 0.5 - e, 0.5), (g, b, a, "half", 0.5 - e, 0.5), (g, a, b, "rest", e, 1.0)]
    rows = ", ".join(f"({g}, {a + 1}, {b + 1}, '{k}', {x!r}, {y})" for g, a, b, k, x, y in spec)
    priors = ", ".join(f"({r}, {g}, {p!r}, '{codes.GENOTYPES[g]}')" for r in range(4) for g, p in enumerate(codes.genotype_prior(r)))
    return f"""
, spec(g, a, b, kind, share, k) as (values {rows}), prior(ref_code, g, prior, gt) as (values {priors}),
low as (select chrom, pos, ref_code, list_transform(w, lambda x, i: case when i = ref_code + 1 and w[5] + w[6] > 0 then greatest(0, floor(x - ((w[5] + w[6]) * 1.375 + 0.5))) else x end) as w from site),
tot as (select *, list_sum(w) as n, floor(list_sum(w) * 0.5 + 0.5) as half from low),
ask as (select chrom, pos, ref_code, g, k, cast(case kind when 'rest' then greatest(0, n - w[a] - case when a = b then 0 else w[b] end) else w[a] end as bigint) as t,
  cast(case kind when 'half' then half else n end as bigint) as n, share from tot, spec),
exp as (select *, cast(floor(cast(n as float) * cast(share as float) + cast(0.5 as float)) as bigint) as e from ask),
dis as (select t, n, e, {_fisher_sql('t', 'n', 'e', 'n', '(1 + 1e-9)')} as p from (select distinct t, n, e from exp)),
lns as (select chrom, pos, ref_code, g, min(p) as low, sum(k * case when p > 0 then ln(p) end) as ln from exp join dis using (t, n, e) group by chrom, pos, ref_code, g),
lik as (select *, case when low <= 0 or ln < -1500 * ln(2.0) then 0.0 else least(1.0, greatest(exp(ln), 2.2250738585072014e-308)) end as l from lns),
pst as (select *, sum(l) over (partition by chrom, pos) as p_d, l / nullif(sum(l) over (partition by chrom, pos), 0) * prior as q from lik join prior using (ref_code, g)),
rnk as (select *, row_number() over (partition by chrom, pos order by q desc nulls last, g) as i from pst)
select chrom, pos, substr('ACGT', cast(ref_code + 1 as bigint), 1) as ref, case when max(p_d) = 0 then substr('ACGT', cast(ref_code + 1 as bigint), 1) || substr('ACGT', cast(ref_code + 1 as bigint), 1) else max(gt) filter (i = 1) end as gt,
  printf('%.4e', coalesce(max(q) filter (i = 1), 0)) as best_p, printf('%.4e', coalesce(max(q) filter (i = 2), 0)) as second_p, printf('%.4e', max(p_d)) as p_d from rnk group by chrom, pos, ref_code
"""


ORACLES["genotype_calls"] = _INDELS + f"""
, a as (select chrom, greatest(pos - 1, 1) as pos, kind, length, seq, hq, lq from cnt),
k as (select *, row_number() over (partition by chrom, pos order by hq + lq desc, kind desc, length, seq) as place from a),
x as (select chrom, pos, coalesce(max(4 * hq) filter (place = 1), 0) as x, coalesce(max(4 * hq) filter (place = 2), 0) as y from k where place <= 2 group by chrom, pos),
p as (select chrom, pos, {', '.join(f"coalesce(sum(weight) filter (code = {k}), 0) as w{k}" for k in range(4))} from obs group by chrom, pos),
site as (select r.chrom, r.pos, r.ref_code, list_transform([coalesce(w0, 0), coalesce(w1, 0), coalesce(w2, 0), coalesce(w3, 0), coalesce(x, 0), coalesce(y, 0)], lambda v: cast(v as double)) as w
  from ({_REFERENCE}) r left join p on r.chrom = p.chrom and r.pos = p.pos left join x on r.chrom = x.chrom and r.pos = x.pos where p.pos is not null or x.pos is not null)
""" + _model_sql()


@query
def genotype_unbacked(spark: SparkSession, d: str) -> DataFrame:
    """Indel calls without an indel; none are expected."""
    calls = candidates.unbacked_calls(candidates.genotyped(candidates.sites(*_called_sites(spark, d))))
    return calls.agg(F.count(F.lit(1)).alias("n"))


def _unbacked_sql() -> str:
    called = ORACLES["genotype_calls"].replace("coalesce(max(4 * hq) filter (place = 2), 0) as y from k", "coalesce(max(4 * hq) filter (place = 2), 0) as y, max(place) as backing from k")
    at = called.rindex("\nselect chrom, pos, substr(") if "\nselect chrom, pos, substr(" in called else called.rindex("select chrom, pos, substr(")
    return called[:at] + """, named as (select chrom, pos, case when max(p_d) = 0 then '' else max(gt) filter (i = 1) end as gt from rnk group by chrom, pos)
select count(*) as n from named left join (select chrom, pos, backing from x) b using (chrom, pos)
  where (gt like '%X%' and coalesce(backing, 0) < 1) or (gt like '%Y%' and coalesce(backing, 0) < 2)"""


ORACLES["genotype_unbacked"] = _unbacked_sql()


def _enriched(spark: SparkSession, d: str, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    piled, top, chunks = _called_sites(spark, d)
    piled, chunks = materialized(piled), materialized(chunks)
    found = candidates.candidates(piled, top, chunks)
    return candidates.enriched(found, piled, reference.base_runs(reference_bases(spark, d)), strict), chunks


@query
def candidate_lines(spark: SparkSession, d: str) -> DataFrame:
    return candidates.tsv_rows(_enriched(spark, d)[0])


@query
def candidate_vcf(spark: SparkSession, d: str) -> DataFrame:
    return vcf.to_vcf(*_enriched(spark, d))


@query
def candidate_genotypes(spark: SparkSession, d: str) -> DataFrame:
    """Alleles, quality and sample column of the VCF records."""
    return candidate_vcf(spark, d).select("chrom", "pos", "ref_allele", "alt", "qual", "sample_call")


def _records_sql() -> str:
    """SQL of the records' alleles, quality and sample column, from the called sites on."""
    site, model = ORACLES["genotype_calls"].split("\n, spec(", 1)
    model = "\n, spec(" + model[: model.index("\nselect chrom, pos, substr")]
    four = lambda x: f"cast(printf('%.4e', {x}) as double)"
    names = "[" + ", ".join(f"'{g}'" for g in codes.GENOTYPES) + "]"
    at = lambda array, allele: f"{array}[list_position(['A', 'C', 'G', 'T', 'X', 'Y'], {allele})]"
    own, base = at("reads", "ref"), "reads[1] + reads[2] + reads[3] + reads[4] + th + tl"
    one_ref, one_alt = "case when k1 = 'D' then ref || q1 else ref end", "case when k1 = 'D' then ref else ref || q1 end"
    long, short = "case when l1 >= l2 then q1 else q2 end", "case when l1 >= l2 then q2 else q1 end"
    rest = f"(substr({long}, 1, strpos({long}, {short}) - 1) || substr({long}, strpos({long}, {short}) + length({short})))"
    two_ref = f"case k1 || k2 when 'DD' then case when l1 <> l2 and strpos({long}, {short}) > 0 then ref || {long} end when 'II' then ref when 'ID' then ref || q2 else ref || q1 end"
    two_alt = f"case k1 || k2 when 'DD' then ref || ',' || ref || {rest} when 'II' then ref || q1 || ',' || ref || q2 when 'ID' then ref || ',' || ref || q2 || q1 else ref || ',' || ref || q1 || q2 end"
    indel, het, hom = "gt like '%X%'", "(gt like '%' || ref || '%' and g1 <> g2)", "g1 = g2"
    plan = [  # when, alts, counted, genotype, depth, REF, ALT
        (f"not {indel} and {hom}", "[a]", "[a]", "1/1", base, "ref", "a"), (f"not {indel} and {het}", "[a]", "[ref, a]", "0/1", base, "ref", "a"),
        (f"not {indel} and not {het} and not {hom}", "[a, b]", "[a, b]", "1/2", base, "ref", "a || ',' || b"), (f"{indel} and {hom}", "['X']", "['X']", "1/1", f"{base} - {own}", one_ref, one_alt),
        (f"{indel} and {het}", "['X']", "[ref, 'X']", "0/1", f"{base} - {own} // 2", one_ref, one_alt), ("gt = 'XY'", "['X', 'Y']", "['X', 'Y']", "1/2", f"{base} - {own}", two_ref, two_alt),
        (f"{indel} and not {het} and not {hom} and gt <> 'XY'", "['X']", "['X']", "0/1", f"{base} - {own}", one_ref, one_alt),
        (f"{indel} and not {het} and not {hom} and gt <> 'XY'", "[a]", "[a]", "0/1", f"{base} - {own}", "ref", "a"),
    ]
    records = " union all ".join(f"select *, {alts} as alts, {cnt} as cnt, '{gt}' as gtx, {dp} as dp, {r} as ref_allele, {alt} as alt from j where {when}" for when, alts, cnt, gt, dp, r, alt in plan)
    share = f"coalesce({four('qs[coalesce(list_position({0}, p), list_position({0}, reverse(p)))]'.format(names))} / opt, 0)"
    phred = f"cast(case when {share} = 0 then 3080 else trunc(-10 * log10(least({share}, 1.0))) end as int)"
    pairs = "case when len(alts) = 1 then [ref || ref, ref || alts[1], alts[1] || alts[1]] else [ref || ref, ref || alts[1], ref || alts[2], alts[1] || alts[1], alts[1] || alts[2], alts[2] || alts[2]] end"
    counts = "select chrom, pos, " + ", ".join([f"coalesce(sum(weight) filter (code = {k}), 0) as w{k}, count(*) filter (code = {k}) as n{k}" for k in range(4)]) + " from obs group by chrom, pos"
    pick = ", ".join(f"max({c}) filter (place = {i}) as {n}{i}" for i in (1, 2) for c, n in (("kind", "k"), ("length", "l"), ("seq", "q"), ("hq", "h"), ("lq", "o")))
    gone = lambda i: f"case when k{i} = 'D' then substr(s, cast(j0.pos + 1 - lo + 1 as bigint), l{i}) else q{i} end"
    return site + model + f"""
, cal as (select chrom, pos, ref_code, max(gt) filter (i = 1) as gt, {four('max(q) filter (i = 1)')} as opt, {four('max(q) filter (i = 2)')} as sub, list(q order by g) as qs from rnk group by chrom, pos, ref_code),
sx as (select chrom, min(pos) as lo, string_agg(substr('ACGT', cast(ref_code + 1 as bigint), 1), '' order by pos) as s from ({_REFERENCE}) group by chrom),
tk as (select chrom, pos, sum(hq) as th, sum(lq) as tl from a group by chrom, pos), ik as (select chrom, pos, {pick} from k where place <= 2 group by chrom, pos), pc as ({counts}),
j0 as (select cal.*, ik.* exclude (chrom, pos), coalesce(th, 0) as th, coalesce(tl, 0) as tl, substr('ACGT', cast(ref_code + 1 as bigint), 1) as ref, gt[1] as g1, gt[2] as g2,
  [coalesce(n0, 0), coalesce(n1, 0), coalesce(n2, 0), coalesce(n3, 0), coalesce(h1 + o1, 0), coalesce(h2 + o2, 0)] as reads,
  [coalesce(w0, 0), coalesce(w1, 0), coalesce(w2, 0), coalesce(w3, 0), coalesce(4 * h1, 0), coalesce(4 * h2, 0)] as depth
  from cal left join ik on cal.chrom = ik.chrom and cal.pos = ik.pos left join tk on cal.chrom = tk.chrom and cal.pos = tk.pos left join pc on cal.chrom = pc.chrom and cal.pos = pc.pos),
j as (select j0.* replace ({gone(1)} as q1, {gone(2)} as q2), case when g1 = ref then g2 else g1 end as a, g2 as b, lo, s from j0 join sx on j0.chrom = sx.chrom
  where gt <> ref || ref and opt > 0 and sub > 0 and (gt not like '%X%' or k1 is not null) and (gt not like '%Y%' or k2 is not null)),
rec as ({records}),
num as (select *, list_sum(list_transform(cnt, lambda x: {at('depth', 'x')})) as nom, list_sum(list_transform(cnt, lambda x: {at('reads', 'x')})) as den, {pairs} as pairs from rec where ref_allele is not null),
fin as (select *, -4.343 * ln(sub / opt) * (1 - log2(5 - nom / den) / log2(5)) as qu from num where den > 0 and substr(s, cast(pos - lo + 1 as bigint), length(ref_allele)) = ref_allele)
select chrom, pos, ref_allele, alt, round(qu, 1) as qual, concat_ws(':', gtx, array_to_string(list_transform(list_concat([ref], alts), lambda x: {at('reads', 'x')}), ','), dp,
  cast(floor(nom * 10 / den + 0.499) as bigint), array_to_string(list_transform(pairs, lambda p: {phred}), ',')) as sample_call from fin
"""


ORACLES["candidate_genotypes"] = _records_sql()


def _flanks(spark: SparkSession, d: str, strict: bool) -> DataFrame:
    totals = pileup.site_totals(pileup.pileup(observed(spark, d)))
    sites = totals.select("chrom", "pos", (F.col("pos") % 3).alias("skip"))
    out = flanks.flank_metrics(sites, totals, strict)
    return out.select("chrom", "pos", "skip", *[F.round(c, 6).alias(c) for c in ("read_pos_bias", "left_gc", "right_gc", "depth_balance", "left_quality", "right_quality")], "left_g", "right_g")


@query
def flank_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _flanks(spark, d, False)


@query
def flank_metrics_strict(spark: SparkSession, d: str) -> DataFrame:
    return _flanks(spark, d, True)


def _flanks_sql(shift: int, sites: str = "select chrom, pos, pos % 3 as skip from base", digits: int = 6) -> str:
    left = f"p.pos >= n.pos - 100 - {shift} and p.pos < n.pos - {shift}"
    right = f"p.pos >= n.pos + n.skip - {shift} and p.pos < n.pos + n.skip + 100 - {shift}"
    tight = f"p.pos >= n.pos - 3 - {shift} and p.pos < n.pos - {shift}", f"p.pos >= n.pos + n.skip - {shift} and p.pos < n.pos + n.skip + 3 - {shift}"
    sums = ", ".join(f"coalesce(sum(p.{c}) filter ({w}), 0) as {s}_{c}" for s, w in (("l", left), ("r", right)) for c in ("depth", "weight", "gc", "delta"))
    ratio = lambda a, b: f"case when {a} + {b} > 0 then ({a} - {b}) / ({a} + {b}) else 0 end"
    mean = lambda s, c: f"case when {s}_n > 0 then {s}_{c} / {s}_n else 0 end"
    return _PILED + f"""
, base as (select chrom, pos, forward + reverse as depth, weight, gc, g from piled),
every as (select chrom, pos from base union select chrom, pos - 1 from base),
pos as (select e.chrom, e.pos, coalesce(b.depth, 0) as depth, coalesce(b.weight, 0) as weight, coalesce(b.gc, 0) as gc, coalesce(b.g, 0) as g, abs(coalesce(b.depth, 0) - coalesce(c.depth, 0)) as delta
  from every e left join base b on e.chrom = b.chrom and e.pos = b.pos left join base c on e.chrom = c.chrom and e.pos + 1 = c.pos),
n as ({sites}),
s as (select n.chrom, n.pos, n.skip, {sums}, coalesce(sum(p.g) filter ({tight[0]}), 0) as l_g, coalesce(sum(p.g) filter ({tight[1]}), 0) as r_g,
  100 - least(greatest(1 - (n.pos - 100 - {shift}), 0), 100) as l_n, 100 - least(greatest(1 - (n.pos + n.skip - {shift}), 0), 100) as r_n
  from n left join pos p on n.chrom = p.chrom and p.pos between n.pos - 300 and n.pos + 300 group by n.chrom, n.pos, n.skip)
select chrom, pos, skip, round({ratio('l_delta', 'r_delta')}, {digits}) as read_pos_bias, round({mean('l', 'gc')}, {digits}) as left_gc, round({mean('r', 'gc')}, {digits}) as right_gc,
  round({ratio('(' + mean('l', 'depth') + ')', '(' + mean('r', 'depth') + ')')}, {digits}) as depth_balance, round(case when l_depth > 0 then l_weight / l_depth else 0 end, {digits}) as left_quality,
  round(case when r_depth > 0 then r_weight / r_depth else 0 end, {digits}) as right_quality, cast(l_g as int) as left_g, cast(r_g as int) as right_g from s
"""


ORACLES["flank_metrics"] = _flanks_sql(0)
ORACLES["flank_metrics_strict"] = _flanks_sql(100)


def _enriched_sql() -> str:
    """SQL of the called sites with their biases, flanks and runs, from the records' SQL on."""
    biases = f"""
, bb as (select chrom, pos, code, least(1.0, {_fisher_sql('f', 'r', '((f + r) // 2)', '((f + r) // 2)', '(1 - 1e-7)')}) as sb,
  least(1.0, {_fisher_sql('w', '(4 * (f + r))', '(4 * (f + r))', '(4 * (f + r))', '(1 - 1e-7)')}) as bq from l where {{near}}),
bl as (select chrom, pos, list(sb order by code) as sb, list(bq order by code) as bq from bb group by chrom, pos)"""
    keys = ", key as (select chrom, pos, case when gt like '%X%' and k1 = 'D' then l1 else 0 end as skip, gt like '%X%' as is_indel from {sites}), near as (select chrom, unnest([pos - 1, pos, pos + skip]) as pos from key)"
    flanks = _flanks_sql(0, "select chrom, pos, skip from key", 15)[len(_PILED) :]
    at = flanks.rindex("\nselect chrom, pos, skip, round(")
    runs = ORACLES["reference_runs"]
    ones = "[1.0, 1.0, 1.0, 1.0]"
    role = lambda c, k: f"coalesce({k}.{c}, {ones})"
    return (
        _PILED[len(_OBSERVED) :] + keys + _ALLELES + biases.replace("{near}", "exists (select 1 from near where near.chrom = l.chrom and near.pos = l.pos)")
        + flanks[:at] + ", fl as (" + flanks[at + 1 :] + "), rr as (" + runs + f""")
, en as (select key.chrom, key.pos, key.skip, key.is_indel, fl.* exclude (chrom, pos, skip), coalesce(least(rr.end_pos - rr.first_pos, 65535), 0) as hrun,
  [f0, f1, f2, f3] as f, [r0, r1, r2, r3] as r, [w0, w1, w2, w3] as w,
  case when is_indel then {role('sb', 'bp')} else {role('sb', 'bo')} end as sb, case when is_indel then {role('sb', 'ba')} end as sb1, case when is_indel then {role('sb', 'bo')} end as sb2,
  case when is_indel then {role('bq', 'bp')} else {role('bq', 'bo')} end as bq, case when is_indel then {role('bq', 'ba')} end as bq1, case when is_indel then {role('bq', 'bo')} end as bq2
  from key join fl on fl.chrom = key.chrom and fl.pos = key.pos and fl.skip = key.skip left join (select chrom, pos, {', '.join(f'{x}{k} as {x}{k}' for x in 'fr' for k in range(4))}, {', '.join(f'w{k}' for k in range(4))} from piled) pl on pl.chrom = key.chrom and pl.pos = key.pos
  left join rr on rr.chrom = key.chrom and key.pos >= rr.first_pos and key.pos < rr.end_pos left join bl bp on bp.chrom = key.chrom and bp.pos = key.pos - 1
  left join bl bo on bo.chrom = key.chrom and bo.pos = key.pos left join bl ba on ba.chrom = key.chrom and ba.pos = key.pos + key.skip)"""
    )


def _vcf_sql() -> str:
    records = _records_sql()
    at = records.rindex("\nselect chrom, pos, ref_allele, alt, round(qu, 1)")
    sample = records[at + 1 :]
    call = sample[sample.index("concat_ws(") : sample.index(" as sample_call")]
    four = lambda x: f"cast(printf('%.4e', {x}) as double)"
    place = lambda allele: f"list_position(['A', 'C', 'G', 'T', 'X', 'Y'], {allele})"
    low = lambda c: f"{four(f'least(list_min({c}1), list_min({c}2), 1.0)')}"
    six = lambda c: f"case when is_indel then list_concat(list_transform({c}, lambda x: {four('x')}), [{low(c)}, {low(c)}]) else list_concat(list_transform({c}, lambda x: {four('x')}), [1.0, 1.0]) end"
    phred = lambda x: f"case when {x} = 0 then 3080 else cast(floor(-10 * log10({x})) as int) end"
    bias = lambda key, c: [f"case when has_ref then '{key}Ref=' || ({phred(f'{c}[{place('ref')}]')}) end", f"'{key}Alt=' || ({phred(f'{c}[{place('alts[1]')}]')})", f"'{key}Alt2=' || ({phred(f'{c}[{place('alts[2]')}]')})"]
    five = lambda x: f"printf('%.5f', round({x}, 4))"
    cent = lambda c, k: f"cast(trunc(round({c}, 4) * {k}) as bigint)"
    meta = "concat_ws(',', " + ", ".join(f"case when is_indel and k{i} is not null then concat_ws(',', l{i} || k{i}, q{i}, h{i}, o{i}) else '*,*,*,*' end" for i in (1, 2)) + ")"
    odds = lambda v, a: f"(coalesce({v}[{place(a)}], 0) + 1.0)"
    x, y = "case when gtx = '1/2' then alts[1] else ref end", "case when gtx = '1/2' then alts[2] else alts[1] end"
    a, b, c, d = odds("f", x), odds("r", x), odds("f", y), odds("r", y)
    sor = f"ln(({a} * {d} / ({b} * {c}) + {b} * {c} / ({a} * {d})) * (least({a}, {b}) / greatest({a}, {b})) / (least({c}, {d}) / greatest({c}, {d})))"
    entries = [
        "case when alts[1] = 'X' then 'INDEL' end", "'AC=' || case gtx when '1/1' then '2' when '0/1' then '1' else '1,1' end", "'AF=' || case gtx when '1/1' then '1' when '0/1' then '0.5' else '0.500,0.500' end",
        "'AN=2'", f"'FRAC=' || case when has_ref and gtx = '0/1' then printf('%.3f', round(reads[{place('alts[1]')}] / (reads[{place('alts[1]')}] + reads[{place('ref')}]), 3)) else '1.000' end",
        *bias("BQFisherPhred", "bq6"), "'BestGT=' || gt", "'DP=' || cast(dp as bigint)", "'DP4=' || array_to_string(reads[1:4], ',')",
        "'DP8=' || concat_ws(',', " + ", ".join(f"coalesce({v}[{i}], 0)" for i in range(1, 5) for v in "fr") + ")", f"'IndelMeta=' || {meta}", *bias("SBFisherPhred", "sb6"), "'QD=' || printf('%.3f', round(nom * 10 / den, 3))",
        f"'ReadPosBias=' || {five('read_pos_bias')}", f"'DepthBias=' || {five('depth_balance')}", f"case when not is_indel then 'SOR=' || printf('%.5f', {sor}) end",
        f"'LeftGCPercent=' || {cent('left_gc', 100)}", f"'RightGCPercent=' || {cent('right_gc', 100)}", f"'LeftQuality=' || {cent('left_quality', 10)}", f"'RightQuality=' || {cent('right_quality', 10)}",
        "'OptSuboptRatio=' || cast(floor(10 * log10(opt / sub)) as int)", "'LeftG=' || left_g", "'RightG=' || right_g", "'HRun=' || hrun", "'IHDP=' || th", "'ILDP=' || tl",
    ]
    return records[:at] + _enriched_sql().replace("{sites}", "j") + f"""
, sx6 as (select chrom, pos, {six('sb')} as sb6, {six('bq')} as bq6 from en),
all_of as (select fin.*, en.* exclude (chrom, pos), sb6, bq6, list_contains(cnt, ref) as has_ref from fin join en on en.chrom = fin.chrom and en.pos = fin.pos join sx6 on sx6.chrom = fin.chrom and sx6.pos = fin.pos)
select chrom, pos, '.' as id, ref_allele, alt, round(qu, 1) as qual, '.' as filter_tag, concat_ws(';', {', '.join(entries)}) as info, 'GT:AD:DP:GQ:PL' as format_keys, {call} as sample_call from all_of
"""


def _lines_sql() -> str:
    """SQL of the table of 98 columns, from the called sites on."""
    records = _records_sql()
    at = records.index("\nrec as (")
    sites = records[:at].replace("coalesce(th, 0) as th", "pd, coalesce(th, 0) as th").replace("list(q order by g) as qs from rnk", "max(p_d) as pd, list(q order by g) as qs, list(q order by g) as post, list(l order by g) as lik, max(q) filter (i = 1) as q1st, max(q) filter (i = 2) as q2nd from rnk")
    sites = sites.replace("\n  where gt <> ref || ref and opt > 0 and sub > 0 and", "\n  where gt <> ref || ref and pd > 0 and").rstrip().rstrip(",")
    e4, dec = lambda x: f"printf('%.4e', {x})", lambda x: f"printf('%.4f', round({x}, 4))"
    star = lambda x: f"coalesce(cast({x} as varchar), '*')"
    indel = lambda i: [star(f"case when is_indel then {x} end") for x in (f"l{i} || k{i}", f"q{i}", f"h{i}", f"o{i}")]
    cells = [
        "j.chrom", "j.pos", "ref", "case when is_indel then ref else '*' end", *[e4(f"coalesce(post[{i}], 0)") for i in range(1, 17)], "gt", e4("q1st"), e4("q2nd"), e4("pd"), "'0.0000e+00'", "'0'", *indel(1), *indel(2),
        "cast(coalesce(list_sum(w), 0) as bigint)", *[f"coalesce(w[{k}], 0)" for k in range(1, 5)], *[f"coalesce({x}[{k}], 0)" for k in range(1, 5) for x in "fr"], *[e4(f"lik[{i}]") for i in range(1, 17)],
        *[star(f"case when {c} is not null then {e4(f'{c}[{k}]')} end") for c in ("sb", "sb1", "sb2", "bq", "bq1", "bq2") for k in range(1, 5)],
        dec("read_pos_bias"), dec("left_gc"), dec("right_gc"), "left_g", "right_g", dec("depth_balance"), dec("left_quality"), dec("right_quality"), "hrun", "th", "tl",
    ]
    return sites + _enriched_sql().replace("{sites}", "j") + f" select j.chrom, j.pos, concat_ws(chr(9), {', '.join(cells)}) as line from j join en on en.chrom = j.chrom and en.pos = j.pos"


@query
def neighbour_biases(spark: SparkSession, d: str) -> DataFrame:
    """Biases at every position as if an indel of its own length began there: before, behind and at it."""
    piled = pileup.pileup(observed(spark, d))
    sites = piled.select("chrom", "pos", (F.col("pos") % 3).alias("skip"), F.lit(True).alias("is_indel"))
    found = flanks.neighbour_biases(sites, piled)
    each = F.arrays_zip(*[F.col(c) for c in ("sb", "sb1", "sb2", "bqb", "bqb1", "bqb2")])
    cells = found.select("chrom", "pos", F.posexplode(each).alias("code", "x"))
    return cells.select("chrom", "pos", "code", *[F.round(f"x.{c}", 6).alias(c) for c in ("sb", "sb1", "sb2", "bqb", "bqb1", "bqb2")])


_BIASED = ORACLES["bias_by_base"].replace(" select chrom, pos, cast(code as int)", ", bb as (select chrom, pos, cast(code as int)") + ")"
ORACLES["neighbour_biases"] = _BIASED + """
, s as (select chrom, pos, pos % 3 as skip, unnest([0, 1, 2, 3]) as code from piled)
select s.chrom, s.pos, s.code, coalesce(a.sb, 1.0) as sb, coalesce(b.sb, 1.0) as sb1, coalesce(c.sb, 1.0) as sb2, coalesce(a.bqb, 1.0) as bqb, coalesce(b.bqb, 1.0) as bqb1, coalesce(c.bqb, 1.0) as bqb2
from s left join bb a on a.chrom = s.chrom and a.code = s.code and a.pos = s.pos - 1 left join bb b on b.chrom = s.chrom and b.code = s.code and b.pos = s.pos + s.skip
  left join bb c on c.chrom = s.chrom and c.code = s.code and c.pos = s.pos
"""


@query
def reference_runs(spark: SparkSession, d: str) -> DataFrame:
    return reference.base_runs(reference_bases(spark, d), tile=64).withColumnsRenamed({"start": "first_pos", "end": "end_pos"})


ORACLES["reference_runs"] = f"""
with b as ({_REFERENCE}), k as (select *, pos - row_number() over (partition by chrom, ref_code order by pos) as grp from b)
select chrom, min(pos) as first_pos, max(pos) + 1 as end_pos, ref_code from k group by chrom, ref_code, grp
"""


ORACLES["candidate_vcf"], ORACLES["candidate_lines"] = _vcf_sql(), _lines_sql()


@query
def reference_previous(spark: SparkSession, d: str) -> DataFrame:
    return reference.previous_base(reference_bases(spark, d))


ORACLES["reference_previous"] = f"""
with b as ({_REFERENCE}) select b.chrom, b.pos, b.ref_code, coalesce(c.ref_code, 4) as pre_code from b left join b c on b.chrom = c.chrom and b.pos = c.pos + 1
"""


@query
def reference_check(spark: SparkSession, d: str) -> DataFrame:
    """Observed bases that the reference chunks hold at their position, and the base after it."""
    chunks = reference.chunks_of_bases(reference_bases(spark, d))
    seen = observed(spark, d).groupBy("chrom", "pos", "code").agg(F.count(F.lit(1)).alias("n"))
    got = reference.slices(seen, chunks, {"here": (F.lit(0), F.lit(1)), "pair": (F.lit(0), F.lit(2))})
    return got.where(F.substring(F.lit("ACGT"), F.col("code") + 1, F.lit(1)) == F.col("here")).select("chrom", "pos", "n", "pair")


ORACLES["reference_check"] = _OBSERVED + f"""
, b as ({_REFERENCE}), s as (select chrom, pos, code, count(*) as n from obs group by chrom, pos, code)
select s.chrom, s.pos, n, substr('ACGT', cast(b.ref_code + 1 as bigint), 1) || coalesce(substr('ACGT', cast(c.ref_code + 1 as bigint), 1), '') as pair
from s join b on s.chrom = b.chrom and s.pos = b.pos and s.code = b.ref_code left join b c on c.chrom = b.chrom and c.pos = b.pos + 1
"""


@query
def vcf_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Phred, quality and odds ratio of line items' numbers."""
    l = table(spark, d, "lineitem")
    n = F.col("l_linenumber")
    strands = (n, 8 - n, F.col("l_quantity"), F.lit(50) - F.col("l_quantity"))
    return l.select(
        "l_orderkey", "l_linenumber", vcf_math.phred(F.col("l_discount")).alias("phred"), vcf_math.phred_ratio(F.col("l_quantity")).alias("ratio"),
        F.round(vcf_math.qual(F.col("l_tax") + 0.001, F.lit(0.5), F.col("l_quantity"), F.lit(15)), 6).alias("qual"), F.round(vcf_math.sor(*strands), 6).alias("sor"),
        vcf_math.max_depth(F.col("l_quantity")).cast("long").alias("max_dp"),
    )


ORACLES["vcf_numbers"] = """
with l as (select *, l_linenumber + 1.0 as a, 9.0 - l_linenumber as b, l_quantity + 1 as c, 51 - l_quantity as d from lineitem)
select l_orderkey, l_linenumber, case when l_discount = 0 then 3080 else cast(floor(-10 * log10(l_discount)) as int) end as phred, cast(floor(10 * log10(l_quantity)) as int) as ratio,
  round(case when l_quantity / 15 < 5 then -4.343 * ln((l_tax + 0.001) / 0.5) * (1 - log2(5 - l_quantity / 15) / log2(5)) end, 6) as qual,
  round(ln((a * d / (b * c) + b * c / (a * d)) * (least(a, b) / greatest(a, b)) / (least(c, d) / greatest(c, d))), 6) as sor,
  cast(floor(l_quantity + 5 * sqrt(l_quantity) + 0.51) as bigint) as max_dp from l
"""

# filtering and annotation of calls


def _named_calls(spark: SparkSession, d: str) -> DataFrame:
    return with_sequence(table(spark, d, "vcf"), table(spark, d, "seq_dict")).drop("chrom").withColumnRenamed("seq_name", "chrom")


@query
def calls_by_sequence(spark: SparkSession, d: str) -> DataFrame:
    return _named_calls(spark, d).groupBy("chrom").agg(F.count(F.lit(1)).alias("n"), F.max("pos").alias("last"))


_CALLS = "select v.* replace (s.chrom as chrom) from vcf v join seq_dict s on lower(trim(v.chrom)) in (lower(trim(s.chrom)), lower(trim(s.short_name)))"
ORACLES["calls_by_sequence"] = f"select chrom, count(*) as n, max(pos) as last from ({_CALLS}) group by chrom"


@query
def calls_mode_depth(spark: SparkSession, d: str) -> DataFrame:
    return vcf_filter.mode_depth(table(spark, d, "vcf"), "run_id").withColumnRenamed("group", "run_id")


_FIELD = lambda k, w="[^;|,\\s]*": f"nullif(regexp_extract(info, '(?:^|[;|,\\s]){k}\\s*=\\s*({w})', 1), '')"
_MODES = f"""
with dp as (select run_id, try_cast({_FIELD('DP')} as bigint) as dp from vcf), c as (select run_id, dp, count(*) as n from dp where dp is not null group by run_id, dp),
modes as (select run_id, arg_max(dp, (n, dp)) as mode_dp from c group by run_id)
"""
ORACLES["calls_mode_depth"] = _MODES + "select run_id, mode_dp from modes"


@query
def calls_known(spark: SparkSession, d: str) -> DataFrame:
    return vcf_filter.annotated(_named_calls(spark, d), table(spark, d, "dbsnp"), "rec_id").withColumnRenamed("ident", "rec_id")


_KNOWN = f"""
, calls as ({_CALLS}),
al as (select snp_id, lower(trim(chrom)) as chrom, pos, ref_allele, rsid, unnest(regexp_extract_all(alt, '<[^<>]*>|[^,;|/\\s"'']+')) as alt from dbsnp),
la as (select chrom, pos, ref_allele, alt, arg_max(coalesce(rsid, ''), snp_id) as rsid from al group by chrom, pos, ref_allele, alt),
ca as (select rec_id, lower(chrom) as chrom, pos, ref_allele, unnest(string_split(alt, ',')) as alt from calls),
kn as (select rec_id, string_agg(distinct rsid, ',' order by rsid) as rsids from ca join la using (chrom, pos, ref_allele, alt) where rsid <> '' group by rec_id)
"""
ORACLES["calls_known"] = _MODES + _KNOWN + "select rec_id, rsids from kn"


@query
def calls_filtered(spark: SparkSession, d: str) -> DataFrame:
    return vcf_filter.filter_vcf(_named_calls(spark, d), table(spark, d, "dbsnp"), "rec_id", "run_id").withColumnRenamed("ident", "rec_id")


@query
def calls_filter_summary(spark: SparkSession, d: str) -> DataFrame:
    return vcf_filter.filter_summary(vcf_filter.filter_vcf(_named_calls(spark, d), table(spark, d, "dbsnp"), "rec_id", "run_id"))


_TAGS = _MODES + _KNOWN + f"""
, f as (select c.rec_id, coalesce(c.id, '.') as own_id, c.alt, case when isnan(c.qual) then null else c.qual end as qual, m.mode_dp, coalesce(regexp_matches(info, '(?:^|[;|,\\s])INDEL(?:[;|,\\s]|$)'), false) as indel,
  try_cast({_FIELD('DP')} as double) as dp, try_cast({_FIELD('FRAC')} as double) as frac, try_cast({_FIELD('QD')} as double) as qd, try_cast({_FIELD('SBFisherPhredAlt')} as double) as fs,
  try_cast({_FIELD('SOR')} as double) as odds, regexp_split_to_array(regexp_extract(info, '(?:^|[;|,\\s])DP8\\s*=\\s*([0-9.]+(?:[,;|/\\s]+[0-9.]+){{7}})', 1), '[,;|/\\s]+') as s
  from calls c left join modes m on c.run_id = m.run_id),
t as (select *, concat_ws(';', case when qual < 10 then 'QUALlow' end, case when dp > floor(mode_dp + 5 * sqrt(mode_dp) + 0.51) then 'DPhigh' end, case when dp < 3 then 'DPlow' end,
  case when indel and fs > 30 then 'FShigh' end, case when not indel and odds > 3 then 'SORhigh' end, case when not indel and odds is null and fs > 30 then 'FShigh' end,
  case when frac < case when indel then 0.15 else 0.3 end then 'FRAClow' end, case when qd < case when indel then 20 else 24 end then 'QDlow' end,
  case when not indel and list_bool_or(list_transform(string_split(alt, ','), lambda b: coalesce(try_cast(s[list_position(['A', 'C', 'G', 'T'], b) * 2 - 1] as double) < 1, false)
    or coalesce(try_cast(s[list_position(['A', 'C', 'G', 'T'], b) * 2] as double) < 1, false))) then 'SClow' end) as tags from f),
r as (select t.rec_id, coalesce(rsids, own_id) as id, case when tags = '' or coalesce(rsids, own_id) <> '.' then '.' else tags end as filter_tag from t left join kn on t.rec_id = kn.rec_id)
"""
ORACLES["calls_filtered"] = _TAGS + "select * from r"
ORACLES["calls_filter_summary"] = _TAGS + "select filter_tag, count(*) as n from r group by filter_tag"


@query
def calls_hwe(spark: SparkSession, d: str) -> DataFrame:
    """Exact equilibrium test of each sequence's genotypes, heterozygous against the two homozygous kinds."""
    gt = F.replace(F.get(F.split("sample_call", ":"), F.lit(0)), F.lit("|"), F.lit("/"))
    counts = _named_calls(spark, d).withColumn("gt", gt).groupBy("chrom").agg(F.count_if(F.col("gt") == "0/1").alias("het"), F.count_if(F.col("gt") == "1/1").alias("hom"), F.count_if(F.col("gt") == "1/2").alias("other"))
    return counts.withColumn("p", F.round(stats.hwe_exact("het", "hom", "other"), 6))


ORACLES["calls_hwe"] = f"""
with c as (select chrom, replace(string_split(sample_call, ':')[1], '|', '/') as gt from ({_CALLS})),
n as (select chrom, count(*) filter (gt = '0/1') as het, count(*) filter (gt = '1/1') as hom, count(*) filter (gt = '1/2') as other from c group by chrom),
h as (select *, het + hom + other as n, 2 * least(hom, other) + het as rare from n),
x as (select *, unnest(range(rare % 2, rare + 1, 2)) as h from h),
l as (select *, lgamma(n + 1) - lgamma(h + 1) - lgamma((rare - h) // 2 + 1) - lgamma(n - h - (rare - h) // 2 + 1) + h * ln(2.0) as ln from x),
p as (select *, exp(ln - max(ln) over (partition by chrom)) as p from l),
o as (select *, max(p) filter (h = het) over (partition by chrom) as own from p)
select chrom, het, hom, other, round(least(1.0, sum(p) filter (p <= own * (1 + 1e-12)) / sum(p)), 6) as p from o group by chrom, het, hom, other
"""


@query
def calls_indel_support(spark: SparkSession, d: str) -> DataFrame:
    """Read support of the indel calls, against the reads' own consensus as reference."""
    r = _reads(spark, d)
    best = F.array_position(F.col("w"), F.array_max("w")).cast("int") - 1
    consensus = pileup.pileup(reads.aligned_bases(r)).select("chrom", "pos", best.alias("ref_code"))
    support = vcf_filter.indel_support(_named_calls(spark, d), "rec_id", r, reference.chunks_of_bases(consensus))
    return support.withColumnRenamed("ident", "rec_id")


def _support_sql() -> str:
    piled = ORACLES["reads_pileup"]
    at = piled.rindex("\nselect chrom, cast(pos as bigint) as pos, ")
    chunk = lambda p: f"(({p} - 1) // 4096)"
    held = lambda p, q: f"case when {q} <= (select z.last from lastk z where z.chrom = t.chrom and z.chunk = {chunk(p)}) then coalesce((select y.base from cons y where y.chrom = t.chrom and y.pos = {q}), 'N') end"
    return piled[:at] + ", pu as (" + piled[at + 1 :] + f"""),
cons as (select chrom, pos, case when w0 >= greatest(w1, w2, w3) then 'A' when w1 >= greatest(w2, w3) then 'C' when w2 >= w3 then 'G' else 'T' end as base from pu),
lastk as (select chrom, chunk, max(pos) as last from (select chrom, pos, {chunk('pos')} as chunk from cons
  union all select chrom, pos, {chunk('pos')} - 1 from cons where (pos - 1) % 4096 < 300 and pos > 4096) group by chrom, chunk),
rec0 as (select v.rec_id, s.chrom, v.pos, v.ref_allele, unnest(string_split(v.alt, ',')) as alt from vcf v join seq_dict s on lower(trim(v.chrom)) in (lower(trim(s.chrom)), lower(trim(s.short_name)))),
rec as (select *, case when length(alt) > length(ref_allele) then 'I' else 'D' end as kind, abs(length(alt) - length(ref_allele)) as n from rec0 where length(alt) <> length(ref_allele) and alt not like '<%'),
rd as (select read_id, chrom, pos, flag, cigar, nullif(nullif({_CLEAN}, ''), '*') as bases from aligned_reads where pos is not null and regexp_full_match(cigar, '([0-9]+[MIDNSHP=X])+')),
e0 as (select read_id, unnest(range(1, len(regexp_extract_all(cigar, '[0-9]+')) + 1)) as k, cast(unnest(regexp_extract_all(cigar, '[0-9]+')) as bigint) as len, unnest(regexp_extract_all(cigar, '[MIDNSHP=X]')) as op from rd),
e as (select *, coalesce(sum(case when op in ('M', 'D') then len end) over earlier, 0) as g, coalesce(sum(case when op in ('M', 'D', 'I', 'S') then len end) over earlier, 0) as r,
  lead(op) over (partition by read_id order by k) as nop, lead(len) over (partition by read_id order by k) as nlen from e0 window earlier as (partition by read_id order by k rows between unbounded preceding and 1 preceding)),
f as (select read_id, op as kind, len as n, min(k) as k from e where op in ('I', 'D') group by read_id, op, len having min(k) > 1),
hit as (select f.*, e.g, e.r, rd.chrom, rd.pos, rd.flag, rd.bases from f join e using (read_id, k) join rd using (read_id)),
gap as (select hit.*, (select arg_min(x.nlen, x.k) from e x where x.read_id = hit.read_id and x.k + 1 < hit.k and x.op in ('I', 'D') and x.nop = 'M') as lg,
  (select arg_min(x.len, x.k) from e x where x.read_id = hit.read_id and x.k > hit.k and x.op = 'M' and x.nop in ('I', 'D')) as rg from hit),
t0 as (select row_number() over () as h, rec.rec_id, rec.alt, rec.chrom, rec.pos, rec.kind, rec.n, least(rec.pos - 1, 15) as ld, cast(gap.r as bigint) as ro, gap.bases, gap.flag, lg, rg,
  case when lg <= 10 then lg else 10 end as lf, case when rg <= 10 then rg else 10 end as rt from rec join gap on rec.chrom = gap.chrom and rec.kind = gap.kind and rec.n = gap.n and rec.pos = gap.pos + gap.g - 1),
t as (select *, pos - ld as first_pos, pos + case when kind = 'D' then n else 0 end as last_pos, case when kind = 'I' then n else 0 end as sk, unnest(range(1, 10)) as i from t0),
b1 as (select h, i, i < lf and ld + 1 - i >= 0 and ro - i between 0 and length(bases) - 1 and ({held('t.first_pos', 't.pos + 1 - t.i')}) <> substr(bases, ro - i + 1, 1) as wl,
  i < rt and ro + sk + i between 0 and length(bases) - 1 and ({held('t.last_pos', 't.last_pos + 1 + t.i')}) <> substr(bases, ro + sk + i + 1, 1) as wr from t),
mis as (select h, bool_or(coalesce(wl, false) or coalesce(wr, false)) as wrong from b1 group by h),
cnt as (select rec_id, alt, count(*) filter ((flag & 16) = 0) as pos_count, count(*) filter ((flag & 16) <> 0) as neg_count, count(*) filter (wrong) as snp_mingle,
  sum(case when lg <= 10 then 1 else 0 end + case when rg <= 10 then 1 else 0 end) as indel_mingle from t0 join mis using (h) group by rec_id, alt)
select rec.rec_id, rec.alt, coalesce(pos_count, 0) as pos_count, coalesce(neg_count, 0) as neg_count, coalesce(snp_mingle, 0) as snp_mingle, cast(coalesce(indel_mingle, 0) as bigint) as indel_mingle
from rec left join cnt on rec.rec_id = cnt.rec_id and rec.alt = cnt.alt
"""


ORACLES["calls_indel_support"] = _support_sql()
