"""Registered queries of the training-data operators, and SQL to check them by."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.nucleotide import canonical_read
from strandloom.llm import frequent, mixing, neardup, packing, pieces, seen, spans, tokens, truncated
from strandloom.session import cut

#: Production parameters.
SHARE, LEAST = 0.01, 5
SPAN = 48
LIMIT, OVERLAP = 12_000, 200
#: Setting that names the tokenizer's vocabulary file, and where it lies if nothing is set.
VOCABULARY = "spark.strandloom.vocabulary", "/opt/tokenizers/byte_bpe_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = _table(spark, sf_dir, "raw_reads")
    return seen.seen_before(reads, canonical_read("seq")).where("seen").select("read_no")


def p1_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seen.error_report(_table(spark, sf_dir, "raw_reads"), canonical_read("seq"), [20, 24, 28, 32, 40, 64])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_counts(spark, sf_dir).select("_file", "seq")


def p2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = _table(spark, sf_dir, "raw_reads")
    top = frequent.frequent_values(reads, canonical_read("seq"), F.col("_file"), SHARE, LEAST)
    return top.select(F.col("grp").alias("_file"), F.col("value").alias("seq"), "rows", "group_rows")


def p2_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the sketch alone answers: bounds of every candidate, and how wide they are against the exact count."""
    found = frequent.frequent_bounds(_table(spark, sf_dir, "raw_reads"), canonical_read("seq"), F.col("_file"), SHARE, LEAST)
    per_file = found.groupBy(F.col("grp").alias("_file")).agg(
        F.count("*").alias("candidates"),
        F.count_if((F.col("rows") / F.col("group_rows") >= F.lit(SHARE)) & (F.col("rows") >= LEAST)).alias("frequent"),
        F.count_if(F.col("rows").between(F.col("low"), F.col("high"))).alias("inside"),
        F.max((F.col("high") - F.col("low")) / F.col("group_rows")).alias("widest"),
    )
    return per_file


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.similar_pairs(_table(spark, sf_dir, "raw_reads"), F.upper("seq"), F.col("qual"))


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.similar_groups(_table(spark, sf_dir, "raw_reads"), F.upper("seq"), F.col("qual"))


def p3_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the signatures' corrected estimates are from the exact similarities of all links."""
    return neardup.estimate_report(_table(spark, sf_dir, "raw_reads"), F.upper("seq"), F.col("qual"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_spans(_table(spark, sf_dir, "raw_reads"), F.col("seq"), length=SPAN)


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_report(_table(spark, sf_dir, "raw_reads"), F.col("seq"), length=SPAN)


def p5_removable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.removable_spans(_table(spark, sf_dir, "raw_reads"), F.col("seq"), length=SPAN)


def _oversized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.stretches(_table(spark, sf_dir, "named_seqs").where(F.length("seq") > LIMIT), F.col("seqname"), F.col("seq"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _oversized(spark, sf_dir)
    cuts = pieces.pieces(parts, LIMIT, OVERLAP)
    return pieces.stretches_of_pieces(parts, cuts).withColumnRenamed("key", "seqname")


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.pieces(_oversized(spark, sf_dir), LIMIT, OVERLAP).withColumnRenamed("key", "seqname")


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(_table(spark, sf_dir, "documents"), F.col("text"), [F.col("doc_id"), F.col("source")], spark.conf.get(*VOCABULARY))


def _capacities(spark: SparkSession, sf_dir: str) -> dict[int, int]:
    return {r["pack_id"]: r["capacity_tokens"] for r in _table(spark, sf_dir, "pack_sizes").collect()}


def p8_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_sized(spark, sf_dir), _capacities(spark, sf_dir))


def p8_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_summary(p8_packs(spark, sf_dir), _capacities(spark, sf_dir))


def p8_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs of each capacity next to best-fit alone and to the program's lower bound."""
    return packing.pack_bounds(_sized(spark, sf_dir), _capacities(spark, sf_dir))


def _schedules(targets: DataFrame) -> DataFrame:
    """Small sources come late: the weight of a source of less than a tenth of the mixture stays level for a
    quarter of the time and then doubles; the others make room for it."""
    late = targets.where(F.col("target_share") < 0.1)
    return late.select("source", F.inline(F.array(*(F.struct(F.lit(t).alias("at"), F.lit(w).alias("weight")) for t, w in ((0.0, 1.0), (0.25, 1.0), (1.0, 2.0))))))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = _table(spark, sf_dir, "mix_targets")
    return mixing.in_training_order(mixing.mix(_sized(spark, sf_dir), targets, _schedules(targets)))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = _table(spark, sf_dir, "mix_targets")
    return mixing.shares(mixing.mix(_sized(spark, sf_dir), targets, _schedules(targets)), targets)


def p9_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each source in each tenth of the token positions, next to its schedule."""
    targets, sized = _table(spark, sf_dir, "mix_targets"), cut(_sized(spark, sf_dir))
    return mixing.slices(cut(mixing.mix(sized, targets, _schedules(targets))), sized, targets, _schedules(targets))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncated.truncated_texts(_table(spark, sf_dir, "documents")).where("truncated").select("doc_id")


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncated.truncation_rates(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_errors, p2_found, p2_counts, p2_bounds, p3_found, p3_groups, p3_estimates, p5_found, p5_report, p5_removable,
        p6_found, p6_pieces, p8_packs, p8_summary, p8_bounds, p9_mix, p9_shares, p9_slices, p10_found, p10_rates,
    )
}

_CANONICAL = """
canon as (
  select read_no, _file, loaded_at, case when length(replace(u, 'N', '')) > 0
    then least(u, reverse(translate(u, 'ACGT', 'TGCA'))) end as c
  from (select read_no, _file, loaded_at, upper(seq) as u from raw_reads)
)"""

_SHARED = f"""
texts as (select read_no, upper(seq) as s from raw_reads where length(seq) >= {SPAN}),
contents as (select s, row_number() over (order by s) as id from (select distinct s from texts)),
windows as (
  select id, p - 1 as off, substr(s, p, {SPAN}) as w
  from (select id, s, unnest(range(1, length(s) - {SPAN - 2})) as p from contents)
  where regexp_full_match(substr(s, p, {SPAN}), '[ACGT]+')
),
several as (select w from windows group by w having count(distinct id) > 1),
hits as (select id, off, lag(off) over (partition by id order by off) as prev from windows join several using (w)),
runs as (select id, off, sum(case when prev is null or off > prev + {SPAN} then 1 else 0 end) over (partition by id order by off) as run from hits),
spans as (select id, min(off) as span_start, max(off) + {SPAN} as span_end from runs group by id, run)"""

_CUT_OFF = """w as (select unnest(regexp_extract_all(text, '\\p{L}+')) as t from documents),
wc as (select t, count(*) as n from w group by t),
known as (select list(t) as k from wc where n >= (select sum(n) from wc) * 0.005),
blank as (select doc_id, rtrim(text, chr(32) || chr(10) || chr(13) || chr(9)) as t from documents),
trimmed as (select doc_id, rtrim(case when ends_with(t, '[...]') then left(t, length(t) - 5) when ends_with(t, '...') then left(t, length(t) - 3) when ends_with(t, '…') then left(t, length(t) - 1)
  when ends_with(t, '�') then rtrim(t, '�') || 'x' else t || 'x' end, chr(32) || chr(10) || chr(13) || chr(9)) as t, ends_with(t, '[...]') or ends_with(t, '...') or ends_with(t, '…') as marked from blank),
tokened as (select doc_id, regexp_extract_all(case when marked then t else left(t, length(t) - 1) end, '\\p{L}+|[0-9]+|\\n+|[^\\s\\p{L}0-9]') as tokens from trimmed),
shaped as (select doc_id, tokens[greatest(1, len(tokens) - 15):] as tail, not list_contains(k, tokens[-1]) and len(list_filter(k, lambda v: starts_with(v, tokens[-1]))) > 0 as half,
  ['^', '^', '^'] || list_transform(tokens, lambda t: case when list_contains(k, t) then t when ascii(t) between 48 and 57 then '9' when ascii(t) = 10 then chr(10)
    when upper(t) = lower(t) then case when length(t) > 1 then 'a' else t end when upper(t) = t then case when length(t) > 1 then 'U' else 'A' end
    when lower(left(t, 1)) = left(t, 1) then 'a' else 'A' end) as s from tokened, known where len(tokens) > 0),
grams as (select s[i - 2] as a, s[i - 1] as b, s[i] as c, count(*) as n from (select s, unnest(range(4, len(s) + 1)) as i from shaped) group by all),
tails as (select tail, count(*) as c, any_value(s[len(s) - 2 - cast(half as int):len(s) - cast(half as int)]) as x from shaped group by tail),
n3 as (select a, b, c, n from grams), n2 as (select b, c, sum(n) as n from grams group by all), n1 as (select c, sum(n) as n from grams group by all),
e3 as (select x, count(*) as e from tails group by x), e2 as (select x[2:] as x, count(*) as e from tails group by all), e1 as (select x[3] as x, count(*) as e from tails group by all),
base as (select (select count(*) from tails) / (select sum(n) from grams) as p),
judged as (select tail, p, greatest(coalesce(n1.n, 0) - t.c, 0) as n1, greatest(coalesce(n2.n, 0) - t.c, 0) as n2, greatest(coalesce(n3.n, 0) - t.c, 0) as n3,
  case when n1.n is null then 0 else e1.e - 1 end as e1, case when n2.n is null then 0 else e2.e - 1 end as e2, case when n3.n is null then 0 else e3.e - 1 end as e3
  from tails t, base left join n3 on n3.a = t.x[1] and n3.b = t.x[2] and n3.c = t.x[3] left join n2 on n2.b = t.x[2] and n2.c = t.x[3] left join n1 on n1.c = t.x[3]
  left join e3 on e3.x = t.x left join e2 on e2.x = t.x[2:] left join e1 on e1.x = t.x[3]),
lifted as (select tail, (e3 + 3000 * (e2 + 300 * (e1 + 30 * p) / (n1 + 30)) / (n2 + 300)) / (n3 + 3000) / p as lift from judged),
cut_off as (select doc_id from shaped join lifted using (tail) where lift < 0.8)"""

ORACLES = {
    "p1_found": f"""with {_CANONICAL}
select read_no from (
  select read_no, row_number() over (partition by c order by loaded_at, read_no) as n from canon where c is not null
) where n > 1""",
    "p2_found": f"""with {_CANONICAL}, sizes as (select _file, count(*) as t from raw_reads group by _file)
select _file, c as seq from (select _file, c, count(*) as n from canon where c is not null group by _file, c) join sizes using (_file)
where n >= {LEAST} and n / t >= {SHARE}""",
    "p2_counts": f"""with {_CANONICAL}, sizes as (select _file, count(*) as t from raw_reads group by _file)
select _file, c as seq, n as rows, t as group_rows from (select _file, c, count(*) as n from canon where c is not null group by _file, c) join sizes using (_file)
where n >= {LEAST} and n / t >= {SHARE}""",
    "p3_found": """with r as (select read_no, upper(seq) as s, qual as q from raw_reads where length(seq) >= 8 and length(qual) >= 4),
a as (select distinct read_no, substr(s, i, 8) as w from (select read_no, s, unnest(range(1, length(s) - 6)) as i from r)),
b as (select distinct read_no, substr(q, i, 4) as w from (select read_no, q, unnest(range(1, length(q) - 2)) as i from r)),
na as (select read_no, count(*) as n from a group by read_no),
nb as (select read_no, count(*) as n from b group by read_no),
qs as (
  select x.read_no as a, y.read_no as b, count(*) as n from b x join b y on x.w = y.w and x.read_no < y.read_no group by 1, 2
),
close as (select qs.a, qs.b from qs join nb x on x.read_no = a join nb y on y.read_no = b where qs.n * 2 >= x.n + y.n - qs.n),
ss as (
  select c.a, c.b, count(*) as n from close c join a x on x.read_no = c.a join a y on y.read_no = c.b and x.w = y.w group by 1, 2
)
select ss.a as read_no_a, ss.b as read_no_b from ss join na x on x.read_no = a join na y on y.read_no = b where ss.n * 2 >= x.n + y.n - ss.n""",
    "p3_groups": f"""with recursive r as (select read_no, upper(seq) as s, qual as q from raw_reads where length(seq) >= 8 and length(qual) >= 4),
classes as (select s, q, min(read_no) as id, count(*) as copies from r group by s, q),
a as (select distinct id, substr(s, i, 8) as w from (select id, s, unnest(range(1, length(s) - 6)) as i from classes)),
b as (select distinct id, substr(q, i, 4) as w from (select id, q, unnest(range(1, length(q) - 2)) as i from classes)),
na as (select id, count(*) as n from a group by id),
nb as (select id, count(*) as n from b group by id),
qs as (select x.id as a, y.id as b, count(*) as n from b x join b y on x.w = y.w and x.id < y.id group by 1, 2),
near as (select qs.a, qs.b from qs join nb x on x.id = a join nb y on y.id = b where qs.n * 2 >= x.n + y.n - qs.n),
ss as (select c.a, c.b, count(*) as n from near c join a x on x.id = c.a join a y on y.id = c.b and x.w = y.w group by 1, 2),
links as (select ss.a, ss.b from ss join na x on x.id = a join na y on y.id = b where ss.n * 2 >= x.n + y.n - ss.n),
sides as (select a, b from links union all select b, a from links),
reach(id, other) as (select id, id from classes union select reach.id, sides.b from reach join sides on sides.a = reach.other),
parts as (select id, min(other) as group_id from reach group by id),
degree as (select a as id, count(*) as links from sides group by a)
select read_no, coalesce(group_id, read_no) as group_id, coalesce(copies, 1) as copies, coalesce(links, 0) as links
from raw_reads r0 left join classes c on upper(r0.seq) = c.s and r0.qual = c.q left join parts on parts.id = c.id left join degree on degree.id = c.id""",
    "p5_found": f"with {_SHARED} select read_no, cast(span_start as bigint) as span_start, cast(span_end as bigint) as span_end from texts join contents using (s) join spans using (id)",
    "p5_report": f"""with {_SHARED}, shared as (
  select read_no, sum(span_end - span_start) as shared, count(*) as spans from texts join contents using (s) join spans using (id) group by read_no
)
select read_no, cast(coalesce(length(seq), 0) as bigint) as letters, cast(coalesce(shared, 0) as bigint) as shared, cast(coalesce(spans, 0) as bigint) as spans,
  case when length(seq) > 0 then coalesce(shared, 0) / length(seq) else 0.0 end as share
from raw_reads left join shared using (read_no)""",
    "p5_removable": f"""with {_SHARED},
owners as (select id, min(read_no) as first_row from texts join contents using (s) group by id),
occurrences as (select w, id, off, first_row from windows join several using (w) join owners using (id)),
ranked as (select *, row_number() over (partition by w order by first_row, off) as n from occurrences),
letters as (select id, n, unnest(range(off, off + {SPAN})) as p from ranked),
covered as (select id, p, bool_or(n = 1) as kept from letters group by id, p),
lost as (
  select read_no, p from texts join contents using (s) join owners using (id) join covered using (id) where not kept or read_no <> first_row
),
parts as (select read_no, p, p - row_number() over (partition by read_no order by p) as run from lost)
select read_no, cast(min(p) as bigint) as span_start, cast(max(p) + 1 as bigint) as span_end from parts group by read_no, run""",
    "p10_found": f"with {_CUT_OFF} select doc_id from cut_off",
    "p10_rates": f"""with {_CUT_OFF} select source, count(*) as texts, count(c.doc_id) as truncated, count(c.doc_id) / count(*) as rate
from documents d left join cut_off c on c.doc_id = d.doc_id group by source""",
    "p6_found": f"""with s as (
  select seqname, string_split_regex(seq, '[Nn]{{10,}}') as parts, regexp_extract_all(seq, '[Nn]{{10,}}') as fills from named_seqs where length(seq) > {LIMIT}
), u as (
  select seqname, i, length(parts[i]) as n, coalesce(length(fills[i]), 0) as f from (select *, unnest(range(1, len(parts) + 1)) as i from s)
), p as (
  select seqname, n, sum(n + f) over (partition by seqname order by i) - n - f as a from u
)
select seqname, cast(a as bigint) as seg_start, cast(a + n as bigint) as seg_end from p where n > 0""",
    "p6_pieces": f"""with recursive s as (
  select seqname, string_split_regex(seq, '[Nn]{{10,}}') as parts, regexp_extract_all(seq, '[Nn]{{10,}}') as fills from named_seqs where length(seq) > {LIMIT}
), u as (
  select seqname, i, length(parts[i]) as n, coalesce(length(fills[i]), 0) as f from (select *, unnest(range(1, len(parts) + 1)) as i from s)
), p as (
  select seqname, n, sum(n + f) over (partition by seqname order by i) - n - f as a from u
), edges as (
  select seqname, list(cast(a as bigint) order by a) as starts, list(cast(a + n as bigint) order by a) as ends from p where n > 0 group by seqname
), walk(seqname, starts, ends, piece, here, best) as (
  select seqname, starts, ends, 0, starts[1], list_max(list_filter(ends, lambda x: x > starts[1] and x <= starts[1] + {LIMIT})) from edges
  union all
  select seqname, starts, ends, piece + 1, n, list_max(list_filter(ends, lambda x: x > n and x <= n + {LIMIT})) from (
    select *, case when best is null then here + {LIMIT - OVERLAP} else list_min(list_filter(starts, lambda x: x >= best)) end as n from walk
  ) where n is not null
)
select seqname, piece, here as piece_start, coalesce(best, here + {LIMIT}) as piece_end, best is not null as "natural" from walk""",
}
