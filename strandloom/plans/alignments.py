"""Registered queries over alignments, references, headers, tags and blocks, with SQL to check them by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import cigar, flags, hashing, nucleotide, tags
from strandloom.operators import align as aligner
from strandloom.operators import archive, models, ordered, reference
from strandloom.session import spread

#: Queries that walk every letter of reads or references.
HEAVY = {
    "ref_diff_encode", "ref_diff_roundtrip", "mismatch_rate_by_ref", "pileup_consensus", "genome_prior_both_strands", "seed_join", "seed_extend_best",
    "unaligned_reads", "tags_parse", "tags_text_bytes",
}
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *tables: str):
    """Register a query over tables (aligned_reads unless named)."""

    def register(make):
        names = tables or ("aligned_reads",)

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            scans = [spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in names]
            return make(*(spread(s) if make.__name__ in HEAVY else s for s in scans))

        run.__name__, run.__doc__ = make.__name__, make.__doc__
        QUERIES[make.__name__] = run
        if sql:
            ORACLES[make.__name__] = sql
        return run

    return register


def _n(c: Column) -> Column:
    return c.cast("long")


def _sum(ops: str) -> str:
    listed = ", ".join(f"'{o}'" for o in ops)
    return f"case when cigar is null then null else coalesce(list_sum(list_transform(list_filter(cigar, lambda c: c.op in ({listed})), lambda c: c.len)), 0) end"


_MAPPED = "flags & 4 = 0 and seqname is not null and pos is not null"


def _name_windows(k: int, table: str = "named_seqs") -> str:
    """SQL of w (seqname, off, k): windows of the dictionary, from tiles."""
    return f"""tiled as (select seqname, off, substr(seq, off + 1, {255 + k}) as t from (select seqname, upper(seq) as seq, unnest(range(0, length(seq), 256)) as off from {table})),
w as (select seqname, off + i - 1 as off, substr(t, i, {k}) as k from (select seqname, off, t, unnest(range(1, length(t) - {k - 2})) as i from tiled where length(t) >= {k}) where regexp_full_match(substr(t, i, {k}), '[ACGT]+'))"""


# flags ---------------------------------------------------------------------


@query("select read_no, list_filter([" + ", ".join(f"case when flags & {b} <> 0 then '{n}' end" for n, (b, _) in flags.FLAGS.items()) + "], lambda x: x is not null) as names from aligned_reads")
def flag_decode(a):
    return a.select("read_no", flags.flag_names("flags").alias("names"))


@query("select _file, flags, count(*) as reads, count_if(flags & 1796 = 0) as usable from aligned_reads group by _file, flags")
def flag_counts(a):
    return a.groupBy("_file", "flags").agg(F.count("*").alias("reads"), F.count_if(flags.usable("flags")).alias("usable"))


@query("select read_no, '0x' || lower(hex(flags)) as hexed, flags as back from aligned_reads")
def flag_text(a):
    hexed = flags.format_flags("flags", "hex")
    both = a.select("read_no", hexed.alias("hexed"), flags.format_flags("flags", "letters").alias("lettered"), "flags")
    back = F.when(flags.parse_flags("hexed") == F.when(F.col("flags") == 0, 0).otherwise(flags.parse_flags("lettered")), flags.parse_flags("hexed"))
    return both.select("read_no", "hexed", back.alias("back"))


@query("select read_no, case when strand then reverse(translate(seq, 'ACGTacgt', 'TGCAtgca')) else seq end as seq, case when strand then reverse(qual) else qual end as qual from aligned_reads")
def strand_orient(a):
    return a.select("read_no", reference.reference_side("seq", "strand").alias("seq"), reference.quality_side("qual", "strand").alias("qual"))


@query(f"select seqname, count(*) as reads, count_if(pos between 1000 and 20000) as begins from aligned_reads where {_MAPPED} and cigar is not null and seqname = 'chrA2' and pos < 20000 and pos + {_sum('MDN=X')} > 1000 group by seqname")
def region_filter(a):
    mapped = a.where((F.col("flags").bitwiseAND(4) == 0) & F.col("cigar").isNotNull())
    inside = mapped.where(flags.in_region("seqname", "pos", cigar.alignment_end("pos", "cigar"), "chrA2", 1000, 20000))
    return inside.groupBy("seqname").agg(F.count("*").alias("reads"), F.count_if(F.col("pos").between(1000, 20000)).alias("begins"))


@query("select _file, coalesce(mate_seqname = seqname, false) as same, count(*) as reads, cast(sum(tlen) as bigint) as tlen from aligned_reads where flags & 1 <> 0 group by 1, 2")
def mate_same_ref(a):
    same = F.coalesce(F.col("mate_seqname") == F.col("seqname"), F.lit(False)).alias("same")
    return a.where(flags.has_flag("flags", "PAIRED")).groupBy("_file", same).agg(F.count("*").alias("reads"), F.sum("tlen").alias("tlen"))


@query(f"select _file, count(*) as reads, round(count_if({_MAPPED}) / count(*), 9) as rate from aligned_reads group by _file")
def alignment_rate(a):
    ok = (F.col("flags").bitwiseAND(4) == 0) & F.col("seqname").isNotNull() & F.col("pos").isNotNull()
    return a.groupBy("_file").agg(F.count("*").alias("reads"), F.round(F.avg(ok.cast("int")), 9).alias("rate"))


@query("""with damaged as (select read_no, id, seq, case when map_qual = 60 then substr(qual, 2) else qual end as qual, flags, case when map_qual between 20 and 40 then -pos else pos end as pos,
  case when map_qual < 20 then null else seqname end as seqname from aligned_reads)
select read_no, problem from (select read_no, case when length(seq) <> length(qual) then 'length of qualities' when pos < 0 then 'position' when flags & 4 = 0 and seqname is null then 'no reference' when id is null or id = '' then 'no name' end as problem from damaged)
where problem is not null""")
def invalid_records(a):
    """Records no writer would make, among reads that are damaged here by their mapping quality."""
    q = F.col("map_qual")
    damaged = a.withColumns({
        "qual": F.when(q == 60, F.substring("qual", F.lit(2), F.length("qual"))).otherwise(F.col("qual")),
        "pos": F.when(q.between(20, 40), -F.col("pos")).otherwise(F.col("pos")),
        "seqname": F.when(q >= 20, F.col("seqname")),
    })
    return damaged.select("read_no", aligner.record_problem(damaged).alias("problem")).where("problem is not null")


# edit operations -----------------------------------------------------------


@query("select read_no, case when len(cigar) > 0 then list_reduce(list_transform(cigar, lambda c: c.len || c.op), lambda x, y: x || y) else '*' end as text from aligned_reads")
def cigar_format(a):
    return a.select("read_no", cigar.format_cigar("cigar").alias("text"))


@query("select read_no, i - 1 as op_no, cigar[i].op as op, cigar[i].len as len from (select read_no, cigar, cast(unnest(range(1, len(cigar) + 1)) as integer) as i from aligned_reads)")
def cigar_parse(a):
    parsed = cigar.parse_cigar(cigar.format_cigar("cigar"))
    return a.select("read_no", F.posexplode(parsed).alias("op_no", "c")).select("read_no", "op_no", "c.op", "c.len")


@query(f"select read_no, cast({_sum('MIS=X')} as bigint) as used, cast({_sum('MIS=XP')} as bigint) as coded, coalesce({_sum('MIS=X')} <> length(seq), false) as differs from aligned_reads")
def cigar_qlen(a):
    used = cigar.query_length("cigar")
    return a.select("read_no", used.alias("used"), cigar.coded_length("cigar").alias("coded"), F.coalesce(used != F.length("seq"), F.lit(False)).alias("differs"))


@query(f"select read_no, cast(pos + {_sum('MDN=X')} as bigint) as stop, cast(pos + {_sum('MDN')} as bigint) as legacy from aligned_reads")
def cigar_end(a):
    return a.select("read_no", cigar.alignment_end("pos", "cigar").alias("stop"), cigar.alignment_end("pos", "cigar", legacy=True).alias("legacy"))


@query("""select cigar[i - 1].op as before, cigar[i].op as op, count(*) as n from (select cigar, unnest(range(2, len(cigar) + 1)) as i from aligned_reads) group by 1, 2""")
def cigar_op_bigrams(a):
    ops = F.transform("cigar", lambda c: c["op"])
    n = F.size("cigar")
    pairs = F.zip_with(F.slice(ops, F.lit(1), n - 1), F.slice(ops, F.lit(2), n - 1), lambda x, y: F.struct(x.alias("before"), y.alias("op")))
    return a.where(n >= 2).select(F.inline(pairs)).groupBy("before", "op").agg(F.count("*").alias("n"))


_END = f"pos + {_sum('MDN=X')} - 1"


@query(f"""select read_no, cast(case when pos >> 14 = ({_END}) >> 14 then 4681 + (pos >> 14) when pos >> 17 = ({_END}) >> 17 then 585 + (pos >> 17) when pos >> 20 = ({_END}) >> 20 then 73 + (pos >> 20)
  when pos >> 23 = ({_END}) >> 23 then 9 + (pos >> 23) when pos >> 26 = ({_END}) >> 26 then 1 + (pos >> 26) else 0 end as bigint) as bin
from aligned_reads where {_MAPPED} and {_sum('MDN=X')} > 0""")
def reg2bin(a):
    span = cigar.reference_length("cigar")
    ok = (F.col("flags").bitwiseAND(4) == 0) & F.col("seqname").isNotNull() & F.col("pos").isNotNull() & (span > 0)
    return a.where(ok).select("read_no", cigar.reg2bin("pos", F.col("pos") + span).alias("bin"))


# order ---------------------------------------------------------------------


@query(f"""with m as (select read_no, _file, pos, coalesce(lag(pos) over (partition by _file order by _ord, read_no), 0) as before from aligned_reads where {_MAPPED})
select read_no, pos - before between 0 and 255 as offset_coded, case when pos - before between 0 and 255 then pos - before else pos end as coded from m""")
def pos_delta(a):
    ok = (F.col("flags").bitwiseAND(4) == 0) & F.col("seqname").isNotNull() & F.col("pos").isNotNull()
    known = ordered.with_previous(a.where(ok), {"before": F.col("pos")}, ["_file"], ["_ord", "read_no"])
    step = F.col("pos") - F.coalesce("before", F.lit(0))
    near = step.between(0, 255)
    return known.select("read_no", near.alias("offset_coded"), F.when(near, step).otherwise(F.col("pos")).alias("coded"))


@query("""with f as (select _file, seqname, min(struct_pack(o := _ord, r := read_no)) as first from aligned_reads where seqname is not null group by _file, seqname)
select _file, seqname, cast(row_number() over (partition by _file order by first) - 1 as integer) as index, first.o as first_at from f""")
def first_seen_index(a):
    return ordered.first_seen_index(a, "seqname", ["_file"], ["_ord", "read_no"])


# references ----------------------------------------------------------------


@query("select a.read_no, a.seqname, length(n.seq) as ref_length from aligned_reads a left join named_seqs n on a.seqname = n.seqname", "aligned_reads", "named_seqs")
def ref_join(a, n):
    return reference.with_reference(a, n).select("read_no", "seqname", "ref_length")


@query("""select a._file, a.seqname, count(*) as reads from aligned_reads a anti join (select _file, tags['SN'] as sn from headers where record = 'SQ') h on a._file = h._file and a.seqname = h.sn
where a.seqname is not null group by 1, 2""", "aligned_reads", "headers")
def ref_missing(a, h):
    """References that a file's reads use and its header does not declare."""
    declared = h.where(F.col("record") == "SQ").select("_file", F.col("tags")["SN"].alias("seqname"))
    return reference.missing_names(a, declared, ["_file"])


@query("""with d as (select _file, tags['SN'] as seqname, count(*) as n, min(try_cast(tags['LN'] as bigint)) as low, max(try_cast(tags['LN'] as bigint)) as high from headers where record = 'SQ' group by 1, 2)
select _file, seqname, problem from (select d._file, d.seqname, case when s.seq is null then 'unknown' when low <> length(s.seq) or high <> length(s.seq) then 'length' when n > 1 then 'repeated' end as problem
from d left join named_seqs s on d.seqname = s.seqname) where problem is not null""", "headers", "named_seqs")
def header_check(h, n):
    return reference.header_check(h, n)


@query("""select seqname, problem from (select seqname, case when length is null then 'only left' when length < length(seq) then 'length'
  when upper(translate(seq, 'a', 'c')) <> upper(seq) then 'content' end as problem from named_seqs) where problem is not null""", "named_seqs")
def ref_dict_check(n):
    """The dictionary against a damaged one: names missing, sequences cut to their declared length, letters changed."""
    other = F.when(F.col("length") < F.length("seq"), F.substring("seq", F.lit(1), F.col("length").cast("int"))).otherwise(F.translate("seq", "a", "c"))
    return reference.dictionary_check(n, n.where("length is not null").select("seqname", other.alias("seq")))


@query("select seqname, length(seq) as letters, length(seq) - length(translate(seq, 'Nn', '')) as n_letters, row_number() over (order by seqname) as no from named_seqs", "named_seqs")
def ref_sorted(n):
    """The dictionary in name order: 260 rows, one number each."""
    from pyspark.sql import Window

    sized = n.select("seqname", _n(F.length("seq")).alias("letters"), _n(nucleotide.n_count("seq")).alias("n_letters"))
    return sized.withColumn("no", F.row_number().over(Window.orderBy("seqname")))


_WALK = f"""ok as (
  select read_no, seqname, pos, cigar, upper(case when strand then reverse(translate(seq, 'ACGTacgt', 'TGCAtgca')) else seq end) as t from aligned_reads
  where {_MAPPED} and len(cigar) > 0 and seq is not null and {_sum('MIS=X')} = length(seq) and len(list_filter(cigar, lambda c: c.op = 'P')) = 0
), o as (
  select *, cigar[i].op as op, cigar[i].len as n,
    coalesce(list_sum(list_transform(list_filter(cigar[1:i - 1], lambda c: c.op in ('M', 'I', 'S', '=', 'X')), lambda c: c.len)), 0) as ra,
    coalesce(list_sum(list_transform(list_filter(cigar[1:i - 1], lambda c: c.op in ('M', 'D', 'N', '=', 'X')), lambda c: c.len)), 0) as ga
  from (select *, unnest(range(1, len(cigar) + 1)) as i from ok)
), l as (
  select read_no, seqname, op, cast(ra + k as integer) as read_at, cast(pos + ga + case when op in ('M', '=', 'X') then k else 0 end as bigint) as ref_at, substr(t, cast(ra + k + 1 as bigint), 1) as nt
  from (select *, unnest(range(0, n)) as k from o where op in ('M', 'I', 'S', '=', 'X'))
), w as (
  select l.*, coalesce(upper(substr(s.seq, l.ref_at + 1, 1)), '') as under from l left join named_seqs s on l.seqname = s.seqname
)"""


def _fetched(a: DataFrame, n: DataFrame) -> DataFrame:
    return reference.fetch(reference.alignable(a, "read_no"), n, "read_no")


@query(f"with {_WALK} select read_no, op, read_at, ref_at, nt from w where op in ('I', 'S') or nt <> under", "aligned_reads", "named_seqs")
def ref_diff_encode(a, n):
    return reference.diff_encode(_fetched(a, n), "read_no").select("read_no", F.inline("diff"))


@query(f"with {_WALK} select a.read_no, upper(seq) as seq from aligned_reads a semi join ok using (read_no)", "aligned_reads", "named_seqs")
def ref_diff_roundtrip(a, n):
    fetched = _fetched(a, n)
    encoded = reference.diff_encode(fetched, "read_no").select("read_no", "diff")
    without = fetched.select("read_no", "strand", "cigar", "under")  # the reads themselves are gone here
    return reference.diff_decode(without.join(encoded, "read_no"), "read_no")


@query(f"with {_WALK} select seqname, count(*) as letters, round(count_if(nt <> under) / count(*), 9) as rate from w where op in ('M', '=', 'X') group by seqname", "aligned_reads", "named_seqs")
def mismatch_rate_by_ref(a, n):
    encoded = reference.diff_encode(_fetched(a, n), "read_no")
    letters = F.aggregate(F.filter("cigar", lambda c: c["op"].isin("M", "=", "X")), F.lit(0).cast("long"), lambda x, c: x + c["len"])
    wrong = F.size(F.filter("diff", lambda d: d["op"].isin("M", "=", "X")))
    return encoded.groupBy("seqname").agg(F.sum(letters).alias("letters"), F.round(F.sum(wrong) / F.sum(letters), 9).alias("rate")).where("letters > 0")


@query(f"with {_WALK}, c as (select seqname, ref_at as at_pos, nt as symbol, count(*) as n from w where op in ('M', '=', 'X') group by 1, 2, 3) select seqname, at_pos, symbol, n from (select *, row_number() over (partition by seqname, at_pos order by n desc, symbol) as no from c) where no = 1", "aligned_reads", "named_seqs")
def pileup_consensus(a, n):
    counts = reference.pileup(_fetched(a, n)).withColumnRenamed("at", "at_pos")
    return models.consensus(counts, ["seqname", "at_pos"])


@query(f"""with {_name_windows(3, "(select seqname, seq from named_seqs union all select seqname, reverse(translate(upper(seq), 'ACGT', 'TGCA')) from named_seqs)")}
select substr(k, 1, 2) as context, substr(k, 3, 1) as symbol, least(count(*), 100) as n from w group by 1, 2""", "named_seqs")
def genome_prior_both_strands(n):
    return models.genome_prior(n, F.col("seq"), 2)


@query(None, "named_seqs")
def ref_checksum(n):
    return reference.dictionary_checksum(n)


# seed and extend ------------------------------------------------------------

_SEEDED = f"""reads as (select read_no, upper(seq) as t, length(seq) as n from aligned_reads where length(seq) >= 12),
s as (select read_no, n, seed_no, off, substr(t, off + 1, 12) as w from (select *, unnest([0, 1, 2]) as seed_no, unnest([least(0, n - 12), least(24, n - 12), least(48, n - 12)]) as off from reads)),
{_name_windows(12)},
c as (select seqname as contig, off, k as w, least(k, reverse(translate(k, 'ACGT', 'TGCA'))) as kmer from w),
x as (select * from (select *, row_number() over (partition by kmer order by contig, off) as no from c) where no <= 100),
h as (select read_no, n, seed_no, contig, s.off as ro, x.off as co, (s.w <> x.kmer) <> (x.w <> x.kmer) as turned from s join x on least(s.w, reverse(translate(s.w, 'ACGT', 'TGCA'))) = x.kmer where regexp_full_match(s.w, '[ACGT]+')),
b as (select read_no, n, seed_no, contig, turned as reverse, case when turned then co - (n - 12 - ro) else co - ro end as begin from h),
p as (select b.* from b join named_seqs z on z.seqname = b.contig where begin >= 0 and begin + n <= length(z.seq))"""

_BEST = f"""with {_SEEDED}, d as (select read_no, contig, begin, reverse, min(seed_no) as seed_no from p group by 1, 2, 3, 4),
m as (select d.*, r.n, hamming(case when reverse then reverse(translate(r.t, 'ACGT', 'TGCA')) else r.t end, upper(substr(z.seq, begin + 1, r.n))) as mismatches
  from d join reads r using (read_no) join named_seqs z on z.seqname = d.contig),
best as (select * from (select *, row_number() over (partition by read_no order by mismatches, seed_no, contig, begin, reverse) as no from m where mismatches / n <= 0.22) where no = 1)"""


@query(f"with {_SEEDED} select read_no, seed_no, contig, begin, reverse from p", "aligned_reads", "named_seqs")
def seed_join(a, n):
    return aligner.seed_hits(a, n, "read_no", F.col("seq"), "seqname", "seq")


@query(f"{_BEST} select read_no, contig, begin, reverse, mismatches, n as length from best", "aligned_reads", "named_seqs")
def seed_extend_best(a, n):
    return aligner.align(a, n, "read_no", "seq", "seqname", "seq")


@query(f"{_BEST} select read_no from aligned_reads anti join best using (read_no)", "aligned_reads", "named_seqs")
def unaligned_reads(a, n):
    return aligner.unaligned(a, aligner.align(a, n, "read_no", "seq", "seqname", "seq"), "read_no").select("read_no")


# tags ------------------------------------------------------------------------

_ENTRIES = "e as (select read_no, unnest(map_entries(aux)) as e from aligned_reads)"


@query(f"with {_ENTRIES} select read_no, e.key as tag, e.value.type as type, e.value.s as s, e.value.i as i from e where e.value.type in ('A', 'Z', 'H', 'i')")
def tags_parse(a):
    """Tags written as text and parsed again."""
    text = F.transform(tags.sorted_tags("aux"), lambda e: tags.format_tag(e["key"], e["value"]))
    parsed = a.select("read_no", tags.parse_tags(text).alias("aux"))
    rows = parsed.select("read_no", F.explode("aux").alias("tag", "v")).select("read_no", "tag", "v.type", "v.s", "v.i")
    return rows.where(F.col("type").isin("A", "Z", "H", "i"))


@query(f"with {_ENTRIES} select read_no, e.key as tag, case when v < -32767 then 'i' when v < -127 then 's' when v < 0 then 'c' when v <= 255 then 'C' when v <= 65535 then 'S' else 'I' end as narrow from (select read_no, e, e.value.i as v from e) where v is not null")
def tags_narrow_type(a):
    rows = a.select("read_no", F.explode("aux").alias("tag", "v")).where("v.i is not null")
    return rows.select("read_no", "tag", tags.narrow_type("v.i").alias("narrow"))


@query("select read_no, list_sort(map_keys(aux)) as keys from aligned_reads")
def tags_sorted(a):
    return a.select("read_no", F.transform(tags.sorted_tags("aux"), lambda e: e["key"]).alias("keys"))


@query("select _file, aux['RG'].s as read_group, count(*) as reads, cast(sum(aux['NM'].i) as bigint) as nm from aligned_reads group by 1, 2")
def tags_access(a):
    return a.groupBy("_file", tags.tag_text("aux", "RG").alias("read_group")).agg(F.count("*").alias("reads"), F.sum(tags.tag_int("aux", "NM")).alias("nm"))


@query(f"""with {_ENTRIES}, z as (select read_no, sum(6 + case when e.value.i is not null then strlen(cast(e.value.i as varchar)) else strlen(e.value.s) end) as total, count(*) as n,
  count_if(e.value.type not in ('A', 'Z', 'H', 'i')) as other from e group by read_no)
select a.read_no, cast(coalesce(total - 1, 0) as bigint) as bytes from aligned_reads a left join z using (read_no) where coalesce(other, 0) = 0""")
def tags_text_bytes(a):
    plain = ~F.exists(F.map_values("aux"), lambda v: ~v["type"].isin("A", "Z", "H", "i"))
    return a.where(F.coalesce(plain, F.lit(True))).select("read_no", _n(tags.text_bytes("aux")).alias("bytes"))


@query()
def tags_binary_bytes(a):
    return a.select("read_no", _n(tags.binary_bytes("aux")).alias("bytes"))


# headers, blocks, digests --------------------------------------------------------


@query("select _file, tags['SN'] as seqname, try_cast(tags['LN'] as bigint) as letters, count(*) as lines from headers where record = 'SQ' group by 1, 2, 3", "headers")
def sam_header_sq(h):
    rows = h.where(F.col("record") == "SQ").select("_file", F.col("tags")["SN"].alias("seqname"), F.col("tags")["LN"].try_cast("bigint").alias("letters"))
    return rows.groupBy("_file", "seqname", "letters").agg(F.count("*").alias("lines"))


@query("select record, entry.key as tag, count(*) as n, count(distinct entry.value) as differing from (select record, unnest(map_entries(tags)) as entry from headers) group by 1, 2", "headers")
def header_tag_table(h):
    rows = h.select("record", F.explode("tags").alias("tag", "value"))
    return rows.groupBy("record", "tag").agg(F.count("*").alias("n"), F.countDistinct("value").alias("differing"))


@query("""select a._file, h.tags['LB'] as library, count(*) as reads from aligned_reads a left join (select _file, tags['ID'] as id, any_value(tags['LB']) as lb, map(['LB'], [any_value(tags['LB'])]) as tags from headers where record = 'RG' group by 1, 2) h
on a._file = h._file and a.aux['RG'].s = h.id group by 1, 2""", "aligned_reads", "headers")
def library_counts(a, h):
    """Reads by library: read group of the read, library of the group."""
    groups = h.where(F.col("record") == "RG").groupBy("_file", F.col("tags")["ID"].alias("id")).agg(F.first(F.col("tags")["LB"]).alias("library"))
    rows = a.groupBy("_file", tags.tag_text("aux", "RG").alias("id")).agg(F.count("*").alias("n"))
    return rows.join(groups, ["_file", "id"], "left").groupBy("_file", "library").agg(F.sum("n").alias("reads"))


@query("""select _file, count(*) as blocks, cast(sum(reads) as bigint) as reads, cast(sum(bases) as bigint) as bases,
  """ + ", ".join(f"cast(sum({c}_{k}_bytes) as bigint) as {c}_{k}_bytes" for c in ("id", "aux", "seq", "qual") for k in ("raw", "comp")) + " from blocks group by _file", "blocks")
def archive_list(b):
    return archive.summary(b)


@query("""select _file, round(sum(id_comp_bytes + aux_comp_bytes + seq_comp_bytes + qual_comp_bytes) / sum(id_raw_bytes + aux_raw_bytes + seq_raw_bytes + qual_raw_bytes + reads), 9) as ratio,
  round(sum(seq_comp_bytes) * 8 / sum(bases), 6) as bits_per_base from blocks group by _file""", "blocks")
def archive_ratio(b):
    return archive.ratios(archive.summary(b)).select("_file", F.round("ratio", 9).alias("ratio"), F.round("bits_per_base", 6).alias("bits_per_base"))


@query("select _file, block, (id_digest is null)::int + (aux_digest is null)::int + (seq_digest is null)::int + (qual_digest is null)::int as missing from blocks where id_digest is null or aux_digest is null or seq_digest is null or qual_digest is null", "blocks")
def blocks_without_digest(b):
    missing = sum((F.col(f"{c}_digest").isNull().cast("int") for c in ("id", "aux", "seq", "qual")), F.lit(0))
    return b.select("_file", "block", missing.alias("missing")).where("missing > 0")


@query()
def block_crc64(a):
    """CRC-64 of the id, seq and qual columns of blocks of 1000 reads in file order."""
    return archive.block_checksums(a, ["id", "seq", "qual"], ["_file"], ["_ord", "read_no"], 1000)


@query("select read_no, md5(concat_ws(chr(31), '+' || id, coalesce('+' || seq, '-'), coalesce('+' || qual, '-'), '+' || flags, coalesce('+' || seqname, '-'), coalesce('+' || pos, '-'), coalesce('+' || mate_seqname, '-'), coalesce('+' || mate_pos, '-'), '+' || tlen)) as digest from aligned_reads")
def alignment_md5(a):
    return a.select("read_no", hashing.row_digest("id", "seq", "qual", "flags", "seqname", "pos", "mate_seqname", "mate_pos", "tlen").alias("digest"))
