"""Registered queries over coded columns, packed forms and small helpers, with SQL to check them by."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import hashing, ident, nucleotide, packing
from strandloom.operators import archive, codec, models
from strandloom.plans import reads as read_plans
from strandloom.plans.formats import _REST, _shown, place
from strandloom.sources import convert, fasta, fastq, files, sam

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(table: str, sql: str | None = None):
    """Register a query of (spark, table) under its function's name, with SQL if there is any."""

    def register(make):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return make(spark, spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        run.__name__, run.__doc__ = make.__name__, make.__doc__
        QUERIES[make.__name__] = run
        if sql:
            ORACLES[make.__name__] = sql
        return run

    return register


def _bits_sql(counts: str, context: str, alphabet: int) -> str:
    """SQL of (symbols, bits) of an adaptive model from counts (context.., symbol, n)."""
    return f"""select sum(t) as symbols, sum((lgamma(t + {alphabet}) - lgamma({alphabet}) - own) / ln(2)) as bits from (
  select cast(sum(n) as bigint) as t, sum(lgamma(n + 1)) as own from ({counts}) group by {context})"""


_PAIRS = """with u as (select read_no, regexp_replace(upper(seq), '[^ACGT]', 'A', 'g') as s, upper(seq) as raw from raw_reads where length(seq) > 0),
p as (select s, unnest(range(0, length(s), 2)) as i from u),
pairs as (select case when i < 8 and i + 1 < length(s) then i // 2 else 4 end as own,
  case when i < 11 then lpad(substr(s, 1, i), 11, 'A') else substr(s, i - 10, 11) end as context, case when i + 1 < length(s) then translate(substr(s, i + 1, 2), 'ACGT', '0123') else '0' || translate(substr(s, i + 1, 1), 'ACGT', '0123') end as symbol from p),
m as (select unnest(range(0, length(raw))) as i, raw from u)"""


@query("raw_reads", f"""{_PAIRS}
select 'pairs' as part, cast(symbols as bigint) as symbols, round(bits, 1) as bits from ({_bits_sql('select own, context, symbol, count(*) as n from pairs group by all', 'own, context', 16)})
union all
select 'n_mask', cast(symbols as bigint), round(bits, 1) from ({_bits_sql("select i, substr(raw, i + 1, 1) = 'N' as symbol, count(*) as n from m group by all", 'i', 2)})""")
def nt2_bits(spark, r):
    """Code length of sequences as pairs of letters after eleven, and of the mask of N."""
    return codec.sequence_bits(r, F.col("seq")).select("part", "symbols", F.round("bits", 1).alias("bits"))


@query("raw_reads", f"select cast(symbols as bigint) as symbols, round(bits, 1) as bits from ({_bits_sql(read_plans.ORACLES['qual_context_counts'], 'pos4, delta, q34, q2, q1', 64)})")
def qual_bits(spark, r):
    """Code length of qualities under their contexts."""
    return codec.quality_bits(models.quality_context_counts(r, F.col("qual"))).select("symbols", F.round("bits", 1).alias("bits"))


_ID_PARTS = f"""with {read_plans._PREVIOUS},
k as (select *, least(token_no, 19) as t, case when a is not null and p is not null and a - p between 0 and 15 then 1 when a is not null then 2 when token = previous then 0 else 3 end as kind,
  coalesce(list_max(list_filter(range(0, least(length(token), length(previous)) + 1), lambda j: substr(token, 1, j) = substr(previous, 1, j))), 0) as same from n),
x as (select *, least(same, 49) as pre from k),
symbols as (
  select 'kind' as part, t, kind as symbol from x union all select 'offset', t, a - p from x where kind = 1
  union all select 'number', t, greatest(1, ceil(log2(cast(a as double) + 1) / 7)) from x where kind = 2 union all select 'prefix', t, pre from x where kind = 3
  union all select 'text', t, ascii(substr(token, i, 1)) from (select *, unnest(range(pre + 1, length(token) + 1)) as i from x where kind = 3)
  union all select 'text', t, 0 from x where kind = 3),
c as (select part, t, symbol, count(*) as n from symbols group by all)"""


@query("raw_reads", _ID_PARTS + " " + " union all ".join(
    f"select '{part}' as part, cast(symbols as bigint) as symbols, round(bits, 1) as bits from ({_bits_sql(f'''select * from c where part = '{part}' ''', 't', size)}) where symbols > 0"
    for part, size in (("kind", 4), ("offset", 16), ("prefix", 50), ("text", 256))
) + " union all select 'number', cast(sum(n) as bigint), round(sum(n * symbol * 8.0), 1) from c where part = 'number' having sum(n) > 0")
def id_bits(spark, r):
    """Code length of identifiers by what is coded: kinds, offsets, numbers, prefixes, letters."""
    symbols = codec.id_symbols(read_plans._with_previous_tokens(r))
    return codec.id_bits(symbols).where("symbols > 0").select("part", "symbols", F.round("bits", 1).alias("bits"))


@query("raw_reads", """select _file, (no - 1) // 200 as block, cast(coalesce(sum(length(qual)), 0) as bigint) as symbols, true as same
from (select *, row_number() over (partition by _file order by _ord, read_no) as no from raw_reads) group by 1, 2""")
def range_coder(spark, r):
    """Qualities of blocks of 200 reads coded to bytes and decoded again."""
    blocks = archive._numbered(r, ["_file"], ["_ord", "read_no"], 200).groupBy("_file", "block").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_no", "qual"))), lambda x: x["qual"]).alias("quals")
    )
    return codec.code_blocks(blocks, F.col("quals"), ["_file", "block"]).select("_file", "block", "symbols", "same")


@query("aligned_reads", """select _file, (count(*) + 999) // 1000 as blocks, count(*) as reads, cast(sum(coalesce(length(seq), 0)) as bigint) as bases,
  cast(sum(strlen(id)) as bigint) as id_raw_bytes, cast(sum(coalesce(strlen(seq), 0)) as bigint) as seq_raw_bytes, cast(sum(coalesce(strlen(qual), 0)) as bigint) as qual_raw_bytes,
  true as smaller from aligned_reads group by _file""")
def archive_list_own(spark, a):
    """The list of an archive that this library wrote: raw and stored bytes, from its block table alone."""
    path = place(spark, "archive")
    archive.write(a, path, order=["_ord", "read_no"], reads=1000)
    listed = archive.ratios(convert.list_archive(spark, path))
    sound = (F.col("ratio") > 0) & (F.col("ratio") < 1) & (F.col("seq_comp_bytes") > 0) & (F.col("qual_comp_bytes") > 0)
    return listed.select("_file", "blocks", "reads", "bases", "id_raw_bytes", "seq_raw_bytes", "qual_raw_bytes", sound.alias("smaller"))


_CLEAN = "regexp_full_match(seq, '[ACGT]+')"


@query("raw_reads", f"""with g as (select read_no, seq, unnest(range(1, length(seq) + 1, 4)) as i from raw_reads where {_CLEAN}),
d as (select read_no, seq, i, rpad(translate(substr(seq, i, 4), 'ACGT', '0123'), 4, '0') as q from g)
select read_no, seq, string_agg(printf('%02X', cast(substr(q, 1, 1) as int) * 64 + cast(substr(q, 2, 1) as int) * 16 + cast(substr(q, 3, 1) as int) * 4 + cast(substr(q, 4, 1) as int)), '' order by i) as packed
from d group by read_no, seq""")
def twobit_pack(spark, r):
    """Sequences in two bits a letter, and unpacked again."""
    clean = r.where(F.col("seq").rlike("^[ACGT]+$")).select("read_no", packing.pack2("seq").alias("p"), F.length("seq").alias("n"))
    return clean.select("read_no", packing.unpack2("p", "n").alias("seq"), F.hex("p").alias("packed"))


_VARINT = " || ".join(f"case when k >= {i} then printf('%02X', ((v >> {7 * i}) & 127) | case when k > {i} then 128 else 0 end) else '' end" for i in range(9))
_GROUPS = " + ".join(f"case when v >= {1 << 7 * i} then 1 else 0 end" for i in range(1, 9))


@query("raw_reads", f"""with n as (select read_no, read_no * read_no * 7919 + coalesce(length(seq), 0) as v from raw_reads), k as (select *, {_GROUPS} as k from n)
select read_no, {_VARINT} as var, printf('%016X', v) as fixed, v as back, v as back_fixed from k""")
def integer_forms(spark, r):
    """Numbers as groups of seven bits and as eight bytes, and read again."""
    n = r.select("read_no", (F.col("read_no") * F.col("read_no") * 7919 + F.coalesce(F.length("seq"), F.lit(0))).alias("v"))
    coded = n.select("read_no", packing.varint("v").alias("a"), packing.big_endian("v", 8).alias("b"))
    return coded.select("read_no", F.hex("a").alias("var"), F.hex("b").alias("fixed"), packing.from_varint("a").alias("back"), packing.from_big_endian("b").cast("long").alias("back_fixed"))


@query("raw_reads", f"""with {read_plans._windows(12)} select k as kmer, cast(list_reduce(list_prepend(0, list_transform(range(1, 13), lambda i: instr('ACGT', substr(k, i, 1)) - 1)), lambda a, x: a * 4 + x) as bigint) as code, count(*) as n from w group by 1, 2""")
def kmer_codes(spark, r):
    """Codes of all 12-letter windows; the window is decoded from its code."""
    from strandloom.operators.kmers import kmer_rows

    coded = kmer_rows(r, F.col("seq"), 12, []).select(nucleotide.kmer_code("kmer").alias("code")).groupBy("code").agg(F.count("*").alias("n"))
    return coded.select(nucleotide.kmer_text("code", 12).alias("kmer"), "code", "n")


@query("raw_reads", f"""with {read_plans._windows(16)}, d as (select distinct k from w) select count(*) as kmers, count(*) as hashes, true as repeatable from d""")
def kmer_hashes(spark, r):
    """Distinct 16-letter windows and their distinct 64-bit hashes, which a second seed confirms."""
    from strandloom.operators.kmers import kmer_rows

    d = kmer_rows(r, F.col("seq"), 16, []).select("kmer").distinct()
    h, g = F.xxhash64("kmer"), F.xxhash64(F.lit(1), "kmer")
    return d.agg(F.count("*").alias("kmers"), F.count_distinct(h).alias("hashes"), (F.count_distinct(h) == F.count_distinct(g)).alias("repeatable"))


@query("raw_reads", """select read_no, nullif(substr(seq, 6, 1), '') as sixth, case when length(seq) > 5 then substr(seq, 1, 5) || '-' || substr(seq, 7) else seq end as edited from raw_reads""")
def letter_edit(spark, r):
    """The sixth letter, and the sequence with it replaced."""
    return r.select("read_no", packing.letter_at("seq", F.lit(5)).alias("sixth"), packing.with_letter("seq", F.lit(5), "-").alias("edited"))


@query("raw_reads", """with l as (select read_no, seq, lag(seq) over (partition by _file order by _ord, read_no) as p from raw_reads)
select read_no, cast(case when length(p) < length(seq) then -1 when length(p) > length(seq) then 1 when p < seq then -1 when p > seq then 1 when p = seq then 0 end as integer) as previous from l where p is not null and seq is not null""")
def length_first_order(spark, r):
    """How the read before compares: shorter first, then by letters."""
    from strandloom.operators.ordered import with_previous

    known = with_previous(r, {"p": F.col("seq")}, ["_file"], ["_ord", "read_no"])
    return known.where("p is not null and seq is not null").select("read_no", packing.compare("p", "seq").alias("previous"))


_CRC = f"""with recursive steps(i, c, n) as (
  select i, cast(i as ubigint), 0 from range(256) as r(i) union all
  select i, case when c & 1 = 1 then xor(c >> 1, cast({hashing.POLYNOMIAL} as ubigint)) else c >> 1 end, n + 1 from steps where n < 8),
t as (select list(c order by i) as tab from steps where n = 8),
b as (select read_no, tab, list_prepend(cast(18446744073709551615 as ubigint), list_transform(range(1, length(id) + 1), lambda i: cast(ascii(substr(id, i, 1)) as ubigint))) as bytes from raw_reads, t)"""


@query("raw_reads", f"{_CRC} select read_no, printf('%016x', xor(list_reduce(bytes, lambda c, x: xor(tab[cast(xor(c, x) & 255 as integer) + 1], c >> 8)), cast(18446744073709551615 as ubigint))) as crc from b")
def id_crc64(spark, r):
    """CRC-64 of every identifier."""
    return hashing.row_crcs(r, ["read_no"], ["id"]).select("read_no", hashing.hex64("crc_id").alias("crc"))


def _crc_sql(bytes_: str) -> str:
    return f"printf('%016x', xor(list_reduce({bytes_}, lambda c, x: xor(tab[cast(xor(c, x) & 255 as integer) + 1], c >> 8)), cast(18446744073709551615 as ubigint)))"


def _bytes_sql(text: str) -> str:
    return f"list_prepend(cast(18446744073709551615 as ubigint), list_transform(range(1, length({text}) + 1), lambda i: cast(ascii(substr({text}, i, 1)) as ubigint)))"


@query("aligned_reads", f"""{_CRC.rsplit('b as (', 1)[0]}
joined as (select _file, (no - 1) // 1000 as block, count(*) as reads, string_agg(id, '' order by no) as ids
  from (select *, row_number() over (partition by _file order by _ord, read_no) as no from aligned_reads) group by 1, 2)
select _file, block, reads, {_crc_sql(_bytes_sql('ids'))} as crc_id from joined, t""")
def block_id_crc64(spark, a):
    """CRC-64 over the identifiers of blocks of 1000 reads in file order."""
    return archive.block_checksums(a, ["id"], ["_file"], ["_ord", "read_no"], 1000)


ORACLES["tags_binary_bytes"] = """with e as (select read_no, unnest(map_entries(aux)).value as v from aligned_reads),
s as (select read_no, 3 + case substr(v.type, 1, 1) when 'B' then 5 + case when substr(v.type, 2, 1) in ('c', 'C') then 1 when substr(v.type, 2, 1) in ('s', 'S') then 2 when substr(v.type, 2, 1) = 'd' then 8 else 4 end * coalesce(len(v.ai), len(v.af), 0)
  when 'A' then 1 when 'Z' then strlen(v.s) + 1 when 'H' then strlen(v.s) + 1 when 'f' then 4 when 'd' then 8
  else case when v.i between -127 and 255 then 1 when v.i between -32767 and 65535 then 2 else 4 end end as b from e)
select a.read_no, cast(case when aux is null then null else coalesce(sum(b), 0) end as bigint) as bytes from aligned_reads a left join s using (read_no) group by a.read_no, aux is null"""


@query("aligned_reads", f"""with r as (select read_no, id, seq, qual, flags, {_REST} from aligned_reads)
select read_no, md5(concat_ws(chr(31), '+' || id, coalesce('+' || seq, '-'), coalesce('+' || qual, '-'), '+' || flags, coalesce('+' || seqname, '-'), '+' || cast(strand as varchar), coalesce('+' || pos, '-'), '+' || map_qual,
  coalesce('+' || cigar, '-'), coalesce('+' || mate_seqname, '-'), coalesce('+' || mate_pos, '-'), '+' || tlen, '+' || tags)) as digest from r""")
def record_md5(spark, a):
    """MD5 of every column of an alignment, CIGAR and tags included."""
    fields = ("id", "seq", "qual", "flags", "seqname", "strand", "pos", "map_qual", "cigar", "mate_seqname", "mate_pos", "tlen", "tags")
    return _shown(a, "read_no").select("read_no", hashing.row_digest(*fields).alias("digest"))


@query("headers", """select _file, record, tags['SN'] as name, tags['LN'] as length, tags['ID'] as id, cast(coalesce(cardinality(tags), 0) as integer) as n_tags from headers where record <> 'CO'""")
def header_lines(spark, h):
    """Header lines written as text and parsed again."""
    lines = h.where("record <> 'CO'").select("_file", F.col("line_no").alias("_ord"), sam.header_text(h).alias("value"))
    parsed = sam.parse_header(lines)
    return parsed.select("_file", "record", F.col("tags")["SN"].alias("name"), F.col("tags")["LN"].alias("length"), F.col("tags")["ID"].alias("id"), F.coalesce(F.size("tags"), F.lit(0)).alias("n_tags"))


@query("headers", """select _file, line_no, case when record = 'PG' and tags['ID'] is null then 'PG without ID' when record = 'RG' and tags['ID'] is null then 'RG without ID'
  when record = 'SQ' and tags['LN'] is null then 'SQ without LN' when record = 'SQ' and tags['SN'] is null then 'SQ without SN' when record = 'HD' and tags['VN'] is null then 'HD without VN' end as problem
from (select _file, line_no, record, map_from_entries(list_filter(map_entries(tags), lambda e: e.key not in ('LN', 'VN'))) as tags from headers)
where record in ('HD', 'SQ', 'RG', 'PG') and problem is not null""")
def header_validation(spark, h):
    """Problems of header lines from which lengths and versions were taken away."""
    less = h.withColumn("tags", F.map_filter("tags", lambda k, _: ~k.isin("LN", "VN")))
    return sam.header_problems(less).where("problem <> 'unknown record'")


@query("headers", """select record, cast(count(*) as bigint) as lines from (select distinct record, list_sort(map_entries(tags)) as e from headers
where record in ('RG', 'PG') and coalesce(tags['SN'], tags['ID']) not in (select n from (select record, coalesce(tags['SN'], tags['ID']) as n, list_sort(map_entries(tags)) as e from headers where record in ('RG', 'PG') group by all) where n is not null group by record, n having count(*) > 1)) group by record""")
def header_merge(spark, h):
    """Lines of the merged header of all files, without names whose lines disagree."""
    kept = h.where("record in ('RG', 'PG')").withColumn("n", F.coalesce(F.col("tags")["SN"], F.col("tags")["ID"]))
    lines = kept.select("record", "n", F.array_sort(F.map_entries("tags")).alias("e")).distinct()
    clash = lines.where("n is not null").groupBy("record", "n").count().where("count > 1").select("n").distinct()
    return sam.merge_headers(kept.where("n is not null").join(clash, "n", "left_anti").drop("n")).groupBy("record").agg(F.count("*").alias("lines"))


_NAMED = [("a.fastq", "archive"), ("b.fq.gz", "archive"), ("run.sam", "bam"), ("x.bam", "fastq"), ("x.fastq.reads", "fastq"), ("y.sam.bz2", "sam")]


@query("headers", """select * from (values ('a.fastq', 'fastq', 'archive', 'a.fastq.reads'), ('b.fq.gz', 'fastq', 'archive', 'b.fq.reads'), ('run.sam', 'sam', 'bam', 'run.bam'),
  ('x.bam', 'bam', 'fastq', 'x.fastq'), ('x.fastq.reads', 'archive', 'fastq', 'x.fastq'), ('y.sam.bz2', 'sam', 'sam', 'y.sam')) as t(name, format, target, output)""")
def output_names(spark, h):
    """Formats by name, and where a conversion goes if nothing is said."""
    rows = [(n, files.format_of_name(n), t, files.output_name(n, t)) for n, t in _NAMED]
    return spark.createDataFrame(rows, "name string, format string, target string, output string")


@query("raw_reads", "select count(*) as reads, true as kept, true as refused from raw_reads")
def sinks(spark, r):
    """The sink that discards takes every read; one that would replace files refuses, and they stay."""
    convert.write(r, "", "null")
    path = place(spark, "fastq")
    convert.write(r, path, "fastq")
    refused = False
    try:
        convert.write(r.limit(1), path, "fastq")
    except Exception as e:  # noqa: BLE001 - whatever the sink raises
        refused = "exist" in str(e).lower()
    back = fastq_count(spark, path)
    return r.agg(F.count("*").alias("reads")).select("reads", (F.col("reads") == back).alias("kept"), F.lit(refused).alias("refused"))


def fastq_count(spark: SparkSession, path: str) -> int:
    return convert.read(spark, path, "fastq").count()


@query("aligned_reads", """select _file, case when flags & 4 = 0 and seqname is not null and pos is not null and cigar is not null then 'reference' when seq is not null and seq <> '' then 'model' else 'none' end as route, count(*) as reads
from aligned_reads group by 1, 2""")
def read_routes(spark, a):
    """How many reads are coded against a reference, by the model, or have nothing to code."""
    from strandloom.operators.align import route

    return a.groupBy("_file", route(a).alias("route")).agg(F.count("*").alias("reads"))


@query("raw_reads", "select id as seqname, count(*) as count from raw_reads group by id having count(*) > 1")
def repeated_ids(spark, r):
    return fasta.repeated_names(r.select(F.col("id").alias("seqname")))


__all__ = ["ORACLES", "QUERIES", "fastq", "ident"]
