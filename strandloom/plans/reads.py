"""Registered queries over reads, qualities, identifiers and models, with SQL to check them by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import ident, nucleotide, quality
from strandloom.functions.hashing import row_digest, stream_digest
from strandloom.operators import kmers, models, ordered
from strandloom.session import spread

#: Queries that make many rows or long arrays of each read.
HEAVY = {
    "canonical_kmer_count_25", "kmer_count_saturated", "kmer_spectrum", "low_complexity_kmers", "kmer_sketch", "seed_index_12",
    "qual_context_counts", "nt_context_counts", "nt_entropy_order_3", "nt_adaptive_bits",
}
QUERIES: dict = {}
ORACLES: dict[str, str] = {}
FILE, ORDER = ["_file"], ["_ord", "read_no"]
_ACGT = "regexp_full_match({}, '[ACGT]+')"
_CANON = "least({0}, reverse(translate({0}, 'ACGT', 'TGCA')))"


def query(sql: str | None = None):
    """Register a query of (reads) under its function's name, with SQL if there is any."""

    def register(make):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            reads = spark.read.parquet(f"{sf_dir}/raw_reads.parquet")
            return make(spread(reads) if make.__name__ in HEAVY else reads)

        run.__name__, run.__doc__ = make.__name__, make.__doc__
        QUERIES[make.__name__] = run
        if sql:
            ORACLES[make.__name__] = sql
        return run

    return register


def _n(c: Column) -> Column:
    return c.cast("long")


@query("select read_no, id, seq, qual from raw_reads")
def reads_projection(r):
    return r.select("read_no", "id", "seq", "qual")


@query("""select _file, count(*) as reads, cast(coalesce(sum(length(seq)), 0) as bigint) as bases,
  round(sum(length(seq) - length(translate(seq, 'GCgc', ''))) / sum(length(seq)), 9) as gc,
  round(sum(list_sum(list_transform(string_split(qual, ''), lambda c: case when c = '' then 0 else ascii(c) - 33 end))) / sum(length(qual)), 6) as mean_phred
from raw_reads group by _file""")
def gc_by_file(r):
    total = F.aggregate(quality.phred("qual"), F.lit(0).cast("long"), lambda a, q: a + q)
    return r.groupBy("_file").agg(
        F.count("*").alias("reads"),
        _n(F.coalesce(F.sum(F.length("seq")), F.lit(0))).alias("bases"),
        F.round(F.sum(nucleotide.gc_count("seq")) / F.sum(F.length("seq")), 9).alias("gc"),
        F.round(F.sum(total) / F.sum(F.length("qual")), 6).alias("mean_phred"),
    )


@query("select length(seq) as length, count(*) as reads from raw_reads group by 1")
def read_length_hist(r):
    return r.groupBy(_n(F.length("seq")).alias("length")).agg(F.count("*").alias("reads"))


@query("select read_no, cast(length(seq) - length(translate(seq, 'Nn', '')) as bigint) as n_letters from raw_reads")
def n_mask_count(r):
    return r.select("read_no", _n(F.aggregate(nucleotide.n_mask("seq"), F.lit(0), lambda a, m: a + m.cast("int"))).alias("n_letters"))


@query("select read_no, translate(seq, 'ACGTacgt', 'TGCAtgca') as seq from raw_reads")
def complement(r):
    return r.select("read_no", nucleotide.complement("seq").alias("seq"))


@query("select read_no, reverse(translate(seq, 'ACGTacgt', 'TGCAtgca')) as seq from raw_reads")
def revcomp(r):
    return r.select("read_no", nucleotide.revcomp("seq").alias("seq"))


@query("select read_no, coalesce(regexp_full_match(seq, '[ACGTN]+'), null) as clean from raw_reads")
def nucleotide_check(r):
    return r.select("read_no", nucleotide.is_nucleotides("seq").alias("clean"))


def _windows(k: int, table: str = "raw_reads") -> str:
    return f"""w as (select read_no, i - 1 as off, substr(s, i, {k}) as k from (select read_no, upper(seq) as s, unnest(range(1, length(seq) - {k - 2})) as i from {table} where length(seq) >= {k})
  where {_ACGT.format(f"substr(s, i, {k})")})"""


@query(f"with {_windows(25)} select {_CANON.format('k')} as kmer, count(*) as n from w group by 1")
def canonical_kmer_count_25(r):
    return kmers.count_kmers(r, F.col("seq"))


@query(f"with {_windows(12)} select {_CANON.format('k')} as kmer, least(count(*), 1023) as n from w group by 1")
def kmer_count_saturated(r):
    return kmers.count_kmers(r, F.col("seq"), 12, cap=kmers.COUNT_CAP)


@query(f"with {_windows(25)}, c as (select {_CANON.format('k')} as kmer, least(count(*), 1023) as n from w group by 1) select n, count(*) as kmers from c group by n")
def kmer_spectrum(r):
    return kmers.spectrum(kmers.count_kmers(r, F.col("seq"), cap=kmers.COUNT_CAP))


@query(f"""with {_windows(12)} select distinct {_CANON.format('k')} as kmer from w where substr(k, 1, 11) = substr(k, 2) or substr(k, 1, 10) = substr(k, 3) or substr(k, 1, 9) = substr(k, 4)""")
def low_complexity_kmers(r):
    rows = kmers.kmer_rows(r, F.col("seq"), 12)
    return rows.where(nucleotide.low_complexity("kmer")).select(nucleotide.canonical("kmer").alias("kmer")).distinct()


@query(f"with {_windows(12)} select {_CANON.format('k')} as kmer, count(*) as n, true as bounded from w group by 1")
def kmer_sketch(r):
    """Counts of the 12-mers of the table, and whether the count-min sketch of 4 x 2**20 cells bounds each from above."""
    wanted = kmers.count_kmers(r, F.col("seq"), 12)
    sketch = kmers.approximate_counts(r, F.col("seq"), 12)
    found = kmers.approximate_lookup(sketch, wanted.select("kmer")).withColumnRenamed("n", "at_most")
    return wanted.join(found, "kmer").select("kmer", "n", (F.col("at_most") >= F.col("n")).alias("bounded"))


@query(f"""with {_windows(12)}, c as (select read_no, off, k, {_CANON.format('k')} as kmer from w),
  p as (select *, row_number() over (partition by kmer order by read_no, off) as no from c)
select kmer, count(*) as positions, count_if(k <> kmer) as reversed from p where no <= 255 group by kmer""")
def seed_index_12(r):
    index = kmers.seed_index(r, "read_no", "seq")
    return index.groupBy("kmer").agg(F.count("*").alias("positions"), F.count_if("reverse").alias("reversed"))


@query("""with l as (select *, lag(seq) over (partition by _file order by _ord, read_no) as p from raw_reads)
select read_no, case when length(seq) = length(p) and length(seq) > 0 then hamming(seq, p) when length(seq) = length(p) then 0 end as mismatches from l""")
def hamming_pairs(r):
    known = ordered.with_previous(r, {"p": F.col("seq")}, FILE, ORDER)
    return known.select("read_no", _n(nucleotide.hamming("seq", "p")).alias("mismatches"))


_PATTERN = ident.PATTERN.replace("\\t", "\t")
_TOKENS = f"""t as (select read_no, _file, _ord, i - 1 as token_no, tokens[i] as token from (
  select read_no, _file, _ord, tokens, unnest(range(1, len(tokens) + 1)) as i from (select *, regexp_extract_all(id, '{_PATTERN}', 1) as tokens from raw_reads)))"""


@query(f"with {_TOKENS} select read_no, cast(token_no as integer) as token_no, token from t")
def id_tokens(r):
    return r.select("read_no", F.posexplode(ident.tokens("id")).alias("token_no", "token"))


@query(f"with {_TOKENS} select cast(token_no as integer) as token_no, regexp_full_match(token, '[1-9][0-9]*') as number, count(*) as n from t group by 1, 2")
def id_token_type(r):
    return id_tokens_of(r).groupBy("token_no", ident.is_number("token").alias("number")).agg(F.count("*").alias("n"))


def id_tokens_of(r: DataFrame) -> DataFrame:
    return r.select("read_no", "_file", "_ord", F.posexplode(ident.tokens("id")).alias("token_no", "token"))


def _with_previous_tokens(r: DataFrame) -> DataFrame:
    known = ordered.with_previous(r, {"before": ident.tokens("id")}, FILE, ORDER)
    rows = known.select("read_no", "before", F.posexplode(ident.tokens("id")).alias("token_no", "token"))
    return rows.withColumn("previous", F.get("before", F.col("token_no"))).drop("before")


_PREVIOUS = f"""b as (select *, regexp_extract_all(id, '{_PATTERN}', 1) as tokens from raw_reads),
l as (select read_no, tokens, lag(tokens) over (partition by _file order by _ord, read_no) as before from b),
t as (select read_no, cast(i - 1 as integer) as token_no, tokens[i] as token, before[i] as previous from (select *, unnest(range(1, len(tokens) + 1)) as i from l)),
n as (select *, case when regexp_full_match(token, '[1-9][0-9]*') then cast(token as hugeint) end as a, case when regexp_full_match(previous, '[1-9][0-9]*') then cast(previous as hugeint) end as p from t)"""


@query(f"""with {_PREVIOUS} select read_no, token_no, case when a is not null and p is not null and a - p between 0 and 15 then 'NUM_OFF' when a is not null then 'NUM'
  when token = previous then 'MATCH' else 'STR' end as kind from n""")
def id_delta_kind(r):
    return _with_previous_tokens(r).select("read_no", "token_no", ident.delta_kind("token", "previous").alias("kind"))


@query(f"""with {_PREVIOUS} select read_no, token_no,
  cast(coalesce(list_max(list_filter(range(0, least(length(token), length(previous)) + 1), lambda j: substr(token, 1, j) = substr(previous, 1, j))), 0) as integer) as prefix from n""")
def id_prefix_match_len(r):
    return _with_previous_tokens(r).select("read_no", "token_no", ident.common_prefix("token", "previous").alias("prefix"))


@query(f"with {_PREVIOUS} select token_no, cast(a - p as bigint) as step, count(*) as n from n where a is not null and p is not null and a - p between 0 and 15 group by 1, 2")
def id_numeric_offset_hist(r):
    rows = _with_previous_tokens(r)
    step = (ident.number("token") - ident.number("previous")).cast("long")
    return rows.where(ident.delta_kind("token", "previous") == "NUM_OFF").groupBy("token_no", step.alias("step")).agg(F.count("*").alias("n"))


_SCORES = "s as (select read_no, _file, _ord, i, ascii(substr(qual, i, 1)) - 33 as q, length(qual) as len from (select *, unnest(range(1, length(qual) + 1)) as i from raw_reads))"


@query(f"with {_SCORES} select q, count(*) as n from s group by q")
def qual_hist(r):
    return r.select(F.explode(quality.phred("qual")).alias("q")).groupBy("q").agg(F.count("*").alias("n"))


def _chunks(r: DataFrame) -> DataFrame:
    low, high = F.array_min(quality.phred("qual", 0)), F.array_max(quality.phred("qual", 0))
    numbered = ordered.with_row_number(r.select("_file", "_ord", "read_no", low.alias("low"), high.alias("high")), "no", FILE, ORDER)
    return numbered.groupBy("_file", F.floor((F.col("no") - 1) / 5000).alias("chunk")).agg(F.min("low").alias("low"), F.max("high").alias("high"))


_CHUNKED = "c as (select *, (row_number() over (partition by _file order by _ord, read_no) - 1) // 5000 as chunk from raw_reads)"
_MINMAX = f"""{_CHUNKED}, m as (select _file, chunk, min(list_min(list_transform(range(1, length(qual) + 1), lambda j: ascii(substr(qual, j, 1))))) as low,
  max(list_max(list_transform(range(1, length(qual) + 1), lambda j: ascii(substr(qual, j, 1))))) as high from c group by _file, chunk)"""


@query(f"with {_MINMAX} select _file, chunk, low, high from m")
def qual_min_max_by_chunk(r):
    return _chunks(r)


@query(f"""with recursive {_MINMAX}, f as (
  select _file, chunk, case when low < 33 or high >= 97 then low else 33 end as base from m where chunk = 0
  union all
  select m._file, m.chunk, case when m.low < f.base or m.high >= f.base + 64 then m.low else f.base end from m join f on m._file = f._file and m.chunk = f.chunk + 1
) select _file, chunk, cast(base as integer) as base from f""")
def qual_scheme_guess(r):
    return ordered.scheme_changes(_chunks(r), FILE).select("_file", "chunk", "base")


_BIN42 = "case when {0} <= 35 then {0} + 1 when {0} = 36 then 38 when {0} = 37 then 39 when {0} = 38 then 40 else 41 end"
_BIN16 = "case when {0} <= 1 then 1 when {0} <= 9 then 2 when {0} <= 24 then 3 when {0} <= 29 then 4 when {0} <= 39 then {0} - 25 else 15 end"


@query(f"with {_SCORES} select cast({_BIN42.format('q')} as integer) as bin, count(*) as n from s group by 1")
def qual_bin42(r):
    return r.select(F.explode(quality.phred("qual")).alias("q")).groupBy(quality.bin42(F.col("q")).alias("bin")).agg(F.count("*").alias("n"))


@query(f"with {_SCORES}, b as (select {_BIN42.format('q')} as b from s) select cast({_BIN16.format('b')} as integer) as bin, count(*) as n from b group by 1")
def qual_bin16(r):
    scores = r.select(F.explode(quality.phred("qual")).alias("q"))
    return scores.groupBy(quality.bin16(quality.bin42(F.col("q"))).alias("bin")).agg(F.count("*").alias("n"))


_BEFORE = f"{_SCORES}, p as (select *, lag(q) over (partition by read_no order by i) as p from s)"


@query(f"""with {_BEFORE}, j as (select read_no, case when p is null then 0 else {_BIN42.format('p')} end as b, q from p)
select r.read_no, cast(case when qual is null then null else least(coalesce(count_if(b - q < -1 or b - q >= 1), 0), 49) end as integer) as jumps
from raw_reads r left join j on r.read_no = j.read_no group by r.read_no, qual""")
def qual_jump_coded(r):
    return r.select("read_no", quality.jump_total(quality.phred("qual"), True).alias("jumps"))


@query(f"""with {_BEFORE} select r.read_no, cast(case when qual is null then null else least(coalesce(count_if(abs(q - p) > 1), 0), 49) end as integer) as jumps
from raw_reads r left join p on r.read_no = p.read_no group by r.read_no, qual""")
def qual_jump_readme(r):
    return r.select("read_no", quality.jump_total(quality.phred("qual"), False).alias("jumps"))


@query(f"with {_BEFORE} select p as q0, q as q1, least(count(*), 250) as n from p where p between 0 and 40 and q between 0 and 40 group by 1, 2")
def qual_pair_prior(r):
    return models.quality_pairs(r, F.col("qual"))


@query(f"""with {_SCORES}, l as (
  select *, lag(q, 1) over w as a1, lag(q, 2) over w as a2, lag(q, 3) over w as a3, lag(q, 4) over w as a4 from s window w as (partition by read_no order by i)
), b as (
  select *, case when a1 is null then 0 else {_BIN42.format('a1')} end as q1, case when a2 is null then 0 else {_BIN42.format('a2')} end as b2,
    case when a3 is null then 0 else {_BIN42.format('a3')} end as b3, case when a4 is null then 0 else {_BIN42.format('a4')} end as b4 from l
), d as (
  select *, least(coalesce(sum(case when q1 - q < -1 or q1 - q >= 1 then 1 else 0 end) over (partition by read_no order by i rows between unbounded preceding and 1 preceding), 0), 49) as jumps from b
), x as (
  select cast((i - 1) // cast(ceil(len / 4) as integer) as integer) as pos4,
    case when jumps = 0 then 0 when jumps = 1 then 1 when jumps <= 4 then 2 when jumps <= 9 then 3 when jumps <= 17 then 4 when jumps <= 27 then 5 when jumps <= 48 then 6 else 7 end as delta,
    greatest(case when a3 is null then 0 else {_BIN16.format('b3')} end, case when a4 is null then 0 else {_BIN16.format('b4')} end) as q34,
    case when a2 is null then 0 else {_BIN16.format('b2')} end as q2, q1, q from d
) select pos4, delta, q34, q2, q1, q, count(*) as n from x group by all""")
def qual_context_counts(r):
    return models.quality_context_counts(r, F.col("qual"))


@query("""with l as (select *, lag(length(seq)) over w as p, row_number() over w as no from raw_reads window w as (partition by _file order by _ord, read_no)),
g as (select *, sum(case when no = 1 or length(seq) is distinct from p then 1 else 0 end) over (partition by _file order by _ord, read_no) - 1 as run from l)
select _file, cast(run as bigint) as run, length(seq) as value, count(*) as n from g group by _file, run, length(seq)""")
def readlen_rle(r):
    return ordered.run_lengths(r, _n(F.length("seq")), FILE, ORDER)


def _totals(r: DataFrame, reads: int) -> DataFrame:
    size = lambda c: F.coalesce(F.octet_length(c), F.lit(0))
    return ordered.chunk_totals(r, FILE, ORDER, {"bases": F.length("seq"), "id_bytes": size("id"), "seq_bytes": size("seq"), "qual_bytes": size("qual")}, reads)


_TOTALS = """select _file, (no - 1) // {0} as chunk, count(*) as reads, cast(coalesce(sum(length(seq)), 0) as bigint) as bases, cast(sum(coalesce(strlen(id), 0)) as bigint) as id_bytes,
  cast(sum(coalesce(strlen(seq), 0)) as bigint) as seq_bytes, cast(sum(coalesce(strlen(qual), 0)) as bigint) as qual_bytes
from (select *, row_number() over (partition by _file order by _ord, read_no) as no from raw_reads) group by 1, 2"""


@query(_TOTALS.format(5000))
def chunk_totals(r):
    return _totals(r, 5000)


@query(f"""with recursive t as ({_TOTALS.format(50)}), f as (
  select _file, chunk, cast(0 as bigint) as block, case when bases > 20000 then 1 else 0 end as closes, case when bases > 20000 then 0 else bases end as held from t where chunk = 0
  union all
  select t._file, t.chunk, f.block + f.closes, case when f.held + t.bases > 20000 then 1 else 0 end, case when f.held + t.bases > 20000 then 0 else f.held + t.bases end
  from t join f on t._file = f._file and t.chunk = f.chunk + 1
) select t._file, block, cast(sum(reads) as bigint) as reads, cast(sum(bases) as bigint) as bases from t join f on t._file = f._file and t.chunk = f.chunk group by 1, 2""")
def block_totals(r):
    """Blocks that close beyond 20,000 bases at chunks of 50 reads (the defaults are 5,000,000 and 5000)."""
    cuts = ordered.block_cuts(_totals(r, 50), FILE, most=20_000)
    return cuts.groupBy("_file", "block").agg(F.sum("reads").alias("reads"), F.sum("bases").alias("bases"))


@query(f"with {_windows(12)} select substr(k, 1, 11) as context, substr(k, 12, 1) as symbol, count(*) as n from w group by 1, 2")
def nt_context_counts(r):
    return models.context_counts(models.nucleotide_contexts(r, F.col("seq"), 11), ["context"], "symbol")


@query(f"""with {_windows(4)}, c as (select substr(k, 1, 3) as context, substr(k, 4, 1) as symbol, count(*) as n from w group by 1, 2),
t as (select context, sum(n) as t from c group by context)
select cast(sum(n) as bigint) as symbols, round(sum(-n * log2(n / t)), 3) as bits, round(sum(-n * log2(n / t)) / sum(n), 9) as bits_per_symbol from c join t using (context)""")
def nt_entropy_order_3(r):
    counts = models.context_counts(models.nucleotide_contexts(r, F.col("seq"), 3), ["context"], "symbol")
    out = models.entropy(counts, ["context"], "symbol")
    return out.select("symbols", F.round("bits", 3).alias("bits"), F.round("bits_per_symbol", 9).alias("bits_per_symbol"))


@query(f"""with {_windows(3)}, x as (select substr(k, 1, 2) as context, substr(k, 3, 1) as symbol, read_no, off from w),
c as (select context, row_number() over (partition by context, symbol order by read_no, off) as rs, row_number() over (partition by context order by read_no, off) as rc from x)
select context, count(*) as symbols, round(sum(-log2(rs / (rc + 3))), 2) as bits from c group by context""")
def nt_adaptive_bits(r):
    counts = models.context_counts(models.nucleotide_contexts(r, F.col("seq"), 2), ["context"], "symbol")
    return models.adaptive_bits(counts, ["context"], "symbol", 4).withColumn("bits", F.round("bits", 2))


@query()
def nt_halving_bits(r):
    """Order-2 model per file whose counts are halved: a fold in file order."""
    rows = models.nucleotide_contexts(r, F.col("seq"), 2, ["_file", "_ord", "read_no"])
    coded = rows.withColumn("s", F.instr(F.lit("ACGT"), F.col("symbol")) - 1)
    return models.halving_bits(coded, ["_file", "context"], ["_ord", "read_no", "at"], "s", 4)


@query("""select read_no, md5(concat_ws(chr(31), '+' || id, coalesce('+' || seq, '-'), coalesce('+' || qual, '-'))) as digest from raw_reads""")
def row_md5(r):
    return r.select("read_no", row_digest("id", "seq", "qual").alias("digest"))


@query("""with d as (select md5(concat_ws(chr(31), '+' || id, coalesce('+' || seq, '-'), coalesce('+' || qual, '-'))) as h from raw_reads)
select count(*) as rows, cast(sum(cast('0x' || substr(h, 1, 12) as hugeint)) % 2305843009213693951 as bigint) as low,
  cast(sum(cast('0x' || substr(h, 17, 12) as hugeint)) % 2305843009213693951 as bigint) as high from d""")
def stream_digest_fastq(r):
    return stream_digest(r, "id", "seq", "qual")


@query("select read_no, _file from (select *, row_number() over (partition by _file order by _ord, read_no) as no from raw_reads) where no <= 100")
def first_n_reads(r):
    return ordered.first_rows(r, 100, FILE, ORDER).select("read_no", "_file")


@query("""with n as (select *, row_number() over (partition by _file order by _ord, read_no) as no from raw_reads),
m as (select _file, max(no) as size from n where no <= 500 group by _file)
select read_no, _file from n join m using (_file) where no <= 500 and no > size - 50""")
def seed_reservoir(r):
    return ordered.reservoir(r, 500, 50, FILE, ORDER).select("read_no", "_file")
