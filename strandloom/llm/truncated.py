"""Texts that were cut off, by comparing their last trigram with all trigrams.

A text is split into words, numbers, line ends and single marks.  Words that
hold at least ``share`` of all words (1/200, so at most 200 words, the only
thing that reaches the driver) stay themselves; others become their class
(capitalised, all capitals, lower case, number), so that trigrams recur.  All
trigrams are counted inside texts, the last ones also as ends.  A text is
flagged if its last trigram is frequent inside texts but almost never ends one:
if it ends texts of another ending less than ``rate`` times as often as an
average token does.  The rate of a trigram leans on that of its last two tokens,
and theirs on the last one, with the weight of so many occurrences (``priors``,
from one token to three).  A last
word that begins a frequent word without being one may be half a word, and the
trigram before it is judged.

Nothing else decides: there is no list of endings.  Every text is read to its
end and whole; blanks and one mark of omission behind the last token are left
out.  The table is tokenised once for the frequent words and once for the
trigrams, which then come from a table of the tokens' hashes; everything is SQL
with partial sums, and only words and trigram hashes are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.session import cut

#: Tokens that texts must share at their ends to count as one ending, as revisions of a page do.
ENDING = 16

TOKEN = r"\\p{L}+|[0-9]+|\\n+|[^\\s\\p{L}0-9]"

#: A token's class; marks stay themselves, words of letters without case are lower case.
_CLASS = """
  case when ascii(t) between 48 and 57 then '9' when ascii(t) = 10 then '\\n'
       when upper(t) = lower(t) then if(length(t) > 1, 'a', t)
       when upper(t) = t then if(length(t) > 1, 'U', 'A')
       when lower(left(t, 1)) = left(t, 1) then 'a' else 'A' end"""

_BLANKS = r"' \n\r\t'"


def _trimmed(text: str) -> str:
    """SQL of a text without the blanks, and one mark of omission, behind its last token."""
    t = f"rtrim({_BLANKS}, {text})"
    cases = " ".join(f"when endswith(t, '{m}') then rtrim({_BLANKS}, left(t, length(t) - {len(m)}))" for m in ("[...]", "...", "…"))
    cases += " when endswith(t, '�') then rtrim('�', t)"  # letters of which only some bytes came through
    return f"transform(array({t}), t -> case {cases} else t end)[0]"


def frequent_sql(table: str, text: str, share: float) -> str:
    """SQL of the words that hold at least ``share`` of all words: at most 1 / share rows."""
    return rf"""
with words as (
  select t, count(*) as n from (select explode(regexp_extract_all(`{text}`, '\\p{{L}}+', 0)) as t from {table}) group by t
)
select t from words where n >= (select sum(n) from words) * {share!r} order by t
"""


def shapes_sql(table: str, row_id: str, text: str, known: list[str]) -> str:
    """SQL of (row_id, tail, half, s): hashes of a text's tokens behind three starts, of its ending, and whether
    its last token may be half a word; null for texts without tokens."""
    words = ", ".join(f"'{w}'" for w in known) or "''"
    start = "xxhash64('^')"
    return f"""
select row_id, xxhash64(slice(tokens, greatest(1, size(tokens) - {ENDING - 1}), {ENDING})) as tail,
  element_at(tokens, -1) not in ({words}) and exists(array({words}), w -> startswith(w, element_at(tokens, -1))) as half,
  concat(array({start}, {start}, {start}), transform(tokens, t -> xxhash64(case when t in ({words}) then t else {_CLASS} end))) as s
from (select `{row_id}` as row_id, regexp_extract_all({_trimmed(f"`{text}`")}, '{TOKEN}', 0) as tokens from {table})
where size(tokens) > 0
"""


def lift_sql(shapes: str, priors: tuple[float, float, float]) -> str:
    """SQL of (tail, lift) from the result of shapes_sql()."""
    own = ", ".join(f"max(if(l.k = {k}, greatest(n - l.c, 0), 0)) as n{k}, max(if(l.k = {k}, greatest(e - 1, 0), 0)) as e{k}" for k in (1, 2, 3))
    one, two, three = priors
    return f"""
with grams as (
  select `0` as a, `1` as b, `2` as c, count(*) as n
  from (select inline(arrays_zip(slice(s, 2, size(s) - 3), slice(s, 3, size(s) - 3), slice(s, 4, size(s) - 3))) from {shapes})
  group by all
), grouped as (
  select k, g, sum(n) as n from (
    select inline(array(struct(3 as k, xxhash64(a, b, c) as g, n), struct(2 as k, xxhash64(b, c) as g, n), struct(1 as k, xxhash64(c) as g, n))) from grams
  ) group by k, g
), tails as (
  select tail, count(*) as c, any_value(slice(s, size(s) - 2 - cast(half as int), 3)) as x from {shapes} group by tail
), lasts as (
  select tail, c, inline(array(struct(3 as k, xxhash64(x[0], x[1], x[2]) as g), struct(2 as k, xxhash64(x[1], x[2]) as g), struct(1 as k, xxhash64(x[2]) as g))) from tails
), terminal as (
  select k, g, count(*) as e from lasts group by k, g
), rated as (
  select t.k, t.g, g.n, t.e from terminal t join grouped g on g.k = t.k and g.g = t.g
), judged as (
  select l.tail, {own} from lasts l left join rated r on l.k = r.k and l.g = r.g group by l.tail
), base as (
  select (select count(*) from tails) / greatest((select sum(n) from grams), 1) as p
)
select tail, (e3 + {three!r} * (e2 + {two!r} * (e1 + {one!r} * (select p from base)) / (n1 + {one!r})) / (n2 + {two!r})) / (n3 + {three!r}) / (select p from base) as lift
from judged
"""


def truncated_texts(df: DataFrame, row_id: str = "doc_id", text: str = "text", rate: float = 0.8, share: float = 0.005, priors: tuple[float, float, float] = (30.0, 300.0, 3000.0)) -> DataFrame:
    """(``row_id``, ``truncated``, ``lift``) for every row.

    ``lift`` is how often the ending ends texts, relative to an average token;
    null for texts without tokens (null, empty, blank), which are not truncated.
    Row ids must be unique; rows of equal text are judged alike.  An empty table
    gives an empty result.  Other columns do not matter.
    """
    spark: SparkSession = df.sparkSession
    name = "strandloom_truncated_texts"
    df.select(row_id, text).createOrReplaceTempView(name)
    known = [r[0] for r in spark.sql(frequent_sql(name, text, share)).collect()]  # at most 1 / share words
    shapes = cut(spark.sql(shapes_sql(name, row_id, text, known)))
    shapes.createOrReplaceTempView(f"{name}_shapes")
    lifts = spark.sql(lift_sql(f"{name}_shapes", priors))
    judged = shapes.select("row_id", "tail").join(lifts, "tail").select(F.col("row_id").alias(row_id), "lift")
    out = df.select(row_id).join(judged, row_id, "left")
    return out.select(row_id, F.coalesce(F.col("lift") < rate, F.lit(False)).alias("truncated"), "lift")


def truncation_rates(df: DataFrame, source: str = "source", row_id: str = "doc_id", text: str = "text", **options: float) -> DataFrame:
    """(``source``, ``texts``, ``truncated``, ``rate``) per source; a null source is a source."""
    flags = truncated_texts(df, row_id, text, **options).select(row_id, "truncated")
    joined = df.select(row_id, source).join(flags, row_id)
    return joined.groupBy(source).agg(
        F.count("*").alias("texts"), F.count_if("truncated").alias("truncated"), F.avg(F.col("truncated").cast("int")).alias("rate")
    )
