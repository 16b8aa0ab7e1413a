"""Optional tags: map<string, struct<type,s,i,f,ai,af>>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TAG_TYPE = "struct<type:string,s:string,i:bigint,f:double,ai:array<bigint>,af:array<double>>"
AUX_TYPE = f"map<string,{TAG_TYPE}>"

#: Bytes of one element of each binary tag type.
WIDTH = {"A": 1, "a": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4, "d": 8}


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parse_tags(fields: Column | str) -> Column:
    """array of ``KK:T:VALUE`` to the tag map; malformed fields are dropped.

    A repeated key keeps its last value.  Integers of any text type become i,
    a, c and C are characters; numbers that don't parse are null.
    """

    def one(field: Column) -> Column:
        kind, value = F.substring(field, 4, 1), F.substring(field, F.lit(6), F.greatest(F.length(field), F.lit(6)))
        listed = F.split(value, ",")
        rest = F.slice(listed, F.lit(2), F.greatest(F.size(listed) - 1, F.lit(0)))
        is_float = listed[0].isin("f", "d")
        type_ = F.when(kind.isin("a", "A", "c", "C"), "A").when(kind.isin("i", "I", "s", "S"), "i").otherwise(kind)
        nothing = F.lit(None)
        tag = F.struct(
            F.when(kind == "B", F.concat(F.lit("B"), listed[0])).otherwise(type_).alias("type"),
            F.when(type_.isin("A", "Z", "H"), value).otherwise(nothing.cast("string")).alias("s"),
            F.when(type_ == "i", value.try_cast("bigint")).alias("i"),
            F.when(kind.isin("f", "d"), value.try_cast("double")).alias("f"),
            F.when((kind == "B") & ~is_float, F.transform(rest, lambda v: v.try_cast("bigint"))).alias("ai"),
            F.when((kind == "B") & is_float, F.transform(rest, lambda v: v.try_cast("double"))).alias("af"),
        )
        return F.struct(F.substring(field, 1, 2).alias("key"), tag.alias("value"))

    good = F.filter(_col(fields), lambda f: f.rlike("^[A-Za-z][A-Za-z0-9]:[aAcCsSiIfdZHB]:"))
    parsed = F.transform(good, one)
    # Most reads repeat no key; only where one does are the last occurrences picked.
    keys = F.transform(good, lambda f: F.substring(f, 1, 2))
    back = F.reverse(keys)
    last = F.filter(parsed, lambda p, i: F.array_position(back, p["key"]) == F.size(keys) - i)
    return F.map_from_entries(F.when(F.size(F.array_distinct(keys)) == F.size(keys), parsed).otherwise(last))


def narrow_type(value: Column | str) -> Column:
    """The smallest binary integer type of a value: c, s, i when negative, else C, S, I."""
    v = _col(value)
    return (
        F.when(v.isNull(), None)
        .when(v < -32767, "i")
        .when(v < -127, "s")
        .when(v < 0, "c")
        .when(v <= 255, "C")
        .when(v <= 65535, "S")
        .otherwise("I")
    )


def short_float(value: Column) -> Column:
    """A double as C's %g prints it: six significant digits, no trailing zeros.

    Decided by the decimal exponent of the rounded value: plain notation for
    -4..5, otherwise scientific with at least two exponent digits.
    """
    v = _col(value)
    sci = F.format_string("%.5e", v)
    exponent = F.regexp_extract(sci, "e([+-][0-9]+)$", 1).cast("int")
    digits = F.regexp_replace(F.regexp_extract(sci, "^(-?[0-9.]+)e", 1), "\\.?0+$", "")
    plain = F.when(exponent >= 5, F.format_string("%.0f", v))
    for e in range(-4, 5):
        plain = F.when(exponent == e, F.format_string(f"%.{5 - e}f", v)).otherwise(plain)
    stripped = F.when(plain.contains("."), F.regexp_replace(plain, "\\.?0+$", "")).otherwise(plain)
    return (
        F.when(v.isNull(), None)
        .when(F.isnan(v), "nan")
        .when(v == float("inf"), "inf")
        .when(v == float("-inf"), "-inf")
        .when(exponent.between(-4, 5), stripped)
        .otherwise(F.concat(digits, F.regexp_extract(sci, "(e[+-][0-9]+)$", 1)))
    )


def sorted_tags(aux: Column | str) -> Column:
    """array<struct<key,value>> in key order."""
    return F.array_sort(F.map_entries(_col(aux)))


def element_type(tag: Column) -> Column:
    """Element type of an array tag; i or f where only B is said."""
    given = F.substring(tag["type"], 2, 1)
    return F.when(given != "", given).when(tag["af"].isNotNull(), "f").otherwise("i")


def format_tag(key: Column, tag: Column) -> Column:
    kind = F.substring(tag["type"], 1, 1)
    ints = F.array_join(F.transform(tag["ai"], lambda v: v.cast("string")), ",")
    floats = F.array_join(F.transform(tag["af"], short_float), ",")
    body = (
        F.when(kind == "B", F.concat_ws(",", element_type(tag), F.nullif(F.coalesce(ints, floats, F.lit("")), F.lit(""))))
        .when(kind.isin("f", "d"), short_float(tag["f"]))
        .when(kind.isin("A", "Z", "H"), tag["s"])
        .otherwise(tag["i"].cast("string"))
    )
    shown = F.when(kind.isin("c", "C", "s", "S", "i", "I"), "i").when(kind == "d", "f").otherwise(kind)
    return F.concat(key, F.lit(":"), shown, F.lit(":"), body)


def format_tags(aux: Column | str) -> Column:
    """Tags as text in key order, joined by TAB; empty for none."""
    return F.array_join(F.transform(sorted_tags(aux), lambda e: format_tag(e["key"], e["value"])), "\t")


def text_bytes(aux: Column | str) -> Column:
    """Bytes of the tags as text, tabs between them included; 0 for none."""
    sizes = F.transform(F.map_entries(_col(aux)), lambda e: F.octet_length(format_tag(e["key"], e["value"])) + 1)
    total = F.aggregate(sizes, F.lit(0), lambda acc, n: acc + n)
    return F.when(F.coalesce(F.size(_col(aux)), F.lit(0)) > 0, total - 1).otherwise(0)


def binary_bytes(aux: Column | str) -> Column:
    """Bytes of the tags in binary form: 3 and the value of each, integers narrowed."""

    def size(e: Column) -> Column:
        tag = e["value"]
        kind = F.substring(tag["type"], 1, 1)
        narrow = F.when(narrow_type(tag["i"]).isin("c", "C"), 1).when(narrow_type(tag["i"]).isin("s", "S"), 2).otherwise(4)
        element = F.lit(4)
        for k, w in WIDTH.items():
            element = F.when(element_type(tag) == k, w).otherwise(element)
        listed = 5 + element * F.coalesce(F.size(tag["ai"]), F.size(tag["af"]), F.lit(0))
        value = (
            F.when(kind == "B", listed)
            .when(kind == "A", 1)
            .when(kind.isin("Z", "H"), F.octet_length(tag["s"]) + 1)
            .when(kind == "f", 4)
            .when(kind == "d", 8)
            .otherwise(narrow)
        )
        return 3 + value

    return F.aggregate(F.transform(F.map_entries(_col(aux)), size), F.lit(0), lambda acc, n: acc + n)


def tag_int(aux: Column | str, key: str) -> Column:
    return _col(aux)[key]["i"]


def tag_float(aux: Column | str, key: str) -> Column:
    tag = _col(aux)[key]
    return F.coalesce(tag["f"], tag["i"].cast("double"))


def tag_text(aux: Column | str, key: str) -> Column:
    return _col(aux)[key]["s"]


def drop_tags(aux: Column | str, *keys: str) -> Column:
    return F.map_filter(_col(aux), lambda k, _: ~k.isin(*keys))


def keep_tags(aux: Column | str, *keys: str) -> Column:
    return F.map_filter(_col(aux), lambda k, _: k.isin(*keys))
