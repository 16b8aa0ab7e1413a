"""Read identifiers: tokens and their comparison with the read before."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Separators, longest token, largest numeric offset.
SEPARATORS = "\\t ./:"
TOKEN_CAP = 49
OFFSET_CAP = 16

#: A separator run with text up to the next separator unless a digit 1-9 follows;
#: a number without leading zero; text up to the next separator.
PATTERN = f"([{SEPARATORS}]+[^1-9{SEPARATORS}][^{SEPARATORS}]*|[{SEPARATORS}]+|[1-9][0-9]*|[^{SEPARATORS}]+)"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokens(ident: Column | str) -> Column:
    """Tokens of an identifier in order; their concatenation is the identifier."""
    return F.regexp_extract_all(_col(ident), F.lit(PATTERN), F.lit(1))


def is_number(token: Column | str) -> Column:
    """True for a number without leading zero that fits 64 unsigned bits."""
    token = _col(token)
    return token.rlike("^[1-9][0-9]*$") & (
        (F.length(token) < 20) | ((F.length(token) == 20) & (token <= F.lit("18446744073709551615")))
    )


def number(token: Column | str) -> Column:
    """The value of a numeric token as decimal(20,0); null for text."""
    token = _col(token)
    return F.when(is_number(token), token.cast("decimal(20,0)"))


def common_prefix(a: Column | str, b: Column | str) -> Column:
    """Length of the common prefix; 0 if either is null."""
    a, b = _col(a), _col(b)
    n = F.when(a.isNotNull() & b.isNotNull(), F.least(F.length(a), F.length(b)))
    differing = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    found = F.when(F.size(differing) > 0, differing[0] - 1).otherwise(n)
    return F.when(F.coalesce(n, F.lit(0)) > 0, found).otherwise(0)


def delta_kind(token: Column | str, previous: Column | str) -> Column:
    """How a token is coded against the same token of the previous read.

    MATCH: equal text; NUM_OFF: numbers, equal or up to 15 more; NUM: any other
    number; STR: any other text.
    """
    token, previous = _col(token), _col(previous)
    a, b = number(token), number(previous)
    return (
        F.when(a.isNotNull() & b.isNotNull() & (a - b >= 0) & (a - b < OFFSET_CAP), "NUM_OFF")
        .when(a.isNotNull(), "NUM")
        .when(token == previous, "MATCH")
        .otherwise("STR")
    )
