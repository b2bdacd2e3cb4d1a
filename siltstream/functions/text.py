"""Column expressions for the comparison rules of labels, addresses and text measures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters trimmed from text, and the tokens that stand for no value.
BLANKS = " \t\n\r\f\v "
NAN_TOKENS = ["nan", "+nan", "-nan"]
NULL_TOKENS = ["null", "none", "na", "n/a", "#n/a", "<na>"]
INFINITE = r"^[+-]?inf(inity)?$"
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?$"
INTEGER = r"^[+-]?[0-9]+$"


def trimmed(value: Column) -> Column:
    return F.btrim(value, F.lit(BLANKS))


def category(value: Column) -> Column:
    """Labels and categories compare trimmed, with single spaces, ignoring case; null stays null."""
    return F.lower(F.regexp_replace(trimmed(value), r"[\s ]+", " "))


def token_class(value: Column) -> Column:
    """missing, nan, null_marker, infinite, number or other."""
    token = F.lower(trimmed(value))
    return (
        F.when(value.isNull() | (token == ""), "missing")
        .when(token.isin(NAN_TOKENS), "nan")
        .when(token.isin(NULL_TOKENS), "null_marker")
        .when(token.rlike(NUMBER), "number")
        .when(token.rlike(INFINITE), "infinite")
        .otherwise("other")
    )


def number(value: Column) -> Column:
    """The value of a text that is a number, else null; minus zero counts as zero."""
    token = F.lower(trimmed(value))
    return F.when(token.rlike(NUMBER), token.try_cast("double") + F.lit(0.0))
