"""Column helpers that keep the text rules of the engine inside built-in expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Python's strip() removes these; Spark's trim only the space.
WS = " \t\n\r\f\x0b"
NUMBER = r"-?[0-9]+(?:\.[0-9]+)?"


def strip(c: Column, chars: str = WS) -> Column:
    return F.btrim(c, F.lit(chars))


def squeeze(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+", " ")


def parts(c: Column) -> Column:
    return F.transform(F.split(c, "[|]"), lambda x: strip(x))


def first_number(c: Column) -> Column:
    """The first number of a text, null if there is none."""
    return F.regexp_substr(c, F.lit(NUMBER))


def number(c: Column) -> Column:
    """A text that is a number and nothing else, as a double; null otherwise."""
    return F.when(c.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$"), F.expr("try_cast(0 AS DOUBLE)") + c.try_cast("double"))


def words(c: Column, table: dict[str, Iterable[str]], otherwise: Column | None = None) -> Column:
    """The canonical value whose accepted words hold ``c``; the first that does."""
    out = None
    for value, accepted in table.items():
        hit = c.isin(list(accepted))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out if otherwise is None else out.otherwise(otherwise)


def lookup(c: Column, table: dict[str, str], otherwise: Column | None = None) -> Column:
    """A literal map, looked up once."""
    found = F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)
    return found if otherwise is None else F.coalesce(found, otherwise)


def first_pattern(c: Column, rules: list[tuple[str, str]], otherwise: str | None = None) -> Column:
    """The canonical value of the first pattern that is found in ``c``."""
    out = None
    for pattern, value in rules:
        hit = c.rlike(pattern)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out if otherwise is None else out.otherwise(otherwise)


def first_prefix(c: Column, rules: list[tuple[str, str]]) -> Column:
    """The value of the longest prefix of ``c``; equally long ones cannot both be."""
    out = None
    for prefix, value in sorted(rules, key=lambda r: -len(r[0])):
        hit = c.startswith(prefix)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def any_of(c: Column, needles: Iterable[str]) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | c.contains(n)
    return out


def any_prefix(c: Column, prefixes: Iterable[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | c.startswith(p)
    return out


def safe_ratio(n: Column, d: Column) -> Column:
    return F.coalesce(F.try_divide(n, d), F.lit(0.0))


def once(df: DataFrame, keep: list[str], **cols: Column) -> DataFrame:
    """``keep`` and new columns that are computed once, however often later expressions use them.

    The columns come out of a generator, through which the optimizer neither pushes a filter nor
    merges a projection. Without it a column used n times, by columns used n times, and so on, is
    copied into each place, and plans grow beyond what the optimizer can hold.
    """
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a column that is computed once, however often ``f`` uses it; works inside lambdas too."""
    return F.get(F.transform(F.array(c), lambda x: f(x)), F.lit(0))


def line(*cols: Column) -> Column:
    return F.concat_ws("|", *cols)
