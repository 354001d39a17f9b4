"""Small column helpers used everywhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """Evaluate `value` once per row and hand it to `body`."""
    return F.element_at(F.transform(F.array(value), body), 1)


def no_strings() -> Column:
    return F.array().cast("array<string>")


WHITE_SPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
               "\u2028\u2029\u202f\u205f\u3000")


def strip(c: Column) -> Column:
    """Trim every kind of white space at both ends."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def collapse(c: Column) -> Column:
    """Runs of white space become one blank; ends trimmed."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def words(c: Column) -> Column:
    """White-space separated words, none empty."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def lookup(key: Column, pairs, default=None) -> Column:
    """Constant mapping as one map literal."""
    m = F.create_map(*[F.lit(x) for kv in pairs for x in kv])
    found = F.element_at(m, key)
    return found if default is None else F.coalesce(found, F.lit(default))


def steps(value: Column, thresholds, otherwise) -> Column:
    """Step function: the first (lower bound, result) whose bound is reached."""
    out = None
    for bound, result in thresholds:
        cond = value >= F.lit(bound)
        out = F.when(cond, F.lit(result)) if out is None else out.when(cond, F.lit(result))
    return out.otherwise(F.lit(otherwise))


def in_turn(pairs, otherwise=None) -> Column:
    """First true condition wins."""
    out = None
    for cond, result in pairs:
        r = result if isinstance(result, Column) else F.lit(result)
        out = F.when(cond, r) if out is None else out.when(cond, r)
    o = otherwise if isinstance(otherwise, Column) else F.lit(otherwise)
    return out.otherwise(o)


def stable_fraction(text: Column) -> Column:
    """The same number in [0, 1] for the same text, everywhere."""
    return F.conv(F.substring(F.sha1(text), 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)


def rounded(c: Column, digits: int) -> Column:
    return F.round(c.cast("double"), digits)


def computed_once(df, **cols):
    """Add costly columns so that later filters do not repeat the work.

    A filter on a projected column is pushed below the projection and evaluates it a
    second time. Behind a generator the value exists once and filters stay above it.
    """
    made = F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()])))
    return df.select(*[c for c in df.columns if c not in cols], made)


def half_up(c: Column, digits: int) -> Column:
    """Rounded with ties upwards, also where the tie is off by the error of a few additions."""
    one = 10 ** digits
    return F.floor(c * one + 0.5 + 1e-6) / one
