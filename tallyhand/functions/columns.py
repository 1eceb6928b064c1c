"""Small Column helpers shared by the other modules."""

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def any_of(*conds: Column) -> Column:
    out = F.lit(False)
    for cond in conds:
        out = out | cond
    return out


def all_of(*conds: Column) -> Column:
    out = F.lit(True)
    for cond in conds:
        out = out & cond
    return out


def yes(cond: Column) -> Column:
    """NULL counts as False."""
    return F.coalesce(cond, F.lit(False))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``use``.

    A plain Column used twenty times in one expression is computed and compiled twenty
    times; binding it to a lambda variable keeps long fallback chains small.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def first_match(text: Column, patterns: list[str], group: int = 1) -> Column:
    """First non-empty capture over an ordered pattern list, else NULL."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, group), F.lit("")) for p in patterns])


def lookup(table: dict, key: Column) -> Column:
    """Literal map lookup; NULL for unknown keys."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def count_true(cond: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, F.lit(1)).otherwise(F.lit(0)).cast("bigint")), F.lit(0).cast("bigint"))


def steady_round(value: Column, decimals: int) -> Column:
    """Half-up rounding that does not depend on the order partial sums were added in.

    Noise in the last bits of a double would otherwise push exact halves either way.
    """
    return F.round(F.round(value, 8), decimals)


def ratio_pct(att: Column, opp: Column, decimals: int = 2) -> Column:
    """att/opp as a percentage, 0.0 when there was no opportunity."""
    return F.when(opp > 0, F.round(att / opp * 100.0, decimals)).otherwise(F.lit(0.0))


def weighted_mean(value: Column, weight: Column) -> Column:
    """Aggregate: sum(v*w)/sum(w) over rows where v is present; NULL when no weight is left."""
    w = F.when(value.isNotNull(), weight)
    return F.try_divide(F.sum(value * w), F.sum(w))
