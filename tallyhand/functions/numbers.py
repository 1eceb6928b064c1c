"""Money and stack amounts in mixed notations, as Columns."""

from pyspark.sql import Column, functions as F

from tallyhand.functions.columns import let


def _float(text: Column) -> Column:
    return F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), text.try_cast("double"))


def amount(value: Column) -> Column:
    """Number with either separator convention; 0.0 when nothing can be read.

    The right-most separator decides. It marks decimals, unless it is the only kind
    and exactly three digits follow it.
    """

    def read(text: Column) -> Column:
        comma = F.instr(F.reverse(text), ",")
        dot = F.instr(F.reverse(text), ".")
        no_comma = F.replace(text, F.lit(","), F.lit(""))
        no_dot = F.replace(text, F.lit("."), F.lit(""))
        comma_last = (comma > 0) & ((dot == 0) | (comma < dot))
        dot_last = (dot > 0) & ((comma == 0) | (dot < comma))
        return (
            F.when(comma_last & (comma == 4) & (dot == 0), no_comma)
            .when(comma_last, F.replace(no_dot, F.lit(","), F.lit(".")))
            .when(dot_last & (dot == 4) & (comma == 0), no_dot)
            .when(dot_last, no_comma)
            .otherwise(text)
        )

    plain = let(F.regexp_replace(F.trim(value), r"[€£$R¥₹\s]", ""), read)
    return F.coalesce(let(plain, _float), F.lit(0.0))


def amount_simple(value: Column) -> Column:
    """Older rule: a lone comma with up to two digits after it is decimal, else thousands. NULL if unreadable."""
    text = F.regexp_replace(F.trim(F.regexp_replace(value, r"[$€£¥₹¢]", "")), r"^[()]+|[()]+$", "")
    parts = F.split(text, ",")
    lone = text.contains(",") & ~text.contains(".")
    decimal = lone & (F.size(parts) == 2) & (F.length(F.get(parts, F.lit(1))) <= 2)
    plain = F.when(decimal, F.replace(text, F.lit(","), F.lit("."))).otherwise(F.replace(text, F.lit(","), F.lit("")))
    return _float(plain)


def amount_us(value: Column) -> Column:
    """Point decimals, comma thousands; 0.0 when nothing can be read."""
    return F.coalesce(let(F.regexp_replace(value, r"[€$£¥R,\s\[\]]", ""), _float), F.lit(0.0))


def decimal_comma(value: Column) -> Column:
    """CSV cell with a decimal comma; empty and ``NA`` are 0."""
    text = F.trim(value)
    return F.when(text.isNull() | text.isin("", "NA"), F.lit(0.0)).otherwise(
        F.replace(text, F.lit(","), F.lit(".")).try_cast("double")
    )
