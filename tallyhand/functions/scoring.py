"""Scores (0-100) of a percentage against its ideal, and their labels."""

from pyspark.sql import Column, functions as F


def _clamp(score: Column) -> Column:
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), score))


def _num(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def score_step(pct: Column, ideal: Column, step_down, step_up, points_down=10.0, points_up=10.0) -> Column:
    """Whole steps away from the ideal cost points; a step includes its upper edge."""
    diff = pct - ideal
    width = F.when(diff > 0, F.greatest(_num(step_up), F.lit(1e-9))).otherwise(F.greatest(_num(step_down), F.lit(1e-9)))
    mult = F.abs(diff) / width
    whole = F.floor(mult)
    steps = F.when((mult - whole < 0.0001) & (whole > 0), whole - 1).otherwise(whole)
    points = F.when(diff > 0, _num(points_up)).otherwise(_num(points_down))
    return F.when(diff == 0, F.lit(100.0)).otherwise(_clamp(100.0 - steps * points))


def score_linear(pct: Column, ideal: Column, step_down, step_up, points_down=10.0, points_up=10.0) -> Column:
    diff = pct - ideal
    up = diff / F.greatest(_num(step_up), F.lit(1e-9)) * _num(points_up)
    down = -diff / F.greatest(_num(step_down), F.lit(1e-9)) * _num(points_down)
    return _clamp(100.0 - F.when(diff >= 0, up).otherwise(down))


SCORERS = {"step": score_step, "linear": score_linear}


def score_tier(pct: Column, ideal: Column, down_pct, up_pct) -> Column:
    """Tiers whose width is a share of the ideal; 10 points per tier, 0 without an ideal."""
    dev = pct - ideal
    width = ideal * F.when(dev < 0, _num(down_pct)).otherwise(_num(up_pct)) / 100.0
    tier = F.floor(F.try_divide(F.abs(dev), width))
    return (
        F.when(ideal.isNull(), F.lit(0.0))
        .when(F.abs(dev) < 0.001, F.lit(100.0))
        .otherwise(F.coalesce(_clamp(100.0 - tier * 10.0), F.lit(0.0)))
    )


def deviation_trend(pct: Column, ideal: Column) -> Column:
    dev = pct - ideal
    return F.when(F.abs(dev) < 0.5, "ideal").when(dev < 0, "below").otherwise("above")


def confidence(opportunities: Column) -> Column:
    return F.when(opportunities >= 100, "high").when(opportunities >= 50, "medium").otherwise("low")


def _bands(value: Column, bands: list[tuple[float, str]], rest: str, missing: str) -> Column:
    out = F.when(value.isNull(), missing)
    for floor, label in bands:
        out = out.when(value >= floor, label)
    return out.otherwise(rest)


# Label bands.
def score_note(score: Column) -> Column:
    return _bands(score, [(90, "Excelente"), (75, "Bom"), (60, "OK"), (40, "A ajustar")], "Crítico", "Sem amostra")


def score_grade(score: Column) -> Column:
    return _bands(score, [(90, "A"), (80, "B"), (70, "C"), (60, "D")], "E", "-")


def score_color(score: Column) -> Column:
    return _bands(
        score, [(90, "#22c55e"), (75, "#84cc16"), (60, "#eab308"), (40, "#f97316")], "#ef4444", "#ef4444"
    )


def range_grade(pct: Column, low: Column, high: Column) -> Column:
    """A inside the range; outside C when less than 3 points off, else D; '-' without a range."""
    off = F.round(F.greatest(low - pct, pct - high), 2)
    return (
        F.when(pct.isNull() | low.isNull() | high.isNull(), "-")
        .when((pct >= low) & (pct <= high), "A")
        .when(off < 3, "C")
        .otherwise("D")
    )


def range_text(pct: Column, low: Column, high: Column) -> Column:
    span = F.format_string("(%.2f–%.2f)", low, high)
    return (
        F.when(pct.isNull() | low.isNull() | high.isNull(), "")
        .when(pct < low, F.concat(F.lit("Abaixo do ideal "), span, F.format_string("; falta %.2f pp.", F.round(low - pct, 2))))
        .when(pct > high, F.concat(F.lit("Acima do ideal "), span, F.format_string("; excede %.2f pp.", F.round(pct - high, 2))))
        .otherwise(F.concat(F.lit("Dentro do ideal "), span, F.lit(".")))
    )


def performance_ratio(wins: Column, opps: Column, player_sum: Column) -> Column:
    """Win rate over the rate expected from the mean number of players."""
    return F.when((opps > 0) & (player_sum > 0), F.round(wins / opps * (player_sum / opps), 2)).otherwise(F.lit(0.0))


def action_ratio(att: Column, opp: Column) -> Column:
    """att/opp, not a percentage; 10.0 stands for 'only attempts'."""
    return F.when(opp > 0, F.round(att / opp, 2)).when(att > 0, F.lit(10.0)).otherwise(F.lit(0.0))
