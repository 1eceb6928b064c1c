"""Predicate trees compiled to Columns.

A clause is a dict with one operator (``all any not eq eq_field in gte lte gt lt
is_true is_false``), a bare field name, a bool, or a list (AND). The compiled
Column is never NULL: a comparison on NULL is False, ``is_false`` and ``not`` on
NULL are True, ``eq`` compares with a literal and ``eq_field`` with another field.
A field that does not exist is an error when the metric is compiled.
"""

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

# A tree is written out as one SQL expression and parsed once: a catalogue has some
# hundred clauses, and building each as nested Column objects costs a round trip to the
# JVM per node.


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, str):
        escaped = value.replace("\\", "\\\\").replace("'", "\\'")
        return f"'{escaped}'"
    return f"{value}D" if isinstance(value, float) else str(value)


def _yes(test: str) -> str:
    return f"coalesce({test}, false)"


class Fields:
    """The columns a clause may name, with the truth test that fits their type."""

    def __init__(self, schema: T.StructType):
        self.types = {f.name: f.dataType for f in schema.fields}

    def name(self, field: str) -> str:
        if field not in self.types:
            raise ValueError(f"predicate names an unknown field: {field!r}")
        return f"`{field}`"

    def truth(self, field: str) -> str:
        col, kind = self.name(field), self.types[field]
        if isinstance(kind, T.BooleanType):
            return _yes(col)
        if isinstance(kind, T.NumericType):
            return _yes(f"{col} != 0")
        if isinstance(kind, T.StringType):
            return _yes(f"{col} != ''")
        return _yes(f"size({col}) > 0")


_COMPARE = {"gte": ">=", "lte": "<=", "gt": ">", "lt": "<"}


def clause_text(clause, fields: Fields) -> str:
    if clause is None:
        return "false"
    if isinstance(clause, bool):
        return _literal(clause)
    if isinstance(clause, str):
        return fields.truth(clause)
    if isinstance(clause, list):
        return clause_text({"all": clause}, fields)
    if not isinstance(clause, dict) or len(clause) != 1:
        raise ValueError(f"a clause needs exactly one operator: {clause!r}")
    (op, arg), = clause.items()
    if op in ("all", "any"):
        parts = [clause_text(c, fields) for c in arg] or [_literal(op == "all")]
        return "(" + (" AND " if op == "all" else " OR ").join(parts) + ")"
    if op == "not":
        return f"(NOT {clause_text(arg, fields)})"
    if op == "is_true":
        return fields.truth(arg)
    if op == "is_false":
        return f"(NOT {fields.truth(arg)})"
    field, value = arg
    col = fields.name(field)
    if op == "eq":
        return f"({col} <=> {_literal(value)})"
    if op == "eq_field":
        return _yes(f"{col} = {fields.name(value)}")
    if op == "in":
        return _yes(f"{col} IN ({', '.join(map(_literal, value))})")
    if op in _COMPARE:
        return _yes(f"{col} {_COMPARE[op]} {_literal(value)}")
    raise ValueError(f"unknown operator: {op!r}")


def filter_text(filters: dict | None, scope: str, fields: Fields) -> str:
    """The four per-metric filters: heads-up, pot type, effective stack, no all-in.

    The stack test always reads the single-raised-pot stack, whatever the pot type.
    """
    f = filters or {}
    tests = ["true"]
    if f.get("heads_up_only"):
        heads_up = fields.truth("heads_up_flop")
        tests.append(f"({heads_up} OR NOT {fields.truth('saw_flop')})" if scope == "postflop" else heads_up)
    if f.get("pot_type"):
        tests.append(clause_text({"in": ["pot_type", list(f["pot_type"])]}, fields))
    if f.get("eff_stack_min_bb") is not None:
        tests.append(clause_text({"gte": ["eff_stack_srp", float(f["eff_stack_min_bb"])]}, fields))
    if f.get("exclude_allin_preflop"):
        tests.append(f"NOT {fields.truth('any_allin_preflop')}")
    return " AND ".join(tests)


def compile_clause(clause, fields: Fields) -> Column:
    return F.expr(clause_text(clause, fields))


def metric_text(metric: dict, fields: Fields) -> tuple[str, str]:
    """(opportunity, attempt) as SQL; an attempt implies its opportunity."""
    passed = filter_text(metric.get("filters"), metric.get("scope", "preflop"), fields)
    opp = f"({passed} AND {clause_text(metric['opportunity'], fields)})"
    return opp, f"({opp} AND {clause_text(metric.get('attempt'), fields)})"


def compile_metric(metric: dict, df: DataFrame) -> tuple[Column, Column]:
    opp, att = metric_text(metric, Fields(df.schema))
    return F.expr(opp), F.expr(att)
