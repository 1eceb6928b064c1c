"""All registered queries and oracles."""

from checks import counts, facts, files, runs, streams, textcounters, texts

MODULES = [counts, facts, texts, textcounters, runs, streams, files]


def queries() -> dict:
    return {name: fn for m in MODULES for name, fn in m.QUERIES.items()}


def oracles() -> dict:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
