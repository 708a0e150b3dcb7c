"""Named queries with, where SQL can express them, the equivalent SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .frames import Market

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def nudged(sql: str) -> str:
    """Move every ``round(x, n) + 0.0`` off exact halves, as ``frames.shown`` does.

    Engines may round an exact half differently; a shift of a thousandth of the last
    kept digit decides it the same way in both.
    """
    out, at = [], 0
    for start in re.finditer(r"\bround\(", sql):
        if start.start() < at:
            continue
        depth, i = 1, start.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[i], 0)
            i += 1
        inner, kept = sql[start.end():i - 1], re.match(r" \+ 0\.0\b", sql[i:])
        digits = re.search(r",\s*(\d+)$", inner)
        if kept and digits:
            value = inner[:digits.start()]
            out += [sql[at:start.start()], f"round(({value}) + 1e-{int(digits.group(1)) + 3}, {digits.group(1)})"]
            at = i
    return "".join(out) + sql[at:]


def query(name: str, sql: str | None = None):
    """Register a function of a ``Market`` under a name."""

    def register(build: Callable[[Market], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(Market(spark, folder))

        if name in QUERIES:
            raise KeyError(name)
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = nudged(sql)
        return build

    return register
