"""Small helpers to build Spark SQL expression text."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, functions as F


def lit(value: str) -> str:
    """Quote a string for Spark SQL."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def array(values) -> str:
    return "array(" + ", ".join(lit(v) for v in values) + ")"


def in_list(expr: str, values) -> str:
    return f"{expr} IN (" + ", ".join(lit(v) for v in values) + ")"


def add(df: DataFrame, **cols: str) -> DataFrame:
    """One projection that adds several SQL expressions; they see only ``df``'s columns."""
    return df.withColumns({name: F.expr(sql) for name, sql in cols.items()})


def any_contains(expr: str, words) -> str:
    return "(" + " OR ".join(f"contains({expr}, {lit(w)})" for w in words) + ")"


def any_endswith(expr: str, words) -> str:
    return "(" + " OR ".join(f"endswith({expr}, {lit(w)})" for w in words) + ")"


def count_contains(expr: str, words) -> str:
    return "(" + " + ".join(f"int(contains({expr}, {lit(w)}))" for w in words) + ")"


def count_char(expr: str, ch: str) -> str:
    return f"(length({expr}) - length(replace({expr}, {lit(ch)}, '')))"


_NAMES = itertools.count()


def let(expr: str, body) -> str:
    """SQL that evaluates ``expr`` once and binds it to a name inside ``body(name)``.

    Without it an expression that mentions its input several times is multiplied whenever the
    optimizer substitutes it into a filter or a grouping key.
    """
    name = f"v{next(_NAMES)}"
    return f"transform(array({expr}), {name} -> {body(name)})[0]"


def pin(df: DataFrame, *cols: str) -> DataFrame:
    """Compute ``cols`` in a step of their own (a one-element explode).

    For join keys that are derived through many small projections: the optimizer otherwise writes
    out the whole derivation of the key for each rule that traces it, which grows exponentially.
    """
    rest = [c for c in df.columns if c not in cols]
    df = df.select(*rest, F.explode(F.array(F.struct(*cols))).alias("_pin"))
    return df.select(*rest, *[F.col(f"_pin.{c}").alias(c) for c in cols])


def items(array_col: str):
    """An array column to hand to ``explode``. Exploding the bare column makes the optimizer add a
    "not empty" filter below, which repeats the whole derivation of a computed array."""
    return F.expr(f"filter({array_col}, x -> true)")
