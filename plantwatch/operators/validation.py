"""Input checks: schema, then type, then finite values, then accepted ranges.

The strict mode refuses a whole batch and names the first offending row; the
quarantine mode keeps every row and lists the reasons, so that bad rows can be set
aside without stopping the rest.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType

from plantwatch import constants as K
from plantwatch.functions.expressions import finite
from plantwatch.session import materialise


@dataclass
class Rule:
    step: int
    place: int
    reason: str
    bad: Column
    message: Column


def check_columns(df: DataFrame, expected: list[str], system: str) -> DataFrame:
    """Exactly the expected columns, put into the expected order."""
    if not isinstance(df, DataFrame):
        raise TypeError("batch inference expects a DataFrame")
    missing = [c for c in expected if c not in df.columns]
    extra = [c for c in df.columns if c not in expected]
    if missing:
        raise ValueError(f"{system}: missing required features ({len(missing)}): " + ", ".join(missing))
    if extra:
        raise ValueError(f"{system}: unexpected features ({len(extra)}): " + ", ".join(extra))
    return df.select(*[F.col(f"`{c}`") for c in expected])


def check_numeric(df: DataFrame, columns: list[str], system: str) -> None:
    for c in columns:
        if not isinstance(df.schema[c].dataType, NumericType):
            raise ValueError(f"{system}: column '{c}' must be numeric")


def _row(row_id: str, system: str) -> Column:
    return F.concat(F.lit(f"{system}: row "), F.col(row_id).cast("string"), F.lit(": "))


def finite_rules(columns: list[str], row_id: str, system: str, step: int) -> list[Rule]:
    return [Rule(step, i, f"finite:{c}", ~finite(F.col(f"`{c}`")),
                 F.concat(_row(row_id, system), F.lit(f"'{c}' is NaN or infinite"))) for i, c in enumerate(columns)]


def machine_rules(row_id: str, system: str = "AI4I", bounds: dict = K.MACHINE_BOUNDS,
                  types: list[str] = K.MACHINE_TYPES, type_column: str = "Type") -> list[Rule]:
    t = F.col(type_column)
    shown = F.coalesce(F.concat(F.lit("'"), t, F.lit("'")), F.lit("None"))
    rules = [Rule(0, 0, f"domain:{type_column}", ~F.coalesce(t.isin(*types), F.lit(False)),
                  F.concat(_row(row_id, system), F.lit(f"'{type_column}' must be one of {types}, got "), shown))]
    rules += finite_rules(list(bounds), row_id, system, 1)
    for i, (c, (lo, hi)) in enumerate(bounds.items()):
        x = F.col(f"`{c}`").cast("double")
        rules.append(Rule(2 + i, 0, f"range:{c}", finite(x) & ((x < lo) | (x > hi)),
                          F.concat(_row(row_id, system), F.lit(f"'{c}'="), x.cast("string"),
                                   F.lit(f" is outside the accepted range [{lo}, {hi}]"))))
    return rules


def flow_rules(columns: list[str], row_id: str, system: str = "RT-IoT2022", limit: float = K.FLOW_ABS_LIMIT) -> list[Rule]:
    rules = finite_rules(columns, row_id, system, 0)
    for i, c in enumerate(columns):
        x = F.col(f"`{c}`").cast("double")
        rules.append(Rule(1, i, f"magnitude:{c}", finite(x) & (F.abs(x) > limit),
                          F.concat(_row(row_id, system),
                                   F.lit(f"'{c}' exceeds the sane magnitude limit {limit:g}"))))
    return rules


def with_reasons(df: DataFrame, rules: list[Rule], name: str = "reasons") -> DataFrame:
    """Add the list of violated rules in declared order; empty for a valid row."""
    return df.withColumn(name, F.array_compact(F.array(*[F.when(r.bad, F.lit(r.reason)) for r in rules])))


def split_valid(df: DataFrame, name: str = "reasons") -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with their reasons)."""
    return df.filter(F.size(name) == 0).drop(name), df.filter(F.size(name) > 0)


def _first_of_row(rules: list[Rule], row_id: str) -> Column:
    """The row's first violation by step, then column; NULL for a valid row."""
    return F.array_min(F.array_compact(F.array(*[F.when(r.bad, F.struct(
        F.lit(r.step).alias("step"), F.col(row_id).alias("row"), F.lit(r.place).alias("place"),
        r.message.alias("message"))) for r in rules])))


def first_violation(df: DataFrame, rules: list[Rule], row_id: str) -> str | None:
    """Message of the first violation: by step, then row, then column."""
    row = df.agg(F.min(_first_of_row(rules, row_id)).alias("m")).first()
    return row["m"]["message"] if row["m"] else None


def strict(df: DataFrame, rules: list[Rule], row_id: str, system: str, work: Callable[[DataFrame], DataFrame],
           label: str = "checked") -> DataFrame:
    """The table of ``work`` over the batch, refused if the batch is empty or any row breaks a rule.

    The rows are read once: a row that breaks a rule stops the job that writes the table. Only then is
    the batch read again, to name its first violation in declared order rather than the one met first.
    """
    first = _first_of_row(rules, row_id)
    stop = F.when(first.isNotNull(), F.raise_error(first["message"]).cast("boolean"))
    try:
        table = materialise(work(df.filter(F.coalesce(stop, F.lit(True)))), label)
    except PySparkException as e:
        message = first_violation(df, rules, row_id)
        if message:
            raise ValueError(message) from e
        raise
    if table.isEmpty():
        raise ValueError(f"{system}: empty batch")
    return table


def require_valid(df: DataFrame, rules: list[Rule], row_id: str, system: str) -> DataFrame:
    """Refuse the batch if it is empty or any row breaks a rule."""
    if df.isEmpty():
        raise ValueError(f"{system}: empty batch")
    message = first_violation(df, rules, row_id)
    if message:
        raise ValueError(message)
    return df
