"""Column expressions shared by the operators. No Python runs per row here."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from plantwatch import constants as K


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: Column, den: Column, empty: float | None = 0.0) -> Column:
    """num / den as double, ``empty`` where the denominator is 0 or NULL."""
    out = F.try_divide(num.cast("double"), den.cast("double"))
    return out if empty is None else F.coalesce(out, F.lit(float(empty)))


def finite(c: Column | str) -> Column:
    c = as_col(c).cast("double")
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def nan_to_null(c: Column | str) -> Column:
    c = as_col(c)
    return F.when(~F.isnan(c), c)


def at_least(score: Column | str, threshold: Column | float) -> Column:
    """score >= threshold; NaN and NULL scores are never positive."""
    score = as_col(score)
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return F.coalesce(~F.isnan(score) & (score >= t), F.lit(False))


def decision(score: Column | str, threshold: Column | float) -> Column:
    return at_least(score, threshold).cast("int")


def risk_level(score: Column | str, high=K.HIGH_RISK_THRESHOLD, medium=K.ATTACK_THRESHOLD) -> Column:
    return (F.when(at_least(score, high), "HIGH RISK")
            .when(at_least(score, medium), "MEDIUM RISK")
            .otherwise("LOW RISK"))


def classification(score: Column | str, threshold=K.ATTACK_THRESHOLD) -> Column:
    return F.when(at_least(score, threshold), "ATTACK").otherwise("NORMAL")


def machine_status(score: Column | str, primary=K.PRIMARY_THRESHOLD,
                   early=K.EARLY_WARNING_THRESHOLD) -> Column:
    return (F.when(at_least(score, primary), "HIGH RISK")
            .when(at_least(score, early), "EARLY WARNING")
            .otherwise("NORMAL"))


def fuse(status: Column | str, attack: Column | str) -> Column:
    """Level of one asset from its machine status and its confirmed network attack."""
    status, attack = as_col(status), F.coalesce(as_col(attack), F.lit(False))
    degraded = F.coalesce(status.isin("EARLY WARNING", "HIGH RISK"), F.lit(False))
    return (F.when(attack & degraded, "CRITICAL")
            .when(attack, "NETWORK ALERT")
            .when(status == "HIGH RISK", "ALARM")
            .when(status == "EARLY WARNING", "WARNING")
            .otherwise("OK"))


def severity(level: Column | str) -> Column:
    """Ordinal of a level, 0 for OK up to 4 for CRITICAL."""
    names = F.array(*[F.lit(x) for x in K.LEVELS])
    return (F.array_position(names, as_col(level)) - 1).cast("int")


def percent_text(p: Column | str) -> Column:
    """0.8235 -> '82.4%', built from whole tenths so every engine prints the same."""
    tenths = F.round(as_col(p) * 1000).cast("bigint")
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."),
                    F.pmod(tenths, F.lit(10)).cast("string"), F.lit("%"))


def explain_fusion(level, status, p, flagged, window) -> Column:
    """Operator-facing reason of a level, from the values that produced it."""
    level, status = as_col(level), as_col(status)
    pct = percent_text(p)
    share = F.concat(as_col(flagged).cast("string"), F.lit("/"), as_col(window).cast("string"))
    return (
        F.when(level == "CRITICAL", F.concat(
            F.lit("Machine is "), F.lower(status), F.lit(" ("), pct,
            F.lit(" failure probability) AND "), share,
            F.lit(" recent flows were classified as attacks: possible cyber-physical incident.")))
        .when(level == "NETWORK ALERT", F.concat(
            share, F.lit(" recent flows classified as attacks; machine health is normal.")))
        .when(level == "ALARM", F.concat(
            F.lit("Failure probability "), pct, F.lit(" is above the primary threshold.")))
        .when(level == "WARNING", F.concat(
            F.lit("Failure probability "), pct, F.lit(" is above the early-warning threshold.")))
        .otherwise("No warning from either model."))


def clock_text(tick: Column | str, minutes: int = K.TICK_MINUTES) -> Column:
    total = as_col(tick).cast("bigint") * minutes
    return F.format_string("T+%02d:%02d", F.floor(total / 60), F.pmod(total, F.lit(60)))


def flow_verdict(true_attack, flagged) -> Column:
    """Which cell of the confusion matrix a single flow falls into, in words."""
    t, f = as_col(true_attack), as_col(flagged)
    return (F.when(t & f, "correctly flagged").when(t, "MISSED")
            .when(f, "False alarm").otherwise("correctly passed"))


def wilson(k: Column, n: Column, z: float = K.WILSON_Z) -> tuple[Column, Column]:
    """Wilson score interval (low, high); NULL when n is 0."""
    n = n.cast("double")
    zz = F.lit(float(z)) * F.lit(float(z))
    p = F.try_divide(k.cast("double"), n)
    width = 1 + F.try_divide(zz, n)
    centre = (p + F.try_divide(zz, 2 * n)) / width
    half = F.lit(float(z)) * F.sqrt(F.try_divide(p * (1 - p), n)
                                    + F.try_divide(zz, 4 * n * n)) / width
    return centre - half, centre + half


def strip_prefix(name: Column | str) -> Column:
    """'num__Torque' -> 'Torque'; only the first '__' separates."""
    return F.regexp_replace(as_col(name), "^.*?__", "")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def binary_label(cls: Column | str, normal: list[str]) -> Column:
    return F.when(as_col(cls).isin(*normal), "Normal").otherwise("Attack")


def encode_label(label: Column | str, mapping: dict[str, int]) -> Column:
    """Dictionary encoding; a value outside the dictionary stops the query."""
    label = as_col(label)
    out = reduce(lambda acc, kv: acc.when(label == kv[0], F.lit(kv[1])),
                 list(mapping.items())[1:],
                 F.when(label == next(iter(mapping)), F.lit(next(iter(mapping.values())))))
    return out.otherwise(F.raise_error(
        F.concat(F.lit("no code for label "), F.coalesce(label.cast("string"), F.lit("NULL")))
    ).cast("int")).cast("int")
