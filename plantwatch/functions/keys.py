"""Content keys, stable hashes and hash-based weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, FloatType

from plantwatch import constants as K
from plantwatch.functions.expressions import as_col


def key_text(df: DataFrame, columns: list[str]) -> Column:
    """Text of the given columns; NULL and NaN are one value, and so are 0.0 and -0.0."""
    parts = []
    for name in columns:
        c = F.col(f"`{name}`")
        if isinstance(df.schema[name].dataType, (DoubleType, FloatType)):
            c = F.when(~F.isnan(c), F.when(c == 0, F.lit(0).cast("double")).otherwise(c))
        text = F.replace(c.cast("string"), F.lit("|"), F.lit("||"))
        parts.append(F.coalesce(text, F.lit("|0")))
    return F.concat_ws("|;", *parts)


def content_key(df: DataFrame, columns: list[str]) -> Column:
    """Duplicate-group id: a hash of the content, the same in every run."""
    return F.md5(key_text(df, columns))


def hash_hex(key: Column | str, salt: int | str, digits: int = 8) -> Column:
    """First hex digits of md5('key:salt'); uniform, ordered as text."""
    return F.substring(F.md5(F.concat(as_col(key).cast("string"), F.lit(f":{salt}"))), 1, digits)


def hex_cut(share: float) -> str:
    """Upper bound, as 8 hex digits, of the given share of the hash range."""
    return f"{min(int(share * 2**32), 2**32 - 1):08x}"


def hash_mod(key: Column | str, salt: int | str, n: Column | int) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    return F.pmod(F.conv(hash_hex(key, salt), 16, 10).cast("bigint"), n)


def poisson_weight(key: Column | str, replicate: Column | int) -> Column:
    """Poisson(1) bootstrap weight of a row in a replicate, from its hash alone."""
    rep = F.lit(replicate) if isinstance(replicate, int) else replicate
    h = F.substring(F.md5(F.concat_ws(":", as_col(key).cast("string"), rep.cast("string"))), 1, 8)
    out = F.lit(len(K.POISSON_HEX_CUTS))
    for w in reversed(range(len(K.POISSON_HEX_CUTS))):
        out = F.when(h < K.POISSON_HEX_CUTS[w], F.lit(w)).otherwise(out)
    return out
