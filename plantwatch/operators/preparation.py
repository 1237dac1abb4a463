"""Column-wise preparation fitted on one split and applied to any table.

A fitted ``Preprocessor`` is a handful of numbers and lists; applying it is plain
column arithmetic. It is stored as JSON next to the model it belongs to.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, functions as F

from plantwatch.functions.expressions import nan_to_null
from plantwatch.operators.quantiles import exact_percentiles, melt
from plantwatch.session import SMALL_TABLE_ROWS, fits_one_task, pin_small


def medians(df: DataFrame, columns: list[str]) -> dict[str, float]:
    if fits_one_task(df):
        # One pass; the counted values of a column are at most the rows of a task.
        cells = [F.percentile(nan_to_null(F.col(f"`{c}`").cast("double")), F.lit(0.5)).alias(f"m{i}") for i, c in enumerate(columns)]
        return dict(zip(columns, df.agg(*cells).first()))
    rows = exact_percentiles(df, columns, [0.5]).collect()
    return {r["feature"]: r["value"] for r in rows}


def text_values(df: DataFrame, columns: list[str], most: int = SMALL_TABLE_ROWS) -> tuple[dict, dict]:
    """Most frequent value (the smallest on ties) and sorted value list per column.

    Only the value counts are fetched, and no more than ``most`` of them: a column
    with more values is not a category.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("f"), F.col(f"`{c}`").cast("string").alias("v")) for c in columns])
    counts = df.select(F.inline(cells)).filter(F.col("v").isNotNull()).groupBy("f", "v").count()
    rows = counts.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"columns {columns} have more than {most} categories; do not encode them")
    values = {c: sorted((r for r in rows if r["f"] == c), key=lambda r: (-r["count"], r["v"])) for c in columns}
    return ({c: v[0]["v"] for c, v in values.items() if v},
            {c: sorted(r["v"] for r in v) for c, v in values.items()})


def modes(df: DataFrame, columns: list[str]) -> dict[str, str]:
    return text_values(df, columns)[0]


def categories(df: DataFrame, column: str) -> list[str]:
    return text_values(df, [column])[1][column]


def filled_scales(df: DataFrame, values: dict[str, float]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column once missing cells hold the given value.

    Worked out from the moments of the present cells and the number of missing ones.
    """
    rows = melt(df, list(values)).groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"), F.count("v").alias("k"), F.coalesce(F.avg("v"), F.lit(0.0)).alias("m"),
        F.coalesce(F.var_pop("v"), F.lit(0.0)).alias("q")).collect()
    out = {}
    for r in rows:
        share, gap = r["k"] / r["n"], values[r["feature"]] - r["m"]
        mean = r["m"] + (1 - share) * gap
        out[r["feature"]] = (mean, (share * r["q"] + share * (1 - share) * gap * gap) ** 0.5)
    return out


def scales(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column."""
    rows = melt(df, columns).groupBy("feature").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).collect()
    return {r["feature"]: (r["m"], r["s"]) for r in rows}


def fill_medians(df: DataFrame, values: dict[str, float]) -> DataFrame:
    return df.withColumns({c: F.coalesce(nan_to_null(F.col(f"`{c}`").cast("double")), F.lit(v))
                           for c, v in values.items()})


def fill_modes(df: DataFrame, values: dict[str, str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(v)) for c, v in values.items()})


def standardise(df: DataFrame, values: dict[str, tuple[float, float]]) -> DataFrame:
    """(x - mean) / population deviation; a constant column becomes 0."""
    return df.withColumns({c: (F.col(f"`{c}`").cast("double") - F.lit(m)) / F.lit(s or 1.0)
                           for c, (m, s) in values.items()})


def one_hot(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """One 0/1 column per known category; an unknown value is 0 in all of them."""
    return df.withColumns({f"{column}_{v}": F.coalesce(F.col(column) == v, F.lit(False)).cast("int")
                           for v in values})


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight n / (classes * rows of the class) per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total, classes = counts.agg(F.sum("n")).scalar(), counts.agg(F.count(F.lit(1))).scalar()
    return counts.withColumn("weight", total / (classes * F.col("n")).cast("double"))


def with_class_weight(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    w = pin_small(class_weights(df, label)).select(F.col(label).alias("_class"), F.col("weight").alias(name))
    return df.join(w, df[label].eqNullSafe(w["_class"])).drop("_class")


@dataclass
class Preprocessor:
    """Median + scaling for numbers, most frequent + one-hot for categories; the rest is dropped."""

    numeric: list[str]
    categorical: list[str] = field(default_factory=list)
    scale: bool = True
    medians: dict = field(default_factory=dict)
    scales: dict = field(default_factory=dict)
    modes: dict = field(default_factory=dict)
    categories: dict = field(default_factory=dict)

    def fit(self, df: DataFrame) -> "Preprocessor":
        if self.numeric:
            self.medians = {c: (0.0 if v is None else v) for c, v in medians(df, self.numeric).items()}
            if self.scale:
                self.scales = filled_scales(df, self.medians)
        if self.categorical:
            self.modes, self.categories = text_values(df, self.categorical)
        return self

    @property
    def inputs(self) -> list[str]:
        return [*self.numeric, *self.categorical]

    @property
    def names(self) -> list[str]:
        """Names of the vector positions, prefixed by the branch they come from."""
        return [f"num__{c}" for c in self.numeric] + [
            f"cat__{c}_{v}" for c in self.categorical for v in self.categories[c]]

    def transform(self, df: DataFrame, output: str = "features") -> DataFrame:
        parts = {}
        for i, c in enumerate(self.numeric):
            x = F.coalesce(nan_to_null(F.col(f"`{c}`").cast("double")), F.lit(self.medians[c]))
            if self.scale:
                m, s = self.scales[c]
                x = (x - F.lit(m)) / F.lit(s or 1.0)
            parts[f"_x{i}"] = x
        for c in self.categorical:
            v = F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(self.modes[c]))
            for cat in self.categories[c]:
                parts[f"_x{len(parts)}"] = (v == cat).cast("double")
        out = VectorAssembler(inputCols=list(parts), outputCol=output).transform(df.withColumns(parts))
        return out.drop(*parts)

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, d: dict) -> "Preprocessor":
        d = dict(d)
        d["scales"] = {k: tuple(v) for k, v in d.get("scales", {}).items()}
        return cls(**d)
