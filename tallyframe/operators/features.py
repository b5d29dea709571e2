"""Feature engineering: derived fields, interactions, imputation, encoding, weights, folds."""

from __future__ import annotations

from datetime import date
from itertools import chain

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tallyframe.operators.describe import quantiles, stacked
from tallyframe.operators.profile import parsed_date, structural_exclusions

REFERENCE_DATE = date(2026, 1, 1)
#: Pairs of fields whose product is a feature where both are present.
INTERACTIONS = (("MntMeatProducts", "NumCatalogPurchases"), ("MntWines", "NumCatalogPurchases"), ("Income", "MntWines"), ("MntWines", "MntMeatProducts"), ("Income", "MntMeatProducts"))


def derived_fields(df: DataFrame, reference: date = REFERENCE_DATE) -> DataFrame:
    """Year_Birth as Customer_Age, Dt_Customer (day first) as Customer_Tenure_Days; the originals go."""
    if "Year_Birth" in df.columns:
        df = df.withColumn("Customer_Age", reference.year - F.col("Year_Birth").try_cast("double")).drop("Year_Birth")
    if "Dt_Customer" in df.columns:
        day = F.col("Dt_Customer").cast("date") if not isinstance(df.schema["Dt_Customer"].dataType, T.StringType) else parsed_date(F.col("Dt_Customer")).cast("date")
        df = df.withColumn("Customer_Tenure_Days", F.datediff(F.lit(reference), day).cast("double")).drop("Dt_Customer")
    return df


def interactions(df: DataFrame, pairs: tuple[tuple[str, str], ...] = INTERACTIONS) -> DataFrame:
    """Columns ``a__x__b`` for the pairs that are both present."""
    return df.withColumns({f"{a}__x__{b}": F.col(a).cast("double") * F.col(b).cast("double") for a, b in pairs if a in df.columns and b in df.columns})


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def log_features(df: DataFrame, least_distinct: int = 20) -> DataFrame:
    """Columns ``c__log1p`` for non-negative numeric columns with more than ``least_distinct`` values."""
    names = numeric_columns(df)
    if not names:
        return df
    r = df.agg(*[F.count_distinct(F.col(c)) for c in names], *[F.min(F.col(c)) for c in names]).first()
    chosen = [c for i, c in enumerate(names) if r[i] > least_distinct and r[len(names) + i] >= 0]
    return df.withColumns({f"{c}__log1p": F.log1p(F.col(c).cast("double")) for c in chosen})


def medians(df: DataFrame, columns: list[str]) -> dict[str, float]:
    if not columns:
        return {}
    found = quantiles(stacked(df, columns), ["variable"], "value", [0.5]).collect()  # a row a column
    return {r["variable"]: r["q"][0] for r in found}


def modes(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """The most frequent value, the smallest of several."""
    if not columns:
        return {}
    r = df.agg(*[F.mode(F.col(c).cast("string"), deterministic=True) for c in columns]).first()
    return {c: v for c, v in zip(columns, r, strict=True) if v is not None}


def impute(df: DataFrame, numeric: dict[str, float], categorical: dict[str, str]) -> DataFrame:
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(v)) for c, v in numeric.items()} | {c: F.coalesce(F.col(c).cast("string"), F.lit(v)) for c, v in categorical.items()}
    return df.withColumns(filled) if filled else df


class Preprocessor:
    """Median and mode imputation, one-hot categories (an unknown one is all zeros), one vector.  Fitted on training rows only."""

    def __init__(self, df: DataFrame, features: list[str]):
        self.numeric = [c for c in features if isinstance(df.schema[c].dataType, T.NumericType)]
        self.categorical = [c for c in features if c not in self.numeric]
        self.medians, self.modes = medians(df, self.numeric), modes(df, self.categorical)
        filled = self._filled(df)
        steps = [OneHotEncoder(inputCols=[f"_i_{c}" for c in self.categorical], outputCols=[f"_o_{c}" for c in self.categorical], dropLast=True)] if self.categorical else []
        index = [StringIndexer(inputCols=self.categorical, outputCols=[f"_i_{c}" for c in self.categorical], handleInvalid="keep", stringOrderType="alphabetAsc")] if self.categorical else []
        self.model = Pipeline(stages=[*index, *steps, VectorAssembler(inputCols=[*self.numeric, *[f"_o_{c}" for c in self.categorical]], outputCol="features")]).fit(filled)

    def _filled(self, df: DataFrame) -> DataFrame:
        numeric = {c: self.medians.get(c, 0.0) for c in self.numeric}
        return impute(df, numeric, {c: self.modes.get(c, "") for c in self.categorical})

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.model.transform(self._filled(df))
        return out.drop(*chain(*[(f"_i_{c}", f"_o_{c}") for c in self.categorical]))


#: Classes of a target at most: each is a tree a round, and its label is known to the driver.
MOST_CLASSES = 1000


def class_labels(df: DataFrame, target: str, most: int = MOST_CLASSES) -> list:
    """The target's distinct values in order; ValueError if there are more than ``most``."""
    found = df.select(target).filter(F.col(target).isNotNull()).distinct().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"{target} has more than {most} different values, so it isn't a class")
    return sorted(r[0] for r in found)


def balanced_weight(df: DataFrame, target: str) -> DataFrame:
    """``df`` with ``weight``: rows over (classes times rows of the class)."""
    counts = df.groupBy(target).agg(F.count(F.lit(1)).alias("_n"))
    totals = counts.agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_k"))
    weights = counts.crossJoin(F.broadcast(totals)).select(target, (F.col("_all") / (F.col("_k") * F.col("_n"))).alias("weight"))
    return df.join(F.broadcast(weights), target)  # a row a class


def fold(key: list[str], folds: int, seed: int) -> Column:
    """A fold number by hash of the row's key: the same in every run and on every cluster."""
    return F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(folds)).cast("int")


def stratified_folds(df: DataFrame, label: str, key: list[str], folds: int, seed: int, buckets: int = 256, name: str = "_fold", counted: DataFrame | None = None) -> DataFrame:
    """``df`` with a fold number in ``name`` that deals the rows of each class out in turn.

    ``df`` is read twice, to count and to number its rows; ``counted`` is a written table
    of the same rows to count instead, so that deals after deals don't read it anew for each.

    Rows of a class are numbered by hash of the key: within hash buckets, and from
    the number of its rows in the buckets before, so no window holds a whole
    class.  Equal rows are dealt out like others.
    """
    h = F.xxhash64(F.lit(seed), *key)
    bucketed = {"_hash": h, "_bucket": F.pmod(h, F.lit(buckets)).cast("int")}
    rows = df.withColumns(bucketed)
    counts = (rows if counted is None else counted.withColumns(bucketed)).groupBy(label, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(label).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.select(label, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_ahead"))
    local = F.row_number().over(Window.partitionBy(label, "_bucket").orderBy("_hash"))
    out = rows.withColumn("_local", local).join(F.broadcast(ahead), [label, "_bucket"])  # classes times buckets
    return out.withColumn(name, F.pmod(F.col("_ahead") + F.col("_local") - 1, F.lit(folds)).cast("int")).drop("_hash", "_bucket", "_local", "_ahead")


def model_features(df: DataFrame, target: str) -> list[str]:
    """Columns to learn from: neither ids, constants, the target, nor types that aren't numbers or texts."""
    usable = [f.name for f in df.schema if isinstance(f.dataType, (T.NumericType, T.StringType, T.BooleanType)) and f.name != target and not f.name.startswith("_")]
    r = df.agg(*[F.count_distinct(F.col(c)) for c in usable], *[F.count_if(F.col(c).isNull()) for c in usable]).first() if usable else []
    counts = {c: (r[i], r[len(usable) + i]) for i, c in enumerate(usable)}
    gone = structural_exclusions(counts, target)
    return [c for c in usable if c not in gone]
