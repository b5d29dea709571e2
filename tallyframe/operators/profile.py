"""What kind of variables a table has: storage, measurement level, field role.

Each function reads the table once, with one aggregation over all columns.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.numbers import to_number

#: Parts of names that mark an ordinal variable.
ORDINAL_NAMES = ("rating", "rank", "level", "likert", "grade", "severity", "stage", "class", "category", "score_code", "ordinal")
#: Texts that are grades.
ORDINAL_VALUES = ("low", "medium", "high", "poor", "fair", "good", "very good", "excellent", "strongly disagree", "disagree", "neutral", "agree", "strongly agree")
#: Names of row numbers.
ID_NAMES = ("id", "customer_id", "row_id", "index")
DATE_PARTS = ("date", "dt_", "_dt", "time", "timestamp")
DATE_FORMATS = ("dd-MM-yyyy", "dd/MM/yyyy", "dd.MM.yyyy", "yyyy-MM-dd", "yyyy/MM/dd", "yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss")
DISCRETE_VALUES = 20


@dataclass(frozen=True)
class Variable:
    name: str
    label: str
    storage: str
    level: str


def _text(name: str) -> Column:
    return F.trim(F.col(f"`{name}`").cast("string"))


def infer_variables(df: DataFrame, columns: list[str] | None = None) -> list[Variable]:
    """Storage (numeric at 90 % finite numbers) and level (Nominal, Ordinal, Scale) of each column."""
    columns = columns or df.columns
    parts: list[Column] = []
    for i, c in enumerate(columns):
        t = _text(c)
        there = t.isNotNull() & (t != "")
        x = to_number(t)
        parts += [
            F.count_if(there).alias(f"n{i}"), F.count_if(there & x.isNotNull()).alias(f"x{i}"), F.count_if(there & (x == F.floor(x))).alias(f"w{i}"), F.count_distinct(x).alias(f"d{i}"),
            F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}"), F.bool_and(F.when(x.isNotNull(), x == F.floor(x))).alias(f"all{i}"),
            F.bool_and(F.when(there, F.lower(t).isin(*ORDINAL_VALUES))).alias(f"o{i}"),
        ]
    r = df.agg(*parts).first()
    out = []
    for i, c in enumerate(columns):
        n = r[f"n{i}"]
        if n and r[f"x{i}"] >= 0.9 * n:
            words = re.sub(r"[^a-z0-9]+", "_", c.lower())
            graded = any(re.search(rf"(^|_){w}(_|$)", words) for w in ORDINAL_NAMES) and r[f"w{i}"] >= 0.95 * n and 2 <= r[f"d{i}"] <= 7 and r[f"all{i}"] and r[f"lo{i}"] >= 0 and r[f"hi{i}"] <= 7
            out.append(Variable(c, c, "numeric", "Ordinal" if graded else "Scale"))
        else:
            out.append(Variable(c, c, "text", "Ordinal" if n and r[f"o{i}"] else "Nominal"))
    return out


def variables_table(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    rows = [(v.name, v.label, v.storage, v.level) for v in infer_variables(df, columns)]
    return df.sparkSession.createDataFrame(rows, "name string, label string, storage string, level string")


def relabel(variables: list[Variable], name: str, label: str | None = None, level: str | None = None) -> list[Variable]:
    """The list with the label or level of one variable set by hand."""
    if level not in (None, "Nominal", "Ordinal", "Scale"):
        raise ValueError("level is Nominal, Ordinal or Scale")
    return [replace(v, label=label or v.label, level=level or v.level) if v.name == name else v for v in variables]


def scale_variables(variables: list[Variable]) -> list[str]:
    return [v.name for v in variables if v.level == "Scale" and v.storage == "numeric"]


def group_variables(variables: list[Variable]) -> list[str]:
    scale = set(scale_variables(variables))
    return [v.name for v in variables if v.name not in scale]


def categorical_variables(variables: list[Variable]) -> list[str]:
    return [v.name for v in variables if v.level in ("Nominal", "Ordinal")]


def advice(variables: list[Variable]) -> list[str]:
    """Which analyses the variables allow."""
    scale, groups = scale_variables(variables), categorical_variables(variables)
    odd = [v.name for v in variables if v.level == "Scale" and v.storage == "text"]
    out = [f"{sum(v.level == level for v in variables)} {level} variables" for level in ("Nominal", "Ordinal", "Scale")]
    out += [f"Stored as text but treated as Scale: {', '.join(odd)}"] if odd else []
    out += ["Correlation is possible"] if len(scale) >= 2 else []
    out += ["Comparing means (t-test, ANOVA) is possible"] if scale and groups else []
    return out if len(out) > 3 + bool(odd) else [*out, "No analysis suggests itself yet"]


def overview(df: DataFrame) -> DataFrame:
    """n_rows, n_columns, numeric columns and missing cells (nulls and blanks)."""
    numeric = sum(isinstance(f.dataType, T.NumericType) for f in df.schema)
    gone = [F.count_if(F.coalesce(_text(c) == "", F.lit(True))) for c in df.columns]
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).cast("long").alias("n_columns"), F.lit(numeric).cast("long").alias("numeric_columns"), sum(gone[1:], gone[0]).alias("missing_cells"))


def variable_table(df: DataFrame) -> DataFrame:
    """variable, distinct values and missing cells of each column."""
    per = df.agg(*[F.struct(F.count_distinct(F.when(_text(c) != "", _text(c))).alias("n_distinct"), F.count_if(F.coalesce(_text(c) == "", F.lit(True))).alias("missing")).alias(f"c{i}") for i, c in enumerate(df.columns)])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(f"c{i}.n_distinct").alias("n_distinct"), F.col(f"c{i}.missing").alias("missing")) for i, c in enumerate(df.columns)]))
    return per.select(rows.alias("r")).select("r.*")


def preview(df: DataFrame, row_order: str, n: int = 50) -> DataFrame:
    """The first rows, as the feature asks."""
    return df.orderBy(row_order).limit(n)


@dataclass(frozen=True)
class Fields:
    """Columns by role, without ids and constants."""

    excluded: list[str]
    continuous: list[str]
    discrete: list[str]
    binary: list[str]
    categorical: list[str]
    datetime: list[str]
    n_rows: int
    counts: dict[str, tuple[int, int]]  # distinct values, nulls

    @property
    def numeric_like(self) -> list[str]:
        return self.continuous + self.discrete

    @property
    def categorical_like(self) -> list[str]:
        return self.binary + self.categorical

    def role(self, name: str) -> str:
        return next(r for r in ("datetime", "binary", "discrete", "continuous", "categorical") if name in getattr(self, r))


def parsed_date(c: Column) -> Column:
    """A text as a date, day first."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in DATE_FORMATS])


def structural_exclusions(counts: dict[str, tuple[int, int]], target: str | None = None) -> list[str]:
    """Row numbers by name, and columns with one value (null counting as one); never the target."""
    ids = [c for c in counts if c.lower() in ID_NAMES]
    constant = [c for c, (n, nulls) in counts.items() if n + (nulls > 0) <= 1]
    return [c for c in dict.fromkeys(ids + constant) if c != target]


def field_roles(df: DataFrame, target: str | None = None, exact: bool = False) -> Fields:
    """The role of each field.

    Roles ask for counts of distinct values near 1, 2 and ``DISCRETE_VALUES`` only:
    one pass sketches all columns, and columns that a sketch puts anywhere near get
    an exact count.  With ``exact`` all do, as a profile shows the counts.
    """
    fields = [f for f in df.schema if isinstance(f.dataType, (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType))]
    dated = [f.name for f in fields if isinstance(f.dataType, T.StringType) and any(p in f.name.lower() for p in DATE_PARTS)]
    q = {f.name: F.col(f"`{f.name}`") for f in fields}
    r = df.agg(F.count(F.lit(1)), *[F.approx_count_distinct(q[f.name], 0.02) for f in fields], *[F.count_if(q[f.name].isNull()) for f in fields], *[F.count(parsed_date(q[c])) for c in dated]).first()
    m = len(fields)
    counts = {f.name: (r[1 + i], r[1 + m + i]) for i, f in enumerate(fields)}
    near = [c for c in counts if exact or counts[c][0] <= 2 * DISCRETE_VALUES]
    if near:
        sure = df.agg(*[F.count_distinct(q[c]) for c in near]).first()
        counts |= {c: (sure[i], counts[c][1]) for i, c in enumerate(near)}
    parsed = {c: r[1 + 2 * m + i] / max(r[0], 1) for i, c in enumerate(dated)}
    excluded = structural_exclusions(counts, target)
    roles: dict[str, list[str]] = {k: [] for k in ("continuous", "discrete", "binary", "categorical", "datetime")}
    for f in fields:
        if f.name in excluded:
            continue
        n = counts[f.name][0]
        if parsed.get(f.name, 0) >= 0.8 or isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            role = "datetime"
        elif n == 2:
            role = "binary"
        elif isinstance(f.dataType, T.NumericType):
            role = "discrete" if n <= DISCRETE_VALUES else "continuous"
        else:
            role = "categorical"
        roles[role].append(f.name)
    return Fields(excluded, n_rows=r[0], counts=counts, **roles)


def field_profile(df: DataFrame) -> DataFrame:
    """field, dtype, role (numeric or categorical, by type), missing_pct, n_unique and unique_ratio of every field that isn't excluded."""
    fields = field_roles(df, exact=True)
    rows = [
        (f.name, f.dataType.simpleString(), "numeric" if isinstance(f.dataType, (T.NumericType, T.BooleanType)) else "categorical", 100.0 * fields.counts[f.name][1] / fields.n_rows, fields.counts[f.name][0], fields.counts[f.name][0] / fields.n_rows)
        for f in df.schema
        if f.name in fields.counts and f.name not in fields.excluded
    ]
    return df.sparkSession.createDataFrame(rows, "field string, dtype string, role string, missing_pct double, n_unique long, unique_ratio double")
