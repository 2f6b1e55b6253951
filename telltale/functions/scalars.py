"""Row-local expressions: coercion, cleaning, ratios and formatted text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telltale.schemas import METRICS, MODEL_FEATURES, NON_FEATURES

# Guards added to denominators.
EPS = 1e-5
MEM_EPS = 1e-6


def number(column: str | Column) -> Column:
    """Text or number to double; anything unreadable becomes 0."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def finite(c: Column) -> Column:
    """Null, NaN and infinities become 0."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(0.0)).otherwise(F.coalesce(c, F.lit(0.0)))


def ratio(a: Column, b: Column) -> Column:
    """``a / b`` with a zero denominator giving 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def rounded(c: Column, digits: int = 6) -> Column:
    """Rounded, and never minus zero."""
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def is_anomaly_event(event_type: Column) -> Column:
    return F.coalesce(F.lower(event_type).contains("anomaly"), F.lit(False))


def coerce_metrics(df: DataFrame, columns=METRICS) -> DataFrame:
    """The named columns as doubles; absent ones are added as 0."""
    return df.withColumns({c: number(c) if c in df.columns else F.lit(0.0) for c in columns})


def clean(df: DataFrame) -> DataFrame:
    """``finite`` on every fractional column, 0 for missing whole numbers."""
    out = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out[f.name] = finite(F.col(f.name))
        elif isinstance(f.dataType, T.IntegralType) and f.name not in NON_FEATURES:
            out[f.name] = F.coalesce(F.col(f.name), F.lit(0).cast(f.dataType))
    return df.withColumns(out) if out else df


def _finite_sql(df: DataFrame, name: str) -> str:
    """``finite(number(name))`` as SQL text, which is far cheaper to build for wide rows."""
    if name not in df.columns:
        return "0.0D"
    x = f"`{name}`" if df.schema[name].dataType.typeName() == "double" else f"try_cast(`{name}` as double)"
    return f"if(isnan({x}) or abs({x}) = double('Infinity'), 0.0D, coalesce({x}, 0.0D))"


def finite_features(df: DataFrame, names) -> DataFrame:
    """The named columns replaced by finite doubles; ones the rows lack are added as 0."""
    kept = [f"`{c}`" for c in df.columns if c not in set(names)]
    return df.selectExpr(*kept, *[f"{_finite_sql(df, n)} as `{n}`" for n in names])


def select_features(df: DataFrame, keep=()) -> DataFrame:
    """Everything but identity columns, as finite doubles, plus the label and ``keep``."""
    features = [c for c in df.columns if c not in NON_FEATURES and c not in keep]
    label = ["label"] if "label" in df.columns else []
    return df.selectExpr(*keep, *[f"{_finite_sql(df, c)} as `{c}`" for c in features], *label)


def align_features(df: DataFrame, names=MODEL_FEATURES, keep=()) -> DataFrame:
    """The model's features in training order; features a row set lacks are 0."""
    return df.selectExpr(*keep, *[f"{_finite_sql(df, n)} as `{n}`" for n in names])


def has_children() -> Column:
    return (F.col("num_children") > 0).cast("int")


def relative_rate(x: str) -> Column:
    return (F.col(x) - F.col(f"{x}_mean_5")) / (F.col(f"{x}_std_5") + EPS)


def ema_spike(x: str) -> Column:
    return F.col(x) / (F.col(f"{x}_ema") + EPS)


def io_total_rate() -> Column:
    return F.col("io_read_rate") + F.col("io_write_rate")


def ctx_total_rate() -> Column:
    return F.col("ctx_voluntary_rate") + F.col("ctx_involuntary_rate")


def io_bytes_per_op() -> Column:
    return ratio(F.col("io_total_rate") + 1, F.col("io_read_ops_rate") + F.col("io_write_ops_rate") + 1)


def ctx_involuntary_ratio() -> Column:
    return ratio(F.col("ctx_involuntary_rate"), F.col("ctx_total_rate") + 1)


def baseline_deviation() -> dict[str, Column]:
    cpu = F.col("cpu") - F.col("cpu_baseline")
    mem = F.col("mem") - F.col("mem_baseline")
    return {
        "cpu_dev_from_baseline": cpu,
        "mem_dev_from_baseline": mem,
        "io_dev_from_baseline": F.col("io_total_rate") - F.col("io_baseline"),
        "cpu_pct_dev_baseline": cpu / (F.col("cpu_baseline") + EPS),
        "mem_pct_dev_baseline": mem / (F.col("mem_baseline") + EPS),
    }


def usage_per_age(io: str = "io_total_rate") -> dict[str, Column]:
    age = F.col("proc_age") + 1
    return {"cpu_per_age": F.col("cpu") / age, "mem_per_age": F.col("mem") / age,
            "io_per_age": F.col(io) / age}


def interactions() -> dict[str, Column]:
    return {"cpu_mem_product": F.col("cpu") * F.col("mem"),
            "cpu_mem_ratio": F.col("cpu") / (F.col("mem") + MEM_EPS),
            "resource_pressure": F.col("cpu") + F.col("mem")}


def format_metric(name: str | Column, value: Column) -> Column:
    """``name=0.00``, rounded half to even on the exact binary value."""
    name = F.lit(name) if isinstance(name, str) else name
    return F.concat(name, F.lit("="), F.call_function("format_number", value.cast("double"), F.lit("0.00")))


def confidence_band(score: Column) -> Column:
    return F.when(score > 0.9, "HIGH").when(score > 0.8, "MEDIUM").otherwise("LOW")


def with_session_tag(df: DataFrame, name: str) -> DataFrame:
    """Add ``session`` unless the rows already carry one."""
    return df if "session" in df.columns else df.withColumn("session", F.lit(name))
