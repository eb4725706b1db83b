"""Rule-based validation, profiles and drift checks: one fused aggregate for all rules."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Rule:
    """One check of one field. kind: dtype, shape, range, not_nan, not_inf, required, custom."""

    field: str
    kind: str
    params: dict = field(default_factory=dict)
    message: str = ""


def dtype(name: str, kind: str) -> Rule:
    return Rule(name, "dtype", {"type": kind})


def shape(name: str, dims: list) -> Rule:
    """dims: the first is the row count, the others the lengths of (nested) arrays; "*" is any. Every array of an axis must
    have its length, and the field's type as many axes as dims."""
    return Rule(name, "shape", {"dims": dims})


def in_range(name: str, low: float | None = None, high: float | None = None) -> Rule:
    return Rule(name, "range", {"min": low, "max": high})


def not_nan(name: str) -> Rule:
    return Rule(name, "not_nan")


def not_inf(name: str) -> Rule:
    return Rule(name, "not_inf")


def required(name: str) -> Rule:
    return Rule(name, "required")


def custom(name: str, condition: str | Callable[[Column], Column], message: str = "Custom validation failed") -> Rule:
    """condition holds for valid rows: a SQL expression, or a function from the field's column to a condition."""
    return Rule(name, "custom", {"condition": condition}, message)


def save_schema(rules: list[Rule], strict: bool = False) -> str:
    """The rules with their parameters as JSON. Conditions given as functions cannot be saved."""
    if any(callable(r.params.get("condition")) for r in rules):
        raise ValueError("a condition given as a function cannot be saved")
    return json.dumps({"strict": strict, "rules": [asdict(r) for r in rules]}, sort_keys=True)


def load_schema(text: str) -> tuple[list[Rule], bool]:
    data = json.loads(text)
    return [Rule(**r) for r in data["rules"]], data["strict"]


def _is_array(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.ArrayType)


def row_error(df: DataFrame, rule: Rule) -> Column | None:
    """The rule's message where a row breaks it, else null; None for rules about the whole field."""
    c = F.col(rule.field)
    array = _is_array(df, rule.field)
    some = (lambda test: F.exists(c, test)) if array else (lambda test: test(c))
    p = rule.params
    if rule.kind == "range":
        bad = F.lit(False)
        if p["min"] is not None:
            bad = bad | some(lambda x: ~F.isnan(x.cast("double")) & (x < p["min"]))
        if p["max"] is not None:
            bad = bad | some(lambda x: ~F.isnan(x.cast("double")) & (x > p["max"]))
        text = f"{rule.field}: value outside [{p['min']}, {p['max']}]"
    elif rule.kind == "not_nan":
        bad, text = some(lambda x: F.isnan(x.cast("double"))), f"{rule.field}: contains NaN"
    elif rule.kind == "not_inf":
        bad, text = some(lambda x: F.abs(x.cast("double")) == float("inf")), f"{rule.field}: contains Inf"
    elif rule.kind == "required":
        bad, text = c.isNull(), f"{rule.field}: contains null"
    elif rule.kind == "custom":
        given = p["condition"]
        bad, text = ~(given(c) if callable(given) else F.expr(given)), f"{rule.field}: {rule.message}"
    else:
        return None
    return F.when(bad, F.lit(text))


def _axes(kind: T.DataType) -> int:
    return 1 + _axes(kind.elementType) if isinstance(kind, T.ArrayType) else 0


def _shape_errors(df: DataFrame, rule: Rule) -> list[Column]:
    """One error array or null per fixed axis: from the least and the greatest length among all arrays of the axis."""
    dims, axes = rule.params["dims"], 1 + _axes(df.schema[rule.field].dataType)
    if len(dims) != axes:
        return [F.array(F.lit(f"{rule.field}: Expected {len(dims)} dimensions, got {axes}"))]
    out, inner = [], F.col(rule.field)
    for i, want in enumerate(dims):
        if i > 2:
            inner = F.flatten(F.filter(inner, lambda x: x.isNotNull()))
        if want == "*":
            continue
        if i == 0:
            low = high = F.count(F.lit(1))
        else:
            sizes = F.transform(inner, F.size) if i > 1 else F.array(F.size(inner))
            low, high = F.min(F.array_min(sizes)), F.max(F.array_max(sizes))
        got = F.when(low != want, low).otherwise(high).cast("long").cast("string")
        out.append(F.when((low != want) | (high != want), F.array(F.concat(F.lit(f"{rule.field}: Dimension {i}: expected {want}, got "), got))))
    return out


def _trial(df: DataFrame, rule: Rule) -> tuple[Column | None, str | None]:
    """row_error, or what a custom condition that cannot be built or analysed says."""
    if rule.kind != "custom":
        return row_error(df, rule), None
    try:
        error = row_error(df, rule)
        df.select(error)  # analysis only
        return error, None
    except Exception as e:  # noqa: BLE001 - whatever the given condition raises is the finding
        return None, f"{rule.field}: Validation error: {str(e).splitlines()[0] if str(e) else type(e).__name__}"


def validate(df: DataFrame, rules: list[Rule], strict: bool = False) -> DataFrame:
    """One row (ok, errors sorted). All rules share one aggregate; field names and types need no job.

    Nulls break only `required`. Range ignores NaN, which not_nan reports. An empty table breaks no row rule.
    """
    fields, texts = {r.field for r in rules}, []
    if strict:
        texts += [f"Unexpected field: {c}" for c in df.columns if c not in fields]
    texts += [f"Missing required field: {c}" for c in fields if c not in df.columns]
    parts: list[Column] = [F.array(*map(F.lit, texts))] if texts else []
    for r in (r for r in rules if r.field in df.columns):
        if r.kind == "dtype":
            actual = df.schema[r.field].dataType.simpleString()
            if actual != r.params["type"]:
                parts.append(F.array(F.lit(f"{r.field}: Expected dtype {r.params['type']}, got {actual}")))
        elif r.kind == "shape":
            parts += _shape_errors(df, r)
        else:
            error, text = _trial(df, r)
            parts.append(F.array(F.lit(text)) if text else F.when(F.count(error) > 0, F.array(F.max(error))))
    none = F.array().cast("array<string>")
    errors = F.array_sort(F.flatten(F.array(*(F.coalesce(p, none) for p in parts)))) if parts else none
    return df.agg(F.count(F.lit(1)).alias("_n"), errors.alias("errors")).select((F.size("errors") == 0).alias("ok"), "errors")


def validate_batches(df: DataFrame, rules: list[Rule], batch: str, tracked: list[str], strict: bool = False, **options) -> DataFrame:
    """(ok, errors) as validate, with the mean and range shifts that a tracked field's batches show against earlier ones.
    options are drift's."""
    out = validate(df, rules, strict)
    for f in tracked:
        d = drift(df, batch, f, **options)
        found = lambda flag, kind: F.when(F.max(F.col(flag).cast("int")) == 1, F.lit(f"{f}: Significant {kind} shift detected"))  # noqa: B023, E731
        out = out.crossJoin(d.agg(F.array_compact(F.array(found("mean_shift", "mean"), found("range_shift", "range"))).alias("_more")))  # one row each
        out = out.select(F.array_sort(F.concat("errors", "_more")).alias("errors"))
    return out.select((F.size("errors") == 0).alias("ok"), "errors")


def split(df: DataFrame, rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantined with an errors array) by the row rules. A plain projection, so it also works on streams."""
    marks = [e for r in rules if (e := row_error(df, r)) is not None]
    marked = df.withColumn("errors", F.array_compact(F.array(*marks)))
    return marked.filter(F.size("errors") == 0).drop("errors"), marked.filter(F.size("errors") > 0)


def profile(df: DataFrame, fields: list[str]) -> DataFrame:
    """One row per numeric field: n, mean, std (sample), min, max. One aggregate, then unpivoted."""
    aggs = []
    for f in fields:
        c = F.col(f).cast("double")
        aggs.append(F.struct(F.lit(f).alias("field"), F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max")))
    return df.agg(F.array(*aggs).alias("rows")).select(F.inline("rows"))


def drift(df: DataFrame, batch: str, value: str, min_batches: int = 10, sigmas: float = 3.0, compat: bool = False) -> DataFrame:
    """Per batch: mean, its profile of earlier batches (mu, sigma: averages of their means and stds), mean_shift, range_shift.

    Batches are compared with earlier ones only, after min_batches of them. range_shift: beyond the earlier range by half
    its width, or, if compat, below half its minimum or above twice its maximum. The window is over one row per batch.
    """
    v = F.col(value).cast("double")
    b = df.groupBy(batch).agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("low"), F.max(v).alias("high"))
    w = Window.orderBy(batch).rowsBetween(Window.unboundedPreceding, -1)
    s = b.select(batch, "mean", "std", "low", "high", F.count(F.lit(1)).over(w).alias("seen"), F.avg("mean").over(w).alias("mu"), F.avg("std").over(w).alias("sigma"), F.min("low").over(w).alias("pmin"), F.max("high").over(w).alias("pmax"))
    ready, width = F.col("seen") >= min_batches, F.col("pmax") - F.col("pmin")
    if compat:
        out = (F.col("low") < 0.5 * F.col("pmin")) | (F.col("high") > 2 * F.col("pmax"))
    else:
        out = (F.col("low") < F.col("pmin") - 0.5 * width) | (F.col("high") > F.col("pmax") + 0.5 * width)
    shift = F.abs(F.col("mean") - F.col("mu")) > sigmas * F.col("sigma")
    return s.select(batch, "mean", "mu", "sigma", F.coalesce(ready & shift, F.lit(False)).alias("mean_shift"), F.coalesce(ready & out, F.lit(False)).alias("range_shift"))


def suggest(df: DataFrame, fields: list[str]) -> DataFrame:
    """Rules that the data would pass: (field, rule, value). Array lengths over 100 or uneven become "*"."""
    rows = []
    for f in fields:
        t = df.schema[f].dataType
        rows.append(F.struct(F.lit(f).alias("field"), F.lit("dtype").alias("rule"), F.lit(t.simpleString()).alias("value")))
        c = F.col(f)
        if isinstance(t, T.ArrayType):
            size = F.when((F.min(F.size(c)) == F.max(F.size(c))) & (F.max(F.size(c)) <= 100), F.max(F.size(c)).cast("string")).otherwise("*")
            rows.append(F.struct(F.lit(f).alias("field"), F.lit("shape").alias("rule"), F.concat(F.lit("*,"), size).alias("value")))
            low, high, nan = F.min(F.array_min(c)), F.max(F.array_max(c)), F.max(F.exists(c, lambda x: F.isnan(x)).cast("int"))
        elif isinstance(t, T.NumericType):
            low, high, nan = F.min(c), F.max(c), F.max(F.isnan(c.cast("double")).cast("int"))
        else:
            continue
        bounds = F.concat_ws(",", F.format_string("%.4f", low.cast("double")), F.format_string("%.4f", high.cast("double")))
        rows.append(F.struct(F.lit(f).alias("field"), F.lit("range").alias("rule"), bounds.alias("value")))
        rows.append(F.struct(F.lit(f).alias("field"), F.lit("not_nan").alias("rule"), F.when(nan == 0, "yes").otherwise("no").alias("value")))
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))
