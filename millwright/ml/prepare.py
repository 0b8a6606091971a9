"""Preparation of raw tables for models: learned once, applied as column expressions."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millwright.functions.columns import NUMERIC, col, correlation, finite, is_text, number
from millwright.functions.constants import SILENT_NULLS
from millwright.functions.ordered import quantiles

DATE = r"^\d{4}[-/]\d{2}[-/]\d{2}"
ID_NAME = re.compile(r"(^|_)(id|uuid|guid|key|index|idx|serial|no|number)($|_)", re.IGNORECASE)
PARTS = ("year", "month", "day", "hour", "dayofweek")


@dataclass
class Plan:
    """Everything that preparation learned; plain values, so it is stored as JSON."""

    raw: list[str] = field(default_factory=list)
    names: dict[str, str] = field(default_factory=dict)
    kinds: dict[str, str] = field(default_factory=dict)
    dropped: dict[str, str] = field(default_factory=dict)
    fill: dict[str, float | str] = field(default_factory=dict)
    levels: dict[str, list[str]] = field(default_factory=dict)
    bounds: dict[str, tuple[float, float]] = field(default_factory=dict)
    shift: dict[str, tuple[float, float]] = field(default_factory=dict)
    features: list[str] = field(default_factory=list)
    silent_nulls: bool = True

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Plan:
        return cls(**json.loads(text))


def sanitised(names: list[str]) -> dict[str, str]:
    out, used = {}, set()
    for name in names:
        base = re.sub(r"[^a-zA-Z0-9_฀-๿]+", "_", name).strip("_") or "feature"
        new, i = base, 0
        while new in used:
            i += 1
            new = f"{base}_{i}"
        used.add(new)
        out[name] = new
    return out


def _text(df: DataFrame, c: str, silent: bool) -> Column:
    stripped = F.regexp_replace(col(c).cast("string"), r"^\s+|\s+$", "")
    return F.when(F.lower(stripped).isin(*SILENT_NULLS), None).otherwise(col(c).cast("string")) if silent else col(c).cast("string")


def _base(df: DataFrame, plan: Plan) -> dict[str, Column]:
    """The raw columns as numbers or texts by their learned kind, under their new names; a missing column is null."""
    out: dict[str, Column] = {}
    for c, kind in plan.kinds.items():
        name = plan.names[c]
        there = c in df.columns
        if kind == "time":
            t = (F.expr(f"try_cast(`{c}` as timestamp)") if is_text(df, c) else col(c).cast("timestamp")) if there else F.lit(None).cast("timestamp")
            parts = (F.year(t), F.month(t), F.dayofmonth(t), F.hour(t), F.weekday(t))
            out |= {f"{name}_{p}": F.coalesce(v, F.lit(0)).cast("double") for p, v in zip(PARTS, parts)}
        elif kind == "number":
            out[name] = finite(number(df, c) if there and not isinstance(df.schema[c].dataType, T.BooleanType) else (col(c).cast("double") if there else F.lit(None).cast("double")))
        else:
            out[name] = _text(df, c, plan.silent_nulls) if there else F.lit(None).cast("string")
    return out


def downcast(df: DataFrame) -> DataFrame:
    """Whole numbers without nulls in the narrowest type that holds them, doubles as floats where none leaves their range. One aggregate finds out."""
    whole = {T.ShortType(): "smallint", T.IntegerType(): "int", T.LongType(): "bigint"}
    numbers = [f.name for f in df.schema if f.dataType in whole or isinstance(f.dataType, T.DoubleType)]
    if not numbers:
        return df
    seen = df.agg(F.count("*").alias("n"), *(g(col(c)).alias(f"{k}{i}") for i, c in enumerate(numbers) for k, g in (("k", F.count), ("lo", F.min), ("hi", F.max)))).first()
    casts = {}
    for i, c in enumerate(numbers):
        low, high = seen[f"lo{i}"], seen[f"hi{i}"]
        if low is None:
            continue
        if isinstance(df.schema[c].dataType, T.DoubleType):
            casts |= {c: "float"} if max(abs(low), abs(high)) < 3.4e38 else {}
        elif seen[f"k{i}"] == seen["n"]:
            casts[c] = next(t for t, top in (("tinyint", 1 << 7), ("smallint", 1 << 15), ("int", 1 << 31), ("bigint", 1 << 63)) if -top <= low and high < top)
    return df.select(*(col(c).cast(casts[c]).alias(c) if c in casts else col(c) for c in df.columns))


def transform(df: DataFrame, plan: Plan, clip: bool = True, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns and the features as doubles, in one projection over the table."""
    base = _base(df, plan)
    prepared = df.select(*(col(c) for c in keep or []), *(v.alias(f"_b_{k}") for k, v in base.items()))
    out = []
    for f in plan.features:
        c = F.col(f"_b_{f}")
        if f in plan.levels:
            filled = F.coalesce(c, F.lit(plan.fill.get(f, "Unknown")))
            c = F.call_function("array_position", F.array(*map(F.lit, plan.levels[f])), filled).cast("double") - 1.0
        else:
            c = F.coalesce(c, F.lit(float(plan.fill.get(f, 0.0))))
            if clip and f in plan.bounds:
                low, high = plan.bounds[f]
                c = F.greatest(F.least(c, F.lit(high)), F.lit(low))
        if f in plan.shift:
            centre, scale = plan.shift[f]
            c = (c - centre) / scale
        out.append(c.alias(f))
    return prepared.select(*(col(c) for c in keep or []), *out)


def fit(df: DataFrame, target: str | None = None, labels: Column | None = None, scale: str = "standard", collinear: float = 0.9, silent_nulls: bool = True, prune_by_target: bool = True) -> Plan:
    """Learn a plan in a few wide aggregates."""
    from millwright.operators.profile import distinct_names

    df, _ = distinct_names(df)
    plan = Plan(silent_nulls=silent_nulls)
    plan.raw = [c for c in df.columns if c != target]
    plan.names = sanitised(plan.raw)
    nested = [c for c in plan.raw if isinstance(df.schema[c].dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))]
    plan.dropped |= dict.fromkeys(nested, "nested")
    usable = [c for c in plan.raw if c not in nested]
    texts = [c for c in usable if is_text(df, c)]
    facts = [F.count("*").alias("n")]
    for i, c in enumerate(usable):
        x = _text(df, c, silent_nulls) if c in texts else finite(col(c).cast("double")) if isinstance(df.schema[c].dataType, NUMERIC) else col(c)
        facts += [F.count(x).alias(f"k{i}"), F.count_distinct(x).alias(f"u{i}")]
        if c in texts:
            facts += [F.count(number(df, c)).alias(f"m{i}"), F.count(F.when(x.rlike(DATE), F.expr(f"try_cast(`{c}` as timestamp)"))).alias(f"t{i}")]
    row = df.agg(*facts).first()
    n = row["n"]
    for i, c in enumerate(usable):
        known, unique = row[f"k{i}"], row[f"u{i}"]
        kind = df.schema[c].dataType
        if not known:
            plan.dropped[c] = "all null"
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)) or (c in texts and row[f"t{i}"] > 0.8 * known):
            plan.kinds[c] = "time"
        elif c in texts and not (row[f"m{i}"] > 0.8 * known and unique > 5):
            if (unique > 0.5 * n and n > 30) or unique > 1000:
                plan.dropped[c] = "high cardinality"
            else:
                plan.kinds[c] = "text"
        elif c not in texts and n > 30 and unique == n and ID_NAME.search(c):
            plan.dropped[c] = "identifier"
        else:
            plan.kinds[c] = "number"
    base = _base(df, plan)
    flat = df.select(*(v.alias(k) for k, v in base.items()), *([labels.cast("double").alias("_y")] if labels is not None else []))
    numbers = [k for k, t in flat.dtypes if t == "double" and k != "_y"]
    words = [k for k, t in flat.dtypes if t == "string"]
    if base:
        middle = {}
        if numbers:
            cells = flat.select(F.inline(F.array(*(F.struct(F.lit(k).alias("column"), F.col(k).alias("x")) for k in numbers))))
            middle = {r["column"]: r["q"][0] for r in quantiles(cells, "x", (0.5,), ["column"]).collect()}
        usual = flat.agg(*(F.mode(F.col(k), True).alias(k) for k in words)).first() if words else {}
        plan.fill = {k: middle.get(k, 0.0) for k in numbers} | {k: (usual[k] if usual[k] is not None else "Unknown") for k in words}
    filled = flat.fillna(plan.fill) if plan.fill else flat
    stats = {}
    if base:
        wide = [F.count_distinct(k).alias(f"u_{k}") for k in base] + [f(k).alias(f"{n_}_{k}") for k in numbers for n_, f in (("lo", F.min), ("hi", F.max), ("m", F.avg), ("s", F.stddev_pop))]
        wide += [F.array_sort(F.collect_set(k)).alias(f"l_{k}") for k in words]  # at most 1000 values each
        stats = filled.agg(*wide).first().asDict()
    for k in base:
        if stats[f"u_{k}"] <= 1:
            plan.dropped[k] = "constant"
        elif k in words:
            plan.levels[k] = list(stats[f"l_{k}"])
        else:
            plan.bounds[k] = (stats[f"lo_{k}"], stats[f"hi_{k}"])
    plan.features = [k for k in base if k not in plan.dropped]
    order = {k: i for i, k in enumerate(plan.features)}
    if 1 < len(plan.features) <= 1000:
        coded = transform(df.withColumn("_y", labels.cast("double")) if labels is not None else df, plan, keep=["_y"] if labels is not None else None)
        pairs = [(a, b) for i, a in enumerate(plan.features) for b in plan.features[i + 1 :]]
        found = coded.agg(*(correlation(F.col(a), F.col(b)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)), *([correlation(F.col(k), F.col("_y")).alias(f"y_{k}") for k in plan.features] if labels is not None else [])).first()
        gone: set[str] = set()
        for i, (a, b) in enumerate(pairs):
            if a in gone or b in gone or found[f"r{i}"] is None or abs(found[f"r{i}"]) <= collinear:
                continue
            weaker = b
            if labels is not None and prune_by_target and abs(found[f"y_{a}"] or 0) < abs(found[f"y_{b}"] or 0):
                weaker = a
            gone.add(weaker)
            plan.dropped[weaker] = "collinear"
        plan.features = sorted((k for k in plan.features if k not in gone), key=order.get)
    for k in plan.features:
        if k in plan.levels or scale == "none":
            continue
        low, high = plan.bounds[k]
        plan.shift[k] = (stats[f"m_{k}"], stats[f"s_{k}"] or 1.0) if scale == "standard" else (low, (high - low) or 1.0)
    return plan


