"""Small column expressions used all over; everything here stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.config import Catalog

US = 1_000_000


def seconds_to_us(seconds: float) -> int:
    return int(round(seconds * US))


def half_up(col: Column, digits: int) -> Column:
    """Round by scaling, the way most SQL engines do for doubles."""
    scale = 10.0**digits
    return F.round(col * scale) / scale


def clip01(col: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), col))


def fixed2(col: Column) -> Column:
    """Text with two decimals, rounded on the exact binary value, ties to even.

    The JVM formatter rounds the shortest decimal form instead, which turns
    0.125 into 0.13 and 0.615 into 0.62. The product with 100 is formed
    without rounding error as p + e (Dekker's splitting; 100 needs no split).
    """
    x = F.abs(col)
    c = x * F.lit(134217729.0)
    hi = c - (c - x)
    lo = x - hi
    p = x * F.lit(100.0)
    e = (hi * F.lit(100.0) - p) + lo * F.lit(100.0)
    whole = F.floor(p).cast("double")
    rest = p - whole
    tie = (rest == 0.5) & (e == 0.0)
    up = (rest > 0.5) | ((rest == 0.5) & (e > 0.0)) | (tie & (F.pmod(whole, F.lit(2.0)) == 1.0))
    cents = whole + up.cast("double")
    text = F.format_string("%.2f", cents / 100.0)
    plain = F.when(x < 1e13, text).otherwise(F.format_string("%.2f", x))
    return F.when(col < 0, F.concat(F.lit("-"), plain)).otherwise(plain)


def number_text(col: Column) -> Column:
    """A double in its shortest plain form (1000000000.0 rather than 1.0E9)."""
    short = col.cast("string")
    plain = F.regexp_replace(F.regexp_replace(col.cast("decimal(38,20)").cast("string"), "0+$", ""), "\\.$", ".0")
    plain = F.when(plain.contains("."), plain).otherwise(F.concat(plain, F.lit(".0")))
    size = F.abs(col)
    return F.when(short.contains("E") & (size >= 1e-4) & (size < 1e16), plain).otherwise(short)


def span_us(later: Column, earlier: Column) -> Column:
    return F.unix_micros(later) - F.unix_micros(earlier)


def present(col: Column) -> Column:
    """Null for an empty string, so that coalesce can skip it."""
    return F.nullif(col, F.lit(""))


def literal_map(entries: dict[str, Column]) -> Column:
    return F.create_map(*[c for k, v in entries.items() for c in (F.lit(k), v)])


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def field_defs(catalog: Catalog) -> Column:
    """map<sensor_type, map<field, struct(unit,min,max,baseline,noise_std)>>, folded to a literal by the optimizer."""
    types = []
    for name, t in catalog.sensor_types.items():
        fields = [
            f"{_text(f)}, named_struct('unit', {_text(d.unit)}, 'min', {d.min!r}D, 'max', {d.max!r}D, "
            f"'baseline', {d.baseline!r}D, 'noise_std', {d.noise_std!r}D)"
            for f, d in t.fields.items()
        ]
        types.append(f"{_text(name)}, map({', '.join(fields)})")
    return F.expr(f"map({', '.join(types)})")


def by_sensor_type(catalog: Catalog, value) -> Column:
    """when-chain over sensor types; `value(SensorType)` gives the branch, null when unknown."""
    out = None
    for name, t in catalog.sensor_types.items():
        cond = F.col("sensor_type") == name
        out = F.when(cond, value(t)) if out is None else out.when(cond, value(t))
    return out


def parse_ts(col: Column) -> Column:
    """ISO text (a naive time means UTC) or epoch seconds; null when neither."""
    epoch = col.try_cast("double")
    iso = F.when(col.rlike(r"^\d{4}-\d{2}-\d{2}"), col.try_cast("timestamp"))
    return F.coalesce(F.timestamp_micros(F.round(epoch * US).cast("bigint")), iso)
