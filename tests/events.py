"""Small event tables for tests."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.schema import SENSOR_EVENT

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def at(seconds: float) -> dt.datetime:
    return T0 + dt.timedelta(seconds=seconds)


def events(spark, rows, delay: float = 0.0):
    """rows: dicts with seconds, metrics and optional event columns."""
    data = []
    for i, r in enumerate(rows):
        data.append(
            (
                r.get("device_id", "d1"),
                r.get("sensor_type", "industrial"),
                at(r["seconds"]),
                r["metrics"],
                r.get("sequence", i),
                r.get("tags", {}),
                r.get("tenant_id", "default"),
                r.get("is_anomaly"),
                None,
                r.get("event_id", f"e{i:05d}"),
                at(r.get("ingested", r["seconds"] + delay)),
            )
        )
    schema = SENSOR_EVENT.simpleString()[7:-1] + ",event_id:string,ingested_at:timestamp"
    return spark.createDataFrame(data, ", ".join(c.replace(":", " ", 1) for c in _split(schema)))


def _split(text):
    out, depth, part = [], 0, ""
    for ch in text:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            out.append(part)
            part = ""
        else:
            part += ch
    return out + [part]


def column(df, name, order=("timestamp", "event_id")):
    return [r[name] for r in df.orderBy(*order).collect()]


def by_id(df, *names):
    return {r["event_id"]: tuple(r[n] for n in names) for r in df.select("event_id", *names).collect()}


__all__ = ["events", "column", "by_id", "at", "F"]
