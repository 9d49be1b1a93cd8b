"""Build canonical event DataFrames from compact Python rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionlog.schema import EVENT_COLUMNS, EVENT_SCHEMA

FIELDS = [f.name for f in EVENT_SCHEMA.fields]


def rows_to_df(spark, sessions: dict[str, list[dict]]):
    """``sessions``: id -> list of event dicts (type, ts in micros, optional payload)."""
    data = []
    for sid, evs in sessions.items():
        for i, e in enumerate(evs):
            r = {k: None for k in FIELDS}
            r.update(e)
            r["session_id"], r["seq"], r["ts_us"] = sid, i, int(e["ts"])
            r.pop("ts")
            data.append(tuple(r.get(k) for k in FIELDS if k != "ts"))
    schema_no_ts = [f for f in EVENT_SCHEMA.fields if f.name != "ts"]
    from pyspark.sql.types import StructType
    df = spark.createDataFrame(data, StructType(schema_no_ts))
    df = df.withColumn("ts", F.timestamp_micros("ts_us"))
    return df.select(*EVENT_COLUMNS)


def S(x):  # seconds -> micros
    return int(round(x * 1_000_000))
