from datetime import datetime, timedelta

from fleetsig import schema

T0 = datetime(2024, 1, 1)


def at(seconds: float) -> datetime:
    return T0 + timedelta(seconds=seconds)


def samples(spark, rows):
    """rows: (instrument_id, param_id, seconds, value)."""
    return spark.createDataFrame(
        [(at(s), i, p, None if v is None else float(v), None) for i, p, s, v in rows], schema.EVENTS
    )


def got(df, *columns):
    """Rows as a sorted list of tuples, instants as seconds since T0."""
    def plain(v):
        return (v - T0).total_seconds() if isinstance(v, datetime) else v

    picked = df.select(*columns) if columns else df
    return sorted((tuple(plain(v) for v in r) for r in picked.collect()), key=repr)
