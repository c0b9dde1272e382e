"""Compare a registered query with its SQL twin in DuckDB."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else round(value, 6)
    if isinstance(value, decimal.Decimal):
        return round(float(value), 6)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, _plain(v)) for k, v in value.items()))
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(plain, key=repr)


def difference(spark, con, query, sf_dir: str, sizes: dict | None = None) -> str | None:
    frame = query.build(spark, sf_dir)
    got_columns, got = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    if sizes is not None:
        sizes[query.name] = len(got)
    if query.sql is None:
        return None
    cursor = con.execute(query.sql)
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    columns, expected = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if got_columns != columns:
        return f"columns {got_columns} != {columns}"
    if len(got) != len(expected):
        return f"{len(got)} rows, expected {len(expected)}; e.g. {got[:2]} / {expected[:2]}"
    for a, b in zip(got, expected):
        if a != b:
            return f"row {a} != {b}"
    names = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}
    for name, kind in frame.dtypes:
        want = names.get(kind)
        if want and want not in kinds[name].upper() and not (want == "VARCHAR" and "STRING" in kinds[name].upper()):
            return f"type of {name}: {kind} / {kinds[name]}"
    return None


if __name__ == "__main__":
    import sys
    import time

    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    from scriptoria.plans.registry import registered
    from scriptoria.session import local_session

    sf = sys.argv[1]
    wanted = sys.argv[2:]
    spark = local_session()
    con = connect(sf)
    bad = 0
    sizes = {}
    for name, q in registered().items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            problem = difference(spark, con, q, sf, sizes)
        except Exception as e:  # noqa: BLE001
            text = " | ".join(str(e).split("JVM stacktrace")[0].splitlines())
            problem = f"{type(e).__name__}: {text[:300]} ... {text[-500:] if len(text) > 300 else ''}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {time.time() - start:6.1f}s {sizes.get(name, -1):7d} {name} {'' if q.sql else '(no sql)'} {problem or ''}", flush=True)
    print("failures:", bad)
    spark.stop()
