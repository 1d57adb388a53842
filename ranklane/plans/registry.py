"""Query registry: name → (Spark builder, optional DuckDB oracle SQL).

Builders take ``(spark, sf_dir)`` and return a DataFrame whose columns are
normalised by ``finish``: integers as BIGINT, floating and decimal values
rounded to 6 decimals through DECIMAL(38,6) (summation order differs between
engines; the decimal round trip makes both engines return the same double).
``normalize_oracle`` applies the same normalisation to the oracle's output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ranklane.plans.oracle_views import is_valid_sql, r6, tok, valid, with_views  # noqa: F401

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_views(sql, *views)
        return fn
    return deco


def finish(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        t = f.dataType
        if isinstance(t, (T.IntegerType, T.ShortType, T.ByteType, T.LongType)):
            c = c.cast("bigint")
        elif isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
            c = c.cast("double").cast("decimal(38,6)").cast("double")
        elif isinstance(t, T.BooleanType):
            c = c.cast("bigint")
        cols.append(c.alias(f.name))
    return df.select(*cols)


_INT_TYPES = {"TINYINT", "SMALLINT", "INTEGER", "BIGINT", "HUGEINT", "UTINYINT", "USMALLINT",
              "UINTEGER", "UBIGINT", "BOOLEAN"}


def normalize_oracle(con, sql: str) -> str:
    """Wrap an oracle statement so its output is normalised like ``finish``.
    Output types come from DESCRIBE (binding only, nothing is executed)."""
    cols = con.execute(f"DESCRIBE {sql}").fetchall()
    sel = []
    for name, typ, *_ in cols:
        q = '"' + name.replace('"', '""') + '"'
        if typ in ("DOUBLE", "FLOAT", "REAL") or typ.startswith("DECIMAL"):
            sel.append(f"CAST(CAST(CAST({q} AS DOUBLE) AS DECIMAL(38,6)) AS DOUBLE) AS {q}")
        elif typ in _INT_TYPES:
            sel.append(f"CAST({q} AS BIGINT) AS {q}")
        else:
            sel.append(q)
    return f"SELECT {', '.join(sel)} FROM (\n{sql}\n) AS __oracle"


def normalized_oracles(sql_by_key: dict[str, str], schema_dir: str) -> dict[str, str]:
    """All oracle statements wrapped by ``normalize_oracle``; the driver
    tables are bound from ``schema_dir`` (only their schemas are read)."""
    import os

    import duckdb

    con = duckdb.connect()
    for f in sorted(os.listdir(schema_dir)):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{schema_dir}/{f}')")
    out = {}
    for k, sql in sql_by_key.items():
        out[k] = normalize_oracle(con, sql)
    return out
