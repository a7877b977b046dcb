"""Registry of driver queries: name -> (Spark callable, oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from convlens.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


# Doubles of compared rows are rounded by the same IEEE operations in both
# engines, so that the order of a sum cannot change a compared value: to 6
# places, and to 12 below a thousandth (p-values).  NaN and infinity stay as
# they are.  Only the driver's queries are rounded, never an operator's result.
SMALL, COARSE, FINE = 0.001, 1e6, 1e12


def round_doubles(df: DataFrame) -> DataFrame:
    from pyspark.sql import functions as F
    from pyspark.sql import types as TY

    cols = []
    for f in df.schema.fields:
        v = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (TY.DoubleType, TY.FloatType)):
            v = v.cast("double")
            r = F.when(F.abs(v) < SMALL, F.rint(v * F.lit(FINE)) / F.lit(FINE)).otherwise(F.rint(v * F.lit(COARSE)) / F.lit(COARSE))
            v = F.when(r == 0, F.lit(0.0)).otherwise(r).alias(f.name)  # no negative zero
        cols.append(v)
    return df.select(*cols)


def _rounded_sql(column: str) -> str:
    c = f'"{column}"'
    r = (
        f"CASE WHEN abs({c}) < {SMALL} THEN round_even({c}::DOUBLE * {FINE:.0f}::DOUBLE, 0) / {FINE:.0f}::DOUBLE "
        f"ELSE round_even({c}::DOUBLE * {COARSE:.0f}::DOUBLE, 0) / {COARSE:.0f}::DOUBLE END"
    )
    return f"CASE WHEN {r} = 0 THEN 0.0::DOUBLE ELSE {r} END AS {c}"


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name`` with its DuckDB SQL."""

    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark, sf_dir, _fn=fn):
            ship_package(spark)
            return round_doubles(_fn(spark, sf_dir))

        run.__name__ = getattr(fn, "__name__", name)
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return deco


#: Columns of the driver's tables, so that no file has to be read to type a statement.
TABLES = {
    "region": "r_regionkey INTEGER, r_name VARCHAR",
    "nation": "n_nationkey INTEGER, n_name VARCHAR, n_regionkey INTEGER",
    "customer": "c_custkey BIGINT, c_name VARCHAR, c_nationkey INTEGER, c_acctbal DOUBLE, c_mktsegment VARCHAR",
    "supplier": "s_suppkey BIGINT, s_name VARCHAR, s_nationkey INTEGER, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name VARCHAR, p_brand VARCHAR, p_type VARCHAR, p_size INTEGER, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus VARCHAR, o_totalprice DOUBLE, o_orderdate TIMESTAMP, o_orderpriority VARCHAR",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INTEGER, l_quantity DOUBLE, l_extendedprice DOUBLE, "
    "l_discount DOUBLE, l_tax DOUBLE, l_returnflag VARCHAR, l_linestatus VARCHAR, l_shipdate TIMESTAMP",
    "events": "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR",
    "documents": "doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT",
    "embeddings": "vec_id BIGINT, embedding FLOAT[], label INTEGER",
    "pages": "page_id BIGINT, url VARCHAR, html VARCHAR",
    "benchmark": "item_id BIGINT, text VARCHAR",
    "labels": "doc_id BIGINT, quality INTEGER, toxic INTEGER",
    "conversations": "conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR",
}
_ROUNDED_SQL: dict[str, str] = {}


def rounded_oracles() -> dict[str, str]:
    """Oracle SQL with double columns rounded like ``round_doubles``.

    The double columns of each statement come from DuckDB itself, over empty
    tables in this process; a statement that does not bind is an error.
    """
    if len(_ROUNDED_SQL) < len(ORACLES):
        import duckdb

        con = duckdb.connect()
        for t, columns in TABLES.items():
            con.execute(f"CREATE TABLE {t} ({columns})")
        for name, sql in ORACLES.items():
            try:
                desc = con.execute(f"SELECT * FROM ({sql}) AS _q LIMIT 0").description
            except duckdb.Error as e:
                raise ValueError(f"oracle of {name} does not bind") from e
            doubles = [d[0] for d in desc if str(d[1]).upper() in ("DOUBLE", "FLOAT")]
            rep = ", ".join(_rounded_sql(c) for c in doubles)
            _ROUNDED_SQL[name] = f"SELECT * REPLACE ({rep}) FROM ({sql}) AS _q" if doubles else sql
    return dict(_ROUNDED_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def union_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """``(table, row)``: the rows of several tables, as JSON."""
    from pyspark.sql import functions as F

    out = None
    for name, df in tables.items():
        part = df.select(F.lit(name).alias("table"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("row"))
        out = part if out is None else out.unionByName(part)
    return out
