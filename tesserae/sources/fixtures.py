"""Pixel relations derived from the driver's tables by integer arithmetic.

Each is a DataFrame, and beside it the same relation as DuckDB SQL for the oracles. Images are
64 x 64, cut from the dense keys of a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

WIDTH = HEIGHT = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cell(k: str) -> list[str]:
    return [f"cast({k} div 4096 as int) image_id", f"cast(({k} div 64) % 64 as int) y", f"cast({k} % 64 as int) x"]


def _cell_sql(k: str) -> str:
    return f"({k} // 4096)::int as image_id, (({k} // 64) % 64)::int as y, ({k} % 64)::int as x"


def px(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = "o_orderkey"
    return table(spark, sf_dir, "orders").selectExpr(
        *_cell(k),
        "cast(o_custkey % 256 as int) r",
        f"cast(({k} * 37) % 256 as int) g",
        "cast(cast(floor(o_totalprice) as bigint) % 256 as int) b",
        "case o_orderstatus when 'F' then 255 when 'O' then 128 else 0 end a",
    )


PX = f"""px as (select {_cell_sql('o_orderkey')}, (o_custkey % 256)::int as r, ((o_orderkey * 37) % 256)::int as g,
  (floor(o_totalprice)::bigint % 256)::int as b, case o_orderstatus when 'F' then 255 when 'O' then 128 else 0 end as a from orders)"""


def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        *_cell("l_orderkey"),
        "cast(l_linenumber - 1 as int) z",
        "cast(l_partkey % 256 as int) r",
        "cast((l_suppkey * 23) % 256 as int) g",
        "cast(cast(floor(l_extendedprice) as bigint) % 256 as int) b",
        "case l_returnflag when 'N' then 255 when 'A' then 128 else 64 end a",
    )


LAYERS = f"""layers as (select {_cell_sql('l_orderkey')}, (l_linenumber - 1)::int as z, (l_partkey % 256)::int as r, ((l_suppkey * 23) % 256)::int as g,
  (floor(l_extendedprice)::bigint % 256)::int as b, case l_returnflag when 'N' then 255 when 'A' then 128 else 64 end as a from lineitem)"""


def mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*_cell("o_orderkey"), "cast(cast(floor(o_totalprice) as bigint) % 256 as int) v")


MASK = f"mask as (select {_cell_sql('o_orderkey')}, (floor(o_totalprice)::bigint % 256)::int as v from orders)"


def idx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*_cell("o_orderkey"), "cast(o_custkey % 256 as int) idx")


IDX = f"idx as (select {_cell_sql('o_orderkey')}, (o_custkey % 256)::int as idx from orders)"


def gray64(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar planes: 64 rows of 64 values each, from the embeddings."""
    rows = table(spark, sf_dir, "embeddings").selectExpr("vec_id", "posexplode(embedding) as (x, e)")
    return rows.selectExpr("cast(vec_id div 64 as int) image_id", "cast(vec_id % 64 as int) y", "cast(x as int) x", "cast(floor((cast(e as double) + 1) * 127.5) as int) v")


GRAY64 = """gray64 as (select (vec_id // 64)::int as image_id, (vec_id % 64)::int as y, (i - 1)::int as x, floor((embedding[i]::double + 1) * 127.5)::int as v
  from embeddings, unnest(generate_series(1, 64)) as s(i))"""


def pal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where("p_partkey < 256").selectExpr(
        "0 palette_id", "cast(p_partkey as int) idx", "cast((p_size * 5) % 256 as int) r", "cast(cast(floor(p_retailprice) as bigint) % 256 as int) g", "cast((p_partkey * 91) % 256 as int) b", "255 a"
    )


PAL = """pal as (select 0 as palette_id, p_partkey::int as idx, ((p_size * 5) % 256)::int as r, (floor(p_retailprice)::bigint % 256)::int as g,
  ((p_partkey * 91) % 256)::int as b, 255 as a from part where p_partkey < 256)"""


def rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        "cast(c_custkey as int) rect_id", "cast(c_custkey % 50 as int) x0", "cast(c_custkey div 50 as int) y0", "cast(1 + c_nationkey as int) w", "cast(1 + cast(floor(abs(c_acctbal)) as bigint) % 16 as int) h"
    )


RECTS = """rects as (select c_custkey::int as rect_id, (c_custkey % 50)::int as x0, (c_custkey // 50)::int as y0, (1 + c_nationkey)::int as w,
  (1 + floor(abs(c_acctbal))::bigint % 16)::int as h from customer)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("cast(day(ts) as int) frame", "cast(event_id % 64 as int) y", "cast(cast(floor(value) as bigint) % 256 as int) v")


FRAMES = "frames as (select day(ts)::int as frame, (event_id % 64)::int as y, (floor(value)::bigint % 256)::int as v from events)"
