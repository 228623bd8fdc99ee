"""Rasters derived from the driver's tables, in Spark SQL and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_BANDS = "cast(vec_id as int) y, cast(pos % 16 as int) x, cast(floor(pos / 16) as int) band, case when label = 9 then 0 else cast(floor((cast(v as double) + 0.6) * 10000) as int) end dn"
SPARK = {
    "bands": ("embeddings", f"select {_BANDS} from embeddings lateral view posexplode(embedding) t as pos, v"),
    "radar": ("orders", "select cast(floor(o_orderkey / 100) as int) y, cast(o_orderkey % 100 as int) x, cast(floor(o_totalprice / 8) as int) dn from orders"),
    "classes": ("part", "select cast(floor(p_partkey / 40) as int) y, cast(p_partkey % 40 as int) x, cast(p_size % 14 as int) code, case when p_partkey % 11 = 0 then 0 else 255 end a from part"),
    "rgb": ("events", "select cast(floor(event_id / 50) as int) y, cast(event_id % 50 as int) x, cast(event_id * 7 % 256 as int) r, cast(user_id * 13 % 256 as int) g, cast(cast(floor(value) as int) % 256 as int) b, case when event_type = 'error' then 0 else 255 end a from events"),
    "tie": ("nation", "select 0 raster_id, cast(n_nationkey % 5 as int) gx, cast(floor(n_nationkey / 5) as int) gy, cast(n_nationkey % 5 as int) * 25 px, cast(floor(n_nationkey / 5) as int) * 25 py, cast(10.0 as double) + cast(0.5 as double) * (n_nationkey % 5) + cast(0.02 as double) * floor(n_nationkey / 5) lon, cast(50.0 as double) - cast(0.4 as double) * floor(n_nationkey / 5) + cast(0.03 as double) * (n_nationkey % 5) lat from nation"),
    "meta": ("supplier", "select s_suppkey raster_id, 32601 + (s_nationkey * 2 + 7) % 60 epsg, 200 + cast(s_suppkey % 7 as int) * 100 width, 200 + cast(s_suppkey % 5 as int) * 100 height, cast(300000 as double) + 6000 * (s_suppkey % 9) x_min, cast(5600000 as double) - 20000 * (s_suppkey % 11) y_max, cast(10 as double) px_w, cast(-10 as double) px_h from supplier"),
    "complex": ("lineitem", "select l_orderkey, l_linenumber, cast(floor(l_quantity) as int) * 600 - 15000 i, cast(floor(l_discount * 100) as int) * 3000 - 15000 q from lineitem"),
    "requests": ("part", "select p_partkey req_id, concat(case when p_size % 4 = 0 then 'NDVI@' when p_size % 4 = 1 then 'HONS@' when p_size % 4 = 2 then 'SCL@' else '' end, 'in/', cast(p_partkey as string), '/T33_B08.v2.jp2', case when p_size % 4 in (0, 1) then concat(',in/T33_', p_type, '_B04.jp2') else '' end, case when p_size % 4 = 1 then ',B02.jp2' else '' end, case when p_size % 3 = 0 then ':q=80' else '' end, case when p_size % 6 = 0 then ':s=2' else '' end) request from part"),
}
DUCK = {name: sql for name, (_, sql) in SPARK.items()} | {
    "bands": f"select {_BANDS} from (select vec_id, label, generate_subscripts(embedding, 1) - 1 pos, unnest(embedding) v from embeddings)",
}


def raster(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The raster ``name`` of the tables in ``sf_dir``."""
    source, sql = SPARK[name]
    return spark.sql(sql.replace(f"from {source}", "from {source}"), source=spark.read.parquet(f"{sf_dir}/{source}.parquet"))


def duck(*names: str) -> str:
    """WITH clause of the rasters for an oracle."""
    return "WITH " + ", ".join(f"{n} AS ({DUCK[n]})" for n in names) + " "
