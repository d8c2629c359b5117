"""The engine's inputs bound onto the star-schema tables: frames for Spark, common table expressions for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelmill.operators.grid import GridSpec
from pixelmill.operators.legend import CLASSES, LEVEL_1, LEVEL_2, TRAINING, legend, table_rows

N_COLS = 100
TOP_VALUE = 600_000.0
FEATURES = [f"f{i}" for i in range(8)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations of pixels over a month: eight-day seasons, a scene class, one band."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("pixel"), "ts", F.expr("CAST((day(ts) - 1) DIV 8 AS INT)").alias("season"), F.expr("CAST(event_id % 12 AS INT)").alias("scl"), (F.col("value") * 20).alias("dn")
    )


OBS = "obs AS (SELECT user_id AS pixel, ts, CAST((day(ts) - 1) // 8 AS INT) AS season, CAST(event_id % 12 AS INT) AS scl, value * 20 AS dn FROM events)"


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raster of 100 columns with gaps."""
    return table(spark, sf_dir, "orders").select(
        F.expr(f"CAST(o_orderkey DIV {N_COLS} AS INT)").alias("row"), F.expr(f"CAST(o_orderkey % {N_COLS} AS INT)").alias("col"), F.when(F.expr("o_orderkey % 7 >= 2"), F.col("o_totalprice")).alias("v")
    )


def full_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same raster without gaps."""
    return table(spark, sf_dir, "orders").select(F.expr(f"CAST(o_orderkey DIV {N_COLS} AS INT)").alias("row"), F.expr(f"CAST(o_orderkey % {N_COLS} AS INT)").alias("col"), F.col("o_totalprice").alias("v"))


GRID = f"""cells AS (SELECT CAST(o_orderkey // {N_COLS} AS INT) AS r, CAST(o_orderkey % {N_COLS} AS INT) AS c, o_totalprice AS full_v,
  CASE WHEN o_orderkey % 7 >= 2 THEN o_totalprice END AS v FROM orders)"""


def spec_of(df: DataFrame) -> GridSpec:
    """Unit cells, the top edge at the number of rows."""
    n_rows = (df.agg(F.max("row")).first()[0] or 0) + 1
    return GridSpec(0.0, float(n_rows), 1.0, 1.0, n_rows, N_COLS)


def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten bands as positive combinations of four measures."""
    return table(spark, sf_dir, "lineitem").select(*[F.expr(e).alias(b) for b, e in BAND_TERMS.items()])


BAND_TERMS = {
    "b02": "200 + 10 * l_quantity",
    "b03": "300 + 12 * l_quantity + 500 * l_discount",
    "b04": "250 + 8 * l_quantity + 900 * l_tax",
    "b05": "400 + 20 * l_quantity",
    "b06": "600 + 30 * l_quantity",
    "b07": "700 + l_extendedprice / 100",
    "b08": "800 + l_extendedprice / 50",
    "b8a": "820 + l_extendedprice / 48",
    "b11": "500 + l_extendedprice / 80 + 1000 * l_discount",
    "b12": "300 + l_extendedprice / 90 + 2000 * l_tax",
}
BANDS_SQL = "bands AS (SELECT " + ", ".join(f"{e} AS {b}" for b, e in BAND_TERMS.items()) + " FROM lineitem)"


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training pixels: eight predictors, ten classes in five macrotypes."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.expr("CAST(10 * (label DIV 2 + 1) + label % 2 + 1 AS INT)").alias("cod_l2"),
        F.expr("CAST(label DIV 2 + 1 AS INT)").alias("cod_l1"),
        *[F.col("embedding")[i].cast("double").alias(f) for i, f in enumerate(FEATURES)],
    )


PIXELS = (
    "pixels AS (SELECT vec_id AS id, CAST(10 * (label // 2 + 1) + label % 2 + 1 AS INT) AS cod_l2, CAST(label // 2 + 1 AS INT) AS cod_l1, "
    + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS {f}" for i, f in enumerate(FEATURES))
    + " FROM embeddings)"
)


def truth_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """True and predicted class 1..5, a quarter of them wrong, and a fold."""
    true = F.substring("o_orderpriority", 1, 1).cast("int")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), true.alias("true"), F.when(F.expr("o_orderkey % 4 = 0"), F.pmod(true, F.lit(5)) + 1).otherwise(true).cast("int").alias("pred"), F.expr("CAST(o_orderkey % 5 + 1 AS INT)").alias("fold")
    )


TRUTH = """truth AS (SELECT o_orderkey AS id, CAST(substring(o_orderpriority, 1, 1) AS INT) AS t, CAST(o_orderkey % 5 + 1 AS INT) AS fold,
  CASE WHEN o_orderkey % 4 = 0 THEN CAST(substring(o_orderpriority, 1, 1) AS INT) % 5 + 1 ELSE CAST(substring(o_orderpriority, 1, 1) AS INT) END AS p FROM orders)"""

#: All 18 level-2 classes, a quarter of the rows taken for the next one.
CODES_18 = [int(c) for c, _, _ in table_rows(LEVEL_2)]


def truth_pred_18(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = F.array(*[F.lit(c) for c in CODES_18])
    at = F.expr("CAST((o_orderkey * 7) % 18 AS INT)")
    taken = F.when(F.expr("o_orderkey % 4 = 0"), (at + 1) % 18).otherwise(at)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), codes[at].alias("true"), codes[taken].alias("pred"))


TRUTH_18 = f"""truth_18 AS (SELECT o_orderkey AS id, [{", ".join(map(str, CODES_18))}][(o_orderkey * 7) % 18 + 1] AS t,
  [{", ".join(map(str, CODES_18))}][((o_orderkey * 7) % 18 + CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END) % 18 + 1] AS p FROM orders)"""

UNKNOWN = (9991, 9992)


def legend_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Land-use polygons with a class, a dirty description and an area; two classes are in no lookup."""
    codes = [int(c) for c, _, _ in table_rows(CLASSES)] + list(UNKNOWN)
    picked = F.array(*[F.lit(c) for c in codes])[F.expr(f"CAST((p_size * 7) % {len(codes)} AS INT)")]
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("polygon_id"), picked.alias("classe"), F.col("p_brand").alias("description"), F.col("p_retailprice").alias("area"))


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _legend_sql() -> str:
    level_1, level_2 = ({int(c): t for c, _, t in table_rows(x)} for x in (LEVEL_1, LEVEL_2))
    rows = ", ".join(
        f"({i}, {c}, {_text(t)}, {int(l2) // 10}, {_text(level_1[int(l2) // 10])}, {l2}, {_text(level_2[int(l2)])}, '{TRAINING}')" for i, (c, l2, t) in enumerate(table_rows(CLASSES))
    )
    n = len(table_rows(CLASSES))
    return (
        f"legend(i, classe, desc_clean, cod_l1, desc_l1, cod_l2, desc_l2, tipo) AS (VALUES {rows}), "
        f"codes AS (SELECT i, classe FROM legend UNION ALL VALUES ({n}, {UNKNOWN[0]}), ({n + 1}, {UNKNOWN[1]})), "
        f"raw AS (SELECT p_partkey AS polygon_id, codes.classe, p_brand AS description, p_retailprice AS area FROM part JOIN codes ON codes.i = (p_size * 7) % {n + 2})"
    )


LEGEND = _legend_sql()


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return legend_raw(spark, sf_dir).join(F.broadcast(legend(spark)), "classe")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.expr("CAST(c_custkey % 15 AS INT)").alias("row"), F.expr(f"CAST((c_custkey * 7) % {N_COLS} AS INT)").alias("col"))


POINTS = f"points AS (SELECT c_custkey AS id, CAST(c_custkey % 15 AS INT) AS r, CAST((c_custkey * 7) % {N_COLS} AS INT) AS c FROM customer)"


def rects(spark: SparkSession, sf_dir: str, n_rows: int) -> DataFrame:
    """Axis-aligned rectangles as closed rings over a grid of unit cells."""
    box = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("cls"), ((F.col("s_suppkey") * 13) % 90 + 0.25).alias("x"), ((F.col("s_suppkey") * 5) % n_rows + 0.75).alias("y"), (F.col("s_suppkey") % 9 + 1.5).alias("w"), (F.col("s_suppkey") % 4 + 1.0).alias("h")
    )
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x, y, x2, y2 = F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h")
    return box.select("id", "cls", F.array(F.array(corner(x, y), corner(x2, y), corner(x2, y2), corner(x, y2), corner(x, y))).alias("rings"))


RECTS = """n AS (SELECT max(r) + 1 AS n_rows FROM cells),
rects AS (SELECT s_suppkey AS id, s_nationkey AS cls, (s_suppkey * 13) % 90 + 0.25 AS x, (s_suppkey * 5) % n_rows + 0.75 AS y, s_suppkey % 9 + 1.5 AS w, s_suppkey % 4 + 1.0 AS h FROM supplier, n),
covered AS (SELECT id, cls, r, c FROM rects, n, cells WHERE c + 0.5 >= x AND c + 0.5 < x + w AND n_rows - r - 0.5 >= y AND n_rows - r - 0.5 < y + h)"""


def river(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raster with a value on the river cells only."""
    return full_grid(spark, sf_dir).withColumn("river", F.when(F.col("col") == (F.col("row") * 3) % N_COLS, 1))


#: Two tiles on both sides of the edge of two zones, and a grid across them.
CUBE_TILES = {"T32TQQ": (735_000.0, 4_990_000.0, 20.0, 32632), "T33TUK": (263_000.0, 4_990_000.0, 20.0, 32633)}
CUBE_TARGET = (734_907.3, 4_990_031.7, 25.0, 90)


def cube_specs(n_rows: int) -> tuple[dict[str, GridSpec], GridSpec]:
    left, top, cell, cols = CUBE_TARGET
    tiles = {name: GridSpec(x, y, d, d, n_rows, N_COLS, srid) for name, (x, y, d, srid) in CUBE_TILES.items()}
    return tiles, GridSpec(left, top, cell, cell, n_rows * 4 // 5 + 5, cols, 32632)


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three dates of two tiles: the raster with gaps in two brightnesses, and a scene class."""
    rows = grid(spark, sf_dir).withColumn("key", F.col("row") * N_COLS + F.col("col")).withColumn("date", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    rows = rows.withColumn("tile", F.explode(F.array(*map(F.lit, CUBE_TILES))))
    first = F.col("tile") == next(iter(CUBE_TILES))
    return rows.select(
        "tile",
        F.expr("TIMESTAMP_NTZ '2019-04-01 10:10:00' + make_dt_interval(5 * date)").alias("ts"),
        "row",
        "col",
        F.when(first, (F.col("key") * 5 + F.col("date") * 3) % 12).otherwise((F.col("key") * 7 + F.col("date")) % 12).cast("int").alias("scl"),
        F.when(first, F.col("v") / 100 * (1 + F.col("date") / 10)).otherwise(F.col("v") / 100 * (1 + F.col("date") / 8) + 100).alias("b08"),
    )


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longitudes and latitudes around the middle of a UTM zone."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(key.alias("id"), (6.0 + (key % 600) / 100).alias("lon"), (43.0 + (key % 379) / 100).alias("lat"))


def spoilt_rects(spark: SparkSession, sf_dir: str, n_rows: int) -> DataFrame:
    """The rectangles with faults by id: empty, open, repeated and null points, a spike, the wrong turn."""
    ring = F.col("rings")[0]
    nothing = F.lit(None).cast("double")
    null_point = F.array(F.struct(nothing.alias("x"), nothing.alias("y")))
    spike = F.array(F.struct((ring[1]["x"] + 5).alias("x"), ring[1]["y"].alias("y")), ring[1])
    fault = F.col("id") % 5
    spoilt = (
        F.when(fault == 0, F.slice(ring, 1, 1))
        .when(fault == 1, F.slice(ring, 1, 4))
        .when(fault == 2, F.concat(F.slice(ring, 1, 2), F.slice(ring, 2, 4)))
        .when(fault == 3, F.concat(F.slice(ring, 1, 2), spike, null_point, F.slice(ring, 3, 3)))
        .otherwise(F.reverse(ring))
    )
    return rects(spark, sf_dir, n_rows).withColumn("rings", F.array(spoilt))
