"""All registered queries of the land-cover engine, each beside the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelmill.functions import indices, projection
from pixelmill.operators import applicability, composite, forest, grid, legend, metrics, neighbourhood, purity, sampling, selection, separability, spatial
from pixelmill.operators.grid import GridSpec
from pixelmill.plans import fixtures as fx
from pixelmill.sources import files, vectors

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql is not None:
            SQL[name or f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked seasonal medians with the name of their season."""
    names = spark.createDataFrame([(i, s.name) for i, s in enumerate(composite.SEASONS)], "season int, season_name string")
    return a1_seasonal_median(spark, sf_dir).join(F.broadcast(names), "season")


# composites and band algebra


@query(f"WITH {fx.OBS} SELECT pixel, season, round(median(CASE WHEN scl IN (4, 5, 6) THEN dn END), 6) AS dn FROM obs GROUP BY ALL")
def a1_seasonal_median(spark, sf_dir):
    return composite.seasonal_median(fx.obs(spark, sf_dir), ["pixel", "season"], ["dn"]).withColumn("dn", F.round("dn", 6))


@query(f"WITH {fx.OBS} SELECT pixel, season, count(*) AS n_obs, count(*) FILTER (WHERE scl IN (4, 5, 6)) AS n_clear FROM obs GROUP BY ALL")
def a1_clear_observation_count(spark, sf_dir):
    return composite.clear_counts(fx.obs(spark, sf_dir), ["pixel", "season"])


@query(f"WITH {fx.OBS} SELECT pixel, ts, dn FROM obs WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-13'")
def f23_season_window(spark, sf_dir):
    return composite.in_season(fx.obs(spark, sf_dir), composite.Season("test", "2024-01-05", "2024-01-12")).select("pixel", "ts", "dn")


@query(
    f"""WITH {fx.BANDS_SQL}
SELECT round((b08 - b04) / nullif(b08 + b04, 0), 6) AS ndvi, round((b03 - b08) / nullif(b03 + b08, 0), 6) AS ndwi_mcf,
  round((b08 - b11) / nullif(b08 + b11, 0), 6) AS ndwi_gao, round((b03 - b11) / nullif(b03 + b11, 0), 6) AS mndwi,
  round(((b11 + b04) - (b08 + b02)) / nullif((b11 + b04) + (b08 + b02), 0), 6) AS bsi,
  round(2.5 * (b08 / 10000 - b04 / 10000) / nullif(b08 / 10000 + 2.4 * (b04 / 10000) + 1, 0), 6) AS evi2,
  round((b8a - b05) / nullif(b8a + b05, 0), 6) AS ndre, round((b11 - b08) / nullif(b11 + b08, 0), 6) AS ndbi,
  round((b11 - b12) / nullif(b11 + b12, 0), 6) AS nbr2,
  round(((b08 / 10000 + 0.1) - (b12 / 10000 + 0.02)) / nullif((b08 / 10000 + 0.1) + (b12 / 10000 + 0.02), 0), 6) AS gvmi,
  round((2 * b03 - (b04 + b02)) / nullif(2 * b03 + (b04 + b02), 0), 6) AS gli
FROM bands"""
)
def f_spectral_indices(spark, sf_dir):
    return fx.bands(spark, sf_dir).select(*[F.round(c, 6).alias(name) for name, c in indices.spectral_indices().items()])


@query(f"WITH {fx.BANDS_SQL} SELECT " + ", ".join(f"round({b} / 10000, 8) AS {b}" for b in fx.BAND_TERMS) + " FROM bands")
def p3_reflectance(spark, sf_dir):
    return indices.reflectance(fx.bands(spark, sf_dir)).select(*[F.round(b, 8).alias(b) for b in fx.BAND_TERMS])


@query(
    f'WITH {fx.GRID} SELECT r AS "row", c AS col, round(sin(radians((r * 37 + c * 11) % 360)), 6) + 0 AS aspect_sin, round(cos(radians((r * 37 + c * 11) % 360)), 6) + 0 AS aspect_cos FROM cells'
)
def p4_aspect_components(spark, sf_dir):
    degrees = ((F.col("row") * 37 + F.col("col") * 11) % 360).cast("double")
    return fx.grid(spark, sf_dir).select("row", "col", *[F.round(c, 6).alias(n) for n, c in indices.circular(degrees).items()])


@query(f"WITH {fx.BANDS_SQL} SELECT b02, b03, b04 FROM bands WHERE b02 / 10000 <= 0.05 AND b03 / 10000 <= 0.05 AND b04 / 10000 <= 0.05")
def p7_physical_filter(spark, sf_dir):
    blue = [F.col(b) / indices.SCALE for b in ("b02", "b03", "b04")]
    return fx.bands(spark, sf_dir).where(indices.physical(blue, 0.05)).select("b02", "b03", "b04")


@query(f'WITH {fx.GRID} SELECT r AS "row", c AS col, v FROM cells WHERE v IS NOT NULL')
def p8_subset_dropna(spark, sf_dir):
    return fx.grid(spark, sf_dir).dropna(subset=["v"])


@query(f'WITH {fx.GRID} SELECT r AS "row", c AS col, CASE WHEN v > 200000 THEN NULL ELSE full_v END AS b08 FROM cells')
def p10_cloud_null(spark, sf_dir):
    both = fx.full_grid(spark, sf_dir).withColumn("blue", F.when(F.expr(f"(row * {fx.N_COLS} + col) % 7 >= 2"), F.col("v")))
    return both.select("row", "col", indices.cloud_null(F.col("v"), F.col("blue"), 200_000).alias("b08"))


GREY = f"CASE WHEN {{v}} IS NOT NULL THEN CAST(least(greatest(round_even({{v}} / {fx.TOP_VALUE} * 31, 0), 0), 31) AS INT) END"


@query(f'WITH {fx.GRID} SELECT r AS "row", c AS col, CAST({GREY.format(v="v")} AS DOUBLE) AS grey FROM cells')
def p11_quantise(spark, sf_dir):
    return fx.grid(spark, sf_dir).select("row", "col", indices.grey_levels(F.col("v"), fx.TOP_VALUE).cast("double").alias("grey"))


# legend, recodes, summaries, sets


@query(f"WITH {fx.LEGEND} SELECT polygon_id, raw.classe, desc_clean, CAST(cod_l1 AS DOUBLE) AS cod_l1, CAST(cod_l2 AS DOUBLE) AS cod_l2, tipo FROM raw LEFT JOIN legend ON legend.classe = raw.classe")
def j1_legend_join(spark, sf_dir):
    joined = legend.attach(fx.legend_raw(spark, sf_dir), legend.legend(spark), "classe")
    return joined.select("polygon_id", "classe", "desc_clean", *[F.col(c).cast("double").alias(c) for c in ("cod_l1", "cod_l2")], "tipo")


@query(f"WITH {fx.LEGEND} SELECT DISTINCT classe FROM raw WHERE classe NOT IN (SELECT classe FROM legend)")
def j5_missing_classes(spark, sf_dir):
    return legend.missing_keys(fx.legend_raw(spark, sf_dir), legend.legend(spark), "classe")


@query(f"WITH {fx.LEGEND} SELECT polygon_id, classe FROM raw WHERE classe IN (SELECT classe FROM legend WHERE cod_l1 = 4)")
def j6_semi_join(spark, sf_dir):
    trees = legend.legend(spark).where("cod_l1 = 4").select("classe")
    return fx.legend_raw(spark, sf_dir).join(F.broadcast(trees), "classe", "left_semi").select("polygon_id", "classe")


@query(f"WITH {fx.LEGEND} SELECT raw.classe, desc_l2, count(*) AS n_polygons, round(sum(area), 2) AS area_ha FROM raw JOIN legend ON legend.classe = raw.classe GROUP BY ALL")
def a2_class_summary(spark, sf_dir):
    return legend.class_summary(fx.labelled(spark, sf_dir), ["classe", "desc_l2"], "area")


@query(f"WITH {fx.LEGEND} SELECT classe, count(DISTINCT description) AS n_variants FROM raw GROUP BY ALL")
def a17_description_variants(spark, sf_dir):
    return legend.description_variants(fx.legend_raw(spark, sf_dir), "classe", "description")


@query(f"WITH {fx.LEGEND} SELECT cod_l2 // 10 AS cod_l1, count(*) AS n FROM raw JOIN legend ON legend.classe = raw.classe GROUP BY ALL")
def p17_macrotype_frequency(spark, sf_dir):
    return legend.frequency(fx.labelled(spark, sf_dir).select(legend.macrotype().alias("cod_l1")), "cod_l1")


@query(f"WITH {fx.LEGEND} SELECT polygon_id, CAST(CASE cod_l1 WHEN 3 THEN 31 WHEN 6 THEN 61 WHEN 7 THEN 71 END AS DOUBLE) AS direct FROM raw JOIN legend ON legend.classe = raw.classe")
def p18_reclass(spark, sf_dir):
    return fx.labelled(spark, sf_dir).select("polygon_id", legend.reclassify(F.col("cod_l1"), legend.DIRECT).cast("double").alias("direct"))


@query(
    f"WITH {fx.LEGEND}, agg(a, b) AS (VALUES {', '.join(f'({a}, {b})' for a, b in legend.AGGREGATED.items())}) SELECT b AS cod_agg, count(*) AS n FROM raw JOIN legend ON legend.classe = raw.classe JOIN agg ON a = cod_l2 GROUP BY ALL"
)
def p19_aggregate_recode(spark, sf_dir):
    return legend.frequency(fx.labelled(spark, sf_dir).select(legend.aggregate_classes(F.col("cod_l2")).alias("cod_agg")), "cod_agg")


@query(f"WITH {fx.LEGEND} SELECT cod_l2, count(*) AS n FROM raw LEFT JOIN legend ON legend.classe = raw.classe WHERE cod_l2 IS NOT NULL GROUP BY ALL")
def a3_frequency(spark, sf_dir):
    return legend.frequency(legend.attach(fx.legend_raw(spark, sf_dir), legend.legend(spark), "classe"), "cod_l2")


@query(f"WITH {fx.LEGEND} SELECT legend.classe, desc_clean, cod_l1, desc_l1, cod_l2, desc_l2, tipo, count(polygon_id) AS n FROM legend LEFT JOIN raw ON raw.classe = legend.classe GROUP BY ALL")
def s17_legend(spark, sf_dir):
    """The legend with the polygons of each class, classes without any included."""
    counts = legend.frequency(fx.legend_raw(spark, sf_dir), "classe")
    return legend.attach(legend.legend(spark), counts, "classe").withColumn("n", F.coalesce("n", F.lit(0)))


PALETTE = "palette(level, value, colour, label) AS (VALUES " + ", ".join(f"({n}, {v}, '{c}', '{v} - {t}')" for n, b in ((1, legend.LEVEL_1), (2, legend.LEVEL_2)) for v, c, t in legend.table_rows(b)) + ")"


@query(
    f"WITH {fx.LEGEND}, {PALETTE}, seen AS (SELECT 1 AS level, cod_l1 AS value FROM raw JOIN legend ON legend.classe = raw.classe UNION ALL SELECT 2, cod_l2 FROM raw JOIN legend ON legend.classe = raw.classe) "
    "SELECT palette.level, palette.value, colour, label, count(*) AS n FROM palette JOIN seen ON seen.level = palette.level AND seen.value = palette.value GROUP BY ALL"
)
def s19_palette(spark, sf_dir):
    """Colours and labels of the classes that the polygons show, at both levels."""
    codes = fx.labelled(spark, sf_dir).select(F.explode(F.array(*[F.struct(F.lit(n).alias("level"), F.col(c).alias("value")) for n, c in ((1, "cod_l1"), (2, "cod_l2"))])).alias("s")).select("s.*")
    counts = codes.groupBy("level", "value").agg(F.count(F.lit(1)).alias("n"))
    return legend.palette(spark).join(F.broadcast(counts), ["level", "value"])  # one row per class


@query(f"WITH {fx.LEGEND} SELECT polygon_id, classe FROM raw WHERE polygon_id % 3 = 0 UNION ALL SELECT polygon_id, classe FROM raw WHERE polygon_id % 3 = 1")
def u1_union_by_name(spark, sf_dir):
    raw = fx.legend_raw(spark, sf_dir).select("polygon_id", "classe")
    return raw.where("polygon_id % 3 = 0").unionByName(raw.where("polygon_id % 3 = 1").select("classe", "polygon_id"))


@query(f"WITH {fx.LEGEND} SELECT classe FROM legend EXCEPT SELECT classe FROM raw")
def u3_set_difference(spark, sf_dir):
    return legend.legend(spark).select("classe").subtract(fx.legend_raw(spark, sf_dir).select("classe"))


@query(f"WITH {fx.LEGEND} SELECT classe FROM legend INTERSECT SELECT classe FROM raw")
def u4_set_intersection(spark, sf_dir):
    return legend.legend(spark).select("classe").intersect(fx.legend_raw(spark, sf_dir).select("classe"))


@query(
    f"WITH {fx.PIXELS}, p AS (SELECT " + " + ".join(f"CAST(count({f}) = count(*) AS INT)" for f in fx.FEATURES) + " AS p FROM pixels), "
    f"m AS (SELECT unnest([floor(sqrt(p) / 2), floor(sqrt(p)), round_even(p / 5, 0), round_even(p / 3, 0)]) AS m, p FROM p) "
    f"SELECT DISTINCT CAST(greatest(1, least(p, {forest.MTRY_MOST}, m)) AS INT) AS mtry, node FROM m, (VALUES (5), (10)) AS n(node)"
)
def u6_settings_grid(spark, sf_dir):
    """Settings to try, by the number of predictors that have no nulls."""
    whole = grid.null_free(fx.pixels(spark, sf_dir), fx.FEATURES)
    mtry = spark.createDataFrame([(m,) for m in forest.mtry_grid(len(whole))], "mtry int")
    return mtry.select("mtry", F.explode(F.array(F.lit(5), F.lit(10))).alias("node"))


@query(f"WITH {fx.LEGEND} SELECT polygon_id, area FROM raw ORDER BY area DESC, polygon_id LIMIT 10")
def o4_top_areas(spark, sf_dir):
    return fx.legend_raw(spark, sf_dir).select("polygon_id", "area").orderBy(F.col("area").desc(), "polygon_id").limit(10)


@query(f"WITH {fx.LEGEND} SELECT DISTINCT cod_l1, cod_l2 FROM raw JOIN legend ON legend.classe = raw.classe")
def p16_distinct_codes(spark, sf_dir):
    return fx.labelled(spark, sf_dir).select("cod_l1", "cod_l2").distinct()


@query(f"WITH {fx.LEGEND}, k AS (SELECT cod_l1, cod_l2 FROM raw JOIN legend ON legend.classe = raw.classe) SELECT cod_l2 FROM k WHERE cod_l1 < 5 UNION SELECT cod_l2 FROM k WHERE cod_l1 > 3")
def u5_set_union(spark, sf_dir):
    codes = fx.labelled(spark, sf_dir)
    return codes.where("cod_l1 < 5").select("cod_l2").union(codes.where("cod_l1 > 3").select("cod_l2")).distinct()


@query(f"WITH {fx.LEGEND}, k AS (SELECT cod_l2, count(*) AS n FROM raw JOIN legend ON legend.classe = raw.classe GROUP BY cod_l2) SELECT DISTINCT legend.cod_l2, desc_l2, n FROM k JOIN legend ON legend.cod_l2 = k.cod_l2")
def j4_class_report(spark, sf_dir):
    names = legend.legend(spark).select("cod_l2", "desc_l2").distinct()
    return legend.frequency(fx.labelled(spark, sf_dir), "cod_l2").join(F.broadcast(names), "cod_l2")


@query(f"WITH {fx.LEGEND}, k AS (SELECT classe, count(*) AS n FROM raw GROUP BY classe) SELECT legend.classe, coalesce(n, 0) AS n FROM legend LEFT JOIN k ON k.classe = legend.classe")
def j7_counts_or_zero(spark, sf_dir):
    counts = legend.frequency(fx.legend_raw(spark, sf_dir), "classe")
    return legend.legend(spark).select("classe").join(counts, "classe", "left").select("classe", F.coalesce("n", F.lit(0)).alias("n"))


# layers and grids


@query(f'WITH {fx.GRID} SELECT r AS "row", c AS col, v, full_v FROM cells')
def j9_stack(spark, sf_dir):
    return grid.stack([fx.grid(spark, sf_dir), fx.full_grid(spark, sf_dir).withColumnRenamed("v", "full_v")])


@query(f'WITH {fx.GRID} SELECT r AS "row", c AS col FROM cells WHERE v IS NOT NULL AND full_v IS NOT NULL')
def p9_complete_cases(spark, sf_dir):
    return j9_stack(spark, sf_dir).where(indices.complete(["v", "full_v"])).select("row", "col")

STATS = "SELECT '{c}' AS layer, min({c}) AS min_value, round(avg({c}), 4) AS mean_value, max({c}) AS max_value, count(*) - count({c}) AS n_null FROM cells"


@query(f"WITH {fx.GRID} {STATS.format(c='v')} UNION ALL {STATS.format(c='full_v')}")
def a4_layer_stats(spark, sf_dir):
    both = fx.full_grid(spark, sf_dir).select(F.col("v").alias("full_v"), F.when(F.expr(f"(row * {fx.N_COLS} + col) % 7 >= 2"), F.col("v")).alias("v"))
    return grid.layer_stats(both, ["v", "full_v"]).withColumn("mean_value", F.round("mean_value", 4))


@query(f"WITH {fx.GRID}, k AS (SELECT 'v' AS layer, count(*) - count(v) AS gaps FROM cells UNION ALL SELECT 'full_v', count(*) - count(full_v) FROM cells) SELECT layer FROM k WHERE gaps = 0")
def p15_null_free_columns(spark, sf_dir):
    both = fx.full_grid(spark, sf_dir).select(F.col("v").alias("full_v"), F.when(F.expr(f"(row * {fx.N_COLS} + col) % 7 >= 2"), F.col("v")).alias("v"))
    return spark.createDataFrame([(c,) for c in grid.null_free(both, ["v", "full_v"])], "layer string")


@query(f'WITH {fx.GRID} SELECT r - 2 AS "row", c - 10 AS col, v FROM cells WHERE r BETWEEN 2 AND 8 AND c BETWEEN 10 AND 60')
def g7_crop(spark, sf_dir):
    return grid.crop(fx.grid(spark, sf_dir), 2, 8, 10, 60)


@query(
    f'WITH {fx.GRID}, t AS (SELECT CAST(i // 104 AS INT) AS r, CAST(i % 104 AS INT) AS c FROM range(104 * 20) x(i)) SELECT t.r AS "row", t.c AS col, v FROM t LEFT JOIN cells ON cells.r = t.r AND cells.c = t.c'
)
def g22_template_extend(spark, sf_dir):
    return grid.on_template(fx.grid(spark, sf_dir), GridSpec(0.0, 20.0, 1.0, 1.0, 20, 104))


@query(f'WITH {fx.GRID} SELECT r AS "row", c AS col, coalesce(CASE WHEN c < 60 THEN v END, CASE WHEN c >= 40 THEN full_v + 1 END) AS v FROM cells WHERE c < 60 OR c >= 40')
def j17_mosaic(spark, sf_dir):
    new = fx.full_grid(spark, sf_dir).where("col >= 40").withColumn("v", F.col("v") + 1)
    return grid.mosaic(fx.grid(spark, sf_dir).where("col < 60"), new, "v")


DIFF = "diff AS (SELECT r, c, abs(v - (full_v + (r * c) % 17)) AS diff FROM cells WHERE v IS NOT NULL)"


def _difference(spark, sf_dir):
    other = fx.full_grid(spark, sf_dir).withColumn("v", F.col("v") + (F.col("row") * F.col("col")) % 17)
    return grid.difference(fx.grid(spark, sf_dir), other, "v")


@query(f'WITH {fx.GRID}, {DIFF} SELECT r AS "row", c AS col, round(diff, 6) AS diff FROM diff')
def j18_difference(spark, sf_dir):
    return _difference(spark, sf_dir).withColumn("diff", F.round("diff", 6))


@query(
    f"WITH {fx.GRID}, {DIFF} SELECT count(*) AS n, round(max(diff), 6) AS max_diff, round(median(diff), 6) AS median_diff, round(quantile_cont(diff, 0.95), 6) AS p95_diff, round(avg(CASE WHEN diff > 10 THEN 1.0 ELSE 0.0 END) * 100, 6) AS pct_above FROM diff"
)
def a11_drift(spark, sf_dir):
    found = grid.drift(_difference(spark, sf_dir), 10)
    return found.select("n", *[F.round(c, 6).alias(c) for c in ("max_diff", "median_diff", "p95_diff", "pct_above")])


@query(f"WITH {fx.GRID}, {DIFF} SELECT count(*) AS n, round(avg(diff), 6) AS mean_gap FROM diff WHERE c BETWEEN 45 AND 74")
def a19_seam(spark, sf_dir):
    return grid.seam_gap(_difference(spark, sf_dir), 45, 74).withColumn("mean_gap", F.round("mean_gap", 6))


@query(
    f"""WITH {fx.GRID}, n AS (SELECT max(r) + 1 AS n_rows FROM cells), t AS (SELECT CAST(i // 40 AS INT) AS tr, CAST(i % 40 AS INT) AS tc FROM n, range(40 * CAST(floor(n_rows / 2.5) AS BIGINT)) x(i))
SELECT tr AS "row", tc AS col, v FROM t LEFT JOIN cells ON r = CAST(floor((tr + 0.5) * 2.5) AS INT) AND c = CAST(floor((tc + 0.5) * 2.5) AS INT)"""
)
def g2_nearest(spark, sf_dir):
    df = fx.grid(spark, sf_dir)
    spec = fx.spec_of(df)
    return grid.nearest(df, spec, GridSpec(0.0, spec.top, 2.5, 2.5, int(spec.n_rows / 2.5), 40))


@query(
    f"""WITH {fx.GRID}, n AS (SELECT max(r) + 1 AS n_rows FROM cells), t AS (SELECT CAST(i // 40 AS INT) AS tr, CAST(i % 40 AS INT) AS tc FROM n, range(40 * CAST(floor(n_rows / 2.5) AS BIGINT)) x(i)),
p AS (SELECT tr, tc, (tc + 0.5) * 2.5 - 0.5 AS x, (tr + 0.5) * 2.5 - 0.5 AS y FROM t),
q AS (SELECT tr, tc, CAST(floor(y) AS INT) + j AS sr, CAST(floor(x) AS INT) + i AS sc,
  (CASE WHEN i = 0 THEN 1 - (x - floor(x)) ELSE x - floor(x) END) * (CASE WHEN j = 0 THEN 1 - (y - floor(y)) ELSE y - floor(y) END) AS w
  FROM p, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j))
SELECT tr AS "row", tc AS col, round(sum(w * v) / nullif(sum(CASE WHEN v IS NOT NULL THEN w END), 0), 7) AS v FROM q LEFT JOIN cells ON r = sr AND c = sc GROUP BY ALL"""
)
def g3_bilinear(spark, sf_dir):
    df = fx.grid(spark, sf_dir)
    spec = fx.spec_of(df)
    target = GridSpec(0.0, spec.top, 2.5, 2.5, int(spec.n_rows / 2.5), 40)
    return grid.bilinear(df, "v", spec, target).withColumn("v", F.round("v", 7))


# neighbourhoods


def _fill_sql(rounds: int) -> str:
    steps = [f"{fx.GRID}", "near AS (SELECT * FROM (VALUES (-1), (0), (1)) a(dr), (VALUES (-1), (0), (1)) b(dc))", "s0 AS (SELECT r, c, v FROM cells)"]
    for k in range(rounds):
        steps.append(
            f"s{k + 1} AS (SELECT a.r, a.c, coalesce(any_value(a.v), avg(b.v)) AS v FROM s{k} a CROSS JOIN near LEFT JOIN s{k} b ON b.r = a.r + dr AND b.c = a.c + dc GROUP BY a.r, a.c)"
        )
    return f'WITH {", ".join(steps)} SELECT r AS "row", c AS col, round(v, 4) AS v FROM s{rounds}'


@query(_fill_sql(1))
def g8_focal_fill_1(spark, sf_dir):
    return neighbourhood.fill_round(fx.grid(spark, sf_dir), "v").withColumn("v", F.round("v", 4))


@query(_fill_sql(5))
def g9_focal_fill_until_done(spark, sf_dir):
    return neighbourhood.fill(fx.grid(spark, sf_dir), "v")[0].withColumn("v", F.round("v", 4))


def _fill_inside_sql(rounds: int) -> str:
    steps = [f"{fx.GRID}", "near AS (SELECT * FROM (VALUES (-1), (0), (1)) a(dr), (VALUES (-1), (0), (1)) b(dc))", "s0 AS (SELECT r, c, v FROM cells WHERE r % 40 < 10 AND c < 40)"]
    for k in range(rounds):
        steps.append(
            f"s{k + 1} AS (SELECT a.r, a.c, coalesce(any_value(a.v), avg(b.v)) AS v FROM s{k} a CROSS JOIN near LEFT JOIN s{k} b ON b.r = a.r + dr AND b.c = a.c + dc GROUP BY a.r, a.c)"
        )
    return f'WITH {", ".join(steps)} SELECT cells.r AS "row", cells.c AS col, round(s{rounds}.v, 4) AS v FROM cells LEFT JOIN s{rounds} ON s{rounds}.r = cells.r AND s{rounds}.c = cells.c'


@query(_fill_inside_sql(5))
def g10_fill_inside(spark, sf_dir):
    df = fx.grid(spark, sf_dir)
    return neighbourhood.fill_inside(df, "v", df.where("row % 40 < 10 AND col < 40")).withColumn("v", F.round("v", 4))


query(_fill_inside_sql(5), name="g10_fill_inside_whole")(g10_fill_inside)  # its name of the round with windows


PAIRS = f"""grey AS (SELECT r, c, {GREY.format(v="full_v")} AS g FROM cells),
shifts(s, dr, dc) AS (VALUES (0, 0, 1), (1, 1, 1), (2, 1, 0), (3, 1, -1)),
pairs AS (SELECT a.r, a.c, s, a.g AS i, b.g AS j FROM grey a CROSS JOIN shifts JOIN grey b ON b.r = a.r + dr AND b.c = a.c + dc),
near AS (SELECT * FROM (VALUES (-2), (-1), (0), (1), (2)) x(nr), (VALUES (-2), (-1), (0), (1), (2)) y(nc)),
windows AS (SELECT a.r, a.c, s, i, j FROM grey a CROSS JOIN near JOIN pairs p ON p.r = a.r + nr AND p.c = a.c + nc)"""


def _grey(spark, sf_dir):
    return fx.full_grid(spark, sf_dir).select("row", "col", indices.grey_levels(F.col("v"), fx.TOP_VALUE).alias("grey"))


@query(
    f"""WITH {fx.GRID}, {PAIRS}, t AS (SELECT r, c, sum((i - j) * (i - j)) / 100.0 AS con, sum(1.0 / (1 + (i - j) * (i - j))) / 100.0 AS hom, count(*) AS n FROM windows GROUP BY r, c)
SELECT grey.r AS "row", grey.c AS col, round(CASE WHEN n = 100 THEN con END, 6) AS con, round(CASE WHEN n = 100 THEN hom END, 6) AS hom FROM grey LEFT JOIN t ON t.r = grey.r AND t.c = grey.c"""
)
def g11_contrast_homogeneity(spark, sf_dir):
    return neighbourhood.texture(_grey(spark, sf_dir), "grey").select("row", "col", F.round("con", 6).alias("con"), F.round("hom", 6).alias("hom"))


@query(
    f"""WITH {fx.GRID}, {PAIRS}, h AS (SELECT r, c, s, i, j, count(*) AS k FROM windows GROUP BY ALL),
t AS (SELECT r, c, -sum(k / 25.0 * ln(k / 25.0)) / 4 AS ent, sum(k) AS n FROM h GROUP BY r, c)
SELECT grey.r AS "row", grey.c AS col, round(CASE WHEN n = 100 THEN ent END, 6) AS ent FROM grey LEFT JOIN t ON t.r = grey.r AND t.c = grey.c"""
)
def g11_entropy(spark, sf_dir):
    return neighbourhood.entropy(_grey(spark, sf_dir), "grey").withColumn("ent", F.round("ent", 6))


@query(
    f"""WITH {fx.GRID}, w AS (SELECT a.r, a.c, a.full_v AS e, b.r - a.r AS dr, b.c - a.c AS dc, b.full_v AS z FROM cells a CROSS JOIN (SELECT * FROM (VALUES (-1), (0), (1)) x(nr), (VALUES (-1), (0), (1)) y(nc)) JOIN cells b ON b.r = a.r + nr AND b.c = a.c + nc),
g AS (SELECT r, c, count(*) AS n, sum(CASE WHEN dc <> 0 THEN dc * (2 - abs(dr)) * z END) / 80.0 AS gx, sum(CASE WHEN dr <> 0 THEN dr * (2 - abs(dc)) * z END) / 80.0 AS gy FROM w GROUP BY r, c),
k AS (SELECT r, c, CASE WHEN n = 9 THEN gx END AS gx, CASE WHEN n = 9 THEN gy END AS gy FROM g)
SELECT r AS "row", c AS col, round(degrees(atan(sqrt(gx * gx + gy * gy))), 6) AS slope,
  round(sin(CASE WHEN gx = 0 AND gy = 0 THEN pi() / 2 ELSE atan2(-gx, gy) END), 6) AS aspect_sin, round(cos(CASE WHEN gx = 0 AND gy = 0 THEN pi() / 2 ELSE atan2(-gx, gy) END), 6) AS aspect_cos FROM k"""
)
def g13_terrain(spark, sf_dir):
    found = neighbourhood.terrain(fx.full_grid(spark, sf_dir), "v", 10.0, 10.0)
    return found.select("row", "col", *[F.round(c, 6).alias(c) for c in ("slope", "aspect_sin", "aspect_cos")])


# vectors and rasters


@query(f'WITH {fx.GRID}, {fx.RECTS} SELECT id, r AS "row", c AS col FROM covered')
def j11_zonal(spark, sf_dir):
    spec = fx.spec_of(fx.grid(spark, sf_dir))
    return spatial.zonal_cells(fx.rects(spark, sf_dir, spec.n_rows), spec)


@query(f'WITH {fx.GRID}, {fx.RECTS} SELECT r AS "row", c AS col, arg_max(cls, id) AS cls FROM covered GROUP BY ALL')
def j10_rasterise(spark, sf_dir):
    spec = fx.spec_of(fx.grid(spark, sf_dir))
    return spatial.rasterise(fx.rects(spark, sf_dir, spec.n_rows), spec, "cls")


@query(f'WITH {fx.GRID}, {fx.POINTS} SELECT id, points.r AS "row", points.c AS col, v FROM points LEFT JOIN cells ON cells.r = points.r AND cells.c = points.c')
def j12_point_sample(spark, sf_dir):
    return spatial.sample_points(fx.points(spark, sf_dir), fx.grid(spark, sf_dir)).select("id", "row", "col", "v")


@query(f'WITH {fx.GRID}, {fx.RECTS} SELECT r AS "row", c AS col, CASE WHEN (r, c) IN (SELECT (r, c) FROM covered) THEN v END AS v FROM cells')
def j14_mask(spark, sf_dir):
    df = fx.grid(spark, sf_dir)
    spec = fx.spec_of(df)
    return spatial.mask(df, spatial.zonal_cells(fx.rects(spark, sf_dir, spec.n_rows), spec), "v")


@query(
    f"""WITH {fx.GRID}, n AS (SELECT max(r) + 1 AS n_rows FROM cells), l AS (SELECT 0.5 AS x1, n_rows - 0.5 AS y1, 99.5 AS x2, 0.5 AS y2, CAST(ceil(greatest(99.0, n_rows - 1.0) * 2) AS BIGINT) AS k FROM n)
SELECT DISTINCT CAST(floor(n_rows - (y1 + i / k * (y2 - y1))) AS INT) AS "row", CAST(floor(x1 + i / k * (x2 - x1)) AS INT) AS col FROM l, n, range(0, k + 1) t(i)"""
)
def j13_line_cells(spark, sf_dir):
    spec = fx.spec_of(fx.grid(spark, sf_dir))
    line = spark.createDataFrame([([(0.5, spec.top - 0.5), (99.5, 0.5)],)], "points array<struct<x:double,y:double>>")
    return spatial.line_cells(line, spec)


@query(
    f"""WITH {fx.GRID}, s AS (SELECT r, c FROM cells WHERE c = (r * 3) % 100)
SELECT a.r AS "row", a.c AS col, round(sqrt(min((a.r - s.r) * (a.r - s.r) * 100.0 + (a.c - s.c) * (a.c - s.c) * 100.0)), 6) AS distance FROM cells a, s GROUP BY a.r, a.c"""
)
def j15_distance(spark, sf_dir):
    return spatial.distance(fx.river(spark, sf_dir), "river", 10.0, 10.0).withColumn("distance", F.round("distance", 6))


@query(
    f"""WITH {fx.GRID}, s AS (SELECT r, c FROM cells WHERE c = (r * 3) % 100)
SELECT DISTINCT a.r AS "row", a.c AS col FROM cells a, s WHERE (a.r - s.r) * (a.r - s.r) * 100.0 + (a.c - s.c) * (a.c - s.c) * 100.0 <= 625"""
)
def g18_buffer(spark, sf_dir):
    return spatial.buffer_cells(fx.river(spark, sf_dir), "river", 25.0, 10.0, 10.0)


@query()  # a closure over the whole raster is too slow in SQL; the tests hold it against union-find
def g17_components(spark, sf_dir):
    return spatial.raster_components(fx.full_grid(spark, sf_dir).where("v > 150000"), fx.N_COLS)


@query(
    f"""WITH RECURSIVE {fx.GRID}, on_cells AS (SELECT r, c, CAST(r AS BIGINT) * 100 + c AS id FROM cells WHERE full_v > 250000),
links AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM on_cells a JOIN on_cells b ON b.r = a.r AND b.c = a.c + 1 UNION ALL SELECT b.id, a.id FROM on_cells a JOIN on_cells b ON b.r = a.r AND b.c = a.c + 1 UNION ALL SELECT a.id, b.id FROM on_cells a JOIN on_cells b ON b.c = a.c AND b.r = a.r + 1 UNION ALL SELECT b.id, a.id FROM on_cells a JOIN on_cells b ON b.c = a.c AND b.r = a.r + 1),
reach(w, v) AS (SELECT id, id FROM on_cells WHERE id NOT IN (SELECT b FROM links WHERE a < b) UNION SELECT reach.w, links.b FROM reach JOIN links ON links.a = reach.v WHERE links.b > reach.w),
part AS (SELECT v, min(w) AS component FROM reach GROUP BY v)
SELECT component, count(*) AS n_cells, count(*) * 100.0::DOUBLE AS area FROM part GROUP BY component HAVING count(*) >= 5"""
)
def p26_large_components(spark, sf_dir):
    labelled = spatial.raster_components(fx.full_grid(spark, sf_dir).where("v > 250000"), fx.N_COLS)
    return spatial.large_components(labelled, 100.0, 500.0)


query(name="g17_components_whole")(g17_components)  # their names of the round with windows
query(SQL["p26_large_components"], name="p26_large_components_whole")(p26_large_components)


# sampling


def _sample(name: str, sql: str, f: Callable[[DataFrame], DataFrame]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(fx.pixels(spark, sf_dir).select("id", "cod_l2"))

    QUERIES[name] = run
    SQL[name] = (
        f"WITH {fx.PIXELS}, ranked AS (SELECT id, cod_l2, row_number() OVER (PARTITION BY cod_l2 ORDER BY md5('50|' || id), id) AS rn, count(*) OVER (PARTITION BY cod_l2) AS n, count(*) OVER () AS total FROM pixels) " + sql
    )


_sample("w2_stratified_cap", "SELECT id, cod_l2 FROM ranked WHERE rn <= 20", lambda df: sampling.stratified_cap(df, "cod_l2", "id", 20))
_sample("w3_split", "SELECT id, cod_l2, CASE WHEN rn <= ceil(0.7::DOUBLE * n) THEN 'train' ELSE 'validation' END AS part FROM ranked", lambda df: sampling.train_split(df, "cod_l2", "id"))
_sample("w4_fraction", "SELECT id, cod_l2 FROM ranked WHERE rn <= greatest(1, round_even(n * 0.03::DOUBLE, 0))", lambda df: sampling.stratified_fraction(df, "cod_l2", "id", 0.03))
_sample("w5_folds", "SELECT id, cod_l2, CAST((rn - 1) % 5 + 1 AS INT) AS fold FROM ranked", lambda df: sampling.folds(df, "cod_l2", "id").withColumn("fold", F.col("fold").cast("int")))
_sample(
    "w6_quota", "SELECT id, cod_l2 FROM ranked WHERE rn <= CASE WHEN total <= 150 THEN n ELSE greatest(1, round_even(150.0::DOUBLE * n / total, 0)) END", lambda df: sampling.proportional_quota(df, "cod_l2", "id", 150)
)
_sample("w7_simple_random", "SELECT id, cod_l2 FROM pixels ORDER BY md5('50|' || id), id LIMIT 100", lambda df: sampling.simple_sample(df, "id", 100))
_sample(
    "w12_case_weights",
    "SELECT id, cod_l2, round(total / ((SELECT count(DISTINCT cod_l2) FROM pixels) * n), 6) AS case_weight FROM ranked",
    lambda df: sampling.case_weights(df, "cod_l2").withColumn("case_weight", F.round("case_weight", 6)),
)
_sample(
    "a10_split_counts",
    "SELECT cod_l2, count(*) FILTER (WHERE rn <= ceil(0.7::DOUBLE * n)) AS n_train, count(*) FILTER (WHERE rn > ceil(0.7::DOUBLE * n)) AS n_val FROM ranked GROUP BY ALL",
    lambda df: sampling.train_split(df, "cod_l2", "id").groupBy("cod_l2").agg(F.count_if(F.col("part") == "train").alias("n_train"), F.count_if(F.col("part") == "validation").alias("n_val")),
)
_sample(
    "a14_fold_counts", "SELECT CAST((rn - 1) % 5 + 1 AS INT) AS fold, cod_l2, count(*) AS n FROM ranked GROUP BY ALL", lambda df: forest.fold_sizes(sampling.folds(df, "cod_l2", "id").withColumn("fold", F.col("fold").cast("int")), "cod_l2")
)

# purity

Z = " + ".join(f"coalesce(pow(({f} - avg({f}) OVER w) / nullif(stddev_samp({f}) OVER w, 0), 2), 0)" for f in fx.FEATURES)
PURE = f"""z AS (SELECT id, cod_l2, sqrt({Z}) AS z FROM pixels WINDOW w AS (PARTITION BY cod_l2)),
t AS (SELECT *, avg(z) OVER w - stddev_samp(z) OVER w AS t1, avg(z) OVER w + stddev_samp(z) OVER w AS t2, count(*) OVER w AS n FROM z WINDOW w AS (PARTITION BY cod_l2)),
judged AS (SELECT id, cod_l2, z, n < 50 OR (z > t1 AND z < t2) AS pure FROM t)"""


@query(f"WITH {fx.PIXELS}, {PURE} SELECT id, cod_l2, round(z, 6) AS z, pure FROM judged")
def m3_purity(spark, sf_dir):
    return purity.purity(fx.pixels(spark, sf_dir), "cod_l2", fx.FEATURES).select("id", "cod_l2", F.round("z", 6).alias("z"), "pure")


@query(
    f"WITH {fx.PIXELS}, {PURE}, k AS (SELECT cod_l2, count(*) AS n_pre, count(*) FILTER (WHERE pure) AS n_post FROM judged GROUP BY ALL) SELECT *, n_pre - n_post AS n_removed, round(100.0::DOUBLE * (n_pre - n_post) / n_pre, 2) AS pct_removed FROM k"
)
def a18_purity_loss(spark, sf_dir):
    return purity.purity_loss(purity.purity(fx.pixels(spark, sf_dir), "cod_l2", fx.FEATURES), "cod_l2")


# accuracy

LEVELS = [1, 2, 3, 4, 5]


def _accuracy_sql(where: str = "true", truth: str = fx.TRUTH, levels: list[int] = LEVELS) -> str:
    return f"""{truth}, lv(k) AS (VALUES {", ".join(f"({k})" for k in levels)}),
m AS (SELECT a.k AS p, b.k AS t, (SELECT count(*) FROM truth WHERE truth.p = a.k AND truth.t = b.k AND {where}) AS n FROM lv a, lv b),
s AS (SELECT CAST(sum(n) AS DOUBLE) AS big FROM m),
k AS (SELECT k AS class, CAST((SELECT sum(n) FROM m WHERE t = k) AS BIGINT) AS n_true, CAST((SELECT sum(n) FROM m WHERE p = k) AS BIGINT) AS n_pred, CAST((SELECT sum(n) FROM m WHERE p = k AND t = k) AS BIGINT) AS tp FROM lv),
q AS (SELECT *, tp / greatest(n_pred, 1) AS ua, tp / greatest(n_true, 1) AS pa, (big - n_true - n_pred + tp) / greatest(big - n_true, 1) AS spec FROM k, s),
g AS (SELECT CAST(max(big) AS BIGINT) AS n, sum(tp) / max(big) AS po, sum(CAST(n_pred AS DOUBLE) * n_true / (big * big)) AS pe, avg((pa + spec) / 2) AS ba, sum(n_true / big * ua) AS wa, avg(pa + spec - 1) AS tss,
  exp(avg(ln(pa)) FILTER (WHERE n_true > 0)) AS gm FROM q)"""


GLOBAL = "n, round(100 * po, 2) AS oa, round(100 * ba, 2) AS ba, round(100 * wa, 2) AS wa, round(tss, 4) AS tss, round(gm, 4) AS gmean, round((po - pe) / (1 - pe), 4) AS kappa"


def _matrix(spark, sf_dir, where: str = "true"):
    return metrics.confusion(fx.truth_pred(spark, sf_dir).where(where), "pred", "true", LEVELS)


@query(f"WITH {_accuracy_sql()} SELECT p AS pred, t AS true, n FROM m".replace("t AS true", 't AS "true"'))
def a9_confusion(spark, sf_dir):
    return _matrix(spark, sf_dir)


@query(
    f"WITH {_accuracy_sql()} SELECT class, n_true, n_pred, round(100 * pa, 2) AS pa, round(100 * ua, 2) AS ua, round(100 * spec, 2) AS spec, round(100 * coalesce(2 * ua * pa / nullif(ua + pa, 0), 0), 2) AS f1, round(100 * (pa + spec) / 2, 2) AS ba, round(pa + spec - 1, 4) AS tss FROM q"
)
def v_class_metrics(spark, sf_dir):
    return metrics.class_metrics(_matrix(spark, sf_dir))


@query(f"WITH {_accuracy_sql()} SELECT {GLOBAL} FROM g")
def v_global_metrics(spark, sf_dir):
    return metrics.global_metrics(_matrix(spark, sf_dir))


@query(
    f"WITH {fx.TRUTH}, agg(a, b) AS (VALUES (1, 1), (2, 1), (3, 3), (4, 4), (5, 4)) SELECT x.b AS pred, y.b AS \"true\", count(*) AS n FROM truth JOIN agg x ON x.a = p JOIN agg y ON y.a = t GROUP BY ALL"
)
def v11_aggregated_eval(spark, sf_dir):
    table = {1: 1, 2: 1, 3: 3, 4: 4, 5: 4}
    merged = fx.truth_pred(spark, sf_dir).select(*[legend.aggregate_classes(F.col(c), table).alias(c) for c in ("pred", "true")])
    return metrics.confusion(merged, "pred", "true", [1, 3, 4]).where("n > 0")


MERGED = sorted(set(legend.AGGREGATED.values()))
MERGED_SQL = f"{fx.TRUTH_18}, agg(a, b) AS (VALUES {', '.join(f'({a}, {b})' for a, b in legend.AGGREGATED.items())}), truth AS (SELECT x.b AS p, y.b AS t FROM truth_18 JOIN agg x ON x.a = truth_18.p JOIN agg y ON y.a = truth_18.t)"
CLASS_METRICS = "class, n_true, n_pred, round(100 * pa, 2) AS pa, round(100 * ua, 2) AS ua, round(100 * spec, 2) AS spec, round(100 * coalesce(2 * ua * pa / nullif(ua + pa, 0), 0), 2) AS f1, round(100 * (pa + spec) / 2, 2) AS ba, round(pa + spec - 1, 4) AS tss"


@query(f"WITH {_accuracy_sql(truth=MERGED_SQL, levels=MERGED)} SELECT {CLASS_METRICS} FROM q")
def v11_aggregated_classes(spark, sf_dir):
    """Per class, after the level-2 classes are merged from 18 to 15."""
    merged = fx.truth_pred_18(spark, sf_dir).select(*[legend.aggregate_classes(F.col(c)).alias(c) for c in ("pred", "true")])
    return metrics.class_metrics(metrics.confusion(merged, "pred", "true", MERGED))


@query(f"WITH {_accuracy_sql(truth=fx.TRUTH_18.replace('truth_18 AS', 'truth AS'), levels=sorted(legend.AGGREGATED))} SELECT {GLOBAL} FROM g")
def v11_level_2(spark, sf_dir):
    """Of all 18 level-2 classes."""
    return metrics.global_metrics(metrics.confusion(fx.truth_pred_18(spark, sf_dir), "pred", "true", sorted(legend.AGGREGATED)))


@query(
    f"""SELECT 'internal' AS setting, oa, ba, wa, kappa FROM (WITH {_accuracy_sql("id % 2 = 0")} SELECT {GLOBAL} FROM g)
UNION ALL SELECT 'transfer', oa, ba, wa, kappa FROM (WITH {_accuracy_sql("id % 2 = 1")} SELECT {GLOBAL} FROM g)"""
)
def v12_comparison(spark, sf_dir):
    return metrics.comparison(*[metrics.global_metrics(_matrix(spark, sf_dir, f"id % 2 = {k}")) for k in (0, 1)])


@query(
    f"WITH {fx.TRUTH}, f AS (SELECT fold, avg(CASE WHEN p = t THEN 100.0::DOUBLE ELSE 0 END) AS oa FROM truth GROUP BY fold) SELECT round(avg(oa), 6) AS mean, round(stddev_samp(oa), 6) AS sd, round(avg(oa) - 2.776445 * stddev_samp(oa) / sqrt(5), 6) AS band_low, round(avg(oa) + 2.776445 * stddev_samp(oa) / sqrt(5), 6) AS band_high FROM f"
)
def a16_fold_band(spark, sf_dir):
    per_fold = fx.truth_pred(spark, sf_dir).groupBy("fold").agg((F.avg((F.col("pred") == F.col("true")).cast("double")) * 100).alias("oa"))
    return metrics.fold_band(per_fold, "oa").select(*[F.round(c, 6).alias(c) for c in ("mean", "sd", "band_low", "band_high")])


# separability and selection


@query(
    f"""WITH {fx.PIXELS}, k AS (SELECT cod_l2 AS class, count(*) AS n, avg(f0) AS m0, avg(f1) AS m1, var_samp(f0) AS a, covar_samp(f0, f1) AS b, var_samp(f1) AS d FROM pixels GROUP BY cod_l2),
p AS (SELECT x.class AS class_a, y.class AS class_b, x.n AS n_a, y.n AS n_b, x.m0 - y.m0 AS g0, x.m1 - y.m1 AS g1, (x.a + y.a) / 2 AS a, (x.b + y.b) / 2 AS b, (x.d + y.d) / 2 AS d, x.a * x.d - x.b * x.b AS dx, y.a * y.d - y.b * y.b AS dy FROM k x JOIN k y ON x.class < y.class),
e AS (SELECT *, (d * g0 * g0 - 2 * b * g0 * g1 + a * g1 * g1) / (a * d - b * b) / 8 + (ln(a * d - b * b) - (ln(dx) + ln(dy)) / 2) / 2 AS bh FROM p)
SELECT class_a, class_b, n_a, n_b, round(least(greatest(2 * (1 - exp(-bh)), 0), 2), 4) AS jm, least(n_a, n_b) < 3 AS few FROM e"""
)
def m1_jm_pairs(spark, sf_dir):
    return separability.jm_pairs(fx.pixels(spark, sf_dir), "cod_l2", ["f0", "f1"])


N_F = len(fx.FEATURES)
#: Every class matrix and every pooled one, bordered by the gap of means, is reduced column by column: the pivots give
#: the logarithms of determinants, the corner left over the squared distance.
JM_SQL = f"""{fx.PIXELS}, x AS (SELECT cod_l2 AS class, [{', '.join(fx.FEATURES)}] AS f FROM pixels),
ij AS (SELECT i, j FROM range(1, {N_F + 1}) a(i), range(1, {N_F + 1}) b(j)),
cov AS (SELECT class, i, j, covar_samp(f[i], f[j]) AS v FROM x, ij GROUP BY class, i, j),
mean AS (SELECT class, i, avg(f[i]) AS m FROM x, range(1, {N_F + 1}) a(i) GROUP BY class, i),
k AS (SELECT class, count(*) AS n FROM x GROUP BY class),
pairs AS (SELECT a.class AS ca, b.class AS cb FROM k a JOIN k b ON a.class <= b.class),
gap AS (SELECT ca, cb, a.i, a.m - b.m AS v FROM pairs JOIN mean a ON a.class = ca JOIN mean b ON b.class = cb AND b.i = a.i),
whole AS (SELECT ca, cb, a.i, a.j, (a.v + b.v) / 2 AS v FROM pairs JOIN cov a ON a.class = ca JOIN cov b ON b.class = cb AND b.i = a.i AND b.j = a.j
  UNION ALL SELECT ca, cb, i, {N_F + 1}, v FROM gap UNION ALL SELECT ca, cb, {N_F + 1}, i, v FROM gap UNION ALL SELECT ca, cb, {N_F + 1}, {N_F + 1}, 0.0 FROM pairs),
steps(k, ca, cb, i, j, v) AS (SELECT 0, ca, cb, i, j, v FROM whole UNION ALL
  SELECT e.k + 1, e.ca, e.cb, e.i, e.j, e.v - r.v * c.v / p.v FROM steps e JOIN steps p ON p.ca = e.ca AND p.cb = e.cb AND p.i = e.k + 1 AND p.j = e.k + 1
  JOIN steps r ON r.ca = e.ca AND r.cb = e.cb AND r.i = e.i AND r.j = e.k + 1 JOIN steps c ON c.ca = e.ca AND c.cb = e.cb AND c.i = e.k + 1 AND c.j = e.j
  WHERE e.i > e.k + 1 AND e.j > e.k + 1 AND e.k < {N_F}),
logs AS (SELECT ca, cb, sum(ln(v)) AS log_det FROM steps WHERE i = k + 1 AND j = k + 1 AND k < {N_F} GROUP BY ca, cb),
far AS (SELECT ca, cb, -v AS q FROM steps WHERE k = {N_F}),
jm AS (SELECT far.ca AS class_a, far.cb AS class_b, x.n AS n_a, y.n AS n_b,
  round(least(greatest(2 * (1 - exp(-(q / 8 + (p.log_det - (a.log_det + b.log_det) / 2) / 2))), 0), 2), 4) AS jm, least(x.n, y.n) < {N_F + 1} AS few
  FROM far JOIN logs p ON p.ca = far.ca AND p.cb = far.cb JOIN logs a ON a.ca = far.ca AND a.cb = far.ca JOIN logs b ON b.ca = far.cb AND b.cb = far.cb
  JOIN k x ON x.class = far.ca JOIN k y ON y.class = far.cb WHERE far.ca < far.cb)"""
CODES = [10 * (k // 2 + 1) + k % 2 + 1 for k in range(10)]


@query(
    f"WITH RECURSIVE {JM_SQL}, sides AS (SELECT class_a AS class, class_b AS other, jm FROM jm UNION ALL SELECT class_b, class_a, jm FROM jm) SELECT class, "
    + ", ".join(f'max(CASE WHEN other = {c} THEN jm END) AS "{c}"' for c in CODES)
    + " FROM sides GROUP BY class"
)
def m2_jm_matrix(spark, sf_dir):
    return separability.jm_matrix(separability.jm_pairs(fx.pixels(spark, sf_dir), "cod_l2", fx.FEATURES))


@query(f"WITH RECURSIVE {JM_SQL} SELECT * FROM jm ORDER BY jm, class_a, class_b LIMIT 10")
def o2_least_separable(spark, sf_dir):
    return separability.jm_pairs(fx.pixels(spark, sf_dir), "cod_l2", fx.FEATURES).orderBy("jm", "class_a", "class_b").limit(10)


LONG = "long AS (" + " UNION ALL ".join(f"SELECT '{f}' AS predictor, {f} AS value, cod_l1 AS class FROM pixels" for f in fx.FEATURES[:4]) + ")"


@query(
    f"""WITH {fx.PIXELS}, {LONG}, u AS (SELECT a.predictor, a.class, count(DISTINCT a.class) AS one, sum(CASE WHEN a.value > b.value THEN 1.0::DOUBLE WHEN a.value = b.value THEN 0.5 ELSE 0 END) AS u, count(*) AS n FROM long a JOIN long b ON a.predictor = b.predictor AND a.class <> b.class GROUP BY a.predictor, a.class),
k AS (SELECT predictor, class, greatest(u / n, 1 - u / n) AS auc FROM u) SELECT predictor, round(max(auc), 6) AS auc FROM k GROUP BY predictor"""
)
def m4_auc(spark, sf_dir):
    return selection.best_auc(fx.pixels(spark, sf_dir), "cod_l1", fx.FEATURES[:4]).withColumn("auc", F.round("auc", 6))


@query(
    f"""WITH {fx.PIXELS}, s AS (SELECT * FROM pixels ORDER BY md5('50|' || id), id LIMIT 300),
g AS (SELECT sign(a.f0 - b.f0) AS s0, sign(a.f1 - b.f1) AS s1, sign(a.f2 - b.f2) AS s2 FROM s a, s b),
t AS (SELECT """
    + ", ".join(f"sum(s{i} * s{j}) AS t{i}{j}" for i in range(3) for j in range(3))
    + " FROM g) "
    + " UNION ALL ".join(f"SELECT 'f{i}' AS a, 'f{j}' AS b, round(t{i}{j} / sqrt(CAST(t{i}{i} AS DOUBLE) * t{j}{j}), 6) AS tau FROM t" for i in range(3) for j in range(3))
)
def m6_kendall(spark, sf_dir):
    return selection.kendall(fx.pixels(spark, sf_dir), ["f0", "f1", "f2"], "id", most=300).withColumn("tau", F.round("tau", 6))


ALL_LONG = "long AS (" + " UNION ALL ".join(f"SELECT '{f}' AS predictor, {f} AS value, cod_l1 AS class FROM pixels" for f in fx.FEATURES) + ")"


@query(
    f"""WITH {fx.PIXELS}, {ALL_LONG}, k AS (SELECT predictor, class, value, (rank() OVER w + rank() OVER w + count(*) OVER (PARTITION BY predictor, value) - 1) / 2 AS mid, count(*) OVER (PARTITION BY predictor) AS n FROM long WINDOW w AS (PARTITION BY predictor ORDER BY value)),
u AS (SELECT predictor, class, (sum(mid) - count(*) * (count(*) + 1) / 2) / (count(*) * (any_value(n) - count(*))) AS a FROM k GROUP BY predictor, class)
SELECT predictor, round(max(greatest(a, 1 - a)), 9) AS auc FROM u GROUP BY predictor"""
)
def m4_auc_whole(spark, sf_dir):
    """As m4_auc, of all predictors."""
    return selection.best_auc(fx.pixels(spark, sf_dir), "cod_l1", fx.FEATURES).withColumn("auc", F.round("auc", 9))


def _tau_sql(columns: dict[str, str]) -> str:
    """tau of every ordered pair of columns over the 3,000 rows of the smallest digests, all row pairs compared."""
    names = list(columns)
    shown = ", ".join(f"{e} AS {c}" for c, e in columns.items())
    terms = ", ".join(f"sum(sign(a.{x} - b.{x}) * sign(a.{y} - b.{y})) AS t_{x}_{y}" for i, x in enumerate(names) for y in names[i:])
    each = " UNION ALL ".join(
        f"SELECT '{x}' AS a, '{y}' AS b, coalesce(t_{min(x, y, key=names.index)}_{max(x, y, key=names.index)} / nullif(sqrt(CAST(t_{x}_{x} AS DOUBLE) * t_{y}_{y}), 0), 0) AS tau FROM sums" for x in names for y in names
    )
    return f"{fx.PIXELS}, s AS (SELECT {shown} FROM pixels ORDER BY md5('50|' || id), id LIMIT 3000), sums AS (SELECT {terms} FROM s a, s b), tau AS ({each})"


@query(f"WITH {_tau_sql({f: f for f in fx.FEATURES})} SELECT a, b, round(tau, 12) AS tau FROM tau")
def m6_kendall_whole(spark, sf_dir):
    """As m6_kendall, of all predictors and on as many rows as the function takes."""
    return selection.kendall(fx.pixels(spark, sf_dir), fx.FEATURES, "id").withColumn("tau", F.round("tau", 12))


#: States the pruning where no two pairs above the cutoff share a predictor, as here.
@query(
    f"""WITH {_tau_sql({f: f for f in fx.FEATURES} | {"g0": "f0 * 2 + 1"})}, m AS (SELECT a, sum(abs(tau)) FILTER (WHERE a <> b) AS total FROM tau GROUP BY a)
SELECT m.a AS predictor FROM m WHERE NOT EXISTS (SELECT 1 FROM tau JOIN m o ON o.a = tau.b WHERE tau.a = m.a AND tau.b <> m.a AND abs(tau) > 0.90 AND (round(m.total, 9) > round(o.total, 9) OR (round(m.total, 9) = round(o.total, 9) AND m.a > o.a)))"""
)
def m7_prune(spark, sf_dir):
    names = [*fx.FEATURES, "g0"]
    df = fx.pixels(spark, sf_dir).withColumn("g0", F.col("f0") * 2 + 1)
    kept = selection.prune(selection.kendall(df, names, "id"), names)
    return spark.createDataFrame([(p,) for p in kept], "predictor string")


@query()
def m5_boruta(spark, sf_dir):
    state = selection.boruta(fx.pixels(spark, sf_dir), "cod_l1", fx.FEATURES, "id")
    return spark.createDataFrame(sorted(state.items()), "predictor string, decision string")


# forests


def _settings(spark, sf_dir):
    return fx.pixels(spark, sf_dir), dict(mtry=3, node=5)


@query()
def m12_forest_out_of_fold(spark, sf_dir):
    df, settings = _settings(spark, sf_dir)
    return forest.out_of_fold(df, "cod_l1", fx.FEATURES, "id", **settings)


@query()
def m11_tuning(spark, sf_dir):
    return forest.best_setting(forest.tune(fx.pixels(spark, sf_dir), "cod_l1", fx.FEATURES, "id", share=0.3))


@query()
def m15_importance(spark, sf_dir):
    df, settings = _settings(spark, sf_dir)
    return forest.forest_importance(df, "cod_l1", fx.FEATURES, "id", settings["mtry"])


@query()
def m16_cascade(spark, sf_dir):
    df, settings = _settings(spark, sf_dir)
    found = forest.cascade_by_parts(df.select("id", *fx.FEATURES), df, ("cod_l1", "cod_l2"), fx.FEATURES, "id", macrotypes=(1, 2, 4, 5), **settings)
    return found.select("id", "cod_l1", "cod_l2")


# applicability

TRAIN = "id % 5 <> 0"
WEIGHTS = [1.0, 0.5, 2.0, 0.0, 1.0, 1.5, 0.25, 1.0]
UNITS = "units AS (SELECT id, " + ", ".join(f"({f} - (SELECT avg({f}) FROM pixels WHERE {TRAIN})) * {w} / (SELECT stddev_samp({f}) FROM pixels WHERE {TRAIN}) AS {f}" for f, w in zip(fx.FEATURES, WEIGHTS, strict=True)) + " FROM pixels)"
APART = "sqrt(" + " + ".join(f"pow(a.{f} - b.{f}, 2)" for f in fx.FEATURES) + ")"
DI_SQL = f"""{fx.PIXELS}, {UNITS}, tr AS (SELECT * FROM units WHERE {TRAIN}),
d AS (SELECT a.id, min({APART}) AS nearest, sum({APART}) AS total, count(*) AS n FROM tr a JOIN tr b ON a.id <> b.id GROUP BY a.id),
md AS (SELECT sum(total) / sum(n) AS m FROM d), di AS (SELECT nearest / m AS di FROM d, md),
q AS (SELECT quantile_cont(di, 0.25) AS q1, quantile_cont(di, 0.75) AS q3 FROM di),
th AS (SELECT m, max(di) AS threshold FROM di, q, md WHERE di <= q3 + 1.5 * (q3 - q1) GROUP BY m)"""


def _space(spark, sf_dir):
    train = fx.pixels(spark, sf_dir).where(TRAIN)
    return applicability.fit_space(train, applicability.training_space(train, fx.FEATURES, WEIGHTS, "cod_l2", "id"))


@query(f"WITH {DI_SQL} SELECT round(m, 6) AS mean_distance, round(threshold, 6) AS threshold FROM th")
def m19_di_threshold(spark, sf_dir):
    s = _space(spark, sf_dir)
    return spark.createDataFrame([(round(float(s.mean_distance), 6), round(float(s.threshold), 6))], "mean_distance double, threshold double")


@query(f"WITH {DI_SQL} SELECT a.id, round(min({APART}) / any_value(m), 5) AS di, CASE WHEN min({APART}) / any_value(m) <= any_value(threshold) THEN 1 ELSE 0 END AS aoa FROM units a, tr b, th WHERE NOT (a.{TRAIN}) GROUP BY a.id")
def m20_aoa(spark, sf_dir):
    new = fx.pixels(spark, sf_dir).where(f"NOT ({TRAIN})")
    return applicability.dissimilarity(new, _space(spark, sf_dir)).select("id", F.round("di", 5).alias("di"), "aoa")


@query(
    f"WITH {DI_SQL}, j AS (SELECT a.id, min({APART}) / any_value(m) <= any_value(threshold) AS ok FROM units a, tr b, th WHERE NOT (a.{TRAIN}) GROUP BY a.id) SELECT count(*) FILTER (WHERE ok) AS n_inside, count(*) FILTER (WHERE NOT ok) AS n_outside, round(100.0::DOUBLE * count(*) FILTER (WHERE ok) / count(*), 2) AS pct_inside FROM j"
)
def a21_aoa_shares(spark, sf_dir):
    return applicability.shares(m20_aoa(spark, sf_dir))


# sinks


@query(f"WITH {fx.LEGEND} SELECT polygon_id, replace(CAST(CAST(round(area, 2) AS DECIMAL(12, 2)) AS VARCHAR), '.', ',') AS area FROM raw")
def s12_european_csv(spark, sf_dir):
    path = f"{files.scratch(spark)}/european"
    files.write_csv_european(fx.legend_raw(spark, sf_dir).select("polygon_id", F.round("area", 2).cast("decimal(12,2)").alias("area")), path)
    return files.read_csv(spark, path, "polygon_id long, area string", sep=";")


@query(f"WITH {fx.LEGEND} SELECT polygon_id, classe, area FROM raw")
def s11_csv_round_trip(spark, sf_dir):
    path = f"{files.scratch(spark)}/plain"
    files.write_csv(fx.legend_raw(spark, sf_dir).select("polygon_id", "classe", "area"), path)
    return files.read_csv(spark, path, "polygon_id long, classe int, area double")


@query(f'WITH {fx.GRID} SELECT r AS "row", c AS col, round_even(v / 100, 0) AS v FROM cells')
def s6_raster_round_trip(spark, sf_dir):
    path = f"{files.scratch(spark)}/raster"
    files.write_raster(fx.grid(spark, sf_dir).withColumn("v", F.rint(F.col("v") / 100)), path, {"v": "int"}, block_rows=64)
    return files.read_raster(spark, path).withColumn("v", F.col("v").cast("double"))



@query(f'WITH {fx.GRID} SELECT r AS "row", c AS col, v FROM cells WHERE r // 16 BETWEEN 2 AND 3')
def s8_block_rows(spark, sf_dir):
    path = f"{files.scratch(spark)}/blocks"
    files.write_raster(fx.grid(spark, sf_dir), path, {"v": "double"}, block_rows=16)
    return files.read_block(spark, path, 2, 3)


@query(f"WITH {fx.GRID}, {fx.RECTS} SELECT id, cls, CAST(5 AS INT) AS n_points, CAST(round(w * h, 6) AS DOUBLE) AS area FROM rects")
def s9_geopackage_round_trip(spark, sf_dir):
    """Rectangles written as GeoPackage parts by the tasks, read back file by file."""
    path = f"{files.scratch(spark)}/rects"
    shapes = fx.rects(spark, sf_dir, fx.spec_of(fx.grid(spark, sf_dir)).n_rows)
    vectors.write_geopackage(shapes.select("id", "cls", vectors.polygon_wkb("rings").alias("geom")), path, "rects")
    back = vectors.with_rings(vectors.read_geopackage(spark, path))
    return back.select(
        F.get_json_object("attributes", "$.id").cast("long").alias("id"), F.get_json_object("attributes", "$.cls").cast("int").alias("cls"), F.size(F.col("rings")[0]).alias("n_points"), F.round(spatial.ring_area(F.col("rings")), 6).alias("area")
    )


@query(f"WITH {fx.GRID} SELECT round(avg(v), 4) AS mean_value, round(max(v), 4) AS max_value FROM cells")
def s14_parameters(spark, sf_dir):
    path = f"{files.scratch(spark)}/parameters"
    stats = fx.grid(spark, sf_dir).agg(F.round(F.avg("v"), 4).alias("mean_value"), F.round(F.max("v"), 4).alias("max_value")).first()
    files.write_parameters(spark, stats.asDict(), path)
    return spark.createDataFrame([tuple(files.read_parameters(spark, path).values())], "mean_value double, max_value double")


@query(f'WITH {fx.GRID} SELECT r AS "row", c AS col, coalesce(CASE WHEN c % 2 = 0 THEN full_v END, v) AS v FROM cells')
def s15_prefer_filled(spark, sf_dir):
    filled = fx.full_grid(spark, sf_dir).where("col % 2 = 0")
    return grid.prefer_filled(fx.grid(spark, sf_dir), filled, "v")


# projections and perimeters

_PLACES = "places AS (SELECT c_custkey AS id, 6.0 + (c_custkey % 600) / 100 AS lon, 43.0 + (c_custkey % 379) / 100 AS lat FROM customer)"


def _series(kind: str, x: str, y: str, terms: tuple[float, ...]) -> str:
    outer, inner = ("cos", "sinh") if kind == "east" else ("sin", "cosh")
    return " + ".join(f"({a!r}) * {outer}({2 * j} * {x}) * {inner}({2 * j} * {y})" for j, a in enumerate(terms, 1))


@query(
    f"""WITH {_PLACES}, a AS (SELECT id, radians(lon - 9) AS away, sinh(atanh(sin(radians(lat))) - {projection.ECCENTRICITY!r} * atanh({projection.ECCENTRICITY!r} * sin(radians(lat)))) AS t FROM places),
b AS (SELECT id, atan2(t, cos(away)) AS xi, asinh(sin(away) / sqrt(t * t + cos(away) * cos(away))) AS eta FROM a)
SELECT id, round(500000 + {projection.RADIUS!r} * (eta + {_series("east", "xi", "eta", projection.FORWARD)}), 3) AS x, round({projection.RADIUS!r} * (xi + {_series("north", "xi", "eta", projection.FORWARD)}), 3) AS y FROM b"""
)
def g5_to_utm(spark, sf_dir):
    x, y = projection.transformed(F.col("lon"), F.col("lat"), 4326, 32632)
    return fx.places(spark, sf_dir).select("id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query(f"WITH {_PLACES} SELECT id, round(lon, 7) AS lon, round(lat, 7) AS lat FROM places")
def g5_utm_round_trip(spark, sf_dir):
    """There and back through the neighbouring zone gives the same place."""
    x, y = projection.transformed(F.col("lon"), F.col("lat"), 4326, 32632)
    there = fx.places(spark, sf_dir).select("id", x.alias("x"), y.alias("y"))
    x, y = projection.transformed(F.col("x"), F.col("y"), 32632, 32633)
    there = there.select("id", x.alias("x"), y.alias("y"))
    lon, lat = projection.transformed(F.col("x"), F.col("y"), 32633, 4326)
    return there.select("id", F.round(lon, 7).alias("lon"), F.round(lat, 7).alias("lat"))


@query(
    f"""WITH {fx.GRID}, {fx.RECTS}, e AS (SELECT min(x) - 300 AS w, min(y) - 300 AS s, max(x + w) + 300 AS e, max(y + h) + 300 AS n, any_value(n_rows) AS n_rows FROM rects, n),
k AS (SELECT greatest(0, ceil(0 - w)) AS west, greatest(0, ceil(0 - s)) AS south, greatest(0, ceil(e - 100)) AS east, greatest(0, ceil(n - n_rows)) AS north, n_rows FROM e)
SELECT CAST(0 - west AS DOUBLE) AS "left", CAST(n_rows + north AS DOUBLE) AS top, CAST(n_rows + north + south AS INT) AS n_rows, CAST(100 + east + west AS INT) AS n_cols FROM k"""
)
def g6_snapped_extent(spark, sf_dir):
    spec = fx.spec_of(fx.grid(spark, sf_dir))
    points = fx.rects(spark, sf_dir, spec.n_rows).select(F.explode(F.col("rings")[0]).alias("p")).select("p.x", "p.y")
    found = spec.snapped(*points.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first())
    return spark.createDataFrame([(found.left, found.top, found.n_rows, found.n_cols)], "left double, top double, n_rows int, n_cols int")


@query(f'WITH {fx.GRID}, {fx.RECTS} SELECT r AS "row", c AS col, v FROM cells WHERE (r, c) IN (SELECT (r, c) FROM covered)')
def g20_clip(spark, sf_dir):
    df = fx.grid(spark, sf_dir)
    spec = fx.spec_of(df)
    return spatial.clip(df, spatial.zonal_cells(fx.rects(spark, sf_dir, spec.n_rows), spec))


@query(f"WITH {fx.GRID}, {fx.RECTS} SELECT id, CAST(round(w * h, 6) AS DOUBLE) AS area, 5 AS n_points FROM rects WHERE id % 5 <> 0")
def g19_repaired(spark, sf_dir):
    """Rings left open, with repeated points, nulls, spikes and the wrong turn are mended; empty ones go."""
    spoilt = fx.spoilt_rects(spark, sf_dir, fx.spec_of(fx.grid(spark, sf_dir)).n_rows).withColumn("rings", spatial.repaired(F.col("rings")))
    whole = spoilt.where(spatial.valid_rings(F.col("rings")))
    return whole.select("id", F.round(spatial.ring_area(F.col("rings")), 6).alias("area"), F.size(F.col("rings")[0]).alias("n_points"))


@query(
    f"""WITH RECURSIVE {fx.GRID}, {fx.RECTS}, src AS (SELECT DISTINCT r, c FROM covered), five AS (SELECT * FROM (VALUES (0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)) x(dr, dc)),
on_cells AS (SELECT DISTINCT CAST(r + dr AS INT) AS r, CAST(c + dc AS INT) AS c, CAST(r + dr AS BIGINT) * 100 + c + dc AS id FROM src, five, n WHERE r + dr BETWEEN 0 AND n_rows - 1 AND c + dc BETWEEN 0 AND 99),
links AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM on_cells a JOIN on_cells b ON b.r = a.r AND b.c = a.c + 1 UNION ALL SELECT b.id, a.id FROM on_cells a JOIN on_cells b ON b.r = a.r AND b.c = a.c + 1 UNION ALL SELECT a.id, b.id FROM on_cells a JOIN on_cells b ON b.c = a.c AND b.r = a.r + 1 UNION ALL SELECT b.id, a.id FROM on_cells a JOIN on_cells b ON b.c = a.c AND b.r = a.r + 1),
reach(w, v) AS (SELECT id, id FROM on_cells WHERE id NOT IN (SELECT b FROM links WHERE a < b) UNION SELECT reach.w, links.b FROM reach JOIN links ON links.a = reach.v WHERE links.b > reach.w),
part AS (SELECT v, min(w) AS component FROM reach GROUP BY v), sized AS (SELECT component, count(*) * 1.0::DOUBLE AS area FROM part GROUP BY component HAVING count(*) >= 12)
SELECT r AS "row", c AS col, component, area FROM on_cells JOIN part ON v = id JOIN sized USING (component)"""
)
def g17_isolated_parts(spark, sf_dir):
    """Widened by half a cell, united, split into parts, small parts dropped."""
    spec = fx.spec_of(fx.grid(spark, sf_dir))
    return spatial.isolated_parts(fx.rects(spark, sf_dir, spec.n_rows), spec, 0.5, 12.0)


# columns, orders, names


@query(f'WITH {fx.GRID}, {fx.RECTS} SELECT covered.id, r AS "row", c AS col, rects.cls, CAST(rects.w AS DOUBLE) AS w FROM covered JOIN rects ON rects.id = covered.id')
def j2_polygon_attributes(spark, sf_dir):
    spec = fx.spec_of(fx.grid(spark, sf_dir))
    shapes = fx.rects(spark, sf_dir, spec.n_rows)
    attributes = shapes.select("id", "cls", (F.col("rings")[0][1]["x"] - F.col("rings")[0][0]["x"]).alias("w"))
    return legend.attach(spatial.zonal_cells(shapes, spec), attributes, "id")


@query(
    f"WITH {fx.LEGEND}, names(cod_l2, colour) AS (VALUES " + ", ".join(f"({v}, '{c}')" for v, c, _ in legend.table_rows(legend.LEVEL_2)) + ") SELECT polygon_id, colour FROM raw LEFT JOIN legend ON legend.classe = raw.classe LEFT JOIN names ON names.cod_l2 = legend.cod_l2"
)
def j3_lookup(spark, sf_dir):
    colours = legend.palette(spark).where("level = 2").select(F.col("value").alias("cod_l2"), "colour")
    coded = legend.attach(fx.legend_raw(spark, sf_dir), legend.legend(spark), "classe")
    return legend.attach(coded, colours, "cod_l2").select("polygon_id", "colour")


@query(f"WITH {fx.BANDS_SQL} SELECT b04 AS \"B04_MAM\", b08 AS \"B08_MAM\" FROM bands")
def p2_season_names(spark, sf_dir):
    """Two bands picked and named by season."""
    return fx.bands(spark, sf_dir).select("b04", "b08").withColumnsRenamed({b: f"{b.upper()}_MAM" for b in ("b04", "b08")})


@query(f"WITH {fx.LEGEND} SELECT polygon_id, classe, area FROM raw")
def p12_drop_stale(spark, sf_dir):
    """Columns of an earlier run go by name, whether they are there or not."""
    return fx.legend_raw(spark, sf_dir).withColumn("COD_L1", F.lit(1)).drop("description", "COD_L1", "COD_MASCHERA")


@query(f"WITH {fx.PIXELS}, m(model, k) AS (VALUES ('L1', NULL), ('L2_1', 1), ('L2_2', 2), ('L2_4', 4), ('L2_5', 5)) SELECT model, count(*) AS n FROM pixels JOIN m ON k IS NULL OR k = cod_l1 GROUP BY model")
def p14_model_rows(spark, sf_dir):
    """Rows of each model by its stored filter."""
    pixels = fx.pixels(spark, sf_dir)
    counted = pixels.agg(*[F.count_if(F.expr(m.rows)).alias(m.name) for m in selection.MODELS])
    each = F.explode(F.array(*[F.struct(F.lit(m.name).alias("model"), F.col(m.name).alias("n")) for m in selection.MODELS]))
    return counted.select(each.alias("m")).select("m.*").where("n > 0")


@query(f"WITH {fx.LEGEND} SELECT polygon_id, raw.classe FROM raw JOIN legend ON legend.classe = raw.classe WHERE cod_l2 = 41")
def p25_polygon_filter(spark, sf_dir):
    coded = legend.attach(fx.legend_raw(spark, sf_dir), legend.legend(spark), "classe")
    return coded.where("cod_l2 IS NOT NULL AND cod_l2 = 41").select("polygon_id", "classe")


@query(f"WITH {fx.LEGEND} SELECT string_agg(k, ',' ORDER BY c) AS codes FROM (SELECT DISTINCT cod_l2 AS c, CAST(cod_l2 AS VARCHAR) AS k FROM raw JOIN legend ON legend.classe = raw.classe)")
def o6_sorted_codes(spark, sf_dir):
    return fx.labelled(spark, sf_dir).agg(F.array_join(F.array_sort(F.collect_set("cod_l2")), ",").alias("codes"))


@query(f"WITH {fx.LEGEND} SELECT polygon_id, classe FROM raw ORDER BY classe, polygon_id LIMIT 5")
def o5_preview(spark, sf_dir):
    """The first five in the order of class codes."""
    return fx.legend_raw(spark, sf_dir).select("polygon_id", "classe").orderBy("classe", "polygon_id").limit(5)


@query(f"WITH {fx.LEGEND} SELECT classe, format('{{:,}}', 1000 * count(*)) AS shown FROM raw GROUP BY classe")
def f22_thousands(spark, sf_dir):
    return legend.frequency(fx.legend_raw(spark, sf_dir), "classe").select("classe", F.format_number(F.col("n") * 1000, 0).alias("shown"))


@query(f"WITH {fx.LEGEND} SELECT polygon_id AS id, row_number() OVER (ORDER BY description, polygon_id) AS polygon_no FROM raw")
def w1_polygon_ids(spark, sf_dir):
    raw = fx.legend_raw(spark, sf_dir).select(F.col("polygon_id").alias("id"), "description")
    return sampling.numbered(raw, ["description", "id"], "polygon_no").select("id", "polygon_no")


@query(f"WITH {fx.PIXELS}, r AS (SELECT *, row_number() OVER (PARTITION BY cod_l2 ORDER BY md5('50|' || id), id) AS rn, count(*) OVER (PARTITION BY cod_l2) AS n FROM pixels) SELECT id, cod_l2, CASE WHEN rn <= ceil(0.7::DOUBLE * n) THEN 'train' ELSE 'validation' END AS part FROM r")
def u2_bound_parts(spark, sf_dir):
    """Training and validation rows bound together again."""
    dealt = sampling.train_split(fx.pixels(spark, sf_dir).select("id", "cod_l2"), "cod_l2", "id")
    return dealt.where("part = 'train'").unionByName(dealt.where("part = 'validation'"))


@query(f'WITH {fx.PIXELS} SELECT CAST(id // 100 AS INT) AS "row", CAST(id % 100 AS INT) AS col, f5, f0, f2 FROM pixels')
def m18_model_stack(spark, sf_dir):
    """The predictors of one model, in the model's order."""
    df = fx.pixels(spark, sf_dir).withColumns({"row": F.expr("CAST(id DIV 100 AS INT)"), "col": F.expr("CAST(id % 100 AS INT)")})
    model = forest.final_model(df, "cod_l1", ["f5", "f0", "f2"], "id", mtry=1, node=5, trees=2)
    forest.check_available(df, {"L1": model})
    return forest.export_stack(df, model)


@query(f"WITH {fx.PIXELS} " + " UNION ALL ".join(f"SELECT '{f}' AS predictor, round(greatest(0, avg({f}) - 0.01), 6) AS weight FROM pixels" for f in fx.FEATURES[:6]) + " UNION ALL SELECT 'f6', 0.0 UNION ALL SELECT 'f7', 0.0")
def m21_stored_weights(spark, sf_dir):
    """Weights from stored importances: negative ones and those that the file does not name count 0."""
    path = f"{files.scratch(spark)}/importance"
    pixels = fx.pixels(spark, sf_dir)
    means = pixels.agg(*[(F.avg(f) - 0.01).alias(f) for f in fx.FEATURES[:6]])
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("predictor"), F.col(f).alias("importance")) for f in fx.FEATURES[:6]]))
    means.select(each.alias("s")).select("s.*").write.parquet(path)
    weights = applicability.importance_weights(pixels, fx.FEATURES, "cod_l1", "id", path)
    return spark.createDataFrame([(f, round(w, 6)) for f, w in zip(fx.FEATURES, weights, strict=True)], "predictor string, weight double")


@query(f'WITH {fx.PIXELS} SELECT id, f0 AS "GLCM_CON_MAM_v3", f1 AS "GLCM_HOM_MAM_v3", f2 AS "GLCM_ENT_MAM_v3" FROM pixels')
def g12_texture_names(spark, sf_dir):
    textures = fx.pixels(spark, sf_dir).select("id", F.col("f0").alias("con"), F.col("f1").alias("hom"), F.col("f2").alias("ent"))
    return neighbourhood.name_textures(textures, "MAM")


from pixelmill.plans import models, rasters  # noqa: E402, F401  register further queries
