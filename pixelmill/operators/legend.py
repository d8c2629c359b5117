"""Legend, lookups, recodes and class summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Land-use class, land-cover class (level 2) and clean description.
CLASSES = """
111 61 Tessuto urbano continuo
112 61 Tessuto urbano discontinuo
121 61 Aree industriali e commerciali
122 61 Reti stradali e ferroviarie e spazi accessori
142 61 Aree sportive e ricreative
213 51 Risaie
221 53 Vigneti
222 53 Frutteti e frutti minori
224 44 Pioppeti
225 45 Altri impianti di arboricoltura da legno
226 52 Terreni non in coltivazione
332 22 Rocce nude
335 22 Aree interessate da processi erosionali e depositi diffusi
1311 71 Piazzali di cava
1312 12 Specchi d'acqua di cave attive
1313 12 Specchi d'acqua di cave non rinaturalizzate
1314 71 Spazi seminaturali all'interno di cave attive
1315 71 Aree interessate da scotico superficiale
1321 61 Discariche
1322 71 Aree degradate
1421 61 Aree con baracche
1422 61 Altre aree ricreative e sportive
2111 52 Orticoltura in pieno campo
2112 52 Seminativi in aree non irrigue
2113 52 Serre
2121 52 Seminativi in aree irrigue
2311 54 Prati stabili
3111 41 Saliceti arborei e formazioni arboree riparie
3112 41 Alneti e formazioni arboree igrofile delle lanche
3113 42 Formazioni arboree planiziali
3114 46 Boschi misti collinari
3115 43 Robinieti
3116 42 Filari arborei
3117 45 Imboschimenti a conifere
3212 31 Popolamenti alto-erbacei
3241 22 Formazioni erbaceo-arbustive xerofile stabili
3242 31 Saliceti arbustivi
3243 31 Formazioni arbustive di ricolonizzazione
3244 45 Imboschimenti
3246 31 Siepi
3311 21 Sabbie e ghiaioni
3312 21 Greto
4113 13 Formazioni erbaceo-arbustive a dominanza di igrofite (lanche)
4241 12 Lanche
4242 13 Formazioni erbaceo-arbustive a dominanza di igrofite
4243 13 Popolamenti vegetali acquatici
4244 13 Formazioni a elofite
5111 11 Alveo principale
5112 11 Bracci secondari
5113 11 Canali
5121 11 Canali e solchi erosionali
5122 12 Specchi d'acqua da cave rinaturalizzate
5123 12 Specchi d'acqua artificiali
"""
#: Class, colour and description of level 1, then of level 2.
LEVEL_1 = """
1 #1565c0 Acque e zone umide
2 #c9b896 Substrato fluviale
3 #b8d08a Vegetazione erbacea e arbustiva
4 #2e7d32 Copertura arborea
5 #f9a825 Superfici coltivate
6 #c62828 Superfici impermeabilizzate
7 #616161 Aree estrattive
"""
LEVEL_2 = """
11 #0d47a1 Acque interne
12 #1e88e5 Lanche e acque ferme fluviali
13 #26a69a Vegetazione igrofila erbacea
21 #d8c7a0 Greto e sabbie fluviali
22 #a9855a Formazioni pioniere su substrato fluviale
31 #b8d08a Vegetazione erbacea alta e arbustiva ripariale
41 #57a05b Boschi ripariali igrofili
42 #2e7d32 Boschi planiziali di latifoglie mesofite
43 #9e9d24 Robinieti
44 #00c853 Pioppeti
45 #6b8e23 Piantagioni arboree da legno
46 #0d3d14 Boschi misti collinari
51 #f5efa0 Risaie
52 #f9a825 Seminativi e colture erbacee annuali
53 #ef6c00 Colture arboree permanenti
54 #c4d62e Prati stabili
61 #c62828 Tessuto urbano e aree industriali
71 #616161 Aree estrattive e cave
"""
#: Level-2 classes merged for the coarse evaluation; a class that is not listed is an error.
AGGREGATED = {11: 11, 12: 12, 13: 12, 21: 20, 22: 20, 31: 31, 41: 41, 42: 42, 43: 43, 44: 40, 45: 40, 46: 46, 51: 51, 52: 52, 53: 53, 54: 54, 61: 61, 71: 71}
#: Macrotypes of one class only are assigned it directly.
DIRECT = {3: 31, 6: 61, 7: 71}
TRAINING = "Training"


def table_rows(block: str) -> list[list[str]]:
    return [line.split(" ", 2) for line in block.strip().splitlines()]


def legend(spark: SparkSession) -> DataFrame:
    """One row per land-use class: classe, desc_clean, cod_l1, desc_l1, cod_l2, desc_l2, tipo."""
    level_1 = {int(code): text for code, _, text in table_rows(LEVEL_1)}
    level_2 = {int(code): text for code, _, text in table_rows(LEVEL_2)}
    rows = [(int(c), text, int(l2) // 10, level_1[int(l2) // 10], int(l2), level_2[int(l2)], TRAINING) for c, l2, text in table_rows(CLASSES)]
    return spark.createDataFrame(rows, "classe int, desc_clean string, cod_l1 int, desc_l1 string, cod_l2 int, desc_l2 string, tipo string")


def palette(spark: SparkSession) -> DataFrame:
    """Value, colour and label of both levels."""
    rows = [(level, int(v), colour, f"{v} - {text}") for level, block in ((1, LEVEL_1), (2, LEVEL_2)) for v, colour, text in table_rows(block)]
    return spark.createDataFrame(rows, "level int, value int, colour string, label string")


def macrotype(cod_l2: str = "cod_l2") -> Column:
    """Level 1 from level 2."""
    return F.expr(f"CAST({cod_l2} DIV 10 AS INT)")


def attach(df: DataFrame, lookup: DataFrame, on: str) -> DataFrame:
    """Left join to a lookup of one row per key; the row count never changes.

    Spark broadcasts a lookup that it knows to be small, as the legend is, and shuffles a larger one.
    """
    return df.join(lookup, on, "left")


def missing_keys(df: DataFrame, lookup: DataFrame, on: str) -> DataFrame:
    """Distinct keys that the lookup does not hold: empty when the join is complete."""
    return df.select(on).distinct().join(lookup.select(on), on, "left_anti")


def reclassify(value: Column, table: Mapping[int, int]) -> Column:
    """Recode by a small table; values that are not listed become null."""
    recoded = F.lit(None).cast("int")
    for old, new in reversed(table.items()):
        recoded = F.when(value == old, new).otherwise(recoded)
    return recoded


def aggregate_classes(value: Column, table: Mapping[int, int] = AGGREGATED) -> Column:
    """As ``reclassify``, but an unknown class stops the query; null stays null."""
    known = reclassify(value, table)
    return F.when(value.isNull() | known.isNotNull(), known).otherwise(F.raise_error(F.concat(F.lit("class without a group: "), value.cast("string"))))


def frequency(df: DataFrame, value: str) -> DataFrame:
    """Cells per value, without nulls (A3)."""
    return df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"))


def class_summary(df: DataFrame, keys: list[str], area: str) -> DataFrame:
    """Polygons and area per class, rounded to two digits (A2)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_polygons"), F.round(F.sum(area), 2).alias("area_ha"))


def description_variants(df: DataFrame, key: str, description: str) -> DataFrame:
    """Distinct descriptions of each class."""
    return df.groupBy(key).agg(F.count_distinct(description).alias("n_variants"))


def codes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Text or factor labels as whole-number codes, in place; what is no number becomes null.

    A label may hold its code before a description, as in "12 - Shrubs".
    """
    return df.withColumns({c: F.regexp_extract(F.col(c).cast("string"), r"^\s*(-?[0-9]+)", 1).try_cast("int") for c in columns})


def by_code(df: DataFrame, code: str) -> DataFrame:
    """Rows in the order of their class code (O1)."""
    return df.orderBy(F.col(code).cast("int"))


def layer_name(path: Column, season: Column | str) -> Column:
    """The name of a layer from the path of its file: folders, ending and version gone, in capitals, with the season
    (F21), as in NDVI_MAM from /x/ndvi_v3.tif."""
    base = F.regexp_replace(F.substring_index(path, "/", -1), r"(?i)(_v[0-9]+)?\.[a-z0-9]+$", "")
    return F.concat_ws("_", F.upper(base), season if isinstance(season, Column) else F.lit(season))
