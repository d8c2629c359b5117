"""Random forests: tuning, out-of-fold validation, final model, importance, and the two-level cascade."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from math import exp, factorial, floor, sqrt

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelmill.functions.indices import complete
from pixelmill.operators.legend import DIRECT, reclassify
from pixelmill.operators.neighbourhood import unused
from pixelmill.operators.sampling import folds, stratified_fraction
from pixelmill.session import in_threads, work_table

MTRY_MOST = 34
#: Parts of a forest that are grown at once.
PARTS_AT_ONCE = 2
#: Training rows of a task; and rows times trees of a part of a forest whose nodes the driver holds at once.
ROWS_A_TASK, ROWS_A_PART = 25_000, 600_000


def forest(predictors: Sequence[str], target: str, mtry: int, node: int, trees: int = 200, seed: int = 50, depth: int = 20, weight: str | None = None) -> Pipeline:
    """Assembler and forest; the model keeps its predictor list in the assembler."""
    assembler = VectorAssembler(inputCols=list(predictors), outputCol="features", handleInvalid="keep")
    grower = RandomForestClassifier(
        labelCol=target, featuresCol="features", predictionCol="predicted", numTrees=trees, featureSubsetStrategy=str(mtry), minInstancesPerNode=node, maxDepth=depth, seed=seed, cacheNodeIds=True
    )
    return Pipeline(stages=[assembler, grower.setWeightCol(weight) if weight else grower])


def predictors_of(model: PipelineModel) -> list[str]:
    return model.stages[0].getInputCols()


def check_available(df: DataFrame, models: Mapping[str, PipelineModel]) -> None:
    """Stops if a model needs a column that the table does not have."""
    for name, model in models.items():
        if gone := [p for p in predictors_of(model) if p not in df.columns]:
            raise ValueError(f"model {name} misses {', '.join(gone)}")


def mtry_grid(p: int) -> list[int]:
    """Distinct candidates from half the root to a third of the predictors."""
    raw = (floor(sqrt(p) / 2), floor(sqrt(p)), round(p / 5), round(p / 3))
    return sorted({max(1, min(p, MTRY_MOST, m)) for m in raw})


def training_rows(df: DataFrame, target: str, predictors: Sequence[str], id_col: str, share: float, seed: int, weight: str | None = None) -> tuple[DataFrame, int]:
    """A stratified ``share`` of the rows, written, and how many they are.

    A task adds up dense statistics of all nodes that are being split, whatever the rows it holds, so rows are dealt to as few
    tasks as ``ROWS_A_TASK`` allows; by id and in its order, so that every run grows the same trees.
    """
    columns = dict.fromkeys([id_col, target, *predictors, *([weight] if weight else [])])
    chosen = work_table(stratified_fraction(df, target, id_col, share, seed).select(*columns), "training-rows")
    n = chosen.count()
    return chosen.repartition(max(1, -(-n // ROWS_A_TASK)), id_col).sortWithinPartitions(id_col), n


def parts_of(training: tuple[DataFrame, int], predictors: Sequence[str], target: str, mtry: int, node: int, trees: int, seed: int) -> tuple[VectorAssembler, list[RandomForestClassifier]]:
    """A forest in parts of as many trees as keep rows times trees under ``ROWS_A_PART``: the driver holds the nodes of the trees
    that it grows, together many times the rows, so where votes or importances are all that is wanted, it holds a part's."""
    assembler, grower = forest(predictors, target, mtry, node, trees, seed).getStages()
    trees, most = grower.getNumTrees(), max(1, ROWS_A_PART // max(1, training[1]))
    each = -(-trees // -(-trees // most))
    return assembler, [grower.copy({grower.numTrees: min(each, trees - first), grower.seed: seed + first}) for first in range(0, trees, each)]


def judged_by_parts(df: DataFrame, training: tuple[DataFrame, int], target: str, predictors: Sequence[str], mtry: int, node: int, name: str, trees: int = 200, seed: int = 50) -> DataFrame:
    """Adds ``name``: the class of complete rows, null for the others, by a forest whose trees are grown in parts.

    The votes of a part are added to those of the parts before and written, as Spark adds up those of one forest.
    """
    rows = training[0].persist()
    assembler, growers = parts_of(training, predictors, target, mtry, node, trees, seed)
    votes, judged = unused(df, "votes"), df
    for at in range(0, len(growers), PARTS_AT_ONCE):
        models = in_threads(lambda grower: grower.fit(assembler.transform(rows)), growers[at : at + PARTS_AT_ONCE], PARTS_AT_ONCE)
        scored, added = assembler.transform(judged), [votes] if at else []
        for i, model in enumerate(models):
            scored = model.copy({model.rawPredictionCol: f"raw_{i}", model.probabilityCol: "", model.predictionCol: ""}).transform(scored)
            added.append(vector_to_array(f"raw_{i}"))
        total = reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), added)
        judged = work_table(scored.select(*df.columns, total.alias(votes)), "votes")
    rows.unpersist()
    best = F.array_position(votes, F.array_max(votes)) - 1
    return judged.withColumn(name, F.when(complete(predictors), best.cast("int"))).drop(votes)


def rare_classes(df: DataFrame, target: str, k: int) -> DataFrame:
    """class, n and verdict of every class: stop (fewer rows than folds), warn (fewer than two a fold) or fine."""
    sizes = df.groupBy(F.col(target).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    return sizes.withColumn("verdict", F.when(F.col("n") < k, "stop").when(F.col("n") < 2 * k, "warn").otherwise("fine"))


def check_rare(df: DataFrame, target: str, k: int) -> list[int]:
    """Stops if a class has fewer rows than folds; returns the classes with fewer than two a fold."""
    judged = {r["class"]: r.verdict for r in rare_classes(df, target, k).where("verdict <> 'fine'").collect()}  # classes are few
    if few := [c for c, verdict in judged.items() if verdict == "stop"]:
        raise ValueError(f"classes {few} have fewer than {k} rows")
    return sorted(judged)


def drawn(id_col: str, bag: int, seed: int = 50) -> Column:
    """How often a row is drawn into a bootstrap sample: a Poisson number of mean one from a hash of sample and id, so the
    same on every run and machine."""
    u = F.pmod(F.xxhash64(F.lit(seed), F.lit(bag), F.col(id_col)), F.lit(1 << 52)) / (1 << 52)
    shares = np.cumsum([exp(-1) / factorial(k) for k in range(12)]).tolist()
    return sum((F.when(u >= s, 1).otherwise(0) for s in shares), F.lit(0))


def bagged_forests(df: DataFrame, target: str, predictors: Sequence[str], id_col: str, mtry: int, node: int, trees: int = 50, per_bag: int = 5, seed: int = 50) -> list[PipelineModel]:
    """A forest in parts of ``per_bag`` trees, each part grown on the rows that it has ``drawn``, weighted by how often; a
    few parts are grown at a time. Trees of a part share their rows and differ by the predictors they try."""
    assembler, grower = forest(predictors, target, mtry, node, trees, seed).getStages()

    def grown(bag: int) -> PipelineModel:
        sample = df.withColumn("bag_weight", drawn(id_col, bag, seed).cast("double")).where("bag_weight > 0")
        held = min(per_bag, trees - bag * per_bag)
        part = grower.copy({grower.numTrees: held, grower.bootstrap: False, grower.seed: seed + bag, grower.weightCol: "bag_weight"})
        return Pipeline(stages=[assembler, part]).fit(sample)

    with ThreadPoolExecutor(8) as pool:
        return list(pool.map(grown, range(-(-trees // per_bag))))


def out_of_bag(df: DataFrame, models: Sequence[PipelineModel], target: str, id_col: str, seed: int = 50) -> DataFrame:
    """id, true, predicted, n_votes of the rows that some part has not drawn: the class that most trees of those parts vote
    for, the smallest of equals (M10).

    All trees judge a row in one pass; votes are counted per row and class.
    """
    judged = models[0].stages[0].transform(df)
    votes = []
    for bag, model in enumerate(models):
        for i, tree in enumerate(model.stages[1].trees):
            name = f"vote_{bag}_{i}"
            judged = tree.copy({tree.predictionCol: name, tree.rawPredictionCol: "", tree.probabilityCol: ""}).transform(judged)
            votes.append(F.when(drawn(id_col, bag, seed) == 0, F.col(name)))
    cast = judged.select(id_col, F.col(target).cast("int").alias("true"), F.explode(F.array_compact(F.array(*votes))).alias("class")).withColumn("class", F.col("class").cast("int"))
    counted = cast.groupBy(id_col, "true", "class").agg(F.count(F.lit(1)).alias("n"))
    best = F.max_by("class", F.struct("n", -F.col("class")))
    return counted.groupBy(id_col, "true").agg(best.alias("predicted"), F.sum("n").alias("n_votes"))


def tune(df: DataFrame, target: str, predictors: Sequence[str], id_col: str, share: float = 0.03, nodes: Sequence[int] = (5, 10), trees: int = 50, seed: int = 50) -> DataFrame:
    """mtry, min_node_size, error of every setting: the out-of-bag error on a stratified fraction."""
    sample = work_table(stratified_fraction(df, target, id_col, share, seed), "tuning")
    rows = []
    for mtry in mtry_grid(len(predictors)):
        for node in nodes:
            judged = out_of_bag(sample, bagged_forests(sample, target, predictors, id_col, mtry, node, trees, seed=seed), target, id_col, seed)
            rows.append((mtry, node, judged.agg(F.avg((F.col("predicted") != F.col("true")).cast("double"))).first()[0]))
    return df.sparkSession.createDataFrame(rows, "mtry int, min_node_size int, error double")


def best_setting(tuning: DataFrame) -> DataFrame:
    """The setting of the smallest error, the first of equals (O3)."""
    return tuning.orderBy("error", "mtry", "min_node_size").limit(1)


def out_of_fold(df: DataFrame, target: str, predictors: Sequence[str], id_col: str, mtry: int, node: int, k: int = 5, trees: int = 200, share: float = 0.8, seed: int = 50) -> DataFrame:
    """fold, id, true and predicted: every row is judged once by a forest that never saw its fold.

    Each fold's forest is grown on a stratified ``share`` of the other folds, a few at a time.
    """
    dealt = work_table(folds(df, target, id_col, k, seed), "folds")
    grown = [training_rows(dealt.where(F.col("fold") != fold), target, predictors, id_col, share, seed + fold) for fold in range(1, k + 1)]

    def judged(fold: int) -> DataFrame:
        held = dealt.where(F.col("fold") == fold).select("fold", id_col, F.col(target).cast("int").alias("true"), *[p for p in predictors if p not in ("fold", id_col)])
        return judged_by_parts(held, grown[fold - 1], target, predictors, mtry, node, "predicted", trees, seed).select("fold", id_col, "true", "predicted")

    return reduce(DataFrame.unionByName, map(judged, range(1, k + 1)))


def fold_sizes(df: DataFrame, class_col: str) -> DataFrame:
    """Rows per fold and class."""
    return df.groupBy("fold", class_col).agg(F.count(F.lit(1)).alias("n"))


def final_model(df: DataFrame, target: str, predictors: Sequence[str], id_col: str, mtry: int, node: int, trees: int = 200, share: float = 0.8, seed: int = 50, weight: str | None = None) -> PipelineModel:
    """The forest on a stratified ``share`` of all rows."""
    return forest(predictors, target, mtry, node, trees, seed, weight=weight).fit(training_rows(df, target, predictors, id_col, share, seed, weight)[0])


def ranked_importance(spark: SparkSession, predictors: Sequence[str], values: Sequence[float]) -> DataFrame:
    rank = F.row_number().over(Window.orderBy(F.col("importance").desc(), "predictor"))  # one row per predictor
    return spark.createDataFrame([(p, float(v)) for p, v in zip(predictors, values, strict=True)], "predictor string, importance double").withColumn("rank", rank)


def importance(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """predictor, importance, rank."""
    return ranked_importance(spark, predictors_of(model), model.stages[1].featureImportances.toArray())


def forest_importance(df: DataFrame, target: str, predictors: Sequence[str], id_col: str, mtry: int, trees: int = 200, share: float = 0.8, seed: int = 50) -> DataFrame:
    """As ``importance``, of a forest of its own on a stratified ``share`` and with single-row leaves.

    The forest is grown in parts, of which the importances of each tree stay, added up as Spark does in one forest.
    """
    training = training_rows(df, target, predictors, id_col, share, seed)
    assembler, growers = parts_of(training, predictors, target, mtry, 1, trees, seed)
    rows = assembler.transform(training[0]).persist()

    def of_part(grower: RandomForestClassifier) -> np.ndarray:
        return sum(tree.featureImportances.toArray() for tree in grower.fit(rows).trees)

    total = sum(in_threads(of_part, growers, PARTS_AT_ONCE))
    rows.unpersist()
    return ranked_importance(df.sparkSession, predictors, total / (total.sum() or 1))


def predicted(df: DataFrame, model: PipelineModel, name: str) -> DataFrame:
    """Adds ``name``: the predicted class of complete rows, null for the others."""
    judged = model.transform(df)
    whole = complete(predictors_of(model))
    extra = [c for c in judged.columns if c not in df.columns]
    return judged.withColumn(name, F.when(whole, F.col("predicted").cast("int"))).drop(*[c for c in extra if c != name])


def cascade(df: DataFrame, level_1: PipelineModel, level_2: Mapping[int, PipelineModel], direct: Mapping[int, int] = DIRECT) -> DataFrame:
    """Adds cod_l1 and cod_l2.

    Level 1 is predicted on rows complete for its predictors. Macrotypes of one class get it directly; each
    other macrotype goes through its own model, on rows complete for that model; all else is null. Every row
    is scored by two forests at most, and no row is shuffled.
    """
    with_l1 = predicted(df, level_1, "cod_l1")
    rest = with_l1.where(F.col("cod_l1").isNull() | ~F.col("cod_l1").isin(*level_2)).withColumn("cod_l2", reclassify(F.col("cod_l1"), direct))
    parts = [predicted(with_l1.where(F.col("cod_l1") == k), model, "cod_l2") for k, model in level_2.items()]
    return reduce(DataFrame.unionByName, parts, rest)


def cascade_by_parts(df: DataFrame, training: DataFrame, targets: tuple[str, str], predictors: Sequence[str], id_col: str, mtry: int, node: int, macrotypes: Sequence[int], direct: Mapping[int, int] = DIRECT, trees: int = 200, share: float = 0.8, seed: int = 50) -> DataFrame:
    """As ``cascade`` by the final models of ``training``: level 1, and level 2 inside each of some macrotypes. No model is
    kept, so the driver holds parts of forests only."""
    upper, lower = targets
    samples = {k: training_rows(training.where(F.col(upper) == k), lower, predictors, id_col, share, seed) for k in macrotypes}
    settings = {"predictors": predictors, "mtry": mtry, "node": node, "trees": trees, "seed": seed}
    with_l1 = work_table(judged_by_parts(df, training_rows(training, upper, predictors, id_col, share, seed), upper, name="cod_l1", **settings), "level-1")
    rest = with_l1.where(F.col("cod_l1").isNull() | ~F.col("cod_l1").isin(*macrotypes)).withColumn("cod_l2", reclassify(F.col("cod_l1"), direct))
    parts = in_threads(lambda k: judged_by_parts(with_l1.where(F.col("cod_l1") == k), samples[k], lower, name="cod_l2", **settings), macrotypes, PARTS_AT_ONCE)
    return reduce(DataFrame.unionByName, parts, rest)


def export_stack(df: DataFrame, model: PipelineModel) -> DataFrame:
    """Cell and the predictors of one model in the model's order."""
    return df.select("row", "col", *predictors_of(model))
