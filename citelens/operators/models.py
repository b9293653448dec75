"""MLlib-backed operators: projections, clusters, topics, embeddings, citation-impact models."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import LDA, BisectingKMeans, KMeans
from pyspark.ml.feature import PCA, CountVectorizer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citelens.operators import linkage, skipgram
from citelens.operators.reports import relabelled_by_size
from citelens.operators.search import sampled
from citelens.sources.tables import stored


def principal_components(rows: DataFrame, vector: str = "embedding", share: float = 0.9, most: int = 50) -> DataFrame:
    """rows with ``components`` (array): as many principal components as hold the given share of variance."""
    v = rows.withColumn("_v", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    k = min(most, v.select(F.size(vector)).first()[0])
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(v)
    total, n = 0.0, 0
    for x in model.explainedVariance.toArray():
        total, n = total + float(x), n + 1
        if total >= share:
            break
    return model.transform(v).withColumn("components", F.slice(vector_to_array("_p"), 1, max(n, 2))).drop("_v", "_p")


def layout(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """(id, x, y): the first two principal components."""
    p = principal_components(rows, vector, 0.0)
    return p.select("id", F.col("components")[0].alias("x"), F.col("components")[1].alias("y"))


def clusters(rows: DataFrame, k: int, vector: str = "embedding", hierarchical: bool = False, seed: int = 0) -> DataFrame:
    v = rows.withColumn("features", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    kind = BisectingKMeans if hierarchical else KMeans
    return kind(k=k, seed=seed, predictionCol="comp").fit(v).transform(v).drop("features")


def tree_clusters(rows: DataFrame, k: int, vector: str = "embedding", key: tuple[str, ...] = ("id",)) -> DataFrame:
    """rows (key, which is unique) with comp: Ward's merge tree cut into k clusters, the largest 0; null for rows that take no part in the tree."""
    parts = linkage.cut_tree(*linkage.merge_tree(rows, key, vector), k)
    return rows.join(parts.select(*key, F.col("comp").cast("int").alias("comp")), list(key), "left")


def clusters_or_none(rows: DataFrame, k: int, vector: str = "embedding", exact: int = 5000, seed: int = 0, key: tuple[str, ...] = ("id",)) -> DataFrame:
    """rows with comp, the largest cluster 0: of Ward's merge tree up to ``exact`` rows, k-means beyond; 0 for all if there are at most k rows or no features."""
    n = rows.count()
    width = rows.agg(F.max(F.size(vector))).first()[0] or 0
    if n <= k or width <= 0:
        return rows.withColumn("comp", F.lit(0))
    if n <= exact:
        return tree_clusters(rows, k, vector, key)
    return relabelled_by_size(clusters(rows, k, vector, seed=seed)).withColumn("comp", F.col("comp").cast("int"))


def topics(documents: DataFrame, k: int = 20, words: int = 20, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """((id, mixture, main), (topic, terms)) of documents (id, tokens) by latent Dirichlet allocation.

    The documents are stored first, as every iteration reads them all.
    """
    documents = stored(documents.select("id", "tokens"))
    vectors = CountVectorizer(inputCol="tokens", outputCol="features", vocabSize=10_000).fit(documents)
    rows = vectors.transform(documents)
    model = LDA(k=k, seed=seed, maxIter=10).fit(rows)
    names = documents.sparkSession.createDataFrame(list(enumerate(vectors.vocabulary)), "i int, word string")  # at most vocabSize
    placed = model.describeTopics(words).select("topic", F.posexplode("termIndices").alias("place", "i")).join(F.broadcast(names), "i")
    described = placed.groupBy("topic").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]).alias("terms"))
    mix = model.transform(rows).select("id", vector_to_array("topicDistribution").alias("mixture"))
    return mix.withColumn("main", F.array_position("mixture", F.array_max("mixture")) - 1), described


def token_vectors(documents: DataFrame, dim: int = 128, window: int = 5, seed: int = 0, known: list[str] | None = None, least: int = 1) -> DataFrame:
    """(token, vector): skip-gram vectors of documents (tokens) or walks, trained in blocks of tokens; of ``known`` tokens only, in
    documents that hold ``least`` of them, where a (bounded) vocabulary is given."""
    return skipgram.vectors(documents, "tokens", dim, window, seed=seed, known=known, least=least)


def regression(rows: DataFrame, features: list[str], target: str, kind: str = "linear", seed: int = 0):
    """Fitted model on standardised features; kind: linear, ridge, lasso, forest or boosted."""
    data = VectorAssembler(inputCols=features, outputCol="features").transform(rows)
    makers = {
        "linear": lambda: LinearRegression(labelCol=target), "ridge": lambda: LinearRegression(labelCol=target, regParam=0.1, elasticNetParam=0.0), "lasso": lambda: LinearRegression(labelCol=target, regParam=0.1, elasticNetParam=1.0),
        "forest": lambda: RandomForestRegressor(labelCol=target, seed=seed), "boosted": lambda: GBTRegressor(labelCol=target, seed=seed, maxIter=10),
    }
    model = makers[kind]().fit(data)
    return model, model.transform(data)


def repeated_regression(train: DataFrame, validate: DataFrame, features: list[str], target: str, kind: str = "linear", runs: int = 5, share: float = 0.8, log_target: bool = True, least: float = 1e-3) -> tuple[DataFrame, DataFrame]:
    """((feature, coefficient), (run, part, rmse, r2)): fits on samples of the training rows with standardised features.

    Samples are by a hash of (run, id).  Coefficients are means over the runs, 0 where smaller than ``least``, largest first.
    """
    spark, scores, total = train.sparkSession, [], np.zeros(len(features))
    told = F.log1p(target) if log_target else F.col(target).cast("double")
    for run in range(runs):
        part = lambda rows: sampled(rows, share, run).withColumn(target, told).select("id", *features, target)  # noqa: B023, E731
        data = VectorAssembler(inputCols=features, outputCol="raw").transform(part(train))
        scaler = StandardScaler(withMean=True, withStd=True, inputCol="raw", outputCol="features").fit(data)
        penalty = {"linear": (0.0, 0.0), "ridge": (0.1, 0.0), "lasso": (0.1, 1.0)}[kind]
        model = LinearRegression(labelCol=target, regParam=penalty[0], elasticNetParam=penalty[1], standardization=False).fit(scaler.transform(data))
        total += model.coefficients.toArray()
        held = VectorAssembler(inputCols=features, outputCol="raw").transform(part(validate))
        for name, rows in (("train", data), ("validate", held)):
            q = quality(model.transform(scaler.transform(rows)), target).first()
            scores.append((run, name, q["rmse"], q["r2"]))
    mean = np.where(np.abs(total / runs) < least, 0.0, total / runs)
    order = np.argsort(-np.abs(mean), kind="stable")
    coefficients = spark.createDataFrame([(features[i], float(mean[i])) for i in order], "feature string, coefficient double")
    return coefficients, spark.createDataFrame(scores, "run int, part string, rmse double, r2 double")


def quality(predicted: DataFrame, target: str) -> DataFrame:
    """(rmse, r2) of predictions."""
    d = predicted.withColumn("_e", F.col(target) - F.col("prediction"))
    return d.agg(F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse"), (1 - F.sum(F.col("_e") * F.col("_e")) / F.nullif(F.var_pop(target) * F.count("*"), F.lit(0.0))).alias("r2"))


def top_share_label(rows: DataFrame, target: str, share: float = 0.02) -> DataFrame:
    bound = rows.agg(F.percentile(target, F.lit(1 - share)).alias("bound"))
    return rows.crossJoin(F.broadcast(bound)).withColumn("label", (F.col(target) >= F.col("bound")).cast("int")).drop("bound")


def above_top_share(rows: DataFrame, target: str, share: float = 0.02) -> DataFrame:
    """rows with label: 1 above the least value among the floor(share * rows) greatest, as a row at that value is no top."""
    n = int(share * rows.count())
    least = rows.select(target).orderBy(F.desc(target)).limit(max(n, 1)).agg(F.min(target).alias("least"))
    return rows.crossJoin(F.broadcast(least)).withColumn("label", (F.col(target) > F.col("least")).cast("int")).drop("least")


def balanced_classes(rows: DataFrame, how: str, seed: int = 27) -> DataFrame:
    """Rows (id, label) of both classes in about equal numbers: the larger one sampled ("down") or the smaller repeated ("up")."""
    counts = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    few = min(counts, key=lambda x: (counts[x], x))
    ratio = max(counts.values()) / max(counts[few], 1)
    if how == "down":
        return rows.filter(F.col("label") == few).unionByName(sampled(rows.filter(F.col("label") != few), 1 / ratio, seed))
    copies = F.explode(F.sequence(F.lit(1), F.lit(max(1, round(ratio)))))
    return rows.filter(F.col("label") != few).unionByName(rows.filter(F.col("label") == few).withColumn("_c", copies).drop("_c"))


def top_paper_classifier(train: DataFrame, validate: DataFrame, features: list[str], how: str = "down", weight: float = 1.0, trees: int = 100, depth: int = 7, seed: int = 0) -> DataFrame:
    """(tn, fp, fn, tp, recall, precision): a forest of balanced classes, class 1 weighing ``weight``, on the validation rows."""
    data = balanced_classes(train, how).withColumn("w", F.when(F.col("label") == 1, float(weight)).otherwise(1.0))
    table = lambda rows: VectorAssembler(inputCols=features, outputCol="raw").transform(rows)
    scaler = StandardScaler(withMean=True, withStd=True, inputCol="raw", outputCol="features").fit(table(data))
    forest = RandomForestClassifier(labelCol="label", weightCol="w", numTrees=trees, maxDepth=depth, seed=seed).fit(scaler.transform(table(data)))
    p = forest.transform(scaler.transform(table(validate)))
    count = lambda label, said: F.count_if((F.col("label") == label) & (F.col("prediction") == said))
    c = p.agg(count(0, 0).alias("tn"), count(0, 1).alias("fp"), count(1, 0).alias("fn"), count(1, 1).alias("tp"))
    rate = lambda x: F.coalesce(F.col("tp") / F.nullif(F.col("tp") + F.col(x), F.lit(0)), F.lit(0.0))
    return c.withColumn("recall", rate("fn")).withColumn("precision", rate("fp"))


def topic_hierarchy(rows: DataFrame, vector: str = "embedding", comp: str = "comp") -> DataFrame:
    """(comp, path): path of each given topic in a binary tree, "0" or "1" a level from the root, by Ward merges of the topics' centres.

    A topic weighs as many as its rows.  The merges, one fewer than the topics, travel as one array.
    """
    v = rows.withColumn("_v", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    centres = v.groupBy(comp).agg(F.count("*").alias("size"), vector_to_array(Summarizer.mean(F.col("_v"))).alias("centre"))
    leaves = linkage.numbered(centres, comp, name="leaf")
    tree = linkage.weighted_tree(leaves, leaves.count())
    steps = tree.agg(F.array_sort(F.collect_list(F.struct("node", "left", "right"))).alias("steps"))
    start = F.struct(F.col("leaf").cast("long").alias("at"), F.lit("").alias("path"))
    side = lambda s, m, c, mark: F.when(s["at"] == m[c], F.struct(m["node"].alias("at"), F.concat(F.lit(mark), s["path"]).alias("path")))
    climb = F.aggregate("steps", start, lambda s, m: F.coalesce(side(s, m, "left", "0"), side(s, m, "right", "1"), s))
    return leaves.crossJoin(F.broadcast(steps)).select(comp, climb["path"].alias("path"))


def topic_tree(rows: DataFrame, k: int, vector: str = "embedding", key: tuple[str, ...] = ("id",)) -> tuple[DataFrame, DataFrame]:
    """((left, right, node, height), (comp, path, place)): the merge tree of all rows contracted to its k clusters, and their ways to the root."""
    leaves, tree = linkage.merge_tree(rows, key, vector)
    parts = linkage.cut_tree(leaves, tree, k)
    merges = linkage.contracted(parts, tree)
    return merges, linkage.topic_paths(merges, parts)


def importances(rows: DataFrame, features: list[str], target: str, kind: str = "forest", seed: int = 0) -> DataFrame:
    """(feature, importance): of a forest or boosted model, or the size of a linear one's coefficients."""
    model, _ = regression(rows, features, target, kind, seed)
    values = model.featureImportances if kind in ("forest", "boosted") else model.coefficients
    return rows.sparkSession.createDataFrame([(f, float(abs(x))) for f, x in zip(features, values.toArray(), strict=True)], "feature string, importance double")


def node_vectors(walks: DataFrame, nodes: DataFrame, degrees: DataFrame, dim: int = 64, window: int = 5, seed: int = 0) -> DataFrame:
    """(id, vector): skip-gram vectors of walks; a node without edges has ones, one that no walk reached has zeros."""
    learned = token_vectors(walks.select(F.col("walk").alias("tokens")), dim, window, seed)
    joined = nodes.select("id").join(learned.withColumnRenamed("token", "id"), "id", "left").join(degrees.select(F.col("node").alias("id"), "degree"), "id", "left")
    alone = F.array_repeat(F.lit(1.0), dim)
    return joined.select("id", F.when(F.col("degree").isNull(), alone).otherwise(F.coalesce("vector", F.array_repeat(F.lit(0.0), dim))).alias("vector"))
