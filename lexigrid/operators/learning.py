"""Folds, classifiers and regressors over document representations, and their scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, OneVsRest
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrid.functions import vectors as vx
from lexigrid.operators import counts
from lexigrid.operators.alignment import gram_matrices
from lexigrid.operators.doc_vectors import dimension_of
from lexigrid.operators.runtime import broadcast_if_small, by_number, settle

C_GRID = (1e-2, 1e-1, 1.0, 1e1, 1e2)
CENTERS_AT_ONCE = 5000


def exact_folds(labelled: DataFrame, folds: int, label: str = "label", order: str = "doc_id") -> DataFrame:
    """fold 0..folds-1 by each row's number in its class: fold sizes of a class differ by one row at most.

    Rows are numbered by ranges of class and order, so a class of any size is
    spread over tasks; a row's number in its class is that less its class's first.
    """
    rows = counts.dense_ids(labelled, [F.col(label).asc(), F.col(order).asc()], name="_row")
    first = rows.groupBy(F.col(label).alias("_class")).agg(F.min("_row").alias("_first"))
    fold = F.pmod(F.col("_row") - F.col("_first"), F.lit(folds)).cast("int")
    return rows.join(first, F.col(label).eqNullSafe(F.col("_class"))).select(*labelled.columns, fold.alias("fold"))


# scores


def accuracy(predicted: DataFrame, pred: str = "prediction", label: str = "label") -> Column | DataFrame:
    return predicted.agg((F.avg((F.col(pred) == F.col(label)).cast("double")) * 100.0).alias("accuracy"))


def f1(predicted: DataFrame, pred: str = "prediction", label: str = "label", positive=1) -> DataFrame:
    tp = F.count_if((F.col(pred) == positive) & (F.col(label) == positive))
    wrong = F.count_if((F.col(pred) == positive) != (F.col(label) == positive))
    return predicted.agg((100.0 * 2 * tp / (2 * tp + wrong)).alias("f1"))


def _mean_ranks(values: DataFrame, c: str) -> DataFrame:
    """c, rank: for each distinct value the mean rank of the n rows of each row of values (c, n). Ranges of values are summed apart."""
    counted = settle(values.groupBy(c).agg(F.sum("n").alias("n")).repartitionByRange(c).withColumn("_part", F.spark_partition_id()))
    base, total = {}, 0
    for r in sorted(counted.groupBy("_part").agg(F.sum("n").alias("n")).collect(), key=lambda r: r["_part"]):
        base[r["_part"]] = total
        total += r["n"]
    if not base:
        return counted.select(c, F.lit(0.0).alias("rank"))
    upto = F.sum("n").over(Window.partitionBy("_part").orderBy(c)) + by_number(base, F.col("_part"))
    return counted.select(c, (upto - (F.col("n") - 1) / 2.0).alias("rank"))


def correlations(frame: DataFrame, x: str, y: str) -> DataFrame:
    """One row: pearson and spearman, times 100. Ranks of ties are their mean.

    Distinct pairs are counted first, so no value's rows meet in one task; ranks go
    to all tasks where the distinct values are few, as labels are.
    """
    pairs = settle(frame.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).agg(F.count(F.lit(1)).alias("n")))
    ranked = pairs
    for c in ("x", "y"):
        ranks = settle(_mean_ranks(pairs, c).withColumnRenamed("rank", f"r{c}"))
        ranked = ranked.join(broadcast_if_small(ranks, c, 8), c)
    ranked = settle(ranked)
    mean = ranked.agg(*[(F.sum(F.col("n") * F.col(c)) / F.sum("n")).alias(f"m{c}") for c in ("x", "y", "rx", "ry")])  # one row

    def corr(a: str, b: str):
        da, db = F.col(a) - F.col(f"m{a}"), F.col(b) - F.col(f"m{b}")
        return F.sum(F.col("n") * da * db) / (F.sqrt(F.sum(F.col("n") * da * da)) * F.sqrt(F.sum(F.col("n") * db * db))) * 100

    return ranked.crossJoin(F.broadcast(mean)).agg(corr("x", "y").alias("pearson"), corr("rx", "ry").alias("spearman"))


# nearest centroid


def centroids(labelled: DataFrame, vec: str = "vec", label: str = "label") -> DataFrame:
    """label, centroid."""
    n = dimension_of(labelled, vec)
    return labelled.groupBy(label).agg(F.array(*[F.avg(F.element_at(vec, k + 1)) for k in range(n)]).cast("array<double>").alias("centroid"))


def nearest_centroid(frame: DataFrame, centers: DataFrame, key: str, vec: str = "vec", label: str = "label") -> DataFrame:
    """key, prediction: the label of the nearest centroid, the least label among equals.

    Each row looks for its own nearest in one broadcast array, without a shuffle.
    More than CENTERS_AT_ONCE centroids come as several arrays, in turns.
    """
    turns = max(1, -(-centers.count() // CENTERS_AT_ONCE))
    turn = F.pmod(F.xxhash64(label), F.lit(turns))
    own = frame.select(key, vx.doubles(F.col(vec)).alias("_v"))
    best = []
    for k in range(turns):
        stacked = centers.where(turn == k).agg(F.collect_list(F.struct(F.col(label).alias("l"), F.col("centroid").alias("c"))).alias(f"_c{k}"))
        own = own.crossJoin(F.broadcast(stacked))  # one row of at most about CENTERS_AT_ONCE centroids
        far = lambda c: F.aggregate(F.zip_with("_v", c["c"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x)
        best.append(F.array_min(F.transform(f"_c{k}", lambda c: F.struct(F.round(far(c), 9).alias("d"), c["l"].alias("l")))))
    return own.select(key, F.array_min(F.array(*best))["l"].alias("prediction"))


# ridge regression


def ridge(train: DataFrame, alphas=C_GRID, x: str = "features", y: str = "label", intercept: bool = True) -> tuple[np.ndarray, float, float]:
    """(coefficients, intercept, alpha): closed form from Gram matrices, alpha by the least squared leave-one-out error.

    What leaving a row out does follows from its place on the diagonal of the hat
    matrix, so one pass over the rows judges all alphas.
    """
    rows = settle(train.select(F.col(x).alias("source"), F.array(F.col(y).cast("double")).alias("target")))
    g = gram_matrices(rows)
    n, mean, shift = g["n"], np.zeros(len(g["sx"])), 0.0
    if intercept:
        mean, shift = g["sx"] / n, float(g["sy"][0] / n)
    xx, xy = g["xx"] - n * np.outer(mean, mean), g["xy"][:, 0] - n * mean * shift
    inverse = [np.linalg.inv(xx + a * np.eye(len(xx))) for a in alphas]

    @F.pandas_udf("array<double>")
    def left_out(v: pd.Series, t: pd.Series) -> pd.Series:
        if not len(v):
            return v
        own, target = np.stack(v.to_numpy()) - mean, np.stack(t.to_numpy())[:, 0] - shift
        out = []
        for m in inverse:
            hat = (own @ m * own).sum(axis=1) + (1.0 / n if intercept else 0.0)
            out.append(((target - own @ (m @ xy)) / np.maximum(1.0 - hat, 1e-12)) ** 2)
        return pd.Series(list(np.stack(out, axis=1)))

    scored = rows.select(left_out("source", "target").alias("e"))
    loss = scored.agg(*[F.sum(F.element_at("e", k + 1)).alias(f"e{k}") for k in range(len(alphas))]).first()
    best = min(range(len(alphas)), key=lambda k: loss[k])
    w = inverse[best] @ xy
    return w, shift - float(w @ mean), alphas[best]


def predict_linear(frame: DataFrame, w: np.ndarray, b: float, x: str = "features") -> DataFrame:
    @F.pandas_udf("double")
    def out(v: pd.Series) -> pd.Series:
        return pd.Series(np.stack(v.to_numpy()) @ w + b) if len(v) else pd.Series([], dtype=float)

    return frame.withColumn("prediction", out(F.col(x)))


# logistic regression


class Logistic:
    """L2 logistic regression, one class against the rest, its C by cross-validation on the training rows."""

    def __init__(self, grid=C_GRID, folds: int = 2, intercept: bool = False, max_iter: int = 100):
        self.grid, self.folds, self.intercept, self.max_iter = grid, folds, intercept, max_iter

    def _fit_one(self, train: DataFrame, c: float, n: int, classes: int):
        lr = LogisticRegression(featuresCol="_x", labelCol="_y", regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False, fitIntercept=self.intercept, maxIter=self.max_iter)
        return (OneVsRest(classifier=lr, featuresCol="_x", labelCol="_y") if classes > 2 else lr).fit(train)

    def fit(self, labelled: DataFrame, key: str = "doc_id", vec: str = "vec", label: str = "label") -> "Logistic":
        self.vec = vec
        self.index = StringIndexer(inputCol="_label", outputCol="_y", stringOrderType="alphabetAsc").fit(labelled.select(F.col(label).cast("string").alias("_label")))
        self.labels = self.index.labels
        rows = self.index.transform(exact_folds(labelled.select(F.col(key), F.col(label).cast("string").alias("_label"), array_to_vector(F.col(vec).cast("array<double>")).alias("_x")), self.folds, "_label", key))
        rows = settle(rows.select("_x", "_y", "fold"))
        n, classes = rows.count(), len(self.labels)
        if classes < 2:
            self.model = None
            return self
        score = {}
        for c in self.grid if len(self.grid) > 1 else ():
            hits = 0.0
            for k in range(self.folds):
                train, test = rows.where(F.col("fold") != k), rows.where(F.col("fold") == k)
                model = self._fit_one(train, c, max(1, train.count()), classes)
                hits += model.transform(test).agg(F.avg((F.col("prediction") == F.col("_y")).cast("double"))).first()[0] or 0.0
            score[c] = hits
        self.c = max(self.grid, key=lambda c: score.get(c, 0.0))
        self.model = self._fit_one(rows, self.c, n, classes)
        return self

    def transform(self, frame: DataFrame) -> DataFrame:
        names = F.array(*[F.lit(x) for x in self.labels])
        if self.model is None:
            return frame.withColumn("prediction", F.lit(self.labels[0] if self.labels else None))
        kept = frame.columns
        out = self.model.transform(frame.withColumn("_x", array_to_vector(F.col(self.vec).cast("array<double>"))))
        return out.select(*kept, F.element_at(names, F.col("prediction").cast("int") + 1).alias("prediction"))


class Centroid:
    """Nearest centroid with the same interface."""

    def fit(self, labelled: DataFrame, key: str = "doc_id", vec: str = "vec", label: str = "label") -> "Centroid":
        self.vec, self.key = vec, key
        self.centers = settle(centroids(labelled.select(F.col(vec).alias("vec"), F.col(label).cast("string").alias("label"))))
        return self

    def transform(self, frame: DataFrame) -> DataFrame:
        return frame.join(nearest_centroid(frame, self.centers, self.key, self.vec), self.key)


def sparse_regularised(train: DataFrame, valid: DataFrame, test: DataFrame, vec: str = "vec", label: str = "label", powers=range(-8, 1), l1: bool = True) -> dict:
    """Sweep C = 2^power on a validation set, refit on train and validation; score, c and the number of nonzero weights."""
    ready = lambda d: d.select(array_to_vector(F.col(vec).cast("array<double>")).alias("_x"), F.col(label).cast("double").alias("_y"))

    def fitted(rows, c):
        return LogisticRegression(featuresCol="_x", labelCol="_y", regParam=1.0 / (c * max(1, rows.count())), elasticNetParam=1.0 if l1 else 0.0, standardization=False).fit(rows)

    hit = lambda m, rows: m.transform(rows).agg(F.avg((F.col("prediction") == F.col("_y")).cast("double"))).first()[0]
    a, b, t = settle(ready(train)), settle(ready(valid)), ready(test)
    c = max((2.0**p for p in powers), key=lambda c: hit(fitted(a, c), b))
    model = fitted(a.unionByName(b), c)
    return {"score": hit(model, t) * 100.0, "c": c, "nonzero": int(np.count_nonzero(model.coefficients.toArray()))}


# the evaluation harness


def evaluate(kind: str, data: dict[str, DataFrame], representation, classifier=None, folds: int = 10) -> dict[str, float]:
    """Scores of a representation on a task.

    kind: 'split' (train, test: doc_id, text, label), 'folds' (all: doc_id, text,
    label), 'similarity' (train, test: doc_id, text1, text2, label; no training),
    'pair_regression' and 'pair_classes', 'pair_binary' (the same tables, labels
    numbers, classes, 0 or 1).
    """
    classifier = classifier or (lambda: Logistic(intercept=kind.startswith("pair")))
    if kind == "split":
        rep = representation.fit(data["train"])
        sets = {s: settle(rep.transform(data[s]).join(data[s].select("doc_id", F.col("label").cast("string").alias("label")), "doc_id")) for s in ("train", "test")}
        model = classifier().fit(sets["train"])
        return {s: accuracy(model.transform(sets[s])).first()[0] for s in ("train", "test")}
    if kind == "folds":
        every = data["all"]
        rows = settle(exact_folds(representation.fit(every).transform(every).join(every.select("doc_id", F.col("label").cast("string").alias("label")), "doc_id"), folds))
        out = {"train": 0.0, "test": 0.0}
        for k in range(folds):
            own = {"train": rows.where(F.col("fold") != k), "test": rows.where(F.col("fold") == k)}
            model = classifier().fit(own["train"])
            for s in own:
                out[s] += (accuracy(model.transform(own[s])).first()[0] or 0.0) / folds
        return out
    pairs = {}
    one = lambda d, c: d.select("doc_id", F.col(c).alias("text"))
    rep = representation.fit(one(data["train"], "text1").unionByName(one(data["train"], "text2")))
    for s in ("train", "test"):
        x, y = (rep.transform(one(data[s], c)).withColumnRenamed("vec", f"vec{c[-1]}") for c in ("text1", "text2"))
        pairs[s] = settle(data[s].select("doc_id", "label").join(x, "doc_id").join(y, "doc_id"))
    if kind == "similarity":
        every = pairs["train"].unionByName(pairs["test"]).select(vx.cosine(F.col("vec1"), F.col("vec2")).alias("score"), F.col("label").cast("double").alias("label"))
        return correlations(every, "score", "label").first().asDict()
    ready = {s: p.select("doc_id", "label", vx.pair_features(F.col("vec1"), F.col("vec2")).alias("vec")) for s, p in pairs.items()}
    if kind == "pair_regression":
        w, b, _ = ridge(ready["train"].withColumnRenamed("vec", "features"))
        scored = settle(predict_linear(ready["test"].withColumnRenamed("vec", "features"), w, b).select("prediction", F.col("label").cast("double").alias("label")))
        return correlations(scored, "prediction", "label").first().asDict()
    if kind in ("pair_classes", "pair_binary"):
        model = classifier().fit(ready["train"])
        test = settle(model.transform(ready["test"].withColumn("label", F.col("label").cast("string"))).select("prediction", "label"))
        if kind == "pair_binary":
            return {"accuracy": accuracy(test).first()[0], "f1": f1(test, positive="1").first()[0]}
        train = model.transform(ready["train"].withColumn("label", F.col("label").cast("string")))
        return {"train": accuracy(train).first()[0], "test": accuracy(test).first()[0]}
    raise NotImplementedError(kind)
