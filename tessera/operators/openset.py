"""Open-set recognition: eight scores (larger: more like a known class), AUROC, OSCR, closed-set metrics, domain gap.

Features are array columns; a label of -1 is unknown. Fitted scorers are small: class means, one covariance, one basis.
"""

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vector import argmax, clip_above, distance, doubles, energy, negative_entropy, normalise, softmax
from ..storage import materialise
from .blocks import block_products, matrix

UNKNOWN = -1
#: Rows that a broadcast of training vectors, or a block of a product of all with all, holds at most.
BLOCK_ROWS = 16_384


def logit_scores(rows: DataFrame, logits: str = "logits") -> DataFrame:
    """rows with msp, maxlogit, energy and entropy."""
    return rows.withColumns({"msp": F.array_max(softmax(logits)), "maxlogit": F.array_max(logits), "energy": energy(logits), "entropy": negative_entropy(logits)})


def _sums(batches):
    """Per label (column 0): count, sum and sum of outer products of the features (column 1)."""
    import pyarrow as pa

    held: dict = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        labels = np.asarray(batch.column(0).to_pylist())
        x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(labels), -1)
        for label in np.unique(labels).tolist():
            part = x[labels == label]
            n, s, m = held.get(label, (0, 0.0, 0.0))
            held[label] = n + len(part), s + part.sum(axis=0), m + part.T @ part
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([h[0] for h in held.values()], pa.int64()), pa.array([h[1].tolist() for h in held.values()]), pa.array([h[2].ravel().tolist() for h in held.values()])], names=["label", "n", "s", "m"])


def _moments(rows: DataFrame, label: str, features: str) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """Label -> (n, sum, sum of outer products): one row for each task and label reaches the driver."""
    held: dict = {}
    for r in rows.select(F.col(label).cast("bigint"), doubles(features)).mapInArrow(_sums, "label bigint, n bigint, s array<double>, m array<double>").toLocalIterator():
        s, d = np.array(r.s), len(r.s)
        n0, s0, m0 = held.get(r.label, (0, 0.0, 0.0))
        held[r.label] = n0 + r.n, s0 + s, m0 + np.array(r.m).reshape(d, d)
    return dict(sorted(held.items()))


def _scoring(rows: DataFrame, columns: list[str], names: list[str], kinds: list[str], f) -> DataFrame:
    """rows with columns made by f from numpy matrices of array columns, batch by batch."""
    schema = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in rows.schema) + "".join(f", {n} {k}" for n, k in zip(names, kinds))

    def run(batches):
        import pyarrow as pa

        types = {"double": pa.float64(), "int": pa.int32()}
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                given = [part.column(part.schema.get_field_index(c)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(part.num_rows, -1) for c in columns]
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(x, types[k]) for x, k in zip(f(*given), kinds))], names=[*part.schema.names, *names])

    return rows.mapInArrow(run, schema)


@dataclass
class Mahalanobis:
    """Distance to the nearest class mean under one shared covariance."""

    labels: list[int]
    means: np.ndarray
    precision: np.ndarray

    @classmethod
    def fit(cls, rows: DataFrame, label: str = "label", features: str = "features", regularization: float = 1e-6) -> "Mahalanobis":
        sums = _moments(rows, label, features)
        n = sum(x[0] for x in sums.values())
        means = np.stack([s / k for k, s, _ in sums.values()])
        within = sum(m - np.outer(s, s) / k for k, s, m in sums.values()) / (n - 1)
        return cls(list(sums), means, np.linalg.pinv(within + regularization * np.eye(len(within))))

    def score(self, rows: DataFrame, features: str = "features", name: str = "mahalanobis") -> DataFrame:
        """rows with the negated squared distance to the nearest mean, and nearest: that class's place."""

        def f(x, means=self.means, p=self.precision):
            # (x - m)' P (x - m), expanded: no row-by-class-by-dimension array is formed
            squared = np.einsum("nd,nd->n", x @ p, x)[:, None] - x @ (p + p.T) @ means.T + np.einsum("cd,cd->c", means @ p, means)
            return -squared.min(axis=1), squared.argmin(axis=1).astype(np.int32)

        return _scoring(rows, [features], [name, "nearest"], ["double", "int"], f)


@dataclass
class ViM:
    """Energy less the length of the feature's residual outside the principal subspace, scaled on training data."""

    mean: np.ndarray
    basis: np.ndarray
    alpha: float

    @classmethod
    def fit(cls, rows: DataFrame, principal: int, features: str = "features", logits: str = "logits") -> "ViM":
        (n, s, m), = _moments(rows.withColumn("__one", F.lit(0)), "__one", features).values()
        if not 1 <= principal < len(s):
            raise ValueError("principal must be at least 1 and below the dimension of the features")
        mean = s / n
        _, vectors = np.linalg.eigh(m / n - np.outer(mean, mean))
        basis = vectors[:, : len(s) - principal]
        lengths = _scoring(rows.select(features, logits), [features], ["residual"], ["double"], lambda x: (np.linalg.norm((x - mean) @ basis, axis=1),))
        top, residual = lengths.select(F.avg(F.array_max(logits)), F.avg("residual")).first()
        return cls(mean, basis, float(top / max(residual, 1e-12)))

    def score(self, rows: DataFrame, features: str = "features", logits: str = "logits", name: str = "vim") -> DataFrame:
        def f(x, mean=self.mean, basis=self.basis):
            return (np.linalg.norm((x - mean) @ basis, axis=1),)

        return _scoring(rows, [features], ["__residual"], ["double"], f).withColumn(name, energy(logits) - F.lit(self.alpha) * F.col("__residual")).drop("__residual")


def knn_score(rows: DataFrame, train: DataFrame, k: int = 5, features: str = "features", name: str = "knn") -> DataFrame:
    """rows with the negated mean distance to the k nearest training features, all of unit length.

    A training side of at most BLOCK_ROWS rows is broadcast. A larger one is met in blocks: each block gives a row its k
    nearest, and the k least of all blocks' are kept."""
    n = train.count()
    if not 1 <= k <= n:
        raise ValueError(f"{k} neighbours are asked of {n} training rows")
    unit = train.select(normalise(features).alias("f"))
    if n <= BLOCK_ROWS:
        held = rows.sparkSession.sparkContext.broadcast(np.array([r.f for r in unit.collect()]))  # at most BLOCK_ROWS rows

        def nearest(x):
            return (-_nearest(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12), held.value, k).sum(axis=1) / k,)

        return _scoring(rows, [features], [name], ["double"], nearest)

    # rows get numbers that a written table keeps, so that what blocks find for a row comes together again
    numbered = materialise(rows.withColumn("__n", F.monotonically_increasing_id()), "knn")

    def meet(asked, block):
        import pyarrow as pa

        found = _nearest(matrix(asked, "f"), matrix(block, "f"), k) if len(asked) and len(block) else np.zeros((len(asked), 0))
        return pa.table({"__n": asked.column("__n"), "near": pa.array(found.tolist(), pa.list_(pa.float64()))})

    parts = block_products(numbered.select("__n", normalise(features).alias("f")), unit, meet, "__n bigint, near array<double>", BLOCK_ROWS)
    least = F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k)  # k numbers a block
    scored = parts.groupBy("__n").agg((-F.aggregate(least, F.lit(0.0), lambda s, x: s + x) / F.lit(k)).alias(name))
    return numbered.join(scored, "__n").select(*rows.columns, name)


def _nearest(x, b, k: int):
    """The k least distances of each row of x to rows of b (all, if b has fewer), measured exactly among the likeliest."""
    out = []
    for at in range(0, len(x), 512):
        part = x[at : at + 512]
        d = (part * part).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * part @ b.T
        # products of nearly equal vectors cancel: the nearest are measured again
        few = min(4 * k, d.shape[1])
        near = np.argpartition(d, few - 1, axis=1)[:, :few] if few < d.shape[1] else np.broadcast_to(np.arange(d.shape[1]), d.shape)
        out.append(np.sort(np.linalg.norm(part[:, None, :] - b[near], axis=2), axis=1)[:, :k])
    return np.concatenate(out) if out else np.zeros((0, k))


def percentile_clip(rows: DataFrame, features: str = "features", q: float = 0.9) -> list[float]:
    """The q-quantile of each dimension, exactly and linearly interpolated; one number a dimension."""
    each = rows.select(F.posexplode(features).alias("d", "v")).groupBy("d").agg(F.percentile(F.col("v").cast("double"), F.lit(q)).alias("p"))
    return [r.p for r in each.orderBy("d").collect()]


def react_energy(rows: DataFrame, head: np.ndarray, bias: np.ndarray, clipping: list[float], features: str = "features", name: str = "react") -> DataFrame:
    """Energy of a linear head over features clipped from above."""
    clipped = clip_above(features, F.array(*[F.lit(float(c)) for c in clipping]))
    dots = [sum((clipped[i] * F.lit(float(w)) for i, w in enumerate(row) if w), F.lit(float(b))) for row, b in zip(head, bias)]
    return rows.withColumn("__logits", F.array(*dots)).withColumn(name, energy("__logits")).drop("__logits")


def to_long(rows: DataFrame, methods: list[str], keep: list[str]) -> DataFrame:
    """(kept columns, method, score)."""
    return rows.select(*keep, F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("score")) for m in methods])).alias("m")).select(*keep, "m.method", "m.score")


def osr_metrics(scores: DataFrame, by: list[str], stretches: int = 64) -> DataFrame:
    """Per group: auroc and oscr of score, over known (bool) and correct (bool) rows, with ties counted half.

    Rows are summed by score first. A group's distinct scores are then cut into stretches of about equal size by its
    quantiles, which need not be exact: running sums go over the scores of a stretch, and over the stretches before it."""
    steps = scores.groupBy(*by, "score").agg(
        F.sum(F.col("known").cast("bigint")).alias("k"), F.sum((~F.col("known")).cast("bigint")).alias("u"), F.sum((F.col("known") & F.col("correct")).cast("bigint")).alias("c"))
    ends = steps.groupBy(*by).agg(F.percentile_approx("score", [i / stretches for i in range(1, stretches)], 20 * stretches).alias("ends"))
    cut = steps.join(ends.withColumnsRenamed({c: f"__{c}" for c in by}), [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]).withColumn("stretch", F.size(F.filter("ends", lambda e: e > F.col("score")))).drop("ends", *[f"__{c}" for c in by])
    # the higher scores of a group, by stretch: a row a stretch
    falling = Window.partitionBy(*by).orderBy("stretch")
    sums = cut.groupBy(*by, "stretch").agg(F.sum("k").alias("sk"), F.sum("c").alias("sc"))
    before = sums.select(*by, "stretch", (F.sum("sk").over(falling) - F.col("sk")).alias("bk"), (F.sum("sc").over(falling) - F.col("sc")).alias("bc"))
    inside = Window.partitionBy(*by, "stretch").orderBy(F.desc("score"))
    run = cut.withColumn("cc", F.sum("c").over(inside)).withColumn("ku", F.sum("k").over(inside))
    b = before.withColumnsRenamed({c: f"__{c}" for c in (*by, "stretch")})
    run = run.join(b, [*[F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by], F.col("stretch") == F.col("__stretch")]).withColumns({"cc": F.col("cc") + F.col("bc"), "ku": F.col("ku") + F.col("bk")})
    total = run.groupBy(*by).agg(
        F.sum("k").alias("nk"), F.sum("u").alias("nu"),
        # pairs of a known row above an unknown one, a tie counting half
        F.sum(F.col("u") * (F.col("ku") - F.col("k") / 2)).alias("above"),
        # the area under correct classification over false positives, by trapezoids
        F.sum(F.col("u") * (2 * F.col("cc") - F.col("c")) / 2).alias("area"),
    )
    pairs = F.col("nk") * F.col("nu")
    return total.select(*by, F.col("nk").alias("known_samples"), F.col("nu").alias("unknown_samples"), (F.col("above") / pairs).alias("auroc"), (F.col("area") / pairs).alias("oscr"))


def closed_set_metrics(rows: DataFrame, by: list[str], label: str = "label", predicted: str = "predicted") -> DataFrame:
    """Per group: samples, accuracy, and macro F1 over the labels that occur as truth or prediction."""
    both = rows.select(*by, F.explode(F.array(F.struct(F.col(label).alias("l"), F.lit(1).alias("t"), F.lit(0).alias("p"), (F.col(label) == F.col(predicted)).cast("int").alias("hit")), F.struct(F.col(predicted).alias("l"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("hit")))).alias("x")).select(*by, "x.*")
    each = both.groupBy(*by, "l").agg(F.sum("t").alias("t"), F.sum("p").alias("p"), F.sum("hit").alias("hit"))
    return each.groupBy(*by).agg(F.sum("t").alias("samples"), (F.sum("hit") / F.sum("t")).alias("accuracy"), F.avg(2 * F.col("hit") / (F.col("t") + F.col("p"))).alias("macro_f1"))


def evaluate(rows: DataFrame, methods: list[str], years: list[int], year: str = "year") -> tuple[DataFrame, DataFrame]:
    """(osr metrics, closed-set metrics) for all years together ('combined') and for each year."""
    sets = F.array(F.lit("combined"), F.when(F.col(year).isin(*years), F.col(year).cast("string")))
    named = rows.withColumn("set", F.explode(F.filter(sets, lambda s: s.isNotNull())))
    long = to_long(named.withColumn("known", F.col("label") != UNKNOWN).withColumn("correct", F.col("label") == F.col("predicted")), methods, ["set", "known", "correct"])
    return osr_metrics(long, ["set", "method"]), closed_set_metrics(named.where(F.col("label") != UNKNOWN), ["set"])


def per_unknown_class(scored: DataFrame, classes: int) -> DataFrame:
    """Per unknown class: samples, auroc of its scores against all known rows, and the known class its rows stand nearest
    to most often (the first of ties) with that share. scored holds label, class, score and nearest."""
    unknown = scored.where(F.col("label") == UNKNOWN)
    named = unknown.select("class").distinct()
    known = scored.where(F.col("label") != UNKNOWN).select("score").crossJoin(F.broadcast(named))  # by the unknown classes
    rows = unknown.select("class", "score", F.lit(False).alias("known")).unionByName(known.select("class", "score", F.lit(True).alias("known"))).withColumn("correct", F.col("known"))
    near = unknown.groupBy("class", "nearest").agg(F.count(F.lit(1)).alias("n"))
    most = near.groupBy("class").agg(F.sum("n").alias("samples"), F.max(F.struct("n", (-F.col("nearest")).alias("less"))).alias("b"))
    return osr_metrics(rows, ["class"]).select("class", "auroc").join(most, "class").select("class", "samples", "auroc", (-F.col("b.less")).cast("int").alias("nearest"), (F.col("b.n") / F.col("samples")).alias("nearest_fraction"))


def centroids(rows: DataFrame, by: list[str], features: str = "features") -> DataFrame:
    """Per group: samples and the mean feature."""
    each = rows.select(*by, F.posexplode(features).alias("d", "v")).groupBy(*by, "d").agg(F.avg(F.col("v").cast("double")).alias("m"), F.count(F.lit(1)).alias("n"))
    return each.groupBy(*by).agg(F.max("n").alias("samples"), F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda x: x["m"]).alias("centroid"))  # d elements


def centroid_shift(rows: DataFrame, first, second, domain: str = "domain", label: str = "label", features: str = "features") -> DataFrame:
    """One row: mean distance of a class's centroids in the two domains, mean distance between classes in the first, their
    ratio, and the shift of each class."""
    c = centroids(rows, [domain, label], features)
    one, two = (c.where(F.col(domain) == v).select(F.col(label).alias("l"), F.col("centroid").alias(n)) for v, n in ((first, "a"), (second, "b")))
    moved = one.join(two, "l").select("l", distance("a", "b").alias("d"))
    other = one.select(F.col("l").alias("r"), F.col("a").alias("b"))
    between = one.join(other, F.col("l") < F.col("r")).agg(F.avg(distance("a", "b")).alias("between"))  # classes by classes
    out = moved.agg(F.avg("d").alias("shift"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("l").cast("string"), "d")))).alias("per_class")).crossJoin(between)
    return out.select(F.col("shift").alias("mean_cross_year_centroid_shift"), F.col("between").alias("mean_between_class_centroid_distance"), (F.col("shift") / F.col("between")).alias("cross_year_to_between_class_ratio"), F.col("per_class").alias("per_class_cross_year_shift"))


def domain_auc(rows: DataFrame, domain: str = "domain", features: str = "features", id_col: str = "id", folds: int = 5) -> float:
    """Mean area under the ROC of a logistic regression that tells the two domains apart, over folds stratified by a shuffle."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.functions import array_to_vector

    from .sampling import places_in_shuffle

    placed = places_in_shuffle(rows.select(F.col(id_col).alias("id"), F.col(domain).cast("double").alias("y"), doubles(features).alias("f")), ["y"], F.md5(F.col("id").cast("string")), "id")
    held = materialise(placed.select("y", "f", ((F.col("place") - 1) % folds).alias("fold")), "folds").select("y", "fold", array_to_vector("f").alias("x"))
    model, measure = LogisticRegression(featuresCol="x", labelCol="y", maxIter=100, regParam=1e-3), BinaryClassificationEvaluator(labelCol="y")
    found = [measure.evaluate(model.fit(held.where(F.col("fold") != f)).transform(held.where(F.col("fold") == f))) for f in range(folds)]
    return float(np.mean(found))


def supervised_contrastive_loss(rows: DataFrame, temperature: float = 0.1, id_col: str = "id", label: str = "label", features: str = "features") -> DataFrame:
    """One row: anchors with a positive, and the mean loss over them, against all rows as one batch.

    The rows meet themselves in blocks of BLOCK_ROWS: each block gives an anchor the maximum, the sum of exponentials under
    it and the sum over positives, which are put together by anchor. The work grows with the square of the rows."""
    batch = materialise(rows.select(F.monotonically_increasing_id().alias("n"), F.col(label).cast("double").alias("label"), doubles(features).alias("f")), "batch")

    def meet(mine, block):
        import pyarrow as pa

        if not len(mine) or not len(block):
            return pa.table({c: pa.array([], k) for c, k in (("n", pa.int64()), ("most", pa.float64()), ("total", pa.float64()), ("positive", pa.float64()), ("count", pa.int64()))})
        x, b = matrix(mine, "f"), matrix(block, "f")
        (i, y), (j, z) = ((t.column("n").to_numpy(), t.column("label").to_numpy()) for t in (mine, block))
        out = []
        for at in range(0, len(x), 512):
            s = x[at : at + 512] @ b.T / temperature
            other = i[at : at + 512, None] != j[None]
            same = other & (y[at : at + 512, None] == z[None])
            top = s.max(axis=1)
            out.append((top, np.where(other, np.exp(s - top[:, None]), 0.0).sum(axis=1), np.where(same, s, 0.0).sum(axis=1), same.sum(axis=1)))
        most, total, positive, n = (np.concatenate(v) for v in zip(*out))
        return pa.table({"n": i, "most": most, "total": total, "positive": positive, "count": n.astype(np.int64)})

    parts = block_products(batch, batch, meet, "n bigint, most double, total double, positive double, count bigint", BLOCK_ROWS)
    most = F.max("most").over(Window.partitionBy("n"))  # a row a block
    each = parts.withColumn("top", most).groupBy("n").agg(F.max("top").alias("most"), F.sum(F.col("total") * F.exp(F.col("most") - F.col("top"))).alias("total"), F.sum("positive").alias("positive"), F.sum("count").alias("count"))
    loss = F.col("positive") / F.col("count") - F.col("most") - F.log(F.col("total") + 1e-12)
    return each.where("count > 0").agg(F.count(F.lit(1)).alias("anchors"), (-F.avg(loss)).alias("loss"))


def supervised_contrastive_loss(rows: DataFrame, temperature: float = 0.1, id_col: str = "id", label: str = "label", features: str = "features") -> DataFrame:
    """One row: anchors with a positive, and the mean loss over them, against all rows as one batch.

    The rows are broadcast in blocks of BLOCK_ROWS; the maximum, the sum of exponentials and the sum over positives of each
    anchor are carried from block to block. The work grows with the square of the rows."""
    spark, blocks, held = rows.sparkSession, [], []
    batch = rows.select(F.col(id_col).alias("id"), F.col(label).cast("double").alias("label"), doubles(features).alias("f"))
    schema = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in batch.schema) + ", most double, total double, positive double, n bigint"

    def seen(block):
        def run(batches):
            import pyarrow as pa

            ids, labels, b = block.value
            for batch in batches:
                for start in range(0, batch.num_rows, 512):
                    part = batch.slice(start, 512)
                    if not part.num_rows:
                        continue
                    mine, y = np.asarray(part.column(0).to_pylist()), part.column(1).to_numpy(zero_copy_only=False)
                    x = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                    most, total, positive, n = (part.column(i).to_numpy(zero_copy_only=False) for i in range(3, 7))
                    for at in range(0, len(b), 4096):
                        s = x @ b[at : at + 4096].T / temperature
                        other = mine[:, None] != ids[None, at : at + 4096]
                        same = other & (y[:, None] == labels[None, at : at + 4096])
                        top = np.maximum(most, s.max(axis=1))
                        total = total * np.exp(most - top) + np.where(other, np.exp(s - top[:, None]), 0.0).sum(axis=1)
                        most, positive, n = top, positive + np.where(same, s, 0.0).sum(axis=1), n + same.sum(axis=1)
                    yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(most), pa.array(total), pa.array(positive), pa.array(n, pa.int64())], names=part.schema.names)

        return run

    def send():
        ids, labels, x = zip(*held)
        blocks.append(spark.sparkContext.broadcast((np.asarray(ids), np.array(labels, float), np.array(x))))
        held.clear()

    for r in batch.toLocalIterator():
        held.append(tuple(r))
        if len(held) >= BLOCK_ROWS:
            send()
    if held:
        send()
    # an anchor's own product is the least that the maximum may be
    own = F.aggregate("f", F.lit(0.0), lambda t, v: t + v * v) / F.lit(float(temperature))
    out = batch.select("*", own.alias("most"), F.lit(0.0).alias("total"), F.lit(0.0).alias("positive"), F.lit(0).cast("bigint").alias("n"))
    for block in blocks:
        out = out.mapInArrow(seen(block), schema)
    loss = F.col("positive") / F.col("n") - F.col("most") - F.log(F.col("total") + 1e-12)
    return out.where("n > 0").agg(F.count(F.lit(1)).alias("anchors"), (-F.avg(loss)).alias("loss"))


def early_stopping(history: DataFrame, patience: int, by: list[str], epoch: str = "epoch", value: str = "validation_macro_f1") -> DataFrame:
    """history with best (the running maximum before the epoch), improved (strictly above it), stale (epochs since), and
    ran: false after the epoch at which stale reached patience."""
    upto = Window.partitionBy(*by).orderBy(epoch)
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    marked = history.withColumn("best", F.max(value).over(before)).withColumn("improved", F.col("best").isNull() | (F.col(value) > F.col("best")))
    stale = marked.withColumn("__last", F.max(F.when(F.col("improved"), F.col(epoch))).over(upto)).withColumn("stale", F.col(epoch) - F.col("__last"))
    stopped = stale.withColumn("__stopped", F.max(F.when(F.col("stale") >= patience, 1).otherwise(0)).over(before))
    return stopped.withColumn("ran", F.coalesce("__stopped", F.lit(0)) == 0).drop("__last", "__stopped")


def probability_columns(logits: str = "logits") -> dict[str, Column]:
    return {"probabilities": softmax(logits), "predicted": argmax(logits)}


def train_head(rows: DataFrame, classes: int, label: str = "label", features: str = "features", weighted: bool = True, penalty: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """(weights, bias) of a linear head over stored features, by multinomial regression; rows of unknown labels are left
    out, and classes weigh alike if asked for."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    held = rows.where(F.col(label) >= 0)
    sizes = held.groupBy(label).agg((1.0 / F.count(F.lit(1))).alias("__w"))
    x = held.join(F.broadcast(sizes), label).select(F.col(label).cast("double").alias("y"), array_to_vector(doubles(features)).alias("x"), F.when(F.lit(weighted), F.col("__w")).otherwise(1.0).alias("w"))
    model = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", family="multinomial", regParam=penalty).fit(x)
    w, b = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    pad = classes - len(w)
    return np.vstack([w, np.zeros((pad, w.shape[1]))]), np.concatenate([b, np.full(pad, -1e9)])


def apply_head(rows: DataFrame, head: np.ndarray, bias: np.ndarray, features: str = "features") -> DataFrame:
    """rows with logits and predicted."""
    from ..functions.vector import dot

    logits = F.array(*[dot(features, F.array(*[F.lit(float(v)) for v in w])) + F.lit(float(b)) for w, b in zip(head, bias)])
    return rows.withColumn("logits", logits).withColumn("predicted", argmax("logits"))


@dataclass(frozen=True)
class Classifier:
    """A linear head with what must fit the data it is used on: its classes in order, and the years it was trained on."""

    known_classes: tuple[str, ...]
    train_years: tuple[int, ...]
    head: np.ndarray
    bias: np.ndarray

    def save(self, spark, path: str) -> None:
        """One row of Parquet, so that a half-written file is never met."""
        row = (list(self.known_classes), list(self.train_years), np.asarray(self.head, float).tolist(), np.asarray(self.bias, float).tolist())
        spark.createDataFrame([row], "known_classes array<string>, train_years array<int>, head array<array<double>>, bias array<double>").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark, path: str, known_classes: list[str] | tuple[str, ...] | None = None) -> "Classifier":
        """A saved head; other classes than those asked for, or another order of them, are an error."""
        r = spark.read.parquet(path).first()
        if known_classes is not None and tuple(r.known_classes) != tuple(known_classes):
            raise ValueError(f"the saved head tells {list(r.known_classes)} apart, not {list(known_classes)}")
        return cls(tuple(r.known_classes), tuple(r.train_years), np.array(r["head"]), np.array(r.bias))


def epoch_losses(batches: DataFrame, by: list[str], loss: str = "loss", size: str = "n") -> DataFrame:
    """Per group the mean loss of its batches, weighted by their sizes."""
    return batches.groupBy(*by).agg((F.sum(F.col(loss) * F.col(size)) / F.sum(size)).alias("loss"))


def lookalikes(manifest: DataFrame, pairs: list[tuple[str, str, float]], examples: int = 4, seed: int = 42) -> DataFrame:
    """Example crops of unknown classes and of the known classes they look like: (unknown, known, auroc, side, columns)."""
    from .sampling import shuffled

    order = Window.partitionBy("unknown", "side").orderBy(*shuffled(seed, "relative_path"))
    listed = manifest.sparkSession.createDataFrame(pairs, "unknown string, known string, auroc double")
    sides = [listed.withColumn("side", F.lit(s)).withColumn("class", F.col(s)) for s in ("unknown", "known")]
    wanted = sides[0].unionByName(sides[1])
    rows = manifest.where(F.col("split").isin("test", "test_unknown")).join(F.broadcast(wanted), "class")
    return rows.withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= examples).drop("__k")
