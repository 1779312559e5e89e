import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import openset, retrieval


def vectors(n=60, d=6, seed=0, labels=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    x[5] = x[4]  # a tie
    y = [None if i % 13 == 7 else int(v) for i, v in enumerate(rng.integers(0, labels, n))]
    y[0] = 99  # alone in its class
    return x, y


def frame(spark, x, y):
    return spark.createDataFrame([(i, str(i), v, [float(t) for t in e]) for i, (e, v) in enumerate(zip(x, y))], "retrieval_id bigint, source_id string, label int, embedding array<double>").withColumn("embedding", retrieval.normalise("embedding"))


def ranked(x, q):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u[q], 12)
    return [i for i in sorted(range(len(x)), key=lambda i: (-s[i], i)) if i != q]


@pytest.mark.parametrize("block_bytes", [1 << 20, 500])
def test_query_metrics(spark, block_bytes):
    x, y = vectors()
    rows = frame(spark, x, y)
    got = {r.retrieval_id: r for r in retrieval.query_metrics(rows, 10, block_bytes).collect()}
    for q in range(len(x)):
        hits = [int(y[i] == y[q]) for i in ranked(x, q)]
        if y[q] is None or not sum(hits):
            assert q not in got  # null and lone labels ask nothing, but stand in the rankings of others
            continue
        cum = np.cumsum(hits)
        assert got[q].average_precision == pytest.approx(sum(c / (k + 1) for k, (c, h) in enumerate(zip(cum, hits)) if h) / sum(hits))
        assert (got[q].precision_at_k, got[q].recall_at_k) == pytest.approx((cum[9] / 10, cum[9] / sum(hits)))
        assert got[q].hits == cum[:10].tolist()


def test_class_summary_takes_the_first_best_depth(spark):
    rows = frame(spark, *vectors(40, labels=3))
    m = retrieval.query_metrics(rows, 100)
    for r in retrieval.class_summary(m, rows).collect():
        mine = [q for q in m.where(F.col("label") == r.label).collect()]
        n = rows.where(F.col("label") == r.label).count() - 1
        k = np.arange(1, len(mine[0].hits) + 1)
        p, q = np.mean([np.array(i.hits) / k for i in mine], axis=0), np.mean([np.array(i.hits) / n for i in mine], axis=0)
        f = 2 * p * q / np.maximum(p + q, 1e-12)
        assert (r.best_k, r.best_f1) == (int(np.argmax(np.round(f, 12))) + 1, pytest.approx(f.max()))


def test_query_and_index_guards(spark):
    x, y = vectors()
    rows = frame(spark, x, y)
    assert [r.retrieval_id for r in retrieval.query(rows, 4, k=12).orderBy("rank").collect()] == ranked(x, 4)[:12]
    assert [r.retrieval_id for r in retrieval.query(rows, 4, k=0).orderBy("rank").collect()] == ranked(x, 4)
    for bad in (lambda: retrieval.query(rows, 4, k=-1), lambda: retrieval.query(rows, "none"), lambda: retrieval.query(rows.withColumn("source_id", F.lit("s")), "s"), lambda: retrieval.load_index(rows.where("retrieval_id <> 3"))):
        with pytest.raises(ValueError):
            bad()
    assert retrieval.load_index(rows).count() == 60
    notes = spark.createDataFrame([("1", "a"), ("1", "b")], "id string, class_id string")
    with pytest.raises(ValueError, match="unique"):
        retrieval.labelled(rows, notes)
    with pytest.raises(ValueError, match="fewer"):
        retrieval.labelled(rows, notes.limit(1))
    with pytest.raises(ValueError, match="missing"):
        retrieval.labelled(rows, notes.drop("class_id"))
    cands = spark.createDataFrame([(10, [3.0, 4.0], "x"), (11, None, "y"), (12, [0.0, 0.0], "z")], "fid bigint, embedding array<double>, note string")
    built = retrieval.build_index(cands, "fid").orderBy("retrieval_id").collect()
    assert [(r.retrieval_id, r.source_id, r.embedding, r.note) for r in built] == [(0, "10", [0.6, 0.8], "x"), (1, "12", [0.0, 0.0], "z")]
    assert retrieval.failures(cands, "fid").first().source_id == "11"


def test_class_similarity(spark):
    x, y = vectors()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {(r.left_label, r.right_label): (r.mean, r.std) for r in retrieval.class_similarity(frame(spark, x, y)).collect()}
    for (a, b), found in got.items():
        s = [u[i] @ u[j] for i in range(60) for j in range(60) if i != j and y[i] == a and y[j] == b]
        assert found == pytest.approx((np.mean(s), np.std(s)) if s else (1.0, 0.0), abs=1e-9)
    assert got[99, 99] == (1.0, 0.0) and len(got) == len({v for v in y if v is not None}) ** 2


def test_projection(spark):
    assert len(retrieval.projection(frame(spark, *vectors()), 2).first().point) == 2


def scored(spark, known, correct, unknown):
    rows = [("g", float(s), True, bool(c)) for s, c in zip(known, correct)] + [("g", float(s), False, False) for s in unknown]
    return openset.osr_metrics(spark.createDataFrame(rows, "m string, score double, known boolean, correct boolean"), ["m"]).first()


def by_thresholds(known, correct, unknown):
    known, correct, unknown = np.array(known), np.array(correct, bool), np.array(unknown)
    ts = [np.inf, *sorted(set(known) | set(unknown), reverse=True), -np.inf]
    x = [np.mean(unknown >= t) for t in ts]
    y = [np.mean((known >= t) & correct) for t in ts]
    auc = np.mean([(k > u) + 0.5 * (k == u) for k in known for u in unknown])
    return auc, sum((b - a) * (c + d) / 2 for a, b, c, d in zip(x, x[1:], y, y[1:]))


def test_auroc_and_oscr(spark):
    rng = np.random.default_rng(1)
    for _ in range(3):
        k, u = rng.integers(0, 12, 40), rng.integers(-3, 9, 30)
        c = rng.random(40) < 0.7
        r = scored(spark, k, c, u)
        assert (r.auroc, r.oscr) == pytest.approx(by_thresholds(k, c, u))
        assert r.oscr <= c.mean() + 1e-12
        back = scored(spark, u, [True] * 30, k)
        assert r.auroc + back.auroc == pytest.approx(1)
    same = scored(spark, [1, 1], [True, False], [1, 1, 1])
    assert (same.auroc, same.oscr) == (0.5, 0.25)
    apart = scored(spark, [5, 6, 7, 8], [True, True, True, False], [1, 2])
    assert (apart.auroc, apart.oscr) == (1.0, 0.75)


def test_scorers_equal_numpy(spark):
    rng = np.random.default_rng(2)
    x, z, y = rng.normal(size=(90, 5)), rng.normal(size=(90, 3)), rng.integers(0, 3, 90)
    rows = spark.createDataFrame([(i, int(y[i]), x[i].tolist(), z[i].tolist()) for i in range(90)], "id int, label int, features array<double>, logits array<double>")
    train, test = rows.where("id < 60"), rows.where("id >= 60")
    tx, ty, tz, qx, qz = x[:60], y[:60], z[:60], x[60:], z[60:]
    energy = lambda a: np.log(np.exp(a).sum(1))
    got = lambda df, c: np.array([r[c] for r in df.orderBy("id").collect()])

    means = np.stack([tx[ty == c].mean(0) for c in range(3)])
    p = np.linalg.pinv(np.cov(np.concatenate([tx[ty == c] - means[c] for c in range(3)]), rowvar=False) + 1e-6 * np.eye(5))
    d = np.array([[(v - m) @ p @ (v - m) for m in means] for v in qx])
    df = openset.Mahalanobis.fit(train).score(test)
    assert got(df, "mahalanobis") == pytest.approx(-d.min(1)) and (got(df, "nearest") == d.argmin(1)).all()

    unit = lambda a: a / np.linalg.norm(a, axis=1, keepdims=True)
    near = np.sort(np.linalg.norm(unit(tx)[None] - unit(qx)[:, None], axis=2), axis=1)[:, :4].mean(1)
    assert got(openset.knn_score(test, train, 4), "knn") == pytest.approx(-near)
    old, openset.BLOCK_ROWS = openset.BLOCK_ROWS, 17
    assert got(openset.knn_score(test, train, 4), "knn") == pytest.approx(-near)
    openset.BLOCK_ROWS = old
    for k in (0, 61):
        with pytest.raises(ValueError):
            openset.knn_score(test, train, k)

    mean = tx.mean(0)
    _, v = np.linalg.eigh((tx - mean).T @ (tx - mean) / 60)
    basis = v[:, :2]
    alpha = tz.max(1).mean() / np.linalg.norm((tx - mean) @ basis, axis=1).mean()
    assert got(openset.ViM.fit(train, 3).score(test), "vim") == pytest.approx(energy(qz) - alpha * np.linalg.norm((qx - mean) @ basis, axis=1))
    with pytest.raises(ValueError):
        openset.ViM.fit(train, 5)

    clip = openset.percentile_clip(train)
    assert clip == pytest.approx(np.percentile(tx, 90, axis=0).tolist())
    head, bias = rng.normal(size=(3, 5)), rng.normal(size=3)
    assert got(openset.react_energy(test, head, bias, clip), "react") == pytest.approx(energy(np.minimum(qx, clip) @ head.T + bias))

    e = np.exp(qz - qz.max(1, keepdims=True))
    soft = e / e.sum(1, keepdims=True)
    s = openset.logit_scores(test)
    for c, want in (("msp", soft.max(1)), ("maxlogit", qz.max(1)), ("energy", energy(qz)), ("entropy", (soft * np.log(soft + 1e-12)).sum(1))):
        assert got(s, c) == pytest.approx(want)


def test_contrastive_loss(spark):
    rng = np.random.default_rng(4)
    f, y = rng.normal(size=(12, 3)), [0, 0, 0, 1, 1, 2, 2, 2, 2, 3, 1, 0]
    s = f @ f.T / 0.5
    s -= s.max(1, keepdims=True)
    losses = []
    for i in range(12):
        log_all = np.log(sum(np.exp(s[i, j]) for j in range(12) if j != i) + 1e-12)
        mine = [s[i, j] - log_all for j in range(12) if j != i and y[j] == y[i]]
        if mine:
            losses.append(-np.mean(mine))
    r = openset.supervised_contrastive_loss(spark.createDataFrame([(i, y[i], f[i].tolist()) for i in range(12)], "id int, label int, features array<double>"), 0.5).first()
    assert (r.anchors, r.loss) == (11, pytest.approx(np.mean(losses)))


def test_early_stopping(spark):
    values = [0.1, 0.3, 0.3, 0.2, 0.1, 0.9]
    h = spark.createDataFrame([("s", i + 1, v) for i, v in enumerate(values)], "stage string, epoch int, validation_macro_f1 double")
    got = openset.early_stopping(h, 3, ["stage"]).orderBy("epoch").collect()
    assert [r.improved for r in got][:5] == [True, True, False, False, False]  # an equal score is no improvement
    assert [r.stale for r in got][:5] == [0, 0, 1, 2, 3] and [r.ran for r in got] == [True] * 5 + [False]
