"""Open-set queries over all rows and all 64 features of a small table, against numpy."""

import numpy as np
import pytest

from tessera.plans import openset_queries


@pytest.fixture(scope="module")
def embeddings(spark, tmp_path_factory):
    """Vectors of 64 dimensions whose classes differ in dimension 31 on, and whose years differ in dimension 41."""
    sf, rng = str(tmp_path_factory.mktemp("embeddings")), np.random.default_rng(3)
    ids, labels = np.arange(600), rng.integers(0, 8, 600)
    x = rng.normal(0, 0.2, (600, 64))
    x[ids, 30 + labels] += 1.5
    x[:, 40] += ids % 2 * 2.0
    x = x.astype(np.float32).astype(float)
    spark.createDataFrame([(i, y, v) for i, y, v in zip(ids.tolist(), labels.tolist(), x.tolist())], "vec_id bigint, label int, embedding array<float>").write.parquet(f"{sf}/embeddings.parquet")
    return sf, ids, labels, x


def test_scores_take_all_features(spark, embeddings):
    sf, ids, labels, x = embeddings
    known, fitted = labels < 5, (ids % 3 == 0) & (labels < 5)
    t, y, q = x[fitted], labels[fitted], x[ids % 3 != 0]
    means = np.stack([t[y == c].mean(axis=0) for c in range(5)])
    within = (t - means[y]).T @ (t - means[y]) / (len(t) - 1)
    p = np.linalg.pinv(within + 1e-6 * np.eye(64))
    d = np.stack([np.einsum("nd,de,ne->n", q - m, p, q - m) for m in means], axis=1)
    got = spark_rows(openset_queries.mahalanobis(spark, sf), "id")
    assert [r.mahalanobis for r in got] == pytest.approx(-d.min(axis=1), abs=1e-3) and [r.nearest for r in got] == d.argmin(axis=1).tolist()
    z = lambda v: v[:, :5] * 10
    mean = t.mean(axis=0)
    basis = np.linalg.eigh(np.cov(t.T, bias=True))[1][:, : 64 - 5]
    alpha = z(t).max(axis=1).mean() / np.linalg.norm((t - mean) @ basis, axis=1).mean()
    want = np.log(np.exp(z(q)).sum(axis=1)) - alpha * np.linalg.norm((q - mean) @ basis, axis=1)
    assert [r.vim for r in spark_rows(openset_queries.vim(spark, sf), "id")] == pytest.approx(want, abs=1e-4)
    unknown = labels[ids % 3 != 0]
    s = -d.min(axis=1)
    for r in openset_queries.per_unknown_class(spark, sf).collect():
        u = s[unknown == int(r["class"][1:])]
        k = s[unknown < 5]
        assert r.samples == len(u) and r.auroc == pytest.approx(np.mean((k[:, None] > u) + 0.5 * (k[:, None] == u)), abs=1e-6)
    assert known.any() and openset_queries.domain_auc(spark, sf).first()[0] > 0.9


@pytest.mark.parametrize("block", [100_000, 37])
def test_contrastive_loss_takes_all_rows(spark, embeddings, block, monkeypatch):
    sf, _, labels, x = embeddings
    monkeypatch.setattr(openset_queries.openset, "BLOCK_ROWS", block)
    f, y = x[labels < 5], labels[labels < 5]
    s = f @ f.T / 0.1
    s -= s.max(axis=1, keepdims=True)
    other = ~np.eye(len(y), dtype=bool)
    same = (y[:, None] == y) & other
    each = (s * same).sum(axis=1) / same.sum(axis=1) - np.log((np.exp(s) * other).sum(axis=1) + 1e-12)
    r = openset_queries.contrastive_loss(spark, sf).first()
    assert (r.anchors, r.loss) == (len(y), pytest.approx(-each.mean(), abs=1e-5))


def spark_rows(df, key):
    return df.orderBy(key).collect()
