import numpy as np

import pytest

from tessera.operators import components as module
from tessera.operators.components import components


@pytest.mark.parametrize("local", [0, 1 << 18])
def test_components(spark, local, monkeypatch):
    monkeypatch.setattr(module, "LOCAL_EDGES", local)
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(70)] + [(5000, i) for i in range(5001, 5100)] + [(7, 7)]
    up = list(range(6000))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert len(got) == len({r.node for r in got})
    assert all(r.label == root(r.node) for r in got)
    assert {r.node for r in got} == {x for e in edges for x in e if e[0] != e[1]}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.mark.parametrize("local", [0, 1 << 18])
def test_labels_of_other_types(spark, local, monkeypatch):
    monkeypatch.setattr(module, "LOCAL_EDGES", local)
    names = components(spark.createDataFrame([("é", "z"), ("a", "é"), ("\U0001f600", "\uffff")], "a string, b string")).collect()
    assert {r.node: r.label for r in names} == {"a": "a", "é": "a", "z": "a", "\uffff": "\uffff", "\U0001f600": "\uffff"}
    keys = components(spark.createDataFrame([(b"\xff", b"\x01"), (b"\x80", b"\xff")], "a binary, b binary")).collect()
    assert {bytes(r.node): bytes(r.label) for r in keys} == {b"\xff": b"\x01", b"\x80": b"\x01", b"\x01": b"\x01"}
