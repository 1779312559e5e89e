"""Connected components of a graph given by its edges, by rounds of large and small stars.

Rounds cost jobs, whatever they move: from LOCAL_EDGES edges down, one task binds the nodes that are left to bind."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialise


#: Edges, counted before, that one task may hold: some ten megabytes of keys.
LOCAL_EDGES = 1 << 18


def _bind(batches):
    """(node, label) of all edges of the task, by union-find."""
    import pyarrow as pa

    up: dict = {}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            up.setdefault(a, a)
            up.setdefault(b, b)
            x, y = root(a), root(b)
            if x != y:
                up[max(x, y)] = min(x, y)
    nodes = list(up)
    for at in range(0, len(nodes), 10_000):
        part = nodes[at : at + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, kind), pa.array([root(x) for x in part], kind)], names=["node", "label"])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label) of every node of edges (a, b): label is the component's least node.

    A node's label is found by rounds until nothing changes, or at once where there are few edges. Each round lets every node hand its neighbours the least node it knows (stars), and is written to the shared folder.
    Ends when a round changes nothing. A hub's rows are pre-aggregated before they are shuffled."""
    spark = edges.sparkSession
    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    if now.count() <= LOCAL_EDGES:
        return materialise(now.repartition(1).mapInArrow(_bind, f"node {now.schema['a'].dataType.simpleString()}, label {now.schema['a'].dataType.simpleString()}"), "components")
    for _ in range(rounds):
        # large star: every neighbour above a node is linked to the least of the node and its neighbours
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: every neighbour below a node, and the node, are linked to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        now = materialise(small.where("a <> b").distinct(), "edges")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("the components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
