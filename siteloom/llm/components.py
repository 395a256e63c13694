"""Connected components of a graph of 64-bit node ids, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.llm.common import stored

#: Links or labels for each task that writes them, and the least number of such tasks. Rounds are many and their tables
#: small: in a task and a file for each shuffle partition, executors would mostly start tasks, write files and grow.
TASK_ROWS, TASKS = 50_000, 12


def _tasks(rows: int) -> int:
    return max(TASKS, -(-rows // TASK_ROWS))


def _flat(edges: DataFrame, tasks: int) -> DataFrame:
    """node, root for each node of ``edges`` (a, b; both directions): the end of its chain of least neighbours, stored.

    A node's second next on that chain is at most the node itself, so a chain ends in two nodes that name each other;
    the smaller one is the root and the least node of its tree.
    """
    least = stored(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")), "labels", tasks)
    then = least.select(F.col("node").alias("j_node"), F.col("least").alias("j_root"))
    ends = (F.col("j_root") == F.col("node")) & (F.col("node") < F.col("least"))
    roots = stored(least.join(then.hint("merge"), least["least"] == then["j_node"]).select("node", F.when(ends, F.col("node")).otherwise(F.col("least")).alias("root")), "labels", tasks)
    while True:
        # pointer jumping: the depth halves, until every node names its root
        jump = roots.select(F.col("node").alias("j_node"), F.col("root").alias("j_root"))
        new = stored(roots.join(jump.hint("merge"), roots["root"] == jump["j_node"]).select("node", F.col("j_root").alias("root"), F.col("root").alias("was")), "labels", tasks)
        roots = new.drop("was")
        if not new.where("root <> was").limit(1).count():
            return roots


def connected(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node id of it) for each node of ``edges`` (a, b), which should be a stored table.

    Each round every node hooks to its least neighbour, the trees become single nodes (known by their least node), and
    only the links between different trees go on. Every tree has two nodes at least, so the nodes of a component with
    links left at least halve a round: rounds grow with the logarithm of its size, whatever its diameter and the order
    of the ids. Labels and links stay distributed. An edge with a null end is left out.
    """
    pairs = edges.where("a is not null and b is not null and a <> b").select("a", "b").distinct()
    both = stored(pairs.union(pairs.select("b", "a")).distinct(), "links")
    tasks = _tasks(both.count())  # nodes are no more than links in both directions, and later rounds have fewer of each
    labels = _flat(both, tasks)
    roots, labels = labels, labels.select("node", F.col("root").alias("component"))
    while True:
        at_a = roots.select(F.col("node").alias("a"), F.col("root").alias("root_a"))
        at_b = roots.select(F.col("node").alias("b"), F.col("root").alias("root_b"))
        ends = both.join(at_a.hint("merge"), "a").join(at_b.hint("merge"), "b").where("root_a <> root_b")
        both = stored(ends.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct(), "links", tasks)
        if not (left := both.count()):
            return labels
        roots = _flat(both, _tasks(left))
        moved = roots.select(F.col("node").alias("j_node"), F.col("root").alias("j_root"))
        labels = stored(labels.join(moved.hint("merge"), labels["component"] == moved["j_node"], "left").select("node", F.coalesce("j_root", "component").alias("component")), "labels", tasks)
