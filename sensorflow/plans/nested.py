"""All forests of a grid of depths, least gains and numbers of trees, out of one fit.

The trees of a random forest are grown independently, and whether a node is split depends on its own rows. So a forest of n trees is
the first n trees of a larger one, a forest of depth d is one whose trees are cut at depth d, and a forest with a higher
least gain is one whose trees are cut where a split gains less. The largest forest of a grid holds all others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from sensorflow.schema import INDEXED_LABEL

LEAVES = "_leaves"
ROWS_AT_A_TIME = 1_000


@dataclass(frozen=True)
class NestedForests:
    """A fitted forest and the grid points it holds, each (place in the grid, (depth, least gain), trees).

    ``shares`` has for each cut (depth, least gain) the class shares that a tree cut there gives for each leaf of
    the whole tree, with the axes tree, leaf and class. Leaves are numbered as in the model's leaf column.
    """

    model: RandomForestClassificationModel
    points: list[tuple[int, tuple[int, float], int]]
    shares: dict[tuple[int, float], np.ndarray]


def nested_forests(estimator: RandomForestClassifier, points: Sequence[dict], rows: DataFrame, folder: str) -> list[NestedForests]:
    """The largest forest of the grid, fitted to ``rows`` and stored below ``folder``.

    Points of a single tree share one of their own: Spark grows a lone tree by other rules, it may look at all features.
    """
    found = []
    for lone in (False, True):
        held = [
            (place, (point[estimator.maxDepth], point[estimator.minInfoGain]), point[estimator.numTrees])
            for place, point in enumerate(points)
            if (point[estimator.numTrees] == 1) == lone
        ]
        if held:
            cuts = {cut for _, cut, _ in held}
            depth, gain, trees = max(d for d, _ in cuts), min(g for _, g in cuts), max(n for *_, n in held)
            largest = {estimator.maxDepth: depth, estimator.minInfoGain: gain, estimator.numTrees: trees, estimator.leafCol: LEAVES}
            model = estimator.fit(rows, largest)
            grown = stored_trees(rows.sparkSession, model, f"{folder}/trees={trees}")
            found.append(NestedForests(model, held, {cut: shares_of(grown, *cut) for cut in cuts}))
    return found


def count_hits(forests: Sequence[NestedForests], rows: DataFrame) -> dict[int, int]:
    """By place in the grid, how many of ``rows`` the point's forest predicts right; one pass for all points of a forest."""
    found = {}
    for forest in forests:
        leaves = forest.model.transform(rows).select(F.col(INDEXED_LABEL).alias("label"), vector_to_array(LEAVES).alias("leaves"))
        hits = leaves.mapInArrow(_hits_of(forest.points, forest.shares), "place int, hits long")
        found |= {place: 0 for place, *_ in forest.points}
        found |= dict(hits.groupBy("place").agg(F.sum("hits")).collect())
    return found


def stored_trees(spark: SparkSession, model: RandomForestClassificationModel, path: str) -> list[dict[int, Row]]:
    """The nodes of each tree by number, from the model's stored form: it has the class counts of inner nodes."""
    model.write().overwrite().save(path)
    trees = [{} for _ in range(model.getNumTrees)]
    for row in spark.read.parquet(f"{path}/data").select("treeID", "nodeData").toLocalIterator():
        trees[row.treeID][row.nodeData.id] = row.nodeData
    return trees


def shares_of(trees: Sequence[dict[int, Row]], depth: int, gain: float) -> np.ndarray:
    cut = [_cut(nodes, 0, depth, gain)[0] for nodes in trees]
    shares = np.zeros((len(cut), max(map(len, cut)), len(cut[0][0])))
    for tree, leaves in enumerate(cut):
        shares[tree, : len(leaves)] = leaves
    return shares


def _cut(nodes: dict[int, Row], number: int, depth: int, gain: float) -> tuple[list[np.ndarray], float | None]:
    """Class shares for each leaf below a node, and the node's class if it is a leaf of the cut tree.

    As Spark does, two leaves of the same class are merged into the node above them.
    """
    node = nodes[number]
    if node.leftChild < 0:
        return [_share(node)], node.prediction
    left, left_class = _cut(nodes, node.leftChild, depth - 1, gain)
    right, right_class = _cut(nodes, node.rightChild, depth - 1, gain)
    if depth <= 0 or node.gain < gain:
        return [_share(node)] * (len(left) + len(right)), node.prediction
    if left_class is not None and left_class == right_class:
        return [_share(node)] * (len(left) + len(right)), left_class
    return left + right, None


def _share(node: Row) -> np.ndarray:
    counts = np.array(node.impurityStats)
    return counts / (counts.sum() or 1.0)


def _hits_of(points: list, shares: dict) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The trees' shares are added in the model's order; the first class with the most wins, as in the model.

    Cuts that give all leaves the same shares are counted together.
    """
    alike = {}
    for cut, given in shares.items():
        alike.setdefault(given.tobytes(), (given, []))[1].extend((place, trees) for place, same, trees in points if same == cut)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = dict.fromkeys((place for place, *_ in points), 0)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_A_TIME):
                part = batch.slice(start, ROWS_AT_A_TIME)
                label = part.column(0).to_numpy()
                leaves = part.column(1).flatten().to_numpy().reshape(len(label), -1).T.astype(np.int64, order="C")
                for given, held in alike.values():
                    votes = np.zeros((len(label), given.shape[2]))
                    for tree in range(len(given)):
                        votes += given[tree].take(leaves[tree], axis=0)
                        places = [place for place, trees in held if trees == tree + 1]
                        if places:
                            predicted = (votes / votes.sum(axis=1, keepdims=True)).argmax(axis=1)
                            right = int((predicted == label).sum())
                            for place in places:
                                hits[place] += right
        yield pa.RecordBatch.from_pydict({"place": pa.array(list(hits), pa.int32()), "hits": pa.array(list(hits.values()), pa.int64())})

    return count
