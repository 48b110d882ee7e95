"""Approximate nearest neighbours with a hierarchical k-means tree.

The tree is fitted on a bounded sample: k-means with `branch` centres splits the sample, and each part again, until a part has `leaf`
vectors at most. Every vector of the table is put in the leaf that greedy descent finds. A query walks the tree best bin first: a priority queue holds
the nodes seen so far by the distance to their centres, and gives leaves in that order. How many leaves a query visits is calibrated: on vectors of
the sample that the tree was not fitted on, visits widen until the mean recall against brute force over the sample reaches `recall`. A query visits on
until its leaves hold more than k rows.

The sample bounds the leaves, so leaves grow with the table. A leaf of more than `split` vectors is therefore split by a second level: a
k-means tree of its own, fitted on `split` of its vectors at most where these lie, into cells of about `cell` vectors. A query that visits such a leaf walks that tree too,
and visits the share of its cells that is calibrated in the same way within the leaf.

Visits meet vectors by a grouped pass over blocks: a cell's vectors are cut into blocks of `block` rows at most by a hash of the row, and a
cell's queries into blocks too, so that a cell with a third of all rows, or of all queries, is many small groups. Each group hands on each query's
best k only, with exact distances in double precision, and a last pass merges a query's lists.

Defined results: vectors that are null, zero, hold null or non-finite components, or are of another dimension than most take no part, as query
or candidate; rows that repeat an id are rows of their own: each is a candidate, and each one that is a query has its own list; a query never finds
its own row; rows of a null id are candidates, after others of the same distance; ties go to the smaller id; a distance that overflows counts as
infinite; fewer than k candidates are all returned (then every leaf is visited); an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispark.llm.common import materialize, ship

#: Vectors that the tree is fitted on at most, those of the smallest hashes.
SAMPLE = 20_000
BLOCK = 4096
QUERY_BLOCK = 512
#: Leaves of more vectors than this are split into cells, by a tree fitted on as many of them.
SPLIT = 8192
#: Orders rows without an id after all others.
_NO_ID = (1 << 63) - 1


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, steps: int = 8) -> tuple[np.ndarray, np.ndarray]:
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(steps):
        near = _nearest(x, centres)
        for j in range(k):
            if (mine := x[near == j]).size:
                centres[j] = mine.mean(0)
    return centres, _nearest(x, centres)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (((centres**2).sum(1)[None, :]) - 2 * x @ centres.T).argmin(1)


@dataclass
class Tree:
    """Nodes as arrays: a node's children are first[i] .. first[i] + count[i] - 1; a leaf has count 0 and a number."""

    centres: np.ndarray
    first: np.ndarray
    count: np.ndarray
    leaf: np.ndarray

    @property
    def n_leaves(self) -> int:
        return int(self.leaf.max()) + 1

    @classmethod
    def fit(cls, x: np.ndarray, branch: int = 12, leaf: int = 64, seed: int = 5) -> Tree:
        rng = np.random.default_rng(seed)
        centres, first, count, leaves = [x.mean(0)], [0], [0], [-1]
        todo, n = [(0, np.arange(len(x)))], 0
        while todo:
            node, mine = todo.pop(0)
            parts = None
            if len(mine) > leaf:
                own, near = _kmeans(x[mine], min(branch, len(mine)), rng)
                parts = [(own[j], mine[near == j]) for j in range(len(own)) if (near == j).any()]
            if parts is None or len(parts) < 2:  # few, or all alike
                leaves[node], n = n, n + 1
                continue
            first[node], count[node] = len(centres), len(parts)
            for centre, part in parts:
                todo.append((len(centres), part))
                centres.append(centre)
                first.append(0)
                count.append(0)
                leaves.append(-1)
        return cls(np.array(centres), np.array(first), np.array(count), np.array(leaves))

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector, by greedy descent."""
        node = np.zeros(len(x), np.int64)
        while (open_ := np.nonzero(self.count[node] > 0)[0]).size:
            for parent in np.unique(node[open_]).tolist():
                at = open_[node[open_] == parent]
                a = int(self.first[parent])
                node[at] = a + _nearest(x[at], self.centres[a : a + int(self.count[parent])])
        return self.leaf[node]

    def visits(self, q: np.ndarray, most: int, sizes: np.ndarray | None = None, need: int = 0) -> list[int]:
        """The first `most` leaves of a best-bin-first walk, and on until they hold `need` vectors; `sizes` says how many each leaf has."""
        out: list[int] = []
        held = 0
        heap = [(0.0, 0)]
        while heap and (len(out) < most or held < need):
            _, node = heapq.heappop(heap)
            if self.count[node] == 0:
                out.append(int(self.leaf[node]))
                held += int(sizes[out[-1]]) if sizes is not None else 0
                continue
            a = int(self.first[node])
            near = ((self.centres[a : a + int(self.count[node])] - q) ** 2).sum(1)
            for j, d in enumerate(near.tolist()):
                heapq.heappush(heap, (d, a + j))
        return out


def calibrate(tree: Tree, x: np.ndarray, k: int, recall: float, probes: int) -> int:
    """The fewest leaves with which the first `probes` vectors of x find that share of their true k neighbours among the others."""
    if len(x) <= k + 1 or not probes:
        return tree.n_leaves
    leaf = tree.assign(x)
    ranks = []
    for i in range(min(probes, len(x))):
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = np.inf
        walk = np.empty(tree.n_leaves, np.int64)
        walk[tree.visits(x[i], tree.n_leaves)] = np.arange(tree.n_leaves)
        ranks.append(walk[leaf[np.lexsort((np.arange(len(x)), d))[:k]]])
    needed = np.sort(np.concatenate(ranks))
    return int(needed[min(len(needed) - 1, max(0, int(np.ceil(recall * len(needed))) - 1))]) + 1


def fit(x: np.ndarray, k: int, recall: float, probes: int = 200, **params) -> tuple[Tree, int]:
    """The tree of distinct vectors in random order, and how many leaves to visit. The first ones, at most a tenth, are held out of the fit as probes.

    Distinct, because copies move no border, and as probes they would find each other in a single leaf.
    """
    held = min(probes, len(x) // 10)
    tree = Tree.fit(x[held:], **params)
    return tree, calibrate(tree, x, k, recall, held)


def valid_vectors(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """row (unique), vec_id and v (array<double>) of the rows that take part, written."""
    v = F.col(vec_col).cast("array<double>")
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("v").isNotNull())
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    rows = rows.filter(F.size("v") == (sizes[0]["n"] if sizes else 0))
    return materialize(rows.withColumn("row", F.monotonically_increasing_id()).select("row", "vec_id", "v"), "vectors")


def _matrix(values: pd.Series) -> np.ndarray:
    return np.stack(values.to_numpy()).astype(np.float64)


def build(rows: DataFrame, k: int, recall: float, sample: int = SAMPLE) -> tuple[Tree, int]:
    """The tree and the number of leaves to visit, from `sample` distinct vectors at most: those of the smallest hashes."""
    h = F.xxhash64("v").alias("h")
    last = rows.select(h).distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    chosen = rows.select(h, "v").filter(F.col("h") <= last).groupBy("h").agg(F.first("v").alias("v")).collect()
    return fit(np.array([r["v"] for r in sorted(chosen, key=lambda r: r["h"])]), k, recall)


def _placed(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(leaf=shared.value.assign(_matrix(batch["v"])))

    return run


def _walks(shared, most: int, need: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, sizes = shared.value
        for batch in batches:
            if len(batch):
                yield batch.assign(leaves=[tree.visits(q, most, sizes, need) for q in _matrix(batch["v"])])

    return run


def _fit_leaf(k: int, recall: float, split: int, cell: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = _matrix(rows.sort_values("h")["v"].head(split))
        tree, most = fit(x, k, recall, leaf=cell)
        return pd.DataFrame({"leaf": [key[0]], "tree": [pickle.dumps(tree)], "most": [most]})

    return run


def _cells_of_rows(key: tuple, rows: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
    cell = pickle.loads(trees["tree"].iloc[0]).assign(_matrix(rows["v"])) if len(rows) else np.array([], np.int64)
    v = rows["v"].astype(object)
    return pd.DataFrame({"row": rows["row"], "vec_id": rows["vec_id"], "v": v, "leaf": np.full(len(rows), key[0], np.int64), "cell": cell})


def _cells_of_queries(need: int):
    def run(key: tuple, queries: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
        out = {"query_row": [], "query_id": [], "v": [], "leaf": [], "cell": []}
        if len(queries):
            tree, most = pickle.loads(trees["tree"].iloc[0]), int(trees["most"].iloc[0])
            sizes = np.zeros(tree.n_leaves, np.int64)
            for x in trees["sizes"].iloc[0]:
                sizes[x["cell"]] = x["n"]
            for row, query, v in zip(queries["query_row"], queries["query_id"], queries["v"], strict=True):
                for c in tree.visits(np.asarray(v), most, sizes, need):
                    for name, value in zip(out, (row, query, v, key[0], c), strict=True):
                        out[name].append(value)
        return pd.DataFrame({name: pd.Series(values, dtype=object if name == "v" else np.int64) for name, values in out.items()})

    return run


def _spread(key: str, salt: int, n: Column) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(salt)), n)


def _split(rows: DataFrame, visits: DataFrame, sizes: DataFrame, k: int, recall: float, split: int, cell: int, block: int) -> tuple[DataFrame, DataFrame]:
    """`rows` and `visits` with the cell of their leaf; visits to a large leaf become visits to cells of it. `sizes` has a row per leaf."""
    large = sizes.filter(F.col("n") > split).select(F.col("leaf").alias("__leaf"), "n", "different", F.ceil(F.col("n") / block).alias("parts"))
    large = F.broadcast(materialize(large, "large"))  # fewer than the tree has leaves
    mine = rows.join(large, F.col("leaf") == F.col("__leaf"))
    # distinct vectors, twice the wanted share by hash, so that the cut at `split` rarely falls short
    some = mine.withColumn("h", F.xxhash64("v")).filter(F.pmod("h", F.lit(1 << 30)) < F.lit(2.0 * split * (1 << 30)) / F.col("different"))
    some = some.groupBy("leaf", "h").agg(F.first("v").alias("v"))
    trees = some.groupBy("leaf").applyInPandas(_fit_leaf(k, recall, split, cell), "leaf long, tree binary, most long")
    trees = materialize(trees, "trees")
    # a tree goes to each part of its leaf
    for_rows = trees.join(large, F.col("leaf") == F.col("__leaf")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    mine = mine.withColumn("part", _spread("row", 3, F.col("parts"))).select("leaf", "part", "row", "vec_id", "v")
    placed = mine.groupBy("leaf", "part").cogroup(for_rows.select("leaf", "part", "tree").groupBy("leaf", "part"))
    placed = materialize(placed.applyInPandas(_cells_of_rows, "row long, vec_id long, v array<double>, leaf long, cell long"), "cells")
    counted = placed.groupBy("leaf", "cell").agg(F.count(F.lit(1)).alias("n"))
    filled = counted.groupBy("leaf").agg(F.collect_list(F.struct("cell", "n")).alias("sizes"))  # no more than a tree's leaves
    for_visits = trees.join(filled.withColumnRenamed("leaf", "__l"), F.col("leaf") == F.col("__l")).crossJoin(F.broadcast(_parts(rows.sparkSession)))
    asking = visits.join(large, F.col("leaf") == F.col("__leaf")).withColumn("part", _spread("query_row", 4, F.lit(PARTS)))
    walked = asking.select("leaf", "part", "query_row", "query_id", "v").groupBy("leaf", "part")
    walked = walked.cogroup(for_visits.select("leaf", "part", "tree", "most", "sizes").groupBy("leaf", "part"))
    walked = walked.applyInPandas(_cells_of_queries(k + 1), "query_row long, query_id long, v array<double>, leaf long, cell long")
    small = lambda df: df.join(large, F.col("leaf") == F.col("__leaf"), "left_anti").withColumn("cell", F.lit(0).cast("long"))
    return small(rows).unionByName(placed), materialize(small(visits).unionByName(walked), "cell_visits")


#: Groups that the queries of a large leaf walk its tree in.
PARTS = 16


def _parts(spark) -> DataFrame:
    return spark.range(PARTS).withColumnRenamed("id", "part")


def _block_search(k: int):
    def run(key: tuple, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found = {"query_row": [], "query_id": [], "row": [], "vec_id": [], "score": []}
        if len(queries) and len(rows):
            x, ids, numbers = _matrix(rows["v"]), rows["vec_id"].to_numpy(), rows["row"].to_numpy()
            # rows by the order that decides ties: a stable sort by distance keeps it
            tied = np.lexsort((numbers, ids))
            x, ids, numbers = x[tied], ids[tied], numbers[tied]
            asked = _matrix(queries["v"])
            of, by = queries["query_row"].to_numpy(), queries["query_id"].to_numpy()
            step = max(1, (1 << 21) // x.size)
            for at in range(0, len(asked), step):
                with np.errstate(over="ignore"):
                    scores = np.sqrt(((x[None, :, :] - asked[at : at + step, None, :]) ** 2).sum(2))
                for i, score in enumerate(scores, at):
                    near = np.nonzero(score <= np.partition(score, k)[k])[0] if len(score) > k + 1 else np.arange(len(score))
                    top = near[np.argsort(score[near], kind="stable")][: k + 1]
                    top = top[numbers[top] != of[i]][:k]
                    for name, values in zip(found, (np.full(len(top), of[i]), np.full(len(top), by[i]), numbers[top], ids[top], score[top]), strict=True):
                        found[name].append(values)
        return pd.DataFrame({name: np.concatenate(v) if v else np.array([], float if name == "score" else np.int64) for name, v in found.items()})

    return run


def search(table: DataFrame, queries: DataFrame, k: int = 10, recall: float = 0.97, sample: int = SAMPLE, block: int = BLOCK, query_block: int = QUERY_BLOCK,
           split: int = SPLIT, cell: int = 64) -> DataFrame:
    """query_row, query_id, rank, vec_id, score: the k nearest rows found of `table` for each row of `queries`.

    Both have row, vec_id and v, as `valid_vectors` gives them; a row of `queries` doesn't find the one of `table` with the same `row`.
    """
    spark = table.sparkSession
    ship(spark)
    tree, most = build(table, k, recall, sample) if table.take(1) else (Tree.fit(np.zeros((1, 1))), 1)
    shared = spark.sparkContext.broadcast(tree)  # at most 2 * SAMPLE centres
    known = table.select("row", F.coalesce("vec_id", F.lit(_NO_ID)).alias("vec_id"), "v")
    rows = materialize(known.mapInPandas(_placed(shared), "row long, vec_id long, v array<double>, leaf long"), "index")
    sizes = rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(F.xxhash64("v")).alias("different"))
    sizes = materialize(sizes, "sizes")
    # a number for each leaf
    held = np.zeros(tree.n_leaves, np.int64)
    for r in sizes.collect():
        held[r["leaf"]] = r["n"]
    most = tree.n_leaves if held.sum() <= k + 1 else most
    asked = queries.select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"), "v")
    walks = asked.mapInPandas(_walks(spark.sparkContext.broadcast((tree, held)), most, k + 1), "query_row long, query_id long, v array<double>, leaves array<long>")
    visits = materialize(walks, "walks").select("query_row", "query_id", "v", F.explode("leaves").alias("leaf"))
    if held.max() > split:
        rows, visits = _split(rows, visits, sizes, k, min(1.0, recall + 0.015), split, cell, block)
    else:
        rows, visits = rows.withColumn("cell", F.lit(0).cast("long")), visits.withColumn("cell", F.lit(0).cast("long"))
    # one row per cell: bounded by the trees
    blocks = rows.groupBy("leaf", "cell").agg(F.ceil(F.count(F.lit(1)) / block).alias("row_blocks"))
    wanted = visits.groupBy("leaf", "cell").agg(F.ceil(F.count(F.lit(1)) / query_block).alias("query_blocks"))
    plan = materialize(blocks.join(wanted, ["leaf", "cell"]), "blocks")
    left = visits.join(plan, ["leaf", "cell"]).withColumn("qb", _spread("query_row", 1, F.col("query_blocks")))
    left = left.withColumn("rb", F.explode(F.sequence(F.lit(0), F.col("row_blocks") - 1))).select("leaf", "cell", "qb", "rb", "query_row", "query_id", "v")
    right = rows.join(plan, ["leaf", "cell"]).withColumn("rb", _spread("row", 2, F.col("row_blocks")))
    right = right.withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1))).select("leaf", "cell", "qb", "rb", "row", "vec_id", "v")
    key = ["leaf", "cell", "qb", "rb"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(_block_search(k), "query_row long, query_id long, row long, vec_id long, score double")
    order = Window.partitionBy("query_row").orderBy("score", "vec_id", "row")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_row", "query_id", "rank", F.nullif("vec_id", F.lit(_NO_ID)).alias("vec_id"), "score")


def digest(embeddings: DataFrame, every: int = 100) -> DataFrame:
    rows = valid_vectors(embeddings)
    return search(rows, rows.filter(F.col("vec_id") % every == 0)).select("query_id", "rank", "vec_id", "score")
