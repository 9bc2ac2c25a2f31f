"""Approximate nearest neighbours: an inverted file scanned by adaptive dimensions.

Vectors are lengthened by one coordinate that gives all the same norm, so the largest inner product is the smallest
distance, and turned by a random rotation. k-means on a bounded sample gives the lists; every vector goes to one.
A query probes the nearest lists, as many as it takes: a sample of the queries is answered by brute force over all
vectors, and the lists that hold their true neighbours tell how many must be probed for the recall asked for (all, if
need be, as for isotropic vectors of many dimensions). A query that has found fewer than it should then probes the rest.

Lists near each other form blocks of a bounded number of rows. A query is sent once to each block with a list that it
probes, first to those of its nearest lists; what it finds there bounds the distance of what it still looks for, and
goes on with it to the others. Within a list, columns are read in blocks: after each, a hypothesis test on the partial
distance abandons the candidates that can hardly be nearer than the bound, for many queries at once as long as any of
them keeps a candidate. The bound tightens with every part of a list that is read, so blocks give back few candidates.
Inner products of these are computed in double precision on the original vectors.

Blocks over a target size are dealt into chunks of it by a hash of the id, so a vector that a third of the rows repeat
fills many chunks and no task holds a whole list; many queries of one block are dealt likewise. Centroids, rotation and
the counts by list have sizes fixed by the parameters and are broadcast.

Cases: rows without an id take no part, nor do vectors that are null or zero, or have a null or non-finite component or
another length than most rows have (of equally frequent lengths the smaller). A query has fewer rows if there are fewer
candidates. Ties go to the smaller id. Rows that repeat an id are candidates each, and the query's own id never is;
repeated rows of one query are one query, and different vectors under one id are queries each. Without vectors there are
no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written


@dataclass(frozen=True)
class NeighbourParameters:
    k: int = 20
    sample_rows: int = 32768  # the bound on rows that the index is fitted on
    rows_per_list: int = 256
    max_lists: int = 4096  # beyond this, lists grow
    probes: int = 24  # lists probed at least
    first: int = 8  # of them, those that give the first bound
    recall: float = 0.95  # of the true neighbours, those that the probed lists must hold
    tried: int = 256  # queries answered by brute force to measure it
    block_rows: int = 16384  # rows of lists, and queries, that meet at once
    part_rows: int = 512  # of a list, read between two updates of the bound
    block: int = 16  # columns read between two tests
    epsilon: float = 2.1  # of the hypothesis test: larger abandons less
    iterations: int = 8
    seed: int = 11


@dataclass(frozen=True)
class Index:
    rotation: np.ndarray
    centroids: np.ndarray
    longest: float  # the largest squared norm

    def place(self, x: np.ndarray) -> np.ndarray:
        """Vectors as points whose distances order inner products."""
        rest = np.sqrt(np.maximum(self.longest - (x * x).sum(1), 0))
        return np.hstack([x, rest[:, None]]) @ self.rotation

    def place_query(self, q: np.ndarray) -> np.ndarray:
        return np.hstack([q, np.zeros((len(q), 1))]) @ self.rotation

    def distances(self, points: np.ndarray) -> np.ndarray:
        return (self.centroids**2).sum(1) - 2 * points @ self.centroids.T


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


def _matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    lists = batch.column(column)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def build(rows: DataFrame, p: NeighbourParameters) -> Index | None:
    """rows: id, v. Fits on at most about p.sample_rows rows."""
    n, longest, width = rows.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)), F.max(F.size("v"))).first()
    if not n:
        return None
    share = min(1.0, p.sample_rows / n)
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share * (1 << 30)).orderBy("id") if share < 1 else rows.orderBy("id")
    x = np.array(sample.select("v").limit(2 * p.sample_rows).toArrow().column("v").to_pylist(), np.float64).reshape(-1, width)
    rng = np.random.default_rng(p.seed)
    rotation, _ = np.linalg.qr(rng.normal(size=(width + 1, width + 1)))
    index = Index(rotation, np.zeros((1, width + 1)), longest)
    points = np.unique(index.place(x if len(x) else np.ones((1, width))), axis=0)
    lists = max(1, min(p.max_lists, math.ceil(n / p.rows_per_list), len(points)))
    index = Index(rotation, points[rng.choice(len(points), lists, replace=False)], longest)
    for _ in range(p.iterations):
        near = index.distances(points).argmin(1)
        counts = np.bincount(near, minlength=lists)
        sums = np.zeros_like(index.centroids)
        np.add.at(sums, near, points)
        index = Index(rotation, np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], index.centroids), longest)
    return index


def scan(points: np.ndarray, queries: np.ndarray, bound: np.ndarray, block: int, epsilon: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (row of points, row of queries) that may lie within the queries' bounds, and their squared distances.

    Partial distances over ever more columns; a pair is abandoned when the test says that it can hardly stay within the
    bound, and rows and queries without a pair left are read no further.
    """
    width = points.shape[1]
    rows, cols = np.arange(len(points)), np.arange(len(queries))
    partial = np.zeros((len(points), len(queries)))
    for at in range(0, width, block):
        x, q = points[rows, at : at + block], queries[cols, at : at + block]
        partial += (x * x).sum(1)[:, None] + (q * q).sum(1) - 2 * x @ q.T
        seen = min(at + block, width)
        slack = 1 + 1e-9 if seen == width else seen / width * (1 + epsilon / math.sqrt(seen)) ** 2
        keep = partial <= bound[cols] * slack + 1e-9
        use_r, use_c = keep.any(1), keep.any(0)
        partial[~keep] = np.inf
        if not use_r.all() or not use_c.all():
            rows, cols, partial = rows[use_r], cols[use_c], partial[np.ix_(use_r, use_c)]
        if not len(rows):
            break
    r, c = np.nonzero(partial < np.inf)
    return rows[r], cols[c], partial[r, c]


def probes_needed(placed: DataFrame, asked: DataFrame, index: Index, p: NeighbourParameters) -> int:
    """The least number of nearest lists that hold p.recall of the true neighbours, by two standard errors, of at most p.tried queries.

    placed: id, v, list; asked: id, v. All vectors are read; k rows a query reach the driver.
    """
    lists = len(index.centroids)
    if lists <= p.probes:
        return lists
    tried = asked.orderBy(F.xxhash64("id", F.lit(p.seed)), "id").limit(p.tried).toArrow().combine_chunks().to_batches()
    if not tried:
        return p.probes
    ids, q = tried[0].column("id").to_numpy(), _matrix(tried[0], "v")
    shared = placed.sparkSession.sparkContext.broadcast((ids, q))

    def nearest(batches):
        ids, q = shared.value
        for batch in batches:
            if batch.num_rows:
                own = batch.column("id").to_numpy()
                scores = q @ _matrix(batch, "v").T
                scores[ids[:, None] == own] = -np.inf
                n = min(p.k, batch.num_rows)
                at = np.argpartition(-scores, n - 1, axis=1)[:, :n]
                found = np.take_along_axis(scores, at, 1).ravel()
                use = np.flatnonzero(found > -np.inf)
                at, of = at.ravel()[use], np.repeat(np.arange(len(q)), n)[use]
                yield pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), pa.array(own[at]), batch.column("list").take(pa.array(at)), pa.array(found[use])], names=["q", "id", "list", "score"])

    order = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    true = placed.mapInArrow(nearest, "q int, id long, list int, score double").withColumn("n", F.row_number().over(order)).where(F.col("n") <= p.k).select("q", "list").toArrow()  # k rows for each of p.tried
    of, held = true.column("q").to_numpy(), true.column("list").to_numpy()
    if not len(of):
        return p.probes
    place = np.argsort(np.argsort(index.distances(index.place_query(q)), axis=1, kind="stable"), axis=1)
    have = np.bincount(of, minlength=len(q))
    # by[i, n]: the share of query i's true neighbours in its n + 1 nearest lists
    by = np.zeros((len(q), lists))
    np.add.at(by, (of, place[of, held]), 1)
    by = by[have > 0].cumsum(1) / have[have > 0, None]
    sure = by.mean(0) - 2 * by.std(0) / math.sqrt(len(by))
    return max(p.probes, min(lists, int((sure < p.recall).sum()) + 1))


def _blocks_of_lists(index: Index, sizes: np.ndarray, p: NeighbourParameters) -> np.ndarray:
    """The block of each list: near lists together, of about as many rows as a block should have."""
    order, todo = [], [np.arange(len(index.centroids))]
    while todo:
        part = todo.pop()
        if len(part) == 1:
            order.append(part[0])
            continue
        own = index.centroids[part]
        part = part[np.argsort(own[:, own.var(0).argmax()], kind="stable")]
        todo += [part[len(part) // 2 :], part[: len(part) // 2]]
    block = np.zeros(len(order), np.int32)
    block[order] = (np.cumsum(sizes[order]) - 1) // p.block_rows
    return block


def search(vectors: DataFrame, queries: DataFrame, p: NeighbourParameters | None = None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k rows of largest inner product, as far as the index finds them."""
    p = p or NeighbourParameters()
    spark = vectors.sparkSession
    clean = lambda df: df.where(F.col(key).isNotNull() & usable(F.col(vector))).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))
    found, asked = clean(vectors), clean(queries)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = found.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").first()
    if width is None:
        return empty
    found, asked = found.where(F.size("v") == width[0]), asked.where(F.size("v") == width[0])
    asked = asked.withColumn("h", F.xxhash64("v")).dropDuplicates(["id", "h"])
    index = build(found, p)
    shared = spark.sparkContext.broadcast(index)
    kind = vectors.schema[vector].dataType.simpleString()

    def to_lists(batches):
        index = shared.value
        for batch in batches:
            if batch.num_rows:
                near = index.distances(index.place(_matrix(batch, "v"))).argmin(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32())], names=["id", "v", "list"])

    placed = written(found.mapInArrow(to_lists, f"id long, v {kind}, list int"), "lists")
    probes = probes_needed(placed, asked.select("id", "v"), index, p)
    lists = len(index.centroids)
    sizes = np.zeros(lists, np.int64)
    for r in placed.groupBy("list").count().collect():  # a row for each list at most
        sizes[r[0]] = r[1]
    blocks = _blocks_of_lists(index, sizes, p)
    rows_in = np.bincount(blocks, sizes)
    in_block = spark.sparkContext.broadcast(blocks)

    def round_of(asked: DataFrame, low: int, high: int) -> DataFrame:
        """query, h, vec_id, score: the best of each block among the lists from the low-th nearest to before the high-th.

        asked: id, h, v and least, the score that a candidate must reach (null: none).
        """

        def to_blocks(batches):
            index, blocks = shared.value, in_block.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                d = index.distances(index.place_query(_matrix(batch, "v")))
                near = np.argsort(d, axis=1, kind="stable")[:, low:high]
                query = np.repeat(np.arange(batch.num_rows), near.shape[1])
                order = np.lexsort((near.ravel(), blocks[near.ravel()], query))
                one, at = near.ravel()[order], query[order]
                new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (blocks[one[1:]] != blocks[one[:-1]])]))
                probed = pa.ListArray.from_arrays(pa.array(np.append(new, len(one)).astype(np.int32)), pa.array(one.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at[new])) for c in batch.columns), probed, pa.array(blocks[one[new]], pa.int32())], names=["id", "h", "v", "least", "probed", "block"])

        probing = asked.select("id", "h", "v", "least").mapInArrow(to_blocks, f"id long, h long, v {kind}, least double, probed array<int>, block int")
        # a row for each block, of which the parameters bound the number: chunks of candidates and of queries
        many = {r[0]: r[1] for r in probing.groupBy("block").count().collect()}
        deals = [(b, max(1, math.ceil(n / p.block_rows)), max(1, math.ceil(many.get(b, 0) / p.block_rows))) for b, n in enumerate(rows_in) if many.get(b)]
        dealt = F.broadcast(spark.createDataFrame(deals, "block int, chunks int, shares int"))
        of_list = F.broadcast(spark.createDataFrame(list(enumerate(blocks.tolist())), "list int, block int"))  # a row for each list
        left = placed.join(of_list, "list").join(dealt, "block").select("block", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int").alias("chunk"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), "list", "id", "v")
        right = probing.join(dealt, "block").select(F.col("block").alias("qb"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("qc"), F.pmod(F.xxhash64("id", "h"), F.col("shares")).cast("int").alias("qs"), "id", "h", "v", "least", "probed")

        def meet(_, left, right):
            nothing = pa.table({"query": pa.array([], pa.int64()), "h": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
            if not left.num_rows or not right.num_rows:
                return nothing
            index = shared.value
            left = left.sort_by([("list", "ascending"), ("id", "ascending")]).combine_chunks().to_batches()[0]
            right = right.combine_chunks().to_batches()[0]
            x, q = _matrix(left, "v"), _matrix(right, "v")
            ids, asking, list_of = (c.to_numpy() for c in (left.column("id"), right.column("id"), left.column("list")))
            points, turned = index.place(x), index.place_query(q)
            square = (turned * turned).sum(1)
            least = right.column("least").to_numpy(zero_copy_only=False)
            limit = np.where(np.isnan(least), np.inf, square + index.longest - 2 * np.nan_to_num(least))
            limit = limit + 1e-9 * (1 + np.where(np.isinf(limit), 0, limit))
            best = np.repeat(limit[:, None], p.k, axis=1)  # each query's k smallest distances, no larger than its limit
            probed = right.column("probed")
            of_query, of_list = np.repeat(np.arange(len(q)), np.diff(probed.offsets.to_numpy())), probed.flatten().to_numpy()
            order = np.argsort(of_list, kind="stable")
            of_query, of_list = of_query[order], of_list[order]
            kept = []
            cuts = np.flatnonzero(np.concatenate([[True], list_of[1:] != list_of[:-1]]))
            for a, b in zip(cuts, [*cuts[1:], len(list_of)], strict=True):
                mine = of_query[np.searchsorted(of_list, list_of[a]) : np.searchsorted(of_list, list_of[a], "right")]
                for c in range(0, len(mine), 2048):
                    own = mine[c : c + 2048]
                    for at in range(a, b, p.part_rows):
                        end = min(at + p.part_rows, b)
                        r, s, d = scan(points[at:end], turned[own], best[own].max(1), p.block, p.epsilon)
                        other = ids[at + r] != asking[own[s]]
                        r, s, d = at + r[other], s[other], d[other]
                        if len(r):
                            kept.append((r, own[s], d))
                            wide = np.full((len(own), int(np.bincount(s).max())), np.inf)
                            by = np.argsort(s, kind="stable")
                            first = np.searchsorted(s[by], s[by])
                            wide[s[by], np.arange(len(by)) - first] = d[by]
                            best[own] = np.partition(np.hstack([best[own], wide]), p.k - 1, axis=1)[:, : p.k]
            if not kept:
                return nothing
            r, s, d = (np.concatenate(z) for z in zip(*kept, strict=True))
            use = d <= best[s].max(1) * (1 + 1e-9) + 1e-9
            r, s = r[use], s[use]
            scores = np.einsum("ij,ij->i", x[r], q[s])
            order = np.lexsort((ids[r], -scores, s))
            r, s, scores = r[order], s[order], scores[order]
            rank = np.arange(len(s)) - np.searchsorted(s, s)
            r, s, scores = r[rank < p.k], s[rank < p.k], scores[rank < p.k]
            return pa.table({"query": asking[s], "h": right.column("h").to_numpy()[s], "vec_id": ids[r], "score": scores})

        return left.groupBy("block", "chunk", "share").cogroup(right.groupBy("qb", "qc", "qs")).applyInArrow(meet, "query long, h long, vec_id long, score double")

    def ranked(met: DataFrame) -> DataFrame:
        order = Window.partitionBy("query", "h").orderBy(F.desc("score"), "vec_id")
        return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= p.k)

    def bounded(asked: DataFrame, top: DataFrame) -> DataFrame:
        """asked with the score of the k-th found, if there are k."""
        kth = top.where(F.col("rank") == p.k).select(F.col("query").alias("id"), "h", F.col("score").alias("least"))
        return asked.select("id", "h", "v").join(kth, ["id", "h"], "left")

    asked = written(asked, "queries")
    first = min(p.first, probes)
    top = written(ranked(round_of(asked.withColumn("least", F.lit(None).cast("double")), 0, first)), "near")
    if first < probes:
        more = round_of(bounded(asked, top), first, probes)
        top = written(ranked(top.drop("rank").unionByName(more)), "near")
    if probes < lists:
        short = asked.join(top.where(F.col("rank") == p.k).select(F.col("query").alias("id"), "h"), ["id", "h"], "left_anti")
        short = written(short, "short")
        if not short.isEmpty():
            more = round_of(short.withColumn("least", F.lit(None).cast("double")), probes, lists)
            top = written(ranked(top.drop("rank").unionByName(more)), "near")
    return top.select(F.col("query").alias("query_id"), "rank", "vec_id", "score")


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every row whose vec_id is divisible by 20, among all other rows."""
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where(F.pmod("vec_id", F.lit(20)) == 0))
