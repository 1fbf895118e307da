"""Nearest neighbours by largest inner product with an adaptive scan over dimensions.

Vectors are dealt into lists around centroids (fitted on a bounded sample). A query probes the
`probes` share of lists whose centroids promise most, and each further list unless the angles and lengths of its
vectors rule out that one reaches the query's bar. Vectors and queries, at unit length, are turned by a random
rotation and scanned in blocks of columns. After every block a hypothesis test abandons candidates. A rotation spreads
the difference of any two vectors evenly, however the vectors lie: d of D columns hold d/D of its square, with
deviation sqrt(2 d (D - d) / (D + 2)) / D. A candidate whose cosine reaches what the bar asks of a vector of its
length differs by at most 2 - 2 cosines in square; it stays while the columns seen hold no more of that than their
share and `z` deviations, and goes for certain once the columns left cannot make up for what is missing.

The bar is set before the lists are scanned: a query's `k`-th best among a few thousand reference vectors of the
sample. These count as found, whatever lists it probes. While a test leaves many
candidates, the next block of columns is computed for the whole strip at once, later for what is left.

A list and its queries meet in blocks: lists are cut into shards of at most SHARD vectors, queries of a list
into groups of at most GROUP, so no task gathers a whole list. Shards give each query its best k; the
best k of these are ranked by exact scores on the original vectors, ties to the smaller id.

Vectors that are null, zero or hold null or non-finite components take no part, nor do rows without an id or of
another length than most. Rows that share an id count once, with the best score, and never for their own query:
equal rows are folded first, and every bar is that of the `k`-th best id, not row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartlens.llm.common import pick, stage

K = 20
EVERY = 20
SAMPLE = 20_000
MAX_LISTS = 1024
PROBES = 0.9
Z = 4.0
# What rounding may take from a cosine.
ROUNDING = 1e-9
COLUMNS = 16
REFERENCES = 4_096
# Lists per square root of the number of vectors.
LISTS = 0.25
# Share of candidates above which the next block is computed for all of a strip.
DENSE = 0.1
SHARD = 20_000
GROUP = 1_000
STRIP = 2_048
SEED = 11

FOUND = "query_id long, vec_id long, score double"


@dataclass
class Index:
    rotation: np.ndarray
    centroids: np.ndarray
    reference_ids: np.ndarray
    references: np.ndarray

    @property
    def lists(self) -> int:
        return len(self.centroids)

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """The list of each vector: the centroid with the smallest angle."""
        return (x @ self.centroids.T).argmax(axis=1)

    def probed(self, x: np.ndarray, probes: float) -> np.ndarray:
        """Places of the best `probes` share of lists for each vector, as a mask."""
        n = max(1, math.ceil(self.lists * probes))
        mask = np.zeros((len(x), self.lists), bool)
        np.put_along_axis(mask, np.argsort(-(x @ self.centroids.T), axis=1, kind="stable")[:, :n], True, axis=1)
        return mask

    def most(self, x: np.ndarray, spans: np.ndarray) -> np.ndarray:
        """The largest inner product that a vector of each list can have with each of `x`.

        `spans` has the smallest cosine to the centroid, the smallest and the largest length of each list."""
        lowest, shortest, longest = spans
        length = lengths(x)[:, None]
        apart = np.arccos(np.clip(x / length @ self.centroids.T, -1, 1)) - np.arccos(np.clip(lowest, -1, 1))
        cosine = np.cos(np.maximum(apart, 0)) + ROUNDING
        return length * np.where(cosine > 0, cosine * longest, cosine * shortest)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the rows that take part."""
    rows = pick(vectors, vec_id="long", embedding="array<double>").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(good & F.exists("embedding", lambda x: x != 0))
    most = rows.groupBy(F.size("embedding").alias("n")).count().agg(F.max_by("n", F.struct("count", "n"))).scalar()
    return rows.where(F.size("embedding") == most)


def fit(vectors: DataFrame, sample: int = SAMPLE, lists: int | None = None) -> Index | None:
    """A rotation and centroids from up to `sample` vectors, drawn by a hash of the row; references sorted by id."""
    n = vectors.count()
    if not n:
        return None
    draw = F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(1 << 40)) / float(1 << 40)
    drawn = vectors.withColumn("draw", draw).where(F.col("draw") <= min(1.0, 1.1 * sample / n + 0.001))
    rows = drawn.orderBy("draw", "vec_id", "embedding").limit(sample).select("vec_id", "embedding").collect()
    rows = rows or vectors.select("vec_id", "embedding").limit(1).collect()
    x = np.array([r["embedding"] for r in rows])
    reference_ids = np.array([r["vec_id"] for r in rows[:REFERENCES]])
    by_id = np.argsort(reference_ids, kind="stable")
    reference_ids, references = reference_ids[by_id], x[:REFERENCES][by_id]
    random = np.random.default_rng(SEED)
    rotation = np.linalg.qr(random.normal(size=(x.shape[1], x.shape[1])))[0]
    x = x / lengths(x)[:, None]
    count = min(lists or math.ceil(LISTS * math.sqrt(n)), MAX_LISTS, len(x))
    centroids = x[random.choice(len(x), count, replace=False)]
    for _ in range(5):
        of = (x @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, of, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centroids)
    return Index(rotation, centroids, reference_ids, references)


def listed(vectors: DataFrame, index: Index) -> DataFrame:
    """vec_id, embedding, list, cosine to its centroid and length of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("embedding"), batch.num_rows)
            length, of = lengths(x), index.nearest(x)
            cosine = (x / length[:, None] * index.centroids[of]).sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("embedding"), pa.array(of.astype(np.int32)), pa.array(cosine), pa.array(length)],
                names=["vec_id", "embedding", "list", "cosine", "length"],
            )

    return vectors.mapInArrow(run, "vec_id long, embedding array<double>, list int, cosine double, length double")


def spans_of(dealt: DataFrame, index: Index) -> np.ndarray:
    """Smallest cosine, smallest and largest length of each list (one row of them for each of at most MAX_LISTS)."""
    spans = np.stack([np.ones(index.lists), np.zeros(index.lists), np.zeros(index.lists)])
    for row in dealt.groupBy("list").agg(F.min("cosine"), F.min("length"), F.max("length")).collect():
        spans[:, row[0]] = row[1:]
    return spans


def probing(queries: DataFrame, index: Index, spans: np.ndarray, probes: float, k: int) -> DataFrame:
    """vec_id, embedding, bar, probed lists and best references (ids, scores) of every query."""

    firsts = runs(index.reference_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, own = matrix(batch.column("embedding"), batch.num_rows), batch.column("vec_id").to_numpy()
            probed, bars, ids, scores = [], [], [], []
            for at in range(0, len(x), GROUP):
                q = x[at : at + GROUP]
                lists, most = index.probed(q, probes), index.most(q, spans)
                near = q @ index.references.T
                near[own[at : at + GROUP, None] == index.reference_ids[None]] = -np.inf
                of_ids = np.maximum.reduceat(near, firsts, axis=1)
                for row, best, mine, reach, vector in zip(near, of_ids, lists, most, q):
                    if len(best) >= k and np.isfinite(bar := np.partition(best, len(best) - k)[len(best) - k]):
                        bar -= 1e-9 * np.linalg.norm(vector) * np.linalg.norm(index.references, axis=1).max()
                    else:
                        bar = -np.inf
                    good = np.flatnonzero((row >= bar) & np.isfinite(row))
                    probed.append(np.flatnonzero(mine | ~(reach < bar)).astype(np.int32))
                    bars.append(bar)
                    exact, found = (vector * index.references[good]).sum(axis=1), index.reference_ids[good]
                    starts = runs(found)
                    ids.append(found[starts])
                    scores.append(np.maximum.reduceat(exact, starts) if len(starts) else exact)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id"), batch.column("embedding"), pa.array(bars, pa.float64()),
                    pa.array(probed, pa.list_(pa.int32())), pa.array(ids, pa.list_(pa.int64())),
                    pa.array(scores, pa.list_(pa.float64())),
                ],
                names=["vec_id", "embedding", "bar", "lists", "ids", "scores"],
            )

    schema = "vec_id long, embedding array<double>, bar double, lists array<int>, ids array<long>, scores array<double>"
    return queries.mapInArrow(run, schema)


def runs(ids: np.ndarray) -> np.ndarray:
    """Where each run of equal ids starts."""
    return np.flatnonzero(np.append(True, ids[1:] != ids[:-1])) if len(ids) else np.zeros(0, np.int64)


def lengths(x: np.ndarray) -> np.ndarray:
    """Length of each row, also where squares would leave the range of doubles."""
    most = np.abs(x).max(axis=1, initial=0)
    most[most == 0] = 1
    norms = np.linalg.norm(x / most[:, None], axis=1)
    return np.where(norms > 0, norms, 1) * most


def matrix(column: pa.ListArray, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def scan(queries, ids, vectors, own, rotation, k: int, z: float, bar=None):
    """Best k ids of one shard for each query: (query, place in the shard of the id's best row, exact score), in no order.

    Vectors come in strips. `bar` is what a query's candidates must reach; it rises with what is found.
    """
    long_q, long_x = lengths(queries), lengths(vectors)
    q, x = queries / long_q[:, None] @ rotation, vectors / long_x[:, None] @ rotation
    n_columns = q.shape[1]
    edges = [*range(0, n_columns, COLUMNS), n_columns]
    # Lengths of what is left from each edge on.
    left_q = np.stack([np.sqrt((q[:, e:] ** 2).sum(axis=1)) for e in edges], axis=1)
    left_x = np.stack([np.sqrt((x[:, e:] ** 2).sum(axis=1)) for e in edges], axis=1)
    # The most that the columns before each edge hold of a difference.
    shares = [e / n_columns + z * math.sqrt(2 * e * (n_columns - e) / (n_columns + 2)) / n_columns for e in edges]
    bar = np.full(len(q), -np.inf) if bar is None else bar.astype(np.float64).copy()
    kept_q, kept_x, kept_s = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    for at in range(0, len(x), STRIP):
        strip = slice(at, at + STRIP)
        part = np.zeros((len(q), len(ids[strip])))
        alive = own[:, None] != ids[strip][None]
        # The cosine that takes a vector of this length to the bar.
        need = (bar / long_q)[:, None] / long_x[strip][None]
        i = 0
        while i < len(edges) - 1 and alive.mean() > DENSE:
            a, b = edges[i], edges[i + 1]
            part += q[:, a:b] @ x[strip, a:b].T
            i += 1
            alive &= ~_missed(part, left_q[:, i][:, None], left_x[strip, i][None], need, shares[i])
        who, what = np.nonzero(alive)
        partial, need, what = part[who, what], need[who, what], what + at
        while i < len(edges) - 1:
            a, b = edges[i], edges[i + 1]
            partial = partial + np.einsum("ij,ij->i", q[who, a:b], x[what, a:b])
            i += 1
            stay = ~_missed(partial, left_q[who, i], left_x[what, i], need, shares[i])
            who, what, partial, need = who[stay], what[stay], partial[stay], need[stay]
        # Equal vectors must tie exactly: scores are summed anew, row by row, on the originals.
        exact = (queries[who] * vectors[what]).sum(axis=1)
        kept_q, kept_x, kept_s = np.append(kept_q, who), np.append(kept_x, what), np.append(kept_s, exact)
        # The best row of each id alone, so that rows of one id take one of the k places.
        order = np.lexsort((-kept_s, ids[kept_x], kept_q))
        of, by = ids[kept_x[order]], kept_q[order]
        order = order[np.append(True, (of[1:] != of[:-1]) | (by[1:] != by[:-1]))[: len(order)]]
        order = order[np.lexsort((ids[kept_x[order]], -kept_s[order], kept_q[order]))]
        kept_q, kept_x, kept_s = kept_q[order], kept_x[order], kept_s[order]
        rank = np.arange(len(kept_q)) - np.searchsorted(kept_q, np.arange(len(q)))[kept_q]
        top = rank < k
        kept_q, kept_x, kept_s, rank = kept_q[top], kept_x[top], kept_s[top], rank[top]
        last = rank == k - 1
        who = kept_q[last]
        bar[who] = np.maximum(bar[who], np.minimum(kept_s[last], np.finfo(np.float64).max))
    return kept_q, kept_x, kept_s


def _missed(part, left_q, left_x, need, share: float):
    """True where a cosine of which `part` is seen falls short of `need`: for certain, or by the share of the
    difference that was seen."""
    lost = part + left_q * left_x < need - ROUNDING
    seen = 1 - (left_q**2 + left_x**2) / 2 - part
    return lost | (seen > (np.maximum(1 - need, 0) + ROUNDING) * share + ROUNDING)


def neighbours(
    vectors: DataFrame, queries: DataFrame, k: int = K, probes: float = PROBES, z: float = Z, index: Index | None = None
) -> DataFrame:
    """query_id, rank, vec_id and score of the `k` best of `vectors` for each of `queries` (vec_id, embedding)."""
    vectors, queries = stage(usable(vectors).distinct(), "vectors"), usable(queries).distinct()
    index = index or fit(vectors)
    if index is None:
        empty = vectors.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
        return empty.where("false")
    dealt = stage(listed(vectors, index), "listed")
    asked_all = stage(probing(queries, index, spans_of(dealt, index), probes, k), "asking")
    asking = asked_all.select("vec_id", "embedding", "bar", F.explode("lists").alias("list"))
    # A number for each list: at most MAX_LISTS rows.
    sizes = dealt.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / SHARD).cast("int").alias("shards"))
    asked = asking.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("groups"))
    blocks = F.broadcast(stage(sizes.join(asked, "list"), "blocks"))
    # By the row: an id that stands in very many different rows is spread over shards and groups.
    lettered = lambda n, column: F.pmod(F.xxhash64("vec_id", "embedding"), F.col(n)).cast("int").alias(column)
    every = lambda n, column: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(column)
    left = dealt.join(blocks, "list").select("list", lettered("shards", "shard"), every("groups", "group"), "vec_id", "embedding")
    right = asking.join(blocks, "list").select("list", every("shards", "shard"), lettered("groups", "group"), "vec_id", "embedding", "bar")
    key = ["list", "shard", "group"]

    def search(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(q):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        ids, own = x["vec_id"].to_numpy(), q["vec_id"].to_numpy()
        found = scan(np.stack(q["embedding"]), ids, np.stack(x["embedding"]), own, index.rotation, k, z, q["bar"].to_numpy())
        return pd.DataFrame({"query_id": own[found[0]], "vec_id": ids[found[1]], "score": found[2]})

    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(search, FOUND)
    references = asked_all.select(F.col("vec_id").alias("query_id"), F.inline(F.arrays_zip("ids", "scores"))).toDF("query_id", "vec_id", "score")
    # At most k rows for each probed shard of a query, and its best references.
    found = found.union(references).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def self_neighbours(vectors: DataFrame, every: int = EVERY, k: int = K, probes: float = PROBES) -> DataFrame:
    """Neighbours of the rows whose id is divisible by `every`, among all other rows."""
    vectors = pick(vectors, vec_id="long", embedding="array<double>")
    return neighbours(vectors, vectors.where(F.col("vec_id") % every == 0), k, probes)
