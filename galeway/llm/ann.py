"""Approximate nearest neighbours on robust-pruned directed graphs, one per shard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors in a shard; edges of a node; beam when building and when searching; slack of the pruning.
SHARD_ROWS, DEGREE, BUILD_BEAM, BEAM, ALPHA = 4096, 32, 48, 96, 1.2
#: A shard holds this many times the root of the number of vectors if that is more than SHARD_ROWS, so that queries times shards grow with the power 1.5.
ROOT = 16
#: Queries that search at once, which bounds memory.
BLOCK = 512


def beam_search(x: np.ndarray, edges: np.ndarray, q: np.ndarray, starts: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of q, the `beam` nodes with the largest inner product found from `starts`, best first; -1 where there are none.

    All queries move together: each step expands the best node of every beam that has not been expanded yet.
    """
    n, m = len(x), len(q)
    ids = np.tile(starts, (m, 1))
    score = np.einsum("md,mkd->mk", q, x[ids])
    seen = np.zeros((m, n), bool)
    rows = np.arange(m)
    np.put_along_axis(seen, ids, True, 1)
    done = np.zeros(ids.shape, bool)
    live = rows
    while len(live):
        s = np.where(done[live], -np.inf, score[live])
        at = s.argmax(1)
        open_ = np.isfinite(s[np.arange(len(live)), at])
        live, at = live[open_], at[open_]
        if not len(live):
            break
        done[live, at] = True
        near = edges[ids[live, at]]
        ok = (near >= 0) & ~np.take_along_axis(seen[live], np.maximum(near, 0), 1)
        seen[live[:, None], np.where(ok, near, ids[live, at][:, None])] = True
        new = np.where(ok, np.einsum("md,mkd->mk", q[live], x[np.maximum(near, 0)]), -np.inf)
        if ids.shape[1] < beam:  # room for all for now
            pad = min(beam, ids.shape[1] + near.shape[1]) - ids.shape[1]
            ids, score, done = np.pad(ids, ((0, 0), (0, pad))), np.pad(score, ((0, 0), (0, pad)), constant_values=-np.inf), np.pad(done, ((0, 0), (0, pad)), constant_values=True)
        width = ids.shape[1]
        all_s = np.concatenate([score[live], new], 1)
        top = np.argpartition(-all_s, width - 1, axis=1)[:, :width]
        ids[live] = np.take_along_axis(np.concatenate([ids[live], np.maximum(near, 0)], 1), top, 1)
        score[live] = np.take_along_axis(all_s, top, 1)
        done[live] = np.take_along_axis(np.concatenate([done[live], ~ok], 1), top, 1)
    order = np.argsort(-score, 1, kind="stable")
    score = np.take_along_axis(score, order, 1)
    return np.where(np.isfinite(score), np.take_along_axis(ids, order, 1), -1), score


def prune(x: np.ndarray, of: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Robust pruning: take the nearest candidate, drop those that are alpha times nearer to it than to the node, repeat."""
    out = np.full((len(of), degree), -1, np.int32)
    p, c = x[of], x[np.maximum(cand, 0)]
    d = ((c - p[:, None]) ** 2).sum(2)
    d[(cand < 0) | (cand == of[:, None])] = np.inf
    rows = np.arange(len(of))
    norm = (c**2).sum(2)
    for k in range(degree):
        best = d.argmin(1)
        ok = np.isfinite(d[rows, best])
        if not ok.any():
            break
        out[ok, k] = cand[rows[ok], best[ok]]
        chosen = c[rows, best]
        apart = norm + (chosen**2).sum(1)[:, None] - 2 * np.einsum("mkd,md->mk", c, chosen)
        d[(alpha * alpha * apart <= d) | (cand == out[:, k][:, None])] = np.inf
    return out


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 7) -> np.ndarray:
    """Edges (n, degree) over the rows of x, padded with -1. Equal rows should be merged first.

    Inner products become distances by one more coordinate that gives all rows the same norm.
    """
    n = len(x)
    norms = (x**2).sum(1)
    x = np.hstack([x, np.sqrt(np.maximum(norms.max(initial=0) - norms, 0))[:, None]]).astype(np.float32)
    rng = np.random.default_rng(seed)
    if n <= degree + 1:
        return np.array([[j for j in range(n) if j != i] + [-1] * (degree - n + 1) for i in range(n)], np.int32).reshape(n, degree)
    edges = rng.integers(0, n, (n, degree)).astype(np.int32)
    starts = entry_points(x)
    for a in (1.0, alpha):
        order = rng.permutation(n)
        for i in range(0, n, BLOCK):
            of = order[i : i + BLOCK]
            found, _ = beam_search(x, edges, x[of], starts, beam)
            edges[of] = prune(x, of, np.hstack([found, edges[of]]), degree, a)
            src, dst = np.repeat(of, degree), edges[of].ravel()
            src, dst = src[dst >= 0], dst[dst >= 0]
            by = np.lexsort((((x[src] - x[dst]) ** 2).sum(1), dst))  # a node's nearest reverse edges first
            nodes, first, count = np.unique(dst[by], return_index=True, return_counts=True)
            place = np.arange(len(by)) - np.repeat(first, count)
            back = np.full((len(nodes), 2 * degree), -1, np.int32)
            near = place < 2 * degree
            back[np.repeat(np.arange(len(nodes)), count)[near], place[near]] = src[by][near]
            edges[nodes] = prune(x, nodes, np.hstack([edges[nodes], back]), degree, a)
    return edges


def entry_points(x: np.ndarray) -> np.ndarray:
    """The row nearest to the mean, and some spread evenly over the rows."""
    mid = ((x - x.mean(0)) ** 2).sum(1).argmin()
    return np.unique(np.append(np.linspace(0, len(x) - 1, min(len(x), 8)).astype(int), mid))


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products in double precision, the same for equal rows wherever they stand."""
    return (a.astype(np.float64) * b.astype(np.float64)).sum(-1)


class Shard:
    """The vectors of a shard, those that are equal merged, and their graph."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, beam: int, degree: int):
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        self.x, inverse = np.unique(x, axis=0, return_inverse=True)
        by = np.argsort(inverse, kind="stable")  # ids ascend within a vector
        self.ids, self.first = ids[by], np.searchsorted(inverse[by], np.arange(len(self.x) + 1))
        self.k, self.beam, self.f = k, max(beam, k + 1), self.x.astype(np.float32)
        self.edges = build(self.f, degree)
        # searches also start at the longest vectors, which inner products favour
        self.starts = np.unique(np.append(entry_points(self.f), np.argsort(-(self.f**2).sum(1), kind="stable")[: self.beam - 32]))

    def search(self, ids: np.ndarray, q: np.ndarray) -> pd.DataFrame:
        out = []
        for i in range(0, len(q), BLOCK):
            qi, own = q[i : i + BLOCK], ids[i : i + BLOCK]
            found, _ = beam_search(self.f, self.edges, qi.astype(np.float32), self.starts, self.beam)
            found = found[:, : self.k + 8]
            score = np.where(found >= 0, exact(self.x[np.maximum(found, 0)], qi[:, None]), -np.inf)
            for r in range(len(qi)):
                nodes = found[r][found[r] >= 0]
                s = score[r][: len(nodes)]
                # of the copies of a vector the k smallest ids but the query's own, which may be there more than once
                parts = []
                for v in nodes:
                    same = self.ids[self.first[v] : self.first[v + 1]]
                    a, b = np.searchsorted(same, [own[r], own[r] + 1])
                    parts.append(np.concatenate([same[: min(a, self.k)], same[b : b + self.k]])[: self.k])
                flat, s = np.concatenate(parts), np.repeat(s, [len(p) for p in parts])
                top = np.lexsort((flat, -s))[: self.k]
                out.append((own[r], flat[top], s[top]))
        return pd.DataFrame({"query_id": np.repeat([o[0] for o in out], [len(o[1]) for o in out]), "vec_id": np.concatenate([o[1] for o in out]), "score": np.concatenate([o[2] for o in out])})


def _searcher(k: int, beam: int, degree: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held, shard = None, [], None
        for pdf in batches:
            for key, part in pdf.groupby("shard", sort=False):
                if key != at:
                    at, held, shard = key, [], None
                rows = part[~part.is_query]
                if len(rows):
                    held.append((rows.vec_id.to_numpy(), np.array(rows.v.tolist(), np.float64)))
                asks = part[part.is_query]
                if len(asks) and held:
                    shard = shard or Shard(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), k, beam, degree)
                    yield shard.search(asks.vec_id.to_numpy(), np.array(asks.v.tolist(), np.float64))

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding",
            shard_rows: int = SHARD_ROWS, beam: int = BEAM, degree: int = DEGREE) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of `vectors` with the largest inner product found for each query, but its own id.

    Each shard holds about shard_rows vectors by a hash of the id, or ROOT times the root of their number if that is more; rows arrive first, the shard's
    graph is built, then the queries stream through it in blocks, so a task holds one shard and
    one block. Vectors that are null, zero, or hold null or non-finite components take no part,
    nor do null ids; vectors of another length, however great, are a space of their own. Equal vectors share a node, ties
    go to the smaller id; repeated rows of `vectors` give repeated results; of `queries` with one id only the one with the
    least vector asks; other columns don't matter; an empty table gives no rows.
    """
    e = F.col(embedding)
    fine = e.isNotNull() & F.coalesce(F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False)) & F.exists(e, lambda v: v != 0)

    def clean(df):
        return df.where(fine & F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), e.cast("array<double>").alias("v"), F.size(e).alias("dim"))

    rows = clean(vectors)
    asks = clean(queries).groupBy("vec_id").agg(F.min(F.struct("v", "dim")).alias("one")).select("vec_id", "one.v", "one.dim")
    counts = rows.groupBy("dim").agg(F.count("*").alias("n"))
    shards = counts.select("dim", F.ceil(F.col("n") / F.greatest(F.lit(shard_rows), F.lit(ROOT) * F.sqrt("n"))).cast("int").alias("of"))  # a row for each length of vectors
    rows = rows.join(F.broadcast(shards), "dim").select(F.struct("dim", F.pmod(F.xxhash64("vec_id"), F.col("of")).cast("int").alias("s")).alias("shard"), F.lit(False).alias("is_query"), "vec_id", "v")
    asks = asks.join(F.broadcast(shards), "dim").select("dim", F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("s"), "vec_id", "v")
    asks = asks.select(F.struct("dim", "s").alias("shard"), F.lit(True).alias("is_query"), "vec_id", "v")
    both = rows.unionByName(asks).withColumn("shard", F.to_json("shard"))
    dealt = both.repartition("shard").sortWithinPartitions("shard", "is_query")
    found = dealt.mapInPandas(_searcher(k, beam, degree), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
