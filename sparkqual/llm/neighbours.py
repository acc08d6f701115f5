"""Approximate nearest neighbours by inner product: a pruned directed graph for each shard.

Every distinct vector is a node in one shard's graph. Greedy searches from the shard's centre
propose neighbours of a node; robust pruning keeps the nearest and drops those that a kept one
is closer to than alpha allows, so the edges are few and point in many directions. A query is
searched in every shard with a beam, and the results are merged.

Inner products become distances by one more dimension: x goes to (x, sqrt(M^2 - |x|^2)) with M
the largest norm of the shard, a query to (q, 0); nearer then means a larger product.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from sparkqual.plans.durable import durable

# Distinct vectors of a shard (expected), queries of a block.
SHARD, BLOCK = 8192, 2048
# Edges of a node, beam of the searches that build and of those that answer, slack of the pruning.
DEGREE, BUILD_BEAM, BEAM, ALPHA = 32, 48, 96, 1.2
_BATCH = 512


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding as array<double>) of the vectors that take part."""
    parts = F.col("embedding").cast("array<double>")
    bad = F.exists(parts, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), parts.alias("embedding"))
        .filter("vec_id is not null and embedding is not null")
        .filter(~F.coalesce(bad, F.lit(True)) & F.exists("embedding", lambda x: x != 0))
    )


def beam_search(
    points: np.ndarray, graph: np.ndarray, entry: int, queries: np.ndarray, beam: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, squared distances, expanded ids) of each query's beam; -1 pads. All queries step together."""
    n = len(queries)
    seen = np.zeros((n, len(points)), bool)
    seen[:, entry] = True
    ids = np.full((n, beam), -1, np.int32)
    far = np.full((n, beam), np.inf, np.float32)
    todo = np.zeros((n, beam), bool)
    ids[:, 0], todo[:, 0] = entry, True
    far[:, 0] = ((queries - points[entry]) ** 2).sum(axis=1)
    expanded = []
    active = np.arange(n)
    while len(active):
        open_far = np.where(todo[active], far[active], np.inf)
        at = open_far.argmin(axis=1)
        active, at = (x[np.isfinite(open_far[np.arange(len(active)), at])] for x in (active, at))
        if not len(active):
            break
        todo[active, at] = False
        node = ids[active, at]
        step = np.full(n, -1, np.int32)
        step[active] = node
        expanded.append(step)
        near = graph[node]
        new = (near >= 0) & ~seen[active[:, None], near]
        row, col = np.nonzero(new)
        cand = near[row, col]
        seen[active[row], cand] = True
        dist = np.full(near.shape, np.inf, np.float32)
        dist[row, col] = ((points[cand] - queries[active[row]]) ** 2).sum(axis=1)
        all_far = np.concatenate([far[active], dist], axis=1)
        keep = np.argpartition(all_far, beam - 1, axis=1)[:, :beam]
        take = np.arange(len(active))[:, None]
        far[active] = all_far[take, keep]
        ids[active] = np.concatenate([ids[active], near], axis=1)[take, keep]
        todo[active] = np.concatenate([todo[active], new], axis=1)[take, keep]
    return ids, far, np.stack(expanded, axis=1) if expanded else np.zeros((n, 0), np.int32)


def prune(points: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Robust pruning: up to `degree` of each node's candidates (-1 pads, repeats allowed)."""
    cand = np.sort(candidates, axis=1)
    repeat = np.zeros(cand.shape, bool)
    repeat[:, 1:] = cand[:, 1:] == cand[:, :-1]
    alive = (cand >= 0) & ~repeat & (cand != nodes[:, None])
    vecs = points[cand]
    own = np.where(alive, ((vecs - points[nodes][:, None, :]) ** 2).sum(axis=2), np.inf)
    out = np.full((len(nodes), degree), -1, np.int32)
    rows = np.arange(len(nodes))
    for k in range(degree):
        best = own.argmin(axis=1)
        found = np.isfinite(own[rows, best])
        if not found.any():
            break
        out[found, k] = cand[rows, best][found]
        between = ((vecs - vecs[rows, best][:, None, :]) ** 2).sum(axis=2)
        own[(alpha * alpha * between <= own) | (np.arange(cand.shape[1]) == best[:, None])] = np.inf
    return out


def build_graph(points: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, int]:
    """(neighbours of each point, entry): a random graph refined in two passes, first without slack."""
    n = len(points)
    entry = int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin())
    rng = np.random.default_rng(n)
    graph = np.full((n, degree), -1, np.int32)
    if n == 1:
        return graph, entry
    # Distinct random offsets give every point distinct neighbours, none of them itself.
    offsets = rng.choice(np.arange(1, n), min(degree, n - 1), replace=False)
    graph[:, : len(offsets)] = (np.arange(n)[:, None] + offsets[None, :]) % n
    for slack in (1.0, alpha):
        order = rng.permutation(n)
        for k in range(0, n, _BATCH):
            nodes = order[k : k + _BATCH]
            ids, _, expanded = beam_search(points, graph, entry, points[nodes], beam)
            graph[nodes] = prune(points, nodes, np.concatenate([graph[nodes], ids, expanded], axis=1), degree, slack)
            _link_back(points, graph, nodes, degree, slack)
    return graph, entry


def _link_back(points: np.ndarray, graph: np.ndarray, nodes: np.ndarray, degree: int, alpha: float) -> None:
    """Add the reverse of the nodes' edges; where a list overflows, prune it."""
    source = np.repeat(nodes, degree)
    target = graph[nodes].ravel()
    source, target = source[target >= 0], target[target >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    at, first, count = np.unique(target, return_index=True, return_counts=True)
    # Long lists in parts, so that one much-linked point doesn't widen the table for all.
    for start in range(0, int(count.max()) if len(count) else 0, degree):
        some = count > start
        width = int(min(degree, (count[some] - start).max()))
        place = first[some][:, None] + start + np.arange(width)
        valid = start + np.arange(width) < count[some][:, None]
        added = np.where(valid, source[np.minimum(place, len(source) - 1)], -1)
        both = np.concatenate([graph[at[some]], added], axis=1)
        for k in range(0, len(both), _BATCH):
            graph[at[some][k : k + _BATCH]] = prune(points, at[some][k : k + _BATCH], both[k : k + _BATCH], degree, alpha)


def _lifted(vectors: np.ndarray) -> np.ndarray:
    norms = (vectors**2).sum(axis=1)
    top = norms.max()
    extra = np.sqrt(np.maximum(top - norms, 0))
    return (np.concatenate([vectors, extra[:, None]], axis=1) / np.sqrt(top)).astype(np.float32)


def _build_shard(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("first_id")
    vectors = np.stack(rows["embedding"].to_numpy()).astype(np.float64)
    lifted = _lifted(vectors)
    graph, entry = build_graph(lifted)
    ids = [np.sort(np.asarray(i, np.int64)) for i in rows["ids"]]
    blob = pickle.dumps((vectors, lifted, graph, entry, ids), protocol=5)
    return pd.DataFrame({"dim": [int(rows["dim"].iloc[0])], "shard": [int(rows["shard"].iloc[0])], "graph": [blob]})


def build(vectors: DataFrame, k: int, shard: int = SHARD) -> DataFrame:
    """(dim, shard, graph) of usable vectors: graphs over distinct vectors, with up to k + 1 ids each.

    Of equal vectors only the k + 1 smallest ids can be among k nearest without the query itself,
    so a vector that many rows share costs no more than that.
    """
    same = Window.partitionBy("hash", "embedding").orderBy("vec_id")
    nodes = (
        vectors.withColumn("hash", F.xxhash64("embedding"))
        .withColumn("copy", F.row_number().over(same))
        .filter(F.col("copy") <= k + 1)
        .groupBy("hash", "embedding")
        .agg(F.collect_set("vec_id").alias("ids"), F.min("vec_id").alias("first_id"))
        .withColumn("dim", F.size("embedding"))
    )
    nodes = durable(nodes.drop("hash"))
    shards = max(1, -(-nodes.count() // shard))
    placed = nodes.withColumn("shard", F.pmod(F.xxhash64("first_id"), F.lit(shards)).cast("int"))
    return durable(placed.groupBy("dim", "shard").applyInPandas(_build_shard, "dim int, shard int, graph binary"))


def _search_shard(k: int, beam: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for graph, query_ids, queries in zip(batch["graph"], batch["query_ids"], batch["queries"], strict=True):
                yield answer(graph, np.asarray(query_ids, np.int64), np.stack(queries).astype(np.float64))

    def answer(blob: bytes, query_ids: np.ndarray, queries: np.ndarray) -> pd.DataFrame:
        vectors, lifted, graph, entry, ids = pickle.loads(blob)
        out = []
        for at in range(0, len(queries), _BATCH):
            own = queries[at : at + _BATCH]
            scaled = own / np.linalg.norm(own, axis=1, keepdims=True)
            target = np.concatenate([scaled, np.zeros((len(own), 1))], axis=1).astype(np.float32)
            found, _, _ = beam_search(lifted, graph, entry, target, max(beam, k + 1))
            row, col = np.nonzero(found >= 0)
            node = found[row, col]
            products = (vectors[node] * own[row]).sum(axis=1)
            # The best k + 1 nodes have the best k rows besides the query's own.
            order = np.lexsort((-products, row))
            row, node, products = row[order], node[order], products[order]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            row, node, products = (x[rank <= k] for x in (row, node, products))
            counts = [len(ids[n]) for n in node]
            out.append(
                pd.DataFrame(
                    {
                        "query_id": np.repeat(query_ids[at + row], counts),
                        "vec_id": np.concatenate([ids[n] for n in node]) if len(node) else np.zeros(0, np.int64),
                        "score": np.repeat(products, counts),
                    }
                )
            )
        result = pd.concat(out)
        return result[result["query_id"] != result["vec_id"]]

    return run


def nearest(vectors: DataFrame, every: int, k: int, shard: int = SHARD, block: int = BLOCK, beam: int = BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows found with the largest inner products.

    Queries are rows whose vec_id is divisible by `every`; candidates are all other rows. Nearest
    first, ties to the smaller vec_id; scores are products of the original vectors in double
    precision. Vectors that are null, empty, zero, or hold null or non-finite components, and rows
    without id take no part; vectors of different lengths never meet. Fewer candidates give fewer
    rows; repeated rows (same id and vector) count once; other columns are ignored.
    """
    rows = usable(vectors).distinct()
    index = build(rows, k, shard)
    asked = rows.filter(F.pmod("vec_id", F.lit(every)) == 0).withColumn("dim", F.size("embedding"))
    blocks = max(1, -(-asked.count() // block))
    asked = (
        asked.groupBy("dim", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block"))
        .agg(F.collect_list(F.struct("vec_id", "embedding")).alias("rows"))
        .select("dim", "block", F.col("rows.vec_id").alias("query_ids"), F.col("rows.embedding").alias("queries"))
    )
    # Each block of queries meets each shard once.
    pairs = index.join(asked, "dim").select("graph", "query_ids", "queries")
    found = pairs.mapInPandas(_search_shard(k, beam), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"
    )
