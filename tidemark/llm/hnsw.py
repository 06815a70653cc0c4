"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard, shard results merged.

Nearness is the inner product. Vectors are laid out so that it becomes a distance: a further coordinate brings every vector of a shard
to the length of its longest one, queries have zero there, and the nearest by distance is the largest by product.

Rows of the same vector are one node that knows its smallest ids (more cannot come among the nearest, ties go to smaller ids), so copies
never crowd a graph. Nodes are dealt over shards by hash; each shard's graph is built in one task of bounded size and
stored as flat neighbour arrays, a row per node. Insertion works in batches: the batch searches the graph as it stands, sees itself,
and takes neighbours that are nearer to the new node than to each other, which keeps clusters connected; neighbours link back and
choose again when full. Queries come in blocks against every shard; found neighbours are scored exactly, in double precision on the
original vectors, and the best of all shards are merged.

Work that grows: every query visits every shard, so searching costs queries x shards x the logarithm of a shard; shards are as large as
their bound of rows and bytes allows. Recall against brute force is measured in the tests and stated in the README.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part; vectors of another length
than the query's are never its neighbours; a query leaves out the rows of its own id; a row repeated whole counts once; rows that share an
id and differ are vectors of their own, and one query each; null ids are found (last of a tie) and ask nothing; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import ship, store

#: Neighbours a node has on upper layers (twice as many on the lowest), candidates held while building and searching.
LINKS, EF_BUILD, EF_SEARCH = 16, 96, 160
#: A shard's bounds, the least it holds before there is another for the sake of parallel work, and queries of a block.
SHARD_ROWS, SHARD_BYTES, SHARD_LEAST, QUERY_BLOCK = 65_536, 32 << 20, 8192, 4096
#: Rows that search together, unexpanded candidates each takes at a step, and rows inserted together at most.
_TOGETHER, _WIDE, _BATCH = 256, 4, 1024
NOBODY = -1


class Graph:
    """Flat arrays of one shard: unit-length ``x`` (n, d), ``level`` (n), and ``links[l]`` (n, width) with ``NOBODY`` as filling."""

    def __init__(self, x: np.ndarray, level: np.ndarray, links: list[np.ndarray] | None = None, width: int = LINKS):
        self.x, self.level = x, level
        top = int(level.max(initial=0))
        self.links = links or [np.full((len(x), width * (2 if layer == 0 else 1)), NOBODY, np.int32) for layer in range(top + 1)]
        self.entry = int(np.argmax(level)) if len(level) else NOBODY

    def search(self, q: np.ndarray, entry: np.ndarray, ef: int, layer: int) -> tuple[np.ndarray, np.ndarray]:
        """Beam search of many queries at once on one layer: ``(ids, products)``, the best ``ef`` found, best first."""
        ids, sims = [], []
        for i in range(0, len(q), _TOGETHER):
            a, b = self._beam(q[i:i + _TOGETHER], entry[i:i + _TOGETHER], ef, layer)
            ids.append(a)
            sims.append(b)
        return np.concatenate(ids), np.concatenate(sims)

    def _beam(self, q: np.ndarray, entry: np.ndarray, ef: int, layer: int) -> tuple[np.ndarray, np.ndarray]:
        links, rows = self.links[layer], np.arange(len(q))
        ids = np.full((len(q), ef), NOBODY, np.int32)
        sims = np.full((len(q), ef), -np.inf, np.float32)
        fresh = np.zeros((len(q), ef), bool)
        ids[:, 0], fresh[:, 0] = entry, True
        sims[:, 0] = np.einsum("qd,qd->q", self.x[entry], q)
        seen = np.zeros((len(q), len(self.x)), bool)
        seen[rows, entry] = True
        live = rows
        while len(live):
            wide = min(_WIDE, ef)
            f = fresh[live]
            order = np.argsort(~f, axis=1, kind="stable")[:, :wide]  # rows are sorted: the best that are not expanded yet
            take = np.take_along_axis(f, order, 1)
            live, order, take = live[take[:, 0]], order[take[:, 0]], take[take[:, 0]]
            if not len(live):
                break
            at = np.where(take, np.take_along_axis(ids[live], order, 1), NOBODY)
            f = fresh[live]
            np.put_along_axis(f, order, False, 1)
            near = np.where(at[:, :, None] >= 0, links[at], NOBODY).reshape(len(live), -1)
            near.sort(axis=1)
            good = near >= 0
            good[:, 1:] &= near[:, 1:] != near[:, :-1]
            good &= ~seen[live[:, None], near]
            r, c = np.nonzero(good)
            seen[live[r], near[r, c]] = True
            found = np.full(near.shape, -np.inf, np.float32)
            found[r, c] = np.einsum("nd,nd->n", self.x[near[r, c]], q[live[r]])
            near[~good] = NOBODY
            all_s = np.concatenate([sims[live], found], 1)
            best = np.argsort(-all_s, axis=1, kind="stable")[:, :ef]
            sims[live] = np.take_along_axis(all_s, best, 1)
            ids[live] = np.take_along_axis(np.concatenate([ids[live], near], 1), best, 1)
            fresh[live] = np.take_along_axis(np.concatenate([f, good], 1), best, 1)
        return ids, sims

    def choose(self, own: np.ndarray, ids: np.ndarray, sims: np.ndarray, width: int) -> np.ndarray:
        """Up to ``width`` of the candidates (best first) for each node, none nearer to one chosen before than to the node;
        places left over go to the best of the others."""
        out = np.full((len(own), width), NOBODY, np.int32)
        for i in range(0, len(own), _TOGETHER):
            c, s = ids[i:i + _TOGETHER], sims[i:i + _TOGETHER]
            v = self.x[c]
            among = v @ v.transpose(0, 2, 1)
            real = (c >= 0) & (c != own[i:i + _TOGETHER, None])
            picked = np.zeros(c.shape, bool)
            shadow = np.full(c.shape, -np.inf, np.float32)  # the largest product with one chosen so far
            room = np.full(len(c), width)
            for j in range(c.shape[1]):
                take = real[:, j] & (shadow[:, j] < s[:, j]) & (room > 0)
                picked[:, j] = take
                room -= take
                shadow[take] = np.maximum(shadow[take], among[take, j])
            rank = np.argsort(np.where(picked, 0, np.where(real, 1, 2)), axis=1, kind="stable")[:, :width]
            out[i:i + _TOGETHER, :rank.shape[1]] = np.where(np.take_along_axis(real, rank, 1), np.take_along_axis(c, rank, 1), NOBODY)
        return out

    def link_back(self, own: np.ndarray, chosen: np.ndarray, layer: int) -> None:
        """Chosen neighbours get the new nodes as theirs; the full ones choose again."""
        links = self.links[layer]
        width = links.shape[1]
        r, c = np.nonzero(chosen >= 0)
        target, source = chosen[r, c], own[r]
        order = np.lexsort((source, target))
        target, source = target[order], source[order]
        while len(target):
            first = np.flatnonzero(np.r_[True, target[1:] != target[:-1]])
            nth = np.arange(len(target)) - np.repeat(first, np.diff(np.r_[first, len(target)]))
            now = nth < width
            nodes = target[first]
            more = np.full((len(nodes), width), NOBODY, np.int32)
            more[np.searchsorted(nodes, target[now]), nth[now]] = source[now]
            old = links[nodes]
            more[(more[:, :, None] == old[:, None, :]).any(2)] = NOBODY
            both = np.concatenate([old, more], 1)
            s = np.where(both >= 0, np.einsum("nkd,nd->nk", self.x[both], self.x[nodes]), -np.inf).astype(np.float32)
            best = np.argsort(-s, axis=1, kind="stable")
            both, s = np.take_along_axis(both, best, 1), np.take_along_axis(s, best, 1)
            full = (both[:, width:] >= 0).any(1)
            links[nodes[~full]] = both[~full, :width]
            if full.any():
                links[nodes[full]] = self.choose(nodes[full], both[full], s[full], width)
            target, source = target[~now], source[~now]

    def insert(self, new: np.ndarray, ef: int) -> None:
        """Add a batch of nodes, all layers from the top."""
        x = self.x[new]
        entry = np.full(len(new), self.entry, np.int32)
        for layer in range(len(self.links) - 1, -1, -1):
            here = self.level[new] >= layer
            if (~here).any():
                entry[~here] = self.search(x[~here], entry[~here], 1, layer)[0][:, 0]
            if not here.any():
                continue
            own = new[here]
            ids, sims = self.search(x[here], entry[here], ef, layer)
            entry[here] = ids[:, 0]
            among = x[here] @ x[here].T  # the batch's own nodes are candidates too
            np.fill_diagonal(among, -np.inf)
            k = min(ef, len(own))
            part = np.argsort(-among, axis=1, kind="stable")[:, :k]
            ids = np.concatenate([ids, own[part].astype(np.int32)], 1)
            sims = np.concatenate([sims, np.take_along_axis(among, part, 1)], 1)
            sims[(ids < 0) | (ids == own[:, None])] = -np.inf
            ids[~np.isfinite(sims)] = NOBODY
            best = np.argsort(-sims, axis=1, kind="stable")[:, :ef]
            ids, sims = np.take_along_axis(ids, best, 1), np.take_along_axis(sims, best, 1)
            chosen = self.choose(own, ids, sims, LINKS)
            self.links[layer][own, :LINKS] = chosen
            self.link_back(own, chosen, layer)

    def nearest(self, q: np.ndarray, ef: int) -> np.ndarray:
        """The ``ef`` best nodes found for every query, filled with ``NOBODY``."""
        entry = np.full(len(q), self.entry, np.int32)
        for layer in range(len(self.links) - 1, 0, -1):
            entry = self.search(q, entry, 1, layer)[0][:, 0]
        return self.search(q, entry, ef, 0)[0]


def lengthened(x: np.ndarray) -> np.ndarray:
    """All vectors brought to length one (the longest of them before) by one more coordinate."""
    x = x.astype(np.float64)
    squares = np.einsum("nd,nd->n", x, x)
    longest = squares.max(initial=0.0) or 1.0
    return (np.concatenate([x, np.sqrt(np.maximum(longest - squares, 0.0))[:, None]], 1) / np.sqrt(longest)).astype(np.float32)


def build(x: np.ndarray, ef: int = EF_BUILD, seed: int = 0) -> Graph:
    """The graph over the rows of ``x``; the same rows give the same graph."""
    rng = np.random.default_rng(seed)
    level = np.minimum(-np.log(rng.random(len(x))) / np.log(LINKS), 30).astype(np.int32)
    graph = Graph(lengthened(x), level)
    # the highest node is first, so that every later one finds a way in; batches are no larger than the graph they search
    order = np.concatenate([[graph.entry], np.delete(np.arange(len(x)), graph.entry)]).astype(np.int32)
    done = 1
    while done < len(x):
        batch = order[done:done + min(_BATCH, max(16, done))]
        graph.insert(batch, ef)
        done += len(batch)
    return graph


# --- the index over a table --------------------------------------------------------------------------------

def usable(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, v, dim)``: rows with a vector that has a direction, in double precision."""
    v = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    sound = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf"))) & F.exists("v", lambda e: e != 0)
    return rows.where(F.coalesce(sound, F.lit(False))).withColumn("dim", F.size("v"))


def classes(vectors: DataFrame, keep: int) -> DataFrame:
    """``(v, dim, ids)``: distinct vectors with their ``keep`` smallest ids."""
    distinct = vectors.distinct()
    w = Window.partitionBy("v").orderBy(F.col("vec_id").asc_nulls_last())
    few = distinct.withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") <= keep)
    ids = F.transform(F.sort_array(F.collect_list(F.struct("_nth", "vec_id"))), lambda r: r["vec_id"])
    return few.groupBy("v", "dim").agg(ids.alias("ids"))


def index(vectors: DataFrame, k: int = 20, ef: int = EF_BUILD) -> DataFrame:
    """The stored index, a row per distinct vector: shard, node, level, v, ids, and links, its neighbours on layer 0, 1, …, level, one
    after the other (2 x LINKS, then LINKS each, filled with -1)."""
    spark = vectors.sparkSession
    found = store(classes(vectors, k + 1), "vector-classes")
    sizes = {r.dim: r.n for r in found.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # a row per length of vectors
    cores = spark.sparkContext.defaultParallelism
    shards = [(dim, max(-(-n // max(1, min(SHARD_ROWS, SHARD_BYTES // (4 * dim)))), min(cores, -(-n // SHARD_LEAST)))) for dim, n in sizes.items()]
    counts = F.broadcast(spark.createDataFrame(shards, "dim int, shards int"))
    dealt = found.join(counts, "dim").withColumn("shard", F.pmod(F.xxhash64("v"), F.col("shards")).cast("int"))

    def grow(group: pa.Table) -> pa.Table:
        x = np.stack(group.column("v").to_numpy())
        order = np.lexsort(x.T[::-1])  # by value, so that a repeated task builds the same graph
        x = x[order]
        graph = build(x, ef)
        links = [np.concatenate([graph.links[layer][i] for layer in range(graph.level[i] + 1)]) for i in range(len(x))]
        return pa.table({
            "dim": group.column("dim"), "shard": group.column("shard"), "node": pa.array(np.arange(len(x), dtype=np.int32)), "level": pa.array(graph.level),
            "v": group.column("v").take(pa.array(order)), "ids": group.column("ids").take(pa.array(order)), "links": pa.array(links, pa.list_(pa.int32()))})

    ship(spark)
    schema = "dim int, shard int, node int, level int, v array<double>, ids array<long>, links array<int>"
    return store(dealt.select("dim", "shard", "v", "ids").groupBy("dim", "shard").applyInArrow(grow, schema), "hnsw-index")


def load(group: pa.Table) -> tuple[Graph, np.ndarray, list]:
    """A shard's graph from its rows, the original vectors and the ids of every node."""
    order = np.argsort(group.column("node").to_numpy())
    take = pa.array(order)
    x, level = np.stack(group.column("v").take(take).to_numpy()), group.column("level").to_numpy()[order]
    flat = group.column("links").take(take).to_numpy()
    links = []
    for layer in range(int(level.max()) + 1):
        width, begin = (2 * LINKS, 0) if layer == 0 else (LINKS, LINKS * (layer + 1))
        links.append(np.full((len(x), width), NOBODY, np.int32))
        for i in np.flatnonzero(level >= layer):
            links[layer][i] = flat[i][begin:begin + width]
    return Graph(lengthened(x), level, links), x, group.column("ids").take(take).to_pylist()


def search(found: DataFrame, queries: DataFrame, k: int = 20, ef: int = EF_SEARCH) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest of the index for every row of ``queries`` (vec_id, v, dim)."""
    shards = store(found.select("dim", "shard").distinct(), "shards")
    asked = store(queries.where("vec_id is not null").distinct().withColumn("query", F.monotonically_increasing_id()), "queries")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int"))
    # a stated set of queries in blocks, against the shards of their length
    met = asked.join(shards, "dim").select("dim", "shard", "block", "query", "vec_id", "v")
    sent = found.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def answer(nodes: pa.Table, block: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if nodes.num_rows and block.num_rows:
            graph, x, ids = load(nodes)
            q = np.stack(block.column("v").to_numpy())
            near = graph.nearest(np.concatenate([q / np.sqrt((q * q).sum(1))[:, None], np.zeros((len(q), 1))], 1).astype(np.float32), min(ef, len(x)))
            for query, own, vector, hits in zip(block.column("query").to_pylist(), block.column("vec_id").to_pylist(), q, near, strict=True):
                hits = hits[hits >= 0]
                scores = (x[hits] * vector).sum(1)
                best = [(-s, i is None, i or 0, i) for s, h in zip(scores.tolist(), hits.tolist(), strict=True) for i in ids[h] if i != own]
                best = sorted(best)[:k]
                for column, values in zip(out, ([query] * len(best), [own] * len(best), [b[3] for b in best], [-b[0] for b in best]), strict=True):
                    column.extend(values)
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.float64())], ["query", "query_id", "vec_id", "score"])

    ship(found.sparkSession)
    pairs = sent.groupBy("dim", "shard", "block").cogroup(met.groupBy("dim", "shard", "block"))
    hits = pairs.applyInArrow(answer, "query long, query_id long, vec_id long, score double")
    w = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_neighbours(df: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """Index all vectors of ``df`` (vec_id, embedding) and search those whose id ``every`` divides."""
    vectors = store(usable(df), "vectors")
    return search(index(vectors, k), vectors.where(F.col("vec_id") % every == 0), k)
