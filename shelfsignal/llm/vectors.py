"""Near-duplicate vectors: a robust-pruned flat graph over overlapping shards.

Exact copies become one weighted class. Centroids are fitted on a bounded
sample (``FIT`` rows a centroid, those of the smallest hash of vec_id), one for
about ``MEMBERS`` classes; every class goes to its ``overlap`` nearest ones.
Where that takes more than ``CENTROIDS`` of them, the nearest cells of a coarse
level have centroids of their own, fitted and looked up cell by cell in tasks,
so that clusters stay as small however many vectors there are. A cluster of
more than ``SHARD`` classes (a dense group) is cut into blocks, and each two
blocks make a shard: any two members of a cluster meet in some task, and no
task holds more than ``SHARD`` of them.

In each shard a flat graph is built in ``ROUNDS`` rounds from a random one:
every node searches for itself, greedily, and what it came across is robustly
pruned to ``DEGREE`` neighbours (a candidate goes if a chosen neighbour is
closer to it, by ``ALPHA``, than the node); edges are taken in both directions.
Adjacency lists are united over all shards. Then every class searches in its
shards: a greedy search from the shard's medoid and the class's own node keeps
``BEAM`` candidates, then expands everything in a range wider than the
threshold until nothing new turns up. Only nodes that a search comes across
are compared. What it finds is verified in double precision. A shard in which
more than ``DENSE`` of all pairs are links (64 of its classes against all tell)
has no use for a graph, as a search would come across all of it: it is compared
by products of blocks, and writes no adjacency lists.

A pair that meets in several shards counts in the first one only, so shards
return a count and a local component for each member, never pairs. Recall is
audited by brute force: ``AUDIT`` classes, a random sample by hash, against all
others. While it is below ``RECALL`` the whole is repeated with a larger
overlap; if it stays below ``LEAST`` at the largest one, that is an error. The
figure is logged.

Defined cases: a vector that is null, empty, zero, or has a null or non-finite
component links with nothing; vectors of different length never link; a null
vec_id links with nothing, has a null component and is kept; rows of one
vec_id are one vector for components, each with its own copies and links.
"""

from __future__ import annotations

import logging

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, connected_components, stage, tune

SHARD, MEMBERS, CENTROIDS, FIT = 2000, 700, 8192, 8
DEGREE, NEAREST, ROUNDS, ALPHA, BEAM, SLACK = 24, 48, 2, 1.2, 16, 0.08
DENSE, PROBES = 0.25, 64
AUDIT, RECALL, LEAST, OVERLAP, MOST_OVERLAP = 2048, 0.97, 0.9, 2, 16
_log = logging.getLogger(__name__)
#: Members of a coarse cell that are looked up in one run of rows.
RUN = 20_000


def matrix(column) -> np.ndarray:
    """Unit rows, in double precision, of an Arrow list column of vectors of one length."""
    x = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = x.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(x), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit_centroids(x: np.ndarray, count: int, rounds: int = 5) -> np.ndarray:
    """Spherical k-means from evenly spaced rows."""
    c = x[np.linspace(0, len(x) - 1, count).astype(int)].copy()
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 2048] @ c.T).argmax(axis=1) for i in range(0, len(x), 2048)])
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        norm = np.linalg.norm(total, axis=1)
        c[norm > 0] = total[norm > 0] / norm[norm > 0, None]
    return c


class Walk:
    """Searches of several nodes at once; ``s`` holds the similarities to the nodes they came across, others are -inf."""

    def __init__(self, x: np.ndarray, flat: np.ndarray, queries: np.ndarray):
        self.x, self.flat, self.queries = x, flat, queries
        self.s = np.full((len(queries), len(x)), -np.inf, np.float32)
        self.done = np.zeros(self.s.shape, bool)
        self.compared = 0

    def see(self, row: np.ndarray, node: np.ndarray) -> None:
        key = np.unique(row * len(self.x) + node)
        row, node = key // len(self.x), key % len(self.x)
        new = np.isneginf(self.s[row, node])
        row, node = row[new], node[new]
        self.compared += len(row)
        for i in range(0, len(row), 1 << 16):
            r, c = row[i : i + (1 << 16)], node[i : i + (1 << 16)]
            self.s[r, c] = np.einsum("nd,nd->n", self.x[self.queries[r]], self.x[c])

    def expand(self, row: np.ndarray, node: np.ndarray) -> None:
        self.done[row, node] = True
        for i in range(0, len(row), 1 << 14):
            r, c = row[i : i + (1 << 14)], node[i : i + (1 << 14)]
            self.see(np.repeat(r, self.flat.shape[1]), self.flat[c].ravel())

    def greedy(self, entry: int) -> None:
        """From ``entry`` and the queries' own nodes to the best ``BEAM`` nodes that can be reached."""
        at = np.arange(len(self.queries))
        self.see(np.concatenate([at, at]), np.concatenate([np.full(len(at), entry), self.queries]))
        width = min(BEAM, len(self.x))
        while True:
            best = np.argpartition(-self.s, width - 1, axis=1)[:, :width]
            live = np.isfinite(np.take_along_axis(self.s, best, axis=1)) & ~np.take_along_axis(self.done, best, axis=1)
            if not live.any():
                return
            self.expand(np.repeat(at, live.sum(axis=1)), best[live])

    def range(self, least: float) -> None:
        """Everything at or above ``least`` that can be reached through such nodes."""
        while True:
            row, node = np.nonzero((self.s >= least) & ~self.done)
            if not len(row):
                return
            self.expand(row, node)


def medoid(x: np.ndarray) -> int:
    return int((x @ x.mean(axis=0)).argmax())


def prune(x: np.ndarray, rows: np.ndarray, cand: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Robustly pruned neighbours (rows x DEGREE) among candidates with their similarities (-inf: none); -1 fills up."""
    out = np.full((len(rows), DEGREE), -1, np.int64)
    order = np.argsort(-s, axis=1, kind="stable")
    cand, s = np.take_along_axis(cand, order, axis=1), np.take_along_axis(s, order, axis=1)
    far = np.maximum(0, 2 - 2 * s.astype(float))
    open_, at = np.isfinite(s) & (cand != rows[:, None]), np.arange(len(rows))
    for r in range(DEGREE):
        some = open_.any(axis=1)
        if not some.any():
            break
        pick = cand[at, open_.argmax(axis=1)]
        out[some, r] = pick[some]
        between = np.maximum(0, 2 - 2 * np.einsum("nd,njd->nj", x[pick], x[cand]))
        open_ &= (ALPHA**2 * between > far) & (cand != pick[:, None])
    return out


def both_ways(graph: np.ndarray) -> np.ndarray:
    """Neighbours and those that have a node as theirs, up to twice as many; a node itself fills up."""
    n, degree = graph.shape
    src, dst = np.repeat(np.arange(n), degree), graph.ravel()
    src, dst = src[dst >= 0], dst[dst >= 0]
    a, b = np.concatenate([src, dst]), np.concatenate([dst, src])
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    out = np.repeat(np.arange(n)[:, None], 2 * degree, axis=1)
    out[a[place < 2 * degree], place[place < 2 * degree]] = b[place < 2 * degree]
    return out


def build(x: np.ndarray, chunk: int = 256, seed: int = 1) -> np.ndarray:
    """A graph (nodes x 2 DEGREE) in which every node searches for its neighbours, the first time in a random one."""
    n, entry = len(x), medoid(x)
    flat = np.random.default_rng(seed).integers(0, n, (n, DEGREE))
    for _ in range(ROUNDS):
        graph = np.empty((n, DEGREE), np.int64)
        for a in range(0, n, chunk):
            rows = np.arange(a, min(n, a + chunk))
            walk = Walk(x, flat, rows)
            walk.greedy(entry)
            k = min(NEAREST, n)
            near = np.argpartition(-walk.s, k - 1, axis=1)[:, :k]
            graph[rows] = prune(x, rows, near, np.take_along_axis(walk.s, near, axis=1))
        flat = both_ways(graph)
    return flat


def search(x: np.ndarray, graph: np.ndarray, threshold: float, chunk: int = 256) -> np.ndarray:
    """Boolean (nodes x nodes): which nodes each node's search finds at or above ``threshold``, about; never itself."""
    n = len(x)
    found, entry = np.zeros((n, n), bool), medoid(x)
    flat = np.where(graph < 0, np.arange(n)[:, None], graph)
    for a in range(0, n, chunk):
        rows = np.arange(a, min(n, a + chunk))
        walk = Walk(x, flat, rows)
        walk.greedy(entry)
        walk.range(threshold - SLACK)
        found[rows] = walk.s >= threshold - 1e-4
    found |= found.T
    np.fill_diagonal(found, False)
    return found


def dense(x: np.ndarray, threshold: float) -> bool:
    """Whether so many pairs are links that a graph would not save comparisons."""
    probes = x[np.linspace(0, len(x) - 1, PROBES).astype(int)]
    return len(x) > PROBES and float((probes @ x.T >= threshold).mean()) > DENSE


def products(x: np.ndarray, threshold: float, chunk: int = 256) -> np.ndarray:
    """As ``search``, by comparing all."""
    found = np.concatenate([x[a : a + chunk] @ x.T >= threshold - 1e-4 for a in range(0, len(x), chunk)])
    np.fill_diagonal(found, False)
    return found


def _assigned(centroids: dict[int, np.ndarray], overlap: int):
    def run(batches):
        for batch in batches:
            sizes = np.array([len(v) for v in batch.column("v")], np.int64)
            for dim in np.unique(sizes):
                rows = np.flatnonzero(sizes == dim)
                own = batch.take(pa.array(rows))
                c = centroids.get(int(dim))
                if c is None or len(c) == 1:
                    near = np.zeros((len(rows), 1), np.int64)
                else:
                    near = np.argsort(-(matrix(own.column("v")) @ c.T), axis=1, kind="stable")[:, :overlap]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, near.shape[1], dtype=np.int32)), pa.array(near.ravel() + (int(dim) << 20)))
                yield pa.RecordBatch.from_arrays([own.column("id"), own.column("w"), own.column("v"), lists], names=["id", "w", "v", "near"])

    return run


def _graph(percent: int):
    def run(table):
        table = table.sort_by("id")
        ids = table["id"].to_numpy()
        x = matrix(table["v"]) if len(ids) > 1 else None
        if x is None or dense(x, percent / 100):
            return pa.table({"src": ids[:0], "dst": ids[:0]})
        flat = build(x)
        row, col = np.nonzero(flat != np.arange(len(ids))[:, None])
        return pa.table({"src": ids[row], "dst": ids[flat[row, col]]})

    return run


def met_before(shards, shard: int) -> np.ndarray:
    """Boolean (nodes x nodes): which nodes have a shard of a smaller number in common as well; such pairs count there."""
    lists = shards.combine_chunks() if isinstance(shards, pa.ChunkedArray) else shards
    owner, number = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()
    owner, number = owner[number < shard], number[number < shard]
    names, at = np.unique(number, return_inverse=True)
    has = np.zeros((len(lists), len(names)), np.float32)
    has[owner, at] = 1
    return has @ has.T > 0.5


def _searched(percent: int):
    def run(key, table):
        shard = key[0].as_py()
        table = table.sort_by("id")
        ids, weight = table["id"].to_numpy(), table["w"].to_numpy()
        x = matrix(table["v"])
        n = len(ids)
        lists = [np.array(v or [], np.int64) for v in table["neighbours"].to_pylist()]
        graph = np.full((n, max(1, *map(len, lists))), -1, np.int64)
        for i, v in enumerate(lists):
            at = np.minimum(np.searchsorted(ids, v), n - 1)
            at = at[ids[at] == v]
            graph[i, : len(at)] = at
        found = products(x, percent / 100) if dense(x, percent / 100) else search(x, graph, percent / 100)
        row, col = np.nonzero(np.triu(found))
        exact = np.concatenate([np.einsum("nd,nd->n", x[row[i : i + 65536]], x[col[i : i + 65536]]) for i in range(0, len(row), 65536)] or [np.zeros(0)])
        row, col = row[exact >= percent / 100], col[exact >= percent / 100]
        mine = ~met_before(table["shards"], shard)[row, col]
        links = np.bincount(row[mine], weight[col[mine]], n) + np.bincount(col[mine], weight[row[mine]], n)
        root = np.arange(n)
        while True:
            before = root.copy()
            np.minimum.at(root, row, root[col])
            np.minimum.at(root, col, root[row])
            root = root[root]
            if (before == root).all():
                break
        return pa.table({"id": ids, "links": links.astype(np.int64), "root": ids[root]})

    return run


def _audited(sample: pd.DataFrame, percent: int):
    def run(batches):
        groups = {dim: (g["id"].to_numpy(), matrix(pa.array(list(g["v"])))) for dim, g in sample.groupby(sample["v"].map(len))}
        for batch in batches:
            sizes = np.array([len(v) for v in batch.column("v")], np.int64)
            for dim, (ids, x) in groups.items():
                rows = np.flatnonzero(sizes == dim)
                if len(rows):
                    own = batch.take(pa.array(rows))
                    hit = x @ matrix(own.column("v")).T >= percent / 100
                    hit &= ids[:, None] != own.column("id").to_numpy()[None, :]
                    n = hit @ own.column("w").to_numpy()
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n.astype(np.int64))], names=["id", "links"])

    return run


def audit(classes: DataFrame, found: DataFrame, percent: int, size: int = AUDIT) -> float:
    """Share of the links of ``size`` random classes, compared with all classes, that ``found`` (id, links) counts; 1 if there are none."""
    sample = bounded_sample(classes, size, "id").select("id", "v").toPandas()  # ``size`` rows
    if sample.empty:
        return 1.0
    true = classes.mapInArrow(_audited(sample, percent), "id long, links long").groupBy("id").agg(F.sum("links").alias("true"))
    row = true.join(found, "id", "left").agg(F.sum(F.least("true", F.coalesce("links", F.lit(0)))).alias("hit"), F.sum("true").alias("all")).first()
    return row["hit"] / row["all"] if row["all"] else 1.0


def _cell(key, table):
    """The centroids of a coarse cell, fitted on a sample of it."""
    x = matrix(table["v"])
    c = fit_centroids(x, max(1, min(len(x), len(x) // FIT)))
    return pa.table({"cell": pa.array([key[0].as_py()], pa.int64()), "c": pa.array([c.ravel().tolist()], pa.list_(pa.float64()))})


def _within(overlap: int):
    """Rows come sorted by (cell, run, role): the cell's centroids first, then its members, which get their nearest ones."""

    def run(batches):
        key, c = None, None
        for batch in batches:
            cells, runs, roles = (batch.column(k).to_numpy() for k in ("cell", "run", "role"))
            edge = np.flatnonzero(np.concatenate([[True], (cells[1:] != cells[:-1]) | (runs[1:] != runs[:-1]) | (roles[1:] != roles[:-1]) | (roles[1:] == 0)]))
            for i, j in zip(edge, [*edge[1:], len(batch)], strict=True):
                part = batch.slice(i, j - i)
                if roles[i] == 0:
                    key, c = (cells[i], runs[i]), np.array(part.column("v")[0].as_py())
                    continue
                x = matrix(part.column("v"))
                near = np.argsort(-(x @ c.reshape(-1, x.shape[1]).T), axis=1, kind="stable")[:, :overlap] if (cells[i], runs[i]) == key else np.zeros((len(x), 1), np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, near.shape[1], dtype=np.int32)), pa.array(near.ravel() + (int(cells[i]) << 20)))
                yield pa.RecordBatch.from_arrays([part.column("id"), lists], names=["id", "near"])

    return run


def _finer(coarse: DataFrame, wanted: int, overlap: int) -> DataFrame:
    """(id, c): the clusters of each class within its coarse cells (id, v, cell), about ``wanted`` in a cell."""
    some = bounded_sample(coarse, FIT * wanted, "id", by="cell")
    fitted = stage(some.groupBy("cell").applyInArrow(_cell, "cell long, c array<double>"), "fitted")
    runs = stage(coarse.groupBy("cell").agg(F.ceil(F.count("*") / RUN).cast("long").alias("runs")), "runs")
    rows = coarse.join(runs, "cell").select("cell", F.expr("pmod(xxhash64(id, 5), runs)").alias("run"), F.lit(1).alias("role"), "id", F.col("v").cast("array<double>").alias("v"))
    heads = fitted.join(runs, "cell").select("cell", F.explode(F.expr("sequence(0L, runs - 1)")).alias("run"), F.lit(0).alias("role"), F.lit(None).cast("long").alias("id"), F.col("c").alias("v"))
    both = rows.unionByName(heads).repartition("cell", "run").sortWithinPartitions("cell", "run", "role")
    return both.mapInArrow(_within(overlap), "id long, near array<long>").select("id", F.explode("near").alias("c"))


def _spread(classes: DataFrame, overlap: int) -> DataFrame:
    """(id, c): the clusters of each class."""
    dims = {r["d"]: r["n"] for r in classes.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n")).limit(64).collect()}
    centroids, fine = {}, {}
    for dim, n in dims.items():
        count = max(1, n // MEMBERS)
        if count > CENTROIDS:  # as many cells as each has centroids
            fine[dim] = -(-count // (count := int(np.ceil(count**0.5))))
        if count > 1:
            some = bounded_sample(classes.where(F.size("v") == dim), max(2000, FIT * count), "id").select("v").toPandas()
            centroids[dim] = fit_centroids(matrix(pa.array(list(some["v"]))), count)
    kind = classes.schema["v"].dataType.simpleString()
    near = stage(classes.mapInArrow(_assigned(centroids, overlap), f"id long, w long, v {kind}, near array<long>"), "near")
    spread = near.where(~F.size("v").isin(*fine)).select("id", F.explode("near").alias("c")) if fine else near.select("id", F.explode("near").alias("c"))
    for dim, wanted in fine.items():
        spread = spread.unionByName(_finer(near.where(F.size("v") == dim).select("id", "v", F.explode("near").alias("cell")), wanted, overlap))
    return stage(spread, "spread")


def _linked(classes: DataFrame, percent: int, overlap: int) -> DataFrame:
    """(id, links, root) for each class in each of its shards."""
    spread = _spread(classes, overlap)
    blocks = spread.groupBy("c").agg(F.when(F.count("*") > SHARD, F.ceil(F.count("*") / (SHARD / 2))).otherwise(1).cast("long").alias("blocks"))
    spread = spread.join(stage(blocks, "blocks"), "c").withColumn("b", F.expr("pmod(xxhash64(id, 3), blocks)"))
    other = F.expr("if(blocks = 1, array(0L), filter(sequence(0L, blocks - 1), x -> x <> b))")
    spread = spread.withColumn("o", F.explode(other)).withColumn("shard", F.expr("xxhash64(c, if(blocks = 1, 0L, least(b, o)), if(blocks = 1, 0L, greatest(b, o)))"))
    shards = stage(spread.groupBy("id").agg(F.collect_set("shard").alias("shards")), "shards")
    members = stage(classes.join(shards, "id").withColumn("shard", F.explode("shards")), "members")
    edges = members.select("shard", "id", "v").groupBy("shard").applyInArrow(_graph(percent), "src long, dst long")
    lists = stage(edges.groupBy("src").agg(F.collect_set("dst").alias("neighbours")), "lists")
    rows = members.join(lists, members.id == lists.src, "left").drop("src")
    return rows.groupBy("shard").applyInArrow(_searched(percent), "id long, links long, root long")


def near_duplicates(vectors: DataFrame, percent: int = 90, overlap: int = OVERLAP) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of ``vectors`` (vec_id, embedding)."""
    tune(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))
    sound = F.expr("vec_id IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < cast('infinity' AS double)) AND exists(v, x -> x <> 0)")
    rows = rows.withColumn("ok", F.coalesce(sound, F.lit(False))).withColumn("x", F.xxhash64("v")).withColumn("y", F.xxhash64(F.col("v").cast("string"), F.lit(7)))
    rows = stage(rows, "vectors")
    whole = rows.where("ok").groupBy("x", "y").agg(F.min("vec_id").alias("id"), F.count("*").alias("w"))
    whole = stage(whole, "classes")
    picked = rows.where("ok").join(whole.withColumnRenamed("id", "vec_id"), ["x", "y", "vec_id"]).groupBy(F.col("vec_id").alias("id")).agg(F.max("w").alias("w"), F.first("v").alias("v"))
    classes = stage(picked, "picked")
    while True:
        local = stage(_linked(classes, percent, overlap), "local")
        found = stage(local.groupBy("id").agg(F.sum("links").alias("links")), "links")
        recall = audit(classes, found, percent)
        _log.info("recall %.4f of links with an overlap of %d", recall, overlap)
        if recall >= RECALL or overlap >= MOST_OVERLAP and recall >= LEAST:
            break
        if overlap >= MOST_OVERLAP:
            raise RuntimeError(f"a recall of {recall:.3f} only, with an overlap of {overlap}")
        overlap *= 2
    same = rows.where("ok").join(whole, ["x", "y"]).where("vec_id <> id").select(F.col("vec_id").alias("u"), F.col("id").alias("v"))
    roots = connected_components(local.where("id <> root").select(F.col("id").alias("u"), F.col("root").alias("v")).union(same))
    known = whole.join(found, "id", "left").join(roots, F.col("id") == F.col("node"), "left")
    known = stage(known.select("x", "y", F.lit(True).alias("ok"), (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("root", "id").alias("component_id")), "known")
    out = rows.join(known, ["x", "y", "ok"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
