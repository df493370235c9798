"""Approximate nearest neighbours by learned partitions.

On a bounded sample the exact neighbour graph is cut into partitions of
equal size (spectral bisection, then balanced moves to the partition of
most neighbours). A small classifier learns where the neighbours of a
vector lie. Every vector is indexed in its most probable partition; a
query goes to its most probable partitions, as many as hold the share of
probability that held-out sample queries needed to find ``RECALL`` of their
neighbours, and on down the ranking while these hold too few vectors to
fill its list. In these partitions the query meets every vector and is ranked
by the exact cosine.

The partitions grow in number with the vectors: one that holds more than
``LEAF_ROWS`` vectors, and more than ``LEAF_ROOT`` times the root of their
number, is cut again by a router fitted on a sample of its own vectors, one
task for each, so routers form a tree of at most ``LEVELS`` levels. The
share of a tree is fitted anew, on the true neighbours of ``CALIBRATE``
vectors among all rows, found in one pass. A tree has about 1/16 of the
root of the number of vectors as leaves, which bounds what tasks are sent
(a router is about 50 kB for 64 components; a billion vectors have about
60 of them).

A partition is dealt into blocks of index vectors and blocks of queries,
by counts taken beforehand, so a popular partition (a third of all vectors
may be copies of one) is many tasks of bounded size. A task returns the
best few of each of its queries.

Defined results: vectors that are null, zero, or hold null or non-finite
components take no part, nor do null ids or vectors of another length than
the sample's first; rows of one id are one vector (the smallest); a query
never finds its own id; ties go to the smaller id; with fewer candidates
all are returned.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.words import xxh64_of_long
from cadenza.session import checkpoint

#: Vectors that the fit may use; the last quarter sets the routing share.
SAMPLE_ROWS = 4096
PARTITIONS = 32
NEIGHBOURS = 10
RECALL = 0.95
HIDDEN, STEPS, RATE = 64, 300, 0.01
#: A partition of more vectors than both bounds allow is cut again.
LEAF_ROWS, LEAF_ROOT, LEVELS = 32_768, 32, 8
#: Vectors whose true neighbours set the share of a tree.
CALIBRATE = 256
#: Index vectors and queries that meet in one task at most (about).
INDEX_BLOCK, QUERY_BLOCK = 4096, 8192
#: Tables of repeated ids are broadcast up to this many rows.
BROADCAST_IDS = 100_000
#: Scores this near to the last one kept are computed again, exactly.
SLACK = 1e-9


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def neighbour_graph(u: np.ndarray, k: int) -> np.ndarray:
    """The k nearest other rows of every unit row."""
    out = np.zeros((len(u), min(k, len(u) - 1)), int)
    for i in range(0, len(u), 512):
        s = u[i:i + 512] @ u.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        out[i:i + 512] = np.argsort(-s, axis=1, kind="stable")[:, :out.shape[1]]
    return out


def balanced_partitions(graph: np.ndarray, parts: int, seed: int = 6) -> np.ndarray:
    """A partition of every node, of equal sizes, that cuts few edges."""
    n = len(graph)
    w = np.zeros((n, n), np.float32)
    w[np.arange(n)[:, None], graph] = 1
    w = np.maximum(w, w.T)
    rng = np.random.default_rng(seed)
    part = np.zeros(n, int)

    def bisect(nodes: np.ndarray, first: int, count: int) -> None:
        part[nodes] = first
        if count == 1:
            return
        sub = w[np.ix_(nodes, nodes)]
        root = np.sqrt(sub.sum(1) + 1e-3)
        trivial = root / np.linalg.norm(root)
        x = rng.standard_normal(len(nodes)).astype(np.float32)
        for _ in range(80):
            x -= trivial * (trivial @ x)
            x = 0.5 * x + 0.5 * (sub @ (x / root)) / root
            x /= np.linalg.norm(x) + 1e-30
        order = np.argsort(x, kind="stable")
        half = len(nodes) * (count // 2) // count
        bisect(np.sort(nodes[order[:half]]), first, count // 2)
        bisect(np.sort(nodes[order[half:]]), first + count // 2, count - count // 2)

    bisect(np.arange(n), 0, parts)
    limit = int(np.ceil(1.05 * n / parts))
    for _ in range(5):
        inside = w @ np.eye(parts, dtype=np.float32)[part]
        best = inside.argmax(1)
        gain = inside[np.arange(n), best] - inside[np.arange(n), part]
        size = np.bincount(part, minlength=parts)
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] > 0 and size[best[i]] < limit:
                size[part[i]] -= 1
                size[best[i]] += 1
                part[i] = best[i]
    return part


@dataclass
class Router:
    """The classifier and the share of probability a query is routed by;
    ``children`` are the routers of partitions that are cut again. Leaves
    are the partitions that are not, numbered from 0 in order."""
    layers: list[np.ndarray]
    share: float
    dim: int
    children: dict[int, Router] = field(default_factory=dict)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.layers
        z = np.maximum(x @ a + b, 0) @ c + d
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def before(self, p: np.ndarray) -> np.ndarray:
        """Probability of all partitions more likely than each."""
        order = np.argsort(-p, axis=1, kind="stable")
        rows = np.arange(len(p))[:, None]
        ranked = p[rows, order]
        out = np.zeros_like(p)
        out[rows, order] = np.cumsum(ranked, axis=1) - ranked
        return out

    def leaves(self) -> list[tuple[Router, int]]:
        """(router, partition) of every leaf."""
        return [leaf for part in range(len(self.layers[-1])) for leaf in
                (self.children[part].leaves() if part in self.children else [(self, part)])]

    def _first(self) -> np.ndarray:
        """Number of the first leaf in each partition."""
        size = np.ones(len(self.layers[-1]), int)
        for part, child in self.children.items():
            size[part] = len(child.leaves())
        return np.cumsum(size) - size

    def home(self, u: np.ndarray) -> np.ndarray:
        """The leaf that each vector is indexed in."""
        best = self.probabilities(u).argmax(1)
        out = self._first()[best]
        for part, child in self.children.items():
            at = np.flatnonzero(best == part)
            if len(at):
                out[at] += child.home(u[at])
        return out

    def needed(self, q: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The share from which each query reaches the home of its vector."""
        best = self.probabilities(u).argmax(1)
        out = self.before(self.probabilities(q))[np.arange(len(q)), best]
        for part, child in self.children.items():
            at = np.flatnonzero(best == part)
            if len(at):
                out[at] = np.maximum(out[at], child.needed(q[at], u[at]))
        return out

    def chances(self, u: np.ndarray) -> np.ndarray:
        """Probability of every leaf."""
        p = self.probabilities(u)
        return np.hstack([p[:, [part]] * self.children[part].chances(u) if part in self.children else p[:, [part]]
                          for part in range(p.shape[1])])

    def _within(self, u: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
        rows, parts = np.nonzero(self.before(self.probabilities(u)) <= share)
        first = self._first()
        plain = ~np.isin(parts, list(self.children))
        found = [(rows[plain], first[parts[plain]])]
        for part, child in self.children.items():
            at = rows[parts == part]
            if len(at):
                r, leaf = child._within(u[at], share)
                found.append((at[r], first[part] + leaf))
        return tuple(np.concatenate(side) for side in zip(*found))

    def asked(self, u: np.ndarray, held: np.ndarray | None = None, least: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of the leaves asked: by the share, and where ``held``
        vectors a leaf are given, on by probability until ``least`` are
        reached."""
        row, leaf = self._within(u, self.share)
        if held is None:
            return row, leaf
        short = np.flatnonzero(np.bincount(row, held[leaf], len(u)) < least)
        pairs = [np.stack([row, leaf])]
        for i in range(0, len(short), 256):
            p = self.chances(u[short[i:i + 256]])
            order = np.argsort(-p, axis=1, kind="stable")
            ranked = held[order]
            r, at = np.nonzero((np.cumsum(ranked, axis=1) - ranked < least) & (ranked > 0))
            pairs.append(np.stack([short[i + r], order[r, at]]))
        return tuple(np.unique(np.concatenate(pairs, axis=1), axis=1)) if len(short) else (row, leaf)


def _train(u: np.ndarray, goal: np.ndarray, seed: int = 6) -> list[np.ndarray]:
    """Cross entropy with soft labels, by Adam over all rows."""
    rng = np.random.default_rng(seed)
    p = goal.shape[1]
    layers = [rng.standard_normal((u.shape[1], HIDDEN)) * np.sqrt(2), np.zeros(HIDDEN),
              rng.standard_normal((HIDDEN, p)) / np.sqrt(HIDDEN), np.zeros(p)]
    m, v = [np.zeros_like(x) for x in layers], [np.zeros_like(x) for x in layers]
    for step in range(1, STEPS + 1):
        a, b, c, d = layers
        h = np.maximum(u @ a + b, 0)
        z = h @ c + d
        z = np.exp(z - z.max(1, keepdims=True))
        dz = (z / z.sum(1, keepdims=True) - goal) / len(u)
        dh = (dz @ c.T) * (h > 0)
        grads = [u.T @ dh + 1e-4 * a, dh.sum(0), h.T @ dz + 1e-4 * c, dz.sum(0)]
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            layers[i] = layers[i] - RATE * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return layers


def fit_router(x: np.ndarray, parts: int = PARTITIONS) -> Router:
    """Partition a sample's neighbour graph and learn to route."""
    dim = x.shape[1]
    u = _unit(np.unique(x, axis=0))
    u = u[np.random.default_rng(6).permutation(len(u))]
    held = len(u) // 4
    fit, test = u[held:], u[:held]
    parts = max(1, min(parts, len(fit) // 32))
    if parts == 1:
        return Router([np.zeros((dim, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)], 1.0, dim)
    graph = neighbour_graph(fit, NEIGHBOURS)
    part = balanced_partitions(graph, parts)
    goal = np.zeros((len(fit), parts))
    np.add.at(goal, (np.arange(len(fit)), part), 1.0)
    np.add.at(goal, (np.repeat(np.arange(len(fit)), graph.shape[1]), part[graph].ravel()), 1.0)
    router = Router(_train(fit, goal / goal.sum(1, keepdims=True)), 1.0, dim)
    home = router.probabilities(fit).argmax(1)
    near = np.argsort(-(test @ fit.T), axis=1, kind="stable")[:, :NEIGHBOURS]
    before = router.before(router.probabilities(test))
    needed = before[np.arange(len(test))[:, None], home[near]]
    router.share = float(np.quantile(needed, RECALL)) + 1e-12
    return router


def _valid(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.col(vec_col)
    finite = ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.select(F.col(id_col).cast("bigint").alias("id"), v.cast("array<double>").alias("v")) \
        .filter(F.col("id").isNotNull() & F.col("v").isNotNull()) \
        .filter(finite & F.exists("v", lambda c: c != 0.0))


def _one_vector_each(rows: DataFrame) -> DataFrame:
    """Rows ``id, v`` with one row of each id, that of the smallest vector.
    Ids that occur once go through no shuffle while the others are few."""
    many = rows.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id")
    many = checkpoint(many, gather=True)
    n = many.count()
    if n == 0:
        return rows
    if n > BROADCAST_IDS:
        return checkpoint(rows.groupBy("id").agg(F.min("v").alias("v")))
    some = rows.join(F.broadcast(many), "id", "left_semi").groupBy("id").agg(F.min("v").alias("v"))
    return rows.join(F.broadcast(many), "id", "left_anti").unionByName(checkpoint(some, gather=True))


def _matrix(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors of the right length)."""
    lists = batch.column(1)
    batch = batch.filter(pa.compute.equal(pa.compute.list_value_length(lists), dim))
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    return ids, batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _counts(router: Router, every: int, held=None, least: int = 0):
    leaves = len(router.leaves())

    def run(batches):
        for batch in batches:
            ids, x = _matrix(batch, router.dim)
            if not len(ids):
                continue
            u = _unit(x)
            n = np.bincount(router.home(u), minlength=leaves)
            asked = np.bincount(router.asked(u[ids % every == 0], held, least)[1], minlength=leaves)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(leaves)), pa.array(n.astype(np.int64)),
                                              pa.array(asked.astype(np.int64))], ["part", "n", "asked"])
    return run


def _counted(rows: DataFrame, router: Router, every: int, *reach) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and queries of every leaf."""
    n, asked = np.zeros(len(router.leaves()), int), np.zeros(len(router.leaves()), int)
    for r in rows.mapInArrow(_counts(router, every, *reach), "part bigint, n bigint, asked bigint") \
            .groupBy("part").agg(F.sum("n").alias("n"), F.sum("asked").alias("asked")).collect():
        n[r["part"]], asked[r["part"]] = r["n"], r["asked"]  # a row for each leaf of the router
    return n, asked


def _deal(router: Router, every: int, base, n_blocks, q_blocks, held=None, least: int = 0):
    """Rows for the tasks: index vectors to each query block of their
    leaf, queries to each index block of the leaves asked."""

    def run(batches):
        for batch in batches:
            ids, x = _matrix(batch, router.dim)
            if not len(ids):
                continue
            u = _unit(x)
            h = (xxh64_of_long(ids.astype(np.int64)) >> np.uint64(1)).astype(np.int64)
            home = router.home(u)
            copies = q_blocks[home]
            row = np.repeat(np.arange(len(ids)), copies)
            j = np.arange(len(row)) - np.repeat(np.cumsum(copies) - copies, copies)
            task = base[home[row]] + (h[row] % n_blocks[home[row]]) * q_blocks[home[row]] + j
            yield _rows(task, False, ids, x, row)
            queries = np.flatnonzero(ids % every == 0)
            row, part = router.asked(u[queries], held, least)
            row = queries[row]
            copies = n_blocks[part]
            at = np.repeat(np.arange(len(row)), copies)
            i = np.arange(len(at)) - np.repeat(np.cumsum(copies) - copies, copies)
            row, part = row[at], part[at]
            task = base[part] + i * q_blocks[part] + h[row] % q_blocks[part]
            yield _rows(task, True, ids, x, row)

    def _rows(task, query, ids, x, row):
        vecs = pa.array([v.tobytes() for v in x], pa.binary()).take(pa.array(row))
        return pa.RecordBatch.from_arrays(
            [pa.array(task.astype(np.int64)), pa.array(np.full(len(row), query)),
             pa.array(ids[row].astype(np.int64)), vecs], ["task", "query", "id", "vec"])

    return run


def _one_each(ids: np.ndarray, vecs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids in order, once, with their smallest vector."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i], vecs[i]))
    keep = [i for k, i in enumerate(order) if k == 0 or ids[order[k - 1]] != ids[i]]
    return ids[keep], np.frombuffer(b"".join(vecs[i] for i in keep), np.float64).reshape(len(keep), -1)


def _best(k: int):
    def run(table: pa.Table) -> pa.Table:
        is_query = table.column("query").to_numpy()
        ids, vecs = table.column("id").to_numpy(), table.column("vec").to_pylist()
        q_at, x_at = np.flatnonzero(is_query), np.flatnonzero(~is_query)
        out_q, out_v, out_s = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if len(q_at) and len(x_at):
            q_ids, q = _one_each(ids[q_at], [vecs[i] for i in q_at])
            x_ids, x = _one_each(ids[x_at], [vecs[i] for i in x_at])
            q_norm, x_norm = np.sqrt((q * q).sum(1)), np.sqrt((x * x).sum(1))
            xu = (x / x_norm[:, None]).T
            for i in range(0, len(q), 256):
                s = (q[i:i + 256] / q_norm[i:i + 256, None]) @ xu
                s[q_ids[i:i + 256, None] == x_ids[None, :]] = -np.inf
                last = np.partition(s, max(0, s.shape[1] - k), axis=1)[:, max(0, s.shape[1] - k)]
                for r in range(len(s)):
                    c = np.flatnonzero((s[r] >= last[r] - SLACK) & (s[r] > -np.inf))
                    exact = (x[c] * q[i + r]).sum(1) / (x_norm[c] * q_norm[i + r])
                    c2 = np.lexsort((x_ids[c], -exact))[:k]
                    out_q.append(np.full(len(c2), q_ids[i + r]))
                    out_v.append(x_ids[c[c2]])
                    out_s.append(exact[c2])
        return pa.table({"query_id": np.concatenate(out_q), "vec_id": np.concatenate(out_v),
                         "score": np.concatenate(out_s)})
    return run


def fit(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
        parts: int = PARTITIONS) -> Router | None:
    """A router from the ``SAMPLE_ROWS`` vectors of smallest id hash."""
    rows = _valid(vectors, id_col, vec_col).orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).collect()
    if not rows:
        return None
    dim = len(rows[0]["v"])
    return fit_router(np.array([r["v"] for r in rows if len(r["v"]) == dim], float), parts)


def _draw(router: Router, rates: np.ndarray):
    """The share ``rates`` of the vectors of each leaf, by their ids."""
    def run(batches):
        for batch in batches:
            ids, x = _matrix(batch, router.dim)
            if not len(ids):
                continue
            home = router.home(_unit(x))
            at = np.flatnonzero(xxh64_of_long(ids.astype(np.int64)) / 2.0**64 < rates[home])
            yield pa.RecordBatch.from_arrays([pa.array(home[at].astype(np.int64)),
                                              pa.array([v.tobytes() for v in x[at]], pa.binary())], ["leaf", "vec"])
    return run


def _fit_leaf(dim: int, parts: np.ndarray):
    def run(table: pa.Table) -> pa.Table:
        leaf = table.column("leaf")[0].as_py()
        x = np.frombuffer(b"".join(table.column("vec").to_pylist()), np.float64).reshape(-1, dim)
        return pa.table({"leaf": [leaf], "router": [pickle.dumps(fit_router(x, int(parts[leaf])))]})
    return run


def _nearest_to(q_ids: np.ndarray, q: np.ndarray, k: int):
    """The ``k`` nearest vectors of a task to each of a few queries."""
    def run(batches):
        best = [(np.zeros(0), np.zeros(0, np.int64), np.zeros((0, q.shape[1])))] * len(q)
        for batch in batches:
            ids, x = _matrix(batch, q.shape[1])
            if not len(ids):
                continue
            s = q @ _unit(x).T
            s[q_ids[:, None] == ids[None, :]] = -np.inf
            for i, (score, own, vec) in enumerate(best):
                top = np.argpartition(-s[i], min(k, len(ids)) - 1)[:k]
                score, own = np.concatenate([score, s[i, top]]), np.concatenate([own, ids[top]])
                keep = np.lexsort((own, -score))[:k]
                best[i] = score[keep], own[keep], np.concatenate([vec, x[top]])[keep]
        for i, (score, own, vec) in enumerate(best):
            real = score > -np.inf
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(real.sum(), i)), pa.array(score[real]), pa.array(own[real].astype(np.int64)),
                 pa.array([v.tobytes() for v in vec[real]], pa.binary())], ["query", "score", "id", "vec"])
    return run


def grow(rows: DataFrame, router: Router) -> Router:
    """Cuts the partitions of ``router`` again that hold too many of the
    vectors ``id, v`` (one row of each id), until none does or none can be
    cut (copies of one vector cannot), and fits the share of the tree."""
    for _ in range(LEVELS):
        n, _ = _counted(rows, router, 1 << 62)
        most = max(LEAF_ROWS, LEAF_ROOT * int(np.sqrt(n.sum())))
        wide = n > most
        if not wide.any():
            break
        drawn = rows.mapInArrow(_draw(router, np.where(wide, SAMPLE_ROWS / np.maximum(n, 1), 0.0)), "leaf bigint, vec binary")
        parts = np.clip(-(-2 * n // most), 2, PARTITIONS)
        fitted = drawn.groupBy("leaf").applyInArrow(_fit_leaf(router.dim, parts), "leaf bigint, router binary").collect()
        places, cut = router.leaves(), False
        for r in fitted:  # a router for each leaf that is cut
            child = pickle.loads(r["router"])
            if len(child.layers[-1]) > 1:
                parent, part = places[r["leaf"]]
                parent.children[part], cut = child, True
        if not cut:
            break
    if router.children:
        few = rows.orderBy(F.xxhash64("id", F.lit("calibrate")), "id").limit(CALIBRATE).collect()
        q = _unit(np.array([r["v"] for r in few], float))
        near = rows.mapInArrow(_nearest_to(np.array([r["id"] for r in few]), q, NEIGHBOURS),
                               "query bigint, score double, id bigint, vec binary")
        order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
        near = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= NEIGHBOURS).collect()
        x = np.frombuffer(b"".join(r["vec"] for r in near), np.float64).reshape(-1, router.dim)
        router.share = float(np.quantile(router.needed(q[[r["query"] for r in near]], _unit(x)), RECALL)) + 1e-12
    return router


def _rows_of(vectors: DataFrame, router: Router, id_col: str, vec_col: str) -> DataFrame:
    return _one_vector_each(_valid(vectors, id_col, vec_col).filter(F.size("v") == router.dim))


def search(vectors: DataFrame, router: Router | None, k: int = 5, every: int = 50,
           id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` nearest found of every
    row whose id is divisible by ``every``."""
    if router is None:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    return _found(_rows_of(vectors, router, id_col, vec_col), router, k, every)


def _found(rows: DataFrame, router: Router, k: int, every: int) -> DataFrame:
    n, asked = _counted(rows, router, every)
    reach = ()
    if n.min() <= k:  # a query may need more leaves than its share; it never finds itself
        reach = (n, k + 1)
        n, asked = _counted(rows, router, every, *reach)
    n_blocks, q_blocks = -(-n // INDEX_BLOCK), -(-asked // QUERY_BLOCK)
    n_blocks = np.maximum(n_blocks, 1)
    tasks = n_blocks * q_blocks
    base = np.cumsum(tasks) - tasks
    dealt = rows.mapInArrow(_deal(router, every, base, n_blocks, q_blocks, *reach),
                            "task bigint, query boolean, id bigint, vec binary")
    found = dealt.groupBy("task").applyInArrow(_best(k), "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")


def search_each_length(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id",
                       vec_col: str = "embedding", parts: int = PARTITIONS) -> DataFrame:
    """:func:`search` among the vectors of each length, with a tree of
    routers of their own: vectors of different lengths have no cosine."""
    usable = _valid(vectors, id_col, vec_col)
    out = None
    for size in sorted(r["n"] for r in usable.select(F.size("v").alias("n")).distinct().collect()):
        own = vectors.filter(F.size(vec_col) == size)
        router = fit(own, id_col, vec_col, parts)
        if router is None:
            continue
        rows = _rows_of(own, router, id_col, vec_col)
        found = _found(rows, grow(rows, router), k, every)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else search(vectors, None, k, every, id_col, vec_col)
