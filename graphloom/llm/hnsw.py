"""Embedding near-duplicates: hierarchical navigable small-world graphs, one a shard."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyarrow import fs
from pyspark.sql import functions as F

from . import lookup
from .common import cut, own_dir, parts, table
from .components import components

COSINE = 0.93
#: Vectors of a shard: the memory bound of a task.
SHARD = 16_384
M, BUILD_BEAM, FIRST_BEAM = 12, 64, 32
#: Queries that one task puts to a shard, so that a label of any size is many tasks' work.
CHUNK = 8_192
#: Share of a shard's audited links that a beam must find; and one of how many vectors is audited at first.
RECALL, AUDIT = 0.995, 20
#: Fewest links to other vectors that prove the recall: were it less, chance would find them all in under 5 % of audits.
PROOF = math.ceil(math.log(0.05) / math.log(RECALL))
BLOCK = 256


class Graph:
    """A small-world graph over unit rows; the search moves a block of queries at a time.

    Levels are drawn from a fixed seed, so that a shard's graph is the same in each
    attempt. Neighbours are chosen for spread: one that is nearer to a chosen
    neighbour than to the row is passed over while there are others.
    """

    def __init__(self, x: np.ndarray, m: int = M, beam: int = BUILD_BEAM, seed: int = 5) -> None:
        self.x = np.ascontiguousarray(x, np.float32)
        n = len(x)
        rnd = np.random.default_rng(seed)
        level = np.minimum((-np.log(rnd.random(n) + 1e-12) / np.log(m)).astype(int), 6)
        # rows of higher levels go in first: they are the way in for all others
        self.order = np.lexsort((np.arange(n), -level))
        self.level, self.m = level, m
        top = int(level.max(initial=0))
        self.near = [np.full((n, 2 * m if k == 0 else m), -1, np.int32) for k in range(top + 1)]
        self.entry = int(self.order[0]) if n else -1
        for k in range(top, -1, -1):  # level by level: all its rows link among themselves
            self._fill(k, self.order[level[self.order] >= k], beam)
        if n:
            self._mend()

    def _reached(self) -> np.ndarray:
        got = np.zeros(len(self.x), bool)
        front = np.array([self.entry])
        got[front] = True
        while len(front):
            to = np.unique(self.near[0][front])
            front = to[(to >= 0) & ~got[to]]
            got[front] = True
        return got

    def _mend(self) -> None:
        """Rows that no path leads to, as all others preferred nearer ones, get one from the nearest row that is reached."""
        while not (got := self._reached()).all():
            lost, there = np.flatnonzero(~got), np.flatnonzero(got)
            self.near[0] = np.pad(self.near[0], ((0, 0), (0, 1)), constant_values=-1)
            free = np.ones(len(self.x), bool)
            for a in range(0, len(lost), BLOCK):
                some = lost[a : a + BLOCK]
                ids, _ = self._beam(self.x[some], self._descend(self.x[some], 0), 0, BUILD_BEAM)
                for row, near in zip(some.tolist(), ids.tolist(), strict=True):
                    at = next((i for i in near if i >= 0 and got[i] and free[i]), -1)
                    at = at if at >= 0 else int(there[row % len(there)])
                    if free[at]:
                        self.near[0][at, -1], free[at] = row, False

    def _fill(self, k: int, rows: np.ndarray, beam: int) -> None:
        first = min(len(rows), BLOCK)
        self._link(k, rows[:first], np.broadcast_to(rows[:first], (first, first)))
        at = first
        while at < len(rows):
            some = rows[at : at + BLOCK]
            found, _ = self._beam(self.x[some], self._descend(self.x[some], k), k, beam)
            also = np.broadcast_to(some, (len(some), len(some)))  # rows of one block see one another
            self._link(k, some, np.concatenate([found, also], axis=1))
            at += len(some)

    def _spread(self, row: np.ndarray, cand: np.ndarray, width: int) -> np.ndarray:
        """For each row, up to width of its candidates (-1: none), nearest first, spread out."""
        sim = np.einsum("qd,qcd->qc", self.x[row], self.x[cand])
        sim[(cand < 0) | (cand == row[:, None])] = -np.inf
        keep = min(cand.shape[1], 4 * width)
        top = np.argsort(-sim, axis=1, kind="stable")[:, :keep]
        cand, sim = np.take_along_axis(cand, top, 1), np.take_along_axis(sim, top, 1)
        v = self.x[cand]
        among = np.einsum("qad,qbd->qab", v, v)
        chosen = np.zeros(cand.shape, bool)
        same = (cand[:, :, None] == cand[:, None, :]) & np.tri(keep, k=-1, dtype=bool)[None]
        twice = same.any(axis=2)
        for c in range(keep):
            shaded = (chosen & (among[:, c, :] > sim[:, c, None])).any(axis=1)
            chosen[:, c] = ~shaded & ~twice[:, c] & np.isfinite(sim[:, c]) & (chosen.sum(axis=1) < width)
        # places left over go to the nearest that were passed over
        rank = np.where(chosen, 0, np.where(np.isfinite(sim) & ~twice, 1, 2)) * keep + np.arange(keep)
        pick = np.argsort(rank, axis=1)[:, :width]
        out = np.take_along_axis(cand, pick, 1)
        out[np.take_along_axis(rank, pick, 1) >= 2 * keep] = -1
        if out.shape[1] < width:
            out = np.pad(out, ((0, 0), (0, width - out.shape[1])), constant_values=-1)
        return out

    def _link(self, k: int, rows: np.ndarray, cand: np.ndarray) -> None:
        near, width = self.near[k], self.near[k].shape[1]
        for a in range(0, len(rows), 64):
            near[rows[a : a + 64]] = self._spread(rows[a : a + 64], cand[a : a + 64], width)
        src = np.repeat(rows, width)
        dst = near[rows].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        cuts = np.flatnonzero(np.r_[True, dst[1:] != dst[:-1]]) if len(dst) else np.empty(0, int)
        ends = np.r_[cuts[1:], len(dst)]
        targets = dst[cuts] if len(dst) else dst
        for a in range(0, len(targets), 64):
            t = targets[a : a + 64]
            most = int((ends[a : a + 64] - cuts[a : a + 64]).max())
            back = np.full((len(t), most), -1, np.int32)
            for i, (s, e) in enumerate(zip(cuts[a : a + 64], ends[a : a + 64], strict=True)):
                back[i, : e - s] = src[s:e]
            near[t] = self._spread(t, np.concatenate([near[t], back], axis=1), width)

    def _descend(self, q: np.ndarray, to: int) -> np.ndarray:
        at = np.full(len(q), self.entry, np.int64)
        for k in range(len(self.near) - 1, to, -1):
            while True:
                n = self.near[k][at]
                sim = np.where(n >= 0, np.einsum("qd,qcd->qc", q, self.x[n]), -np.inf)
                best = sim.argmax(axis=1)
                better = sim[np.arange(len(q)), best] > np.einsum("qd,qd->q", q, self.x[at])
                if not better.any():
                    break
                at = np.where(better, n[np.arange(len(q)), best], at)
        return at

    def _beam(self, q: np.ndarray, start: np.ndarray, k: int, beam: int, step: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """The nearest rows met, best first, (ids, similarity); -1 where fewer were."""
        n, near = len(q), self.near[k]
        ids = np.full((n, beam), -1, np.int64)
        sim = np.full((n, beam), -np.inf, np.float32)
        done = np.zeros((n, beam), bool)
        seen = np.zeros((n, len(self.x) + 1), bool)
        who = np.arange(n)
        ids[:, 0], sim[:, 0] = start, np.einsum("qd,qd->q", q, self.x[start])
        seen[who, start] = True
        seen[:, -1] = True
        while len(who):
            open_ = np.where(done[who] | (ids[who] < 0), -np.inf, sim[who])
            pick = np.argsort(-open_, axis=1)[:, :step]
            live = np.isfinite(np.take_along_axis(open_, pick, 1))
            some = live.any(axis=1)
            who, pick, live = who[some], pick[some], live[some]
            if not len(who):
                break
            rows, cols = np.nonzero(live)
            done[who[rows], pick[rows, cols]] = True
            new = np.where(live[:, :, None], near[np.where(live, ids[who[:, None], pick], 0)], -1).reshape(len(who), -1)
            new = np.sort(new, axis=1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
            new[seen[who[:, None], new]] = -1
            seen[who[:, None], new] = True
            s = np.where(new >= 0, np.einsum("qd,qcd->qc", q[who], self.x[new]), -np.inf)
            all_s, all_i = np.concatenate([sim[who], s], axis=1), np.concatenate([ids[who], new], axis=1)
            all_d = np.concatenate([done[who], np.zeros(new.shape, bool)], axis=1)
            top = np.argsort(-all_s, axis=1, kind="stable")[:, :beam]
            ids[who], sim[who], done[who] = np.take_along_axis(all_i, top, 1), np.take_along_axis(all_s, top, 1), np.take_along_axis(all_d, top, 1)
        return ids, sim

    def near_to(self, q: np.ndarray, beam: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) of all similarities of at least `least` that a beam finds; queries that fill it are compared with all rows."""
        out, wide = [], []
        size = max(16, min(BLOCK, (1 << 24) // (beam * 64)))
        for a in range(0, len(q), size):
            some = np.arange(a, min(a + size, len(q)))
            ids, sim = self._beam(q[some], self._descend(q[some], 0), 0, beam)
            full = (sim[:, -1] >= least) & (beam < len(self.x))
            r, c = np.nonzero((sim >= least) & ~full[:, None])
            out.append((some[r], ids[r, c]))
            wide.append(some[full])
        if wide:  # a beam as wide as a dense place meets more rows, one by one, than the shard has
            rest = np.concatenate(wide)
            out.append(_pairs(rest, exact(self.x, q[rest], least)))
        return (np.concatenate([i for i, _ in out]), np.concatenate([j for _, j in out])) if out else (np.empty(0, int), np.empty(0, int))


def exact(x: np.ndarray, q: np.ndarray, least: float) -> list[np.ndarray]:
    """Rows of at least that similarity to each query, by brute force in blocks."""
    return [np.flatnonzero(row) for a in range(0, len(q), BLOCK) for row in q[a : a + BLOCK] @ x.T >= least]


def _pairs(queries: np.ndarray, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(queries, np.fromiter(map(len, rows), int, len(rows))), np.concatenate([np.empty(0, int), *rows])


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _audit(g: Graph, q: np.ndarray, own: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(audited, query, row): the true links of the audited queries, without those to their own rows.

    One query in AUDIT is audited, and twice as many until their links prove the recall
    or no query is left. Links of queries that fill a first beam prove nothing, as those
    are compared with all rows. Queries are taken in an order that strides over all of them.
    """
    order = np.concatenate([np.arange(k, len(q), AUDIT) for k in range(AUDIT)])
    done, n, proof, i, j = 0, -(-len(q) // AUDIT), 0, [], []
    while True:
        some = order[done:n]
        u, v = _pairs(some, exact(g.x, q[some], least))
        real = v != own[u]
        proof += (real & (np.bincount(u, minlength=len(q))[u] < FIRST_BEAM)).sum()
        i.append(u[real])
        j.append(v[real])
        done = n
        if proof >= PROOF or done == len(q):
            return order[:done], np.concatenate(i), np.concatenate(j)
        n = min(2 * n, len(q))


def _proven(g: Graph, q: np.ndarray, own: np.ndarray, least: float, beam: int, truth: np.ndarray) -> bool:
    """Whether the queries that a beam answers find RECALL of their links; truth: the query of each true link."""
    i, j = g.near_to(q, beam, least)
    answered = np.bincount(i, minlength=len(q)) < beam  # the others were compared with all rows
    return (answered[i] & (j != own[i])).sum() >= RECALL * answered[truth].sum()


def links_between(have: np.ndarray, ask: np.ndarray, cosine: float = COSINE, graph: Graph | None = None, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of cosine >= `cosine`, candidates from the graph, each verified in double precision.

    own: the row that a query itself is, -1 for none; a link to it is none. The beam is
    doubled until the audited queries find the links that brute force does; these keep
    brute force's links, the others are asked with that beam. Where that takes a beam
    as wide as the shard, or so few queries have links that all of them were audited,
    all queries are compared in blocks.
    """
    if not len(have) or not len(ask):
        return np.empty(0, int), np.empty(0, int)
    a, b = _unit(have.astype(np.float64)), _unit(ask.astype(np.float64))
    slack = np.float32(cosine - 1e-5)
    g = graph or Graph(a)
    q = b.astype(np.float32)
    if own is None:
        own = np.full(len(q), -1)
    audited, i, j = _audit(g, q, own, slack)
    if len(audited) < len(q):
        at, beam = np.empty(len(q), int), FIRST_BEAM
        at[audited] = np.arange(len(audited))
        while beam < len(a) and not _proven(g, q[audited], own[audited], slack, beam, at[i]):
            beam *= 2
        rest = np.setdiff1d(np.arange(len(q)), audited)
        if beam < len(a):
            u, v = g.near_to(q[rest], beam, slack)
            u = rest[u]
        else:
            u, v = _pairs(rest, exact(g.x, q[rest], slack))
        real = v != own[u]
        i, j = np.concatenate([i, u[real]]), np.concatenate([j, v[real]])
    keep = np.concatenate([np.einsum("nd,nd->n", b[i[s : s + 65536]], a[j[s : s + 65536]]) >= cosine for s in range(0, len(i), 65536)]) if len(i) else np.empty(0, bool)
    return i[keep], j[keep]


def _rows(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """(tasks, ids, components, where each row's begin, where a task's rows begin) of rows (task, node, embedding)."""
    tasks, ids = (b.column(k).to_numpy(zero_copy_only=False) for k in range(2))
    flat = b.column(2)
    cuts = [0, *(np.flatnonzero(tasks[1:] != tasks[:-1]) + 1).tolist(), len(tasks)]
    return tasks, ids, flat.flatten().to_numpy(zero_copy_only=False), flat.offsets.to_numpy() - flat.offsets[0].as_py(), cuts


def _by_task(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Rows sorted by task to (task, ids, vectors), a task in pieces of about `most` rows."""
    task, held, n = None, [], 0
    for b in batches:
        tasks, ids, x, at, cuts = _rows(b)
        for s, e in zip(cuts, cuts[1:], strict=False):
            if s == e:
                continue
            if held and (tasks[s] != task or most and n >= most):
                yield task, np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
                held, n = [], 0
            task = tasks[s]
            held.append((ids[s:e], x[at[s] : at[e]].reshape(e - s, -1)))
            n += e - s
    if held:
        yield task, np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])


def _builder(to: str):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (shard, node, embedding), sorted, to a graph's files for each shard."""
        system, root = fs.FileSystem.from_uri(to)
        n = 0
        for shard, ids, x in _by_task(batches):
            g = Graph(_unit(x.astype(np.float64)))
            files = {"ids": ids, "rows": x.astype("<f8")} | {f"near{k}": v for k, v in enumerate(g.near)}
            files["head"] = np.array([len(x), x.shape[1], g.entry, *(v.shape[1] for v in g.near)], "<i8")
            for k, v in files.items():
                lookup.save(system, f"{root}/{int(shard) & (1 << 64) - 1:016x}.{k}", v)
            n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return build


def _load(to: str, shard: int) -> tuple[np.ndarray, np.ndarray, Graph]:
    """(ids, vectors, graph) of a shard, as its builder wrote them."""
    of = lambda k, kind: lookup.load.__wrapped__(to, f"{int(shard) & (1 << 64) - 1:016x}.{k}", kind)
    n, size, entry, *widths = of("head", "<i8").tolist()
    rows = of("rows", "<f8").reshape(n, size)
    g = Graph.__new__(Graph)
    g.x, g.entry = _unit(rows).astype(np.float32), entry
    g.near = [of(f"near{k}", "<i4").reshape(n, w) for k, w in enumerate(widths)]
    return of("ids", "<i8"), rows, g


def _asker(to: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (shard, node, embedding), sorted, to the links (a, b) of each node in the shard."""
        last = None
        for shard, q_ids, q in _by_task(batches, CHUNK):
            if shard != last:
                (ids, rows, g), last = _load(to, shard), shard
            at = np.searchsorted(ids, q_ids)  # rows were written sorted by node
            own = np.where(ids[np.minimum(at, len(ids) - 1)] == q_ids, at, -1)
            i, j = links_between(rows, q, graph=g, own=own)
            u, v = q_ids[i], ids[j]
            yield pa.RecordBatch.from_arrays([pa.array(u[u != v]), pa.array(v[u != v])], names=["a", "b"])

    return run


def near_duplicates(vectors: DataFrame, shard: int = SHARD, chunk: int = CHUNK) -> DataFrame:
    """vectors (vec_id, embedding, label) to vec_id, n_links, component_id, kept; a row for each row.

    Equal vectors of a label are one node of their number, so copies are never
    paired. A label's nodes are dealt to shards of at most about `shard` by hash,
    each shard is asked for the neighbours of all the label's nodes, and each link
    is found from both ends, of which either is enough. Vectors of different
    lengths are kept apart like labels. A null label or vector, a zero vector and
    null or non-finite components link with nothing: such a row is its own
    component. component_id passes over null ids. An empty table gives an empty one.
    """
    e = F.col("embedding")
    d = vectors.select(F.col("vec_id").cast("long"), e.cast("array<double>").alias("embedding"), F.col("label"))
    fine = F.col("label").isNotNull() & e.isNotNull() & (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(e, lambda x: x != 0)
    d = d.withColumn("fine", F.coalesce(fine, F.lit(False)))
    nodes = d.where("fine").groupBy("label", "embedding").agg(F.count("*").alias("n"), F.min("vec_id").alias("low"))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()))
    size = F.size("embedding").alias("size")
    shards = nodes.groupBy("label", size).agg(F.ceil(F.count("*") / shard).cast("int").alias("shards"), F.count("*").alias("rows"))
    of = nodes.select("label", "embedding", "node", size).join(shards, ["label", "size"])
    key = F.struct("label", "size")
    mine = F.pmod(F.xxhash64("node"), F.col("shards")).cast("int")
    to, spark = own_dir(vectors.sparkSession, "graphs"), vectors.sparkSession
    system, root = fs.FileSystem.from_uri(to)
    system.create_dir(root, recursive=True)
    have = of.select(F.xxhash64(key, mine).alias("task"), "node", "embedding").repartition(parts(spark), "task").sortWithinPartitions("task", "node")
    have.mapInArrow(_builder(to), "n long").agg(F.sum("n")).collect()
    ask = of.withColumn("s", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).withColumn("chunk", F.pmod(F.xxhash64("node", "s"), F.ceil(F.col("rows") / chunk)))
    ask = ask.select(F.xxhash64(key, F.col("s")).alias("task"), "node", "embedding", "chunk")
    tasks = shards.agg(F.coalesce(F.sum(F.col("shards") * F.ceil(F.col("rows") / chunk)), F.lit(1))).first()[0]
    found = ask.repartition(max(parts(spark), min(int(tasks), 100 * parts(spark))), "task", "chunk").drop("chunk").sortWithinPartitions("task", "node").mapInArrow(_asker(to), "a long, b long")
    links = cut(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    both = links.union(links.select("b", "a")).toDF("node", "other")
    near = both.join(nodes.select(F.col("node").alias("other"), "n"), "other").groupBy("node").agg(F.sum("n").alias("others"))
    at = nodes.join(components(links).withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    low = at.groupBy("component").agg(F.min("low").alias("component_id"))
    at = at.join(low, "component").join(near, "node", "left").select("label", "embedding", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    fine_rows = d.where("fine").join(at, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    rest = d.where("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return fine_rows.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector; nulls, repeats and empty tables as in near_duplicates()."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
