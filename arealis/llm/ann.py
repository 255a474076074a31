"""Near-duplicate vectors with hierarchical navigable small-world graphs, one per shard.

Equal vectors are one node. Shards have about `shard_size` nodes, fewer if vectors are long. Each gets a graph: layers of
ever fewer nodes, each node linked to near but mutually distant neighbours. Graphs and vectors are written once below the
shared folder. A task takes one graph and one block of vectors, which it reads by path, so nothing is copied through a
shuffle. It searches each vector: down the layers to a near node, then with a beam on the lowest layer. A search whose
beam is full of hits is repeated with a beam twice as wide, in the end against the whole shard. A graph's
beam is chosen when it is built: near copies of random nodes, just above the threshold, are made and searched, and the beam
is doubled until the wanted share of their links is found. Before it searches, a task audits that beam: a random sample of its vectors, of its own shard or another, is compared with all of the graph's, and the beam
is doubled until the search finds the wanted share of their links. Cosines are computed in double precision.

Links count for both ends, whoever found them. Searches that compared a vector with the whole shard are exact and return
counts: of links, and for each node of how many such vectors found it. All others have few links and return them; each
pair counts once. Components are joined from spanning forests, so a group of m near copies costs no m * m rows.

Nulls and ties: vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do
vectors of different length; rows with a null id are returned with no links and no component. Repeated rows are other
vectors with the same id. Other columns aren't read. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arealis.llm.batches import shared_uri, stored, work_dir
from arealis.llm.graph import components
from arealis.llm.words import mix

DEGREE, BUILD_BEAM, EXPAND, ROWS = 12, 40, 4, 256
#: Near copies that are made to find a graph's beam.
PROBES = 512
#: How far a cosine in single precision may be from the one in double precision.
ROUNDING = 1e-4


def diverse(sims: np.ndarray, ids: np.ndarray, vectors: np.ndarray, degree: int) -> np.ndarray:
    """Of each row's candidates (best first, -1: none) up to `degree`: those nearer to the row than to any chosen one, then the nearest others."""
    rows, c = ids.shape
    near = vectors[np.maximum(ids, 0)]
    cross = np.matmul(near, near.transpose(0, 2, 1))
    chosen = np.zeros((rows, c), bool)
    count = np.zeros(rows, np.int64)
    for j in range(c):
        close = np.where(chosen, cross[:, j, :], -2).max(axis=1, initial=-2)
        ok = (ids[:, j] >= 0) & (count < degree) & (close < sims[:, j])
        chosen[:, j] = ok
        count += ok
    order = np.argsort(np.where(ids < 0, 2, np.where(chosen, 0, 1)), axis=1, kind="stable")[:, :degree]
    return np.take_along_axis(ids, order, 1)


class Graph:
    """Searches run in single precision; links are verified in double precision."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray):
        self.n = len(vectors)
        self.hold(vectors)
        u = (mix(ids.astype(np.uint64)) >> np.uint64(11)).astype(np.float64) / 2**53
        self.level = np.minimum((-np.log(np.maximum(u, 1e-12)) / math.log(DEGREE)).astype(np.int64), 6)
        self.links = [np.full((self.n, DEGREE * (2 if lay == 0 else 1)), -1, np.int32) for lay in range(int(self.level.max()) + 1)]
        self.order = np.argsort(-self.level, kind="stable")  # high nodes first, so that upper layers are whole early
        self.entry = int(self.order[0])
        done = 0
        while done < self.n:
            step = min(self.n - done, max(64, min(done, 1024)))
            self._insert(self.order[done : done + step], self.order[:done])
            done += step

    def hold(self, vectors: np.ndarray | None) -> None:
        """Take the vectors, or let them go before the graph is written."""
        self.x = vectors
        self.y = self.seen = None
        if vectors is not None:
            self.y, self.seen = vectors.astype(np.float32), np.zeros((ROWS, self.n), bool)

    def _insert(self, new: np.ndarray, old: np.ndarray) -> None:
        x = self.y[new]
        within = x @ x.T
        np.fill_diagonal(within, -2)
        for lay in range(int(self.level[new].max()), -1, -1):
            mine = np.flatnonzero(self.level[new] >= lay)
            k = min(BUILD_BEAM, len(mine))
            part = within[np.ix_(mine, mine)]
            top = np.argpartition(-part, k - 1, axis=1)[:, :k]
            ids, sims = new[mine][top], np.take_along_axis(part, top, 1)
            ids = np.where(sims > -2, ids, -1)
            if len(old) and (self.level[old] >= lay).any():
                found, s = self.search(x[mine], BUILD_BEAM, lay)
                ids, sims = np.concatenate([ids, found], axis=1), np.concatenate([sims, s], axis=1)
            best = np.argsort(-np.where(ids < 0, -3, sims), axis=1, kind="stable")[:, :BUILD_BEAM]
            ids, sims = np.take_along_axis(ids, best, 1), np.take_along_axis(sims, best, 1)
            self._join(lay, new[mine], diverse(sims, ids, self.y, DEGREE))

    def _join(self, lay: int, nodes: np.ndarray, to: np.ndarray) -> None:
        links = self.links[lay]
        width = links.shape[1]
        links[nodes, : to.shape[1]] = to
        a, b = np.repeat(nodes, to.shape[1]), to.ravel()
        a, b = a[b >= 0], b[b >= 0]
        sims = np.einsum("ij,ij->i", self.y[a], self.y[b])
        order = np.lexsort((-sims, b))
        a, b = a[order], b[order]
        begin = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else np.zeros(0, np.int64)
        size = np.diff(np.concatenate([begin, [len(b)]]))
        rank = np.arange(len(b)) - np.repeat(begin, size)
        keep = rank < width
        target = b[begin] if len(b) else b
        extra = np.full((len(target), width), -1, np.int64)
        extra[np.repeat(np.arange(len(target)), size)[keep], rank[keep]] = a[keep]
        for lo in range(0, len(target), ROWS):
            t = target[lo : lo + ROWS]
            ids = np.concatenate([links[t].astype(np.int64), extra[lo : lo + ROWS]], axis=1)
            ids = np.sort(ids, axis=1)
            ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
            sims = np.where(ids < 0, -3, np.einsum("rcd,rd->rc", self.y[np.maximum(ids, 0)], self.y[t]))
            best = np.argsort(-sims, axis=1, kind="stable")
            links[t] = diverse(np.take_along_axis(sims, best, 1), np.take_along_axis(ids, best, 1), self.y, width)

    def search(self, q: np.ndarray, beam: int, lay: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: none) and cosines of the nearest found nodes of a layer."""
        q = q.astype(np.float32)
        out = [self._search(q[i : i + ROWS], beam, lay) for i in range(0, len(q), ROWS)]
        return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])

    def _search(self, q: np.ndarray, beam: int, lay: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.full((len(q), 1), self.entry, np.int64)
        sims = (q @ self.y[self.entry])[:, None]
        for upper in range(len(self.links) - 1, lay, -1):
            at, sims = self._beam(q, at[:, :1], sims[:, :1], 1, upper)
        return self._beam(q, at[:, :1], sims[:, :1], beam, lay)

    def _beam(self, q: np.ndarray, at: np.ndarray, sims: np.ndarray, beam: int, lay: int) -> tuple[np.ndarray, np.ndarray]:
        rows, links = len(q), self.links[lay]
        ids, val = np.full((rows, beam), -1, np.int64), np.full((rows, beam), -3, np.float32)
        ids[:, 0], val[:, 0] = at[:, 0], sims[:, 0]
        seen, marks = self.seen, [(np.arange(rows), at[:, 0])]
        seen[marks[0]] = True
        fresh = ids >= 0
        e = min(EXPAND, beam)
        active = np.arange(rows)
        while len(active):
            score = np.where(fresh[active], val[active], -3)
            pick = np.argpartition(-score, e - 1, axis=1)[:, :e]
            ok = np.take_along_axis(score, pick, 1) > -3
            active, pick, ok = (z[ok.any(axis=1)] for z in (active, pick, ok))
            if not len(active):
                break
            fresh[active[:, None], pick] &= ~ok
            near = np.where(ok[:, :, None], links[np.where(ok, ids[active[:, None], pick], 0)], -1).reshape(len(active), -1).astype(np.int64)
            near = np.sort(near, axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            near[seen[active[:, None], np.maximum(near, 0)]] = -1
            r, c = np.nonzero(near >= 0)
            marks.append((active[r], near[r, c]))
            seen[marks[-1]] = True
            s = np.full(near.shape, -3, np.float32)
            s[r, c] = np.einsum("ij,ij->i", self.y[near[r, c]], q[active[r]])
            all_ids, all_val = np.concatenate([ids[active], near], axis=1), np.concatenate([val[active], s], axis=1)
            all_fresh = np.concatenate([fresh[active], near >= 0], axis=1)
            best = np.argpartition(-all_val, beam - 1, axis=1)[:, :beam]
            ids[active], val[active], fresh[active] = (np.take_along_axis(z, best, 1) for z in (all_ids, all_val, all_fresh))
        for mark in marks:
            seen[mark] = False
        best = np.argsort(-val, axis=1, kind="stable")
        return np.take_along_axis(ids, best, 1), np.take_along_axis(val, best, 1)

    def links_of(self, q: np.ndarray, least: float, beam: int) -> Iterator[tuple[int, np.ndarray, bool]]:
        """(row, nodes with a cosine of at least `least`, whether it was compared with all nodes) for each query; full beams are widened."""
        open_, wide, single = np.arange(len(q)), min(beam, self.n), q.astype(np.float32)
        while len(open_):
            whole = wide >= min(self.n, 8 * beam)
            again = []
            for lo in range(0, len(open_), ROWS):
                rows = open_[lo : lo + ROWS]
                if whole:  # the beam has become the shard
                    for few in range(0, len(rows), step := max(1, (1 << 24) // self.n)):
                        sims = q[rows[few : few + step]] @ self.x.T
                        for r, s in zip(rows[few : few + step].tolist(), sims, strict=True):
                            yield r, np.flatnonzero(s >= least), True
                    continue
                ids, sims = self._search(single[rows], wide, 0)
                full = sims[:, -1] >= least - ROUNDING
                again.append(rows[full])
                for r, i, s in zip(rows[~full].tolist(), ids[~full], sims[~full], strict=True):
                    near = i[s >= least - ROUNDING]
                    yield r, near[self.x[near] @ q[r] >= least], False
            open_, wide = np.concatenate(again) if again else np.zeros(0, np.int64), wide * 2

    def within(self, q: np.ndarray, least: float, beam: int) -> Iterator[tuple[int, np.ndarray]]:
        for r, found, _ in self.links_of(q, least, beam):
            yield r, found

    def audit(self, q: np.ndarray, own: np.ndarray, least: float, beam: int, recall: float, sample: int, most: int | None = None) -> tuple[int, int, int]:
        """The beam with which a random sample of queries finds the wanted share of its links to other nodes, how many links it has, and how many of them were found.

        own: the node that each query is, or -1. The sample has `sample` queries and as many links at least, or `most` queries, or is all of them."""
        order = np.random.default_rng(len(q)).permutation(len(q))[:most]
        block, linked, true, at = max(1, min(ROWS, (1 << 24) // self.n)), [], 0, 0
        while at < len(order) and (at < sample or true < sample):
            rows = order[at : at + block]
            near = q[rows] @ self.x.T >= least
            is_node = np.flatnonzero(own[rows] >= 0)
            near[is_node, own[rows[is_node]]] = False
            n = near.sum(axis=1)
            linked.append(rows[n > 0])
            true, at = true + int(n.sum()), at + len(rows)
        rows = np.concatenate(linked) if linked else order[:0]
        count = lambda: sum(int((f != own[rows[r]]).sum()) for r, f in self.within(q[rows], least, beam))
        found = count() if true else 0
        while found < recall * true and beam < self.n:
            beam *= 2
            found = count()
        return beam, true, found

    def needed_beam(self, least: float, beam: int, recall: float, probes: int) -> int:
        """The beam with which the graph's own near copies are found: for `probes` random nodes a vector whose cosine with the node lies
        just above `least` is made, so that there are as many known links at least, however rare near copies are among the real vectors."""
        rng = np.random.default_rng(self.n)
        node = rng.integers(0, self.n, probes)
        away = rng.normal(size=(probes, self.x.shape[1]))
        away -= np.einsum("ij,ij->i", away, self.x[node])[:, None] * self.x[node]
        size = np.linalg.norm(away, axis=1, keepdims=True)
        cosine = rng.uniform(least + ROUNDING, min(1.0, least + 0.01), (probes, 1))
        q = cosine * self.x[node] + np.sqrt(1 - cosine**2) * away / np.maximum(size, 1e-300)
        q /= np.linalg.norm(q, axis=1, keepdims=True)
        true, block = 0, max(1, min(ROWS, (1 << 24) // self.n))
        for lo in range(0, probes, block):
            true += int((q[lo : lo + block] @ self.x.T >= least).sum())
        while beam < self.n and sum(len(f) for _, f in self.within(q, least, beam)) < recall * true:
            beam *= 2
        return beam

    def audited(self, least: float, beam: int, recall: float, sample: int) -> int:
        return self.audit(self.x, np.arange(self.n), least, beam, recall, sample)[0]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Links:
    """What a task returns: rows of LINKS."""

    def __init__(self) -> None:
        self.parts: list[tuple] = []

    def add(self, kind: int, a, b, na, nb) -> None:
        columns = np.broadcast_arrays(np.asarray(a, np.int64), np.asarray(b, np.int64), np.asarray(na, np.int64), np.asarray(nb, np.int64))
        self.parts.append((np.full(columns[0].size, kind), *[np.atleast_1d(c) for c in columns]))

    def batch(self, mine: int, theirs: int) -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*self.parts, strict=True)] if self.parts else [np.zeros(0, np.int64)] * 5
        n = len(columns[0])
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (*columns, np.full(n, mine), np.full(n, theirs))], LINKS_NAMES)


EDGE, EXACT, FOUND_BY, LINK, AUDIT = range(5)
#: edge: a and b are in one component; exact: a has na links in the shard `theirs`; found by: exact vectors of `mine` that
#: stand for na rows have a link to a of `theirs`; link: a and b, which stand for na and nb rows; audit: na links, nb found.
LINKS = "kind long, a long, b long, na long, nb long, mine long, theirs long"
LINKS_NAMES = [x.split()[0] for x in LINKS.split(", ")]


def searched(g: Graph, ids: np.ndarray, weight: np.ndarray, q: np.ndarray, q_ids: np.ndarray, q_weight: np.ndarray, own: np.ndarray, least: float, beam: int) -> Links:
    """The links between a graph's nodes and a block of queries."""
    out, up = Links(), np.arange(g.n)  # up: nodes joined so far
    by, touched = np.zeros(g.n, np.int64), np.zeros(g.n, bool)

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = int(up[x])
        return x

    for r, found, exact in g.links_of(q, least, beam):
        found = found[found != own[r]]
        if not len(found):
            continue
        touched[found] = True
        roots = {top(x) for x in np.unique(up[found]).tolist()}
        low = min(roots)
        up[list(roots)] = low
        up[found] = low
        out.add(EDGE, q_ids[r], ids[found[0]], 0, 0)
        if exact:
            out.add(EXACT, q_ids[r], 0, weight[found].sum(), 0)
            by[found] += q_weight[r]
        else:
            out.add(LINK, q_ids[r], ids[found], q_weight[r], weight[found])
    at = np.flatnonzero(touched)
    ends = np.array([top(x) for x in at.tolist()], np.int64)
    out.add(EDGE, ids[at[ends != at]], ids[ends[ends != at]], 0, 0)
    at = np.flatnonzero(by)
    out.add(FOUND_BY, ids[at], 0, by[at], 0)
    return out


def search_all(df: DataFrame, least: float, shards: int, shard_size: int, beam: int, recall: float, audit: int, block: int) -> DataFrame:
    """Rows of LINKS of all shards' graphs with all vectors. df: dim, rep, n, v."""
    spark = df.sparkSession
    path = shared_uri(work_dir(spark, "graphs"))
    sizes = df.groupBy("dim").agg(F.count("*").alias("size"))
    room = F.least(F.lit(shard_size), F.greatest(F.lit(1), F.floor(F.lit(1 << 25) / F.col("dim"))))
    sizes = stored(sizes.select("dim", F.greatest(F.lit(shards), F.ceil(F.col("size") / room)).alias("shards")), "sizes")
    dealt = df.join(sizes, "dim").withColumn("shard", F.pmod(F.xxhash64("rep"), F.col("shards")).cast("long") + F.shiftleft(F.col("dim").cast("long"), 32))

    def build(table: pa.Table) -> pa.Table:
        import pickle

        ids, x, shard = table.column("rep").to_numpy(), _matrix(table.column("v")), table.column("shard")[0].as_py()
        graph = Graph(x, ids)
        wide = graph.needed_beam(least, beam, recall, PROBES)
        graph.hold(None)
        files, folder = pafs.FileSystem.from_uri(path)
        files.create_dir(folder, recursive=True)
        name = f"graph-{shard}-{TaskContext.get().taskAttemptId()}"
        with files.open_output_stream(f"{folder}/{name}.x", compression=None) as sink:
            sink.write(memoryview(np.ascontiguousarray(x)).cast("B"))
        with files.open_output_stream(f"{folder}/{name}", compression=None) as sink:
            pickle.dump(graph, sink, protocol=5)
        with files.open_output_stream(f"{folder}/{name}.n", compression=None) as sink:
            sink.write(np.stack([ids, table.column("n").to_numpy()], axis=1).astype(np.int64).tobytes())
        return pa.table([table.column("dim")[:1], pa.array([shard]), pa.array([len(ids)]), pa.array([name]), pa.array([wide])], ["dim", "shard", "size", "name", "beam"])

    graphs = stored(dealt.select("dim", "shard", "rep", "n", "v").groupBy("shard").applyInArrow(build, "dim int, shard long, size long, name string, beam long"), "graphs")

    def look(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        files, folder = pafs.FileSystem.from_uri(path)

        def part(name: str, width: int, kind: type, lo: int, hi: int) -> np.ndarray:
            with files.open_input_file(f"{folder}/{name}") as source:
                source.seek(lo * width * 8)
                return np.frombuffer(source.read((hi - lo) * width * 8), kind).reshape(-1, width)

        held, g, ids, weight = None, None, None, None
        for b in rows:
            for pair in b.to_pylist():
                if held != pair["graph"]:  # pairs come in order of their graph
                    held, n = pair["graph"], pair["nodes"]
                    with files.open_input_stream(f"{folder}/{held}", compression=None) as source:
                        g = pickle.loads(source.read())
                    ids, weight = part(f"{held}.n", 2, np.int64, 0, n).T
                    g.hold(part(f"{held}.x", pair["dim"], np.float64, 0, n))
                lo, hi = pair["block"] * block, min(pair["size"], (pair["block"] + 1) * block)
                q_ids, q_weight = part(f"{pair['queries']}.n", 2, np.int64, lo, hi).T
                q = part(f"{pair['queries']}.x", pair["dim"], np.float64, lo, hi)
                own = np.arange(lo, hi) if held == pair["queries"] else np.full(hi - lo, -1)
                wide, true, found = g.audit(q, own, least, pair["beam"], recall, audit, 2 * audit)
                links = searched(g, ids, weight, q, q_ids, q_weight, own, least, wide)
                links.add(AUDIT, 0, 0, true, found)
                yield links.batch(pair["mine"], pair["theirs"])

    one = graphs.select("dim", F.col("shard").alias("theirs"), F.col("name").alias("graph"), F.col("size").alias("nodes"), "beam")
    blocks = graphs.select("dim", F.col("shard").alias("mine"), F.col("name").alias("queries"), "size", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / block))).alias("block"))
    pairs = one.join(blocks, "dim")  # a row for each graph and block of queries of the same dimension, without vectors
    tasks = max(1, min(pairs.count(), 20_000))
    # a task's pairs have one graph or a few, one after another
    dealt = pairs.repartitionByRange(tasks, "graph", "queries", "block").sortWithinPartitions("graph", "queries", "block")
    return stored(dealt.mapInArrow(look, LINKS), "links")


def counted(links: DataFrame) -> DataFrame:
    """a, links: of each vector, in rows that it links with."""
    exact = links.where(F.col("kind") == EXACT).select("a", F.col("theirs").alias("shard"), "na")
    known = stored(exact.select("a", "shard"), "exact")
    found = links.where(F.col("kind") == LINK)
    both = found.select("a", "b", F.col("mine").alias("sa"), F.col("theirs").alias("sb"), F.col("nb").alias("n"))
    both = both.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("theirs").alias("sa"), F.col("mine").alias("sb"), F.col("na").alias("n"))).dropDuplicates(["a", "b"])
    is_a, is_b = known.select("a", F.col("shard").alias("sb")), known.select(F.col("a").alias("b"), F.col("shard").alias("sa"))
    both = both.join(is_a, ["a", "sb"], "left_anti").join(is_b, ["b", "sa"], "left_anti")
    by = links.where(F.col("kind") == FOUND_BY).select("a", F.col("mine").alias("shard"), F.col("na").alias("n")).join(known, ["a", "shard"], "left_anti")
    return exact.select("a", F.col("na").alias("n")).unionByName(both.select("a", "n")).unionByName(by.select("a", "n")).groupBy("a").agg(F.sum("n").alias("links"))


def recall_of(links: DataFrame) -> tuple[int, int]:
    """How many links the audits of all tasks had, and how many of them the searches found."""
    r = links.where(F.col("kind") == AUDIT).agg(F.coalesce(F.sum("na"), F.lit(0)), F.coalesce(F.sum("nb"), F.lit(0))).first()
    return r[0], r[1]


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.95, shards: int = 1, shard_size: int = 100_000, beam: int = 24, recall: float = 0.99, audit: int = 256, block: int = 8192) -> DataFrame:
    """One row per vector: vec_id, n_links (other vectors with a cosine of at least `least`), component_id, kept."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    ok = F.coalesce(F.col("vec_id").isNotNull() & finite & (square > 0) & (square < float("inf")), F.lit(False))
    rows = rows.withColumn("key", F.when(ok, F.concat_ws("-", F.xxhash64("v").cast("string"), F.hash("v").cast("string"), F.size("v").cast("string"))))
    classes = rows.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("v").alias("v"))
    classes = stored(classes.withColumn("dim", F.size("v")), "vectors")
    links = search_all(classes, least, shards, shard_size, beam, recall, audit, block)
    roots = components(links.where(F.col("kind").isin(EDGE, LINK)))
    known = classes.select("key", "rep", "n").join(counted(links), F.col("rep") == F.col("a"), "left").join(roots, F.col("rep") == F.col("node"), "left")
    known = stored(known.select("key", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("root", "rep").alias("root")), "classes")
    out = rows.select("vec_id", "key").join(known, "key", "left")
    component = F.coalesce("root", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
