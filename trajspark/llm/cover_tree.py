"""Hard negatives by best-first descent of cover trees (operator 13).

Candidates get one more coordinate, the square root of what their squared norm
lacks of the largest one in their tree; a query gets a zero there.  Then a larger
inner product is a smaller distance, and a node's centre and covering radius bound
the inner products of everything below it from both sides.

The index is a table of trees: rows are range-sorted by length, label, nearest pivot
and a hash of the id, so that partitions are of equal size whatever the labels are,
and each ``cap`` rows of one label become one tree.  In a tree, a node's members are
covered by a farthest-first net of half its radius; members that stand apart at
that radius stay single.  A search sends queries to parts of the index and descends
there, best bound first; a node that no window of the query can use is skipped, and
single members and centres are scored exactly.  Parts are searched in rounds of growing
size: what a round finds raises the score that the next one has to reach, so that
few rows leave the later tasks.  Rounds order the work only; every part is searched.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from trajspark.llm.common import shuffle_partitions, slices, written

#: Members below which a node keeps its members single.
LEAF = 32
#: Parts of a round against those of the round before, and queries handled at once.
GROWTH, QUERIES = 16, 256
WHOLE = 1 << 62


def scaled(rows: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
           scale: int = 256) -> DataFrame:
    """``vec_id, label, dim, v``: rows that take part, components as floor(``scale`` * x).

    Left out are rows with a null id, label or vector, with a null or non-finite component, or
    with one so large that a score could leave the range of a long.
    """
    x = F.col(f"`{vec_col}`").cast("array<double>")
    limit = F.sqrt(F.lit(float(1 << 54)) / F.greatest(F.size(x), F.lit(1))) - 1
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) * scale <= limit))
    kept = rows.where(F.col(f"`{id_col}`").isNotNull() & F.col(f"`{label_col}`").isNotNull() & F.col(f"`{vec_col}`").isNotNull() & fine)
    # a vector without components scores 0, as one zero does
    v = F.when(F.size(x) == 0, F.array(F.lit(0).cast("long"))).otherwise(F.transform(x, lambda e: F.floor(e * scale)))
    return kept.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").cast("long").alias("label"),
                       F.size(x).alias("dim"), v.alias("v"))


def _matrix(column) -> np.ndarray:
    """Rows of a list column whose lists have one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _distances(points: np.ndarray, norms: np.ndarray, k: int) -> np.ndarray:
    return np.sqrt(np.maximum(norms + norms[k] - 2 * (points @ points[k]), 0))


def net(points: np.ndarray, radius: float, most: int) -> tuple[list[int], np.ndarray] | None:
    """Farthest-first centres that cover ``points`` within ``radius``, and each point's centre (by number);
    None if more than ``most`` are needed."""
    norms = (points * points).sum(1)
    centres, near, owner = [0], _distances(points, norms, 0), np.zeros(len(points), np.int64)
    while (far := int(near.argmax())) is not None and near[far] > radius:
        if len(centres) == most:
            return None
        d = _distances(points, norms, far)
        closer = d < near
        owner[closer], near[closer] = len(centres), d[closer]
        owner[far], near[far] = len(centres), 0.0
        centres.append(far)
    return centres, owner


class Tree:
    """Points in the order of the tree.  Node i covers places ``lo[i]`` (its centre) to ``hi[i]``; those up to
    ``single[i]`` are scored one by one, the others are below its children ``first[i]`` to ``last[i]``."""

    def __init__(self, ids, vectors, nodes, radii):
        self.ids, self.nodes, self.radii = ids, nodes, radii
        largest = int(np.abs(vectors).max(initial=0))
        # products of whole numbers are exact in doubles up to 2 ** 53
        self.exact = vectors.shape[1] * largest
        self.whole = vectors
        self.vectors = vectors.astype(np.float64)
        self.top = float((self.vectors * self.vectors).sum(1).max(initial=0))

    @classmethod
    def built(cls, ids: np.ndarray, vectors: np.ndarray) -> Tree:
        v = vectors.astype(np.float64)
        norms = (v * v).sum(1)
        points = np.column_stack([v, np.sqrt(np.maximum(norms.max() - norms, 0))])
        order, nodes, radii = np.empty(len(ids), np.int64), [[0] * 5], [0.0]
        todo = [(0, 0, 0, np.arange(1, len(ids)))]  # node, its place, its centre, members
        while todo:
            node, lo, centre, members = todo.pop()
            order[lo] = centre
            hi, single, children = lo + 1 + len(members), lo + 1, []
            away = np.sqrt(((points[members] - points[centre]) ** 2).sum(1))
            radius = float(away.max(initial=0))
            found = net(points[members], radius / 2, len(members) // 4) if len(members) > LEAF and radius > 0 else None
            if found is None:
                order[single:hi] = members
                single = hi
            else:
                groups = [members[found[1] == k] for k in range(len(found[0]))]
                for k, c in enumerate(found[0]):
                    rest = groups[k][groups[k] != members[c]]
                    if len(rest):
                        children.append((members[c], rest))
                    else:
                        order[single] = members[c]
                        single += 1
            first, place = len(nodes), single
            nodes[node] = [lo, single, hi, first, first + len(children)]
            radii[node] = radius
            for c, rest in children:
                todo.append((len(nodes), place, c, rest))
                nodes.append([0] * 5)
                radii.append(0.0)
                place += 1 + len(rest)
        return cls(ids[order], vectors[order], np.array(nodes, np.int64), np.array(radii))

    def dots(self, places, queries: np.ndarray) -> np.ndarray:
        """Exact inner products, (queries, places), as whole numbers."""
        if self.exact * np.abs(queries).max(initial=0) < 1 << 53:
            return (queries.astype(np.float64) @ self.vectors[places].T).astype(np.int64)
        return queries @ self.whole[places].T

    def bounds(self, score, norm, radius):
        """Least and largest inner product within ``radius`` of a centre that scores ``score``."""
        both = norm + self.top
        d = np.sqrt(np.maximum(both - 2.0 * score, 0))
        slack = 1e-9 * both + 1e-6
        return (both - (d + radius) ** 2) / 2 - slack, (both - np.maximum(d - radius, 0) ** 2) / 2 + slack


class Query:
    """Windows of one query and the best ``k`` candidates of each so far."""

    def __init__(self, own: int, k: int, lo, hi, reach):
        self.own, self.k, self.hi = own, k, hi
        self.reach = np.maximum(lo, reach)  # a candidate below it can't be among the best
        self.scores = [np.empty(0, np.int64) for _ in lo]
        self.ids = [np.empty(0, np.int64) for _ in lo]

    def useful(self, least, most):
        """Whether some window meets the range of inner products, for arrays of ranges."""
        return ((np.asarray(most)[..., None] >= self.reach) & (np.asarray(least)[..., None] <= self.hi)).any(-1)

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        some = np.flatnonzero((scores >= self.reach.min()) & (scores <= self.hi.max()) & (ids != self.own))
        if not len(some):
            return
        scores, ids = scores[some], ids[some]
        for w in range(len(self.hi)):
            fit = (scores >= self.reach[w]) & (scores <= self.hi[w])
            if not fit.any():
                continue
            s, i = np.concatenate([self.scores[w], scores[fit]]), np.concatenate([self.ids[w], ids[fit]])
            best = np.lexsort((i, -s))[:self.k]
            self.scores[w], self.ids[w] = s[best], i[best]
            if len(best) == self.k:
                self.reach[w] = s[best[-1]]


def descend(tree: Tree, vectors: np.ndarray, queries: list[Query]) -> None:
    """Offer to each query what its windows can use of the tree, best bound first."""
    norms = (vectors.astype(np.float64) ** 2).sum(1)
    lo, single, _, first, last = tree.nodes.T
    score = tree.dots([0], vectors)[:, 0]
    least, most = tree.bounds(score, norms, tree.radii[0])
    for s, q in zip(score, queries):
        q.offer(np.array([s]), tree.ids[:1])
    some = [k for k, q in enumerate(queries) if q.useful(least[k], most[k])]
    if not some:
        return

    def opened(node: int, k: int, scores: np.ndarray, places: np.ndarray, heap: list) -> None:
        """Offer singles and children's centres of a node; its useful children join the heap."""
        q, inner = queries[k], range(first[node], last[node])
        q.offer(scores, tree.ids[places])
        if inner:
            below, above = tree.bounds(scores[len(places) - len(inner):], norms[k], tree.radii[first[node]:last[node]])
            for at in np.flatnonzero(q.useful(below, above)):
                heapq.heappush(heap, (-above[at], below[at], inner[at]))

    def places_of(node: int) -> np.ndarray:
        return np.concatenate([np.arange(lo[node] + 1, single[node]), lo[first[node]:last[node]]])

    root = places_of(0)
    for k, scores in zip(some, tree.dots(root, vectors[some])):
        heap: list = []
        opened(0, k, scores, root, heap)
        while heap:
            most_k, least_k, node = heapq.heappop(heap)
            if -most_k < queries[k].reach.min():
                break  # best first: nothing left in the heap reaches any window
            if queries[k].useful(least_k, -most_k):
                places = places_of(node)
                opened(node, k, tree.dots(places, vectors[k:k + 1])[0], places, heap)


def index(rows: DataFrame, *, cap: int = 4096, pivots: int = 64, sample: int = 2048, partitions: int | None = None) -> DataFrame:
    """One row per tree of at most ``cap`` rows of ``scaled``: its label, places and nodes.

    ``sample`` rows (smallest hash of id and vector) give up to ``pivots`` pivots for each length of
    vectors; they decide only which rows share a tree.  Every row is in exactly one tree.
    """
    spark = rows.sparkSession
    n = partitions or shuffle_partitions(spark)
    by_dim: dict[int, list] = {}
    for r in rows.orderBy(F.xxhash64("vec_id", "v")).limit(sample).select("dim", "v").collect():
        by_dim.setdefault(r.dim, []).append(r.v)
    chosen = {}
    for dim, vs in by_dim.items():
        points = np.array(vs, np.float64)
        centres = [0]
        near = ((points - points[0]) ** 2).sum(1)
        while len(centres) < min(pivots, len(points)) and near.max() > 0:
            centres.append(int(near.argmax()))
            near = np.minimum(near, ((points - points[centres[-1]]) ** 2).sum(1))
        chosen[dim] = points[centres]

    def nearest(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            pivot = np.full(batch.num_rows, -1, np.int32)
            for dim in np.unique(dims):
                if int(dim) in chosen:
                    on, c = np.flatnonzero(dims == dim), chosen[int(dim)]
                    v = _matrix(batch.column("v").take(pa.array(on))).astype(np.float64)
                    pivot[on] = ((c * c).sum(1) - 2 * (v @ c.T)).argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot)], names=[*batch.schema.names, "pivot"])

    def build(batches):
        part, made, held, size = TaskContext.get().partitionId(), 0, [], 0

        def tree():
            t = pa.Table.from_batches(held)
            whole = _matrix(t.column("v"))
            made_ = Tree.built(t.column("vec_id").to_numpy(), whole)
            width = next(w for w in (2, 4, 8) if w == 8 or np.abs(whole).max(initial=0) < 1 << 8 * w - 1)
            return pa.RecordBatch.from_pydict({
                "tree": pa.array([part + n * made], pa.int64()), "dim": t.column("dim")[:1].combine_chunks(),
                "label": t.column("label")[:1].combine_chunks(), "size": pa.array([t.num_rows], pa.int64()),
                "ids": [made_.ids.astype("<i8").tobytes()], "vectors": [made_.whole.astype(f"<i{width}").tobytes()],
                "nodes": [made_.nodes.astype("<i8").tobytes()], "radii": [made_.radii.astype("<f8").tobytes()]})

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                here = (batch.column("dim")[at], batch.column("label")[at])
                if held and (size == cap or (held[0].column("dim")[0], held[0].column("label")[0]) != here):
                    yield tree()
                    made, held, size = made + 1, [], 0
                rest = batch.slice(at, cap - size)
                other = pc.or_(pc.not_equal(rest.column("dim"), here[0]), pc.not_equal(rest.column("label"), here[1]))
                stop = pc.index(other, True).as_py()
                rest = rest if stop < 0 else rest.slice(0, stop)
                held.append(rest)
                size, at = size + rest.num_rows, at + rest.num_rows
        if held:
            yield tree()

    placed = rows.mapInArrow(nearest, "vec_id long, label long, dim int, v array<bigint>, pivot int")
    order = ("dim", "label", "pivot", F.xxhash64("vec_id"))
    return written(placed.repartitionByRange(n, *order).sortWithinPartitions(*order, "vec_id").mapInArrow(
        build, "tree long, dim int, label long, size long, ids binary, vectors binary, nodes binary, radii binary"), "cover-trees")


def _loaded(batch: pa.RecordBatch, row: int) -> Tree:
    raw = {c: batch.column(c)[row].as_py() for c in ("size", "ids", "vectors", "nodes", "radii")}
    dim = max(1, batch.column("dim")[row].as_py())
    width = len(raw["vectors"]) // (raw["size"] * dim)
    return Tree(np.frombuffer(raw["ids"], "<i8"), np.frombuffer(raw["vectors"], f"<i{width}").reshape(-1, dim).astype(np.int64),
                np.frombuffer(raw["nodes"], "<i8").reshape(-1, 5), np.frombuffer(raw["radii"], "<f8"))


def search(trees: DataFrame, queries: DataFrame, k: int, same_label: bool, *, trees_at_once: int = 16) -> DataFrame:
    """``q, w, score, vec_id, rank``: the best ``k`` rows of the index for each window of each query.

    ``queries``: ``q`` (unique), ``vec_id, label, dim, v`` and ``windows``, an array of ``(w, lo, hi)``: a row fits
    window w if its inner product is in lo..hi, its label equals the query's (``same_label``) or differs from it, its
    vector is as long and its id another.  Higher scores come first, then smaller ids.
    """
    spark = trees.sparkSession
    n_trees = trees.count()
    n_parts = max(1, min(n_trees, shuffle_partitions(spark)), math.ceil(n_trees / trees_at_once))
    edges = [n_parts]
    while edges[0] > 1:
        edges.insert(0, math.ceil(edges[0] / GROWTH))
    edges.insert(0, 0)
    found_schema = pa.schema([("q", pa.int64()), ("w", pa.int64()), ("score", pa.int64()), ("vec_id", pa.int64())])

    def run(batches):
        key, here = None, []
        for batch in batches:
            keys, kinds = batch.column("key").to_numpy(), batch.column("kind").to_numpy()
            cut = np.flatnonzero((keys[1:] != keys[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for lo, hi in zip([0, *cut], [*cut, batch.num_rows]):
                if lo == hi:
                    continue
                if keys[lo] != key:
                    key, here = keys[lo], []
                if kinds[lo] == 0:
                    here += [(batch.column("dim")[r].as_py(), batch.column("label")[r].as_py(), _loaded(batch, r)) for r in range(lo, hi)]
                elif here:
                    for part in slices([batch.slice(lo, hi - lo)], QUERIES):
                        yield from answered(part, here)

    def answered(part, here):
        dims, labels = part.column("dim").to_numpy(), part.column("label").to_numpy()
        windows = part.column("windows").to_pylist()
        reach = part.column("reach").to_pylist()
        state = [Query(own, k, np.array([x["lo"] for x in w], np.int64), np.array([x["hi"] for x in w], np.int64), np.array(r, np.int64))
                 for own, w, r in zip(part.column("vec_id").to_pylist(), windows, reach)]
        for dim in np.unique(dims):
            on = np.flatnonzero(dims == dim)
            v = _matrix(part.column("v").take(pa.array(on)))
            for tree_dim, label, tree in here:
                if tree_dim == dim:
                    fit = np.flatnonzero((labels[on] == label) == same_label)
                    if len(fit):
                        descend(tree, v[fit], [state[on[f]] for f in fit])
        out = [(q, x["w"], s, i) for q, w, st in zip(part.column("q").to_pylist(), windows, state)
               for x, ss, ii in zip(w, st.scores, st.ids) for s, i in zip(ss.tolist(), ii.tolist())]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=found_schema)

    queries = queries.where(F.size("windows") > 0)
    best = None
    for first, last in zip(edges, edges[1:]):
        parts = last - first
        chunks = max(1, n_parts // parts)  # few parts: each is searched by several tasks, with a share of the queries
        if best is None:
            asked = queries.withColumn("reach", F.transform("windows", lambda x: x.lo))
        else:
            least = best.where(F.col("rank") == k).groupBy("q").agg(
                F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("least"))  # one entry per window
            asked = queries.join(least, "q", "left").withColumn(
                "reach", F.transform("windows", lambda x: F.coalesce(F.element_at("least", x.w), x.lo))).drop("least")
        part = F.pmod("tree", F.lit(n_parts))
        index_rows = trees.where((part >= first) & (part < last)).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).select(
            ((part - first) * chunks + F.col("chunk")).alias("key"), F.lit(0).alias("kind"), "dim", "label", "size", "ids", "vectors", "nodes",
            "radii", *(F.lit(None).cast(t).alias(c) for c, t in (("q", "long"), ("vec_id", "long"), ("v", "array<bigint>"),
                       ("windows", "array<struct<w:bigint,lo:bigint,hi:bigint>>"), ("reach", "array<bigint>"))))
        query_rows = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select(
            (F.col("part") * chunks + F.pmod(F.xxhash64("q"), F.lit(chunks))).alias("key"), F.lit(1).alias("kind"), "dim", "label",
            F.lit(None).cast("long").alias("size"), *(F.lit(None).cast("binary").alias(c) for c in ("ids", "vectors", "nodes", "radii")),
            "q", "vec_id", "v", F.col("windows").cast("array<struct<w:bigint,lo:bigint,hi:bigint>>").alias("windows"), "reach")
        placed = index_rows.unionByName(query_rows).repartitionByRange(parts * chunks, "key").sortWithinPartitions("key", "kind")
        got = placed.mapInArrow(run, "q long, w long, score long, vec_id long")
        got = got if best is None else got.unionByName(best.drop("rank"))
        order = W.partitionBy("q", "w").orderBy(F.desc("score"), "vec_id")
        best = written(got.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "cover-best")
    return best


def hard_negatives(rows: DataFrame, *, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
                   id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", scale: int = 256,
                   cap: int = 4096, partitions: int | None = None) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are the rows whose id ``every`` divides.  A row's score is its integer inner product with the anchor.  The
    positives are the anchor's first ``positives`` rows of its label, the negatives of each the first ``negatives`` rows of another
    label whose score is ``low`` to ``high`` hundredths of the positive's.

    Rows with a null id, label, vector or component, a non-finite component, or one whose scores could leave the range of a
    long take no part.  Vectors of other lengths are no partners, nor are rows with the anchor's own id.  Ties go to the
    smaller id.  An anchor that stands there twice with one label and vector is asked once; repeated candidates count each.
    Anchors without positives, or whose windows hold no row, give no rows; an empty table gives none.
    Other columns are not read.
    """
    vectors = written(scaled(rows, id_col=id_col, vec_col=vec_col, label_col=label_col, scale=scale), "vectors")
    trees = index(vectors, cap=cap, partitions=partitions)
    anchors = written(vectors.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "label", "v"]).withColumn(
        "q", F.monotonically_increasing_id()), "anchors")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("w"), F.lit(-WHOLE).alias("lo"), F.lit(WHOLE).alias("hi")))
    near = search(trees, anchors.withColumn("windows", whole), positives, True)
    near = near.select("q", F.col("rank").cast("long").alias("w"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    floor = lambda x: f"(({x}) - pmod({x}, 100)) DIV 100"
    windows = near.select("q", F.struct(
        "w", F.expr(f"-({floor(f'-{low} * positive_score')})").alias("lo"),
        F.expr(floor(f"{high} * positive_score")).alias("hi")).alias("window")).where("window.lo <= window.hi")
    asked = anchors.join(windows.groupBy("q").agg(F.array_sort(F.collect_list("window")).alias("windows")), "q")  # one per positive
    found = search(trees, asked, negatives, False)
    return found.withColumnRenamed("vec_id", "negative_id").join(near, ["q", "w"]).join(
        anchors.select("q", F.col("vec_id").alias("anchor_id")), "q").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", F.col("score").alias("negative_score"))
