"""Exact top-k inner-product search with two cover trees.

Rows and queries are put in order along a Hilbert curve of a few projections
and cut into blocks of bounded size, so a block's rows are neighbours. Each
block has a cover tree: a node's points are split by a net whose members are
more than half the node's radius apart and within that of every point; net
members with few points share leaves. Every node knows a centre and its
covering radius.

A pair of blocks is searched by descending both trees at once; a pair of
nodes is dropped where
    qc.dc + |qc| rd + |dc| rq + rq rd
is below the worst k-th score of the query node's group. Each block of queries
first meets the block of rows with the highest such bound; its worst k-th
scores then drop whole pairs of blocks before their trees meet, and start the
search of the rest. No row is left out but by its bound, so results are exact.

Components are floor(256 x) as whole numbers. Rows whose squared length is
beyond NARROW keep blocks of their own, where floating-point bounds select
candidates and Python's integers score them, so any finite value is exact; a
score beyond 64 bits is given as the nearest that has them, but ranks as it
is.

Vectors that are null or hold null or non-finite components take no part;
shorter vectors count as padded with zeros. Rows are told apart by a row id,
so repeated vec_ids are rows of their own and only a query's own row is left
out. A null vec_id is no query and sorts last among ties. An empty table gives
no rows. The result has its own columns alone, so no name of the input clashes.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.common import drop_staged, stage, table, trim
from quillstone.llm.packing import hilbert_key

#: Rows of a data block and of a query block, of either with wide rows, and points of a leaf of either tree.
DATA_BLOCK, QUERY_BLOCK, WIDE_BLOCK, DATA_LEAF, QUERY_LEAF = 16_384, 2_048, 256, 256, 64
#: Squared length of a narrow row at most: products of two stay exact in doubles, and leave room for a place in 64 bits.
NARROW = 2.0**44
#: Projections of the curve, and bits of each.
AXES, BITS = 4, 8
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


# ---------------------------------------------------------------- trees
def net(points: np.ndarray, apart: float, few: int = 64, idle: int = 4) -> np.ndarray:
    """The number of the net member that each point is within `apart` of; members lie farther apart than that. -1 for points that are left when `idle` batches of members one after another hardly cover more than themselves."""
    owner, left, members, bad = np.full(len(points), -1), np.arange(len(points)), 0, 0
    squares = (points**2).sum(1)
    while len(left) and bad < idle:
        at = np.unique(np.linspace(0, len(left) - 1, few).astype(int))
        tried = left[at]
        near = squares[tried][:, None] + squares[left] - 2 * (points[tried] @ points[left].T) <= apart * apart
        taken: list[int] = []
        for i in range(len(tried)):
            if not near[i, at[taken]].any():
                taken.append(i)
        near = near[taken]
        near[np.arange(len(taken)), at[taken]] = True
        covered = near.any(0)
        owner[left[covered]] = members + near[:, covered].argmax(0)
        members += len(taken)
        bad = bad + 1 if np.count_nonzero(covered) < 1.25 * len(tried) else 0
        left = left[~covered]
    return owner


class CoverTree:
    """Nodes in preorder; the points of node i are order[lo[i]:hi[i]]."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.lo, self.hi, self.centre, self.radius, self.children = [], [], [], [], []
        self.order = np.arange(len(points))
        if len(points):
            self._build(points.astype(np.float64), self.order, 0, leaf)
        self.points = points[self.order]
        self.centre = np.array(self.centre).reshape(len(self.lo), points.shape[1])
        self.radius, self.lo, self.hi = np.array(self.radius), np.array(self.lo, int), np.array(self.hi, int)
        self.norm = np.sqrt((self.centre**2).sum(1))

    def _node(self, own: np.ndarray, lo: int) -> int:
        centre = own.mean(0)
        self.lo.append(lo)
        self.hi.append(lo + len(own))
        self.centre.append(centre)
        self.radius.append(float(np.sqrt(((own - centre) ** 2).sum(1).max())))
        self.children.append([])
        return len(self.lo) - 1

    def _build(self, points: np.ndarray, order: np.ndarray, lo: int, leaf: int) -> int:
        """Lays out order in place, from place lo of the whole, and returns the node."""
        own = points[order]
        node = self._node(own, lo)
        if len(order) <= leaf or not (own != own[0]).any():
            return node
        owner = net(own, self.radius[node] / 2)
        count = np.bincount(owner[owner >= 0], minlength=1)
        large = count >= max(2, leaf // 8)
        rank = np.append(np.where(large, np.arange(len(count)), len(count)), len(count))  # the last is that of points without a member
        order[:] = order[np.argsort(rank[owner], kind="stable")]
        sizes = count[large]
        at = 0
        for size in sizes.tolist():
            part = order[at : at + size]
            if size == len(order):  # one member covers all: its halves are nodes
                half = size // 2
                for a, z in ((0, half), (half, size)):
                    self.children[node].append(self._build(points, part[a:z], lo + a, leaf))
            else:
                self.children[node].append(self._build(points, part, lo + at, leaf))
            at += size
        for a in range(at, len(order), leaf):  # what lies alone, in the order along the curve
            self.children[node].append(self._node(points[order[a : a + leaf]], lo + a))
        return node


class Search:
    """One query tree against one data tree; visited counts the pairs of nodes that were looked at, compared the pairs of leaves whose points met."""

    def __init__(self, queries: CoverTree, q_uid: np.ndarray, data: CoverTree, d_uid: np.ndarray, d_id: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.visited = self.compared = 0
        n, m = len(queries.points), len(data.points)
        self.score, self.ids, self.uids = np.full((n, k), LEAST), np.zeros((n, k), np.int64), np.full((n, k), -1)
        if not n or not m:
            return
        qp, dp = queries.points.astype(np.float64), data.points.astype(np.float64)
        # a score and the place of its row in the order of (id, uid) make one integer, so the best are the largest
        places = np.empty(m, np.int64)
        by_id = np.lexsort((d_uid, d_id))
        places[by_id] = m - 1 - np.arange(m)
        bits = max(1, int(m - 1).bit_length())
        best = np.full((n, k), LEAST)
        worst = np.full(n, LEAST) if floor is None else floor.copy()  # the k-th score of each query
        own = np.full(n, -1)
        by_uid = np.argsort(d_uid)
        at = np.minimum(np.searchsorted(d_uid, q_uid, sorter=by_uid), m - 1)
        found = d_uid[by_uid[at]] == q_uid
        own[found] = by_uid[at[found]]

        def bounds(q: int, ds: list[int]) -> np.ndarray:
            self.visited += len(ds)
            return upper(data.centre[ds] @ queries.centre[q], queries.norm[q], queries.radius[q], data.norm[ds], data.radius[ds])

        def leaf(q: int, d: int) -> None:
            self.compared += 1
            a, b, c, e = queries.lo[q], queries.hi[q], data.lo[d], data.hi[d]
            s = (qp[a:b] @ dp[c:e].T).astype(np.int64)
            change = np.flatnonzero(s.max(1) >= worst[a:b])
            if not len(change):
                return
            keys = (s[change] << bits) + places[c:e]
            mine = own[a + change]
            self_at = np.flatnonzero((mine >= c) & (mine < e))
            keys[self_at, mine[self_at] - c] = LEAST
            both = np.concatenate([best[a + change], keys], 1)
            best[a + change] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
            low = best[a + change].min(1)
            worst[a + change] = np.maximum(worst[a + change], np.where(low == LEAST, LEAST, low >> bits))

        # best first over pairs of nodes
        heap, tie = [(-bounds(0, [0])[0], 0, 0, 0)], 0
        while heap:
            bound, _, q, d = heapq.heappop(heap)
            if -bound < worst[queries.lo[q] : queries.hi[q]].min():
                continue
            qs, ds = queries.children[q], data.children[d]
            if not qs and not ds:
                leaf(q, d)
                continue
            if qs and (not ds or queries.radius[q] >= data.radius[d]):
                pairs = [(bounds(x, [d])[0], x, d) for x in qs]
            else:
                pairs = list(zip(bounds(q, ds), [q] * len(ds), ds, strict=True))
            for up, x, y in pairs:
                if up >= worst[queries.lo[x] : queries.hi[x]].min():
                    tie += 1
                    heapq.heappush(heap, (-up, tie, x, y))
        known = best != LEAST
        row = by_id[m - 1 - (best[known] & ((1 << bits) - 1))]
        self.score[known], self.ids[known], self.uids[known] = best[known] >> bits, d_id[row], d_uid[row]
        self.worst = worst


def upper(dot, q_norm, q_radius, d_norm, d_radius):
    """What no score of the two nodes' points exceeds, rounding included."""
    up = dot + q_norm * d_radius + d_norm * q_radius + q_radius * d_radius
    return up + 1e-9 * (np.abs(dot) + q_norm * d_norm + np.abs(up)) + 1e-3


# ---------------------------------------------------------------- any finite value
def exact_best(queries: list[list[int]], q_uid: np.ndarray, data: list[list[int]], d_uid: np.ndarray, d_id: np.ndarray, k: int) -> list[tuple[int, int, int, int]]:
    """(query's place, score, id, uid) of the k best of each query, in Python's integers. Doubles of rows scaled to a common size, with their error, select the candidates."""
    width = max(map(len, (*queries, *data)), default=0)
    if not queries or not data:
        return []

    def scaled(rows):
        shift = np.array([max((abs(x) for x in r), default=0).bit_length() for r in rows], np.int64)
        out = np.zeros((len(rows), width))
        for i, r in enumerate(rows):
            out[i, : len(r)] = [x / (1 << int(shift[i])) for x in r]
        return out, shift

    (qf, _), (df, ds) = scaled(queries), scaled(data)
    size = np.ldexp(1.0, np.maximum(ds - ds.max(), -1000).astype(int))
    t = (qf @ df.T) * size
    err = (width + 4) * 2.0**-51 * np.sqrt((qf**2).sum(1))[:, None] * np.sqrt((df**2).sum(1)) * size + 2.0**-990
    own = q_uid[:, None] == d_uid
    t[own] = -np.inf
    low = np.sort(t - err, 1)[:, -min(k, len(data))]
    out = []
    for i, j in enumerate(map(np.flatnonzero, (t + err >= low[:, None]) & ~own)):
        found = sorted((-sum(x * y for x, y in zip(queries[i], data[c], strict=False)), int(d_id[c]), int(d_uid[c])) for c in j.tolist())
        out += [(i, -s, v, u) for s, v, u in found[:k]]
    return out


def beyond(score: int) -> tuple[int, str | None]:
    """(1, 0 or -1 where a score is above, in or below 64 bits; what ranks scores beyond them)."""
    if LEAST < score <= MOST:
        return 0, None
    digits = str(abs(score))
    if score > 0:
        return 1, f"{len(digits):05d}{digits}"
    return -1, f"{99_999 - len(digits):05d}" + "".join(str(9 - int(c)) for c in digits)


# ---------------------------------------------------------------- blocks
def whole_row(values: list[float], scale: float) -> list[int]:
    """floor(scale x) of each, exact where the product overflows a double."""
    return [math.floor(y) if math.isfinite(y := scale * x) else math.floor(Fraction(x) * Fraction(scale)) for x in values]


@lru_cache(8)
def _axes(width: int) -> np.ndarray:
    """Directions on which a row of length one has a standard normal component, about."""
    return np.random.default_rng(width).normal(size=(width, AXES))


def _coded(scale: float):
    """Rows to whole numbers: bytes of 32-bit ones if narrow, else pickled ones, and their place along the curve."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = b.column("v")
            size = np.asarray(cells.value_lengths().fill_null(0), dtype=np.int64)
            flat = np.asarray(cells.flatten().cast(pa.float64()).fill_null(float("nan")), dtype=np.float64)
            first, valid = np.cumsum(size) - size, np.asarray(cells.is_valid())
            codes: list[bytes | None] = [None] * b.num_rows
            wide, place = np.zeros(b.num_rows, bool), np.zeros(b.num_rows, np.int64)
            for width in np.unique(size[valid]).tolist():  # rows of one length together
                rows = np.flatnonzero(valid & (size == width))
                x = flat[first[rows][:, None] + np.arange(width)]
                fine = np.isfinite(x).all(1)
                rows, x = rows[fine], x[fine]
                with np.errstate(over="ignore"):
                    y = np.floor(x * scale)
                    wide[rows] = ~((y**2).sum(1) <= NARROW)
                for i, own in zip(rows.tolist(), np.where(wide[rows][:, None], 0, y).astype("<i4"), strict=True):
                    codes[i] = own.tobytes()
                for j in np.flatnonzero(wide[rows]).tolist():
                    codes[rows[j]] = pickle.dumps(whole_row(x[j].tolist(), scale))
                big = np.abs(x).max(1, initial=0.0)[:, None]
                unit = x / np.where(big > 0, big, 1.0)
                long = np.sqrt((unit**2).sum(1))[:, None]
                cell = (unit / np.where(long > 0, long, 1.0)) @ _axes(width) / 6 + 0.5
                place[rows] = hilbert_key(np.clip(cell * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64), BITS)
            at = np.flatnonzero([c is not None for c in codes])
            codes, wide, place = [codes[i] for i in at.tolist()], wide[at], place[at]
            where = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(where) for c in ("uid", "vec_id", "q")), pa.array(codes, pa.binary()), pa.array(wide, pa.bool_()), pa.array(place, pa.int64())], names=["uid", "vec_id", "q", "code", "wide", "place"])

    return run


def _blocks(size: int, leaf: int):
    """Rows in order to blocks of one kind, each known by its first row."""

    def made(rows: list[tuple]) -> tuple:
        uid, ids = np.array([r[0] for r in rows], np.int64), np.array([MOST if r[1] is None else r[1] for r in rows], np.int64)
        if rows[0][2]:
            return int(uid[0]), pickle.dumps(([pickle.loads(r[3]) for r in rows], uid, ids), protocol=5), None, 0.0, 0.0
        width = max(len(r[3]) for r in rows) // 4
        points = np.zeros((len(rows), width), np.int32)
        for i, r in enumerate(rows):
            points[i, : len(r[3]) // 4] = np.frombuffer(r[3], "<i4")
        tree = CoverTree(points, leaf)
        return int(uid[0]), pickle.dumps((tree, uid[tree.order], ids[tree.order]), protocol=5), tree.centre[0].tobytes(), float(tree.norm[0]), float(tree.radius[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out(rows):
            block, tree, centre, norm, radius = made(rows)
            trim()
            return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([len(rows)]), pa.array([tree], pa.binary()), pa.array([centre], pa.binary()), pa.array([norm]), pa.array([radius])], names=["block", "size", "tree", "centre", "norm", "radius"])

        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("uid", "vec_id", "wide", "code")), strict=True):
                if held and (r[2] != held[0][2] or len(held) >= (WIDE_BLOCK if r[2] else size)):
                    yield out(held)
                    held = []
                held.append(r)
        if held:
            yield out(held)

    return run


BLOCK = "block long, size long, tree binary, centre binary, norm double, radius double"


def _bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bound of each pair of blocks; pairs with a wide one are never dropped."""
    for b in batches:
        ups = []
        for qc, qn, qr, dc, dn, dr in zip(*(b.column(c).to_pylist() for c in ("q_centre", "q_norm", "q_radius", "centre", "norm", "radius")), strict=True):
            if qc is None or dc is None:
                ups.append(math.inf)
                continue
            x, y = np.frombuffer(qc), np.frombuffer(dc)
            m = min(len(x), len(y))
            ups.append(float(upper(x[:m] @ y[:m], qn, qr, dn, dr)))
        yield pa.RecordBatch.from_arrays([b.column("q_block"), b.column("block"), pa.array(ups, pa.float64())], names=["q_block", "block", "up"])


def _pad(tree: CoverTree, width: int) -> None:
    more = width - tree.points.shape[1]
    if more > 0:
        tree.points, tree.centre = np.pad(tree.points, ((0, 0), (0, more))), np.pad(tree.centre, ((0, 0), (0, more)))


def _listed(side) -> list[list[int]]:
    return side if isinstance(side, list) else side.points.tolist()


FOUND = "q_block long, q_uid long, query_id long, vec_id long, uid long, score long, over int, digits string"


def _search(k: int):
    """Pairs of trees to the best rows of each query; kth holds the queries' k-th scores so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for q_block, q_blob, d_blob, kth in zip(b.column("q_block").to_pylist(), b.column("q_tree"), b.column("tree"), b.column("kth").to_pylist(), strict=True):
                (qt, q_uid, q_id), (dt, d_uid, d_id) = pickle.loads(q_blob.as_py()), pickle.loads(d_blob.as_py())
                if isinstance(qt, list) or isinstance(dt, list):
                    best = exact_best(_listed(qt), q_uid, _listed(dt), d_uid, d_id, k)
                    r, ids, uids = np.array([x[0] for x in best], int), np.array([x[2] for x in best], np.int64), np.array([x[3] for x in best], np.int64)
                    score = np.array([min(max(x[1], LEAST), MOST) for x in best], np.int64)
                    over, digits = zip(*(beyond(x[1]) for x in best), strict=True) if best else ((), ())
                else:
                    width = max(qt.points.shape[1], dt.points.shape[1])
                    _pad(qt, width)
                    _pad(dt, width)
                    floor = None
                    if kth:
                        by = dict(kth)
                        floor = np.array([by.get(u, LEAST) for u in q_uid.tolist()], np.int64)
                    s = Search(qt, q_uid, dt, d_uid, d_id, k, floor)
                    r, c = np.nonzero(s.score != LEAST)
                    score, ids, uids = s.score[r, c], s.ids[r, c], s.uids[r, c]
                    over, digits = np.zeros(len(r), int), [None] * len(r)
                n = len(r)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([q_block] * n, pa.int64()), pa.array(q_uid[r]), pa.array(q_id[r]), pa.array(ids, pa.int64(), mask=ids == MOST), pa.array(uids, pa.int64()), pa.array(score, pa.int64()), pa.array(over, pa.int32()), pa.array(digits, pa.string())],
                    names=["q_block", "q_uid", "query_id", "vec_id", "uid", "score", "over", "digits"],
                )
                trim()

    return run


def top_k(vectors: DataFrame, is_query, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query row's k best other rows, ties to the smaller vec_id."""
    v = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vec_col}`").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    v = v.where("v is not null").withColumn("uid", F.monotonically_increasing_id())
    rows = stage(v.mapInArrow(_coded(scale), "uid long, vec_id long, q boolean, code binary, wide boolean, place long"), "vectors")
    n, nq = rows.agg(F.count("*"), F.count_if("q")).first()

    def blocks(df: DataFrame, count: int, size: int, leaf: int, label: str) -> DataFrame:
        order = ["wide", "place", "uid"]
        return stage(df.repartitionByRange(max(1, -(-count // size)), *order).sortWithinPartitions(*order).mapInArrow(_blocks(size, leaf), BLOCK), label)

    trees = blocks(rows, n, DATA_BLOCK, DATA_LEAF, "data-trees")
    asked = blocks(rows.where("q"), nq, QUERY_BLOCK, QUERY_LEAF, "query-trees").select(*(F.col(c).alias("q_" + c) for c in ("block", "size", "tree", "centre", "norm", "radius")))
    drop_staged(rows)
    # every block of queries meets the centre of every block of rows: a query block goes to all of some slots, a row block to one
    count = trees.count()
    slots = min(1024, max(1, count))
    about = trees.select("block", "centre", "norm", "radius", F.pmod(F.xxhash64("block"), F.lit(slots)).alias("slot"))
    going = asked.drop("q_tree").withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))))
    pairs = stage(about.join(going, "slot").mapInArrow(_bounds, "q_block long, block long, up double"), "block-pairs")
    tasks = min(4096, max(1, count * asked.count()))

    def searched(which: DataFrame) -> DataFrame:
        """The best rows that each of some pairs (q_block, block, kth) gives."""
        return trees.select("block", "tree").join(which.join(asked.select("q_block", "q_tree"), "q_block").repartition(tasks, "block"), "block").mapInArrow(_search(k), FOUND)

    first = pairs.groupBy("q_block").agg(F.max_by("block", F.struct(F.when(F.col("up") < math.inf, F.col("up")), "block")).alias("block"))
    near = stage(searched(first.withColumn("kth", F.expr("cast(null as map<long,long>)"))), "near-found")
    # the k-th score of each query that has k is a floor for the rest; the least of a block's queries, if all have one, is the block's
    per = near.groupBy("q_block", "q_uid").agg(F.count("*").alias("n"), F.min("score").alias("low"), F.max(F.abs("over")).alias("over")).where(f"n >= {k} and over = 0")
    per = per.groupBy("q_block").agg(F.map_from_entries(F.collect_list(F.struct("q_uid", "low"))).alias("kth"), F.min("low").alias("least"), F.count("*").alias("has"))
    floors = asked.select("q_block", "q_size").join(per, "q_block", "left").select("q_block", "kth", F.when(F.col("has") == F.col("q_size"), F.col("least")).alias("floor"))
    rest = pairs.join(first, ["q_block", "block"], "left_anti").join(floors, "q_block").where("floor is null or up >= floor").select("q_block", "block", "kth")
    best = Window.partitionBy("q_uid").orderBy(F.col("over").desc(), F.col("score").desc(), F.col("digits").desc(), F.col("vec_id").asc_nulls_last(), "uid")
    return near.unionByName(searched(rest)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(q.e, d.e) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 5
"""
