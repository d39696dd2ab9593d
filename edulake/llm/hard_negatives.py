"""Hard negatives by exact inner-product search over cover trees of norm-augmented vectors.

Every vector gets one more component that brings it to the largest norm of the table; for a query, whose own extra
component is 0, inner product and distance then order vectors alike. Vectors are dealt out to the nearest of a bounded
number of centres, which are the upper level of the tree, and every block of a centre's vectors builds the levels below: a
node's children are vectors of it that lie further apart than half its covering radius and that leave no vector further
away than that. The inner product of a query q with anything below a node lies within |q| times the node's covering radius
of that with its own vector. So a search skips the centres and nodes whose range misses the window it looks for, goes
down best first, and stops when no range left can beat what it has. Scores are exact; centres only decide how much is
skipped.

Anchors meet blocks in groups of bounded size, and only those blocks that their ranges ask for.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edulake.llm.textops import released
from edulake.session import settle

#: Vectors of a block, and anchors that meet a block at once, on average.
BLOCK = 4096
#: Centres at most, and rows of the sample that they are chosen from. Neither bears on the results.
MOST_CENTRES = 256
SAMPLE = 8192
#: Vectors of a node that is searched without children.
LEAF = 16
#: Anchors whose scores for a root's children are computed together.
AT_ONCE = 64


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """The vectors of a list column as rows; a shorter one is continued with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return values.reshape(len(sizes), width).astype(np.float64)
    out = np.zeros((len(sizes), width))
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def augment(vectors: np.ndarray, square: float) -> np.ndarray:
    """The vectors with one more component that brings them to the squared norm ``square``."""
    rest = np.sqrt(np.maximum(square - np.einsum("ij,ij->i", vectors, vectors), 0))
    return np.column_stack((vectors, rest))


def spread_out(points: np.ndarray, most: int, radius: float = 0.0, first: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Places of centres, each the point furthest from those before, until all lie within ``radius`` of one; and the
    centre of each point. The first centre is the point at ``first``."""
    chosen = [first]
    squares = np.einsum("ij,ij->i", points, points)
    distance = np.full(len(points), np.inf)
    owner = np.zeros(len(points), dtype=np.int64)
    far = first
    while True:
        # Squared distances by one product with a vector; a centre is never chosen twice, whatever the rounding.
        further = squares + squares[far] - 2 * (points @ points[far])
        nearer = further < distance
        nearer[chosen[:-1]] = False
        owner[nearer] = len(chosen) - 1
        distance[nearer] = further[nearer]
        distance[far], owner[far] = -1.0, len(chosen) - 1
        far = int(distance.argmax())
        if len(chosen) >= most or distance[far] <= radius * radius:
            break
        chosen.append(far)
    return np.array(chosen), owner


class Tree:
    """A cover tree over the rows of a block, flattened: ``rows`` of vectors lie in the order of the nodes.

    Node k has its own vector at ``lo[k]``, all vectors of its subtree up to ``hi[k]``, its children from ``child[k]`` on
    (``kids[k]`` of them, the first one with the same vector), its covering ``radius[k]`` and least and largest label.
    """

    INTEGERS = ("lo", "hi", "child", "kids", "least", "most")

    def __init__(self, vectors, ids, labels, radius, nodes):
        self.vectors, self.ids, self.labels, self.radius = vectors, ids, labels, radius
        for name, column in zip(self.INTEGERS, nodes, strict=True):
            setattr(self, name, column)
        self._below: dict[int, tuple] = {}

    def below(self, node: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of a node's children those of a single vector, as rows, and the other ones; and the vectors of both."""
        if node not in self._below:
            nodes = np.arange(self.child[node], self.child[node] + self.kids[node])
            alone = self.hi[nodes] - self.lo[nodes] == 1
            rows, wider = self.lo[nodes[alone]], nodes[~alone]
            self._below[node] = rows, wider, self.vectors[rows], self.vectors[self.lo[wider]]
        return self._below[node]

    @classmethod
    def grow(cls, vectors: np.ndarray, ids: np.ndarray, labels: np.ndarray, square: float) -> Tree:
        points = augment(vectors, square)
        order = np.arange(len(points))
        lo, hi, child, kids, radius = [0], [len(points)], [0], [0], []
        at = 0
        while at < len(lo):
            own = order[lo[at] : hi[at]]
            inside = points[own]
            wide = float(np.linalg.norm(inside - inside[0], axis=1).max())
            radius.append(wide)
            if len(own) > LEAF and wide > 0:
                chosen, owner = spread_out(inside, len(own), wide / 2)
                # Each child's vectors side by side, its own vector first.
                rank = np.ones(len(own), dtype=np.int64)
                rank[chosen] = 0
                order[lo[at] : hi[at]] = own[np.lexsort((own, rank, owner))]
                ends = lo[at] + np.cumsum(np.bincount(owner, minlength=len(chosen)))
                child[at], kids[at] = len(lo), len(chosen)
                lo.extend([lo[at], *ends[:-1].tolist()])
                hi.extend(ends.tolist())
                child.extend([0] * len(chosen))
                kids.extend([0] * len(chosen))
            at += 1
        labels = labels[order]
        first, last = np.array(lo), np.array(hi)
        least = np.array([labels[a:b].min() for a, b in zip(lo, hi, strict=True)])
        most = np.array([labels[a:b].max() for a, b in zip(lo, hi, strict=True)])
        nodes = (first, last, np.array(child), np.array(kids), least, most)
        return cls(vectors[order], ids[order], labels, np.array(radius), nodes)

    def packed(self) -> dict[str, bytes]:
        nodes = np.stack([getattr(self, name) for name in self.INTEGERS]).astype(np.int64)
        parts = {"vectors": self.vectors, "ids": self.ids, "labels": self.labels, "radius": self.radius, "nodes": nodes}
        return {name: np.ascontiguousarray(part).tobytes() for name, part in parts.items()}

    @classmethod
    def unpacked(cls, row: dict[str, bytes]) -> Tree:
        ids, labels, nodes = (np.frombuffer(row[k], dtype=np.int64) for k in ("ids", "labels", "nodes"))
        vectors = np.frombuffer(row["vectors"], dtype=np.float64).reshape(len(ids), -1)
        return cls(vectors, ids, labels, np.frombuffer(row["radius"]), nodes.reshape(len(cls.INTEGERS), -1))


class Search:
    """Searches of one anchor in one tree. Scores of a node's children are kept for further windows."""

    def __init__(self, tree: Tree, anchor: int, label: int, query: np.ndarray):
        self.tree, self.anchor, self.label, self.query = tree, anchor, label, query
        self.norm = float(np.linalg.norm(query))
        self.known: dict[int, tuple] = {}

    @classmethod
    def several(cls, tree: Tree, anchors: list[int], labels: list[int], queries: np.ndarray) -> Iterator[Search]:
        """A search for each anchor; the scores of the root's children come from one product for many of them."""
        for k in range(0, len(anchors), AT_ONCE):
            some = queries[k : k + AT_ONCE]
            if tree.kids[0]:
                _, _, rows, wider = tree.below(0)
                first, second = some @ rows.T, some @ wider.T
            for at in range(len(some)):
                search = cls(tree, anchors[k + at], labels[k + at], some[at])
                if tree.kids[0]:
                    search._keep(0, first[at], second[at])
                yield search

    def _keep(self, node: int, alone: np.ndarray, scores: np.ndarray) -> tuple:
        """Rows and scores of single children; least and largest score below the others, and these."""
        rows, wider, *_ = self.tree.below(node)
        radius = self.tree.radius[wider]
        wide = radius * (self.norm * (1 + 1e-9)) + 1e-6 * (radius > 0)
        self.known[node] = rows, alone, scores - wide, scores + wide, wider
        return self.known[node]

    def _children(self, node: int) -> tuple:
        if node in self.known:
            return self.known[node]
        _, _, rows, wider = self.tree.below(node)
        return self._keep(node, rows @ self.query, wider @ self.query)

    def best(self, count: int, low: float, high: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of the ``count`` rows with the highest scores in [low, high], ties by the smaller id.

        Of rows with the anchor's label, or of those with others; never the anchor itself.
        """
        tree = self.tree
        scores, ids = np.zeros(0), np.zeros(0, dtype=np.int64)
        queue: list[tuple] = [(-np.inf, 0, None, None)]

        def take(rows: np.ndarray, found: np.ndarray) -> None:
            nonlocal scores, ids, low
            inside = np.flatnonzero((found >= low) & (found <= high))
            rows = rows[inside]
            good = ((tree.labels[rows] == self.label) == same) & (tree.ids[rows] != self.anchor)
            if not good.any():
                return
            scores = np.concatenate((scores, found[inside[good]]))
            ids = np.concatenate((ids, tree.ids[rows[good]]))
            order = np.lexsort((ids, -scores))[:count]
            scores, ids = scores[order], ids[order]
            if len(scores) == count:
                low = max(low, scores[-1])

        while queue:
            top, node, rest, at = heapq.heappop(queue)
            if -top < low:
                break
            if rest is not None:
                # The next best child of a node whose children are ranked already.
                keys, nodes = rest
                node = int(nodes[at])
                if at + 1 < len(nodes):
                    heapq.heappush(queue, (-keys[at + 1], int(nodes[at + 1]), rest, at + 1))
            if not tree.kids[node]:
                rows = np.arange(tree.lo[node], tree.hi[node])
                take(rows, tree.vectors[rows] @ self.query)
                continue
            rows, alone, under, upper, nodes = self._children(node)
            take(rows, alone)
            open_ = (upper >= low) & (under <= high)
            least, most = tree.least[nodes], tree.most[nodes]
            if same:
                open_ &= (least <= self.label) & (self.label <= most)
            else:
                open_ &= (least != self.label) | (most != self.label)
            if open_.any():
                nodes, keys = nodes[open_], np.minimum(upper[open_], high)
                order = np.argsort(-keys, kind="stable")
                rest = keys[order], nodes[order]
                heapq.heappush(queue, (-rest[0][0], int(rest[1][0]), rest, 0))
        return scores, ids


_TREE = "centre int, piece int, ids binary, labels binary, vectors binary, radius binary, nodes binary"


def _plant(width: int, square: float):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        ids = rows.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        vectors, labels = _matrix(rows.column("vector"), width)[order], rows.column("label").to_numpy()[order]
        tree = Tree.grow(vectors, ids[order], labels, square).packed()
        columns = {"centre": pa.array([key[0].as_py()], pa.int32()), "piece": pa.array([key[1].as_py()], pa.int32())}
        return pa.table(columns | {k: pa.array([tree[k]], pa.binary()) for k in ("ids", "labels", "vectors", "radius", "nodes")})

    return run


def _nearest(centres: np.ndarray, width: int, square: float):
    @released
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = augment(_matrix(batch.column("vector"), width), square)
            nearest, radius = np.zeros(len(points), dtype=np.int32), np.zeros(len(points))
            for k in range(0, len(points), 256):
                part = points[k : k + 256]
                apart = np.linalg.norm(part[:, None, :] - centres[None, :, :], axis=2)
                nearest[k : k + 256] = apart.argmin(1)
                radius[k : k + 256] = apart.min(1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(nearest), pa.array(radius)], [*batch.schema.names, "centre", "radius"]
            )

    return run


def _reaching(centres: np.ndarray, radii: np.ndarray, width: int, home: bool | None):
    """Anchors with each centre whose range meets their window from ``low`` to ``high``.

    ``home``: only the centre with the highest score, or only the others; None: all.
    """

    @released
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column("vector"), width)
            scores = vectors @ centres[:, :width].T
            norms = np.linalg.norm(vectors, axis=1)[:, None]
            wide = norms * radii[None, :] * (1 + 1e-9) + 1e-6
            low, high = (batch.column(c).to_numpy(zero_copy_only=False)[:, None] for c in ("low", "high"))
            open_ = (radii[None, :] >= 0) & (scores + wide >= low) & (scores - wide <= high)
            top = np.zeros_like(open_)
            if len(open_):
                top[np.arange(len(top)), np.where(radii[None, :] >= 0, scores, -np.inf).argmax(1)] = True
            if home is not None:
                open_ = top if home else open_ & ~top
            row, centre = np.nonzero(open_)
            kept = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(centre.astype(np.int32))], [*kept.schema.names, "centre"]
            )

    return run


_POSITIVES = "anchor bigint, id bigint, score bigint"
_NEGATIVES = "anchor bigint, positive_id bigint, positive_score bigint, id bigint, score bigint"


def _positives(count: int, width: int):
    def run(anchors: pa.Table, trees: pa.Table) -> pa.Table:
        out: list[tuple] = []
        queries = _matrix(anchors.column("vector"), width)
        keys, labels, lows = (anchors.column(c).to_pylist() for c in ("id", "label", "low"))
        for tree in map(Tree.unpacked, trees.to_pylist()):
            for search, low in zip(Search.several(tree, keys, labels, queries), lows, strict=True):
                scores, ids = search.best(count, low, np.inf, same=True)
                out += [(search.anchor, i, int(s)) for i, s in zip(ids.tolist(), scores, strict=True)]
        columns = list(zip(*out, strict=True)) or [()] * 3
        return pa.table([pa.array(c, pa.int64()) for c in columns], ["anchor", "id", "score"])

    return run


def window(score: int, low: int, high: int) -> tuple[int, int]:
    """The scores n with ``low * score <= 100 * n <= high * score``."""
    return -((-low * score) // 100), (high * score) // 100


def _negatives(count: int, width: int, low: int, high: int):
    def run(anchors: pa.Table, trees: pa.Table) -> pa.Table:
        out: list[tuple] = []
        queries = _matrix(anchors.column("vector"), width)
        keys, labels, wanted = (anchors.column(c).to_pylist() for c in ("id", "label", "positives"))
        for tree in map(Tree.unpacked, trees.to_pylist()):
            for search, positives in zip(Search.several(tree, keys, labels, queries), wanted, strict=True):
                for positive in positives:
                    least, most = window(positive["score"], low, high)
                    if least > most:
                        continue
                    scores, ids = search.best(count, least, most, same=False)
                    own = (search.anchor, positive["id"], positive["score"])
                    out += [(*own, i, int(s)) for i, s in zip(ids.tolist(), scores, strict=True)]
        names = ["anchor", "positive_id", "positive_score", "id", "score"]
        columns = list(zip(*out, strict=True)) or [()] * 5
        return pa.table([pa.array(c, pa.int64()) for c in columns], names)

    return run


class Index:
    """All vectors in blocks, each with its tree. ``rows`` has ``id``, ``label`` and ``vector``, none of them null."""

    def __init__(self, rows: DataFrame, block: int = BLOCK, most_centres: int = MOST_CENTRES):
        rows = settle(rows)
        self.block = block
        norm = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
        self.size, width, square = rows.agg(F.count("*"), F.max(F.size("vector")), F.max(norm)).first()
        self.width, self.square = max(width or 0, 1), square or 0.0
        if not self.size:
            return
        sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").toArrow()
        points = augment(_matrix(sample.column("vector"), self.width), self.square)
        chosen, _ = spread_out(points, min(most_centres, -(-self.size // block)))
        self.centres = points[chosen]
        schema = "id bigint, label bigint, vector array<double>, centre int, radius double"
        self.rows = settle(rows.mapInArrow(_nearest(self.centres, self.width, self.square), schema))
        found = self.rows.groupBy("centre").agg(F.count("*").alias("n"), F.max("radius").alias("radius")).collect()
        self.radii = np.full(len(chosen), -1.0)
        for r in found:
            self.radii[r.centre] = r.radius
        # At most ``most_centres`` rows: how many blocks a centre's vectors are cut into.
        spark = rows.sparkSession
        self.pieces = spark.createDataFrame([(r.centre, -(-r.n // block)) for r in found], "centre int, pieces int")
        piece = F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int")
        placed = self.rows.join(F.broadcast(self.pieces), "centre").select("centre", piece.alias("piece"), "id", "label", "vector")
        grown = placed.groupBy("centre", "piece").applyInArrow(_plant(self.width, self.square), _TREE)
        self.trees = settle(grown)

    def visit(self, anchors: DataFrame, n_anchors: int, home: bool | None, search, schema: str) -> DataFrame:
        """Run ``search`` on every tree that anchors reach, with the anchors that reach it.

        ``anchors`` has ``id``, ``label``, ``vector``, ``low``, ``high`` and what else the search needs.
        """
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in anchors.schema.fields)
        reach = anchors.mapInArrow(_reaching(self.centres, self.radii, self.width, home), f"{kinds}, centre int")
        groups = max(1, -(-n_anchors // self.block))
        reach = reach.join(F.broadcast(self.pieces), "centre").select(
            *anchors.columns,
            "centre",
            F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"),
            F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("part"),
        )
        reach = settle(reach)
        keys = ["centre", "piece", "part"]
        wanted = reach.select(keys).distinct().toDF("centre", "piece", "__part")
        trees = self.trees.join(wanted, ["centre", "piece"]).withColumnRenamed("__part", "part")
        return reach.groupBy(*keys).cogroup(trees.groupBy(*keys)).applyInArrow(search, schema)


def _first(rows: DataFrame, by: list[str], count: int) -> DataFrame:
    """The ``count`` rows of highest score by ``by``, ties by the smaller id, with their ``rank`` from 1."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def mine(
    rows: DataFrame,
    anchor: Column,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    block: int = BLOCK,
    most_centres: int = MOST_CENTRES,
) -> DataFrame:
    """For every anchor and each of its positives the hard negatives of its window.

    ``rows`` has ``id``, ``label`` and ``vector`` (whole numbers as doubles), and ``anchor`` tells by these which rows are
    anchors. A score is the inner product of two vectors, exact up to 2^53; higher ones come first, ties by the smaller id.
    An anchor's positives are its first ``positives`` other rows of its label; a positive's negatives the first
    ``negatives`` rows of other labels with ``low`` to ``high`` percent of its score, so none where that is negative.

    Rows with a null id, label or vector, or a null or non-finite component, take no part. Of rows with one id the one
    with the smallest label and vector stands for all. A vector shorter than others is continued with zeros. Gives
    ``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score`` and ``negative_score``; no rows for an
    empty table, or for anchors without positives or positives without negatives.
    """
    spark = rows.sparkSession
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.select(F.col("id").cast("bigint"), F.col("label").cast("bigint"), F.col("vector").cast("array<double>"))
    rows = rows.where("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL").where(sound)
    one = rows.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("v")).select("id", "v.label", "v.vector")
    index = Index(one, block, most_centres)
    result = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    if not index.size:
        return spark.createDataFrame([], result)
    anchors = settle(index.rows.where(anchor).select("id", "label", "vector"))
    n = anchors.count()
    infinite = F.lit(float("inf"))

    # What the best centre of an anchor holds says how high a score must be to count anywhere else.
    asked = anchors.withColumn("low", -infinite).withColumn("high", infinite)
    found = settle(index.visit(asked, n, True, _positives(positives, index.width), _POSITIVES))
    full = _first(found, ["anchor"], positives).where(F.col("rank") == positives)
    least = full.select(F.col("anchor").alias("id"), F.col("score").cast("double").alias("least"))
    asked = anchors.join(least, "id", "left").withColumn("low", F.coalesce("least", -infinite))
    asked = asked.drop("least").withColumn("high", infinite)
    more = index.visit(asked, n, False, _positives(positives, index.width), _POSITIVES)
    chosen = settle(_first(found.unionByName(more), ["anchor"], positives))

    # One search for all windows of an anchor: from the lowest beginning to the highest end.
    some = F.sort_array(F.collect_list(F.struct("rank", F.col("id").alias("id"), "score")))
    windows = chosen.groupBy("anchor").agg(
        some.alias("positives"),
        F.min(F.col("score") * (low / 100) - 1).alias("low"),
        F.max(F.col("score") * (high / 100) + 1).alias("high"),
    )
    asked = anchors.join(windows.withColumnRenamed("anchor", "id"), "id").select(
        "id", "label", "vector", "positives", "low", "high"
    )
    hard = index.visit(asked, n, None, _negatives(negatives, index.width, low, high), _NEGATIVES)
    return _first(hard, ["anchor", "positive_id"], negatives).select(
        F.col("anchor").alias("anchor_id"),
        "positive_id",
        "rank",
        F.col("id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )


#: The query's rows in SQL.
SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
    CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id
  WHERE a.vec_id % 50 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same
    AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM n WHERE rank <= 3
"""
