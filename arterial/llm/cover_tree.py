"""Embedding near-dedup: exact threshold pairs by dual traversal of cover trees.

Rows take part when label and vector are not null and the vector has a finite, non-zero length; they
meet only rows of the same label (and the same number of components). Equal vectors are collapsed to
one weighted point, and so are vectors of equal unit vectors (multiples of each other): each is linked to
the others of its point and has that point's links. Unit vectors lie on a sphere where cosine >= c is distance <= tau = sqrt(2 - 2c).

The upper part of the tree is a table: a cell with more than ``cell`` points is split among a few of
its points (chosen by hash), each point going to the nearest, level by level, and each cell keeps its
centre and covering radius. Cells that are still larger after ``LEVELS`` levels (where nearly all points
are nearest to one) are dealt by hash into cells of one centre, so every point ends in a leaf. The traversal
starts with each root against itself and expands pairs of cells by joins on their parents, dropping a pair when
the centres are further apart than both radii and tau together.

Leaf cells that follow each other in the tree are put together to parts of at most ``PART_POINTS`` points and
``PART_CELLS`` cells. A task takes two parts and the pairs of cells between them, so a vector travels once for each
part it meets and not once for each cell. There each cell gets its lower levels: centres of radius 1/2, 1/4 and 1/8,
each point in the cover of one centre a level up. Node pairs are pruned by the same bound, and counted as a whole when
even their furthest points link. Only the remaining pairs are compared in double precision. A task
returns a count for each point and the edges of a spanning forest, never its pairs.

Defined cases: all other rows have 0 links and are their own component; a null vec_id links nothing and
has a null component; rows that share a vec_id but not the vector are one node of all their links; a zero
distance between different vectors (multiples of each other) is a link; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytesops import trimmed, trimmed_group
from .common import components, discard, stored

#: Points of a cell that isn't split further.
CELL = 2048
#: Children of a split cell.
FAN = 16
#: Levels of splits by distance; what is still too large then is dealt by hash.
LEVELS = 24
#: What a part holds at most, but for the cell that fills it. Two parts and their pairs of cells are one task.
PART_POINTS = 16384
PART_CELLS = 64
#: Bounds are widened by this much, so rounding never prunes a pair that is compared exactly afterwards.
SLACK = 1e-9


class Node:
    """A cover: its centre, covering radius and points, and the covers below it."""

    def __init__(self, centre: np.ndarray, radius: float, points: np.ndarray, children: list[Node]):
        self.centre, self.radius, self.points, self.children = centre, radius, points, children
        if children:
            self.centres = np.stack([c.centre for c in children])
            self.radii = np.array([c.radius for c in children])


def build(x: np.ndarray, points: np.ndarray, radius: float, least: float) -> Node:
    """The cover of ``points``: centres of half the radius below it, down to ``least``."""
    centre = x[points].mean(axis=0)
    reach = float(np.sqrt(((x[points] - centre) ** 2).sum(axis=1).max())) if len(points) > 1 else 0.0
    if len(points) <= 16 or radius < least or reach <= least:
        return Node(centre, reach, points, [])
    groups, rest = [], points
    while len(rest):
        near = ((x[rest] - x[rest[0]]) ** 2).sum(axis=1) <= radius * radius
        groups.append(rest[near])
        rest = rest[~near]
    if len(groups) == 1:
        return build(x, points, radius / 2, least)
    return Node(centre, reach, points, [build(x, g, radius / 2, least) for g in groups])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d2 = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(d2, 0))


def _joined(hit: np.ndarray, p: np.ndarray, q: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges that connect what the hits connect: every row and column to the first row of its part."""
    big = len(p)
    label = np.where(hit.any(axis=1), np.arange(big), big)
    while True:
        column = np.where(hit, label[:, None], big).min(axis=0)
        new = np.minimum(label, np.where(hit, column[None, :], big).min(axis=1))
        if (new == label).all():
            break
        label = new
    rows, columns = np.flatnonzero(label < big), np.flatnonzero(column < big)
    return [(p[rows], p[label[rows]]), (q[columns], p[column[columns]])]


class Traversal:
    """Weighted link counts (``links``) of the points ``x``, and ``edges`` (id, id) that connect all linked points."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, weights: np.ndarray, cosine: float):
        self.x, self.ids, self.weights, self.cosine = x, ids, weights, cosine
        self.tau = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
        self.links = np.zeros(len(x), np.int64)
        self.found: list[tuple[np.ndarray, np.ndarray]] = []

    def edges(self) -> np.ndarray:
        pairs = np.concatenate([np.stack(e, axis=1) for e in self.found]) if self.found else np.zeros((0, 2), np.int64)
        return np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)

    def compare(self, p: np.ndarray, q: np.ndarray, own: bool) -> None:
        x, w = self.x, self.weights
        for at in range(0, len(p), 512):
            part = p[at : at + 512]
            hit = x[part] @ x[q].T >= self.cosine
            if own:
                hit &= part[:, None] != q[None, :]
            if hit.any():
                self.links[part] += hit @ w[q]
                if not own:
                    self.links[q] += hit.T @ w[part]
                self.found.extend(_joined(hit, self.ids[part], self.ids[q]))

    def whole(self, s: Node, t: Node) -> None:
        w, ids = self.weights, self.ids
        if s is t:
            self.links[s.points] += w[s.points].sum() - w[s.points]
        else:
            self.links[s.points] += w[t.points].sum()
            self.links[t.points] += w[s.points].sum()
        self.found.append((ids[s.points], np.full(len(s.points), ids[t.points[0]])))
        self.found.append((ids[t.points], np.full(len(t.points), ids[s.points[0]])))

    def meet(self, a: Node, b: Node) -> None:
        """All pairs between two trees, or within one, each once and no point with itself."""
        tau = self.tau
        stack = [(a, b)]
        while stack:
            s, t = stack.pop()
            gap = float(np.sqrt(((s.centre - t.centre) ** 2).sum()))
            if gap > s.radius + t.radius + tau + SLACK:
                continue
            if gap + s.radius + t.radius <= tau - SLACK:
                self.whole(s, t)
            elif not s.children and not t.children:
                self.compare(s.points, t.points, s is t)
            elif s.children and t.children:
                near = _distances(s.centres, t.centres) <= s.radii[:, None] + t.radii[None, :] + tau + 1e-6
                if s is t:
                    near = np.triu(near)
                stack.extend((s.children[i], t.children[j]) for i, j in np.argwhere(near).tolist())
            else:
                big, small = (s, t) if s.children else (t, s)
                near = np.flatnonzero(_distances(big.centres, small.centre[None])[:, 0] <= big.radii + small.radius + tau + 1e-6)
                stack.extend((big.children[k], small) if big is s else (small, big.children[k]) for k in near.tolist())


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The rows of a column of equally long lists."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _meet(cosine: float):
    """Kernel: the vectors of two parts (left) and the pairs of their cells (right) to link counts and edges."""

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"a": [], "b": [], "links": [], "edge": []}
        if left.num_rows and right.num_rows:
            x = _matrix(left.column("v"))
            g, pid, n = (left.column(c).to_numpy() for c in ("g", "pid", "n"))
            names, number = np.unique(np.array(left.column("cell").to_pylist(), object), return_inverse=True)
            order = np.argsort(number, kind="stable")
            cells = dict(zip(names.tolist(), np.split(order, np.cumsum(np.bincount(number))[:-1]), strict=True))
            trees = {c: build(x, points, 0.5, 0.12) for c, points in cells.items()}
            walk = Traversal(x, pid, n, cosine)
            for a, b in sorted(set(zip(right.column("a").to_pylist(), right.column("b").to_pylist(), strict=True))):
                walk.meet(trees[a], trees[b])
            some = np.flatnonzero(walk.links)
            edges = walk.edges()
            out = {
                "a": np.concatenate((g[some], edges[:, 0])),
                "b": np.concatenate((np.zeros(len(some), np.int64), edges[:, 1])),
                "links": np.concatenate((walk.links[some], np.zeros(len(edges), np.int64))),
                "edge": np.concatenate((np.zeros(len(some), bool), np.ones(len(edges), bool))),
            }
        kinds = {"a": pa.int64(), "b": pa.int64(), "links": pa.int64(), "edge": pa.bool_()}
        return pa.table({c: pa.array(out[c], t) for c, t in kinds.items()})

    return work


def _points(rows: DataFrame) -> DataFrame:
    """``root, pid, n, ids, v``: the distinct vectors of a label with their smallest id, unit length."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    valid = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0").where(
        ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    )
    # a label's vectors of another length can't be compared with these
    valid = valid.withColumn("norm", norm).where("norm > 0 AND norm < double('infinity')")
    valid = valid.withColumn("dim", F.size("embedding"))
    return valid.groupBy("label", "dim", "embedding").agg(
        F.min("vec_id").alias("pid"), F.count(F.lit(1)).alias("n"), F.first("norm").alias("norm")
    )


LEVEL = "cell string, g long, pid long, n long, v array<double>, child int, d double, centre array<double>"


def _nearest(batches):
    """The nearest pivot of each point, its place among the cell's and the distance; or the place ``deal``, where that is given.

    Rows come sorted by cell and salt, the pivots (with a null ``g``) first.
    """
    cell = pivots = None
    for batch in batches:
        names = np.array(batch.column("cell").to_pylist(), object)
        cut = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1]))) if len(names) else np.zeros(0, np.int64)
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(names)], strict=True):
            rows = batch.slice(a, b - a)
            head = rows.column("g").is_null()
            for p in rows.filter(head).column("pivots").to_pylist():
                cell, pivots = names[a], np.array(p)
            rows = rows.filter(pc.invert(head))
            if not rows.num_rows:
                continue
            if cell != names[a]:
                raise ValueError("a cell has no pivots")
            x = _matrix(rows.column("v"))
            k = ((pivots * pivots).sum(axis=1)[None, :] - 2 * (x @ pivots.T)).argmin(axis=1)
            d = np.sqrt(((x - pivots[k]) ** 2).sum(axis=1))
            deal = rows.column("deal")
            child = k if deal.null_count else deal.to_numpy(zero_copy_only=False)
            made = {c: rows.column(c) for c in ("cell", "g", "pid", "n", "v")}
            made |= {"child": pa.array(child.astype(np.int32)), "d": pa.array(d), "centre": pa.array(list(pivots[k]), pa.list_(pa.float64()))}
            yield pa.record_batch(made)


def _split(open_: DataFrame, depth: int, cell: int) -> DataFrame:
    """The points of cells that are too large, each with its nearest pivot."""
    last = depth == LEVELS
    # the pivots of a cell: its points of smallest hash, gathered from a part of the cell that holds a bounded number
    part = open_.where(F.pmod(F.xxhash64("g", "cell"), F.lit(1 << 20)) <= (F.lit(64.0 * (1 << 20)) / F.col("count")))
    fan = F.lit(1) if last else F.least(F.lit(FAN), F.ceil(F.col("count") / cell) * 2).cast("int")
    salts = F.ceil(F.col("count") / (8 * cell)).cast("int")
    pivots = part.groupBy("cell").agg(
        F.slice(F.sort_array(F.collect_list(F.struct(F.xxhash64("g"), "v"))), 1, FAN).alias("p"), F.max(fan).alias("fan"), F.max(salts).alias("salts")
    )
    pivots = pivots.select("cell", F.transform(F.slice("p", F.lit(1), F.col("fan")), lambda s: s["v"]).alias("pivots"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    null = lambda kind: F.lit(None).cast(kind)
    heads = pivots.select("cell", "salt", null("long").alias("g"), null("long").alias("pid"), null("long").alias("n"), null("array<double>").alias("v"), null("int").alias("deal"), "pivots")
    deal = F.pmod(F.xxhash64("g", F.lit(depth)), F.ceil(F.col("count") / cell) * 2).cast("int") if last else null("int")
    points = open_.select("cell", F.pmod(F.xxhash64("g"), salts).cast("int").alias("salt"), "g", "pid", "n", "v", deal.alias("deal"), null("array<array<double>>").alias("pivots"))
    dealt = heads.union(points).repartition("cell", "salt").sortWithinPartitions("cell", "salt", F.col("g").asc_nulls_first())
    return dealt.mapInArrow(trimmed(_nearest), LEVEL)


def near_duplicates(rows: DataFrame, cosine: float = 0.98, cell: int = CELL) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row of ``rows(vec_id, embedding, label)``."""
    tau = float(np.sqrt(2 - 2 * cosine))
    points = _points(rows)
    unit = F.transform("embedding", lambda x: x.cast("double") / F.col("norm"))
    points = stored(
        points.select(F.concat_ws("/", F.col("label").cast("string"), F.col("dim").cast("string")).alias("cell"), "pid", "n", "norm", "label", "embedding"),
        "points",
    )
    # points of equal unit vectors are one of the tree, known by g; its pid is the smallest of them
    units = points.groupBy("cell", unit.alias("v")).agg(F.min("pid").alias("pid"), F.sum("n").alias("n"))
    units = stored(units.withColumn("g", F.monotonically_increasing_id()), "units")
    members = points.select("cell", unit.alias("v"), "pid", "n").join(
        units.select("cell", "v", "g", F.col("pid").alias("first"), F.col("n").alias("total")), ["cell", "v"]
    )
    members = stored(members.select("pid", "n", "g", "first", "total"), "members")
    level = units.select("cell", "g", "pid", "n", "v")
    sizes = level.groupBy("cell").count()
    pairs = sizes.select(F.col("cell").alias("a"), F.col("cell").alias("b"))  # roots against themselves
    leaves = None
    used: list[DataFrame] = []
    tree: list[DataFrame] = []
    for depth in range(LEVELS + 1):
        sizes = level.groupBy("cell").count()
        full = sizes.where(F.col("count") > cell)
        done = level.join(full.select("cell"), "cell", "left_anti")
        leaves = done if leaves is None else leaves.union(done)
        if full.isEmpty():
            break
        dealt = _split(level.join(full, "cell"), depth, cell)
        dealt = stored(dealt.withColumn("parent", F.col("cell")).withColumn("cell", F.concat_ws(".", "cell", F.col("child").cast("string"))), "level")
        used.append(dealt)
        nodes = dealt.groupBy("parent", "cell").agg(F.max("d").alias("radius"), F.first("centre").alias("centre"))
        tree.append(nodes)
        level = dealt.select("cell", "g", "pid", "n", "v")
        if depth == LEVELS:
            leaves = leaves.union(level)
    leaves = stored(leaves, "leaves")
    pairs = stored(_cell_pairs(pairs, tree, tau).distinct(), "pairs")
    discard(*used, units)
    # parts of leaf cells that follow each other; the root of a cell's path is all up to its last "/" and number
    root = F.regexp_extract("cell", r"(?s)^(.*/\d+)(?:\.\d+)*$", 1)
    so_far = Window.partitionBy("root").orderBy("cell")
    parts = leaves.groupBy("cell").count().withColumn("root", root)
    share = F.col("count") / F.lit(float(PART_POINTS)) + F.lit(1.0 / PART_CELLS)
    parts = parts.select("cell", F.concat_ws("#", "root", F.floor(F.sum(share).over(so_far) - share).cast("string")).alias("part"))
    parts = stored(parts, "parts")
    at_a, at_b = (parts.select(F.col("cell").alias(x), F.col("part").alias(f"part_{x}")) for x in "ab")
    pairs = pairs.join(at_a, "a").join(at_b, "b").select(F.least("part_a", "part_b").alias("p"), F.greatest("part_a", "part_b").alias("q"), "a", "b")
    pairs = stored(pairs, "tasks")
    need = pairs.select("p", "q", F.col("a").alias("cell")).union(pairs.select("p", "q", F.col("b").alias("cell"))).distinct()
    sent = leaves.join(need, "cell").select(F.col("p").alias("s"), F.col("q").alias("t"), "cell", "g", "pid", "n", "v")
    met = sent.groupBy("s", "t").cogroup(pairs.groupBy("p", "q")).applyInArrow(trimmed_group(_meet(cosine)), "a long, b long, links long, edge boolean")
    met = stored(met, "met")
    discard(leaves, parts, pairs)
    counts = met.where("NOT edge").groupBy(F.col("a").alias("g")).agg(F.sum("links").alias("links"))
    counts = members.join(counts, "g", "left").groupBy("pid").agg(F.sum(F.col("total") - F.col("n") + F.coalesce("links", F.lit(0))).alias("links"))
    own = members.where("pid <> first").select(F.col("pid").alias("a"), F.col("first").alias("b"))
    joined = components(met.where("edge").select("a", "b").union(own))
    classes = points.join(counts, "pid", "left").join(joined, F.col("pid") == F.col("node"), "left")
    classes = classes.select(
        "label",
        "embedding",
        (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"),
        F.coalesce("component", "pid").alias("component"),
    )
    keyed = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    out = keyed.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").join(classes, ["label", "embedding"], "left")
    none = keyed.where("vec_id IS NULL OR label IS NULL OR embedding IS NULL").select(
        "vec_id", F.lit(None).cast("long").alias("links"), F.lit(None).cast("long").alias("component")
    )
    out = out.select("vec_id", "links", "component").union(none)
    return out.select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
        (F.coalesce("component", "vec_id") == F.col("vec_id")).alias("kept"),
    )


def _cell_pairs(roots: DataFrame, tree: list[DataFrame], tau: float) -> DataFrame:
    """Pairs of leaf cells within reach of each other: both sides descend level by level, pruned by covering radii."""
    pairs = roots.select("a", "b")
    for nodes in tree:
        child = nodes.select("parent", "cell", "radius", "centre")

        def down(side: str, child: DataFrame = child) -> DataFrame:
            return child.select(
                F.col("parent").alias(f"p_{side}"), F.col("cell").alias(f"c_{side}"), F.col("radius").alias(f"r_{side}"), F.col("centre").alias(f"x_{side}")
            )

        pairs = pairs.join(down("a"), F.col("a") == F.col("p_a"), "left").join(down("b"), F.col("b") == F.col("p_b"), "left")
        gap = F.sqrt(F.aggregate(F.zip_with("x_a", "x_b", lambda u, w: (u - w) * (u - w)), F.lit(0.0), lambda s, d: s + d))
        near = F.col("x_a").isNull() | F.col("x_b").isNull() | (gap <= F.col("r_a") + F.col("r_b") + tau + SLACK)
        pairs = pairs.where(near).select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b"))
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs
