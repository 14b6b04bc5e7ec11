"""Hard negatives of anchors, found with a multiway hyperplane tree (GNAT).

Scores are inner products of integer vectors. A further component, ``sqrt(M - |x|²)`` for rows and 0 for anchors, turns them
into distances: ``|a - x|² = |a|² + M - 2<a, x>`` with ``M`` the largest squared length, so a window of scores is an annulus
around the anchor. Every split point of the tree stores the smallest and largest distance from itself to the rows of each
sibling subtree. A sibling whose range does not meet what the annulus leaves possible is eliminated; the leaves that stay are
compared exactly.

The split points are fitted on a bounded sample (``SAMPLE`` distinct vectors); routing, ranges and leaves cover every row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetsig.llm.shared import materialise, width

SAMPLE = 32_768  # distinct vectors the split points are chosen from
WAYS = 8
LEAF_ROWS = 2048  # rows a leaf should hold; the tree cannot have more leaves than SAMPLE / 8
CELL_VALUES = 4096 * 64  # components of one cell of a leaf, the most that a task holds of it
EXACT = 2.0**53
_QUERIES = 512
_SEED = 11
_FOUND = "query long, id long, score long"


@dataclass
class Tree:
    """Nodes of split points; ``children`` are nodes, or leaves as ``-1 - leaf``."""

    most: float
    points: list[np.ndarray] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    low: list[np.ndarray] = field(default_factory=list)
    high: list[np.ndarray] = field(default_factory=list)
    paths: list[list[tuple[int, int]]] = field(default_factory=list)  # of each leaf: (node, child) from the root

    @property
    def slack(self) -> float:
        """More than rounding can move a distance by."""
        return 1e-6 * np.sqrt(2 * self.most) + 1e-9


def _distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    squares = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2 * (x @ y.T)
    return np.sqrt(np.maximum(squares, 0))


def _lift(x: np.ndarray, most: float) -> np.ndarray:
    """Rows with the component that makes all their lengths equal."""
    return np.c_[x, np.sqrt(np.maximum(most - (x * x).sum(axis=1), 0))]


def _flat(x: np.ndarray) -> np.ndarray:
    """Anchors, whose further component is 0."""
    return np.c_[x, np.zeros(len(x))]


def _spread(x: np.ndarray, rng) -> np.ndarray:
    """Split points: of some random rows, each the farthest from those before."""
    pool = x[rng.choice(len(x), min(len(x), 3 * WAYS), replace=False)]
    picked, near = [0], _distance(pool, pool[:1])[:, 0]
    while len(picked) < WAYS and near.max() > 0:
        picked.append(int(near.argmax()))
        near = np.minimum(near, _distance(pool, pool[picked[-1:]])[:, 0])
    return pool[picked]


def grow(x: np.ndarray, leaf: int, most: float) -> Tree:
    """A tree over the sampled rows ``x``, split until a leaf has at most ``leaf`` of them; ranges come later."""
    tree, rng = Tree(most), np.random.default_rng(_SEED)
    x = _lift(x, most)
    todo = [(np.arange(len(x)), [])]
    while todo:
        rows, path = todo.pop()
        points = _spread(x[rows], rng) if len(rows) > leaf else x[:0]
        if len(points) < 2:
            number = -1 - len(tree.paths)
            tree.paths.append(path)
        else:
            number = len(tree.points)
            tree.points.append(points)
            tree.children.append([0] * len(points))
            own = _distance(x[rows], points).argmin(axis=1)
            todo.extend((rows[own == j], [*path, (number, j)]) for j in range(len(points)))
        if path:
            node, child = path[-1]
            tree.children[node][child] = number
    return tree


def route(tree: Tree, x: np.ndarray) -> np.ndarray:
    """Leaf of each row: at every node that of the nearest split point."""
    leaf = np.zeros(len(x), np.int64)
    todo = [(0, np.arange(len(x)))] if tree.points else []
    x = _lift(x, tree.most)
    while todo:
        node, rows = todo.pop()
        own = _distance(x[rows], tree.points[node]).argmin(axis=1)
        for j, child in enumerate(tree.children[node]):
            mine = rows[own == j]
            if child < 0:
                leaf[mine] = -1 - child
            elif len(mine):
                todo.append((child, mine))
    return leaf


def measure(tree: Tree, x: np.ndarray, leaf: np.ndarray, ranges: dict) -> None:
    """Widen ``ranges[node]``, a pair of arrays (split point, child), by the distances of rows from the split points above."""
    x = _lift(x, tree.most)
    for one in np.unique(leaf):
        rows = x[leaf == one]
        for node, child in tree.paths[one]:
            d = _distance(rows, tree.points[node])
            n = len(tree.points[node])
            low, high = ranges.setdefault(node, (np.full((n, n), np.inf), np.full((n, n), -np.inf)))
            low[:, child] = np.minimum(low[:, child], d.min(axis=0))
            high[:, child] = np.maximum(high[:, child], d.max(axis=0))


def visit(tree: Tree, q: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, leaf) pairs that may hold a row with a score of ``low`` to ``high`` (infinite: open)."""
    if not tree.points:
        return np.arange(len(q)), np.zeros(len(q), np.int64)
    squares = (q * q).sum(axis=1) + tree.most
    with np.errstate(invalid="ignore"):
        inner = np.sqrt(np.maximum(squares - 2 * high, 0)) - tree.slack
        outer = np.sqrt(np.maximum(squares - 2 * low, 0)) + tree.slack
    q = _flat(q)
    todo, found = [(0, np.arange(len(q)))], []
    while todo:
        node, rows = todo.pop()
        d = _distance(q[rows], tree.points[node])
        least = np.maximum(d - outer[rows, None], inner[rows, None] - d) - tree.slack
        most = d + outer[rows, None] + tree.slack
        # a subtree stays if from every split point its range meets what the annulus allows
        stays = ((tree.high[node][None] >= least[:, :, None]) & (tree.low[node][None] <= most[:, :, None])).all(axis=1)
        for j, child in enumerate(tree.children[node]):
            mine = rows[stays[:, j]]
            if child < 0:
                found.append((mine, np.full(len(mine), -1 - child)))
            elif len(mine):
                todo.append((child, mine))
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _runs(*keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of equal neighbouring keys."""
    if len(keys[0]):
        new = np.any([k[1:] != k[:-1] for k in keys], axis=0)
        edges = np.r_[0, np.flatnonzero(new) + 1, len(keys[0])]
        yield from zip(edges, edges[1:])


def _rows(column: pa.ListArray) -> np.ndarray:
    """Vectors of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _by_size(column: pa.ListArray) -> Iterator[tuple[int, np.ndarray]]:
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    for n in np.unique(size):
        yield int(n), np.flatnonzero(size == n)


def _finite(vec: Column) -> Column:
    return F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def integer_rows(df: DataFrame, scale: int, key: str, vec: str, label: str) -> DataFrame:
    """Distinct usable rows ``(id, label, size, vec)`` with components ``floor(scale * x)`` as doubles."""
    picked = df.select(
        F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vec).cast("array<double>").alias("vec")
    )
    picked = picked.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & _finite(F.col("vec")))
    picked = picked.withColumn("vec", F.transform("vec", lambda x: F.floor(x * scale).cast("double")))
    return picked.where(_square(F.col("vec")) < EXACT).select("id", "label", F.size("vec").alias("size"), "vec").distinct()


def _square(vec: Column) -> Column:
    return F.aggregate(vec, F.lit(0.0), lambda total, x: total + x * x)


def _fit(classes: DataFrame) -> dict[int, Tree]:
    """A tree for each length of vector in the sample; other lengths have one leaf."""
    facts = classes.groupBy("size").agg(F.count("*").alias("n"), F.max(_square(F.col("vec"))).alias("most"))
    sample = classes.select("size", "vec").distinct().orderBy(F.xxhash64("vec")).limit(SAMPLE)
    drawn: dict[int, list] = {}
    for r in sample.collect():
        drawn.setdefault(r["size"], []).append(r["vec"])
    sizes = classes.sparkSession.createDataFrame([(n,) for n in drawn], "size int")
    trees = {}
    for r in facts.join(F.broadcast(sizes), "size").collect():
        x = np.array(drawn[r["size"]], dtype=float).reshape(len(drawn[r["size"]]), r["size"])
        trees[r["size"]] = grow(x, max(8, len(x) * LEAF_ROWS // r["n"]), r["most"])
    return trees


def _routed(rows: DataFrame, trees) -> DataFrame:
    """``rows`` (their last column ``vec``) with the leaf of their vector."""
    kept = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            leaf, vec = np.zeros(len(part), np.int64), part.column(len(kept) - 1)
            for n, at in _by_size(vec):
                if n in trees.value:
                    leaf[at] = route(trees.value[n], _rows(vec.take(pa.array(at))))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(leaf)], [*kept, "leaf"])

    return rows.mapInArrow(run, rows.withColumn("leaf", F.lit(0).cast("long")).schema)


def _ranges(routed: DataFrame, trees) -> list:
    """Distances from split points to sibling subtrees over all rows; as many rows as the trees have such pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, dict] = {}
        for part in batches:
            leaf, vec = part.column(1).to_numpy(), part.column(0)
            for n, at in _by_size(vec):
                if n in trees.value and trees.value[n].points:
                    measure(trees.value[n], _rows(vec.take(pa.array(at))), leaf[at], found.setdefault(n, {}))
        for n, nodes in found.items():
            for node, (low, high) in nodes.items():
                i, j = np.nonzero(low <= high)
                columns = [np.full(len(i), n), np.full(len(i), node), i, j, low[i, j], high[i, j]]
                names = ["size", "node", "i", "j", "low", "high"]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    kind = "size long, node long, i long, j long, low double, high double"
    each = routed.select("vec", "leaf").mapInArrow(run, kind)
    return each.groupBy("size", "node", "i", "j").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()


def _indexed(classes: DataFrame):
    """(cells, trees): the rows with leaf and cut, and the broadcast trees with their ranges."""
    context = classes.sparkSession.sparkContext
    fitted = _fit(classes)
    routed = materialise(_routed(classes, context.broadcast(fitted)), "routed")
    for tree in fitted.values():
        tree.low = [np.full((len(p), len(p)), np.inf) for p in tree.points]
        tree.high = [np.full((len(p), len(p)), -np.inf) for p in tree.points]
    for r in _ranges(routed, context.broadcast(fitted)):
        fitted[r.size].low[r.node][r.i, r.j] = r.low
        fitted[r.size].high[r.node][r.i, r.j] = r.high
    each = F.greatest(F.lit(1), F.floor(F.lit(CELL_VALUES) / F.greatest(F.lit(1), "size")))
    cuts = routed.groupBy("size", "leaf").agg(F.count("*").alias("n")).select("size", "leaf", F.ceil(F.col("n") / each).cast("int").alias("cuts"))
    return routed, materialise(cuts, "cuts"), context.broadcast(fitted)


def _visits(queries: DataFrame, trees, home: bool) -> DataFrame:
    """A row for each leaf that a query must see: its own one, or all others that its window does not eliminate."""
    names = ["query", "own", "label", "low", "high", "size", "home", "vec"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            own = part.column(6).to_numpy()
            if home:
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own)], [*names, "leaf"])
                continue
            low, high = (part.column(i).to_numpy(zero_copy_only=False) for i in (3, 4))
            for n, at in _by_size(part.column(7)):
                if n not in trees.value:
                    continue
                q = _rows(part.column(7).take(pa.array(at)))
                who, leaf = visit(trees.value[n], q, low[at], high[at])
                who, leaf = who[leaf != own[at[who]]], leaf[leaf != own[at[who]]]
                for a in range(0, len(who), 4096):
                    picked = part.take(pa.array(at[who[a : a + 4096]]))
                    yield pa.RecordBatch.from_arrays([*picked.columns, pa.array(leaf[a : a + 4096])], [*names, "leaf"])

    picked = queries.select(*names)
    return picked.mapInArrow(run, picked.withColumn("leaf", F.lit(0).cast("long")).schema)


def _best(q, own, label, low, high, c, c_label, c_ids, same: bool, k: int) -> tuple:
    """The first k rows of each query among the classes of a cell: (query position, id, score)."""
    score = q @ c.T
    score[(label[:, None] == c_label) != same] = -np.inf
    score[(score < low[:, None]) | (score > high[:, None])] = -np.inf
    n = min(k + 1, score.shape[1])  # one class may hold nothing but the query itself
    edge = -np.partition(-score, n - 1, axis=1)[:, n - 1]
    who, which = np.nonzero((score >= edge[:, None]) & (score > -np.inf))
    counts = np.diff(c_ids[0])[which]
    rows = np.repeat(np.arange(len(who)), counts)
    ids = c_ids[1][c_ids[0][which[rows]] + np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)]
    who, found = who[rows], score[who[rows], which[rows]]
    if same:
        others = ids != own[who]
        who, ids, found = who[others], ids[others], found[others]
    order = np.lexsort((ids, -found, who))
    who, ids, found = who[order], ids[order], found[order]
    first = np.arange(len(who)) - np.searchsorted(who, who) < k
    return who[first], ids[first], found[first]


def _meet(same: bool, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by cell and kind: the classes of a cell first, then its queries, some at a time."""
        cell, held, solid = None, [], None
        for part in batches:
            size, leaf, cut, kind = (part.column(i).to_numpy() for i in range(4))
            for a, b in _runs(size, leaf, cut, kind):
                here, piece = (size[a], leaf[a], cut[a]), part.slice(a, b - a)
                if kind[a] == 0:
                    held = [*held, piece] if cell == here else [piece]
                    cell, solid = here, None
                elif cell == here:
                    if solid is None:
                        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                        ids = whole.column(8)
                        solid = (
                            _rows(whole.column(9)), whole.column(5).to_numpy(),
                            (np.r_[0, np.cumsum(ids.value_lengths().to_numpy())], ids.flatten().to_numpy()),
                        )
                    for at in range(0, b - a, _QUERIES):
                        some = piece.slice(at, _QUERIES)
                        q, own, label, low, high = (some.column(i).to_numpy(zero_copy_only=False) for i in (4, 10, 5, 6, 7))
                        who, ids, score = _best(_rows(some.column(9)), own, label, low, high, *solid, same, k)
                        columns = [pa.array(q[who]), pa.array(ids), pa.array(score.astype(np.int64))]
                        yield pa.RecordBatch.from_arrays(columns, ["query", "id", "score"])

    return run


def _search(queries: DataFrame, routed: DataFrame, cuts: DataFrame, trees, home: bool, same: bool, k: int) -> DataFrame:
    """``(query, id, score)``: the first ``k`` rows of each query in the leaves it visits."""
    n = F.coalesce("cuts", F.lit(1))
    stored = routed.join(cuts, ["size", "leaf"], "left").select(
        "size", "leaf", F.pmod(F.xxhash64("label", "vec"), n).cast("int").alias("cut"), F.lit(0).alias("kind"),
        F.lit(0).cast("long").alias("query"), "label", F.lit(0.0).alias("low"), F.lit(0.0).alias("high"), "ids", "vec",
        F.lit(0).cast("long").alias("own"),
    )
    asked = _visits(queries, trees, home).join(cuts, ["size", "leaf"], "left").select(
        "size", "leaf", F.explode(F.sequence(F.lit(0), n - 1)).alias("cut"), F.lit(1).alias("kind"), "query", "label",
        "low", "high", F.array().cast("array<long>").alias("ids"), "vec", "own",
    )
    cells = stored.unionAll(asked).repartition(width(queries.sparkSession), "size", "leaf", "cut")
    found = cells.sortWithinPartitions("size", "leaf", "cut", "kind").mapInArrow(_meet(same, k), _FOUND)
    return materialise(_first(found, k), "found")


def _first(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return found.withColumn("place", place).where(F.col("place") <= k).drop("place")


def _first_in_window(queries: DataFrame, routed: DataFrame, cuts: DataFrame, trees, same: bool, k: int) -> DataFrame:
    """The leaf a query lies in comes first; what it gives narrows the window of the other leaves."""
    near = _search(queries, routed, cuts, trees, True, same, k)
    full = near.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("worst")).where(F.col("n") == k)
    narrowed = queries.join(full, "query", "left").withColumn(
        "low", F.greatest("low", F.coalesce(F.col("worst").cast("double"), F.lit(float("-inf"))))
    )
    far = _search(narrowed, routed, cuts, trees, False, same, k)
    return materialise(_first(near.unionAll(far), k), "first")


def mine(
    anchors: DataFrame, base: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256,
    key: str = "vec_id", vec: str = "embedding", label: str = "label",
) -> DataFrame:
    """``(anchor, positive, rank, negative, positive_score, negative_score)`` of the rows of ``base`` for each anchor.

    Components become ``floor(scale * x)``, scores are integer inner products, higher ones first, ties by smaller key. The
    positives of an anchor are its first ``positives`` rows with its label and another key; the negatives of a positive are
    the first ``negatives`` rows of another label with a score of ``low`` to ``high`` per cent of the positive's.

    Rows with a null key, label or vector or a component that is null or not finite take no part, nor do rows whose squared
    integer length reaches 2^53 (components about 370,000), as their scores would not be exact. Rows are compared with rows
    of the same length only; zero and empty vectors take part with scores of 0. Repeated rows count once; a key with
    several labels or vectors stands for several rows, and as an anchor for several anchors. Equal vectors of one label are
    one class that stands for its smallest keys, as many as a result can show of it, so copies do not meet. Empty tables
    give no rows; other columns are ignored.
    """
    rows = integer_rows(base, scale, key, vec, label)
    most = max(positives + 1, negatives)
    place = F.row_number().over(Window.partitionBy("label", "size", "vec").orderBy("id"))
    classes = rows.withColumn("place", place).where(F.col("place") <= most).groupBy("label", "size", "vec")
    classes = classes.agg(F.sort_array(F.collect_list("id")).alias("ids")).select("label", "size", "ids", "vec")
    routed, cuts, trees = _indexed(materialise(classes, "classes"))

    asked = _routed(integer_rows(anchors, scale, key, vec, label).select("id", "label", "size", "vec"), trees)
    asked = asked.select(
        F.monotonically_increasing_id().alias("query"), F.col("id").alias("own"), "label", F.lit(float("-inf")).alias("low"),
        F.lit(float("inf")).alias("high"), "size", F.col("leaf").alias("home"), "vec",
    )
    asked = materialise(asked, "asked")
    liked = _first_in_window(asked, routed, cuts, trees, True, positives)
    liked = liked.where("score >= 0").select("query", F.col("id").alias("positive"), F.col("score").alias("positive_score"))

    windows = liked.select("query", "positive_score").distinct().join(asked.drop("low", "high"), "query").select(
        F.monotonically_increasing_id().alias("query"), F.col("query").alias("anchor_query"), "own", "label",
        F.expr(f"({low} * positive_score + 99) div 100").cast("double").alias("low"),
        F.expr(f"({high} * positive_score) div 100").cast("double").alias("high"), "size", "home", "vec", "positive_score",
    )
    windows = materialise(windows, "windows")
    hard = _first_in_window(windows, routed, cuts, trees, False, negatives)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    ranked = hard.withColumn("rank", rank).join(windows.select("query", "anchor_query", "own", "positive_score"), "query")
    ranked = ranked.select(F.col("anchor_query").alias("query"), "own", "positive_score", "rank", "id", "score")
    return liked.join(ranked, ["query", "positive_score"]).select(
        F.col("own").alias("anchor"), "positive", "rank", F.col("id").alias("negative"), "positive_score",
        F.col("score").alias("negative_score"),
    )
