"""Neighbourhood maps: a nearest-neighbour graph by joins, and the leading eigenvectors of its normalised adjacency.

All matrices are tables. The driver sees sums over columns (a few hundred numbers a pass), never rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cliptide.operators.exact import bucketed_rank, settled

#: Rows compared with one another in a task when the graph begins.
BLOCK = 256
#: Cells of a projection's range and hash parts of a cell: what the order of a pass is bucketed by.
CELLS, PARTS = 4096, 16
#: A matrix of so few entries (17 bytes each) is broadcast; a larger one meets the vectors by shuffle.
SMALL_EDGES = 200_000


def _nearest(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, other row, squared distance) of every row's ``k`` nearest others; ties to the rows that follow it, in a
    circle, so that equal rows do not all point to the same few."""
    take = min(k, len(x) - 1)
    rows, others, far = [], [], []
    for i in range(len(x) if take > 0 else 0):
        d = ((x - x[i]) ** 2).sum(axis=1)
        kept = d.copy()
        kept[i] = np.inf
        order = np.lexsort(((np.arange(len(x)) - i) % len(x), kept))[:take]
        rows.append(np.full(take, i))
        others.append(order)
        far.append(d[order])
    if not rows:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return np.concatenate(rows), np.concatenate(others), np.concatenate(far)


def _closest(edges: DataFrame, k: int, by: str = "src") -> DataFrame:
    """The ``k`` shortest edges per ``by``, ties by a hash of both ends: copies spread their edges, none becomes the
    hub of all. Spark limits each group before it shuffles, so that a node that many others point to does not
    bring all of them into one task."""
    order = Window.partitionBy(by).orderBy("d2", F.xxhash64("src", "dst"), "src", "dst")
    return edges.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k).drop("_n")


def _projected(rows: DataFrame, width: int, passes: int, seed: int) -> DataFrame:
    """``rows`` with ``_cells``: per pass, the cell of the row's projection on a random direction."""
    matrix = np.random.default_rng(seed).normal(0.0, 1.0, (width, passes))

    @F.pandas_udf("array<double>")
    def mapped(batch: pd.Series) -> pd.Series:
        return pd.Series([], dtype=object) if batch.empty else pd.Series(list(np.stack(batch) @ matrix))

    placed = rows.withColumn("_p", mapped("v"))
    ends = placed.agg(*[f(F.get("_p", F.lit(i))).alias(f"{f.__name__}{i}") for i in range(passes) for f in (F.min, F.max)]).first()
    cells = []
    for i in range(passes):
        low, span = ends[f"min{i}"], ends[f"max{i}"] - ends[f"min{i}"]
        share = (F.get("_p", F.lit(i)) - low) / span if span > 0 else F.lit(0.0)
        cells.append(F.least(F.floor(share * CELLS), F.lit(CELLS - 1)).cast("long"))
    return placed.withColumn("_cells", F.array(*cells)).drop("_p")


def _first_edges(rows: DataFrame, width: int, k: int, passes: int, seed: int) -> DataFrame:
    """Nearest neighbours within blocks of rows that lie side by side on a random direction, for every pass."""
    kind = rows.schema["id"].dataType
    schema = T.StructType([T.StructField("src", kind), T.StructField("dst", kind), T.StructField("d2", T.DoubleType())])

    def compare(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("id")
        ids = block["id"].to_numpy()
        a, b, d = _nearest(np.stack(block["v"]).astype(np.float64), k)
        return pd.DataFrame({"src": ids[a], "dst": ids[b], "d2": d})

    placed = _projected(rows, width, passes, seed)
    part = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(PARTS))
    edges = None
    for i in range(passes):
        # Equal vectors share a cell; the hash parts of a cell bound what one task has to order.
        ranked = bucketed_rank(placed.select("id", "v", F.get("_cells", F.lit(i)).alias("_cell")), [], F.col("_cell") * PARTS + part, ["id"], "_rank")
        blocks = ranked.select("id", "v", F.floor((F.col("_rank") - 1) / BLOCK).alias("_block"))
        found = blocks.groupBy("_block").applyInPandas(compare, schema)
        edges = found if edges is None else edges.unionByName(found)
    return edges


def _neighbourhoods(graph: DataFrame, k: int) -> DataFrame:
    """(at, ids): every node's ``k`` nearest and the ``k`` nearest that point to it, sorted."""
    ahead = graph.select(F.col("src").alias("at"), F.col("dst").alias("id"))
    back = _closest(graph, k, "dst").select(F.col("dst").alias("at"), F.col("src").alias("id"))
    return settled(ahead.unionByName(back).groupBy("at").agg(F.sort_array(F.collect_set("id")).alias("ids")), "map_around")


def _reach(graph: DataFrame, k: int) -> DataFrame:
    """(id, far): the longest edge of every node that has ``k`` of them; a longer one cannot replace any."""
    return graph.groupBy(F.col("src").alias("id")).agg(F.when(F.count(F.lit(1)) >= k, F.max("d2")).alias("far"))


def _met(around: DataFrame, before: DataFrame | None, rows: DataFrame, far: DataFrame, k: int) -> DataFrame:
    """Edges between nodes that share a neighbour: the members of every neighbourhood are compared with one another. A
    neighbourhood brings 2k vectors. One with the same members as in the round ``before`` brings none: its edges
    were candidates then, and a node's ``k`` best only get better. Edges longer than ``far`` stay behind, too."""
    if before is not None:
        around = around.join(before, ["at", "ids"], "left_anti")
    members = around.select("at", F.explode("ids").alias("id")).join(rows.join(far, "id", "left"), "id")
    around = members.groupBy("at").agg(F.sort_array(F.collect_list(F.struct("id", "v", F.coalesce("far", F.lit(float("inf"))).alias("far")))).alias("m"))
    kind = rows.schema["id"].dataType
    schema = T.StructType([T.StructField("src", kind), T.StructField("dst", kind), T.StructField("d2", T.DoubleType())])

    def compare(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ids, vectors, limit = batch.column(0), batch.column(1), batch.column(2).flatten().to_numpy()
            ends = ids.offsets.to_numpy()
            flat = vectors.values.flatten().to_numpy(zero_copy_only=False)
            flat = flat.reshape(len(vectors.values), -1).astype(np.float64)
            a, b, d = [], [], []
            for low, high in zip(ends[:-1], ends[1:]):
                i, j, d2 = _nearest(flat[low:high], k)
                short = d2 <= limit[i + low]
                a.append(i[short] + low)
                b.append(j[short] + low)
                d.append(d2[short])
            if a:
                take = lambda at: ids.values.take(pa.array(np.concatenate(at)))
                yield pa.RecordBatch.from_arrays([take(a), take(b), pa.array(np.concatenate(d), pa.float64())], ["src", "dst", "d2"])

    return around.select(F.col("m.id").alias("ids"), F.col("m.v").alias("vectors"), F.col("m.far").alias("limits")).mapInArrow(compare, schema)


def neighbour_graph(df: DataFrame, key: str, values: str, k: int = 10, passes: int = 3, rounds: int = 6, seed: int = 42) -> DataFrame:
    """(src, dst, d2): about the ``k`` nearest other rows of every row by Euclidean distance, found by descent: the
    neighbours of neighbours are compared until no edge gets shorter, or for ``rounds`` rounds.

    Approximate beyond ``BLOCK`` rows. ``key`` identifies a row. Rows without a key, with a null or empty vector or
    one that holds null or non-finite values take no part; all others must be of one length. Equal vectors are
    neighbours at distance 0; of equally near rows a hash of both keys decides. Fewer than two rows give no edge.
    """
    # Floats stay floats until they are compared: most of what a round shuffles are vectors.
    v = F.col(values) if df.select(values).dtypes[0][1] == "array<float>" else F.col(values).cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = settled(df.filter(F.col(key).isNotNull() & (F.size(v) > 0) & sound).select(F.col(key).alias("id"), v.alias("v")), "map_rows")
    widths = rows.agg(F.min(F.size("v")), F.max(F.size("v"))).first()
    if widths[0] is None:
        return rows.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("d2"))  # no row
    if widths[0] != widths[1]:
        raise ValueError(f"vectors of {widths[0]} to {widths[1]} values")

    def kept(edges: DataFrame) -> tuple[DataFrame, tuple]:
        once = edges.groupBy("src", "dst").agg(F.min("d2").alias("d2"))
        graph = settled(_closest(once, k), "map_graph")
        return graph, graph.agg(F.count(F.lit(1)), F.sum("d2")).first()

    graph, was = kept(_first_edges(rows, widths[0], k, passes, seed))
    before = None
    for _ in range(rounds):
        turned = graph.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "d2")
        around = _neighbourhoods(graph, k)
        graph, now = kept(graph.unionByName(turned).unionByName(_met(around, before, rows, _reach(graph, k), k)))
        before = around
        if now[0] == was[0] and (now[1] or 0.0) >= (was[1] or 0.0) * (1 - 1e-12):
            break
        was = now
    return graph


def normalised_adjacency(graph: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (src, dst, w) of D^-1/2 · W · D^-1/2, and (id, degree). W is the mean of the graph and its transpose, each
    edge weighing 1, so that one seen from both ends weighs 1 and one from a single end 1/2."""
    ends = graph.select("src", "dst")
    both = ends.unionByName(ends.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    weights = settled(both.groupBy("src", "dst").agg((F.count(F.lit(1)) / 2).alias("w")), "map_weights")
    degrees = settled(weights.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("degree")), "map_degrees")
    at = lambda end: degrees.select(F.col("id").alias(end), F.col("degree").alias(f"_{end}"))
    scaled = weights.join(at("src"), "src").join(at("dst"), "dst")
    return settled(scaled.select("src", "dst", (F.col("w") / F.sqrt(F.col("_src") * F.col("_dst"))).alias("w")), "map_edges"), degrees


def _columns(letter: str, count: int) -> list[str]:
    return [f"{letter}{i}" for i in range(count)]


def _combined(letter: str, weights: np.ndarray, shift: np.ndarray) -> list[Column]:
    """Columns y or z of the product of a row's ``letter`` columns with a small matrix, less ``shift`` times t."""
    product = [" + ".join(f"{letter}{i} * {float(x)!r}D" for i, x in enumerate(column)) for column in weights.T]
    return [F.expr(f"{p} - t * {float(s)!r}D").alias(f"{letter}{j}") for j, (p, s) in enumerate(zip(product, shift))]


def _gram(table: DataFrame, columns: list[str]) -> np.ndarray:
    """Inner products of all columns with one another: a small matrix per task, summed by place."""
    size = len(columns)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size, size))
        for batch in batches:
            x = batch.to_numpy(np.float64)
            total += x.T @ x
        yield pd.DataFrame({"place": np.arange(size * size, dtype="int32"), "part": total.ravel()})

    sums = table.select(*columns).mapInPandas(partial, "place int, part double").groupBy("place").agg(F.sum("part").alias("s")).collect()
    found = np.zeros(size * size)
    for r in sums:
        found[r.place] = r.s
    return found.reshape(size, size)


def _spread(state: DataFrame, edges: DataFrame, sums: dict[str, str]) -> DataFrame:
    """(id, t, sums…): what a node's edges bring from their other ends. A row keeps its own values by an edge to itself
    (``own``, of weight 0), so that the state is read once."""
    met = edges.join(state.withColumnRenamed("id", "src"), "src")
    kept = {"t": "sum(CASE WHEN own THEN t END)", **sums}
    return met.groupBy(F.col("dst").alias("id")).agg(*[F.expr(e).alias(name) for name, e in kept.items()])


def _applied(state: DataFrame, edges: DataFrame, count: int) -> DataFrame:
    """(id, t, y…, z…) with z = S·y."""
    own = {f"y{i}": f"sum(CASE WHEN own THEN y{i} END)" for i in range(count)}
    return _spread(state, edges, {**own, **{f"z{i}": f"sum(w * y{i})" for i in range(count)}})


def _filtered(ritz: DataFrame, edges: DataFrame, count: int, steps: int, least: float) -> DataFrame:
    """Chebyshev polynomial of degree ``steps`` of S on the columns y (z = S·y): small on [-1, ``least``], where the
    unwanted eigenvalues lie, and growing fast above."""
    centre, half = (least - 1) / 2, (least + 1) / 2
    first = [f"(z{i} - {centre!r}D * y{i}) / {half!r}D AS y{i}" for i in range(count)]
    state = ritz.selectExpr("id", "t", *[f"y{i} AS p{i}" for i in range(count)], *first)
    matrix = edges.selectExpr("src", "dst", "own", f"2 * (CASE WHEN own THEN w - {centre!r}D ELSE w END) / {half!r}D AS w")
    sums = {f"y{i}": f"sum(CASE WHEN own THEN w * y{i} - p{i} ELSE w * y{i} END)" for i in range(count)}
    sums |= {f"p{i}": f"sum(CASE WHEN own THEN y{i} END)" for i in range(count)}
    for _ in range(steps - 1):
        state = _spread(state, matrix, sums)
    return state.select("id", "t", *_columns("y", count))


def leading_vectors(
    edges: DataFrame, degrees: DataFrame, count: int, guard: int = 6, steps: int = 8, passes: int = 25, tolerance: float = 1e-6, seed: int = 42
) -> tuple[DataFrame, list[float]]:
    """(id, y0…) and the values: the ``count`` eigenvectors of the normalised adjacency with the largest eigenvalues
    after the constant one, by orthogonal iteration with a polynomial filter and ``guard`` further columns.

    A pass multiplies the columns ``steps`` times by the sparse matrix (joins and sums by node) and turns them by
    the eigenvectors of their small Gram matrices; it ends when every residual is below ``tolerance``, or after
    ``passes``. Each vector's largest entry is positive. Where eigenvalues are equal (several components), any basis
    of their space may come out. With fewer rows than columns the missing ones are left out.
    """
    total, n = degrees.agg(F.sum("degree"), F.count(F.lit(1))).first()
    m = min(count + guard, (n or 0) - 1)
    if m < 1:
        raise ValueError("a map needs at least two rows")
    loops = degrees.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("w"))
    edges = settled(edges.withColumn("own", F.lit(False)).unionByName(loops.withColumn("own", F.lit(True))), "map_matrix")
    if edges.count() <= SMALL_EDGES:
        edges = F.broadcast(edges)
    draw = lambda i: F.xxhash64(F.lit(seed + i), "id") / F.lit(2.0**63)
    state = degrees.select("id", F.sqrt(F.col("degree") / float(total)).alias("t"), *[draw(i).alias(y) for i, y in enumerate(_columns("y", m))])
    for _ in range(passes):
        applied = settled(_applied(state, edges, m), "map_applied")
        inner = _gram(applied, ["t", *_columns("y", m), *_columns("z", m)])
        along = inner[0, 1 : m + 1]  # what lies along the constant vector t comes off: S·t = t
        gram = inner[1 : m + 1, 1 : m + 1] - np.outer(along, along)
        image = inner[1 : m + 1, m + 1 :] - np.outer(along, along)
        image = (image + image.T) / 2
        scale = 1 / np.sqrt(np.maximum(np.diag(gram), 1e-300))  # the filter stretches columns unequally
        size, axes = np.linalg.eigh(gram * np.outer(scale, scale))
        sound = size > 1e-13 * size.max()
        white = (scale[:, None] * axes[:, sound]) / np.sqrt(size[sound])
        value, turn = np.linalg.eigh(white.T @ image @ white)
        value, turn = value[::-1], white @ turn[:, ::-1]
        m = len(value)
        shift = along @ turn
        ritz = settled(applied.select("id", "t", *_combined("y", turn, shift), *_combined("z", turn, shift)), "map_ritz")
        wanted = min(count, m)
        off = ritz.agg(*[F.expr(f"sum(pow(z{j} - y{j} * {float(value[j])!r}D, 2))") for j in range(wanted)]).first()
        if max(off) ** 0.5 < tolerance:
            break
        state = _filtered(ritz, edges, m, steps, float(np.clip(value[-1], -0.9, 0.999)))
    tops = ritz.agg(*[F.max_by(f"y{j}", F.struct(F.round(F.abs(F.col(f"y{j}")), 9), F.col("id"))) for j in range(wanted)]).first()
    signs = [1.0 if top >= 0 else -1.0 for top in tops]
    return ritz.select("id", *[(F.col(f"y{j}") * s).alias(f"y{j}") for j, s in enumerate(signs)]), [float(x) for x in value[:wanted]]


def neighbour_map(df: DataFrame, key: str, values: str, dims: int = 2, k: int = 10, tolerance: float = 1e-4, seed: int = 42, **descent: int) -> DataFrame:
    """(key, axis1…): coordinates in which neighbouring rows lie close together (Laplacian eigenmap).

    The leading eigenvectors of the normalised adjacency of ``neighbour_graph``, without the constant one, divided
    by the root of the degree; ``tolerance`` is the residual they may have. Rows that take no part in the graph are left out.
    """
    edges, degrees = normalised_adjacency(neighbour_graph(df, key, values, k, seed=seed, **descent))
    vectors, found = leading_vectors(edges, degrees, dims, tolerance=tolerance, seed=seed)
    axis = lambda j: (F.col(f"y{j}") / F.sqrt("degree")).alias(f"axis{j + 1}")
    return vectors.join(degrees, "id").select(F.col("id").alias(key), *[axis(j) for j in range(len(found))])
