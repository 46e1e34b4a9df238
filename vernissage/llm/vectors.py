"""Near duplicates among vectors by an inverted multi-index."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vernissage.llm.graph import components
from vernissage.llm.linking import Joined
from vernissage.session import land

LIKENESS = 0.9


@dataclass(frozen=True)
class Settings:
    """`fit_rows` bounds the sample the codebooks are fitted on; all rows are indexed and searched.

    How many cells are visited is set by samples of `probe_rows` rows: partners planted at the least
    likeness, and links found by brute force, in up to `probe_blocks` samples until `linked_probes`
    rows with links are seen.

    A codebook has about sqrt(rows / per_cell) entries, `most_codes` at most. Cells and queries of a
    cell are cut into tiles of `tile` rows.
    """

    likeness: float = LIKENESS
    recall: float = 0.99
    fit_rows: int = 20_000
    probe_rows: int = 1024
    probe_blocks: int = 8
    linked_probes: int = 64
    per_cell: int = 64
    most_codes: int = 1024
    least_visits: int = 8
    tile: int = 4096
    rounds: int = 12
    seed: int = 9


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """(n, width) doubles of a list column whose lists all have that length."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks)
    return array.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(array), width)


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by the largest part first, so squares neither overflow nor vanish."""
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True) if len(rows) else rows
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True) if len(rows) else scaled


def fit_codebook(rows: np.ndarray, k: int, settings: Settings) -> np.ndarray:
    """Lloyd's algorithm; an entry that loses all its rows moves to a random one."""
    random = np.random.default_rng(settings.seed)
    codes = rows[random.choice(len(rows), k, replace=False)]
    for _ in range(settings.rounds):
        own = square_distances(rows, codes).argmin(1)
        sums = np.zeros_like(codes)
        np.add.at(sums, own, rows)
        counts = np.bincount(own, minlength=k)
        codes = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], rows[random.integers(0, len(rows), k)])
    return codes


def square_distances(rows: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return (rows * rows).sum(1)[:, None] + (codes * codes).sum(1) - 2 * rows @ codes.T


@dataclass
class Grid:
    """Codebooks of the two halves; cell (i, j) is number i * len(second) + j."""

    first: np.ndarray
    second: np.ndarray

    def distances(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.first.shape[1]
        return square_distances(units[:, :half], self.first), square_distances(units[:, half:], self.second)

    def own_cells(self, units: np.ndarray) -> np.ndarray:
        a, b = self.distances(units)
        return a.argmin(1) * len(self.second) + b.argmin(1)

    def visits(self, units: np.ndarray, n: int) -> np.ndarray:
        """Numbers of the n nearest cells of each row, nearest first.

        In the multi-sequence order the cell of the a-th nearest first code and
        b-th nearest second code has (a + 1)(b + 1) - 1 cells no farther, so the
        n nearest are among those with (a + 1)(b + 1) <= n.
        """
        a, b = self.distances(units)
        order_a, order_b = np.argsort(a, axis=1, kind="stable")[:, :n], np.argsort(b, axis=1, kind="stable")[:, :n]
        pairs = [(x, y) for x in range(order_a.shape[1]) for y in range(min(order_b.shape[1], n // (x + 1)))]
        x, y = np.array(pairs).T
        near_a, near_b = np.take_along_axis(a, order_a, 1), np.take_along_axis(b, order_b, 1)
        total = near_a[:, x] + near_b[:, y]
        best = np.argsort(total, axis=1, kind="stable")[:, :n]
        return order_a[np.arange(len(a))[:, None], x[best]] * len(self.second) + order_b[np.arange(len(a))[:, None], y[best]]

    def ranks(self, unit_row: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """How many cells are nearer to one row than each of the given cells."""
        a, b = (d[0] for d in self.distances(unit_row[None]))
        values = a[cells // len(b)] + b[cells % len(b)]
        return np.searchsorted(np.sort(b), values[:, None] - a[None]).sum(1)


def fit_grid(groups: DataFrame, width: int, count: int, settings: Settings) -> Grid:
    k = max(1, min(settings.most_codes, round((count / settings.per_cell) ** 0.5)))
    sample = groups.orderBy(F.xxhash64("rep"), "rep").limit(settings.fit_rows).select("v").collect()
    units = unit(np.array([r["v"] for r in sample], dtype=np.float64).reshape(len(sample), width))
    k, half = min(k, len(units)), (width + 1) // 2
    return Grid(fit_codebook(units[:, :half], k, settings), fit_codebook(units[:, half:], k, settings))


def planted_partners(units: np.ndarray, likeness: float, seed: int) -> np.ndarray:
    """For each unit row another at exactly this cosine, in a random direction."""
    away = np.random.default_rng(seed).normal(size=units.shape)
    away -= (away * units).sum(1, keepdims=True) * units
    return likeness * units + (1 - likeness**2) ** 0.5 * away / np.linalg.norm(away, axis=1, keepdims=True)


def quantile_rank(rank: np.ndarray, weight: np.ndarray, share: float) -> int:
    """The number of cells within which this share of the weight lies."""
    order = np.argsort(rank, kind="stable")
    reached = np.cumsum(weight[order]) / weight.sum()
    return int(rank[order][min(np.searchsorted(reached, share - 1e-12), len(rank) - 1)]) + 1


def visits_for_recall(groups: DataFrame, grid: Grid, width: int, settings: Settings) -> int:
    """Cells to visit so that the share of found links reaches the target.

    A partner at the least likeness is planted for each probe row, so the number
    does not depend on how many links the table has. Probe rows also meet all
    rows, block by block until enough of them have links; the share of all
    their links and the mean share per probe row must reach the target too. What
    comes back is one number per probe row and rank.
    """
    some = groups.orderBy(F.xxhash64("rep", F.lit(1)), "rep").limit(settings.probe_rows * settings.probe_blocks)
    some = some.select("rep", "v").collect()
    sampled = unit(np.array([r["v"] for r in some], dtype=np.float64).reshape(len(some), width))
    sampled_reps = np.array([r["rep"] for r in some])

    def links(probes: np.ndarray, reps: np.ndarray) -> list:
        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                units = unit(matrix(batch.column(1), width))
                if not len(units):
                    continue
                cells, own = grid.own_cells(units), np.asarray(batch.column(0))
                near = (probes @ units.T >= settings.likeness) & (reps[:, None] != own)
                out: list[tuple[int, int, int]] = []
                for q in np.flatnonzero(near.any(1)).tolist():
                    ranks, counts = np.unique(grid.ranks(probes[q], cells[near[q]]), return_counts=True)
                    out.extend(zip([q] * len(ranks), ranks.tolist(), counts.tolist(), strict=True))
                columns = list(zip(*out, strict=True)) or [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["q", "rank", "n"])

        found = groups.select("rep", "v").mapInArrow(measure, "q bigint, rank bigint, n bigint")
        return found.groupBy("q", "rank").agg(F.sum("n").alias("n")).collect()

    cells = len(grid.first) * len(grid.second)
    enough = [min(settings.least_visits, cells)]
    if width > 1:
        first = sampled[: settings.probe_rows]
        own = grid.own_cells(planted_partners(first, settings.likeness, settings.seed))
        planted = np.array([grid.ranks(u, own[i : i + 1])[0] for i, u in enumerate(first)])
        enough.append(quantile_rank(planted, np.ones(len(planted)), settings.recall))
    found: list[tuple[int, int, int]] = []
    for at in range(0, len(sampled), settings.probe_rows):
        block = slice(at, at + settings.probe_rows)
        found += [(at + r["q"], r["rank"], r["n"]) for r in links(sampled[block], sampled_reps[block])]
        if len({q for q, _, _ in found}) >= settings.linked_probes:
            break
    if found:
        q, rank, n = np.array(found).T
        enough.append(quantile_rank(rank, n, settings.recall))
        enough.append(quantile_rank(rank, n / np.bincount(q, n)[q], settings.recall))
    return min(cells, max(enough))


def _place(grid: Grid, width: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 2048):
                part = batch.slice(at, 2048)
                visits = grid.visits(unit(matrix(part.column(1), width)), n)
                own = grid.own_cells(unit(matrix(part.column(1), width)))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(own, pa.int64()), pa.array(list(visits), pa.list_(pa.int64()))],
                    names=["rep", "v", "m", "cell", "visits"],
                )

    return run


def _verify(width: int, settings: Settings):
    """Links between the indexed rows and the visiting rows of one tile.

    A visiting row is credited with every link it finds. The indexed row of the
    link is credited here only if it does not visit the other's cell, because
    there it is credited as the visitor. So each side counts each link once.
    """

    def run(indexed: pa.Table, visiting: pa.Table) -> pa.Table:
        none = np.zeros(0, dtype=np.int64)
        a, b, n = [none], [none], [none]
        if len(indexed) and len(visiting):
            x, q = unit(matrix(indexed.column("v"), width)), unit(matrix(visiting.column("_v"), width))
            x_rep, x_m = indexed.column("rep").to_numpy(), indexed.column("m").to_numpy()
            q_rep, q_m = visiting.column("_rep").to_numpy(), visiting.column("_m").to_numpy()
            visits = np.array(indexed.column("visits").to_pylist()).reshape(len(x), -1)
            cells, place = np.unique(visiting.column("_cell").to_numpy(), return_inverse=True)
            silent = np.array([~(visits == c).any(1) for c in cells]).reshape(len(cells), len(x))
            members, ends = np.unique(np.concatenate([x_rep, q_rep]), return_inverse=True)
            joined = Joined(len(members))
            x_credit = np.zeros(len(x), dtype=np.int64)
            for at in range(0, len(q), 1024):
                own = slice(at, at + 1024)
                near = (q[own] @ x.T >= settings.likeness) & (q_rep[own, None] != x_rep)
                found_q, found_x = np.nonzero(near)
                if not len(found_q):
                    continue
                credit = near @ x_m
                got = np.flatnonzero(credit)
                a.append(q_rep[own][got])
                n.append(credit[got])
                b.append(np.full(len(got), -1))
                x_credit += (near & silent[place[own]]).T @ q_m[own]
                i, j = joined.link(ends[len(x) + at + found_q], ends[found_x])
                a.append(members[i])
                b.append(members[j])
                n.append(np.zeros(len(i), dtype=np.int64))
            got = np.flatnonzero(x_credit)
            a.append(x_rep[got])
            n.append(x_credit[got])
            b.append(np.full(len(got), -1))
        return pa.table({"a": np.concatenate(a).astype(np.int64), "b": np.concatenate(b).astype(np.int64), "n": np.concatenate(n).astype(np.int64)})

    return run


def search(groups: DataFrame, width: int, settings: Settings = Settings()) -> DataFrame:
    """(a, b, n) for distinct vectors (rep, v, m): credits with b = -1, and links that join what is linked.

    A vector is indexed in its own cell and visits the nearest cells. Cells or
    visitor lists above the tile size are cut by hash, every tile of one side
    meets every tile of the other, so no task holds a hot cell.
    """
    count = groups.count()
    if count == 0:
        return groups.select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.col("m").alias("n"))
    grid = fit_grid(groups, width, count, settings)
    n = visits_for_recall(groups, grid, width, settings)
    parts = groups.schema["v"].dataType.simpleString()
    placed = f"rep bigint, v {parts}, m bigint, cell bigint, visits array<bigint>"
    placed = land(groups.select("rep", "v", "m").mapInArrow(_place(grid, width, n), placed), "vectors-placed")
    visiting = placed.select(*[F.col(c).alias(f"_{c}") for c in ("rep", "v", "m", "cell")], F.explode("visits").alias("at"))
    tiles = lambda rows, name: F.ceil(F.col(rows) / settings.tile).cast("int").alias(name)
    indexed_n = placed.groupBy(F.col("cell").alias("at")).agg(F.count(F.lit(1)).alias("_x"))
    visiting_n = placed.select(F.explode("visits").alias("at")).groupBy("at").agg(F.count(F.lit(1)).alias("_q"))
    sizes = land(indexed_n.join(visiting_n, "at").select("at", tiles("_x", "xs"), tiles("_q", "qs")), "vectors-cells")
    cut = lambda rep, by: F.pmod(F.xxhash64(rep), F.col(by)).cast("int")
    every = lambda by: F.explode(F.sequence(F.lit(0), F.col(by) - 1))
    left = placed.withColumn("at", F.col("cell")).join(sizes, "at").withColumn("x", cut("rep", "xs")).withColumn("q", every("qs"))
    right = visiting.join(sizes, "at").withColumn("q", cut("_rep", "qs")).withColumn("x", every("xs"))
    return (
        left.select("at", "x", "q", "rep", "v", "m", "visits").groupBy("at", "x", "q")
        .cogroup(right.select("at", "x", "q", "_rep", "_v", "_m", "_cell").groupBy("at", "x", "q"))
        .applyInArrow(_verify(width, settings), "a bigint, b bigint, n bigint")
    )


def near_duplicate_vectors(table: DataFrame, key: str = "vec_id", vector: str = "embedding", settings: Settings = Settings()) -> DataFrame:
    """(key, n_links, component_id, kept) for every row of `table`.

    Vectors are linked at a cosine of at least `likeness`, computed in double
    precision; candidates come from the index, so a link below that is never
    made and the share of links found is set by `recall`. Equal vectors are
    searched once and count as often as they occur.

    Vectors that are null, zero, or hold nulls or non-finite parts link with
    nothing; vectors of different lengths do not link with each other, and each
    length is searched as a table of its own, one after another. Floats stay
    floats, other numbers are taken as doubles. Component ids are the smallest
    key in the component (null where all are null), and a row is kept when its
    key is that id. Repeated rows are vectors of their own. An empty table gives
    no rows; other columns are ignored.
    """
    parts = "array<float>" if table.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    rows = land(table.select(F.col(key).alias("key"), F.col(vector).cast(parts).alias("v"), F.monotonically_increasing_id().alias("row")), "vectors-rows")
    finite = "v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < float('inf')) and exists(v, x -> x <> 0)"
    usable = rows.filter(finite)
    groups = land(usable.groupBy("v").agg(F.min("row").alias("rep"), F.count(F.lit(1)).alias("m")), "vectors-distinct")
    widths = sorted(r["w"] for r in groups.select(F.size("v").alias("w")).distinct().collect()) or [1]
    found = None
    for width in widths:
        links = search(groups.filter(F.size("v") == width), width, settings)
        found = links if found is None else found.unionByName(links)
    found = land(found, "vectors-links")
    credits = found.filter("b = -1").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("_others"))
    linked = components(found.filter("b <> -1"))
    of_rep = groups.join(credits, "rep", "left").join(linked.withColumnRenamed("node", "rep"), "rep", "left").select(
        "rep", "v", (F.coalesce("_others", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component")
    )
    named = rows.select("row", "key", F.when(F.expr(finite), F.col("v")).alias("v")).join(of_rep, "v", "left")
    named = land(named.select("row", "key", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "row").alias("component")), "vectors-named")
    firsts = named.groupBy("component").agg(F.min("key").alias("component_id"))
    return named.join(firsts, "component").select(
        F.col("key").alias(key), "n_links", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept")
    )
