"""Vector retrieval: norms, centroids, exact cosine neighbours from a kept index of cells, greedy matching and reranking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.functions.work import files_state, materialize, new_path


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column | str) -> Column:
    """v over its norm; null for a zero or non-finite norm."""
    v = F.col(v) if isinstance(v, str) else v
    # the norm goes along in a struct: named inside the inner function it would be computed for every component
    bound = F.array(F.struct(v.alias("v"), norm(v).alias("n")))
    return F.transform(bound, lambda b: F.when((b["n"] > 0) & (b["n"] < float("inf")), F.transform(b["v"], lambda x: x.cast("double") / b["n"])))[0]


def centroids(rows: DataFrame, by: list[str], vector: str = "embedding") -> DataFrame:
    """The mean of each group's unit vectors, scaled to unit length; sums are partial before they move."""
    unit = rows.select(*by, F.posexplode(l2_normalize(vector)).alias("pos", "x"))
    mean = unit.groupBy(*by, "pos").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    g = mean.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("parts"), F.max("n").alias("n"))
    return g.select(*by, "n", l2_normalize(F.transform("parts", lambda p: p["x"])).alias("centroid"))


#: Cells of an index at most, rows for which it gets one cell more, rows of a tile, queries of a block, and cells probed first.
CELLS, CELL_ROWS, TILE, BLOCK, PROBES = 1_024, 4_096, 4_096, 2_048, 3
#: What is granted to rounding when a cell is ruled out.
SLACK = 1e-7


@dataclass(frozen=True)
class Cells:
    """An index of unit vectors in files: rows filed under the nearest of some centres, and each cell's radius.

    rows(row_id, row_group, row_vector, tile, cell) lie in folders by cell; centres, radii and tiles hold one entry a cell.
    Scores are rounded to so many digits, once, where they are made.
    """

    rows: DataFrame
    centres: np.ndarray
    radii: np.ndarray
    tiles: np.ndarray
    digits: int = 9


def _matrix(column) -> np.ndarray:
    """Lists of one length as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1 if len(column) else 0)


def _file_under(centres):
    """Each row with its nearest centre and the distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(i, TILE) for b in batches for i in range(0, b.num_rows, TILE)):
            scores = _matrix(b.column(2)) @ centres.value.T
            cell = scores.argmax(axis=1)
            away = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * scores[np.arange(len(cell)), cell]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(away)], names=["row_id", "row_group", "row_vector", "cell", "away"])

    return run


def build_cells(rows: DataFrame, folder: str, cells: int | None = None) -> None:
    """Write the index of rows(row_id, row_group, row_vector), whose vectors are unit vectors of one length, to folder.

    Integer ids and groups; rows with a null vector or group are near to nothing and left out. Centres are at most CELLS
    rows, those with the smallest hashes of their ids; every row is filed. A cell of many rows has several tiles.
    """
    spark = rows.sparkSession
    some = rows.where("row_vector IS NOT NULL AND row_group IS NOT NULL").select(F.col("row_id").cast("long"), F.col("row_group").cast("long"), F.col("row_vector").cast("array<double>"))
    wanted = cells or min(CELLS, -(-some.count() // CELL_ROWS))
    centres = [r[0] for r in some.orderBy(F.xxhash64("row_id"), "row_id").limit(wanted).select("row_vector").collect()]  # CELLS at most
    sent = spark.sparkContext.broadcast(np.array(centres, float).reshape(len(centres), -1 if centres else 0))
    schema = "row_id long, row_group long, row_vector array<double>, cell int, away double"
    filed = materialize(some.mapInArrow(_file_under(sent), schema), "cells-filed")
    sizes = filed.groupBy("cell").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"), F.max("away").alias("radius"))
    found = {r.cell: r for r in sizes.collect()}  # CELLS at most
    shape = [(i, c, float(found[i].radius) if i in found else 0.0, int(found[i].tiles) if i in found else 0) for i, c in enumerate(centres)]
    shape = spark.createDataFrame(shape, "cell int, centre array<double>, radius double, tiles int").coalesce(1)
    tiled = filed.join(F.broadcast(shape.select("cell", "tiles")), "cell").withColumn("tile", F.pmod(F.xxhash64("row_id", "row_vector"), F.col("tiles")).cast("int"))
    tiled.select("row_id", "row_group", "row_vector", "tile", "cell").repartition("cell", "tile").sortWithinPartitions("cell", "tile").write.partitionBy("cell").parquet(f"{folder}/rows")
    shape.write.parquet(f"{folder}/shape")


def open_cells(spark: SparkSession, folder: str) -> Cells:
    shape = spark.read.schema("cell int, centre array<double>, radius double, tiles int").parquet(f"{folder}/shape").orderBy("cell").collect()  # CELLS at most
    rows = spark.read.schema("row_id long, row_group long, row_vector array<double>, tile int, cell int").parquet(f"{folder}/rows")
    return Cells(rows, np.array([r.centre for r in shape], float).reshape(len(shape), -1 if shape else 0), np.array([r.radius for r in shape]), np.array([r.tiles for r in shape], int))


_BUILT: dict[tuple, Cells] = {}


def kept_cells(name: str, source: DataFrame, rows: DataFrame) -> Cells:
    """The index of rows, which are derived from the table source, built once for each state of that table's files."""
    spark = rows.sparkSession
    key = (spark.sparkContext.applicationId, name, *files_state(source))
    if key not in _BUILT:
        folder = new_path(spark, "cells")
        build_cells(rows, folder)
        _BUILT[key] = open_cells(spark, folder)
    return _BUILT[key]


def _bounds(shape):
    """Each query with its home cells, nearest first, and for every cell the highest cosine that a row of it can have.

    A row is at least d - r away from the query, d being the distance to its cell's centre and r the cell's radius; on unit
    vectors a distance x is a cosine of 1 - x * x / 2.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, radii, tiles = shape.value
        held = np.flatnonzero(tiles > 0)
        for b in (b.slice(i, BLOCK) for b in batches for i in range(0, b.num_rows, BLOCK)):
            scores = _matrix(b.column(2)) @ centres[held].T
            nearest = np.maximum(0.0, np.sqrt(np.maximum(0.0, 2.0 - 2.0 * scores)) - radii[held])
            home = held[np.argsort(-scores, axis=1, kind="stable")[:, :PROBES]]
            listed = [pa.array(list(home.astype(np.int32)), pa.list_(pa.int32())), pa.array(list(1.0 - nearest * nearest / 2.0), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *listed], names=["query_id", "query_group", "query_vector", "home", "bounds"])

    return run


def _best(k: int, digits: int):
    """The k best rows of a tile for each query of a block: one matrix product."""

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        names = ["query_id", "row_id", "score"]
        if not queries.num_rows or not rows.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        asked, groups = queries["query_id"].to_numpy(), queries["query_group"].to_pandas().to_numpy(float, na_value=np.nan)
        order = np.argsort(rows["row_id"].to_numpy(), kind="stable")
        ids, own = rows["row_id"].to_numpy()[order], rows["row_group"].to_numpy()[order]
        scores = np.round(_matrix(queries["query_vector"]) @ _matrix(rows["row_vector"])[order].T, digits)
        scores[groups[:, None] == own[None, :]] = -np.inf
        if len(ids) > k:  # whatever reaches the k-th score, ties included; the exact order is made of those alone
            least = np.partition(scores, -k, axis=1)[:, -k]
            scores[scores < least[:, None]] = -np.inf
        q, r = np.nonzero(scores > -np.inf)
        s = scores[q, r]
        by = np.lexsort((ids[r], -s, q))
        q, r, s = q[by], r[by], s[by]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        q, r, s = q[place < k], r[place < k], s[place < k]
        return pa.table([pa.array(asked[q]), pa.array(ids[r]), pa.array(s)], names=names)

    return run


def _scan(index: Cells, visits: DataFrame, k: int) -> DataFrame:
    """(query_id, row_id, score): the best k rows of each tile, for visits(query_id, query_group, query_vector, cell).

    Blocks of queries meet tiles of rows; only the folders of cells that are visited are read.
    """
    spark = visits.sparkSession
    asked = {r["cell"]: r["n"] for r in visits.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # CELLS at most
    plan = spark.createDataFrame([(c, -(-n // BLOCK), int(index.tiles[c])) for c, n in asked.items()], "cell int, blocks int, tiles int")
    q = visits.join(F.broadcast(plan), "cell").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int"))
    q = q.select("query_id", "query_group", "query_vector", "cell", "block", F.explode(F.expr("sequence(0, tiles - 1)")).alias("tile"))
    r = index.rows.where(F.col("cell").isin(list(asked))).join(F.broadcast(plan), "cell")
    r = r.select("row_id", "row_group", "row_vector", "cell", "tile", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"))
    by = ["cell", "tile", "block"]
    return q.groupBy(*by).cogroup(r.groupBy(*by)).applyInArrow(_best(k, index.digits), "query_id long, row_id long, score double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("row_id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest_in(index: Cells, queries: DataFrame, k: int, digits: int = 9) -> DataFrame:
    """(query_id, row_id, score, rank): the k rows of the highest cosine for each query, but of other groups; exact.

    queries(query_id, query_group, query_vector) hold unit vectors and distinct integer ids; one with a null vector finds
    nothing, one with a null group may find every row. The cells nearest to a query are read first; their k-th score then
    rules out each cell whose bound is lower, and what is left is read. Equal scores (of so many digits) go by row_id.
    """
    spark, index = queries.sparkSession, replace(index, digits=digits)
    slack = SLACK + 0.5 * 10.0**-digits  # a lower score may be rounded up to the k-th
    stated = queries.where("query_vector IS NOT NULL").select(F.col("query_id").cast("long"), F.col("query_group").cast("long"), F.col("query_vector").cast("array<double>"))
    held = np.flatnonzero(index.tiles > 0)
    if not len(held):
        return spark.createDataFrame([], "query_id long, row_id long, score double, rank int")
    if len(held) <= PROBES:
        every = F.explode(F.array(*[F.lit(int(c)) for c in held])).alias("cell")
        return _ranked(_scan(index, stated.select("*", every), k), k).select("query_id", "row_id", "score", "rank")
    sent = spark.sparkContext.broadcast((index.centres, index.radii, index.tiles))
    schema = "query_id long, query_group long, query_vector array<double>, home array<int>, bounds array<double>"
    bounded = materialize(stated.mapInArrow(_bounds(sent), schema), "cells-bounds")
    first = materialize(_ranked(_scan(index, bounded.select("query_id", "query_group", "query_vector", F.explode("home").alias("cell")), k), k), "cells-first")
    least = first.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    cells = F.array(*[F.lit(int(c)) for c in held])
    left = bounded.join(least, "query_id", "left").withColumn("b", F.explode(F.arrays_zip(cells.alias("cell"), F.col("bounds").alias("bound"))))
    left = left.where(~F.array_contains("home", F.col("b.cell")) & (F.col("least").isNull() | (F.col("b.bound") >= F.col("least") - slack)))
    rest = _scan(index, materialize(left.select("query_id", "query_group", "query_vector", F.col("b.cell").alias("cell")), "cells-visits"), k)
    return _ranked(first.select("query_id", "row_id", "score").unionByName(rest), k).select("query_id", "row_id", "score", "rank")


def nearest(queries: DataFrame, rows: DataFrame, k: int, cells: int | None = None) -> DataFrame:
    """nearest_in over an index of rows that is built for this call."""
    folder = new_path(rows.sparkSession, "cells")
    build_cells(rows, folder, cells)
    return nearest_in(open_cells(rows.sparkSession, folder), queries, k)


def greedy_pairs(scores: np.ndarray, query_ids: list, row_ids: list) -> list[tuple]:
    """Pairs by descending score, then ids, each end used once."""
    order = sorted(((-scores[i, j], q, r) for i, q in enumerate(query_ids) for j, r in enumerate(row_ids)))
    used_q, used_r, out = set(), set(), []
    for s, q, r in order:
        if q not in used_q and r not in used_r:
            used_q.add(q)
            used_r.add(r)
            out.append((q, r, -s))
    return out


def rerank(pairs: DataFrame) -> DataFrame:
    """(query, candidate, score, n, best_query_item, best_item) from pairs(query, candidate, query_item, item, qv, v).

    Each (query, candidate) group is at most an excerpt list against another (ten by ten); it is matched greedily and
    scored by the median of its matches.
    """
    schema = "query long, candidate long, score double, n long, best_query_item long, best_item long"

    def work(g: pd.DataFrame) -> pd.DataFrame:
        q = g.drop_duplicates("query_item").sort_values("query_item")
        c = g.drop_duplicates("item").sort_values("item")
        a, b = np.vstack(q["qv"].to_numpy()), np.vstack(c["v"].to_numpy())
        a, b = a / np.linalg.norm(a, axis=1)[:, None], b / np.linalg.norm(b, axis=1)[:, None]
        found = greedy_pairs(np.round(a @ b.T, 9), q["query_item"].tolist(), c["item"].tolist())
        return pd.DataFrame([(g["query"].iat[0], g["candidate"].iat[0], float(np.median([s for _, _, s in found])), len(found), found[0][0], found[0][1])], columns=["query", "candidate", "score", "n", "best_query_item", "best_item"])

    return pairs.groupBy("query", "candidate").applyInPandas(work, schema)
