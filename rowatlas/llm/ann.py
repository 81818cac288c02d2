"""Approximate nearest neighbours by cosine: an inverted file with product-quantised residuals.

Vectors are scaled to length 1. Coarse centroids and the codebooks of residual parts are
fitted by k-means on a bounded sample; every vector is indexed. A vector goes to
its best cell; cells are cut into chunks of bounded size, so a cell with a third of
all vectors is many tasks. A query visits its ``probes`` best cells, as many as the sample's own nearest
neighbours need for the recall that is asked for: few where vectors have clusters, most where they have none. In each chunk an
asymmetric distance table scores all codes. The best ``rerank`` of the chunk are measured
on the original vectors, which lie beside their codes, and give a first k-th score; then
every code whose upper bound, its rough score plus the stored error of its vector, reaches
that score is measured too, in double precision. So a chunk loses none of its k best,
however close its vectors are. Each chunk gives its k best, which are merged.

Recall on whole tables is measured in tests against brute force: at least 0.9.

Defined cases: vectors that are null, zero, or hold null or non-finite components take
no part as query or candidate; nor do vectors of another length than the most
frequent (ties: the longest) or with a null id; a query has all candidates if there
are fewer than k; equal scores are ordered by id; rows that share an id are vectors
of their own: each is a query with its own ranks, and a candidate for the others; empty tables give no rows; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowatlas.llm import scratch
from rowatlas.llm.sampling import smallest

#: Vectors for k-means at most: those with the smallest hash.
SAMPLE_ROWS, SAMPLE_NUMBERS = 80_000, 4_000_000
#: Vectors of a chunk, and queries of a block, on average; queries that numpy takes at once.
CHUNK, QUERY_BLOCK = 4096, 128
#: Recall on the sample by which the number of cells is chosen that a query visits, sample queries for that, and candidates of a
#: chunk that are measured first.
RECALL, ASKED, RERANK = 0.97, 512, 60
#: Vectors of the sample for each cell, and cells at most: cells grow with the root of the number of vectors up to there.
PER_CELL, MOST_CELLS = 20, 4096
#: Room for rounding in bounds of cosines, and numbers of vectors that are measured at once.
SLACK, MEASURED = 1e-9, 4_000_000
ROUNDS = 8


@dataclass
class Index:
    centroids: np.ndarray  # (cells, d)
    books: np.ndarray  # (parts, codes, d / parts)


def usable(v: Column) -> Column:
    """Not null, all components finite, not zero."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    k = min(k, len(x))
    c = x[np.sort(rng.choice(len(x), k, replace=False))].copy()
    for _ in range(ROUNDS):
        near = (x @ c.T - (c**2).sum(1) / 2).argmax(1)
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def _parts(d: int) -> int:
    """Parts of a residual: the largest divisor of d that leaves two components or more in each."""
    return max((p for p in range(1, d + 1) if d % p == 0 and d // p >= 2), default=1)


def fit(sample: np.ndarray, cells: int, codes: int = 256, seed: int = 3) -> Index:
    """Centroids and codebooks from unit vectors."""
    rng = np.random.default_rng(seed)
    c = _kmeans(sample, cells, rng)
    rest = sample - c[(sample @ c.T - (c**2).sum(1) / 2).argmax(1)]
    p = _parts(sample.shape[1])
    return Index(c, np.stack([_padded(_kmeans(part, codes, rng), codes) for part in np.split(rest, p, axis=1)]))


def probes_for(index: Index, sample: np.ndarray, k: int, recall: float = RECALL) -> int:
    """Cells that a query must visit, so that so many of the k nearest of sample vectors are in them. Neighbours in the whole are nearer than those in a sample."""
    cells, n = len(index.centroids), len(sample)
    if n <= k or cells == 1:
        return cells
    asked = np.random.default_rng(9).choice(n, min(n, ASKED), replace=False)
    cell = np.concatenate([(part @ index.centroids.T - (index.centroids**2).sum(1) / 2).argmax(1) for part in np.array_split(sample, max(1, n // 8192))])
    places = []
    for q in np.array_split(asked, max(1, len(asked) // 64)):
        cos = sample[q] @ sample.T
        cos[np.arange(len(q)), q] = -np.inf
        near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
        order = np.argsort(np.argsort(-(sample[q] @ index.centroids.T), axis=1, kind="stable"), axis=1)
        places.append(np.take_along_axis(order, cell[near], 1).ravel())
    return min(cells, int(np.quantile(np.concatenate(places), recall, method="higher")) + 1)


def _padded(book: np.ndarray, codes: int) -> np.ndarray:
    return np.concatenate([book, np.full((codes - len(book), book.shape[1]), 1e9)]) if len(book) < codes else book


def encode(index: Index, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cell, codes (bytes) and length of what the codes leave out, of unit vectors."""
    c = index.centroids
    cell = (x @ c.T - (c**2).sum(1) / 2).argmax(1)
    rest = x - c[cell]
    codes = [(part @ book.T - (book**2).sum(1) / 2).argmax(1) for part, book in zip(np.split(rest, len(index.books), axis=1), index.books, strict=True)]
    known = np.concatenate([book[c] for c, book in zip(codes, index.books, strict=True)], 1)
    return cell, np.stack(codes, 1).astype(np.uint8), np.linalg.norm(rest - known, axis=1)


def _unit(v: np.ndarray) -> np.ndarray:
    top = np.abs(v).max(1, keepdims=True)
    v = v / top
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d).astype(float)


def _indexing(index: Index, d: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            cell, codes, error = encode(index, _unit(_matrix(b.column("v"), d)))
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("id"), pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), b.column("v")], ["row", "id", "cell", "codes", "error", "v"])

    return run


def _probing(index: Index, d: int, probes: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            near = np.argsort(-(_unit(_matrix(b.column("v"), d)) @ index.centroids.T), axis=1, kind="stable")[:, :probes]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("id"), b.column("v"), pa.array(list(near.astype(np.int32)), pa.list_(pa.int32()))], ["row", "id", "v", "cells"])

    return run


def _kth(score: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row, as a column; minus infinity if there are fewer."""
    n = score.shape[1]
    return np.partition(score, n - k, axis=1)[:, [n - k]] if n >= k else np.full((len(score), 1), -np.inf)


def _search_block(index: Index, cell: int, q: np.ndarray, q_row: np.ndarray, x: np.ndarray, x_row: np.ndarray, x_id: np.ndarray, unit_x: np.ndarray, codes: np.ndarray, error: np.ndarray, k: int, rerank: int) -> tuple[np.ndarray, ...]:
    """Place of the query, id of the candidate, and cosine of the best k of a chunk for each query of a block."""
    unit, parts = _unit(q), len(index.books)
    tables = np.stack([part @ book.T for part, book in zip(np.split(unit, parts, axis=1), index.books, strict=True)])  # (parts, queries, codes)
    rough = np.repeat((unit @ index.centroids[cell])[:, None], len(x), 1)
    for p in range(parts):
        rough += tables[p][:, codes[:, p]]
    rough[q_row[:, None] == x_row[None, :]] = -np.inf
    r = min(max(rerank, k), len(x))
    pick = np.argpartition(-rough, r - 1, axis=1)[:, :r]
    first = np.einsum("qd,qrd->qr", unit, unit_x[pick])
    first[np.isneginf(np.take_along_axis(rough, pick, 1))] = -np.inf
    open_ = (rough + error >= _kth(first, k) - SLACK) & ~np.isneginf(rough)
    at = np.flatnonzero(open_.any(0))
    near = np.where(open_[:, at], unit @ unit_x[at].T, -np.inf)
    a, b = np.nonzero((near >= _kth(near, k) - SLACK) & ~np.isneginf(near))
    b = at[b]
    # Equal vectors must have equal scores to the last bit, which a matrix product does not promise.
    step = max(1, MEASURED // x.shape[1])
    dots = np.concatenate([np.empty(0), *(np.einsum("pd,pd->p", q[a[s : s + step]], x[b[s : s + step]]) for s in range(0, len(a), step))])
    score = dots / (np.sqrt((q * q).sum(1))[a] * np.sqrt((x * x).sum(1))[b])
    order = np.lexsort((x_id[b], -score, a))  # ties by id
    n = np.bincount(a, minlength=len(q))
    best = order[np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) < k]
    return a[best], x_id[b[best]], score[best]


def _searching(index: Index, d: int, k: int, rerank: int):
    def run(key: tuple[pa.Scalar, ...], chunk: pa.Table, asked: pa.Table) -> pa.Table:
        schema = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        out = [schema.empty_table()]
        if chunk.num_rows and asked.num_rows:
            x, x_row, x_id = _matrix(chunk["v"].combine_chunks(), d), chunk["row"].to_numpy(), chunk["id"].to_numpy()
            q, q_row, q_id = _matrix(asked["v"].combine_chunks(), d), asked["row"].to_numpy(), asked["id"].to_numpy()
            codes = np.frombuffer(b"".join(chunk["codes"].to_pylist()), np.uint8).reshape(len(x), -1)
            unit_x, error = _unit(x), chunk["error"].to_numpy()
            for at in range(0, len(q), QUERY_BLOCK):
                place, vec, score = _search_block(index, key[0].as_py(), q[at : at + QUERY_BLOCK], q_row[at : at + QUERY_BLOCK], x, x_row, x_id, unit_x, codes, error, k, rerank)
                out.append(pa.Table.from_arrays([pa.array(c, t) for c, t in zip((q_row[at + place], q_id[at + place], vec, score), schema.types, strict=True)], schema=schema))
        return pa.concat_tables(out)

    return run


def search(spark: SparkSession, vectors: DataFrame, is_query: Column, k: int = 5, recall: float = RECALL, rerank: int = RERANK, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k nearest other vectors of each query.

    ``vectors`` has ``id`` and ``v``; ``is_query`` is a condition on ``id``.
    """
    tables = scratch.Tables(spark)
    found = vectors.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    sizes = found.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    empty = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], empty)
    d, n = sizes.d, sizes.n
    found = found.where(F.size("v") == d)
    cells = min(round(math.sqrt(n)), MOST_CELLS)
    rows = min(sample_rows, max(1, SAMPLE_NUMBERS // d), max(5000, PER_CELL * cells))
    x = _unit(_matrix(smallest(found, F.xxhash64("id", "v"), rows).select("v").toArrow().column("v").combine_chunks(), d))
    index = fit(x, max(1, min(cells, len(x) // PER_CELL)))
    probes = probes_for(index, x, k, recall)
    # Rows are numbered in the written table: numbers are unique and stay.
    found = found.select(F.monotonically_increasing_id().alias("row"), "id", "v")
    stored = tables.write(found.mapInArrow(_indexing(index, d), "row long, id long, cell int, codes binary, error double, v array<double>"), "index")
    asked = stored.where(is_query).select("row", "id", "v").mapInArrow(_probing(index, d, probes), "row long, id long, v array<double>, cells array<int>")
    asked = tables.write(asked.select("row", "id", "v", F.explode("cells").alias("cell")), "queries")
    # Chunks and query blocks of a cell: every pair of them is one group of bounded size.
    held = stored.groupBy("cell").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    sought = asked.groupBy("cell").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("blocks"))
    plan = F.broadcast(held.join(sought, "cell"))  # one row per cell
    part = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    chunks = stored.join(plan, "cell").select("cell", part("chunks").alias("chunk"), each("blocks").alias("block"), "row", "id", "codes", "error", "v")
    blocks = asked.join(plan, "cell").select("cell", each("chunks").alias("chunk"), part("blocks").alias("block"), "row", "id", "v")
    keys = ["cell", "chunk", "block"]
    near = chunks.groupBy(*keys).cogroup(blocks.groupBy(*keys)).applyInArrow(_searching(index, d, k, rerank), "query long, query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")).cast("int")
    return near.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
