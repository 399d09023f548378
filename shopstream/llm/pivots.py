"""Exact top-k inner products by a pivot-distance index.

Vectors are lifted by one coordinate to one common norm; then the order of inner products with a query is
that of distances to the query, which is lifted with a zero. Every vector is keyed by its nearest pivot and
its distance to it; the keys are sorted by range, and runs of them are annuli: blocks of bounded size that
know their least and largest distance. A query's distance to a vector is at least the difference of their
distances to a pivot. So queries, in blocks of their own, first visit the annuli around their own distance,
which gives a score that the k-th best reaches at least, and then those annuli alone that the triangle
inequality leaves. Annuli that touch the bound are visited, too, so ties are kept and the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

#: Pivots are fitted on about so many vectors, chosen by a hash of their components; all vectors are indexed.
SAMPLE, PIVOTS, STEPS = 8_192, 64, 6
#: Vectors of an annulus and queries of a block.
BLOCK, QUERIES = 1_024, 256
#: Blocks of queries for which an annulus is sent once.
VISITS = 64
SCALE = 256.0
#: Sums of products are exact in doubles while norms stay below this; vectors beyond take no part.
_MOST = 2.0**52
_BLOCKS = "part int, k int, dims int, pivot int, low double, high double, n int, ids binary, rows binary"


def _integers(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, dims, norm2 and ints, the components as doubles of whole numbers, of vectors that take part."""
    id_kind = "long"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(1)
            flat = column.flatten()
            values = np.floor(flat.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False) * SCALE) + 0.0
            lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            starts = np.cumsum(lengths) - lengths
            for dims in np.unique(lengths[lengths > 0]).tolist():
                own = np.flatnonzero(lengths == dims)
                rows = values[starts[own][:, None] + np.arange(dims)]
                with np.errstate(over="ignore", invalid="ignore"):
                    norm2 = np.einsum("ij,ij->i", rows, rows)
                good = norm2 < _MOST  # false for what is not finite, too
                own, rows, norm2 = own[good], rows[good], norm2[good]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(own)), pa.array(np.full(len(own), dims, np.int32)), pa.array(norm2), _packed(rows)], names=["vec_id", "dims", "norm2", "ints"])

    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).where("vec_id is not null and v is not null")
    return own.mapInArrow(work, f"vec_id {id_kind}, dims int, norm2 double, ints binary")


def _packed(rows: np.ndarray) -> pa.Array:
    """Rows of whole numbers below 2**26 in size, as int32."""
    return pa.array([x.tobytes() for x in rows.astype(np.int32)], pa.binary())


def _rows(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int32).reshape(-1, dims).astype(np.float64)


def _fit(sample: np.ndarray) -> np.ndarray:
    """Centres of a sample by a few rounds of k-means from spread-out starts."""
    random = np.random.default_rng(7)
    centres = [sample[0]]
    near = ((sample - centres[0]) ** 2).sum(1)
    while len(centres) < min(PIVOTS, len(sample)) and near.max() > 0:
        centres.append(sample[random.choice(len(sample), p=near / near.sum())])
        near = np.minimum(near, ((sample - centres[-1]) ** 2).sum(1))
    centres = np.array(centres)
    for _ in range(STEPS):
        own = _distances(sample, centres).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        n = np.bincount(own, minlength=len(centres))
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def _distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = (rows**2).sum(1)[:, None] + (pivots**2).sum(1)[None, :] - 2 * rows @ pivots.T
    return np.sqrt(np.maximum(squares, 0))


class Lift:
    """Of vectors of one number of dimensions: the common norm and the pivots."""

    def __init__(self, top2: float, sample: np.ndarray):
        self.top2 = top2
        self.pivots = _fit(self.lifted(sample))
        #: What rounding can change a squared distance by.
        self.slack = 1e-9 * (1 + top2 + float((self.pivots**2).sum(1).max()))

    def lifted(self, rows: np.ndarray, query: bool = False) -> np.ndarray:
        last = np.zeros(len(rows)) if query else np.sqrt(np.maximum(self.top2 - (rows**2).sum(1), 0))
        return np.column_stack([rows, last])

    def keys(self, rows: np.ndarray, query: bool = False) -> tuple[np.ndarray, np.ndarray]:
        found = _distances(self.lifted(rows, query), self.pivots)
        own = found.argmin(1)
        return own, found[np.arange(len(rows)), own]

    def reach(self, queries: np.ndarray, least: np.ndarray) -> np.ndarray:
        """How far from a query a vector of score ``least`` or more can be."""
        with np.errstate(over="ignore"):
            return np.sqrt(np.maximum((queries**2).sum(1) + self.top2 - 2 * least + self.slack, 0)) + 1e-6 * (1 + np.sqrt(self.top2))


def _lifts(rows: DataFrame) -> dict[int, Lift]:
    """A lift for each number of dimensions; the sample is bounded, the norm is of all vectors."""
    sizes = {r["dims"]: (r["n"], r["top"]) for r in rows.groupBy("dims").agg(F.count(F.lit(1)).alias("n"), F.max("norm2").alias("top")).collect()}
    out = {}
    for dims, (n, top) in sizes.items():
        share = min(1.0, SAMPLE / n)
        own = rows.where((F.col("dims") == dims) & (F.pmod(F.xxhash64("ints"), F.lit(1_000_000)) < share * 1_000_000)).select("ints").limit(2 * SAMPLE).toArrow()
        sample = _rows(own.column(0).combine_chunks(), dims) if own.num_rows else np.zeros((1, dims))
        out[dims] = Lift(top, np.unique(sample, axis=0))
    return out


def _keyed(rows: DataFrame, lifts: dict[int, Lift], query: bool) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dims").to_numpy()
            for d in np.unique(dims).tolist():
                own = b.take(pa.array(np.flatnonzero(dims == d)))
                pivot, at = lifts[d].keys(_rows(own.column("ints"), d), query)
                yield pa.RecordBatch.from_arrays([own.column("vec_id"), own.column("dims"), own.column("ints"), pa.array(pivot.astype(np.int32)), pa.array(at)], names=["vec_id", "dims", "ints", "pivot", "at"])

    return rows.select("vec_id", "dims", "ints").mapInArrow(work, "vec_id long, dims int, ints binary, pivot int, at double")


def _blocks(keyed: DataFrame, size: int) -> DataFrame:
    """Runs of one pivot in order of distance, packed: a row has at most ``size`` vectors."""
    order = ["dims", "pivot", "at", "vec_id"]
    parts = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        held: list[tuple[np.ndarray, list[bytes], np.ndarray]] = []
        key, n = None, 0

        def block() -> pa.RecordBatch:
            ids, rows, at = np.concatenate([x[0] for x in held]), b"".join(r for x in held for r in x[1]), np.concatenate([x[2] for x in held])
            return pa.RecordBatch.from_pylist([{"part": part, "k": k, "dims": key[0], "pivot": key[1], "low": at[0], "high": at[-1], "n": len(ids), "ids": ids.astype(np.int64).tobytes(), "rows": rows}], _schema)

        for b in batches:
            dims, pivot = b.column("dims").to_numpy(), b.column("pivot").to_numpy()
            ids, at, rows = b.column("vec_id").to_numpy(), b.column("at").to_numpy(), b.column("ints").to_pylist()
            cuts = np.flatnonzero(np.concatenate([[True], (dims[1:] != dims[:-1]) | (pivot[1:] != pivot[:-1])])).tolist() + [len(ids)]
            for s, e in zip(cuts[:-1], cuts[1:]):
                if held and key != (dims[s], pivot[s]):
                    yield block()
                    held, n, k = [], 0, k + 1
                key = (int(dims[s]), int(pivot[s]))
                while s < e:
                    m = min(e, s + size - n)
                    held.append((ids[s:m], rows[s:m], at[s:m]))
                    n, s = n + m - s, m
                    if n == size:
                        yield block()
                        held, n, k = [], 0, k + 1
        if held:
            yield block()

    _schema = pa.schema([("part", pa.int32()), ("k", pa.int32()), ("dims", pa.int32()), ("pivot", pa.int32()), ("low", pa.float64()), ("high", pa.float64()), ("n", pa.int32()), ("ids", pa.binary()), ("rows", pa.binary())])
    return sorted_.mapInArrow(work, _BLOCKS)


def _visits(pairs: DataFrame, queries: DataFrame, annuli: DataFrame, lifts: dict[int, Lift], k: int) -> DataFrame:
    """The best ``k`` of each query in each annulus that its block visits; ``pairs`` names blocks and annuli.

    An annulus is sent once for each ``VISITS`` blocks, which follow it one by one.
    """
    order = Window.partitionBy("part", "k").orderBy("q_part", "q_k")
    pairs = pairs.withColumn("salt", F.floor((F.row_number().over(order) - 1) / VISITS).cast("int"))
    at = ["part", "k", "salt"]
    first = pairs.select(at).distinct().join(annuli, ["part", "k"]).withColumn("least", F.lit(None).cast("binary"))
    then = pairs.join(queries, ["q_part", "q_k"]).select(*at, *[F.lit(None).cast(t).alias(c) for c, t in (("dims", "int"), ("pivot", "int"), ("low", "double"), ("high", "double"))], F.col("q_ids").alias("ids"), F.col("q_rows").alias("rows"), "least")
    rows = first.select(then.columns).unionByName(then).repartition(*at).sortWithinPartitions(*at, F.col("dims").isNull())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict = {}
        for b in batches:
            for r in range(len(b)):
                x = b.slice(r, 1).to_pylist()[0]
                if x["dims"] is not None:
                    own = x | {"ids": np.frombuffer(x["ids"], np.int64), "rows": np.frombuffer(x["rows"], np.int32).reshape(-1, x["dims"]).astype(np.float64)}
                    continue
                queries, q_ids = np.frombuffer(x["rows"], np.int32).reshape(-1, own["dims"]).astype(np.float64), np.frombuffer(x["ids"], np.int64)
                least = np.full(len(q_ids), -np.inf)
                if x["least"] is not None:
                    lift, least = lifts[own["dims"]], np.frombuffer(x["least"], np.float64)
                    apart = _distances(lift.lifted(queries, True), lift.pivots[own["pivot"]][None, :])[:, 0]
                    reach = lift.reach(queries, least)
                    use = np.flatnonzero((apart - reach <= own["high"]) & (apart + reach >= own["low"]))
                    queries, q_ids, least = queries[use], q_ids[use], least[use]
                if len(q_ids):
                    yield _best(queries, q_ids, least, own["rows"], own["ids"], k)

    return rows.mapInArrow(work, "query_id long, vec_id long, score long")


def _best(queries: np.ndarray, q_ids: np.ndarray, least: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> pa.RecordBatch:
    scores = queries @ rows.T
    scores[q_ids[:, None] == ids[None, :]] = -np.inf
    if len(ids) > k:  # all that reach the k-th, so ties are not decided here
        least = np.maximum(least, np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k])
    q, x = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
    q_id, vec_id, score = q_ids[q], ids[x], scores[q, x].astype(np.int64)
    order = np.lexsort((vec_id, -score, q_id))
    q_id, vec_id, score = q_id[order], vec_id[order], score[order]
    keep = np.arange(len(q_id)) - np.searchsorted(q_id, q_id) < k
    return pa.RecordBatch.from_arrays([pa.array(q_id[keep]), pa.array(vec_id[keep]), pa.array(score[keep])], names=["query_id", "vec_id", "score"])


def _ranked(found: DataFrame, k: int) -> DataFrame:
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)


def _limits(blocks: DataFrame, lifts: dict[int, Lift]) -> DataFrame:
    """For each block of queries and each pivot, how near and far the block's queries can find what they want."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.to_pylist():
                lift = lifts[x["dims"]]
                queries = np.frombuffer(x["q_rows"], np.int32).reshape(-1, x["dims"]).astype(np.float64)
                apart = _distances(lift.lifted(queries, True), lift.pivots)
                reach = lift.reach(queries, np.frombuffer(x["least"], np.float64))[:, None]
                n = len(lift.pivots)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x["q_part"]] * n, pa.int32()), pa.array([x["q_k"]] * n, pa.int32()), pa.array([x["dims"]] * n, pa.int32()), pa.array(np.arange(n, dtype=np.int32)), pa.array((apart - reach).min(0)), pa.array((apart + reach).max(0))],
                    names=["q_part", "q_k", "dims", "pivot", "near", "far"],
                )

    return blocks.mapInArrow(work, "q_part int, q_k int, dims int, pivot int, near double, far double")


def _with_least(blocks: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """Blocks of queries with the score that each query's k-th best reaches at least."""
    least = _ranked(found, k).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("score")).where(F.col("n") == k)
    each = blocks.select("q_part", "q_k", F.posexplode("q_list").alias("i", "query_id")).join(least, "query_id", "left")
    lists = each.groupBy("q_part", "q_k").agg(F.array_sort(F.collect_list(F.struct("i", F.col("score").cast("double").alias("score")))).alias("of"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            least = [np.array([-np.inf if s["score"] is None else s["score"] for s in x]).tobytes() for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(least, pa.binary())], names=["q_part", "q_k", "least"])

    return blocks.drop("least").join(lists.mapInArrow(work, "q_part int, q_k int, least binary"), ["q_part", "q_k"])


def top_products(vectors: DataFrame, k: int = 5, *, every: int = 50, queries: DataFrame | None = None, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK, q_block: int = QUERIES) -> DataFrame:
    """For each query its ``k`` largest integer inner products: query_id, rank (from 1), vec_id, score.

    Components count as floor(256 * x). Queries are the rows of ``queries``, or those whose id is divisible
    by ``every``; candidates are all rows but those of the query's own id. Equal scores rank by least
    vec_id. A query with fewer candidates gets them all.

    Vectors that are null or empty, hold null or non-finite components, or have a squared integer norm of
    2**52 or more, whose products doubles don't hold, take no part; neither do rows with a null id. Vectors
    of different lengths don't meet. Of rows that repeat an id, equal vectors are one; of different ones of
    a candidate the best counts, and a query's are one query of which each pair's best score counts. Equal
    vectors are compared once: only the least ``k + 1`` of their ids can be in a result. Empty tables give
    an empty result; other columns are not looked at.
    """
    spark = vectors.sparkSession
    tables = Scratch(spark, "pivots")
    all_rows = tables.put(_integers(vectors, id_col, vector_col), "rows")
    asked = (tables.put(_integers(queries, id_col, vector_col), "asked") if queries is not None else all_rows.where(F.col("vec_id") % every == 0)).dropDuplicates(["vec_id", "ints"])
    nothing = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    lifts = _lifts(all_rows)
    asked = asked.where(F.col("dims").isin(list(lifts))) if lifts else asked.limit(0)
    # equal vectors of a third of the rows: each task sends k + 1 of them at most
    own = Window.partitionBy("ints").orderBy("vec_id")
    rows = all_rows.select("vec_id", "dims", "ints").withColumn("_r", F.dense_rank().over(own)).where(F.col("_r") <= k + 1).dropDuplicates(["vec_id", "ints"])
    annuli = tables.put(_blocks(_keyed(rows, lifts, False), block), "annuli")
    blocks = _blocks(_keyed(asked, lifts, True), q_block)
    renamed = blocks.select(F.col("part").alias("q_part"), F.col("k").alias("q_k"), "dims", F.col("pivot").alias("q_pivot"), F.col("low").alias("q_low"), F.col("high").alias("q_high"), F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows"))
    blocks = tables.put(_listed(renamed), "queries")
    if not lifts or blocks.isEmpty():
        return tables.keep(nothing)
    # the annuli of a block's own pivot that its distances fall into, or the next ones inside and outside
    index = annuli.select("part", "k", "dims", "pivot", "low", "high")
    near = F.greatest(F.col("low") - F.col("q_high"), F.col("q_low") - F.col("high"), F.lit(0.0))
    by_block = Window.partitionBy("q_part", "q_k").orderBy("near", "part", "k")
    first = blocks.select("q_part", "q_k", "dims", F.col("q_pivot").alias("pivot"), "q_low", "q_high").join(index, ["dims", "pivot"]).withColumn("near", near)
    first = tables.put(first.withColumn("_r", F.row_number().over(by_block)).where("near = 0 or _r <= 2").select("q_part", "q_k", "part", "k"), "first")
    packed = blocks.select("q_part", "q_k", "q_ids", "q_rows")
    stored = annuli.select("part", "k", "dims", "pivot", "low", "high", "ids", "rows")

    def visit(pairs: DataFrame, asked_blocks: DataFrame) -> DataFrame:
        return _visits(pairs, asked_blocks, stored, lifts, k)

    found = tables.put(visit(first, packed.withColumn("least", F.lit(None).cast("binary"))), "found")
    blocks = tables.put(_with_least(blocks, found, k), "least")
    limits = _limits(blocks.select("q_part", "q_k", "dims", "q_rows", "least"), lifts)
    rest = limits.join(index, ["dims", "pivot"]).where("low <= far and high >= near").select("q_part", "q_k", "part", "k").join(first, ["q_part", "q_k", "part", "k"], "left_anti")
    more = tables.put(visit(rest, blocks.select("q_part", "q_k", "q_ids", "q_rows", "least")), "more")
    best = found.unionByName(more).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return tables.keep(_ranked(best, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "found", "more")


def _listed(blocks: DataFrame) -> DataFrame:
    """Blocks of queries with their ids as an array beside the packed ones."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = pa.array([np.frombuffer(x, np.int64) for x in b.column("q_ids").to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], names=[*b.schema.names, "q_list"])

    return blocks.mapInArrow(work, "q_part int, q_k int, dims int, q_pivot int, q_low double, q_high double, q_ids binary, q_rows binary, q_list array<long>")
