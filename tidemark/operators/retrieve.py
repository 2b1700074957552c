"""Nearest vectors by an index of lists, lexical ranks and their fusion."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import write_table

#: Queries and rows that one multiplication takes at most, about.
QUERIES_AT_ONCE, ROWS_AT_ONCE = 512, 8192
#: Centres are fitted on so many vectors, and on so many numbers, at most; there are at most MOST_CENTRES.
SAMPLE, SAMPLE_NUMBERS, MOST_CENTRES = 16_384, 1 << 23, 4096
#: Lists that a search looks at first are as many as hold this share of the true neighbours of sample vectors.
RECALL = 0.95
_FITTING_ROUNDS = 8


def _unit(vectors: list) -> np.ndarray:
    """Vectors at length 1 in doubles; rows of nan for those that are null, zero or not finite."""
    size = max((len(v) for v in vectors if v is not None), default=1)
    made = np.full((len(vectors), size), np.nan)
    for k, v in enumerate(vectors):
        if v is not None and len(v) == size and None not in v:
            made[k] = v
    length = np.sqrt((made * made).sum(axis=1))
    return made / np.where((length > 0) & np.isfinite(length), length, np.nan)[:, None]


class Centres:
    """Centres of the lists of an index, by rounds of nearest centres and means on a bounded sample; ``probes``, the number of nearest lists that hold RECALL of the nearest ``k`` of sample vectors."""

    def __init__(self, sample: np.ndarray, count: int, k: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        many = min(len(sample), MOST_CENTRES, max(1, round(math.sqrt(count))))
        centres = sample[rng.permutation(len(sample))[:many]]
        for _ in range(_FITTING_ROUNDS):
            near = (sample @ centres.T).argmax(axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, near, sample)
            length = np.linalg.norm(sums, axis=1, keepdims=True)
            centres = np.where(length > 1e-12, sums / np.where(length > 1e-12, length, 1), centres)
        self.centres = centres
        own = (sample @ centres.T).argmax(axis=1)
        tried = sample[rng.permutation(len(sample))[:256]]
        among = tried @ sample.T
        wanted = min(k + 1, len(sample))
        nearest = np.argpartition(-among, wanted - 1, axis=1)[:, :wanted]
        place = np.argsort(np.argsort(-(tried @ centres.T), axis=1), axis=1)
        depth = np.sort(np.take_along_axis(place, own[nearest], axis=1).ravel())
        self.probes = int(depth[min(len(depth) - 1, math.ceil(RECALL * len(depth)))]) + 1


def fit_centres(rows: DataFrame, vector_col: str, k: int) -> Centres | None:
    """Centres from a sample of ``rows`` by a hash of the vector; None if no row has a usable vector."""
    some = rows.where(F.col(vector_col).isNotNull() & (F.size(vector_col) > 0))
    count, size = some.agg(F.count(F.lit(1)), F.max(F.size(vector_col))).first()
    if not count:
        return None
    most = max(64, min(SAMPLE, SAMPLE_NUMBERS // size))
    share = min(1 << 40, (1 << 40) * most * 5 // (4 * count))
    taken = sorted(tuple(r[0]) for r in some.where(F.pmod(F.xxhash64(vector_col), F.lit(1 << 40)) < share).select(vector_col).limit(2 * most).collect() if None not in r[0])
    sample = _unit([v for v in taken if len(v) == size])
    sample = sample[np.isfinite(sample).all(axis=1)] if len(sample) else sample
    return Centres(sample, count, k) if len(sample) else None


def index_vectors(rows: DataFrame, id_col: str, vector_col: str, centres: Centres, attributes: list[str]) -> DataFrame:
    """``id``, ``centre`` (the nearest), ``near`` (its cosine), ``unit`` (bytes of doubles) and ``attributes`` of every row with a usable vector of the centres' size."""
    source = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("__v"), *attributes)
    made = [T.StructField("centre", T.IntegerType()), T.StructField("near", T.DoubleType()), T.StructField("unit", T.BinaryType())]
    schema = T.StructType([source.schema["id"], *(source.schema[c] for c in attributes), *made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = _unit(batch.column(1).to_pylist())
            if unit.shape[1] != centres.centres.shape[1]:
                continue
            at = np.flatnonzero(np.isfinite(unit).all(axis=1))
            near = unit[at] @ centres.centres.T
            kept = [batch.column(c).take(pa.array(at)) for c in (0, *range(2, batch.num_columns))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(near.argmax(axis=1), pa.int32()), pa.array(near.max(axis=1)), pa.array([v.tobytes() for v in unit[at]], pa.binary())], names=schema.names)

    return source.mapInArrow(run, schema)


def _probe(queries: DataFrame, centres: Centres, lists: list[tuple[int, int, float]], first: int, phase: int) -> DataFrame:
    """``queries`` (id, unit, ...) once for each list to look at. Phase 1: the ``first`` nearest lists. Phase 2: those beyond, that may hold one nearer than ``least``: no vector of a list is nearer to a query than the angle to its centre less the list's widest angle."""
    wide = np.full(len(centres.centres), -1.0)
    for centre, _, least_near in lists:
        wide[centre] = math.acos(max(-1.0, min(1.0, least_near)))
    schema = T.StructType([*queries.schema.fields, T.StructField("list", T.IntegerType())])
    unit_at = queries.columns.index("unit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = np.stack([np.frombuffer(x, dtype=np.float64) for x in batch.column(unit_at).to_pylist()])
            near = unit @ centres.centres.T
            near[:, wide < 0] = -np.inf
            place = np.argsort(np.argsort(-near, axis=1, kind="stable"), axis=1)
            if phase == 1:
                chosen = (place < first) & np.isfinite(near)
            else:
                least = batch.column(batch.schema.get_field_index("least")).to_numpy(zero_copy_only=False)
                best = np.cos(np.maximum(0.0, np.arccos(np.clip(near, -1, 1)) - wide[None, :]))
                chosen = (place >= first) & np.isfinite(near) & (best >= least[:, None] - 2e-6)
            at, lists_at = np.nonzero(chosen)
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at)) for c in batch.columns), pa.array(lists_at.astype(np.int32))], names=schema.names)

    return queries.mapInArrow(run, schema)


def _search(probes: DataFrame, index: DataFrame, sizes: DataFrame, k: int, digits: int, same: list[str], not_later: str | None, kind: T.DataType) -> DataFrame:
    """The ``k`` best of each probe in its list. Lists are cut by a hash to about ROWS_AT_ONCE rows and the queries of a list to about QUERIES_AT_ONCE; each two parts meet in one multiplication."""
    asked = probes.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERIES_AT_ONCE).cast("int").alias("q"))
    cut = write_table(asked.join(sizes, "list"), "cut")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    mine = lambda salt, c: F.pmod(F.xxhash64(F.lit(salt), "id"), F.col(c)).cast("int")
    left = probes.join(F.broadcast(cut), "list").select("list", mine("query", "q").alias("i"), every("r").alias("j"), *(c for c in probes.columns if c != "list"))
    right = index.withColumnRenamed("centre", "list").join(F.broadcast(cut), "list").select("list", every("q").alias("i"), mine("row", "r").alias("j"), "id", "unit", *same, *([not_later] if not_later else []))
    schema = T.StructType([T.StructField("query_id", kind), T.StructField("id", kind), T.StructField("cosine", T.DoubleType())])

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"query_id": [], "id": [], "cosine": []}).cast(arrow)
        vectors = [np.stack([np.frombuffer(x, dtype=np.float64) for x in t.column("unit").to_pylist()]) for t in (a, b)]
        ids = [np.array(t.column("id").to_pylist(), dtype=object) for t in (a, b)]
        order = sorted(range(len(ids[1])), key=lambda n: (ids[1][n] is None, ids[1][n]))
        b, ids[1], vectors[1] = b.take(pa.array(order)), ids[1][order], vectors[1][order]
        near = np.round(vectors[0] @ vectors[1].T, digits)
        fits = ids[0][:, None] != ids[1][None, :]
        for c in same:
            x, y = (np.array(t.column(c).to_pylist(), dtype=object) for t in (a, b))
            fits &= (x[:, None] == y[None, :]) & (x != None)[:, None]  # noqa: E711
        if not_later:
            x, y = (np.array(t.column(not_later).to_pylist(), dtype=object) for t in (a, b))
            known = (x != None)[:, None] & (y != None)[None, :]  # noqa: E711
            later = np.zeros_like(fits)
            later[known] = (np.broadcast_to(y[None, :], fits.shape)[known] > np.broadcast_to(x[:, None], fits.shape)[known]).astype(bool)
            fits &= known & ~later
        near[~fits.astype(bool)] = -np.inf
        at = np.argsort(-near, axis=1, kind="stable")[:, :k]
        near = np.take_along_axis(near, at, axis=1)
        keep = np.isfinite(near)
        query = np.repeat(np.arange(len(at)), at.shape[1]).reshape(at.shape)[keep]
        return pa.table({"query_id": pa.array(ids[0][query].tolist(), arrow.field("query_id").type), "id": pa.array(ids[1][at[keep]].tolist(), arrow.field("id").type), "cosine": near[keep]})

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    return left.groupBy("list", "i", "j").cogroup(right.groupBy("list", "i", "j")).applyInArrow(best, schema)


def cosine_top(queries: DataFrame, rows: DataFrame, k: int, id_col: str, vector_col: str, digits: int = 6, same: list[str] | None = None, not_later: str | None = None, exact: bool = True) -> DataFrame:
    """``query_id``, ``id_col``, ``cosine`` (rounded) and ``rank`` of the ``k`` nearest rows of each query, itself left out, ties by id; ``same`` names columns that must be equal and ``not_later`` one in which a row may not exceed the query's (null: no match), both of queries and rows.

    Rows are laid into the lists of their nearest centres (``fit_centres``; every row is in one). A search looks at the lists nearest to a query, inside which rows that the filters refuse don't count; where ``exact``, it then looks at every other list that may hold a row as near as the ``k``-th found: of clustered vectors few, of evenly spread ones all. Without it about RECALL are found. Vectors that are null, zero, not finite or of another size than the largest match nothing. Lists have at most MOST_CENTRES sizes and widths, which reach the driver.
    """
    spark, same = rows.sparkSession, same or []
    kind = rows.schema[id_col].dataType
    none = spark.createDataFrame([], T.StructType([T.StructField("query_id", kind), T.StructField(id_col, kind), T.StructField("cosine", T.DoubleType()), T.StructField("rank", T.IntegerType())]))
    centres = fit_centres(rows, vector_col, k)
    if centres is None:
        return none
    attributes = [*same, *([not_later] if not_later else [])]
    index = write_table(index_vectors(rows, id_col, vector_col, centres, attributes), "index")
    lists = [tuple(r) for r in index.groupBy("centre").agg(F.count(F.lit(1)).alias("n"), F.min("near")).collect()]
    sizes = spark.createDataFrame([(c, -(-n // ROWS_AT_ONCE)) for c, n, _ in lists], "list int, r int")
    asked = write_table(index_vectors(queries, id_col, vector_col, centres, attributes).drop("centre", "near"), "queries")
    w = W.partitionBy("query_id").orderBy(F.col("cosine").desc(), "id")
    top = lambda found: found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    found = write_table(top(_search(_probe(asked, centres, lists, centres.probes, 1), index, sizes, k, digits, same, not_later, kind)), "found")
    if exact and centres.probes < len(lists):
        least = found.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("cosine")).otherwise(F.lit(-2.0)).alias("least"))
        again = asked.join(least.withColumnRenamed("query_id", "id"), "id", "left").withColumn("least", F.coalesce("least", F.lit(-2.0)))
        more = _search(_probe(again, centres, lists, centres.probes, 2).drop("least"), index, sizes, k, digits, same, not_later, kind)
        found = top(found.drop("rank").unionByName(more))
    return found.withColumnRenamed("id", id_col)


def lexical_top(df: DataFrame, id_col: str, text_col: str, terms: list[str], k: int) -> DataFrame:
    """The ``k`` texts with most of the terms, then most occurrences per word, ties by id."""
    words = F.split(F.lower(F.col(text_col)), "[^a-z]+")
    hits = F.filter(words, lambda w: w.isin(*terms))
    scored = df.select(id_col, F.size(F.array_distinct(hits)).alias("n_terms"), F.size(hits).alias("n_hits")).where("n_terms > 0")
    top = scored.orderBy(F.col("n_terms").desc(), F.col("n_hits").desc(), id_col).limit(k)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.col("n_terms").desc(), F.col("n_hits").desc(), id_col)))


def fuse(ranked: list[DataFrame], id_col: str, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (``id_col``, rank)."""
    laid = ranked[0].select(id_col, "rank")
    for other in ranked[1:]:
        laid = laid.unionByName(other.select(id_col, "rank"))
    return laid.groupBy(id_col).agg(F.sum(1 / (F.lit(constant) + F.col("rank"))).alias("fused"), F.count(F.lit(1)).alias("n_lists"))


def hit_rate(found: DataFrame, truth: DataFrame, query: str, item: str, k: int) -> DataFrame:
    """Share of the queries of ``truth`` with a true item among their first ``k`` found."""
    hits = found.where(F.col("rank") <= k).join(truth, [query, item], "left_semi").select(query).distinct().withColumn("hit", F.lit(1))
    return truth.select(query).distinct().join(hits, query, "left").agg(F.count(F.lit(1)).alias("n_queries"), F.avg(F.coalesce("hit", F.lit(0))).alias("hit_rate"))
