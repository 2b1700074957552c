"""Embedding near-dedup: codes by iterative quantisation, multi-index Hamming tables, and cosines of the original vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import few_at_once, quoted
from ..operators.components import smallest_reachable
from ..scratch import drop_table, write_table

#: The model is fitted on a sample of so many vectors, or numbers, at most.
SAMPLE, SAMPLE_NUMBERS = 8192, 1 << 22
#: Bits of one rotation, at most; more components are first projected to the principal ones.
MOST_BITS = 128
ROTATION_STEPS = 30
#: Tables are added until this share of pairs of just the asked likeness meet in one; with more tables than MOST_TABLES keys get shorter instead.
RECALL, MOST_TABLES = 0.98, 64
#: Of pairs of just the asked likeness, the share whose codes may differ in more bits than are looked at.
TAIL = 0.001
#: A bucket with more vectors is looked at for crowds; a crowd has so many vectors at least.
CROWDED, LEAST_CROWD, CROWD_ROUNDS = 32, 16, 4
#: Vectors of one side of a block of products.
SIDE = 512
#: Keys that go to every executor at most.
MOST_SENT = 100_000
#: Room for rounding where a bound decides that a pair is linked.
SLACK = 1e-9


def unit(values: np.ndarray) -> np.ndarray | None:
    """A vector at length 1 in doubles; None if a component isn't finite or all are zero."""
    most = np.abs(values).max() if values.size and np.isfinite(values).all() else 0.0
    if not most:
        return None
    scaled = values / most
    return scaled / np.sqrt(scaled @ scaled)


class Codes:
    """Rotations that give balanced binary codes, and tables over pieces of them.

    Each rotation is learned by iterative quantisation from its own random start: signs of the rotated sample and the rotation that best maps the sample on them, in turns. A bit is whether a rotated component exceeds its median in the sample. The pieces of ``width`` bits of all rotations, one after another, are the keys of the tables. Their number is measured: pairs of just the likeness ``cosine`` are made from sample vectors, towards other sample vectors and towards random directions, and tables are added until RECALL of either kind meet in one.
    """

    def __init__(self, sample: np.ndarray, count: int, cosine: float, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.size = sample.shape[1]
        self.mean = sample.mean(axis=0)
        centred = sample - self.mean
        self.bits = min(self.size, MOST_BITS)
        self.axes = np.linalg.eigh(centred.T @ centred)[1][:, ::-1][:, : self.bits]
        flat = centred @ self.axes
        others = sample[rng.permutation(len(sample))]
        noise = rng.standard_normal(sample.shape)
        pairs = [(self._towards(sample, x, cosine) - self.mean) @ self.axes for x in (others, noise)]
        self.width = max(6, math.ceil(math.log2(max(count, 2))) - 3)
        self.rotations, self.medians, bits, near = [], [], np.zeros((len(sample), 0), dtype=bool), [np.zeros((len(sample), 0), dtype=bool)] * 2
        self.tables = 0
        while not self.tables:
            if bits.shape[1] >= self.width * MOST_TABLES:
                self.tables = self._enough(bits, near)
                if not self.tables:
                    self.width -= 1
                    self.tables = MOST_TABLES if self.width == 0 else 0
                continue
            rotation = self._learn(flat, rng)
            turned = flat @ rotation
            median = np.median(turned, axis=0)
            self.rotations.append(rotation)
            self.medians.append(median)
            bits = np.concatenate([bits, turned > median], axis=1)
            near = [np.concatenate([x, y @ rotation > median], axis=1) for x, y in zip(near, pairs, strict=True)]
            if bits.shape[1] // self.width <= MOST_TABLES:
                self.tables = self._enough(bits, near)
        if self.width == 0:
            self.width, self.tables = 1, 0
        used = max(1, math.ceil(self.width * self.tables / self.bits))
        self.rotations, self.medians = self.rotations[:used], self.medians[:used]
        self.reach = int(max(np.quantile((x[:, : self.bits] ^ bits[:, : self.bits]).sum(axis=1), 1 - TAIL) for x in near)) + 1

    @staticmethod
    def _towards(x: np.ndarray, y: np.ndarray, cosine: float) -> np.ndarray:
        """Unit vectors at ``cosine`` from those of ``x``, on the side of ``y``."""
        away = y - (x * y).sum(axis=1, keepdims=True) * x
        size = np.linalg.norm(away, axis=1, keepdims=True)
        return cosine * x + math.sqrt(1 - cosine * cosine) * np.divide(away, size, out=np.zeros_like(away), where=size > 1e-12)

    def _learn(self, flat: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        rotation = np.linalg.qr(rng.standard_normal((self.bits, self.bits)))[0]
        for _ in range(ROTATION_STEPS):
            u, _, v = np.linalg.svd(np.where(flat @ rotation > 0, 1.0, -1.0).T @ flat)
            rotation = (u @ v).T
        return rotation

    def _enough(self, bits: np.ndarray, near: list[np.ndarray]) -> int:
        """The least number of tables in which RECALL of both kinds of pairs meet; 0 if there are too few."""
        tables = min(MOST_TABLES, bits.shape[1] // self.width)
        most = 0
        for other in near:
            same = (bits ^ other)[:, : tables * self.width].reshape(len(bits), tables, self.width)
            met = np.logical_or.accumulate(~same.any(axis=2), axis=1).mean(axis=0)
            if not len(met) or met[-1] < RECALL:
                return 0
            most = max(most, int(np.argmax(met >= RECALL)) + 1)
        return most

    def __call__(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys (one a table, tagged with its number; one for all if there is no table) and code (two longs) of unit vectors, shorter ones filled with zeros."""
        flat = np.zeros((len(vectors), self.size))
        flat[:, : vectors.shape[1]] = vectors
        flat = (flat - self.mean) @ self.axes
        bits = np.concatenate([flat @ r > m for r, m in zip(self.rotations, self.medians, strict=True)], axis=1)
        keys = np.zeros((len(vectors), max(1, self.tables)), dtype=np.int64)
        for t in range(self.tables):
            keys[:, t] = bits[:, t * self.width : (t + 1) * self.width] @ (1 << np.arange(self.width, dtype=np.int64)) + (t << 48)
        code = np.zeros((len(vectors), MOST_BITS), dtype=bool)
        code[:, : self.bits] = bits[:, : self.bits]
        return keys, np.packbits(code, axis=1).view(">i8").astype(np.int64)


def _rows(column: pa.Array) -> list[np.ndarray]:
    """Vectors packed as bytes of doubles."""
    return [np.frombuffer(x, dtype=np.float64) for x in column.to_pylist()]


def units(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``__id`` and ``__unit`` (bytes of doubles) of every row: its vector at length 1, or null where it is null, empty or zero or holds null or non-finite components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for values in batch.column(1):
                row = None if not values.is_valid or values.values.null_count else unit(values.values.to_numpy(zero_copy_only=False).astype(np.float64))
                made.append(None if row is None else (row + 0.0).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["__id", "__unit"])

    source = df.select(F.col(quoted(id_col)).alias("__id"), F.col(quoted(vector_col)).alias("__vector"))
    few_at_once(df.sparkSession)
    return source.mapInArrow(run, T.StructType([source.schema[0], T.StructField("__unit", T.BinaryType())]))


def fit(vectors: DataFrame, cosine: float) -> Codes | None:
    """Codes fitted on the units of a bounded sample of ``vectors`` (by a hash, so that any run takes the same), with keys for their number; None if there are none."""
    count, size = vectors.agg(F.count("unit"), F.max(F.length("unit"))).first()
    if not count:
        return None
    most = max(64, min(SAMPLE, SAMPLE_NUMBERS * 8 // size))
    taken = vectors.where(F.pmod(F.xxhash64("unit"), F.lit(1 << 40)) < F.lit(min(1 << 40, (1 << 40) * most * 5 // (4 * count)))).select("unit").limit(2 * most)
    rows = [np.frombuffer(x, dtype=np.float64) for x in sorted(bytes(r[0]) for r in taken.collect())]
    if not rows:
        rows = [np.frombuffer(vectors.select("unit").first()[0], dtype=np.float64)]
    sample = np.stack([np.pad(r, (0, size // 8 - len(r))) for r in rows])
    return Codes(sample, count, cosine)


def coded(vectors: DataFrame, codes: Codes) -> DataFrame:
    """``vectors`` (node, unit, n, least) with ``keys`` and ``code`` (arrays of longs)."""
    longs = T.ArrayType(T.LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _rows(batch.column(batch.schema.get_field_index("unit")))
            flat = np.zeros((len(rows), codes.size))
            for k, row in enumerate(rows):
                flat[k, : len(row)] = row
            keys, code = codes(flat)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(keys), pa.list_(pa.int64())), pa.array(list(code), pa.list_(pa.int64()))], names=[*batch.schema.names, "keys", "code"])

    return vectors.mapInArrow(run, T.StructType([*vectors.schema.fields, T.StructField("keys", longs), T.StructField("code", longs)]))


def _cosines(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Cosines of pairs of unit vectors; of vectors of different sizes -1."""
    sizes = np.array([len(x) if len(x) == len(y) else 0 for x, y in zip(a, b, strict=True)])
    found = np.full(len(a), -1.0)
    for size in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == size)
        found[at] = np.einsum("ij,ij->i", np.stack([a[k] for k in at]), np.stack([b[k] for k in at]))
    return found


def with_cosine(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """``pairs`` (a, b, both nodes) with ``cosine``, from the whole original vectors."""
    units_of = lambda c: vectors.select(F.col("node").alias(c), F.col("unit").alias(f"__{c}"))
    both = pairs.join(units_of("b"), "b").join(units_of("a"), "a").select(*pairs.columns, "__a", "__b")
    kept = len(pairs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _cosines(_rows(batch.column(kept)), _rows(batch.column(kept + 1)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:kept], pa.array(found)], names=[*batch.schema.names[:kept], "cosine"])

    return both.mapInArrow(run, T.StructType([*pairs.schema.fields, T.StructField("cosine", T.DoubleType())]))


def _few(table: DataFrame) -> DataFrame:
    """A written table of keys, to be sent to every executor if it has MOST_SENT rows at most."""
    return F.broadcast(table) if table.count() <= MOST_SENT else table


def crowds(vectors: DataFrame, cosine: float) -> DataFrame:
    """``node``, ``crowd`` and ``cosine`` (to the crowd's vector) of vectors in crowds: each is linked to the vector ``crowd``.

    In every bucket of over CROWDED vectors one is drawn, the least by a mix of its node with the round's number, and vectors of the bucket that link with it may join it. Each takes, of those so near that the angle alone links all who join, else of all, the least again, so that buckets of one group agree on few drawn ones. Joined vectors leave the buckets, and the next round looks at those that are still full. No pairs but those with drawn vectors are made.
    """
    half = math.cos(math.acos(cosine) / 2) + SLACK
    free, found = vectors, None
    for turn in range(CROWD_ROUNDS):
        mix = F.lit((turn * 0x5DEECE66D1234567) & ((1 << 63) - 1))
        index = free.select("node", F.explode("keys").alias("key"))
        drawn = F.min(F.col("node").bitwiseXOR(mix)).bitwiseXOR(mix)
        full = write_table(index.groupBy("key").agg(F.count(F.lit(1)).alias("n"), drawn.alias("b")).where(F.col("n") > CROWDED).select("key", "b"), "full")
        if full.isEmpty():
            break
        pairs = index.join(_few(full), "key").select(F.col("node").alias("a"), "b").distinct()
        near = with_cosine(pairs, vectors).where(F.col("cosine") >= cosine)
        best = near.groupBy("a").agg(F.min(F.struct((F.col("cosine") < half).alias("far"), F.col("b").bitwiseXOR(mix).alias("drawn"), "cosine")).alias("best"))
        joined = write_table(best.select(F.col("a").alias("node"), F.col("best.drawn").bitwiseXOR(mix).alias("crowd"), F.col("best.cosine").alias("cosine")), "joined")
        large = joined.groupBy("crowd").count().where(F.col("count") >= LEAST_CROWD).select("crowd")
        joined = write_table(joined.join(large, "crowd", "left_semi").select("node", "crowd", "cosine"), "joined")
        found = joined if found is None else found.unionByName(joined)
        free = free.join(joined.select("node"), "node", "left_anti")
    return found if found is not None else vectors.sparkSession.createDataFrame([], "node long, crowd long, cosine double")


def pairs_of_few(singles: DataFrame, reach: int) -> DataFrame:
    """Pairs (a, b) of nodes that meet in a table and whose codes differ in at most ``reach`` bits. Buckets of over SIDE vectors are cut, and every two of their parts meet in a task of their own."""
    index = singles.select("node", F.col("code")[0].alias("hi"), F.col("code")[1].alias("lo"), F.explode("keys").alias("key"))
    full = write_table(index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SIDE), "full")
    if full.isEmpty():
        cut = index.select("*", F.lit(0).alias("part"), F.lit(0).alias("other"))
    else:
        parts = F.coalesce(F.ceil(F.col("n") / SIDE).cast("int"), F.lit(1))
        cut = index.join(_few(full), "key", "left").withColumn("part", F.pmod(F.xxhash64("node"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    cut = cut.select("key", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", "node", "hi", "lo")
    left = cut.select("key", "p", "q", F.col("part").alias("a_part"), F.col("node").alias("a"), F.col("hi").alias("a_hi"), F.col("lo").alias("a_lo"))
    right = cut.select("key", "p", "q", F.col("part").alias("b_part"), F.col("node").alias("b"), F.col("hi").alias("b_hi"), F.col("lo").alias("b_lo"))
    differ = F.bit_count(F.col("a_hi").bitwiseXOR(F.col("b_hi"))) + F.bit_count(F.col("a_lo").bitwiseXOR(F.col("b_lo")))
    met = left.join(right, ["key", "p", "q"]).where((F.col("a") < F.col("b")) & (F.least("a_part", "b_part") == F.col("p")) & (F.greatest("a_part", "b_part") == F.col("q")) & (differ <= reach))
    return met.select("a", "b").distinct()


def _cells(left: DataFrame, right: DataFrame, cosine: float, both: bool) -> DataFrame:
    """``node``, ``add`` and ``crowd`` of vectors with links across the two sides of each crowd: sides (crowd, node, n, unit, whole) are cut to about SIDE vectors by a hash, and each two parts are multiplied in a task of their own. ``add`` counts rows linked in one part. Right vectors are counted if ``both`` or ``whole``."""
    sizes = lambda side, name: side.groupBy("crowd").agg(F.ceil(F.count(F.lit(1)) / SIDE).cast("int").alias(name))
    parts = write_table(sizes(left, "l").join(sizes(right, "r"), "crowd"), "parts")
    own = lambda c: F.pmod(F.xxhash64("node"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    keep = ["crowd", "node", "n", "unit", "whole"]
    laid = left.join(_few(parts), "crowd").select(*keep, F.lit(0).alias("side"), own("l").alias("i"), every("r").alias("j"))
    laid = laid.unionByName(right.join(_few(parts), "crowd").select(*keep, F.lit(1).alias("side"), own("r").alias("j"), every("l").alias("i")))

    def product(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        node, n, whole = (table.column(c).to_numpy(zero_copy_only=False) for c in ("node", "n", "whole"))
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        rows = np.stack(_rows(table.column("unit").combine_chunks()))
        linked = (rows[a] @ rows[b].T >= cosine) & (node[a][:, None] != node[b][None, :])
        counted = b if both else b[whole[b].astype(bool)]
        nodes = np.concatenate([node[a], node[counted]])
        adds = np.concatenate([linked @ n[b], (n[a] @ linked)[np.isin(b, counted)]])
        some = adds > 0
        return pa.table({"node": nodes[some], "add": adds[some].astype(np.int64), "crowd": np.repeat(table.column("crowd")[0].as_py(), some.sum()).astype(np.int64)})

    return laid.groupBy("crowd", "i", "j").applyInArrow(product, "node long, add long, crowd long")


def near_vectors(df: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id_col``, ``n_links`` (other rows linked directly), ``component_id`` (the smallest id that links reach, the own included) and ``kept`` (whether it is the own) of every row.

    Links are pairs of cosine ``cosine`` or more, in doubles, among vectors of one size. Null, empty and zero vectors and those with null or non-finite components link with nothing and are kept. Rows of one vector (up to length) are linked; they are one node with their number, so that their pairs are never made. Crowds are found first (``crowds``): vectors near enough to the crowd's to be linked by the angle alone are counted without products, others by blocks of products, with the crowd and with what meets it in a table. All else meets by keys, then by codes, then by vectors. Null ids take part; the smallest id that isn't null names the class. Empty tables give no rows; other columns are not read. The pairs found are those that the tables make meet (``Codes``), every found one is exact.
    """
    if not 0.5 < cosine <= 1:
        raise ValueError(f"cosine {cosine} isn't over 0.5 and at most 1")
    rows = write_table(units(df, id_col, vector_col).withColumn("__copy", F.unhex(F.md5("__unit"))), "units")
    nodes = rows.where("__unit is not null").groupBy(F.col("__unit").alias("unit")).agg(F.count(F.lit(1)).alias("n"), F.min("__id").alias("least"))
    vectors = write_table(nodes.select(F.monotonically_increasing_id().alias("node"), "unit", "n", "least"), "vectors")
    codes = fit(vectors, cosine)
    alone = rows.where("__unit is null").select(F.col("__id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("__id").alias("component_id"), F.lit(True).alias("kept"))
    if codes is None:
        return alone
    found = write_table(coded(vectors, codes), "coded")
    drop_table(vectors)
    members = write_table(crowds(found, cosine).join(found, "node").select("crowd", "node", "cosine", "n", "unit", "keys"), "members")
    singles = found.join(members.select("node"), "node", "left_anti")
    links = write_table(with_cosine(pairs_of_few(singles, codes.reach), found).where(F.col("cosine") >= cosine).select("a", "b"), "links")
    counts = [links.select(F.col(x).alias("node"), F.col(y).alias("other")).join(found.select(F.col("node").alias("other"), F.col("n").alias("add")), "other").select("node", "add") for x, y in (("a", "b"), ("b", "a"))]
    edges = [links]
    if not members.isEmpty():
        more, joined = _crowd_links(found, members, singles, cosine)
        counts += more
        edges += joined
    total = counts[0]
    for some in counts[1:]:
        total = total.unionByName(some)
    total = total.groupBy("node").agg(F.sum("add").alias("add"))
    joined = edges[0]
    for some in edges[1:]:
        joined = joined.unionByName(some)
    roots = smallest_reachable(joined).withColumnRenamed("root", "__root")
    classed = found.select("node", F.unhex(F.md5("unit")).alias("__copy"), "n", "least").join(total, "node", "left").join(roots, "node", "left").withColumn("__root", F.coalesce("__root", "node"))
    least = classed.groupBy("__root").agg(F.min("least").alias("component_id"))
    of_copy = classed.join(least, "__root").select("__copy", (F.col("n") - 1 + F.coalesce("add", F.lit(0))).alias("n_links"), "component_id")
    told = rows.where("__unit is not null").select("__id", "__copy").join(of_copy, "__copy")
    return alone.unionByName(told.select(F.col("__id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("__id") == F.col("component_id"), F.lit(False)).alias("kept")))


def _crowd_links(found: DataFrame, members: DataFrame, singles: DataFrame, cosine: float) -> tuple[list[DataFrame], list[DataFrame]]:
    """Counts (node, add) and edges (a, b) of links inside crowds and between them and others."""
    angle, half = math.acos(cosine), math.cos(math.acos(cosine) / 2) + SLACK
    inside = members.select("crowd", "node", "n", "unit", (F.col("cosine") >= half).alias("whole"))
    cores = inside.where("whole").groupBy("crowd").agg(F.sum("n").alias("core"))
    counts = [inside.where("whole").join(cores, "crowd").select("node", (F.col("core") - F.col("n")).alias("add"))]
    counts.append(_cells(inside.where("not whole"), inside, cosine, both=False).select("node", "add"))
    edges = [inside.select(F.col("node").alias("a"), F.col("crowd").alias("b"))]

    # what meets a crowd in a table: single vectors, and crowds of larger number with all they hold
    of_crowd = members.select("crowd", F.explode("keys").alias("key")).distinct()
    others = singles.select(F.col("node").alias("b"), F.explode("keys").alias("key"), F.lit(False).alias("is_crowd")).unionByName(of_crowd.select(F.col("crowd").alias("b"), "key", F.lit(True).alias("is_crowd")))
    met = write_table(of_crowd.withColumnRenamed("crowd", "a").join(others, "key").where("a < b or not is_crowd").select("a", "b", "is_crowd").distinct(), "met")
    width = members.groupBy("crowd").agg(F.acos(F.least(F.min("cosine"), F.lit(1.0))).alias("width"))
    a_width, b_width = (width.select(F.col("crowd").alias(c), F.col("width").alias(f"{c}_width")) for c in ("a", "b"))
    gap = F.acos(F.greatest(F.least("cosine", F.lit(1.0)), F.lit(-1.0)))
    near = with_cosine(met, found).join(a_width, "a").join(b_width, "b", "left")
    reach = angle + F.col("a_width") + F.when(F.col("is_crowd"), F.col("b_width")).otherwise(0.0) + SLACK
    near = write_table(near.where(gap <= reach).select("a", "b", "is_crowd"), "near")
    single = near.where("not is_crowd").select("a", "b")
    of_other = near.where("is_crowd").join(members.select(F.col("crowd").alias("b"), "node"), "b").select("a", F.col("node").alias("b"))
    close = with_cosine(of_other, found).join(a_width, "a").where(gap <= angle + F.col("a_width") + SLACK).select("a", "b")
    beside = write_table(single.unionByName(close).select(F.col("a").alias("crowd"), F.col("b").alias("node")).join(found.select("node", "n", "unit"), "node").select("crowd", "node", "n", "unit", F.lit(False).alias("whole")), "beside")
    across = write_table(_cells(inside, beside, cosine, both=True), "across")
    counts.append(across.select("node", "add"))
    edges.append(across.select(F.col("node").alias("a"), F.col("crowd").alias("b")))
    return counts, edges
