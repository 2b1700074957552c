"""Document fingerprints: invertible Bloom lookup sketches of hashed paragraph cells. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .batches import quoted

#: Longest paragraph cell in characters; longer lines are wrapped at white space.
WIDTH = 160
#: Cells of each of the three tables of a sketch, as first tried and in the retries, each four times as large.
TABLE, RETRIES = 8, (8, 32, 128, 512, 2048)
#: Digests of both versions that share a bucket in a retry, about.
BUCKET = 8
#: Rounds of peeling; each takes all cells that hold one digest.
ROUNDS = 12


def digests(text: Column, width: int = WIDTH) -> Column:
    """Distinct 64-bit digests of the paragraph cells of a text: its lines, long ones wrapped. Null and empty texts have none."""
    cells = F.regexp_extract_all(text, F.lit(rf"[^\n]{{0,{width - 1}}}[^\s](?=\s|$)|[^\n]{{{width}}}"), F.lit(0))
    return F.coalesce(F.array_distinct(F.transform(cells, lambda c: F.xxhash64(c))), F.array().cast("array<bigint>"))


def _check(k: Column) -> Column:
    return F.hash(k)


def placed(keys: Column, table: int = TABLE) -> Column:
    """Digests ``k`` with their check sum ``c``, their cell in each of three tables (a, b, d) and a hash ``r`` that deals them to buckets."""
    at = lambda k, t: F.pmod(F.xxhash64(k, F.lit(t)), F.lit(table)).cast("int")
    return F.transform(keys, lambda k: F.struct(k.alias("k"), _check(k).alias("c"), at(k, 0).alias("a"), at(k, 1).alias("b"), at(k, 2).alias("d"), F.xxhash64(k, F.lit(11)).alias("r")))


def _bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def sketch(keys: Column, table: int = TABLE) -> Column:
    """Of placed digests 3 * table cells (n, k, c), table by table: how many digests fall in, and the exclusive or of them and of their check sums."""
    empty = F.struct(F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("k"), F.lit(0).alias("c"))
    add = lambda s, p: F.struct((s["n"] + 1).alias("n"), s["k"].bitwiseXOR(p["k"]).alias("k"), s["c"].bitwiseXOR(p["c"]).alias("c"))
    cells = lambda t: F.transform(F.sequence(F.lit(0), F.lit(table - 1)), lambda i: F.aggregate(F.filter(keys, lambda p: p[t] == i), empty, add))
    return F.concat(cells("a"), cells("b"), cells("d"))


def subtract(a: Column, b: Column) -> Column:
    """The sketch of what is in one version and not in the other, n negative for what only ``b`` has."""
    return F.zip_with(a, b, lambda x, y: F.struct((x["n"] - y["n"]).alias("n"), x["k"].bitwiseXOR(y["k"]).alias("k"), x["c"].bitwiseXOR(y["c"]).alias("c")))


def peel(cells: Column, table: int = TABLE) -> Column:
    """The digests that differ, recovered from a difference of sketches: cells with one digest tell it, it is taken out of its other cells, and so on. Null if cells remain."""
    is_one = lambda c: (F.abs(c["n"]) == 1) & (c["c"] == _check(c["k"]))
    at = lambda k, t: F.pmod(F.xxhash64(k, F.lit(t)), F.lit(table)).cast("int")
    less = lambda c, p: F.struct((c["n"] - p["n"]).alias("n"), c["k"].bitwiseXOR(p["k"]).alias("k"), c["c"].bitwiseXOR(p["c"]).alias("c"))

    def told(state: Column) -> Column:
        ones = F.array_distinct(F.transform(F.filter(state["cells"], is_one), lambda c: F.struct(c["k"].alias("k"), c["n"].alias("n"))))
        return F.transform(ones, lambda o: F.struct(o["k"].alias("k"), o["n"].alias("n"), _check(o["k"]).alias("c"), at(o["k"], 0).alias("a"), at(o["k"], 1).alias("b"), at(o["k"], 2).alias("d")))

    def step(state: Column, ones: Column) -> Column:
        part = lambda n, t: F.transform(F.slice(state["cells"], 1 + n * table, table), lambda cell, i: F.aggregate(F.filter(ones, lambda p: p[t] == i), cell, less))
        return F.struct(F.concat(part(0, "a"), part(1, "b"), part(2, "d")).alias("cells"), F.concat(state["got"], F.transform(ones, lambda o: o["k"])).alias("got"), F.lit(True).alias("live"))

    def round_(state: Column, _: Column) -> Column:
        stop = F.struct(state["cells"].alias("cells"), state["got"].alias("got"), F.lit(False).alias("live"))
        return F.when(~state["live"], state).otherwise(_bound(told(state), lambda ones: F.when(F.size(ones) == 0, stop).otherwise(step(state, ones))))

    start = F.struct(cells.alias("cells"), F.array().cast("array<bigint>").alias("got"), F.lit(True).alias("live"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, round_, lambda s: F.when(F.forall(s["cells"], lambda c: (c["n"] == 0) & (c["k"] == 0) & (c["c"] == 0)), s["got"]))


def roots(a: Column, b: Column) -> Column:
    """The square root of the number of buckets for two versions' digests."""
    return F.greatest(F.lit(1), F.ceil(F.sqrt((F.size(a) + F.size(b)) / BUCKET))).cast("int")


def _in_buckets(a: Column, b: Column, root: Column) -> Column:
    """Pairs (a, b) of the placed digests of both versions that fall in the same bucket, dealt in two steps, so that long documents do not pay for every bucket with every digest."""
    pair = lambda x, y: F.struct(x.alias("a"), y.alias("b"))
    outer = lambda keys: F.transform(F.sequence(F.lit(0), root - 1), lambda g: F.filter(keys, lambda p: F.pmod(p["r"], root) == g))
    inner = lambda keys: F.transform(F.sequence(F.lit(0), root - 1), lambda g: F.filter(keys, lambda p: F.pmod(F.shiftright(p["r"], 32), root) == g))
    return F.flatten(F.transform(F.zip_with(outer(a), outer(b), pair), lambda o: F.zip_with(inner(o["a"]), inner(o["b"]), pair)))


def difference(a: Column, b: Column, sketch_a: Column, sketch_b: Column, root: Column) -> Column:
    """How many of the placed digests are in one of two versions only.

    The two fingerprints are subtracted and peeled first. If that fails, a larger sketch of both takes its place: ``root`` squared parts, each a sketch of the digests that a hash deals to it, subtracted and peeled by itself. A part that does not peel is made anew in ever larger tables, other hashes each time, until it does; one that defies the largest (about 16 digests in 6,144 cells) would fail the task.
    """
    only = lambda keys: F.transform(keys, lambda p: p["k"])

    def attempt(p: Column, table: int) -> Column:
        if table == TABLE:
            return F.array_size(peel(subtract(sketch(p["a"]), sketch(p["b"]))))
        return _bound(placed(only(p["a"]), table), lambda x: _bound(placed(only(p["b"]), table), lambda y: F.array_size(peel(subtract(sketch(x, table), sketch(y, table)), table))))

    def bucket(p: Column) -> Column:
        return F.coalesce(*(attempt(p, t) for t in RETRIES), F.raise_error(F.lit("a part of a sketch does not peel")).cast("int"))

    first = F.array_size(peel(subtract(sketch_a, sketch_b)))
    again = F.aggregate(_in_buckets(a, b, root), F.lit(0), lambda n, p: n + F.when(F.size(p["a"]) + F.size(p["b"]) == 0, 0).otherwise(bucket(p)))
    return F.coalesce(first, again)


def as_text(cells: Column) -> Column:
    """A sketch as a string: count, key and check sum of each cell in hexadecimal digits."""
    return F.array_join(F.transform(cells, lambda c: F.concat(F.hex(c["n"]), F.lit("."), F.hex(c["k"]), F.lit("."), F.hex(c["c"]))), ",")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``fingerprint`` of every whole text; equal texts have equal fingerprints, null and empty ones an empty sketch."""
    return df.select(F.col(quoted(id_col)).alias(id_col), as_text(_bound(placed(digests(F.col(quoted(text_col)))), sketch)).alias("fingerprint"))


def with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: Column | None = None) -> DataFrame:
    """``id_col``, ``text`` (null: empty), ``mark`` (of the columns id and text), and ``next_text`` and ``next_mark``, those of the row that follows by id; after the last comes the first.

    Rows are dealt to ranges of ids, whose limits are the only thing that comes to the driver, and each range is put in order by itself; what follows its last row is looked up. A null id comes first, rows with equal ids in the order of their texts.
    """
    spark = df.sparkSession
    rows = df.select(F.col(quoted(id_col)).alias("id"), F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("text"))
    mark = F.lit(None).cast("int") if mark is None else mark
    ranges = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    limits = rows.agg(F.percentile_approx("id", [k / ranges for k in range(1, ranges)], 100 * ranges)).first()[0] or []
    limits = F.array(*(F.lit(x).cast("bigint") for x in sorted(set(limits)))).cast("array<bigint>")
    rows = rows.withColumn("range", F.size(F.filter(limits, lambda x: x <= F.coalesce(F.col("id"), F.lit(-(1 << 63))))))
    order = W.partitionBy("range").orderBy("id", "text")
    marked = rows.withColumn("mark", mark)
    inner = marked.withColumns({"next_text": F.lead("text").over(order), "next_mark": F.lead("mark").over(order)}).where(F.col("next_text").isNotNull()).select("id", "text", "mark", "next_text", "next_mark")
    # one row for each range: its ends, by id and digest of the text, as ids may repeat
    ends = df.select(F.col(quoted(id_col)).alias("id")).withColumn("range", F.size(F.filter(limits, lambda x: x <= F.coalesce(F.col("id"), F.lit(-(1 << 63)))))).groupBy("range").agg(F.min(F.struct("id")).alias("low"), F.max(F.struct("id")).alias("high")).orderBy("range").collect()
    pairs = [(k, ends[k]["high"]["id"], ends[(k + 1) % len(ends)]["low"]["id"]) for k in range(len(ends))]
    pairs = spark.createDataFrame(pairs, "pair int, high bigint, low bigint")
    last = rows.join(F.broadcast(pairs), F.col("id").eqNullSafe(F.col("high"))).groupBy("pair").agg(F.max_by(F.struct("id", "text"), "text").alias("r"))
    first = rows.join(F.broadcast(pairs), F.col("id").eqNullSafe(F.col("low"))).groupBy("pair").agg(F.min("text").alias("next_text"))
    outer = last.join(first, "pair").select("r.id", "r.text", "next_text")
    outer = outer.select("id", "text", mark.alias("mark"), "next_text").withColumn("__own", F.col("text")).withColumn("text", F.col("next_text")).select("id", F.col("__own").alias("text"), "mark", "next_text", mark.alias("next_mark"))
    return inner.unionByName(outer).select(F.col("id").alias(id_col), "text", "mark", "next_text", "next_mark")


def compare_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text: the last quarter (rounded down) of its code points replaced by the first as many, or all, of the next text.

    Gives ``id_col``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited`` and ``near_next``: likeness to the edited and to the next text, the shared over all digests of both, from the count that differs; 1 for two texts without any.
    """
    rows = with_next(df, id_col, text_col, digests(F.col("text"))).withColumn("n_chars", F.length("text").cast("bigint")).withColumn("__q", F.floor(F.col("n_chars") / 4).cast("int"))
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - F.col("__q")), F.substring("next_text", F.lit(1), F.col("__q"))))
    rows = rows.select(id_col, "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.col("mark").alias("a"), digests(F.col("edited")).alias("b"), F.col("next_mark").alias("c"))
    rows = rows.withColumns({x: placed(F.col(x)) for x in "abc"}).withColumns({f"sketch_{x}": sketch(F.col(x)) for x in "abc"} | {f"root_{x}": roots(F.col("a"), F.col(x)) for x in "bc"})
    rows = rows.withColumns({f"apart_{x}": difference(F.col("a"), F.col(x), F.col("sketch_a"), F.col(f"sketch_{x}"), F.col(f"root_{x}")) for x in "bc"})

    def near(x: str) -> Column:
        both = F.size("a") + F.size(x)
        return F.when(both == 0, 1.0).otherwise((both - F.col(f"apart_{x}")) / (both + F.col(f"apart_{x}")))

    return rows.select(id_col, "n_chars", "edited_sha256", as_text(F.col("sketch_a")).alias("fingerprint"), as_text(F.col("sketch_b")).alias("edited_fingerprint"), near("b").alias("near_edited"), near("c").alias("near_next"))
