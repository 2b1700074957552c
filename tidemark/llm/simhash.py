"""SimHash near-dedup by deletion-variant signatures; near copies that fingerprints do not show by prefixes of shingle sets."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import few_at_once, map_texts, quoted, slices
from ..operators.components import dealt, smallest_reachable
from ..scratch import drop_table, write_table

BITS = 64
#: Of near copies: the share of a set that is kept to count shingles and take prefixes from; a prefix needs a fifth of the set at 0.8, and as much again may be common.
LEAD = 0.45
#: Keys (24 bytes) that are sent to every executor at most; more are joined by a shuffle.
MOST_SENT = 250_000
#: Classes in which the shingles of a text are counted, to bound the overlap of two texts.
CLASSES = 256
#: Room for rounding where a bound decides which texts meet.
SLACK = 1e-6
#: Shingle hashes unpacked into bits at once.
VOTES_AT_ONCE = 1 << 16


def shingle_hashes(text: bytes, width: int, seed: int) -> np.ndarray:
    """XXH64 of the shingles of ``width`` words of one text in UTF-8, in their order, with repeats: words between ASCII white space with A-Z lowered; fewer words are one shingle."""
    import xxhash

    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, seed)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = [0, *(ends[:-width] + 1).tolist()]
    return np.array([digest(joined[i:j], seed) for i, j in zip(starts, ends[width - 1 :].tolist(), strict=True)], dtype=np.uint64)


def votes_of(hashes: np.ndarray) -> int:
    """The SimHash of hashes: the bits set in over half of them."""
    votes = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), VOTES_AT_ONCE):
        some = hashes[at : at + VOTES_AT_ONCE].astype(">u8")
        votes += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(hashes)).tobytes(), "big")


def fingerprint_of(text: bytes, width: int, seed: int) -> int:
    """SimHash of one text over its shingles with repeats."""
    return votes_of(shingle_hashes(text, width, seed))


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Distinct hashes of the shingles of one text, in order."""
    return np.unique(shingle_hashes(text, width, 0).view(np.int64))


def _kernel(width: int, seed: int):
    def run(texts: list[bytes]) -> list:
        found = np.array([fingerprint_of(x, width, seed) for x in texts], dtype=np.uint64)
        return [found.view(np.int64)]

    return run


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42, keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, the columns ``keep`` and ``simhash`` (64 bits in a long) of every whole text.

    Null, empty and blank texts get 0; a text of fewer than ``width`` words has its whole sequence as one shingle.
    """
    return map_texts(df, lambda: _kernel(width, seed), [("simhash", T.LongType(), pa.int64())], text_col, (id_col, *keep))


def _variants(value: Column, segments: int) -> Column:
    """Signatures: for each segment and each of its bits, the segment without that bit, tagged with both.

    Segments have 32 bits or fewer, so that tag and value fit a long without hashing.
    """
    made, low = [], 0
    for s in range(segments):
        size = BITS // segments + (s < BITS % segments)
        part = F.shiftrightunsigned(value, low).bitwiseAND(F.lit((1 << size) - 1))
        made += [part.bitwiseAND(F.lit((1 << size) - 1 - (1 << i))).bitwiseOR(F.lit((s * BITS + i) << 32)) for i in range(size)]
        low += size
    return F.array(*made)


def _ball(value: Column) -> Column:
    """The value and all that differ from it in one bit."""
    return F.array(value, *[value.bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(BITS)])


def links(values: DataFrame, bucket: int = 8) -> DataFrame:
    """Links (a, b) between representatives, so that their transitive closure joins all values that differ in at most 2 bits; a link may come more than once.

    ``values`` has distinct ``simhash`` with ``rep``. Two values at 2 bits or fewer have, of 2 segments, one that differs in at most 1 bit, hence a common one-wildcard variant of it. Variants with at most ``bucket`` values are joined on equality and verified. Values in fuller variants need another way that makes no pairs: two values differ in at most 2 bits exactly if some value is at most 1 bit from both, so each is linked to the smallest representative around every such point. Both ways are exact.
    """
    index = values.select("rep", "simhash", F.explode(_variants(F.col("simhash"), 2)).alias("variant"))
    sizes = index.groupBy("variant").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = write_table(index.join(dealt(sizes), "variant"), "variants")
    few = members.where(F.col("n") <= bucket).select("variant", "rep", "simhash")
    other = few.select("variant", F.col("rep").alias("b"), F.col("simhash").alias("other"))
    near = few.withColumnRenamed("rep", "a").join(dealt(other), "variant").where((F.col("a") < F.col("b")) & (F.bit_count(F.col("simhash").bitwiseXOR(F.col("other"))) <= 2)).select("a", "b")
    crowded = members.where(F.col("n") > bucket).select("rep", "simhash").distinct()
    points = crowded.select("rep", F.explode(_ball(F.col("simhash"))).alias("point"))
    centres = points.groupBy("point").agg(F.min("rep").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").select("point", "a")
    around = points.join(dealt(centres), "point").where("a < rep").select("a", F.col("rep").alias("b"))
    return near.unionByName(around)


def near_duplicate_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """``id_col``, ``simhash`` and ``component_id``: the smallest id reachable over links of at most 2 differing bits.

    Equal fingerprints are linked, those of texts without words (0) included. Repeated rows keep their number; rows with a null id take part through their text and get the smallest id that isn't null, or null if there is none. An empty table gives an empty result; other columns are not read.
    """
    marks = write_table(fingerprints(df, id_col, text_col, width, seed).withColumnRenamed(id_col, "__id"), "simhash")
    values = write_table(marks.groupBy("simhash").agg(F.min("__id").alias("least")), "values")
    roots = smallest_reachable(links(values.select(F.col("simhash").alias("rep"), "simhash")))
    rooted = values.join(dealt(roots.withColumnRenamed("node", "simhash")), "simhash", "left").withColumn("root", F.coalesce("root", "simhash"))
    classes = rooted.join(dealt(rooted.groupBy("root").agg(F.min("least").alias("component_id"))), "root").select("simhash", "component_id")
    return marks.join(dealt(classes), "simhash").select(F.col("__id").alias(id_col), "simhash", "component_id")


def keyed(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with the key of its rows: ``__copy``, a digest of the text (null: the empty one), and ``__row``, a hash of all columns. Rows with one key are equal, or copies of one text at least."""
    return df.withColumns({"__copy": F.unhex(F.md5(F.coalesce(F.col(quoted(text_col)), F.lit("")))), "__row": F.xxhash64(*(F.col(quoted(c)) for c in df.columns))})


def joined_with_few(rows: DataFrame, few: DataFrame, on: list[str], how: str) -> DataFrame:
    """Rows joined with a table of keys, which goes to every executor if it has MOST_SENT rows at most, so that texts stay where they are; else both sides are dealt by the keys."""
    return rows.join(F.broadcast(few) if few.count() <= MOST_SENT else dealt(few), on, how)


def distinct_texts(rows: DataFrame, width: int) -> DataFrame:
    """One row for each distinct text of ``rows`` (``__id``, ``__row``, ``__copy``, ``__text``): ``node`` (a number), ``copy``, ``first`` (the least of its rows: whether the id is null, the id and the hash of the row), ``size`` (distinct shingles), ``lead`` (the hashes of the first LEAD of them), ``counts`` (shingles by the last bits of their hashes; null if one is over 127) and ``simhash``. Texts themselves are not moved; a task looks at a copy of what it has seen once."""
    ids = rows.select("__id", "__row").schema

    def run(batches):
        seen = set()
        for batch in batches:
            for part, texts in slices(batch, 3):
                copies = part.column(2).to_pylist()
                sizes, leads, counts, marks = ([None] * len(texts) for _ in range(4))
                for k, (copy, text) in enumerate(zip(copies, texts, strict=True)):
                    if copy not in seen:
                        seen.add(copy)
                        hashes = shingle_hashes(text, width, 0)
                        shingles = np.unique(hashes.view(np.int64))
                        sizes[k], leads[k] = len(shingles), shingles[: math.ceil(LEAD * len(shingles))]
                        of_class = np.bincount(shingles & (CLASSES - 1), minlength=CLASSES)
                        counts[k] = of_class.astype(np.int8) if of_class.max() < 128 else None
                        marks[k] = int(np.uint64(votes_of(hashes)).astype(np.int64))
                made = [pa.array(sizes, pa.int32()), pa.array(leads, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int8())), pa.array(marks, pa.int64())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), *made], names=["__id", "__row", "__copy", "size", "lead", "counts", "simhash"])
        pa.default_memory_pool().release_unused()

    kinds = [("__copy", T.BinaryType()), ("size", T.IntegerType()), ("lead", T.ArrayType(T.LongType())), ("counts", T.ArrayType(T.ByteType())), ("simhash", T.LongType())]
    looked = rows.select("__id", "__row", "__copy", "__text").mapInArrow(run, T.StructType([*ids, *(T.StructField(*k) for k in kinds)]))
    first = F.min(F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), F.col("__row").alias("row"))).alias("first")
    texts = looked.groupBy("__copy").agg(first, F.max("size").alias("size"), F.first("lead", True).alias("lead"), F.first("counts", True).alias("counts"), F.max("simhash").alias("simhash"))
    return write_table(texts.select(F.monotonically_increasing_id().alias("node"), F.col("__copy").alias("copy"), "first", "size", "lead", "counts", "simhash"), "texts")


def sets_of(nodes: DataFrame, texts: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """``node`` and ``shingles`` (the whole set, in order) of those texts, from the first row of each, written to the shared folder."""
    wanted = write_table(texts.join(dealt(nodes), "node", "left_semi").select("node", F.col("copy").alias("__copy"), F.col("first.row").alias("__row")), "wanted")
    few = joined_with_few(rows.select("__copy", "__row", "__text"), wanted, ["__copy", "__row"], "inner").dropDuplicates(["node"])
    sets = write_table(map_texts(few, lambda: lambda x: [[shingle_set(t, width) for t in x]], [("shingles", T.ArrayType(T.LongType()), pa.list_(pa.int64()))], "__text", ("node",)), "sets")
    drop_table(wanted)
    return sets


def prefixes(texts: DataFrame, rows: DataFrame, width: int, at_least: float, bucket: int) -> DataFrame:
    """``node``, ``size`` and ``prefix`` of every text: the first shingles of its set in an order that is the same for all sets, so many that two sets of a likeness of ``at_least`` have one of them in common.

    Common shingles, those in the leads of more than ``bucket`` texts, come last, the most common at the end; all others go by their hashes. So a passage that many texts share is in the prefixes of those only that hold little else. Where the lead has too few others, the whole set is put in order.
    """
    lead = texts.select("node", F.explode("lead").alias("shingle"))
    common = write_table(lead.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket), "common")
    late = lambda held: joined_with_few(held, common, ["shingle"], "inner").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "shingle"))).alias("late"))
    length = (F.col("size") - F.ceil(at_least * F.col("size") - SLACK) + 1).cast("int")
    last = F.coalesce("late.shingle", F.array().cast("array<long>"))
    own = F.slice(F.array_except("lead", last), F.lit(1), length)
    made = write_table(texts.where("size > 0").select("node", "size", "lead").join(dealt(late(lead)), "node", "left").select("node", "size", own.alias("prefix"), (F.size(own) < length).alias("short")), "prefixes")
    short = made.where("short").select("node", "size")
    sets = sets_of(short, texts, rows, width)
    whole = sets.join(dealt(short), "node").join(dealt(late(sets.select("node", F.explode("shingles").alias("shingle")))), "node", "left")
    ordered = F.concat(F.array_except("shingles", last), last)
    return made.where("not short").select("node", "size", "prefix").unionByName(whole.select("node", "size", F.slice(ordered, F.lit(1), length).alias("prefix")))


def alike(pairs: DataFrame, texts: DataFrame, rows: DataFrame, width: int, at_least: float) -> DataFrame:
    """Those of ``pairs`` (a, b; nodes of ``texts``) whose whole sets of shingles have a likeness of ``at_least``, written to the shared folder. Two sets have no more in common than the sum over classes of hashes of the lesser count: pairs that cannot be alike by that go first."""
    of = lambda name: texts.select(F.col("node").alias(name), F.struct("size", "counts").alias(f"of_{name}"))
    most = F.coalesce(F.aggregate(F.zip_with("of_a.counts", "of_b.counts", lambda x, y: F.least(x, y)), F.lit(0), lambda n, x: n + x), F.least("of_a.size", "of_b.size"))
    bounded = pairs.distinct().join(dealt(of("a")), "a").join(dealt(of("b")), "b").withColumn("most", most)
    pairs = write_table(bounded.where(F.col("most") >= at_least * (F.col("of_a.size") + F.col("of_b.size") - F.col("most")) - SLACK).select("a", "b"), "pairs")
    sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), texts, rows, width)
    side = lambda name: sets.select(F.col("node").alias(name), F.col("shingles").alias(f"of_{name}"))
    both = pairs.join(dealt(side("a")), "a").join(dealt(side("b")), "b").withColumn("shared", F.size(F.array_intersect("of_a", "of_b")))
    links = write_table(both.where(F.col("shared") >= at_least * (F.size("of_a") + F.size("of_b") - F.col("shared")) - SLACK).select("a", "b"), "links")
    for done in (pairs, sets):
        drop_table(done)
    return links


def apart_alike(members: DataFrame, texts: DataFrame, rows: DataFrame, width: int, at_least: float) -> DataFrame:
    """Pairs (a, b), among them all alike texts of different classes (``own``) that have a reference in common; ``members`` has ``ref``, ``node``, ``own``, ``ref_own``.

    Let d(x) be the shingles that x or the reference has and the other hasn't. Two sets x and y differ by d(x) less d(y) and d(y) less d(x), and are alike exactly if that is at most a share (1 - at_least) / (1 + at_least) of their sizes together, so d(x) and d(y) must have in common half of what their sizes exceed it by. The same share tells which texts are alike to the reference: two that are meet in it. Where x is not, d(x) exceeds the share of x and the reference, hence any y alike to it has over (d(y) - share * (size of y - size of the reference)) / 2 of d(x): each d has a prefix of which one shingle must be in the other's. Rare ones come first, so copies of one text that were edited apart have their own edits there and make no pairs.
    """
    share = (1 - at_least) / (1 + at_least)
    sets = sets_of(members.select(F.explode(F.array("node", "ref")).alias("node")).distinct(), texts, rows, width)
    of_ref = sets.select(F.col("node").alias("ref"), F.col("shingles").alias("of_ref"))
    apart = F.concat(F.array_except("shingles", "of_ref"), F.array_except("of_ref", "shingles"))
    held = members.join(dealt(sets), "node").join(dealt(of_ref), "ref").select("ref", "node", "own", "ref_own", F.size("shingles").alias("size"), F.size("of_ref").alias("ref_size"), apart.alias("apart"))
    held = write_table(held.withColumn("gap", F.size("apart")).withColumn("far", F.col("gap") > share * (F.col("size") + F.col("ref_size")) + SLACK), "apart")
    least = F.greatest(F.lit(1), F.ceil((F.col("gap") - share * F.when(F.col("far"), F.col("size") + F.col("ref_size")).otherwise(F.col("size") - F.col("ref_size"))) / 2 - SLACK))

    parts = held.select("ref", "node", F.explode("apart").alias("shingle"))
    often = parts.groupBy("ref", "shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    late = parts.join(dealt(often), ["ref", "shingle"]).groupBy("ref", "node").agg(F.sort_array(F.collect_list(F.struct("n", "shingle"))).alias("late"))
    placed = held.join(dealt(late), ["ref", "node"]).withColumn("first", F.col("gap") - F.size("late"))
    prefix = F.slice("late.shingle", F.lit(1), F.greatest(F.col("gap") - least + 1 - F.col("first"), F.lit(0)).cast("int"))
    index = write_table(placed.select("ref", "node", "own", "size", "gap", "far", "first", F.posexplode(prefix).alias("at", "shingle")).withColumn("pos", F.col("first") + F.col("at")).drop("first", "at"), "index")
    other = index.select("ref", "shingle", *(F.col(c).alias(f"other_{c}") for c in ("node", "own", "size", "gap", "far", "pos")))
    needed = F.greatest(F.lit(1), (F.col("gap") + F.col("other_gap") - share * (F.col("size") + F.col("other_size"))) / 2 - SLACK)
    fits = F.least(F.col("gap") - F.col("pos"), F.col("other_gap") - F.col("other_pos")) >= needed
    met = index.join(dealt(other), ["ref", "shingle"]).where((F.col("node") < F.col("other_node")) & (F.col("own") != F.col("other_own")) & (F.col("far") | F.col("other_far")) & fits)
    beside = held.where("not far and own <> ref_own").select(F.least("ref", "node").alias("a"), F.greatest("ref", "node").alias("b"))
    pairs = write_table(met.select(F.col("node").alias("a"), F.col("other_node").alias("b")).unionByName(beside).distinct(), "pairs")
    for done in (sets, held, index):
        drop_table(done)
    return pairs


def alike_links(texts: DataFrame, rows: DataFrame, width: int = 5, at_least: float = 0.8, bucket: int = 16) -> DataFrame:
    """Links (a, b) between nodes of ``texts`` whose transitive closure joins all texts with a likeness of ``at_least``; all are measured on whole sets of shingles.

    First come SimHashes: nodes with equal fingerprints, or with fingerprints that their deletion variants link (``links``), if they are alike. A fingerprint says little about pairs that are just alike, so all others are found by prefixes of the sets: two sets that are alike share a shingle of both prefixes, and at the first that they share what follows must be long enough for the overlap (``fits``). A shingle before which all its texts share the same one goes: its pairs meet there. Shingles of at most ``bucket`` prefixes pair all their texts. In a more common one all texts meet its centre, the text with the fewest rarer shingles. Where its texts are of several classes after that, they are held against one of them by what sets it apart from each (``apart_alike``), so that a crowd of texts that differ makes no pairs. Pairs that are of one class already are not measured.
    """
    worded = texts.where("size > 0")
    reps = write_table(worded.groupBy("simhash").agg(F.min("node").alias("rep")), "values")
    same = worded.join(dealt(reps), "simhash").where("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    found = alike(same.unionByName(links(reps)), texts, rows, width, at_least)
    roots = smallest_reachable(found)

    index = write_table(prefixes(texts, rows, width, at_least, bucket).select("node", "size", F.posexplode("prefix").alias("pos", "shingle")), "index")
    counts = index.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    before = F.lag("shingle").over(Window.partitionBy("node").orderBy("pos"))
    shared = write_table(index.join(dealt(counts), "shingle").withColumn("before", before), "shared")
    first = shared.groupBy("shingle").agg((F.count("before") == F.count(F.lit(1))).alias("all"), F.min("before").alias("low"), F.max("before").alias("high")).where("not all or low <> high").select("shingle")
    named = roots.withColumnRenamed("root", "own")
    members = write_table(shared.drop("before").join(dealt(first), "shingle").join(dealt(named), "node", "left").withColumn("own", F.coalesce("own", "node")), "members")
    drop_table(shared)
    share = at_least / (1 + at_least)

    def fits(one: str, other: str) -> Column:
        return F.least(F.col(f"{one}size") - F.col(f"{one}pos"), F.col(f"{other}size") - F.col(f"{other}pos")) >= share * (F.col(f"{one}size") + F.col(f"{other}size")) - SLACK

    pair = lambda a, b: [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]
    few = members.where(F.col("n") <= bucket).select("shingle", "node", "size", "pos", "own")
    others = few.select("shingle", *(F.col(c).alias(f"other_{c}") for c in few.columns if c != "shingle"))
    near = few.join(dealt(others), "shingle").where((F.col("node") < F.col("other_node")) & (F.col("own") != F.col("other_own")) & fits("", "other_")).select(*pair("node", "other_node"))
    many = members.where(F.col("n") > bucket).select("shingle", "node", "size", "pos", "own")
    centres = many.groupBy("shingle").agg(F.min(F.struct("pos", "node", "size", "own")).alias("c")).select("shingle", *(F.col(f"c.{c}").alias(f"other_{c}") for c in ("pos", "node", "size", "own")))
    centred = write_table(many.join(dealt(centres), "shingle"), "crowd")
    around = centred.where((F.col("own") != F.col("other_own")) & fits("", "other_")).select(*pair("node", "other_node"))
    found = write_table(found.unionByName(alike(near.unionByName(around), texts, rows, width, at_least)), "links")
    for done in (members, index):
        drop_table(done)

    again = smallest_reachable(found)
    crowd = centred.select("shingle", "node").join(dealt(again.withColumnRenamed("root", "own")), "node", "left").withColumn("own", F.coalesce("own", "node"))
    mixed = crowd.groupBy("shingle").agg((F.min("own") != F.max("own")).alias("mixed")).where("mixed").select("shingle")
    crowd = write_table(crowd.join(dealt(mixed), "shingle"), "crowd")
    times = crowd.groupBy("node").agg(F.count(F.lit(1)).alias("times"))
    refs = crowd.join(dealt(times), "node").groupBy("shingle").agg(F.max(F.struct("times", (-F.col("node")).alias("least"), "own")).alias("r")).select("shingle", (-F.col("r.least")).alias("ref"), F.col("r.own").alias("ref_own"))
    members = write_table(crowd.join(dealt(refs), "shingle").select("ref", "node", "own", "ref_own").distinct(), "members")
    if not members.isEmpty():
        found = found.unionByName(alike(apart_alike(members, texts, rows, width, at_least), texts, rows, width, at_least))
    for done in (centred, crowd, members):
        drop_table(done)
    return found


def near_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, at_least: float = 0.8) -> DataFrame:
    """A row for each distinct text of ``df``: ``copy`` (a digest of the text), ``first`` (``none``, ``id``, ``row``: the least of its rows, null ids last) and ``root``, the same for all copies and near copies: texts whose sets of shingles have a Jaccard likeness of ``at_least``, and theirs in turn. Texts without words are one class."""
    few_at_once(df.sparkSession)
    kept = keyed(df, text_col)
    rows = kept.select(F.col(quoted(id_col)).alias("__id"), "__row", "__copy", F.coalesce(F.col(quoted(text_col)), F.lit("")).cast("binary").alias("__text"))
    texts = distinct_texts(rows, width)
    roots = smallest_reachable(alike_links(texts, rows, width, at_least))
    root = F.when(F.col("size") == 0, F.lit(-1)).otherwise(F.coalesce("root", "node"))
    return write_table(texts.select("node", "copy", "first", "size").join(dealt(roots), "node", "left").select("copy", "first", root.alias("root")), "classes")


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, at_least: float = 0.8) -> DataFrame:
    """``id_col`` and ``component_id``, the smallest id of the copies and near copies of each text (see ``near_classes``).

    All near copies are found (see ``alike_links``). Texts without words, and null ones, are copies of each other. Repeated rows keep their number; rows with a null id are in no class. An empty table gives an empty result.
    """
    named = df.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text")).where("id is not null")
    classes = near_classes(named, "id")
    least = classes.groupBy("root").agg(F.min("first.id").alias("component_id"))
    copies = keyed(named).select("id", F.col("__copy").alias("copy"))
    return copies.join(dealt(classes.join(dealt(least), "root").select("copy", "component_id")), "copy").select(F.col("id").alias(id_col), "component_id")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, at_least: float = 0.8) -> DataFrame:
    """One row of each class of near copies of ``df`` (see ``near_classes``), that with the smallest id; null ids come last, and of equal rows one stays. Repeated ids and rows with a null id take part by their text."""
    rows = keyed(df, text_col)
    best = near_classes(df, id_col, text_col, width, at_least).groupBy("root").agg(F.min(F.struct("first", "copy")).alias("best"))
    kept = best.select(F.col("best.copy").alias("__copy"), F.col("best.first.row").alias("__row"), F.lit(True).alias("kept"))
    keys = rows.groupBy("__copy", "__row").agg(F.count(F.lit(1)).alias("n")).join(dealt(kept), ["__copy", "__row"], "left")
    gone = write_table(keys.where("kept is null or n > 1"), "gone")
    single = joined_with_few(rows, gone.select("__copy", "__row"), ["__copy", "__row"], "left_anti")
    equal = joined_with_few(rows, gone.where("kept").select("__copy", "__row"), ["__copy", "__row"], "left_semi").dropDuplicates(["__copy", "__row"])
    return single.unionByName(equal).select(*(F.col(quoted(c)) for c in df.columns))
