"""Admission of texts in order: each is declined if it is too like one admitted before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import drop_table, write_table
from . import text

#: Texts of one bucket that are held against each other in one task; fuller ones are first held against their earliest text, and what is left is cut.
FULL = 64
#: Hashes of more sketches than this are common and come last in the order by which leads are taken.
COMMON = 16
#: Rounds in which the earliest texts of full buckets are looked at, before the rest is held against each other.
FIRST_ROUNDS = 6


def likeness(a: str, b: str, size: int) -> Column:
    return text.sketch_jaccard(F.col(a), F.col(b), size)


def _leads(nodes: DataFrame, least: float) -> DataFrame:
    """``node``, ``place``, ``size`` (hashes of the sketch) and ``key``: the first hashes of a sketch, as many as may be missing from a sketch that is like it, and one more. Two that are alike have ``least`` of the larger sketch in common, so the first common hash is among these of both, whatever the order, if it is one for all.

    It is the order of the hashes, but common ones come last, the rarest of them first (counted over all sketches), so that a passage of many texts brings only those together that hold little else.
    """
    each = nodes.select("node", F.explode("sketch").alias("key"))
    common = write_table(each.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > COMMON), "common")
    held = each.join(common, "key").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("held"))
    last = F.coalesce(F.transform("held", lambda x: x["key"]), F.array().cast("array<bigint>"))
    many = F.floor((1 - F.lit(least)) * F.size("sketch") + 1e-9).cast("int") + 1
    return nodes.join(held, "node", "left").select("node", "place", F.size("sketch").alias("size"), F.explode(F.slice(F.concat(F.array_except("sketch", last), last), F.lit(1), many)).alias("key"))


def admit(df: DataFrame, id_col: str, text_col: str, order: list[str], least: float = 0.85, words: int = 8, size: int = 128, long_text: int = 150_000) -> DataFrame:
    """``id_col``, ``admitted``, ``reason`` (novel, exact_dup, near_dup, partial_kept), ``nearest`` and ``score`` (the likest text admitted before, the earliest of equals, if it is ``least`` or more alike) of every row.

    Texts come by ``order``, then ``id_col``. A text whose normalized form is that of one admitted before is an exact_dup. Else it is held against all admitted before it by sketches of the ``size`` smallest hashes of ``words``-word shingles: near_dup if one is ``least`` or more alike. A text of over ``long_text`` characters is never declined for likeness (partial_kept), as its tail may be new. Declined texts decline nobody, so the first of a group decides, not the group's transitive closure. Null and empty texts have empty sketches: the first is novel, others are exact_dup.

    Texts of one sketch behave alike, so that the earliest (and the earliest long one) stands for all. Candidates share one of the first hashes, rare ones before common ones, which loses no pair (``_leads``). In full buckets the earliest texts come first: one that is the earliest in each of its buckets is admitted for certain, and declines what is like it in one pass; that repeats for a few rounds, so that crowds of near copies form no pairs. What is left meets in buckets, full ones cut to parts, and only pairs that are alike are kept as edges. Over these the order is settled in rounds: a text without an open earlier neighbour is admitted, one with an admitted earlier neighbour is declined. Each round is written to the shared folder.
    """
    spark = df.sparkSession
    base = df.select(F.col(id_col).alias("id"), F.struct(*(F.col(c).alias(f"o{k}") for k, c in enumerate(order)), F.col(id_col).alias("own")).alias("place"), text.copy_key(F.coalesce(F.col(text_col), F.lit(""))).alias("copy"), text.bottom_sketch(F.coalesce(F.col(text_col), F.lit("")), words, size).alias("sketch"), (F.coalesce(F.length(text_col), F.lit(0)) > long_text).alias("long"))
    marks = write_table(base.withColumn("group", F.md5(F.concat_ws(",", F.col("sketch").cast("array<string>")))), "marks")
    # of one sketch the earliest stands for all; sketches are told apart by their md5, as copies are
    groups = marks.groupBy("group", "long").agg(F.min(F.struct("place", "copy", "id")).alias("first"), F.first("sketch").alias("sketch"))
    nodes = write_table(groups.select(F.monotonically_increasing_id().alias("node"), "group", "sketch", "long", F.col("first.place").alias("place"), F.col("first.id").alias("id")), "nodes")
    leads = write_table(_leads(nodes, least), "leads")
    by_node = nodes.select("node", "sketch", "long", "place")

    n_leads = leads.count()
    declined, settled, nears = None, None, []
    open_ = nodes.select("node", "place")
    for _ in range(FIRST_ROUNDS):
        index = leads.join(open_.select("node"), "node", "left_semi")
        buckets = write_table(index.groupBy("key").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")), "buckets")
        # rounds are for crowds: while full buckets hold no more pairs than there are leads, to hold these against each other is the lesser work
        if (buckets.where(F.col("n") > FULL).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] or 0) <= n_leads:
            drop_table(buckets)
            break
        ranked = index.join(buckets, "key")
        certain = write_table(ranked.groupBy("node").agg(F.every(F.col("place") == F.col("first")).alias("all_first"), F.max("n").alias("n")).where(F.col("all_first") & (F.col("n") > FULL)).select("node"), "certain")
        if certain.isEmpty():
            break
        drop_table(buckets)
        near = write_table(_edges(index.join(certain, "node", "left_semi"), index, by_node, least, size), "near")
        nears.append(near)
        hit = near.join(by_node.where("not long").select(F.col("node").alias("b")), "b").select(F.col("b").alias("node")).distinct()
        now = write_table(hit, "declined")
        declined = now if declined is None else declined.unionByName(now)
        settled = certain if settled is None else settled.unionByName(certain)
        open_ = write_table(open_.join(now, "node", "left_anti").join(certain, "node", "left_anti"), "open")

    rest = leads.join(open_.select("node"), "node", "left_semi")
    edges = write_table(_edges(rest, rest, by_node, least, size), "edges")
    if settled is not None:
        # a text that certain ones have met without declining it keeps them as neighbours that are admitted
        admitted = settled
    else:
        admitted = open_.select("node").limit(0)
    long_ones = by_node.where("long").select("node")
    state = write_table(open_.select("node").join(long_ones, "node", "left_anti"), "state")
    gone = open_.select("node").limit(0)
    sure = open_.select("node").join(long_ones, "node", "left_semi")
    live = edges.select("a", "b")
    while not state.isEmpty():
        hit = live.join(sure.withColumnRenamed("node", "a"), "a", "left_semi").select(F.col("b").alias("node")).distinct().join(state, "node", "left_semi")
        now = write_table(hit, "gone")
        gone = gone.unionByName(now)
        state = state.join(now, "node", "left_anti")
        blocked = live.join(state.withColumnRenamed("node", "a"), "a", "left_semi").select(F.col("b").alias("node")).distinct()
        fresh = write_table(state.join(blocked, "node", "left_anti"), "fresh")
        if fresh.isEmpty() and now.isEmpty():
            raise RuntimeError("texts of one place can't be ordered")
        sure = sure.unionByName(fresh)
        state = write_table(state.join(fresh, "node", "left_anti"), "state")
    admitted = write_table(admitted.unionByName(sure).distinct(), "admitted")

    # declined and long texts and the admitted that they are like: no other has one. Edges and the rounds' pairs have them all but those of texts that a round declined, which met only that round's
    found = edges.join(admitted.withColumnRenamed("node", "a"), "a", "left_semi")
    for more in nears:
        found = found.unionByName(more)
    if declined is not None:
        found = found.unionByName(_edges(leads.join(admitted, "node", "left_semi"), leads.join(declined, "node", "left_semi"), by_node, least, size))
    found = write_table(found.distinct(), "found")
    near = found.join(nodes.select(F.col("node").alias("a"), F.col("id").alias("nearest"), F.col("place").alias("a_place")), "a")
    best = near.groupBy(F.col("b").alias("node")).agg(F.min_by(F.struct("nearest", "score"), F.struct(-F.col("score"), "a_place")).alias("best"))  # of equals the earliest, however nodes are numbered
    told = nodes.join(best.select("node", "best.*"), "node", "left").join(admitted.withColumn("in", F.lit(True)), "node", "left")
    told = told.select("group", "long", F.col("id").alias("first_id"), "nearest", "score", F.coalesce("in", F.lit(False)).alias("in"))
    return _verdicts(spark, marks, told, id_col)


def _edges(left: DataFrame, right: DataFrame, by_node: DataFrame, least: float, size: int) -> DataFrame:
    """``a``, ``b`` and ``score`` of pairs of an earlier node of ``left`` and a later one of ``right`` that share a key and are alike. Full buckets are cut by a hash of the earlier node, so that no task holds all of one."""
    counts = right.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > FULL * 16)
    parts = F.coalesce(F.ceil(F.col("n") / (FULL * 16)).cast("int"), F.lit(1))
    a = left.join(counts, "key", "left").select("key", F.col("node").alias("a"), F.col("place").alias("a_place"), F.col("size").alias("a_size"), F.pmod(F.xxhash64("node"), parts).alias("part"))
    b = right.join(counts, "key", "left").select("key", F.col("node").alias("b"), F.col("place").alias("b_place"), F.col("size").alias("b_size"), F.explode(F.sequence(F.lit(0).cast("bigint"), parts.cast("bigint") - 1)).alias("part"))
    may = F.least("a_size", "b_size") + 1e-9 >= least * F.greatest("a_size", "b_size")  # what is alike is of like size
    met = a.join(b, ["key", "part"]).where(F.col("a_place") < F.col("b_place")).where(may).select("a", "b").distinct()
    of = lambda c: by_node.select(F.col("node").alias(c), F.col("sketch").alias(f"{c}_sketch"))
    scored = met.join(of("a"), "a").join(of("b"), "b").select("a", "b", likeness("a_sketch", "b_sketch", size).alias("score"))
    return scored.where(F.col("score") >= least)


def _verdicts(spark, marks: DataFrame, told: DataFrame, id_col: str) -> DataFrame:
    """Rows of all texts from the verdicts on the earliest of their sketch, then copies by their normalized text."""
    rows = marks.withColumn("size", F.size("sketch")).drop("sketch").join(told, ["group", "long"])
    own = F.col("id").eqNullSafe(F.col("first_id"))
    # later texts of an admitted sketch are like the earliest itself; long ones are kept all the same
    near = F.when(own, F.col("nearest")).when(F.col("in"), F.col("first_id")).otherwise(F.col("nearest"))
    score = F.when(own, F.col("score")).when(F.col("in") & (F.col("size") > 0), F.lit(1.0)).otherwise(F.col("score"))
    kept = F.when(own, F.col("in")).otherwise(F.col("long") | (F.col("size") == 0))
    rows = rows.select("id", "place", "copy", "long", near.alias("nearest"), score.alias("score"), kept.alias("kept"))
    first = rows.where("kept").groupBy("copy").agg(F.min("place").alias("first_kept"))
    rows = rows.join(first, "copy", "left").withColumn("exact", F.coalesce(F.col("first_kept") < F.col("place"), F.lit(False)))
    admitted = F.col("kept") & ~F.col("exact")
    reason = F.when(F.col("exact"), "exact_dup").when(~F.col("kept"), "near_dup").when(F.col("score").isNotNull(), "partial_kept").otherwise("novel")
    return rows.select(F.col("id").alias(id_col), admitted.alias("admitted"), reason.alias("reason"), F.when(~F.col("exact"), F.col("nearest")).alias("nearest"), F.when(F.col("exact"), F.lit(1.0)).otherwise(F.col("score")).alias("score"))
