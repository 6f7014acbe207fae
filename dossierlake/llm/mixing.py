"""Mixing sources to target weights by Pfair scheduling.

A source is cut into blocks of documents.  Its integer share W out of all shares
(weights are rounded to multiples of 1/``slots``, or of a quarter of the mean share
if there are many sources, and none is below one) is served in *rounds*: a round
takes W blocks of every source that still has them.  Served ideally, all sources
advance together in proportion to their shares; block k of a source is released
at the slot in which its ideal service begins and due at the slot in which that
ends.  Each slot goes to the released block with the earliest deadline.  Unit
blocks with such windows always meet their deadlines, so at every slot each
source has been served within one block of its ideal share, and exactly it at
the end of a round.  When a source runs out, the others share its slots in
proportion to their weights; no document is dropped or repeated.

Rounds between two such events are identical, so only as many rounds are
scheduled as there are sources, twice, plus one; every block finds its slot by
arithmetic.  The schedule is one ``aggregate`` expression over the slots of a
round.  Only DataFrame functions are used.

Ranks inside a source need no task per source: documents are dealt by hash to
buckets, ranked inside (source, bucket), and bucket counts give the offsets.

Defined results
  * null source: a source of its own.  Null text plays no part.
  * repeated rows: each is placed.  Ties of the hash: by id.
  * sources without a weight: the smallest share.  Empty table: an empty result.
  * null id: a document like others.  Extra columns, also with the names of the
    result, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize

BLOCK_DOCS = 32
SLOTS = 1000
#: Slots for each source at least, so that many sources keep unequal shares.
FINEST = 4
#: Weight of a source by default: its documents to this power.
TEMPERATURE = 0.5
BUCKET_ROWS = 50_000
MIN_BUCKETS = 64


def _key(source: Column) -> Column:
    """The source as text, with null kept apart from every value."""
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source.cast("string")))


def _shares(counts: DataFrame, weights: dict | None, temperature: float, slots: int) -> DataFrame:
    """(s, n, w): documents and integer share of each source."""
    if weights is None:
        raw = F.pow(F.col("n").cast("double"), F.lit(float(temperature)))
    else:
        raw = F.lit(0.0)
        for source, weight in weights.items():
            raw = F.when(F.col("s") == _key(F.lit(source)), F.lit(float(weight))).otherwise(raw)
    total, sources = counts.select(F.sum(raw), F.count("*")).first()
    total, slots = total or 1.0, max(slots, FINEST * sources)
    return counts.withColumn("w", F.greatest(F.lit(1), F.round(raw / F.lit(float(total)) * slots)).cast("long"))


def round_windows(c: Column, w: Column) -> Column:
    """For each source and block of a round: (release, due).

    At virtual time v in [0, 1] source j has been served min(c[j], v*w[j])
    blocks ideally; their sum S(v) is the slot.  Block k of source i spans
    v = k/w[i] to (k+1)/w[i].
    """

    def slot(k: Column, own: Column) -> Column:
        return F.aggregate(F.zip_with(c, w, lambda x, y: F.least(x * own, y * k)), F.lit(0).cast("long"), lambda a, x: a + x) / own

    def window(n: Column, i: Column) -> Column:
        own = F.get(w, i)
        every = F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<long>"))
        return F.transform(every, lambda k: F.struct(F.floor(slot(k, own)).alias("r"), F.ceil(slot(k + 1, own)).alias("d")))

    return F.transform(c, window)


def round_schedule(windows: Column, width: Column) -> Column:
    """The source index served at each of ``width`` slots: of the released blocks the one due first."""
    start = F.struct(F.transform(windows, lambda x: F.lit(0)).alias("k"), F.array().cast("array<long>").alias("out"))

    def serve(state: Column, t: Column) -> Column:
        def due(k: Column, i: Column) -> Column:
            block = F.get(F.get(windows, i), k)
            return F.when(block["r"] <= t, F.struct(block["d"].alias("d"), i.cast("long").alias("i")))

        chosen = F.array_min(F.transform(state["k"], due))["i"]
        # An array of one binds the choice once.
        return F.transform(F.array(chosen), lambda one: F.struct(F.transform(state["k"], lambda k, i: F.when(i == one, k + 1).otherwise(k)).alias("k"), F.concat(state["out"], F.array(one)).alias("out")))[0]

    return F.aggregate(F.sequence(F.lit(0).cast("long"), width - 1), start, serve)["out"]


def pfair_slots(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", weights: dict | None = None, block_docs: int = BLOCK_DOCS, slots: int = SLOTS, temperature: float = TEMPERATURE) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, source, block, slot, turn, share``.

    ``block`` counts the blocks of the source, ``slot`` is the block's place in
    the mix, ``turn`` the document's place in the block, ``share`` the source's
    target weight.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), docs[source_col].alias("source"), _key(docs[source_col]).alias("s"))
    rows = rows.withColumn("h", F.xxhash64("doc_id", F.lit(6)))
    counted = materialize(rows.groupBy("s", F.pmod("h", F.lit(1 << 20)).alias("fine")).agg(F.count("*").alias("n")).groupBy("s").agg(F.sum("n").alias("n")), "sources")
    total = counted.agg(F.sum("n")).first()[0] or 0
    shares = materialize(_shares(counted, weights, temperature, slots).withColumn("nb", F.ceil(F.col("n") / block_docs)), "shares")
    buckets = max(MIN_BUCKETS, total // BUCKET_ROWS)
    rows = rows.withColumn("bucket", F.pmod(F.shiftright("h", 20), F.lit(buckets)))

    # The rounds, from one row that lists the sources: as many as the mix names.
    every = shares.agg(F.array_sort(F.collect_list(F.struct("s", "nb", "w"))).alias("S"), F.sum("w").alias("all"))
    events = F.array_sort(F.array_distinct(F.flatten(F.transform("S", lambda x: F.array(F.lit(0).cast("long"), F.floor(x["nb"] / x["w"]), F.ceil(x["nb"] / x["w"]))))))
    kinds = (
        every.withColumn("E", events)
        .select("S", "all", "E", F.posexplode("E").alias("j", "m0"))
        .withColumn("m1", F.get("E", F.col("j") + 1))
        .where("m1 is not null")
        .withColumn("c", F.transform("S", lambda x: F.greatest(F.lit(0).cast("long"), F.least(x["w"], x["nb"] - F.col("m0") * x["w"]))))
        .withColumn("width", F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + x))
    )
    kinds = kinds.repartition("j").withColumn("windows", round_windows(F.col("c"), F.transform("S", lambda x: x["w"])))
    kinds = materialize(kinds, "rounds").withColumn("out", round_schedule(F.col("windows"), F.col("width"))).drop("windows", "c")
    # The rounds before this kind: at most twice the sources, so one small window.
    size = (F.col("m1") - F.col("m0")) * F.col("width")
    kinds = materialize(kinds.withColumn("base", F.coalesce(F.sum(size).over(Window.orderBy("j").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))), "kinds")
    served = kinds.select("j", "m0", "m1", "width", "base", "S", F.posexplode("out").alias("t", "i")).select("m0", "m1", "width", "base", "t", F.element_at("S", (F.col("i") + 1).cast("int"))["s"].alias("ss"), F.row_number().over(Window.partitionBy("j", "i").orderBy("t")).alias("k1"))
    served = materialize(served.groupBy("ss", (F.col("k1") - 1).cast("long").alias("kk")).agg(F.collect_list(F.struct("m0", "m1", "width", "base", "t")).alias("plan")), "served")

    per = rows.groupBy("s", "bucket").agg(F.count("*").alias("c")).withColumnsRenamed({"s": "ps", "bucket": "pb"})
    before = materialize(per.select("ps", "pb", (F.sum("c").over(Window.partitionBy("ps").orderBy("pb")) - F.col("c")).alias("before")), "before")
    ranked = rows.withColumn("rn", F.row_number().over(Window.partitionBy("s", "bucket").orderBy("h", "doc_id"))).join(before, (F.col("s") == F.col("ps")) & (F.col("bucket") == F.col("pb")))
    ranked = materialize(ranked.select("doc_id", "source", "s", (F.col("before") + F.col("rn") - 1).alias("rank")).withColumn("block", F.floor(F.col("rank") / block_docs)), "ranked")

    weights_of = shares.select(F.col("s").alias("ws"), "w")
    share_of = shares.agg(F.sum("w")).first()[0] or 1
    blocks = ranked.select("s", "block").distinct().join(weights_of, F.col("s") == F.col("ws")).withColumn("m", F.floor(F.col("block") / F.col("w")))
    placed = blocks.join(served, (F.col("s") == F.col("ss")) & (F.col("block") - F.col("m") * F.col("w") == F.col("kk")))
    at = F.get(F.filter("plan", lambda p: (p["m0"] <= F.col("m")) & (F.col("m") < p["m1"])), F.lit(0))
    placed = materialize(placed.select(F.col("s").alias("bs"), F.col("block").alias("bb"), "w", at.alias("p"), "m").select("bs", "bb", "w", (F.col("p.base") + (F.col("m") - F.col("p.m0")) * F.col("p.width") + F.col("p.t")).alias("slot")), "placed")
    return ranked.join(placed, (F.col("s") == F.col("bs")) & (F.col("block") == F.col("bb"))).select(
        "doc_id", "source", "block", F.col("slot").cast("long").alias("slot"), (F.col("rank") - F.col("block") * block_docs).cast("int").alias("turn"), (F.col("w") / F.lit(int(share_of))).alias("share")
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs`` in the order of the mix, as files to be read one after another.

    Each output partition holds a run of slots, sorted.  Rows repeated with the
    same id take the places of that id one each.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = materialize(pfair_slots(docs, id_col, source_col, **options).select(F.col("doc_id").alias("id"), "slot", "turn"), "order")
    last = order.agg(F.max("slot")).first()[0] or 0
    whole = docs.select(docs[id_col].alias("key"), F.struct(*[docs[c] for c in docs.columns]).alias("doc"))
    on = F.col("key").eqNullSafe(F.col("id"))
    if not order.groupBy("id").count().where("count > 1").isEmpty():
        order = order.withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy("slot", "turn")))
        whole = whole.withColumn("own", F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("doc"))))
        on = on & (F.col("own") == F.col("nth"))
    joined = whole.join(order.hint("merge"), on).withColumn("part", F.floor(F.col("slot") * parts / (last + 1)).cast("int"))
    return joined.repartitionById(parts, F.col("part")).sortWithinPartitions("slot", "turn").select("doc.*")
