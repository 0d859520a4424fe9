"""Mixing sources to target weights by Pfair scheduling; DataFrame functions only.

Blocks. A source's documents, in a random but fixed order (by the MD5 of the id), are laid end to end;
block k of a source holds the documents that begin in its k-th stretch of ``block_chars`` characters
(a document counts one more than its length, so empty ones advance too).

Schedule. With weight w block k (from 1) is released at slot floor((k - 1) / w) and is due by
slot ceil(k / w). Each slot takes the released block that is due first (ties: the lower
source). Weights are whole multiples of 1 / ``period`` that sum to 1, so releases and deadlines
repeat after ``period`` slots and the schedule of one period is all that has to be worked out: it is a
fold over ``period`` slots and sources, whatever the size of the corpus. ``period`` must be at least twice the number of
sources; with more of them give a longer one, or group them first (as hosts by domain). Every deadline is
met, and no source ever deviates by a block or more from its share while no source has run out. When a source has run out
its slots stay unused, which leaves the others' proportions as they are. Every
document is mixed exactly once; none is dropped or repeated.

Scale. A source is cut by MD5 prefix into ranges of about ``range_chars`` characters, and running sums are
taken within ranges and then over the ranges' totals: no task gets more of a hot source than
a range. The schedule (``period`` rows) and the ranges' totals are joined; nothing else is shuffled but
ids and lengths.

Weights. Given ones are rounded to multiples of 1 / period (largest remainders, at least one each).
Without any, a source weighs as its characters to the power ``temperature``. Sources that ``weights`` leaves
out count as the lightest given one.

Defined results: null text counts as empty; a null source is a source of its own, as is the empty one; rows with null ids
are placed by their texts; repeated rows are mixed each, ties in any order; very long texts fill blocks of their own; an
empty table gives an empty result; extra columns, whatever their names, are passed through by :func:`interleave`
and not read otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vespera.llm.common import fit_name, keep


def shares(sizes: DataFrame, weights: dict[str, float] | None, temperature: float, period: int) -> DataFrame:
    """(source, rank, share): each source's whole number of slots in a period; the shares sum to period."""
    if weights:
        least = min(weights.values())
        table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
        raw = F.coalesce(F.element_at(table, F.col("source")), F.lit(least)).cast("double")
    else:
        raw = F.pow(F.col("size").cast("double"), F.lit(temperature))
    every, n = Window.partitionBy(), F.count("*").over(Window.partitionBy())
    # One row per source: of each share one slot is given, the rest is dealt by weight.
    rows = sizes.select("source", raw.alias("w")).withColumn("total", F.sum("w").over(every)).withColumn("n", n)
    rows = rows.withColumn("ideal", F.col("w") / F.col("total") * (F.lit(period) - F.col("n")))
    rows = rows.withColumn("floor", F.floor("ideal")).withColumn("missing", F.lit(period) - F.col("n") - F.sum("floor").over(every))
    rows = rows.withColumn("order", F.row_number().over(Window.orderBy(F.desc(F.col("ideal") - F.col("floor")), F.col("source").asc_nulls_first())))
    rows = rows.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_first())))
    share = (1 + F.col("floor") + (F.col("order") <= F.col("missing")).cast("int")).cast("int")
    return rows.select("source", "rank", share.alias("share"))


def schedule(share: DataFrame, period: int) -> DataFrame:
    """(rank, turn, slot): in which slot of a period a source has its turn-th block (from 0).

    A fold over the slots; its state is the number of blocks each source has been given.
    """
    listed = share.agg(F.array_sort(F.collect_list(F.struct("rank", "share"))).alias("s"))
    p = F.lit(period).cast("long")

    def pick(given: Column, t: Column) -> Column:
        """Of the sources whose next block is released, the one due first: (deadline, index)."""
        due = F.transform(
            F.col("s"),
            lambda s, i: F.when(
                F.floor(F.element_at(given, i + 1) * p / s["share"]) <= t,
                F.struct(F.ceil((F.element_at(given, i + 1) + 1) * p / s["share"]).alias("due"), (i + 1).alias("at")),
            ),
        )
        return F.array_min(F.filter(due, lambda d: d.isNotNull()))["at"]

    start = F.struct(F.transform("s", lambda s: F.lit(0).cast("long")).alias("given"), F.array().cast("array<struct<rank:int,turn:bigint,slot:bigint>>").alias("out"))

    def step(state: Column, t: Column) -> Column:
        # The choice is bound to a name by a one-element transform, so that it is worked out once.
        return F.element_at(
            F.transform(
                F.array(pick(state["given"], t)),
                lambda at: F.struct(
                    F.transform(state["given"], lambda g, i: F.when(i + 1 == at, g + 1).otherwise(g)).alias("given"),
                    F.concat(state["out"], F.array(F.struct(F.element_at(F.col("s"), at)["rank"].alias("rank"), F.element_at(state["given"], at).alias("turn"), t.alias("slot")))).alias("out"),
                ),
            ),
            1,
        )

    slots = F.aggregate(F.sequence(F.lit(0).cast("long"), p - 1), start, step)["out"]
    return listed.where(F.size("s") > 0).select(F.explode(slots).alias("x")).select("x.rank", "x.turn", "x.slot")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block_chars: int = 1 << 18, period: int = 1000, temperature: float = 0.5, range_chars: int = 1 << 21, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row per document: its source, block, release, deadline and slot, and its place in the mix.

    ``position`` counts from 0 over all documents in mix order.
    """
    size = F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long") + 1
    none = F.concat(F.lit("null "), F.coalesce(F.col(text_col), F.lit("")))  # null ids go by their texts
    digest = F.md5(F.coalesce(F.col(id_col).cast("string"), none).cast("binary"))
    rows = keep(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), digest.alias("digest")), "mix-rows")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("size"))
    if period < 2 * sizes.count():
        raise ValueError(f"a period of {period} slots is too short: it takes two for each source at least")
    share = keep(shares(sizes, weights, temperature, period), "mix-shares")
    turns = keep(schedule(share, period), "mix-turns")

    # Where each document begins in its source: within its range of digests, then over the ranges.
    cuts = sizes.select("source", F.greatest(F.lit(1), F.ceil(F.col("size") / range_chars)).cast("long").alias("cuts"))
    prefix = F.coalesce(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long"), F.lit(0))
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    ranged = rows.alias("r").join(cuts.alias("c"), same("r", "c")).select("r.*", F.floor(prefix * F.col("cuts") / F.lit(1 << 32)).cast("long").alias("cut"))
    inner = Window.partitionBy("source", "cut").orderBy("digest", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("begin", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    totals = ranged.groupBy("source", "cut").agg(F.sum("size").alias("total"))
    outer = Window.partitionBy("source").orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("source", "cut", F.coalesce(F.sum("total").over(outer), F.lit(0)).alias("offset"))
    based = placed.alias("p").join(offsets.alias("o"), same("p", "o") & (F.col("p.cut") == F.col("o.cut"))).select("p.doc_id", "p.source", "p.size", "p.digest", (F.col("p.begin") + F.col("o.offset")).alias("begin"))

    # Block, and the block's slot: its turn within a period, periods later.
    known = based.alias("b").join(F.broadcast(share).alias("s"), same("b", "s")).select("b.*", "s.rank", "s.share", F.floor(F.col("begin") / block_chars).alias("k"))
    known = known.withColumn("turn", F.pmod("k", F.col("share").cast("long")))
    slotted = known.join(F.broadcast(turns), ["rank", "turn"]).withColumn("slot", F.col("slot") + F.floor(F.col("k") / F.col("share")) * period)
    kept = keep(slotted.select("doc_id", "source", "size", "digest", "begin", "k", "share", "slot"), "mix-slots")

    # Places: documents before each run of slots, before the slot in its run, and within the slot's block.
    per_slot = kept.groupBy("slot").agg(F.count("*").alias("n"))
    run = F.floor(F.col("slot") / 4096)
    in_run = Window.partitionBy("run").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = per_slot.withColumn("run", run).withColumn("inner", F.coalesce(F.sum("n").over(in_run), F.lit(0)))
    runs = slots.groupBy("run").agg(F.sum("n").alias("n")).select("run", F.coalesce(F.sum("n").over(Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("outer"))
    before = slots.join(runs, "run").select("slot", (F.col("inner") + F.col("outer")).alias("before"))
    within = F.row_number().over(Window.partitionBy("slot").orderBy("begin", "digest", "doc_id")) - 1
    release = F.floor(F.col("k") * period / F.col("share"))
    deadline = F.ceil((F.col("k") + 1) * period / F.col("share"))
    out = kept.withColumn("within", within).join(before, "slot")
    return out.select("doc_id", "source", (F.col("share") / period).alias("weight"), (F.col("k") + 1).cast("long").alias("block"), release.cast("long").alias("release"), deadline.cast("long").alias("deadline"), F.col("slot").cast("long").alias("slot"), (F.col("before") + F.col("within")).cast("long").alias("position"))


def interleave(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """All documents with all their columns, in the order of the mix.

    Documents are matched to their places by id; rows that share an id share the first place.
    """
    place = fit_name(docs, "_place")
    places = mix(docs, id_col=id_col, **options).groupBy(F.col("doc_id").alias("_id")).agg(F.min("position").alias(place))
    joined = docs.join(places, F.col(id_col).eqNullSafe(F.col("_id"))).drop("_id")
    return joined.repartitionByRange(place).sortWithinPartitions(place).drop(place)


def runs_of(docs: DataFrame, run_slots: int = 100, id_col: str = "doc_id", **options) -> DataFrame:
    """(id, run): the run of ``run_slots`` slots of the mix that holds the document, for each id once.

    While no source has run out each run holds every source at its weight, give or take two blocks.
    Rows that share an id share the first slot.
    """
    places = mix(docs, id_col=id_col, **options)
    return keep(places.groupBy(F.col("doc_id").alias("id")).agg(F.floor(F.min("slot") / run_slots).cast("long").alias("run")), "mix-runs")
