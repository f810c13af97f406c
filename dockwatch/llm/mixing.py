"""Mixing sources to target weights by entropy balancing.

Each source has a target number of words. Of all document rates that meet the
targets, entropy balancing takes those nearest to "every document once". They
are exponentially tilted: a document of x mean sizes is taken exp(lambda * x)
times, at most ``cap`` times, with one multiplier lambda for each source. The
multipliers solve a convex dual, found here by Newton steps kept inside a
bracket. Rates depend on source and size alone, so the steps run on the counts
of documents per (source, size), never on documents.

Rates become whole copies tier by tier, from the largest sizes down (a tier
holds the sizes of one power of two). Running sums of rates are cut to whole
numbers, and what a tier misses is spread over the smaller ones, so a source
ends within a small document of its target wherever copies allow it.

Only built-in functions run. Sums that decide something are sums of whole
numbers, so reruns agree whatever the order of addition.

Defined cases: null text has size 0; documents of size 0 keep one copy and
count nothing; a null source is a source of its own, last in order; rows that
repeat are documents of their own; an empty table gives no rows; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from dockwatch.llm.common import first_of_repeats, keyed, n_words, table, text_key
from dockwatch.operators.ordering import numbered
from dockwatch.session import stage

WEIGHTS = (5, 2, 1)
CAP = 3
#: Rates are kept as whole multiples of 1 / UNIT.
UNIT = 1 << 32
TOLERANCE = 1e-6
MAX_STEPS = 60


def _big(c: Column, digits: int) -> Column:
    return c.cast(f"decimal({digits},0)")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``sources`` (source, source_size, n_docs) with ``target``.

    All sizes together are shared out by weight; a source stops at ``cap`` times
    its size and the rest is shared among the others. That is one water level:
    target = min(cap * size, level * weight). The level rises until no further
    source stops; each look at it is one pass over the sources.
    """
    ranked = numbered(sources, [F.col("source").asc_nulls_last()], "_rank")
    w = F.element_at(F.array(*[F.lit(x) for x in weights]),
                     ((F.col("_rank") - 1) % len(weights) + 1).cast("int"))
    ranked = stage(ranked.withColumn("_w", w).drop("_rank"), "mix-sources")
    level, stopped, total = 0.0, -1, None
    while True:
        full = F.col("_w") * F.lit(level) > cap * F.col("source_size")
        row = ranked.agg(
            F.sum("source_size").alias("total"), F.sum(full.cast("long")).alias("stopped"),
            F.coalesce(F.sum(F.when(full, cap * F.col("source_size"))), F.lit(0)).alias("used"),
            F.sum(F.when(~full, F.col("_w"))).alias("weight")).first()
        total = row["total"] or 0
        if not total or row["stopped"] == stopped or not row["weight"]:
            break
        stopped, level = row["stopped"], (total - row["used"]) / row["weight"]
    return ranked.withColumn("target", F.least(
        (cap * F.col("source_size")).cast("double"), F.col("_w") * F.lit(level))).drop("_w")


def _rate(cap: int) -> Column:
    """The tilted rate of a size class in units, a whole number."""
    tilt = F.exp(F.least(F.col("lam") * F.col("x"), F.lit(50.0)))
    return F.when(F.col("full"), F.lit(cap * UNIT)).otherwise(
        F.round(F.least(F.lit(float(cap)), tilt) * UNIT)).cast("long")


def _classes(hist: DataFrame, state: DataFrame, cap: int) -> DataFrame:
    s = state.withColumnRenamed("source", "_s")
    return (hist.join(s, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
            .withColumn("x", F.col("size") / F.col("mean")).withColumn("rate", _rate(cap)))


def multipliers(hist: DataFrame, goal: DataFrame, cap: int = CAP) -> DataFrame:
    """The multiplier ``lam`` of every source with a target; ``full`` ones take ``cap`` copies."""
    state = goal.filter((F.col("source_size") > 0)).select(
        "source", "source_size", "target", (F.col("source_size") / F.col("n_docs")).alias("mean"),
        (F.col("target") >= F.lit(cap * (1 - 1e-12)) * F.col("source_size")).alias("full"),
        F.lit(0.0).alias("lam"), F.lit(None).cast("double").alias("lo"),
        F.lit(None).cast("double").alias("hi"), F.lit(1.0).alias("off"))
    state = stage(state, "mix-state")
    tokens = _big(F.col("n") * F.col("size"), 20)
    # A text has fewer than 2**31 bytes, so ten digits hold any size.
    for _ in range(MAX_STEPS):
        moving = F.col("rate") < cap * UNIT
        # A source's row of ``state`` comes along as the key, so it need not be joined again.
        j = _classes(hist, state, cap).groupBy(*state.columns).agg(
            F.sum(tokens * _big(F.col("rate"), 12)).alias("_a"),
            F.sum(F.when(moving, _big(F.col("n") * F.col("size"), 20) * _big(F.col("size"), 10)
                         * _big(F.col("rate"), 11))).alias("_b"))
        a = F.col("_a").cast("double") / UNIT
        slope = F.coalesce(F.col("_b").cast("double"), F.lit(0.0)) / F.col("mean") / UNIT
        j = (j.withColumn("lo", F.when(a < F.col("target"), F.col("lam")).otherwise(F.col("lo")))
             .withColumn("hi", F.when(a >= F.col("target"), F.col("lam")).otherwise(F.col("hi")))
             .withColumn("_newton", F.when(slope > 0, F.col("lam")
                                           - F.log(a / F.col("target")) * a / slope)))
        inside = (F.col("_newton").isNotNull()
                  & (F.col("lo").isNull() | (F.col("_newton") > F.col("lo")))
                  & (F.col("hi").isNull() | (F.col("_newton") < F.col("hi"))))
        step = (F.when(inside, F.col("_newton"))
                .when(F.col("lo").isNotNull() & F.col("hi").isNotNull(), (F.col("lo") + F.col("hi")) / 2)
                .when(F.col("hi").isNull(), F.greatest(F.col("lam") * 2, F.col("lam") + 1))
                .otherwise(F.least(F.col("lam") * 2, F.col("lam") - 1)))
        off = F.when(F.col("full") | (F.col("target") == 0), 0.0).otherwise(
            F.abs(a - F.col("target")) / F.col("target"))
        j = j.withColumn("off", off).withColumn(
            "lam", F.when(F.col("off") < TOLERANCE, F.col("lam")).otherwise(step))
        state = stage(j.select(*state.columns), "mix-state")
        worst = state.agg(F.max("off")).first()[0]
        if worst is None or worst < TOLERANCE:
            break
    return state


def _whole(units: Column) -> Column:
    """A sum of rates as the nearest whole number."""
    return F.floor((units.cast("decimal(38,0)") + F.lit(UNIT // 2)) / F.lit(UNIT)).cast("long")


def _want(n: Column, rate: Column, shift: Column, cap: int) -> Column:
    """What the ``n`` documents of a class want together, in units."""
    return _big(n, 20) * _big(F.greatest(F.lit(0), F.least(F.lit(cap * UNIT), rate + shift)), 12)


def _shifts(cls: DataFrame, cap: int) -> DataFrame:
    """What each (source, tier) adds to its rates, as ``_s``, ``_t``, ``shift``.

    A tier needs to know what the tiers above it took, so a source's tiers are
    folded from the top down: one row per source, with one entry per class. A
    source never has more classes than the words of its largest text.
    """
    tiers = cls.groupBy("source", "tier").agg(
        F.first("target").alias("target"), F.sum(F.col("n") * F.col("size")).alias("z"),
        F.sum(_big(F.col("n") * F.col("size"), 20) * _big(F.col("rate"), 12)).alias("e"),
        F.sort_array(F.collect_list(F.struct("size", "n", "rate")), asc=False).alias("classes"))
    sources = tiers.groupBy("source").agg(
        F.first("target").alias("target"), F.sum("z").alias("z"), F.sum("e").alias("e"),
        F.sort_array(F.collect_list(F.struct("tier", "z", "e", "classes")), asc=False).alias("tiers"))
    zero = F.lit(0).cast("long")

    def tier(above: Column, t: Column) -> Column:
        shift = F.round(((F.col("target") - above["taken"]) * UNIT - above["e"].cast("double"))
                        / above["z"]).cast("long")

        def one(s: Column, c: Column) -> Column:
            upto = (s["upto"] + _want(c["n"], c["rate"], shift, cap)).cast("decimal(38,0)")
            copies = F.least(c["n"] * cap, _whole(upto) - _whole(s["upto"]))
            return F.struct(upto.alias("upto"), (s["taken"] + copies * c["size"]).alias("taken"))

        last = F.aggregate(t["classes"], F.struct(_big(zero, 38).alias("upto"), above["taken"].alias("taken")), one)
        return F.struct(last["taken"].alias("taken"), (above["z"] - t["z"]).alias("z"),
                        _big(above["e"] - t["e"], 38).alias("e"),
                        F.concat(above["shifts"], F.array(F.struct(t["tier"].alias("tier"), shift.alias("shift")))
                                 ).alias("shifts"))

    start = F.struct(zero.alias("taken"), F.col("z"), _big(F.col("e"), 38).alias("e"),
                     F.array().cast("array<struct<tier:int,shift:bigint>>").alias("shifts"))
    folded = sources.select(F.col("source").alias("_s"), F.explode(
        F.aggregate("tiers", start, tier)["shifts"]).alias("_x"))
    return folded.select("_s", F.col("_x.tier").alias("_t"), F.col("_x.shift").alias("shift"))


def class_copies(hist: DataFrame, state: DataFrame, cap: int = CAP) -> DataFrame:
    """Whole copies for each (source, size): ``copies`` to deal out among its ``n`` documents."""
    cls = stage(_classes(hist, state, cap).filter(F.col("size") > 0).select(
        "source", "size", "n", "rate", "target",
        F.floor(F.log2(F.col("size").cast("double")) + 1e-9).cast("int").alias("tier")), "mix-classes")
    shifts = stage(_shifts(cls, cap), "mix-shifts")
    here = cls.join(shifts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("tier") == F.col("_t")))
    # One row per size: a tier of a source never has more rows than its largest size.
    w = Window.partitionBy("source", "tier").orderBy(F.desc("size"))
    want = _want(F.col("n"), F.col("rate"), F.col("shift"), cap)
    here = here.withColumn("_want", want).withColumn("_upto", F.sum("_want").over(
        w.rowsBetween(Window.unboundedPreceding, 0)).cast("decimal(38,0)"))
    copies = F.least(F.col("n") * cap, _whole(F.col("_upto")) - _whole(F.col("_upto") - F.col("_want")))
    return stage(here.select("source", "size", "n", copies.alias("copies")), "mix-copies")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row per document: doc_id, source, text_key, size, source_size, target, copies, taken."""
    d = stage(docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"),
                          text_key().alias("text_key"), n_words().alias("size")), "mix-docs")
    hist = stage(d.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-hist")
    goal = stage(targets(hist.groupBy("source").agg(
        F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("n_docs")),
        weights, cap), "mix-goal")
    copies = class_copies(hist, multipliers(hist, goal, cap), cap)
    # Which documents of a class get the extra copy: the first ones by a hash of their id.
    pos = numbered(d, [F.col("source").asc_nulls_last(), F.col("size").desc(),
                       F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))),
                       F.col("doc_id"), F.col("text_key")], "_at")
    pos = stage(pos, "mix-order")
    first = pos.groupBy("source", "size").agg((F.min("_at")).alias("_first"))
    c = copies.select(F.col("source").alias("_s"), F.col("size").alias("_z"), "n", "copies")
    f = first.select(F.col("source").alias("_fs"), F.col("size").alias("_fz"), "_first")
    cls = f.join(c, F.col("_fs").eqNullSafe(F.col("_s")) & (F.col("_fz") == F.col("_z")), "left")
    cls = cls.select("_fs", "_fz", "_first", "n", F.col("copies").alias("_k"))
    g = goal.select(F.col("source").alias("_gs"), "source_size", "target")
    cls = cls.join(g, F.col("_fs").eqNullSafe(F.col("_gs"))).drop("_gs")
    out = pos.join(cls, F.col("source").eqNullSafe(F.col("_fs")) & (F.col("size") == F.col("_fz")))
    extra = (F.col("_at") - F.col("_first") < F.col("_k") % F.col("n")).cast("long")
    copies_of = F.when(F.col("size") == 0, F.lit(1).cast("long")).otherwise(
        F.floor(F.col("_k") / F.col("n")).cast("long") + extra)
    return out.select("doc_id", "source", "text_key", "size", "source_size", "target",
                      copies_of.alias("copies"), (copies_of * F.col("size")).alias("taken"))


def mixed_rows(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """The rows of the mix: each row of ``docs`` as often as its copies say."""
    m = mix(docs, weights, cap).groupBy(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("_id"),
        F.col("text_key").alias("_key")).agg(F.sum("copies").alias("_copies"))
    rows = first_of_repeats(keyed(docs).join(m.filter("_copies > 0"), ["_id", "_key"]))
    return rows.select(*docs.columns, F.explode(
        F.sequence(F.lit(1).cast("long"), F.col("_copies"))).alias("_i")).drop("_i")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to weights 5, 2, 1."""
    return mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "copies", "source")
