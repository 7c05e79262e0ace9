"""Mixing sources to target weights by entropy balancing (native).

Among all rates r of the documents of a source, entropy balancing takes those nearest to 1 (in relative entropy, under
a base measure q) that meet the token constraint ``sum(r * size) = target``. The dual of this has one multiplier per
source and is convex; its solution is an exponential tilt, ``r = exp(multiplier * size / q)``, cut at the most copies
that a document may have. With ``q = size + mean size of the source`` the tilt is bounded: long documents carry more of
the change than short ones, none runs away. Newton steps on the dual are grouped sums over a table that is aggregated
to (source, size) beforehand, so an iteration never touches the documents.

Rates are then rounded into copies by systematic rounding within small windows of similar sizes, large documents first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from legispark.llm.storage import drop, materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Documents that a rounding window holds on average, and the multipliers that may be broadcast.
WINDOW_ROWS, BROADCAST_SOURCES = 192, 50_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def row_key(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(doc_id, text)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row per source, null included.

    Sources by code point, null last, take ``weights`` in turn and share the total. A target over ``cap`` times its
    source's size stops there, and the rest is shared anew by weight until none is above. Sources are ranked by ranges,
    of which only the counts meet in one task, and each sharing is one sum over all sources; only sums come to the driver.
    """
    order = F.col("source").asc_nulls_last()
    placed = sizes.repartitionByRange(order).sortWithinPartitions(order)
    placed = materialize(placed.select("source", "source_size", F.spark_partition_id().alias("_task"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_nth")), "ranked")
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("_task").agg(F.count(F.lit(1)).alias("_n")).select("_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    at = ((F.col("_before") + F.col("_nth")) % len(weights) + 1).cast("int")
    ranked = placed.join(F.broadcast(counts), "_task").select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), at).cast("double").alias("_weight"), (F.lit(cap) * F.col("source_size")).alias("_room"))
    ranked = materialize(ranked, "weights")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    water, stopped = 0.0, -1
    while True:
        # Sources that the water level so far fills stop; the others share what is left.
        full = F.col("_room") < water * F.col("_weight")
        n, rest, weight = ranked.agg(F.count_if(full), F.sum(F.when(full, F.col("_room")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("_weight")))).first()
        if n == stopped or not weight:
            break
        water, stopped = (total - rest) / weight, n
    target = F.when((F.lit(not weight)) | (F.col("_room") < water * F.col("_weight")), F.col("_room")).otherwise(water * F.col("_weight"))
    return ranked.select("source", "source_size", target.alias("target"))


def _rate(multiplier: Column, size: Column, mean: Column, cap: float) -> Column:
    return F.least(F.lit(cap), F.exp(F.least(multiplier * size / (size + mean), F.lit(50.0))))


def _attach(big: DataFrame, small: DataFrame, rows: int) -> DataFrame:
    """Join per-source values to ``big``: broadcast only if the source count was found small, else a shuffled join (whose hot keys are split at run time)."""
    return big.join(F.broadcast(small) if rows <= BROADCAST_SOURCES else small, big["source"].eqNullSafe(small["_source"]), "left").drop("_source")


def entropy_rates(groups: DataFrame, sources: DataFrame, cap: float = 3.0, steps: int = 25, tolerance: float = 1e-7) -> tuple[DataFrame, int]:
    """Multipliers per source by Newton's method on the dual, kept in a bracket.

    ``groups``: (source, size, n) with the documents of a source and size counted; ``sources``: (source, source_size,
    target, mean). Each step is one grouped sum, combined before the shuffle, over all groups; only the largest
    remaining error comes to the driver. A source whose target is its ceiling gets an infinite multiplier.
    """
    n_sources = sources.count()
    big = 1e4
    state = sources.select(F.col("source").alias("_source"), "target", "mean", F.when(F.col("target") >= cap * F.col("source_size") * (1 - 1e-9), big).otherwise(0.0).alias("multiplier"), F.lit(-big).alias("_low"), F.lit(big).alias("_high"), F.lit(False).alias("_done"))
    state = materialize(state, "multipliers")
    for _ in range(steps):
        joined = _attach(groups, state.select("_source", "mean", "multiplier"), n_sources)
        size, n = F.col("size").cast("double"), F.col("n").cast("double")
        tilt = size / (size + F.col("mean"))
        rate = _rate(F.col("multiplier"), size, F.col("mean"), cap)
        sums = joined.groupBy(F.col("source").alias("_s")).agg(F.sum(n * size * rate).alias("_got"), F.sum(F.when(rate < cap, n * size * rate * tilt).otherwise(0.0)).alias("_slope"))
        error = F.col("_got") - F.col("target")
        done = F.col("_done") | F.col("_got").isNull() | (F.abs(error) <= F.greatest(tolerance * F.col("target"), F.lit(0.25))) | (F.col("multiplier") >= big)
        low, high = F.when(error < 0, F.col("multiplier")).otherwise(F.col("_low")), F.when(error > 0, F.col("multiplier")).otherwise(F.col("_high"))
        newton = F.when(F.col("_slope") > 0, F.col("multiplier") - error / F.col("_slope"))
        middle = F.when((low > -big) & (high < big), (low + high) / 2).when(low > -big, low * 2 + 1).otherwise(high * 2 - 1)
        moved = F.when((newton > low) & (newton < high), newton).otherwise(middle)
        after = state.join(sums, state["_source"].eqNullSafe(sums["_s"]), "left").select("_source", "target", "mean", F.when(done, F.col("multiplier")).otherwise(moved).alias("multiplier"), F.when(done, F.col("_low")).otherwise(low).alias("_low"), F.when(done, F.col("_high")).otherwise(high).alias("_high"), done.alias("_done"))
        after = materialize(after, "multipliers")
        drop(state)
        state = after
        if state.filter(~F.col("_done")).isEmpty():
            break
    return state.select("_source", "target", "mean", "multiplier"), n_sources


def occurrence(rows: DataFrame, keys: list[str], turn: str = "_turn") -> DataFrame:
    """Adds ``turn``: 0, 1, ... for the rows that are alike in ``keys``.

    Rows alike may be a third of all, so they are never sorted together: the rows of each task are counted by key, the
    counts of the tasks before are added up (one row per key and task), and a row's number is found within its task.
    """
    columns = rows.columns
    own = F.struct(*(F.col(k).alias(f"k{n}") for n, k in enumerate(keys))).alias("key")
    # All columns of the rows travel in one, so that no name can clash.
    placed = materialize(rows.select(F.struct(*columns).alias("x"), own, F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("seq")), "occurrences")
    earlier = Window.partitionBy("key").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("key", "task").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    counts = counts.select(F.col("key").alias("of"), F.col("task").alias("at"), "before")
    within = placed.withColumn("nth", F.row_number().over(Window.partitionBy("key", "task").orderBy("seq")) - 1)
    met = within.join(counts, (F.col("task") == F.col("at")) & F.col("key").eqNullSafe(F.col("of")))
    return met.select(*(F.col(f"x.`{c}`").alias(c) for c in columns), (F.col("before") + F.col("nth")).cast("long").alias(turn))


def number_repeats(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``occurrence``, but rows that nothing repeats are only told so: their keys are counted, they are not sorted."""
    columns = rows.columns
    repeated = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(*(F.col(k).alias(f"_r{n}") for n, k in enumerate(keys)))
    repeated = materialize(repeated, "repeated")
    if repeated.isEmpty():
        return rows.withColumn("_turn", F.lit(0).cast("long"))
    same = F.lit(True)
    for n, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_r{n}"))
    sole = rows.join(repeated, same, "left_anti").withColumn("_turn", F.lit(0).cast("long"))
    return sole.unionByName(occurrence(rows.join(repeated, same, "left_semi").select(*columns), keys))


def _rounded(part: DataFrame, facts: DataFrame, n_sources: int, cap: int) -> DataFrame:
    """Copies of the documents of one level, by systematic rounding in windows of one source and size class."""
    rated = _attach(part, facts, n_sources)
    rated = rated.withColumn("rate", F.when(F.col("size") == 0, 0.0).otherwise(_rate(F.col("multiplier"), F.col("size").cast("double"), F.col("mean"), float(cap))))
    # Rows alike are spread over all windows of their class.
    salt = F.pmod(F.xxhash64("_key", "_turn"), F.coalesce(F.element_at(F.col("_windows"), F.col("_class")), F.lit(1)))
    rated = rated.withColumn("_salt", salt).drop("_windows")
    window = Window.partitionBy("source", "_class", "_salt").orderBy(F.col("size").desc(), "_key", "doc_id", "_turn").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.round(F.sum("rate").over(window), 9)
    copies = F.floor(upto + 0.5) - F.floor(F.round(upto - F.col("rate"), 9) + 0.5)
    copies = F.when(F.col("size") == 0, F.lit(0)).otherwise(F.greatest(F.lit(0), F.least(F.lit(cap), copies))).cast("long")
    return rated.select("doc_id", "source", "size", "_key", "_turn", "rate", copies.alias("copies"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, levels: tuple[int, ...] = (10, 60)) -> DataFrame:
    """Every document with ``source, size, source_size, target, rate, copies`` and ``taken`` (words taken, repeats counted).

    Needs doc_id, text and source; the text and any further columns are not carried. A null text has size 0, a null
    source is a source of its own, weighed last. Documents of size 0 get no copies. Repeated rows count as rows of
    their own and are numbered (``_turn``); an empty table gives an empty result. Reruns agree: order comes from hashes
    of doc_id, text and number, and which of some rows alike has which number is all the same.

    Copies are whole, so a few documents that are large against a target would miss it. Documents of over a tenth of
    their source's target are therefore rounded first, then the dual is solved anew for the rest of the target and the
    rest of the source, and so on by ``levels``; the last documents to be rounded are small ones.
    """
    key = row_key(F.col("doc_id"), F.col("text"))
    size_class = F.floor(F.log2(F.col("size") + 1)).cast("int")
    sized = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("_key")).withColumn("_class", size_class), "sizes")
    base = materialize(number_repeats(sized, ["doc_id", "_key", "source"]), "numbered")
    groups = materialize(base.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "size-groups")
    per_source = groups.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"), (F.sum(F.col("size") * F.col("n")) / F.greatest(F.sum(F.when(F.col("size") > 0, F.col("n"))), F.lit(1))).alias("mean"))
    targets = source_targets(per_source.select("source", "source_size"), weights, float(cap)).withColumnRenamed("source", "_t").drop("source_size")
    windows = groups.groupBy("source", size_class.alias("_class")).agg(F.ceil(F.sum("n") / WINDOW_ROWS).cast("long").alias("_n")).groupBy(F.col("source").alias("_w")).agg(F.map_from_entries(F.collect_list(F.struct("_class", "_n"))).alias("_windows"))
    sources = per_source.join(targets, F.col("source").eqNullSafe(F.col("_t"))).join(windows, F.col("source").eqNullSafe(F.col("_w"))).select("source", "source_size", "target", F.greatest(F.coalesce("mean", F.lit(1.0)), F.lit(1.0)).alias("mean"), "_windows")
    sources = materialize(sources, "sources")
    n_sources = sources.count()
    parts, rest, rest_groups, rest_base = [], sources.withColumn("rest", F.col("target")), groups, base
    for level in (*levels, None):
        limit = F.lit(-1.0) if level is None else F.col("target") / level
        tagged = _attach(rest_groups, rest.select(F.col("source").alias("_source"), "target"), n_sources)
        if level is not None and tagged.filter(F.col("size") > limit).isEmpty():
            continue
        left = rest_groups.groupBy(F.col("source").alias("_l")).agg(F.sum(F.col("size") * F.col("n")).alias("_left"))
        asked = rest.join(left, F.col("source").eqNullSafe(F.col("_l")), "left").select("source", F.coalesce("_left", F.lit(0)).alias("source_size"), F.least(F.greatest(F.col("rest"), F.lit(0.0)), F.coalesce("_left", F.lit(0)) * float(cap)).alias("target"), "mean")
        state, _ = entropy_rates(rest_groups, asked, float(cap))
        facts = materialize(state.drop("target").join(sources.select(F.col("source").alias("_f"), F.col("target"), "_windows"), F.col("_source").eqNullSafe(F.col("_f"))).select("_source", "target", "mean", "multiplier", "_windows"), "source-facts")
        bound = facts.select("_source", F.col("target").alias("_bound"))
        here = _attach(rest_base, bound, n_sources)
        cut = F.lit(-1.0) if level is None else F.col("_bound") / level
        part = _rounded(here.filter(F.col("size") > cut).drop("_bound"), facts, n_sources, cap)
        if level is not None:
            part = materialize(part, "rounded")
            got = part.groupBy(F.col("source").alias("_g")).agg(F.sum(F.col("copies") * F.col("size")).alias("_got"))
            rest = materialize(rest.join(got, F.col("source").eqNullSafe(F.col("_g")), "left").withColumn("rest", F.col("rest") - F.coalesce("_got", F.lit(0))).drop("_g", "_got"), "rest")
            rest_groups = tagged.filter(F.col("size") <= limit).drop("target")
            rest_base = here.filter(F.col("size") <= cut).drop("_bound")
        parts.append(part)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    named = sources.select(F.col("source").alias("_source"), "source_size", "target")
    return _attach(out, named, n_sources).select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"), "_key", "_turn")
