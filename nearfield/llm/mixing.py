"""Mixing sources to target weights by hash order, distributed prefix sums and an exact cut.

Each document gets a hash-random 60-bit key. Within a source the key's leading bits deal the documents
into ranges; prefix sums over the ranges' word counts find the one range in which the source's budget
ends, and only that range is sorted document by document. So whatever the size of a source, no task
holds more than one range of it, and no text is shuffled.

Defined results: null text and text without words have size 0 and get 0 words; a null source is a
source of its own, ordered last; rows of the same key are ordered by id and size; a source of size 0 has
target 0; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hash60, persist_table, word_count

KEY_BITS = 60
#: Ranges of a source. A range holds a 16,384th of a source's documents.
RANGE_BITS = 14
#: Per-source tables up to this many rows are broadcast (below 64 bytes a row); larger ones are joined by shuffle.
BROADCAST_SOURCES = 50_000


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str) -> DataFrame:
    size = word_count(F.col(text_col))
    light = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"))
    return light.withColumn("key", hash60(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.col("size").cast("string"))))


def _ranked(totals: DataFrame) -> DataFrame:
    """Sources numbered from 0 by code point, null last, without gathering them in one task."""
    spark = totals.sparkSession
    ordered = persist_table(totals.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()), "mix-order")
    counts = ordered.groupBy(F.shiftright("at", 33).alias("part")).count().collect()  # a row for each task of the sort
    starts, total = [], 0
    for part, n in sorted((r[0], r[1]) for r in counts):
        starts.append((part, total))
        total += n
    if not starts:
        return ordered.withColumn("rank", F.lit(0).cast("long")).drop("at")
    offsets = spark.createDataFrame(starts, "part long, start long")
    return ordered.withColumn("part", F.shiftright("at", 33)).join(F.broadcast(offsets), "part").withColumn("rank", F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop("at", "part", "start")


def _targets(totals: DataFrame, weights: Sequence[int], max_epochs: int) -> tuple[DataFrame, int]:
    """A source's share of all words by weight; what lies above max_epochs times its size is shared again."""
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = persist_table(_ranked(totals).withColumn("weight", weight.cast("long")).withColumn("cap", max_epochs * F.col("source_size")), "mix-sources")
    n, total = ranked.agg(F.count("*"), F.coalesce(F.sum("source_size"), F.lit(0))).first()
    held, open_weight, before = 0, 0, -1
    while True:  # each round closes at least one of the weights' groups of sources, so a few rounds do
        full = F.lit(False) if before < 0 else F.col("cap") * F.lit(open_weight) <= F.lit(total - held) * F.col("weight")
        state = ranked.agg(
            F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)), F.count(F.when(full, 1))
        ).first()
        if state[2] == before:
            break
        held, open_weight, before = state
        if not open_weight:
            break
    share = (F.lit(total - held) * F.col("weight")) / F.lit(float(open_weight or 1))
    full = F.col("cap") * F.lit(open_weight) <= F.lit(total - held) * F.col("weight") if open_weight else F.lit(True)
    return ranked.withColumn("target", F.when(full, F.col("cap").cast("double")).otherwise(share)), n


def plan_cuts(light: DataFrame, weights: Sequence[int] = (5, 2, 1), max_epochs: int = 3) -> tuple[DataFrame, int]:
    """One row per source: source, source_size, target, epochs, cut_key, cut_rest; and their number.

    Keys below cut_key are taken once more than epochs times, keys above it are not; cut_rest words remain
    for the documents of cut_key itself. cut_key is -1 where the budget ends with a whole epoch.
    """
    at = F.shiftright("key", KEY_BITS - RANGE_BITS).alias("range")
    ranges = persist_table(light.groupBy("source", at).agg(F.sum("size").alias("range_size")), "mix-ranges")
    sources, n = _targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, max_epochs)
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(0)
    sources = sources.withColumn("epochs", epochs.cast("long")).withColumn("rest", (budget - F.col("epochs") * F.col("source_size")).cast("long"))
    sources = persist_table(sources.select("source", "source_size", "target", "epochs", "rest"), "mix-targets")
    hint = F.broadcast if n <= BROADCAST_SOURCES else (lambda df: df)

    def ends_in(rows: DataFrame, keys: list[str], size: str) -> DataFrame:
        """The one row of each source in whose words the rest ends; rest becomes what lies in it."""
        w = Window.partitionBy("source").orderBy(*keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        upto = rows.withColumn("upto", F.sum(size).over(w))
        return upto.where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col(size) <= F.col("rest"))).withColumn("rest", F.col("rest") - (F.col("upto") - F.col(size))).drop("upto")

    left = sources.select(F.col("source").alias("s"), "rest").where("rest > 0")
    cut = ends_in(ranges.join(hint(left), F.col("source").eqNullSafe(F.col("s"))), ["range"], "range_size").select("s", F.col("range").alias("cut_range"), "rest")
    cut = persist_table(cut, "mix-cut-ranges")
    inside = light.withColumn("range", at).join(hint(cut), F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("cut_range")))
    by_key = inside.groupBy("source", "key", "rest").agg(F.sum("size").alias("key_size"))
    keys = ends_in(by_key, ["key"], "key_size").select(F.col("source").alias("s"), F.col("key").alias("cut_key"), F.col("rest").alias("cut_rest"))
    cuts = sources.join(hint(keys), F.col("source").eqNullSafe(F.col("s")), "left").select(
        "source", "source_size", "target", "epochs", F.coalesce("cut_key", F.lit(-1)).alias("cut_key"), F.coalesce("cut_rest", F.lit(0)).alias("cut_rest")
    )
    return persist_table(cuts, "mix-cuts"), n


def allocate(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), max_epochs: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix") -> DataFrame:
    """Words that the mix takes of each document: id_col, size, source_size, target, taken.

    The document in which a source's budget ends gives only the words up to it, so a source's taken words
    are its target rounded down.
    """
    light = persist_table(_keyed(docs, id_col, text_col, source_col, seed), "mix-light")
    cuts, n = plan_cuts(light, weights, max_epochs)
    side = cuts.withColumnRenamed("source", "s")
    rows = light.join(F.broadcast(side) if n <= BROADCAST_SOURCES else side, F.col("source").eqNullSafe(F.col("s")))
    whole = rows.where("key <> cut_key").withColumn("more", F.when(F.col("key") < F.col("cut_key"), F.col("size")).otherwise(0))
    w = Window.partitionBy("source", "key").orderBy("id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    partly = rows.where("key = cut_key").withColumn("upto", F.sum("size").over(w))
    partly = partly.withColumn("more", F.greatest(F.lit(0), F.least(F.col("size"), F.col("cut_rest") - F.col("upto") + F.col("size")))).drop("upto")
    return whole.unionByName(partly).select(
        F.col("id").alias(id_col), "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("more")).cast("long").alias("taken")
    )


def repeat_documents(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), max_epochs: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix") -> DataFrame:
    """The mixed corpus: whole rows of docs, each as often as the mix takes it.

    Texts stay whole: the document in which a source's budget ends is taken if at least half of it lies
    before the end. Documents without words take no part in any budget and are kept once.
    """
    light = persist_table(_keyed(docs, id_col, text_col, source_col, seed), "mix-light")
    cuts, n = plan_cuts(light, weights, max_epochs)
    side = cuts.select(*[F.col(c).alias(f"__mix_{c}") for c in cuts.columns])
    size = word_count(F.col(text_col))
    key = hash60(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.col("__mix_size").cast("string")))
    rows = docs.withColumn("__mix_size", size).withColumn("__mix_key", key)
    rows = rows.join(F.broadcast(side) if n <= BROADCAST_SOURCES else side, F.col(source_col).eqNullSafe(F.col("__mix_source")))
    more = (F.col("__mix_key") < F.col("__mix_cut_key")) | ((F.col("__mix_key") == F.col("__mix_cut_key")) & (2 * F.col("__mix_cut_rest") >= F.col("__mix_size")))
    copies = F.when(F.col("__mix_size") == 0, 1).otherwise(F.col("__mix_epochs") + more.cast("int"))
    once = rows.withColumn("__mix_copies", copies.cast("int")).where("__mix_copies > 0")
    return once.withColumn("__mix_copy", F.explode(F.expr("sequence(1, __mix_copies)"))).select(*docs.columns)
