"""Mixing sources to target weights by Sainte-Laguë apportionment, with DataFrame functions only.

Sizes are words.  Every source is dealt into shards by a seeded hash of the
document, each shard is one line of words in seeded order, cut into blocks of
``block`` words.  Blocks are seats: the highest quotients ``target / (2k + 1)``
give each source an integer number of blocks, those of the shard sizes divide
them among its shards.  A shard that gets more blocks than it has is taken in
whole as often as it fits; of the rest, a seeded permutation picks exactly the
number left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlane.llm.rules import words

#: Weights by rank of the source, repeating.
WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK = 16
#: Words of a shard; a source so large that it would have more shards than a shard has words is dealt into as many as the root of its words.
SHARD_WORDS = 1 << 16
SEED = "mix-1"


def seeded(seed: str, *cols: Column) -> Column:
    """A non-negative 60-bit number that other engines can compute too."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("null")) for c in cols])), 1, 15), 16, 10).cast("long")


def sainte_lague(df: DataFrame, votes: str, seats: str, party: list[str], group: list[str] | None = None) -> DataFrame:
    """``df`` with ``quota``: ``seats`` (the same in each group) by highest quotients; ties to the smaller ``party``.

    With V votes of n parties and N seats, party i has at least
    ``floor(v_i (N - n/2) / V + 1/2)`` and at most ``floor(v_i (N + n/2) / V + 1/2)``
    seats, so only the quotients between compete: about n rows a group.
    """
    group = group or []
    w = Window.partitionBy(*[df[g] for g in group])
    d = df.withColumn("sl_v", F.sum(votes).over(w)).withColumn("sl_n", F.sum(F.when(F.col(votes) > 0, 1).otherwise(0)).over(w))
    bound = lambda sign: F.when(F.col("sl_v") > 0, F.floor(F.col(votes) * F.greatest(F.lit(0.0), F.col(seats) + F.lit(sign * 0.5) * F.col("sl_n")) / F.col("sl_v") + 0.5)).otherwise(F.lit(0)).cast("long")
    d = d.withColumn("sl_low", F.greatest(F.lit(0), bound(-1) - 1)).withColumn("sl_high", bound(1) + 1)
    d = d.withColumn("sl_open", F.col(seats) - F.sum("sl_low").over(w))
    keys = [*group, *party]
    runs = d.where(F.col(votes) > 0).select(*keys, "sl_open", (F.col(votes)).alias("sl_votes"), F.explode(F.sequence("sl_low", "sl_high")).alias("sl_k"))
    rank = Window.partitionBy(*group).orderBy(F.desc("sl_q"), *[F.asc_nulls_last(p) for p in party])
    won = runs.withColumn("sl_q", F.col("sl_votes") / (2.0 * F.col("sl_k") + 1.0)).withColumn("sl_rank", F.row_number().over(rank))
    won = won.groupBy(*[F.col(k).alias(f"sl_key_{k}") for k in keys]).agg(F.sum(F.when(F.col("sl_rank") <= F.col("sl_open"), 1).otherwise(0)).cast("long").alias("sl_won"))
    cond = [F.col(k).eqNullSafe(F.col(f"sl_key_{k}")) for k in keys]
    return d.join(won, cond, "left").select(*df.columns, (F.col("sl_low") + F.coalesce("sl_won", F.lit(0))).alias("quota"))


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """For each ``source`` its ``source_size``, rank and ``target``: shares by weight, none above ``most`` times its size."""
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.asc_nulls_last("source"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1)
    s = s.withColumn("rank", F.row_number().over(order)).withColumn("weight", weight.cast("long"))
    every = Window.partitionBy()
    full = Window.orderBy(F.col("ceiling") / F.col("weight"), "rank")
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    after = full.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn("ceiling", F.col("source_size") * most).withColumn("total", F.sum("source_size").over(every))
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("ceiling").over(before), F.lit(0))) / F.sum("weight").over(after))
    # sources fill up in this order; the first level that its own source can take is the level of all the rest
    s = s.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("ceiling"), F.struct(F.col("ceiling") / F.col("weight"), F.col("rank"), F.col("level").alias("level")))).over(every)["level"])
    share = F.col("level") * F.col("weight")
    return s.select("source", "source_size", "total", F.coalesce(F.least(share, F.col("ceiling").cast("double")), F.col("ceiling").cast("double")).alias("target"))


def plan(docs: DataFrame, weights=WEIGHTS, most: int = MOST, block: int = BLOCK, seed: str = SEED, shard_words: int = SHARD_WORDS, carry: bool = False) -> DataFrame:
    """How often and in which parts each document is taken.

    One row for each input row: ``doc_id``, ``source``, ``size``,
    ``source_size``, ``target``, ``copies`` (whole passes), ``first`` and
    ``last`` (its words on its shard's line), ``blocks``, ``picked``, ``mul``,
    ``add`` (the permutation) and ``taken``.  A null text has no words and is
    never taken; a null source is a source of its own, last in order.  Rows
    with the same id are laid out side by side in any order, with the same
    words taken in total.  With ``carry`` each row has its own row of ``docs`` as
    ``own_row``, and such rows are in its order.
    """
    own = [F.struct(*[docs[c] for c in docs.columns]).alias("own_row")] if carry else []
    d = docs.select(docs["doc_id"].alias("doc_id"), docs["source"].alias("source"), F.size(words(docs["text"])).cast("long").alias("size"), *own)
    s = targets(d, weights, most)
    seats = F.round(F.col("total") / block).cast("long")
    s = sainte_lague(s.withColumn("seats", seats), "target", "seats", ["source"]).withColumnRenamed("quota", "source_quota").drop("seats", "total")
    s = s.withColumn("n_shards", F.greatest(F.lit(1), F.least(F.ceil(F.sqrt("source_size")), F.ceil(F.col("source_size") / shard_words))).cast("long"))
    d = d.join(s.withColumnRenamed("source", "own"), F.col("source").eqNullSafe(F.col("own"))).drop("own")
    d = d.withColumn("place", seeded(seed, F.col("doc_id"))).withColumn("shard", F.pmod(F.col("place"), F.col("n_shards")))
    line = Window.partitionBy("source", "shard").orderBy("place", "doc_id", "size", *(["own_row"] if carry else []))
    d = d.withColumn("last", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0))).withColumn("first", F.col("last") - F.col("size"))
    parts = d.groupBy("source", "shard").agg(F.sum("size").alias("words"), F.first("source_quota").alias("seats"))
    parts = sainte_lague(parts, "words", "seats", ["shard"], ["source"])
    parts = parts.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("words") / block)).cast("long")).withColumn("quota", F.least("quota", F.col("blocks") * most))
    parts = parts.withColumn("copies", F.floor(F.col("quota") / F.col("blocks")).cast("long")).withColumn("picked", F.col("quota") - F.col("copies") * F.col("blocks"))
    # a multiplier without a common factor makes j -> (mul * j + add) mod blocks a permutation
    tries = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.pmod(seeded(seed + "-mul", F.col("source"), F.col("shard")) + i, F.greatest(F.col("blocks"), F.lit(2))))
    parts = parts.withColumn("mul", F.coalesce(F.get(F.filter(tries, lambda x: _gcd(x, F.col("blocks")) == 1), F.lit(0)), F.lit(1)).cast("long")).withColumn("add", F.pmod(seeded(seed + "-add", F.col("source"), F.col("shard")), F.col("blocks")))
    parts = parts.select(F.col("source").alias("own"), F.col("shard").alias("own_shard"), "blocks", "copies", "picked", "mul", "add")
    d = d.join(parts, F.col("source").eqNullSafe(F.col("own")) & (F.col("shard") == F.col("own_shard"))).drop("own", "own_shard")
    return d.withColumn("taken", F.col("copies") * F.col("size") + part_words(block))


def _gcd(a: Column, b: Column) -> Column:
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    step = lambda s, _: F.struct(F.when(s["b"] == 0, s["a"]).otherwise(s["b"]).alias("a"), F.when(s["b"] == 0, F.lit(0).cast("long")).otherwise(F.pmod(s["a"], F.nullif(s["b"], F.lit(0).cast("long")))).alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(64)), start, step, lambda s: s["a"])


def is_picked(j: Column) -> Column:
    """Whether the shard's block ``j`` is among those picked."""
    return F.pmod(F.pmod(j, F.col("blocks")) * F.col("mul") + F.col("add"), F.col("blocks")) < F.col("picked")


def picked_blocks(block: int) -> Column:
    """The picked blocks that a document touches, ascending."""
    return picked_blocks_of("size", block)


def part_words(block: int) -> Column:
    return F.aggregate(picked_blocks(block), F.lit(0).cast("long"), lambda a, j: a + F.least(F.col("last"), (j + 1) * block) - F.greatest(F.col("first"), j * block))


def mixed(docs: DataFrame, block: int = 64, **options) -> DataFrame:
    """The mix itself: each document as many times as ``copies`` says, and once more with the words of its picked blocks.

    Rows have the columns of ``docs`` (``n_chars``, if there, is that of the
    new text).  Whole copies keep their text unchanged; in a part, words stand
    one space apart.
    """
    cols = docs.columns
    d = plan(docs, block=block, carry=True, **options).where("taken > 0").select("own_row", F.col("size").alias("mix_size"), "first", "last", "blocks", "picked", "copies", "mul", "add")
    cut = F.transform(picked_blocks_of("mix_size", block), lambda j: F.array_join(F.slice(F.col("mix_words"), (F.greatest(F.col("first"), j * block) - F.col("first") + 1).cast("int"), (F.least(F.col("last"), (j + 1) * block) - F.greatest(F.col("first"), j * block)).cast("int")), " "))
    d = d.withColumn("mix_words", words(F.col("own_row.text"))).withColumn("mix_part", F.array_join(cut, " "))
    every = F.concat(F.array_repeat(F.col("own_row.text"), F.col("copies").cast("int")), F.when(F.col("mix_part") != "", F.array(F.col("mix_part"))).otherwise(F.array().cast("array<string>")))
    d = d.withColumn("mix_text", F.explode(every))
    made = {"text": F.col("mix_text")} | ({"n_chars": F.length("mix_text").cast(dict(docs.dtypes)["n_chars"])} if "n_chars" in cols else {})
    return d.select(*[made.get(c, F.col("own_row")[c]).alias(c) for c in cols])


def picked_blocks_of(size: str, block: int) -> Column:
    touched = F.sequence(F.floor(F.col("first") / block).cast("long"), F.floor((F.col("last") - 1) / block).cast("long"))
    return F.when((F.col(size) > 0) & (F.col("picked") > 0), F.filter(touched, is_picked)).otherwise(F.array().cast("array<long>"))
