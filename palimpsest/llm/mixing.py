"""Mixing sources to target weights, with DataFrame functions only.

Targets. Sources sorted by code point (null last) weigh 1, 2, 3, repeating, and share as many words as all
documents have. A target stops at ``most`` times its source; the excess goes to the others by weight. Filling
them in order of the level at which they stop gives the result without iteration.

Draws. A source's documents fall into blocks by a hash of their id, of about ``block_words`` words each. A source
is passed over as often as its target holds it whole; of the last pass, it gives blocks in hash order until the
target is reached. One block, and in it one document, is cut, so the words taken equal the rounded target.

Shards. The number of block draws of each source is fixed, so dealing them to shards is a multivariate
hypergeometric draw. It is made by a binary tree: a node halves its slots and draws, source by source, how many
of each go left. All random numbers are hashes of (seed, node, source); so every shard walks its own path from the
root, and shards agree without exchanging anything. A shard's draws of a source are a run of that source's
permuted list, so shards are disjoint and no draw is left over. ``place`` orders the documents inside a shard.

Bounds. Documents are aggregated by (source, block) before anything is ordered. Windows see blocks per source or the
documents of one block, never all documents of a source. The list of quotas has one number for each source.

Defined cases: null or empty text has size 0 and is never taken; a null source is a source, sorted last; equal ids
fall into the same block and are ordered by their row; empty tables give empty results; further columns of the
input don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.tables import few
from palimpsest.workspace import stored

BLANKS = " \t\n\x0b\f\r"
BLOCK_WORDS = 1 << 16
SHARD_WORDS = 1 << 22
SMALL = 500_000


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; null: 0."""
    marks = F.regexp_replace(text, r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++", "x")
    return F.coalesce(F.length(F.translate(marks, BLANKS, "")), F.lit(0)).cast("bigint")


def sized(docs: DataFrame) -> DataFrame:
    """Key columns only, with a number for each row that stays fixed: _row, doc_id, source, size, key."""
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"),
                       F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("key"))
    return stored(rows.withColumn("_row", F.monotonically_increasing_id()), "mix-sizes")


def source_targets(rows: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3,
                   block_words: int = BLOCK_WORDS) -> DataFrame:
    """source, source_size, target, wanted (whole words), passes, rest, blocks (to cut the source into)."""
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    at = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weighed = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), at + 1).cast("bigint"))
    by_level = Window.orderBy(F.col("source_size") * most / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum(F.col("source_size") * most).over(before), F.lit(0))) / F.sum("weight").over(after)
    stops = F.col("source_size") * most / F.col("weight")
    # the first source that stops above the level reached by then, and all after it, stay at that level
    filled = (weighed.withColumn("level", level).withColumn("nth", F.row_number().over(by_level))
              .withColumn("from", F.min(F.when(stops > F.col("level"), F.struct("nth", "level"))).over(whole))
              .withColumn("full", F.col("from").isNull() | (F.col("nth") < F.col("from.nth")))
              .withColumn("open", F.col("from.level")))
    target = F.when(F.col("full"), (F.col("source_size") * most).cast("double")).otherwise(F.col("open") * F.col("weight"))
    wanted = F.least(F.floor(F.col("target") + 0.5), F.col("source_size") * most)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("wanted") / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(0)
    return (filled.withColumn("target", target).withColumn("wanted", wanted.cast("bigint"))
            .withColumn("passes", passes.cast("bigint"))
            .select("source", "source_size", "target", "wanted", "passes",
                    (F.col("wanted") - F.col("passes") * F.col("source_size")).alias("rest"),
                    F.greatest(F.lit(1), F.ceil(F.col("source_size") / block_words)).cast("bigint").alias("blocks")))


def placed(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Every row with its source's figures and its block."""
    t = targets.withColumnRenamed("source", "of")
    block = F.conv(F.substring("key", 1, 12), 16, 10).cast("bigint") % F.col("blocks")
    return rows.join(t, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("block", block)


def block_draws(rows: DataFrame) -> DataFrame:
    """One row per block and pass that takes it: source, block, pass, room (words it may give), rank in its source."""
    blocks = (rows.groupBy("source", "block", "passes", "rest").agg(F.sum("size").alias("words"))
              .filter("words > 0"))
    before = F.sum("words").over(Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    ordered = blocks.withColumn("room", F.col("rest") - F.coalesce(before, F.lit(0)))
    drawn = ordered.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("passes"))))
    drawn = (drawn.filter((F.col("pass") < F.col("passes")) | (F.col("room") > 0))
             .withColumn("room", F.when(F.col("pass") < F.col("passes"), F.col("words")).otherwise(F.least("room", "words"))))
    order = Window.partitionBy("source").orderBy(F.xxhash64("block", "pass"), "block", "pass")
    return drawn.select("source", "block", "pass", "room", (F.col("room") < F.col("words")).alias("cut"),
                        (F.row_number().over(order) - 1).cast("bigint").alias("rank"))


def _hypergeometric(u: Column, pool: Column, marked: Column, drawn: Column) -> Column:
    """How many of ``drawn`` items are marked, by inversion of the weights within eight deviations of the mode."""
    n, k, d = (c.cast("double") for c in (pool, marked, drawn))
    least, top = F.greatest(F.lit(0).cast("bigint"), drawn - pool + marked), F.least(marked, drawn)
    mode = F.floor((d + 1) * (k + 1) / (n + 2))
    spread = 8 * F.sqrt(F.greatest(F.lit(0.0), d * k / n * (1 - k / n) * (n - d) / F.greatest(n - 1, F.lit(1.0)))) + 2
    first = F.greatest(least, (mode - spread).cast("bigint"))
    last = F.least(top, (mode + spread).cast("bigint"))
    ratio = lambda x: (k - x) * (d - x) / ((x + 1) * (n - k - d + x + 1))  # noqa: E731  weight at x + 1 over weight at x
    steps = F.sequence(first, last)
    total = F.aggregate(steps, F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum")),
                        lambda a, x: F.struct((a.w * ratio(x)).alias("w"), (a["sum"] + a.w).alias("sum")), lambda a: a["sum"])
    found = F.aggregate(steps, F.struct(F.lit(1.0).alias("w"), (u * total).alias("left"), first.alias("at")),
                        lambda a, x: F.struct((a.w * ratio(x)).alias("w"), (a.left - a.w).alias("left"),
                                              F.when(a.left - a.w > 0, F.least(x + 1, last)).otherwise(a["at"]).alias("at")),
                        lambda a: a["at"])
    return F.when(top <= least, least).otherwise(found)


def shard_quotas(draws: DataFrame, targets: DataFrame, shard_words: int = SHARD_WORDS, seed: int = 17) -> DataFrame:
    """source, shard, first, quota: the run of a source's ranks that each shard gets."""
    counts = draws.groupBy(F.col("source").alias("of")).agg(F.count("*").alias("n"))
    depth = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.sum("wanted") / shard_words, F.lit(1.0))))).cast("int")
    # one row; its list is as long as there are sources with words
    listed = (targets.join(counts, F.col("source").eqNullSafe(F.col("of")))
              .agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("sources"), F.coalesce(depth, F.lit(0)).alias("depth")))
    root = listed.filter(F.size("sources") > 0).withColumn("shard", F.explode(F.expr("sequence(0L, shiftleft(1L, depth) - 1)")))
    root = root.repartition("shard")
    empty = F.array().cast("array<bigint>")

    def left_part(q: Column, node: Column, slots: Column) -> Column:
        def step(a: Column, i: Column) -> Column:
            here = F.element_at(q, i)
            u = F.pmod(F.xxhash64(F.lit(seed), node, i), F.lit(1 << 53)) / F.lit(float(1 << 53))
            x = F.when(a["need"] <= 0, F.lit(0).cast("bigint")).otherwise(_hypergeometric(u, a["pool"], here, a["need"]))
            return F.transform(F.array(x), lambda got: F.struct(F.concat(a["out"], F.array(got)).alias("out"),
                               (a["need"] - got).alias("need"), (a["pool"] - here).alias("pool")))[0]
        return F.aggregate(F.sequence(F.lit(1), F.size(q)), F.struct(empty.alias("out"), F.floor(slots / 2).cast("bigint").alias("need"), slots.alias("pool")),
                           step, lambda a: a["out"])

    def down(a: Column, level: Column) -> Column:
        slots = F.aggregate(a["q"], F.lit(0).cast("bigint"), lambda s, x: s + x)
        shift = F.col("depth") - level
        node = F.call_function("shiftleft", F.lit(1).cast("bigint"), level) + F.expr("shard").bitwiseAND(F.lit(-1).cast("bigint")) / F.pow(F.lit(2.0), shift)
        node = F.floor(node).cast("bigint")
        right = F.pmod(F.floor(F.col("shard") / F.pow(F.lit(2.0), shift - 1)), F.lit(2)) == 1
        return F.transform(F.array(left_part(a["q"], node, slots)), lambda lq: F.struct(
            F.when(right, F.zip_with(a["q"], lq, lambda x, y: x - y)).otherwise(lq).alias("q"),
            F.when(right, F.zip_with(a["off"], lq, lambda x, y: x + y)).otherwise(a["off"]).alias("off")))[0]

    q = F.transform("sources", lambda s: s["n"])
    zero = F.transform("sources", lambda s: F.lit(0).cast("bigint"))
    levels = F.when(F.col("depth") > 0, F.sequence(F.lit(0), F.col("depth") - 1)).otherwise(F.array().cast("array<int>"))
    leaf = F.aggregate(levels, F.struct(q.alias("q"), zero.alias("off")), down)
    return (root.select("shard", "sources", leaf.alias("leaf"))
            .select("shard", F.posexplode(F.arrays_zip(F.col("sources.source").alias("source"), F.col("leaf.q").alias("quota"), F.col("leaf.off").alias("first"))).alias("at", "x"))
            .select("x.source", "shard", "x.first", "x.quota").filter("quota > 0"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, block_words: int = BLOCK_WORDS,
        shard_words: int = SHARD_WORDS, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(rows, taken). rows: every input row with _row, size, source_size and target. taken: one row per document and
    pass that takes it: _row, pass, shard, words (fewer than its size for the cut document), place (order in the shard)."""
    rows = sized(docs)
    targets = stored(source_targets(rows, weights, most, block_words), "mix-targets")
    every = placed(rows, targets)
    draws = stored(block_draws(every), "mix-draws")
    runs = shard_quotas(draws, targets, shard_words, seed)
    dealt = (runs.withColumn("rank", F.explode(F.expr("sequence(first, first + quota - 1)"))).select(F.col("source").alias("of"), F.col("rank").alias("at"), "shard"))
    drawn = draws.join(dealt, F.col("source").eqNullSafe(F.col("of")) & (F.col("rank") == F.col("at"))).drop("of", "at", "rank")
    docs_of = every.filter("size > 0").select("_row", "key", "size", F.col("source").alias("from"), F.col("block").alias("in_block"))
    got = docs_of.join(drawn, F.col("from").eqNullSafe(F.col("source")) & (F.col("in_block") == F.col("block"))).drop("from", "in_block")
    before = F.sum("size").over(Window.partitionBy("source", "block").orderBy("key", "_row").rowsBetween(Window.unboundedPreceding, -1))
    cut = (got.filter("cut").withColumn("words", F.least(F.col("size"), F.col("room") - F.coalesce(before, F.lit(0))))
           .filter("words > 0"))
    taken = got.filter("not cut").withColumn("words", F.col("size")).unionByName(cut)
    return every, taken.select("_row", "pass", "shard", "words", F.xxhash64(F.lit(seed), "key", "_row", "pass").alias("place"))


def mixed(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The mix itself: rows of ``docs`` as often as they are taken, by shard and in each shard's order. ``key`` names the rows. Of
    the cut document, the words taken remain, with the white space in front of and between them; ``n_chars`` follows."""
    every, taken = mix(docs.select(F.col(key).alias("doc_id"), "text", "source"), **options)
    named = taken.join(every.select(F.col("_row").alias("_of"), F.col("doc_id").alias("_mix_name"), "size"), F.col("_row") == F.col("_of"))
    picks = stored(named.select("_mix_name", F.col("shard").alias("_mix_shard"), F.col("place").alias("_mix_place"), F.col("words").alias("_mix_words"),
                                (F.col("words") < F.col("size")).alias("_mix_cut")), "mix-picks")
    rows = docs.join(few(picks, SMALL), F.col(key) == F.col("_mix_name"))
    blank = r"[\x20\x09-\x0D]"
    parts = F.split("text", rf"(?<={blank})(?=[^\x20\x09-\x0D])")  # each word with what follows it; white space in front apart
    front = F.when(F.col("text").rlike(rf"^{blank}"), 1).otherwise(0)
    whole = rows.filter("not _mix_cut")
    short = rows.filter("_mix_cut").withColumn("text", F.regexp_replace(F.array_join(F.slice(parts, F.lit(1), (F.col("_mix_words") + front).cast("int")), ""), rf"{blank}+$", ""))
    if "n_chars" in docs.columns:
        short = short.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return whole.unionByName(short).repartition("_mix_shard").sortWithinPartitions("_mix_shard", "_mix_place").select(docs.columns)


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row."""
    rows, taken = mix(docs, **options)
    words = taken.groupBy(F.col("_row").alias("_of")).agg(F.sum("words").alias("taken"))
    return (rows.join(words, F.col("_row") == F.col("_of"), "left")
            .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken")))
