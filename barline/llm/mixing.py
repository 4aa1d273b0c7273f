"""Mixing sources to target weights, by blocks that are joined by index.

Each source's words stand in one pseudorandom document order and are cut into
blocks of ``block_words``. A source has as many output slots as its target needs
blocks; the slots of all sources are dealt to equal shards by a keyed permutation
of their numbers. A shard's source counts are so a multinomial draw given that
all quotas are used up (a multivariate hypergeometric one), and even the
smallest source comes within a block of its target. The j-th slot of a source
reads block pi(j mod blocks), pi a keyed permutation of the source's block
numbers, another for each turn; slots and blocks meet in an equi-join on
(source, block). The result says which shards get a document's words, and the
mix can be had by shard.

Only DataFrame functions are used. Slots are exploded from chunks of a source's
slots, so a large source is spread over many tasks. Prefix sums are two-level
(hash buckets, then rows), so a source with a third of all rows is never in one
task; the windows without a bucket see one row per source (60 bytes each), or
per (source, bucket).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.llm.common import full_text, let, materialize, n_words, words

# Weights by source in code-point order, repeating; the cap on repeats.
WEIGHTS = (5, 2, 1)
MAX_PASSES = 3
ROUNDS = 24
SLOT_CHUNK = 1 << 16


def permute(df: DataFrame, i: str, n: Column, *key) -> DataFrame:
    """Replaces the column ``i``, in 0..n-1, by a keyed permutation of it: a swap-or-not shuffle for any n.

    A select per round: each stays a small piece of generated code.
    """
    others = [c for c in df.columns if c != i]
    df = df.withColumns({"__n": n.cast("long"), "__key": F.xxhash64(*key)})
    for r in range(ROUNDS):
        df = df.withColumn("__other", F.pmod(F.pmod(F.xxhash64("__key", F.lit(r)), F.col("__n")) - F.col(i), F.col("__n")))
        df = df.withColumn("__top", F.greatest(i, "__other"))
        df = df.withColumn(i, F.when(F.xxhash64("__key", "__top", F.lit(r)).bitwiseAND(1) == 0, F.col("__other")).otherwise(F.col(i)))
    return df.select(*others, i)


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_passes: int = MAX_PASSES) -> DataFrame:
    """(src, source, source_size, target) by source; ``sizes`` has source, size.

    The shares of all words by weight, cut at ``max_passes`` times a source's
    size, the excess shared again: with sources ordered by cap/weight, the level
    is the largest (total - caps before) / (weights not before).
    """
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("src", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    s = s.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("src") - 1) % len(weights) + 1))
    s = s.withColumn("cap", F.col("source_size") * float(max_passes))
    before = Window.orderBy(F.col("cap") / F.col("w"), "src").rowsBetween(Window.unboundedPreceding, -1)
    s = s.select(
        "*",
        F.sum("source_size").over(everything).alias("all_words"),
        F.sum("w").over(everything).alias("all_w"),
        F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("caps"),
        F.coalesce(F.sum("w").over(before), F.lit(0.0)).alias("ws"),
    )
    s = s.withColumn("level", F.max((F.col("all_words") - F.col("caps")) / (F.col("all_w") - F.col("ws"))).over(everything))
    return s.select("src", "source", "source_size", F.least("cap", F.col("level") * F.col("w")).alias("target"))


def slots(targets: DataFrame, total: int, shard_slots: int, seed: int, chunk: int = SLOT_CHUNK) -> DataFrame:
    """(src, shard, turn, block): the shard of each output slot, and the block it reads in which turn through its source.

    ``targets`` has src, blocks, slots and base (the slots of the sources before);
    ``total`` is the sum of all slots.
    """
    chunks = targets.filter("slots > 0").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(slots - 1) div {chunk}"))))
    chunks = chunks.repartition(max(1, -(-total // chunk)), "src", "chunk")
    first, last = F.col("chunk") * chunk, F.least(F.col("slots"), (F.col("chunk") + 1) * chunk) - 1
    drawn = chunks.select("src", "blocks", "base", F.explode(F.sequence(first, last)).alias("j"))
    drawn = drawn.withColumn("place", F.col("base") + F.col("j")).drop("base")
    drawn = permute(drawn, "place", F.lit(max(total, 1)), F.lit(seed))
    n_shards = max(1, round(total / shard_slots))
    drawn = drawn.select("src", "blocks", F.expr(f"place div {-(-total // n_shards) or 1}").alias("shard"), F.expr("j div blocks").alias("turn"), F.expr("j % blocks").alias("block"))
    return permute(drawn, "block", F.col("blocks"), F.lit(seed), F.col("src"), F.col("turn")).select("src", "shard", "turn", "block")


def shard_counts(drawn: DataFrame) -> DataFrame:
    """(shard, src, n): the draw itself, how many blocks of each source a shard gets."""
    return drawn.groupBy("shard", "src").agg(F.count("*").alias("n"))


def plan_mix(sized: DataFrame, block_words: int = 64, shard_slots: int = 4096, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """``sized`` (materialized): uid, doc_id, source, size. Returns (targets, spans).

    spans: uid, start (word in the document), length, takes (the turn and the
    shard of each slot that reads the block, at most MAX_PASSES).
    """
    total = sized.count()
    buckets = max(1, int(total**0.5))
    targets = source_targets(sized)
    blocks = F.ceil(F.col("source_size") / block_words)
    wanted = F.when(F.col("source_size") > 0, F.round(F.col("target") * F.col("blocks") / F.col("source_size"))).otherwise(0)
    targets = targets.withColumn("blocks", blocks).withColumn("slots", F.least(wanted.cast("long"), MAX_PASSES * F.col("blocks")))
    before = Window.orderBy("src").rowsBetween(Window.unboundedPreceding, -1)
    targets = materialize(targets.withColumn("base", F.coalesce(F.sum("slots").over(before), F.lit(0))))
    n_slots = targets.agg(F.sum("slots")).first()[0] or 0

    placed = sized.filter("size > 0").withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "uid"))
    placed = placed.withColumn("bucket", F.expr(f"pmod(h, {buckets})"))
    placed = placed.join(targets.select("src", F.col("source").alias("s")), F.col("source").eqNullSafe(F.col("s"))).select("uid", "size", "h", "bucket", "src")
    sums = placed.groupBy("src", "bucket").agg(F.sum("size").alias("n"))
    ahead = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("src", "bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    within = Window.partitionBy("src", "bucket").orderBy("h", "uid").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("at", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = placed.join(sums, ["src", "bucket"]).withColumn("at", F.col("at") + F.col("base"))
    cut = placed.select("uid", "src", "at", "size", F.explode(F.sequence(F.floor(F.col("at") / block_words), F.floor((F.col("at") + F.col("size") - 1) / block_words))).alias("block"))
    begin = F.greatest(F.col("at"), F.col("block") * block_words)
    end = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block_words)
    cut = cut.select("uid", "src", "block", (begin - F.col("at")).alias("start"), (end - begin).alias("length"))
    takes = F.array_sort(F.collect_list(F.struct("turn", "shard"))).alias("takes")
    read = materialize(slots(targets, n_slots, shard_slots, seed).groupBy("src", "block").agg(takes))
    return targets, cut.join(read, ["src", "block"]).select("uid", "start", "length", "takes")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken, shards (those that get words of it, rising).

    Defined cases: a null text has size 0 and is never taken; a null source is a
    source of its own, ordered last; repeated rows are documents of their own
    and get blocks of their own; an empty table, or one without a word, gives
    targets and takes of 0; further columns are ignored. A document's words are
    taken at most three times (whole blocks at most three times each). Reruns
    on the same files agree.
    """
    sized = materialize(
        docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(full_text(text_col)).alias("size")).withColumn("uid", F.monotonically_increasing_id())
    )
    targets, spans = plan_mix(sized, **options)
    taken = spans.select("uid", "length", F.explode("takes.shard").alias("shard")).groupBy("uid", "shard").agg(F.sum("length").alias("words"))
    taken = taken.groupBy("uid").agg(F.sum("words").alias("taken"), F.array_sort(F.collect_list("shard")).alias("shards"))
    t = targets.select(F.col("source").alias("s"), "source_size", "target")
    return (
        sized.join(t, F.col("source").eqNullSafe(F.col("s")))
        .join(taken, "uid", "left")
        .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("shards", F.array().cast("array<bigint>")).alias("shards"))
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", by_shard: bool = False, **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row per document and turn through its source.

    A turn that takes a whole document keeps its text as it is; one that takes
    some of its blocks has their words, joined by a space. ``by_shard``: a row
    per document, turn and output shard, with the words that the shard draws,
    and the column ``shard`` first; a document whose blocks go to several shards
    has a row in each. Documents of which nothing is taken have no row. Null
    texts and sources as in ``mix``.
    """
    held = materialize(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).withColumn("uid", F.monotonically_increasing_id()))
    text = full_text(F.col("row")[text_col])
    sized = materialize(held.select("uid", F.col("row")[id_col].alias("doc_id"), F.col("row")[source_col].cast("string").alias("source"), n_words(text).alias("size")))
    _, spans = plan_mix(sized, **options)
    per = ["uid", "turn", *(["shard"] if by_shard else [])]
    spans = spans.select("uid", "start", "length", F.explode("takes").alias("t")).select("uid", "start", "length", "t.*")
    taken = spans.groupBy(*per).agg(F.sort_array(F.collect_list(F.struct("start", "length"))).alias("mine"), F.sum("length").alias("n"))
    out = held.join(taken.join(sized.select("uid", "size"), "uid"), "uid")

    def cut(ws):
        return F.array_join(F.flatten(F.transform("mine", lambda x: F.slice(ws, (x["start"] + 1).cast("int"), x["length"].cast("int")))), " ")

    new_text = F.when(F.col("n") < F.col("size"), let(words(text), cut)).otherwise(F.col("row")[text_col])
    shard = [F.col("shard")] if by_shard else []
    return out.withColumn("new_text", new_text).select(*shard, *[F.col("new_text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])
