"""Mixing sources to target weights, by blocks of a fixed number of words (operator 7).

The words of a source's documents form one stream, cut in blocks. Output shards have a fixed number of slots.
Each shard's slots per source are a multinomial draw, conditioned on the corpus's totals so that targets are
met: the N strata of the cumulative weights are dealt to the N slots by a pseudorandom permutation. The
slots of a source are numbered over the shards and mapped to block numbers by the source's own permutation,
once around for every pass over it; blocks join by number. Permutations are swap-or-not networks: exact for
any length, and a pure function of the index. All of it is DataFrame expressions.

Documents lie in their source's stream in the order of a hash bucket, then id, then text hash, so reruns
agree, and the number of buckets is the same for all tables. Starts come from bucket sums first, so no task orders a whole source.

Defined cases: a null text has no words; a null ``source`` is a source of its own, after all others; rows
without words are returned and take nothing; repeated rows are documents of their own, each with its part;
a null ``doc_id`` is an id like any other. An empty table, or one without a word, takes nothing. Further columns are
kept by ``mixed_documents``, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.operators.ids import rank_distinct
from cohortspark.session import tuned, written

#: Words in a block, and slots in an output shard.
BLOCK_WORDS = 128
SHARD_SLOTS = 4096
#: Weights of the sources in code-point order, repeating; the share of all words that is taken; passes at most.
WEIGHTS = (3, 1, 2)
SHARE_PERCENT = 150
MOST_PASSES = 2
#: Hash buckets of a source's stream; starts are summed by bucket, then inside each.
BUCKETS = 4096
#: Slots that one task makes.
RUN_SLOTS = 1 << 16
ROUNDS = 40
SEED = 20240607

_GAP = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words of a text, without an array of them; null counts 0."""
    first = F.regexp_replace(text, f"^{_GAP}+", "")
    marks = F.length(F.regexp_replace(first, f"{_WORD}{_GAP}*", "x"))
    return F.coalesce(marks, F.lit(0)).cast("long")


def permuted(index: Column, size: Column, *key: Column) -> Column:
    """The place of ``index`` in a pseudorandom permutation of 0 .. size-1 named by ``key``.

    Each round pairs every x with (k - x) mod size and swaps the pair or not by a hash of its larger member.
    """

    def step(x: Column, turn: Column) -> Column:
        pivot = F.pmod(F.xxhash64(*key, turn), size)
        other = F.pmod(pivot - x, size)
        flip = F.xxhash64(*key, turn, F.greatest(x, other)).bitwiseAND(F.lit(1)) == 1
        return F.when(flip, other).otherwise(x)

    turns = F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(turns, index.cast("long"), step)


@dataclass
class Mixture:
    """The written parts of a mix.

    ``rows``: the documents with ``_mix_row``, ``_mix_source``, ``_mix_size`` and their start in the source's stream.
    ``sources``: number, ``source``, ``source_size``, ``target``, blocks and slots. ``slots``: shard, source,
    block and pass of every slot of the mix. ``documents``: ``_mix_row`` and the kept columns as ``_mix_kept``.
    """

    rows: DataFrame
    sources: DataFrame
    slots: DataFrame
    documents: DataFrame
    block_words: int

    def pieces(self) -> DataFrame:
        """A row for each block a document reaches into: its words there, from ``low`` in the document."""
        n, start, end = self.block_words, F.col("_mix_start"), F.col("_mix_start") + F.col("_mix_size")
        held = self.rows.filter("_mix_size > 0").select("_mix_row", "_mix_source", "_mix_start", "_mix_size")
        reached = F.explode(F.sequence(F.floor(start / n), F.floor((end - 1) / n)))
        low, high = F.greatest(F.col("block") * n, start), F.least((F.col("block") + 1) * n, end)
        return held.withColumn("block", reached).select(
            "_mix_row", "_mix_source", "block", (low - start).alias("low"), (high - low).alias("words")
        )

    def taken(self) -> DataFrame:
        """``_mix_row`` and the words the mix takes of it, for rows of which it takes any."""
        times = self.slots.groupBy("_mix_source", "block").agg(F.count(F.lit(1)).alias("times"))
        return (
            self.pieces()
            .join(times, ["_mix_source", "block"])
            .groupBy("_mix_row")
            .agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
        )


def source_targets(sizes: DataFrame) -> DataFrame:
    """Number, weight and target of each source, from ``source`` and ``source_size``.

    A target is weight times a level, but never over ``MOST_PASSES`` times the source's size; the level rises
    until the targets sum to the share. Each round is one small sum over the sources.
    """
    ranked = rank_distinct(sizes, ["source"], "_mix_source").withColumnRenamed("source", "_mix_name")
    weight = F.element_at(
        F.array(*map(F.lit, WEIGHTS)),
        (F.pmod(F.col("_mix_source") - 1, F.lit(len(WEIGHTS))) + 1).cast("int"),
    )
    sources = written(
        sizes.join(ranked, F.col("source").eqNullSafe(F.col("_mix_name")))
        .drop("_mix_name")
        .withColumn("weight", weight),
        "mix_sources",
    )
    most = MOST_PASSES * F.col("source_size")
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, full = 0.0, -1
    while True:
        above = most < F.col("weight") * F.lit(level)
        bound, free, count = sources.agg(
            F.coalesce(F.sum(F.when(above, most)), F.lit(0)),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)),
            F.count(F.when(above, 1)),
        ).first()
        if count == full or free == 0:
            break
        full, level = count, (SHARE_PERCENT * total - 100 * bound) / (100 * free)
    return sources.withColumn(
        "target", F.least(most.cast("double"), F.col("weight") * F.lit(float(level)))
    )


def _starts(rows: DataFrame) -> DataFrame:
    """The rows with ``_mix_start``, the words of their source before them."""
    placed = rows.withColumn("_mix_bucket", F.pmod(F.xxhash64("doc_id", "_mix_tie"), F.lit(BUCKETS)))
    key = ["_mix_source", "_mix_bucket"]
    before = Window.partitionBy("_mix_source").orderBy("_mix_bucket")
    bases = (
        placed.groupBy(*key)
        .agg(F.sum("_mix_size").alias("_mix_sum"))
        .withColumn("_mix_base", F.sum("_mix_sum").over(before) - F.col("_mix_sum"))
        .drop("_mix_sum")
    )
    inside = Window.partitionBy(*key).orderBy("doc_id", "_mix_tie", "_mix_row")
    running = F.sum("_mix_size").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return (
        placed.withColumn("_mix_before", running - F.col("_mix_size"))
        .join(bases, key)
        .withColumn("_mix_start", F.col("_mix_base") + F.col("_mix_before"))
        .drop("_mix_base", "_mix_before", "_mix_bucket", "_mix_tie")
    )


def _slots(sources: DataFrame, shard_slots: int) -> DataFrame:
    """Shard, source, block and pass of every slot."""
    total = sources.agg(F.coalesce(F.sum("_mix_slots"), F.lit(0))).first()[0]
    before = Window.orderBy("_mix_source").rowsBetween(Window.unboundedPreceding, -1)
    # Sources are few against documents: one row each passes through one task here.
    strata = sources.select(
        "_mix_source",
        F.col("_mix_slots").alias("n"),
        F.coalesce(F.sum("_mix_slots").over(before), F.lit(0)).alias("base"),
    ).filter("n > 0")
    run, tasks = RUN_SLOTS, max(1, total // RUN_SLOTS)
    runs = strata.withColumn(
        "run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / run)))
    ).repartition(tasks)
    dealt = runs.withColumn(
        "stratum",
        F.explode(F.sequence(F.col("run") * run, F.least((F.col("run") + 1) * run, F.col("n")) - 1)),
    ).select(
        "_mix_source",
        permuted(
            F.col("base") + F.col("stratum"), F.lit(max(1, total)).cast("long"), F.lit(SEED), F.lit(-1)
        ).alias("slot"),
    )
    counts = (
        dealt.withColumn("shard", F.floor(F.col("slot") / shard_slots))
        .groupBy("shard", "_mix_source")
        .agg(F.count(F.lit(1)).alias("drawn"))
    )
    earlier = Window.partitionBy("_mix_source").orderBy("shard")
    drawn = counts.withColumn("first", F.sum("drawn").over(earlier) - F.col("drawn")).join(
        sources.select("_mix_source", "_mix_blocks"), "_mix_source"
    )
    index, blocks = F.col("index"), F.col("_mix_blocks")
    within = F.sequence(F.col("first"), F.col("first") + F.col("drawn") - 1)
    turn = F.floor(index / blocks)
    # A row becomes up to a shard's slots, so rows are dealt by the slots they make, not by their bytes.
    return drawn.repartition(tasks, "shard", "_mix_source").withColumn("index", F.explode(within)).select(
        "shard",
        "_mix_source",
        permuted(F.pmod(index, blocks), blocks, F.lit(SEED), F.col("_mix_source"), turn).alias("block"),
        turn.alias("pass"),
    )


def mix(
    docs: DataFrame,
    keep: list[str] | None = None,
    block_words: int = BLOCK_WORDS,
    shard_slots: int = SHARD_SLOTS,
) -> Mixture:
    """The mix of documents with ``doc_id``, ``text`` and ``source``.

    The rows are written once with a number of their own, narrow unless ``keep`` names columns to keep.
    """
    tuned(docs.sparkSession)
    counted = written(
        docs.select(
            "doc_id",
            "source",
            *([F.struct(*keep).alias("_mix_kept")] if keep else []),
            F.xxhash64("text").alias("_mix_tie"),
            word_count(F.col("text")).alias("_mix_size"),
            F.monotonically_increasing_id().alias("_mix_row"),
        ),
        "mix_rows",
    )
    sizes = counted.groupBy("source").agg(F.sum("_mix_size").alias("source_size"))
    size, target = F.col("source_size"), F.col("target")
    blocks = F.ceil(size / block_words)
    sources = written(
        source_targets(sizes)
        .withColumn("_mix_blocks", blocks)
        .withColumn("_mix_slots", F.when(size > 0, F.round(target * blocks / size)).otherwise(0).cast("long")),
        "mix_targets",
    )
    named = sources.select(F.col("source").alias("_mix_name"), "_mix_source")
    narrow = counted.select("doc_id", "source", "_mix_tie", "_mix_size", "_mix_row")
    placed = _starts(
        narrow.join(named, F.col("source").eqNullSafe(F.col("_mix_name"))).drop("_mix_name")
    )
    return Mixture(
        rows=written(placed, "mix_placed"),
        sources=sources,
        slots=written(_slots(sources, shard_slots), "mix_slots"),
        documents=counted,
        block_words=block_words,
    )


def taken_words(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken words of every document."""
    mixture = mix(docs)
    of_source = mixture.sources.select("_mix_source", "source_size", "target")
    return (
        mixture.rows.select("_mix_row", "_mix_source", "doc_id", F.col("_mix_size").alias("size"))
        .join(of_source, "_mix_source")
        .join(mixture.taken(), "_mix_row", "left")
        .select(
            "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken")
        )
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents the mix takes, one row for each pass over them, with all their columns.

    ``text`` holds the words of the blocks drawn in that pass, with the white space after each; a document
    drawn whole keeps its text unchanged. ``n_chars`` follows the text.
    """
    mixture = mix(docs, keep=docs.columns)
    drawn = (
        mixture.pieces()
        .join(mixture.slots, ["_mix_source", "block"])
        .groupBy("_mix_row", "pass")
        .agg(
            F.sum("words").alias("_mix_taken"),
            F.sort_array(F.collect_list(F.struct("low", "words"))).alias("_mix_parts"),
        )
    )
    kept, spans = F.col("_mix_kept"), F.col("_mix_parts")

    def joined(words: Column) -> Column:
        part = F.transform(
            spans,
            lambda p: F.array_join(F.slice(words, (p["low"] + 1).cast("int"), p["words"].cast("int")), ""),
        )
        return F.array_join(part, "")

    # The words are the one element of an array, so they are found once and not for every part.
    words = F.regexp_extract_all(kept["text"], F.lit(f"{_WORD}{_GAP}*"), F.lit(0))
    cut = F.transform(F.array(words), joined)[0]
    whole = F.col("_mix_taken") == F.col("_mix_size")
    taken = (
        mixture.documents.select("_mix_row", "_mix_kept", "_mix_size")
        .join(drawn, "_mix_row")
        .select("_mix_kept", F.when(whole, kept["text"]).otherwise(cut).alias("_mix_text"))
    )
    changed = {"text": F.col("_mix_text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length("_mix_text").cast(docs.schema["n_chars"].dataType)
    return taken.select(*[changed.get(c, kept[c]).alias(c) for c in docs.columns])
