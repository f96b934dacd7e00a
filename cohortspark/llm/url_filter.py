"""URL filters: ordered host and path rules, then exact list membership by a Bloom filter cascade (operator 5).

The cascade encodes which keys of a corpus are on a list. Level 1 is a Bloom filter of the listed keys; level 2
one of the unlisted keys of the corpus that level 1 wrongly passes; level 3 one of the listed keys that level 2
passes; and so on until a level passes nothing wrongly. Since every key of the corpus was tried, a key of the
corpus gets its exact answer from the filters alone, without a join. All of it is DataFrame expressions.

Levels are built over the distinct keys, so a hot host weighs as much as any other. Filters are arrays of
64-bit words read as scalar subqueries. A key set whose filters would pass ``MAX_WORDS`` is cut in blocks by
hash; each block has a cascade of its own, and each row meets only its block's.

Defined cases: a null url, or one without ``://``, has an empty host and an empty path; an empty host fits no
rule and is not a key, so it is allowed; repeated rows come back each; an empty list allows all that no rule
blocks; a null listed key lists nothing. Further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.session import run_path, tuned, written

#: Words of 64 bits in the largest filter of one block (8 MB); such a filter travels with the tasks.
MAX_WORDS = 1 << 20
#: Levels after which a build is given up; each is expected to halve what is left.
MAX_LEVELS = 200

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``allow`` or ``block`` for a host, its subdomains and the paths that start alike."""

    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return self.text[len(self.host) :]


def parsed(pages: DataFrame) -> DataFrame:
    """The rows with ``host`` and ``path`` of ``url``, both empty where it has no ``://``."""
    url = F.coalesce(F.col("url"), F.lit(""))
    pattern = "(?s)^.*?://([^/?#]*)([^?#]*)"
    return pages.withColumns(
        {
            "host": F.translate(F.regexp_extract(url, pattern, 1), UPPER, LOWER),
            "path": F.regexp_extract(url, pattern, 2),
        }
    )


def fitting_rule(rules: Sequence[Rule], of=lambda rule: rule.text) -> Column:
    """Of the rules that fit ``host`` and ``path``, the longest one's text, or what ``of`` gives."""
    host, path = F.col("host"), F.col("path")
    cases = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        cases = F.when(fits, of(rule)).otherwise(cases)
    return cases


@dataclass
class Cascade:
    """Filters in ``folder``; for each block, the bits and probes of its levels."""

    folder: str
    levels: list[list[tuple[int, int]]]

    def holds(self, spark: SparkSession, key: Column, block: int) -> Column:
        """Whether a key of the corpus that falls into a block is listed."""
        sizes = self.levels[block]
        answer = F.lit(len(sizes) % 2 == 1)
        if not sizes:
            return answer
        words = (
            spark.read.parquet(f"{self.folder}/block={block}")
            .groupBy()
            .agg(F.sort_array(F.collect_list(F.struct("level", "words"))).alias("levels"))
            .select(F.transform("levels", lambda x: x["words"]))
            .scalar()
        )
        for level in range(len(sizes), 0, -1):
            passes = _passes(words[level - 1], key, block, level, *sizes[level - 1])
            answer = F.when(passes, answer).otherwise(F.lit(level % 2 == 0))
        return answer

    def with_answer(self, rows: DataFrame, key: str, name: str) -> DataFrame:
        """The rows with the answer for their key; each block's rows meet its filters alone."""
        spark, n = rows.sparkSession, len(self.levels)
        if n == 1:
            return rows.withColumn(name, self.holds(spark, F.col(key), 0))
        parts = [
            rows.filter(F.coalesce(_block(F.col(key), n), F.lit(0)) == b).withColumn(
                name, self.holds(spark, F.col(key), b)
            )
            for b in range(n)
        ]
        return reduce(DataFrame.unionByName, parts)


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("block")), F.lit(blocks))


def _places(key: Column, block: int, level: int, bits: int, probes: int) -> list[Column]:
    return [
        F.pmod(F.xxhash64(key, F.lit(block), F.lit(level), F.lit(j)), F.lit(bits).cast("long"))
        for j in range(probes)
    ]


def _passes(words: Column, key: Column, block: int, level: int, bits: int, probes: int) -> Column:
    return reduce(
        Column.__and__,
        [
            F.getbit(words[F.shiftright(at, 6).cast("int")], at.bitwiseAND(63).cast("int")) == 1
            for at in _places(key, block, level, bits, probes)
        ],
    )


def filter_size(inside: int, outside: int, level: int) -> tuple[int, int]:
    """Bits and probes of a level that encodes ``inside`` keys and is tried on ``outside`` others.

    The first level passes about inside / sqrt(2) of the others, the later ones half.
    """
    chance = min(0.5, max(1, inside) * math.sqrt(0.5) / max(1, outside)) if level == 1 else 0.5
    bits = math.ceil(inside * math.log2(1 / chance) / math.log(2))
    return max(64, -(-bits // 64) * 64), max(1, round(math.log2(1 / chance)))


def _filter_words(encoded: DataFrame, block: int, level: int, bits: int, probes: int) -> DataFrame:
    """One row: the words of the filter in order; no more than ``MAX_WORDS`` of them."""
    spark = encoded.sparkSession
    at = F.explode(F.array(*_places(F.col("key"), block, level, bits, probes)))
    set_bits = encoded.select(at.alias("at")).select(
        F.shiftright("at", 6).alias("word"),
        F.expr("shiftleft(1L, cast(at & 63 as int))").alias("bits"),
    )
    blank = spark.range(bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    return (
        set_bits.unionByName(blank)
        .groupBy("word")
        .agg(F.bit_or("bits").alias("bits"))
        .groupBy()
        .agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("all"))
        .select(F.lit(level).alias("level"), F.transform("all", lambda x: x["bits"]).alias("words"))
    )


def build(keys: DataFrame, listed: DataFrame, max_words: int = MAX_WORDS) -> Cascade:
    """The cascade of the corpus keys ``key`` and the listed ones; either may repeat.

    What is left for the next level is written after each, so lost executors cost one level at most.
    """
    spark = tuned(keys.sparkSession)
    folder = run_path(spark, "cascade")
    universe = written(
        keys.select("key", F.lit(False).alias("listed"))
        .unionByName(listed.select("key", F.lit(True).alias("listed")))
        .filter(F.col("key").isNotNull())
        .groupBy("key")
        .agg(F.max("listed").alias("listed")),
        "keys",
    )
    inside, total = universe.agg(
        F.coalesce(F.sum(F.col("listed").cast("long")), F.lit(0)), F.count(F.lit(1))
    ).first()
    bits, _ = filter_size(inside, total - inside, 1)
    blocks = max(1, -(-bits // (48 * max_words)))  # leaves room for uneven blocks
    levels: list[list[tuple[int, int]]] = []
    for block in range(blocks):
        left = universe if blocks == 1 else universe.filter(_block(F.col("key"), blocks) == block)
        levels.append([])
        for level in range(1, MAX_LEVELS + 1):
            encodes = F.col("listed") == F.lit(level % 2 == 1)
            inside, outside = left.agg(
                F.count(F.when(encodes, 1)), F.count(F.when(~encodes, 1))
            ).first()
            if inside == 0 or (level > 1 and outside == 0):
                break
            size = filter_size(inside, outside, level)
            if size[0] > 64 * max_words:
                raise ValueError(f"block {block}: a filter of {size[0]} bits; raise max_words")
            path = f"{folder}/block={block}/step={level}"
            _filter_words(left.filter(encodes), block, level, *size).write.parquet(path)
            levels[block].append(size)
            words = spark.read.parquet(path).select("words").scalar()
            passes = _passes(words, F.col("key"), block, level, *size)
            left = written(left.filter(encodes | passes), "left")
        else:
            raise ValueError(f"block {block}: keys are left after {MAX_LEVELS} levels")
    return Cascade(folder, levels)


def judged(pages: DataFrame, rules: Sequence[Rule], listed: DataFrame) -> DataFrame:
    """page_id, host, path, ``rule`` (or null) and ``verdict`` of every row.

    ``listed`` has the blocked hosts in ``key``. Where no rule fits, a listed host is blocked.
    """
    rows = parsed(pages.select("page_id", "url"))
    hosts = rows.filter(F.col("host") != "").select(F.col("host").alias("key"))
    cascade = build(hosts.distinct(), listed)
    answered = cascade.with_answer(rows, "host", "on_list")
    by_list = F.when(F.col("on_list") & (F.col("host") != ""), "block").otherwise("allow")
    return answered.select(
        "page_id",
        "host",
        "path",
        fitting_rule(rules).alias("rule"),
        F.coalesce(fitting_rule(rules, lambda r: r.verdict), by_list).alias("verdict"),
    )


def hosts_with_labels(pages: DataFrame, labels: Sequence[str]) -> DataFrame:
    """The distinct hosts of a corpus that have one of these labels, as ``key``: a list to block."""
    named = F.arrays_overlap(F.split("host", "[.]"), F.array(*map(F.lit, labels)))
    return parsed(pages.select("url")).filter(named).select(F.col("host").alias("key")).distinct()
