"""URL rules: a blocked Bloom filter of listed canonical URLs, then an exact hash join.

A rule is a host and the start of a path. A URL's candidates are each suffix of its host, label by label,
with the start of its path at each length that rules have. A candidate's hash names one block of the
filter, whose words hold all its bits; blocks are a table joined by block number, so the filter works
beyond what can be broadcast. Candidates that pass are joined to the rules exactly, and the longest rule
of a URL wins. URLs are judged once however often they occur.

Defined results: a null URL, or one without "://", has an empty host and path and gets the default verdict;
a path that is empty starts with no rule's path; an empty table gives no rows; a URL's verdict does not
depend on how often it occurs; a rule that is listed with several verdicts has the last of them by code point (block
before allow); hosts of rules are lower-cased like those of URLs; clashing names of other columns do no harm, as only id and URL are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower

#: Words of 64 bits in a block, bits set for each key, and bits of the filter for each key.
BLOCK_WORDS = 8
BITS_SET = 8
BITS_PER_KEY = 16
#: Rules and blocks are broadcast up to so many rules (about 200 bytes each); beyond, both joins shuffle.
BROADCAST_RULES = 200_000
#: Different path lengths up to which each is tried on every path; beyond, only those of the host's rules.
LENGTHS = 256
SEP = "\u0001"


def host_of(url: Column) -> Column:
    """What follows the first "://" up to "/", "?", "#" or the end, A-Z lower-cased."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rules_table(spark: SparkSession, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """(rule, verdict) pairs as rows: rule, verdict, host, prefix."""
    df = spark.createDataFrame(list(rules), "rule string, verdict string")
    at = F.instr("rule", "/")
    return df.select("rule", "verdict", ascii_lower(F.expr("substring(rule, 1, instr(rule, '/') - 1)")).alias("host"), F.expr("substring(rule, instr(rule, '/'))").alias("prefix")).where(at > 0)


def _bits(key: Column, blocks: int) -> tuple[Column, Column]:
    """The block of a key and its bit numbers within the block."""
    h, g = F.xxhash64(key), F.xxhash64(key, F.lit("bits"))
    return F.pmod(h, F.lit(blocks)), F.array(*[F.pmod(F.shiftright(g, 7 * i), F.lit(64 * BLOCK_WORDS)).cast("int") for i in range(BITS_SET)])


def bloom_blocks(rules: DataFrame, blocks: int) -> DataFrame:
    """The filter as a table: block, words."""
    block, bits = _bits(F.concat("host", F.lit(SEP), "prefix"), blocks)
    ones = rules.select(block.alias("block"), F.explode(bits).alias("bit"))
    one = F.expr("shiftleft(cast(1 as bigint), bit % 64)")
    words = [F.coalesce(F.bit_or(F.when(F.floor(F.col("bit") / 64) == i, one)), F.lit(0)).alias(f"w{i}") for i in range(BLOCK_WORDS)]
    return ones.groupBy("block").agg(*words).select("block", F.array(*[F.col(f"w{i}") for i in range(BLOCK_WORDS)]).alias("words"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", url_col: str = "url", keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """keep columns, host, path, rule and verdict of every row of pages."""
    n = rules.count()
    hint = F.broadcast if n <= BROADCAST_RULES else (lambda df: df)
    blocks = max(1, -(-n * BITS_PER_KEY // (64 * BLOCK_WORDS)))
    lengths = rules.select(F.length("prefix").alias("n")).distinct()
    few = [r[0] for r in lengths.limit(LENGTHS + 1).collect()]
    urls = pages.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)], host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    seen = urls.select("host", "path").distinct().where("host <> ''")
    labels = seen.withColumn("labels", F.split("host", r"\."))
    suffixes = F.transform(F.sequence(F.lit(1), F.size("labels")), lambda i: F.array_join(F.slice("labels", i, F.size("labels")), "."))
    suffixed = labels.select("host", "path", F.explode(suffixes).alias("suffix"))
    if len(few) <= LENGTHS:
        starts = F.filter(F.array(*[F.when(F.length("path") >= k, F.substring("path", 1, k)) for k in sorted(few)]), lambda x: x.isNotNull()) if few else F.array().cast("array<string>")
        cand = suffixed.select("host", "path", "suffix", F.explode(starts).alias("prefix"))
    else:  # each length that rules of the suffix's host have, by a join: only those can be met
        of_host = rules.select(F.col("host").alias("suffix"), F.length("prefix").alias("n")).distinct()
        cand = suffixed.join(of_host, "suffix").where(F.length("path") >= F.col("n")).select("host", "path", "suffix", F.expr("substring(path, 1, n)").alias("prefix"))
    block, bits = _bits(F.concat("suffix", F.lit(SEP), "prefix"), blocks)
    probe = cand.withColumn("block", block).withColumn("bits", bits).join(hint(bloom_blocks(rules, blocks)), "block")
    hit = F.lit(True)
    for i in range(BITS_SET):
        hit = hit & (F.expr(f"shiftrightunsigned(words[cast(floor(bits[{i}] / 64) as int)], bits[{i}] % 64) & 1") == 1)
    maybe = probe.where(hit).select("host", "path", "suffix", "prefix")
    exact = maybe.join(hint(rules.groupBy(F.col("host").alias("suffix"), "prefix").agg(F.max(F.struct("verdict", "rule")).alias("r")).select("suffix", "prefix", "r.rule", "r.verdict")), ["suffix", "prefix"])
    best = exact.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "verdict")).alias("best"))
    out = urls.join(best, ["host", "path"], "left")
    return out.select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)], "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
