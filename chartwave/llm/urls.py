"""URL filtering by host and path rules and a Bloom filter cascade, in SQL functions only.

The cascade's first level is a Bloom filter of the listed keys.  The keys of the
corpus that it lets through wrongly are encoded in a second level, the listed keys
that pass that one in a third, and so on until nothing passes wrongly.  Over the
corpus's complete key universe membership is then exact: a key is listed if the
number of levels that it passes before its first miss is odd.  The filter words of a
level are one array, made by the cluster and shared as a scalar subquery, so rows are
judged where they are read, without a join.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bound on all levels together, which every executor holds; longer lists are matched by a join instead.
MAX_CASCADE_BYTES = 16 << 20
MAX_LEVELS = 64


def host_of(url: Column) -> Column:
    """What follows the first ://, up to /, ?, # or the end, A-Z lower-cased; else empty."""
    at = F.instr(url, "://")
    tail = F.substr(url, at + 3)
    return F.coalesce(F.when(at > 0, F.translate(F.regexp_extract(tail, "^([^/?#]*)", 1), UPPER, LOWER)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end; else empty."""
    at = F.instr(url, "://")
    tail = F.substr(url, at + 3)
    return F.coalesce(F.when(at > 0, F.regexp_extract(tail, "^[^/?#]*([^?#]*)", 1)), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(the longest rule that fits, its verdict); both null where none fits.

    rules: a handful of (verdict, rule), the rule being a host and a path prefix.
    """
    rule = verdict = None
    for kind, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        site, slash, rest = text.partition("/")
        fits = ((host == site) | host.endswith("." + site)) & path.startswith(slash + rest)
        rule = F.when(fits, F.lit(text)) if rule is None else rule.when(fits, F.lit(text))
        verdict = F.when(fits, F.lit(kind)) if verdict is None else verdict.when(fits, F.lit(kind))
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def suffixes_of(host: Column) -> Column:
    """The host and all domains above it, longest first: a.b.c, b.c, c."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


@dataclass
class Level:
    """One Bloom filter: its words are the only row of a written table."""

    hashes: int
    bits: int
    words: DataFrame

    def array(self) -> Column:
        return self.words.scalar()


def positions(key: Column, level: int, hashes: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level), F.lit(i)), F.lit(bits).cast("long")) for i in range(hashes)]


def build_level(keys: DataFrame, level: int, hashes: int, bits: int) -> Level:
    """One level's filter over column key: its 64-bit words in order."""
    at = keys.select(F.explode(F.array(*positions(F.col("key"), level, hashes, bits))).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("id")).agg(F.expr("bit_or(shiftleft(1L, CAST(at & 63 AS INT)))").alias("bits"))
    every = keys.sparkSession.range(bits // 64 + 1).join(words, "id", "left").select("id", F.coalesce("bits", F.lit(0)).alias("bits"))
    row = every.agg(F.array_sort(F.collect_list(F.struct("id", "bits"))).alias("words")).select(F.expr("transform(words, w -> w.bits)").alias("words"))
    return Level(hashes, bits, cut(row))


def passes(key: Column, number: int, level: Level, words: Column) -> Column:
    hit = F.lit(True)
    for at in positions(key, number, level.hashes, level.bits):
        word = F.get(words, F.shiftright(at, 6).cast("int"))
        hit = hit & (F.getbit(word, at.bitwiseAND(F.lit(63)).cast("int")) == 1)
    return hit


def cascade(listed: DataFrame, universe: DataFrame, max_bytes: int = MAX_CASCADE_BYTES) -> list[Level] | None:
    """Levels that tell the listed keys among the universe; None beyond the bound.

    Both frames have distinct non-null keys in column key.  Listed keys outside the universe
    are left out: no row asks for them.
    """
    universe = cut(universe.select("key"))
    inside = cut(universe.join(listed.select("key"), "key", "left_semi"))
    outside = cut(universe.join(inside, "key", "left_anti"))
    n_in, n_out = inside.count(), outside.count()
    levels: list[Level] = []
    rate = min(0.5, n_in / max(1.0, math.sqrt(2) * n_out))
    while n_in:
        hashes = max(1, round(math.log2(1 / rate)))
        bits = max(64, math.ceil(n_in * hashes / math.log(2)))
        if len(levels) >= MAX_LEVELS or sum(x.bits for x in levels) + bits > 8 * max_bytes:
            return None
        number = len(levels)
        levels.append(build_level(inside, number, hashes, bits))
        wrong = cut(outside.where(passes(F.col("key"), number, levels[-1], levels[-1].array())))
        drop_table(outside)
        inside, outside, n_in, rate = wrong, inside, wrong.count(), 0.5
    drop_table(universe)
    return levels


def listed_in(key: Column, levels: list[Level], words: list[Column]) -> Column:
    """Whether a key of the universe is listed: the first level that it misses decides."""
    verdict = F.lit(len(levels) % 2 == 1)
    for number in range(len(levels) - 1, -1, -1):
        verdict = F.when(passes(key, number, levels[number], words[number]), verdict).otherwise(F.lit(number % 2 == 1))
    return verdict


def filter_urls(
    pages: DataFrame, rules: list[tuple[str, str]], listed: DataFrame, max_bytes: int = MAX_CASCADE_BYTES, id_col: str = "page_id"
) -> DataFrame:
    """Judges each row's url; returns the id, host, path, rule and verdict (allow or block).

    The longest rule that fits decides.  Else hosts are blocked that are listed (column
    host, lower case) or lie below a listed one.  The cascade's universe are all hosts of
    the table and the domains above them, over which it is exact.

    A null url, or one without ://, has empty host and path and is allowed unless
    listed.  Null and repeated listed hosts count once or not at all.  Urls of any length
    are read whole.  Repeated rows are judged each, null ids kept, further columns left
    out; an empty table gives an empty result.
    """
    url = F.col("url").cast("string")
    hosts = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    universe = hosts.select("host").distinct().select(F.explode(suffixes_of(F.col("host"))).alias("key")).distinct()
    keys = listed.select(F.col("host").cast("string").alias("key")).where("key IS NOT NULL").distinct()
    levels = cascade(keys, universe, max_bytes)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    if levels is None:
        below = universe.join(keys, "key", "left_semi")
        own = hosts.select("host").distinct().select("host", F.explode(suffixes_of(F.col("host"))).alias("key"))
        hit_hosts = own.join(below, "key", "left_semi").select("host").distinct().withColumn("hit", F.lit(True))
        judged = hosts.join(hit_hosts, "host", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    else:
        names = [f"words_{i}" for i in range(len(levels))]
        judged = hosts.select("*", *[x.array().alias(n) for x, n in zip(levels, names)])
        hit = F.exists(suffixes_of(F.col("host")), lambda key: listed_in(key, levels, [F.col(n) for n in names])) if levels else F.lit(False)
        judged = judged.withColumn("hit", hit)
    return judged.select(
        F.col("id").alias(id_col), "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("hit"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
    )
