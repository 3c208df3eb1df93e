"""URL filters: host and path rules, and a Bloom filter cascade for a list of domains, in DataFrame functions only.

The list is a table of keys; a host is listed if it, or a domain above it, is one of them. The universe is every
distinct domain at which a host of the corpus ends, of as many labels as a listed key has at most. The first
level of the cascade encodes the listed keys, the next the keys of the universe that the first
wrongly has, the next the listed keys that the second wrongly has, and so on until a level has no
false positive. So the answer is exact for every key of the universe, and a row is judged by tests of bits: no join.
Which keys of the universe are listed is looked up once, when the cascade is built.

A level's bits are a row of numbers in the shared folder; each plan reads them as the value of a scalar
subquery, so they are no part of the plan. A level has at most `MAX_BITS` bits: a longer list is dealt by a hash of
the key to several cascades, and a key is tested by the one that it belongs to. At most `FILTERS` cascades are tested in one
pass over the hosts' table, so that memory is bounded; beyond that the rows are written between passes.

Nulls: a null url, or one without `://`, has the empty host and path; the empty host is a key like
any other. Null keys are left out. No listed key: every row is allowed. Repeated rows are judged alike, repeated keys count once. Empty
tables: no rows. Ties: of rules of one length the later of the table decides. Urls of any length are taken whole. Only id and url
are read, so further columns may have any names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marrow.llm.common import settled

MAX_BITS = 1 << 24
MAX_LEVELS = 64
#: Cascades tested in one pass.
FILTERS = 16
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: Domains that the query lists: these and all their subdomains.
LISTED_NAMES = ("spam-farm", "cheap-pills", "casino-win", "free-bets", "adult-x", "ads-track")
LISTED_DOMAINS = tuple(f"{name}.example.{end}" for name in LISTED_NAMES for end in ("com", "net", "org"))


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def under(host: Column, domain: str) -> Column:
    return (host == domain) | host.endswith(f".{domain}")


def rule_case(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as `host/path`, and its verdict; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, domain, start in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = under(host, domain) & path.startswith(start)
        rule, verdict = F.when(fits, domain + start).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def domains_of(host: Column, labels: int) -> list[Column]:
    """The ends of a host of 1, 2 and so on up to `labels` labels; null where it has fewer."""
    parts = F.split(host, r"\.")
    return [F.when(F.size(parts) >= k, F.substring_index(host, ".", -k)) for k in range(1, labels + 1)]


@dataclass(frozen=True)
class Level:
    """A Bloom filter; words is a row of 64-bit numbers."""

    words: DataFrame | None
    bits: int
    hashes: int
    seed: int

    def places(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(self.seed), F.lit(j)), F.lit(self.bits)) for j in range(self.hashes)]

    def has(self, key: Column) -> Column:
        words = self.words.scalar()
        found = F.lit(True)
        for p in self.places(key):
            found = found & (F.getbit(F.get(words, F.floor(p / 64).cast("int")), F.pmod(p, F.lit(64)).cast("int")) == 1)
        return found


def hashes_of(n: int, others: int) -> int:
    return min(16, max(1, round(math.log2(max(2.0, others / max(1, n))))))


def bits_of(n: int, hashes: int) -> int:
    return 64 * max(1, math.ceil(n * hashes / math.log(2) / 64))


def level(keys: DataFrame, n: int, others: int, seed: int) -> Level:
    """The Bloom filter of n keys, as tight as pays off against so many others."""
    hashes = hashes_of(n, others)
    empty = Level(None, bits_of(n, hashes), hashes, seed)
    places = keys.select(F.explode(F.array(*empty.places(F.col("key")))).alias("p"))
    bit = F.expr("shiftleft(1L, cast(pmod(p, 64) AS int))")
    held = places.groupBy(F.floor(F.col("p") / 64).alias("w")).agg(F.bit_or(bit).alias("x"))
    # one row of bits / 64 numbers, which MAX_BITS bounds
    all_words = keys.sparkSession.range(empty.bits // 64).join(held, F.col("id") == F.col("w"), "left")
    words = all_words.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", F.coalesce("x", F.lit(0).cast("long")).alias("x")))), lambda e: e["x"]).alias("words"))
    return Level(settled(words, "url-bits"), empty.bits, hashes, seed)


def cascade(universe: DataFrame) -> list[Level]:
    """Levels for the distinct keys of universe (key, listed)."""
    state = settled(universe.select("key", "listed"), "url-keys")
    levels: list[Level] = []
    inside = True  # whether this level encodes listed keys
    while True:
        n, others = state.agg(F.count_if(F.col("listed") == inside), F.count_if(F.col("listed") != inside)).first()
        if not n:
            return levels
        if len(levels) == MAX_LEVELS:
            raise ValueError("the cascade does not end")
        levels.append(level(state.where(F.col("listed") == inside), n, others, len(levels)))
        # those that are encoded stay for the level after next, the others only if they pass
        state = settled(state.where((F.col("listed") == inside) | levels[-1].has(F.col("key"))), "url-keys")
        inside = not inside


def member(levels: list[Level], key: Column) -> Column:
    """Whether a key of the universe is listed: the last level in a row that has it decides."""
    found = F.lit(len(levels) % 2 == 1)
    for i in reversed(range(len(levels))):
        found = F.when(levels[i].has(key), found).otherwise(F.lit(i % 2 == 1))
    return found


def shard(key: Column, of: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(of))


def listed_hosts(df: DataFrame, listed: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """df (host and more columns) with `blocked`: whether the host or a domain above it is a key of listed."""
    mine = settled(listed.select("key").where("key IS NOT NULL").distinct(), "url-list")
    n, labels = mine.agg(F.count("*"), F.max(F.size(F.split("key", r"\.")))).first()
    if not n:
        return df.withColumn("blocked", F.lit(False))
    hosts = df.select("host").distinct()
    keys = hosts.select(F.explode(F.array(*domains_of(F.col("host"), labels))).alias("key")).where("key IS NOT NULL").distinct()
    universe = settled(keys.join(mine.withColumn("listed", F.lit(True)), "key", "left").select("key", F.coalesce("listed", F.lit(False)).alias("listed")), "url-universe")
    inside, all_keys = universe.agg(F.count_if("listed"), F.count("*")).first()
    # the largest level has the listed keys, or those that pass it, which are fewer than half of the others
    most = max(inside, (all_keys - inside) // 2 if inside else 0)
    shards = -(-bits_of(most, hashes_of(inside, all_keys)) // max(64, max_bits))
    df = df.withColumn("blocked", F.lit(False))
    for first in range(0, shards, FILTERS):
        some = [(i, cascade(universe.where(shard(F.col("key"), shards) == i) if shards > 1 else universe)) for i in range(first, min(shards, first + FILTERS))]
        for key in domains_of(F.col("host"), labels):
            found = F.lit(False)
            for i, levels in some:
                found = F.when(shard(key, shards) == i, member(levels, key)).otherwise(found) if shards > 1 else member(levels, key)
            df = df.withColumn("blocked", F.col("blocked") | (key.isNotNull() & found))
        if first + FILTERS < shards:
            df = settled(df, "url-rows")
    return df


def judge(pages: DataFrame, listed: DataFrame | None = None, domains: tuple[str, ...] = LISTED_DOMAINS, id_col: str = "page_id", url_col: str = "url", rules: tuple = RULES, max_bits: int = MAX_BITS) -> DataFrame:
    """id_col, host, path, rule, verdict. Listed are the keys of `listed` (key), or `domains`, each with all below it."""
    df = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col).cast("string")).alias("host"), path_of(F.col(url_col).cast("string")).alias("path"))
    if listed is None:
        listed = pages.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, domains)) if domains else F.array().cast("array<string>")).alias("key"))
    df = listed_hosts(df, listed, max_bits)
    rule, verdict = rule_case(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("blocked"), "block").otherwise("allow")
    return df.select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"))
