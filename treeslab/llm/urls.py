"""URL filters: rules first, then a Bloom filter cascade, in SQL functions only.

The key universe is every host of the table with all its parent domains. Level 0 of the cascade is a Bloom
filter over the listed keys. Keys of the universe that pass it without being listed are its false
positives; level 1 holds those, level 2 the listed keys that level 1 wrongly holds, and so on until
a level errs on no key of the universe. A key is listed if the number of levels it passes in a
row is odd. So over the universe membership is exact, and a page needs no join: its keys are
tested against the levels, which are literals of the plan.

List and universe go in shards by hash, each with a cascade of its own: of about ``SHARD_KEYS`` listed keys and a hundred times as many of the
universe, so each level is a literal of about 10 * SHARD_KEYS bits at most (level 1 holds the hundredth of the
universe that level 0 wrongly lets through). A longer list or a larger universe makes more shards; the pages are then judged shard by shard.

Defined cases: a null URL, or one without ://, has an empty host and path, fits no rule and is not
listed. Repeated rows are judged alike. An empty list allows everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeslab.llm.shared import spool

#: (verdict, host, path) of the rules. (Fixed values.)
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Hosts of the blocklist, subdomains included. (Fixed values.)
LISTED = [f"{name}.example.{net}" for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for net in ("com", "net", "org")]
BITS_A_KEY = 10
PROBES = 5
#: Keys of one shard of the list: its first level takes 1.25 MB at most.
SHARD_KEYS = 1_000_000
PAGE_BITS = 1 << 15


def host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lowered; empty if there is no ://."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """After the host up to ? # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def parents(name: Column) -> Column:
    """A host and all its parent domains; none of an empty host."""
    parts = F.split(name, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    return F.when(name == "", F.array().cast("array<string>")).otherwise(suffixes)


class Level:
    """One Bloom filter: its bits in pages of 4 KiB, as literals."""

    def __init__(self, size: int, salt: int, pages: dict[int, bytes]):
        self.size, self.salt, self.pages = size, salt, pages

    def probes(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(self.salt), F.lit(k)), F.lit(self.size)) for k in range(PROBES)]

    def holds(self, key: Column) -> Column:
        """All probed bits are set."""
        last = max(self.pages, default=0)
        whole = b"".join(self.pages.get(k, bytes(PAGE_BITS // 8)) for k in range(last + 1))
        byte = lambda at: F.conv(F.hex(F.substring(F.lit(whole), (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        bit = lambda at: F.coalesce(F.getbit(byte(at), F.pmod(at, F.lit(8)).cast("int")), F.lit(0))
        return F.aggregate(F.array(*self.probes(key)), F.lit(True), lambda ok, at: ok & (bit(at) == 1))


def level(keys: DataFrame, salt: int, n: int) -> Level:
    """A filter over the n keys of a frame (key), built by Spark in pages; only its bits reach the driver."""
    size = max(64, BITS_A_KEY * n)
    blank = Level(size, salt, {})
    bits = keys.select(F.explode(F.array(*blank.probes(F.col("key")))).alias("bit"))
    pages = bits.groupBy(F.expr(f"bit div {PAGE_BITS}").alias("page")).agg(F.bitmap_construct_agg(F.pmod("bit", F.lit(PAGE_BITS))).alias("bits"))
    return Level(size, salt, {row.page: bytes(row.bits) for row in pages.collect()})


def cascade(listed: DataFrame, universe: DataFrame) -> list[Level]:
    """The levels for listed keys (key) of a shard, exact on the universe (key). The list is in the universe or not; both are told apart."""
    inside = spool(listed.select("key").distinct())
    n = inside.count()
    levels: list[Level] = []
    if n == 0:
        return levels
    # the universe's keys that pass level 0, with their membership: the only join, over false positives and listed keys
    levels.append(level(inside, 0, n))
    passed = universe.where(levels[0].holds(F.col("key")))
    wrong = spool(passed.join(inside, "key", "left_anti").distinct())
    right = inside
    while (n := wrong.count()) > 0:
        levels.append(level(wrong, len(levels), n))
        right, wrong = wrong, spool(right.where(levels[-1].holds(F.col("key"))))
    return levels


def contains(levels: list[Level], key: Column) -> Column:
    """Whether a key of the universe is listed: it passes an odd number of levels before the first it fails."""
    out = F.lit(len(levels) % 2 == 1)
    for k in range(len(levels) - 1, -1, -1):
        out = F.when(levels[k].holds(key), out).otherwise(F.lit(k % 2 == 1))
    return out


def best_rule(name: Column, route: Column) -> Column:
    """The longest rule that fits, as struct<rule, verdict>, or null."""
    ordered = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    cases = [F.when(((name == h) | name.endswith("." + h)) & route.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in ordered]
    return F.coalesce(*cases)


def judge(pages: DataFrame, listed: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of pages (page_id, url); listed: the blocked hosts (key)."""
    url = F.col("url").cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host(url).alias("host"), path(url).alias("path"))
    universe = spool(rows.select("host").distinct().select(F.explode(parents(F.col("host"))).alias("key")).distinct())
    # a level after the first holds what the one before it wrongly holds: about a hundredth of the universe at level 1
    n_shards = max(1, -(-listed.count() // SHARD_KEYS), -(-universe.count() // (100 * SHARD_KEYS)))
    shard = lambda key: F.pmod(F.xxhash64(key, F.lit(99)), F.lit(n_shards))
    blocked = None
    for k in range(n_shards):
        part = lambda frame: frame.where(shard(F.col("key")) == k) if n_shards > 1 else frame  # noqa: B023, E731
        levels = cascade(part(listed), part(universe))
        mine = (lambda key: shard(key) == k) if n_shards > 1 else (lambda key: F.lit(True))  # noqa: B023
        hit = F.exists(parents(F.col("host")), lambda key: mine(key) & contains(levels, key))  # noqa: B023
        rows = rows.withColumn("hit", hit if blocked is None else F.col("hit") | hit)
        if n_shards > 1:
            rows = spool(rows)  # the shard's levels are done with
        blocked = True
    rule = best_rule(F.col("host"), F.col("path"))
    out = rows.withColumn("best", rule)
    verdict = F.coalesce(F.col("best.verdict"), F.when(F.col("hit"), F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"))


def oracle() -> str:
    """The same in DuckDB: with exact membership in the list."""
    cases = " ".join(f"when (host = '{h}' or host like '%.{h}') and starts_with(path, '{p}') then '{h + p}'" for _, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2])))
    verdicts = " ".join(f"when '{h + p}' then '{v}'" for v, h, p in RULES)
    names = ", ".join(f"'{x}'" for x in LISTED)
    return f"""
    with parts as (
      select page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
        regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') as path from pages),
    ruled as (select *, case {cases} end as rule from parts)
    select page_id, host, path, rule,
      case when rule is not null then case rule {verdicts} end
           when exists (select 1 from (select unnest([{names}]) as name) l where ruled.host = l.name or ends_with(ruled.host, '.' || l.name)) then 'block' else 'allow' end as verdict
    from ruled"""


__all__ = ["LISTED", "RULES", "cascade", "contains", "host", "judge", "oracle", "parents", "path"]
