"""URL filters: host and path rules, and exact membership in a list of keys by a cascade of Bloom filters.

Level 1 of the cascade encodes the listed keys. Level 2 encodes the keys of the corpus that level 1 takes for listed by mistake, level 3 the listed
keys that level 2 takes for such mistakes, and so on until no mistake is left. As the levels were tried on every key of the corpus, walking them gives
the exact answer for each. The cascade is dealt into shards by the hash of the key, each with a row of bit arrays for its levels; a key finds its answer in the row of its shard, which comes by
broadcast up to BROADCAST_BYTES of filters (their size is known) and by a shuffle of the keys beyond. Keys are never joined with the list. Everything is a DataFrame
expression, and no bit comes to the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize

#: (verdict, rule): a rule fits its host and all subdomains where the path starts with the rule's; the longest wins.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Keys of the universe aimed at in a shard; bytes of all filters up to which they are broadcast; levels at most (each lets about half of the mistakes through).
SHARD_KEYS, BROADCAST_BYTES, MAX_LEVELS = 1 << 20, 256 << 20, 128
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The rule that fits (longest first, of equal ones the first given) and its verdict; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):
        own, slash, rest = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _places(level: int, hashes: int, key: Column, words: Column) -> list[Column]:
    """The bits of a key in a filter of so many longs."""
    return [F.pmod(F.xxhash64(F.lit(level), F.lit(i), key), 64 * words.cast("long")) for i in range(hashes)]


def _has(level: int, hashes: int, key: Column, bits: Column) -> Column:
    """Whether all bits of the key are set; an empty filter (null) has nothing."""
    found = F.lit(True)
    for p in _places(level, hashes, key, F.size(bits)):
        found = found & (F.getbit(F.get(bits, F.shiftright(p, 6).cast("int")), F.pmod(p, F.lit(64)).cast("int")) == 1)
    return F.coalesce(F.when(F.size(bits) > 0, found), F.lit(False))


class Cascade:
    """Exact membership in listed for every key of universe (DataFrames with a column k). None of the keys is null."""

    def __init__(self, listed: DataFrame, universe: DataFrame, shard_keys: int = SHARD_KEYS, broadcast_bytes: int = BROADCAST_BYTES):
        inside = universe.select("k").distinct().join(listed.select("k").distinct().withColumn("listed", F.lit(True)), "k", "left")
        inside = materialize(inside.select("k", F.coalesce("listed", F.lit(False)).alias("listed")), "url-keys")
        n, n_listed = inside.count(), inside.where("listed").count()
        self.shards, self.broadcast_bytes = max(1, -(-n // shard_keys)), broadcast_bytes
        inside = inside.withColumn("shard", self._shard(F.col("k")))
        encoded, tried = inside.where("listed").select("shard", "k"), inside.where("not listed").select("shard", "k")
        self.hashes: list[int] = []
        levels, left = [], n_listed
        while left:
            if len(levels) == MAX_LEVELS:
                raise RuntimeError("the cascade does not end")
            # the first filter weighs its size against the mistakes to come; the later ones let half through
            rate = 0.5 if levels else min(0.5, math.sqrt(n_listed / max(1, n - n_listed)))
            self.hashes.append(max(1, round(-math.log2(rate))))
            own = self._filter(encoded, len(levels))
            levels.append(own)
            mistakes = tried.join(self._hinted(own), "shard").where(_has(len(levels) - 1, self.hashes[-1], F.col("k"), F.col("bits"))).select("shard", "k")
            encoded, tried = materialize(mistakes, "url-mistakes"), encoded
            left = encoded.count()
        self.levels = len(levels)
        rows = inside.sparkSession.range(self.shards).select(F.col("id").cast("int").alias("shard"))
        for i, own in enumerate(levels):
            rows = rows.join(own.withColumnRenamed("bits", f"bits_{i}"), "shard", "left")
        self.filters = materialize(rows, "url-filters") if levels else rows

    def _shard(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit("shard"), key), F.lit(self.shards)).cast("int")

    def _filter(self, keys: DataFrame, level: int) -> DataFrame:
        """(shard, bits): the bits of each shard's keys, as longs. The longs of a shard are a few per cent of SHARD_KEYS at most."""
        size = keys.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) * self.hashes[level] / (64 * math.log(2))).cast("int").alias("words"))
        size = materialize(size, "url-sizes")
        place = F.explode(F.array(*_places(level, self.hashes[level], F.col("k"), F.col("words"))))
        ones = keys.join(F.broadcast(size), "shard").select("shard", place.alias("p"))
        ones = ones.select("shard", F.shiftright("p", 6).cast("int").alias("word"), F.expr("shiftleft(1L, cast(p % 64 as int))").alias("bit"))
        none = size.select("shard", F.explode(F.sequence(F.lit(0), F.col("words") - 1)).alias("word"), F.lit(0).cast("long").alias("bit"))
        words = ones.unionByName(none).groupBy("shard", "word").agg(F.bit_or("bit").alias("bits"))
        bits = F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"])
        return materialize(words.groupBy("shard").agg(bits.alias("bits")), "url-level")

    def _hinted(self, filters: DataFrame) -> DataFrame:
        longs = [F.sum(F.greatest(F.size(c), F.lit(0))) for c in filters.columns if c != "shard"]
        held = sum(x or 0 for x in filters.agg(*longs).first()) if longs else 0
        return F.broadcast(filters) if 8 * held <= self.broadcast_bytes else filters

    def with_listed(self, df: DataFrame, key: str, out: str) -> DataFrame:
        """df with the boolean column out: whether the key is listed. A key that is null or empty is not."""
        if not self.levels:
            return df.withColumn(out, F.lit(False))
        answer = F.lit(self.levels % 2 == 1)
        for i in reversed(range(self.levels)):
            answer = F.when(_has(i, self.hashes[i], F.col(key), F.col(f"bits_{i}")), answer).otherwise(F.lit(i % 2 == 1))
        d = df.withColumn("shard", F.coalesce(self._shard(F.col(key)), F.lit(0))).join(self._hinted(self.filters), "shard", "left")
        return d.withColumn(out, F.coalesce(F.when(F.col(key) != "", answer), F.lit(False))).select(*df.columns, out)


def judge_urls(pages: DataFrame, listed: DataFrame | None = None, rules=RULES, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """page_id, host, path, rule, verdict, listed for every row of pages (page_id, url; other columns are ignored).

    listed has the blocked hosts in a column k; by default they are the hosts of pages that default_list takes. The verdict is that of the rule, or else
    block for a listed host and allow for another. A null url, or one without ://, has neither host nor path: no rule fits and it is allowed. Repeated
    rows are judged each; very long urls are read whole; an empty table gives no rows.
    """
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    universe = rows.where("host <> ''").select(F.col("host").alias("k"))
    cascade = Cascade(universe.where(default_list(F.col("k"))) if listed is None else listed, universe, shard_keys)
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    out = cascade.with_listed(rows.withColumns({"rule": rule, "by_rule": verdict}), "host", "listed")
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")


def default_list(host: Column) -> Column:
    """A stand-in for a published block list, as none is at hand: about a quarter of all hosts, by their MD5."""
    return F.substring(F.md5(host), 1, 1).isin("0", "1", "2", "3")


ORACLE = """
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), r AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule,
    host <> '' AND substr(md5(host), 1, 1) IN ('0', '1', '2', '3') AS listed FROM p
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed FROM r
"""
