"""Judging urls by rules and lists of canonical urls, through a blocked Bloom filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epiweave.llm.common import UPPER

#: Blocks of 256 bits; the filter is broadcast and takes at most this many rows of five longs.
BLOCKS = 1 << 15
ALLOW, BLOCK = "allow", "block"


def host_of(url: str | Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty without one."""
    rest = _rest(url)
    return F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, UPPER.lower())


def path_of(url: str | Column) -> Column:
    """What follows the host up to ``? #`` or the end."""
    return F.regexp_extract(_rest(url), r"(?s)^[^/?#]*([^?#]*)", 1)


def _rest(url: str | Column) -> Column:
    url = F.col(url) if isinstance(url, str) else url
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise("")


def canonical(host: Column, path: Column) -> Column:
    """Form in which lists hold a url: no scheme, query or fragment, no ``www.``, no slash at the end."""
    return F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, r"/+$", ""))


def _one_shl(bit: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), bit.cast("int"))


def _bits(key: Column) -> tuple[Column, list[Column]]:
    """The block of a key and the two bits it sets in each of the block's four words."""
    block = F.pmod(F.xxhash64(F.lit(0), key), F.lit(BLOCKS)).cast("int")
    places = F.xxhash64(F.lit(1), key)
    masks = []
    for word in range(4):
        first, second = (F.shiftrightunsigned(places, 12 * word + 6 * i).bitwiseAND(63) for i in (0, 1))
        masks.append(_one_shl(first).bitwiseOR(_one_shl(second)))
    return block, masks


def bloom_filter(keys: DataFrame, key: str) -> DataFrame:
    """(block, w0..w3): at most BLOCKS rows, whatever the number of keys.

    An overfull filter lets more candidates pass; the exact join removes them.
    """
    block, masks = _bits(F.col(key))
    marked = keys.select(block.alias("block"), *(m.alias(f"w{i}") for i, m in enumerate(masks)))
    return marked.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(4)))


def possible_hits(candidates: DataFrame, key: str, bloom: DataFrame) -> DataFrame:
    """Candidates whose bits are all set. The filter is broadcast: its size is bounded by BLOCKS."""
    block, masks = _bits(F.col(key))
    columns = candidates.columns
    probe = candidates.select("*", block.alias("block"), *(m.alias(f"m{i}") for i, m in enumerate(masks)))
    hit = F.expr(" AND ".join(f"w{i} & m{i} = m{i}" for i in range(4)))
    return probe.join(F.broadcast(bloom), "block").where(hit).select(columns)


def judge_urls(urls: DataFrame, rules: DataFrame, listed: DataFrame, url: str = "url") -> DataFrame:
    """``urls`` with host, path, rule and verdict.

    ``rules`` (host, path, verdict): a rule fits its host and all subdomains if the
    url's path starts with the rule's; the longest rule string wins, of equally long ones
    that with the longer host, then a block. Where no rule fits, a url is blocked if
    its canonical form is that of a url in ``listed`` (url), else allowed.

    Every distinct host and path makes its candidate keys once: the canonical form and each
    host suffix with each path prefix of lengths some rule has. A blocked Bloom filter over
    both lists drops nearly all of them where they are made; what passes is joined
    exactly. The lengths are collected to the driver: strings of B bytes in all have
    at most sqrt(2 B) different lengths. Null urls and urls without ``://`` have an empty host and
    path; no rule fits an empty host. Null fields of a rule make it void, null listed urls too. Columns named
    host, path, rule or verdict in ``urls`` are replaced.
    """
    base = urls.drop("host", "path", "rule", "verdict")
    base = base.withColumns({"host": host_of(url), "path": path_of(url)})
    rules = rules.where("host <> '' AND path IS NOT NULL AND verdict IS NOT NULL")
    entries = rules.select(
        F.concat(F.lit("r"), "host", F.lit("\n"), "path").alias("key"), "verdict", F.concat("host", "path").alias("rule"),
        F.char_length("host").alias("host_length"),
    ).unionByName(
        listed.where(F.col("url").isNotNull())
        .select(F.concat(F.lit("u"), canonical(host_of("url"), path_of("url"))).alias("key"))
        .distinct()
        .select("key", F.lit(BLOCK).alias("verdict"), F.lit(None).cast("string").alias("rule"), F.lit(0).alias("host_length"))
    )
    path_lengths, host_lengths = (
        sorted(r[0] for r in rules.select(F.char_length(c)).distinct().collect()) for c in ("path", "host")
    )
    pages = base.select("host", "path").distinct().where("host <> ''")
    suffixes = F.transform(
        F.filter(
            F.array(*map(F.lit, host_lengths)).cast("array<int>"),
            lambda n: (n == F.char_length("host"))
            | ((n < F.char_length("host")) & (F.substring(F.col("host"), -n - 1, F.lit(1)) == ".")),
        ),
        lambda n: F.substring(F.col("host"), -n, n),
    )
    prefixes = F.transform(
        F.filter(F.array(*map(F.lit, path_lengths)).cast("array<int>"), lambda n: n <= F.char_length("path")),
        lambda n: F.substring(F.col("path"), F.lit(1), n),
    )
    keys = F.flatten(
        F.transform(
            suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(F.lit("r"), s, F.lit("\n"), p))
        )
    )
    exact = F.array(F.concat(F.lit("u"), canonical(F.col("host"), F.col("path"))))
    candidates = pages.select("host", "path", F.explode(F.array_distinct(F.concat(keys, exact))).alias("key"))
    hits = possible_hits(candidates, "key", bloom_filter(entries, "key")).join(entries, "key")
    strength = F.struct(
        F.col("rule").isNotNull(), F.char_length("rule"), F.col("host_length"), F.col("verdict") == BLOCK
    )
    best = hits.groupBy(F.col("host").alias("_host"), F.col("path").alias("_path")).agg(
        F.max(F.struct(strength.alias("s"), "rule", "verdict")).alias("b")
    )
    same = (base["host"] == best["_host"]) & (base["path"] == best["_path"])
    return (
        base.join(best, same, "left")
        .withColumns({"rule": F.col("b.rule"), "verdict": F.coalesce("b.verdict", F.lit(ALLOW))})
        .drop("_host", "_path", "b")
    )
