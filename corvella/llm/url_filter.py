"""URL rules by Bloom filter cascades: exact membership over the corpus's key universe, without joins. Native."""

from __future__ import annotations

import math
import string
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvella.llm.common import materialize


def url_parts(url: str | Column) -> tuple[Column, Column]:
    """(host, path) of a url; both are empty where it is null or has no ://."""
    url = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


@dataclass(frozen=True)
class Level:
    """One Bloom filter of a cascade; bit p of the filter is bit p % 8 of byte p // 8."""

    seed: int
    hashes: int
    bits: bytes

    @cached_property
    def column(self) -> Column:
        """The filter as one constant: however often it is asked, a plan holds its bytes once."""
        return F.lit(self.bits)

    @staticmethod
    def positions(key: Column, seed: int, hashes: int, size: int) -> list[Column]:
        return [F.pmod(F.xxhash64(F.lit(seed), F.lit(j), key), F.lit(size)) for j in range(hashes)]

    def has(self, key: Column) -> Column:
        def bit(p: Column) -> Column:
            byte = F.ascii(F.decode(F.substring(self.column, (F.floor(p / 8) + 1).cast("int"), F.lit(1)), "ISO-8859-1"))
            return F.getbit(byte, (p % 8).cast("int")) == 1

        return reduce(lambda a, b: a & b, map(bit, self.positions(key, self.seed, self.hashes, len(self.bits) * 8)))


def _level(members: DataFrame, n: int, rate: float, seed: int) -> Level:
    """Encode the `n` keys of `members` with the false positive rate asked for."""
    size = max(64, 8 * math.ceil(-n * math.log(rate) / math.log(2) ** 2 / 8))
    hashes = max(1, round(-math.log2(rate)))
    bit = F.explode(F.array(*Level.positions(F.col("key"), seed, hashes, size))).alias("bit")
    words = members.select(bit).groupBy(F.floor(F.col("bit") / 8).alias("byte")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1), (F.col("bit") % 8).cast("int"))).alias("v"))
    filled = bytearray(size // 8)
    for row in words.toLocalIterator():  # the bytes of the filter, which follow the list of rules and not the corpus
        filled[row["byte"]] = row["v"]
    return Level(seed, hashes, bytes(filled))


def build_cascade(universe: DataFrame, listed: str) -> list[Level]:
    """Filters that tell exactly which keys of `universe` (key, and a boolean column named by `listed`) are listed.

    Level 1 encodes the listed keys. Level 2 encodes its false positives among all other keys of the universe, level 3
    those listed keys that level 2 takes for false positives, and so on, until a level errs on no key. The first rate
    makes levels 1 and 2 about as large as each other; later levels halve what is left. So every level is of the order of
    the listed keys (which the driver holds as rules), and has a bit more a key where the others double.
    """
    counts = universe.groupBy().agg(F.count_if(F.col(listed)).alias("n"), F.count_if(~F.col(listed)).alias("others")).first()
    inside, n = universe.where(F.col(listed)).select("key"), counts["n"]
    outside, rate = universe.where(~F.col(listed)).select("key"), min(0.5, max(counts["n"], 1) / (math.sqrt(2) * max(counts["others"], 1)))
    levels: list[Level] = []
    while n:
        level = _level(inside, n, rate, len(levels))
        levels.append(level)
        wrong = materialize(outside.where(level.has(F.col("key"))))
        inside, outside, n, rate = wrong, inside, wrong.count(), 0.5
    return levels


def listed_in(levels: list[Level], key: Column) -> Column:
    """Whether a key of the universe is listed: the first level that rejects it decides."""
    out: Column = F.lit(len(levels) % 2 == 1)
    for i, level in reversed(list(enumerate(levels))):
        out = F.when(~level.has(key), F.lit(i % 2 == 1)).otherwise(out)
    return F.coalesce(key.isNotNull() & out, F.lit(False))


def url_filter(pages: DataFrame, block: list[tuple[str, str]], allow: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per row of `pages`: id_col, host, path, rule, verdict. Other columns are neither read nor returned.

    `block` and `allow` are (host, path) rules. A rule fits its host and all subdomains if the url's path starts with its
    path; of those that fit, the longest (host and path together, then the longer host) gives the verdict, else `default`.
    A url has one key for each number of host labels and each length of path that rules have, so a rule fits if it is one
    of the url's keys, and membership is asked of two cascades built over the distinct keys of all pages.

    * A null url, or one without ://, has an empty host and path; no rule fits it.
    * Repeated rows each get their verdict; an empty table gives an empty result.
    * A key that is both blocked and allowed counts as blocked.
    * Null or repeated ids are rows like any others; hosts and paths may be of any length.
    """
    host, path = url_parts(url_col)
    rows = pages.select(F.col(id_col).alias("_id"), host.alias("_host"), path.alias("_path"))
    rules = {h + p: "block" if (h, p) in block else "allow" for h, p in [*allow, *block]}
    shapes = sorted({(h.count(".") + 1, len(p)) for h, p in [*allow, *block]})

    def key(labels: int, length: int) -> Column:
        return F.when((F.col("_host") != "") & (F.length("_path") >= length), F.concat(F.substring_index("_host", ".", -labels), F.substring("_path", 1, length)))

    rows = rows.withColumn("_keys", F.array(*(key(*s) for s in shapes)) if shapes else F.array().cast("array<string>"))
    seen = rows.select(F.explode("_keys").alias("key")).where("key is not null").select("key", F.lit(False).alias("block"), F.lit(False).alias("allow"))
    given = pages.sparkSession.createDataFrame([(k, v == "block", v == "allow") for k, v in rules.items()], "key string, block boolean, allow boolean")
    universe = materialize(seen.union(given).groupBy("key").agg(F.bool_or("block").alias("block"), F.bool_or("allow").alias("allow")))
    cascades = {v: build_cascade(universe, v) for v in ("block", "allow")}
    fit = "struct<size:int,host_size:int,key:string,verdict:string>"

    def fitting(k: Column, labels: int, verdict: Column) -> Column:
        return F.when(verdict.isNotNull(), F.struct(F.length(k).alias("size"), F.length(F.substring_index("_host", ".", -labels)).alias("host_size"), k.alias("key"), verdict.alias("verdict"))).cast(fit)

    found = []
    for i, (labels, _) in enumerate(shapes):
        k = F.col("_keys")[i]
        found.append(fitting(k, labels, F.when(listed_in(cascades["block"], k), "block").when(listed_in(cascades["allow"], k), "allow")))
    judged = rows.withColumn("_best", F.array_max(F.array(*found)) if found else F.lit(None).cast(fit))
    return judged.select(F.col("_id").alias(id_col), F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_best.key").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))
