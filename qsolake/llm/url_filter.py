"""URL filter: rules of hosts and paths first; a blocked Bloom filter and an exact hash join for listed URLs.

A url that no rule decides is brought into canonical form. The canonical forms of the listed URLs set bits in blocks of
512: a hash chooses the block, eight pieces of another set one bit in each of its eight 64-bit words. A url whose bits
aren't all set is not on the list; only the others meet the list in an exact join on the canonical form, which removes
false positives. So nearly all rows pass by one look at one block, and no verdict depends on a hash.

The filter is sent to the tasks while it has at most SENT_BLOCKS blocks, which is counted from the list; beyond that the
urls are joined to its blocks. Urls that repeat a million times share a block and a canonical form: both are equi-joins,
whose large partitions adaptive execution splits.

Defined cases: a null url or one without :// has an empty host and path, fits no rule, is never listed and is allowed;
so is an empty one; rows that repeat are judged alike; a very long url is judged whole; an empty table gives no row, an
empty list lists nothing; null entries of the list count for nothing; ones that repeat count once. The columns of pages
stay, ones named like a result are replaced. Of rules that fit, the one with the most letters wins, of equally long ones
the first given."""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qsolake.llm.common import lower_ascii, written


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"),
)

WORDS = 8
#: Bits of the filter for each listed URL; with eight bits set, about one url in 1,500 passes falsely.
BITS_PER_URL = 16
#: Blocks that are sent to the tasks: 64 bytes each, 16 MB in all.
SENT_BLOCKS = 1 << 18
RESULTS = ("host", "path", "rule", "verdict")
#: Parts of a query that don't change what a url names.
TRACKING = "^(utm_[^=]*|ref|fbclid|gclid)(=|$)"


def rest(url: Column) -> Column:
    """What follows the first ://; empty without one."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))


def host(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(rest(url), "^[^/?#]*", 0))


def path(url: Column) -> Column:
    return F.regexp_extract(rest(url), "^[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """One form for the ways to write a url: without scheme, www. or m., default port, fragment, tracking parameters, a
    final slash, index page or .html; parameters sorted. Null without a host."""
    name = F.regexp_replace(F.regexp_replace(host(url), r"^(www|m)\.", ""), ":(80|443)$", "")
    place = F.regexp_replace(path(url), r"(/|/index\.html?|\.html?)$", "")
    given = F.regexp_extract(rest(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(given, "&"), lambda x: (x != "") & ~x.rlike(TRACKING))), "&")
    return F.when(name != "", F.concat(name, place, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def by_rules(rules: Sequence[Rule], value) -> Column:
    """value(rule) of the longest rule that fits, else null."""
    found = F.lit(None).cast("string")
    for r in sorted(reversed(rules), key=lambda r: len(r.name)):
        found = F.when(fits(r, F.col("host"), F.col("path")), F.lit(value(r))).otherwise(found)
    return found


def block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def masks(key: Column) -> list[Column]:
    """One bit of each word: eight pieces of six bits of a second hash."""
    bits = F.xxhash64(key, F.lit("bits"))
    pieces = [F.shiftrightunsigned(bits, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(WORDS)]
    return [F.call_function("shiftleft", F.lit(1).cast("long"), piece) for piece in pieces]


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """Rows (_block, _w0 ... _w7) of the blocks in which any bit is set, from the distinct canonical forms in column _key."""
    key = F.col("_key")
    return listed.groupBy(block(key, blocks).alias("_block")).agg(*[F.bit_or(m).alias(f"_w{i}") for i, m in enumerate(masks(key))])


def list_of(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """The distinct canonical forms of urls, written to the shared folder, in column _key."""
    keys = urls.select(canonical(F.col(url_col)).alias("_key")).where("_key is not null").distinct()
    return written(keys, "url-list")


def possible(keyed: DataFrame, listed: DataFrame, sent_blocks: int = SENT_BLOCKS) -> DataFrame:
    """keyed with a column _possible: false for a _key that is certainly not in listed."""
    blocks = max(1, math.ceil(listed.count() * BITS_PER_URL / (64 * WORDS)))
    made = bloom(listed, blocks)
    if blocks <= sent_blocks:
        made = F.broadcast(made)
    key = F.col("_key")
    there = F.lit(True)
    for i, m in enumerate(masks(key)):
        there = there & (F.col(f"_w{i}").bitwiseAND(m) == m)
    looked = keyed.withColumn("_block", block(key, blocks)).join(made, "_block", "left")
    return looked.withColumn("_possible", F.coalesce(there, F.lit(False)) & key.isNotNull()).drop("_block", *[f"_w{i}" for i in range(WORDS)])


def url_filter(
    pages: DataFrame, listed: DataFrame, *, rules: Sequence[Rule] = RULES, url_col: str = "url", sent_blocks: int = SENT_BLOCKS
) -> DataFrame:
    """pages with host, path, rule (name of the rule that decides, else null) and verdict (allow or block).

    listed is what list_of gives: the canonical forms that are blocked where no rule decides."""
    url = F.col(url_col)
    own = [c for c in pages.columns if c not in RESULTS]
    judged = (
        pages.select(*[F.col(c).alias(f"_in_{i}") for i, c in enumerate(own)], host(url).alias("host"), path(url).alias("path"), canonical(url).alias("_key"))
        .withColumn("rule", by_rules(rules, lambda r: r.name)).withColumn("verdict", by_rules(rules, lambda r: r.verdict))
        .withColumn("_key", F.when(F.col("rule").isNull(), F.col("_key")))
    )
    looked = possible(judged, listed, sent_blocks)
    clear = looked.where(~F.col("_possible")).withColumn("verdict", F.coalesce("verdict", F.lit("allow")))
    found = looked.where("_possible").join(listed.withColumn("_listed", F.lit(True)), "_key", "left")
    found = found.withColumn("verdict", F.when(F.col("_listed"), "block").otherwise("allow"))
    columns = [*[F.col(f"_in_{i}").alias(c) for i, c in enumerate(own)], *RESULTS]
    return clear.select(columns).unionByName(found.select(columns))


#: Words in the name of a host that put its pages on the list.
UNWANTED = ("ads", "casino", "cheap", "farm", "pills", "spam", "track")


def unwanted(pages: DataFrame, url_col: str = "url", words: Sequence[str] = UNWANTED) -> DataFrame:
    """The pages of hosts whose name has two unwanted words joined by a hyphen, as a source of listed URLs."""
    two = "|".join(words)
    return pages.where(host(F.col(url_col)).rlike(rf"(^|\.)({two})-({two})(\.|$)"))
