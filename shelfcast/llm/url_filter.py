"""URL filter: ordered allow and block rules, then a list of blocked URLs behind a blocked Bloom filter.

The listed URLs, in canonical form, set eight bits each in one 256-bit block of the filter. A page whose
URL finds one of its bits clear is surely not listed and is settled where it was read. Only possible hits
go on to the exact hash join with the list, which removes the false positives. DataFrame operations only.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.spread import salted_left_join
from shelfcast.sources.storage import stage

MAX_BLOCKS = 1 << 18  # of 256 bits: the broadcast filter has at most 8 MB of bits, however long the list
KEYS_PER_BLOCK = 16  # 16 bits for a key, a false positive in about a thousand, until the filter is full
MAX_RULES = 1000  # rules are part of the plan; longer lists belong in the filter

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# parameters that say where a visitor came from, not which page is shown
TRACKING = "utm_[^=&]*|gclid|fbclid|msclkid|ref"

_WORDS = [f"_w{i}" for i in range(4)]


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://` or for null."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; empty without `://` or for null."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """One form for the URLs of a page: no scheme, user, default port, leading `www.`, fragment, tracking
    parameter or closing slash; other parameters in order. Null where there is no host."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^.*@", ""), r"^www\.|:(80|443)?$", "")
    asked = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(asked, "&"), lambda p: ~p.rlike(f"^({TRACKING})(=|$)") & (p != "")))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(host != "", F.concat(host, F.regexp_replace(path_of(url), "/$", ""), query))


def first_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits, else null. A rule (verdict, host, path) fits its host
    and all subdomains where the path starts with the rule's; of equal lengths the longer host wins."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules; put listed URLs in the list")
    if wrong := [r for r in rules if r[0] not in ("allow", "block")]:
        raise ValueError(f"neither allow nor block: {wrong[0]}")
    longest = sorted(rules, key=lambda r: (-len(r[1]) - len(r[2]), -len(r[1]), r))
    fits = [
        F.when(
            ((host == h) | host.endswith(f".{h}")) & path.startswith(p),
            F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict")),
        )
        for verdict, h, p in longest
    ]
    return F.coalesce(*fits, F.lit(None).cast("struct<rule:string,verdict:string>"))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _masks(key: Column) -> list[Column]:
    """Four words with two bits set in each, taken from 48 bits of a second hash."""
    second = F.xxhash64(key, F.lit(1))

    def bit(i: int) -> Column:
        place = F.shiftrightunsigned(second, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        return F.call_function("shiftleft", F.lit(1).cast("long"), place)

    return [bit(2 * i).bitwiseOR(bit(2 * i + 1)) for i in range(4)]


def build_filter(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """(_block, four words): the blocks of the filter that hold a key, at most `blocks` rows."""
    marked = keys.select(_block(F.col(key), blocks).alias("_block"), *[m.alias(w) for w, m in zip(_WORDS, _masks(F.col(key)), strict=True)])
    return marked.groupBy("_block").agg(*[F.bit_or(w).alias(w) for w in _WORDS])


def blocks_for(keys: DataFrame, most: int = MAX_BLOCKS) -> int:
    """A power of two with KEYS_PER_BLOCK keys to a block, and `most` at most."""
    return min(most, 1 << max(0, (keys.count() - 1) // KEYS_PER_BLOCK).bit_length())


def possible_hits(rows: DataFrame, key: str, filled: DataFrame, blocks: int, out: str = "_possible") -> DataFrame:
    """Add whether all bits of the key are set; false where the key is null."""
    held = rows.withColumn("_block", _block(F.col(key), blocks)).join(F.broadcast(filled), "_block", "left")
    set_in = reduce(and_, [F.col(w).bitwiseAND(m) == m for w, m in zip(_WORDS, _masks(F.col(key)), strict=True)])
    return held.withColumn(out, F.coalesce(F.col(key).isNotNull() & set_in, F.lit(False))).drop("_block", *_WORDS)


def judge_urls(
    pages: DataFrame,
    listed: DataFrame,
    rules: Sequence[tuple[str, str, str]] = (),
    url: str = "url",
    listed_url: str = "url",
    most_blocks: int = MAX_BLOCKS,
) -> DataFrame:
    """Every row of `pages` with host, path, rule and verdict (allow or block).

    The longest rule that fits decides; without one a page is blocked if its canonical URL is that of a
    listed URL. A null URL, or one without `://`, has an empty host and path, is never listed and is
    allowed, unless a rule has an empty host. Repeated rows are judged one by one; listed URLs may repeat
    or be null. Input columns named like a result column are replaced. An empty list blocks nothing; an
    empty table gives an empty result.
    """
    result = ("host", "path", "rule", "verdict")
    own = [c for c in pages.columns if c not in result]
    found = first_rule(F.col("host"), F.col("path"), rules)
    rows = (
        pages.select(*own, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
        .withColumn("_found", found)
        .withColumn("_key", F.when(F.col("_found").isNull(), canonical(F.col(url))))
    )
    keys = stage(listed.select(canonical(F.col(listed_url)).alias("_key")).where("_key is not null").distinct(), "listed_urls")
    blocks = blocks_for(keys, most_blocks)
    probed = possible_hits(rows, "_key", build_filter(keys, "_key", blocks), blocks)
    settled = probed.where("not _possible").select(*own, "host", "path", "_found", F.lit(False).alias("_listed"))
    # a listed URL may be that of a third of all pages
    dealt = F.xxhash64("_key", F.spark_partition_id())
    checked = salted_left_join(probed.where("_possible"), keys.withColumn("_is", F.lit(True)), ["_key"], dealt)
    checked = checked.select(*own, "host", "path", "_found", F.coalesce("_is", F.lit(False)).alias("_listed"))
    return settled.unionByName(checked).select(
        *own, "host", "path", F.col("_found.rule").alias("rule"),
        F.coalesce("_found.verdict", F.when(F.col("_listed"), "block").otherwise("allow")).alias("verdict"),
    )
