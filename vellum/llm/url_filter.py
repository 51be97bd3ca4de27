"""URL filter: path rules, then a sorted digest array of blocked hosts and pages.

The blocklist is kept as shards of sorted 64-bit xxhash keys. A task memory-maps the keys
of one shard, finds all its probes by vectorised binary search, and confirms each hit
against the stored full string, so a digest collision never blocks a clean url. A url is
probed under its host, every parent domain, and host plus path; probes are made distinct
first, so a host with a third of all rows is probed once.

Defined results: a null url, or one without ``://``, has empty host and path, fits no rule
and is allowed; null or empty blocklist entries are ignored, repeated ones count once;
repeated urls are judged row by row; further input columns are dropped except ``id_col``.
"""

from __future__ import annotations

import tempfile
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.lineage import materialise
from vellum.operators.common import checked_broadcast

SHARD_ROWS = 1 << 20  # keys, and probes, of one shard at most (on average)


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: Production rules.
RULES = (Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"),
         Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))

#: Production blocklist: names of blocked sites; under which domains they stand is read from the pages.
NAMES = ("ads-track", "spam-farm", "casino-win", "adult-x", "cheap-pills", "free-bets")


def host_of(url: Column) -> Column:
    """Text after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), upper, upper.lower())


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def longest_rule(rules: tuple[Rule, ...], host: Column, path: Column, value: str) -> Column:
    """``value`` (a field of ``Rule``) of the longest rule that fits; null if none does."""
    ordered = sorted(rules, key=lambda r: (-len(r.name), r.name))
    return F.coalesce(F.lit(None).cast("string"), *[F.when(fits(r, host, path), getattr(r, value)) for r in ordered])


def parent_domains(host: Column) -> Column:
    """The host and each domain above it: ``a.b.c`` -> ``a.b.c, b.c, c``."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n - i + 1), "."))


def variants(names: tuple[str, ...], pages: DataFrame, url: str = "url") -> DataFrame:
    """``entry``: every listed name under every domain that occurs in ``pages`` (``name.example.org``, ``name.org``, …).

    The list grows with the distinct domains of the input, ``len(names)`` entries for each.
    """
    hosts = pages.select(host_of(F.col(url)).alias("host")).filter("host <> ''").distinct()
    domains = hosts.select(F.explode(parent_domains(F.col("host"))).alias("domain")).distinct()
    return domains.select(F.explode(F.transform(F.array(*[F.lit(n) for n in names]), lambda n: F.concat(n, F.lit("."), F.col("domain")))).alias("entry"))


def probe(entries: DataFrame, blocklist: DataFrame) -> DataFrame:
    """The distinct ``entry`` strings of ``entries`` that the blocklist holds.

    Both sides are dealt to shards by their digest; a shard's share of either side is about
    ``SHARD_ROWS`` rows, whatever the tables hold.
    """
    wanted = entries.select("entry").filter("entry IS NOT NULL AND entry <> ''").distinct()
    stored = blocklist.select("entry").filter("entry IS NOT NULL AND entry <> ''").distinct()
    n = max(1, -(-max(wanted.count(), stored.count()) // SHARD_ROWS))

    def keyed(df: DataFrame) -> DataFrame:
        key = F.xxhash64("entry")
        return df.select("entry", key.alias("key"), F.pmod(F.shiftrightunsigned(key, 32), F.lit(n)).cast("int").alias("shard"))

    def search(array: pa.Table, probes: pa.Table) -> pa.Table:
        if not array.num_rows or not probes.num_rows:
            return pa.table({"entry": pa.array([], pa.string())})
        order = np.argsort(array["key"].to_numpy(), kind="stable")
        strings = array["entry"].take(pa.array(order))
        with tempfile.TemporaryFile() as f:
            array["key"].to_numpy()[order].tofile(f)
            f.flush()
            digests = np.memmap(f, np.int64, "r", shape=(len(order),))
            keys = probes["key"].to_numpy()
            lo, hi = np.searchsorted(digests, keys, "left"), np.searchsorted(digests, keys, "right")
            del digests
        hit = np.zeros(len(keys), bool)
        text = probes["entry"]
        for step in range(int((hi - lo).max(initial=0))):  # more than one step only where digests collide
            near = np.flatnonzero(lo + step < hi)
            same = pc.equal(text.take(pa.array(near)), strings.take(pa.array(lo[near] + step)))
            hit[near[np.asarray(same)]] = True
        return pa.table({"entry": text.take(pa.array(np.flatnonzero(hit))).cast(pa.string())})

    return keyed(stored).groupBy("shard").cogroup(keyed(wanted).groupBy("shard")).applyInArrow(search, "entry string")


def judge(pages: DataFrame, blocklist: DataFrame, rules: tuple[Rule, ...] = RULES, url: str = "url", id_col: str = "page_id") -> DataFrame:
    """``id_col, host, path, rule, verdict, listed`` for every row.

    ``verdict`` is the longest fitting rule's, else ``block`` if the digest array holds the
    host, a parent domain, or host + path (``listed``), else ``allow``.
    """
    h, p = F.col("host"), F.col("path")
    parts = pages.select(F.col(id_col), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    hosts = parts.select("host").filter("host <> ''").distinct()
    domains = hosts.select("host", F.explode(parent_domains(h)).alias("entry"))
    exact = parts.filter("host <> '' AND path <> ''").select(F.concat(h, p).alias("entry"))
    hits = probe(domains.select("entry").unionByName(exact), blocklist).distinct()
    hits = materialise(hits, "listed")
    bad_hosts = materialise(domains.join(hits, "entry", "left_semi").select("host").distinct().withColumn("bad_host", F.lit(True)), "hosts")
    bad_pages = hits.select(F.col("entry").alias("_page"), F.lit(True).alias("bad_page"))
    listed = F.coalesce("bad_host", F.lit(False)) | F.coalesce("bad_page", F.lit(False))
    # The listed hosts found are few; where they are counted to be, a common host moves no page.
    return (parts.join(checked_broadcast(bad_hosts), "host", "left")
            .withColumn("_page", F.concat(h, p)).join(checked_broadcast(bad_pages), "_page", "left")
            .select(id_col, "host", "path", longest_rule(rules, h, p, "name").alias("rule"),
                    F.coalesce(longest_rule(rules, h, p, "verdict"), F.when(listed, "block").otherwise("allow")).alias("verdict"),
                    listed.alias("listed")))
