"""URL verdicts by a sort-merge range join with prefix rules.

A host is turned round ("www.example.com" is "com.example.www."), so a rule for a host and its subdomains is an interval
of keys. Pages and rules are dealt over the same key ranges, a rule to every range its interval meets; each range is
sorted and swept once with a stack of the rules whose host encloses the current key.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetsig.llm.shared import width

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_END = "\U0010ffff"
_SAMPLE, _EDGE_CHARS = 64, 256


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def turned(host: Column) -> Column:
    """Canonical key: labels from the right, each followed by a dot; nothing for an empty host."""
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def _deal(edges: list[tuple[str, int]]):
    """Pages go to the range of (key, salt); rules to all ranges that hold a key they are a prefix of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            kinds, keys, salts = (part.column(i).to_pylist() for i in range(3))
            rows, ranges = [], []
            for i, (kind, key, salt) in enumerate(zip(kinds, keys, salts)):
                if kind:
                    spots = (bisect_right(edges, (key, salt)),)
                else:
                    low, high = bisect_left(edges, (key, -(1 << 63))), bisect_right(edges, (key + _END, 1 << 63))
                    spots = range(low, high + 1)
                rows.extend([i] * len(spots))
                ranges.extend(spots)
            taken = part.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(ranges, pa.int32()), *taken.columns], ["range", *part.schema.names])

    return run


def _best(stack: list, path: str) -> tuple | None:
    """The longest rule on the stack that fits: ties to the longer host, then to block."""
    found = None
    for _, rules in stack:
        for size, same in rules.items():
            hit = same.get(path[:size]) if size <= len(path) else None
            if hit and (found is None or hit[0] >= found[0]):
                found = hit
    return found


def _sweep(default: str):
    out = pa.schema([("page", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack, at = [], None
        for part in batches:
            page, host, path, rule, verdict = [], [], [], [], []
            for r, kind, key, own, h, p, text, said in zip(*(part.column(i).to_pylist() for i in (0, 1, 2, 4, 5, 6, 7, 8))):
                if r != at:
                    stack, at = [], r
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if kind == 0:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, {}))
                    same = stack[-1][1].setdefault(len(p), {})
                    if p not in same or said == "block":
                        same[p] = len(h) + len(p), text, said
                    continue
                hit = _best(stack, p)
                page.append(own)
                host.append(h)
                path.append(p)
                rule.append(hit[1] if hit else None)
                verdict.append(hit[2] if hit else default)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((page, host, path, rule, verdict), out)], schema=out)

    return run


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", key: str = "page_id", url: str = "url") -> DataFrame:
    """``(page, host, path, rule, verdict)`` per row of ``pages``.

    ``rules`` has ``(host, path, verdict)``; a rule fits its host and all subdomains if the url's path starts with the
    rule's. The rule with the longest text (host and path together) wins; among equally long ones the longer host, and
    block over allow for the same rule. Without a rule the verdict is ``default`` and the rule null. Rules may repeat;
    those with a null host, path or verdict are ignored. Null urls and urls without ``://`` have an empty host and path,
    which no rule with a host fits. Repeated and null page ids are kept.
    A host with very many pages is spread over ranges by a salt from its path and id.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col(url))
    asked = pages.select(F.lit(1).alias("kind"), F.col(key).cast("long").alias("page"), host.alias("host"), path.alias("path"))
    asked = asked.select(
        "kind", turned(F.col("host")).alias("key"), F.xxhash64("path", "page").alias("salt"), "page", "host", "path",
        F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("said"),
    )
    low = F.translate("host", _UPPER, _LOWER)
    given = rules.where("host is not null and path is not null and verdict is not null").select(low.alias("host"), "path", "verdict")
    given = given.distinct().select(
        F.lit(0).alias("kind"), turned(F.col("host")).alias("key"), F.lit(0).cast("long").alias("salt"),
        F.lit(None).cast("long").alias("page"), "host", "path", F.concat("host", "path").alias("rule"), F.col("verdict").alias("said"),
    )
    parts = width(spark)
    # range edges from a sample that grows with the number of ranges only
    sample = asked.select(F.substring("key", 1, _EDGE_CHARS).alias("key"), "salt", F.xxhash64("salt").alias("draw"))
    picked = sorted((r.key, r.salt) for r in sample.orderBy("draw", "key").limit(_SAMPLE * parts).collect())
    edges = sorted({picked[i * len(picked) // parts] for i in range(1, parts)}) if picked else []
    kind = "kind int, key string, salt long, page long, host string, path string, rule string, said string"
    dealt = asked.unionAll(given).mapInArrow(_deal(edges), f"range int, {kind}")
    dealt = dealt.repartition(parts, "range").sortWithinPartitions("range", "key", "kind", "salt")
    return dealt.mapInArrow(_sweep(default), "page long, host string, path string, rule string, verdict string")
