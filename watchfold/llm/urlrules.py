"""URL rules by a sort-merge range join.

A host is written backwards (``org.example.blog.``), so that a rule for a host and its
subdomains is a range of keys; together with its path prefix a rule is an interval of
keys ``host + path``.  Intervals of one host are nested or disjoint.  URL keys, one for
each of a host's suffixes that has rules, are sorted and swept together with the rules;
a stack holds the rules whose intervals are open, the innermost on top.

Rules are sorted once and taken in blocks of bounded size, each sent to all tasks; the
URL side is swept batch by batch where it lies and never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BLOCK = 50_000  # rules swept at once: the bound of what is sent to tasks
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or no ``://``."""
    return F.translate(F.regexp_extract(_after_scheme(url), r"\A[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after_scheme(url), r"\A[^/?#]*([^?#]*)", 1)


def reversed_host(host: str) -> str:
    """Labels from the right, each closed by a dot."""
    return ".".join(reversed(host.split("."))) + "." if host else ""


def rule_blocks(rules: DataFrame, size: int = BLOCK) -> Iterator[list[tuple[str, str, str, str]]]:
    """Distinct rules (host, path, verdict) in blocks, sorted by key: (reversed host, path, rule, verdict).

    A rule given with both verdicts blocks.
    """
    clean = rules.select(F.translate("host", _UPPER, _LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").where("host <> ''")
    one = clean.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).orderBy("host", "path")
    block = []
    for r in one.toLocalIterator():
        block.append((reversed_host(r.host), r.path, r.host + r.path, r.verdict))
        if len(block) == size:
            yield sorted(block)
            block = []
    if block:
        yield sorted(block)


def sweep(keys: list[tuple[str, str]], rules: list[tuple[str, str, str, str]]) -> list[int]:
    """For each key (host, path), both sorted, the innermost rule of that very host whose path it starts with, else -1."""
    stack, found, r = [], [], 0
    for host, path in keys:
        while r < len(rules) and (rules[r][0], rules[r][1]) <= (host, path):
            while stack and not (rules[stack[-1]][0] == rules[r][0] and rules[r][1].startswith(rules[stack[-1]][1])):
                stack.pop()  # its interval ended before this rule
            stack.append(r)
            r += 1
        while stack and not (rules[stack[-1]][0] == host and path.startswith(rules[stack[-1]][1])):
            stack.pop()
        found.append(stack[-1] if stack else -1)
    return found


def judge(spark: SparkSession, urls: DataFrame, rules: DataFrame, default: str = "allow", url_col: str = "url", block: int = BLOCK) -> DataFrame:
    """``urls`` with ``host``, ``path``, ``rule`` and ``verdict`` (columns of these names are replaced).

    The longest rule (host and path together) wins, then the longer host; without one the verdict is ``default``.  Null and
    odd URLs have empty host and path and fit no rule; an empty rule table leaves every URL to
    the default; repeated URLs are judged alike; an empty table gives no rows.
    """
    kept = [c for c in urls.columns if c not in ("host", "path", "rule", "verdict")]
    out = urls.select(*kept, host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    for rows in rule_blocks(rules, block):
        shared = spark.sparkContext.broadcast((rows, {r[0] for r in rows}))

        def run(batches, shared=shared):
            rows, hosts = shared.value
            for batch in batches:
                names, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
                keys = []
                for n, (name, path) in enumerate(zip(names, paths)):
                    whole = reversed_host(name)
                    at = whole.find(".") + 1
                    while at:
                        if whole[:at] in hosts:
                            keys.append((whole[:at], path, n))
                        at = whole.find(".", at) + 1
                keys.sort()
                best = list(zip(batch.column("rule").to_pylist(), batch.column("verdict").to_pylist()))
                for (host, _, n), r in zip(keys, sweep([k[:2] for k in keys], rows)):
                    if r >= 0:
                        rule = (rows[r][2], rows[r][3])
                        if best[n][0] is None or (len(rule[0]), len(host)) > (len(best[n][0]), len(best[n][0].split("/", 1)[0]) + 1):
                            best[n] = rule
                at = batch.schema.names.index("rule")
                yield pa.record_batch(
                    [*batch.columns[:at], pa.array([b[0] for b in best], pa.string()), pa.array([b[1] for b in best], pa.string())], batch.schema.names
                )

        out = out.mapInArrow(run, out.schema)
    return out
