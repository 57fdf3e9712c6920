"""URL filters by a sort-merge range join over reversed hosts (operator 9)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import ascii_lower


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): both empty for a null or a string without ://."""
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(has, ascii_lower(host)).otherwise(""), F.when(has, path).otherwise("")


def reversed_host(host: Column) -> Column:
    """com.example.www. for www.example.com: a domain's key begins those of all its
    subdomains, so its rules cover one interval of sorted keys."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def interval(rule_host: str) -> tuple[str, str]:
    """The keys from the first on and below the second are the host and its subdomains."""
    key = ".".join(reversed(rule_host.split("."))) + "."
    return key, key[:-1] + "/"  # the slash follows the full stop


def _sweep(rules: list[tuple[str, str, str]]):
    """rules: (host, path, verdict). A sorted pass over keys with a stack of the open
    intervals, each within the one below it."""
    nested: dict[tuple[str, str], list[tuple[str, str, int, str]]] = {}
    for host, path, verdict in rules:
        nested.setdefault(interval(host), []).append((path, host + path, len(host), verdict))
    ordered = [(low, high, sorted(own, key=lambda r: -len(r[0]))) for (low, high), own in sorted(nested.items(), key=lambda x: (x[0][0], [-ord(c) for c in x[0][1]]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple[str, str, list]] = []
        at = 0
        for batch in batches:
            keys, paths, best, hosts, verdicts = (batch.column(c).to_pylist() for c in ("key", "path", "rule", "rule_host", "verdict"))
            for i, (key, path) in enumerate(zip(keys, paths, strict=True)):
                while at < len(ordered) and ordered[at][0] <= key:
                    while stack and stack[-1][1] <= ordered[at][0]:
                        stack.pop()
                    stack.append(ordered[at])
                    at += 1
                while stack and stack[-1][1] <= key:
                    stack.pop()
                for _, _, own in stack:
                    for start, name, host, verdict in own:
                        if path.startswith(start):
                            if best[i] is None or (len(name), host) > (len(best[i]), hosts[i]):
                                best[i], hosts[i], verdicts[i] = name, host, verdict
                            break
            new = {"rule": pa.array(best, pa.string()), "rule_host": pa.array(hosts, pa.int32()), "verdict": pa.array(verdicts, pa.string())}
            yield pa.RecordBatch.from_arrays([new.get(n, batch.column(n)) for n in batch.schema.names], names=batch.schema.names)

    return run


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", default: str = "allow", block_rules: int = 200_000) -> DataFrame:
    """``pages`` with host, path, rule and verdict; rules are (host, path, verdict).

    A rule fits its host and all subdomains if the path starts with its path; the
    longest (host and path together) wins, of two equally long ones the one with the longer
    host, and where none fits the verdict is
    ``default``. Keys, reversed hosts and paths, are dealt in ranges and sorted; each
    task sweeps its range with a stack of open rules. A host with very many rows is
    split by its paths and by a salt. Rules go to every task, ``block_rules`` of them
    at once; a longer list is swept in blocks, one after the other, over rows that
    stay sorted, with the same result.

    A null url, or one without ://, has an empty host and path; rules with an empty host
    fit only an empty host. Repeated rows give a row each; with repeated rules the
    first one counts; an empty table gives no rows. Columns of ``pages`` named host, path, rule or
    verdict are replaced, after the url was read if it is one of them."""
    new = ["host", "path", "rule", "verdict"]
    host, path = url_parts(F.col(f"`{url}`").cast("string"))
    own = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in pages.columns if c not in new])
    rows = pages.select(own.alias("own"), host.alias("host"), path.alias("path"), F.lit(None).cast("string").alias("rule"), F.lit(0).alias("rule_host"), F.lit(default).alias("verdict"))
    salt = F.pmod(F.xxhash64("own"), F.lit(4096))
    out = rows.withColumns({"key": reversed_host(F.col("host")), "salt": salt}).repartitionByRange("key", "path", "salt").sortWithinPartitions("key", "path").drop("salt")
    first: dict[tuple[str, str], str] = {}
    for h, p, v in rules:
        first.setdefault((h.translate({c: c + 32 for c in range(65, 91)}), p), v)
    whole = [(h, p, v) for (h, p), v in first.items()]
    for i in range(0, len(whole), block_rules):
        out = out.mapInArrow(_sweep(whole[i : i + block_rules]), out.schema)
    return out.select(*[F.col(f"own.`{c}`") for c in pages.columns if c not in new], *new)
