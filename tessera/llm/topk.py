"""Exact top-k inner products with block-at-a-time pruning (operator 1)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import materialize

LARGE = 2**53


def quantized(c: Column) -> Column:
    """floor(256 * x) of every component as a double; null where the vector is null or
    has a component that is null or not finite."""
    double = F.transform(c, lambda x: x.cast("double"))
    odd = F.exists(double, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(c.isNotNull() & ~F.coalesce(odd, F.lit(True)), F.transform(double, lambda x: F.floor(x * 256.0)))


def together(vectors: np.ndarray, block: int) -> np.ndarray:
    """An order of the rows in which blocks hold rows that are alike: halves are parted
    across the direction in which their rows differ most, down to one block."""
    parts, out = [np.arange(len(vectors))], []
    while parts:
        own = parts.pop()
        if len(own) <= block:
            out.append(own)
            continue
        x = vectors[own].astype(np.float64)
        x -= x.mean(axis=0)
        d = x[np.argmax(np.abs(x).sum(axis=1))]
        for _ in range(6):
            d = x.T @ (x @ (d / max(1e-300, np.abs(d).max())))
        side = np.argsort(x @ d, kind="stable")
        half = -(-len(own) // (2 * block)) * block
        parts += [own[side[half:]], own[side[:half]]]
    return np.concatenate(out)


def top_of_blocks(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, block: int = 64, seen: dict | None = None) -> Iterator[tuple[int, int, int]]:
    """(query id, id, score) of each query's k best of these vectors, its own excluded,
    ties to smaller ids.

    Rows are put in an order in which like ones are together, and blocks are ranges of it.
    A term is a dimension with a sign, so a block's summed
    term maxima bound a query's score in it. Each query takes blocks in the order of
    that bound, and scores them through the block's forward index (its vectors' rows)
    until the next bound is below its k-th score. ``seen`` counts the blocks scored and
    passed over. Vectors without any likeness give bounds that pass nothing over."""
    order = together(vectors, block) if vectors.shape[1] else np.arange(len(ids))
    vectors, ids = vectors[order], ids[order]
    starts = np.arange(0, len(ids), block)
    peak = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * max(1, vectors.shape[1])
    kind = np.float64 if peak < LARGE else object  # beyond doubles: whole numbers of any size
    cast = lambda m: m.astype(np.int64).astype(kind)
    q, v = cast(queries), cast(vectors)
    high, low = np.maximum.reduceat(vectors, starts, axis=0), np.minimum.reduceat(vectors, starts, axis=0)
    zero = 0.0 if kind is np.float64 else 0
    bound = np.maximum(q, zero) @ cast(high).T + np.minimum(q, zero) @ cast(low).T
    turn = np.argsort(-bound, axis=1, kind="stable")
    scored = [np.empty(0, kind)] * len(q)
    placed = [np.empty(0, np.int64)] * len(q)
    kth = np.full(len(q), -float("inf"), kind)
    live = np.arange(len(q))
    taken = 0
    for step in range(len(starts)):
        live = live[bound[live, turn[live, step]] >= kth[live]]
        if not len(live):
            break
        taken += len(live)
        chosen = turn[live, step]
        for b in np.unique(chosen):
            these = live[chosen == b]
            part = slice(starts[b], min(starts[b] + block, len(ids)))
            scores = q[these] @ v[part].T
            for row, i in zip(scores, these, strict=True):
                own = np.flatnonzero((row >= kth[i]) & (ids[part] != query_ids[i]))
                if not len(own):
                    continue
                s, at = np.concatenate([scored[i], row[own]]), np.concatenate([placed[i], own + starts[b]])
                keep = np.argsort(ids[at], kind="stable")
                keep = keep[np.argsort(-s[keep], kind="stable")][:k]
                scored[i], placed[i] = s[keep], at[keep]
                if len(keep) == k:
                    kth[i] = scored[i][-1]
    if seen is not None:
        seen["scored"] = seen.get("scored", 0) + taken
        seen["passed"] = seen.get("passed", 0) + len(q) * len(starts) - taken
    for i in range(len(q)):
        for s, at in zip(scored[i], placed[i], strict=True):
            yield int(query_ids[i]), int(ids[at]), int(s)


def _rows(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    n = table.num_rows
    column = table.column("v").combine_chunks()
    flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in (column.chunks if isinstance(column, pa.ChunkedArray) else [column])] or [np.empty(0, np.int64)])
    return flat.astype(np.int64).reshape(n, len(flat) // n), table.column("vec_id").to_numpy().astype(np.int64)


def _search(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple[int, int, int]] = []
        if left.num_rows and right.num_rows:
            (q, qi), (v, vi) = _rows(left), _rows(right)
            for at in range(0, len(q), 1024):
                rows += top_of_blocks(q[at : at + 1024], qi[at : at + 1024], v, vi, k)
        return pa.table({c: pa.array([r[i] for r in rows], pa.int64()) for i, c in enumerate(("query_id", "vec_id", "score"))})

    return run


def top_k(vectors: DataFrame, queries: Column, k: int = 5, shard_rows: int = 1 << 16, query_rows: int = 1 << 14) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each
    row of ``vectors`` (vec_id, embedding) for which ``queries`` holds, with every other
    row; all if fewer; ties to smaller ids.

    Candidates are dealt in ranges of vec_id (shards of at most about ``shard_rows``)
    and queries in chunks of ``query_rows``; a task searches one shard for one chunk,
    block by block, and sends k rows for each query. Both sides are sent only as
    often as there are chunks or shards, so no task or broadcast grows with the input.

    Vectors that are null or hold a component that is null or not finite, and rows without
    an id, take no part. Only vectors of one length are compared. A query whose id is
    repeated searches once, with the least of its vectors; every row with its id counts
    as its own; other repeated rows are candidates each. Queries without a candidate
    give no row; empty tables give none. Scores beyond 64 bits raise an error."""
    spark = vectors.sparkSession
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), quantized(F.col("embedding")).alias("v"), queries.alias("q")).where("vec_id is not null and v is not null")
    v = materialize(v.withColumn("d", F.size("v")), "vectors")
    n, n_queries = v.agg(F.count("*"), F.count_if("q")).first()
    cores = spark.sparkContext.defaultParallelism
    shards = int(max(1, -(-n // shard_rows), min(2 * cores, n // 1024)))
    chunks = int(max(1, -(-n_queries // query_rows)))
    edges = sorted(set(v.approxQuantile("vec_id", [i / shards for i in range(1, shards)], 0.25 / shards))) if shards > 1 else []
    edges = F.array(*[F.lit(int(e)) for e in edges]) if edges else F.array().cast("array<bigint>")
    shard = F.size(F.filter(edges, lambda e: e <= F.col("vec_id")))
    candidates = v.select("vec_id", "v", "d", shard.alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    asked = v.where("q").groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("d", F.size("v")).withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).cast("int"))
    asked = asked.select("vec_id", "v", "d", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "chunk")
    key = ["d", "shard", "chunk"]
    found = asked.groupBy(*key).cogroup(candidates.groupBy(*key)).applyInArrow(_search(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
