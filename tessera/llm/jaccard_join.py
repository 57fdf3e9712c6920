"""N-gram Jaccard join: grouped prefix join over word shingles (operator 5)."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.shared import bounded_batches, lean, materialize
from tessera.llm.shingles import U, mix, set_key, shingle_sets

WIDTH = 1 << 22  # counters in each of the sketch's two rows
PIECE = 1 << 16
SIZE_BITS = 20
BITMAP = 1 << 27  # bits of the filter of candidate groups
FLUSH = 1 << 20
PAIRS = 1 << 20
TWICE = U((1 << 64) - 1)
FAN = 32
FULL = 32  # runs up to so many groups are counted pair by pair
OFTEN = 8  # shingles of so many prefixes go behind others of their level
SENT = 256 << 20  # bytes of sets that may be sent to be compared at once, if not twice those held
DONE = U((1 << SIZE_BITS) - 1)


def prefix_len(n: np.ndarray | int, percent: int):
    """Sets that link share one of so many first shingles of either, in any one order."""
    return n + (-percent * n) // 100 + 1


# -- pass 1: sizes, set keys and the sketch of shingle frequencies ---------------

def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(2 * WIDTH, np.uint8)
    waiting: list[np.ndarray] = []
    names = ["kind", "doc_id", "n", "cls", "piece", "blob"]
    held, ids = 0, None

    def count() -> None:
        s = np.concatenate(waiting)
        for row in (0, 1):
            part = counts[row * WIDTH : (row + 1) * WIDTH]
            at, found = np.unique((s >> U(32 * row)).astype(np.uint32) & np.uint32(WIDTH - 1), return_counts=True)
            part[at] = np.minimum(found + part[at], 255)
        waiting.clear()

    for batch in batches:
        n, cls = [], []
        for _, s in shingle_sets(batch.column("text")):
            n.append(len(s))
            cls.append(set_key(s))
            if len(s):
                waiting.append(s)
                held += len(s)
            if held >= FLUSH:
                count()
                held = 0
        k = len(n)
        ids = batch.column("doc_id")
        yield pa.RecordBatch.from_arrays([pa.array([0] * k, pa.int32()), ids, pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names=names)
    if waiting:
        count()
    pieces = [(i, counts[i * PIECE : (i + 1) * PIECE]) for i in range(2 * WIDTH // PIECE)]
    pieces = [(i, zlib.compress(c.tobytes(), 1)) for i, c in pieces if c.any()]
    k = len(pieces)
    if k:
        yield pa.RecordBatch.from_arrays([pa.array([1] * k, pa.int32()), pa.nulls(k, ids.type), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.array([p for p, _ in pieces], pa.int32()), pa.array([b for _, b in pieces], pa.binary())], names=names)


def _add_pieces(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    total = np.zeros(PIECE, np.int64)
    for batch in table.to_batches():
        for blob in batch.column("blob"):
            raw = np.frombuffer(zlib.decompress(blob.as_py()), np.uint8 if len(key) == 2 else np.int64)
            total += raw
    return pa.table({"piece": pa.array([key[0].as_py()], pa.int32()), "blob": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})


def _levels(sketch: DataFrame) -> np.ndarray:
    """How far each counter is above the mean, in steps of its spread, as a power of two.
    The table has 2 * WIDTH bytes whatever the input, so it may be broadcast."""
    salted = sketch.select("piece", "blob", F.pmod(F.xxhash64("blob"), F.lit(16)).alias("salt"))
    some = salted.groupBy("piece", "salt").applyInArrow(_add_pieces, "piece int, blob binary")
    rows = materialize(some.groupBy("piece").applyInArrow(_add_pieces, "piece int, blob binary"), "sketch").collect()
    total = np.zeros(2 * WIDTH, np.int64)
    for r in rows:
        total[r.piece * PIECE : (r.piece + 1) * PIECE] = np.frombuffer(zlib.decompress(bytes(r.blob)), np.int64)
    mean = max(1.0, total.sum() / (2 * WIDTH))
    return np.floor(np.log2(1 + np.maximum(total - mean, 0) / (2 * np.sqrt(mean)))).astype(np.uint8)


def _ordered_prefix(s: np.ndarray, order: tuple[np.ndarray, np.ndarray | None], percent: int) -> np.ndarray:
    """First shingles of a sorted set in the common order: rarer levels first, of a level
    those not found often, then by hash. Any order is right; this one keeps common shingles
    out of prefixes."""
    levels, often = order
    level = 2 * np.minimum(levels[(s & U(WIDTH - 1)).astype(np.int64)], levels[WIDTH + ((s >> U(32)) & U(WIDTH - 1)).astype(np.int64)])
    if often is not None:
        at = (s & U(BITMAP - 1)).astype(np.int64)
        level += often[at >> 3] >> (at & 7).astype(np.uint8) & 1
    return s[np.argsort(level, kind="stable")[: prefix_len(len(s), percent)]]


def _group_key(prefix: np.ndarray, n: int) -> int:
    """64 bits for the documents with this prefix and size."""
    return int(mix(mix(prefix).sum(dtype=U, keepdims=True) + U(n))[0])


def _group_id(prefix: np.ndarray, n: int) -> int:
    """One id for the documents with this prefix and size: 44 bits of hash, 20 of
    size. Groups that share an id by chance, told apart by their keys, all post their
    prefixes under it, and are verified as members of one group."""
    return (_group_key(prefix, n) >> SIZE_BITS << SIZE_BITS) | min(n, int(DONE))


# -- pass 2: shingles of many prefixes --------------------------------------------

def _prefix_tokens(order, buckets: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen, tokens, size = order.value, set(), [], 0

        def flush() -> pa.RecordBatch:
            t = np.concatenate(tokens or [np.empty(0, U)])
            b = ((t >> U(32)) % U(buckets)).astype(np.int64)
            by = np.argsort(b, kind="stable")
            t, at = (t[by] & U(0xFFFFFFFF)).astype(np.uint32), np.searchsorted(b[by], np.arange(buckets + 1))
            some = np.flatnonzero(np.diff(at)).tolist()
            tokens.clear()
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([t[at[i] : at[i + 1]].tobytes() for i in some], pa.binary())], names=["bucket", "tokens"])

        for batch in batches:
            for _, s in shingle_sets(batch.column("text")):
                if not len(s) or (key := set_key(s)) in seen:
                    continue
                if len(seen) < 1 << 17:
                    seen.add(key)
                tokens.append(_ordered_prefix(s, held, percent))
                size += len(tokens[-1])
                if size >= FLUSH:
                    yield flush()
                    size = 0
        yield flush()

    return run


def _often(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    t, times = np.unique(np.frombuffer(b"".join(x.as_py() for x in table.column("tokens")), np.uint32), return_counts=True)
    at = np.unique(t[times >= OFTEN] & np.uint32(BITMAP - 1))
    parts = [at[i : i + FLUSH].tobytes() for i in range(0, len(at), FLUSH)]
    return pa.table({"bits": pa.array(parts, pa.binary())})


def _found_often(docs: DataFrame, order, buckets: int, percent: int) -> np.ndarray:
    """A filter of BITMAP bits over the shingles that stand in OFTEN prefixes or more.
    Counters of the sketch are shared by ever more shingles as the input grows, and those of
    some dozen texts no longer stand out; in prefixes they would make long runs of texts that
    have nothing else in common. 16 MB at any input; a bit set by chance changes the order only."""
    tokens = docs.select("text").mapInArrow(lean(_prefix_tokens(order, buckets, percent)), "bucket int, tokens binary")
    found = materialize(tokens.groupBy("bucket").applyInArrow(_often, "bits binary"), "often")
    bits = np.zeros(BITMAP // 8, np.uint8)
    for r in found.toLocalIterator():
        at = np.frombuffer(bytes(r.bits), np.uint32)
        np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return bits


# -- pass 3: shingle -> groups, runs and first candidates ------------------------

_packed = pa.schema([("bucket", pa.int32()), ("tokens", pa.binary()), ("groups", pa.binary())])


def _postings(order, buckets: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_order = order.value
        seen: set[bytes] = set()
        done: set[int] = set()
        tokens: list[np.ndarray] = []
        groups: list[np.ndarray] = []
        members: list[tuple[int, int]] = []
        held = 0

        def flush() -> pa.RecordBatch:
            t, g = np.concatenate(tokens or [np.empty(0, U)]), np.concatenate(groups or [np.empty(0, U)])
            b = ((t >> U(32)) % U(buckets)).astype(np.int64)
            by = np.argsort(b, kind="stable")
            t, g, b = (t[by] & U(0xFFFFFFFF)).astype(np.uint32), g[by], b[by]
            at = np.searchsorted(b, np.arange(buckets + 1))
            m = np.array(members, U).reshape(-1, 2)
            mb = (mix(m[:, 0]) % U(buckets)).astype(np.int64)
            rows = [(i, t[at[i] : at[i + 1]].tobytes(), g[at[i] : at[i + 1]].tobytes()) for i in range(buckets) if at[i + 1] > at[i]]
            rows += [(-1 - int(i), b"", m[mb == i].tobytes()) for i in np.unique(mb)]
            tokens.clear(), groups.clear(), members.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else ((), (), ()), _packed, strict=True)], schema=_packed)

        for batch in batches:
            for _, s in shingle_sets(batch.column("text")):
                if not len(s) or (key := set_key(s)) in seen:
                    continue
                if len(seen) < 1 << 17:
                    seen.add(key)
                prefix = _ordered_prefix(s, held_order, percent)
                gid = _group_id(prefix, len(s))
                members.append((gid, int(np.frombuffer(key, U)[0])))
                held += 16
                whole = _group_key(prefix, len(s))
                if whole in done:
                    continue
                if len(done) < 1 << 17:
                    done.add(whole)
                low, times = np.unique(prefix & U(0xFFFFFFFF), return_counts=True)
                if len(low) < len(prefix):  # shingles that may pass for one in a bucket
                    members += [(gid, int(TWICE))] * int((times - 1).sum())
                tokens.append(prefix)
                groups.append(np.full(len(prefix), gid, U))
                held += len(prefix)
                if held >= FLUSH:
                    yield flush()
                    held = 0
        yield flush()

    return run


def _near_sizes(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of the sizes in these group ids can reach the similarity."""
    x, y = np.minimum(a & DONE, b & DONE).astype(np.int64), np.maximum(a & DONE, b & DONE).astype(np.int64)
    return (100 * x >= percent * y) | (y == int(DONE))


def _tree_links(run: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """A tree over a sorted run of group ids: blocks of about FAN ids by their first
    bits hang on the block's first id, then those form the next run."""
    out = []
    while len(run) > 1:
        bits = max(0, int(np.ceil(np.log2(len(run) / FAN))))
        block = run >> U(64 - bits) if bits else np.zeros(len(run), U)
        head = np.concatenate(([True], block[1:] != block[:-1]))
        first = run[np.flatnonzero(head)[np.cumsum(head) - 1]]
        out.append((first[~head], run[~head]))
        if head.all():  # every id has a block of its own: hang all on the first
            out.append((np.full(len(run) - 1, run[0], U), run[1:]))
            break
        run = run[head]
    return out


_found = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("shared", pa.int64()), ("ids", pa.binary())])


def _all_pairs(ids: np.ndarray, start: np.ndarray, size: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within each run of FULL ids at most, of sizes that can be similar, and how
    often each is met. A pair is one integer of two positions among the distinct ids;
    pairs met are counted whenever PAIRS of them wait, so distinct ones set the memory."""
    names, place = np.unique(ids, return_inverse=True)
    place = place.astype(U)
    keys, counts, waiting, held = np.empty(0, U), np.empty(0, np.int64), [], 0

    def count() -> tuple[np.ndarray, np.ndarray]:
        met, times = np.unique(np.concatenate([np.empty(0, U), *waiting]), return_counts=True)
        waiting.clear()
        if not len(keys):
            return met, times
        both, at = np.unique(np.concatenate([keys, met]), return_inverse=True)
        total = np.zeros(len(both), np.int64)
        np.add.at(total, at, np.concatenate([counts, times]))
        return both, total

    for k in np.unique(size):
        at = start[size == k]
        i, j = np.triu_indices(k, 1)
        step = max(1, PAIRS // 4 // len(i))
        for part in range(0, len(at), step):
            rows = at[part : part + step, None]
            a, b = place[rows + i].ravel(), place[rows + j].ravel()
            near = _near_sizes(names[a], names[b], percent)
            waiting.append(a[near] << U(32) | b[near])
            held += len(waiting[-1])
            if held >= max(PAIRS, len(keys)):
                keys, counts = count()
                held = 0
    keys, counts = count()
    return np.stack([names[keys >> U(32)], names[keys & U(0xFFFFFFFF)]], 1), counts


def _counted(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(pairs):
        return pairs, np.empty(0, np.int64)
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    first = np.flatnonzero(np.concatenate(([True], (pairs[1:] != pairs[:-1]).any(axis=1))))
    return pairs[first], np.diff(np.append(first, len(pairs)))


def _runs(percent: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """Of a bucket: kind 0, pairs of groups with the number of shingles they share
        in runs of FULL groups at most, and with 0 the tree over longer runs; kind 1,
        the longer runs (b is 1), and groups of several sets (b is 0); kind 2, each group's number of
        shingles in longer runs."""
        blobs = lambda name, kind: np.frombuffer(b"".join(x.as_py() for x in table.column(name)), kind)
        pairs, shared = np.empty((0, 2), U), np.empty(0, np.int64)
        long, times = np.empty(0, U), np.empty(0, np.int64)
        runs: dict[int, bytes] = {}
        lengthy = int(key[0].as_py() >= 0)

        def keep(ids: np.ndarray) -> None:
            runs[int(mix(mix(ids).sum(dtype=U, keepdims=True))[0].astype(np.int64))] = ids.tobytes()

        if key[0].as_py() < 0:  # groups of several sets
            m = blobs("groups", U).reshape(-1, 2)
            long, times = np.unique(m[m[:, 1] == TWICE, 0], return_counts=True)
            m = np.unique(m[m[:, 1] != TWICE], axis=0)
            for g in np.unique(m[1:, 0][m[1:, 0] == m[:-1, 0]]):
                keep(np.array([g], U))
        else:
            t, g = blobs("tokens", np.uint32), blobs("groups", U)
            order = np.lexsort((g, t))
            t, g = t[order], g[order]
            new = np.concatenate(([True], (t[1:] != t[:-1]) | (g[1:] != g[:-1]))) if len(t) else np.empty(0, bool)
            t, g = t[new], g[new]
            start = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1]))) if len(t) else np.empty(0, int)
            size = np.diff(np.append(start, len(t)))
            some = (size > 1) & (size <= FULL)
            pairs, shared = _all_pairs(g, start[some], size[some], percent)
            many = [g[i : i + k] for i, k in zip(start[size > FULL].tolist(), size[size > FULL].tolist(), strict=True)]
            for ids in many:
                keep(ids)
            long, times = np.unique(np.concatenate([*many, long]), return_counts=True)
            tree = [np.stack([a, b], 1)[_near_sizes(a, b, percent)] for ids in runs.values() for a, b in _tree_links(np.frombuffer(ids, U))]
            if tree:
                tree, _ = _counted(np.concatenate(tree))
                pairs, shared = np.concatenate([pairs, tree]), np.concatenate([shared, np.zeros(len(tree), np.int64)])
        parts = [(k, ids[i : i + 8192]) for k, ids in runs.items() for i in range(0, len(ids), 8192)]
        columns = [
            np.repeat(np.arange(3, dtype=np.int32), [len(pairs), len(parts), len(long)]),
            np.concatenate([pairs[:, 0].astype(np.int64), np.array([k for k, _ in parts], np.int64), long.astype(np.int64)]),
            np.concatenate([pairs[:, 1].astype(np.int64), np.full(len(parts), lengthy, np.int64), times]),
            np.concatenate([shared, np.zeros(len(parts) + len(long), np.int64)]),
            pa.array([*[None] * len(pairs), *[x for _, x in parts], *[None] * len(long)], pa.binary()),
        ]
        return pa.table([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], schema=_found)

    return run


def _enough_shared(found: DataFrame, percent: int) -> DataFrame:
    """Pairs of groups whose prefixes share enough for sets of their sizes. What two
    sets share beyond the end of the prefix that ends first is at most the rest of that
    set; so their prefixes share the needed overlap less the longer rest. Shingles in
    longer runs are not counted pair by pair: the lesser of both groups' number of
    those is added."""
    pairs = found.where("kind = 0").groupBy("a", "b").agg(F.sum("shared").alias("shared"))
    many = found.where("kind = 2").groupBy("a").agg(F.sum("b").alias("many"))
    both = pairs.join(many.withColumnRenamed("many", "ma"), "a", "left").join(many.select(F.col("a").alias("b"), F.col("many").alias("mb")), "b", "left")
    x, y = (F.col(c).bitwiseAND(F.lit(int(DONE))) for c in "ab")
    need = F.ceil((x + y) * percent / (100 + percent) - 1e-9) - F.ceil(F.greatest(x, y) * percent / 100 - 1e-9) + 1
    has = F.col("shared") + F.least(F.coalesce("ma", F.lit(0)), F.coalesce("mb", F.lit(0)))
    return both.where((has >= need) | (F.greatest(x, y) == int(DONE))).select("a", "b")


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for run, lengthy, ids in zip(batch.column("a"), batch.column("b"), batch.column("ids"), strict=True):
            g = np.frombuffer(ids.as_py(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), run.as_py(), np.int64)), pa.array(np.full(len(g), lengthy.as_py() == 1)), pa.array(g)], names=["run", "lengthy", "gid"])


# -- pass 4: the sets of candidate groups, verification --------------------------

_sets = pa.schema([("gid", pa.int64()), ("cls", pa.binary()), ("n", pa.int64()), ("shingles", pa.binary())])


def _candidate_sets(order, bitmap, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_order, bits = order.value, bitmap.value
        seen: set[bytes] = set()
        for batch in batches:
            rows, held = [], 0
            for _, s in shingle_sets(batch.column("text")):
                if not len(s) or (key := set_key(s)) in seen:
                    continue
                gid = _group_id(_ordered_prefix(s, held_order, percent), len(s))
                at = _bit(np.array([gid], U))[0]
                if bits[at >> 3] >> (at & 7) & 1:
                    if len(seen) < 1 << 17:
                        seen.add(key)
                    rows.append((np.uint64(gid).astype(np.int64), key, len(s), s.tobytes()))
                    held += len(s)
                if held > FLUSH:
                    yield _batch(rows)
                    rows, held = [], 0
            yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else ((),) * 4, _sets, strict=True)], schema=_sets)


def _bit(gid: np.ndarray) -> np.ndarray:
    return (mix(gid) % U(BITMAP)).astype(np.int64)


def _gather_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits: set[int] = set()
    for batch in batches:
        bits.update(_bit(batch.column("gid").to_numpy(zero_copy_only=False).view(U)).tolist())
    at = np.array(sorted(bits), np.int64)
    for page in np.unique(at >> 19):
        yield pa.RecordBatch.from_arrays([pa.array([page], pa.int32()), pa.array([(at[at >> 19 == page] & 0x7FFFF).astype(np.int32).tobytes()], pa.binary())], names=["page", "bits"])


def _bitmap(gids: DataFrame) -> np.ndarray:
    """A filter of BITMAP bits over the candidate groups: 16 MB at any input; as it
    fills, more documents pass it, and the join that follows drops those."""
    bits = np.zeros(BITMAP // 8, np.uint8)
    found = materialize(gids.mapInArrow(_gather_bits, "page int, bits binary"), "candidates")  # else a job for each partition
    for r in found.toLocalIterator():
        at = (r.page << 19) + np.frombuffer(bytes(r.bits), np.int32).astype(np.int64)
        np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return bits


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i in range(len(batch)):
                x, y = (np.frombuffer(batch.column(c)[i].as_py(), U) for c in ("xs", "ys"))
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            m = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(m), batch.column("b").filter(m)], names=["a", "b"])

    return run


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of set keys whose sets reach the similarity."""
    side = lambda key, out: sets.select(F.col("cls").alias(key), F.col("shingles").alias(out))
    both = pairs.join(side("b", "ys"), "b").join(side("a", "xs"), "a")
    return both.select("a", "b", "xs", "ys").mapInArrow(lean(_verify(percent)), "a binary, b binary")


def _in_rounds(pairs: DataFrame, sent: DataFrame, sets: DataFrame, links: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``links`` of ``pairs``, written a part of the pairs at a time: ``sent`` has the sizes n
    of the sets that the pairs send, and no part sends more than SENT bytes or twice the sets
    held, so that disk grows with the sets and not with the pairs."""
    total = lambda d: 8 * (d.agg(F.sum("n")).first()[0] or 0)
    rounds = -(-total(sent) // max(SENT, 2 * total(sets))) or 1
    part = F.pmod(F.xxhash64(*pairs.columns), F.lit(rounds))
    out = [materialize(links(pairs.where(part == i)), "linked") for i in range(rounds)]
    return reduce(DataFrame.union, out)


def _compare(percent: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """Links that join two roots, for all pairs across the key's two blocks: shared
        shingles are counted as a product of incidence matrices."""
        one, two = key[0].as_py(), key[1].as_py()
        block = table.column("block").to_pylist()
        sets = [np.frombuffer(x.as_py(), U) for x in table.column("shingles")]
        rows = [i for i, b in enumerate(block) if b == one]
        cols = rows if one == two else [i for i, b in enumerate(block) if b == two]
        size = np.array([len(s) for s in sets], np.int64)
        both = np.intersect1d(np.concatenate([sets[i] for i in rows]), np.concatenate([sets[i] for i in cols])) if rows and cols else np.empty(0, U)
        shared = np.zeros((len(rows), len(cols)), np.int64)
        for at in range(0, len(both), 1 << 14):  # memory stays bounded for long texts
            part = both[at : at + (1 << 14)]
            sides = []
            for side in [rows] if one == two else [rows, cols]:
                m = np.zeros((len(side), len(part)), np.float32)
                for r, i in enumerate(side):
                    _, _, where = np.intersect1d(sets[i], part, assume_unique=True, return_indices=True)
                    m[r, where] = 1
                sides.append(m)
            shared += np.rint(sides[0] @ sides[-1].T).astype(np.int64)
        union = size[rows][:, None] + size[cols][None, :] - shared
        root = [x.as_py() for x in table.column("root")]
        name = [x.as_py() for x in table.column("cls")]
        parent: dict[bytes, bytes] = {}

        def top(x: bytes) -> bytes:
            while (up := parent.get(x, x)) != x:
                parent[x] = x = parent.get(up, up)
            return x

        found = []
        for r, c in zip(*np.nonzero(100 * shared >= percent * union), strict=True):
            i, j = rows[r], cols[c]
            x, y = top(root[i]), top(root[j])
            if x != y:
                parent[max(x, y)] = min(x, y)
                found.append((name[i], name[j]))
        return pa.table({"a": pa.array([x for x, _ in found], pa.binary()), "b": pa.array([y for _, y in found], pa.binary())})

    return run


def _block_pairs(members: DataFrame, percent: int, block: int = 64) -> tuple[DataFrame, DataFrame]:
    """(homes, pairs): each set's block, and the pairs of blocks to compare, of the
    members (run, lengthy, cls, n, root, many) of runs.

    A member's home is its longest run, there the members with its root (or the small
    roots with one hash) and a size within half the ratio that links allow. Of blocks that
    meet in a run, pairs are left out whose sizes are too far apart, whose members all have
    one root, and, where they meet only in longer runs, whose prefixes have too few
    shingles in such runs (``many``, of the most) to share what their sizes ask for: the
    like of pages with one boilerplate and texts of their own. So rows grow with pairs of
    blocks and never with pairs of members."""
    size = members.groupBy("run").agg(F.count("*").alias("size"))
    homes = members.join(size, "run").groupBy("cls").agg(F.max(F.struct("size", "run")).alias("home"), F.first("root").alias("root"), F.first("n").alias("n"), F.max("many").alias("many"))
    band = F.floor(F.log(F.col("n")) * (2 / math.log(100 / percent))).cast("long")
    homes = homes.select("cls", "root", "n", "many", F.col("home.run").alias("run"), band.alias("band"))
    cell = homes.groupBy("run", "band", "root").agg(F.count("*").alias("own"))
    small = cell.where(F.col("own") < block).groupBy("run", "band").agg(F.sum("own").alias("rest"))
    cell = cell.join(small, ["run", "band"], "left")
    cut = F.when(F.col("own") < block, F.pmod(F.xxhash64("root"), F.ceil(F.col("rest") / block))).otherwise(F.xxhash64("root", F.pmod(F.xxhash64("cls"), F.ceil(F.col("own") / block))))
    homes = homes.join(cell, ["run", "band", "root"]).select("cls", "root", "n", "many", "band", F.xxhash64("run", "band", F.col("own") < block, cut).alias("block"))
    homes = materialize(homes, "homes")
    about = homes.groupBy("block").agg(F.min("band").alias("band"), F.min("root").alias("first"), F.max("root").alias("last"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("many").alias("many"))
    met = members.select("run", "lengthy", "cls").join(homes.select("cls", "block"), "cls").groupBy("run", "block").agg(F.min("lengthy").alias("lengthy")).join(about, "block")
    x, y = (met.select("run", F.struct(*met.columns).alias(c)) for c in "xy")
    i, j = F.col("x"), F.col("y")
    alone = (i["first"] == i["last"]) & (j["first"] == j["last"]) & (i["first"] == j["first"])
    need = (i["lo"] + j["lo"]) * (percent / (100 + percent)) - F.greatest(i["hi"], j["hi"]) * (percent / 100) - 1e-6
    near = (i["block"] <= j["block"]) & (F.abs(i["band"] - j["band"]) <= 2) & ~alone & (~(i["lengthy"] & j["lengthy"]) | (F.least(i["many"], j["many"]) >= need))
    pairs = x.join(y, "run").where(near).select(i["block"].alias("i"), j["block"].alias("j")).distinct()
    return homes, materialize(pairs, "blocks")


def _block_links(members: DataFrame, sets: DataFrame, percent: int, block: int = 64) -> DataFrame:
    """Links (a, b) enough to join all roots that any link joins, among the members of
    runs: the pairs of _block_pairs() are compared whole."""
    homes, pairs = _block_pairs(members, percent, block)
    ends = lambda d: d.withColumn("block", F.col("i")).union(d.where("i <> j").withColumn("block", F.col("j")))

    def links(part: DataFrame) -> DataFrame:
        sent = ends(part).join(homes.select("cls", "root", "block"), "block").join(sets.select("cls", "shingles"), "cls")
        return sent.select("i", "j", "block", "cls", "root", "shingles").groupBy("i", "j").applyInArrow(_compare(percent), "a binary, b binary")

    return _in_rounds(pairs, ends(pairs).join(homes.groupBy("block").agg(F.sum("n").alias("n")), "block"), sets, links)


def jaccard_components(docs: DataFrame, percent: int = 75, salts: int = 32) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text).

    Two documents link when 100 * |A and B| >= percent * |A or B| over their sets of
    distinct 5-word shingles, held as 64-bit hashes; component_id is the least doc_id
    that links reach. Sets are exact up to a collision of such hashes.

    1. One pass finds each document's set size and key, and a count sketch of fixed
       size. Documents with one set are one member from here on.
    2. The sketch gives the common order of shingles. A pass counts those of all prefixes;
       the ones found often go behind others of their level.
    3. Each distinct set sends the
       shingles of its prefix, packed, to the bucket of each; documents of one task
       with one prefix and size go as one group. A bucket lists the groups of each
       shingle: it counts the shared ones of every two groups in short runs, and takes
       a tree of pairs from long ones. Pairs that share too little for their sizes go.
    4. Groups in any pair or run are expanded to their members, whose sets are
       fetched in one more pass; pairs of members are verified on whole sets.
       Runs whose members are then still in several components are compared in
       full, block against block, so no two components that a link joins stay apart.
       Both go in rounds, each of which sends a bounded multiple of the sets held.
    Nothing gathered on the driver grows with the input: the sketch has 8 MB and the
    filters of common shingles and candidate groups 16 MB each at any size.

    A null or empty text has no shingles, links with nothing and is its own component;
    a text of one to four words has one shingle. Repeated rows give a row each, with
    the least doc_id among them; a null doc_id never becomes a component's id unless
    all of it are null. An empty table gives no rows. Other columns are not read."""
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _components(kept, percent, salts)


def row_components(docs: DataFrame, percent: int = 75, salts: int = 32) -> DataFrame:
    """(row, component) for every row of ``docs`` (doc_id, text) that was read from files:
    row is a struct that names it, (null id or not, doc_id, hash of its file's name, place in that file), and component
    the least row that links reach. Repeated ids, null ids and repeated rows are rows each."""
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))
    found = _components(docs.select(row.alias("doc_id"), F.col("text").cast("string").alias("text")), percent, salts)
    return found.select(F.col("doc_id").alias("row"), F.col("component_id").alias("component"))


def _components(docs: DataFrame, percent: int, salts: int) -> DataFrame:
    """jaccard_components() for a doc_id of any type with an order."""
    spark = docs.sparkSession
    bounded_batches(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    first = materialize(docs.mapInArrow(lean(_describe), f"kind int, doc_id {kind}, n long, cls binary, piece int, blob binary"), "sets", "kind")
    own = first.where("kind = 0").select("doc_id", "n", "cls")
    levels = _levels(first.where("kind = 1"))
    total = own.agg(F.sum("n")).first()[0] or 0
    tokens = total * (100 - percent) // 100
    buckets = int(max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), tokens // (1 << 20), 64))
    order = spark.sparkContext.broadcast((levels, None))
    often = _found_often(docs, order, buckets, percent)
    order.unpersist()
    order = spark.sparkContext.broadcast((levels, often))
    packed = docs.select("text").mapInArrow(lean(_postings(order, buckets, percent)), "bucket int, tokens binary, groups binary")
    found = materialize(packed.groupBy("bucket").applyInArrow(_runs(percent), "kind int, a long, b long, shared long, ids binary"), "runs", "kind")
    runs = materialize(found.where("kind = 1").groupBy("a", "ids").agg(F.min("b").alias("b")).mapInArrow(_unpack, "run long, lengthy boolean, gid long"), "members")
    near = materialize(_enough_shared(found, percent), "near")
    gids = near.select(F.explode(F.array("a", "b")).alias("gid")).union(runs.select("gid")).distinct()
    bitmap = spark.sparkContext.broadcast(_bitmap(gids))
    sets = docs.select("text").mapInArrow(lean(_candidate_sets(order, bitmap, percent)), "gid long, cls binary, n long, shingles binary")
    sets = materialize(sets.dropDuplicates(["cls"]).join(gids, "gid", "left_semi"), "shingles")
    order.unpersist()
    bitmap.unpersist()
    members = sets.select("gid", "cls", "n")

    rep = members.groupBy("gid").agg(F.min("cls").alias("rep"), F.count("*").alias("k"))
    across = near.join(rep.select(F.col("gid").alias("a"), F.col("rep").alias("ra")), "a").join(rep.select(F.col("gid").alias("b"), F.col("rep").alias("rb")), "b").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
    within = members.join(rep.where("k > 1").select("gid", "rep"), "gid").where("cls <> rep").select(F.col("rep").alias("a"), F.col("cls").alias("b"))
    tried = materialize(across.union(within).distinct(), "tried")
    links = _in_rounds(tried, tried.join(members.select(F.col("cls").alias("b"), "n"), "b"), sets, lambda part: verified(part, sets, percent))

    # what the trees left open: every pair across components, in pairs and runs of groups
    roots = components(links, salts)
    at = members.join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left").select("gid", "cls", "n", F.coalesce("root", "cls").alias("root"))
    open_pairs = near.join(rep.where("k > 1").select(F.col("gid").alias("a")), "a", "left_semi").union(near.join(rep.where("k > 1").select(F.col("gid").alias("b")), "b", "left_semi")).distinct()
    as_runs = open_pairs.select(F.xxhash64("a", "b").alias("run"), F.lit(False).alias("lengthy"), F.explode(F.array("a", "b")).alias("gid"))
    many = found.where("kind = 2").groupBy(F.col("a").alias("gid")).agg(F.sum("b").alias("many"))
    at = at.join(many, "gid", "left").withColumn("many", F.coalesce("many", F.lit(0)))
    placed = materialize(runs.union(as_runs).join(at, "gid"), "placed")
    several = placed.groupBy("run", "root").agg(F.lit(1).alias("one")).groupBy("run").agg(F.count("*").alias("k")).where("k > 1").select("run")
    left = materialize(placed.join(several, "run", "left_semi"), "open")
    links = links.union(_block_links(left, sets, percent))
    roots = components(links, salts)

    # documents of one set may be a third of all rows: minima by (set, salt) first
    salted = own.where("n > 0").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    part = salted.groupBy("cls", "salt").agg(F.min("doc_id").alias("least"))
    least = part.groupBy("cls").agg(F.min("least").alias("least")).join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = materialize(least, "least")
    whole = least.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("k"))
    alone = least.join(whole.where("k > 1").select("root", "component_id"), "root", "left").select("cls", F.coalesce("component_id", "least").alias("component_id"))
    named = part.select("cls", "salt").join(alone, "cls")
    linked = salted.join(named, ["cls", "salt"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return linked.union(own.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
