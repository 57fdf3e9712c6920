"""Benchmark decontamination with an Aho-Corasick automaton (operator 4)."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import beside, bounded_batches, extended, kept, lean, materialize

#: A-Z to a-z; every other ASCII character that is no letter or digit to a blank.
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """Lower-cased words, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def windows(text: str | None, width: int) -> Iterator[list[bytes]]:
    """All runs of ``width`` words; fewer words are one window, none are none."""
    w = words(text)
    for i in range(max(1, len(w) - width + 1) if w else 0):
        yield w[i : i + width]


UNSEEN = "\0"  # a word that is in no window


def _letter(i: int) -> str:
    """The i-th word's character: all but NUL and the surrogates."""
    return chr(i + 1 if i < 0xD7FF else i + 0x801)


MOST_WORDS = 0x10F7FF


def _automaton(patterns: list[tuple[str, tuple[str, ...]]]):
    import ahocorasick

    a = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for i, (p, _) in enumerate(patterns):
        a.add_word(p, i)
    a.make_automaton()
    return a


def _scan(block, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, letters, patterns = block.value
        automaton = kept(f"automaton-{name}", lambda: _automaton(patterns)) if patterns else None
        for batch in batches:
            names = batch.schema.names
            hits, items = (batch.column(c).to_pylist() for c in ("hit_words", "hit_items"))
            n_words = []
            for k, text in enumerate(batch.column("text")):  # one text's words are objects at a time
                w = words(text.as_py())
                n_words.append(len(w))
                found = list(automaton.iter("".join(map(letters.get, w, repeat(UNSEEN))))) if patterns and w else []
                if not found:
                    continue
                edge = np.zeros(len(w) + 1, np.int64)
                for end, p in found:
                    edge[end + 1 - len(patterns[p][0])] += 1
                    edge[end + 1] -= 1
                edge[hits[k] or []] += len(found)  # of an earlier block
                edge[[x + 1 for x in hits[k] or []]] -= len(found)
                hits[k] = np.flatnonzero(np.cumsum(edge)).tolist()
                items[k] = sorted({i for _, p in found for i in patterns[p][1]}.union(items[k] or ()))
            out = {"n_words": pa.array(n_words, pa.int64()), "hit_words": pa.array(hits, pa.list_(pa.int64())), "hit_items": pa.array(items, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([out.get(n, batch.column(n)) for n in names], names=names)

    return lean(run)


def _original_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Start and end, in code points of the original text, of each run of hit words."""
    for batch in batches:
        spans: list[list[dict]] = []
        for text, hit in zip(batch.column("text").to_pylist(), batch.column("hit_words").to_pylist(), strict=True):
            own: list[dict] = []
            if hit:
                raw = text.encode("utf-8", "surrogatepass")
                flat = np.frombuffer(raw.translate(_TABLE), np.uint8) != 32
                edge = np.diff(np.concatenate(([0], flat.view(np.int8), [0])))
                starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                points = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
                for w in hit:
                    if own and own[-1]["word"] == w - 1:
                        own[-1].update(word=w, end=int(points[ends[w]]))
                    else:
                        own.append({"word": w, "start": int(points[starts[w]]), "end": int(points[ends[w]])})
            spans.append([{"start": x["start"], "end": x["end"]} for x in own])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, kind)], names=[*batch.schema.names, "spans"])


def _blocks(benchmark: DataFrame, width: int, nodes: int) -> Iterator[tuple[str, dict[bytes, str], list[tuple[str, tuple[str, ...]]]]]:
    """(name, each word's character, windows with the ids of their items), in blocks
    whose automaton has about so many nodes at most."""
    rows = benchmark.where("text is not null").select(F.col("item_id").cast("string").alias("id"), F.col("text").cast("string").alias("text"))
    letters: dict[bytes, str] = {}
    block: dict[str, tuple[str, ...]] = {}
    size = 0

    def done() -> tuple[str, dict[bytes, str], list[tuple[str, tuple[str, ...]]]]:
        return uuid.uuid4().hex, letters, sorted(block.items())

    for r in rows.toLocalIterator():
        for w in windows(r.text, width):
            if block and (size >= nodes or len(letters) + len(w) > MOST_WORDS):
                yield done()
                letters, block, size = {}, {}, 0
            p = "".join([letters[x] if x in letters else letters.setdefault(x, _letter(len(letters))) for x in w])
            ids = block.get(p)
            if ids is None:
                size += len(p)
            if r.id is None or r.id in (ids or ()):
                block.setdefault(p, ())
            else:
                block[p] = (*(ids or ()), r.id)
    yield done()


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, width: int = 10, nodes: int = 1 << 22, spans: bool = False) -> DataFrame:
    """``docs`` with n_words, hit_words (the positions of hit words), hit_items (ids
    of items with a window in the text, as sorted strings) and, if asked for, spans
    (start, end in code points of the original text).

    All windows of ``width`` words of all items (an item with fewer words is one
    window) form one automaton, which each text passes once, in normal form. Its letters
    are words: each word of the benchmark has a character, all others share one, so a
    window of ten words takes ten nodes at most, whatever the words' lengths.

    Each worker holds the automaton, about 50 bytes a node. A benchmark with more than
    ``nodes`` of them (about 420,000 windows of ten words) would not fit, and is cut into
    several automata; the texts pass one after the other and what was found is written
    between, so one automaton is held at a time by the driver (two while one is
    being read), by executors and by workers. The result is the same.

    A null or empty text, or one without words, has no words and no hits; items that are
    null or empty are in no text; the words of an item without an id are hits, but it
    can't be listed; items that share a window are all
    found; an id that is repeated counts once. Repeated documents give a row each.
    Empty tables give no rows, or no hits. Columns of ``docs`` with the names of the
    results are replaced; other columns stay as they are."""
    spark = docs.sparkSession
    bounded_batches(spark)
    new = {"n_words": "long", "hit_words": "array<long>", "hit_items": "array<string>"}
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in {*new, "spans", "text"}], F.col("text").cast("string").alias("text"))
    out = rows.withColumns({c: F.lit(None).cast(t) for c, t in new.items()})
    blocks = _blocks(benchmark, width, nodes)
    block = next(blocks)
    while block:
        after = next(blocks, None)
        held = spark.sparkContext.broadcast(block)
        out = out.mapInArrow(_scan(held, width), out.schema)
        if after:
            out = materialize(out, "scanned")
            held.unpersist()
        block = after
    if spans:
        out = out.mapInArrow(lean(_original_spans), extended(out.schema, "spans array<struct<start:bigint,end:bigint>>"))
    return out


def digest(hits: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of benchmark_hits()."""
    items = F.coalesce("hit_items", F.array().cast("array<string>"))
    n_hit = F.coalesce(F.size("hit_words"), F.lit(0)).cast("long")
    return hits.select("doc_id", "n_words", F.when(F.col("hit_words").isNull(), 0).otherwise(n_hit).cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), F.col("hit_words").isNotNull().alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10, **more) -> DataFrame:
    """The rows of ``docs`` without a hit, with the columns of ``docs``."""
    return beside(docs, ["n_words", "hit_words", "hit_items", "spans"], lambda d: benchmark_hits(d, benchmark, width, **more).where("hit_words is null"))
