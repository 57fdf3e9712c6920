"""Quality classifier: nearest-neighbour voting in a latent space (operator 2)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import bounded_batches, extended, fold, lean
from tessera.llm.shingles import _SPACE, U, mix, text_slices, word_hashes

WORDS, ENDS, SHAPES = 2048, 1024, 1024
STATS, LEVELS = 3, 12
WIDTH = WORDS + ENDS + SHAPES + STATS * LEVELS
STAT_COUNT = 2000  # such a level weighs as a word that often
_CLASS = np.zeros(256, np.uint64)
_CLASS[0x61:0x7B] = 1
_CLASS[0x41:0x5B] = 2
_CLASS[0x30:0x3A] = 3
_CLASS[0x80:] = 4
for _b in range(0x21, 0x7F):
    if not _CLASS[_b]:
        _CLASS[_b] = _b


def term_counts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, rows, row, term, count) of slices of texts. Terms are hashes of words, of
    words' last three bytes, and of words' shapes: classes of the first and the last
    three bytes; and levels of how much a text repeats itself: shares of words that follow
    themselves, of distinct words and of distinct runs of three words."""
    for first, data, offsets in text_slices(column):
        words, row = word_hashes(data, offsets)
        rows = len(offsets) - 1
        if not len(words):
            yield first, rows, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
            continue
        space = _SPACE[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[offsets] = True
        starts = np.flatnonzero(~space & (np.concatenate(([True], space[:-1])) | cut[:-1]))
        ends = np.flatnonzero(~space & (np.concatenate((space[1:], [True])) | cut[1:]))
        last = [np.maximum(ends - k, starts) for k in (0, 1, 2)]
        end = sum((data[x].astype(U) << U(8 * k) for k, x in enumerate(last)), U(0))
        shape = sum((_CLASS[data[x]] << U(8 * k) for k, x in enumerate([*last, starts])), U(0))
        terms = np.concatenate([words % U(WORDS), U(WORDS) + mix(end) % U(ENDS), U(WORDS + ENDS) + mix(shape + U(1)) % U(SHAPES)]).astype(np.int64)
        key, n = np.unique(np.tile(row, 3) * WIDTH + terms, return_counts=True)
        size = np.bincount(row, minlength=rows).astype(np.float64)
        same = np.bincount(row[1:][(words[1:] == words[:-1]) & (row[1:] == row[:-1])], minlength=rows)
        three = mix(words[:-2] + mix(words[1:-1] + mix(words[2:])))[row[:-2] == row[2:]] if len(words) > 2 else words[:0]
        of = row[:-2][row[:-2] == row[2:]] if len(words) > 2 else row[:0]
        distinct = [np.bincount(r[np.unique(h ^ mix(r.astype(U) + U(1)), return_index=True)[1]], minlength=rows) for h, r in ((words, row), (three, of))]
        shares = [same / np.maximum(size, 1), distinct[0] / np.maximum(size, 1), distinct[1] / np.maximum(size - 2, 1)]
        some = np.flatnonzero(size)
        level = [np.minimum(np.floor(np.minimum(s[some], 1) * LEVELS), LEVELS - 1).astype(np.int64) for s in shares]
        extra = np.concatenate([some * WIDTH + WORDS + ENDS + SHAPES + i * LEVELS + v for i, v in enumerate(level)])
        key, n = np.concatenate([key, extra]), np.concatenate([n, np.full(len(extra), STAT_COUNT)])
        order = np.argsort(key)
        yield first, rows, key[order] // WIDTH, key[order] % WIDTH, n[order].astype(np.float64)


def _collect_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        labels = batch.column("y").to_pylist()
        for first, rows, row, term, n in term_counts(batch.column("text")):
            at = np.searchsorted(row, np.arange(rows + 1))
            yield pa.RecordBatch.from_arrays([pa.array(labels[first : first + rows], pa.float64()), pa.array([term[at[i] : at[i + 1]].astype(np.int32) for i in range(rows)], pa.list_(pa.int32())), pa.array([n[at[i] : at[i + 1]].astype(np.int32) for i in range(rows)], pa.list_(pa.int32()))], names=["y", "term", "n"])


def _weighted(rows: int, row: np.ndarray, term: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of unit length of (1 + log count) * idf."""
    x = np.zeros((rows, WIDTH), np.float32)
    x[row, term] = (1 + np.log(n)) * idf[term] if len(n) else 0
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def fit(y: np.ndarray, terms: list[np.ndarray], counts: list[np.ndarray], rank: int = 48, seed: int = 7) -> dict:
    """The latent space of the labelled rows (a truncated singular value decomposition
    of their weighted terms) and their unit vectors in it."""
    n = len(y)
    row = np.repeat(np.arange(n), [len(t) for t in terms])
    term = np.concatenate([np.asarray(t, np.int64) for t in terms]) if n else np.empty(0, np.int64)
    count = np.concatenate([np.asarray(c, np.float64) for c in counts]) if n else np.empty(0)
    idf = np.log((1 + n) / (1 + np.bincount(term, minlength=WIDTH))) + 1
    x = _weighted(n, row, term, count, idf)
    rank = max(1, min(rank, n))
    basis = np.random.default_rng(seed).standard_normal((WIDTH, rank + 8)).astype(np.float32)
    for _ in range(4):  # subspace iteration
        basis, _ = np.linalg.qr(x.T @ (x @ basis)) if n else (basis, None)
    if n:
        small = x @ basis
        _, _, turn = np.linalg.svd(small, full_matrices=False)
        basis = basis @ turn[:rank].T
    v = x @ basis
    return {"idf": idf, "basis": np.ascontiguousarray(basis, np.float32), "vectors": v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12), "y": np.asarray(y, np.float64)}


def vote(model: dict, x: np.ndarray, neighbours: int = 25, power: float = 4.0, block: int = 256) -> np.ndarray:
    """Each row's score: the neighbours' labels weighted by a power of their cosine,
    which is computed for all labelled vectors, block by block. Rows with the cosine of
    the last place share the places left. One vote for
    the mean label is added, so that texts unlike any other get that."""
    y, vectors = model["y"], model["vectors"]
    mean = float(y.mean()) if len(y) else 0.5
    out = np.full(len(x), mean)
    if not len(y):
        return out
    k = min(neighbours, len(y))
    for i in range(0, len(x), block):
        v = x[i : i + block] @ model["basis"]
        cosine = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)) @ vectors.T
        cosine = np.round(cosine, 5)  # copies of a text score alike in any block
        last = -np.partition(-cosine, k - 1, axis=1)[:, k - 1 : k]
        row, near = np.nonzero(cosine >= last)
        tied = cosine[row, near] == last[row, 0]
        n_tied = np.bincount(row, tied, len(v))
        places = np.where(tied, ((k - np.bincount(row, ~tied, len(v))) / n_tied)[row], 1.0)
        w = places * np.maximum(cosine[row, near], 0).astype(np.float64) ** power
        out[i : i + block] = (np.bincount(row, w * y[near], len(v)) + 1e-3 * mean) / (np.bincount(row, w, len(v)) + 1e-3)
    return np.round(out, 6)


def held_out() -> Column:
    """True for the rows whose labels are not learned from. A row without an id has no
    remainder, so it is not held out; it has no label either."""
    return F.coalesce(F.pmod(fold(), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", class_docs: int = 1500, **more) -> dict:
    """A model from ``labels`` (doc_id, ``label`` 0 or 1), the rows to learn from, and
    the texts of ``docs``. About ``class_docs`` rows of each class, chosen by a hash of
    the id, are fetched and fitted; that bounds what is gathered and broadcast at any
    input. Contradicting labels of one id count as their mean. Null labels are ignored."""
    spark = docs.sparkSession
    y = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg(F.col(label).cast("double")).alias("y"))
    ones, n = y.agg(F.count_if(F.col("y") >= 0.5), F.count("*")).first()
    share = F.when(F.col("y") >= 0.5, min(1.0, class_docs / max(1, ones))).otherwise(min(1.0, class_docs / max(1, n - ones)))
    rows = y.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20)).collect()
    chosen = spark.createDataFrame([(r.doc_id, r.y) for r in rows], "doc_id long, y double")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text")
    found = texts.select("y", "text").mapInArrow(_collect_terms, "y double, term array<int>, n array<int>").toArrow()
    found = found.sort_by("y") if not found.num_rows else found
    term, count = found.column("term").to_pylist(), found.column("n").to_pylist()
    ys = found.column("y").to_pylist()
    order = sorted(range(len(ys)), key=lambda i: (ys[i], term[i], count[i]))  # no order of tasks shows in the model
    order = [i for i in order if term[i]]
    return fit(np.array([ys[i] for i in order]), [term[i] for i in order], [count[i] for i in order], **more)


def classify(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with score (0 to 1, higher: label 1 likelier) and predicted (score >= 0.5).

    Whole texts are read. A null or empty text is like nothing and gets the mean
    label of the learned rows; with no learned rows every score is 0.5. Repeated
    rows give a row each with the same score; an empty table none. Columns
    of ``docs`` named score or predicted are replaced."""
    spark = docs.sparkSession
    bounded_batches(spark)
    held = spark.sparkContext.broadcast(model)
    own = [c for c in docs.columns if c not in ("score", "predicted")]
    kept = docs.select(*[F.col(f"`{c}`").cast("string").alias(c) if c == "text" else F.col(f"`{c}`") for c in own])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            scores = np.zeros(len(batch))
            for first, rows, row, term, n in term_counts(batch.column("text")):
                at = np.searchsorted(row, np.arange(rows + 1))
                for i in range(0, rows, 512):  # memory of dense rows stays bounded
                    j = min(rows, i + 512)
                    p = slice(at[i], at[j])
                    scores[first + i : first + j] = vote(m, _weighted(j - i, row[p] - i, term[p], n[p], m["idf"]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], names=[*own, "score", "predicted"])

    return kept.mapInArrow(lean(run), extended(kept.schema, "score double, predicted int"))
