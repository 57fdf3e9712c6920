"""Language ID by unigram pieces summed over all segmentations (operator 7)."""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.sentencepiece_codec import NORMAL, SPACE, load_model, parse_model
from tessera.llm.shared import bounded_batches, extended, fold, kept, lean, materialize

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = 1e-7
LONG = 256  # letters from which a word is scored on its own, position by position
STRETCH = 24  # letters of a word that training takes at once
RESCALE = 8  # positions between two rescalings of the forward sums
CELLS = 1 << 20  # positions times languages that are held at once
CACHE = 1 << 17  # words whose sums a task keeps
WHOLE = 1 << 20  # expected counts are summed as whole numbers of this fraction


def vocabulary(model: bytes | None = None) -> list[str]:
    """Pieces of letters, lower case; the mark of a word's beginning counts as one."""
    texts = (t for t, _, kind in parse_model(load_model() if model is None else model)["pieces"] if kind == NORMAL)
    return sorted({t for t in texts if t == t.lower() and (t == SPACE or t.lstrip(SPACE).isalpha()) and SPACE not in t[1:]})


def words(text: str | None) -> list[str]:
    """Lower-cased runs of letters (Unicode's categories L)."""
    found = _WORD.findall((text or "").lower())
    if all(map(str.isalpha, found)):
        return found
    return [x for w in found for x in "".join(c if c.isalpha() else " " for c in w).split()]


class Lattice:
    """All segmentations of words into pieces of a vocabulary or single characters."""

    def __init__(self, pieces: list[str]):
        h = np.array([self._hash(p) for p in pieces], U)
        self.hash = np.append(h, U(0))  # the last one stands for no piece
        self.unknown = len(pieces)
        self.longest = max(map(len, pieces), default=1)
        self.power = np.cumprod(np.concatenate(([U(1)], np.full(self.longest, _BASE, U))))
        self.tables: list[tuple[int, np.ndarray]] = []
        left = np.unique(h, return_index=True)[1]
        while len(left):  # each table takes the pieces that are first in their slots
            bits = max(3, int(8 * len(left)).bit_length())
            _, first = np.unique(self._slot(h[left], len(self.tables), bits), return_index=True)
            table = np.full(1 << bits, -1, np.int32)
            table[self._slot(h[left[first]], len(self.tables), bits)] = left[first]
            self.tables.append((bits, table))
            left = np.delete(left, first)

    @staticmethod
    def _hash(piece: str) -> np.uint64:
        h = 0
        for c in piece:
            h = (h * int(_BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return U(h)

    @staticmethod
    def _slot(h: np.ndarray, turn: int, bits: int) -> np.ndarray:
        return (h * U((0xD1342543DE82EF95 + 0x5851F42D4C957F2E * turn) & 0xFFFFFFFFFFFFFFFF | 1)) >> U(64 - bits)

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """The piece with each hash, or -1."""
        found = np.full(h.shape, -1, np.int32)
        for turn, (bits, table) in enumerate(self.tables):
            at = table[self._slot(h, turn, bits)]
            found = np.where(self.hash[at] == h, at, found)
        return found

    def arcs(self, group: list[str]) -> tuple[np.ndarray, list[list[tuple[int, np.ndarray]]]]:
        """Lengths, and for each end the (start, piece of each word) of its arcs. A
        single character without a piece has the piece ``unknown``, nothing else -1."""
        n = max(map(len, group))
        chars = np.array(group, dtype=f"U{n}").view(np.uint32).reshape(len(group), n)
        chars = np.concatenate([np.full((len(group), 1), ord(SPACE), np.uint32), chars], axis=1)
        length = (chars > 0).sum(axis=1)
        total = np.zeros((n + 2, len(group)), U)
        for i in range(n + 1):
            total[i + 1] = total[i] * _BASE + chars[:, i].astype(U) + U(1)
        out: list[list[tuple[int, np.ndarray]]] = [[] for _ in range(n + 1)]
        for size in range(1, min(n + 1, self.longest) + 1):
            found = self.lookup(total[size:] - total[:-size] * self.power[size])
            if size == 1:
                found[found < 0] = self.unknown
            for start in np.flatnonzero((found >= 0).any(axis=1)).tolist():
                out[start + size - 1].append((start, found[start]))
        return length, out

    def forward(self, group: list[str], p: np.ndarray) -> np.ndarray:
        """log of the sum over all segmentations of each word, for each column of p
        (pieces and the unknown one, by languages). Sums are rescaled on the way, so
        words of any length have one."""
        length, arcs = self.arcs(group)
        p = np.concatenate([p, np.zeros((1, p.shape[1]))])  # piece -1
        a = np.zeros((len(arcs) + 1, len(group), p.shape[1]))
        a[0] = 1
        scale = np.zeros(a.shape[1:])
        out = np.empty(a.shape[1:])
        for end, own in enumerate(arcs, 1):
            for start, piece in own:
                a[end] += a[start] * p[piece]
            ready = length == end
            if ready.any():
                out[ready] = np.log(a[end, ready]) + scale[ready]
            if end % RESCALE == 0 and end < len(arcs):
                near = a[max(0, end + 1 - self.longest) : end + 1]
                top = near.max(axis=0)
                top[top == 0] = 1  # beyond a shorter word's end
                near /= top
                scale += np.log(top)
        return out

    def forward_long(self, word: str, p: np.ndarray, block: int = 1 << 16) -> np.ndarray:
        """forward() of one long word, in blocks of positions and linear time."""
        p = np.concatenate([p, np.zeros((1, p.shape[1]))])
        n, text = self.longest, SPACE + word
        scale = np.zeros(p.shape[1])
        tail = np.zeros((n, p.shape[1]))  # sums at the last n positions
        tail[-1] = 1
        for at in range(0, len(text), block):
            part = text[max(0, at - n + 1) : at + block]
            skip = at - max(0, at - n + 1)
            chars = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32).astype(U)
            found = np.full((len(part) + 1, n + 1), -1, np.int32)
            h = np.zeros(len(part) + 1, U)  # of the substring of each size that ends here
            for size in range(1, min(n, len(part)) + 1):
                h[size:] = h[size - 1 : -1] * _BASE + chars[size - 1 :] + U(1)
                found[size:, size] = self.lookup(h[size:])
            found[1:, 1][found[1:, 1] < 0] = self.unknown
            a = np.concatenate([tail, np.zeros((len(part) - skip, p.shape[1]))])
            for i in range(n, len(a)):
                own = found[i - n + 1 + skip]
                sizes = np.flatnonzero(own >= 0)
                a[i] = (a[i - sizes] * p[own[sizes]]).sum(axis=0)
                if i % RESCALE == 0:
                    near = a[i + 1 - n : i + 1]
                    top = near.max(axis=0)
                    near /= top
                    scale += np.log(top)
            tail = a[-n:]
        return np.log(tail[-1]) + scale

    def expected(self, group: list[str], p: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected counts of each piece, and the unknown one, in weighted words of
        STRETCH letters at most."""
        length, arcs = self.arcs(group)
        p = np.append(p, 0.0)
        a = np.zeros((len(arcs) + 1, len(group)))
        a[0] = 1
        for end, own in enumerate(arcs, 1):
            for start, piece in own:
                a[end] += a[start] * p[piece]
        b = np.zeros_like(a)
        at = np.arange(len(group))
        b[length, at] = weight / a[length, at]
        met, share = [], []
        for end in range(len(arcs), 0, -1):
            for start, piece in arcs[end - 1]:
                some = np.flatnonzero(piece >= 0)
                reach = b[end, some] * p[piece[some]]
                b[start, some] += reach
                met.append(piece[some])
                share.append(a[start, some] * reach)
        return np.bincount(np.concatenate(met), np.concatenate(share), len(p) - 1)


def _groups(distinct: list[str], cells: int) -> Iterator[np.ndarray]:
    """Positions of words of much the same length, about ``cells`` letters at once."""
    size = np.array([len(w) + 1 for w in distinct], np.int64)
    order = np.argsort(size, kind="stable")
    at = 0
    while at < len(order):
        most = min(len(order) - at, max(1, cells // int(size[order[at]])))
        while most > 1 and most * int(size[order[at + most - 1]]) > 2 * cells:
            most = max(1, most // 2)
        yield order[at : at + most]
        at += most


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: dict[tuple[str, str], int] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            for w in words(text.as_py()):
                for x in [w] if len(w) <= STRETCH else [w[i : i + STRETCH] for i in range(0, len(w), STRETCH)]:
                    found[lang, x] = found.get((lang, x), 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=["lang", "word", "n"])


def _expect(held):
    """Expected counts of pieces over a task's words, in whole numbers of 1 / WHOLE, so
    that their sum is the same in any order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, langs, p, pieces = held.value
        lattice = kept(f"lattice-{name}", lambda: Lattice(pieces))
        for batch in batches:
            lang, word, n = (batch.column(c).to_pylist() for c in ("lang", "word", "n"))
            total = np.zeros(p.shape)
            by_lang = defaultdict(list)
            for i, x in enumerate(lang):
                by_lang[x].append(i)
            for k, x in enumerate(langs):
                rows = by_lang[x]
                own = [word[i] for i in rows]
                for g in _groups(own, CELLS // 8):
                    total[:, k] += lattice.expected([own[i] for i in g], p[:, k], np.array([n[rows[i]] for i in g], float))
            piece, k = np.nonzero(total)
            value = np.rint(total[piece, k] * WHOLE).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(piece, pa.int32()), pa.array(value)], names=["k", "piece", "value"])

    return run


def fit(counted: DataFrame, langs: list[str], pieces: list[str], rounds: int = 4) -> np.ndarray:
    """Each piece's probability in each language, by expectation maximisation over the
    words (lang, word, n). Each round is one job over them; what comes back has a row for
    each piece and language."""
    spark = counted.sparkSession
    p = np.full((len(pieces) + 1, len(langs)), 1.0 / (len(pieces) + 1))
    p[-1] = UNKNOWN
    name = uuid.uuid4().hex
    for _ in range(rounds):
        held = spark.sparkContext.broadcast((name, langs, p, pieces))
        sums = counted.mapInArrow(lean(_expect(held)), "k int, piece int, value long").groupBy("k", "piece").agg(F.sum("value").alias("value")).toArrow()
        held.unpersist()
        total = np.zeros_like(p)
        total[sums.column("piece").to_numpy(), sums.column("k").to_numpy()] = sums.column("value").to_numpy() / WHOLE
        total[:-1] += 0.01
        p = total / total[:-1].sum(axis=0)
        p[-1] = UNKNOWN
    return p


def train(docs: DataFrame, pieces: list[str] | None = None, lang_docs: int = 2000, rounds: int = 4) -> tuple[list[str], np.ndarray, list[str]]:
    """A model from ``docs`` (doc_id, text, lang), the labelled rows to learn from: all
    words of about ``lang_docs`` documents of each language, chosen by a hash of id and text.
    That bound holds at any input. Words of more than STRETCH letters are learned from in
    stretches of so many; none is left out."""
    pieces = vocabulary() if pieces is None else pieces
    docs = docs.where("lang is not null and text is not null").select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    sizes = {r.lang: r["count"] for r in docs.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return langs, np.zeros((len(pieces) + 1, 0)), pieces
    bounded_batches(docs.sparkSession)
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, lang_docs / n))])
    chosen = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < F.element_at(share, F.col("lang")) * (1 << 20))
    counted = chosen.select("lang", "text").mapInArrow(lean(_count_words), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return langs, fit(materialize(counted, "words").repartition(parts, "lang", "word"), langs, pieces, rounds), pieces


class _Scorer:
    """Sums of words in each language, kept for a task's next batches."""

    def __init__(self, lattice: Lattice, p: np.ndarray):
        self.lattice, self.p = lattice, p
        self.known: defaultdict[str, int] = defaultdict()
        self._forget()

    def _forget(self) -> None:
        self.known.clear()
        self.known.default_factory = self.known.__len__
        self.sums = np.empty((0, self.p.shape[1]))
        self.letters = np.empty(0)

    def codes(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Number of words of each text, and the position in ``sums`` of every word. Only
        one text's words are objects at a time."""
        if len(self.known) > CACHE:
            self._forget()
        parts = []
        for t in column:
            own = words(t.as_py())
            parts.append(np.fromiter(map(self.known.__getitem__, own), np.int32, len(own)))
        new = list(self.known)[len(self.sums) :]
        sums = np.empty((len(new), self.p.shape[1]))
        short = [i for i, w in enumerate(new) if len(w) < LONG]
        for g in _groups([new[i] for i in short], CELLS // max(8, self.p.shape[1])):
            at = [short[i] for i in g]
            sums[at] = self.lattice.forward([new[i] for i in at], self.p)
        for i, w in enumerate(new):
            if len(w) >= LONG:
                sums[i] = self.lattice.forward_long(w, self.p)
        self.sums = np.concatenate([self.sums, sums])
        self.letters = np.concatenate([self.letters, [len(w) + 1.0 for w in new]])
        return np.array([len(x) for x in parts], np.int64), np.concatenate(parts) if parts else np.empty(0, np.int32)


def _text_sums(value: np.ndarray, code: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each text the sum of its words' rows, of which some are held at once."""
    out = np.zeros((len(sizes), value.shape[1]))
    row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    step = max(1, CELLS // max(1, value.shape[1]))
    for i in range(0, len(code), step):
        r = row[i : i + step]
        first = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
        out[r[first]] += np.add.reduceat(value[code[i : i + step]], first, axis=0)
    return out


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray, list[str]]) -> DataFrame:
    """``docs`` with lang_pred, score and likelihood.

    A text's likelihood in a language is the product over its words of the sum over all
    segmentations of the word's pieces (a forward pass, in batches of distinct words).
    score is the posterior of lang_pred among the learned languages, all alike before,
    with the log-likelihood divided by the root of the number of words. Ties go to the
    lesser name. likelihood is the mean log-likelihood, in lang_pred, of a letter or a
    word's beginning. The model (pieces by languages) is broadcast; the vocabulary bounds it.

    A null or empty text, or one without a letter, is ``und`` with score and likelihood 0; so is every
    text if no language was learned. Words may have any length. Repeated rows give a row each; an empty
    table none. Columns of ``docs`` named lang_pred, score or likelihood are replaced."""
    spark = docs.sparkSession
    bounded_batches(spark)
    held = spark.sparkContext.broadcast((uuid.uuid4().hex, *model))
    own = [c for c in docs.columns if c not in ("lang_pred", "score", "likelihood")]
    rows = docs.select(*[F.col(f"`{c}`").cast("string").alias(c) if c == "text" else F.col(f"`{c}`") for c in own])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, langs, p, pieces = held.value
        scorer = _Scorer(kept(f"lattice-{name}", lambda: Lattice(pieces)), p)
        for batch in batches:
            preds, scores, likely = ["und"] * len(batch), np.zeros(len(batch)), np.zeros(len(batch))
            if langs:
                sizes, code = scorer.codes(batch.column("text"))
                full = np.flatnonzero(sizes)
                sums = _text_sums(scorer.sums, code, sizes)[full]
                each = sums / _text_sums(scorer.letters[:, None], code, sizes)[full]
                sums /= np.sqrt(sizes[full])[:, None]
                top = sums.argmax(axis=1)
                scores[full] = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1) if len(full) else 0
                likely[full] = each[np.arange(len(full)), top]
                for i, k in zip(full.tolist(), top.tolist(), strict=True):
                    preds[i] = langs[k]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(preds, pa.string()), pa.array(np.round(scores, 9)), pa.array(np.round(likely, 9))], names=[*own, "lang_pred", "score", "likelihood"])

    return rows.mapInArrow(lean(run), extended(rows.schema, "lang_pred string, score double, likelihood double"))


def held_out() -> Column:
    """True for the rows that language models are not learned from. A row without an id
    has no remainder, so it is not held out; learnable() leaves it out all the same."""
    return F.coalesce(F.pmod(fold(), F.lit(5)) == 0, F.lit(False))


def learnable() -> Column:
    return F.coalesce(F.pmod(fold(), F.lit(5)) != 0, F.lit(False))
