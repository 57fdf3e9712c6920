"""SentencePiece encoding and decoding on the tokenizers library (operator 10)."""

from __future__ import annotations

import hashlib
import os
import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import bounded_batches, extended, kept, lean

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
SLICE = 1 << 20
STEP = 1 << 14
PART = 256  # chunks in one string


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protobuf message."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[i] & 127) << shift
            shift += 7
            i += 1
            if data[i - 1] < 128:
                return value, i

    i = 0
    while i < len(data):
        key, i = varint(i)
        if key & 7 == 0:
            value, i = varint(i)
        else:
            size, i = (8, i) if key & 7 == 1 else (4, i) if key & 7 == 5 else varint(i)
            value = data[i : i + size]
            i += size
        yield key >> 3, value


def parse_model(data: bytes) -> dict:
    """Pieces (text, score, type) and settings of a model's protobuf."""
    pieces = []
    model = {"type": UNIGRAM, "byte_fallback": False, "charsmap": b"", "dummy_prefix": True, "single_blanks": True, "escape": True, "unk_id": 0, "suffix": False}
    for number, value in _fields(data):
        if number == 1:
            text, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    text = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            pieces.append((text, score, kind))
        elif number == 2:
            for n, v in _fields(value):
                name = {3: "type", 35: "byte_fallback", 40: "unk_id", 24: "suffix"}.get(n)
                if name:
                    model[name] = v
        elif number == 3:
            for n, v in _fields(value):
                name = {2: "charsmap", 3: "dummy_prefix", 4: "single_blanks", 5: "escape"}.get(n)
                if name:
                    model[name] = v
    return model | {"pieces": pieces}


class Codec:
    """A tokenizer rebuilt from a SentencePiece model, with the original beside it.

    No piece holds the blank's mark behind another character, so a text's ids are those
    of its chunks, each some marks and what follows up to the next mark. Distinct chunks
    are put together to strings of PART chunks, which the rebuilt tokenizer, with the mark
    as its pre-tokenizer's cut, encodes in a batch and decodes again. Whole
    texts are encoded by the original library too; where the ids differ the original's stand.

    Chunks are kept for two generations of ``cache`` each, so that frequent ones stay.
    Most are seen once, and a worker outlives its task, so the cache is small: tens of MB."""

    def __init__(self, data: bytes, cache: int = 1 << 17):
        import sentencepiece
        from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

        m = parse_model(data)
        if m["type"] not in (UNIGRAM, BPE) or m["suffix"] or not m["escape"]:
            raise ValueError("only unigram and BPE models with the mark before words")
        texts = [t for t, _, _ in m["pieces"]]
        if any(SPACE in t.lstrip(SPACE) for t, _, kind in m["pieces"] if kind in (NORMAL, USER)):
            raise ValueError("a piece crosses words")
        ids = {t: i for i, t in enumerate(texts)}
        if m["type"] == UNIGRAM:
            model = models.Unigram([(t, s) for t, s, _ in m["pieces"]], unk_id=m["unk_id"], byte_fallback=bool(m["byte_fallback"]))
        else:
            usable = {t: (s, i) for i, (t, s, kind) in enumerate(m["pieces"]) if kind in (NORMAL, USER)}
            merges = []
            for t, (s, i) in usable.items():
                merges += [(-s, i, k, (t[:k], t[k:])) for k in range(1, len(t)) if t[:k] in usable and t[k:] in usable]
            merges.sort(key=lambda x: x[:3])
            model = models.BPE(vocab=ids, merges=[x[3] for x in merges], unk_token=texts[m["unk_id"]], fuse_unk=True, byte_fallback=bool(m["byte_fallback"]))
        self.tokenizer = Tokenizer(model)
        self.tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{SPACE}+[^{SPACE}]*"), "isolated")
        self.tokenizer.decoder = decoders.Sequence([decoders.Replace(SPACE, " "), decoders.ByteFallback(), decoders.Fuse(), decoders.Strip(" ", 1, 0)])
        before = [normalizers.Precompiled(m["charsmap"])] if m["charsmap"] else []
        if m["single_blanks"]:
            before += [normalizers.Replace(Regex(f"[ {SPACE}]+"), " "), normalizers.Strip()]
        self.before = normalizers.Sequence(before) if before else None
        if not m["dummy_prefix"]:
            raise ValueError("only models that put a mark before a text")
        self.original = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.is_byte = np.array([kind == BYTE for _, _, kind in m["pieces"]])
        self.marked = np.array([t.startswith(SPACE) for t in texts])
        self.size = cache
        self._forget()

    def chunks(self, text: str) -> list[str]:
        """The chunks of a text, each without its first mark."""
        if self.before is not None:
            text = self.before.normalize_str(text)
        if not text:
            return []
        if "  " not in text and SPACE not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        return [c[1:] for c in re.findall(f"{SPACE}+[^{SPACE}]*", SPACE + text.replace(" ", SPACE))]

    def _tokens(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of chunks, the number of each one's ids, and whether they decode to it."""
        plain = all(c and SPACE not in c for c in chunks)
        parts = [chunks[i : i + PART] for i in range(0, len(chunks), PART)] if plain else [[c] for c in chunks]
        found = [e.ids for e in self.tokenizer.encode_batch_fast([SPACE + SPACE.join(p) for p in parts], add_special_tokens=False)]
        back = self.tokenizer.decode_batch(found, skip_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(found), np.int32)
        good = np.array([b == " ".join(p) for b, p in zip(back, parts, strict=True)], bool)
        if not plain:
            good = np.array([b == c.replace(SPACE, " ") for b, c in zip(back, chunks, strict=True)], bool)
            return ids, np.array([len(i) for i in found], np.int32), good
        first = np.flatnonzero(self.marked[ids])
        if len(first) != len(chunks) or first[0] or (not good.all() and len(chunks) > 1):
            each = [self._tokens([c]) for c in chunks] if len(chunks) > 1 else [(ids, np.array([len(ids)], np.int32), good)]
            return tuple(np.concatenate(x) for x in zip(*each, strict=True))
        return ids, np.diff(np.append(first, len(ids))).astype(np.int32), np.repeat(good, [len(p) for p in parts])

    def _learn(self, chunks: list[str]) -> None:
        at = len(self.sizes)
        odd = [c for c in chunks if not c or SPACE in c]
        chunks = [*[c for c in chunks if c and SPACE not in c], *odd]
        got = [self._tokens(part) for part in (chunks[: len(chunks) - len(odd)], odd) if part]
        ids, sizes, good = (np.concatenate(x) for x in zip(*got, strict=True))
        self.known.update(zip(chunks, range(at, at + len(chunks)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(sizes, dtype=np.int64) - sizes])
        self.sizes, self.whole = np.concatenate([self.sizes, sizes]), np.concatenate([self.whole, good])
        self.pool = np.concatenate([self.pool, ids])

    def _forget(self) -> None:
        """What is kept of chunks holds for the decoder that they were tried with."""
        self.decoder = self.tokenizer.decoder.__getstate__()
        self.pool, self.starts, self.sizes, self.whole = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, bool)
        self.known: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def _next_generation(self) -> None:
        """Forget the chunks that were not met since the last generation began."""
        places = np.fromiter(self.known.values(), np.int64, len(self.known))
        self.older = dict(zip(self.known, range(len(places)), strict=True))
        self.known = {}
        sizes = self.sizes[places]
        ends = np.cumsum(sizes, dtype=np.int64)
        index = np.arange(int(sizes.sum())) + np.repeat(self.starts[places] - (ends - sizes), sizes)
        self.pool, self.starts, self.sizes, self.whole = self.pool[index], ends - sizes, sizes, self.whole[places]

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, bool, bool]]:
        """(ids, parity, round trip) of each text; a null is an empty text. Texts are taken
        in slices of SLICE characters (a longer text alone), which bounds what is held."""
        out, first, size = [], 0, 0
        for i, t in enumerate(texts):
            size += len(t or "")
            if size >= SLICE or i + 1 == len(texts):
                out += self._encode(texts[first : i + 1])
                first, size = i + 1, 0
        return out

    def _encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, bool, bool]]:
        per_text = [self.chunks(t or "") for t in texts]
        lengths = [len(x) for x in per_text]
        same = [" ".join(x).replace(SPACE, " ") == (t or "") for t, x in zip(texts, per_text, strict=True)]
        flat = list(chain.from_iterable(per_text))
        del per_text
        if self.tokenizer.decoder.__getstate__() != self.decoder:
            self._forget()
        elif len(self.known) > self.size:
            self._next_generation()
        known, older = self.known, self.older
        new = set(flat) - known.keys()
        met = new & older.keys()
        known.update(zip(met, map(older.__getitem__, met), strict=True))
        fresh = sorted(new - met)
        for i in range(0, len(fresh), STEP):
            self._learn(fresh[i : i + STEP])
        place = np.array(list(map(known.__getitem__, flat)), np.int64)
        del flat
        originals = self.original.encode([t or "" for t in texts], num_threads=1)
        out, at = [], 0
        for t, k, s, theirs in zip(texts, lengths, same, originals, strict=True):
            c = place[at : at + k]
            at += k
            n = self.sizes[c]
            ends = np.cumsum(n, dtype=np.int64)
            own = self.pool[np.arange(int(ends[-1]) if k else 0) + np.repeat(self.starts[c] - (ends - n), n)]
            theirs = np.array(theirs, np.int32)
            parity = np.array_equal(own, theirs)
            back = s and bool(self.whole[c].all()) if parity else self.decode([theirs.tolist()])[0] == (t or "")
            out.append((own if parity else theirs, parity, back))
        return out

    def decode(self, ids: list[list[int] | None]) -> list[str]:
        return self.tokenizer.decode_batch([list(i or ()) for i in ids], skip_special_tokens=False)


def _codec(data: bytes) -> Codec:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; the library's threads cost more than they save
    return kept(f"codec-{hashlib.sha256(data).hexdigest()}", lambda: Codec(data))


def load_model(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model: bytes | None = None, ids: bool = True) -> DataFrame:
    """``docs`` without text, with input_ids (if asked for), n_tokens, n_byte_pieces,
    ids_sha256 (of the ids as little-endian int32), parity and round_trip.

    The model (some hundred KB; a file of the driver's, by parameter) is broadcast, and
    each worker rebuilds it once. The ids are the tokenizers library's; parity: they are
    the original's of the whole text, whose ids stand where not (rows with a false parity
    count those). round_trip: the tokenizers library decodes the ids to the text again; not
    so where a text holds the mark U+2581 itself, which stands for a blank.

    A null or empty text has no tokens. Repeated rows give a row each; an empty table
    gives none. Columns of ``docs`` with the names of the results are replaced."""
    spark = docs.sparkSession
    bounded_batches(spark)
    held = spark.sparkContext.broadcast(load_model() if model is None else model)
    new = {"input_ids": "array<int>", "n_tokens": "long", "n_byte_pieces": "long", "ids_sha256": "string", "parity": "boolean", "round_trip": "boolean"}
    if not ids:
        del new["input_ids"]
    own = [c for c in docs.columns if c not in new and c != "text"]
    rows = docs.select(*[F.col(f"`{c}`") for c in own], F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(held.value)
        for batch in batches:
            found: dict[str, list] = {c: [] for c in new}
            text = batch.column("text").to_pylist()
            for t, (i, parity, back) in zip(text, codec.encode(text), strict=True):
                if ids:
                    found["input_ids"].append(i)
                found["n_tokens"].append(len(i))
                found["n_byte_pieces"].append(int(codec.is_byte[i].sum()))
                found["ids_sha256"].append(hashlib.sha256(i.astype("<i4").tobytes()).hexdigest())
                found["parity"].append(parity)
                found["round_trip"].append(back)
            kinds = {"input_ids": pa.list_(pa.int32()), "n_tokens": pa.int64(), "n_byte_pieces": pa.int64(), "ids_sha256": pa.string(), "parity": pa.bool_(), "round_trip": pa.bool_()}
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in own], *[pa.array(found[c], kinds[c]) for c in new]], names=[*own, *new])

    return rows.mapInArrow(lean(run), extended(rows.drop("text").schema, ", ".join(f"{c} {t}" for c, t in new.items())))


def decode(encoded: DataFrame, model: bytes | None = None) -> DataFrame:
    """``encoded`` with text in the place of input_ids; no ids give an empty text."""
    held = encoded.sparkSession.sparkContext.broadcast(load_model() if model is None else model)
    own = [c for c in encoded.columns if c not in ("input_ids", "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(held.value)
        for batch in batches:
            text = codec.decode(batch.column("input_ids").to_pylist())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in own], pa.array(text, pa.string())], names=[*own, "text"])

    rows = encoded.select(*[F.col(f"`{c}`") for c in own], "input_ids")
    return rows.mapInArrow(lean(run), extended(rows.drop("input_ids").schema, "text string"))
