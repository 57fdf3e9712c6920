"""Token counts as rollups that signed deltas maintain (operator 3)."""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import bounded_batches, extended, kept, lean, shared_dir

KEYS = ["source", "lang", "tokenizer"]
TOTALS = ["n_docs", "n_tokens"]
SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"

#: Fixed value: how byte-pair vocabularies of this family cut a text before they merge.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Tokenizer versions: rank files (base64 token, rank); the version is part of every rollup key.
TOKENIZERS = {"byte-bpe-50k": "/opt/tokenizers/byte_bpe_50k.tiktoken", "byte-bpe-multi-50k": "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"}


def count_words(text: Column) -> Column:
    """Version words-1: maximal runs of other than ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _encoding(ranks: bytes):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("counted", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def count_tokens(docs: DataFrame, tokenizers: dict[str, str] | None = None) -> DataFrame:
    """``docs`` without text: for every row and every version (name to rank file, which the
    driver reads) a row with tokenizer and n_tokens, of the whole text. A null or empty text
    has no tokens; columns of ``docs`` with those names are replaced. The ranks, under
    a MB a version, are broadcast; each worker builds them once."""
    spark = docs.sparkSession
    bounded_batches(spark)
    ranks = {}
    for name, path in (TOKENIZERS if tokenizers is None else tokenizers).items():
        with open(path, "rb") as f:
            ranks[name] = f.read()
    held = spark.sparkContext.broadcast((uuid.uuid4().hex, ranks))
    own = [c for c in docs.columns if c not in ("text", "tokenizer", "n_tokens")]
    rows = docs.select(*[F.col(f"`{c}`") for c in own], F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, all_ranks = held.value
        encodings = kept(f"ranks-{key}", lambda: {n: _encoding(r) for n, r in all_ranks.items()})
        for batch in batches:
            counts: dict[str, list[int]] = {n: [] for n in encodings}
            for t in batch.column("text"):
                text = (t.as_py() or "").encode("utf-8", "replace").decode()
                for n, e in encodings.items():
                    counts[n].append(len(e.encode_ordinary(text)))
            for n, c in counts.items():
                yield pa.RecordBatch.from_arrays([*[batch.column(x) for x in own], pa.array([n] * len(c), pa.string()), pa.array(c, pa.int64())], names=[*own, "tokenizer", "n_tokens"])

    return rows.mapInArrow(lean(run), extended(rows.drop("text").schema, "tokenizer string, n_tokens long"))


def inserts(counted: DataFrame) -> DataFrame:
    """Signed changes that add every row of ``counted`` (source, lang, tokenizer,
    n_tokens). Nulls in source or lang are keys of their own, a null count is 0, repeated
    rows count each; other columns are not read."""
    return counted.select(*[F.col(c).cast("string").alias(c) for c in KEYS], F.lit(1).cast("long").alias("n_docs"), F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)).alias("n_tokens"))


def deletes(added: DataFrame) -> DataFrame:
    """Changes that take back what ``added`` adds."""
    return added.select(*KEYS, *[(-F.col(c)).alias(c) for c in TOTALS])


def revisions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Changes from one count, source, language or tokenizer to another."""
    return deletes(before).unionByName(after.select(*KEYS, *TOTALS))


class TokenRollup:
    """Totals by source, language and tokenizer version, in a folder of the store.

    commit() adds up a batch's signed changes (combined before the shuffle, so a
    source with a third of all rows is a few rows) and publishes them under the batch's
    id with one rename. A batch whose id is there already, whether from a
    retry after lost executors or from a second writer, changes nothing. totals() sums the
    batches; compact() folds those it has listed into a snapshot that names them, so a
    replay stays without effect and a batch that is committed meanwhile is counted once.
    A compaction drops the folders that the one before it folded, so readers that
    opened totals() since then still find theirs. Texts are never read again for an update.

    Keys whose documents are all gone are not listed. An empty batch is committed and
    changes nothing."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _exists(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.path}/{name}"))

    def _list(self, name: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.path}/{name}"))) if self._exists(name) else []

    def _names(self, snapshot: str | None) -> DataFrame:
        """The ids of the batches that a snapshot holds."""
        if snapshot is None:
            return self.spark.createDataFrame([], "batch string")
        return self.spark.read.schema("batch string").parquet(f"{self.path}/snapshots/{snapshot}/batches")

    def _state(self) -> tuple[str | None, list[str], list[str]]:
        """The last snapshot, and the batches with a folder that it lacks and holds. No
        more ids are gathered than there are folders."""
        listed = self._list("batches")  # before the snapshot: none is missed
        last = (self._list("snapshots") or [None])[-1]
        folded = {r.batch for r in self._names(last).where(F.col("batch").isin(listed)).collect()} if last and listed else set()
        return last, [b for b in listed if b not in folded], sorted(folded)

    def _publish(self, trial: str, target: str) -> bool:
        """Rename a written folder; False, and the folder gone, if the target is there."""
        self._fs.mkdirs(self._path(f"{self.path}/{target}").getParent())
        there = self._path(f"{self.path}/{target}")
        if self._fs.exists(there) or not self._fs.rename(self._path(trial), there):
            self._fs.delete(self._path(trial), True)
            return False
        nested = f"{target}/{trial.rsplit('/', 1)[1]}"
        if self._exists(nested):  # a store that moves into a folder which another writer made meanwhile
            self._fs.delete(self._path(f"{self.path}/{nested}"), True)
            return False
        return True

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Whether the batch is new; else nothing is computed or written."""
        if not re.fullmatch(r"[\w.-]+", batch):
            raise ValueError("a batch id has letters, digits, full stops, hyphens and underscores")
        last = (self._list("snapshots") or [None])[-1]
        if self._exists(f"batches/{batch}") or not self._names(last).where(F.col("batch") == batch).isEmpty():
            return False
        trial = f"{self.path}/trials/{batch}-{uuid.uuid4().hex}"
        changes.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in TOTALS]).write.parquet(trial)
        return self._publish(trial, f"batches/{batch}")

    def _sum(self, snapshot: str | None, batches: list[str]) -> DataFrame:
        paths = ([f"{self.path}/snapshots/{snapshot}/totals"] if snapshot else []) + [f"{self.path}/batches/{b}" for b in batches]
        rows = self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)
        return rows.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in TOTALS])

    def totals(self) -> DataFrame:
        last, fresh, _ = self._state()
        return self._sum(last, fresh).where("n_docs <> 0 or n_tokens <> 0")

    def compact(self) -> bool:
        """Fold the committed batches into a snapshot. False if another compaction was
        first; then nothing changes."""
        last, fresh, folded = self._state()
        trial = f"{self.path}/trials/snapshot-{uuid.uuid4().hex}"
        self._sum(last, fresh).coalesce(1).write.parquet(f"{trial}/totals")
        self._names(last).union(self.spark.createDataFrame([(b,) for b in fresh], "batch string")).coalesce(1).write.parquet(f"{trial}/batches")
        if not self._publish(trial, f"snapshots/{int(last or 0) + 1:08d}"):
            return False
        for b in folded:
            self._fs.delete(self._path(f"{self.path}/batches/{b}"), True)
        return True


def open_rollup(spark: SparkSession, name: str) -> TokenRollup:
    return TokenRollup(spark, f"{shared_dir(spark)}/{name}")
