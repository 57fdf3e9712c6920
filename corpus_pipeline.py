"""From raw documents to token ids: five stages, each one of the operators in tessera.llm.

Each stage reads what its predecessor wrote and kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, jaccard_join, language_id, secrets, sentencepiece_codec
from tessera.llm.shared import beside, from_files, materialize, read, remove, scratch, written

#: Fixed value: mean log-likelihood a letter. The first 400 words of each document of sf0.01
#: have -2.4 at least, five tried strings (random letters, base64, scripts not learned)
#: -6.2 at most.
LEAST_LIKELIHOOD = -5.0


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, and those less likely than LEAST_LIKELIHOOD in every
    learned language. ``lang`` is what the model says. Learned from the labelled rows
    outside the held-out fold; if there is none, every document stays as it is."""
    model = language_id.train(docs.where(language_id.learnable()))
    if not model[0]:
        return docs
    kept = (F.col("lang_pred") != "und") & (F.col("likelihood") >= LEAST_LIKELIHOOD)
    return beside(docs, ["lang_pred", "score", "likelihood"], lambda d: language_id.identify(d, model).where(kept).withColumn("lang", F.col("lang_pred")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that links join, one row stays: the first one of the
    least id (an id before none). Rows are told apart by their place in the files, so
    repeated ids and ids that are null are rows of their own. Rows without words have no
    group and stay."""
    if not from_files(docs):
        docs = materialize(docs, "documents")
    with scratch(spark) as tables:  # what the join wrote goes before the documents are written
        found = jaccard_join.row_components(docs.select("doc_id", "text"))
        gone = materialize(found.where("row <> component").select(F.col("row.file").alias("_file"), F.col("row.place").alias("_place")), "copies")
        own = tables.pop()
    written(own)
    placed = docs.withColumns({"_file": F.xxhash64("_metadata.file_path"), "_place": F.col("_metadata.row_index")})
    return placed.join(gone, ["_file", "_place"], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item, or a whole
    shorter one, go."""
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays, its n_chars set anew."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*[F.col(f"`{c}`") for c in docs.columns])


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, input_ids, n_tokens, ids_sha256, parity, round_trip."""
    return sentencepiece_codec.encode(docs).select("doc_id", "lang", "source", "input_ids", "n_tokens", "ids_sha256", "parity", "round_trip")


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scans", redact_secrets),
    ("sentencepiece_encoding", encode_tokens),
]

#: SQL can't express the trained stages; the tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's table. What a stage wrote on its way goes when the stage is written, and a
    stage's table when the next one is."""
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch(spark) as tables:
            docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
            own = tables.pop()
        if before:
            remove(spark, before)
        before = own
    return docs
