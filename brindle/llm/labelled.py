"""What the two label-trained scorers share: folds, training sample, scoring."""

from __future__ import annotations

import pickle

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.sample import smallest
from brindle.llm.subword import Model, Settings, fit
from brindle.llm.textbytes import relax, utf8_views

#: Texts of the training sample, at most.
TRAIN_ROWS = 3000


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the ids that no model learns from; null ids: false."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str, settings: Settings, rows: int = TRAIN_ROWS, none: float = 0.0) -> Model:
    """Fit ``label`` on at most ``rows`` labelled documents outside the held-out fold.

    The sample is that of the smallest hashes of doc_id among the labelled ids
    with a text, so it is the same on every run and for every partitioning.  An
    id gives one row: of several texts the smallest, of several labels the
    largest.  Rows without id, label or text are no training rows; texts are
    learnt from whole, however long.  One task reads the sample and fits, so
    that the driver gets the model and no text.  ``none`` is the logit of every
    text if there is no training row.  Ids are whole numbers.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("_y"))
    usable = docs.where(F.col("text").isNotNull()).select("doc_id", "text")
    picked = smallest(known.join(usable.select("doc_id").distinct(), "doc_id", "left_semi"), "doc_id", rows)
    # at most `rows` small rows: a proven bound for the broadcast, and for what the one task gets
    texts = usable.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.first("_y").alias("_y"), F.min("text").cast("binary").alias("text"))

    def learn(batches):
        held = []
        for batch in batches:
            held += zip(*(batch.column(c).to_pylist() for c in ("doc_id", "_y", "text")))
        if held:
            held.sort(key=lambda r: (hash_key(r[0]), r[0]))
            model = fit([r[2] for r in held], [r[1] for r in held], settings)
            held.clear()
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])
        relax()

    found = texts.select("doc_id", "_y", "text").repartition(1).mapInArrow(learn, "model binary").collect()
    if found:
        return pickle.loads(found[0]["model"])
    model = fit([], [], settings)
    model.bias = none
    return model


def hash_key(doc_id: int) -> int:
    """A fixed shuffle of ids, so that folds by position don't follow id order."""
    return (int(doc_id) * 0x9E3779B97F4A7C15 + 0x1234567) >> 7 & 0xFFFFFFFF


def score_documents(docs: DataFrame, model: Model, cut: float, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted for every row, plus the columns of ``keep``."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c in keep and c not in ("held_out", "score", "predicted")]
    source = docs.select("doc_id", "text", *[c for c in kept if c not in ("doc_id", "text")])
    extra = [c for c in kept if c != "doc_id"]
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *[docs.schema[c] for c in extra], T.StructField("score", T.DoubleType())])

    def score(batches):
        fitted = shared.value
        for batch in batches:
            value = fitted.scores(*utf8_views(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[batch.column(c) for c in extra], pa.array(value, pa.float64())],
                names=["doc_id", *extra, "score"],
            )

    scored = source.mapInArrow(score, schema)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"), *extra)
