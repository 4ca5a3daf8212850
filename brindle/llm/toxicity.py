"""Toxicity: subword-bag embeddings averaged into a linear softmax.

Bags are windows of 48 words, so that a few insults in a long text are not
averaged away; the score of a text is that of its most toxic window, and a
text of very many windows teaches as much as one of a few.  Unseen
misspellings share character n-gram vectors with the words they come from.

Edge cases: null or empty texts have no window and get the score of no
evidence; null ids are scored and never held out; repeated rows are scored
alike; empty tables give empty results; columns beyond doc_id and text are not
read.  Without any labelled text to learn from every score is below 0.5, so that
nothing is taken for toxic.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from brindle.llm.labelled import TRAIN_ROWS, score_documents, train
from brindle.llm.subword import Model, Settings
from brindle.llm.textbytes import relax, utf8_views

#: Chosen inside of the training fold: see ``choose_settings``.
SETTINGS = Settings(keep="word", lower=True, window_words=48, epochs=10, target=0.5, least_texts=3, prior=100.0)

#: Logit of every text where there is nothing to learn from.
NO_EVIDENCE = -4.0


def train_toxicity(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fit ``labels.toxic`` on a bounded sample of at most ``rows`` labelled texts."""
    return train(docs, labels, "toxic", SETTINGS, rows, none=NO_EVIDENCE)


def score_toxicity(docs: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from 0.5) for every document."""
    return score_documents(docs, model, 0.5, keep)


def without_toxic(docs: DataFrame, model: Model, cut: float = 0.5) -> DataFrame:
    """The documents of ``docs`` that score below ``cut``, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        fitted = shared.value
        for batch in batches:
            yield batch.filter(pa.array(fitted.scores(*utf8_views(batch.column("text"))) < cut))
        relax()

    return docs.mapInArrow(run, docs.schema)
