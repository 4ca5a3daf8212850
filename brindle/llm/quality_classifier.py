"""Quality classifier: hashed word and character n-gram vectors, averaged.

A document is one bag; case and symbols count, since they tell junk from
prose, and so does a word that repeats its predecessor (the one word bigram).  Softmax output, trained by numpy stochastic gradient descent.

Edge cases: as in ``toxicity``: null and empty texts get the score of no
evidence, null ids are scored and never held out, repeated rows are scored
alike, empty tables give empty results.  Without any labelled text to learn
from every score is 0.5, so that everything is taken for good.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from brindle.llm.labelled import TRAIN_ROWS, score_documents, train
from brindle.llm.subword import Model, Settings

#: Chosen inside of the training fold: see ``choose_settings``.
SETTINGS = Settings(keep="black", lower=False, window_words=0, echo=True, epochs=5, target=0.3, goal="keep")


def train_quality(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fit ``labels.quality`` on a bounded sample of at most ``rows`` labelled texts."""
    return train(docs, labels, "quality", SETTINGS, rows)


def score_quality(docs: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from 0.3) for every document."""
    return score_documents(docs, model, 0.3, keep)
