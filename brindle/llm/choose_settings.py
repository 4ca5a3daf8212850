"""How the settings of the two label-trained scorers were chosen: python -m brindle.llm.choose_settings SF_DIR.

Only the training fold is read.  Every fifth of its documents (by hash) is kept
for validation; each candidate is fitted on the rest (which sets its threshold
on a fifth of its own) and judged there.  The held-out fold takes no part.
"""

from __future__ import annotations

import sys
import time
import zlib
from dataclasses import replace

import numpy as np

from brindle.llm import quality_classifier, toxicity
from brindle.llm.labelled import TRAIN_ROWS, hash_key
from brindle.llm.subword import KEEP, Settings, _column, fit

CANDIDATES: dict[str, list[dict]] = {
    "toxic": [{}, {"window_words": 24}, {"window_words": 96}, {"most_bags": 1.0}, {"most_bags": 1e9}],
    "quality": [{}, {"echo": False}, {"lower": True, "keep": "word"}, {"epochs": 10}],
}


def judged(predicted: np.ndarray, labels: np.ndarray, goal: str) -> float:
    """What the threshold is set for, as a share of the best."""
    if goal == "accuracy":
        return float((predicted == labels).mean())
    return float((KEEP * (predicted & (labels == 1)).sum() - (predicted & (labels == 0)).sum()) / max(1, KEEP * (labels == 1).sum()))


def compare(texts: list[bytes], labels: np.ndarray, base: Settings, cut: float, options: list[dict]) -> list[tuple[dict, float, float, float, float]]:
    """(option, goal reached, share of label 1 found, share of label 0 left alone, seconds) on the validation part."""
    aside = np.arange(len(texts)) % 5 == 2
    out = []
    for option in options:
        began = time.process_time()
        s = replace(base, **option)
        model = fit([t for t, a in zip(texts, aside) if not a], labels[~aside].tolist(), s)
        y = labels[aside]
        predicted = model.scores(*_column([t for t, a in zip(texts, aside) if a])) >= cut
        out.append((option, judged(predicted, y, s.goal), float(predicted[y == 1].mean()), float(1 - predicted[y == 0].mean()), time.process_time() - began))
    return out


def main(sf_dir: str) -> None:
    import pyarrow.parquet as pq

    docs = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    labels = pq.read_table(f"{sf_dir}/labels.parquet").to_pylist()
    text = {r["doc_id"]: r["text"] for r in docs if r["text"] is not None}
    for label, base, cut in (("toxic", toxicity.SETTINGS, 0.5), ("quality", quality_classifier.SETTINGS, 0.3)):
        known = {r["doc_id"]: r[label] for r in labels if r[label] in (0, 1) and r["doc_id"] in text and zlib.crc32(str(r["doc_id"]).encode()) % 5}
        ids = sorted(known, key=hash_key)[:TRAIN_ROWS]
        for option, *found in compare([text[i].encode() for i in ids], np.array([known[i] for i in ids]), base, cut, CANDIDATES[label]):
            print(label, option, [round(x, 4) for x in found], flush=True)


if __name__ == "__main__":
    main(sys.argv[1])
