import os
import zlib

import numpy as np
import pytest
from odd import ODD
from pyspark.sql import functions as F

from brindle.llm import labelled, quality_classifier, toxicity
from brindle.llm.labelled import held_out
from brindle.llm.queries import op2_toxicity, op8_quality_classifier
from brindle.llm.subword import Settings, features, fit
from brindle.llm.textbytes import class_table

SF = "/root/testdata/sf0.01"


def fold(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


@pytest.fixture(scope="module")
def insults():
    """Texts of made-up words, with or without insults."""
    rng = np.random.default_rng(5)
    plain = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 9))) for _ in range(400)]

    def text(bad):
        words = list(rng.choice(plain, rng.integers(20, 120)))
        for _ in range(3 * bad):
            words.insert(rng.integers(len(words)), str(rng.choice(["stupid", "moronic", "worthless"])))
        return " ".join(words)

    y = rng.integers(0, 2, 600)
    return [text(int(v)).encode() for v in y], y.tolist(), text


def column(texts):
    at = np.r_[0, np.cumsum([len(t) for t in texts])]
    return np.frombuffer(b"".join(texts), np.uint8), at


def test_held_out_accuracy_and_misspellings(insults):
    texts, y, make = insults
    model = fit(texts[:500], y[:500], toxicity.SETTINGS)
    predicted = model.scores(*column(texts[500:])) >= 0.5
    assert (predicted == np.array(y[500:])).mean() >= 0.95
    odd = [(make(0) + " " + w).encode() for w in ("stuppid stupidd", "worthles wortless", "moronical moronicc")]
    assert (model.scores(*column(odd)) >= 0.5).all()
    # a few insults in a long text
    long = (" ".join(make(0) for _ in range(200)) + " stupid worthless moronic stupid " + " ".join(make(0) for _ in range(200))).encode()
    clean = " ".join(make(0) for _ in range(400)).encode()
    a, b = model.scores(*column([long, clean]))
    assert a > b


def test_pieces_score_as_the_whole(insults):
    from brindle.llm.subword import scores_of

    texts, y, _ = insults
    model = fit(texts[:300], y[:300], Settings(keep="black", lower=False))
    raw = b" ".join(texts)
    whole, cut = (scores_of(model, *column([raw, texts[0]]), limit) for limit in (1 << 22, 5000))
    assert np.allclose(whole, cut, atol=1e-6)


def test_features_share_ngrams_and_respect_words():
    table = class_table("word", True)
    mapped = lambda t: table[np.frombuffer(f" {t} ".encode(), np.uint8)]
    sets = [set(np.concatenate([b for _, b in features(mapped(t), (3, 4, 5), 20)]).tolist()) for t in ("stupid", "STUPIDD", "stu pid")]
    assert len(sets[0] & sets[1]) > len(sets[0] & sets[2])
    assert list(features(mapped(""), (3,), 10)) == [] or all(len(w) == 0 for w, _ in features(mapped(""), (3,), 10))


def test_degenerate_training():
    s = Settings(bits=10)
    assert fit([], [], s).scores(*column([b"x", b""])).tolist() == [0.5, 0.5]
    assert (fit([b"a"], [1], s).scores(*column([b"x", b""])) > 0.9).all()
    assert (fit([b"a", b"a"], [0, 1], s).scores(*column([b"x"])) < 0.1).all()


@pytest.mark.parametrize("query,label,cut,least", [(op2_toxicity, "toxic", 0.5, 0.9), (op8_quality_classifier, "quality", 0.3, 0.85)])
def test_queries(spark, query, label, cut, least):
    rows = query(spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(1000))
    assert all(r["held_out"] == fold(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= cut) for r in rows)
    known = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    judged = [r["predicted"] == known[r["doc_id"]] for r in rows if r["held_out"] and r["doc_id"] in known]
    assert sum(judged) >= least * len(judged)


@pytest.mark.parametrize("module,train,score", [(toxicity, "train_toxicity", "score_toxicity"), (quality_classifier, "train_quality", "score_quality")])
def test_labels_of_the_held_out_fold_are_not_learnt(spark, module, train, score):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumns({c: F.when(held_out(F.col("doc_id")), 1 - F.col(c)).otherwise(F.col(c)) for c in ("quality", "toxic")})
    a, b = (getattr(module, train)(docs, x) for x in (labels, turned))
    assert np.array_equal(a.gain, b.gain) and a.bias == b.bias


def test_nothing_is_dropped_without_training_texts(spark, documents):
    docs = documents([(k, f"some words of text {k}") for k in range(30)] + [(k, None) for k in range(30, 40)])
    some = spark.createDataFrame([(k, 1, 1) for k in (*range(30, 40), *range(100, 140))], "doc_id long, quality int, toxic int")
    for labels in (some, some.limit(0)):
        model = toxicity.train_toxicity(docs, labels)
        assert toxicity.without_toxic(docs, model).count() == 40
        assert {r["predicted"] for r in toxicity.score_toxicity(docs, model).collect()} == {0}
        assert {r["predicted"] for r in quality_classifier.score_quality(docs, quality_classifier.train_quality(docs, labels)).collect()} == {1}


def test_sample_is_picked_among_usable_texts(spark, documents):
    texts = ["fine words here and there", "stupid moronic worthless thing"]
    docs = documents([(k, f"{texts[k % 2]} {k}" if k < 100 else None) for k in range(400)])
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(4000)], "doc_id long, quality int, toxic int")
    for train in (toxicity.train_toxicity, quality_classifier.train_quality):
        assert train(docs, labels, 40).notes["texts"] == 40


def test_odd_tables(spark, documents):
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(20)] + [(None, 1, 1), (3, None, None), (4, 7, 7), (3, 0, 0)], "doc_id long, quality int, toxic int")
    rows = [(k, t) for k, t in enumerate(ODD)] + [(None, "x y z"), (0, "again"), (0, "again")]
    docs = documents(rows, score="clash", predicted=3)
    for module, train, score in ((toxicity, "train_toxicity", "score_toxicity"), (quality_classifier, "train_quality", "score_quality")):
        model = getattr(module, train)(docs, labels)
        out = getattr(module, score)(docs, model, ("source", "score")).collect()
        assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
        assert [r["held_out"] for r in out if r["doc_id"] is None] == [False]
        empty = getattr(module, train)(docs.limit(0), labels.limit(0))
        assert getattr(module, score)(docs.limit(0), empty).count() == 0
    kept = toxicity.without_toxic(docs, toxicity.train_toxicity(docs, labels), 2.0)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert toxicity.without_toxic(docs, toxicity.train_toxicity(docs, labels), 0.0).count() == 0


M64 = (1 << 64) - 1


def mixed(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & M64
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & M64
    return x ^ (x >> 31)


def word_hash(word):
    """The hash of a word: a random number for each byte at its place, summed and mixed."""
    total = 0
    for k, b in enumerate(word):
        r = mixed((((k % 64) * 256 + b + 1) * 0x9E3779B97F4A7C15) & M64)
        total += r * pow(0xD6E8FEB86659FD93, k // 64, 1 << 64)
    return mixed((total + len(word)) & M64)


def brute_score(model, text, settings):
    """A text's score in plain Python: features of each bag, their mean gain, the logistic function."""
    import math
    import re

    raw = (text or "").encode()
    if settings.lower:
        raw = bytes(b + 32 if 65 <= b <= 90 else b for b in raw)
    inside = rb"[0-9A-Za-z\x80-\xff]+" if settings.keep == "word" else rb"[^\x20\x09-\x0d]+"
    words = re.findall(inside, raw)
    bucket = lambda v: ((v * 0x9E3779B97F4A7C15) & M64) >> (64 - settings.bits)
    per = settings.window_words or max(1, len(words))
    parts = [words[k : k + per] for k in range(0, len(words), per)]
    if settings.window_words and len(parts) > 1 and len(parts[-1]) < per // 2:
        parts[-2:] = [parts[-2] + parts[-1]]
    best, before = [], None
    for part in parts:
        gains = []
        for w in part:
            gains.append(model.gain[bucket(word_hash(w))])
            if settings.echo and w == before:
                gains.append(model.gain[(1 << settings.bits) - 1])
            before = w
            spaced = b" " + w + b" "
            for n in settings.sizes:
                for i in range(len(spaced) - n + 1):
                    value = spaced[i] + 1
                    for c in spaced[i + 1 : i + n]:
                        value = (value * 0xC2B2AE3D27D4EB4F + c + 1) & M64
                    value = (value + n) & M64
                    gains.append(model.gain[bucket(value ^ (value >> 29))])
        best.append(sum(map(float, gains)) / max(1, len(gains) + settings.prior))
    logit = model.slope * max(best, default=0.0) + model.bias
    return 1 / (1 + math.exp(-max(-30, min(30, logit))))


@pytest.mark.parametrize("query,train,label", [(op2_toxicity, toxicity.train_toxicity, "toxic"), (op8_quality_classifier, quality_classifier.train_quality, "quality")])
def test_query_scores_equal_plain_python(spark, query, train, label):
    small = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    model = train(docs, labels)
    rows = {r["doc_id"]: r for r in query(spark, small).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(rows) == len(texts) and max(map(len, texts.values())) > 5000
    for i, t in texts.items():
        score = brute_score(model, t, model.settings)
        assert abs(rows[i]["score"] - score) < 1e-4, i
        assert rows[i]["predicted"] == int(rows[i]["score"] >= (0.5 if label == "toxic" else 0.3)) and rows[i]["held_out"] == fold(i)


def test_long_texts_are_learnt_from_and_scored_whole(spark, documents):
    rng = np.random.default_rng(4)
    plain = ["".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(300)]
    texts = []
    for k in range(120):
        words = list(rng.choice(plain, 1500))
        if k % 2:
            words[1200:1200] = ["stupid", "worthless", "moronic"] * 20
        texts.append(" ".join(words))
    assert min(map(len, texts)) > 5000
    labels = spark.createDataFrame([(k, 1 - k % 2, k % 2) for k in range(120)], "doc_id long, quality int, toxic int")
    docs = documents(texts)
    for module, score, column in ((toxicity, toxicity.score_toxicity, "toxic"), (quality_classifier, quality_classifier.score_quality, "quality")):
        model = (toxicity.train_toxicity if column == "toxic" else quality_classifier.train_quality)(docs, labels)
        assert model.notes["texts"] == sum(not fold(k) for k in range(120))
        held = [(r["doc_id"] % 2 == (column == "toxic")) == (r["predicted"] == 1) for r in score(docs, model).collect() if r["held_out"]]
        assert np.mean(held) >= 0.9


def test_one_id_gives_one_training_row(spark, documents):
    docs = documents([(1, f"text number {k}") for k in range(500)] + [(2, "another text")])
    labels = spark.createDataFrame([(1, 1, 1), (1, 0, 0), (2, 0, 0)] * 50, "doc_id long, quality int, toxic int")
    kept = [k for k in (1, 2) if not fold(k)]
    assert toxicity.train_toxicity(docs, labels).notes.get("texts", len(kept)) <= len(kept)


def test_the_driver_fits_nothing_and_gets_the_same_model(spark, documents, insults, monkeypatch):
    """A task fits: texts and training arrays would fill the driver's memory."""
    texts, y, _ = insults
    docs = documents([t.decode() + (" größer" if k % 3 else "") for k, t in enumerate(texts)])
    labels = spark.createDataFrame([(k, v, v) for k, v in enumerate(y)], "doc_id long, quality int, toxic int")

    def noted(*args):
        model = fit(*args)
        model.notes["process"] = os.getpid()
        return model

    monkeypatch.setattr(labelled, "fit", noted)
    whole = {r["doc_id"]: r["text"].encode() for r in docs.collect() if not fold(r["doc_id"])}
    order = sorted(whole, key=lambda k: (labelled.hash_key(k), k))
    for module, train in ((toxicity, toxicity.train_toxicity), (quality_classifier, quality_classifier.train_quality)):
        model, same = train(docs, labels), fit([whole[k] for k in order], [y[k] for k in order], module.SETTINGS)
        assert model.notes.pop("process") != os.getpid()
        assert np.array_equal(model.gain, same.gain) and (model.bias, model.slope, model.notes) == (same.bias, same.slope, same.notes)


def test_settings_are_compared_inside_the_training_fold():
    from brindle.llm.choose_settings import compare

    texts = [(f"fine words {k} here" if k % 2 else f"stupid worthless {k} thing").encode() for k in range(200)]
    out = compare(texts, np.array([1 - k % 2 for k in range(200)]), Settings(bits=12, epochs=3), 0.5, [{}, {"epochs": 1}])
    assert [o for o, *_ in out] == [{}, {"epochs": 1}] and out[0][1] == 1.0
