import random
import re

import numpy as np
from odd import ODD

from brindle.llm.license_scan import LEAST_COVER, LEAST_RUN, MOST_GAP, LicenseIndex, SuffixAutomaton, scan_licenses, word_ids
from brindle.llm.license_texts import PHRASES, TEMPLATES


def brute_places(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), sorted((k, label) for label, p in PHRASES for k in range(len(words)) if words[k : k + len(p.split())] == p.split())


def test_matching_statistics_equal_brute_force():
    rng = random.Random(4)
    for _ in range(60):
        templates = [[rng.randrange(3) for _ in range(rng.randrange(1, 9))] for _ in range(3)]
        a = SuffixAutomaton(templates)
        runs = {(tuple(t[i:j])): {(k, e) for k, u in enumerate(templates) for e in range(j - i, len(u) + 1) if u[e - (j - i) : e] == t[i:j]} for t in templates for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
        text = [rng.randrange(4) for _ in range(30)]
        state = run = 0
        for i, w in enumerate(text):
            while state and w not in a.next[state]:
                state = a.link[state]
                run = a.length[state]
            state = a.next[state].get(w, 0)
            run = run + 1 if state else 0
            longest = max((n for n in range(0, i + 2) if n == 0 or tuple(text[i + 1 - n : i + 1]) in runs), default=0)
            assert run == longest
            if run:
                assert a.ends[state] == runs[tuple(text[i + 1 - run : i + 1])]


def test_places_equal_brute_force(spark, documents):
    texts = [*ODD, "MIT License mit license,MIT\nlicense", "the GNU General Public License gnu general public gnu general public license", "cc by cc-by CC BY-NC apache license mit", "x mitlicense mit é license"]
    texts += [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows = {r["doc_id"]: r for r in scan_licenses(documents(texts, places="clash")).collect()}
    for k, t in enumerate(texts):
        n, places = brute_places(t)
        assert rows[k]["n_words"] == n
        assert [(p["start"], p["label"]) for p in rows[k]["places"]] == places


def test_templates_are_covered_through_gaps(documents):
    index = LicenseIndex()
    mit = TEMPLATES[0][1]
    words = mit.split()
    edited = " ".join(words[:30] + ["foo", "bar"] + words[33:])
    half = " ".join(words[:20])
    for text, found in ((mit, True), (edited, True), (half, False)):
        _, spans = index.scan(index.number(word_ids("before it " + text + " after it")[0]))
        assert any(s.label == "mit" and s.template == 0 for s in spans) == found
    _, spans = index.scan(index.number(word_ids("see: " + mit)[0]))
    whole = next(s for s in spans if s.template == 0)
    assert (whole.start, whole.cover) == (1, 1.0) and LEAST_RUN > 1


def test_nested_templates_equal_brute_force():
    rng = random.Random(6)
    for _ in range(80):
        long = [rng.choice("abcde") for _ in range(14)]
        texts = [long, long[:6], long[4:10], [rng.choice("abcde") for _ in range(5)], long[9:]]
        index = LicenseIndex([], [(str(k), " ".join(t)) for k, t in enumerate(texts)])
        words = [rng.choice("abcde") for _ in range(4)] + long + [rng.choice("abcde") for _ in range(6)] + long[:8]
        expected = set()
        for k, t in enumerate(texts):
            inside = {tuple(t[i:j]) for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
            size = [max((n for n in range(i + 1) if n == 0 or tuple(words[i - n : i]) in inside), default=0) for i in range(len(words) + 1)] + [0]
            expected |= {(k, size[i], i) for i in range(len(words) + 1) if size[i] >= LEAST_RUN and size[i + 1] != size[i] + 1}
        numbers = index.number(word_ids(" ".join(words))[0]).tolist()
        _, matches = index.stream(numbers, 0)
        assert {(k, run, end) for k, _, run, end in matches} == expected
        assert all(index.sequences[k][e - run : e] == numbers[end - run : end] for k, ends, run, end in matches for e in ends)
        # every template that stands in the text is covered
        _, spans = index.scan(np.array(numbers))
        assert {s.template for s in spans if s.cover == 1.0} >= {k for k, t in enumerate(texts) if any(words[i : i + len(t)] == t for i in range(len(words)))}


def test_short_notice_inside_the_long_one():
    index = LicenseIndex()
    short = "Licensed under the Apache License, Version 2.0."
    k = next(k for k, (_, t) in enumerate(TEMPLATES) if word_ids(t)[1] == word_ids(short)[1])
    for text in (short, short + " The code is here", *[t for _, t in TEMPLATES if word_ids(t)[1][:7] == word_ids(short)[1][:7]]):
        _, spans = index.scan(index.number(word_ids(text)[0]))
        assert [s.cover for s in spans if s.template == k] == [1.0], text


def test_long_text_is_scanned_whole(documents):
    text = "filler words here " * 120_000 + "under the MIT License"
    row = scan_licenses(documents([text])).first()
    assert row["n_words"] == 360_004 and [p["start"] for p in row["places"]] == [360_002]
    assert scan_licenses(documents([])).count() == 0


def test_another_version_is_another_licence():
    index = LicenseIndex()
    labels = lambda text: {s.label for s in index.scan(index.number(word_ids(text)[0]))[1]}
    assert "apache-2.0" in labels("Licensed under the Apache License, Version 2.0.")
    assert "apache-2.0" not in labels("Licensed under the Apache License, Version 1.1.")
    for here, there in (("2", "3"), ("3", "2")):
        found = labels(f"This work is licensed under the GNU General Public License, version {here}.")
        assert f"gpl-{here}.0" in found and f"gpl-{there}.0" not in found


def test_a_word_of_another_template_hides_none():
    x, y = "alpha beta gamma delta epsilon hotel india juliet kilo lima", "alpha beta gamma delta epsilon foxtrot golf mike november oscar"
    index = LicenseIndex([], [("x", x), ("y", y)])
    for word in ("foxtrot", "zulu"):
        text = x.replace("hotel", word + " hotel")
        assert {(s.label, s.cover) for s in index.scan(index.number(word_ids(text)[0]))[1]} >= {("x", 1.0)}


def test_chains_equal_brute_force():
    """Templates of different words, edited: the cover is that of all long runs that no wide gap parts."""
    rng = random.Random(9)
    for _ in range(150):
        words = [f"w{k}" for k in range(40)]
        index = LicenseIndex([], [("t", " ".join(words))])
        text: list[str] = []
        for w in words:
            if rng.random() < 0.06:
                text += [f"n{rng.randrange(99)}" for _ in range(rng.choice([1, 2, 5, 30]))]
            if rng.random() > 0.05:
                text.append(w)
        runs, best, start = [], 0.0, 0
        for i in range(1, len(text) + 1):
            if i == len(text) or not (text[i - 1][0] == "w" and text[i] == f"w{int(text[i - 1][1:]) + 1}"):
                if text[i - 1][0] == "w" and i - start >= LEAST_RUN:
                    runs.append((start, i))
                start = i
        held, last = 0, None
        for a, b in runs:
            held = held + b - a if last is not None and a - last <= MOST_GAP else b - a
            best, last = max(best, held / len(words)), b
        _, spans = index.scan(index.number(word_ids(" ".join(text))[0]))
        covers = [s.cover for s in spans]
        assert (max(covers) if covers else 0.0) == (best if best >= LEAST_COVER else 0.0)


def test_query_columns(spark, tmp_path):
    """The registered query: base columns by DuckDB, the method's by its own spans."""
    import duckdb

    from brindle.llm.queries import op4_license_scan

    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in op4_license_scan(spark, sf).collect()}
    words = " || ".join(f"CASE WHEN i + {len(p.split()) - 1} <= len(w) AND " + " AND ".join(f"w[i + {j}] = '{x}'" for j, x in enumerate(p.split())) + f" THEN '{label},' ELSE '' END" for label, p in PHRASES)
    sql = f"""WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM '{sf}/documents.parquet'),
    p AS (SELECT doc_id, i, {words} AS l FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w)),
    h AS (SELECT doc_id, i, unnest(string_split(rtrim(l, ','), ',')) AS l FROM p WHERE l <> '')
    SELECT w.doc_id, len(any_value(w)) AS n_words, count(h.i) AS n_base, min(h.i) - 1 AS first_word, max(h.i) - 1 AS last_word, coalesce(string_agg(DISTINCT h.l, ',' ORDER BY h.l), '') AS base_labels
    FROM w LEFT JOIN h USING (doc_id) GROUP BY w.doc_id"""
    rows = duckdb.sql(sql).fetchall()
    assert len(rows) == len(got) and any(r[2] for r in rows)
    spans = {r["doc_id"]: r["spans"] for r in scan_licenses(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    for r in rows:
        g = got[r[0]]
        assert (g["doc_id"], g["n_words"], g["n_base"], g["first_word"], g["last_word"], g["base_labels"]) == r
        base = set(r[5].split(",")) - {""}
        assert g["labels"] == ",".join(sorted(base | {s["label"] for s in spans[r[0]]}))
        assert g["score"] == max([0.5 if r[2] else 0.0, *[s["cover"] for s in spans[r[0]]]])
