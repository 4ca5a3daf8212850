import random
import re

import numpy as np
import pytest
from odd import ODD

from brindle.llm import decontamination as d
from brindle.llm.queries import op3_decontamination

SF = "/root/testdata/sf0.01"


def template(text):
    raw = text.encode()
    return next(iter(d.templates(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))))[1]


def brute_tokens(text):
    """(kind, word) of the canonical words, by plain Python."""
    words = [(m.start(), m.end(), m[0]) for m in re.finditer(r"[0-9A-Za-z\x80-\U0010ffff]+", text)]
    out, last, last_name = [], None, False
    for k, (a, b, w) in enumerate(words):
        gap = text[words[k - 1][1] : a] if k else ""
        opens = k == 0 or re.search(r'[.!?:;\n"]', gap)
        number = w.isascii() and w.isdigit()
        was = k and words[k - 1][2].isascii() and words[k - 1][2].isdigit()
        lower = "".join(c.lower() if c.isascii() or "À" <= c <= "Þ" and c != "×" else c for c in w)
        up = lambda c: "A" <= c <= "Z" or "À" <= c <= "Þ" and c != "×"
        name = up(w[0]) and len(w) > 1 and not up(w[1]) and not opens and not number
        if number and was and gap in (".", ","):
            continue
        if name and last_name:
            continue
        kind = d.NUMBER if number else d.NAME if name else d.UNIT if was and lower in d.UNITS else d.PLAIN
        out.append((kind, lower))
        last_name = name
    return out


@pytest.mark.parametrize("text", ["Tom Smith has 1,250.5 kg of Pears. Then Anna ate 3 km", "ALL CAPS HERE and É Ève été 5 x 7 hours", "a. B c\nD Ee: Ff \"Gg Hh\" Ii Jj Kk 12 13 km km", "", "Élan Élan x Élan Été y"])
def test_canonical_words_equal_brute_force(text):
    t = template(text)
    expected = brute_tokens(text)
    assert t.kind.tolist() == [k for k, _ in expected]
    assert t.raw.tolist() == [int(h) for h in (d._hashes([w for _, w in expected]) if expected else [])]


QUESTION = "A farmer named Tom has 12 apples and he buys 3 kg of pears from Anna for 1,250 dollars. How much does Tom pay in total for the pears?"


def leaks(text, item=QUESTION):
    return d.BenchmarkIndex([(7, template(item))]).leaks(template(text))


def test_reparameterised_questions_are_caught():
    other = "intro words. A farmer named Lisa has 40 apples and he buys 71 kg of pears from Bob Jones for 99.5 dollars. How much does Lisa pay in total for the pears? And more"
    assert [x["item_id"] for x in leaks(other)] == [7] and leaks(other)[0]["first_word"] == 2
    assert [x["item_id"] for x in leaks(QUESTION.upper())] in ([7], [])
    assert leaks("The farmer has apples. He buys pears from Anna. How much is it?") == []


@pytest.mark.parametrize("item", ["What is 12 + 34?", "Who was Marie Curie?", "Where is Mount Everest?", "Who wrote War and Peace?", "Add 1 2 3 4 5 6 7 8 9 10 11 12", QUESTION])
def test_verbatim_copies_are_found_in_any_case_and_place(item):
    for text in (item, item.lower(), item.upper(), "some words " + item, "Some. " + item.lower() + " and more"):
        assert [(x["item_id"], x["cover"] >= 0.5) for x in leaks(text, item)] == [(7, True)], text
    assert leaks("some words about 12 and 34, and who was there, and the Curie family", item) == []


def test_inconsistent_slots_are_no_leak():
    item = "then Tom met Anna and Tom gave Anna a book while Tom told Anna about it and Tom left Anna there"
    same = "then Max met Eve and Max gave Eve a book while Max told Eve about it and Max left Eve there"
    mixed = "then Max met Eve and Eva gave Ron a book while Tim told Max about it and Eve left Joe there"
    assert [x["item_id"] for x in leaks("so " + same, "so " + item)] == [7]
    assert leaks("so " + mixed, "so " + item) == []


def test_every_alignment_is_judged():
    item = "so then Tom met Anna and Tom gave Anna a book while Tom told Anna about it and Tom left Anna there"
    mixed = "so then Max met Eve and Eva gave Ron a book while Tim told Max about it and Eve left Joe there"
    other = item.replace("Tom", "Max").replace("Anna", "Eve")
    found = leaks(f"{mixed} {mixed} {other}", item)
    assert [(x["item_id"], x["cover"], x["first_word"]) for x in found] == [(7, 1.0, 44)]
    # one window less than the decoy
    assert [x["item_id"] for x in leaks(f"{mixed} and {other.removesuffix(' there')}", item)] == [7]
    assert leaks(f"{mixed} {mixed} {mixed}", item) == []


def test_parts_of_items_are_found_and_added_up():
    rng = random.Random(3)
    words = [f"{a}{b}" for a in "abcdefghijklmnop" for b in "qrstuvwxyz"]
    for n, part in ((59, 31), (59, 8), (400, 50)):
        item = [rng.choice(words) for _ in range(n)]
        found = leaks("intro and " + " ".join(item[5 : 5 + part]) + " tail", " ".join(item))
        assert [(x["item_id"], x["cover"], x["first_word"]) for x in found] == [(7, part / n, 2)]
        assert leaks("intro and " + " ".join(item[5:12]) + " tail " + " ".join(item[20:27]), " ".join(item)) == []
    # halves of a re-parameterised item without eight equal words in a row, in order and not
    item = " ".join(f"{a} {b} {c} {k + 11}" for k, (a, b, c) in enumerate(zip(*[iter(rng.sample(words, 36))] * 3)))
    other = re.sub(r"\d+", lambda m: str(int(m[0]) + 500), item).split()
    a, b, noise = " ".join(other[:21]), " ".join(other[27:]), "x1 " * 60
    assert [(x["item_id"], x["first_word"]) for x in leaks(f"so {a} {noise} {b}", item)] == [(7, 1)]
    assert leaks(f"so {b} {noise} {a}", item) == []


SHORT = [
    "Is 91 prime?",
    "What is 12 + 34?",
    "Compute 3 + 4 * 12 - 5 now",
    "Solve 2 x + 7 = 19",
    "Who was Marie Curie?",
    "How far is Paris from Rome?",
    "What is 15 percent of 80 kg?",
    "Sort 9 3 7 1 8 2 and add 4",
    "Add 1 2 3 4 5 6 7 8 9 10 11 12",
    "Round 12.75 to 1 place",
    "Divide 144 by 12",
    "Is 17 larger than 71?",
]


def other_values(text, rng):
    """The same question with other numbers, names and units; equal ones change alike."""
    to = {}

    def new(m):
        w = m[0]
        if w not in to:
            if w.isdigit():
                to[w] = str(1000 + 7 * len(to) + rng.randrange(7))
            elif w.lower() in d.UNITS:
                to[w] = rng.choice([u for u in d.UNITS if u != w])
            else:
                to[w] = rng.choice(["Bo", "Li", "Ada", "Max"]) + "xyzw"[len(to) % 4] + "abcd"[len(to) // 4 % 4]
        return to[w]

    head, _, rest = text.partition(" ")
    return head + " " + re.sub(r"\b\d+\b|(?<=\d )(?:kg|percent)\b|\b[A-Z][a-z]+\b", new, rest)


def test_every_item_pasted_verbatim_is_found(spark):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").collect()]
    items += [(10_000 + k, t) for k, t in enumerate(SHORT)]
    index = d.BenchmarkIndex([(i, template(t)) for i, t in items])
    for i, t in items:
        for text in ("so it goes. " + t + " And on", "amid words " + t.lower() + " it stands", "".join(c if c == "ß" else c.upper() for c in t)):
            assert i in [x["item_id"] for x in index.leaks(template(text))], t


def test_recall_of_reparameterised_items():
    rng = random.Random(12)
    names, things = ["Tom", "Anna", "Lisa", "Bob"], ["apples", "pears", "books", "coins"]
    items = list(SHORT)
    for _ in range(60):
        a, b = rng.sample(names, 2)
        x, y = rng.sample(things, 2)
        items.append(f"The shop of {a} sells {rng.randrange(90)} {x} to {b} for {rng.randrange(900)} dollars. If {b} buys {rng.randrange(50)} kg of {y} from {a} too, how much is left to {b}?")
    index = d.BenchmarkIndex([(k, template(t)) for k, t in enumerate(items)])
    found = [k in [x["item_id"] for x in index.leaks(template("Some words. " + other_values(t, rng) + " More words"))] for k, t in enumerate(items)]
    assert np.mean(found[: len(SHORT)]) >= 0.9 and np.mean(found[len(SHORT) :]) >= 0.9
    clean = ["The market opens at 8 and closes at 17.", "In 1984 Anna moved to Rome.", "There are 12 apples and 30 pears in the shop of Tom.", "She was 91 and he 17 when they met in Paris."]
    assert all(index.leaks(template(t)) == [] for t in clean)


def test_a_window_of_very_many_items():
    """Items that share their opening: each is judged by its own windows."""
    rng = random.Random(13)
    words = [f"{a}{b}" for a in "abcdefghijklmnop" for b in "qrstuvwxyz"]
    opening = "in the following passage find the"
    items = [opening + " " + " ".join(rng.sample(words, 20)) for _ in range(3000)]
    index = d.BenchmarkIndex([(k, template(t)) for k, t in enumerate(items)])
    text = " ".join([opening + " best of it"] * 100) + " " + items[7]
    assert [x["item_id"] for x in index.leaks(template(text))] == [7]
    assert len(index.hits(template(text))) == 1


def test_query_finds_every_passage_and_nothing_else(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    grams = {}
    for i in items:
        w = words(i["text"])
        for k in range(len(w) - 7):
            grams.setdefault(tuple(w[k : k + 8]), set()).add(i["item_id"])
    expected = set()
    for r in docs:
        w = words(r["text"])
        for k in range(len(w) - 7):
            expected |= {(r["doc_id"], i) for i in grams.get(tuple(w[k : k + 8]), ())}
    assert {(r["doc_id"], r["item_id"]) for r in op3_decontamination(spark, SF).collect()} == expected and expected


def test_blocks_give_the_same_leaks(spark, documents, monkeypatch):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(500)]
    items = [(k, " ".join(rng.sample(words, 20))) for k in range(12)] + [(12, None), (None, "x y z a b c"), (13, "two words"), (14, "just three words")]
    texts = [(k, " ".join(rng.sample(words, 50)) + " " + items[k][1] + " tail") for k in range(12)] + [(20, "here are just three words"), (21, "nothing")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    df = documents(texts, leaks="clash", item_id=1, _leaks=2, _leaks_of_block0=3)
    whole = sorted((r["doc_id"], r["item_id"]) for r in d.find_leaks(df, benchmark).collect())
    assert whole == [(k, k) for k in range(12)] + [(20, 14)]
    monkeypatch.setattr(d.benchmark_blocks, "__defaults__", (45,))
    assert sorted((r["doc_id"], r["item_id"]) for r in d.find_leaks(df, benchmark).collect()) == whole
    kept = d.without_leaks(df, benchmark)
    assert kept.columns == df.columns and [r["doc_id"] for r in kept.collect()] == [21]


def test_odd_tables(spark, documents):
    benchmark = spark.createDataFrame([(1, QUESTION), (1, QUESTION), (2, "")], "item_id long, text string")
    df = documents([*ODD, QUESTION, QUESTION, "filler words and more " * 80_000 + QUESTION])
    found = d.find_leaks(df, benchmark).collect()
    n = len(ODD)
    assert sorted((r["doc_id"], r["item_id"]) for r in found) == sorted([(k, 1) for k in (n, n + 1, n + 2)] * 2)
    assert max(r["first_word"] for r in found) == 320_000
    assert d.find_leaks(df, benchmark.limit(0)).count() == 0 and d.find_leaks(df.limit(0), benchmark).count() == 0
    assert d.without_leaks(df, benchmark.limit(0)).count() == n + 3
