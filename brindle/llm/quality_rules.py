"""Quality rules: repetition guards and divergence from language references.

Base rules reject texts of few words and texts whose words mostly stand in
repeated three-word windows.  The method's rule compares two histograms of a
text with those of its language, by Jensen-Shannon distance (0 to 1):

* character classes: capitals, digits, symbols, sentence marks, other marks,
  bytes beyond ASCII, and the other characters of words;
* the commonest words of the language, and all other words.

References are summed over all documents of a language (all documents for
languages without a word list), so they are at most five rows.  Each distinct
text counts once there, so that a group of copies is no reference; the registered
query counts every row, as its SQL does.  Either distance counts only for texts
long enough for it.

Everything is DataFrame functions: one pass sums the references, the next one
judges.  Null and empty texts have no words and fail the base rules; an unknown
or null language is compared with the pooled reference on characters alone;
repeated rows are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What separates words, and the eight commonest short words of each language.
WHITE = " \t\n\x0b\x0c\r"
COMMON = {
    "en": ("the", "of", "and", "to", "in", "is", "that", "for"),
    "de": ("der", "die", "und", "den", "von", "zu", "das", "mit"),
    "fr": ("de", "la", "le", "et", "les", "des", "un", "que"),
    "es": ("de", "la", "que", "el", "y", "los", "del", "no"),
}
SYMBOLS = "#*$%&|<>"
MARKS = ".,;:!?"
OTHER_MARKS = "\"'()+-/=@[\\]^_`{}~"
CLASSES = ("capitals", "digits", "symbols", "marks", "other_marks", "wide", "plain")
WORDS = tuple(f"word{k}" for k in range(8)) + ("word_rest",)


@dataclass(frozen=True)
class Rules:
    """Parameters of the rules."""

    least_words: int = 50
    most_repeated: int = 50  # percent of the words
    char_words: int = 50  # least words for the character histogram
    char_distance: float = 0.3
    common_words: int = 100  # least words for the word histogram
    common_distance: float = 0.25


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def light_features(docs: DataFrame) -> DataFrame:
    """``docs`` with _t, _w (words), _lang, class and common-word counts."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    source = capitals + "0123456789" + SYMBOLS + MARKS + OTHER_MARKS + WHITE
    target = "U" * 26 + "D" * 10 + "S" * len(SYMBOLS) + "P" * len(MARKS) + "Q" * len(OTHER_MARKS)
    out = docs.withColumn("_t", F.coalesce(F.col("text"), F.lit("")))
    out = out.withColumn("_lang", F.when(F.col("lang").isin(*COMMON), F.col("lang")) if "lang" in docs.columns else F.lit(None).cast("string"))
    # every class becomes one letter, white space goes
    out = out.withColumn("_m", F.translate("_t", source, target))
    out = out.withColumn("_w", F.array_remove(F.split("_t", r"[\x20\x09-\x0D]+"), ""))
    count = lambda letter: (F.length("_m") - F.length(F.replace(F.col("_m"), F.lit(letter), F.lit("")))).cast("long")
    out = out.withColumns(
        {
            "word_chars": F.length("_m").cast("long"),
            "n_words": F.size("_w").cast("long"),
            "capitals": count("U"),
            "digits": count("D"),
            "symbols": count("S"),
            "marks": count("P"),
            "other_marks": count("Q"),
            "wide": (F.octet_length("_m") - F.length("_m")).cast("long"),
        }
    )
    every = sorted({w for words in COMMON.values() for w in words})
    listed = F.when(F.lit(False), F.array().cast("array<string>"))
    for lang, words in COMMON.items():
        listed = listed.when(F.col("_lang") == lang, F.array(*map(F.lit, words)))
    hits = F.filter("_w", lambda x: x.isin(*every))
    counts = _let(hits, lambda c: F.transform(listed, lambda v: F.size(F.filter(c, lambda x: x == v)).cast("long")))
    out = out.withColumn("_c", counts)
    out = out.withColumns({f"word{k}": F.coalesce(F.get("_c", F.lit(k)), F.lit(0)).cast("long") for k in range(8)})
    plain = F.col("word_chars") - sum((F.col(c) for c in CLASSES[:5]), F.lit(0))
    rest = F.col("n_words") - sum((F.col(f"word{k}") for k in range(8)), F.lit(0))
    return out.withColumns({"plain": F.greatest(plain - F.col("wide"), F.lit(0)).cast("long"), "word_rest": rest.cast("long")})


def language_references(docs: DataFrame, once: bool = True) -> dict[str | None, dict[str, float]]:
    """Shares of all classes and words per language; None: all documents.

    With ``once``, equal texts of a language (by 64-bit hash) count as one.
    At most one row per language of ``COMMON`` and one for the others comes to
    the driver.
    """
    columns = [*CLASSES, *WORDS]
    held = light_features(docs.select(*[c for c in ("text", "lang") if c in docs.columns]))
    if once:
        held = held.groupBy("_lang", F.xxhash64("_t").alias("_h")).agg(*[F.max(c).alias(c) for c in columns])
    rows = held.groupBy("_lang").agg(*[F.sum(c).alias(c) for c in columns]).collect()
    sums = {r["_lang"]: {c: r[c] or 0 for c in columns} for r in rows}
    sums[None] = {c: sum(s[c] for s in sums.values()) for c in columns}
    share = lambda s, names: {c: s[c] / total if (total := sum(s[n] for n in names)) else 0.0 for c in names}
    return {lang: share(s, CLASSES) | share(s, WORDS) for lang, s in sums.items()}


def _distance(names: tuple[str, ...], references: dict, langs: list) -> Column:
    """Jensen-Shannon distance (base 2) of a text's histogram from its language's."""
    total = sum((F.col(c) for c in names), F.lit(0))
    terms = []
    for c in names:
        p = F.when(total > 0, F.col(c) / total).otherwise(0.0)
        q = F.lit(float(references[None][c]))
        pick = None
        for lang in langs:
            value = F.lit(float(references[lang][c]))
            pick = F.when(F.col("_lang") == lang, value) if pick is None else pick.when(F.col("_lang") == lang, value)
        if pick is not None:
            q = pick.otherwise(q)
        part = lambda a, b: F.when(a > 0, a * F.ln(2 * a / (a + b))).otherwise(0.0)
        terms.append(part(p, q) + part(q, p))
    return F.sqrt(F.greatest(sum(terms[1:], terms[0]) / 2 / F.ln(F.lit(2.0)), F.lit(0.0)))


def judge(docs: DataFrame, references: dict, rules: Rules = Rules()) -> DataFrame:
    """``docs`` with counts, distances, base_failed and kept (columns of the same names are replaced).

    The rows pass a generator that gives each of them once: no later filter is
    pushed through it, with a copy of all these expressions at every use.
    """
    judged = _judged(docs, references, rules)
    return judged.select(F.inline(F.array(F.struct(*judged.columns))))


def _judged(docs: DataFrame, references: dict, rules: Rules) -> DataFrame:
    keep = [c for c in docs.columns if c not in OUTPUT]
    # the given columns travel in a struct, so that none clashes with a feature
    read = [c for c in ("text", "lang") if c in docs.columns]
    out = light_features(docs.select(F.struct(*keep).alias("_row"), *read))
    lines = F.filter(F.split("_t", "\n"), lambda x: F.length(F.trim(x, F.lit(WHITE))) > 0)
    repeated_lines = _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    # hashes of three-word windows; those that occur again, by place; the words they cover
    windows = F.when(F.size("_w") >= 3, F.transform(F.sequence(F.lit(0), F.size("_w") - 3), lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2))))
    windows = F.coalesce(windows, F.array().cast("array<bigint>"))

    def covered(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        again = lambda s: F.transform(F.filter(F.transform(s, lambda e, k: F.struct(e["i"].alias("i"), (F.coalesce(F.get(s, k - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == e["h"], F.lit(False))).alias("y"))), lambda e: e["y"]), lambda e: e["i"])
        places = F.array_sort(_let(ordered, again))
        steps = lambda r: F.aggregate(F.transform(r, lambda x, k: F.least(F.lit(3), x - F.coalesce(F.get(r, k - 1), F.lit(-3)))), F.lit(0), lambda a, x: a + x)
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_let(places, steps))

    out = out.withColumns({"n_symbols": F.col("symbols"), "n_dup_lines": repeated_lines.cast("long"), "n_repeat_words": _let(windows, covered).cast("long")})
    out = out.withColumn("base_failed", (F.col("n_words") < rules.least_words) | (100 * F.col("n_repeat_words") > rules.most_repeated * F.col("n_words")))
    langs = [k for k in references if k is not None]
    out = out.withColumns({"char_distance": _distance(CLASSES, references, langs), "common_distance": _distance(WORDS, references, langs)})
    odd = (F.col("n_words") >= rules.char_words) & (F.col("char_distance") > rules.char_distance)
    rare = F.col("_lang").isNotNull() & (F.col("n_words") >= rules.common_words) & (F.col("common_distance") > rules.common_distance)
    out = out.withColumn("kept", ~F.col("base_failed") & ~odd & ~rare)
    return out.select("_row.*", *OUTPUT)


def keep_good(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The documents of ``docs`` that the rules keep, with all their columns."""
    references = language_references(docs)
    held = docs.select(F.struct(*docs.columns).alias("_all"), *[c for c in ("text", "lang") if c in docs.columns])
    judged = _judged(held, references, rules)
    # not a filter, for the reason that ``judge`` gives
    return judged.select(F.inline(F.when(F.col("kept"), F.array("_all"))))


OUTPUT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "common_distance", "kept")
