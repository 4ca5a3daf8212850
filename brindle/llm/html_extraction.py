"""HTML extraction: the maximum-scoring subsequence of a page's tokens.

A page is a sequence of tags and words.  Words score by where they stand, tags
by their name; a linear scan finds the contiguous run of the largest sum, the
content region.  Blocks that the region touches are kept, without what stands
in menus, footers, adverts, forms, comments and the like: elements that are such
by their name or role, and elements whose class words weigh against them.

Class words are features with weights like the rest.  A word that its class
qualifies (``no-sidebar``, ``comments-open``, ``ad-free``) is a feature of its own,
and an element that a class names the article, or that is one, needs more than
one word against it.  Where nothing is left, class words (but those of comments)
have misled: the page is read again without them.

Weights are log-odds from labelled pages: pages that mark their article with
``article``, ``main`` or ``itemprop=articleBody`` tell what is inside of it and
what isn't.  Tokens that no such page has get priors: words positive, tags negative.
"""

from __future__ import annotations

import html
import math
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.sample import smallest

#: Most labelled pages that weights are learnt from (smallest hashes of page_id among the pages that mark an article).
TRAIN_PAGES = 2000

# Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
SKIPPED = frozenset("nav footer aside form button select option datalist dialog menu template svg canvas object video audio map head script style textarea title noscript iframe xmp noembed noframes".split())
BLOCKS = frozenset("address article blockquote body center dd details div dl dt fieldset figcaption figure footer h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul aside form".split())
CLOSES_P = BLOCKS - frozenset("td th tr tbody thead tfoot body html".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner banners promo promotion sponsor sponsored sponsors sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices disclaimer alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments commentlist reply replies respond disqus discussion widget widgets toolbar pagination pager search skip hidden".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist reply replies respond disqus discussion".split())
ARTICLE_WORDS = frozenset("article post entry content story title".split())
#: Words of a class that say how things are, not what the element is.
STATES = frozenset("no non not without has have with is free open opened closed enabled disabled off on print only hide show".split())
NOISE_ROLES = frozenset("navigation banner complementary contentinfo search form dialog alert alertdialog menu menubar toolbar".split())

#: What stands in an element of boilerplate is left out anyway, wherever it is;
#: it scores little, so that an advert amid the article doesn't end it.
NOISE = -0.01
#: What it says for an element that it is an article, or that a class names it one.
CONTAINER = 2.0

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:"[^"]*+"|'[^']*+'|[^>"'])*+)["']?>?|<[!?/][^>]*+>?""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SPLIT = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_DISPLAY = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


def _raw_end(page: str, name: str, at: int) -> int:
    found = re.compile(rf"</{name}(?=[\s/>])|</{name}\Z", re.I).search(page, at)
    return found.start() if found else len(page)


def class_features(value: str, in_article: bool) -> list[str]:
    """Features of a class or id: its known words, qualified ones with a ``~``, names of the article with a ``+``."""
    out = []
    for token in _CAMEL.sub("-", value).lower().split():
        words = _SPLIT.split(token)
        stated = "~" if not STATES.isdisjoint(words) else ""
        against = [w for w in words if w in NOISE_WORDS or (w == "header" and not in_article)]
        names = [w for w in words if w in ARTICLE_WORDS]
        if "header" in against and names:
            against.remove("header")
        out += [f"c:{stated}{w}" for w in against]
        if names and not against and not stated:
            out.append("c:+" + names[0])
        elif against:
            out += [f"c:{stated}{w}" for w in names]
    return out


def _judged(name: str, attributes: str, in_article: bool) -> tuple[bool, list[str]]:
    """(whether an element is boilerplate by its name, role or look, its class features)."""
    if name in SKIPPED or (name == "header" and not in_article):
        return True, []
    features: list[str] = []
    if not attributes or attributes.isspace():
        return False, features
    for key, a, b, c in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), (a or b or c)
        if key in ("class", "id") and name not in ("body", "html", "main"):
            features += class_features(value, in_article)
        elif key == "role" and value.strip().lower() in NOISE_ROLES:
            return True, features
        elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            return True, features
        elif key == "style" and _DISPLAY.search(value.lower()):
            return True, features
    return False, features


@dataclass
class Piece:
    """A tag or a run of words: what it is, how often it counts, its text and block."""

    kind: str
    count: int
    text: str = ""
    block: int = -1
    inside: bool = False  # in an element that marks the article
    noise: bool = False
    features: tuple[str, ...] = ()  # class features of the elements around it


def tokens(page: str, weights: Weights | None = None, classes: bool = True) -> tuple[list[Piece], bool]:
    """The pieces of a page, and whether it marks its article.

    Without ``classes`` the only class words that count are those of comments.
    """
    weights = weights or Weights()
    out: list[Piece] = []
    stack: list[tuple[str, bool, bool, tuple[str, ...]]] = []  # element, noise inside of it, article inside of it, features
    block, at, marked = 0, 0, False

    def text(raw: str) -> None:
        if not raw or raw.isspace():
            if raw:
                out.append(Piece("space", 0, " ", block))
            return
        noise = bool(stack) and stack[-1][1]
        inside = bool(stack) and stack[-1][2]
        place = "noise" if noise else next((s[0] for s in reversed(stack) if s[0] in BLOCKS or s[0] == "a"), "none")
        decoded = html.unescape(raw) if "&" in raw else raw
        out.append(Piece("w:" + place, len(decoded.split()), decoded, block, inside, noise, stack[-1][3] if stack else ()))

    def pop(k: int) -> None:
        nonlocal block
        for name, *_ in reversed(stack[k:]):
            if name in BLOCKS:
                block += 1
        del stack[k:]

    n = len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        noise = bool(stack) and stack[-1][1]
        inside = bool(stack) and stack[-1][2]
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    pop(k)
                    break
                # an inline end tag doesn't close blocks
                if stack[k][0] in BLOCKS and name not in BLOCKS:
                    break
            out.append(Piece("noise" if noise else "/" + (name if name in BLOCKS else "other"), 1, "", block, bool(stack) and stack[-1][2], noise))
            if name in BLOCKS:
                block += 1
            continue
        if name in CLOSES_P or name == "p":
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    pop(k)
                    break
                if stack[k][0] in BLOCKS:
                    break
        if name == "li":
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "li":
                    pop(k)
                    break
                if stack[k][0] in ("ul", "ol"):
                    break
        if name in BLOCKS:
            block += 1
        marks = name in ("article", "main") or "articlebody" in (m[3] or "").lower()
        hard, features = _judged(name, m[3] or "", inside or marks)
        if not noise:
            seen = features if classes else [f for f in features if f.removeprefix("c:") in COMMENT_WORDS]
            # an element that is an article itself, but not one inside of another, speaks for itself
            noise = hard or (bool(seen) and sum(map(weights.of, seen)) + (CONTAINER if marks and not inside else 0.0) < 0)
        inside = inside or (marks and not noise)
        marked = marked or inside
        out.append(Piece("noise" if noise else "<" + (name if name in BLOCKS else "other"), 1, " " if name == "br" else "", block, inside, noise))
        around = (*(stack[-1][3] if stack else ()), *features) if features else (stack[-1][3] if stack else ())
        if name in RAW:
            end = _raw_end(page, name, at)
            at = end
            stack.append((name, True, inside, around))
        elif name not in VOID and not (m[3] or "").rstrip().endswith("/"):
            stack.append((name, noise, inside, around))
    return out, marked


def prior(kind: str) -> float:
    if kind.startswith("c:"):
        word = kind[2:]
        if word[0] == "+":
            return CONTAINER
        if word[0] == "~":
            return 0.0
        return -3.0 if word in COMMENT_WORDS else 1.0 if word in ARTICLE_WORDS else -2.0
    if kind in ("noise", "w:noise"):
        return NOISE
    if kind == "w:a":
        return -0.2
    if kind.startswith("w:"):
        return 1.0
    return 0.0 if kind == "space" else -0.4


@dataclass
class Weights:
    """Score of each kind of token; kinds without a labelled example get priors."""

    score: dict[str, float] = field(default_factory=dict)

    def of(self, kind: str) -> float:
        found = self.score.get(kind)
        return prior(kind) if found is None else found


def weights_from(counts: dict[str, tuple[int, int]]) -> Weights:
    """Log-odds of (inside, outside) counts, with the prior as if seen a few times."""
    plain = [n for kind, n in counts.items() if not kind.startswith("c:")]
    ins, outs = sum(a for a, _ in plain) or 1, sum(b for _, b in plain) or 1
    score = {}
    for kind, (a, b) in counts.items():
        if kind in ("space", "noise", "w:noise") or a + b == 0:
            continue
        odds = math.log((a / ins + 1e-6) / (b / outs + 1e-6))
        # class words are rare and their priors telling: they take more examples
        trust = (a + b) / (a + b + (200.0 if kind.startswith("c:") else 5.0))
        score[kind] = max(-3.0, min(3.0, trust * odds + (1 - trust) * prior(kind)))
    return Weights(score)


def best_region(pieces: list[Piece], weights: Weights) -> tuple[int, int]:
    """[a, b) of the largest sum; the first of equals; (0, 0) if none is positive."""
    best, region, total, start = 0.0, (0, 0), 0.0, 0
    known: dict[str, float] = {}
    for k, p in enumerate(pieces):
        w = known.get(p.kind)
        if w is None:
            w = known[p.kind] = weights.of(p.kind)
        if total <= 0.0:
            total, start = 0.0, k
        total += w * p.count
        if total > best:
            best, region = total, (start, k + 1)
    return region


def extract(page: str, weights: Weights) -> str:
    """Main text: blocks of the region in page order, white space collapsed."""
    found, _ = tokens(page, weights)
    text = _region_text(found, weights)
    if not text and any(p.features and p.noise and p.kind.startswith("w:") for p in found):
        text = _region_text(tokens(page, weights, classes=False)[0], weights)
    return text


def _region_text(found: list[Piece], weights: Weights) -> str:
    a, b = best_region(found, weights)
    words = [p.block for p in found[a:b] if p.kind.startswith("w:") and not p.noise]
    if not words:
        return ""
    low, high = words[0], words[-1]
    blocks: dict[int, list[str]] = {}
    for p in found:
        if p.text and not p.noise and low <= p.block <= high:
            blocks.setdefault(p.block, []).append(p.text)
    lines = (" ".join("".join(parts).split()) for _, parts in sorted(blocks.items()))
    return "\n".join(x for x in lines if x)


def train_weights(pages: DataFrame, most: int = TRAIN_PAGES) -> Weights:
    """Weights from at most ``most`` pages that mark their article; only counts of token kinds reach the driver.

    There are a few hundred kinds at most: they are made of the element names
    and class words listed above.  Pages without id are no examples; of repeated
    ids one row is taken.
    """
    marking = pages.select("page_id", "html").where(F.col("page_id").isNotNull() & F.col("html").rlike(r"(?i)<(article|main)[\s>/]|articlebody"))
    sample = smallest(marking, "page_id", most).select("html")

    def count(batches):
        tally: dict[str, list[int]] = {}
        for batch in batches:
            for page in batch.column("html").to_pylist():
                found, marked = tokens(page)
                if not marked:
                    continue
                for p in found:
                    side = 0 if p.inside and not p.noise else 1
                    for kind in {p.kind, *p.features}:
                        tally.setdefault(kind, [0, 0])[side] += p.count
        kinds = list(tally)
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array([tally[k][0] for k in kinds], pa.int64()), pa.array([tally[k][1] for k in kinds], pa.int64())], names=["kind", "ins", "outs"])

    rows = sample.mapInArrow(count, "kind string, ins long, outs long").groupBy("kind").agg(F.sum("ins").alias("ins"), F.sum("outs").alias("outs")).collect()
    return weights_from({r["kind"]: (r["ins"], r["outs"]) for r in rows})


def extract_pages(pages: DataFrame, weights: Weights) -> DataFrame:
    """All columns of ``pages`` but html, and text and n_chars (code points).

    Null and empty pages, and pages without words, have the empty text; repeated
    rows are extracted alike; columns already named text or n_chars are
    replaced; an empty table gives an empty result.
    """
    keep = [c for c in pages.columns if c not in ("html", "text", "n_chars")]
    schema = T.StructType([*[pages.schema[c] for c in keep], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        for batch in batches:
            texts = [extract(p, weights) if p else "" for p in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    return pages.select(*keep, "html").mapInArrow(run, schema)
