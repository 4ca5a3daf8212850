"""URL filter: rules first, then gradient-boosted trees on lexical features.

Rules give a host (it and its subdomains) and a beginning of the path; the
longest that fits decides.  Other URLs are judged by trees over length, depth,
digit ratio, character entropy, parameter counts and statistics of the host's
suffix and of the path's first segment, trained from labelled URLs.  In the registered query the labels are positive and
unlabelled ones: URLs that a rule blocks are examples of blocking, all others of
not blocking.  So a suffix is blocked by the trees only where the rules block
most of its URLs, not where the few that a rule speaks of are blocked, and what
nothing tells against is allowed.

Features, rules and trees are column expressions; training reads a bounded
sample of feature rows (``TRAIN_ROWS``, smallest hashes of the URL) to the
driver and fits histogram trees there.

A null URL or one without ``://`` has empty host and path, fits no rule and is
judged by its features (all zero for null).  Without labelled rows every such
URL is allowed.  Repeated rows are judged alike; other columns pass through
(host, path, rule, verdict, score are replaced); an empty table gives an empty
result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.sample import smallest

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Largest number of labelled URLs that training reads.
TRAIN_ROWS = 20_000
#: Largest number of suffixes, and of first path segments, with statistics of their own.
MOST_SUFFIXES = 64


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


FEATURES = ("url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "entropy", "parameters", "query_length", "hyphens", "fragment", "suffix_share", "suffix_blocked", "segment_share", "segment_blocked")


def with_parts(pages: DataFrame) -> DataFrame:
    """``pages`` with host and path, as the rules read them."""
    at = F.instr("url", "://")
    rest = F.when(F.coalesce(at, F.lit(0)) > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    out = pages.withColumn("_rest", rest)
    out = out.withColumn("_host", F.regexp_extract("_rest", r"^[^/?#]*", 0))
    path = F.regexp_extract(F.expr("substring(_rest, length(_host) + 1)"), r"^[^?#]*", 0)
    return out.withColumns({"host": F.translate("_host", UPPER, LOWER), "path": path}).drop("_rest", "_host")


def rule_of(rules: tuple[Rule, ...], value) -> Column:
    """``value(rule)`` of the longest rule that fits host and path; else null."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        out = F.when(fits, F.lit(value(r))).otherwise(out)
    return out


def _suffix() -> Column:
    return F.element_at(F.split("host", r"\."), -1)


def _segment() -> Column:
    """The first segment of the path, with its slash; a slash alone without one."""
    return F.concat(F.lit("/"), F.regexp_extract("path", "^/([^/]*)", 1))


def with_features(parts: DataFrame, suffixes: dict[str, tuple[float, float]], other: tuple[float, float]) -> DataFrame:
    """``parts`` (with host and path) with the FEATURES columns, prefixed by _f_."""
    u = F.coalesce(F.col("url"), F.lit(""))
    size = F.length(u)
    count = lambda c, x: (size - F.length(F.replace(u, F.lit(x), F.lit("")))) if c is None else (F.length(c) - F.length(F.replace(c, F.lit(x), F.lit(""))))
    letters = F.array_distinct(F.split(u, ""))
    sums = F.aggregate(F.transform(letters, lambda x: (F.length(u) - F.length(F.replace(u, x, F.lit("")))).cast("double")), F.lit(0.0), lambda a, n: a + F.when(n > 0, n * F.ln(n)).otherwise(0.0))
    entropy = F.when(size > 0, F.ln(size.cast("double")) - sums / size).otherwise(0.0)
    query = F.regexp_extract(u, r"\?([^#]*)", 1)

    def stat(name: Column, k: int, segment: bool) -> Column:
        out = F.lit(float(other[k]))
        for known, values in suffixes.items():
            if known.startswith("/") == segment:
                out = F.when(name == known, F.lit(float(values[k]))).otherwise(out)
        return out

    values = {
        "url_length": size,
        "host_length": F.length("host"),
        "path_length": F.length("path"),
        "depth": count(F.col("path"), "/"),
        "labels": count(F.col("host"), ".") + F.when(F.col("host") != "", 1).otherwise(0),
        "digit_ratio": F.when(size > 0, (size - F.length(F.translate(u, "0123456789", ""))) / size).otherwise(0.0),
        "entropy": entropy,
        "parameters": count(query, "=") + count(query, "&"),
        "query_length": F.length(query),
        "hyphens": count(F.col("host"), "-"),
        "fragment": F.when(u.contains("#"), 1).otherwise(0),
        "suffix_share": stat(_suffix(), 0, False),
        "suffix_blocked": stat(_suffix(), 1, False),
        "segment_share": stat(_segment(), 0, True),
        "segment_blocked": stat(_segment(), 1, True),
    }
    return parts.withColumns({f"_f_{k}": v.cast("double") for k, v in values.items()})


@dataclass
class Tree:
    """A node (feature, threshold, left for <=, right) or a leaf (value)."""

    value: float = 0.0
    feature: int = -1
    threshold: float = 0.0
    left: Tree | None = None
    right: Tree | None = None

    def column(self) -> Column:
        if self.left is None or self.right is None:
            return F.lit(float(self.value))
        return F.when(F.col("_f_" + FEATURES[self.feature]) <= F.lit(float(self.threshold)), self.left.column()).otherwise(self.right.column())

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.left is None or self.right is None:
            return np.full(len(x), self.value)
        low = x[:, self.feature] <= self.threshold
        out = np.empty(len(x))
        out[low], out[~low] = self.left.predict(x[low]), self.right.predict(x[~low])
        return out


@dataclass
class Boosted:
    base: float = -4.0  # log-odds of blocking without labels
    trees: list[Tree] = field(default_factory=list)
    suffixes: dict[str, tuple[float, float]] = field(default_factory=dict)
    other: tuple[float, float] = (0.0, 0.5)

    def margin(self) -> Column:
        total = F.lit(float(self.base))
        for t in self.trees:
            total = total + t.column()
        return total


def grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, cuts: list[np.ndarray], depth: int, rate: float, least: float = 5.0, ridge: float = 1.0) -> Tree:
    """A tree by Newton gain over histogram cuts; ties go to the first feature and cut."""
    g, h = grad.sum(), hess.sum()
    leaf = Tree(value=float(-rate * g / (h + ridge)))
    if depth == 0 or len(x) < 2 * least:
        return leaf
    best, pick = 1e-6, None
    for f, cut in enumerate(cuts):
        if not len(cut):
            continue
        bin_ = np.searchsorted(cut, x[:, f], "left")
        gs, hs, ns = (np.cumsum(np.bincount(bin_, w, len(cut) + 1))[:-1] for w in (grad, hess, np.ones(len(x))))
        gain = gs**2 / (hs + ridge) + (g - gs) ** 2 / (h - hs + ridge) - g**2 / (h + ridge)
        gain[(ns < least) | (len(x) - ns < least)] = 0
        k = int(np.argmax(gain))
        if gain[k] > best + 1e-9:
            best, pick = gain[k], (f, float(cut[k]))
    if pick is None:
        return leaf
    low = x[:, pick[0]] <= pick[1]
    return Tree(0.0, *pick, grow(x[low], grad[low], hess[low], cuts, depth - 1, rate), grow(x[~low], grad[~low], hess[~low], cuts, depth - 1, rate))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 20, depth: int = 3, rate: float = 0.3, bins: int = 32) -> tuple[float, list[Tree]]:
    """(base, trees) of logistic boosting for labels 0 and 1."""
    share = np.clip(y.mean(), 0.02, 0.98)
    base = float(np.log(share / (1 - share)))
    # cuts lie halfway between neighbouring values, so that rounding can't move a row across
    cuts = []
    for f in range(x.shape[1]):
        v = np.unique(x[:, f])
        mid = (v[1:] + v[:-1]) / 2
        cuts.append(mid if len(mid) <= bins else mid[np.linspace(0, len(mid) - 1, bins).astype(int)])
    margin, out = np.full(len(y), base), []
    if y.min() == y.max():
        return base, out
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        out.append(grow(x, p - y, p * (1 - p), cuts, depth, rate))
        margin += out[-1].predict(x)
    return base, out


def train_trees(labelled: DataFrame, rows: int = TRAIN_ROWS) -> Boosted:
    """Fit on (url, blocked): at most ``rows`` distinct URLs, by the smallest hashes; blocked wins over not.

    Statistics (share among the sample, smoothed share of blocked ones) cover the
    ``MOST_SUFFIXES`` commonest last host labels, and as many first path segments;
    others share theirs.
    """
    known = labelled.where("url is not null and blocked is not null").select("url", (1 - F.col("blocked").cast("int")).alias("_allowed"))
    sample = with_parts(smallest(known, "url", rows).select("url", (1 - F.col("_allowed")).alias("blocked")))

    def stat(name: Column, k: int, segment: bool) -> Column:
        out = F.lit(float(other[k]))
        for known, values in suffixes.items():
            if known.startswith("/") == segment:
                out = F.when(name == known, F.lit(float(values[k]))).otherwise(out)
        return out

    values = {
        "url_length": size,
        "host_length": F.length("host"),
        "path_length": F.length("path"),
        "depth": count(F.col("path"), "/"),
        "labels": count(F.col("host"), ".") + F.when(F.col("host") != "", 1).otherwise(0),
        "digit_ratio": F.when(size > 0, (size - F.length(F.translate(u, "0123456789", ""))) / size).otherwise(0.0),
        "entropy": entropy,
        "parameters": count(query, "=") + count(query, "&"),
        "query_length": F.length(query),
        "hyphens": count(F.col("host"), "-"),
        "fragment": F.when(u.contains("#"), 1).otherwise(0),
        "suffix_share": stat(_suffix(), 0, False),
        "suffix_blocked": stat(_suffix(), 1, False),
        "segment_share": stat(_segment(), 0, True),
        "segment_blocked": stat(_segment(), 1, True),
    }
    return parts.withColumns({f"_f_{k}": v.cast("double") for k, v in values.items()})


@dataclass
class Tree:
    """A node (feature, threshold, left for <=, right) or a leaf (value)."""

    value: float = 0.0
    feature: int = -1
    threshold: float = 0.0
    left: Tree | None = None
    right: Tree | None = None

    def column(self) -> Column:
        if self.left is None or self.right is None:
            return F.lit(float(self.value))
        return F.when(F.col("_f_" + FEATURES[self.feature]) <= F.lit(float(self.threshold)), self.left.column()).otherwise(self.right.column())

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.left is None or self.right is None:
            return np.full(len(x), self.value)
        low = x[:, self.feature] <= self.threshold
        out = np.empty(len(x))
        out[low], out[~low] = self.left.predict(x[low]), self.right.predict(x[~low])
        return out


@dataclass
class Boosted:
    base: float = -4.0  # log-odds of blocking without labels
    trees: list[Tree] = field(default_factory=list)
    suffixes: dict[str, tuple[float, float]] = field(default_factory=dict)
    other: tuple[float, float] = (0.0, 0.5)

    def margin(self) -> Column:
        total = F.lit(float(self.base))
        for t in self.trees:
            total = total + t.column()
        return total


def grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, cuts: list[np.ndarray], depth: int, rate: float, least: float = 5.0, ridge: float = 1.0) -> Tree:
    """A tree by Newton gain over histogram cuts; ties go to the first feature and cut."""
    g, h = grad.sum(), hess.sum()
    leaf = Tree(value=float(-rate * g / (h + ridge)))
    if depth == 0 or len(x) < 2 * least:
        return leaf
    best, pick = 1e-6, None
    for f, cut in enumerate(cuts):
        if not len(cut):
            continue
        bin_ = np.searchsorted(cut, x[:, f], "left")
        gs, hs, ns = (np.cumsum(np.bincount(bin_, w, len(cut) + 1))[:-1] for w in (grad, hess, np.ones(len(x))))
        gain = gs**2 / (hs + ridge) + (g - gs) ** 2 / (h - hs + ridge) - g**2 / (h + ridge)
        gain[(ns < least) | (len(x) - ns < least)] = 0
        k = int(np.argmax(gain))
        if gain[k] > best + 1e-9:
            best, pick = gain[k], (f, float(cut[k]))
    if pick is None:
        return leaf
    low = x[:, pick[0]] <= pick[1]
    return Tree(0.0, *pick, grow(x[low], grad[low], hess[low], cuts, depth - 1, rate), grow(x[~low], grad[~low], hess[~low], cuts, depth - 1, rate))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 20, depth: int = 3, rate: float = 0.3, bins: int = 32) -> tuple[float, list[Tree]]:
    """(base, trees) of logistic boosting for labels 0 and 1."""
    share = np.clip(y.mean(), 0.02, 0.98)
    base = float(np.log(share / (1 - share)))
    # cuts lie halfway between neighbouring values, so that rounding can't move a row across
    cuts = []
    for f in range(x.shape[1]):
        v = np.unique(x[:, f])
        mid = (v[1:] + v[:-1]) / 2
        cuts.append(mid if len(mid) <= bins else mid[np.linspace(0, len(mid) - 1, bins).astype(int)])
    margin, out = np.full(len(y), base), []
    if y.min() == y.max():
        return base, out
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        out.append(grow(x, p - y, p * (1 - p), cuts, depth, rate))
        margin += out[-1].predict(x)
    return base, out


def train_trees(labelled: DataFrame, rows: int = TRAIN_ROWS) -> Boosted:
    """Fit on (url, blocked): at most ``rows`` distinct URLs, by the smallest hashes; blocked wins over not.

    Statistics (share among the sample, smoothed share of blocked ones) cover the
    ``MOST_SUFFIXES`` commonest last host labels, and as many first path segments;
    others share theirs.
    """
    known = labelled.where("url is not null and blocked is not null").groupBy("url").agg(F.max(F.col("blocked").cast("int")).alias("blocked"))
    sample = with_parts(known.orderBy(F.xxhash64("url"), "url").limit(rows))
    fields = [f"_f_{k}" for k in FEATURES]
    got = with_features(sample, {}, (0.0, 0.5)).select("url", "blocked", _suffix().alias("_suffix"), _segment().alias("_segment"), *fields).collect()
    if not got:
        return Boosted()
    got.sort(key=lambda r: r["url"])
    y = np.array([r["blocked"] for r in got], float)
    x = np.array([[r[f] for f in fields] for r in got], float)
    prior, other = 20.0, (0.0, float(y.mean()))
    suffixes: dict[str, tuple[float, float]] = {}
    for kind in ("suffix", "segment"):
        names = [r[f"_{kind}"] or "" for r in got]
        tally: dict[str, list[float]] = {}
        for name, blocked in zip(names, y):
            t = tally.setdefault(name, [0.0, 0.0])
            t[0] += 1
            t[1] += blocked
        for k in sorted(tally, key=lambda k: (-tally[k][0], k))[:MOST_SUFFIXES]:
            # a host without a name has no suffix; a suffix never begins with a slash
            if k:
                suffixes[k] = tally[k][0] / len(y), (tally[k][1] + prior * y.mean()) / (tally[k][0] + prior)
        for place, column in enumerate((f"{kind}_share", f"{kind}_blocked")):
            x[:, FEATURES.index(column)] = [suffixes.get(k, other)[place] for k in names]
    base, trees = boost(x, y)
    return Boosted(base, trees, suffixes, other)


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...], model: Boosted) -> DataFrame:
    """``pages`` with host, path, rule, verdict and score (the trees' share of blocking)."""
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "score")]
    # the given columns travel in a struct, so that none clashes with a feature
    out = with_features(with_parts(pages.select(F.struct(*keep).alias("_row"), "url")), model.suffixes, model.other)
    out = out.withColumns({"_margin": model.margin(), "rule": rule_of(rules, lambda r: r.name)})
    learnt = F.when(F.col("_margin") > 0, F.lit("block")).otherwise(F.lit("allow"))
    out = out.withColumns({"verdict": F.coalesce(rule_of(rules, lambda r: r.verdict), learnt), "score": 1 / (1 + F.exp(-F.col("_margin")))})
    judged = out.select("_row.*", "host", "path", "rule", "verdict", "score")
    # through a generator that gives each row once: a later filter isn't pushed below it with copies of all trees
    return judged.select(F.inline(F.array(F.struct(*judged.columns))))


def labelled_by_rules(pages: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(url, blocked) of all rows: blocked where a rule blocks, not where a rule allows or none fits."""
    out = with_parts(pages.select("url")).withColumn("_v", rule_of(rules, lambda r: r.verdict))
    return out.select("url", F.coalesce(F.col("_v") == "block", F.lit(False)).alias("blocked"))
