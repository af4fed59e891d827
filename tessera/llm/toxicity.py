"""Toxicity scores by gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a text: densities of a fixed and of a learned lexicon, nearness of
second-person words to lexicon words, capitals, punctuation and obfuscation
rates. The learned lexicon (words, and word beginnings for inflected forms) and
the trees come from labelled rows; out-of-fold scores fit the calibration.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, fresh, give_back, id_crc, unit
from .tokens import steps

# Common insults and second-person words in English, German, French and Spanish.
INSULTS = frozenset("idiot idiots stupid moron morons dumb loser losers pathetic worthless trash garbage scum clown clowns disgusting fool fools jerk ugly hate shut liar idiotic imbecile bastard crap damn vermin filth idioten dumm dummkopf trottel arschloch abschaum widerlich versager lügner müll hässlich idiote stupide crétin imbécile connard salaud débile ordure minable dégoûtant menteur estúpido estúpida idiota imbécil tonto basura asqueroso patético mentiroso inútil payaso escoria".split())
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deiner ihr euch euer tu te toi ton ta tes vous votre vos tú ti tuyo usted ustedes vosotros tus".split())
LEET = str.maketrans("013457@$!|", "oieastasil")

NEAR = 5
STEM_LENGTHS = (4, 5, 6, 7)
FEATURES = ("words", "fixed_density", "fixed_count", "learned_density", "learned_count", "learned_kinds", "learned_top", "learned_mass", "stem_density", "stem_mass", "near_you", "you_density", "capitals", "all_caps", "exclaim", "question", "punctuation", "symbols", "mixed_words", "hidden_hits", "stretched", "variety")

_WORDS = re.compile(r"[^\W\d_]+")
_MIXED = re.compile(r"(?<!\S)[^\W\d_]+[0-9@$!|*#]+[^\W\d_]+(?!\S)")
_STRETCH = re.compile(r"([^\W\d_])\1\1")
_MARKS = re.compile(r"[^\w\s]")
_SYMBOLS = re.compile(r"[@#$%&*^~|<>]")


@dataclass
class Lexicon:
    """Learned weights (log-odds of the label) of words and of word beginnings."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)


def terms(text: str) -> set[tuple[bool, str]]:
    """What a text may teach the lexicon: (False, word) and (True, beginning)."""
    found: set[tuple[bool, str]] = set()
    for w in set(_WORDS.findall(text.lower())):
        if len(w) > 2:
            found.add((False, w))
        found.update((True, w[:n]) for n in STEM_LENGTHS if len(w) >= n)
    return found


def dense(text: str, lexicon: Lexicon) -> list[float]:
    """The features of a whole text, in the order of FEATURES; an empty text has zeros."""
    low = text.lower()
    words = _WORDS.findall(low)
    n = max(1, len(words))
    counts = Counter(words)
    fixed = sum(c for w, c in counts.items() if w in INSULTS)
    you = sum(c for w, c in counts.items() if w in SECOND_PERSON)
    lw, ls = lexicon.words, lexicon.stems
    hits = {w: lw[w] for w in counts if w in lw}
    learned = sum(counts[w] for w in hits)
    mass = sum(counts[w] * s for w, s in hits.items())
    stem_hits = stem_mass = 0.0
    if ls:
        for w, c in counts.items():
            s = max((ls.get(w[:k], 0.0) for k in STEM_LENGTHS if len(w) >= k), default=0.0)
            if s:
                stem_hits += c
                stem_mass += c * s
    near = 0
    if you and (fixed or learned):
        at_you = [i for i, w in enumerate(words) if w in SECOND_PERSON]
        for i, w in enumerate(words):
            if w in INSULTS or w in hits:
                j = bisect.bisect_left(at_you, i - NEAR)
                near += j < len(at_you) and at_you[j] <= i + NEAR
    letters = max(1, sum(map(len, words)))
    capitals = sum(map(str.isupper, text))
    mixed = _MIXED.findall(text)
    hidden = sum(1 for m in mixed if (d := re.sub(r"[^a-zß-ÿ]", "", m.lower().translate(LEET))) in INSULTS or d in lw)
    size = max(1, len(text))
    return [
        math.log1p(len(words)), fixed / n, math.log1p(fixed), learned / n, math.log1p(learned), math.log1p(len(hits)), max(hits.values(), default=0.0), mass / n,
        stem_hits / n, stem_mass / n, near / n, you / n, capitals / letters, sum(1 for w in text.split() if len(w) > 2 and w.isupper()) / n,
        text.count("!") / n, text.count("?") / n, len(_MARKS.findall(text)) / size, len(_SYMBOLS.findall(text)) / size, len(mixed) / n, hidden / n,
        len(_STRETCH.findall(low)) / n, len(counts) / n,
    ]


@dataclass
class Trees:
    """Boosted regression trees on logits; nodes as arrays (feature, threshold, left, right, value)."""

    base: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def logits(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, left, right, value in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(16):
                f = feature[node]
                if (f < 0).all():
                    break
                go = np.where(x[rows, np.maximum(f, 0)] <= threshold[node], left[node], right[node])
                node = np.where(f < 0, node, go)
            total += value[node]
        return total


def boost(x: np.ndarray, y: np.ndarray, *, rounds: int = 120, depth: int = 3, rate: float = 0.1, bins: int = 48, leaf: int = 10, ridge: float = 1.0) -> Trees:
    """Second-order boosting of logistic loss over histograms of quantile bins."""
    prior = min(max(float(y.mean()) if len(y) else 0.0, 1e-3), 1 - 1e-3)
    base = math.log(prior / (1 - prior))
    if len(y) < 4 * leaf or y.min() == y.max():
        return Trees(base, [])
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    offset = binned + np.arange(x.shape[1]) * bins
    logit, trees = np.full(len(y), base), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-logit))
        g, h = y - p, p * (1 - p)
        nodes: list[list[float]] = []

        def grow(rows: np.ndarray, level: int) -> int:
            me = len(nodes)
            gs, hs = g[rows].sum(), h[rows].sum()  # noqa: B023
            nodes.append([-1, 0.0, me, me, rate * gs / (hs + ridge)])  # noqa: B023
            if level == depth or len(rows) < 2 * leaf:
                return me
            flat = offset[rows].ravel()
            width = x.shape[1]
            hist = lambda v: np.bincount(flat, np.repeat(v, width), minlength=width * bins).reshape(width, bins).cumsum(1)
            gl, hl, nl = hist(g[rows]), hist(h[rows]), hist(np.ones(len(rows)))  # noqa: B023
            gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
            gain[(nl < leaf) | (len(rows) - nl < leaf)] = -1
            j, b = divmod(int(gain.argmax()), bins)
            if gain[j, b] <= 1e-6 or b >= len(edges[j]):
                return me
            left = binned[rows, j] <= b
            nodes[me][0], nodes[me][1] = j, float(edges[j][b])
            nodes[me][2] = grow(rows[left], level + 1)
            nodes[me][3] = grow(rows[~left], level + 1)
            return me

        grow(np.arange(len(y)), 0)
        a = np.array(nodes)
        tree = (a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4])
        trees.append(tree)
        logit += Trees(0.0, [tree]).logits(x)
    return Trees(base, trees)


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: thresholds and levels of the best non-decreasing fit."""
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []  # sum, count, upper end
    for r, v in zip(raw[order], y[order], strict=True):
        blocks.append([float(v), 1.0, float(r)])
        while len(blocks) > 1 and (blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1] or blocks[-2][2] == blocks[-1][2]):
            s, c, end = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + c, end]
    return np.array([b[2] for b in blocks]), np.array([(b[0] + 0.5 * 0.1) / (b[1] + 0.1) for b in blocks])


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees
    ends: np.ndarray
    levels: np.ndarray

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        raw = self.trees.logits(np.array([dense(t or "", self.lexicon) for t in texts]))
        plain = 1 / (1 + np.exp(-raw))
        if not len(self.ends):
            return plain
        # The calibrated level; a millionth of the raw score orders texts of one level.
        level = np.interp(raw, self.ends, np.maximum.accumulate(self.levels))
        return np.clip(level + 1e-6 * (plain - level), 0.0, 1.0)


def _lexicon(counts: DataFrame, folds: tuple[int, ...], totals: dict, most: int) -> Lexicon:
    """The ``most`` terms with the surest excess among toxic rows: at least 4 of them, by lower bound of the log-odds."""
    total = lambda label: sum(totals[f"{label}{f}"] for f in folds) + 1
    toxic, clean = (sum((F.col(f"{label}{f}") for f in folds), F.lit(0)) + 0.5 for label in ("toxic", "clean"))
    sure = F.ln(toxic / total("toxic")) - F.ln(clean / total("clean")) - 1.64 * F.sqrt(1 / toxic + 1 / clean)
    best = counts.filter(F.col("term").isNotNull() & (toxic > 4)).select("stem", "term", sure.alias("sure")).filter(F.col("sure") > 0.7)
    out = Lexicon()
    for r in best.orderBy(F.col("sure").desc(), "stem", "term").limit(most).collect():
        (out.stems if r["stem"] else out.words)[r["term"]] = r["sure"]
    return out


def train(labelled: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = 12_000, lexicon_size: int = 3000, seed: int = 2) -> Model:
    """Fit the model to rows of (key, text, label).

    ``max_rows`` bounds the rows that are learned from, give or take the chance
    of a draw by a seeded hash of the key, and ``lexicon_size`` the learned terms; rows without a label are left out. Without rows of both labels
    the score is the share of label 1, or 0.5 without any row.
    """
    rows = labelled.filter(F.col(label).isNotNull()).select(F.col(key).alias("k"), F.coalesce(text, F.lit("")).alias("t"), F.col(label).cast("int").alias("y"))
    n = rows.count()
    if n == 0:
        return Model(Lexicon(), Trees(0.0, []), np.zeros(0), np.zeros(0))
    draw = F.xxhash64(F.lit(seed), "k")
    rows = rows.filter(unit(draw) < min(1.0, max_rows / n)).withColumn("fold", F.pmod(F.xxhash64(F.lit(seed + 1), "k"), F.lit(2)).cast("int"))

    def teach(batches):  # noqa: ANN001, ANN202
        seen: dict[tuple[int, bool, str], list[int]] = {}
        totals = {(f, y): 0 for f in (0, 1) for y in (0, 1)}
        for b in batches:
            for t, y, f in zip(b.column("t").to_pylist(), b.column("y").to_pylist(), b.column("fold").to_pylist(), strict=True):
                totals[f, int(y == 1)] += 1
                for stem, term in terms(t):
                    seen.setdefault((f, stem, term), [0, 0])[int(y == 1)] += 1
        out = [(f, s, w, c[1], c[0]) for (f, s, w), c in seen.items()] + [(f, None, None, totals[f, 1], totals[f, 0]) for f in (0, 1)]
        cols = list(zip(*out, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.bool_(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["fold", "stem", "term", "toxic", "clean"])

    counted = rows.mapInArrow(teach, "fold int, stem boolean, term string, toxic long, clean long").groupBy("stem", "term")
    per = counted.agg(*[F.sum(F.when(F.col("fold") == f, F.col(c)).otherwise(0)).alias(f"{c}{f}") for f in (0, 1) for c in ("toxic", "clean")])
    per = cut(per.filter(F.col("term").isNull() | (F.col("toxic0") + F.col("toxic1") >= 4)), "toxicity-terms")
    totals = per.filter(F.col("term").isNull()).first().asDict()
    other = {0: _lexicon(per, (1,), totals, lexicon_size), 1: _lexicon(per, (0,), totals, lexicon_size)}
    final = _lexicon(per, (0, 1), totals, lexicon_size)

    def measure(batches):  # noqa: ANN001, ANN202
        for b in batches:
            folds = b.column("fold").to_pylist()
            x = [dense(t, other[f]) for t, f in zip(b.column("t").to_pylist(), folds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("k").cast(pa.string()), b.column("y"), pa.array(x, pa.list_(pa.float64()))], names=["k", "y", "x"])
            give_back()

    table = rows.mapInArrow(measure, "k string, y int, x array<double>").toArrow().sort_by("k")
    y = (table.column("y").to_numpy() == 1).astype(float)
    x = np.array(table.column("x").to_pylist(), dtype=float).reshape(len(y), -1)
    part = np.random.default_rng(seed).integers(0, 4, len(y))
    held = np.zeros(len(y))
    for p in range(4):
        if (part == p).any():
            held[part == p] = boost(x[part != p], y[part != p]).logits(x[part == p])
    ends, levels = isotonic(held, y) if len(y) and y.min() != y.max() else (np.zeros(0), np.zeros(0))
    return Model(final, boost(x, y), ends, levels)


def score(df: DataFrame, model: Model, *, text: str = "text", name: str = "score") -> DataFrame:
    """Every row of ``df`` with ``name``, the calibrated probability of label 1 of its whole text.

    Null and empty texts get the score of a text without words. Repeated rows
    stay and score alike; an input column called ``name`` is replaced; an empty
    table gives an empty result.
    """
    rows = fresh(df, name)
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            scores = [model.scores(b.column(text).slice(a, z - a).to_pylist()) for a, z in steps(b.column(text))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(scores) if scores else np.zeros(0))], names=[*b.schema.names, name])

    return rows.mapInArrow(run, schema)


def train_on_tables(documents: DataFrame, labels: DataFrame) -> Model:
    """The model of the query and of the pipeline: labels of rows whose id's crc32 isn't divisible by 5."""
    known = labels.filter((id_crc(F.col("doc_id")) % 5 != 0) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return train(documents.select("doc_id", "text").join(known, "doc_id"))


def toxicity_digest(documents: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(documents.select("doc_id", "text"), train_on_tables(documents, labels))
    return scored.select("doc_id", (id_crc(F.col("doc_id")) % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
