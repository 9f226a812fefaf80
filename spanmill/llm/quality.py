"""Quality scores by a generalised additive model with pairwise interactions (operator 9).

Each feature is cut into ``BINS`` quantile bins. Training boosts cyclically: one
shallow tree (at most four leaves) per feature and round is fitted to the residual's
histogram and added, shrunk, to that feature's lookup table; then the pairs whose
joint histogram explains most of what remains get tables of their own. A score is
the logistic of the intercept plus one table entry per feature and pair, added up
for a block of rows at a time.

Training uses at most ``SAMPLE`` labelled rows, those with the least hash of their
id, so the choice depends on neither order nor partitioning; of several texts or labels
under one id the smallest text and the largest label count. A NULL text counts as empty;
without labels every score is 0.5, with one class it is that class's share, smoothed.
Texts of any length are read whole; equal texts get equal scores, repeated rows one each,
and an empty table an empty result. Columns may have any names.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanmill.llm.common import sealed

SAMPLE = 20_000
BINS, ROUNDS, PAIR_ROUNDS, PAIRS, PAIR_BINS, RATE = 32, 150, 60, 6, 8, 0.1
THRESHOLD = 0.3

FEATURES = [
    "chars", "words", "word_len", "word_len_sd", "distinct_words", "top_word", "lower", "upper", "digit", "space", "punct", "symbol", "top_mark", "mark_runs", "short_words",
    "line_len", "repeated_lines", "sentence_len", "capital_words", "word_entropy", "punct_words",
]

#: Kinds of code points: 0 other letter, 1 a-z, 2 upper case, 3 digit, 4 white space, 5 sentence punctuation, 6 other symbols.
_kinds = None


def _kind_table() -> np.ndarray:
    global _kinds
    if _kinds is None:
        t = np.full(0x110000, 6, np.uint8)
        for c in range(0x30000):
            s = chr(c)
            if s.isalpha():
                t[c] = 2 if s.isupper() else 1 if c < 0x250 else 0
            elif s.isdigit():
                t[c] = 3
            elif s.isspace():
                t[c] = 4
        for s in ".,;:?!'\"()-":
            t[ord(s)] = 5
        _kinds = t
    return _kinds


def features(text: str | None) -> np.ndarray:
    """The ``FEATURES`` of one text."""
    text = text or ""
    out = np.zeros(len(FEATURES))
    n = len(text)
    if not n:
        return out
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    kind = _kind_table()[codes]
    kinds = np.bincount(kind, minlength=7) / n
    mark = kind >= 5
    top_mark = np.bincount(np.minimum(codes[mark], 255), minlength=1).max() / n
    mark_runs = np.count_nonzero(mark[1:] & mark[:-1]) / n
    words = text.split()
    w = len(words)
    lens = np.fromiter(map(len, words), np.int64, w)
    counts = np.array(sorted(Counter(words).values(), reverse=True), float) if w else np.zeros(1)
    lines = [x for x in text.split("\n") if x.strip()]
    p = counts / max(w, 1)
    out[:] = [
        np.log1p(n), np.log1p(w), lens.mean() if w else 0, lens.std() if w else 0, len(counts) / w if w else 0, p[0], kinds[1] + kinds[0], kinds[2], kinds[3], kinds[4], kinds[5], kinds[6], top_mark, mark_runs, (lens <= 3).mean() if w else 0,
        np.log1p(n / max(1, len(lines))), 1 - len(set(lines)) / max(1, len(lines)), np.log1p(w / (1 + text.count(". ") + text.count(".\n"))), sum(map(str.istitle, words)) / max(w, 1), -(p * np.log(np.maximum(p, 1e-12))).sum() / np.log(max(w, 2)),
        sum(1 for x in words if not x[-1].isalnum()) / max(w, 1),
    ]
    return out


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2, l2: float = 1.0) -> np.ndarray:
    """Leaf values per bin of the best tree of ``depth`` on histograms of gradients and weights."""
    out = np.full(len(g), g.sum() / (h.sum() + l2))
    if depth == 0 or len(g) < 2:
        return out
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = gl**2 / (hl + l2) + (g.sum() - gl) ** 2 / (h.sum() - hl + l2)
    k = int(gain.argmax()) + 1
    if gain[k - 1] <= g.sum() ** 2 / (h.sum() + l2) + 1e-12:
        return out
    return np.concatenate((_tree(g[:k], h[:k], depth - 1, l2), _tree(g[k:], h[k:], depth - 1, l2)))


def _tree2(g: np.ndarray, h: np.ndarray, l2: float = 1.0) -> np.ndarray:
    """The same on a pair's grid: the better axis is split first, each half then along the other."""
    best = None
    for axis in (0, 1):
        a, b = (g, h) if axis == 0 else (g.T, h.T)
        gl, hl = np.cumsum(a.sum(1))[:-1], np.cumsum(b.sum(1))[:-1]
        gain = gl**2 / (hl + l2) + (a.sum() - gl) ** 2 / (b.sum() - hl + l2)
        if best is None or gain.max() > best[0]:
            best = (gain.max(), axis, int(gain.argmax()) + 1)
    _, axis, k = best
    a, b = (g, h) if axis == 0 else (g.T, h.T)
    out = np.empty_like(a)
    for part in (slice(0, k), slice(k, None)):
        out[part] = _tree(a[part].sum(0), b[part].sum(0), 1, l2)
    return out if axis == 0 else out.T


@dataclass
class Gam:
    intercept: float = 0.0
    edges: list = field(default_factory=list)
    tables: np.ndarray | None = None
    pair_edges: list = field(default_factory=list)
    pairs: list = field(default_factory=list)
    pair_tables: list = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Scores of a block of feature rows."""
        margin = np.full(len(x), self.intercept)
        if self.tables is not None:
            for k, e in enumerate(self.edges):
                margin += self.tables[k][np.searchsorted(e, x[:, k], side="right")]
            for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
                margin += t[np.searchsorted(self.pair_edges[i], x[:, i], side="right"), np.searchsorted(self.pair_edges[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(margin, -40, 40)))


def _quantiles(v: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(v, np.arange(1, bins) / bins))


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    """Cyclic boosting on features ``x`` and labels ``y`` (0 or 1)."""
    m = Gam()
    if not len(y):
        return m
    share = (y.sum() + 0.5) / (len(y) + 1)
    m.intercept = float(np.log(share / (1 - share)))
    if y.min() == y.max():
        return m
    f = x.shape[1]
    m.edges = [_quantiles(x[:, k], BINS) for k in range(f)]
    m.pair_edges = [_quantiles(x[:, k], PAIR_BINS) for k in range(f)]
    at = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(m.edges)]
    m.tables = np.zeros((f, BINS))
    margin = np.full(len(y), m.intercept)

    def state():
        p = 1 / (1 + np.exp(-margin))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(ROUNDS):
        for k in range(f):
            g, h = state()
            step = RATE * _tree(np.bincount(at[k], g, BINS), np.bincount(at[k], h, BINS))
            m.tables[k] += step
            margin += step[at[k]]
    coarse = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(m.pair_edges)]
    g, h = state()
    gains = []
    for i in range(f):
        for j in range(i + 1, f):
            cell = coarse[i] * PAIR_BINS + coarse[j]
            gg, hh = np.bincount(cell, g, PAIR_BINS**2), np.bincount(cell, h, PAIR_BINS**2)
            gains.append(((gg**2 / (hh + 1)).sum(), i, j))
    m.pairs = [(i, j) for _, i, j in sorted(gains, reverse=True)[:PAIRS]]
    m.pair_tables = [np.zeros((PAIR_BINS, PAIR_BINS)) for _ in m.pairs]
    for _ in range(PAIR_ROUNDS):
        for t, (i, j) in zip(m.pair_tables, m.pairs, strict=True):
            g, h = state()
            cell = coarse[i] * PAIR_BINS + coarse[j]
            step = RATE * _tree2(np.bincount(cell, g, PAIR_BINS**2).reshape(PAIR_BINS, -1), np.bincount(cell, h, PAIR_BINS**2).reshape(PAIR_BINS, -1))
            t += step
            margin += step[coarse[i], coarse[j]]
    return m


def _featured(batches):
    for batch in batches:
        for i in range(0, batch.num_rows, 500):
            part = batch.slice(i, 500)
            x = [features(t).tolist() for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Gam:
    """Fit on at most ``sample`` rows of ``labels`` (doc_id, ``label``) that have a document."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("_y"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # at most ``sample`` rows of two numbers
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    ys = {r[0]: r[1] for r in known.collect()}
    got = rows.mapInArrow(_featured, "doc_id bigint, x array<double>").collect()
    got.sort(key=lambda r: r[0])
    return fit(np.array([r[1] for r in got], float).reshape(len(got), len(FEATURES)), np.array([ys[r[0]] for r in got], float))


def score(docs: DataFrame, model: Gam, columns: list[str], text: str = "text") -> DataFrame:
    """``columns`` of every row with score."""
    df, names, (body,) = sealed(docs, columns, text)

    def scored(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                x = np.array([features(t) for t in part.column(body).to_pylist()]).reshape(part.num_rows, len(FEATURES))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(model.score(x))], [*names, "score"])

    return df.mapInArrow(scored, df.select(*names).schema.add("score", "double")).toDF(*columns, "score")
