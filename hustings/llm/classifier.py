"""Quality classifier: a generalised additive model with pairwise interactions.

Features of a text are cut into bins by quantiles. Cyclic boosting visits one feature after another and adds a
shallow tree over its bins to that feature's lookup table, many rounds at a small rate; then the pairs of
features whose joint bins still explain most of the residual get tables of their own. A score is a sum of table
entries, so scoring is one vectorised lookup and addition for each table.

The model is fitted on at most ``MAX_TRAIN`` labelled rows, the ones with the smallest id hash. Features come from
the text alone. Cases: null and empty texts have features (zeros) and get a score; labels that disagree on an id
count by their mean; without labelled rows every score is 0.5; repeated rows score alike; an empty table gives no
rows; further columns are ignored by ``score`` and kept by ``keep_good``.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, slices

#: Most labelled rows the model is fitted on; their features are all that reaches the driver (about 3 MB).
MAX_TRAIN = 20_000
THRESHOLD = 0.3

# Frequent function words of English, German, French and Spanish.
STOP = frozenset(
    """the of and to in a is that for it as was with be by on not he his are at this have from or an they which
    der die das und ist nicht mit von zu den ein eine im auf für als auch sich dem des
    le la les et est des un une que dans pour qui sur par pas au aux en du
    el los las y es por con para una del se lo como su al de""".split()
)
_UPPER, _LOWER, _DIGIT, _SPACE, _SYMBOL, _PUNCT, _WIDE = range(7)
_CLASS = np.full(256, _PUNCT)
_CLASS[128:] = _WIDE
for _lo, _hi, _k in ((65, 90, _UPPER), (97, 122, _LOWER), (48, 57, _DIGIT), (9, 13, _SPACE), (32, 32, _SPACE)):
    _CLASS[_lo : _hi + 1] = _k
_CLASS[list(b"#%*$&|<>{}[]=_~^@\\+/")] = _SYMBOL

FEATURES = (
    "log_chars", "word_length", "stop_share", "upper_share", "digit_share", "symbol_share", "punct_share", "pipe_share", "bang_share",
    "distinct_words", "top_word", "adjacent_repeats", "log_lines", "log_line_length", "repeated_lines", "ended_lines", "longest_word", "dressed_words",
)


def features(text: str) -> list[float]:
    raw = np.frombuffer(text.encode(), np.uint8)
    by_byte = np.bincount(raw, minlength=256)
    by_class = np.bincount(_CLASS, by_byte, 7)
    chars = max(len(text), 1)
    letters = max(by_class[_UPPER] + by_class[_LOWER], 1)
    words = text.split()
    n = max(len(words), 1)
    seen = Counter(words)
    lines = [x for x in text.split("\n") if x]
    m = max(len(lines), 1)
    return [
        math.log1p(len(text)),
        (len(text) - by_class[_SPACE]) / n,
        sum(c for w, c in seen.items() if w.lower().strip(".,;:!?") in STOP) / n,
        by_class[_UPPER] / letters,
        by_class[_DIGIT] / chars,
        by_class[_SYMBOL] / chars,
        by_class[_PUNCT] / chars,
        by_byte[124] / n,
        by_byte[33] / n,
        len(seen) / n,
        max(seen.values(), default=0) / n,
        sum(map(str.__eq__, words, words[1:])) / n,
        math.log1p(len(lines)),
        math.log1p(len(text) / m),
        1 - len(set(lines)) / m if lines else 0.0,
        sum(x[-1] in ".!?" for x in lines) / m,
        math.log1p(max(map(len, seen), default=0)),
        sum(c for w, c in seen.items() if not w.rstrip(".,;:!?").isalpha()) / n,
    ]


def _leaf(g: float, h: float, l2: float) -> float:
    return g / (h + l2)


def shallow_tree(g: np.ndarray, h: np.ndarray, depth: int = 2, l2: float = 5.0) -> np.ndarray:
    """Leaf value for each bin of a tree of ``depth`` cuts over ordered bins with gradients g and curvatures h."""
    out = np.full(len(g), _leaf(g.sum(), h.sum(), l2))
    if depth == 0 or len(g) < 2:
        return out
    gl, hl = g.cumsum()[:-1], h.cumsum()[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + l2) + gr**2 / (hr + l2) - g.sum() ** 2 / (h.sum() + l2)
    cut = int(gain.argmax()) + 1
    if gain[cut - 1] <= 1e-9:
        return out
    out[:cut] = shallow_tree(g[:cut], h[:cut], depth - 1, l2)
    out[cut:] = shallow_tree(g[cut:], h[cut:], depth - 1, l2)
    return out


def pair_tree(g: np.ndarray, h: np.ndarray, l2: float = 5.0) -> np.ndarray:
    """As above for a grid: the best cut of one axis, then each part cut along the other axis."""
    best, best_gain = None, 0.0
    for flip in (False, True):
        a, b = (g.T, h.T) if flip else (g, h)
        for cut in range(1, a.shape[0]):
            parts, gain = [], 0.0
            for rows in (slice(0, cut), slice(cut, None)):
                leaf = shallow_tree(a[rows].sum(0), b[rows].sum(0), 1, l2)
                gain += float((leaf * a[rows].sum(0)).sum())
                parts.append(np.broadcast_to(leaf, a[rows].shape))
            if gain > best_gain:
                best_gain, tree = gain, np.concatenate(parts)
                best = tree.T if flip else tree
    return np.zeros_like(g) if best is None else best


def _bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(edges)], 1) if len(x) else np.zeros((0, len(edges)), int)


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.1, bins: int = 32, pairs: int = 6, pair_rounds: int = 40, coarse: int = 8) -> dict:
    """Lookup tables for features ``x`` (rows by features) and labels ``y`` (0 to 1)."""
    k = x.shape[1] if x.ndim == 2 else len(FEATURES)
    model: dict = {"base": 0.0, "edges": [np.zeros(0)] * k, "tables": [np.zeros(1)] * k, "coarse": [np.zeros(0)] * k, "pairs": []}
    if not len(y):
        return model
    cuts = lambda c, n: np.unique(np.quantile(c, np.linspace(0, 1, n + 1)[1:-1]))
    model["edges"], model["coarse"] = [cuts(x[:, f], bins) for f in range(k)], [cuts(x[:, f], coarse) for f in range(k)]
    share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    model["base"] = math.log(share / (1 - share))
    fine, rough = _bins(x, model["edges"]), _bins(x, model["coarse"])
    sizes, margin = [len(e) + 1 for e in model["edges"]], np.full(len(y), model["base"])
    model["tables"] = [np.zeros(n) for n in sizes]

    def slope() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for f in range(k):
            g, h = slope()
            step = rate * shallow_tree(np.bincount(fine[:, f], g, sizes[f]), np.bincount(fine[:, f], h, sizes[f]))
            model["tables"][f] += step
            margin += step[fine[:, f]]
    shape = [len(e) + 1 for e in model["coarse"]]
    cell = lambda a, b: rough[:, a] * shape[b] + rough[:, b]
    grid = lambda a, b, v: np.bincount(cell(a, b), v, shape[a] * shape[b]).reshape(shape[a], shape[b])
    g, h = slope()
    ranked = sorted(combinations(range(k), 2), key=lambda ab: -float((grid(*ab, g) ** 2 / (grid(*ab, h) + 5)).sum()))[:pairs]
    tables = {ab: np.zeros((shape[ab[0]], shape[ab[1]])) for ab in ranked}
    for _ in range(pair_rounds):
        for (a, b), t in tables.items():
            g, h = slope()
            step = rate * pair_tree(grid(a, b, g), grid(a, b, h))
            t += step
            margin += step[rough[:, a], rough[:, b]]
    model["pairs"] = list(tables.items())
    return model


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    """Scores (0 to 1): bins, then one lookup and addition for each table."""
    if not len(x):
        return np.zeros(0)
    fine, rough = _bins(x, model["edges"]), _bins(x, model["coarse"])
    margin = np.full(len(x), model["base"])
    for f, t in enumerate(model["tables"]):
        margin += t[fine[:, f]]
    for (a, b), t in model["pairs"]:
        margin += t[rough[:, a], rough[:, b]]
    return 1 / (1 + np.exp(-margin))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def feature_rows(docs: DataFrame) -> DataFrame:
    """doc_id and the array ``x`` of its text's features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = [features(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, "doc_id long, x array<double>")


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN, **options) -> dict:
    """Fit on at most ``max_rows`` labelled ids outside the held-out fifth."""
    chosen = (
        labels.where(~held_out(F.col("doc_id")) & F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    )
    rows = pick(docs, ("doc_id", "text")).join(F.broadcast(chosen.select("doc_id")), "doc_id")
    known = feature_rows(rows).groupBy("doc_id").agg(F.min("x").alias("x")).join(F.broadcast(chosen), "doc_id")
    got = known.orderBy("doc_id").toPandas()
    x = np.array(got["x"].tolist(), float) if len(got) else np.zeros((0, len(FEATURES)))
    return fit(x, got["label"].to_numpy(float), **options)


def score(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            s = predict(model, np.array([features(t or "") for t in batch.column("text").to_pylist()], float))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= threshold).astype("int32"))], names=["doc_id", "held_out", "score", "predicted"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return narrow.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose score reaches ``threshold``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            s = predict(model, np.array([features(t or "") for t in batch.column("text").to_pylist()], float))
            yield batch.filter(pa.array(s >= threshold))

    return docs.mapInArrow(run, docs.schema)
