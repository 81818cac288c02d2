"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are counted over the whole text. Trees are grown on a bounded sample of
labelled rows from histograms of binned statistics, and flattened into arrays, which
numpy walks for all rows of a batch at once. The model is a few thousand numbers; scoring
is one pass without a shuffle.

Defined cases: null and empty texts have the statistics 0 and get a score like any
other; labels with a null id or mark are not learned from; a label, or a document, that is repeated
counts once, a document with the text of the smallest digest; without labels of both kinds every score is the share of good ones (0.5
without any); a null doc_id is not held out; empty tables give no rows; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from rowatlas.llm import scratch
from rowatlas.llm.sampling import smallest

#: Labelled rows that are learned from at most: those with the smallest hash of their id.
SAMPLE_ROWS = 20_000
TREES, DEPTH, BINS, RATE, LEAST_WEIGHT, RIDGE = 80, 4, 64, 0.15, 1.0, 1.0

STATISTICS = (
    "log_words", "mean_word", "unique_share", "top_word_share", "repeat_share", "upper_share", "digit_share", "stop_share",
    "comma_share", "exclaim_share", "bar_share", "symbol_share", "space_share", "wide_share", "mean_line", "repeated_lines", "long_word_share", "short_line_share",
)
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,!|'-"]] = True


def statistics(text: str) -> list[float]:
    """The numbers of STATISTICS for one whole text."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    size = float(raw.sum())
    counted = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    letters = max(1.0, float(raw[65:91].sum() + raw[97:123].sum()))
    share = lambda c: float(raw[ord(c)]) / n
    return [
        math.log1p(n), len(text) / n, len(counted) / n, counted.most_common(1)[0][1] / n, sum(map(eq, words, words[1:])) / n,
        float(raw[65:91].sum()) / letters, float(raw[48:58].sum()) / size, share("."), share(","), share("!"), share("|"),
        float(raw[_SYMBOLS].sum()) / n, float(raw[[9, 10, 13, 32]].sum()) / size, float(raw[128:].sum()) / size, n / max(1, len(lines)),
        1 - len(set(lines)) / max(1, len(lines)), sum(c for w, c in counted.items() if len(w) > 20) / n, sum(len(x) < 30 for x in lines) / max(1, len(lines)),
    ]


@dataclass
class Trees:
    """Flattened trees: node k goes left if x[feature[k]] <= cut[k]; leaves point to themselves."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(DEPTH):
                at = np.where(x[rows, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
            total += self.value[at]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosted trees for the logistic loss, grown level by level from histograms."""
    n, good = len(y), float(y.sum())
    none = np.empty(0, int)
    if not n or good in (0.0, float(n)):
        share = min(max(good / n, 1e-6), 1 - 1e-6) if n else 0.5
        return Trees(math.log(share / (1 - share)), none, np.empty(0), none, none, np.empty(0), none)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)])
    base = math.log(good / (n - good))
    out, feature, cut, left, right, value, roots = np.full(n, base), [], [], [], [], [], []

    def node() -> int:
        k = len(feature)
        for a, v in ((feature, 0), (cut, 0.0), (left, k), (right, k), (value, 0.0)):
            a.append(v)
        return k

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-out))
        g, h = y - p, p * (1 - p)
        at = np.zeros(n, int)  # place among the open nodes; -1: in a leaf
        open_, where = [node()], np.full(n, len(feature) - 1)
        roots.append(open_[0])
        for depth in range(DEPTH + 1):
            live = at >= 0
            G, H = (np.bincount(at[live], v[live], len(open_)) for v in (g, h))
            for k, node_id in enumerate(open_):
                value[node_id] = RATE * G[k] / (H[k] + RIDGE)
            if depth == DEPTH:
                break
            gain, pick = np.full(len(open_), 1e-6), [None] * len(open_)
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                cell = at[live] * (len(c) + 1) + binned[f][live]
                hg, hh = (np.bincount(cell, v[live], len(open_) * (len(c) + 1)).reshape(len(open_), -1).cumsum(1)[:, :-1] for v in (g, h))
                rg, rh = G[:, None] - hg, H[:, None] - hh
                win = hg**2 / (hh + RIDGE) + rg**2 / (rh + RIDGE) - (G**2 / (H + RIDGE))[:, None]
                win[(hh < LEAST_WEIGHT) | (rh < LEAST_WEIGHT)] = 0
                best = win.argmax(1)
                for k in np.nonzero(win[np.arange(len(open_)), best] > gain)[0]:
                    gain[k], pick[k] = win[k, best[k]], (f, best[k])
            grown, moved = [], np.full(n, -1)
            for k, node_id in enumerate(open_):
                if pick[k] is None:
                    continue
                f, b = pick[k]
                feature[node_id], cut[node_id], left[node_id], right[node_id] = f, cuts[f][b], node(), node()
                mine = at == k
                low = mine & (binned[f] <= b)
                moved[low], moved[mine & ~low] = len(grown), len(grown) + 1
                where[low], where[mine & ~low] = left[node_id], right[node_id]
                grown += [left[node_id], right[node_id]]
            at, open_ = moved, grown
            if not open_:
                break
        out = out + np.asarray(value)[where]
    return Trees(base, np.asarray(feature), np.asarray(cut), np.asarray(left), np.asarray(right), np.asarray(value), np.asarray(roots))


def held_out(doc_id: Column) -> Column:
    """True for ids whose CRC-32, as text, leaves 1 when divided by 3: never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = [statistics(t or "") for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("k"), b.column("quality"), b.column("d"), pa.array(x, pa.list_(pa.float64()))], ["k", "quality", "d", "x"])


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Trees:
    """Trees from the labelled documents that are not held out."""
    marks = labels.select(F.col("doc_id").cast("long").alias("k"), F.col("quality").cast("int").alias("quality")).where("k is not null and quality is not null").distinct()
    sample = smallest(marks.where(~held_out(F.col("k"))), F.xxhash64("k"), sample_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), F.col("doc_id") == F.col("k"))
    counted = texts.select("k", "quality", F.md5(F.coalesce("text", F.lit(""))).alias("d"), "text").mapInArrow(_counted, "k long, quality int, d string, x array<double>")
    # Of rows that repeat a labelled id, that with the smallest digest is learned from: what is gathered is bounded by the sample.
    rows = counted.groupBy("k", "quality").agg(F.min(F.struct("d", "x")).alias("m")).select("k", "quality", "m.x").toArrow()
    order = np.argsort(rows.column("k").to_numpy(), kind="stable")
    x = np.array(rows.column("x").to_pylist(), float).reshape(-1, len(STATISTICS))[order]
    y = rows.column("quality").to_numpy()[order].astype(float)
    same = np.lexsort([*x.T, y, np.sort(rows.column("k").to_numpy(), kind="stable")])  # repeated ids in any order give the same sums
    return fit(x[same], y[same])


def _scoring(trees: Trees):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                x = np.array([statistics(t or "") for t in b.column("text").to_pylist()], float).reshape(-1, len(STATISTICS))
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(b.num_columns)), pa.array(trees.score(x))], [*b.schema.names, "score"])
        scratch.give_back()

    return run


def score(docs: DataFrame, trees: Trees) -> DataFrame:
    """``docs`` (with a column text) and ``score``, higher where label 1 is likelier; a column of that name is replaced."""
    docs = docs.drop("score")
    schema = StructType([*docs.schema.fields, StructField("score", DoubleType())])
    return docs.mapInArrow(_scoring(trees), schema)
