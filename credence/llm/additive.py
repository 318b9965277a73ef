"""Text quality by a generalised additive model with pairwise interactions.

The score of a text is a sum of numbers looked up by bin: one for each feature, one for each of some pairs of features. The tables are
learned by cyclic boosting: feature after feature, round after round, a tree of three leaves is fitted to what the sum still leaves
and added to that feature's table alone. Then the pairs that explain most of the rest get tables of their own in the same way.

Spark runs several bags side by side: rows are dealt into as many folds, each bag learns from all folds but one and stops where
that one gets worse; the model is the mean of the bags' tables. Texts are read once, into a table of features. Scoring is bin lookup
and addition over arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents_of, hashed_words, mixed, new_dir, stored, text_steps

#: What a text is measured by, in order.
FEATURES = (
    "log_words", "log_lines", "word_bytes", "word_bytes_spread", "short_words", "long_words", "distinct_words", "top_word", "repeat_windows", "repeat_lines",
    "line_words", "upper", "digits", "symbols", "marks", "non_ascii", "space", "marked_words", "upper_words", "byte_entropy",
)

#: Classes of bytes: capital letters, digits, symbols, marks of sentences.
_CLASSES = np.zeros((5, 256))
_CLASSES[0, 65:91] = 1
_CLASSES[1, 48:58] = 1
_CLASSES[2, [ord(c) for c in "#*$%&|<>{}[]=_~^@\\/+"]] = 1
_CLASSES[3, [ord(c) for c in ".,!?;:"]] = 1
_CLASSES[4, 128:] = 1


def _by_group(row: np.ndarray, h: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(different h, the most of one h, how many stand in an h that comes again) by row, and whether each entry's h comes again."""
    order = np.lexsort((h, row))
    r, g = row[order], h[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (r[1:] != r[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(g)))
    most = np.zeros(rows, np.int64)
    np.maximum.at(most, r[first], size)
    again = np.zeros(len(h), bool)
    again[order] = np.repeat(size > 1, size)
    return np.bincount(r[first], minlength=rows), most, np.bincount(row[again], minlength=rows), again


def measured(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The features of the texts that data holds one after the other, a row each; all are zero for a text without words."""
    rows = len(offsets) - 1
    out = np.zeros((rows, len(FEATURES)))
    h, row, first, end = hashed_words(data, offsets, fold=True)
    if not len(h):
        return out.astype(np.float32)
    size = np.diff(offsets)
    owner = np.repeat(np.arange(rows), size)
    histogram = np.bincount(owner * 256 + data, minlength=rows * 256).reshape(rows, 256)
    n = np.bincount(row, minlength=rows)
    length = (end - first).astype(float)
    sums = lambda x: np.bincount(row, x, rows)
    per_word = 1 / np.maximum(n, 1)
    mean = sums(length) * per_word
    distinct, most, _, _ = _by_group(row, h, rows)
    # windows of three words, and the words that stand in one that comes again
    covered = np.zeros(len(h), bool)
    if len(h) > 2:
        whole = row[2:] == row[:-2]
        g = mixed(h[:-2] + h[1:-1] * np.uint64(0x9E3779B97F4A7C15) + h[2:] * np.uint64(0xC2B2AE3D27D4EB4F))[whole]
        at = np.flatnonzero(whole)[_by_group(row[:-2][whole], g, rows)[3]]
        for k in range(3):
            covered[at + k] = True
    # lines with words: hashed by their words and these words' places
    breaks = np.concatenate([[0], np.cumsum(data == 10)])
    line = breaks[first] + row  # a text begins a line
    starts = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
    place = np.arange(len(h)) - np.repeat(starts, np.diff(np.append(starts, len(h))))
    line_hash = np.add.reduceat(mixed(h + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), starts)
    line_row = row[starts]
    lines = np.bincount(line_row, minlength=rows)
    different = _by_group(line_row, line_hash, rows)[0]
    last = data[end - 1]
    heads = data[first]
    capital = (heads >= 65) & (heads <= 90) & (np.add.reduceat(((data >= 65) & (data <= 90)).astype(np.int64), first) > 1)
    classes = histogram @ _CLASSES.T
    per_byte = 1 / np.maximum(histogram.sum(1), 1)
    share = histogram * per_byte[:, None]
    spaces = histogram[:, 32] + histogram[:, 9:14].sum(1)
    columns = [
        np.log2(1 + n), np.log2(1 + lines), mean, np.sqrt(np.maximum(0, sums(length**2) * per_word - mean**2)), sums(length <= 3) * per_word, sums(length > 10) * per_word,
        distinct * per_word, most * per_word, sums(covered) * per_word, 1 - different / np.maximum(lines, 1),
        n / np.maximum(lines, 1), *(classes[:, k] * per_byte for k in (0, 1, 2, 3, 4)), spaces * per_byte,
        sums(_CLASSES[2, last] + _CLASSES[3, last]) * per_word, sums(capital) * per_word, -(share * np.log2(np.where(share > 0, share, 1))).sum(1),
    ]
    out[:] = np.stack(columns, 1)
    return np.where(n[:, None] > 0, out, 0).astype(np.float32)


def features(docs: DataFrame) -> DataFrame:
    """doc_id and the features of every whole text of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_steps(batch.column(1)):
                yield pa.record_batch([batch.column(0).slice(a, b - a), *(pa.array(c) for c in measured(data, offsets).T)], ["doc_id", *FEATURES])

    return documents_of(docs).mapInArrow(run, "doc_id long, " + ", ".join(f"{f} float" for f in FEATURES))


@dataclass
class Settings:
    """bins, pair_bins: of a feature alone, and in a pair. rows: labelled rows to learn from, about; of more, a share is drawn by hash."""

    bins: int = 64
    pair_bins: int = 12
    pairs: int = 10
    bags: int = 5
    rounds: int = 250
    rate: float = 0.15
    ridge: float = 1.0
    least: float = 1.0
    patience: int = 25
    rows: int = 100_000


@dataclass
class Model:
    """cuts: ascending ends of each feature's bins. tables: log-odds by bin; pairs: two features, and log-odds by both coarse bins."""

    base: float
    cuts: list[np.ndarray]
    coarse: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def binned(self, x: np.ndarray, coarse: bool = False) -> np.ndarray:
        return np.stack([np.searchsorted(c, v, side="left") for c, v in zip(self.coarse if coarse else self.cuts, x.T, strict=True)])

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        fine, coarse = self.binned(x), self.binned(x, True)
        out = np.full(len(x), self.base)
        for t, b in zip(self.tables, fine, strict=True):
            out += t[b]
        for i, j, t in self.pairs:
            out += t[coarse[i], coarse[j]]
        return out


def _gain(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    return g * g / (h + ridge)


def best_cut(g: np.ndarray, h: np.ndarray, s: Settings) -> tuple[float, int]:
    """What the best cut of bins in two wins, and the first bin right of it; 0 where both sides can't hold enough."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    right_g, right_h = g.sum() - left_g, h.sum() - left_h
    won = _gain(left_g, left_h, s.ridge) + _gain(right_g, right_h, s.ridge) - _gain(g.sum(), h.sum(), s.ridge)
    won = np.where((left_h >= s.least) & (right_h >= s.least), won, 0)
    k = int(won.argmax()) if len(won) else 0
    return (float(won[k]), k + 1) if len(won) and won[k] > 1e-9 else (0.0, 0)


def shallow(g: np.ndarray, h: np.ndarray, s: Settings) -> np.ndarray:
    """A tree of three leaves over ordered bins: the best cut, then the better one of its sides' best cuts."""
    won, k = best_cut(g, h, s)
    out = np.zeros(len(g))
    if not k:
        return out
    parts = [(0, k), (k, len(g))]
    inner = [best_cut(g[a:b], h[a:b], s) for a, b in parts]
    best = max(range(2), key=lambda i: inner[i][0])
    if inner[best][1]:
        a, b = parts[best]
        parts[best : best + 1] = [(a, a + inner[best][1]), (a + inner[best][1], b)]
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + s.ridge)
    return out


def crossed(g: np.ndarray, h: np.ndarray, s: Settings) -> tuple[float, np.ndarray]:
    """A tree over two features' bins: a cut of the first, then a cut of the second on each side. What it wins, and its leaves by cell."""
    best, out = 0.0, np.zeros(g.shape)
    for flip in (False, True):
        a, b = (g.T, h.T) if flip else (g, h)
        for k in range(1, len(a)):
            sides = [(a[:k].sum(0), b[:k].sum(0)), (a[k:].sum(0), b[k:].sum(0))]
            if min(y.sum() for _, y in sides) < s.least:
                continue
            cuts = [best_cut(x, y, s) for x, y in sides]
            won = sum(w for w, _ in cuts) + sum(float(_gain(x.sum(), y.sum(), s.ridge)) for x, y in sides) - float(_gain(a.sum(), b.sum(), s.ridge))
            if won > best + 1e-9:
                best, leaves = won, np.zeros(a.shape)
                for rows, (x, y), (_, c) in zip((slice(0, k), slice(k, None)), sides, cuts, strict=True):
                    for cells in (slice(0, c), slice(c, None)) if c else (slice(0, None),):
                        leaves[rows, cells] = x[cells].sum() / (y[cells].sum() + s.ridge)
                out = leaves.T if flip else leaves
    return best, out


def _loss(y: np.ndarray, score: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, score) - y * score)) if len(y) else 0.0


def boosted(y: np.ndarray, learn: np.ndarray, score: np.ndarray, cells: list[np.ndarray], shapes: list[tuple[int, ...]], s: Settings) -> list[np.ndarray]:
    """Cyclic boosting: round by round, a tree for each table in turn, until the rows that aren't learned from have got no better for a while."""
    tables, best = [np.zeros(n) for n in shapes], None
    score, kept, since = score.copy(), [np.zeros(n) for n in shapes], 0
    best = _loss(y[~learn], score[~learn])
    own = y[learn]
    inside = [c[learn] for c in cells]
    for _ in range(s.rounds):
        for t, (cell, shape) in enumerate(zip(cells, shapes, strict=True)):
            p = 1 / (1 + np.exp(-score[learn]))
            g, h = (np.bincount(inside[t], w, int(np.prod(shape))).reshape(shape) for w in (own - p, p * (1 - p)))
            step = s.rate * (shallow(g, h, s) if len(shape) == 1 else crossed(g, h, s)[1])
            tables[t] += step
            score += step.reshape(-1)[cell]
        now = _loss(y[~learn], score[~learn])
        if now < best - 1e-7 or not (~learn).any():
            best, since, kept = now, 0, [t.copy() for t in tables]
        else:
            since += 1
        if since >= s.patience:
            break
    return kept


def _bag(rows: pd.DataFrame, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, targets and which rows to learn from, in a defined order."""
    rows = rows.sort_values(["fold", "doc_id", *FEATURES, "y"], kind="stable")
    return rows[list(FEATURES)].to_numpy(np.float32), rows["y"].to_numpy(float), (rows["fold"] != rows["bag"]).to_numpy()


def cuts_of(training: DataFrame, bins: int) -> list[np.ndarray]:
    """The different quantiles of each feature over all training rows, one aggregation."""
    shares = [k / bins for k in range(1, bins)]
    row = training.agg(*(F.percentile_approx(f, shares, 20 * bins).alias(f) for f in FEATURES)).first()
    return [np.unique(np.array(row[f] or [], np.float32)) for f in FEATURES]


def fit(rows: DataFrame, s: Settings | None = None) -> Model:
    """Learn from rows (doc_id, features, y from 0 to 1). A bag is one task of at most about s.rows rows of a few numbers each."""
    s = s or Settings()
    n, total = rows.agg(F.count("y"), F.sum("y")).first()
    total = total or 0.0
    base = float(np.log((total + 1) / (n - total + 1)))
    model = Model(base, cuts_of(rows, s.bins), cuts_of(rows, s.pair_bins), [])
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    if n < 2 * s.bags or total in (0, n):
        return model
    pick = F.xxhash64(F.lit("row"), "doc_id", *FEATURES)
    drawn = rows.filter(F.pmod(pick, F.lit(1 << 20)) < int(min(1.0, s.rows / n) * (1 << 20)))
    fold = F.pmod(F.xxhash64(F.lit("fold"), "doc_id", *FEATURES), F.lit(s.bags)).cast("int")
    bags = drawn.withColumn("fold", fold).withColumn("bag", F.explode(F.sequence(F.lit(0), F.lit(s.bags - 1))))
    sizes = [(len(c) + 1,) for c in model.cuts]
    every = list(combinations(range(len(FEATURES)), 2))

    def mains(bag: pd.DataFrame) -> pd.DataFrame:
        x, y, learn = _bag(bag, s)
        fine, coarse = model.binned(x), model.binned(x, True)
        tables = boosted(y, learn, np.full(len(y), base), list(fine), sizes, s)
        score = base + sum(t[b] for t, b in zip(tables, fine, strict=True))
        p = 1 / (1 + np.exp(-score[learn]))
        gains = []
        for i, j in every:
            shape = (len(model.coarse[i]) + 1, len(model.coarse[j]) + 1)
            cell = coarse[i][learn] * shape[1] + coarse[j][learn]
            g, h = (np.bincount(cell, w, shape[0] * shape[1]).reshape(shape) for w in (y[learn] - p, p * (1 - p)))
            gains.append(crossed(g, h, s)[0])
        return pd.DataFrame({"bag": bag["bag"].iloc[0], "table": range(len(tables) + 1), "value": [*tables, np.array(gains)]})

    def joint(bag: pd.DataFrame) -> pd.DataFrame:
        x, y, learn = _bag(bag, s)
        coarse = model.binned(x, True)
        shapes = [t.shape for _, _, t in model.pairs]
        cells = [coarse[i] * t.shape[1] + coarse[j] for i, j, t in model.pairs]
        tables = boosted(y, learn, model.log_odds(x), cells, shapes, s)
        return pd.DataFrame({"bag": bag["bag"].iloc[0], "table": range(len(tables)), "value": [t.reshape(-1) for t in tables]})

    def mean(fitted) -> list[np.ndarray]:
        """Of the bags' tables, a few thousand numbers each, in the order of bags."""
        found = bags.groupBy("bag").applyInPandas(fitted, "bag int, table int, value array<double>").toPandas().sort_values("bag", kind="stable")
        return [np.mean(np.stack(part["value"].to_list()), 0) for _, part in found.groupby("table")]

    *model.tables, gains = mean(mains)
    best = sorted(range(len(every)), key=lambda k: (-gains[k], k))[: s.pairs]
    model.pairs = [(*every[k], np.zeros((len(model.coarse[every[k][0]]) + 1, len(model.coarse[every[k][1]]) + 1))) for k in best if gains[k] > 0]
    if model.pairs:
        model.pairs = [(i, j, v.reshape(t.shape)) for (i, j, t), v in zip(model.pairs, mean(joint), strict=True)]
    return model


def scored(measured_rows: DataFrame, model: Model) -> DataFrame:
    """doc_id and score, 0 to 1, by lookups and additions over each batch's bins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(k + 1).to_numpy() for k in range(len(FEATURES))], 1)
            yield pa.record_batch([batch.column(0), pa.array(1 / (1 + np.exp(-model.log_odds(x))))], ["doc_id", "score"])

    return measured_rows.select("doc_id", *FEATURES).mapInArrow(run, "doc_id long, score double")


def held_out(key: Column) -> Column:
    """Documents whose labels no model may learn from: crc32(doc_id as text) mod 5 is 0."""
    return F.coalesce(F.crc32(key.cast("long").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, settings: Settings | None = None, path: str | None = None) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from `threshold` on) of every whole text of docs (doc_id, text).

    labels (doc_id, quality): the mean of a doc_id's labels is learned from, null ones aren't; held-out documents' aren't read. A text
    that is null, empty or blank is measured by zeros and scored as such. Without labels of both kinds, or with fewer
    than two for each bag, the score is the labels' share, smoothed. Rows that repeat give a row each, null ids stay null and match
    no label; other columns aren't read. Texts are measured in place; only features are joined to labels.
    """
    at = stored(features(docs), path or new_dir(docs.sparkSession, "features"))
    marks = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].cast("double").alias("y")).filter("y IS NOT NULL").filter(~held_out(F.col("doc_id")))
    training = at.join(marks.groupBy("doc_id").agg(F.avg("y").alias("y")), "doc_id")
    found = scored(at, fit(training, settings))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
