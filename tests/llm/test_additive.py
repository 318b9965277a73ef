"""The additive model: its features against plain ones, its trees against all cuts, held-out accuracy, and what it may not look at."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from credence.llm import additive
from credence.llm.common import text_steps
from credence.llm.queries import QUERIES

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain_features(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text))
    raw = WORD.findall(text)
    if not words:
        return [0.0] * len(additive.FEATURES)
    data, n = text.encode(), len(words)
    size = [len(w.encode()) for w in words]
    mean = sum(size) / n
    windows = [tuple(words[i : i + 3]) for i in range(n - 2)]
    twice = {w for w, k in Counter(windows).items() if k > 1}
    covered = {j for i, w in enumerate(windows) if w in twice for j in range(i, i + 3)}
    lines = [tuple(WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), x))) for x in text.split("\n") if WORD.search(x)]
    share = lambda chars: sum(chr(b) in chars for b in data) / len(data)
    symbols, marks = "#*$%&|<>{}[]=_~^@\\/+", ".,!?;:"
    return [
        math.log2(1 + n), math.log2(1 + len(lines)), mean, math.sqrt(max(0, sum(s * s for s in size) / n - mean**2)), sum(s <= 3 for s in size) / n, sum(s > 10 for s in size) / n,
        len(set(words)) / n, max(Counter(words).values()) / n, len(covered) / n, 1 - len(set(lines)) / len(lines),
        n / len(lines), share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), share("0123456789"), share(symbols), share(marks), sum(b >= 128 for b in data) / len(data), share(" \t\n\x0b\x0c\r"),
        sum(w[-1] in symbols + marks for w in raw) / n, sum("A" <= w[0] <= "Z" and sum("A" <= c <= "Z" for c in w) > 1 for w in raw) / n,
        -sum(c / len(data) * math.log2(c / len(data)) for c in Counter(data).values()),
    ]


def test_features(spark, documents, odd):
    texts = [r["text"] for r in documents.filter("n_chars < 20000").collect()] + [r["text"] for r in odd.collect()] + ["A\nA\nb A\n\n", "\n", "AB Cd EF. 12|", "one two three one two three"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r[0]: r[1:] for r in additive.features(rows.repartition(3)).collect()}
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(plain_features(t or ""), abs=2e-3, rel=1e-4), (i, t and t[:80])


def test_a_tree_makes_the_best_cuts():
    rng, s = np.random.default_rng(1), additive.Settings()
    value = lambda g, h: g * g / (h + s.ridge)
    for _ in range(50):
        n = int(rng.integers(2, 9))
        g, h = rng.normal(size=n), rng.uniform(1, 3, n)
        won, k = additive.best_cut(g, h, s)
        tried = [value(g[:i].sum(), h[:i].sum()) + value(g[i:].sum(), h[i:].sum()) - value(g.sum(), h.sum()) for i in range(1, n)]
        assert won == pytest.approx(max(0, *tried)) and (not k or tried[k - 1] == max(tried))
        assert len(set(additive.shallow(g, h, s))) <= 3
    g, h = rng.normal(size=(5, 4)), rng.uniform(1, 3, (5, 4))
    won, leaves = additive.crossed(g, h, s)
    tried = []
    for a, b in ((g, h), (g.T, h.T)):
        for i in range(1, len(a)):
            for j in range(1, a.shape[1]):
                for k in range(1, a.shape[1]):
                    tried.append(sum(value(a[r, c].sum(), b[r, c].sum()) for r, c in ((slice(0, i), slice(0, j)), (slice(0, i), slice(j, None)), (slice(i, None), slice(0, k)), (slice(i, None), slice(k, None)))))
    assert won + value(g.sum(), h.sum()) == pytest.approx(max(tried)) and len(np.unique(leaves)) <= 4


def test_pairs_learn_what_single_features_cannot(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(size=(1200, len(additive.FEATURES)))
    y = (x[:, 3] > 0.5) ^ (x[:, 7] > 0.5)
    rows = spark.createDataFrame([(i, *map(float, v), float(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))], "doc_id long, " + ", ".join(f"{f} float" for f in additive.FEATURES) + ", y double")
    model = additive.fit(rows, additive.Settings(rounds=40, pairs=3, bins=16))
    assert (3, 7) in [(i, j) for i, j, _ in model.pairs]
    fresh = rng.uniform(size=(500, len(additive.FEATURES))).astype(np.float32)
    assert np.mean((model.log_odds(fresh) > 0) == ((fresh[:, 3] > 0.5) ^ (fresh[:, 7] > 0.5))) > 0.9
    # the sum of the tables, looked up one by one
    for v in fresh[:20]:
        cell = lambda cuts, k: int(np.searchsorted(cuts[k], v[k], side="left"))  # noqa: B023, E731
        want = model.base + sum(t[cell(model.cuts, k)] for k, t in enumerate(model.tables)) + sum(t[cell(model.coarse, i), cell(model.coarse, j)] for i, j, t in model.pairs)
        assert model.log_odds(v[None])[0] == pytest.approx(want)


@pytest.fixture(scope="module")
def small():
    return additive.Settings(rounds=30, pairs=3, bins=16)


def test_held_out_accuracy(spark):
    where = DATA.replace("sf0.001", "sf0.01")
    got = QUERIES["op11_quality_classifier"](spark, where)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = {r["doc_id"]: r for r in got.collect()}
    docs = spark.read.parquet(f"{where}/documents.parquet")
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows.values())
    known = [(rows[r["doc_id"]], r["quality"]) for r in spark.read.parquet(f"{where}/labels.parquet").collect() if rows[r["doc_id"]]["held_out"]]
    assert len(known) > 40 and np.mean([r["predicted"] == q for r, q in known]) > 0.93


def test_only_texts_and_allowed_labels_count(spark, documents, small):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    want = sorted(additive.quality(documents, labels, settings=small).collect())
    out = additive.held_out(F.col("doc_id"))
    turned = labels.withColumn("quality", F.when(out, 1 - F.col("quality")).otherwise(F.col("quality"))).withColumn("toxic", F.lit(7))
    other = documents.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string")).withColumn("y", F.lit("clash")).withColumn("score", F.lit(0))
    assert sorted(additive.quality(other, turned, settings=small).collect()) == want
    assert [r["held_out"] for r in want] == [__import__("zlib").crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in want]


def test_odd_rows(spark, documents, odd, nothing, small):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    docs = documents.unionByName(odd, allowMissingColumns=True)
    more = spark.createDataFrame([(None, 1, 0), (1, None, 0), (1005, 0, 0), (1005, 1, 0), (424242, 1, 1)], "doc_id long, quality int, toxic int")
    rows = additive.quality(docs, labels.unionByName(more), settings=small).collect()
    assert sorted(str(r[0]) for r in rows) == sorted(str(r["doc_id"]) for r in docs.collect())
    empty = {r["score"] for r in rows if r["doc_id"] in (1001, 1002, 1003)}
    assert len(empty) == 1 and not any(r["held_out"] is None or math.isnan(r["score"]) for r in rows)
    assert additive.quality(nothing, labels).count() == 0
    assert {r["score"] for r in additive.quality(documents, labels.limit(0)).collect()} == {0.5}
    ones = additive.quality(documents, labels.filter("quality = 1")).collect()
    assert len({r["score"] for r in ones}) == 1 and ones[0]["score"] > 0.9


def test_long_texts_are_measured_whole():
    import pyarrow as pa

    text = "word other " * 200_000 + "END!! " * 3
    (part,) = text_steps(pa.array([text]))
    assert additive.measured(part[2], part[3])[0][0] == pytest.approx(math.log2(1 + 400_003), rel=1e-5)
