"""Each stage of the pipeline against a plain version on its own input."""

import zlib

import numpy as np
from conftest import DATA
from test_operators import plain_components

import corpus_pipeline
from credence.llm import decontaminate, language_id, mixing
from credence.llm.queries import _tokenizer


def test_stages(spark, documents, odd):
    docs = documents.unionByName(odd.select(documents.columns))
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, DATA)
        assert out.columns == documents.columns
        out = spark.createDataFrame(out.collect(), documents.schema)
        kept[name] = (docs.collect(), out.collect())
        docs = out
    before, after = kept["language_id"]
    pred = {r["doc_id"]: r for r in language_id.language_id(spark.createDataFrame(before, documents.schema)).collect()}
    assert sorted(str(r["doc_id"]) for r in after) == sorted(str(r["doc_id"]) for r in before if r["doc_id"] is not None and pred[r["doc_id"]]["lang_pred"] != "und" and pred[r["doc_id"]]["score"] >= 0.2)
    before, after = kept["ngram_jaccard"]
    reach = plain_components([(r["doc_id"], r["text"]) for r in before])
    assert sorted(r["doc_id"] for r in after) == sorted(k for k, (_, c) in reach.items() if k == c)
    before, after = kept["decontamination"]
    items = [decontaminate.shingle_set(r["text"].lower()) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    leaks = {r["doc_id"] for r in before if any(1000 * len(s & decontaminate.shingle_set(r["text"].lower())) >= 800 * len(s) for s in items)}
    assert leaks and {r["doc_id"] for r in after} == {r["doc_id"] for r in before} - leaks
    before, after = kept["mixing"]
    drawn = mixing.mixed_sources(spark.createDataFrame(before, documents.schema)).groupBy("doc_id").count().collect()
    assert sorted((r["doc_id"], r["count"]) for r in drawn) == sorted((k, sum(r["doc_id"] == k for r in after)) for k in {r["doc_id"] for r in after})
    from tokenizers import Tokenizer

    tokenizer, start, want = Tokenizer.from_file(_tokenizer("word_bpe_49k.json")), 0, []
    coded = sorted((r["doc_id"], np.array([*tokenizer.encode(r["text"], add_special_tokens=False).ids, 2], "<u2").tobytes()) for r in after)
    for k, x in coded:
        want.append((k, start, len(x) // 2, zlib.crc32(np.frombuffer(x, "<u2").astype("<u4").tobytes())))
        start += len(x) // 2
    last = corpus_pipeline.token_ids(spark, docs, DATA)
    assert sorted(tuple(r[c] for c in ("doc_id", "start", "n_tokens", "ids_crc32")) for r in last.collect()) == sorted(want)


def test_empty_input(spark, documents):
    none = spark.createDataFrame([], documents.schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, DATA).count() == 0, name


def test_rows_that_share_a_doc_id(spark, documents):
    """Verdicts hold for a row, not for all rows of its doc_id."""
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").first()["text"]
    good = [r["text"] for r in documents.filter("lang = 'en' and n_chars between 400 and 3000").orderBy("doc_id").limit(3).collect()]
    rows = [(1, good[0]), (1, "12 34"), (2, good[1]), (2, good[1] + " " + item), (3, good[2]), (3, good[2]), (4, None)]
    docs = spark.createDataFrame([(k, t, "en", "s", None) for k, t in rows], documents.schema)
    stages = dict(corpus_pipeline.STAGES)
    model = language_id.fit(documents)
    kept = language_id.prevailing(docs, model, 0.2).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == sorted((k, t) for k, t in rows if t and t != "12 34")
    clean = stages["decontamination"](spark, docs.filter("text is not null"), DATA).collect()
    assert sorted((r["doc_id"], r["text"]) for r in clean) == sorted((k, t) for k, t in rows if t and item not in t)
    one = stages["ngram_jaccard"](spark, docs, DATA).collect()
    assert sorted((r["doc_id"], r["text"] or "") for r in one) == sorted([(1, min("12 34", good[0])), (2, min(good[1], good[1] + " " + item)), (3, good[2]), (4, "")])


def test_extra_columns_of_any_name_and_type(spark, documents):
    """Names that the stages use inside, names with dots and back-ticks, maps: a column is only carried along."""
    from pyspark.sql import functions as F

    good = documents.filter("n_chars between 400 and 3000").orderBy("doc_id").limit(12)
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").limit(1).select(F.lit(777).cast("long").alias("doc_id"), "text", F.lit("en").alias("lang"), F.lit("src0").alias("source"), F.lit(9).cast(documents.schema["n_chars"].dataType).alias("n_chars"))
    docs = good.unionByName(item).unionByName(good.filter("doc_id < 3"))
    want, plain = {}, docs
    for name, stage in corpus_pipeline.STAGES[1:4]:
        plain = stage(spark, plain, DATA)
        plain = spark.createDataFrame(plain.collect(), documents.schema)
        want[name] = sorted(r["doc_id"] for r in plain.collect())
    assert 777 not in want["decontamination"] and len(want["ngram_jaccard"]) == len(set(want["ngram_jaccard"]))
    names = ["d", "s", "x", "times", "_x", "_n", "k", "row", "key", "count", "h", "n", "col", "a.b", "text.x", "b`c", "component_id", "contaminated"]
    more = docs.select("*", *(F.lit(i).alias(n) for i, n in enumerate(names)), F.create_map(F.lit("m"), F.col("doc_id")).alias("map"), F.array(F.create_map(F.lit(1), F.lit("v"))).alias("maps"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, more, DATA)
        if name in want:
            assert out.columns == more.columns
            rows = out.collect()
            assert sorted(r["doc_id"] for r in rows) == want[name], name
            assert all(r["map"] == {"m": r["doc_id"]} and r["a.b"] == names.index("a.b") for r in rows)
            more = spark.createDataFrame(rows, more.schema)
        else:
            assert out.count() >= len(want["mixing"])
