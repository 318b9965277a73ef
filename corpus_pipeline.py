"""Five stages that make a training set of documents: each is written as Parquet and reread as the next one's input.

Null, empty and very long texts, ties, repeated rows and extra columns: decisions are made row by row, by doc_id and text together where
a stage joins, so rows that share a doc_id are kept or dropped each on its own. Documents without a doc_id go at the first stage,
since no later one could name them. An empty table gives an empty result. A stage that joins takes each row as one struct, so extra
columns may have any name and any type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from credence.llm import decontaminate, language_id, mixing, ngram_join, token_binary
from credence.llm.common import new_dir, remove_dir, small_side, stored
from credence.llm.queries import _tokenizer

#: Documents whose first language scores less, since none prevails, are rejected; short ones of one language score more.
LEAST_SCORE = 0.2


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: rows without a language (null texts, no letters), or in which none prevails, go. No shuffle; repeated rows stay."""
    model = language_id.fit(docs.filter(~language_id.held_out(docs)))
    plain = docs.filter("doc_id IS NOT NULL").toDF(*("text" if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)))  # names that Python workers can be sent
    return language_id.prevailing(plain, model, LEAST_SCORE).toDF(*docs.columns)


def _packed(docs: DataFrame) -> DataFrame:
    """Each row as one struct `row`, beside its doc_id and text: no other column's name is met."""
    whole = F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in docs.columns))
    return docs.select(whole.alias("row"), docs["doc_id"].alias("doc_id"), docs["text"].alias("text"))


def _order(docs: DataFrame) -> Column:
    """A defined order of rows that share a doc_id: by text, then by the other columns; maps, which have no order, by their JSON."""
    fields = sorted(docs.schema["row"].dataType.fields, key=lambda f: f.name != "text")
    value = lambda f: F.col("row").getField(f.name)
    return F.struct(*((F.to_json(F.struct(value(f))) if "map<" in f.dataType.simpleString() else value(f)).alias(f"c{i}") for i, f in enumerate(fields)))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each component the smallest doc_id stays. Of rows that share it, the first in the order of their columns, text first, stays."""
    found = ngram_join.ngram_components(docs)
    ids = small_side(stored(found.filter("doc_id = component_id").select("doc_id"), new_dir(spark, "ids")))
    rows = _packed(docs)
    kept = rows.join(ids, "doc_id", "left_semi")
    repeated = stored(rows.groupBy("doc_id").count().filter("count > 1").select("doc_id"), new_dir(spark, "repeated"))
    if not repeated.limit(1).count():
        return kept.select("row.*")
    several = kept.join(small_side(repeated), "doc_id", "left_semi")
    first = several.groupBy("doc_id").agg(F.min_by("row", _order(several)).alias("row")).select("row")
    return kept.join(small_side(repeated), "doc_id", "left_anti").select("row").unionByName(first).select("row.*")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: rows whose text holds an item go; rows without a text hold none and stay."""
    found = decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = found.filter("contaminated").select(F.col("doc_id").alias("d"), F.col("text_hash").alias("x")).distinct()
    bad = small_side(stored(bad, new_dir(spark, "contaminated")))
    key = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return _packed(docs).join(bad, F.col("doc_id").eqNullSafe(F.col("d")) & (key == F.col("x")), "left_anti").select("row.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources: a row for each time that a document is drawn; repeated rows are drawn together."""
    path = new_dir(spark, "mixing")
    drawn = mixing.mixed_sources(docs, path=path).groupBy("doc_id", "source", "h").agg(F.count("*").alias("times"))
    drawn = drawn.select(F.col("doc_id").alias("d"), F.col("source").alias("s"), F.col("h").alias("x"), "times")
    drawn = small_side(stored(drawn, new_dir(spark, "drawn")), 200_000)
    remove_dir(spark, path)
    at = _packed(docs).select("row", "doc_id", F.col("row").getField("source").alias("source"), mixing.text_key(F.col("text")).alias("key"))
    at = at.join(drawn, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("key") == F.col("x")))
    return at.select("row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("times")))).select("row.*")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in binary files: doc_id, start, n_tokens, ids_crc32 as read back from them; a row for each row, empty texts have the end id alone."""
    return token_binary.token_files(docs, _tokenizer("word_bpe_49k.json"), end_id=2)


STAGES = [("language_id", keep_language), ("ngram_jaccard", one_of_each), ("decontamination", without_benchmark), ("mixing", mixed), ("token_binary", token_ids)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over sf_dir's documents; their outputs stay in the shared folder."""
    path = new_dir(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
    return docs


#: Language prediction, the tokenizer and the binary coding aren't SQL.
ORACLE_SQL = None
