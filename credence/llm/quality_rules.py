"""Quality rules whose cut-offs follow the corpus: quantile sketches per language and source, then a joined filter.

The sketch of a metric counts its values by their first seven binary digits, so a quantile read from it is at most 1/64 off. Sketches
of parts add up bin by bin: languages and the whole corpus are merges of their sources, in any order and with the same result.
A cut-off is a quantile of its group, drawn towards that of the group above (source, language, corpus) the more, the fewer documents
it has. So no fixed cut-off is left but for the base rules, and of each group a set share at most is cut off by each metric.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, new_dir, small_side, stored, words_of

SYMBOLS = "#*$%&|<>"
#: Binary digits that a sketch keeps.
DIGITS = 7
#: Metrics (millionths for shares, ten-thousandths of a character for the mean length of a word) and the quantiles, in thousandths, at which each is cut off below and above.
METRICS = {"symbol_ppm": (None, 990), "dup_ppm": (None, 990), "repeat_ppm": (None, 990), "length_e4": (10, 990)}


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows that stand twice or more in a text. Windows are compared by 64-bit hashes within one text."""
    n = F.size(words)
    keys = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))
    return F.when(n >= 4, F.sort_array(keys)).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))


def base_metrics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed of every text (null: no words)."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    at = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["lang"].cast("string").alias("lang"), docs["source"].cast("string").alias("source"), text.alias("text"))
    at = at.withColumn("words", words_of(F.col("text")))
    at = at.withColumn("lines", F.filter(F.split("text", "\n"), lambda line: F.length(F.translate(line, SPACE, "")) > 0))
    at = at.withColumn("keys", _repeat_words(F.col("words")))
    twice = F.filter(F.sequence(F.lit(0), F.size("keys") - 1), lambda i: F.coalesce(F.get("keys", i - 1)["h"] == F.get("keys", i)["h"], F.lit(False)) | F.coalesce(F.get("keys", i + 1)["h"] == F.get("keys", i)["h"], F.lit(False)))
    at = at.withColumn("found", F.when(F.size("keys") > 1, F.sort_array(F.transform(twice, lambda i: F.get("keys", i)["i"]))).otherwise(F.array().cast("array<int>")))
    # each window covers its three words, less those of the next one
    covered = F.aggregate(F.zip_with("found", F.expr("slice(found, 2, greatest(size(found), 1))"), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3)))), F.lit(0), lambda s, x: s + x)
    at = at.select(
        "doc_id", "lang", "source", F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"), F.size("lines").cast("long").alias("n_lines"),
    )
    return at.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def measured(metrics: DataFrame) -> DataFrame:
    """METRICS beside the base metrics."""
    share = lambda a, b: F.expr(f"1000000 * {a} div greatest({b}, 1)").cast("long")
    length = F.expr("10000 * word_chars div greatest(n_words, 1)").cast("long")
    return metrics.withColumns({"symbol_ppm": share("n_symbols", "word_chars"), "dup_ppm": share("n_dup_lines", "n_lines"), "repeat_ppm": share("n_repeat_words", "n_words"), "length_e4": length})


def bin_width(v: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.greatest(F.length(F.bin(v)) - DIGITS, F.lit(0)))


def sketches(rows: DataFrame) -> DataFrame:
    """(lang, source, metric, bin, width, n) over all documents that pass the base rules; pre-aggregated by task, some hundred bins a group and metric."""
    long = rows.filter(~F.col("base_failed")).select("lang", "source", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in METRICS))).alias("x"))
    width = bin_width(F.col("v"))
    long = long.select("lang", "source", "x.metric", "x.v").select("lang", "source", "metric", (F.col("v") - F.col("v") % width).alias("bin"), width.alias("width"))
    return long.groupBy("lang", "source", "metric", "bin", "width").agg(F.count("*").alias("n"))


def quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, metric, docs, lo, hi): the quantiles of the merged sketches of each group; the lower end of a bin for lo, -1 where a metric has none, the upper one for hi."""
    by = [*keys, "metric"]
    merged = sketch.groupBy(*by, "bin", "width").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*by)
    merged = merged.withColumns({"upto": F.sum("n").over(w.orderBy("bin")) * 1000, "docs": F.sum("n").over(w)})
    reached = lambda k: F.col("upto") >= F.col("docs") * F.element_at(F.create_map(*(F.lit(x) for m, q in METRICS.items() if q[k] for x in (m, q[k]))), F.col("metric"))
    lo = F.coalesce(F.min(F.when(reached(0), F.col("bin"))), F.lit(-1).cast("bigint"))
    return merged.groupBy(*by).agg(F.max("docs").alias("docs"), lo.alias("lo"), F.min(F.when(reached(1), F.col("bin") + F.col("width") - 1)).alias("hi"))


def drawn_to(own: DataFrame, above: DataFrame, keys: list[str], weight: int) -> DataFrame:
    """Quantiles of groups, each drawn to those of the group above (same metric, same keys) as if that had `weight` documents in it."""
    up = above.select(F.col("metric").alias("m"), *(F.col(k).alias(f"up_{k}") for k in keys), F.col("lo").alias("up_lo"), F.col("hi").alias("up_hi"))
    on = F.col("metric") == F.col("m")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"up_{k}"))
    both = own.join(up, on)
    drawn = lambda x: F.expr(f"(docs * {x} + {weight} * up_{x}) div (docs + {weight})")
    return both.withColumns({"lo": drawn("lo"), "hi": drawn("hi")}).select(own.columns)


def cut_offs(sketch: DataFrame, weight: int) -> DataFrame:
    """(of_lang, of_source, METRICS as (lo, hi)) of each language and source."""
    languages = drawn_to(quantiles(sketch, ["lang"]), quantiles(sketch, []), [], weight)
    sources = drawn_to(quantiles(sketch, ["lang", "source"]), languages, ["lang"], weight)
    wide = sources.groupBy("lang", "source").agg(*(F.max(F.when(F.col("metric") == m, F.struct("lo", "hi"))).alias(f"of_{m}") for m in METRICS))
    return wide.withColumnsRenamed({"lang": "of_lang", "source": "of_source"})


def quality_rules(docs: DataFrame, weight: int = 100, path: str | None = None) -> DataFrame:
    """Base rules and adaptive cut-offs for documents (doc_id, text, lang, source).

    Cut-offs come from the documents that pass the base rules: quantiles of each language and source, drawn towards those of the
    language and these towards those of the corpus by `weight` documents. Null languages and sources are groups like others.
    kept: base rules passed and every metric within its cut-offs, which count as within. Empty and null texts have no words and
    fail; repeated rows give a row each; a very long text takes memory in proportion.
    """
    path = path or new_dir(docs.sparkSession, "quality")
    rows = stored(measured(base_metrics(docs)), f"{path}/metrics")
    cuts = small_side(stored(cut_offs(stored(sketches(rows), f"{path}/sketch"), weight), f"{path}/cuts"))
    out = rows.join(cuts, rows["lang"].eqNullSafe(F.col("of_lang")) & rows["source"].eqNullSafe(F.col("of_source")), "left")
    within = F.lit(True)
    for m in METRICS:
        within = within & F.col(m).between(F.col(f"of_{m}.lo"), F.col(f"of_{m}.hi"))
    kept = ~F.col("base_failed") & F.coalesce(within, F.lit(False))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), *METRICS)
