"""License scans: phrases word by word, and text blocks that hold most of a license text.

The blocks of a template of L words are the windows of 2 L words that begin at every L-th word, whatever lines they run over: a copy of
the template lies in one of them whole. The join of blocks and templates is an exact set-similarity join under containment. All
tokens of templates are ranked by their frequency in the corpus, rarest first; a template and a block are the ascending ranks of
their tokens, tokens of no template aside. A block that holds enough of a template has one of the template's first |T| - least + 1
ranks (prefix filter): blocks are found by an equi-join of the corpus's words with these ranks. It has `least` ranks itself (length
filter), and from the first rank that both have on, both have enough left (positional filter). Only blocks that pass are intersected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, lower_ascii, new_dir, small_side, stored
from .license_texts import TEMPLATES

#: Phrases and their labels.
PHRASES = {"cc-by": ("cc", "by"), "gpl": ("general", "public", "license"), "reserved": ("all", "rights", "reserved")}
NOT_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Words of a text that are kept together for its blocks.
CHUNK = 256


def scan_words(lowered: Column) -> Column:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of lower-cased text."""
    return F.filter(F.split(lowered, NOT_WORD), lambda w: w != "")


def template_words(text: str) -> list[str]:
    """The words of a template, as scan_words gives them."""
    low = text.translate(str.maketrans(UPPER, LOWER))
    return [w for w in "".join(c if c.isalnum() or not c.isascii() else " " for c in low).split(" ") if w]


def places(words: Column, phrase: tuple[str, ...]) -> Column:
    """Starts at which the phrase's words stand one after the other."""
    n = F.size(words)
    hit = lambda i: reduce(lambda a, b: a & b, (F.get(words, i + k) == w for k, w in enumerate(phrase)))
    return F.when(n >= len(phrase), F.filter(F.sequence(F.lit(0), F.greatest(n - len(phrase), F.lit(0))), hit)).otherwise(F.array().cast("array<int>"))


def need(n: int, threshold: float) -> int:
    """Least number of a template's n tokens that reaches the threshold."""
    return max(1, -(-round(threshold * 1000) * n // 1000))


def ranked_tokens(docs: DataFrame, vocabulary: list[str]) -> list[str]:
    """The templates' tokens, rarest in the corpus first. The counts come from all documents; at most one a token reaches the driver."""
    hits = F.filter(scan_words(lower_ascii(F.coalesce(docs["text"].cast("string"), F.lit("")))), lambda w: w.isin(vocabulary))
    counts = {r["w"]: r["n"] for r in docs.select(F.explode(hits).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def template_table(docs: DataFrame, templates: list[tuple[str, float, str]]) -> tuple[list[str], list[str], DataFrame]:
    """All tokens by rank; those of prefixes; (template, label, least, stride, ranks, prefix)."""
    words = [template_words(text) for _, _, text in templates]
    tokens = ranked_tokens(docs, sorted({w for t in words for w in t}))
    rank = {w: i + 1 for i, w in enumerate(tokens)}
    rows, first = [], set()
    for k, ((label, threshold, _), t) in enumerate(zip(templates, words, strict=True)):
        ranks = sorted({rank[w] for w in t})
        if ranks:
            least = need(len(ranks), threshold)
            rows.append((k, label, least, len(t), ranks, ranks[: len(ranks) - least + 1]))
            first.update(rows[-1][-1])
    schema = "template int, label string, least int, stride int, ranks array<int>, prefix array<int>"
    return tokens, [tokens[r - 1] for r in sorted(first)], docs.sparkSession.createDataFrame(rows, schema)


def scanned(docs: DataFrame, tokens: list[str], first: list[str], path: str) -> DataFrame:
    """(row, doc_id, n_words, phrase results, marks): marks: place and rank of every template token, of texts with a token of a prefix alone."""
    low = lower_ascii(F.coalesce(docs["text"].cast("string"), F.lit("")))
    at = docs.select(F.monotonically_increasing_id().alias("row"), docs["doc_id"].cast("long").alias("doc_id"), low.alias("low"))
    at = at.withColumn("words", scan_words(F.col("low")))
    # a phrase can only stand where its longest word does
    for label, phrase in PHRASES.items():
        at = at.withColumn(f"at_{label}", F.when(F.col("low").contains(max(phrase, key=len)), places(F.col("words"), phrase)).otherwise(F.array().cast("array<int>")))
    listed = F.array(*map(F.lit, tokens)) if tokens else F.array().cast("array<string>")
    placed = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("pos"), w.alias("w"))), lambda x: x["w"].isin(tokens))
    ranked = F.transform(placed, lambda x: F.struct(x["pos"].alias("pos"), F.array_position(listed, x["w"]).cast("int").alias("rank")))
    marks = F.when(F.arrays_overlap("words", F.array(*map(F.lit, first))), ranked) if first else F.lit(None).cast("array<struct<pos:int,rank:int>>")
    every = F.concat(*(F.col(f"`at_{label}`") for label in PHRASES))
    base = F.concat(*(F.when(F.size(f"`at_{label}`") > 0, F.array(F.lit(label))).otherwise(F.array().cast("array<string>")) for label in PHRASES))
    at = at.select(
        "row", "doc_id", F.size("words").cast("long").alias("n_words"), F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"), base.alias("base"), marks.alias("marks"),
    )
    return stored(at, path)


def matches(rows: DataFrame, table: DataFrame) -> DataFrame:
    """(row, template, label, block, share) of every block that holds a template; block: the number of its window."""
    marks = rows.filter(F.size("marks") > 0).select("row", F.explode("marks").alias("m")).select("row", "m.pos", "m.rank")
    firsts = small_side(table.select("template", "stride", F.explode("prefix").alias("first")))
    found = marks.join(firsts, F.col("rank") == F.col("first")).select("row", "template", "stride", F.floor(F.col("pos") / F.col("stride")).alias("q"))
    blocks = found.select("row", "template", "stride", F.explode(F.array("q", F.col("q") - 1)).alias("block")).filter("block >= 0").distinct()
    # the words of a text in chunks, so that a block takes a few of them, however long its text
    chunks = marks.groupBy("row", F.floor(F.col("pos") / CHUNK).alias("chunk")).agg(F.collect_list(F.struct("pos", "rank")).alias("held"))
    begin, end = F.col("block") * F.col("stride"), (F.col("block") + 2) * F.col("stride")
    parts = blocks.select("*", begin.alias("begin"), end.alias("end"), F.explode(F.sequence(F.floor(begin / CHUNK), F.floor((end - 1) / CHUNK))).alias("chunk"))
    inside = F.filter("held", lambda x: (x["pos"] >= F.col("begin")) & (x["pos"] < F.col("end")))
    parts = parts.join(chunks, ["row", "chunk"]).select("row", "template", "block", F.transform(inside, lambda x: x["rank"]).alias("part"))
    whole = parts.groupBy("row", "template", "block").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("part")))).alias("own"))
    both = whole.join(small_side(table), "template")
    left = lambda x: F.size(x) - F.array_position(x, F.array_min(F.array_intersect("own", "prefix"))) + 1
    both = both.filter((F.size("own") >= F.col("least")) & (left("ranks") >= F.col("least")) & (left("own") >= F.col("least")))
    shared = F.size(F.array_intersect("own", "ranks"))
    return both.filter(shared >= F.col("least")).select("row", "template", "label", "block", (shared / F.size("ranks")).alias("share"))


def license_scan(docs: DataFrame, templates: list[tuple[str, float, str]] | None = None, path: str | None = None) -> DataFrame:
    """Phrases and template matches of every document (doc_id, text); templates: (label, share of its tokens that a block must hold, text).

    Returns doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (the best containment over blocks and
    templates; 1.0 where a phrase stands, 0 without a match), n_blocks (blocks that hold a template). A null or empty text has no
    words and no labels; ties and repeated rows give a row each; a template without words matches nothing.
    """
    path = path or new_dir(docs.sparkSession, "licenses")
    tokens, first, table = template_table(docs, TEMPLATES if templates is None else templates)
    rows = scanned(docs, tokens, first, f"{path}/rows")
    found = stored(matches(rows, stored(table, f"{path}/templates")), f"{path}/matches")
    found = found.groupBy("row").agg(F.collect_set("label").alias("more"), F.max("share").alias("best"), F.count("*").alias("n_blocks")).withColumnRenamed("row", "of")
    out = rows.drop("marks").join(small_side(stored(found, f"{path}/found")), F.col("row") == F.col("of"), "left")
    joined = lambda labels: F.array_join(F.sort_array(F.array_distinct(labels)), ",")
    more = F.coalesce("more", F.array().cast("array<string>"))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", joined(F.col("base")).alias("base_labels"), joined(F.concat("base", more)).alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"), F.coalesce("n_blocks", F.lit(0)).cast("long").alias("n_blocks"),
    )
