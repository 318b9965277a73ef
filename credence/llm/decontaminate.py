"""Benchmark decontamination: test items found inside documents by MinHash containment search, verified shingle by shingle.

Items are parted by size (powers of two of their distinct five-word shingles). Each has a bottom-k MinHash sketch: the k smallest
hashes of its shingles, k = |Q| - ceil(threshold * |Q|) + 1. A document has one sketch for each class: its hashes up to the
largest one in the class's sketches, so that it is as long as the document asks for and a short item in a long document isn't
lost. A document that holds at least `threshold` of an item holds one of any k of its shingles, so the sketches of both meet: no
match is missed. Documents with fewer shingles than a class needs skip it. Pairs whose sketches meet are verified on the words.

Documents are filtered against a bitmap of all sketch hashes, which Spark builds and which has a fixed largest size. What passes is
joined with the items' sketches by hash; neither texts nor sketches of the benchmark go through the driver.
Letters of all alphabets are compared in lower case, so that shouted passages are found too.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, documents_of, hashed_words, new_dir, shingles, small_side, stored, text_steps

WORD = re.compile("[^\x20\x09-\x0d]+")
FOLD = str.maketrans(UPPER, LOWER)
#: Bits of a bitmap for each hash in it (a document of some hundred hashes seldom passes by chance), and logarithms of its least and
#: largest number of bits (32 MB). A fuller bitmap lets more documents pass, which the join then drops.
BITS, LEAST_BITS, MOST_BITS = 1 << 14, 16, 28
CHUNK_BITS = 13


def shingle_set(text: str, k: int = 5) -> set[tuple[str, ...]]:
    """Distinct k-word shingles of a text; with fewer words, all of them as one; without words, none."""
    words = WORD.findall(text.translate(FOLD))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set())


def shingles_in(text: str, wanted: set[tuple[str, ...]], k: int = 5) -> set[tuple[str, ...]]:
    """Those of the wanted shingles that a lower-case text has. It is read word by word: what is held grows with what is wanted, not with the text."""
    window, found = deque(maxlen=k), set()
    for word in WORD.finditer(text):
        window.append(word.group())
        if len(window) == k and (shingle := tuple(window)) in wanted:
            found.add(shingle)
    if len(window) < k and tuple(window) in wanted:
        found.add(tuple(window))
    return found


def _lowered(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(texts)


def item_sketches(benchmark: DataFrame, threshold: float, path: str) -> tuple[DataFrame, DataFrame]:
    """(item, item_id, text) and (item, least, h): a sketch of each item by row; least: shingles that a document of its class needs."""
    share = round(threshold * 1000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in text_steps(_lowered(batch.column(1))):
                h, row, _, _ = hashed_words(data, offsets)
                g, r = shingles(h, row, j - i)
                n = np.bincount(r, minlength=j - i)
                place = np.arange(len(g)) - (np.cumsum(n) - n)[r]
                kept = place < (n + (-share * n) // 1000 + 1)[r]  # hashes come in ascending order
                least = np.array([max(1, -(-share * (1 << (int(x).bit_length() - 1)) // 1000)) if x else 1 for x in n], np.int64)
                keys = batch.column(0).slice(i, j - i).take(pa.array(r[kept]))
                yield pa.record_batch([keys, pa.array(least[r[kept]]), pa.array(g[kept].view(np.int64))], ["item", "least", "h"])

    items = benchmark.select(F.coalesce(benchmark["item_id"].cast("long"), F.lit(-1)).alias("item_id"), benchmark["text"].cast("string").alias("text"))
    items = stored(items.filter("text IS NOT NULL").withColumn("item", F.monotonically_increasing_id()), f"{path}/items")
    return items, stored(items.select("item", "text").mapInArrow(run, "item long, least long, h long"), f"{path}/sketches")


def bitmap_of(sketches: DataFrame) -> dict:
    """For each class (by `least`) the largest hash, and a bitmap of all sketch hashes by their first bits, of at most 2**MOST_BITS bits."""
    unsigned = F.col("h").bitwiseXOR(F.lit(-(1 << 63)))  # in the order of unsigned numbers
    classes = sketches.groupBy("least").agg(F.max(unsigned).alias("top"), F.count("*").alias("n")).collect()  # one row a class
    bits = min(MOST_BITS, max(LEAST_BITS, (BITS * sum(r["n"] for r in classes) - 1).bit_length()))
    chunks = sketches.select(F.shiftrightunsigned("h", 64 - bits).alias("b")).distinct()
    chunks = chunks.groupBy(F.shiftright("b", CHUNK_BITS).alias("chunk")).agg(F.collect_list(F.expr(f"CAST(b & {(1 << CHUNK_BITS) - 1} AS SMALLINT)")).alias("bits"))
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in chunks.toLocalIterator():
        at = (r["chunk"] << CHUNK_BITS) + np.array(r["bits"], np.int64)
        np.bitwise_or.at(out, at >> 3, (128 >> (at & 7)).astype(np.uint8))
    return {"bits": bits, "map": out, "classes": [(r["least"], r["top"] + (1 << 63)) for r in classes]}


def sketched(docs: DataFrame, filtered: dict, path: str) -> DataFrame:
    """(row, doc_id, text_hash, h, text): a row for each document; h: hashes of its sketches that are in the bitmap, text only where there are some."""
    shared = docs.sparkSession.sparkContext.broadcast(filtered)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, bitmap, classes = shared.value["bits"], shared.value["map"], shared.value["classes"]
        for batch in batches:
            for i, j, data, offsets in text_steps(_lowered(batch.column(3))):
                h, row, _, _ = hashed_words(data, offsets)
                g, r = shingles(h, row, j - i)
                n = np.bincount(r, minlength=j - i)
                top = np.zeros(j - i, np.uint64)  # the largest hash in the sketches of the classes that a document may hold
                some = np.zeros(j - i, bool)
                for least, most in classes:
                    fits = n >= least
                    top[fits] = np.maximum(top[fits], np.uint64(most))
                    some |= fits
                at = (g >> np.uint64(64 - bits)).astype(np.int64)
                hit = (g <= top[r]) & some[r] & ((bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).astype(bool)
                ends = np.concatenate([[0], np.cumsum(np.bincount(r[hit], minlength=j - i))])
                held = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(g[hit].view(np.int64)))
                texts = batch.column(3).take(pa.array(np.arange(i, j), mask=np.diff(ends) == 0))
                yield pa.record_batch([*(batch.column(k).slice(i, j - i) for k in range(3)), held, texts], ["row", "doc_id", "text_hash", "h", "text"])

    rows = documents_of(docs).select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return stored(rows.mapInArrow(run, "row long, doc_id long, text_hash long, h array<long>, text string"), path)


def _verified(threshold: float):
    share = round(threshold * 1000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, shares = [], []
            lower, items = _lowered(batch.column(2)), _lowered(batch.column(3))
            rows = batch.column(0).to_pylist()
            for _, places in groupby(range(len(rows)), rows.__getitem__):  # all items that one document meets need one reading of it
                own = {i: shingle_set(items[i].as_py()) for i in places}
                found = shingles_in(lower[min(own)].as_py(), set().union(*own.values()))
                for i, wanted in own.items():
                    n = len(wanted & found)
                    if n * 1000 >= share * len(wanted):
                        keep.append(i), shares.append(n / len(wanted))
            yield pa.record_batch([batch.column(0).take(pa.array(keep, pa.int64())), batch.column(1).take(pa.array(keep, pa.int64())), pa.array(shares, pa.float64())], ["row", "item_id", "share"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, path: str | None = None) -> DataFrame:
    """doc_id, contaminated, n_items, items (ascending distinct ids, comma-joined), containment (the highest), text_hash of documents (doc_id, text).

    An item is held when at least `threshold` of its distinct five-word shingles stand in the document. Every row of the benchmark
    is an item of its own, also where ids repeat; a null id is listed as -1. Items without words and null texts match nothing;
    null and empty texts hold nothing. Every input row gives a row, whatever its doc_id. A very long text is one step, is
    sketched whole and verified word by word. text_hash (xxhash64 of the text, null as empty) tells rows of one doc_id apart.
    """
    spark = docs.sparkSession
    path = path or new_dir(spark, "decontamination")
    items, sketches = item_sketches(benchmark, threshold, path)
    rows = sketched(docs, bitmap_of(sketches), f"{path}/rows")
    hits = rows.filter(F.size("h") > 0)
    meeting = hits.select("row", F.explode("h").alias("g")).join(small_side(sketches.select("h", "item")), F.col("g") == F.col("h"))
    pairs = stored(meeting.select("row", "item").distinct(), f"{path}/pairs")
    texts = hits.select(F.col("row").alias("at"), F.col("text").alias("doc_text"))
    both = pairs.join(items.select(F.col("item").alias("of"), "item_id", F.col("text").alias("item_text")), F.col("item") == F.col("of"))
    both = both.join(texts, F.col("row") == F.col("at")).select("row", "item_id", "doc_text", "item_text")
    found = both.mapInArrow(_verified(threshold), "row long, item_id long, share double")
    found = found.groupBy("row").agg(F.sort_array(F.collect_set("item_id")).alias("ids"), F.max("share").alias("share")).withColumnRenamed("row", "of")
    found = small_side(stored(found, f"{path}/found"))
    listed = F.array_join(F.transform("ids", lambda x: x.cast("string")), ",")
    out = rows.select("row", "doc_id", "text_hash").join(found, F.col("row") == F.col("of"), "left")
    return out.select(
        "doc_id", F.col("of").isNotNull().alias("contaminated"), F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce(listed, F.lit("")).alias("items"), F.coalesce("share", F.lit(0.0)).alias("containment"), "text_hash",
    )
