"""N-gram Jaccard join: documents that share most of their five-word shingles, and the components that these links form.

The incidence of documents and shingles is a sparse matrix M; the overlaps of all pairs are M times its transpose. The product is
never built whole. It runs in blocks of columns (ranges of shingle hashes) and drops what size-derived bounds rule out:

1. A linked pair x, y shares at least 80 % of the larger. So of x's shingles in hash order only the first
   |x| - ceil(.8 |x|) + ceil(.1 |x|) enter the matrix, and of these a partner shares at least ceil(.1 ceil(.8 |x|)).
   Block by block, the columns that no other document has are dropped. A document that keeps fewer has no partner.
2. Documents with equal sets become one. What is left enters the matrix wholly, and the same is asked of whole rows: a document
   with fewer than ceil(.8 |x|) columns that another one has is dropped. Of the others only the |x| - ceil(.8 |x|) + 1
   rarest columns are multiplied: two documents that share none of them can't be linked.
3. Round by round each document is proposed with a pivot of its columns, first the smallest document, then others drawn at
   random, as long as a quarter of them link; at last all pairs of a column that aren't in one component. Pairs within a
   component need no proof. A pair must share ceil(80 (|x| + |y|) / 180) - max(ceil(.8 |x|), ceil(.8 |y|)) + 1 of the rare columns.
4. For the pairs proposed the product is made in full: the columns are parted into PARTS blocks, each block that two sets have
   gives a partial overlap, and these are added up and held against the bound of the sizes.

A shingle that very many documents have is summed up per task and never meets in one place; see `_block_rows`.
Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents_of, hashed_words, mixed, new_dir, remove_dir, shingles, small_side, stored, text_steps

#: Entries that a task gathers before it sends blocks, the count from which a column is hot among them, and entries of one column
#: that all tasks together may send to its block: with very many tasks a column is hot sooner, at 2 at least.
GATHERED, HOT, COLUMN_ENTRIES = 1_000_000, 64, 1_000_000
#: Text bytes for each block of columns.
BLOCK_TEXT = 12 << 20
#: Logarithm of the ratio of sizes that share a bin.
SIZE_BIN = 0.02
ENTRY, SIZE, HOT_ENTRY, HOT_COLUMN = 0, 1, 2, 3
#: Blocks of columns (by the first bits of a hash) in which the overlaps of proposed pairs are added up: a power of two.
PARTS = 4
#: Stands for the number of documents of any hot column: in order of rarity these come after all others.
HOT_NUMBER = 1 << 40


def need(n, percent: int = 80):
    """Least overlap with a set of n, or of more, that links."""
    return (percent * n + 99) // 100


def tenth(n):
    return (n + 9) // 10


def width(n):
    """Shingles, in hash order, of a set of n that enter the matrix."""
    return n - need(n) + tenth(n)


def shared(n):
    """Of these, how many a partner of a set of n shares at least."""
    return tenth(need(n))


def text_sets(keys: pa.Array, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, shingle hashes by row and hash, row of each)."""
    ids = keys.to_numpy()
    for i, j, data, offsets in text_steps(texts):
        h, row, _, _ = hashed_words(data, offsets)
        g, r = shingles(h, row, j - i)
        yield ids[i:j], g, r


def stored_sets(ids: pa.Array, sets: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The same from sets that were written before."""
    ids = ids.to_numpy()
    for i in range(0, len(ids), 256):
        parts = [np.frombuffer(x.as_buffer(), np.uint64) for x in sets[i : i + 256]]
        yield ids[i : i + 256], np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(x) for x in parts])


def fingerprints(g: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Two sums over each set's shingles: equal sets have equal ones, and different sets different ones but for a chance of 2**-128."""
    begin = np.cumsum(n) - n
    two = np.zeros((len(n), 2), np.int64)
    full = np.flatnonzero(n > 0)
    for k, x in enumerate((mixed(g), mixed(g ^ np.uint64(0xA5A5A5A5A5A5A5A5)))):
        two[full, k] = np.add.reduceat(x, begin[full]).view(np.int64) if len(full) else 0
    return two


def _block_rows(blocks: int, sets_of, first_of, sizes: bool, least_hot: int = HOT):
    """A task's work on batches (ids, texts or sets): the first first_of(n) shingles of each set of n, in hash order, as rows (block, kind, a, b, c).

    ENTRY: a: hashes of a block of columns, b: the document of each. HOT_COLUMN: a: hashes of the block's columns that are hot in this
    task. HOT_ENTRY: hashes and documents of hot columns, sent to any block. SIZE, with sizes: a: documents, b: their numbers of
    shingles, c: two fingerprints of each set. Documents may have any number, negative ones too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, held, salt = [], 0, 0
        names = ["block", "kind", "a", "b", "c"]

        def row(block: int, kind: int, *arrays: np.ndarray) -> tuple:
            return (block, kind, *(np.ascontiguousarray(x).tobytes() for x in arrays), *[b""] * (3 - len(arrays)))

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal salt
            salt += 1
            h, d = (np.concatenate(x) for x in zip(*gathered, strict=True))
            order = np.argsort(h)
            h, d = h[order], d[order]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
            count = np.diff(np.append(first, len(h)))
            hot = np.repeat(count >= least_hot, count)
            rows = []
            if hot.any():
                for k, part in enumerate(np.array_split(np.flatnonzero(hot), max(1, int(hot.sum()) // 100_000))):
                    rows.append(row(int(mixed(np.array([salt * 1000 + k + int(h[0] >> np.uint64(1))], np.uint64))[0] % np.uint64(blocks)), HOT_ENTRY, h[part], d[part]))
            for kind, *columns in ((ENTRY, h[~hot], d[~hot]), (HOT_COLUMN, h[first[count >= least_hot]])):
                if not len(columns[0]):
                    continue
                block = (columns[0] % np.uint64(blocks)).astype(np.int64)
                order = np.argsort(block, kind="stable")
                block, columns = block[order], [x[order] for x in columns]
                cuts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
                for a, b in zip(cuts, np.append(cuts[1:], len(block)), strict=True):
                    rows.append(row(int(block[a]), kind, *(x[a:b] for x in columns)))
            for i in range(0, len(rows), 500):
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows[i : i + 500], strict=True), (pa.int32(), pa.int32(), *[pa.binary()] * 3), strict=True)], names)

        for batch in batches:
            for ids, g, r in sets_of(batch.column(0), batch.column(1)):
                ids = ids.astype(np.int64)
                n = np.bincount(r, minlength=len(ids))
                begin = np.cumsum(n) - n
                if sizes:
                    yield pa.record_batch([pa.array([x], t) for x, t in zip(row(int(ids[0]) % blocks, SIZE, ids, n.astype(np.int64), fingerprints(g, n)), (pa.int32(), pa.int32(), *[pa.binary()] * 3), strict=True)], names)
                inside = np.arange(len(g)) - begin[r] < first_of(n)[r]
                gathered.append((g[inside], ids[r[inside]]))
                held += int(inside.sum())
                if held >= GATHERED:
                    yield from flush()
                    gathered, held = [], 0
        if held:
            yield from flush()

    return run


def _multiplied(block: pd.DataFrame) -> pd.DataFrame:
    """Within a block of columns: each column's documents (y: their number) if there are two at least, sizes and hot entries as they come."""
    out = []
    names = ["kind", "doc", "x", "y", "z"]
    frame = lambda kind, doc, x, y, z: out.append(pd.DataFrame({"kind": np.full(len(doc), kind, np.int32), "doc": doc, "x": x, "y": y, "z": z}, columns=names))
    for kind in (SIZE, HOT_ENTRY):
        part = block[block["kind"] == kind]
        if len(part):
            a, b = np.frombuffer(b"".join(part["a"]), np.int64), np.frombuffer(b"".join(part["b"]), np.int64)
            if kind == SIZE:
                c = np.frombuffer(b"".join(part["c"]), np.int64).reshape(-1, 2)
                frame(SIZE, a, b, c[:, 0], c[:, 1])
            else:
                frame(HOT_ENTRY, b, a, np.full(len(a), HOT_NUMBER), np.zeros(len(a), np.int64))
    part = block[block["kind"] == ENTRY]
    if len(part):
        h, d = np.frombuffer(b"".join(part["a"]), np.int64), np.frombuffer(b"".join(part["b"]), np.int64)
        marks = np.frombuffer(b"".join(block.loc[block["kind"] == HOT_COLUMN, "a"]), np.int64)
        lone = np.repeat([False, True], [len(h), len(marks)])
        h, d = np.concatenate([h, marks]), np.concatenate([d, np.zeros(len(marks), np.int64)])
        order = np.argsort(h, kind="stable")
        h, d, lone = h[order], d[order], lone[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        count = np.diff(np.append(first, len(h)))
        docs = np.where(np.logical_or.reduceat(lone, first), HOT_NUMBER, count)
        number = np.repeat(docs, count)
        kept = (number >= 2) & ~lone
        frame(ENTRY, d[kept], h[kept], number[kept], np.zeros(int(kept.sum()), np.int64))
    return pd.concat(out) if out else pd.DataFrame({x: np.zeros(0, np.int64) for x in names})


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document and block of columns: its hashes there, perhaps none, in order."""
    for batch in batches:
        for ids, g, r in text_sets(batch.column(0), batch.column(1)):
            n = np.bincount(r, minlength=len(ids))
            sums = fingerprints(g, n)
            part = (g >> np.uint64(64 - (PARTS.bit_length() - 1))).astype(np.int64)
            ends = np.cumsum(np.bincount(r * PARTS + part, minlength=len(ids) * PARTS))
            starts = np.concatenate([[0], ends[:-1]])
            sets = pa.array([g[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary())
            keys = [np.repeat(x, PARTS) for x in (ids.astype(np.int64), n.astype(np.int64), sums[:, 0], sums[:, 1])]
            parts = pa.array(np.tile(np.arange(PARTS, dtype=np.int32), len(ids)))
            yield pa.record_batch([*map(pa.array, keys), parts, sets], ["doc", "n", "f", "g", "part", "set"])


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Overlaps in one block of columns: both lists are sorted without repeats, so what they share is what they together have twice."""
    for batch in batches:
        shared = np.zeros(len(batch), np.int64)
        for i, (a, b) in enumerate(zip(batch.column(4), batch.column(5), strict=True)):
            both = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in (a, b)])
            both.sort(kind="stable")
            shared[i] = np.count_nonzero(both[1:] == both[:-1])
        yield pa.record_batch([*(batch.column(k) for k in range(4)), pa.array(shared)], ["a", "b", "n", "m", "o"])


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of pairs (a, b, n, m), n and m their sizes, whose Jaccard similarity is 0.8 or more."""
    left = pairs.join(sets.select(F.col("doc").alias("a"), "part", F.col("set").alias("s")), "a")
    both = left.join(sets.select(F.col("doc").alias("b"), "part", F.col("set").alias("t")), ["b", "part"])
    partial = both.select("a", "b", "n", "m", "s", "t").mapInArrow(_overlaps, "a long, b long, n long, m long, o long")
    product = partial.groupBy("a", "b", "n", "m").agg(F.sum("o").alias("o"))
    return product.filter("100 * o >= 80 * (n + m - o)").select("a", "b")


def _roots(hooks: DataFrame, path: str) -> DataFrame:
    """(doc, label): where the way from each document along hooks (doc, label) ends, labels being documents of hooks too. Each step doubles the ways, so there are as many as the logarithm of the longest."""
    step, changed = 0, True
    while changed:
        step += 1
        jump = hooks.select(F.col("doc").alias("via"), F.col("label").alias("far"))
        hooks = stored(hooks.join(jump, F.col("label") == F.col("via")).select("doc", F.col("far").alias("label"), (F.col("far") != F.col("label")).alias("moved")), f"{path}-{step}")
        changed = hooks.filter("moved").limit(1).count()
        hooks = hooks.select("doc", "label")
    return hooks


def components(edges: DataFrame, path: str) -> DataFrame:
    """(doc, label): the smallest document that each document of edges (a, b) reaches.

    Each round hooks every document to its smallest neighbour if that is smaller, follows the hooks to their roots, and keeps the
    edges between different roots, until there are none. A root that is left after a round has taken in all its neighbours, or one
    of these went to a smaller root, to which it hooks in the next round: two rounds halve the roots of a component at least.
    """
    both = stored(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{path}/edges-0")
    labels, i = None, 0
    while True:
        hooks = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "doc"), f"{path}/hooks-{i}")
        roots = _roots(hooks, f"{path}/roots-{i}")
        far = roots.select(F.col("doc").alias("via"), F.col("label").alias("far"))
        labels = roots if labels is None else stored(labels.join(far, F.col("label") == F.col("via"), "left").select("doc", F.coalesce("far", "label").alias("label")), f"{path}/labels-{i}")
        near = both.join(roots.select(F.col("doc").alias("a"), F.col("label").alias("x")), "a").join(roots.select(F.col("doc").alias("b"), F.col("label").alias("y")), "b")
        i += 1
        both = stored(near.filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), f"{path}/edges-{i}")
        if not both.limit(1).count():
            return labels


def fitting(n: Column, m: Column) -> Column:
    """Sizes that allow a link."""
    return F.floor((80 * F.greatest(n, m) + 99) / 100) <= F.least(n, m)


def fewest(n: Column, m: Column) -> Column:
    """Rare columns that a linked pair of these sizes shares at least."""
    least = lambda x: F.floor((80 * x + 99) / 100)
    return F.ceil(80 * (n + m) / 180) - F.greatest(least(n), least(m)) + 1


MATRIX = "block int, kind int, a binary, b binary, c binary"
PRODUCT = "kind int, doc long, x long, y long, z long"


def _shared_columns(product: DataFrame) -> DataFrame:
    """(doc, h, df): the columns of each document that others have."""
    return product.filter(F.col("kind") != SIZE).select("doc", F.col("x").alias("h"), F.col("y").alias("df"))


def _identity(n):
    return n


def ngram_components(docs: DataFrame, path: str | None = None, rounds: int = 10) -> DataFrame:
    """doc_id, n_shingles, component_id for documents (doc_id, text), a row for each doc_id.

    doc_id is a key: rows that repeat one wholly count once, rows without one are left out. Of rows with one doc_id and different
    texts the one with the most shingles counts, among equals the one of the largest fingerprints. A text with fewer than five
    words has its whole sequence as its only shingle; null, empty and blank texts have none and are linked with nothing. A very
    long text is one step.
    """
    spark = docs.sparkSession
    path = path or new_dir(spark, "ngram")
    base = documents_of(docs).filter("doc_id IS NOT NULL")
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // BLOCK_TEXT)

    hot = max(2, min(HOT, COLUMN_ENTRIES // max(blocks, size // GATHERED + 1)))

    # 1: the first columns of all documents
    matrix = base.mapInArrow(_block_rows(blocks, text_sets, width, True, hot), MATRIX)
    product = stored(matrix.groupBy("block").applyInPandas(_multiplied, PRODUCT), f"{path}/product")
    sizes = product.filter(F.col("kind") == SIZE).groupBy("doc").agg(F.max(F.struct("x", "y", "z")).alias("s"))
    sizes = stored(sizes.select("doc", F.col("s.x").alias("n"), F.col("s.y").alias("f"), F.col("s.z").alias("g")), f"{path}/sizes")
    kept = _shared_columns(product).groupBy("doc").agg(F.count("*").alias("k"))
    kept = stored(kept.join(sizes, "doc").filter("k >= ((80 * n + 99) div 100 + 9) div 10"), f"{path}/kept")

    # 2: one document of each set, whole rows
    same = stored(kept.groupBy("n", "f", "g").agg(F.min("doc").alias("rep")), f"{path}/same")
    ours = kept.select("doc", F.col("n").alias("n1"), F.col("f").alias("f1"), F.col("g").alias("g1"))
    reps = stored(ours.join(same, (F.col("n1") == F.col("n")) & (F.col("f1") == F.col("f")) & (F.col("g1") == F.col("g"))).select("doc", "rep", "n", "f", "g"), f"{path}/reps")
    wanted = small_side(stored(reps.filter("doc = rep").select(F.col("doc").alias("doc_id"), "n", "f", "g"), f"{path}/wanted"))
    sets = base.join(wanted.select("doc_id"), "doc_id", "left_semi").mapInArrow(_sets, "doc long, n long, f long, g long, part int, set binary")
    sets = sets.join(wanted.withColumnRenamed("doc_id", "doc"), ["doc", "n", "f", "g"], "left_semi").select("doc", "part", "set").dropDuplicates(["doc", "part"])
    sets = stored(sets, f"{path}/sets")
    remove_dir(spark, f"{path}/product")
    matrix = sets.select("doc", "set").mapInArrow(_block_rows(blocks, stored_sets, _identity, False, hot), MATRIX)
    product = stored(matrix.groupBy("block").applyInPandas(_multiplied, PRODUCT), f"{path}/whole")
    rows = _shared_columns(product).groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("row"))  # as long as its text at most
    rows = rows.join(sizes.select("doc", "n"), "doc").filter(F.size("row") >= F.expr("(80 * n + 99) div 100"))
    # rarest first: columns that nobody else has come before all others and match nothing
    first = F.expr("slice(row, 1, greatest(0, n - (80 * n + 99) div 100 + 1 - (n - size(row))))")
    firsts = stored(rows.select("doc", "n", F.transform(first, lambda x: x["h"]).alias("first")), f"{path}/firsts")
    posts = stored(firsts.select("doc", "n", F.size("first").alias("c"), F.posexplode("first").alias("pos", "h")), f"{path}/posts")
    remove_dir(spark, f"{path}/whole")

    # 3: pairs
    named = posts.withColumn("label", F.col("doc"))
    labels = tried = edges = None
    enough = F.least("c", "c2") >= fewest(F.col("n"), F.col("m"))
    for i in range(rounds):
        at = f"{path}/round-{i}"
        draw = F.struct((F.col("doc") if i == 0 else F.xxhash64("doc", "h", F.lit(i))).alias("drawn"), "doc", "n", "c", "label")
        pivots = named.groupBy("h").agg(F.min(draw).alias("p"), F.min("label").alias("x"), F.max("label").alias("y")).filter("x < y")
        pivots = stored(pivots.select(F.col("h").alias("open"), F.col("p.doc").alias("b"), F.col("p.n").alias("m"), F.col("p.c").alias("c2"), F.col("p.label").alias("other")), f"{at}/pivots")
        near = named.join(pivots, (F.col("h") == F.col("open")) & (F.col("label") != F.col("other")) & fitting(F.col("n"), F.col("m")) & enough)
        near = near.groupBy("doc", "b", "n", "m").agg(F.count("*").alias("k")).filter(F.col("k") >= fewest(F.col("n"), F.col("m")))
        if tried is not None:
            near = near.join(tried.select(F.col("a").alias("doc"), "b"), ["doc", "b"], "left_anti")
        # of what its columns propose, each document takes the pivot it shares most with
        best = near.groupBy("doc", "n").agg(F.max(F.struct("k", F.bitwise_not("b").alias("minus"), "m")).alias("top"))
        pairs = stored(best.select(F.col("doc").alias("a"), F.bitwise_not("top.minus").alias("b"), "n", "top.m"), f"{at}/pairs")
        found = stored(linked(pairs, sets), f"{at}/links")
        n_pairs, n_found = pairs.count(), found.count()
        if not n_found:
            break
        tried = pairs.select("a", "b") if tried is None else tried.unionByName(pairs.select("a", "b"))
        edges = found if edges is None else edges.unionByName(found)
        labels = components(edges, f"{at}/components")
        joined = posts.join(labels.withColumnRenamed("doc", "of"), posts["doc"] == F.col("of"), "left")
        named = stored(joined.select("h", "doc", "n", "c", "pos", F.coalesce("label", "doc").alias("label")), f"{at}/named")
        if 4 * n_found < n_pairs:
            break

    several = named.groupBy("h").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x < y").select(F.col("h").alias("open"))
    left = stored(named.join(stored(several, f"{path}/open"), F.col("h") == F.col("open")).select("h", "doc", "n", "c", "pos", "label"), f"{path}/left")
    # each larger set looks among the sizes that its own columns allow: a column of very many documents isn't paired wholly
    size_bin = lambda n: F.floor(F.ln(n.cast("double")) / SIZE_BIN)
    smallest = F.floor((80 * F.col("n") + 99) / 100)
    largest = F.least(F.col("n").cast("double"), F.floor((smallest + F.col("c") - 1) * 180 / 80) - F.col("n"))
    larger = left.filter(largest >= smallest).withColumn("bin", F.explode(F.sequence(size_bin(smallest), size_bin(largest))))
    smaller = left.select(F.col("h").alias("h2"), F.col("doc").alias("b"), F.col("n").alias("m"), F.col("c").alias("c2"), F.col("pos").alias("pos2"), F.col("label").alias("other"), size_bin(F.col("n")).alias("bin2"))
    ordered = (F.col("m") < F.col("n")) | (F.col("m") == F.col("n")) & (F.col("b") < F.col("doc"))
    # of the columns that a pair must share, the first one leaves room for the others behind it in both
    room = F.least(F.col("c") - F.col("pos"), F.col("c2") - F.col("pos2")) >= fewest(F.col("n"), F.col("m"))
    pairs = larger.join(smaller, (F.col("h") == F.col("h2")) & (F.col("bin") == F.col("bin2")) & ordered & (F.col("label") != F.col("other")) & fitting(F.col("n"), F.col("m")) & room)
    pairs = stored(pairs.select(F.col("doc").alias("a"), "b").distinct(), f"{path}/proposed")
    pairs = pairs.join(firsts.select(F.col("doc").alias("a"), "n", F.col("first").alias("s")), "a").join(firsts.select(F.col("doc").alias("b"), F.col("n").alias("m"), F.col("first").alias("t")), "b")
    pairs = pairs.filter(F.size(F.array_intersect("s", "t")) >= fewest(F.col("n"), F.col("m"))).select("a", "b", "n", "m")
    found = stored(linked(stored(pairs, f"{path}/pairs"), sets), f"{path}/links")
    if found.limit(1).count():
        labels = components(found if edges is None else edges.unionByName(found), f"{path}/last")

    # classes of equal sets reach what their first document reaches
    if labels is None:
        joined = reps.select(F.col("doc").alias("of"), F.col("rep").alias("smallest"))
    else:
        joined = reps.select("doc", "rep").join(labels.withColumnRenamed("doc", "at"), F.col("rep") == F.col("at"), "left")
        joined = joined.select(F.col("doc").alias("of"), F.coalesce("label", "rep").alias("smallest"))
    joined = stored(joined, f"{path}/components")
    out = sizes.join(joined, sizes["doc"] == F.col("of"), "left")
    out = out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("smallest", "doc").alias("component_id"))
    out = stored(out, f"{path}.result")
    remove_dir(spark, path)
    return out
