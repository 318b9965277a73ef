"""A Merkle manifest of a dataset: a tree of leaves for each source, a tree of the sources above them, a proof for every row.

Leaves of a source in order are cut into aligned blocks of fanout ** depth of them. A task hashes its block's own tree; then blocks
swap subtree roots by a butterfly exchange. In round r the fanout blocks that differ in digit r of their number alone exchange the
roots of the subtrees they stand in; each of them hashes the common ancestor itself and writes down the others as its proof's next
level. After as many rounds as block numbers have digits every block has all its upper proof and the root, and nothing was sent
down. Numbers are padded with empty blocks to a power of the fanout: an empty block learns the subtree it stands in as all others
do, so that the last, shorter runs need no rule of their own. No exchange has more than fanout rows, however large a source.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import new_dir, small_side, stored

FANOUT, DEPTH = 3, 7


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(*fields: Column) -> Column:
    """Hash of a row's fields in order: `-` for null, else its number of bytes, a colon and the value."""
    texts = [f.cast("string") for f in fields]
    return F.unhex(F.sha2(F.concat(*(F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts)).cast("binary"), 256))


def placed(leaves: DataFrame, order: list[str], path: str) -> DataFrame:
    """Leaves (tree, ..., leaf) with pos, their place in the tree, and n, its size: sorted by ranges, then running sums over the ranges' sizes.

    Equal rows are told apart by their place in the input, so that very many of them don't meet in one range.
    """
    at = leaves.withColumn("_tie", F.monotonically_increasing_id())
    by = ["tree", *order, "leaf", "_tie"]
    at = at.repartitionByRange(*by).sortWithinPartitions(*by).drop("_tie").withColumn("_id", F.monotonically_increasing_id())
    at = stored(at.withColumn("_range", F.shiftright("_id", 33)), f"{path}/sorted")
    sizes = at.groupBy("tree", "_range").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))  # a row a tree and range that it touches
    before = Window.partitionBy("tree").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumns({"_before": F.coalesce(F.sum("_n").over(before), F.lit(0)), "n": F.sum("_n").over(Window.partitionBy("tree"))}).drop("_n")
    at = at.join(small_side(stored(sizes, f"{path}/sizes")), ["tree", "_range"])
    return at.withColumn("pos", F.col("_id") - F.col("_first") + F.col("_before")).drop("_id", "_range", "_first", "_before")


def blocks_of(leaves: DataFrame, carried: list[str], fanout: int, depth: int) -> DataFrame:
    """(tree, n, block, leaves): the leaves of an aligned block in order, fanout ** depth at most, each with its carried columns."""
    size = F.lit(fanout**depth)
    at = leaves.withColumn("block", F.floor(F.col("pos") / size))
    return at.groupBy("tree", "n", "block").agg(F.sort_array(F.collect_list(F.struct("pos", "leaf", *carried))).alias("leaves"))


def levels(nodes: list[str], rounds: int, fanout: int) -> list[list[str]]:
    """The nodes and, round by round, the hashes of their runs."""
    out = [nodes]
    for _ in range(rounds):
        out.append([sha(*out[-1][i : i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def height(n: int, fanout: int) -> int:
    """Rounds until n nodes are one."""
    h = 0
    while n > 1:
        n, h = -(-n // fanout), h + 1
    return h


def siblings(tree: list[list[str]], i: int, fanout: int) -> list[tuple[str, str]]:
    """What stands left and right of leaf i's ancestors in their runs, joined, level by level below the top."""
    out = []
    for nodes in tree[:-1]:
        run = i - i % fanout
        out.append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + fanout])))
        i //= fanout
    return out


def folded(node: str, path: list[tuple[str, str]]) -> str:
    for left, right in path:
        node = sha(left, node, right)
    return node


PATH = "array<struct<left:string,right:string>>"


def exchanged(blocks: DataFrame, fanout: int, depth: int, path: str) -> DataFrame:
    """(tree, block, root, path): each block's upper proof and its tree's root, by butterfly rounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots = []
            for n, leaves in zip(batch.column(1).to_pylist(), batch.column(3), strict=True):
                rounds = min(depth, height(n, fanout))
                roots.append(levels([x.hex() for x in leaves.values.field("leaf").to_pylist()], rounds, fanout)[-1][0])
            yield pa.record_batch([*batch.columns[:3], pa.array(roots, pa.string())], ["tree", "n", "block", "node"])

    at = stored(blocks.mapInArrow(run, "tree string, n long, block long, node string"), f"{path}/roots")
    most = at.agg(F.max("n")).first()[0] or 0
    rounds = max(0, height(most, fanout) - depth)
    at = at.withColumn("count", F.ceil(F.col("n") / F.lit(fanout**depth)))
    # the smallest power of the fanout that holds all blocks
    padded = F.coalesce(*(F.when(F.col("count") <= fanout**r, F.lit(fanout**r)) for r in range(rounds + 1))).cast("long")
    more = at.filter(F.col("block") == F.col("count") - 1).filter(F.col("count") < padded).withColumn("block", F.explode(F.sequence(F.col("count"), padded - 1))).withColumn("node", F.lit(None).cast("string"))
    at = at.unionByName(more).withColumn("path", F.array().cast(PATH))
    for r in range(rounds):
        digit = F.floor(F.col("block") / F.lit(fanout**r)) % fanout
        w = Window.partitionBy("tree", F.floor(F.col("block") / F.lit(fanout ** (r + 1))), F.col("block") % F.lit(fanout**r))
        at = at.withColumn("_d", digit).withColumn("_mates", F.sort_array(F.collect_list(F.struct("_d", "node")).over(w)))
        joined = lambda keep: F.array_join(F.transform(F.filter("_mates", keep), lambda m: m["node"]), "")
        other = F.struct(joined(lambda m: m["_d"] < F.col("_d")).alias("left"), joined(lambda m: m["_d"] > F.col("_d")).alias("right"))
        all_of = joined(lambda m: F.lit(True))
        active = F.col("count") > fanout**r
        up = F.when(all_of != "", F.sha2(all_of.cast("binary"), 256))
        at = at.withColumns({"node": F.when(active, up).otherwise(F.col("node")), "path": F.when(active, F.concat("path", F.array(other))).otherwise(F.col("path"))}).drop("_d", "_mates")
    return stored(at.filter(F.col("block") < F.col("count")).select("tree", "block", F.col("node").alias("root"), "path"), f"{path}/upper")


def _unfolded(blocks: DataFrame, upper: DataFrame, fanout: int, depth: int, emit: Callable[[dict, list[tuple[str, str]], dict], tuple], schema: str) -> DataFrame:
    """emit(leaf, its proof up to its tree's root, upper's row) for each leaf of the blocks, once they have met their upper proofs."""
    kinds = pa.schema([(f.split()[0], {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), PATH: pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))}[f.split()[1]]) for f in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1).to_pylist()[0]
                nodes = row.pop("leaves")
                own = levels([x["leaf"].hex() for x in nodes], min(depth, height(row["n"], fanout)), fanout)
                above = [(p["left"], p["right"]) for p in row.pop("path")]
                out = [emit(x, siblings(own, k, fanout) + above, row) for k, x in enumerate(nodes)]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds.types, strict=True)], schema=kinds)

    return blocks.join(upper, ["tree", "block"]).mapInArrow(run, schema)


def manifest(docs: DataFrame, checked_text: Callable[[Column, Column], Column] | None = None, digests: bool = False, fanout: int = FANOUT, depth: int = DEPTH, path: str | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root and proof of every row of docs (doc_id, source, lang, n_chars, text), as lowercase hex sha256.

    A source's leaves ascend by doc_id, null first, then by leaf. While several nodes remain, every `fanout` consecutive ones become
    the hash of theirs, joined; sources' subroots, null first and then by their bytes, likewise. proof: [(left, right)] by level, the
    joined siblings on both sides, so that folding a leaf into it gives the root.

    checked_text(doc_id, text): the text of a copy of docs that is checked against the manifest. Then the columns folded_root (from
    the copy's leaf and the proof) and verified (whether it is the root) come too; digests: proof_sha256, the hash of all siblings
    joined, in place of proof. Rows that repeat are leaves each; a null text is hashed as `-`; an empty table has no rows; other
    columns aren't read. Texts are hashed where they are read, none is shuffled.
    """
    path = path or new_dir(docs.sparkSession, "merkle")
    key, source = docs["doc_id"].cast("long"), docs["source"].cast("string")
    leaf = lambda text: leaf_of(key, source, docs["lang"], docs["n_chars"].cast("long"), text)
    text = docs["text"].cast("string")
    changed = checked_text(key, text) if checked_text else text
    copy = F.when(~changed.eqNullSafe(text), leaf(changed))  # null where nothing changed
    tree = F.when(source.isNull(), "n").otherwise(F.concat(F.lit("s"), source))  # in the order of sources
    hashed = stored(docs.select(tree.alias("tree"), key.alias("doc_id"), leaf(text).alias("leaf"), copy.alias("copy")), f"{path}/hashed")  # sorting reads its input twice
    leaves = placed(hashed, ["doc_id"], f"{path}/leaves")
    blocks = stored(blocks_of(leaves, ["doc_id", "copy"], fanout, depth), f"{path}/blocks")
    upper = exchanged(blocks, fanout, depth, f"{path}/rounds")
    subroots = upper.filter("block = 0").select(F.lit("").alias("tree"), F.col("tree").alias("of"), F.unhex("root").alias("leaf"))
    tops = stored(blocks_of(placed(subroots, ["of"], f"{path}/subroots"), ["of"], fanout, depth), f"{path}/top_blocks")
    above = exchanged(tops, fanout, depth, f"{path}/top_rounds")
    of_source = _unfolded(tops, above, fanout, depth, lambda x, p, r: (x["of"], r["root"], [{"left": a, "right": b} for a, b in p]), f"tree string, root string, upward {PATH}")
    of_source = small_side(stored(of_source, f"{path}/sources"))
    upper = upper.withColumnRenamed("root", "subroot").join(of_source, "tree").withColumn("path", F.concat("path", "upward")).drop("upward")
    upper = small_side(stored(upper, f"{path}/proofs"), 100_000)  # some KB a row

    def emit(x: dict, proof: list[tuple[str, str]], row: dict) -> tuple:
        leaf = x["leaf"].hex()
        shown = sha(*(s for p in proof for s in p)) if digests else [{"left": a, "right": b} for a, b in proof]
        out = (x["doc_id"], leaf, row["subroot"], row["root"], shown)
        if checked_text is None:
            return out
        again = folded(x["copy"].hex() if x["copy"] is not None else leaf, proof)
        return (*out, again, again == row["root"])

    schema = f"doc_id long, leaf string, subroot string, root string, {'proof_sha256 string' if digests else f'proof {PATH}'}"
    return _unfolded(blocks, upper, fanout, depth, emit, schema + (", folded_root string, verified boolean" if checked_text else ""))


def tampered(key: Column, text: Column) -> Column:
    """The text without line ends where the unsigned crc32 of the decimal doc_id is even."""
    return F.when(F.crc32(key.cast("string").cast("binary")) % 2 == 0, F.translate(text, "\n", "")).otherwise(text)
