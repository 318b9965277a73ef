"""Token ids in binary files, coded by range asymmetric numeral systems (rANS) under one static frequency table.

File format. A file is a sequence of frames, each followed by one byte "\\n". Integers are little-endian.
Frame: b"TANS", format 1 (u16), lanes (u16), crc32 of the frequency table (u32), documents (u32), blocks (u32), first id's
place within its file (i64), bytes of the blocks (i64), crc32 of all that stands before (u32); document ids (i64 each); their ids'
counts (i64 each); the blocks.
Block: ids (u32), words (u32), checkpoints (u32), crc32 of the ids as u32 (u32), crc32 of states and words (u32); for the
block's begin and each checkpoint the place of the next word (u32 each) and a state of every lane (u64 each); words (u32 each).
Id i of a block is coded by lane i % lanes; rows of one id a lane are decoded one after the other, lanes that run low take
their next words in lane order. Blocks are independent of one another, and so are the stretches between checkpoints.

The table is a file of its own, written before the frames: quantised to a sum of 2**20, every id that occurs has 1 at least.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Known, byte_steps, documents_of, new_dir, remove_dir, stored

SCALE = 20
LOW = np.uint64(1 << 31)
HEAD, BLOCK = struct.Struct("<4sHHIIIqqI"), struct.Struct("<IIIII")
U = np.uint64


class Table:
    """Static frequencies: freq, the sums before each id, and the id of each of the 2**20 slots."""

    def __init__(self, freq: np.ndarray):
        self.freq, self.raw = freq.astype(np.uint64), freq.astype("<u4").tobytes()
        self.before = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self.crc = zlib.crc32(self.raw)
        self._slots: np.ndarray | None = None

    @property
    def slots(self) -> np.ndarray:
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._slots

    @classmethod
    def of_counts(cls, counts: np.ndarray) -> Table:
        """Quantise counts to a sum of 2**20; the largest take up what rounding leaves or lacks."""
        total, goal = int(counts.sum()), 1 << SCALE
        if not total:
            return cls(np.array([goal]))
        freq = np.where(counts > 0, np.maximum(1, counts * (goal / total)).astype(np.int64), 0)
        while gap := goal - int(freq.sum()):
            order = np.argsort(-freq, kind="stable")[: abs(gap)]
            order = order if gap > 0 else order[freq[order] > 1]
            freq[order] += 1 if gap > 0 else -1
        return cls(freq)


def encode_block(ids: np.ndarray, table: Table, lanes: int, every: int) -> bytes:
    """One block; a checkpoint every `every` rows."""
    n = len(ids)
    rows = -(-n // lanes)
    state = np.full(lanes, LOW, np.uint64)
    words: list[np.ndarray] = []
    marks: list[tuple[int, np.ndarray]] = []
    for r in range(rows - 1, -1, -1):
        part = ids[r * lanes : (r + 1) * lanes]
        k = len(part)
        f, c, x = table.freq[part], table.before[part], state[:k]
        out = x >= f << U(63 - SCALE)
        words.append((x[out] & U(0xFFFFFFFF)).astype("<u4"))
        x = np.where(out, x >> U(32), x)
        q = x // f
        state[:k] = (q << U(SCALE)) + (x - q * f) + c
        if r % every == 0:
            marks.append((len(words), state.copy()))
    words.reverse()
    places = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    stream = np.concatenate(words).astype("<u4").tobytes() if words else b""
    marks.reverse()
    heads = np.array([places[len(words) - k] for k, _ in marks], "<u4").tobytes() + b"".join(s.astype("<u8").tobytes() for _, s in marks)
    return BLOCK.pack(n, len(stream) // 4, max(0, len(marks) - 1), zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(heads + stream)) + heads + stream


def decode_block(data: memoryview, table: Table, lanes: int, every: int, only: int | None = None) -> tuple[np.ndarray, int]:
    """(ids, bytes of the block). All stretches between checkpoints are decoded side by side; only: the ids of one of them."""
    n, n_words, extra, crc, crc_coded = BLOCK.unpack_from(data)
    marks = extra + 1 if n else 0
    size = BLOCK.size + marks * (4 + 8 * lanes) + 4 * n_words
    coded = data[BLOCK.size : size]
    if zlib.crc32(coded) != crc_coded:
        raise ValueError("a block's coded bytes don't match their checksum")
    at = np.frombuffer(coded, "<u4", marks).astype(np.int64)
    state = np.frombuffer(coded, "<u8", marks * lanes, 4 * marks).reshape(marks, lanes).astype(np.uint64)
    words = np.frombuffer(coded, "<u4", n_words, marks * (4 + 8 * lanes)).astype(np.uint64)
    rows, begin = -(-n // lanes), np.arange(marks) * every
    if only is not None:
        at, state, begin = at[only : only + 1], state[only : only + 1], begin[only : only + 1]
    first, last = (int(begin[0]), min(rows, int(begin[-1]) + every)) if len(begin) else (0, 0)
    out = np.zeros((last - first, lanes), np.uint32)
    for step in range(min(every, last - first)):
        live = int(np.searchsorted(begin, last - step))  # the last stretch may be shorter
        x, row = state[:live], begin[:live] + step
        slot = x & U((1 << SCALE) - 1)
        ids = table.slots[slot]
        out[row - first] = ids
        x = table.freq[ids] * (x >> U(SCALE)) + slot - table.before[ids]
        need = x < LOW
        if row[-1] == rows - 1 and n % lanes:  # lanes beyond the last id
            need[-1, n % lanes :] = False
        count = need.sum(1)
        from_ = np.repeat(at[:live] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
        x[need] = (x[need] << U(32)) | words[from_]
        at[:live] += count
        state[:live] = x
    ids = out.reshape(-1)[: min(n, last * lanes) - first * lanes]
    if only is None and zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError("a block's ids don't match their checksum")
    return ids, size


def encode_frame(doc_ids: list[int], parts: list[np.ndarray], begin: int, table: Table, lanes: int, every: int, block_ids: int) -> bytes:
    ids = np.concatenate(parts) if parts else np.zeros(0, np.uint16)
    blocks = [encode_block(ids[i : i + block_ids], table, lanes, every) for i in range(0, len(ids), block_ids)]
    head = HEAD.pack(b"TANS", 1, lanes, table.crc, len(doc_ids), len(blocks), begin, sum(map(len, blocks)), 0)[:-4]
    lists = np.array(doc_ids, "<i8").tobytes() + np.array([len(p) for p in parts], "<i8").tobytes()
    return head + struct.pack("<I", zlib.crc32(head)) + lists + b"".join(blocks)


def frames(data: memoryview) -> Iterator[tuple[memoryview, int, int, int, int, int]]:
    """(documents' lists and blocks, lanes, crc of the table, documents, blocks, begin) of each frame."""
    at = 0
    while at < len(data):
        magic, version, lanes, crc, docs, blocks, begin, size, own = HEAD.unpack_from(data, at)
        if magic != b"TANS" or version != 1 or zlib.crc32(data[at : at + HEAD.size - 4]) != own:
            raise ValueError("not a frame, or a damaged one")
        at += HEAD.size
        end = at + 16 * docs + size
        yield data[at:end], lanes, crc, docs, blocks, begin
        at = end + 1  # the newline


#: Text bytes of a step, and bytes of pieces that are kept from one step to the next.
STEP, KEPT = 2 << 20, 48 << 20
#: Texts in which lower case depends on more than the single character, or special strings may stand, keep their case.
AS_IT_IS = "<\\||[^\x00-\u024f]"
LETTERS = re.compile("[a-z\xe0-\xf6\xf8-\xff]+")
#: A word of Latin letters and marks that the tokenizer parts from it.
MARKED = "([a-z\xe0-\xf6\xf8-\xff])([.,!?;:|*%$&#()\"<>]+)( |$)"


class Encoder:
    """From texts to ids as u16 bytes.

    The tokenizer folds case and drops white space between words, so a text's ids are those of its pieces between spaces, and each
    different piece is encoded once. Marks at the end of a word of Latin letters are parted from it, as the tokenizer does. New
    words of such letters go through its model together, with the same vocabulary but without the normaliser and splitter, which
    leave them as they are; a word ends where an end-of-word token stands. All other pieces go through the tokenizer as it is.
    """

    def __init__(self, path: str, end_id: int | None = None):
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id = Tokenizer.from_file(path), end_id
        lean = json.loads(self.tokenizer.to_str())
        split = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        lean |= {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, split]}, "post_processor": None}
        self.lean = Tokenizer.from_str(json.dumps(lean))
        self.ends = np.zeros(1 << 16, bool)
        self.ends[[i for w, i in self.tokenizer.get_vocab().items() if w.endswith("</w>")]] = True
        self.known = Known(self._encoded, KEPT)

    def _encoded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each piece, the ids of all)."""
        letters = [i for i, p in enumerate(pieces) if LETTERS.fullmatch(p)]
        others = [i for i, p in enumerate(pieces) if not LETTERS.fullmatch(p)]
        places, sizes, ids = [], [], []
        for i in range(0, len(letters), 10_000):
            parts = [letters[k : k + 100] for k in range(i, min(i + 10_000, len(letters)), 100)]
            for part, e in zip(parts, self.lean.encode_batch_fast([" ".join([pieces[k] for k in p]) for p in parts], add_special_tokens=False), strict=True):
                own = np.array(e.ids, "<u2")
                cuts = np.flatnonzero(self.ends[own]) + 1
                if len(cuts) != len(part) or cuts[-1] != len(own):
                    others.extend(part)
                    continue
                places.append(part), sizes.append(np.diff(cuts, prepend=0)), ids.append(own)
        for i in range(0, len(others), 1_000):
            part = others[i : i + 1_000]
            for e in self.tokenizer.encode_batch_fast([pieces[k] for k in part], add_special_tokens=False):
                ids.append(np.array(e.ids, "<u2")), sizes.append(np.array([len(ids[-1])]))
            places.append(part)
        order, size, pool = np.concatenate(places), np.concatenate(sizes), np.concatenate(ids)
        out = np.zeros(len(pieces), np.int64)
        out[order] = size
        # the ids in the order of the pieces
        begin = np.zeros(len(pieces), np.int64)
        begin[order] = np.cumsum(size) - size
        upto = np.cumsum(out) - out
        return out, pool[np.repeat(begin - upto, out) + np.arange(int(out.sum()))]

    def encode(self, texts: pa.Array) -> pa.Array:
        """The ids of each text, and end_id behind them if there is one."""
        kept = pc.match_substring_regex(texts, AS_IT_IS).to_pylist()
        low = pa.array([(t if k else t.lower()).replace("\n", " ") for t, k in zip(texts.to_pylist(), kept, strict=True)], pa.string())
        words = pc.split_pattern(pc.if_else(pa.array(kept, pa.bool_()), low, pc.replace_substring_regex(low, MARKED, "\\1 \\2\\3")), " ")
        coded = words.flatten().dictionary_encode()
        rows = self.known.rows(coded.dictionary)[coded.indices.to_numpy()]
        n, begin = self.known.size[rows], (np.cumsum(self.known.size) - self.known.size)[rows]
        # each word's ids from the known ones, one after the other, with a place left behind each text
        upto = np.concatenate([[0], np.cumsum(n)])
        source = np.repeat(begin - upto[:-1], n) + np.arange(int(upto[-1]))
        ends = upto[words.offsets.to_numpy()][1:]
        extra = 0 if self.end_id is None else 1
        out = np.full(int(upto[-1]) + extra * len(texts), self.end_id or 0, "<u2")
        out[np.arange(len(source)) + extra * np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))] = self.known.pool[source]
        offsets = np.concatenate([[0], 2 * (ends + extra * np.arange(1, len(texts) + 1))]).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(out.tobytes())])


def tokenised(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(doc_id, ids): the ids of each whole text and end_id, u16 each; a null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = Encoder(tokenizer, end_id)
        for batch in batches:
            for a, b in byte_steps(batch.column(1), STEP):
                yield pa.record_batch([batch.column(0).slice(a, b - a), encoder.encode(batch.column(1).slice(a, b - a))], ["doc_id", "ids"])

    return documents_of(docs).mapInArrow(run, "doc_id long, ids binary")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << 16, np.int64)
    for batch in batches:
        for i in range(0, len(batch), 512):
            ids = np.frombuffer(b"".join(batch.column(0)[i : i + 512].to_pylist()), "<u2")
            total += np.bincount(ids, minlength=1 << 16)
    seen = np.flatnonzero(total)
    yield pa.record_batch([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["id", "n"])


def frequencies(tokens: DataFrame) -> np.ndarray:
    """Counts of all ids over all documents, summed in Spark; at most the 65,536 ids there are reach the driver."""
    counts = np.zeros(1 << 16, np.int64)
    for r in tokens.select("ids").mapInArrow(_counted, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r["id"]] = r["n"]
    return counts[: int(np.flatnonzero(counts).max(initial=0)) + 1]


#: Stands for a null doc_id in files.
NO_ID = -(1 << 63)


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, lanes: int = 1024, block_ids: int = 1 << 18, every: int = 128, frame_ids: int = 1 << 19, file_bytes: int = 64 << 20) -> None:
    """Write the ids of docs (doc_id, text) under path: the table in path/table, frames in path/ids, files and frames by ascending doc_id.

    Repeated ids of documents stand one after the other by their ids; null ones come first.
    """
    spark = docs.sparkSession
    staged = stored(tokenised(docs, tokenizer, end_id), f"{path}/staged")
    counts = frequencies(staged)
    table = Table.of_counts(counts)
    raw = spark.createDataFrame([(bytearray(table.raw),)], "value binary")
    raw.select(F.col("value").cast("string")).coalesce(1).write.option("lineSep", "\n").text(f"{path}/table")
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(counts.sum()) * 2 // file_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Table(np.frombuffer(freq, "<u4"))
        ids, parts, begin, held = [], [], 0, 0
        frame = lambda: pa.record_batch([pa.array([encode_frame(ids, parts, begin, own, lanes, every, block_ids)], pa.binary())], ["value"])
        for batch in batches:
            for key, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = np.frombuffer(x.as_py(), "<u2")
                if ids and held + len(part) > frame_ids:
                    yield frame()
                    begin, held, ids, parts = begin + held, 0, [], []
                ids.append(NO_ID if key is None else key)
                parts.append(part)
                held += len(part)
        if ids:
            yield frame()

    freq = table.raw
    # the head of the ids parts the rows of one doc_id, in the same order
    ordered = staged.repartitionByRange(files, F.col("doc_id"), F.substring("ids", 1, 64)).sortWithinPartitions("doc_id", "ids")
    ordered.mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.option("lineSep", "\n").text(f"{path}/ids")
    remove_dir(spark, f"{path}/staged")


def read_ids(spark: SparkSession, path: str, every: int = 128, with_ids: bool = False) -> DataFrame:
    """Decode the files: doc_id, start, n_tokens, ids_crc32 of each document, and its ids if asked for."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/table").select("content").first()
    freq = bytes(raw["content"])[:-1]
    if len(freq) % 4:
        raise ValueError("the table is damaged")
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "file", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(np.frombuffer(freq, "<u4"))
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for body, lanes, crc, docs, blocks, begin in frames(memoryview(content.as_buffer())):
                    if crc != table.crc:
                        raise ValueError("a frame was coded with another table")
                    keys, sizes = np.frombuffer(body, "<i8", docs), np.frombuffer(body, "<i8", docs, 8 * docs)
                    at, parts = 16 * docs, []
                    for _ in range(blocks):
                        part, size = decode_block(body[at:], table, lanes, every)
                        parts.append(part)
                        at += size
                    ids = np.concatenate(parts).astype("<u4") if parts else np.zeros(0, "<u4")
                    ends = np.cumsum(sizes)
                    cut = [ids[e - n : e].tobytes() for e, n in zip(ends, sizes, strict=True)]
                    columns = [pa.array([None if k == NO_ID else k for k in keys.tolist()], pa.int64()), pa.array(ends - sizes + begin), pa.array(sizes), pa.array([zlib.crc32(c) for c in cut], pa.int64()), pa.array([file] * docs, pa.string())]
                    yield pa.record_batch([*columns, *[pa.array(cut, pa.binary())] * with_ids], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/ids").select("path", "content")
    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, file string" + ", ids binary" * with_ids)


def placed(rows: DataFrame) -> DataFrame:
    """start counted from the first file on instead of within each file. The running sum goes over one row a file."""
    number = lambda name: F.regexp_extract("file", name, 1).cast("long")
    sums = rows.groupBy("file").agg(F.sum("n_tokens").alias("n")).select(F.col("file").alias("of"), "n", number(r"part-(\d+)").alias("p"), number(r"-c(\d+)").alias("c"))
    before = Window.orderBy("p", "c").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("of", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return rows.join(sums, rows["file"] == sums["of"]).withColumn("start", F.col("start") + F.col("base")).drop("of", "base", "file")


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Write the documents' ids and read them back: doc_id, start, n_tokens, ids_crc32. The files stay under path."""
    path = path or new_dir(docs.sparkSession, "tokens")
    write_ids(docs, path, tokenizer, end_id)
    return placed(stored(read_ids(docs.sparkSession, path), f"{path}/index"))
