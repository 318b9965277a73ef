"""Shared pieces of the training-data operators: storage in the shared folder, text buffers, word and shingle hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import new_path as new_dir  # noqa: F401

#: White space that parts words: \x20 and \x09-\x0D, as the contracts fix it.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of text that one NumPy step works on; a longer document makes a step of its own.
STEP_BYTES = 1_000_000


def remove_dir(spark: SparkSession, path: str) -> None:
    """Delete a folder that new_dir() named, on whatever file system it is."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def stored(df: DataFrame, path: str, partitioned: tuple[str, ...] = ()) -> DataFrame:
    """The frame written as Parquet under path and reread: its lineage is cut and a lost executor costs no recomputation."""
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partitioned) if partitioned else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a few numbers each that may be broadcast, some tens of MB at most; larger sides are shuffled.
BROADCAST_ROWS = 1_000_000


def small_side(written: DataFrame, rows: int | None = None) -> DataFrame:
    """A written table, marked for broadcast if its counted rows are few: BROADCAST_ROWS, or `rows` where they hold text."""
    return F.broadcast(written) if written.count() <= (BROADCAST_ROWS if rows is None else rows) else written


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; all other characters stay."""
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text that isn't null, in order."""
    return F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def documents_of(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and text alone: other columns, whatever their names, can't clash. A null text is an empty one."""
    return df.select(df[key].cast("long").alias("doc_id"), F.coalesce(df[text].cast("string"), F.lit("")).alias("text"))


def text_steps(texts: pa.Array, most: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, UTF-8 bytes of the rows' texts together, offsets) for runs of rows of at most `most` bytes, or of one longer text."""
    texts = texts.cast(pa.large_string()).cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8) if len(texts) and texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads each input bit over all 64."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0x9FB21C651E98DF25)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_BASE = 0x2545F4914F6CDD1D
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE ** i and its inverse modulo 2**64 for i below n; kept up to the length of one step and a long word."""
    if _POWERS and len(_POWERS[0]) >= n:
        return _POWERS[0][:n], _POWERS[1][:n]
    out = []
    for base in (_BASE, pow(_BASE, -1, 2**64)):
        p = np.full(max(n, 1 << 16), base, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    if n <= 2 * STEP_BYTES:
        _POWERS[:] = out
    return out[0][:n], out[1][:n]


def _hashed(data: np.ndarray, cuts: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end byte of every word of data; a word ends at a cut at the latest."""
    if fold:
        data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    inside = (data != 32) & ((data < 9) | (data > 13))
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    starts[cuts] = inside[cuts]
    ends[cuts - 1] = inside[cuts - 1]
    first, last = np.flatnonzero(starts), np.flatnonzero(ends)
    power, inverse = _powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power, out=total[1:])
    return mixed((total[last + 1] - total[first]) * inverse[first] + (last - first).astype(np.uint64)), first, last + 1


def _word_border(data: np.ndarray, at: int) -> int:
    """The first place from `at` on that holds white space, or the end."""
    while at < len(data):
        part = data[at : at + 65_536]
        space = np.flatnonzero((part == 32) | (part >= 9) & (part <= 13))
        if len(space):
            return at + int(space[0])
        at += len(part)
    return len(data)


def hashed_words(data: np.ndarray, offsets: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash, row, first byte and end byte of every word in the texts that data holds one after the other; fold: with A-Z in lower case.

    Long data goes in stretches of about STEP_BYTES that end between words, so that what a byte needs meanwhile doesn't grow with its text.
    """
    parts, a = [], 0
    borders = offsets[:-1][np.diff(offsets) > 0]  # words end with their text
    while a < len(data):
        b = len(data) if len(data) - a <= STEP_BYTES else _word_border(data, a + STEP_BYTES)
        cuts = borders[np.searchsorted(borders, a, side="right") : np.searchsorted(borders, b)]
        h, first, end = _hashed(data[a:b], cuts - a, fold)
        parts.append((h, first + a, end + a))
        a = b
    if not parts:
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))
    h, first, end = (np.concatenate(x) for x in zip(*parts, strict=True)) if len(parts) > 1 else parts[0]
    return h, np.searchsorted(offsets, first, side="right") - 1, first, end


def shingles(h: np.ndarray, row: np.ndarray, rows: int, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles as (hash, row), by row and hash. A text of fewer words has its whole sequence as one; one without words has none.

    Two different shingles of one corpus share a 64-bit hash with a chance of about n * n / 2**65.
    """
    out_h, out_row = [], []
    count = np.bincount(row, minlength=rows)
    factor = [np.uint64(pow(_BASE, i + 1, 2**64) ^ 0x5851F42D4C957F2D | 1) for i in range(k)]
    if len(h) >= k:
        g = np.zeros(len(h) - k + 1, np.uint64)
        for i in range(k):
            g += h[i : len(h) - k + 1 + i] * factor[i]
        same = row[k - 1 :] == row[: len(row) - k + 1]
        out_h.append(mixed(g[same]))
        out_row.append(row[: len(row) - k + 1][same])
    begin = np.concatenate([[0], np.cumsum(count)[:-1]]) if rows else np.zeros(0, np.int64)
    for r in np.flatnonzero((count > 0) & (count < k)):  # short texts
        n = int(count[r])
        g = np.array([n], np.uint64) + (h[begin[r] : begin[r] + n] * np.array(factor[:n], np.uint64)).sum(dtype=np.uint64)
        out_h.append(mixed(g))
        out_row.append(np.array([r]))
    if not out_h:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    g, r = np.concatenate(out_h), np.concatenate(out_row)
    order = np.lexsort((g, r))
    g, r = g[order], r[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (r[1:] != r[:-1])
    return g[new], r[new]


class Known:
    """Pieces of text that were encoded before and the ids of each, kept as arrays of at most about `budget` bytes: beyond that it begins anew."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], budget: int):
        self.encode, self.budget = encode, budget
        self.clear()

    def clear(self) -> None:
        self.words = pa.array([], pa.string())
        self.size, self.pool = np.zeros(0, np.int64), np.zeros(0, np.uint16)

    def rows(self, pieces: pa.Array) -> np.ndarray:
        """The place of each of some different pieces; unknown ones are encoded first: to (numbers of ids, all ids)."""
        if self.words.nbytes + self.size.nbytes + self.pool.nbytes > self.budget:
            self.clear()
        at = pc.fill_null(pc.index_in(pieces, value_set=self.words), -1).to_numpy().astype(np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            words = pieces.take(pa.array(new))
            size, pool = self.encode(words.to_pylist())
            at[new] = len(self.words) + np.arange(len(new))
            self.words = pa.concat_arrays([self.words, words])
            self.size, self.pool = np.concatenate([self.size, size]), np.concatenate([self.pool, pool])
        return at


def byte_steps(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows (first, row after the last) of about `most` bytes of text, or of one longer text."""
    size = pc.binary_length(texts).to_numpy()
    cut = np.flatnonzero(np.diff(np.cumsum(size) // most, prepend=0)).tolist()
    yield from ((a, b) for a, b in zip([0, *cut], [*cut, len(texts)], strict=True) if a < b)
