"""Tokens of two tokenizers aligned by bytes: pointer jumping finds the groups, a table of linked ids tells how common each link is.

Both tokenizers cut the same bytes. Every token points to its farthest-right overlapping token; doubling these pointers leads all
tokens of a group to the last one, which ends where a token of the other side ends too. A step of some texts is one array, so a
text's length doesn't matter: the number of doublings grows with the logarithm of the longest group.

A text is encoded word by word where its tokenizers' files show that no token reaches over a single space between words, so that a word
is encoded once for many texts; any other text is encoded whole. Pointers always run over the tokens of whole texts.

Link counts are needed for each text, yet belong to the corpus. Texts are laid down in blocks of bounded bytes with a dictionary of
the block's own pairs. Counts are summed over dictionaries, and each block gets the counts of its dictionary alone, so a pair
that all texts hold makes a row a block, not a row a text.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_steps, documents_of, new_dir, stored

#: Bytes of text that are encoded at once, and of a block; a longer text makes one of its own.
STEP, BLOCK = 1_000_000, 16_000_000
#: Bytes of words and their ids that are kept from one step to the next.
KEPT = 48 << 20
#: Texts that can't be parted at spaces: with a space at an end or beside white space, or with any white space but it and line ends.
WHOLE = re.compile(r"^ | $| \n|\n |  |[^\S \n]")


@cache
def byte_alphabet() -> dict[str, int]:
    """The character that byte-level vocabularies write for each byte: printable ones as themselves, the others from U+0100 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class ByteLevel:
    """A byte-level BPE of the tokenizers library: ids of a space and the text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        alphabet = byte_alphabet()
        self.pieces = np.full(self.tokenizer.get_vocab_size(), b"", object)
        for piece, i in vocabulary.items():
            self.pieces[i] = bytes(alphabet[c] for c in piece) if all(c in alphabet for c in piece) else piece.encode()

    @property
    def by_words(self) -> bool:
        """Whether the file has the usual splitter, which parts a text before each space between words, and changes nothing."""
        made = json.loads(self.tokenizer.to_str())
        split = made["pre_tokenizer"] or {}
        return made["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex", False) and not split["add_prefix_space"]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


class Pieces:
    """A sentencepiece model that writes spaces as U+2581 and puts one before the text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = np.empty(self.model.get_piece_size(), object)
        for i in range(len(self.pieces)):
            piece = self.model.id_to_piece(i)
            self.pieces[i] = bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()

    @property
    def by_words(self) -> bool:
        """Whether no piece goes on after a space that follows another character: no merge then reaches over it."""
        return not any(b" " in p.lstrip(b" ") for p in self.pieces.tolist())

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def tokenizer_of(path: str) -> ByteLevel | Pieces:
    return Pieces(path) if path.endswith(".model") else ByteLevel(path)


def terminals(end_a: np.ndarray, end_b: np.ndarray) -> np.ndarray:
    """For each A token, then each B token, the A token that ends its group. Ends are ascending places in the same bytes, the last one shared.

    A token's pointer: itself where the tokens of both sides end together (the A token, for both), else the token of the other
    side that holds its last byte, which overlaps it and reaches farthest.
    """
    n = len(end_a)
    over = np.searchsorted(end_b, end_a)
    to = np.concatenate([np.where(end_b[over] > end_a, n + over, np.arange(n)) if n else over, np.searchsorted(end_a, end_b)])
    while True:
        further = to[to]
        if np.array_equal(further, to):
            return to
        to = further


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Sizes, and all numbers together."""
    size = np.fromiter(map(len, lists), np.int64, len(lists))
    return size, np.fromiter(chain.from_iterable(lists), np.int64, int(size.sum()))


def _unchanged(side: ByteLevel | Pieces, ids: np.ndarray, sizes: np.ndarray, texts: list[str]) -> np.ndarray:
    """Which texts' tokens join up to a space and the text."""
    want, got = [b" " + t.encode() for t in texts], side.pieces[ids].tolist()
    upto = np.concatenate([[0], np.cumsum(sizes)]).tolist()
    length = np.concatenate([[0], np.cumsum(np.fromiter(map(len, got), np.int64, len(got)))])[upto]
    if np.array_equal(np.diff(length), np.fromiter(map(len, want), np.int64, len(want))) and b"".join(got) == b"".join(want):
        return np.ones(len(texts), bool)
    return np.array([b"".join(got[s:e]) == t for s, e, t in zip(upto[:-1], upto[1:], want, strict=True)], bool)


class Words:
    """Different words and their ids on both sides, kept up to some bytes; a word that either side changes isn't valid."""

    def __init__(self, aligner: Aligner):
        self.aligner = aligner
        self.clear()

    def clear(self) -> None:
        self.words, self.valid = pa.array([], pa.string()), np.zeros(0, bool)
        self.sizes, self.pools = [np.zeros(0, np.int64)] * 2, [np.zeros(0, np.int64)] * 2

    def rows(self, words: pa.Array) -> np.ndarray:
        """The places of some different words, of which new ones are encoded first."""
        if self.words.nbytes + 8 * sum(len(x) for x in (*self.sizes, *self.pools)) > KEPT:
            self.clear()
        at = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy().astype(np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            more = words.take(pa.array(new))
            texts = more.to_pylist()
            at[new] = len(self.words) + np.arange(len(new))
            self.words, ok = pa.concat_arrays([self.words, more]), np.ones(len(new), bool)
            for k, side in enumerate(self.aligner.sides):
                size, pool = _flat(side.encode(texts))
                ok &= _unchanged(side, pool, size, texts)
                self.sizes[k], self.pools[k] = np.concatenate([self.sizes[k], size]), np.concatenate([self.pools[k], pool])
            self.valid = np.concatenate([self.valid, ok])
        return at

    def ids(self, side: int, at: np.ndarray) -> np.ndarray:
        """The ids of words at some places, one after the other."""
        size = self.sizes[side]
        begin, size = (np.cumsum(size) - size)[at], size[at]
        return self.pools[side][np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())]


class Aligner:
    """Aligns the texts of a step and keeps their pairs of linked ids, a * (size of B's vocabulary) + b."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.sides = self.a, self.b = tokenizer_of(path_a), tokenizer_of(path_b)
        self.size_b = len(self.b.pieces)
        if len(self.a.pieces) * self.size_b >= 1 << 42:
            raise ValueError("the vocabularies are too large for pairs of 42 bits")
        self.by_words, self.known = all(t.by_words for t in self.sides), Words(self)
        self.lengths = [np.array([len(p) for p in t.pieces]) for t in self.sides]
        digits = lambda n, ends: np.array([b"%d%s" % (i, e) for e in ends for i in range(n)], object)
        self.shown = digits(len(self.a.pieces), (b",", b"|")), digits(self.size_b, (b",", b";", b""))

    def by_word(self, texts: pa.Array, good: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Of the texts at `good`, those all of whose words are valid: which, and sizes and ids on both sides."""
        parts = pc.split_pattern(texts.take(pa.array(good)), " ")
        coded = parts.flatten().dictionary_encode()
        at = self.known.rows(coded.dictionary)[coded.indices.to_numpy()]
        owner = np.repeat(np.arange(len(good)), np.diff(parts.offsets.to_numpy()))
        bad = np.bincount(owner[~self.known.valid[at]], minlength=len(good)) > 0
        at, owner = at[~bad[owner]], owner[~bad[owner]]
        sizes = [np.bincount(owner, s[at], len(good)).astype(np.int64)[~bad] for s in self.known.sizes]
        return good[~bad], sizes, [self.known.ids(k, at) for k in (0, 1)]

    def whole(self, texts: pa.Array, good: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """The same of texts that are encoded whole, of those that neither side changes."""
        own = texts.take(pa.array(good)).to_pylist()
        flat = [_flat(side.encode(own)) for side in self.sides]
        ok = np.ones(len(own), bool)
        for side, (size, ids) in zip(self.sides, flat, strict=True):
            ok &= _unchanged(side, ids, size, own)
        return good[ok], [size[ok] for size, _ in flat], [ids[np.repeat(ok, size)] for size, ids in flat]

    def step(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]]:
        """For some rows at a time: which; n_a, n_b, n_groups, n_links of each; digests of the groups; and for each of their different
        pairs the row's place among them, the pair, and how often it is linked."""
        left = np.ones(len(texts), bool)
        plain = np.array([bool(t) and not WHOLE.search(t) for t in texts.to_pylist()], bool) if self.by_words else ~left
        for rows, encode in ((np.flatnonzero(plain), self.by_word), (None, self.whole)):
            rows = np.flatnonzero(left & (pc.binary_length(texts).to_numpy() > 0)) if rows is None else rows
            if len(rows):
                rows, sizes, ids = encode(texts, rows)
                left[rows] = False
                if len(rows):
                    yield rows, *self.joined(*sizes, *ids)
        rest = np.flatnonzero(left)
        none = np.zeros(0, np.int64)
        if len(rest):
            yield rest, np.zeros((4, len(rest)), np.int64), [""] * len(rest), none, none, none

    def joined(self, n_a: np.ndarray, n_b: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Numbers, digests and pairs of texts from their sizes and ids."""
        end_a, end_b = np.cumsum(self.lengths[0][a]), np.cumsum(self.lengths[1][b])
        ends = terminals(end_a, end_b)
        last_of = ends[: len(a)] == np.arange(len(a))
        lasts = np.flatnonzero(last_of)
        group_a, group_b = np.cumsum(last_of) - last_of, np.searchsorted(lasts, ends[len(a) :])
        doc_a = np.repeat(np.arange(len(n_a)), n_a)
        # links: every stretch between two ends lies in one token of each side
        places = np.sort(np.concatenate([end_a, end_b]), kind="stable")
        places = places[np.append(places[1:] != places[:-1], True)]
        at_a, at_b = np.searchsorted(end_a, places), np.searchsorted(end_b, places)
        counts = np.stack([n_a, n_b, np.bincount(doc_a[lasts], minlength=len(n_a)), np.bincount(doc_a[at_a], minlength=len(n_a))])
        key, times = np.unique((doc_a[at_a] << 42) + a[at_a] * self.size_b + b[at_b], return_counts=True)
        # groups in order, A's tokens before B's
        in_a, in_b = np.bincount(group_a, minlength=len(lasts)), np.bincount(group_b, minlength=len(lasts))
        shown = np.empty(len(a) + len(b), object)
        last_b = np.append(group_b[1:] != group_b[:-1], True).astype(np.int64)
        last_b[np.cumsum(n_b) - 1] = 2
        shown[np.arange(len(a)) + (np.cumsum(in_b) - in_b)[group_a]] = self.shown[0][a + last_of * len(self.a.pieces)]
        shown[np.arange(len(b)) + np.cumsum(in_a)[group_b]] = self.shown[1][b + last_b * self.size_b]
        upto = np.concatenate([[0], np.cumsum(n_a + n_b)])
        digests = [hashlib.sha256(b"".join(shown[s:e].tolist())).hexdigest() for s, e in zip(upto[:-1], upto[1:], strict=True)]
        return counts, digests, key >> 42, key & ((1 << 42) - 1), times


class PairCounts:
    """Numbers by pair, merged whenever as many have gathered as are known."""

    def __init__(self):
        self.pairs, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.more: list[np.ndarray] = []
        self.waiting = 0

    def add(self, pairs: np.ndarray) -> None:
        self.more.append(pairs)
        self.waiting += len(pairs)
        if self.waiting > max(1_000_000, len(self.pairs)):
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        new, n = np.unique(np.concatenate([np.zeros(0, np.int64), *self.more]), return_counts=True)
        both, at = np.unique(np.concatenate([self.pairs, new]), return_inverse=True)
        self.counts = np.bincount(at, np.concatenate([self.counts, n]), len(both)).astype(np.int64)
        self.pairs, self.more, self.waiting = both, [], 0
        return self.pairs, self.counts


LAID = "block long, is_block boolean, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"
_ARROW = pa.schema([("block", pa.int64()), ("is_block", pa.bool_()), *((c, pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))])


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values))


def aligned_blocks(docs: DataFrame, tokenizer_a: str, tokenizer_b: str, block_bytes: int = BLOCK) -> DataFrame:
    """A row for each text with its numbers and different pairs, and a row for each block of texts with its pairs and how many of its texts hold each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, seen, held = Aligner(tokenizer_a, tokenizer_b), PairCounts(), 0
        block = TaskContext.get().partitionId() << 32

        def dictionary() -> pa.RecordBatch:
            pairs, n = seen.merge()
            null = pa.nulls(1, pa.int64())
            return pa.record_batch([pa.array([block]), pa.array([True]), null, null, null, null, null, pa.nulls(1, pa.string()), _lists(pairs, [len(pairs)]), _lists(n, [len(n)])], schema=_ARROW)

        for batch in batches:
            for i, j in byte_steps(batch.column(1), STEP):
                texts, keys = batch.column(1).slice(i, j - i), batch.column(0).slice(i, j - i)
                held += texts.nbytes
                for rows, counts, digests, row, pair, times in aligner.step(texts):
                    sizes, n = np.bincount(row, minlength=len(rows)), len(rows)
                    seen.add(pair)
                    yield pa.record_batch([pa.array(np.full(n, block)), pa.array(np.zeros(n, bool)), keys.take(pa.array(rows)), *map(pa.array, counts), pa.array(digests), _lists(pair, sizes), _lists(times, sizes)], schema=_ARROW)
                if held >= block_bytes:
                    yield dictionary()
                    seen, held, block = PairCounts(), 0, block + 1
        if held:
            yield dictionary()

    return documents_of(docs).mapInArrow(run, LAID)


def link_counts(laid: DataFrame, size_b: int) -> DataFrame:
    """(pair, n_docs, best): in how many texts two ids are linked, and whether no other link of that A id is in more. An A id has at most size_b rows."""
    at = laid.filter("is_block").select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("n_docs"))
    first = F.floor(F.col("pair") / F.lit(size_b))
    return at.withColumn("best", F.col("n_docs") == F.max("n_docs").over(Window.partitionBy(first)))


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _weighed(texts: pa.Table, known: pa.Table) -> pa.Table:
    """n_best and count_sum of the texts of one block, from the counts of its pairs."""
    order = np.argsort(known["pair"].to_numpy())
    pair, n, best = (known[c].to_numpy()[order] for c in ("pair", "n_docs", "best"))
    pairs, times = texts["pairs"].combine_chunks(), texts["times"].combine_chunks()
    row = np.repeat(np.arange(len(texts)), np.diff(pairs.offsets.to_numpy()))
    at, weight = np.searchsorted(pair, pairs.flatten().to_numpy()), times.flatten().to_numpy()
    sums = []
    for value in (weight * best[at], weight * n[at]):  # whole numbers, added as such
        upto = np.concatenate([[0], np.cumsum(value)])
        ends = np.searchsorted(row, np.arange(len(texts) + 1))
        sums.append(pa.array(upto[ends[1:]] - upto[ends[:-1]], pa.int64()))
    columns = {"n_best": sums[0], "count_sum": sums[1]} | {c: texts[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
    return pa.table({c.split()[0]: columns[c.split()[0]] for c in RESULT.split(", ")})


def aligned(docs: DataFrame, tokenizer_a: str, tokenizer_b: str, path: str | None = None, block_bytes: int = BLOCK) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every whole text of docs (doc_id, text).

    tokenizer_a: a byte-level BPE of the tokenizers library, given a space and the text; tokenizer_b: either kind. Groups are the
    smallest runs of tokens that begin and end together on both sides; links are pairs of overlapping tokens. n_best: links that
    are in as many texts as any of their A id; count_sum: over links, the texts that hold the pair linked.

    Texts that are null or empty, or that a tokenizer changes (its tokens don't join up to the text), have zeros and ''. Rows that
    repeat count and give a row each, null ids stay null; other columns aren't read. A very long text is one step of its
    own. A block's texts and counts meet in one task: some tens of MB for each 16 MB of text.
    """
    path = path or new_dir(docs.sparkSession, "aligned")
    laid = stored(aligned_blocks(docs, tokenizer_a, tokenizer_b, block_bytes), path)
    counts = link_counts(laid, len(tokenizer_of(tokenizer_b).pieces))
    asked = laid.filter("is_block").select(F.col("block").alias("of"), F.explode("pairs").alias("pair"))
    known = asked.join(counts, "pair").select("of", "pair", "n_docs", "best")
    texts = laid.filter("NOT is_block").drop("is_block")
    return texts.groupBy("block").cogroup(known.groupBy("of")).applyInArrow(_weighed, RESULT)


def groups_of(aligner: Aligner, text: str) -> list[tuple[list[int], list[int]]]:
    """The groups of one text, as ids of both sides."""
    _, _, (a, b) = aligner.whole(pa.array([text], pa.string()), np.arange(1 if text else 0))
    end = terminals(np.cumsum(aligner.lengths[0][a]), np.cumsum(aligner.lengths[1][b]))
    return [(a[end[: len(a)] == t].tolist(), b[end[len(a) :] == t].tolist()) for t in np.unique(end)]
