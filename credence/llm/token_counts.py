"""Token counts of whole texts; texts longer than a chunk by overlapping chunks, spliced where both encodings agree.

A byte-level BPE first parts its text with a pattern that never looks back. So once two scans, of chunks that begin at
different places, both begin a word at the same character with the same token, they go on alike: that place is a stable
boundary. A left chunk is trusted up to there, the right one from there on. Only boundaries well before the left chunk's end
count, since a word, a special string or a look-ahead may be cut off there. Where the overlap has none, it is widened.

Chunks of plain texts are encoded by pieces: parted before single spaces, where the pattern parts them too, so that the ids
of a chunk are those of its pieces, and each different piece of a step is encoded once. Their offsets are the pieces' places. Texts
with other white space, or in which two pieces could share a run of it, go through the tokenizer as they are.
"""

from __future__ import annotations

import os
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import Known, byte_steps, documents_of

#: Spaces beyond " " and "\n", and runs that a cut before a space would part otherwise than the tokenizer does.
NOT_PLAIN = re.compile("  |\n \n|[\t\r\x0b\x0c\x1c-\x1f\x85\xa0" + "".join(map(chr, (0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))) + "]")
#: Characters of a chunk and of the overlap of two, and those at a chunk's end that no boundary may be in; longer than any special string.
CHUNK, OVERLAP, GUARD = 4_096, 256, 64
#: Text bytes of a step, and bytes of pieces that are kept from one step to the next.
STEP, KEPT = 2 << 20, 48 << 20
#: Marks that the splitter parts from letters before them, and a single word of Latin letters.
MARKED = "^[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+[.,!?;:|*%$&#()\"<>]+$"
TAIL = "[.,!?;:|*%$&#()\"<>]+$"
LETTERS = re.compile("[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+")


def _boundaries(enc, start: int, low: int, high: int) -> dict[tuple[int, int, int], int]:
    """First tokens of words as (begin, end, id), with characters counted in the whole text, begin from low and end up to high: their index."""
    offsets, words, ids, out = enc.offsets, enc.word_ids, enc.ids, {}
    for i in range(bisect_left(offsets, (low - start,)), len(offsets)):
        a, b = offsets[i]
        if a + start > high:
            break
        if b + start <= high and (not i or words[i] is None or words[i] != words[i - 1]):
            out[(a + start, b + start, ids[i])] = i
    return out


def spliced_ids(tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP, spliced: list[bool] | None = None) -> Iterator[list[int]]:
    """The ids of a text, part by part, as the tokenizer gives them for the whole of it; spliced takes a flag for each seam: whether it was widened."""
    encode = lambda a, b: tokenizer.encode(text[a:b], add_special_tokens=False)
    start, end = 0, min(chunk, len(text))
    left, since, longer = encode(start, end), 0, False
    first = None  # the boundary from which the left chunk is trusted
    while end < len(text):
        wide, joint = overlap, None
        while joint is None and wide < end - start:
            begin, stop = end - wide, min(len(text), end - wide + max(chunk, 2 * wide))
            right = encode(begin, stop)
            marks, other = _boundaries(left, start, begin, end - GUARD), _boundaries(right, begin, begin, end - GUARD)
            joint = max((k for k, i in marks.items() if since < i < len(left) - 2 and k in other), default=None)
            wide *= 2
        if joint is None:  # no boundary at all: a longer left chunk
            end = min(len(text), end + (end - start))
            left, longer = encode(start, end), True
            since = _boundaries(left, start, first[0], first[1])[first] if first else 0
            continue
        yield left.ids[since : marks[joint]]
        if spliced is not None:
            spliced.append(longer or wide > 2 * overlap)
        left, start, end, since, first, longer = right, begin, stop, other[joint], joint, False
    if spliced is not None and longer:
        spliced.append(True)
    yield left.ids[since:]


class Counter:
    """Numbers of tokens of texts, for a byte-level BPE in a tokenizers file."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        from tokenizers import Tokenizer

        self.tokenizer, self.chunk, self.overlap = Tokenizer.from_file(path), chunk, overlap
        vocabulary = self.tokenizer.get_vocab()
        self.starts = np.zeros(max(vocabulary.values()) + 1, bool)
        self.starts[[i for w, i in vocabulary.items() if w.startswith("Ġ")]] = True  # the byte-level sign of a space
        self.known = Known(self._words, KEPT)  # words with a space before them

    def _encoded(self, texts: list[str]) -> np.ndarray:
        sizes = [len(e) for i in range(0, len(texts), 1_000) for e in self.tokenizer.encode_batch_fast(texts[i : i + 1_000], add_special_tokens=False)]
        return np.array(sizes, np.int64)

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of each word with a space before it. Words of letters are encoded a hundred to a text, and one begins where a token with a space does."""
        size = np.zeros(len(words), np.int64)
        letters = [i for i, w in enumerate(words) if LETTERS.fullmatch(w)]
        other = [i for i, w in enumerate(words) if not LETTERS.fullmatch(w)]
        parts = [letters[i : i + 100] for i in range(0, len(letters), 100)]
        for part, e in zip(parts, self.tokenizer.encode_batch_fast(["".join(" " + words[i] for i in p) for p in parts], add_special_tokens=False), strict=True):
            at = np.flatnonzero(self.starts[e.ids])
            if len(at) == len(part) and not at[0]:
                size[part] = np.diff(np.append(at, len(e.ids)))
            else:
                other.extend(part)
        size[other] = self._encoded([" " + words[i] for i in other])
        return size, np.zeros(0, np.uint16)

    def pieces(self, words: pa.Array) -> np.ndarray:
        """The tokens of different words with a space before each; marks at a word's end are counted on their own."""
        marked = pc.match_substring_regex(words, MARKED)
        cores = pc.if_else(marked, pc.replace_substring_regex(words, TAIL, ""), words).dictionary_encode()
        at = self.known.rows(cores.dictionary)
        size = self.known.size[at][cores.indices.to_numpy()]
        where = np.flatnonzero(marked.to_numpy(zero_copy_only=False))
        tails = pc.replace_substring_regex(words.take(pa.array(where)), "^[^.,!?;:|*%$&#()\"<>]+", "").dictionary_encode()
        size[where] += self._encoded(tails.dictionary.to_pylist())[tails.indices.to_numpy()]
        return size

    def plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(tokens, seams, whether all seams were found) of plain texts, all chunks of a step together."""
        owner, begin, stop = [], [], []
        for i, t in enumerate(texts):
            a = 0
            while a + self.chunk < len(t):
                owner.append(i), begin.append(a), stop.append(a + self.chunk)
                a += self.chunk - self.overlap
            owner.append(i), begin.append(a), stop.append(len(t))
        words = pc.split_pattern(pa.array([texts[i][a:b] for i, a, b in zip(owner, begin, stop, strict=True)], pa.string()), " ")
        flat = words.flatten()
        coded = flat.dictionary_encode()
        owner, begin, stop = np.array(owner), np.array(begin), np.array(stop)
        head = words.offsets.to_numpy().astype(np.int64)  # a chunk's first piece; the last entry is the end
        size = pc.utf8_length(flat).to_numpy().astype(np.int64)
        tokens = self.pieces(coded.dictionary)[coded.indices.to_numpy()]
        # the first piece of a text has no space before it
        lead = head[:-1][begin == 0]
        tokens[lead] = self._encoded(flat.take(pa.array(lead)).to_pylist())
        upto = np.concatenate([[0], np.cumsum(tokens)])
        place = np.cumsum(size + 1) - (size + 1)
        chunk_of = np.repeat(np.arange(len(owner)), np.diff(head))
        place += (begin - place[head[:-1]])[chunk_of]
        # the last piece that ends well within the left chunk, and the same in the right one, where it isn't the first
        left = np.flatnonzero(owner[1:] == owner[:-1])
        right = left + 1
        key = chunk_of * (1 << 40) + place
        joint = np.searchsorted(key + size, left * (1 << 40) + stop[left] - GUARD, side="right") - 1
        mate = np.minimum(np.searchsorted(key, right * (1 << 40) + place[joint]), len(key) - 1)
        found = (joint > head[left]) & (chunk_of[mate] == right) & (mate > head[right]) & (place[mate] == place[joint]) & (size[mate] == size[joint])
        since, until = head[:-1].copy(), head[1:].copy()
        until[left], since[right] = np.where(found, joint, head[right]), np.where(found, mate, head[right])
        whole = np.ones(len(texts), bool)
        whole[owner[left[~found]]] = False
        whole[owner[since > until]] = False
        total = np.bincount(owner, upto[until] - upto[since], len(texts)).astype(np.int64)
        return total, np.bincount(owner, minlength=len(texts)) - 1, whole

    def count(self, texts: list[str]) -> tuple[list[int], list[int], list[int]]:
        """(tokens, seams, widened seams) of each text."""
        tokens, seams, widened = [0] * len(texts), [0] * len(texts), [0] * len(texts)
        plain = [i for i, t in enumerate(texts) if not NOT_PLAIN.search(t)]
        again = set(range(len(texts))) - set(plain)
        if plain:
            for i, n, k, whole in zip(plain, *(x.tolist() for x in self.plain([texts[i] for i in plain])), strict=True):
                if whole:
                    tokens[i], seams[i] = n, k
                else:
                    again.add(i)
        short = [i for i in again if len(texts[i]) <= self.chunk]
        for i, n in zip(short, self._encoded([texts[i] for i in short]).tolist(), strict=True):
            tokens[i] = n
        for i in again.difference(short):
            log: list[bool] = []
            tokens[i] = sum(map(len, spliced_ids(self.tokenizer, texts[i], self.chunk, self.overlap, log)))
            seams[i], widened[i] = len(log), sum(log)
        return tokens, seams, widened


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, n_seams, n_widened of every whole text of docs (doc_id, text) for a byte-level BPE in a tokenizers file.

    Texts of more than `chunk` characters go by chunks: n_seams places where two of them were spliced, n_widened of them after
    wider overlaps. A null text counts as empty: no bytes, no tokens; rows that repeat give a row each, null ids stay null. A
    text without a boundary becomes one chunk, however long. No shuffle; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        counter = Counter(tokenizer, chunk, overlap)
        for batch in batches:
            for a, b in byte_steps(batch.column(1), STEP):
                texts = batch.column(1).slice(a, b - a)
                n, seams, widened = (pa.array(x, pa.int64()) for x in counter.count(texts.to_pylist()))
                columns = [batch.column(0).slice(a, b - a), pc.binary_length(texts).cast(pa.int64()), n, pc.greater(n, limit), seams, widened]
                yield pa.record_batch(columns, ["doc_id", "n_bytes", "n_tokens", "over_limit", "n_seams", "n_widened"])

    return documents_of(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_seams long, n_widened long")
