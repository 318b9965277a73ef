"""Language identification with spans for mixed texts.

Scores: log odds of hashed byte n-grams (two to four bytes of a word with its borders), counted per language over all labelled
documents. Scripts: a language is a candidate for a word if it is written in that word's script. Spans: a Viterbi path over the
words' scores, which pays a penalty whenever the language changes.

A step works on STEP_BYTES of text, or on one longer text; a word of it takes about 10 bytes for each language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents_of, hashed_words, text_steps

BUCKETS = 1 << 16
GRAMS = (2, 3, 4)
#: Code points of scripts, first and last.
SCRIPTS = [
    ("Latin", [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x2AF), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xAB30, 0xAB6F), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A)]),
    ("Greek", [(0x370, 0x3FF), (0x1F00, 0x1FFF)]),
    ("Cyrillic", [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)]),
    ("Armenian", [(0x530, 0x58F), (0xFB13, 0xFB17)]),
    ("Hebrew", [(0x590, 0x5FF), (0xFB1D, 0xFB4F)]),
    ("Arabic", [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)]),
    ("Devanagari", [(0x900, 0x97F), (0xA8E0, 0xA8FF)]),
    ("Bengali", [(0x980, 0x9FF)]),
    ("Gurmukhi", [(0xA00, 0xA7F)]),
    ("Gujarati", [(0xA80, 0xAFF)]),
    ("Oriya", [(0xB00, 0xB7F)]),
    ("Tamil", [(0xB80, 0xBFF)]),
    ("Telugu", [(0xC00, 0xC7F)]),
    ("Kannada", [(0xC80, 0xCFF)]),
    ("Malayalam", [(0xD00, 0xD7F)]),
    ("Sinhala", [(0xD80, 0xDFF)]),
    ("Thai", [(0xE00, 0xE7F)]),
    ("Lao", [(0xE80, 0xEFF)]),
    ("Tibetan", [(0xF00, 0xFFF)]),
    ("Myanmar", [(0x1000, 0x109F), (0xA9E0, 0xA9FF), (0xAA60, 0xAA7F)]),
    ("Georgian", [(0x10A0, 0x10FF), (0x1C90, 0x1CBF), (0x2D00, 0x2D2F)]),
    ("Hangul", [(0x1100, 0x11FF), (0x3130, 0x318F), (0xA960, 0xA97F), (0xAC00, 0xD7FF)]),
    ("Ethiopic", [(0x1200, 0x139F), (0x2D80, 0x2DDF), (0xAB00, 0xAB2F)]),
    ("Khmer", [(0x1780, 0x17FF)]),
    ("Mongolian", [(0x1800, 0x18AF)]),
    ("Kana", [(0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9D)]),
    ("Han", [(0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)]),
]
#: Scripts and "no letter" (0) and "a letter of any other script" (the last).
KINDS = len(SCRIPTS) + 2
UND = "und"


@lru_cache(maxsize=1)
def script_of() -> np.ndarray:
    """The script of each code point: 0 where it is no letter, KINDS - 1 for letters outside SCRIPTS."""
    out = np.zeros(0x110000, np.uint8)
    for k, (_, ranges) in enumerate(SCRIPTS):
        for a, b in ranges:
            out[a : b + 1] = k + 1
    letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return np.where(letters, np.where(out > 0, out, KINDS - 1), 0).astype(np.uint8)


def letter_scripts(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, script) of each character in UTF-8 bytes."""
    lead = np.flatnonzero((raw & 0xC0) != 0x80)
    b = np.concatenate([raw, np.zeros(3, np.uint8)]).astype(np.int32)
    first = b[lead]
    code = first.copy()
    for size, low, high, mask in ((2, 0xC0, 0xDF, 0x1F), (3, 0xE0, 0xEF, 0x0F), (4, 0xF0, 0xFF, 0x07)):
        at = np.flatnonzero((first >= low) & (first <= high))
        if len(at):
            c = first[at] & mask
            for k in range(1, size):
                c = (c << 6) | (b[lead[at] + k] & 0x3F)
            code[at] = c
    return lead, script_of()[code]


@dataclass
class Words:
    """Distinct words of a step: n-gram buckets of each (flat, with starts), script (0: no letter), and each word's place among them."""

    which: np.ndarray
    row: np.ndarray
    length: np.ndarray
    grams: np.ndarray
    starts: np.ndarray
    script: np.ndarray
    counts: np.ndarray


def analysed(data: np.ndarray, offsets: np.ndarray) -> Words:
    h, row, first, end = hashed_words(data, offsets)
    _, at, which, counts = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    length = (end - first)[at]
    if not len(at):
        none = np.zeros(0, np.int64)
        return Words(none, none, none, none, none, none.astype(np.uint8), none)
    # the bytes of the distinct words, each between two spaces
    starts = np.concatenate([[0], np.cumsum(length + 2)[:-1]])
    flat = np.full(int((length + 2).sum()), 32, np.uint8)
    word = np.repeat(np.arange(len(at)), length)
    inside = np.arange(len(word)) - np.repeat(np.cumsum(length) - length, length)
    raw = data[first[at][word] + inside]
    flat[starts[word] + 1 + inside] = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)
    code = np.zeros(len(flat), np.uint64)
    owner = np.repeat(np.arange(len(at)), length + 2)
    grams, owners = [], []
    for n in range(1, max(GRAMS) + 1):
        code = code[: len(flat) - n + 1] * np.uint64(257) + flat[n - 1 :] + np.uint64(1) if len(flat) >= n else code[:0]
        if n in GRAMS:
            same = owner[n - 1 :] == owner[: len(owner) - n + 1] if len(owner) >= n else np.zeros(0, bool)
            grams.append(((code[same] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64))
            owners.append(owner[: len(owner) - n + 1][same] if len(owner) >= n else owner[:0])
    g, o = np.concatenate(grams), np.concatenate(owners)
    order = np.argsort(o, kind="stable")
    g, o = g[order], o[order]
    # a word's script is that of most of its letters
    at_byte, kind = letter_scripts(raw)
    votes = np.bincount(word[at_byte] * KINDS + kind, minlength=len(at) * KINDS).reshape(len(at), KINDS)[:, 1:]
    script = np.where(votes.any(1), votes.argmax(1) + 1, 0).astype(np.uint8)
    return Words(which, row, length, g, np.searchsorted(o, np.arange(len(at))), script, counts)


@dataclass
class Model:
    """Log odds of buckets by language (languages x BUCKETS), and whether a language is written in a script (languages x KINDS)."""

    languages: list[str]
    odds: np.ndarray
    written: np.ndarray


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, bucket, n) summed over a task; a few languages at a time are held, each with a row of counts."""
    sums: dict[str, np.ndarray] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for name, total in sums.items():
            seen = np.flatnonzero(total)
            yield pa.record_batch([pa.array([name] * len(seen), pa.string()), pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["lang", "bucket", "n"])
        sums.clear()

    for batch in batches:
        names = batch.column(0).dictionary_encode()
        code = names.indices.to_numpy(zero_copy_only=False)
        for k, name in enumerate(names.dictionary.to_pylist()):
            if name not in sums and len(sums) >= 64:
                yield from flush()
            total = sums.setdefault(name, np.zeros(BUCKETS + KINDS, np.int64))
            for _, _, data, offsets in text_steps(batch.column(1).filter(pa.array(code == k))):
                w = analysed(data, offsets)
                times = np.repeat(w.counts, np.diff(np.append(w.starts, len(w.grams))))
                total[:BUCKETS] += np.bincount(w.grams, times, BUCKETS).astype(np.int64)
                total[BUCKETS:] += np.bincount(w.script, w.counts * w.length, KINDS).astype(np.int64)
    yield from flush()


def fit(labelled: DataFrame, smoothing: float = 0.5, script_share: float = 0.01, most_languages: int = 1000) -> Model:
    """Count n-grams and scripts over all rows of labelled (text, lang), null languages aside.

    What reaches the driver are the summed counts, at most BUCKETS + KINDS a language. A model holds 256 KB a language in every
    worker, so more than most_languages of them raise ValueError: such a column isn't one of languages.
    """
    rows = labelled.select(labelled["lang"].cast("string").alias("lang"), labelled["text"].cast("string").alias("text")).dropna()
    languages = sorted(r["lang"] for r in rows.select("lang").distinct().limit(most_languages + 1).collect())
    if len(languages) > most_languages:
        raise ValueError(f"more than {most_languages} languages to learn")
    summed = rows.mapInArrow(_counted, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(languages), BUCKETS + KINDS), np.float32)
    place = {x: i for i, x in enumerate(languages)}
    names = summed.column("lang").combine_chunks().dictionary_encode()
    names = names.combine_chunks() if isinstance(names, pa.ChunkedArray) else names
    code = np.array([place[x] for x in names.dictionary.to_pylist()], np.int64)[names.indices.to_numpy()]
    counts[code, summed.column("bucket").to_numpy()] = summed.column("n").to_numpy()
    scripts, odds = counts[:, BUCKETS:].astype(np.float64), counts[:, :BUCKETS]
    odds += np.float32(smoothing)
    odds /= odds.sum(1, keepdims=True, dtype=np.float64).astype(np.float32)
    np.log(odds, out=odds)
    if len(languages):
        odds -= odds.mean(0, keepdims=True)
    letters = scripts[:, 1:].sum(1, keepdims=True)
    return Model(languages, np.ascontiguousarray(odds), scripts >= np.maximum(script_share * letters, 1))


def word_scores(w: Words, model: Model) -> np.ndarray:
    """Scores of the distinct words, each scaled to at most 4 a word so that no single word outweighs its neighbours; languages not written in the word's script get -8."""
    if not len(w.length) or not model.languages:
        return np.zeros((len(w.length), len(model.languages)), np.float32)
    sums = np.stack([np.add.reduceat(m[w.grams], w.starts) for m in model.odds], 1)
    sums -= sums.max(1, keepdims=True)
    sums = np.maximum(sums, -4)
    fits = model.written[:, w.script].T
    sums = np.where(fits | ~fits.any(1, keepdims=True), sums, np.float32(-8))
    sums[w.script == 0] = 0
    return sums.astype(np.float32)


def viterbi(scores: np.ndarray, row: np.ndarray, rows: int, penalty: float) -> np.ndarray:
    """The best language of each word (rows of scores), text by text; all texts of a step move on together, the longest first."""
    n, langs = scores.shape
    count = np.bincount(row, minlength=rows)
    begin = np.concatenate([[0], np.cumsum(count)[:-1]])
    order = np.argsort(-count, kind="stable")
    begin, count = begin[order], count[order]
    active = np.searchsorted(-count, -np.arange(1, int(count.max(initial=0)) + 1), side="right")  # texts that have a t-th word
    kind = np.min_scalar_type(max(langs - 1, 0))  # a byte holds up to 256 languages
    came = np.empty((n, langs), kind)
    state = np.zeros((rows, langs), np.float32)
    own = np.arange(langs, dtype=kind)
    for t, k in enumerate(active):
        s = state[:k]
        best = s.argmax(1)
        top = s[np.arange(k), best][:, None] - np.float32(penalty)
        at = begin[:k] + t
        if t:
            stay = s >= top
            came[at] = np.where(stay, own, best[:, None])
            s = np.maximum(s, top)
        state[:k] = s + scores[at]
    path = np.empty(n, kind)
    now = state.argmax(1)
    for t in range(len(active) - 1, -1, -1):
        k = active[t]
        at = begin[:k] + t
        path[at] = now[:k]
        if t:
            now[:k] = came[at, now[:k]]
    return path


SPANS = pa.list_(pa.struct([("first_word", pa.int32()), ("n_words", pa.int32()), ("lang", pa.string())]))


def labelled_texts(texts: pa.Array, model: Model, penalty: float) -> Iterator[pa.RecordBatch]:
    """(lang_pred, score, spans) of texts, in order, a step at a time."""
    languages, most = model.languages, max(1, len(model.languages))
    for _, _, data, offsets in text_steps(texts):
        rows = len(offsets) - 1
        w = analysed(data, offsets)
        n = len(w.which)
        letters = (w.script > 0)[w.which] if n else np.zeros(0, bool)
        each = word_scores(w, model)[w.which] if n and languages else np.zeros((n, most), np.float32)
        path = viterbi(each, w.row, rows, penalty)
        weight = np.where(letters, w.length[w.which], 0) if n else np.zeros(0)
        shares = np.bincount(w.row * most + path, weight, rows * most).reshape(rows, most)
        best, total = shares.argmax(1), shares.sum(1)
        # how far the other languages' best total lies behind
        sums = np.stack([np.bincount(w.row, np.where(letters, each[:, k], 0), rows) for k in range(most)], 1)
        rest = np.where(np.arange(most) == best[:, None], -np.inf, sums).max(1)
        gap = np.maximum(0, sums[np.arange(rows), best] - rest) if most > 1 else np.full(rows, 50.0)
        sure = 1 / (1 + np.exp(-np.minimum(gap, 50)))
        known = (total > 0) & bool(languages)
        score = np.where(known, shares[np.arange(rows), best] / np.maximum(total, 1) * sure, 0.0)
        cut = np.ones(n, bool)
        cut[1:] = (path[1:] != path[:-1]) | (w.row[1:] != w.row[:-1])
        first = np.flatnonzero(cut)
        size = np.diff(np.append(first, n))
        shown = known[w.row[first]]
        first, size = first[shown], size[shown]
        begin = np.searchsorted(w.row, np.arange(rows))
        ends = np.concatenate([[0], np.cumsum(np.bincount(w.row[first], minlength=rows))])
        names = pa.array([languages[k] for k in path[first]], pa.string())
        flat = pa.StructArray.from_arrays([pa.array((first - begin[w.row[first]]).astype(np.int32)), pa.array(size.astype(np.int32)), names], fields=list(SPANS.value_type))
        spans = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), flat).cast(SPANS)
        pred = pa.array([languages[b] if ok else UND for b, ok in zip(best, known, strict=True)], pa.string())
        yield pa.record_batch([pred, pa.array(score), spans], ["lang_pred", "score", "spans"])


def identified(docs: DataFrame, model: Model, penalty: float = 6.0) -> DataFrame:
    """doc_id, lang_pred, score, spans of every whole text of docs (doc_id, text).

    lang_pred: the language with the most bytes of words that have letters, the first by name among equals; "und" for texts that
    are null or have no letter, or where no language was learned. A letter of a script that no language was learned with still
    gets the language whose n-grams fit best. score: its share of those bytes, times how surely its words tell it from the next
    language. spans: (first word, words, language) of each stretch in one language, empty for "und". Rows that repeat give a
    row each, null ids stay null; a very long text is one step of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for found in labelled_texts(batch.column(1), model, penalty):
                yield pa.record_batch([batch.column(0).slice(at, len(found)), *found.columns], ["doc_id", *found.schema.names])
                at += len(found)

    return documents_of(docs).mapInArrow(run, "doc_id long, lang_pred string, score double, spans array<struct<first_word:int,n_words:int,lang:string>>")


def prevailing(docs: DataFrame, model: Model, least_score: float, penalty: float = 6.0) -> DataFrame:
    """The rows of docs, with all their columns, whose text has a language that scores least_score or more. Row by row: nothing is shuffled, rows that repeat stay."""
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).cast(pa.string()).fill_null("")
            keep = [(np.asarray(found.column(1)) >= least_score) & np.array([x != UND for x in found.column(0).to_pylist()]) for found in labelled_texts(texts, model, penalty)]
            if keep:
                yield batch.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(run, docs.schema)


def held_out(docs: DataFrame) -> Column:
    """Documents that no model may learn from: crc32(doc_id as text) mod 4 is 2."""
    return F.coalesce(F.crc32(docs["doc_id"].cast("long").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def language_id(docs: DataFrame, penalty: float = 6.0) -> DataFrame:
    """Learn from the documents that aren't held out, then predict all: doc_id, held_out, lang_pred, score, spans."""
    found = identified(docs, fit(docs.filter(~held_out(docs))), penalty)
    return found.select("doc_id", held_out(found).alias("held_out"), "lang_pred", "score", "spans")
