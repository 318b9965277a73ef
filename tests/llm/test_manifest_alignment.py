"""The manifest and the alignment against plain versions in Python."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest

from credence.llm import alignment, merkle
from credence.llm.queries import QUERIES, _tokenizer

# 12


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def proofs(leaves, fanout=3):
    """The root, and the siblings of each leaf by level, by the definition."""
    ways, at, nodes = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(nodes) > 1:
        for i, k in enumerate(at):
            run = k - k % fanout
            ways[i].append((nodes[run:k], nodes[k + 1 : run + fanout]))
        at = [k // fanout for k in at]
        nodes = [H(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
    return nodes[0], ways


def plain_manifest(rows, fanout=3):
    by = defaultdict(list)
    for r in rows:
        leaf = H(*map(field, r))
        key, text = r[0], r[4]
        if key is not None and zlib.crc32(str(key).encode()) % 2 == 0 and text is not None:
            text = text.replace("\n", "")
        by[r[1]].append((key is not None, key or 0, leaf, key, H(*map(field, r[:4]), field(text))))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: proofs([x[2] for x in sorted(by[s])], fanout) for s in order}
    root, tops = proofs([trees[s][0] for s in order], fanout)
    out = []
    for s, top in zip(order, tops, strict=True):
        for x, way in zip(sorted(by[s]), trees[s][1], strict=True):
            node = x[4]
            for left, right in way + top:
                node = H(*left, node, *right)
            out.append((x[3], x[2], trees[s][0], root, H(*(n for a, b in way + top for n in (*a, *b))), node, node == root))
    return sorted(out, key=str)


COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


@pytest.mark.parametrize("fanout, depth", [(3, 7), (3, 1), (2, 2), (3, 0)])
def test_manifest(documents, odd, fanout, depth):
    docs = documents.unionByName(odd, allowMissingColumns=True).withColumn("leaf", documents["text"]).withColumn("tree", documents["lang"])
    docs = docs.unionByName(docs.filter("doc_id < 30").selectExpr("doc_id + 5000 AS doc_id", "text", "lang", "'src0' AS source", "n_chars", "leaf", "tree"), allowMissingColumns=True)
    want = plain_manifest([tuple(r[c] for c in COLUMNS) for r in docs.collect()], fanout)
    got = merkle.manifest(docs, merkle.tampered, digests=True, fanout=fanout, depth=depth)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert {x[-1] for x in want} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 27, 28])
def test_one_source_of_every_shape(spark, n):
    docs = spark.createDataFrame([(k, "s", None, k, f"t{k}") for k in range(n)], "doc_id long, source string, lang string, n_chars int, text string")
    got = merkle.manifest(docs, depth=1).collect()
    root, ways = proofs([H(*map(field, (k, "s", None, k, f"t{k}"))) for k in range(n)])
    assert {r["root"] for r in got} == {r["subroot"] for r in got} == {root} and len(got) == n
    for r in got:
        assert [(p["left"], p["right"]) for p in r["proof"]] == [("".join(a), "".join(b)) for a, b in ways[r["doc_id"]]]
        assert merkle.folded(r["leaf"], [(p["left"], p["right"]) for p in r["proof"]]) == root


def test_manifest_of_nothing(nothing):
    assert merkle.manifest(nothing).count() == 0


# 13


@pytest.fixture(scope="module")
def both():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(_tokenizer("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=_tokenizer("piece_bpe_32k.model"))


def byte_pieces(both, text):
    """Ids and bytes of the tokens of both sides; None where they don't join up to the text."""
    a, b = both
    if not text:
        return None
    e = a.encode(" " + text, add_special_tokens=False)
    alphabet = alignment.byte_alphabet()
    side_a = [(i, bytes(alphabet[c] for c in a.id_to_token(i))) for i in e.ids]
    side_b = []
    for i in b.encode(text):
        p = b.id_to_piece(i)
        side_b.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
    whole = (" " + text).encode()
    return (side_a, side_b) if all(b"".join(x for _, x in s) == whole for s in (side_a, side_b)) else None


def plain_alignment(both, rows):
    links, out = [], []
    for key, text in rows:
        sides = byte_pieces(both, text)
        if sides is None:
            out.append([key, 0, 0, 0, ""])
            links.append([])
            continue
        spans = []
        for side in sides:
            at, own = 0, []
            for i, x in side:
                own.append((at, at + len(x), i))
                at += len(x)
            spans.append(own)
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, ia, ib = [], 0, 0
        for c in cuts:
            ga, gb = [], []
            while ia < len(spans[0]) and spans[0][ia][1] <= c:
                ga.append(str(spans[0][ia][2]))
                ia += 1
            while ib < len(spans[1]) and spans[1][ib][1] <= c:
                gb.append(str(spans[1][ib][2]))
                ib += 1
            groups.append(",".join(ga) + "|" + ",".join(gb))
        pairs, j = [], 0
        for s, e, i in spans[0]:
            while spans[1][j][1] <= s:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][0] < e:
                pairs.append((i, spans[1][k][2]))
                k += 1
        links.append(pairs)
        out.append([key, len(spans[0]), len(spans[1]), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest()])
    held = Counter(p for x in links for p in set(x))
    best = defaultdict(int)
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    return sorted(((k, a, b, g, len(x), sum(held[p] == best[p[0]] for p in x), sum(held[p] for p in x), h) for (k, a, b, g, h), x in zip(out, links, strict=True)), key=str)


NAMES = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
TRICKY = ["<s>", "</s> <unk> <0x0A>", "ﬁ ½ Ａ", "a  b   c\t\td", " lead", "trail \n", "<|endoftext|>", "é é", "中文字 مرحبا 😀😀", "\x00nul", "▁x ▁", "x" * 3000, "​﻿", "­soft", "a\r\nb"]


@pytest.mark.parametrize("block_bytes", [alignment.BLOCK, 20_000])
def test_alignment(spark, documents, odd, both, block_bytes):
    docs = documents.select("doc_id", "text").unionByName(odd.withColumn("pairs", odd["kind"]), allowMissingColumns=True)
    docs = docs.unionByName(spark.createDataFrame(list(enumerate(TRICKY, 9000)), "doc_id long, text string"), allowMissingColumns=True)
    want = plain_alignment(both, [(r["doc_id"], r["text"]) for r in docs.collect()])
    got = alignment.aligned(docs, _tokenizer("byte_bpe_50k.json"), _tokenizer("piece_bpe_32k.model"), block_bytes=block_bytes).collect()
    assert sorted((tuple(r[c] for c in NAMES) for r in got), key=str) == want
    assert any(x[1] and x[3] < x[1] for x in want)


def test_alignment_of_nothing(nothing):
    assert alignment.aligned(nothing, _tokenizer("byte_bpe_50k.json"), _tokenizer("piece_bpe_32k.model")).count() == 0


def test_pointer_jumping():
    import numpy as np

    rng = np.random.default_rng(0)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        a, b = (np.union1d(rng.choice(n, rng.integers(0, n), replace=False) + 1, [n]) for _ in range(2))
        end = alignment.terminals(a, b)
        common = np.intersect1d(a, b)
        assert np.array_equal(a[end], common[np.searchsorted(common, np.concatenate([a, b]))])


def test_words_are_exact(both):
    """By words or whole, texts have the same tokens."""
    import random

    import pyarrow as pa

    aligner = alignment.Aligner(_tokenizer("byte_bpe_50k.json"), _tokenizer("piece_bpe_32k.model"))
    assert aligner.by_words
    rng = random.Random(5)
    bits = ["a", "B", " ", " ", "\n", "!", " word", " Über", ".,", "#|", "'s", "1", "\t", " x", "\x1c", "é", "<|endoftext|>", "中", "▁", "<s>", "e\u0301", "\u200b", "\xa0"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(30))) for _ in range(3000)]
    seen = 0
    for rows, counts, _, _, _, _ in aligner.step(pa.array(texts, pa.string())):
        for i, n_a, n_b in zip(rows, *counts[:2], strict=True):
            sides = byte_pieces(both, texts[i])
            assert (n_a, n_b) == ((len(sides[0]), len(sides[1])) if sides else (0, 0)), texts[i]
            seen += 1
    assert seen == len(texts)
    assert alignment.groups_of(aligner, "") == [] and len(alignment.groups_of(aligner, "one two")) == 2


def test_registered_whole(spark, documents, both):
    from conftest import DATA

    got = QUERIES["op13_token_alignment"](spark, DATA)
    assert sorted((tuple(r[c] for c in NAMES) for r in got.collect()), key=str) == plain_alignment(both, [(r["doc_id"], r["text"]) for r in documents.collect()])
