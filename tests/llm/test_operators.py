"""Each operator against a plain version in Python, on a table and on odd rows."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import DATA, ODD

from credence.llm import common, decontaminate, language_id, license_scan, mixing, ngram_join, perspectives, quality_rules, token_binary, token_counts, warc
from credence.llm.license_texts import APACHE, BSD_2, GPL, MIT
from credence.llm.queries import QUERIES, _tokenizer

WORD = re.compile("[^\x20\x09-\x0d]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def by_id(df):
    return {r[0]: r.asDict() for r in df.collect()}


@pytest.fixture(scope="session")
def texts(documents, odd):
    """All documents and the odd ones, with the odd ones' clashing columns."""
    return documents.select("doc_id", "text", "lang", "source").unionByName(odd, allowMissingColumns=True)


# 1


@pytest.fixture(scope="module")
def bytes_bpe():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(_tokenizer("byte_bpe_50k.json"))


def test_token_counts(texts, nothing, bytes_bpe):
    want = sorted((str(k), len(t.encode()), n := len(bytes_bpe.encode(t, add_special_tokens=False).ids), n > 512) for k, t in rows_of(texts))
    got = token_counts.token_counts(texts, _tokenizer("byte_bpe_50k.json")).collect()
    assert sorted((str(r[0]), *r[1:4]) for r in got) == want
    # every text longer than a chunk was spliced, and those without a boundary widened
    long = {k for k, t in rows_of(texts) if len(t) > token_counts.CHUNK}
    assert len(long) > 10 and {r["doc_id"] for r in got if r["n_seams"]} == long
    assert {r["doc_id"] for r in got if r["n_widened"]} == {1008}
    assert token_counts.token_counts(nothing, _tokenizer("byte_bpe_50k.json")).count() == 0


@pytest.mark.parametrize("chunk, overlap", [(300, 80), (997, 130), (5000, 256)])
def test_splicing(documents, bytes_bpe, chunk, overlap):
    longest = " ".join(t for _, t in rows_of(documents))[:60_000]
    for text in (longest, "a" * 3000 + " b" + "c" * 3000, "<|endoftext|>" * 900, "  \n\n " * 1500, longest[:2000] + " " * 4000 + longest[:2000], "it's " * 2000, "1234567890" * 500):
        got = [i for part in token_counts.spliced_ids(bytes_bpe, text, chunk, overlap) for i in part]
        assert got == bytes_bpe.encode(text, add_special_tokens=False).ids


def test_pieces_are_exact(bytes_bpe):
    rng = random.Random(3)
    count = token_counts.Counter(_tokenizer("byte_bpe_50k.json"), 1000, 100).count
    texts = ["".join(rng.choice(["a", "B", " ", "\n", "!", " word", " Über", ".,", "#|", "'s", "1", "\t", " ", "\x1c", " ", "é", "<|endoftext|>", "中"]) for _ in range(rng.randrange(60))) for _ in range(2000)]
    assert count(texts)[0] == [len(bytes_bpe.encode(t, add_special_tokens=False).ids) for t in texts]


# 2


def test_token_files(spark, texts, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(_tokenizer("word_bpe_49k.json"))
    want, start = [], 0
    coded = [(k, [*tokenizer.encode(t, add_special_tokens=False).ids, 2]) for k, t in rows_of(texts)]
    for k, ids in sorted(coded, key=lambda x: (x[0] is not None, x[0] or 0, np.array(x[1], "<u2").tobytes())):
        want.append((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    path = f"file://{tmp_path}/ids"
    got = token_binary.token_files(texts, _tokenizer("word_bpe_49k.json"), path=path).collect()
    assert sorted((tuple(r[c] for c in ("doc_id", "start", "n_tokens", "ids_crc32")) for r in got), key=lambda r: r[1]) == want
    ids = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in token_binary.read_ids(spark, path, with_ids=True).collect()}
    assert all(ids[k] == x for k, x in coded)


def test_word_pieces_are_exact():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(_tokenizer("word_bpe_49k.json"))
    rng = random.Random(4)
    encode = token_binary.Encoder(_tokenizer("word_bpe_49k.json")).encode
    bits = ["a", "Bc", "ß", "Ünter", " ", "\n", "\n\n", "!", "..", "'s", "'", "it's", "1", "23", "\t", "\xa0", "é", "e\u0301", "<|endoftext|>", "<|EndOfText|>", "<|", "中", "Σ", "İ", "ª", "word", "\u0308", "#%", "\x1c"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(3000)]
    assert [np.frombuffer(x, "<u2").tolist() for x in encode(pa.array(texts, pa.string())).to_pylist()] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_token_files_of_nothing(nothing, tmp_path):
    assert token_binary.token_files(nothing, _tokenizer("word_bpe_49k.json"), path=f"file://{tmp_path}/none").count() == 0


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 5000])
def test_blocks(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.01, n), 40_000).astype(np.uint16)
    table = token_binary.Table.of_counts(np.bincount(ids, minlength=10))
    assert table.freq.sum() == 1 << 20
    data = token_binary.encode_block(ids, table, 64, 8)
    out, size = token_binary.decode_block(memoryview(data), table, 64, 8)
    assert size == len(data) and out.tolist() == ids.tolist()
    for k in range(-(-n // 512)):  # each stretch without those before it
        assert token_binary.decode_block(memoryview(data), table, 64, 8, k)[0].tolist() == ids[k * 512 : (k + 1) * 512].tolist()
    if n:
        broken = bytearray(data)
        broken[-1] ^= 1
        with pytest.raises(ValueError, match="checksum"):
            token_binary.decode_block(memoryview(bytes(broken)), table, 64, 8)


# 3


def base_of(text):
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    covered = {j for i, w in enumerate(windows) if w in twice for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(texts, nothing):
    want = sorted((str(k), *base_of(t)) for k, t in rows_of(texts))
    got = quality_rules.quality_rules(texts).collect()
    assert sorted((str(r["doc_id"]), *(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))) for r in got) == want
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    assert quality_rules.quality_rules(nothing).count() == 0


def test_sketches(spark):
    rng = random.Random(2)
    rows = [("en", rng.choice("ab"), int(rng.paretovariate(0.5)) - 1) for _ in range(4000)] + [(None, None, 7), (None, "a", 10**12)]
    docs = spark.createDataFrame([(False, a, b, v, 0, 0, 0) for a, b, v in rows], "base_failed boolean, lang string, source string, symbol_ppm long, dup_ppm long, repeat_ppm long, length_e4 long")
    sketch = quality_rules.sketches(docs)
    for keys in ([], ["lang"], ["lang", "source"]):
        got = {tuple(r[k] for k in keys): r for r in quality_rules.quantiles(sketch, keys).filter("metric = 'symbol_ppm'").collect()}
        groups = defaultdict(list)
        for a, b, v in rows:
            groups[tuple({"lang": a, "source": b}[k] for k in keys)].append(v)
        assert set(got) == set(groups)
        for k, values in groups.items():
            exact = sorted(values)[-(-len(values) * 990 // 1000) - 1]
            assert exact <= got[k]["hi"] <= exact * (1 + 1 / 64) and got[k]["docs"] == len(values) and got[k]["lo"] == -1


def test_cut_offs_follow_the_source(spark):
    """The same text is kept where its like is usual, and dropped where it isn't."""
    rng = random.Random(4)
    prose = lambda: " ".join(rng.choices([f"word{i}" for i in range(900)], k=80))
    code = lambda: " ".join(w + rng.choice(["", "#", "$%"]) for w in prose().split())
    rows = [(i, prose(), "en", "book") for i in range(400)] + [(i, code(), "en", "repo") for i in range(400, 800)]
    same = " ".join(w + "#" * (i % 2) for i, w in enumerate(prose().split()))
    rows += [(1000, same, "en", "book"), (1001, same, "en", "repo"), (1002, None, "xx", None)]
    got = by_id(quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")))
    assert (got[1000]["kept"], got[1001]["kept"], got[1002]["kept"]) == (False, True, False)
    for own in (range(400), range(400, 800)):
        assert sum(not got[i]["kept"] for i in own) <= 0.05 * len(own)


# 4


def test_decontamination(spark, texts, odd, nothing, monkeypatch):
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet").unionByName(spark.createDataFrame([(900, None), (901, ""), (902, "a b c d e f g"), (903, "one")], "item_id long, text string"))
    sets = {r["item_id"]: decontaminate.shingle_set((r["text"] or "").lower()) for r in bench.collect()}
    want = set()
    for k, t in rows_of(texts):
        own = decontaminate.shingle_set(t.lower())
        want |= {(k, i) for i, s in sets.items() if s and len(s & own) * 1000 >= 800 * len(s)}
    for bits, rows in ((28, 1_000_000), (8, 0)):  # a bitmap with room, and one that lets nearly all hashes pass, joined by a shuffle
        monkeypatch.setattr(decontaminate, "LEAST_BITS", min(bits, 16))
        monkeypatch.setattr(decontaminate, "MOST_BITS", bits)
        monkeypatch.setattr(decontaminate, "CHUNK_BITS", min(bits, 13))
        monkeypatch.setattr(common, "BROADCAST_ROWS", rows)
        got = {(r["doc_id"], int(i)) for r in decontaminate.contaminated(texts, bench).collect() for i in r["items"].split(",") if i}
        assert got == want and len(want) > 5
    assert decontaminate.contaminated(nothing, bench).count() == 0
    assert decontaminate.contaminated(odd, bench.limit(0)).filter("contaminated").count() == 0


def test_shingles_in_a_text():
    text = "one two  three\tfour five one two three four five six"
    wanted = decontaminate.shingle_set("two three four five six") | decontaminate.shingle_set("four five one two three") | {("one", "two"), ("six", "one", "two", "three", "four")}
    assert decontaminate.shingles_in(text, wanted) == wanted & decontaminate.shingle_set(text) and len(wanted & decontaminate.shingle_set(text)) == 2
    assert decontaminate.shingles_in(" one two\n", wanted) == {("one", "two")} and not decontaminate.shingles_in(" ", wanted | {("",)})


def test_decontamination_keeps_rows(spark):
    item = "a b c d e f g h"
    rows = [(1, item), (1, "quite clean"), (2, item), (2, item), (None, item), (None, "clean too"), (None, "k l m n o p"), (3, None)]
    bench = spark.createDataFrame([(900, item), (901, "k l m n o p"), (902, "one two three four five")], "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted((str(k), {item: "900", "k l m n o p": "901"}.get(t, "")) for k, t in rows)
    got = decontaminate.contaminated(docs, bench).collect()
    assert sorted((str(r["doc_id"]), r["items"]) for r in got) == want
    assert all(r["contaminated"] == bool(r["items"]) == bool(r["n_items"]) == (r["containment"] == 1) for r in got)


def test_items_that_share_an_id(spark):
    bench = spark.createDataFrame([(7, "a b c d e f g h"), (7, "k l m n o p"), (None, "q r s t u v"), (8, "k l m n o p"), (7, "k l m n o p")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x a b c d e f g h y"), (2, "K L M N O P"), (3, "q r s t u v"), (4, "none")], "doc_id long, text string")
    got = {r["doc_id"]: (r["items"], r["n_items"]) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {1: ("7", 1), 2: ("7,8", 2), 3: ("-1", 1), 4: ("", 0)}


def test_short_item_in_a_long_text(spark):
    rng = random.Random(8)
    filler = [" ".join(rng.choices([f"w{i}" for i in range(3000)], k=400_000)) for _ in range(2)]
    docs = spark.createDataFrame([(1, filler[0] + " to be found here now " + filler[1]), (2, filler[0])], "doc_id long, text string")
    bench = spark.createDataFrame([(5, "to be found here now"), (6, filler[1][:2000])], "item_id long, text string")
    got = {r["doc_id"]: r["items"] for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {1: "5,6", 2: ""}


# 5


def plain_views(rows):
    """(conversation, perspective): the whole view and its trained parts."""
    clean = lambda t: t.replace("<|", "<\\|").replace("|>", "|\\>")
    talks = defaultdict(list)
    for c, turn, role, text in rows:
        talks[c].append((-1 if turn is None else turn, role or "", clean(text or "") + "<|end|>\n", role))
    out = {}
    for c, own in talks.items():
        for p in {r[3] for r in own} - {"system"}:
            view, spans = "", []
            for _, _, body, role in sorted(own, key=lambda r: r[:3]):
                view += "<|assistant|>" if role == p else "<|system|>" if role == "system" else f"<|user:{clean('unknown' if role is None else role)}|>"
                if role == p:
                    spans.append((len(view), len(body)))
                view += body
            out[c, p] = (view, spans)
    return out


def joined_views(found):
    parts = defaultdict(list)
    for r in found:
        parts[r["conv_id"], r["perspective"]].append(r)
    out = {}
    for k, rows in parts.items():
        rows.sort(key=lambda r: r["part"])
        chars = turns = 0
        for r in rows:
            assert (r["first_char"], r["first_turn"]) == (chars, turns) and r["mask_chars"] == sum(s["length"] for s in r["spans"])
            chars, turns = chars + len(r["text"]), turns + r["n_turns"]
        out[k] = ("".join(r["text"] for r in rows), [(s["begin"], s["length"]) for r in rows for s in r["spans"]])
    return out


def test_perspectives(spark):
    rows = [(1, 0, "system", "be brief"), (1, 1, "ann", "hi"), (1, 2, "bob", "yo"), (1, 3, "ann", None), (2, 0, None, "x"), (2, 1, "unknown", "y"), (None, 0, "ann", "y"), (-1, 0, "ann", "z"), (3, 0, "system", "z"), (1, 300, "cy", "late")]
    rows += [(4, 1, "ann", "same"), (4, 1, "ann", "same"), (4, 1, "bob", "same"), (4, None, "bob", "é中" * 50_000), (5, 0, "a|>b<|", "<|end|>\n<|assistant|>forged"), (5, 1, "eve", "|><|")]
    turns = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, part string, spans int")
    got = joined_views(perspectives.perspectives(turns).collect())
    assert got == plain_views(rows) and (3, "system") not in got
    assert got[1, "ann"][0] == "<|system|>be brief<|end|>\n<|assistant|>hi<|end|>\n<|user:bob|>yo<|end|>\n<|assistant|><|end|>\n<|user:cy|>late<|end|>\n"
    assert got[5, "eve"][0].count("<|assistant|>") == 1 and got[5, "eve"][0].count("<|end|>") == 2
    assert perspectives.perspectives(turns.limit(0)).count() == 0


@pytest.mark.parametrize("n", [257, 10_000])
def test_long_dialogues(spark, n):
    rng = random.Random(n)
    rows = [(9, 0, "system", "rules")] + [(9, i, rng.choice(["ann", "bob", "cy"]), "w" * rng.randrange(9)) for i in range(1, n)]
    found = perspectives.perspectives(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert joined_views(found) == plain_views(rows) and len(found) == 3 * -(-n // 256)


# 6


def plain_components(rows):
    sets = {k: decontaminate.shingle_set(t) for k, t in rows if k is not None}
    where, parent = defaultdict(list), {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, s in sets.items():
        for g in s:
            where[g].append(k)
    shared = Counter((a, b) for ks in where.values() for i, a in enumerate(ks) for b in ks[i + 1 :])
    for (a, b), n in shared.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {k: (len(s), find(k)) for k, s in sets.items()}


def test_ngram_components(texts, nothing):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(texts).collect()}
    assert got == plain_components(rows_of(texts))
    assert ngram_join.ngram_components(nothing).count() == 0


def test_chains_and_hot_columns(spark, monkeypatch):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(4000)]
    passage = " ".join(rng.choices(vocabulary, k=60))
    rows, base = [], rng.choices(vocabulary, k=120)
    for i in range(120):  # each a small change of the one before: a chain whose ends share little
        base = list(base)
        base[rng.randrange(len(base))] = rng.choice(vocabulary)
        rows.append((i, " ".join(base)))
    for i in range(120, 320):  # a passage that all share
        rows.append((i, passage + " " + " ".join(rng.choices(vocabulary, k=rng.choice([4, 10, 30, 90])))))
    for i in range(320, 420):  # copies at the threshold
        words = passage.split()
        for _ in range(rng.randrange(3)):
            words[rng.randrange(60)] = rng.choice(vocabulary)
        rows.append((i, " ".join(words)))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(docs).collect()}
    assert got == plain_components(rows)


def test_long_chains(spark, tmp_path):
    rng = random.Random(7)
    last = [*range(1, 1200), 0]  # the smallest document at the far end
    mixed = rng.sample(range(5000, 6500), 1500)
    star = [x for i in range(300) for x in ((8000, 7000 + i), (7000 + i, 9000 + i))]
    edges = [*zip(last, last[1:]), *zip(mixed, mixed[1:]), *star, (-5, -3), (-4, -4)]
    got = ngram_join.components(spark.createDataFrame(edges, "a long, b long"), f"file://{tmp_path}/chains").collect()
    want = dict.fromkeys(last, 0) | dict.fromkeys(mixed, 5000) | dict.fromkeys((x for e in star for x in e), 7000) | {-5: -5, -3: -5, -4: -4}
    assert len(got) == len(want) and {r["doc"]: r["label"] for r in got} == want


def test_negative_ids(spark):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(4000)]
    passage = " ".join(rng.choices(vocabulary, k=40))
    rows = [(k, text) for i in range(20) for text in [" ".join(rng.choices(vocabulary, k=80))] for k in (-7 - i, 7 + i, -1000 - i)]
    rows += [(i, passage + " " + " ".join(rng.choices(vocabulary, k=rng.choice([3, 60])))) for i in range(-400, -250)]  # hot columns
    rows += [(-(2**63), rows[0][1] + " more"), (2**63 - 1, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(docs).collect()}
    assert got == plain_components(rows) and got[7][1] == got[2**63 - 1][1] == -(2**63)


def test_clashing_ids(spark, monkeypatch):
    rng = random.Random(11)
    text = lambda k: " ".join(rng.choices([f"w{i}" for i in range(4000)], k=k))
    big, small, other = text(80), text(30), text(50)
    rows = [(1, small), (1, big), (2, small), (3, big + " end"), (4, other), (5, other + " x"), (5, other + " x")]
    want = {1: (76, 1), 2: (26, 2), 3: (77, 1), 4: (46, 4), 5: (47, 4)}
    monkeypatch.setattr(ngram_join, "COLUMN_ENTRIES", 1)  # all columns of two rows are hot
    for part in (rows, rows[::-1]):
        got = ngram_join.ngram_components(spark.createDataFrame(part, "doc_id long, text string")).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want and len(got) == 5


# 7


def test_language_id(documents, texts, nothing, odd):
    found = by_id(language_id.language_id(documents))
    names = {r["doc_id"]: r["lang"] for r in documents.collect()}
    held = [r for r in found.values() if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) for k, r in found.items())
    assert sum(r["lang_pred"] == names[r["doc_id"]] for r in held) >= 0.97 * len(held)
    strange = by_id(language_id.language_id(texts))
    assert all(strange[k]["lang_pred"] == "und" for k in (1001, 1002, 1003, 1010)) and strange[1007]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in strange.values())
    assert language_id.language_id(nothing).count() == 0
    model = language_id.fit(odd.limit(0))
    assert {r["lang_pred"] for r in language_id.identified(odd, model).collect()} == {"und"}


def test_spans(documents, spark):
    model = language_id.fit(documents)
    long = {lang: next(r["text"] for r in documents.filter(f"lang = '{lang}' and n_chars between 400 and 3000").collect()) for lang in ("en", "de")}
    n = {k: len(WORD.findall(t)) for k, t in long.items()}
    row = language_id.identified(spark.createDataFrame([(1, long["en"] + " " + long["de"])], "doc_id long, text string"), model).first()
    assert [s["lang"] for s in row["spans"]] == ["en", "de"] and abs(row["spans"][0]["n_words"] - n["en"]) <= 3
    assert sum(s["n_words"] for s in row["spans"]) == n["en"] + n["de"]


def test_viterbi():
    rng = np.random.default_rng(1)
    for _ in range(30):
        scores = rng.normal(size=(12, 3)).astype(np.float32)
        row = np.repeat([0, 2], [5, 7])
        path = language_id.viterbi(scores, row, 3, 1.0)
        for r in (0, 2):
            part = scores[row == r]
            best = part[0].copy()
            for s in part[1:]:
                best = np.maximum(best, best.max() - 1.0) + s
            own = path[row == r]
            assert np.isclose(part[np.arange(len(part)), own].sum() - (own[1:] != own[:-1]).sum(), best.max(), atol=1e-4)


def plain_language_id(learned, texts, penalty=6.0):
    """The whole query word by word: (language, score) of each text."""
    kinds = {c: k + 1 for k, (_, ranges) in enumerate(language_id.SCRIPTS) for a, b in ranges for c in range(a, b + 1)}

    def split(text):
        return [w.translate(FOLD) for w in WORD.findall(text)]

    def grams(w):
        raw, out = b" " + w.encode() + b" ", []
        for n in language_id.GRAMS:
            for i in range(len(raw) - n + 1):
                code = 0
                for b in raw[i : i + n]:
                    code = code * 257 + b + 1
                out.append((code * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 48)
        return out

    def script(w):
        votes = Counter(kinds.get(ord(c), language_id.KINDS - 1) for c in w if c.isalpha())
        return min(votes, key=lambda k: (-votes[k], k)) if votes else 0

    names = sorted({lang for _, lang in learned})
    counts, scripts = {x: np.zeros(language_id.BUCKETS) for x in names}, {x: np.zeros(language_id.KINDS) for x in names}
    for text, lang in learned:
        for w in split(text):
            np.add.at(counts[lang], grams(w), 1)
            scripts[lang][script(w)] += len(w.encode())
    odds = np.stack([np.log((counts[x] + 0.5) / (counts[x] + 0.5).sum()) for x in names])
    odds -= odds.mean(0)
    written = np.stack([scripts[x] >= max(0.01 * scripts[x][1:].sum(), 1) for x in names])

    def scores(w):
        k = script(w)
        if not k:
            return np.zeros(len(names))
        s = odds[:, grams(w)].sum(1)
        s = np.maximum(s - s.max(), -4)
        return np.where(written[:, k], s, -8) if written[:, k].any() else s

    out = []
    for text in texts:
        words = split(text or "")
        each = [scores(w) for w in words]
        best, came = np.zeros(len(names)), []
        for i, s in enumerate(each):
            top = int(best.argmax())
            if i:
                stay = best >= best[top] - penalty
                came.append(np.where(stay, np.arange(len(names)), top))
                best = np.where(stay, best, best[top] - penalty)
            best = best + s
        path = [int(best.argmax())]
        for back in reversed(came):
            path.append(int(back[path[-1]]))
        path.reverse()
        shares, sums = np.zeros(len(names)), np.zeros(len(names))
        for w, s, k in zip(words, each, path if words else [], strict=True):
            if script(w):
                shares[k] += len(w.encode())
                sums += s
        if not shares.sum():
            out.append(("und", 0.0))
            continue
        k = int(shares.argmax())
        gap = max(0, sums[k] - np.delete(sums, k).max())
        out.append((names[k], shares[k] / shares.sum() / (1 + np.exp(-min(gap, 50)))))
    return out


def test_language_id_by_brute_force(spark, documents, odd):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in documents.filter("n_chars < 3000").orderBy("doc_id").limit(90).collect()]
    strange = ["\u0561\u0561 \u0561", "\uff21\uff22\uff23 \uff24\uff25", "\U00010330\U00010331", "\u00aa", "\u07d2\u07de", "\U00020000 \U00020001", "1 2 ()", "", None, "Привет мир", "the и 中文 und"]
    rows += [(5000 + i, t, None) for i, t in enumerate(strange)] + [(None, "the end", "en"), (2**60 + 1, "die Welt", None)]
    found = language_id.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)).collect()
    learned = [(t, lang) for k, t, lang in rows if t is not None and lang is not None and not (k is not None and zlib.crc32(str(k).encode()) % 4 == 2)]
    want = {k: x for (k, _, _), x in zip(rows, plain_language_id(learned, [t for _, t, _ in rows]), strict=True)}
    assert len(found) == len(rows) and {r["doc_id"] for r in found} == set(want)
    for r in found:
        assert r["lang_pred"] == want[r["doc_id"]][0] and abs(r["score"] - want[r["doc_id"]][1]) < 0.01, (r, want[r["doc_id"]])
    und = {r["doc_id"] for r in found if r["lang_pred"] == "und"}
    assert und == {5000 + i for i, t in enumerate(strange) if not any(c.isalpha() for c in t or "")}


@pytest.mark.parametrize("langs", [129, 200, 300])
def test_many_languages(spark, langs):
    want = np.repeat(np.random.default_rng(langs).permutation(langs), 3)
    scores = np.where(np.arange(langs) == want[:, None], 0, -4).astype(np.float32)
    assert language_id.viterbi(scores, np.zeros(len(want), np.int64), 1, 1.0).tolist() == want.tolist()
    if langs == 200:
        words = ["".join(random.Random(i).choices("abcdefghijklmnopqrstuvwxyz", k=12)) for i in range(langs)]
        docs = spark.createDataFrame([(i, f"{w} " * 20, f"l{i:03}") for i, w in enumerate(words)], "doc_id long, text string, lang string")
        found = language_id.identified(docs, language_id.fit(docs)).collect()
        assert all(r["lang_pred"] == f"l{r['doc_id']:03}" and [s["lang"] for s in r["spans"]] == [r["lang_pred"]] for r in found) and len(found) == langs


# 8


def test_license_scan(spark, texts, nothing):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    wrapped = "\n * ".join(MIT.split("\n")) + "\n\n" + "\n# ".join(" ".join(BSD_2.split()[i : i + 9]) for i in range(0, len(BSD_2.split()), 9))
    rng = random.Random(12)
    near = [w if rng.random() < 0.93 else "changed" for w in word.findall(GPL.translate(FOLD))]
    extra = [(2000, "filler " * 1000 + wrapped + " filler" * 3000), (2001, " ".join(near)), (2002, "Licensed under CC BY 4.0"), (2003, "licensed under\nCC BY-NC\n4.0."), (2004, " ".join(APACHE.split()[:30])), (2004, MIT), (2004, MIT)]
    texts = texts.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    found = license_scan.license_scan(texts).collect()
    got = Counter((str(r["doc_id"]), r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], round(r["score"], 9), r["n_blocks"]) for r in found)
    templates = [(label, license_scan.need(len(set(t)), share), len(t), set(t)) for label, share, text in license_scan.TEMPLATES for t in [word.findall(text.translate(FOLD))]]
    want = Counter()
    for k, text in rows_of(texts):
        words = word.findall(text.translate(FOLD))
        at = {label: [i for i in range(len(words)) if tuple(words[i : i + len(p)]) == p] for label, p in license_scan.PHRASES.items()}
        every = [i for x in at.values() for i in x]
        base = {label for label, x in at.items() if x}
        labels, best, blocks = set(base), 0.0, 0
        for label, least, stride, tokens in templates:
            for begin in range(0, len(words), stride):
                n = len(tokens.intersection(words[begin : begin + 2 * stride]))
                if n >= least:
                    labels.add(label)
                    best, blocks = max(best, n / len(tokens)), blocks + 1
        want[str(k), len(words), len(every), min(every, default=None), max(every, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), round(1.0 if every else best, 9), blocks] += 1
    assert got == want
    labels = {r["doc_id"]: r["labels"] for r in found if r["doc_id"] is not None and r["doc_id"] >= 2000}
    assert labels[2000] == "bsd,mit" and "gpl" in labels[2001] and labels[2002] == "cc-by" and labels[2003] == "cc-by,cc-by-nc"
    assert license_scan.license_scan(nothing).count() == 0
    assert {r["labels"] for r in license_scan.license_scan(texts, []).collect()} == {r["base_labels"] for r in found}


# 9


def test_mixing(texts, nothing):
    drawn = mixing.mixed_sources(texts, max_repeats=1.5, block_tokens=2000).collect()
    mass = mixing.token_mass(texts).collect()
    own = {(r["doc_id"], r["source"], r["h"]): r["n_tokens"] for r in mass}
    total, sizes = sum(own.values()), Counter()
    for (_, s, _), n in own.items():
        sizes[s] += n
    lo, hi = 0.0, 1.0
    for _ in range(60):
        a = (lo + hi) / 2
        z = sum(n**a for n in sizes.values())
        lo, hi = (a, hi) if max(n ** (a - 1) for n in sizes.values()) / z * total > 1.5 else (lo, a)
    z = sum(n**hi for n in sizes.values())
    times, spent = Counter((r["doc_id"], r["source"], r["h"]) for r in drawn), Counter()
    for k, n in times.items():
        spent[k[1]] += n * own[k]
    for s, n in sizes.items():
        target = n**hi / z * total
        assert spent[s] <= target + 1 and spent[s] > target - max(v for k, v in own.items() if k[1] == s) - 1
        assert all(times[k] in (target // n, target // n + 1) for k in own if k[1] == s)
    assert mixing.mixed_sources(nothing).count() == 0


def test_entropy(spark):
    sources = spark.createDataFrame([("a", 1000), ("b", 100), ("c", 10)], "source string, tokens long")
    for goal in (0.5, 0.9, 1.05):
        a = mixing.exponent(sources, 1110.0, None, goal)
        p = np.array([1000.0, 100, 10]) ** a
        p /= p.sum()
        assert abs(-(p * np.log(p)).sum() - goal) < 1e-6
    for goal in (0.2, 1.2):
        with pytest.raises(ValueError, match="no mix"):
            mixing.exponent(sources, 1110.0, None, goal)
    assert mixing.exponent(sources, 1110.0, 1000.0, None) == 0.0
    with pytest.raises(ValueError, match="no mix"):
        mixing.exponent(sources, 11100.0, 2.0, None)


def test_blocks_before(spark, tmp_path):
    rng = random.Random(9)
    rows = [(s, b, rng.randrange(1 << 60), rng.randrange(1, 50)) for s in ("a", "b", None) for b in range(700)]
    got = mixing.blocks_before(spark.createDataFrame(rows, "source string, block long, block_order long, block_tokens long"), f"file://{tmp_path}/b").collect()
    want, total = {}, Counter()
    for s, b, _, n in sorted(rows, key=lambda r: r[2]):
        want[s, b] = total[s]
        total[s] += n
    assert {(r["of"], r["b"]): r["earlier"] for r in got} == want


# 10


def test_warc(spark, tmp_path):
    rows = [(1, "http://a/ b", "same"), (2, None, "same"), (3, "http://c", None), (4, "http://d", ""), (5, "u", "x\r\n\r\nWARC/1.1\r\n\r\né"), (5, "u", "x\r\n\r\nWARC/1.1\r\n\r\né"), (6, "v", "long " * 200_000), (None, "w", "same"), (7, "z", "\r\n\r\n")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload_digest string")
    got = warc.deduplicated(pages, f"file://{tmp_path}/w").collect()
    payload = {k: (h or "").encode() for k, _, h in rows}
    want = {1: ("revisit", 2), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None), 5: ("response", None), 6: ("response", None), None: ("revisit", 2), 7: ("response", None)}
    assert len(got) == len(rows) and all(r["intact"] for r in got)
    for r in got:
        p = payload[r["page_id"]]
        assert (r["record_type"], r["refers_to"]) == want[r["page_id"]]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(p), base64.b32encode(hashlib.sha1(p).digest()).decode())
    assert warc.deduplicated(pages.limit(0), f"file://{tmp_path}/none").count() == 0


def test_registered_queries(spark):
    assert [k.split("_")[0] for k in QUERIES if k.startswith("op")] == [f"op{n}" for n in range(1, 11)]
    assert {len(r) for r in ODD} == {5}
