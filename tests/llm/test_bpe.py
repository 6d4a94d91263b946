"""Encoding and decoding against the tokenizers library."""

import hashlib
import random
import sys

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from peneira.llm import bpe, queries

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(PATH)
    made.no_padding()
    made.no_truncation()
    return made


@pytest.fixture(scope="module")
def coder():
    return bpe.coder(PATH)


def same(coder, library, texts):
    got = coder.encode(texts)
    for text, ids in zip(texts, got, strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids == want, text[:80]
        assert coder.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_every_character(coder, library):
    every = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    same(coder, library, ["".join(every[i : i + 997]) for i in range(0, len(every), 997)])
    same(coder, library, [f"a{c}{c}1 {c}!" for c in every[:0x3100]] + ["".join(f"x{c}é" for c in every[i : i + 50]) for i in range(0x3100, len(every), 50)])


def test_odd_texts(coder, library):
    texts = ["", " \n\t ", "a", "it's we'll I'M 'SAY", "ΣΑΣ ΟΔΟΣ σας", "İstanbul ǅ ﬀ ß ẞ", "é ạ̈ 각 Å", "x<|endoftext|>y <|startoftext|><|endoftext|", "<|END", "</w> a</w>b <w></", "\x00\x01\x85\xa0​  　", "日本語 русский العربية 😀👍🏽 \U0001e900", "１２ ²³ Ⅷ", "a" * 5000, "ab" * 4000 + "!" * 3001, "é" * 999, "-" * 70 + "=" * 33]
    same(coder, library, texts)


def test_random_words(coder, library):
    rng = random.Random(4)
    pieces = list(coder.merges.inner)
    words = ["".join(rng.choice("abcdeghilmnoprstuvéñ") for _ in range(rng.randint(1, 14))) for _ in range(4000)]
    words += [b"".join(rng.choice(pieces) for _ in range(rng.randint(1, 5))).decode("utf-8", "ignore") for _ in range(6000)]
    words += [rng.choice("abc") * rng.randint(1, 9) + rng.choice("abn") * rng.randint(1, 9) for _ in range(3000)]
    before = coder.failed
    same(coder, library, [" ".join(words[i : i + 50]) for i in range(0, len(words), 50)])
    assert coder.failed > before


def test_pairs_equal_exact_merging(coder):
    m, rng = coder.merges, np.random.default_rng(1)
    inner = np.array([i for i, (raw, end) in enumerate(m.raw) if raw and not end])
    every = np.array([i for i, (raw, _) in enumerate(m.raw) if raw])
    a, b = rng.choice(inner, 20_000), rng.choice(every, 20_000)
    # pairs that touch where a longer token is cut are the hard ones
    cut = [(m.inner[raw[:j]], m.last[raw[j:]]) for raw in m.last for j in range(1, len(raw)) if raw[:j] in m.inner and raw[j:] in m.last][::7]
    a, b = np.concatenate([a, [x for x, _ in cut]]), np.concatenate([b, [y for _, y in cut]])
    ends = [m.raw[j][1] for j in b]
    got = m.compatible(a, b)
    for x, y, end, fine in zip(a.tolist(), b.tolist(), ends, got, strict=True):
        if end:
            assert (m.merged(m.raw[x][0] + m.raw[y][0]) == [x, y]) == fine
    assert got.any() and not got.all()
    # every token is made of its own bytes
    assert all(m.merged(raw) == [i] for i, (raw, end) in enumerate(m.raw) if raw and end) and m.sound.sum() == len(every)


def test_a_file_whose_merges_do_not_build_on_earlier_ones():
    signs = bpe.byte_signs()
    vocab = {s + e: i for i, (s, e) in enumerate((s, e) for e in ("", bpe.END) for s in signs)}
    vocab |= {"ab": 512, "abc": 513}
    with pytest.raises(ValueError):
        bpe.Merges(vocab, [("ab", "c"), ("a", "b")])


def test_words_come_back(coder):
    text = "The  Quick brown-fox, it's 42 naïve <|endoftext|> end"
    assert coder.words_of(coder.encode([text])[0]) == "the quick brown - fox , it 's 4 2 naïve <|endoftext|> end"


def test_store_of_words_is_bounded(coder, monkeypatch, library):
    monkeypatch.setattr(bpe, "KEPT_WORDS", 50)
    rng = random.Random(8)
    for _ in range(5):
        same(coder, library, ["".join(rng.choice("abcdefgh") for _ in range(60)) + " " + " ".join(str(rng.random()) for _ in range(40))])
    assert all(len(w) <= bpe.KEPT_BYTES for w in coder.known)


def test_operator(spark, edges, edge_rows, empty, library):
    got = sorted(map(tuple, bpe.encode_decode(edges, PATH).collect()), key=str)
    want = []
    for doc_id, text, *_ in edge_rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((doc_id, ids, library.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want, key=str)
    assert bpe.encode_decode(empty, PATH).collect() == []


def test_query(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for r in docs:
        ids = library.encode(r.text, add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    got = queries.op12_bpe(spark, sf_dir)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(want)
