import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestone.llm import bpe

LIB = Tokenizer.from_file(bpe.default_vocabulary())
OWN = bpe.TokenAutomaton(bpe.read_spec(bpe.default_vocabulary()))


def same(text):
    ids = np.frombuffer(OWN.encode(text), "<u4").tolist()
    lib = LIB.encode(text, add_special_tokens=False).ids
    assert ids == lib
    assert OWN.decode(OWN.encode(text)) == LIB.decode(lib, skip_special_tokens=False)


def test_special_cases():
    for t in ["", " ", "Hello, World's", "a<|endoftext|>b", "ΑΣ ΣΑΣ", "İstanbul Å ﬁ", "x\u3000y\x1cz\u0085q", "a" * 3000, "thethethe" * 50, "é́ 한글 日本 😀", "1234'll've"]:
        same(t)


def test_equals_library_for_every_code_point():
    """Each character alone, between letters, doubled and beside digits and marks, against the library."""
    for at in [*range(0, 0x40000, 0x400), *range(0xE0000, 0x110000, 0x8000)]:
        every = [chr(i) for i in range(at, at + 0x400) if not 0xD800 <= i <= 0xDFFF]
        if every:
            text = " ".join(f"a{c}b7{c}{c}! {c} e\u0301{c}\u0327Σ" for c in every)
            assert np.frombuffer(OWN.encode(text), "<u4").tolist() == LIB.encode(text, add_special_tokens=False).ids


def test_equals_library_for_random_ranges():
    rng = np.random.default_rng(11)
    for _ in range(3000):
        top = int(rng.choice([0x80, 0x600, 0x3000, 0x20000]))
        text = "".join(chr(i) for i in rng.integers(0, top, rng.integers(1, 25)).tolist() if not 0xD800 <= i <= 0xDFFF)
        same(text)


def test_long_words_take_time_in_proportion():
    rng = np.random.default_rng(12)
    for text in ("ab" * 50_000, "".join(rng.choice(list("aeiost"), 100_000)), "é" * 100_000, " " * 1_000_000 + "x", "!" * 100_000):
        same(text)


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from(list("aabtheinsr' .,!0üßΣİ한日😀\n")), max_size=40))
def test_equals_library(text):
    same(text)


def test_every_arc_pair_is_canonical():
    """Pairs of tokens: two follow each other in the automaton exactly if encoding their joined text gives them back."""
    rng = np.random.default_rng(3)
    letters = [i for i, x in enumerate(OWN.labels) if x.isascii() and x.replace("</w>", "").isalpha() and x == x.lower()]
    inner = [i for i in letters if not OWN.labels[i].endswith("</w>")]
    final = [i for i in letters if OWN.labels[i].endswith("</w>")]
    for a, b in zip(rng.choice(inner, 300), rng.choice(final, 300)):
        word = OWN.labels[a] + OWN.labels[b].replace("</w>", "")
        assert OWN.follows(int(a), int(b)) == (OWN.word(word) == [int(a), int(b)])


def test_columns(spark):
    df = spark.createDataFrame([(1, "The end.", b"x"), (2, None, b"y"), (3, "", b"z"), (1, "The end.", b"x")], "doc_id long, text string, ids binary")
    out = bpe.decode(bpe.encode(df, bpe.default_vocabulary()), bpe.default_vocabulary()).collect()
    assert len(out) == 4 and [r.decoded for r in out if r.doc_id == 2] == [""]
    want = LIB.encode("The end.", add_special_tokens=False)
    got = next(r for r in out if r.doc_id == 1)
    assert np.frombuffer(got.ids, "<u4").tolist() == want.ids and hashlib.sha256(got.decoded.encode()).hexdigest()
    assert bpe.encode(df.limit(0), bpe.default_vocabulary()).count() == 0


def test_query_equals_library(spark):
    from lodestone.llm import registry

    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in registry.queries()["op1_bpe"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    for d in docs:
        ids = LIB.encode(d.text or "", add_special_tokens=False).ids
        r = got[d.doc_id]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(LIB.decode(ids, skip_special_tokens=False).encode()).hexdigest()
