"""BPE encoding and token counts against the libraries themselves."""

import hashlib
import random

import public_tokenizers
import pyarrow as pa
import sentencepiece
from tokenizers import Tokenizer

from attestry.llm import bpe, token_counts

WORD_BPE, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "\n", "a  b", "Hello, world!  Ñandú́ <|endoftext|> <|ENDOFTEXT|>x it's  12 ", "\x1c a\x85b​c ﷺ é", "don't <|endoftext|>'s a</w>b </w> x", "!" * 3000, "日本語のテキスト 한국어 \U0001f600\U0001f468‍\U0001f469",
    "ΑΣ Σ İ", "á ́b", "</w></w> <//w>>", "▁x ▁▁y\n▁", "\n\nx \n y  \n", "\t tab\t\r\n cr", "a\x00b", "word " * 3000, "x" * 20000, "<s> </s> <0x0A> <unk>",
]


def texts():
    rng = random.Random(1)
    return ODD + ["".join(rng.choice("ab <|>/w\n▁é!'s1２日́ ") for _ in range(rng.randint(1, 40))) for _ in range(400)]


def test_round_trip_is_the_library(spark):
    library = Tokenizer.from_file(WORD_BPE)
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, i) for i, t in rows], "doc_id bigint, text string, ids bigint")
    got = {r.doc_id: r for r in bpe.round_trip(df, WORD_BPE).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want = (len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == want, repr(t)[:80]


def test_encode_gives_ids_and_text(spark):
    df = spark.createDataFrame([(1, "Hello world", "x"), (2, None, "y")], "doc_id bigint, text string, decoded string")
    got = {r.doc_id: (r.ids, r.decoded) for r in bpe.encode(df, WORD_BPE).collect()}
    assert got[1] == (Tokenizer.from_file(WORD_BPE).encode("Hello world", add_special_tokens=False).ids, "hello</w> world</w>") and got[2] == ([], "")


def test_cuts_hold_no_token():
    vocabulary, word = bpe.load(WORD_BPE), b"qjxzqvwkxj"
    ids, offsets, of_word, first = vocabulary.fragments(pa.array([b"abc", word], pa.binary()))
    cuts = (offsets[first[1] :] - 3).tolist()
    assert len(cuts) > 2 and cuts[-1] == len(word) and (of_word[first[1] :] == 1).all()
    tokens = vocabulary.tokens.to_pylist()
    assert not any(word[i - 1 : i + 1].decode() in t for i in cuts[1:-1] for t in tokens)


def test_long_fragments_merge_alike(monkeypatch):
    library, rng = Tokenizer.from_file(WORD_BPE), random.Random(3)
    some = ["".join(rng.choice("aeinst!-") for _ in range(rng.randint(1, 90))) for _ in range(200)] + [None, "", "a" * 300]
    for longest in (1, 2, 7, 64):
        monkeypatch.setattr(bpe, "LONGEST_TOGETHER", longest)
        ids, offsets = bpe.load(WORD_BPE).encode(pa.array(some))
        assert [ids[s:e].tolist() for s, e in zip(offsets, offsets[1:])] == [library.encode(t or "", add_special_tokens=False).ids for t in some]


def test_decoding_in_blocks(monkeypatch):
    monkeypatch.setattr(bpe, "DECODED_AT_ONCE", 3)
    library, some = Tokenizer.from_file(WORD_BPE), ["a b c d e f g", "", "x", None, "one two", "three four five", ""]
    vocabulary = bpe.load(WORD_BPE)
    got = [t for _, texts in vocabulary.decode(*vocabulary.encode(pa.array(some))) for t in texts]
    assert got == [library.decode(library.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False) for t in some]


def test_counts_are_the_library(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, n_tokens int")
    got = {r.doc_id: r for r in token_counts.count_tokens(df, PIECES, limit=2000).collect()}
    for i, t in rows:
        n = len(library.encode(t or ""))
        assert (got[i].n_tokens, got[i].over_limit, got[i].n_bytes) == (n, n > 2000, len((t or "").encode())), repr(t)[:80]


def test_whole_tokens_encode_alone():
    c = token_counts.counter(PIECES)
    assert len(c.whole) > 30000
    assert all(len(c.sp.encode("\n" + p)) - c.lead == 1 for p in random.Random(2).sample(sorted(c.whole), 300))


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert bpe.round_trip(df, WORD_BPE).count() == 0 and token_counts.count_tokens(df, PIECES).count() == 0
