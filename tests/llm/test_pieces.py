"""SentencePiece encoding with spans, against the library itself."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from attestry.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "  ", "\n", "a  b", " lead", "trail ", "Ñandú́ </s> <s> <0x41> <unk>", "\x1c a\x85b​c ﷺ é", "日本語のテキスト 한국어 \U0001f600\U0001f468‍\U0001f469 x", "▁x ▁▁y\n▁", "\n\nx \n y  \n", "\t tab\t\r\n cr",
    "a\x00b", "word " * 3000, "x" * 20000, " " * 500 + "y", "�￾", "end \U0010ffff",
]


def texts():
    rng = random.Random(3)
    return ODD + ["".join(rng.choice("ab <|>/w\n▁é!'s1２日́ ") for _ in range(rng.randint(1, 60))) for _ in range(400)]


def library_spans(sp, text):
    return [(p.begin, p.end) for p in sp.encode(text, return_type="proto").pieces]


@pytest.mark.parametrize("block", [pieces.BLOCK, 7])
def test_ids_spans_and_text_are_the_librarys(block, monkeypatch):
    monkeypatch.setattr(pieces, "BLOCK", block)
    sp, model = sentencepiece.SentencePieceProcessor(model_file=PATH), pieces.load(PATH)
    for t in texts():
        t = t or ""
        ids, begins, ends = model.encode(t)
        want = sp.encode(t, add_eos=True)
        assert ids.tolist() == want, repr(t)[:80]
        assert model.decode(want) == sp.decode(want), repr(t)[:80]
        assert list(zip(begins.tolist(), ends.tolist()))[:-1] == library_spans(sp, t), repr(t)[:80]
        assert begins[-1] == ends[-1] == len(t.encode())


def test_spans_cover_the_text_without_a_gap():
    model = pieces.load(PATH)
    for t in texts():
        data = (t or "").encode()
        _, begins, ends = model.encode(t or "")
        assert b"".join(data[b:e] for b, e in zip(begins, ends)) == data


def test_decoding_any_ids():
    sp, model, rng = sentencepiece.SentencePieceProcessor(model_file=PATH), pieces.load(PATH), random.Random(4)
    for _ in range(500):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(3, 259)]) for _ in range(rng.randint(0, 9))]
        assert model.decode(ids) == sp.decode(ids), ids


@pytest.mark.parametrize("rule", ["identity", "nfkc", "nmt_nfkc", "nmt_nfkc_cf"])
@pytest.mark.parametrize("extra", [False, True])
def test_normalisation_is_the_librarys(rule, extra):
    """Compiled maps of the library's own, with what each character came from."""
    theirs = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=extra)
    spec = {n: v for n, v, _ in pieces.message(theirs.serialized_normalizer_spec())}
    ours = pieces.Normaliser(pieces.CharacterMap(spec.get(pieces.CHARACTER_MAP, b"")), dummy_prefix=True, remove_extra=extra)
    more = ["ＡＢＣ ①  ｶﾞ ", "  ﬁne　wide space  ", "İstanbul ẞ ǅ", "é ẹ́ 각", "​﻿x­ y", "①②" * 50, "がギ㍿ ﷺ"]
    for t in texts() + more:
        t = t or ""
        normal, source = ours(t)
        want, offsets = theirs.normalize(t, with_offsets=True)
        assert normal == want, (rule, repr(t)[:60])
        at = np.concatenate([[0], np.cumsum([len(c.encode()) for c in t])]).astype(int)
        of_character = np.concatenate([[0], np.cumsum([len(c.encode()) for c in normal])]).astype(int)
        if normal:  # of a text without any, the library tells nothing; here its end is the source's
            assert source[of_character].tolist() == at[offsets].tolist(), (rule, repr(t)[:60])
        assert source[-1] <= len(t.encode())


def test_report_and_lists(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows] + [(None, "again", "", 1)] * 2, "doc_id bigint, text string, ids string, n_tokens int")
    got = {r.doc_id: r for r in pieces.round_trip(df, PATH).collect()}
    listed = {r.doc_id: r for r in pieces.encode(df, PATH).collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for i, t in [*rows, (None, "again")]:
        ids = sp.encode(t or "", add_eos=True)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), digest(" ".join(map(str, ids))), digest(sp.decode(ids))), repr(t)[:80]
        spans = np.array([listed[i].begins, listed[i].ends], "<u4").T.tobytes()
        assert listed[i].ids == ids and listed[i].decoded == sp.decode(ids) and got[i].spans_sha256 == hashlib.sha256(spans).hexdigest()
    empty = df.where("false")
    assert pieces.round_trip(empty, PATH).count() == 0 and pieces.encode(empty, PATH).columns == ["doc_id", "ids", "begins", "ends", "decoded"]


def test_models_that_cannot_be_cut_or_have_no_byte_pieces():
    with open(PATH, "rb") as f:
        data = f.read()
    kept = b"".join(raw for n, _, raw in pieces.message(data) if n != pieces.TRAINER)
    with pytest.raises(ValueError):
        pieces.PieceModel(kept)
    model = pieces.PieceModel(data)
    model.cuts = False
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    assert all(model.encode(t or "")[0].tolist() == sp.encode(t or "", add_eos=True) for t in texts()[:80])
