"""Pieces with offsets against the library, with the model as it is and with other ways of normalising."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from graphweave.llm import pieces, queries

PATH = public_tokenizers.path("piece_bpe_32k.model")
PARTS = [*"ab  ▁é日本語😀\0\n\t①ﬁ½ 　ガｶﾞ한한﻿​¨²²..,__''<s>/0x41İß\xa0", "hello", "the ", " world", "<unk>", "m²", "é", "  ", "internationalization"]


def texts(seed, n, most=40):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randrange(most))) for _ in range(n)]


def other_model(**rules):
    m = sentencepiece_model_pb2.ModelProto()
    with open(PATH, "rb") as f:
        m.ParseFromString(f.read())
    if rules.pop("mapped"):
        n = sentencepiece_model_pb2.ModelProto()
        n.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto())
        m.normalizer_spec.precompiled_charsmap = n.normalizer_spec.precompiled_charsmap
    m.trainer_spec.treat_whitespace_as_suffix = rules.pop("suffix")
    for name, value in rules.items():
        setattr(m.normalizer_spec, name, value)
    return m.SerializeToString()


@pytest.mark.parametrize("mapped", [False, True])
@pytest.mark.parametrize("squeeze", [False, True])
@pytest.mark.parametrize("prefix", [False, True])
@pytest.mark.parametrize("suffix", [False, True])
def test_every_way_of_normalising_equals_the_library(mapped, squeeze, prefix, suffix):
    model = other_model(mapped=mapped, suffix=suffix, remove_extra_whitespaces=squeeze, add_dummy_prefix=prefix)
    library, own = sentencepiece.SentencePieceProcessor(model_proto=model), pieces.Pieces(model=model)
    for text in texts(3, 400):
        ids, starts, ends = own.encode(text)
        want = library.encode(text, return_type="proto").pieces
        assert ids.tolist() == [p.id for p in want]
        assert list(zip(starts.tolist(), ends.tolist())) == [(p.begin, p.end) for p in want]
        assert own.decode(ids) == library.decode(ids.tolist())


def test_decoding_of_any_ids_equals_the_library():
    library, own, rng = sentencepiece.SentencePieceProcessor(model_file=PATH), pieces.Pieces(PATH), random.Random(5)
    for _ in range(3000):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(300), 28705]) for _ in range(rng.randrange(12))]
        assert own.decode(np.array(ids, dtype=np.int64)) == library.decode(ids)


def test_long_stretches_and_a_small_memory():
    library, own, rng = sentencepiece.SentencePieceProcessor(model_file=PATH), pieces.Pieces(PATH, memo=5), random.Random(6)
    for text in [*texts(7, 100), "x" * 3000, "".join(rng.choice("etaoin日本") for _ in range(5000)), " " * 500, "a" + " " * 37 + "b ", "²." * 50 + " word " * 9]:
        assert own.encode(text)[0].tolist() == library.encode(text)


def test_spans_are_the_text_behind_the_pieces():
    own, text = pieces.Pieces(PATH), "é 日x ሴ😀 end"
    ids, starts, ends = own.encode(text)
    assert "".join(text.encode()[a:z].decode() for a, z in zip(starts, ends)) == text
    assert (ends[:-1] <= starts[1:]).all() and ends[-1] == len(text.encode())
    text = "  ﬁne   ①  "
    ids, starts, ends = pieces.Pieces(model=other_model(mapped=True, suffix=False, remove_extra_whitespaces=True, add_dummy_prefix=True)).encode(text)
    assert "".join(text.encode()[a:z].decode() for a, z in zip(starts, ends)) == "ﬁne   ①"


def test_models_of_other_kinds_are_refused():
    m = sentencepiece_model_pb2.ModelProto()
    with open(PATH, "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.byte_fallback = False
    with pytest.raises(ValueError):
        pieces.Pieces(model=m.SerializeToString())
    m.trainer_spec.byte_fallback = True
    m.pieces.add(piece="<own>", type=4)
    with pytest.raises(ValueError):
        pieces.Pieces(model=m.SerializeToString())


def test_query_over_awkward_rows(spark, docs, none, tables):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    want = []
    for r in docs.collect():
        ids = library.encode(r["text"] or "")
        want.append((str(r["doc_id"]), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest(), len((r["text"] or "").encode())))
    got = [(str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], r["n_bytes"]) for r in queries.op11_piece_offsets(spark, tables).collect()]
    assert sorted(got) == sorted(want)
    assert pieces.round_trip_digests(none, PATH).collect() == []


def test_encoded_table_and_its_decoding(spark, docs):
    coded = pieces.encode_texts(docs, PATH)
    assert coded.where(F.size("ids") != F.size("starts")).count() == 0 and coded.count() == docs.count()
    back = {(r["doc_id"], r["decoded_text"]) for r in pieces.decode_ids(coded, PATH).collect()}
    assert back == {(r["doc_id"], (r["text"] or "").replace("▁", " ")) for r in docs.collect()}
