"""Document frequencies and ids of packing, against plain readings."""

from __future__ import annotations

from collections import Counter

import public_tokenizers

from graphweave.llm import packing


def test_frequencies_count_an_id_once_for_each_document(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["the the the cat", "The cat. x1 don't", None, "", "theé unheardofword a_b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    library = packing.WordBPE(path).library
    want = Counter(i for t in texts for i in {*library.encode(t or "", add_special_tokens=False).ids, packing.END_ID})
    frequency, rows, _ = packing.token_statistics(packing.tokenized(df, path), packing.tokenizer(path).size)
    assert rows == 5 and {k: n for k, n in enumerate(frequency.tolist()) if n} == want
    assert [x.tolist() for x in packing.WordBPE(path).encode([t or "" for t in texts])] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
