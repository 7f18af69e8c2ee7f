"""The pipeline against a plain version of every stage, over planted copies, junk and personal data."""

from __future__ import annotations

import random
import re

import numpy as np
import public_tokenizers
import pytest
from test_queries import fingerprint, smallest
from tokenizers import Tokenizer

pytest.importorskip("corpus_pipeline")
import corpus_pipeline  # noqa: E402

from graphweave.llm import stages  # noqa: E402

SHAPE = "doc_id long, text string, lang string, source string, n_chars long"
MAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def prose(rng, n=120):
    return " ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    clean = [prose(rng) for _ in range(40)]
    clean += [f"{prose(rng, 60)} Write to user{k}@mail.example.org today. {prose(rng, 30)}" for k in range(5)]
    texts = clean + clean[:6] + ["%%% ".join(prose(rng).split()) + "%%%" for _ in range(8)] + ["too short", "", None, "same words again " * 60]
    return [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]


def test_stages(spark, rows, tmp_path):
    spark.createDataFrame(rows, SHAPE).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    text = {k: t for k, t, *_ in rows}
    assert kept["quality"] == {k: text[k] for k in range(51)}  # the clean ones and their copies
    ids = sorted(kept["quality"])
    group = smallest([fingerprint(text[k]) for k in ids], ids)
    assert sorted(kept["near_duplicates"]) == sorted(set(group)) == list(range(45))
    assert kept["personal_data"] == {k: MAIL.sub("[EMAIL]", text[k]) for k in range(45)}
    assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    found = {k: {} for k in range(45)}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        found[r["doc_id"]][r["start"]] = np.frombuffer(r["ids"], dtype="<u4").tolist()
    for k in range(45):
        assert sum((found[k][s] for s in sorted(found[k])), []) == [*t.encode(kept["personal_data"][k], add_special_tokens=False).ids, 1]


def test_stages_stand_awkward_tables(spark, docs, none):
    for df in (docs, none):
        for stage in (stages.keep_good, stages.keep_one_of_each, stages.mask_private):
            out = stage(df)
            assert out.columns == df.columns
            assert {r["doc_id"] for r in out.select("doc_id").collect()} <= {r["doc_id"] for r in df.select("doc_id").collect()}
    assert stages.keep_one_of_each(docs).where("doc_id is null").count() == 1
    assert stages.mask_private(docs).count() == docs.count()


def jaccard(a, b):
    a, b = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (a.lower().split(), b.lower().split()))
    return len(a & b) / len(a | b)


def test_near_copies_go(spark):
    rng = random.Random(3)
    texts, want = [], set()
    for k in range(30):
        words = prose(rng, 300).split()
        near, far = list(words), list(words)
        for at in range(1 + k % 5):
            near[30 + 50 * at] = "other"
        for at in range(12):
            far[10 + 24 * at] = "other"
        texts += [" ".join(words), " ".join(near), " ".join(far)]
        assert jaccard(texts[-3], texts[-2]) >= 0.8 > 0.75 > jaccard(texts[-3], texts[-1]) and jaccard(texts[-2], texts[-1]) < 0.8
        want |= {3 * k, 3 * k + 2}
    df = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], SHAPE)
    assert {r["doc_id"] for r in stages.keep_one_of_each(df).collect()} == want


def test_texts_that_share_an_id_stay(spark):
    rng = random.Random(5)
    a, b, c = prose(rng), prose(rng), prose(rng)
    rows = [(1, a), (2, a), (2, b), (2, b), (None, a), (None, c), (None, c), (3, None)]
    df = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], SHAPE)
    got = sorted(((r["doc_id"], r["text"]) for r in stages.keep_one_of_each(df).collect()), key=str)
    assert got == sorted([(1, a), (2, b), (None, c), (3, None)], key=str)


def test_large_groups_are_compared_in_blocks(spark):
    """A chain of copies, each changed a little, that shares bands but isn't one star; many blocks, and few."""
    from graphweave.llm import near_copies
    from graphweave.llm.common import components

    rng = random.Random(11)
    words = prose(rng, 200).split()
    texts = [" ".join(words)]
    for k in range(60):
        words = list(words)
        words[(k * 7) % 190] = f"w{k}"
        texts.append(" ".join(words))
    texts += [prose(rng, 200) for _ in range(20)]
    keyed = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    parent = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= 0.8:
                a, b = parent[i], parent[j]
                parent = [min(a, b) if x in (a, b) else x for x in parent]
    for block in (5, 2000):
        rows, links = near_copies.near_copies(keyed, block=block)
        node = {r["key"]: r["node"] for r in rows.collect()}
        found = {r["node"]: r["component"] for r in components(links).collect()}
        got = [found.get(node[k], node[k]) for k in range(len(texts))]
        assert all((got[i] == got[j]) == (parent[i] == parent[j]) for i in range(len(texts)) for j in range(i))


def test_run_on_an_empty_table_and_no_tables_left(spark, tmp_path):
    from graphweave.llm import common

    before = common.stored()
    spark.createDataFrame([], SHAPE).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    assert len([x for x in common.stored() if x not in before]) <= 4  # the last stage's input and its own
