"""Hard negatives and vector codes against plain readings of their contracts."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphweave.llm import hard_negatives, queries, vector_codes

SHAPE = "vec_id long, embedding array<float>, label int, id long, vec string, copies int, code string, of int"


def rows_of(seed, n, wide=8):
    rng = random.Random(seed)
    near = [[rng.gauss(0, 1) for _ in range(wide)] for _ in range(6)]
    rows = []
    for k in range(n):
        v = [float(np.float32(x + rng.gauss(0, 0.4))) for x in rng.choice(near)]
        rows.append([k, v, rng.randrange(4)])
    for k in range(0, n, 9):  # equal vectors under other ids, so that scores tie
        rows[k][1] = rows[0][1]
    odd = [[None, rows[1][1], 1], [None, rows[2][1], 2], [9001, None, 1], [9002, [1.0, None] * (wide // 2), 1], [9003, [math.nan] * wide, 2], [9004, [math.inf] * wide, 2], [9100, rows[3][1], None], [9200, rows[3][1][:4], 1], [9300, [], 1]]
    rows += odd + [rows[k % n] for k in (0, 10, 10, 10, 11, 12)]
    return [(*r, 5, "x", 7, "y", 1) for r in rows]


def sound(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute_negatives(rows, step):
    kept = []
    for k, (i, v, y, *_) in enumerate(rows):
        if y is not None and sound(v):
            y = (y + 1) % 10 if i is not None and i % 7 == 0 else y
            kept.append((k, i, [math.floor(256 * x) for x in v], y))
    out = []
    for k, i, v, y in kept:
        if i is None or i % step:
            continue
        scored = sorted((-sum(map(lambda a, b: a * b, v, w)), j is None, j or 0, n, z, j) for n, j, w, z in kept if len(w) == len(v) and n != k)
        for p in [s for s in scored if s[4] == y][:5]:
            fit = [s for s in scored if s[4] != y and 80 * -p[0] <= 100 * -s[0] <= 100 * -p[0]][:5]
            out += [(i, p[5], r, s[5], -p[0], -s[0]) for r, s in enumerate(fit, 1)]
    return sorted(out, key=lambda r: tuple((x is None, x or 0) for x in r))


def mined(df):
    cols = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=lambda r: tuple((x is None, x or 0) for x in r))


def stored_rows(spark, tmp_path, rows):
    spark.createDataFrame(rows, SHAPE).repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("small", [False, True])
def test_hard_negatives_equal_brute_force(spark, tmp_path, monkeypatch, small):
    if small:  # many blocks of anchors
        monkeypatch.setattr(hard_negatives, "ANCHOR_BYTES", 400)
    rows = rows_of(4, 700)
    got = mined(queries.op12_hard_negatives(spark, stored_rows(spark, tmp_path, rows)))
    assert got == brute_negatives(rows, 100) and len(got) > 50


def test_hard_negatives_of_large_components_and_small_blocks(spark):
    rows = [(i, [float(np.float32(x * 20_000)) for x in v] if sound(v) else v, y, *r) for i, v, y, *r in rows_of(5, 300, 6)]
    df = spark.createDataFrame(rows, SHAPE)
    got = mined(hard_negatives.mine(df.selectExpr("vec_id", "embedding", "IF(vec_id % 7 = 0, (label + 1) % 10, label) AS label"), F.col("id") % 20 == 0))
    assert got == brute_negatives(rows, 20)


def test_scores_in_order_whatever_the_size_of_scores():
    rng = np.random.default_rng(1)
    v = rng.integers(-3, 4, (50, 5))
    want = None
    for scale in (1, 10_000, 10_000_000):
        scores, order = hard_negatives.scores_in_order(v[:7] * scale, v * scale)
        assert (np.diff(scores, axis=1) <= 0).all()
        want = order if want is None else want
        assert (order == want).all() and (scores == np.take_along_axis((v[:7] @ v.T), order, axis=1) * scale**2).all()
    with pytest.raises(OverflowError):
        hard_negatives.scores_in_order(v * 10**10, v * 10**10)


def test_hard_negatives_of_nothing(spark):
    none = spark.createDataFrame([], SHAPE)
    assert hard_negatives.mine(none, F.col("id") % 100 == 0).collect() == []
    assert hard_negatives.mine(spark.createDataFrame([(1, [1.0], 2, 1, "", 1, "", 1)], SHAPE), F.col("id") % 100 == 0).collect() == []


def test_an_anchor_held_by_many_rows(spark):
    df = spark.range(5000).selectExpr("100L AS vec_id", "array(1.0f, 0.5f) AS embedding", "1 AS label").unionByName(spark.range(3).selectExpr("id + 1 AS vec_id", "array(0.9f, 0.5f) AS embedding", "2 AS label"))
    out = hard_negatives.mine(df, F.col("id") % 100 == 0)
    assert out.count() == 5000 * 5 * 3 and out.where("positive_id = 100 AND negative_id IN (1, 2, 3)").count() == 75_000


def brute_codes(rows, parts=8, n=16, rounds=6):
    kept = [(i, [math.floor(4096 * x) for x in v], y) for i, v, y, *_ in rows if sound(v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    wide = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == wide]
    each = wide // parts
    cut = [[tuple(v[p * each : (p + 1) * each]) for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:n]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda x, book: min(range(len(book)), key=lambda k: (far(x, book[k]), k))
    for _ in range(rounds):
        for p in range(parts):
            own = [near(c[p], books[p]) for c in cut]
            for k in range(len(books[p])):
                some = [c[p] for c, o in zip(cut, own) if o == k]
                if some:
                    books[p][k] = tuple(sum(x) // len(some) for x in zip(*some))
    out = []
    for (i, _, y), c in zip(kept, cut):
        code = [near(c[p], books[p]) for p in range(parts)]
        out.append((i, bytes(code).hex(), sum(far(c[p], books[p][code[p]]) for p in range(parts)), y))
    total = {}
    for *_, e, y in out:
        total[y] = total.get(y, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, total[y], digest) for i, c, e, y in out), key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))


def coded(df):
    return sorted(((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))


@pytest.mark.parametrize("n,wide", [(400, 16), (9, 8)])
def test_vector_codes_equal_brute_force(spark, tmp_path, n, wide):
    rows = rows_of(6, n, wide)
    assert coded(queries.op13_vector_codes(spark, stored_rows(spark, tmp_path, rows))) == brute_codes(rows)


def test_vector_codes_with_many_ties(spark):
    rng = random.Random(8)
    rows = [(k, [rng.randrange(3) / 4096 for _ in range(8)], k % 2 or None, 1, "", 1, "", 1) for k in range(200)]
    assert coded(vector_codes.compress(spark.createDataFrame(rows, SHAPE).repartition(7))) == brute_codes(rows)


def test_tree_finds_the_lowest_of_the_nearest():
    rng = np.random.default_rng(2)
    for width in (1, 2, 8):
        for span in (2, 5, 1000):
            book, points = rng.integers(0, span, (16, width)), rng.integers(-1, span + 1, (500, width))
            d = ((points[:, None, :] - book[None]) ** 2).sum(axis=2)
            at, best = vector_codes.KdTree(book).nearest(points)
            assert (at == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()


def test_vector_codes_of_odd_widths_and_nothing(spark):
    none = spark.createDataFrame([], SHAPE)
    assert vector_codes.compress(none).collect() == []
    rows = [(k, [0.1 * k] * 11, 1, 1, "", 1, "", 1) for k in range(40)] + [(100, [0.5] * 3, 1, 1, "", 1, "", 1)]
    got = vector_codes.compress(spark.createDataFrame(rows, SHAPE)).collect()
    assert len(got) == 40 and {len(r["code"]) for r in got} == {16}
    hot = spark.createDataFrame([(7, [1.0] * 8, 3, 1, "", 1, "", 1)] * 300, SHAPE)
    assert {(r["error"], r["label_error"]) for r in vector_codes.compress(hot).collect()} == {(0, 0)}
