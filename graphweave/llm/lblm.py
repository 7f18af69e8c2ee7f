"""A log-bilinear language model trained with noise-contrastive estimation, and exact scores of whole texts.

The model predicts a token from the vectors of the two tokens before: first its class, then the token
within the class, each normalised, so a token costs about twice the square root of the vocabulary.
Tokens are the most frequent words, each with vectors of its own, and buckets that all other words
are hashed to, with a vector for each bucket; within a bucket a word has its share by corpus counts.
So what the model tells apart is bounded by a documented size, and no word is left out.

Counts are exact for every word. The most frequent ones (a bounded table) go to every task; the rest
are joined by word, which no longer has any hot key.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweave.llm.common import slices, store

END = b""  # words are never empty
SEED = 42
FIXED = 1 << 12  # parameters are summed over tasks as whole numbers, so that the order of the sum doesn't matter
DIMENSIONS = 16


def words_of(text: str | None) -> list[bytes]:
    """Words at ASCII white space, A-Z lower-cased, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text leaves 1 by 5. A null id trains."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def word_counts(texts: DataFrame, most: int = 600_000) -> DataFrame:
    """(word binary, c) over all rows of texts(text), with one end for each row; summed within tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def rows() -> Iterator[pa.RecordBatch]:
            words, counts = list(seen), np.fromiter(seen.values(), dtype=np.int64, count=len(seen))
            for at in range(0, len(words), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(words[at : at + 100_000], pa.binary()), pa.array(counts[at : at + 100_000])], ["word", "c"])

        for batch in slices(batches, "text", trim=False):
            for text in batch.column("text").to_pylist():
                seen.update(words_of(text))
            seen[END] += batch.num_rows
            if len(seen) >= most:
                yield from rows()
                seen.clear()
        yield from rows()

    return texts.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def head_limit(counts: DataFrame, most: int) -> int:
    """The least count that no more than `most` words reach, on a scale of sixteen steps to each doubling.

    Only the scale's steps come to the driver, some hundred rows, and no task sorts.
    """
    step = F.floor(F.log2(F.col("c").cast("double")) * 16).cast("int")
    held, limit = 0, None
    for s, n, least in sorted(counts.groupBy(step.alias("s")).agg(F.count("*"), F.min("c")).collect(), reverse=True):
        held += n
        if held > most:
            break
        limit = least
    return limit if limit is not None else 1 << 62


class LogBilinear:
    """Vectors of tokens as contexts R and as targets Q (the last column is a bias), of classes A, and the weights C of both places.

    Tokens are numbered class by class; `item` has a token's number by its rank. Classes have about
    equal sums of the square roots of frequencies, so frequent tokens are in small ones.
    """

    def __init__(self, mass: np.ndarray, classes: int = 192, wide: int = DIMENSIONS) -> None:
        rng = np.random.default_rng(SEED)
        order = np.argsort(-mass, kind="stable")
        roots = np.cumsum(np.sqrt(mass[order]))
        kinds = np.minimum((roots - 1e-9) / roots[-1] * classes, classes - 1).astype(np.int64)
        kinds = np.unique(kinds, return_inverse=True)[1]
        self.item = np.empty(len(mass), dtype=np.int64)
        self.item[order] = np.arange(len(mass))
        self.kind = kinds  # of each token, by number
        self.first = np.searchsorted(kinds, np.arange(kinds[-1] + 2))
        self.size = np.diff(self.first)
        share = mass[order] / mass.sum()
        self.until = np.cumsum(share)
        self.class_share = np.add.reduceat(share, self.first[:-1])
        self.inside = share / self.class_share[kinds]
        draw = lambda n: rng.normal(0, 0.1, (n, wide))
        self.p = {
            "R": draw(len(mass)), "Q": np.column_stack([draw(len(mass)), np.log(self.inside)]), "A": np.column_stack([draw(len(self.size)), np.log(self.class_share)]),
            "C": np.ones((2, wide)) * [[1.0], [0.5]],
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.grown = {k: np.full_like(v, 0.1) for k, v in self.p.items()}

    def step(self, name: str, rows: np.ndarray, sums: np.ndarray, rate: float) -> None:
        """One adaptive gradient step of distinct rows of a table."""
        grown = self.grown[name][rows]
        grown += sums * sums
        self.grown[name][rows] = grown
        self.p[name][rows] += rate * sums / np.sqrt(grown)

    def train(self, tokens: np.ndarray, starts: np.ndarray, rng: np.random.Generator, noises: int = 24, inner: int = 1, rate: float = 0.2, batch: int = 2048) -> None:
        """One pass of noise-contrastive estimation: classes against shared draws, tokens against draws from their class, both by frequency.

        tokens: those of texts, one text after another, beginning at `starts`. Tokens are taken in
        order, so those of a batch are gathered and sorted once, as contexts, targets and classes.
        """
        R, Q, A, C = (self.p[k] for k in "RQAC")
        end = int(self.item[0])
        log_noise, log_inner = np.log(self.class_share * noises).astype(np.float32), np.log(self.inside * inner).astype(np.float32)
        low = np.concatenate([[0.0], self.until])[self.first[:-1]]
        rising = lambda x: 1 / (1 + np.exp(np.clip(x, -30, 30)))
        flat = np.concatenate([[end, end], tokens])
        opening = np.zeros(len(tokens), dtype=bool)
        opening[starts] = True
        for at in range(0, len(tokens), batch):
            near, first = flat[at : at + batch + 2], np.flatnonzero(opening[at : at + batch])
            w = near[2:]
            c, n = self.kind[w], rng.choice(len(self.size), noises, p=self.class_share)
            there = R[near]
            rv, ru = there[1:-1], there[:-2].copy()
            ru[first] = R[end]
            full = np.empty((len(w), R.shape[1] + 1), dtype=np.float32)
            full[:, -1] = 1
            np.add(C[0] * rv, C[1] * ru, out=full[:, :-1])
            own, noise = A[c], A[n]
            up = rising(np.einsum("nd,nd->n", full, own) - log_noise[c])  # towards data
            down = -rising(log_noise[n] - full @ noise.T)  # away from noise
            back = up[:, None] * own[:, :-1] + down @ noise[:, :-1]
            target, drawn = Q[w], (low[c][:, None] + rng.random((len(w), inner)) * self.class_share[c][:, None]).ravel()
            drawn = np.clip(np.searchsorted(self.until, drawn, side="right"), np.repeat(self.first[c], inner), np.repeat(self.first[c + 1], inner) - 1)
            several = self.size[c] > 1  # a class of one token tells nothing more
            other = Q[drawn].reshape(len(w), inner, -1)
            up_in = rising(np.einsum("nd,nd->n", full, target) - log_inner[w]) * several
            down_in = -rising(log_inner[drawn].reshape(len(w), inner) - np.einsum("nd,nmd->nm", full, other)) * several[:, None]
            back += up_in[:, None] * target[:, :-1] + np.einsum("nm,nmd->nd", down_in, other[:, :, :-1])
            # sums over equal tokens; tokens are numbered class by class, so classes are runs of them
            context = np.zeros((len(near), R.shape[1]), dtype=np.float32)
            context[1:-1] = back * C[0]
            further = back * C[1]
            for_end = further[first].sum(axis=0)
            further[first] = 0
            context[:-2] += further
            order = np.argsort(near)
            ranks = near[order]
            cuts = np.flatnonzero(np.concatenate([[True], ranks[1:] != ranks[:-1]]))
            rows, sums = ranks[cuts], np.add.reduceat(context[order], cuts, axis=0)
            if len(first):
                if end in rows:
                    sums[np.searchsorted(rows, end)] += for_end
                else:
                    rows, sums = np.append(rows, end), np.concatenate([sums, for_end[None, :]])
            self.step("C", np.array([0, 1]), np.stack([np.einsum("nd,nd->d", back, rv), np.einsum("nd,nd->d", back, ru)]), rate)
            self.step("R", rows, sums, rate)
            order = order[order >= 2] - 2
            ranks = w[order]
            cuts = np.flatnonzero(np.concatenate([[True], ranks[1:] != ranks[:-1]]))
            self.step("Q", ranks[cuts], np.add.reduceat((up_in[:, None] * full)[order], cuts, axis=0), rate)
            kinds = c[order]
            cuts = np.flatnonzero(np.concatenate([[True], kinds[1:] != kinds[:-1]]))
            classes = np.zeros(A.shape, dtype=np.float32)
            classes[kinds[cuts]] = np.add.reduceat((up[:, None] * full)[order], cuts, axis=0)
            np.add.at(classes, n, down.T @ full)
            self.step("A", slice(None), classes, rate)
            order = np.argsort(drawn)
            ranks = drawn[order]
            cuts = np.flatnonzero(np.concatenate([[True], ranks[1:] != ranks[:-1]]))
            away = (down_in[:, :, None] * full[:, None, :]).reshape(-1, full.shape[1])
            self.step("Q", ranks[cuts], np.add.reduceat(away[order], cuts, axis=0), rate)

    def log_probabilities(self, before: np.ndarray, last: np.ndarray, target: np.ndarray, cells: int = 200_000) -> np.ndarray:
        """Normalised log10 probabilities of targets, by matrix products over batches of one class that stay in the cache."""
        R, Q, A, C = (self.p[k] for k in "RQAC")
        out = np.empty(len(target))

        def of(full: np.ndarray, table: np.ndarray, place: np.ndarray) -> np.ndarray:
            scores = full @ table.T
            own, top = scores[np.arange(len(full)), place], scores.max()
            if top > 30 or scores.min() < -80:  # beyond what sums of exponentials stand
                high = scores.max(axis=1)
                scores -= high[:, None]
                return own - high - np.log(np.exp(scores, out=scores).sum(axis=1))
            return own - np.log(np.exp(scores, out=scores).sum(axis=1))

        step = max(1, cells // len(self.size))
        for at in range(0, len(target), 64 * step):
            where = slice(at, at + 64 * step)
            w = target[where]
            full = np.ones((len(w), R.shape[1] + 1), dtype=np.float32)
            np.add(C[0] * R[last[where]], C[1] * R[before[where]], out=full[:, :-1])
            c, some = self.kind[w], np.empty(len(w), dtype=np.float32)
            for a in range(0, len(w), step):
                some[a : a + step] = of(full[a : a + step], A, c[a : a + step])
            order = np.argsort(c.astype(np.int16), kind="stable")
            cuts = np.searchsorted(c[order], np.arange(len(self.size) + 1)).tolist()
            sorted_full, sorted_place = full[order], w[order] - self.first[c[order]]
            within = np.zeros(len(w), dtype=np.float32)
            for k in np.flatnonzero(self.size > 1).tolist():
                table = Q[self.first[k] : self.first[k + 1]]
                wide = max(1, cells // len(table))
                for a in range(cuts[k], cuts[k + 1], wide):
                    rows = slice(a, min(a + wide, cuts[k + 1]))
                    within[rows] = of(sorted_full[rows], table, sorted_place[rows])
            some[order] += within
            out[where] = some
        return out / np.log(10)


def contexts(tokens: np.ndarray, ends: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The tokens one and two places before each; before a text stands the end of one.

    tokens: those of texts, one text after another; ends: the place after each text's last token.
    """
    last = np.concatenate([[end], tokens[:-1]])
    before = np.concatenate([[end, end], tokens[:-2]])[: len(tokens)]
    starts = np.concatenate([[0], ends[:-1]])
    before[starts] = end
    second = starts + 1
    before[second[second < ends]] = end
    last[starts] = end
    return before, last


def flat_ranks(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of the tokens of coded texts, one text after another, and the place after each text."""
    each = column.to_pylist()
    return np.frombuffer(b"".join(each), dtype="<i4"), np.cumsum([len(x) // 4 for x in each])


def trained(training: DataFrame, mass: np.ndarray, classes: int, parts: int) -> LogBilinear:
    """The model after one pass over training(ranks) in `parts` tasks, averaged.

    Each task starts alike; a token's vectors are averaged over the tasks that saw it, by how often
    they did. What a task gives is a row for each token it saw, summed by the JVM; what comes to the
    driver is the model.
    """
    wide = DIMENSIONS + 1

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, rng = LogBilinear(mass, classes), np.random.default_rng(SEED)
        seen = {k: np.zeros(len(v), dtype=np.int64) for k, v in model.p.items()}
        for batch in slices(batches, "ranks", 4 << 20, trim=False):
            if batch.num_rows:
                ranks, ends = flat_ranks(batch.column("ranks"))
                own = model.item[ranks]
                before, last = contexts(own, ends, int(model.item[0]))
                model.train(own, np.concatenate([[0], ends[:-1]]), rng)
                for name, rows in (("R", last), ("R", before), ("Q", own), ("A", model.kind[own])):
                    seen[name] += np.bincount(rows, minlength=len(seen[name]))
                seen["C"] += len(own)
        for number, name in enumerate("RQAC"):
            rows = np.flatnonzero(seen[name])
            for at in range(0, len(rows), 20_000):
                some = rows[at : at + 20_000]
                values = np.zeros((len(some), wide), dtype=np.int64)
                values[:, : model.p[name].shape[1]] = np.round(model.p[name][some].astype(np.float64) * FIXED)
                values *= seen[name][some][:, None]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), number)), pa.array(some), pa.array(seen[name][some]), *(pa.array(values[:, k]) for k in range(wide))], names)

    names = ["part", "row", "n", *(f"v{k}" for k in range(wide))]
    sums = training.coalesce(parts).mapInArrow(learn, ", ".join(f"{c} long" for c in names)).groupBy("part", "row").agg(*(F.sum(c).alias(c) for c in names[2:])).toArrow()
    model = LogBilinear(mass, classes)
    part, row, n, *values = (sums.column(c).to_numpy() for c in names)
    for number, name in enumerate("RQAC"):
        here = part == number
        width = model.p[name].shape[1]
        if here.any():
            model.p[name][row[here]] = np.stack([values[k][here] / (n[here] * float(FIXED)) for k in range(width)], axis=1)
    return model


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", head: int = 65536, buckets: int = 16384, classes: int = 192, task_tokens: int = 40_000_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Both scores are log10 probabilities of the whole text and its end: base_score under the smoothed
    counts of single words, score under the model. Training reads every document that isn't held out,
    in tasks of about `task_tokens` tokens or as many as there are cores. `head` words have vectors of
    their own, the others share `buckets`. A null text counts as empty and has the end alone; repeated
    rows count and are scored each; a table without training documents gives the scores of an untrained
    model; an empty table gives an empty table. Other columns of docs are ignored.
    """
    spark = docs.sparkSession
    df = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    training = df.where(~held_out(F.col("doc_id"))).select("text")
    counts = store(word_counts(training), "counts")
    tokens, types = (x or 0 for x in counts.agg(F.sum("c"), F.count("*")).first())
    limit = head_limit(counts, head)
    top = sorted(counts.where(F.col("c") >= limit).collect(), key=lambda r: (-r[1], bytes(r[0])))
    listed = [END, *(bytes(r[0]) for r in top if bytes(r[0]) != END)]
    by_word = {bytes(r[0]): r[1] for r in top}
    known = np.array([by_word.get(w, 0) for w in listed], dtype=np.int64)
    held, kinds = np.zeros(buckets, dtype=np.int64), np.zeros(buckets, dtype=np.int64)
    beyond = counts.where((F.col("c") < limit) & (F.length("word") > 0)).groupBy(F.pmod(F.xxhash64("word"), F.lit(buckets)).alias("b")).agg(F.sum("c"), F.count("*"))
    for b, c, n in beyond.collect():  # one row for each bucket
        held[b], kinds[b] = c, n
    mass = np.concatenate([known, held]) + 0.5 * np.concatenate([np.ones(len(known)), kinds + 1])
    inside_bucket = np.log10(held + 0.5 * (kinds + 1))
    shared = spark.sparkContext.broadcast({w: k for k, w in enumerate(listed)})
    first = len(listed)  # ranks from here on are buckets

    logs = np.concatenate([np.log10(known + 0.5), np.zeros(buckets)])
    familiar = np.concatenate([known > 0, np.zeros(buckets, dtype=bool)])
    shares = np.concatenate([np.zeros(first), inside_bucket])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, digest = shared.value, xxhash.xxh64_intdigest
        for batch in slices(batches, "text", 4 << 20, trim=False):
            if not batch.num_rows:
                continue
            words = [words_of(x) for x in batch.column("text").to_pylist()]
            ends = np.cumsum([len(w) + 1 for w in words])
            ranks = np.fromiter(map(rank.get, chain.from_iterable((*w, END) for w in words), repeat(-1)), dtype=np.int32, count=ends[-1])
            tails = []
            for w, end in zip(words, ends.tolist()):
                start = end - 1 - len(w)
                beyond = np.flatnonzero(ranks[start:end] < 0).tolist()
                tails.append([w[k] for k in beyond])
                for k in beyond:
                    ranks[start + k] = first + digest(w[k], SEED) % buckets
            starts = np.concatenate([[0], ends[:-1]])
            total = lambda x: np.add.reduceat(x, starts)
            raw = ranks.astype("<i4").tobytes()
            coded = [raw[4 * a : 4 * z] for a, z in zip(starts.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"), batch.column("doc_id"), batch.column("held_out"), pa.array(ends - starts), pa.array(total(familiar[ranks].astype(np.int64))),
                    pa.array(total(logs[ranks])), pa.array(total(shares[ranks])), pa.array(coded, pa.binary()), pa.array(tails, pa.list_(pa.binary())),
                ],
                ["row", "doc_id", "held_out", "n_tokens", "known", "logs", "shares", "ranks", "tail"],
            )

    kind = df.schema["doc_id"].dataType.simpleString()
    asked = df.select(F.monotonically_increasing_id().alias("row"), "doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    coded = store(asked.mapInArrow(code, f"row long, doc_id {kind}, held_out boolean, n_tokens long, known long, logs double, shares double, ranks binary, tail array<binary>"), "coded")
    parts = max(spark.sparkContext.defaultParallelism, tokens // task_tokens)
    model = spark.sparkContext.broadcast(trained(coded.where("not held_out").select("ranks"), mass, classes, parts))  # bounded by head, buckets and classes

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in slices(batches, "ranks", 4 << 20, trim=False):
            if batch.num_rows:
                ranks, ends = flat_ranks(batch.column("ranks"))
                own = m.item[ranks]
                before, last = contexts(own, ends, int(m.item[0]))
                scores = np.add.reduceat(m.log_probabilities(before, last, own), np.concatenate([[0], ends[:-1]]))
                yield pa.RecordBatch.from_arrays([*(x for x, name in zip(batch.columns, batch.schema.names) if name != "ranks"), pa.array(scores)], names)

    names = ["row", "doc_id", "held_out", "n_tokens", "known", "logs", "shares", "model"]
    scored = coded.drop("tail").mapInArrow(apply, f"row long, doc_id {kind}, held_out boolean, n_tokens long, known long, logs double, shares double, model double")
    each = coded.where(F.size("tail") > 0).select("row", F.explode("tail").alias("word")).join(counts, "word", "left")
    tails = each.groupBy("row").agg(F.count("c").alias("t_known"), F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("t_logs"))
    out = scored.join(tails, "row", "left")
    extra, zero = F.coalesce("t_logs", F.lit(0.0)), F.lit(0).cast("long")
    divisor = F.lit(float(np.log10(tokens + 0.5 * (types + 1))))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("t_known", zero)).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + extra - F.col("n_tokens") * divisor).alias("base_score"), (F.col("model") - F.col("shares") + extra).alias("score"),
    )
