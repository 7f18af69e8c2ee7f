"""Lexical retrieval packing: windows filled with a document and its BM25 neighbours.

A document's ids are cut into whole windows, which need no filling, and a rest. Rests are packed
shard by shard: a shard is a run of documents that fits in memory, with an inverted index of its
own; inverse document frequencies and the mean length are those of the whole corpus. Documents are
routed to shards by content, in whatever file they lie: all are put in the order of the leaves of a
k-means tree over projected term weights, and shards are runs of that order. A seed takes
its best unused neighbours until the window is full; the last of them is cut, and what is left of it
seeds the next window. So only the last window of a shard has padding.
"""

from __future__ import annotations

import bisect
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from graphweave.llm import ann
from graphweave.llm.common import renamed, row_hash, sampled, slices, store

WINDOW = 2048
END_ID = 1
# The tokenizer's splitting pattern over lower-cased text up to U+024F, and the
# characters there whose class or folding isn't plain; texts with those or later ones go to the library.
PIECES = re.compile("[a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u024f]+|'(?:[stmd]|re|ve|ll)|[0-9]|(?:[^\\s\\w]|_)+")
SEPARATORS = "\x1c\x1d\x1e\x1f"  # white space to Python only
ODD_BYTES = (b"\xb2", b"\xb3", b"\xb9", b"\xbc", b"\xbd", b"\xbe")
NOT_PLAIN = re.compile("[\u00b2\u00b3\u00b9\u00bc-\u00be\u0130\u0250-\U0010ffff]")

# Byte-level tokenizers write a byte as its Latin-1 character if that can be seen, else as the next one from U+0100.
_SEEN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_CHARACTERS = {b: 0x100 + k for k, b in enumerate(b for b in range(256) if b not in _SEEN)}


def is_plain(text: str) -> bool:
    """Whether PIECES splits the text as the library does."""
    if "<|" in text or any(x in text for x in SEPARATORS):
        return False
    if text.isascii():
        return True
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        return not NOT_PLAIN.search(text)
    return not any(b in raw for b in ODD_BYTES)


class _Memo(dict):
    """Words with their ids as bytes; a word that is asked for in vain is encoded piece by piece.

    The first `most` words are kept, frequent ones among them. After eight times as many vain calls
    all are forgotten, for other texts may have come. The model takes bytes beyond ASCII as characters
    of their own.
    """

    def __init__(self, tokenize: Callable, code: str, most: int, longest: int) -> None:
        super().__init__()
        self.tokenize, self.code, self.most, self.longest, self.vain = tokenize, code, most, longest, 0

    def __missing__(self, word: str) -> bytes:
        tokenize, stem = self.tokenize, word[:-1]
        if word[-1] in ".,;:" and stem.isascii() and stem.isalpha():  # two pieces, the first of which is often known
            known = stem in self
            out = self[stem] + self[word[-1]]
            if known and len(self) < self.most and len(word) <= self.longest:
                self[word] = out
            return out
        if word.isascii() and word.isalpha():  # one piece
            ids = [t.id for t in tokenize(word)]
        elif word.isascii():
            ids = [t.id for piece in PIECES.findall(word) for t in tokenize(piece)]
        else:
            ids = [t.id for piece in PIECES.findall(word) for t in tokenize(piece.encode().decode("latin-1").translate(BYTE_CHARACTERS))]
        out = array(self.code, ids).tobytes()
        if len(self) < self.most:
            if len(word) <= self.longest:
                self[word] = out
        else:
            self.vain += 1
            if self.vain > 8 * self.most:
                self.vain = 0
                self.clear()
        return out


class WordBPE:
    """The library's tokenizer with its results kept by word at white space: each new word is encoded once.

    No piece of the tokenizer's splitting pattern holds white space, so a text's ids are those of
    its words, one after another. `memo` bounds the words that are kept; those beyond `longest`
    characters never are.
    """

    def __init__(self, path: str, memo: int = 500_000, longest: int = 64) -> None:
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        self.kind = "<u2" if self.size <= 1 << 16 else "<u4"
        self.memo = _Memo(self.library.model.tokenize, "H" if self.kind == "<u2" else "I", memo, longest)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as the library gives them without special tokens."""
        ids_of, out = self.memo.__getitem__, []
        for text in texts:
            if is_plain(text):
                out.append(np.frombuffer(b"".join(map(ids_of, text.lower().split())), dtype=self.kind))
            else:
                out.append(np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=self.kind))
        return out


_loaded: dict[str, WordBPE] = {}


def tokenizer(path: str) -> WordBPE:
    if path not in _loaded:
        _loaded[path] = WordBPE(path)
    return _loaded[path]


def keyed_ids(docs: list[bytes], sizes: list[int] | np.ndarray) -> np.ndarray:
    """All 16-bit ids of documents, the document's number above them; in 32 bits as far as they reach, which sort faster."""
    kind = np.uint32 if len(docs) <= 1 << 16 else np.uint64
    return np.repeat(np.arange(len(docs), dtype=kind) << kind(16), sizes) + np.frombuffer(b"".join(docs), dtype="<u2")


def tokenized(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids binary of 16-bit ids with the end id last, n) of every row; a null text is empty.

    Each task adds one row with n = -1 and no id: the document frequencies of its rows, 32-bit by id.
    """
    df = renamed(docs, doc_id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizer(tokenizer_path)
        assert words.size <= 1 << 16
        end, seen = np.array([END_ID], dtype="<u2").tobytes(), np.zeros(words.size, dtype=np.int64)
        kind = None
        for batch in slices(batches, "text", 4 << 20):
            each = [x.tobytes() + end for x in words.encode([x or "" for x in batch.column("text").to_pylist()])]
            sizes = [len(x) // 2 for x in each]
            for x in each:
                seen[np.frombuffer(x, dtype="<u2")] += 1  # an id that comes again in the document is added once
            kind = batch.column("doc_id").type
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(each, pa.binary()), pa.array(sizes, pa.int64())], names)
        if kind is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.array([seen.astype("<u4").tobytes()], pa.binary()), pa.array([-1], pa.int64())], names)

    names = ["doc_id", "ids", "n"]
    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, ids binary, n long")


def token_statistics(tokens: DataFrame, size: int) -> tuple[np.ndarray, int, float]:
    """Document frequency of every id, documents and their mean length, over the whole corpus.

    The tasks' frequencies are added up by id; what reaches the driver is one row for each id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for x in batch.column("ids").to_pylist():
                seen += np.frombuffer(x, dtype="<u4")
        held = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(seen[held])], ["id", "n"])

    rows, total = tokens.where("n >= 0").agg(F.count("*"), F.sum("n")).first()
    frequency = np.zeros(size, dtype=np.int64)
    for k, n in tokens.where("n < 0").select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n")).collect():
        frequency[k] = n
    return frequency, rows, (total or 0) / max(1, rows)


class Index:
    """BM25 over the documents of one shard: postings sorted by id, each with its weight."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float, k1: float = 1.2, b: float = 0.75) -> None:
        kind = np.uint32 if len(docs) * len(idf) < 1 << 32 else np.uint64
        flat = np.concatenate(docs).astype(kind) if docs else np.zeros(0, dtype=kind)
        keys = np.sort(np.repeat(np.arange(len(docs), dtype=kind) * kind(len(idf)), [len(x) for x in docs]) + flat)
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
        tf, keys = np.diff(np.append(at, len(keys))), keys[at].astype(np.int64)
        self.doc, ids = keys // len(idf), keys % len(idf)
        lengths = np.array([len(x) for x in docs], dtype=np.float64)
        norm = k1 * (1 - b + b * lengths / max(mean, 1.0))
        weight = (idf[ids] * tf * (k1 + 1) / (tf + norm[self.doc])).astype(np.float32)
        self.query_from = np.searchsorted(self.doc, np.arange(len(docs) + 1))
        self.query_ids = ids
        order = np.argsort(ids, kind="stable")
        self.posting_doc, self.posting_weight = self.doc[order], weight[order]
        self.posting_from = np.searchsorted(ids[order], np.arange(len(idf) + 1))
        self.size = len(docs)
        # terms of many documents have a row of weights for all, which adds faster than postings
        frequent = np.flatnonzero(np.diff(self.posting_from) * 8 > max(1, len(docs)))
        self.row_of = np.full(len(idf), -1, dtype=np.int64)
        self.row_of[frequent] = np.arange(len(frequent))
        self.rows = np.zeros((len(frequent), len(docs)), dtype=np.float32)
        there = self.row_of[ids] >= 0
        self.rows[self.row_of[ids[there]], self.doc[there]] = weight[there]

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every document for all terms of the seed."""
        ids = self.query_ids[self.query_from[seed] : self.query_from[seed + 1]]
        rows = self.row_of[ids]
        out = self.rows[rows[rows >= 0]].sum(axis=0).astype(np.float64)
        ids = ids[rows < 0]
        spans = [slice(a, z) for a, z in zip(self.posting_from[ids].tolist(), self.posting_from[ids + 1].tolist())]
        if spans:
            out += np.bincount(np.concatenate([self.posting_doc[s] for s in spans]), np.concatenate([self.posting_weight[s] for s in spans]), self.size)
        return out


def falling(scores: np.ndarray) -> Iterator[int]:
    """Places of the positive scores by falling score, then place; sorted in growing steps, so some come again."""
    n = 0
    while n < len(scores):
        n = min(len(scores), max(16, 8 * n))
        best = np.argpartition(-scores, n - 1)[:n]
        for x in best[np.lexsort((best, -scores[best]))].tolist():
            if scores[x] <= 0:
                return
            yield x


def pack_shard(docs: list[np.ndarray], idf: np.ndarray, mean: float, window: int = WINDOW) -> Iterator[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of all ids of docs, sequences from 0."""
    sequence, rests = 0, []
    for k, ids in enumerate(docs):
        for start in range(0, len(ids) - window + 1, window):
            yield k, start, window, sequence, 0
            sequence += 1
        if len(ids) % window:
            rests.append((k, len(ids) - len(ids) % window))
    index = Index([docs[k] for k, _ in rests], idf, mean)  # a long document counts by its whole text
    free = np.ones(len(rests), dtype=bool)
    following, filled = 0, 0
    seed, cut = -1, 0  # the document that seeds the window, and how much of its rest is packed
    while True:
        if seed < 0:
            while following < len(rests) and not free[following]:
                following += 1
            if following == len(rests):
                return
            seed, cut = following, 0
            free[seed] = False
        k, start = rests[seed]
        left = len(docs[k]) - start - cut
        yield k, start + cut, left, sequence, 0  # a rest is shorter than a window
        filled, last = left, seed
        seed, cut = -1, 0
        near = falling(np.where(free, index.scores(last), -1.0)) if free.any() else iter(())
        while filled < window:
            n = next(near, -1)
            if n < 0:  # no neighbour left: the next document in order
                while following < len(rests) and not free[following]:
                    following += 1
                if following == len(rests):
                    break
                n = following
            elif not free[n]:
                continue
            free[n] = False
            k, start = rests[n]
            whole = len(docs[k]) - start
            taken = min(whole, window - filled)
            yield k, start, taken, sequence, filled
            filled += taken
            if taken < whole:
                seed, cut = n, taken
        sequence += 1


def pack_batches(batches: Iterator[pa.RecordBatch], idf: np.ndarray, mean: float, window: int = WINDOW, shard_tokens: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Batches of (doc_id, ids, n) to batches of pieces with their ids as little-endian 32-bit integers."""
    context = TaskContext.get()
    numbers = (context.partitionId() if context else 0) << 36
    held, names, size = [], [], 0
    kind = None

    def done() -> Iterator[pa.RecordBatch]:
        nonlocal numbers
        pieces = list(pack_shard(held, idf, mean, window))
        for at in range(0, len(pieces), 2000):
            some = pieces[at : at + 2000]
            columns = [
                pa.array([names[p[0]] for p in some], kind), pa.array([p[1] for p in some], pa.int64()), pa.array([p[2] for p in some], pa.int64()),
                pa.array([held[p[0]][p[1] : p[1] + p[2]].astype("<u4").tobytes() for p in some], pa.binary()), pa.array([len(held[p[0]]) for p in some], pa.int64()),
                pa.array([numbers + p[3] for p in some], pa.int64()), pa.array([p[4] for p in some], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
        numbers += max((p[3] for p in pieces), default=-1) + 1

    for batch in slices(batches, "ids"):
        kind = batch.schema.field("doc_id").type
        for name, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
            held.append(np.frombuffer(ids, dtype="<u2"))
            names.append(name)
            size += len(held[-1])
            if size >= shard_tokens:
                yield from done()
                held, names, size = [], [], 0
    if held:
        yield from done()


class Router:
    """The place of a document in an order by content: the leaf of its vector, then the signs of the vector's components.

    A vector is the document's term weights (as in the index) in a random projection.
    """

    def __init__(self, idf: np.ndarray, mean: float, wide: int = 64) -> None:
        self.idf, self.mean = idf.astype(np.float32), mean
        self.projection = np.random.default_rng(42).standard_normal((len(idf), wide), dtype=np.float32)

    def vectors(self, docs: list[bytes], k1: float = 1.2, b: float = 0.75) -> np.ndarray:
        """One vector for each document, given by its 16-bit ids."""
        lengths = np.array([len(x) // 2 for x in docs], dtype=np.int64)
        key = np.sort(keyed_ids(docs, lengths)).astype(np.int64)
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
        tf, owner, terms = np.diff(np.append(at, len(key))), key[at] >> 16, key[at] & 0xFFFF
        norm = (k1 * (1 - b + b * lengths / max(self.mean, 1.0)))[owner]
        weight = self.idf[terms] * (tf * (k1 + 1) / (tf + norm)).astype(np.float32)
        cuts = np.searchsorted(owner, np.arange(len(docs) + 1)).tolist()
        out = np.array([weight[x:y] @ self.projection[terms[x:y]] for x, y in zip(cuts, cuts[1:])], dtype=np.float32).reshape(len(docs), -1)
        return out / np.maximum(np.sqrt((out * out).sum(axis=1)), 1e-9)[:, None]

    def keys(self, tree: ann.Tree, vectors: np.ndarray) -> list[tuple[int, int]]:
        signs = np.packbits(vectors[:, :63] > 0, axis=1, bitorder="big")
        fine = np.concatenate([signs, np.zeros((len(vectors), 8 - signs.shape[1]), dtype=np.uint8)], axis=1).view(">u8").ravel() >> np.uint64(1)
        return list(zip(tree.assign(vectors).tolist(), fine.tolist()))


def routed(tokens: DataFrame, idf: np.ndarray, rows: int, total: int, shard_tokens: int, sample_size: int = 4096) -> DataFrame:
    """tokens in partitions of about four shards, sorted so that documents of like content are next to each other.

    Tree and bounds are fitted on about `sample_size` documents; every document is routed. Bounds
    include a hash of the id and of the row's place, so that a large group of copies, under whatever ids,
    is split between partitions.
    """
    spark = tokens.sparkSession
    router, parts = Router(idf, total / max(1, rows)), min(sample_size, -(-total // (4 * shard_tokens)))
    tokens = tokens.withColumn("tie", row_hash("doc_id"))
    some = sampled(tokens, F.col("tie"), rows, sample_size)
    vectors = router.vectors([bytes(r["ids"]) for r in some])
    tree = ann.Tree(vectors, leaves=int(min(512, max(8, total // (shard_tokens // 2)))))
    order = sorted((*key, r["gw_hash"]) for key, r in zip(router.keys(tree, vectors), some))
    bounds = [order[len(order) * k // parts] for k in range(1, parts)]
    shared = spark.sparkContext.broadcast((idf, total / max(1, rows), tree, bounds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, mean, tree, bounds = shared.value
        router = Router(idf, mean)
        for batch in slices(batches, "ids", 2 << 20):
            if batch.num_rows:
                keys = router.keys(tree, router.vectors(batch.column("ids").to_pylist()))
                ties = batch.column("tie").to_pylist()
                part = [bisect.bisect_right(bounds, (*k, t)) for k, t in zip(keys, ties)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part, pa.int32()), pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int64())], [*batch.schema.names, "part", "leaf", "fine"])

    kind = tokens.schema["doc_id"].dataType.simpleString()
    placed = tokens.mapInArrow(run, f"doc_id {kind}, ids binary, n long, tie long, part int, leaf int, fine long")
    return placed.repartitionById(parts, "part").sortWithinPartitions("part", "leaf", "fine", "tie").select("doc_id", "ids", "n")


def idf_of(frequency: np.ndarray, rows: int) -> np.ndarray:
    return np.log1p((rows - frequency + 0.5) / (frequency + 0.5))


def pack(docs: DataFrame, tokenizer_path: str, digest: bool = False, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, shard_tokens: int = 2_000_000) -> DataFrame:
    """Pieces of every document: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    Every id of every document, with the end id after its text, lies in one piece. digest: the
    CRC-32 of a piece's ids (ids_crc32) in place of the ids. A null text counts as empty, so its
    document is the end id alone; repeated rows are packed each; an empty table gives no piece.
    Other columns of docs are ignored. sequence_id is unique over all shards, not gapless.
    """
    size = tokenizer(tokenizer_path).size
    tokens = store(tokenized(docs, tokenizer_path, id_col, text_col), "tokens")
    frequency, rows, mean = token_statistics(tokens, size)
    tokens = tokens.where("n >= 0")
    idf = docs.sparkSession.sparkContext.broadcast(idf_of(frequency, rows))  # one number for each id of the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pack_batches(batches, idf.value, mean, window, shard_tokens):
            if digest:
                sums = pa.array([zlib.crc32(x) for x in batch.column("ids").to_pylist()], pa.int64())
                batch = batch.set_column(3, "ids_crc32", sums)
            yield batch

    if rows:
        tokens = routed(tokens, idf.value, rows, round(mean * rows), shard_tokens)
    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.mapInArrow(run, f"doc_id {kind}, start long, length long, {'ids_crc32 long' if digest else 'ids binary'}, doc_tokens long, sequence_id long, offset long")
