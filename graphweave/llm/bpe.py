"""Byte-level BPE by a backtracking encoder, and decoding by an offset table.

A piece of text is encoded left to right. At every place the longest token comes from the
Aho-Corasick matches of the piece; a token may follow another only if the two are compatible, that
is, if merging them by rank would leave the boundary between them alone. When no token fits, the
encoder takes one step back and tries the next shorter token there. A place that failed once is
never entered again, so the work is linear in the piece, and the result is that of the merges.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from graphweave.llm.common import renamed, slices

# The splitting pattern of byte-level BPE, and its 256 printable stand-ins for bytes.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# The same pattern in the classes of Python's own engine, which is three times as fast, and the
# characters for which those classes differ or may differ by Unicode version.
PLAIN_PIECES = r"""'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"""
NOT_PLAIN = "[\x1c-\x1f\x85\u00b2\u00b3\u00b9\u00bc-\u00be\u0250-\U0010ffff]"
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself where printable, else the next one from U+0100 on."""
    rest = iter(range(256, 512))
    return [chr(b) if b in _PRINTABLE else chr(next(rest)) for b in range(256)]


class ByteBPE:
    """A tokenizer file read into a match automaton, a split table and a decoding offset table."""

    def __init__(self, path: str, memo: int = 800_000) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        stand = byte_characters()
        byte_of = {c: b for b, c in enumerate(stand)}
        self.size = max([*vocab.values(), *added.values()]) + 1
        texts: list[bytes] = [b""] * self.size
        for word, k in vocab.items():
            if word not in added:
                texts[k] = bytes(byte_of[c] for c in word)
        for word, k in added.items():
            texts[k] = word.encode()
        self.lengths = np.array([len(x) for x in texts], dtype=np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])
        self.flat = np.frombuffer(b"".join(texts), dtype=np.uint8)
        self.width = [len(x) for x in texts]
        # rank of the merge that makes a pair, and the pair that makes a token
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[tuple[int, int], int] = {}
        self.split: dict[int, tuple[int, int, int]] = {}
        for r, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            key, whole = (vocab[left], vocab[right]), vocab[left + right]
            if key not in self.rank:
                self.rank[key], self.made[key] = r, whole
                self.split.setdefault(whole, (*key, r))
        self.bytes_to_id = [vocab[c] for c in stand]
        auto = ahocorasick.Automaton()
        tokens = {w: k for w, k in vocab.items() if w not in added and (len(w) == 1 or k in self.split)}
        for word, k in tokens.items():
            auto.add_word(word, k)
        auto.make_automaton()
        self.auto = auto
        # the longest proper prefix of a token that is a token itself
        self.shorter = {k: next((tokens[w[:n]] for n in range(len(w) - 1, 0, -1) if w[:n] in tokens), -1) for w, k in tokens.items()}
        self.stand, self.tokens = dict(enumerate(stand)), tokens
        self.packed = [int(k).to_bytes(4, "little") for k in range(self.size)]
        self.added = added
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.pieces, self.plain_pieces = regex.compile(PIECES), re.compile(PLAIN_PIECES)
        self.not_plain = re.compile(NOT_PLAIN)
        self.fits: dict[tuple[int, int], bool] = {}
        self.memo: dict[str, bytes] = {}
        self.most = memo

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges of left + right leave the boundary between the two as it is.

        Looks at the pairs of parts that meet at the boundary, from the last merges inside the two
        tokens backwards: a pair that would merge sooner than either part was finished breaks it.
        """
        known = self.fits.get((left, right))
        if known is None:
            known = self._compatible(left, right)
            if len(self.fits) > 1_000_000:
                self.fits.clear()
            self.fits[left, right] = known
        return known

    def _compatible(self, left: int, right: int) -> bool:
        never = len(self.rank)
        made = lambda k: self.split[k][2] if k in self.split else -1
        # (rank, side) of the merge that used up the part now at the boundary; none for whole tokens
        used = (never, 0)
        while True:
            meets = self.rank.get((left, right), never)
            # of two equal pairs the left one merges first; the pair at the boundary is to the right
            # of the left token's own parts and to the left of the right token's
            if meets < used[0] or meets == used[0] < never and used[1] == 1:
                return False
            last_left, last_right = made(left), made(right)
            if last_left < 0 and last_right < 0:
                return True
            if last_left > last_right:
                used, left = (last_left, 0), self.split[left][1]
            elif last_left < last_right:
                used, right = (last_right, 1), self.split[right][0]
            else:  # the same merge on both sides: the right one is done later
                used, right = (last_right, 1), self.split[right][0]

    def encode_piece(self, piece: str) -> list[int]:
        """Token ids of one piece of the splitting pattern."""
        if piece.isascii() and piece[1:].isalpha():
            text = piece.replace(" ", self.stand[32])
        else:
            text = piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.stand)
        whole = self.tokens.get(text)
        if whole is not None:
            return [whole]
        width, fits, size = self.width, self.fits, len(text)
        # the chain of longest matches, if every token of it may follow the one before
        chain, last = [], -1
        for _, token in self.auto.iter_long(text):
            good = last < 0 or fits.get((last, token))
            if good is None:
                good = self.compatible(last, token)
            if not good:
                break
            chain.append(token)
            last = token
        else:
            return chain
        longest = [-1] * size
        for end, token in self.auto.iter(text):  # by rising length at every end, so the last to start at a place is its longest
            longest[end + 1 - width[token]] = token
        out: list[int] = []
        dead = bytearray(size + 1)
        at, token, last = 0, longest[0], -1
        while True:
            end = at + width[token]
            if not dead[end]:
                good = last < 0 or fits.get((last, token))
                if good is None:
                    good = self.compatible(last, token)
                if good:
                    out.append(token)
                    if end == size:
                        return out
                    at, last, token = end, token, longest[end]
                    continue
            token = self.shorter[token]
            while token < 0:  # nothing fits here: this place is dead, go back one token
                dead[at] = 1
                token = self.shorter[out[-1]]
                at -= width[out.pop()]
                last = out[-1] if out else -1

    def encode(self, text: str) -> np.ndarray:
        """Token ids of a whole text, as 32-bit integers."""
        if self.special is not None and any(x in text for x in self.added):
            parts = [np.array([self.added[x]], dtype="<u4") if x in self.added else self._encode_plain(x) for x in self.special.split(text) if x]
            return np.concatenate(parts)
        return self._encode_plain(text)

    def _encode_plain(self, text: str) -> np.ndarray:
        memo, found = self.memo, (self.pieces if self.not_plain.search(text) else self.plain_pieces).findall(text)
        try:
            raw = b"".join([memo[x] for x in found])
        except KeyError:
            if len(memo) >= self.most:
                memo.clear()
            packed = self.packed
            for x in {*found}.difference(memo):
                memo[x] = b"".join([packed[k] for k in self.encode_piece(x)])
            raw = b"".join([memo[x] for x in found])
        return np.frombuffer(raw, dtype="<u4")

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """Bytes of the tokens, gathered from the flat table by the tokens' offsets."""
        ids = ids.astype(np.int64)
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        place = np.arange(total, dtype=np.int64) + np.repeat(self.offsets[ids] - (ends - sizes), sizes)
        return self.flat[place].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


_loaded: dict[str, ByteBPE] = {}


def tokenizer(path: str) -> ByteBPE:
    """The tokenizer of a file, read once for each worker process."""
    if path not in _loaded:
        _loaded[path] = ByteBPE(path)
    return _loaded[path]


def encode_batches(batches: Iterator[pa.RecordBatch], tokenizer_path: str) -> Iterator[pa.RecordBatch]:
    """Batches of (doc_id, text) to batches of (doc_id, ids, n_tokens)."""
    bpe = tokenizer(tokenizer_path)
    for batch in slices(batches, "text"):
        ids = [bpe.encode(x or "") for x in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([len(x) for x in ids], pa.int64())], ["doc_id", "ids", "n_tokens"])


def decode_batches(batches: Iterator[pa.RecordBatch], tokenizer_path: str) -> Iterator[pa.RecordBatch]:
    """Adds decoded_text to batches that have ids."""
    bpe = tokenizer(tokenizer_path)
    for batch in slices(batches, "ids", 32 << 20):
        text = [bpe.decode(np.frombuffer(x or b"", dtype="<u4")) for x in batch.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string())], [*batch.schema.names, "decoded_text"])


def encode_texts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of every whole text: (doc_id, ids binary of little-endian 32-bit integers, n_tokens).

    A null text counts as empty and gives no ids; rows are neither dropped nor merged; a null or
    repeated id stays as it is; columns besides the two named are ignored, whatever they are called.
    An empty table gives an empty table. One narrow pass: no shuffle, memory of a few texts.
    """
    df = renamed(docs, doc_id=id_col, text=text_col)
    return df.mapInArrow(lambda batches: encode_batches(batches, tokenizer_path), f"doc_id {df.schema['doc_id'].dataType.simpleString()}, ids binary, n_tokens long")


def decode_ids(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """Adds decoded_text to what encode_texts returns; bytes that aren't UTF-8 become U+FFFD."""
    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids", "n_tokens").mapInArrow(lambda batches: decode_batches(batches, tokenizer_path), f"doc_id {kind}, ids binary, n_tokens long, decoded_text string")


def round_trip_digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """encode_batches, decode_batches and SHA-256 of both results, chained in one Python pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in decode_batches(encode_batches(batches, tokenizer_path), tokenizer_path):
            sha = lambda values: pa.array([hashlib.sha256(x).hexdigest() for x in values], pa.string())
            ids, text = batch.column("ids").to_pylist(), batch.column("decoded_text").cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_tokens"), sha(ids), sha(text)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    df = renamed(docs, doc_id="doc_id", text="text")
    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
