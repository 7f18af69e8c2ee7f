"""SentencePiece encoding that keeps offsets, and decoding by an offset table.

A text is normalised by the longest prefixes that the model's compiled character map knows; every
byte of the result remembers the byte of the text that it came from. Pieces are merged by score, and
their ends, counted in normalised bytes, are looked up in that alignment, which gives the bytes of
the original text behind every piece. Characters without a piece become one piece for each byte; the
last of these holds the character's span, the others an empty one in front of it.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
import struct
from collections.abc import Iterator
from operator import add
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from graphweave.llm.common import renamed, slices

# The space mark, kinds of pieces, and numbers of the fields in a model file.
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
BPE = 2
#: Below every score.
NEVER = float("-inf")


def _one_byte(e: UnicodeError) -> tuple[str, int]:
    return "�", e.start + 1  # every byte that is part of no character counts by itself


codecs.register_error("graphweave_one_byte", _one_byte)


def fields(data: bytes) -> Iterator[tuple[int, Any]]:
    """(number, value) of the fields of a protocol buffer message: integers, 32-bit floats, bytes."""

    def number(at: int) -> tuple[int, int]:
        out = shift = 0
        while True:
            b = data[at]
            out |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return out, at

    at = 0
    while at < len(data):
        key, at = number(at)
        kind = key & 7
        if kind == 0:
            value, at = number(at)
        elif kind == 5:
            value, at = struct.unpack_from("<f", data, at)[0], at + 4
        elif kind == 1:
            value, at = data[at : at + 8], at + 8
        else:
            size, at = number(at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class CharacterMap:
    """The compiled map: a double-array trie over UTF-8 keys whose values are offsets of replacements."""

    def __init__(self, blob: bytes) -> None:
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob, dtype="<u4", count=size // 4, offset=4).tolist() if size else []
        self.texts = blob[4 + size :]
        firsts = self._firsts() if size else []
        #: Finds the places at which some key may begin; all others stay as they are.
        self.may = re.compile("[" + "".join(map(re.escape, firsts)) + "]") if firsts else None

    def _child(self, at: int, byte: int) -> tuple[int, bool] | None:
        """Where the children of at's child by this byte are, and whether a key ends there."""
        at ^= byte
        if at >= len(self.units):
            return None
        unit = self.units[at]
        if unit & 0x800000FF != byte:
            return None
        return at ^ self._offset(unit), bool(unit >> 8 & 1)

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def _firsts(self) -> list[str]:
        """First characters of all keys."""
        out, todo = [], [(self._offset(self.units[0]), b"")]
        while todo:
            at, head = todo.pop()
            for byte in range(1, 256) if not head else range(128, 192):
                if (step := self._child(at, byte)) is not None:
                    char = head + bytes([byte])
                    whole = char[0] < 128 or len(char) == 2 + (char[0] >= 0xE0) + (char[0] >= 0xF0)
                    if whole:
                        out.append(char.decode())
                    else:
                        todo.append((step[0], char))
        return out

    def longest(self, data: bytes, start: int) -> tuple[int, str] | None:
        """Length in bytes of the longest key at a place of data, and its replacement."""
        at, found = self._offset(self.units[0]), None
        for end in range(start, len(data)):
            step = self._child(at, data[end]) if data[end] else None
            if step is None:
                break
            at, leaf = step
            if leaf:
                found = end + 1 - start, self.units[at] & 0x7FFFFFFF
        if found is None:
            return None
        size, place = found
        return size, self.texts[place : self.texts.index(b"\0", place)].decode()


class Pieces:
    """A model file of byte-pair pieces with byte fallback, ready to encode and decode.

    Unigram models, and ones with user-defined or unused pieces or without byte fallback, are refused.
    """

    def __init__(self, path: str | None = None, memo: int = 400_000, model: bytes | None = None) -> None:
        if model is None:
            with open(path, "rb") as f:
                model = f.read()
        parts = [(n, v) for n, v in fields(model)]
        pieces = []
        for n, v in parts:
            if n == 1:
                own = dict(fields(v))
                pieces.append((own.get(1, b"").decode(), own.get(2, 0.0), own.get(3, NORMAL)))
        trainer = dict(fields(next((v for n, v in parts if n == 2), b"")))
        rules = dict(fields(next((v for n, v in parts if n == 3), b"")))
        kinds = {kind for _, _, kind in pieces}
        if trainer.get(3, 1) != BPE or not trainer.get(35) or kinds - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("the model must hold byte-pair pieces with byte fallback, and none that users defined")
        self.map = CharacterMap(rules.get(2, b""))
        self.prefix, self.squeeze, escape = bool(rules.get(3, 1)), bool(rules.get(4, 1)), bool(rules.get(5, 1))
        self.suffix = bool(trainer.get(24, 0))
        self.mark = SPACE if escape else " "
        self.ids = {p: k for k, (p, _, kind) in enumerate(pieces) if kind == NORMAL}
        self.score = {p: s for p, s, kind in pieces if kind == NORMAL}
        self.bytes_to_id = [0] * 256
        shown: list[bytes] = []
        width = []
        for k, (piece, _, kind) in enumerate(pieces):
            if kind == BYTE:
                byte = int(piece[3:5], 16)
                self.bytes_to_id[byte] = k
                shown.append(bytes([byte]))
            elif kind == CONTROL:
                shown.append(b"")
            elif kind == UNKNOWN:
                shown.append(trainer[44] if 44 in trainer else " ⁇ ".encode())
            else:
                shown.append(piece.replace(SPACE, " ").encode())
            width.append(1 if kind == BYTE else len(piece.encode()) if kind == NORMAL else 0)
        self.width = np.array(width, dtype=np.int64)
        self.lengths = np.array([len(x) for x in shown], dtype=np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])
        self.flat = np.frombuffer(b"".join(shown), dtype=np.uint8)
        self.leads = [p.startswith(SPACE) and kind == NORMAL for p, _, kind in pieces]
        self.control = [kind == CONTROL for _, _, kind in pieces]
        self.packed = [k.to_bytes(4, "little") for k in range(len(pieces))]
        # where no piece has a space mark behind another character, none reaches over that border
        held = any(SPACE in p.lstrip(SPACE) for p in self.ids) or not escape
        self.words = None if held else re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        # nor over one between letters or digits and others, but for pieces that hold one of these characters
        both = {a if a.isalnum() else b for p in self.ids for a, b in zip(p, p[1:]) if SPACE not in (a, b) and a.isalnum() != b.isalnum()}
        self.mixing = re.compile("[" + "".join(map(re.escape, both)) + "]") if both else None
        self.stems = None if held else re.compile(rf"{SPACE}*[^\W_]+|{SPACE}*(?:[^\w{SPACE}]|_)+|{SPACE}+")
        #: Ids of words, by whether they come without their mark, and of stems.
        self.memo: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})
        self.known: dict[str, bytes] = {}
        self.most = memo

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its bytes and its end the byte of text that it comes from."""
        data = text.encode()
        if self.map.may is None and not self.squeeze:
            return self._escaped(text, data)
        out, source, last = [], [], len(data)
        at, gap = 0, self.squeeze  # gap: white space that comes now is dropped

        def put(part: str, each: list[int] | None, start: int) -> None:
            """Adds a part, whose bytes come from `each` or all from start."""
            nonlocal gap
            if gap and part.startswith(" "):
                cut = len(part) - len(part.lstrip(" "))
                part, each = part[cut:], each and each[cut:]
            if part:
                raw = part.encode()
                places = np.array(each if each else [start] * len(raw), dtype=np.int64)
                if self.mark != " ":
                    places = np.repeat(places, np.where(np.frombuffer(raw, dtype=np.uint8) == 32, len(SPACE.encode()), 1))
                if self.prefix and not self.suffix and not out:
                    head(start if each is None else each[0])
                out.append(part.replace(" ", self.mark))
                source.append(places)
                gap = self.squeeze and part.endswith(" ")

        def head(start: int) -> None:
            out.append(self.mark)
            source.append(np.full(len(self.mark.encode()), start, dtype=np.int64))

        for kind, part in self._runs(text):
            size = len(part.encode())
            if kind == "same":
                lead = np.frombuffer(part.encode(), dtype=np.uint8) & 0xC0 != 0x80
                places = at + np.maximum.accumulate(np.where(lead, np.arange(size), 0))
                if not self.squeeze:
                    put(part, places.tolist(), at)
                else:  # of every run of spaces the first stays
                    kept = np.frombuffer(part.encode(), dtype=np.uint8) != 32
                    kept[1:] |= kept[:-1]
                    kept[0] = kept[0] or not gap
                    if kept.any():
                        put(np.frombuffer(part.encode(), dtype=np.uint8)[kept].tobytes().decode(), places[kept].tolist(), at)
            else:
                put(kind, None, at)
            at += size
        whole, places = "".join(out), np.concatenate(source) if source else np.zeros(0, dtype=np.int64)
        if not whole:
            return "", np.zeros(1, dtype=np.int64)
        if self.squeeze and whole.endswith(self.mark):
            cut = whole.rstrip(self.mark)
            last = int(places[len(cut.encode())])
            whole, places = cut, places[: len(cut.encode())]
        if self.prefix and self.suffix:
            whole, places = whole + self.mark, np.concatenate([places, np.full(len(self.mark.encode()), last)])
        return whole, np.concatenate([places, [last]])

    def _runs(self, text: str) -> Iterator[tuple[str, str]]:
        """("same", part) of what the map leaves alone, and (replacement, part) of the longest keys."""
        if self.map.may is None:
            yield from [("same", text)] if text else []
            return
        done = at = 0
        while found := self.map.may.search(text, at):
            at = found.start()
            window = text[at : at + 64].encode()  # keys are much shorter
            key = self.map.longest(window, 0)
            if key is None:
                at += 1
                continue
            if done < at:
                yield "same", text[done:at]
            part = window[: key[0]].decode()
            yield key[1], part
            at = done = at + len(part)
        if done < len(text):
            yield "same", text[done:]

    def _escaped(self, text: str, data: bytes) -> tuple[str, np.ndarray]:
        """The same where the map is empty and white space stays: only spaces change."""
        if not data:
            return "", np.zeros(1, dtype=np.int64)
        raw = np.frombuffer(data, dtype=np.uint8)
        places, wide = np.arange(len(raw)), len(self.mark.encode())
        if len(text) < len(data):
            places = np.maximum.accumulate(np.where(raw & 0xC0 != 0x80, places, 0))
        if wide > 1:
            places = np.repeat(places, np.where(raw == 32, wide, 1))
        whole, parts = text.replace(" ", self.mark), [places]
        if self.prefix:
            whole = whole + self.mark if self.suffix else self.mark + whole
            parts.insert(1 if self.suffix else 0, np.full(wide, len(data) if self.suffix else 0))
        return whole, np.concatenate([*parts, [len(data)]])

    def merged(self, part: str) -> list[int]:
        """Ids of a stretch that no piece reaches over: the best pair merges first, of equal ones the leftmost."""
        ids, stand = self.ids, self.bytes_to_id
        out: list[int] = []
        for x in self._short(part) if len(part) <= 40 else self._long(part):
            own = ids.get(x)
            if own is None:
                out += [stand[b] for b in x.encode()]
            else:
                out.append(own)
        return out

    def _short(self, part: str) -> list[str]:
        """Pieces of a short stretch: all pairs are looked through for each merge."""
        score, now = self.score.get, list(part)
        of = [score(x, NEVER) for x in map(add, part, part[1:])]
        while of:
            best = max(of)
            if best == NEVER:
                break
            k = of.index(best)
            joined = now[k] + now[k + 1]
            now[k] = joined
            del of[k], now[k + 1]
            if k < len(of):
                of[k] = score(joined + now[k + 1], NEVER)
            if k:
                of[k - 1] = score(now[k - 1] + joined, NEVER)
        return now

    def _long(self, part: str) -> list[str]:
        """The same by a queue of pairs, for stretches of any length."""
        score, size = self.score, len(part)
        now: list[str | None] = list(part)
        before, after = list(range(-1, size - 1)), list(range(1, size + 1))
        heap = [(-s, k, 2) for k in range(size - 1) if (s := score.get(part[k : k + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, long = heapq.heappop(heap)
            left = now[k]
            if left is None or after[k] >= size:
                continue
            right = now[after[k]]
            if len(left) + len(right) != long:
                continue
            joined = left + right  # the same place and length, so the same piece
            now[k], now[after[k]] = joined, None
            after[k] = after[after[k]]
            if after[k] < size:
                before[after[k]] = k
                if (s := score.get(joined + now[after[k]])) is not None:
                    heapq.heappush(heap, (-s, k, long + len(now[after[k]])))
            if before[k] >= 0 and (s := score.get(now[before[k]] + joined)) is not None:
                heapq.heappush(heap, (-s, before[k], long + len(now[before[k]])))
        return [x for x in now if x is not None]

    def ids_of(self, normal: str) -> np.ndarray:
        """Ids of a normalised text; words seen before are looked up."""
        if self.words is None:
            return np.array(self.merged(normal) if normal else [], dtype="<u4")
        single = normal.startswith(SPACE) and SPACE * 2 not in normal
        found = normal[1:].split(SPACE) if single else self.words.findall(normal)  # without their mark, or with it
        memo = self.memo[single]
        try:
            raw = b"".join([memo[x] for x in found])
        except KeyError:
            if len(memo) >= self.most:
                memo.clear()
            own, mark = {}, SPACE if single else ""
            for x in {*found}.difference(memo):
                (memo if len(x) <= 64 else own)[x] = self._word(mark + x)  # long stretches rarely come again
            raw = b"".join([memo[x] if x in memo else own[x] for x in found])
        return np.frombuffer(raw, dtype="<u4")

    def _word(self, word: str) -> bytes:
        """Ids of a word with its marks, packed; its stems may be known."""
        stems, packed, out = self.known, self.packed, []
        if len(stems) >= self.most:
            stems.clear()
        for x in [word] if self.mixing and self.mixing.search(word) else self.stems.findall(word):
            ids = stems.get(x)
            if ids is None:
                ids = b"".join([packed[k] for k in self.merged(x)])
                if len(x) <= 64:
                    stems[x] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of a whole text, and where each one's part of the text begins and ends, in bytes."""
        normal, source = self.normalise(text)
        ids = self.ids_of(normal)
        ends = np.cumsum(self.width[ids])
        places = source[np.concatenate([[0], ends])] if len(ids) else np.zeros(1, dtype=np.int64)
        return ids, places[:-1], places[1:]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: bytes gathered from the flat table, without the mark in front that encoding adds."""
        ids = ids.astype(np.int64)
        sizes = self.lengths[ids]
        if self.prefix or self.squeeze:
            ids, sizes, lost = self._bare(ids, sizes)
        else:
            lost = 0
        ends = np.cumsum(sizes)
        place = np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int64) + np.repeat(self.offsets[ids] - (ends - sizes), sizes)
        return self.flat[place].tobytes()[lost:].decode("utf-8", "graphweave_one_byte")

    def _bare(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """ids without leading pieces that show nothing, and the bytes to drop from the first one."""
        at = 0
        while at < len(ids):
            k = int(ids[at])
            if self.control[k]:
                at += 1
            elif not self.leads[k]:
                return ids[at:], sizes[at:], 0
            elif sizes[at] > 1 or not self.squeeze:
                return ids[at:], sizes[at:], 1
            else:  # white space alone: the next piece is still in front
                at += 1
        return ids[at:], sizes[at:], 0


_loaded: dict[str, Pieces] = {}


def model(path: str) -> Pieces:
    """The model of a file, read once for each worker process."""
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def encode_texts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, starts, ends) of every whole text: a piece's id and the bytes of the UTF-8 text that it stands for.

    A null text counts as empty and gives no ids; a text of spaces is kept as the model says; rows are
    neither dropped nor merged; null and repeated ids stay; columns besides the two named are ignored,
    whatever they are called. An empty table gives an empty table. One narrow pass: no shuffle, memory
    of a few texts.
    """
    df = renamed(docs, doc_id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_path)
        for batch in slices(batches, "text", 2 << 20):
            found = [m.encode(x or "") for x in batch.column("text").to_pylist()]
            columns = [pa.array([f[k].astype(kind) for f in found], pa.list_(pa.from_numpy_dtype(kind))) for k, kind in enumerate((np.int32, np.int64, np.int64))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "ids", "starts", "ends"])

    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, ids array<int>, starts array<long>, ends array<long>")


def decode_ids(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, decoded_text) of what encode_texts returns; bytes that are no character become U+FFFD each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_path)
        for batch in batches:
            text = [m.decode(np.array(x if x is not None else [], dtype=np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(text, pa.string())], ["doc_id", "decoded_text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, decoded_text string")


def round_trip_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """Encoding with spans, decoding, and SHA-256 of the ids, the decoded text and the spans' ends, in one Python pass.

    n_bytes is the length of the text's part that the pieces cover; spans_sha256 is over the ends as
    little-endian 64-bit integers. Cases as in encode_texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_path)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes", "spans_sha256"]
        for batch in slices(batches, "text"):
            rows = []
            for text in batch.column("text").to_pylist():
                ids, starts, ends = m.encode(text or "")
                covered = int(ends[-1] - starts[0]) if len(ids) else 0
                rows.append((len(ids), sha(",".join(map(str, ids.tolist())).encode()), sha(m.decode(ids).encode()), covered, sha(ends.astype("<i8").tobytes())))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], names)

    df = renamed(docs, doc_id="doc_id", text="text")
    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long, spans_sha256 string")
