"""Token ids of whole texts by the tokenizers library, each distinct piece looked up once in a table of bounded size."""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np

from packwright.llm.common import mix64

#: Pieces that a worker's table holds (about 40 bytes each); it starts anew beyond that.
TABLE_PIECES = 1 << 18
#: Characters that are worked on at once; arrays of a worker grow with this, not with its batches.
CHUNK = 1 << 19
LETTER, NUMBER, OTHER, SPACE, UNASSIGNED, EDGE = 1, 2, 3, 4, 5, 9
#: Characters that end texts here, that Python and the library may class differently as white space, or that lower-case by context: texts with one are encoded whole,
#: and so are those with a code point that Python's Unicode version doesn't assign, as the library's may.
UNSURE = re.compile("[\0\x1c-\x1f\x85\u0130\u03a3\u180e\u200b\ufeff]")
#: A blank between letters: a piece starts with it or after it, whatever stands around.
_CUT = re.compile(r"(?<=[^\W\d_]) (?=[^\W\d_])")
# Endings after an apostrophe that both pre-tokenizers keep apart.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
_encoders: dict[str, Encoder] = {}
_tables: dict[str, np.ndarray] = {}


def _kinds(codes: np.ndarray) -> np.ndarray:
    """The class of each code point; classes are looked up for the pages of 256 that occur."""
    if "kind" not in _tables:
        _tables["kind"], _tables["known"] = np.zeros(0x110000, np.uint8), np.zeros(0x1100, bool)
    table, known = _tables["kind"], _tables["known"]
    pages = np.bincount(codes >> 8, minlength=len(known)) > 0
    for page in np.flatnonzero(pages & ~known).tolist():
        chars = [chr(i) for i in range(page << 8, (page + 1) << 8)]
        names = [unicodedata.category(c) for c in chars]
        kind = {"L": LETTER, "N": NUMBER}
        table[page << 8 : (page + 1) << 8] = [SPACE if c.isspace() else UNASSIGNED if n == "Cn" else kind.get(n[0], OTHER) for c, n in zip(chars, names, strict=True)]
        known[page] = True
        table[0] = EDGE
    return table[codes]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64 and of its inverse; kept up to CHUNK."""
    if len(_tables.get("up", ())) < n:
        size = max(n, 1 << 16) if n > 2 * CHUNK else min(2 * CHUNK, 1 << max(16, (n - 1).bit_length()))
        made = []
        for base in (0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)):
            steps = np.full(size, np.uint64(base))
            steps[0] = 1
            made.append(np.multiply.accumulate(steps))
        if n > 2 * CHUNK:
            return made[0][:n], made[1][:n]
        _tables["up"], _tables["down"] = made
    return _tables["up"][:n], _tables["down"][:n]


class PieceTable:
    """Ids of pieces by a 64-bit hash, which a second number checks: sorted arrays instead of objects, so that its size is bounded."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.key, self.check = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.at, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def look_up(self, key: np.ndarray, check: np.ndarray, encode) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids one after another, and where those of each piece start and how many they are. key: ascending; encode(rows) gives the ids of pieces that aren't there."""
        where = np.searchsorted(self.key, key)
        at, size = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
        there = where < len(self.key)
        there[there] = self.key[where[there]] == key[there]
        same = there.copy()
        same[there] = self.check[where[there]] == check[there]
        at[same], size[same] = self.at[where[same]], self.size[where[same]]
        new = np.flatnonzero(~same)
        flat = self.flat
        if len(new):
            ids = encode(new)
            size[new] = [len(x) for x in ids]
            at[new] = len(flat) + np.cumsum(size[new]) - size[new]
            flat = np.concatenate([flat, np.fromiter(chain.from_iterable(ids), np.uint32, int(size[new].sum()))])
            fresh = np.flatnonzero(~there)  # a key with another check stays the first piece's
            if len(self.key) + len(fresh) > TABLE_PIECES:
                self.clear()
            else:
                for name, own in (("key", key), ("check", check), ("at", at), ("size", size)):
                    setattr(self, name, np.insert(getattr(self, name), where[fresh], own[fresh]))
                self.flat = flat
        return flat, at, size


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes, equal to the library's for each whole text with add_special_tokens=False.

    The pre-tokenizers' pieces are found for many texts at once by classes of characters, with arrays instead of a
    loop over characters; the library's model encodes each piece that the table lacks. byte_bpe: ByteLevel with its regex; word_bpe: NFC,
    lower case, split, white space dropped. Texts that hold the string of an added token go to the library whole, which gives it that token's id."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        steps = {"ByteLevel": "bytes", "Sequence": "words"}.get(spec["pre_tokenizer"]["type"])
        lowers = [n["type"] for n in (spec["normalizer"] or {"normalizers": []})["normalizers"]]
        if steps is None or (steps == "words") != (lowers == ["NFC", "Replace", "Lowercase"]) or spec["model"]["type"] != "BPE":
            raise ValueError(f"{path}: neither a byte-level nor a word BPE")
        self.words = steps == "words"
        self.added = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or "(?!)", re.I)
        shown = {c: chr(c) for c in (*range(33, 127), *range(161, 173), *range(174, 256))}
        hidden = [c for c in range(256) if c not in shown]
        self.alphabet = shown | {c: chr(256 + k) for k, c in enumerate(hidden)}  # how byte-level models write bytes
        self.table = PieceTable()

    @staticmethod
    def of(path: str) -> Encoder:
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        return _encoders[path]

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _pieces(self, pieces: list[str]) -> list[list[int]]:
        # byte 255 is in no UTF-8 text, and is written as itself
        written = b"\xff".join(p.encode("utf-8", "replace") for p in pieces).decode("latin-1").translate(self.alphabet)
        tokenize = self.tokenizer.model.tokenize
        return [[t.id for t in tokenize(p)] for p in written.split("\xff")]

    def _bounds(self, joined: str, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of pieces in texts joined by NUL."""
        kind = _kinds(codes)
        before = np.concatenate([np.full(1, EDGE, np.uint8), kind[:-1]])
        start = kind != before
        if self.words:
            start |= kind == NUMBER
        else:
            real = np.flatnonzero((kind <= OTHER) & (before == SPACE))
            blank = codes[real - 1] == 32
            start[real[blank]] = False
            start[real - 1] = True
        at = -1
        while (at := joined.find("'", at + 1)) >= 0:
            if before[at] == OTHER or not self.words and at and codes[at - 1] == 32:
                continue
            end = next((at + 1 + len(e) for e in ENDINGS if joined.startswith(e, at + 1)), 0)
            if end:
                start[at + 1] = False
                if end < len(kind):
                    start[end] = True
        first = np.flatnonzero(start)
        last = np.append(first[1:], len(codes))
        keep = (kind[first] != EDGE) & ((kind[first] != SPACE) | (not self.words))
        return first[keep], last[keep]

    def _parts(self, text: str) -> Iterator[str]:
        """The text cut between pieces after about every CHUNK characters; whole where it has no such place."""
        at = 0
        while len(text) - at > CHUNK and (m := _CUT.search(text, at + CHUNK)):
            yield text[at : m.start()]
            at = m.start()
        yield text[at:]

    def _needs_library(self, text: str) -> bool:
        if UNSURE.search(text) or self.added.search(text):
            return True
        return not text.isascii() and any((_kinds(_codes(text[k : k + CHUNK])) == UNASSIGNED).any() for k in range(0, len(text), CHUNK))

    def _encode(self, parts: list[str]) -> list[bytes]:
        if self.words:
            parts = [t.lower() if t.isascii() else unicodedata.normalize("NFC", t).lower() for t in parts]
        joined = "\0".join(parts)
        codes = _codes(joined)
        if not len(codes):
            return [b""] * len(parts)
        begin, end = self._bounds(joined, codes)
        up, down = _powers(len(codes) + 1)
        prefix = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)], out=prefix[1:])
        length = (end - begin).astype(np.uint64)
        key = mix64((prefix[end] - prefix[begin]) * down[begin] + length)
        uniq, first, place = np.unique(key, return_index=True, return_inverse=True)
        a, z = begin[first], end[first]
        check = codes[a].astype(np.uint64) | codes[z - 1].astype(np.uint64) << np.uint64(21) | length[first] << np.uint64(42)
        flat, at, size = self.table.look_up(uniq, check, lambda rows: self._pieces([joined[s:e] for s, e in zip(a[rows].tolist(), z[rows].tolist(), strict=True)]))
        n = size[place]
        upto = np.concatenate([[0], np.cumsum(n)])
        tokens = flat[np.repeat(at[place] - upto[:-1], n) + np.arange(upto[-1])]
        cuts = np.cumsum([0, *(len(p) + 1 for p in parts)])
        bounds = upto[np.searchsorted(begin, cuts)].tolist()
        return [tokens[s:e].tobytes() for s, e in zip(bounds, bounds[1:], strict=False)]

    def encode_many(self, texts: list[str]) -> list[bytes]:
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, str]] = []
        size = 0

        def flush() -> None:
            for (i, _), ids in zip(held, self._encode([p for _, p in held]), strict=True):
                out[i].append(ids)
            held.clear()

        for i, text in enumerate(texts):
            if self._needs_library(text):
                out[i].append(self.whole(text))
                continue
            for part in self._parts(text):
                if size + len(part) > CHUNK:
                    flush()
                    size = 0
                held.append((i, part))
                size += len(part) + 1
        flush()
        return [b"".join(x) for x in out]
