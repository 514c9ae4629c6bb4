"""Token ids of whole texts with a public tokenizer file, fast on text with many repeated words.

The library cuts a text into units (words, numbers, marks, white space) before it merges pairs, so the
ids of a text are those of its units in order. Units are found for a whole batch with numpy, and each
distinct one is encoded once by the library and kept in a dictionary of bounded size. Where the units
are not certain (apostrophes, letters outside the first 2,048 code points, combining marks), the
library gets the whole piece between white space, or the whole text.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import numpy as np
import regex
from tokenizers import Tokenizer

from chunkcast.llm.textbytes import LOWER, hash_spans, slices, text_buffers

LETTER, NUMBER, SPACE, OTHER, UNSURE = range(5)
_WIDE_SPACES = np.array([ord(c) for c in map(chr, range(0x800, 0x3001)) if regex.match(r"\s", c)])


def _class_of(cp: int) -> int:
    c = chr(cp)
    if c == "'" or unicodedata.category(c) in ("Mn", "Mc", "Me", "Cn") or unicodedata.normalize("NFC", c) != c or len(c.lower()) != 1:
        return UNSURE
    if regex.match(r"\s", c):
        return SPACE
    return LETTER if regex.match(r"\p{L}", c) else NUMBER if regex.match(r"\p{N}", c) else OTHER


_CLASS = np.array([_class_of(cp) for cp in range(0x800)], dtype=np.uint8)
_BYTE_CLASS = np.concatenate([_CLASS[:128], np.full(128, UNSURE, np.uint8)])


def _byte_letters() -> dict[int, str]:
    """The visible letter of every byte, by the rule of byte-level vocabularies."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = (b for b in range(256) if b not in shown)
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def _classes(data: np.ndarray) -> np.ndarray:
    """The class of the character that each byte belongs to."""
    cls = _BYTE_CLASS[data]
    two = np.flatnonzero((data >= 0xC2) & (data < 0xE0))
    cp = (data[two].astype(np.int64) & 0x1F) << 6 | data[two + 1] & 0x3F
    cls[two] = cls[two + 1] = _CLASS[cp]
    return cls


def _wide_space_rows(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows with white space of three bytes."""
    three = np.flatnonzero((data >= 0xE1) & (data <= 0xE3))
    cp = (data[three].astype(np.int64) & 0x0F) << 12 | (data[three + 1].astype(np.int64) & 0x3F) << 6 | data[three + 2] & 0x3F
    return np.unique(np.searchsorted(offsets, three[np.isin(cp, _WIDE_SPACES)], "right") - 1)


class TextEncoder:
    """Ids of texts, equal to ``Tokenizer.encode(text, add_special_tokens=False).ids``.

    With ``added``, rows that hold the text of an added token go whole to the library, which splits there
    as it does by default; without it, special token strings are ordinary text (the library's
    ``encode_special_tokens``). ``dtype`` is that of the ids: two bytes for vocabularies of up to 65,536
    entries, else four. The dictionary starts anew beyond ``most`` units.
    """

    def __init__(self, path: str, most: int = 1_200_000, added: bool = False):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added
        known = self.tokenizer.get_added_tokens_decoder().values() if added else []
        self.added = [t.content.encode() for t in known]
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.width = 2 if self.vocabulary <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        self.most = most
        # tokens that match normalized text cannot be found in the raw one
        self.kind = None if any(t.normalized for t in known) else self._kind(json.loads(self.tokenizer.to_str()))
        self.model, self.normalizer = self.tokenizer.model, self.tokenizer.normalizer
        self.letters = str.maketrans({chr(b): c for b, c in _byte_letters().items()})
        self._forget()

    @staticmethod
    def _kind(spec: dict) -> str | None:
        """``spaced``: a space belongs to the unit after it; ``lower``: lower-cased, white space dropped."""
        pre = spec["pre_tokenizer"] or {}
        parts = [p.get("type") for p in pre.get("pretokenizers", [])]
        normal = [p.get("type") for p in (spec["normalizer"] or {}).get("normalizers", [])]
        if spec["model"]["type"] == "BPE" and not spec["model"].get("dropout"):
            if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec["normalizer"]:
                return "spaced"
            if normal == ["NFC", "Replace", "Lowercase"] and parts == ["Split", "ByteLevel"] and pre["pretokenizers"][0].get("invert"):
                return "lower"
        return None

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # sorted hashes of known units, and which unit each is
        self.which = np.zeros(0, np.int64)
        self.begin = np.zeros(1, np.int64)  # of every unit's ids in flat
        self.flat = np.zeros(0, self.dtype)

    def _library(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _unit(self, raw: bytes, unsure: bool) -> list[int]:
        if unsure:
            return self._library(raw.decode())
        if self.kind == "lower" and not raw.isascii():
            raw = self.normalizer.normalize_str(raw.decode()).encode()
        return [t.id for t in self.model.tokenize(raw.decode("latin-1").translate(self.letters))]

    def _units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and certainty of every unit, and the number of units of every row."""
        n, cls = len(data), _classes(data)
        first = offsets[:-1][np.diff(offsets) > 0]
        start = np.empty(n, bool)
        start[0] = True
        np.not_equal(cls[1:], cls[:-1], out=start[1:])
        if self.kind == "lower":
            start |= (cls == NUMBER) & ((data < 0x80) | (data >= 0xC0))
        start[first] = True
        space = cls == SPACE
        edge = np.empty(n, bool)
        np.not_equal(space[1:], space[:-1], out=edge[1:])
        edge[first] = True
        runs_at = np.flatnonzero(edge)
        runs_to = np.append(runs_at[1:], n)
        blank = space[runs_at]
        unsure = np.concatenate([[0], np.cumsum(cls == UNSURE)])
        odd = ~blank & (unsure[runs_to] > unsure[runs_at])
        if odd.any():  # uncertain pieces stay whole
            step = np.zeros(n + 1, np.int32)
            np.add.at(step, runs_at[odd] + 1, 1)
            np.add.at(step, runs_to[odd], -1)
            start &= np.cumsum(step[:-1]) == 0
            start[first] = True
        if self.kind == "spaced":
            row_ends = np.zeros(n + 1, bool)
            row_ends[offsets] = True
            to = runs_to[blank & ~row_ends[runs_to]]
            last = to - 1 - (data[to - 1] >= 0x80)  # first byte of the run's last character
            start[last] = True
            joined = data[last] == 0x20
            start[to[joined]] = False
        for row in _wide_space_rows(data, offsets).tolist():
            start[offsets[row] + 1 : offsets[row + 1]] = False
            unsure[offsets[row] + 1 :] += 1
        s = np.flatnonzero(start)
        e = np.append(s[1:], n)
        if self.kind == "lower":
            keep = (cls[s] != SPACE) | (unsure[e] > unsure[s])
            s, e = s[keep], e[keep]
        return s, e, unsure[e] > unsure[s], np.diff(np.searchsorted(s, offsets))

    def _known(self, h: np.ndarray) -> np.ndarray:
        """Position of every hash among the known units, -1 where there is none."""
        if not len(self.keys):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, self.which[at], -1)

    def _learn(self, low: np.ndarray, h: np.ndarray, s: np.ndarray, e: np.ndarray, unsure: np.ndarray) -> None:
        raw, ids, sizes = low.tobytes(), [], []
        for a, b, u in zip(s.tolist(), e.tolist(), unsure.tolist()):
            got = self._unit(raw[a:b], u)
            ids.extend(got)
            sizes.append(len(got))
        named = np.arange(len(self.begin) - 1, len(self.begin) - 1 + len(h))
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(sizes)])
        self.flat = np.concatenate([self.flat, np.array(ids, self.dtype)])
        keys = np.concatenate([self.keys, h])
        order = np.argsort(keys, kind="stable")
        self.keys, self.which = keys[order], np.concatenate([self.which, named])[order]

    def _added_rows(self, data: np.ndarray, offsets: np.ndarray) -> list[int]:
        """Rows that hold the text of an added token."""
        raw, rows = data.tobytes(), set()
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                row = int(np.searchsorted(offsets, at, "right")) - 1
                inside = at + len(token) <= offsets[row + 1]
                if inside:
                    rows.add(row)
                at = raw.find(token, int(offsets[row + 1]) if inside else at + 1)
        return sorted(rows)

    def _slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, sizes, at = [], [], 0
        for row in [*(self._added_rows(data, offsets) if self.kind else ()), len(offsets) - 1]:
            if row > at:
                got, n = self._plain(data[offsets[at] : offsets[row]], offsets[at : row + 1] - offsets[at])
                ids.append(got)
                sizes.append(n)
            if row < len(offsets) - 1:
                whole = self._library(data[offsets[row] : offsets[row + 1]].tobytes().decode())
                ids.append(np.array(whole, self.dtype))
                sizes.append(np.array([len(whole)], np.int64))
            at = row + 1
        return np.concatenate([np.zeros(0, self.dtype), *ids]), np.concatenate([np.zeros(0, np.int64), *sizes])

    def _plain(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = len(offsets) - 1
        if not len(data):
            return np.zeros(0, self.dtype), np.zeros(rows, np.int64)
        if self.kind is None:
            raw = data.tobytes()
            each = [self._library(raw[a:b].decode()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            return np.array([x for ids in each for x in ids], self.dtype), np.array([len(ids) for ids in each], np.int64)
        if len(self.keys) >= self.most:
            self._forget()
        s, e, unsure, counts = self._units(data, offsets)
        low = LOWER[data] if self.kind == "lower" else data
        distinct, at, place = np.unique(hash_spans(low, s, e), return_index=True, return_inverse=True)
        known = self._known(distinct)
        if (new := known < 0).any():
            take = at[new]
            self._learn(low, distinct[new], s[take], e[take], unsure[take])
            known = self._known(distinct)
        unit = known[place]
        sizes = self.begin[unit + 1] - self.begin[unit]
        total = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.flat[np.repeat(self.begin[unit] - total[:-1], sizes) + np.arange(total[-1])]
        ends = np.concatenate([[0], np.cumsum(counts)])
        return ids, np.diff(total[ends])

    def encode(self, column, end_id: int | None = None, most_bytes: int = 1_000_000):
        """Yield ``(first row, ids, ids per row)`` for runs of rows of an Arrow string column.

        Nulls are empty texts; ``end_id`` is appended to every row. A run has at most ``most_bytes`` of
        text, or is one longer row; a run takes many times its bytes while it is encoded.
        """
        data, offsets = text_buffers(column)
        for low, high in slices(offsets, most_bytes):
            a, b = offsets[low], offsets[high]
            ids, n = self._slice(data[a:b], offsets[low : high + 1] - a)
            if end_id is not None:
                ids = np.insert(ids, np.cumsum(n), end_id)
                n = n + 1
            yield low, ids, n


@lru_cache(maxsize=2)
def encoder(path: str) -> TextEncoder:
    """The worker's encoder for a tokenizer file."""
    return TextEncoder(path, added=True)
