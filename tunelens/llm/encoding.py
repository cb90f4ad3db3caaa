"""Whole-text encoding inside tasks with the tokenizers library, each distinct chunk of text encoded once per worker.

Both public vocabularies split a text at white space before they merge bytes, so a text's ids are the ids of its chunks
in a row. ``byte`` vocabularies keep white space: a chunk is a word with the white space before it, and a single line
break is a chunk of its own. ``word`` vocabularies drop it: a chunk is a word. A text with white space beyond ASCII,
whose runs the two views might cut differently, is encoded in one piece.

A text of plain characters alone is cut further, as the vocabulary cuts it, into pieces (letters, digits, marks), whose
ids come from the vocabulary's merge model: there are fewer of them than chunks, and words with marks share them.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa

_S = r" \t\n\x0b\x0c\r"
# White space, and marks some libraries take for it, beyond the six ASCII characters.
_ODD_CODES = [*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200E), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060,
              0x3000, 0xFEFF]
_ODD = re.compile("[" + "".join(map(chr, _ODD_CODES)) + "]")
_BYTE = re.compile(rf"\n(?=[^{_S}])|[{_S}]*[^{_S}]+|[{_S}]+")
_WORD = re.compile(rf"[^{_S}]+")
_JOINABLE = re.compile(rf" ?[^{_S}]+\Z")


def _plain_letters() -> str:
    """Latin letters beyond ASCII that composition leaves alone and that have one lower-case letter."""
    letters = map(chr, range(0xC0, 0x250))
    return "".join(c for c in letters if c.isalpha() and len(c.lower()) == 1 and unicodedata.is_normalized("NFC", c))


def _byte_letters() -> dict[int, str]:
    """The letter that byte vocabularies write for each byte: printable ones stand for themselves, the others for the
    next free character from 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in own]
    return {b: chr(256 + i) for i, b in enumerate(others)}


_BYTE_LETTERS = _byte_letters()
_PLAIN = re.compile(f"[{_S}!-~{_plain_letters()}]*")
_L = f"A-Za-z{_plain_letters()}"
# How the two public vocabularies cut text into pieces, for plain characters.
_ENDINGS = "'(?:s|t|re|ve|m|ll|d)"
_WORD_PIECES = re.compile(rf"[{_L}]+|{_ENDINGS}|\d|[^\s\d{_L}]+")
_BYTE_PIECES = re.compile(rf" ?[{_L}]+|{_ENDINGS}| ?\d+| ?[^\s\d{_L}]+|\s+(?!\S)|\s")

#: Chunks a worker remembers before it starts anew; about 200 MB at the most.
CACHE_CHUNKS = 1_000_000
#: Documents, and characters of text, that are held in encoded form at a time.
BATCH_ROWS, BATCH_CHARS = 512, 4_000_000

_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def tokenizer_path(name_or_path: str) -> str:
    """A file's path as given, or the place of a public vocabulary file on this machine."""
    if os.path.sep in name_or_path:
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(name_or_path)


class Encoder:
    """Ids of texts, and with ``spans`` the characters each id covers."""

    def __init__(self, vocabulary: str, spans: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path(vocabulary))
        self.spans = spans
        probe = self.tokenizer.encode("a\nb", add_special_tokens=False)
        self.keeps_space = len(probe.ids) == 3
        # What parts chunks that are encoded in one call: a line break, or a word of its own where space is dropped.
        self.joint = "\n" if self.keeps_space else " | "
        self.joint_id = self.tokenizer.encode(self.joint, add_special_tokens=False).ids[0]
        self.pattern = _BYTE if self.keeps_space else _WORD
        self._pieces = (_BYTE_PIECES if self.keeps_space else _WORD_PIECES).findall
        self._marks = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.size = self.used = 0
        self.pool = np.zeros(1 << 16, np.uint32)
        self.first = np.zeros(1 << 16, np.int32)
        self.last = np.zeros(1 << 16, np.int32)
        self.begin = np.zeros(1 << 14, np.int64)
        self.count = np.zeros(1 << 14, np.int32)

    def _add(self, chunk: str, ids: list[int], spans: list[tuple[int, int]] | None) -> None:
        if self.size == len(self.begin):
            self.begin, self.count = _twice(self.begin), _twice(self.count)
        n = len(ids)
        while self.used + n > len(self.pool):
            self.pool = _twice(self.pool)
            if self.spans:
                self.first, self.last = _twice(self.first), _twice(self.last)
        self.pool[self.used : self.used + n] = ids
        if spans is not None and n:
            self.first[self.used : self.used + n], self.last[self.used : self.used + n] = zip(*spans)
        self.begin[self.size], self.count[self.size] = self.used, n
        self.known[chunk] = self.size
        self.size += 1
        self.used += n

    def _add_all(self, chunks: list[str], lists: list[list[int]]) -> None:
        counts = np.fromiter(map(len, lists), np.int32, len(lists))
        n, total = len(chunks), int(counts.sum())
        while self.size + n > len(self.begin):
            self.begin, self.count = _twice(self.begin), _twice(self.count)
        while self.used + total > len(self.pool):
            self.pool = _twice(self.pool)
        self.pool[self.used : self.used + total] = np.fromiter((i for ids in lists for i in ids), np.uint32, total)
        self.count[self.size : self.size + n] = counts
        self.begin[self.size : self.size + n] = self.used + np.cumsum(counts, dtype=np.int64) - counts
        self.known.update(zip(chunks, range(self.size, self.size + n)))
        self.size += n
        self.used += total

    def _learn_plain(self, chunks: list[str]) -> list[str]:
        """Learn the chunks that can be cut into pieces here; returns the others."""
        others, plain, lists = [], [], []
        merge, cut, space = self.tokenizer.model.tokenize, self._pieces, _BYTE_LETTERS[ord(" ")]
        for c in chunks:
            if c.isascii() and c.isalpha():
                lists.append([t.id for t in merge(c if self.keeps_space else c.lower())])
            elif self.keeps_space and c[0] == " " and c.isascii() and c[1:].isalpha():
                lists.append([t.id for t in merge(space + c[1:])])
            elif self._is_plain(c):
                ids = []
                for piece in cut(c if self.keeps_space else c.lower()):
                    ids += [t.id for t in merge(piece.encode().decode("latin-1").translate(_BYTE_LETTERS))]
                lists.append(ids)
            else:
                others.append(c)
                continue
            plain.append(c)
        self._add_all(plain, lists)
        return others

    def _is_plain(self, text: str) -> bool:
        return _PLAIN.fullmatch(text) is not None and not ("<" in text and any(m in text for m in self._marks))

    def _learn(self, chunks: list[str]) -> None:
        if not self.spans:
            chunks = self._learn_plain(chunks)
        alone, joined = [], []
        for c in chunks:
            (joined if not self.spans and "|" not in c and _JOINABLE.match(c) else alone).append(c)
        for i in range(0, len(joined), 256):
            part = joined[i : i + 256]
            ids = np.array(self.tokenizer.encode(self.joint.join(part), add_special_tokens=False).ids, np.uint32)
            ends = np.append(np.flatnonzero(ids == self.joint_id), len(ids))
            if len(ends) != len(part):
                alone += part
                continue
            at = 0
            for c, end in zip(part, ends.tolist()):
                self._add(c, ids[at:end], None)
                at = end + 1
        for i in range(0, len(alone), 1024):
            part = alone[i : i + 1024]
            for c, e in zip(part, self.tokenizer.encode_batch(part, add_special_tokens=False)):
                self._add(c, e.ids, e.offsets if self.spans else None)

    def _chunks(self, text: str) -> list[str]:
        if not self.spans and self._is_plain(text):
            return self._pieces(text if self.keeps_space else text.lower())
        return [text] if _ODD.search(text) else self.pattern.findall(text)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray | None]:
        """(ids of all texts in a row, where each text's ids end, first character and end of each id in its text)."""
        if self.size > CACHE_CHUNKS:
            self.clear()
        parts = [self._chunks(t) for t in texts]
        flat = list(chain.from_iterable(parts))
        codes = np.fromiter(map(self.known.get, flat, repeat(-1)), np.int64, len(flat))
        new = np.flatnonzero(codes < 0)
        if len(new):
            missed = [flat[i] for i in new.tolist()]
            self._learn(list(dict.fromkeys(missed)))
            codes[new] = np.fromiter(map(self.known.__getitem__, missed), np.int64, len(missed))
        counts = self.count[codes].astype(np.int64)
        ends = np.cumsum(counts)
        at = np.repeat(self.begin[codes] - (ends - counts), counts)
        at += np.arange(len(at))
        sizes = np.array([len(p) for p in parts], np.int64)
        ends = np.append(0, ends)
        text_ends = ends[np.cumsum(sizes)] if len(sizes) else np.zeros(0, np.int64)
        if not self.spans:
            return self.pool[at], text_ends, None, None
        where = self._places(texts, parts)
        place = np.repeat(where, counts)
        return self.pool[at], text_ends, self.first[at] + place, self.last[at] + place

    def _places(self, texts: list[str], parts: list[list[str]]) -> np.ndarray:
        """First character of every chunk in its text."""
        places = []
        for text, p in zip(texts, parts):
            if self.keeps_space or len(p) == 1 and p[0] is text:
                lengths = np.fromiter(map(len, p), np.int64, len(p))
                places.append(np.cumsum(lengths) - lengths)
            else:
                places.append(np.fromiter((m.start() for m in self.pattern.finditer(text)), np.int64, len(p)))
        return np.concatenate(places) if places else np.zeros(0, np.int64)


def _twice(a: np.ndarray) -> np.ndarray:
    return np.concatenate([a, np.zeros_like(a)])


def encoder(vocabulary: str, spans: bool = False) -> Encoder:
    """This worker's encoder: its chunks stay known from task to task."""
    key = (vocabulary, spans)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(vocabulary, spans)
    return _ENCODERS[key]


def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Record batches cut to bounded size, with their texts; null as empty."""
    for whole in rows:
        texts = ["" if t is None else t for t in whole.column("text").to_pylist()]
        start = chars = 0
        for i, t in enumerate(texts):
            chars += len(t)
            if chars >= BATCH_CHARS or i + 1 - start >= BATCH_ROWS or i + 1 == len(texts):
                yield whole.slice(start, i + 1 - start), texts[start : i + 1]
                start, chars = i + 1, 0
