"""Token ids of whole texts with the ``tokenizers`` library, inside Spark tasks.

A byte-level BPE never merges across a space that follows a byte which is not
white space, nor between an ASCII letter and an ASCII mark other than the
apostrophe, nor before or after a line feed between visible ASCII characters:
its pre-tokenizer always cuts there, and nothing it does to the
right of the cut depends on what stands to the left. Texts are therefore cut
at such places, each distinct segment is encoded once by the library,
and a document's ids are its segments' ids in order. The result equals the
library's ids of the whole text (tests compare them). Latin letters, with or
without a space before them, are one pre-token, which goes straight to the
library's model.
"""

from __future__ import annotations

import re
from codecs import charmap_decode
from functools import lru_cache

import numpy as np
import pyarrow as pa

from .arrays import byte_table, ragged

END_ID = 0
#: Distinct segments that a Python worker remembers between runs of documents: bounds memory, never changes ids.
MEMO_SEGMENTS = 200_000


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark schedules one task per core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
    return tokenizer


ASCII_LETTER = byte_table(lambda b: 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)
MARK = byte_table(lambda b: 0x21 <= b <= 0x7E and not chr(b).isalnum() and b != 0x27)
VISIBLE = byte_table(lambda b: 0x21 <= b <= 0x7E)
#: An optional space and ASCII letters or letters of U+00C0 to U+023F: one pre-token.
WORD = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4-\xc8][\x80-\xbf])+")


def _byte_level() -> str:
    """How the byte-level alphabet writes every byte."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    others = {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - set(own)))}
    return "".join(chr(others.get(b, b)) for b in range(256))


BYTE_LEVEL = _byte_level()


def segment_bounds(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte places where segments begin: each document's start, every safe space and line feed, and between letters and marks."""
    space = np.flatnonzero(data[1:] == 0x20) + 1 if len(data) else np.zeros(0, np.int64)
    previous = data[space - 1]
    safe = previous > 0x20
    # a white-space character of several bytes ends in a continuation byte
    two = data[np.maximum(space - 2, 0)]
    three = data[np.maximum(space - 3, 0)]
    wide = (previous >= 0x80) & (((two == 0xC2) & ((previous == 0x85) | (previous == 0xA0)))
                                 | (three == 0xE1) | (three == 0xE2) | (three == 0xE3))
    cut = np.zeros(len(data) + 1, bool)
    cut[space[safe & ~wide]] = True
    letter, mark = ASCII_LETTER[data], MARK[data]
    cut[1:-1] |= (letter[:-1] & mark[1:]) | (mark[:-1] & letter[1:])
    after = np.flatnonzero(mark[2:] & (data[1:-1] >= 0x80)) + 2  # marks after a letter of two bytes
    lead, last = data[after - 2], data[after - 1]
    cut[after[(lead >= 0xC4) & (lead <= 0xC8) | (lead == 0xC3) & (last != 0x97) & (last != 0xB7)]] = True
    line = np.flatnonzero(data[1:] == 0x0A) + 1 if len(data) else space
    line = line[VISIBLE[data[line - 1]]]
    cut[line] = True
    line = line[line + 1 < len(data)] + 1
    cut[line[VISIBLE[data[line]]]] = True
    cut[offsets] = True  # also where empty documents lie
    return np.flatnonzero(cut[:-1])


class SegmentEncoder:
    """Encodes runs of documents; a distinct segment of a run goes through the library once, one that is remembered not at all.

    After a run at most ``MEMO_SEGMENTS`` are remembered; where there are more, the half of that which most runs used stays.
    """

    def __init__(self, path: str):
        self.path = path
        self.place: dict[bytes, int] = {}
        self.ids = np.zeros(0, np.uint32)
        self.at = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)
        self.uses = np.zeros(0, np.int64)

    def forget(self, left: int):
        """Keep the ``left`` segments that most runs used."""
        kept = np.sort(np.argsort(-self.uses, kind="stable")[:left])
        segments = list(self.place)  # in the order of their numbers
        self.place = {segments[k]: i for i, k in enumerate(kept.tolist())}
        self.ids, self.length = ragged(self.ids, self.at[kept], self.length[kept]), self.length[kept]
        self.at = np.cumsum(self.length) - self.length
        self.uses = self.uses[kept] // 2

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): ids of document i are ``ids[bounds[i]:bounds[i + 1]]``."""
        cuts = segment_bounds(data, offsets)
        bounds = np.append(cuts, len(data)).astype(np.int64)
        segments = pa.Array.from_buffers(pa.large_binary(), len(cuts), [
            None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        distinct = segments.dictionary.to_pylist()
        new = [s for s in distinct if s not in self.place]
        if new:
            tokenizer = _tokenizer(self.path)
            tokenize = tokenizer.model.tokenize
            words, rest = [], []
            for s in new:
                (words if WORD.fullmatch(s) else rest).append(s)
            ids, length = [self.ids], [self.length]
            for k in range(0, len(words), 4096):
                marked = charmap_decode(b"\n".join(words[k:k + 4096]), "strict", BYTE_LEVEL)[0].split(BYTE_LEVEL[0x0A])
                part = list(map(tokenize, marked))
                length.append(np.fromiter(map(len, part), np.int64, len(part)))
                ids.append(np.array([t.id for tokens in part for t in tokens], np.uint32))
            for k in range(0, len(rest), 4096):
                part = [e.ids for e in tokenizer.encode_batch([s.decode("utf-8") for s in rest[k:k + 4096]], add_special_tokens=False)]
                length.append(np.fromiter(map(len, part), np.int64, len(part)))
                ids.append(np.array([i for some in part for i in some], np.uint32))
            self.place.update(zip(words + rest, range(len(self.at), len(self.at) + len(new))))
            self.ids, self.length = np.concatenate(ids), np.concatenate(length)
            self.at = np.cumsum(self.length) - self.length
            self.uses = np.append(self.uses, np.zeros(len(new), np.int64))
        where = np.fromiter(map(self.place.__getitem__, distinct), np.int64, len(distinct))
        self.uses[where] += 1
        where = where[segments.indices.to_numpy(zero_copy_only=False)] if len(cuts) else where[:0]
        sizes = self.length[where]
        total = np.zeros(len(sizes) + 1, np.int64)
        np.cumsum(sizes, out=total[1:])
        out = ragged(self.ids, self.at[where], sizes), total[np.searchsorted(cuts, offsets)]
        if len(self.place) > MEMO_SEGMENTS:
            self.forget(MEMO_SEGMENTS // 2)
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> SegmentEncoder:
    """The worker's encoder: workers are reused, so its memory serves later tasks too."""
    return SegmentEncoder(path)


def with_end(ids: np.ndarray, bounds: np.ndarray, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """Append ``end_id`` to every document."""
    return np.insert(ids, bounds[1:], end_id), bounds + np.arange(len(bounds))
