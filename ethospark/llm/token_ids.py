"""Token ids of whole texts: every distinct word of a slice is encoded once, ids are gathered by word.

The pattern of byte-level BPE always begins a token at white space that follows something else, so
texts are cut there, on the UTF-8 bytes of an Arrow batch. Words are dictionary-encoded, words not met
before are encoded together (token boundaries fall on word boundaries by the same rule), and the
ids of all texts are one ragged gather. Only cuts that are certain are made: after a byte that can
end one of Unicode's wide spaces a text is not cut, which costs a larger word and nothing else.

Merging uses ``tiktoken`` with the vocabulary of the tokenizer file. Strings of its special tokens are
ordinary text, or with ``special`` those tokens, as the tokenizer reads them unless told otherwise.
A null text is empty. Memory is bounded by the slice (``SLICE_BYTES`` or one text) and the table of
words (``TABLE_BYTES`` of words, then it starts anew).
"""

from __future__ import annotations

import json
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ethospark.llm.text import utf8

SLICE_BYTES = 8 << 20
TABLE_BYTES = 6 << 20
#: Fixed value: the pattern of byte-level BPE that splits a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_PLAIN = np.zeros(256, bool)  # bytes that are no white space by themselves
_PLAIN[0x21:0x7F] = True
_SOLID = _PLAIN.copy()  # last bytes of words that surely end in no white space
_LEADS = np.zeros(256, bool)  # first bytes of the characters among which wide spaces are
_LEADS[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_BLANK, _SURE = _SPACE.tolist(), _SOLID.tolist()  # for single bytes: lists are read faster


def _byte_of() -> dict[str, int]:
    """Characters that stand for bytes in the vocabulary: printable ones for themselves, the others
    for those from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


def _cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte offsets where words begin, and the end: text starts, and sure spaces after something."""
    n = len(data)
    begins = np.zeros(n + 1, bool)
    if n > 1:
        before = data[:-1]
        sure = _PLAIN[before]
        wide = np.flatnonzero((before >= 0x80) & _SPACE[data[1:]])  # ends of longer characters before a space
        if len(wide):
            lead = _LEADS[data[np.maximum(wide - 1, 0)]] | _LEADS[data[np.maximum(wide - 2, 0)]]
            sure[wide[~lead]] = True
        begins[1:n] = sure & _SPACE[data[1:]]
    begins[offsets] = True
    return np.flatnonzero(begins)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes of all elements of the given runs, one run after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if total and max(total, int(starts.max()) + total) < 1 << 31 else np.int64
    return np.repeat((starts - (ends - lengths)).astype(kind), lengths) + np.arange(total, dtype=kind)


def _slices(words: pa.Array) -> list[bytes]:
    """The values of a large binary array without nulls; many times faster than ``to_pylist``."""
    offsets = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, 8 * words.offset)
    data, offsets = words.buffers()[2].slice(int(offsets[0])).to_pybytes(), (offsets - offsets[0]).tolist()
    return [data[a:b] for a, b in zip(offsets, offsets[1:])]


class TokenIds:
    """Ids by one byte-level BPE file; keeps the ids of the words it met."""

    _loaded: dict[str, TokenIds] = {}

    @classmethod
    def load(cls, path: str) -> TokenIds:
        """One for each Python worker."""
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        added, byte_of = {t["content"]: t["id"] for t in spec["added_tokens"]}, _byte_of()
        self.special = added
        self.special_parts = re.compile(
            "(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")" if added else "(?!)"
        )
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
        self.bpe = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.token_bytes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.token_bytes[i] = len(token)
        self._forget()

    def _forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.table_bytes = self.used = 0
        self.ids = np.zeros(1 << 16, np.int32)
        self.starts, self.lengths = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _append(self, words: list[bytes]) -> np.ndarray:
        """Places of new words, encoded in one go; what begins without or ends in white space stands at an end of a
        text and is encoded alone, for its tokens depend on that end."""
        alone = np.fromiter((not w or not _BLANK[w[0]] or not _SURE[w[-1]] for w in words), bool, len(words))
        order = np.argsort(alone, kind="stable")  # those alone come last
        words = [words[i] for i in order.tolist()]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        n_joined = len(words) - int(alone.sum())
        joined = self.bpe.encode_to_numpy(b"".join(words[:n_joined]).decode(), disallowed_special=()).astype(np.int32)
        single = [self.bpe.encode_ordinary(w.decode()) for w in words[n_joined:]]
        ids = np.concatenate([joined, np.array([i for w in single for i in w], np.int32)])
        ends = np.searchsorted(np.cumsum(self.token_bytes[joined]), np.cumsum(sizes[:n_joined])) + 1
        lengths = np.concatenate([np.diff(ends, prepend=0), [len(w) for w in single]]).astype(np.int64)
        n, known = len(ids), len(self.place)
        while self.used + n > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while known + len(words) > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.lengths = np.concatenate([self.lengths, np.zeros_like(self.lengths)])
        self.ids[self.used : self.used + n] = ids
        self.lengths[known : known + len(words)] = lengths
        self.starts[known : known + len(words)] = self.used + np.cumsum(lengths) - lengths
        self.used += n
        self.place.update(zip(words, range(known, known + len(words))))
        self.table_bytes += int(sizes.sum())
        places = np.empty(len(words), np.int64)
        places[order] = known + np.arange(len(words))
        return places

    def encode(self, texts: pa.Array, special: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of the texts in them) of a string column."""
        if special and self.special and any(pc.any(pc.match_substring(texts, t)).as_py() for t in self.special):
            return self._with_special(texts)
        data, offsets = utf8(texts)
        cuts = _cuts(data, offsets)
        if len(cuts) < 2:
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        words = pa.Array.from_buffers(
            pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
        )
        coded = pc.dictionary_encode(words)
        distinct = _slices(coded.dictionary)
        if self.table_bytes > TABLE_BYTES:
            self._forget()
        places = np.fromiter(map(self.place.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(places < 0)
        if len(new):
            places[new] = self._append([distinct[i] for i in new.tolist()])
        at = places[coded.indices.to_numpy(zero_copy_only=False)]
        lengths = self.lengths[at]
        ids = self.ids[ragged(self.starts[at], lengths)]
        before = np.concatenate([[0], np.cumsum(lengths)])
        return ids, before[np.searchsorted(cuts, offsets)]

    def _with_special(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Texts cut at special tokens; what is between them is encoded by itself."""
        rows = [self.special_parts.split(t or "") for t in texts.to_pylist()]
        flat = [x for row in rows for x in row]
        ids, offsets = self.encode(pa.array(["" if x in self.special else x for x in flat], pa.large_string()))
        marks = np.array([self.special.get(x, -1) for x in flat])
        ids = np.insert(ids, offsets[:-1][marks >= 0], marks[marks >= 0])
        offsets = offsets + np.concatenate([[0], np.cumsum(marks >= 0)])
        return ids, offsets[np.concatenate([[0], np.cumsum([len(row) for row in rows])])]


def with_end(ids: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The end id after each text."""
    return np.insert(ids, offsets[1:], end_id), offsets + np.arange(len(offsets))
