"""Re-Pair: a sequence of ids as a grammar, built in rounds over arrays.

A round counts all neighbouring pairs, replaces those above its threshold by new symbols (nonterminals),
left to right where they overlap, and lowers the threshold. A rule is (left, right); its
expansion length tells how many ids it stands for, so any range of the sequence is decoded from the symbols that
cover it alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ethospark.llm.token_ids import ragged

_MULTIPLIERS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77))  # odd, of no other meaning


@dataclass
class Grammar:
    """``symbols`` below ``base`` are ids, symbol ``base + k`` is the pair ``rules[k]``."""

    base: int
    rules: np.ndarray  # (k, 2) symbols
    lengths: np.ndarray  # (k,) ids a rule stands for
    symbols: np.ndarray

    def _sizes(self, symbols: np.ndarray) -> np.ndarray:
        if not len(self.lengths):
            return np.ones(len(symbols), np.int64)
        return np.where(symbols < self.base, 1, self.lengths[np.maximum(symbols - self.base, 0)])

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        while True:
            pairs = symbols >= self.base
            if not pairs.any():
                return symbols
            at = np.cumsum(1 + pairs) - 1 - pairs  # where a symbol's expansion begins
            grown = np.empty(len(symbols) + int(pairs.sum()), symbols.dtype)
            grown[at] = symbols
            both = self.rules[symbols[pairs] - self.base]
            grown[at[pairs]], grown[at[pairs] + 1] = both[:, 0], both[:, 1]
            symbols = grown

    def decode(self) -> np.ndarray:
        """All ids: every rule is expanded once, then gathered."""
        if not len(self.rules):
            return self.symbols
        all_rules = self._expand(np.arange(self.base, self.base + len(self.rules), dtype=self.symbols.dtype))
        ends = np.cumsum(self.lengths)
        pool = np.concatenate([all_rules, self.symbols])  # terminals are gathered from the sequence itself
        terminal = self.symbols < self.base
        rule = np.maximum(self.symbols - self.base, 0)
        starts = np.where(terminal, len(all_rules) + np.arange(len(self.symbols)), (ends - self.lengths)[rule])
        return pool[ragged(starts, self._sizes(self.symbols))]

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop``: only the symbols that cover them are expanded."""
        ends = np.cumsum(self._sizes(self.symbols))
        first = int(np.searchsorted(ends, start, "right"))
        last = int(np.searchsorted(ends, stop, "left"))
        skip = start - (int(ends[first - 1]) if first else 0)
        return self._expand(self.symbols[first : last + 1])[skip : skip + stop - start]


def _replaced(symbols: np.ndarray, threshold: int, new: int) -> tuple[np.ndarray, np.ndarray]:
    """(symbols with frequent pairs replaced by ``new``, ``new`` + 1 …, those pairs)."""
    none = np.zeros((0, 2), symbols.dtype)
    if len(symbols) < 2:
        return symbols, none
    a, b = symbols[:-1], symbols[1:]
    buckets_log2 = 16 if threshold >= 256 else 18 if threshold >= 16 else 20  # few counters stay in the cache
    bucket = a.view(np.uint32) * _MULTIPLIERS[0]
    bucket += b.view(np.uint32) * _MULTIPLIERS[1]
    bucket >>= np.uint32(32 - buckets_log2)
    bucket = bucket.astype(np.intp)
    often = np.bincount(bucket, minlength=1 << buckets_log2) >= threshold
    at = np.flatnonzero(often.take(bucket))  # a superset: pairs may share a bucket
    if not len(at):
        return symbols, none
    ordered, at = _in_pair_order(a, b, at)
    begins = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    counts = np.diff(begins, append=len(ordered))
    use = counts >= threshold
    at, begins, counts = at[np.repeat(use, counts)], begins[use], counts[use]
    pair_at = np.full(len(symbols), -1, np.int32)
    pair_at[at] = np.repeat(np.arange(len(begins), dtype=np.int32), counts)
    at = np.flatnonzero(pair_at >= 0)
    pair = pair_at[at]
    # of overlapping places in a row, every other one
    first = np.concatenate([[True], at[1:] != at[:-1] + 1]) if len(at) else np.zeros(0, bool)
    run = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0)) if len(at) else np.zeros(0, np.int64)
    free = (np.arange(len(at)) - run) & 1 == 0
    at, pair = at[free], pair[free]
    left = np.bincount(pair, minlength=len(begins))
    worth = left[pair] >= 2  # overlaps may have left a pair alone
    at, pair = at[worth], pair[worth]
    used = np.flatnonzero(left >= 2)
    if not len(at):
        return symbols, none
    number = np.zeros(len(begins), symbols.dtype)
    number[used] = new + np.arange(len(used))
    stay = np.ones(len(symbols), bool)
    stay[at + 1] = False
    made = symbols.copy()
    made[at] = number[pair]
    chosen = ordered[begins[used]]
    return made[stay], np.stack([chosen >> 32, chosen & 0xFFFFFFFF], axis=1).astype(symbols.dtype)


def _in_pair_order(a: np.ndarray, b: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(left << 32 | right of the places ``at``, ascending; the places in that order). Pair and place are sorted as
    one number where they fit into it, which is faster than sorting places by pair."""
    bits, place = int(max(a.max(), b.max())).bit_length(), len(a).bit_length()
    keys = a[at].astype(np.int64)
    if 2 * bits + place > 63:
        keys = keys << 32 | b[at]
        order = np.argsort(keys)
        return keys[order], at[order]
    keys <<= bits
    keys |= b[at]
    keys <<= place
    keys |= at
    keys.sort()
    at = keys & ((1 << place) - 1)
    keys >>= place
    return (keys >> bits) << 32 | keys & ((1 << bits) - 1), at


def compress(ids: np.ndarray, least: int = 4, gain: float = 1 / 64) -> Grammar:
    """The grammar of ``ids`` (non-negative). Pairs found ``least`` times become rules, in rounds whose
    threshold falls by a factor of four, until a round at ``least`` shortens the sequence by less than ``gain``."""
    symbols = np.ascontiguousarray(ids, np.int32)
    base = int(symbols.max()) + 1 if len(symbols) else 0
    rules, lengths = [], np.zeros(0, np.int64)
    threshold = max(least, len(symbols) >> 8)
    while True:
        before, n_rules = len(symbols), len(lengths)
        symbols, pairs = _replaced(symbols, threshold, base + n_rules)
        if len(pairs):
            sizes = np.where(pairs < base, 1, lengths[np.maximum(pairs - base, 0)] if n_rules else 1)
            rules.append(pairs)
            lengths = np.concatenate([lengths, sizes.sum(axis=1)])
        if threshold == least and before - len(symbols) <= gain * before:
            break
        threshold = max(least, threshold >> 2)
    return Grammar(base, np.concatenate(rules) if rules else np.zeros((0, 2), np.int32), lengths, symbols)


def pack_numbers(x: np.ndarray) -> bytes:
    """Non-negative 32-bit numbers: one byte with the number of bits, the low halves as 16 bits
    (little-endian), then a plane of bits for each further bit."""
    bits = max(16, int(x.max()).bit_length()) if len(x) else 16
    planes = [np.packbits((x >> k & 1).astype(np.uint8)).tobytes() for k in range(16, bits)]
    return bytes([bits]) + (x & 0xFFFF).astype("<u2").tobytes() + b"".join(planes)


def unpack_numbers(data: bytes, n: int) -> np.ndarray:
    x = np.frombuffer(data, "<u2", n, 1).astype(np.int32)
    plane, at = (n + 7) // 8, 1 + 2 * n
    for k in range(16, data[0]):
        bits = np.unpackbits(np.frombuffer(data, np.uint8, plane, at), count=n)
        x |= bits.astype(np.int32) << np.int32(k)
        at += plane
    return x
