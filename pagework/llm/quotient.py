"""Counting quotient filters over packed n-grams, as sorted blocks (operator 13).

A key of 2 * half bits is permuted without loss (Feistel rounds), so that its
leading bits are spread evenly.  The leading ``lead`` bits name the block, the
next ones are the quotient, and the whole rest is kept as the remainder: nothing
is hashed away, and every key can be computed back.

A block is written as a counting quotient filter writes its slots: one bit per
quotient says whether it is occupied, one bit per entry whether its run ends
there, then the remainders, one bit per entry that counts more than once, and
those counts.  Filters of one block are merged in the order of their keys; the
quotient of the merged filter may take more bits, since remainders are full.
"""

from __future__ import annotations

import struct

import numpy as np

ROUNDS = 4
HEADER = struct.Struct("<QBBBB")  # entries, half, lead, quotient bits, bytes of a count
U = np.uint64


def _round(x: np.ndarray, number: int, half: int) -> np.ndarray:
    """Bits of x and the round's number, mixed: any function will do."""
    x = (x + U(number + 1)) * U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(29))) * U(0xD6E8FEB86659FD93)
    return (x ^ (x >> U(32))) & U((1 << half) - 1)


def permute(high: np.ndarray, low: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """A one-to-one map of keys, given as two numbers of ``half`` bits each."""
    for number in range(ROUNDS):
        high, low = low, high ^ _round(low, number, half)
    return high, low


def restore(high: np.ndarray, low: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    for number in reversed(range(ROUNDS)):
        high, low = low ^ _round(high, number, half), high
    return high, low


def count_sorted(high: np.ndarray, low: np.ndarray, counts: np.ndarray | None, half: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys in order, with their counts (None: one each) added up."""
    if 2 * half <= 64:
        key = high << U(half) | low
        order = np.argsort(key, kind="stable")  # merges what is sorted already
        key = key[order]
        new = key[1:] != key[:-1]
    else:
        order = np.lexsort((low, high))
        high, low = high[order], low[order]
        new = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
    first = np.flatnonzero(np.concatenate([[True], new])) if len(order) else np.empty(0, np.int64)
    if counts is None:
        sums = np.diff(np.append(first, len(order))).astype(np.uint64)
    else:
        sums = np.add.reduceat(counts[order], first) if len(order) else counts
    if 2 * half <= 64:
        key = key[first]
        return key >> U(half), key & U((1 << half) - 1), sums
    return high[first], low[first], sums


def _width(bits: int) -> str:
    return "<u1" if bits <= 8 else "<u2" if bits <= 16 else "<u4" if bits <= 32 else "<u8"


def write(high: np.ndarray, low: np.ndarray, counts: np.ndarray, half: int, lead: int) -> bytes:
    """A block: sorted distinct keys whose first ``lead`` bits are the same."""
    n = len(high)
    # About one quotient per entry.
    bits = min(half - lead, max(n - 1, 0).bit_length())
    rest = half - lead - bits
    quotient = (high >> U(rest)) & U((1 << bits) - 1)
    occupied = np.zeros(1 << bits, bool)
    occupied[quotient] = True
    ends = np.ones(n, bool)
    ends[:-1] = quotient[1:] != quotient[:-1]
    many = counts > 1
    more = counts[many]
    size = int(_width(int(more.max()).bit_length() if len(more) else 1)[2:])
    parts = [
        HEADER.pack(n, half, lead, bits, size), np.packbits(occupied).tobytes(), np.packbits(ends).tobytes(),
        (high & U((1 << rest) - 1)).astype(_width(rest)).tobytes() if rest else b"", low.astype(_width(half)).tobytes(),
        np.packbits(many).tobytes(), more.astype(f"<u{size}").tobytes(),
    ]
    return b"".join(parts)


def read(data: bytes, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys and counts of a block, in order."""
    n, half, lead, bits, size = HEADER.unpack_from(data)
    at, rest = HEADER.size, half - lead - bits

    def take(count: int, kind: str) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, count, at)
        at += out.nbytes
        return out

    def flags(count: int) -> np.ndarray:
        return np.unpackbits(take(-(-count // 8), "u1"), count=count).astype(bool)

    quotients = np.flatnonzero(flags(1 << bits)).astype(np.uint64)
    ends = flags(n)
    run = np.concatenate([[0], np.cumsum(ends)[:-1]]) if n else np.empty(0, np.int64)
    high = (U(block) << U(bits) | quotients[run]) << U(rest)
    if rest:
        high |= take(n, _width(rest)).astype(np.uint64)
    low = take(n, _width(half)).astype(np.uint64)
    counts = np.ones(n, np.uint64)
    many = flags(n)
    counts[many] = take(int(many.sum()), f"<u{size}")
    return high, low, counts


def blocks(high: np.ndarray, low: np.ndarray, counts: np.ndarray, half: int, lead: int) -> list[tuple[int, bytes]]:
    """A sorted filter as its blocks (number, bytes)."""
    number = (high >> U(half - lead)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]])) if len(number) else []
    out = []
    for a, b in zip(first, [*first[1:], len(number)], strict=True):
        out.append((int(number[a]), write(high[a:b], low[a:b], counts[a:b], half, lead)))
    return out


def merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], half: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Several sorted filters of one block as one."""
    return count_sorted(*(np.concatenate(x) for x in zip(*parts, strict=True)), half)
