"""Canonical length-limited Huffman codes for token ids, with coding and decoding of many blocks at once in numpy."""

from __future__ import annotations

import numpy as np

LIMIT = 16
#: Ids between two checkpoints. A checkpoint holds the bits of its ids: LIMIT * STEP fits into 16 bits.
STEP = 64


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Bits per symbol that minimise the total for ``counts`` with no code above ``limit``; 0 for unused symbols.

    Package-merge: the list of each level merges the symbols with pairs of the list below; the 2n - 2 cheapest items of
    the top list say how often each symbol is used, which is its code length.
    """
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) == 0:
        return lengths
    if len(used) == 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols need codes of more than {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    leaf_before = []  # for each level: how many of its first k items are symbols
    items = weights
    for level in range(limit):
        if level:
            pairs = items[: len(items) // 2 * 2].reshape(-1, 2).sum(1)
            both = np.concatenate([weights, pairs])
            rank = np.argsort(both, kind="stable")
            items = both[rank]
            leaf_before.append(np.append(0, np.cumsum(rank < len(weights))))
        else:
            leaf_before.append(np.arange(len(weights) + 1))
    take = 2 * len(order) - 2
    for leaves in reversed(leaf_before):
        symbols = int(leaves[take])
        lengths[order[:symbols]] += 1
        take = 2 * (take - symbols)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then of symbol: lengths alone give them back."""
    codes = np.zeros(len(lengths), np.uint32)
    code = before = 0
    for symbol in np.lexsort((np.arange(len(lengths)), lengths)).tolist():
        n = int(lengths[symbol])
        if n == 0:
            continue
        code = (code + 1) << (n - before) if before else 0
        before = n
        codes[symbol] = code
    return codes


def decode_table(lengths: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """For every ``limit`` bits: the symbol whose code they start with, and its length."""
    codes = canonical_codes(lengths)
    symbols = np.zeros(1 << limit, np.uint32)
    sizes = np.zeros(1 << limit, np.int64)
    for s in np.flatnonzero(lengths).tolist():
        n = int(lengths[s])
        low = int(codes[s]) << (limit - n)
        symbols[low : low + (1 << (limit - n))] = s
        sizes[low : low + (1 << (limit - n))] = n
    return symbols, sizes


def encode_block(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, bytes]:
    """(bits, checkpoints): the codes in a row, and the bits of every ``STEP`` ids as little-endian 16-bit numbers."""
    if len(ids) == 0:
        return b"", b""
    sizes = lengths[ids].astype(np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    words = int(ends[-1] + 31) // 32
    value = codes[ids].astype(np.uint64) << (64 - (starts & 31) - sizes).astype(np.uint64)
    word = starts >> 5
    # Codes in one word share no bits, so sums below 2^32 in doubles are exact.
    high = np.bincount(word, (value >> np.uint64(32)).astype(np.float64), words + 1)
    low = np.bincount(word + 1, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), words + 1)
    packed = (high + low).astype(np.uint32)[:words].astype(">u4").tobytes()
    marks = np.append(ends[STEP - 1 : -1 : STEP], ends[-1])
    return packed[: int(ends[-1] + 7) // 8], np.diff(marks, prepend=0).astype("<u2").tobytes()


def decode_blocks(bits: list[bytes], checkpoints: list[bytes], counts: list[int],
                  table: tuple[np.ndarray, np.ndarray], limit: int = LIMIT) -> list[np.ndarray]:
    """Ids of several blocks. Every checkpoint of every block is a lane; all lanes take one table step at a time."""
    symbols, sizes = table
    raw = np.frombuffer(b"".join(bits) + b"\0" * 4, np.uint8).astype(np.uint32)
    window = (raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]  # 24 bits from every byte on
    base = np.cumsum([0] + [len(b) for b in bits])[:-1] * 8
    lanes, left = [], []
    for start, marks, n in zip(base.tolist(), checkpoints, counts):
        widths = np.frombuffer(marks, "<u2").astype(np.int64)
        lanes.append(start + np.cumsum(widths) - widths)
        own = np.full(len(widths), STEP, np.int64)
        if n:
            own[-1] = n - STEP * (len(widths) - 1)
        left.append(own)
    at = np.concatenate(lanes) if lanes else np.zeros(0, np.int64)
    left_all = np.concatenate(left) if left else np.zeros(0, np.int64)
    out = np.zeros((len(at), STEP), np.uint32)
    shift, mask = 24 - limit, (1 << limit) - 1
    for step in range(STEP):
        key = (window[np.minimum(at >> 3, len(window) - 1)] >> (shift - (at & 7)).astype(np.uint32)) & mask
        out[:, step] = symbols[key]
        at = at + sizes[key]
    flat = out[np.arange(STEP) < left_all[:, None]]
    return np.split(flat, np.cumsum(counts)[:-1]) if counts else []
