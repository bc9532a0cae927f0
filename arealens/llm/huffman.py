"""Length-limited canonical Huffman code, packing and table-driven decoding of token ids.

A code is given by its lengths alone: symbols ordered by (length, id) take consecutive codes. Ids are
packed most significant bit first in blocks of BLOCK ids; the bit offset of each block is kept, so blocks
are decoded independently and here all at once, one table look-up a step for each of them.
"""

from __future__ import annotations

import numpy as np

BLOCK = 256
LIMIT = 20  # longest code in bits; the decoding table has 2**LIMIT entries


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits by package-merge; symbols that never occur have length 0."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols need codes of more than {limit} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    weights = counts[used].astype(np.float64)
    is_leaf, current = [], weights
    flags = np.ones(len(weights), bool)
    for _ in range(limit):
        is_leaf.append(flags)
        pairs = current[: len(current) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weights, pairs])
        order = np.argsort(both, kind="stable")
        current, flags = both[order], order < len(weights)
    taken = 2 * len(weights) - 2
    for flags in reversed(is_leaf):
        leaves = int(flags[:taken].sum())
        lengths[used[:leaves]] += 1
        taken = 2 * (taken - leaves)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    codes = np.zeros(len(lengths), np.uint32)
    code = last = 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    for s in order[lengths[order] > 0]:
        code <<= int(lengths[s]) - last
        last = int(lengths[s])
        codes[s] = code
        code += 1
    return codes


def decoding_table(lengths: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and length for every value of the next ``limit`` bits."""
    symbols, widths = np.zeros(1 << limit, np.uint32), np.ones(1 << limit, np.uint8)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    spans = 1 << (limit - lengths[order].astype(np.int64))
    n = int(spans.sum())
    symbols[:n], widths[:n] = np.repeat(order, spans), np.repeat(lengths[order], spans)
    return symbols, widths


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Payload (big-endian 32-bit words) and the bit offset of each block."""
    if not len(ids):
        return b"", np.zeros(0, np.int64)
    widths = lengths[ids].astype(np.int64)
    ends = np.cumsum(widths)
    starts = ends - widths
    word = starts >> 5
    shifted = codes[ids].astype(np.uint64) << (64 - (starts & 31) - widths).astype(np.uint64)
    at = np.flatnonzero(np.diff(word, prepend=-1))
    out = np.zeros((int(ends[-1]) >> 5) + 2, np.uint32)
    out[word[at]] |= np.bitwise_or.reduceat((shifted >> np.uint64(32)).astype(np.uint32), at)
    out[word[at] + 1] |= np.bitwise_or.reduceat(shifted.astype(np.uint32), at)
    return out.astype(">u4").tobytes(), starts[::BLOCK]


def unpack(payload: bytes, n: int, offsets: np.ndarray, table: tuple[np.ndarray, np.ndarray], limit: int = LIMIT) -> np.ndarray:
    """The ``n`` ids of a payload."""
    if not n:
        return np.zeros(0, np.uint32)
    symbols, widths = table
    words = np.concatenate([np.frombuffer(payload, ">u4").astype(np.uint64), np.zeros(BLOCK * limit // 32 + 2, np.uint64)])
    pairs = (words[:-1] << np.uint64(32)) | words[1:]
    at, mask = offsets.astype(np.int64).copy(), (1 << limit) - 1
    out = np.empty((BLOCK, len(at)), np.uint32)
    for step in range(min(BLOCK, n)):
        bits = (pairs[at >> 5] >> (64 - limit - (at & 31)).astype(np.uint64)).astype(np.int64) & mask
        out[step] = symbols[bits]
        at += widths[bits]
    return out.T.reshape(-1)[:n]
