"""Golomb-coded sorted sets of fingerprints, with power-of-two parameters (Rice).

The gaps of a sorted set of uniform fingerprints are nearly geometric, for which
Golomb codes are optimal. The unary quotients and the fixed-width remainders go to
two streams, so that both directions are whole-array numpy operations.
"""

from __future__ import annotations

import numpy as np


def parameter(n: int, universe_bits: float) -> int:
    """Remainder width for n sorted values below 2**universe_bits."""
    if n == 0:
        return 0
    mean_gap = 2.0**universe_bits / n
    return int(max(0, min(62, np.floor(np.log2(max(1.0, 0.69 * mean_gap))))))


def encode(values: np.ndarray, universe_bits: float) -> tuple[int, bytes]:
    """values: sorted, distinct, unsigned. Gives the parameter and the bytes."""
    n = len(values)
    k = parameter(n, universe_bits)
    if n == 0:
        return k, b""
    gaps = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    quotients = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(quotients + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1, np.uint8)
    unary[ends] = 1
    head = np.packbits(unary).tobytes()
    if not k:
        return k, len(head).to_bytes(8, "little") + head
    return k, len(head).to_bytes(8, "little") + head + pack(gaps & np.uint64((1 << k) - 1), k)


def decode(n: int, k: int, code: bytes) -> np.ndarray:
    """The n values that encode() was given, as uint64."""
    if n == 0:
        return np.zeros(0, np.uint64)
    size = int.from_bytes(code[:8], "little")
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(code, np.uint8, size, 8)))[:n]
    gaps = (np.diff(ends, prepend=-1) - 1).astype(np.uint64) << np.uint64(k)
    if k:
        gaps |= unpack(code[8 + size :], k, n)
    return np.cumsum(gaps, dtype=np.uint64)


def encode_runs(values: np.ndarray, edges: np.ndarray, universe_bits: float) -> tuple[int, list[tuple[int, bytes]]]:
    """Many sets at once, values[edges[i]:edges[i + 1]] each as encode() has them, of about equal density.

    Gives the parameter of all, and for each set the bytes of its quotients and its code. For
    sets of a few hundred values, what a call costs is more than what it codes.
    """
    sizes = np.diff(edges)
    if not len(values):
        return 0, [(0, b"")] * len(sizes)
    k = parameter(int(sizes.max()), universe_bits)
    own = np.flatnonzero(sizes)
    first, sizes_of = edges[:-1][own], sizes[own]
    gaps = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    gaps[first] = values[first]
    ends = np.cumsum((gaps >> np.uint64(k)).astype(np.int64) + 1)  # in one stream without bounds
    last = ends[first + sizes_of - 1]
    bits = np.diff(last, prepend=0)
    heads = np.append(0, np.cumsum((bits + 7) // 8))
    unary = np.zeros(int(heads[-1]) * 8, np.uint8)
    unary[ends - 1 + np.repeat(heads[:-1] * 8 - (last - bits), sizes_of)] = 1
    head = np.packbits(unary).tobytes()
    tails = np.append(0, np.cumsum((sizes_of * k + 7) // 8))
    words = np.zeros(int(tails[-1]) // 8 + 2, "<u8")
    if k:
        place = np.repeat(tails[:-1] * 8 - (first - first[0]) * k, sizes_of) + np.arange(len(values)) * k
        word, shift, rest = place >> 6, (place & 63).astype(np.uint64), gaps & np.uint64((1 << k) - 1)
        np.bitwise_or.at(words, word, rest << shift)
        over = np.flatnonzero(shift + np.uint64(k) > 64)
        np.bitwise_or.at(words, word[over] + 1, rest[over] >> (np.uint64(64) - shift[over]))
    tail = words.tobytes()
    out = [(0, b"")] * len(sizes)
    heads, tails = heads.tolist(), tails.tolist()
    for j, i in enumerate(own.tolist()):
        out[i] = heads[j + 1] - heads[j], head[heads[j] : heads[j + 1]] + tail[tails[j] : tails[j + 1]]
    return k, out


def decode_runs(sizes: np.ndarray, ks: np.ndarray, heads: np.ndarray, codes: list[bytes]) -> np.ndarray:
    """The values of all sets, one after the other: how many each has, its parameter, the bytes of its quotients, its code."""
    if not sizes.sum():
        return np.zeros(0, np.uint64)
    first = np.cumsum(sizes) - sizes
    unary = np.frombuffer(b"".join([c[:h] for c, h in zip(codes, heads.tolist(), strict=True)]), np.uint8)
    ones = np.flatnonzero(np.unpackbits(unary))
    before = np.append(-1, ones[:-1])
    own = np.flatnonzero(sizes)
    before[first[own]] = (np.cumsum(heads) - heads)[own] * 8 - 1
    k = np.repeat(ks, sizes)
    gaps = (ones - before - 1).astype(np.uint64) << k.astype(np.uint64)
    tail = b"".join([c[h:] for c, h in zip(codes, heads.tolist(), strict=True)])
    width = (sizes * ks + 7) // 8
    place = np.repeat((np.cumsum(width) - width) * 8 - first * ks, sizes) + np.arange(len(k)) * k
    words = np.zeros(len(tail) // 8 + 2, "<u8")
    words.view(np.uint8)[: len(tail)] = np.frombuffer(tail, np.uint8)
    word, shift = place >> 6, (place & 63).astype(np.uint64)
    rest = words[word] >> shift
    over = np.flatnonzero((shift > 0) & (place % 64 + k > 64))
    rest[over] |= words[word[over] + 1] << (np.uint64(64) - shift[over])
    gaps |= rest & ((np.uint64(1) << k.astype(np.uint64)) - np.uint64(1))
    total = np.cumsum(gaps, dtype=np.uint64)
    base = np.zeros(len(own), np.uint64)
    base[1:] = total[first[own][1:] - 1]
    return total - np.repeat(base, sizes[own])  # modulo 2**64, as the sums are


def pack(values: np.ndarray, width: int) -> bytes:
    """Unsigned values in width bits each, lowest bit first, one after the other.

    64 values fill exactly width words of 64 bits, so the work goes over columns of 64
    values: each is shifted to its place in all rows at once.
    """
    n = len(values)
    rows = -(-n // 64)
    columns = np.zeros(rows * 64, "<u8")
    columns[:n] = values
    columns = np.ascontiguousarray(columns.reshape(rows, 64).T)
    out = np.zeros((width, rows), "<u8")
    for j in range(min(64, n)):
        word, shift = divmod(j * width, 64)
        out[word] |= columns[j] << np.uint64(shift)
        if shift + width > 64:
            out[word + 1] |= columns[j] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T).tobytes()[: (n * width + 7) // 8]


def unpack(code: bytes, width: int, n: int, start: int = 0) -> np.ndarray:
    """n values from the start-th on; reads only the words that hold them."""
    if n <= 0:
        return np.zeros(0, np.uint64)
    first, skip = divmod(start, 64)
    rows = -(-(skip + n) // 64)
    raw = code[first * width * 8 : (first + rows) * width * 8]
    words = np.zeros(rows * width, "<u8")
    words.view(np.uint8)[: len(raw)] = np.frombuffer(raw, np.uint8)
    words = np.ascontiguousarray(words.reshape(rows, width).T)
    out, mask = np.zeros((64, rows), np.uint64), np.uint64((1 << width) - 1)
    for j in range(min(64, skip + n)):
        word, shift = divmod(j * width, 64)
        out[j] = words[word] >> np.uint64(shift)
        if shift + width > 64:
            out[j] |= words[word + 1] << np.uint64(64 - shift)
    return np.ascontiguousarray((out & mask).T).reshape(-1)[skip : skip + n]
