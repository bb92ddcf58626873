"""LZW with codes of 9 to 12 bits, most significant bit first."""

from __future__ import annotations

import numpy as np

from vellumspark.codecs.text import CodecError

CLEAR, END, FIRST, MOST_BITS = 256, 257, 258, 12


def _widths(early: int) -> np.ndarray:
    """The width of each code after a clear code, by its place."""
    free = np.arange(FIRST, (1 << MOST_BITS) + 2) + early
    return np.minimum(9 + sum((free > 1 << w).astype(np.int64) for w in range(9, MOST_BITS)), MOST_BITS)


_WIDTHS = {early: _widths(early) for early in (0, 1)}


def _packed(codes: list[int], widths: np.ndarray) -> bytes:
    bits = (np.array(codes, np.uint16)[:, None] >> np.arange(MOST_BITS - 1, -1, -1, dtype=np.uint16)) & 1
    used = np.arange(MOST_BITS - 1, -1, -1) < widths[:, None]
    return np.packbits(bits.astype(np.uint8)[used]).tobytes()


def encode(data: bytes, early: int = 1) -> bytes:
    """early: 1 if codes widen one code before they must, else 0."""
    table, most = _WIDTHS[early], (1 << MOST_BITS) - early
    codes, widths = [CLEAR], [table[:1]]
    # a node for each code: the nodes of longer strings by their next byte, its own code at -1
    roots = [{-1: i} for i in range(256)]
    free, node, begun = FIRST, None, 1
    put = codes.append
    for c in data:
        if node is None:
            node = roots[c]
            continue
        longer = node.get(c)
        if longer is not None:
            node = longer
            continue
        put(node[-1])
        node[c] = {-1: free}
        free += 1
        node = roots[c]
        if free >= most:
            put(c)
            put(CLEAR)
            n = len(codes) - begun - 1
            widths += [table[:n], table[n - 1 : n]]
            roots = [{-1: i} for i in range(256)]
            free, node, begun = FIRST, None, len(codes)
    if node is not None:
        put(node[-1])
    put(END)
    widths.append(table[: len(codes) - begun])
    return _packed(codes, np.concatenate(widths))


def decode(data: bytes, early: int = 1) -> bytes:
    out: list[bytes] = []
    first = [bytes([i]) for i in range(256)] + [b"", b""]
    table, held, most = first.copy(), FIRST, 1 << MOST_BITS
    width, last, limit = 9, b"", (1 << 9) - 1 - early
    bits = n = at = 0
    size = len(data)
    while True:
        while n < width:
            if at >= size:
                raise CodecError("no end code")
            bits, n, at = bits << 8 | data[at], n + 8, at + 1
        n -= width
        code = bits >> n
        bits &= (1 << n) - 1
        if code == END:
            return b"".join(out)
        if code == CLEAR:
            table, held = first.copy(), FIRST
            width, last, limit = 9, b"", (1 << 9) - 1 - early
            continue
        if code < held:
            entry = table[code]
        elif code == held and last:
            entry = last + last[:1]
        else:
            raise CodecError("an unknown code")
        out.append(entry)
        if last and held < most:
            table.append(last + entry[:1])
            held += 1
        last = entry
        # the encoder is one entry ahead
        if held > limit and width < MOST_BITS:
            width += 1
            limit = (1 << width) - 1 - early
