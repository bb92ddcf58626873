"""Group 3 (one- and two-dimensional) and group 4 fax codes.

A line is a list of change positions: where the colour flips, white first. k < 0: group 4; k = 0:
group 3 in one dimension; k > 0: group 3 where every k-th line has one dimension.
"""

from __future__ import annotations

import numpy as np

from vellumspark.codecs.text import CodecError

# Fixed values of the fax recommendations: codes of run lengths 0..63, then 64, 128, .. 1728 by
# colour, then 1792, 1856, .. 2560 of either, and of the modes of a two-dimensional line.
WHITE_SHORT = (
    "00110101 000111 0111 1000 1011 1100 1110 1111 10011 10100 00111 01000 001000 000011 110100 110101 101010 101011 0100111 0001100 "
    "0001000 0010111 0000011 0000100 0101000 0101011 0010011 0100100 0011000 00000010 00000011 00011010 00011011 00010010 00010011 "
    "00010100 00010101 00010110 00010111 00101000 00101001 00101010 00101011 00101100 00101101 00000100 00000101 00001010 00001011 "
    "01010010 01010011 01010100 01010101 00100100 00100101 01011000 01011001 01011010 01011011 01001010 01001011 00110010 00110011 00110100"
)
WHITE_LONG = (
    "11011 10010 010111 0110111 00110110 00110111 01100100 01100101 01101000 01100111 011001100 011001101 011010010 011010011 011010100 "
    "011010101 011010110 011010111 011011000 011011001 011011010 011011011 010011000 010011001 010011010 011000 010011011"
)
BLACK_SHORT = (
    "0000110111 010 11 10 011 0011 0010 00011 000101 000100 0000100 0000101 0000111 00000100 00000111 000011000 0000010111 0000011000 "
    "0000001000 00001100111 00001101000 00001101100 00000110111 00000101000 00000010111 00000011000 000011001010 000011001011 000011001100 "
    "000011001101 000001101000 000001101001 000001101010 000001101011 000011010010 000011010011 000011010100 000011010101 000011010110 "
    "000011010111 000001101100 000001101101 000011011010 000011011011 000001010100 000001010101 000001010110 000001010111 000001100100 "
    "000001100101 000001010010 000001010011 000000100100 000000110111 000000111000 000000100111 000000101000 000001011000 000001011001 "
    "000000101011 000000101100 000001011010 000001100110 000001100111"
)
BLACK_LONG = (
    "0000001111 000011001000 000011001001 000001011011 000000110011 000000110100 000000110101 0000001101100 0000001101101 0000001001010 "
    "0000001001011 0000001001100 0000001001101 0000001110010 0000001110011 0000001110100 0000001110101 0000001110110 0000001110111 "
    "0000001010010 0000001010011 0000001010100 0000001010101 0000001011010 0000001011011 0000001100100 0000001100101"
)
EXTRA_LONG = (
    "00000001000 00000001100 00000001101 000000010010 000000010011 000000010100 000000010101 000000010110 000000010111 000000011100 "
    "000000011101 000000011110 000000011111"
)
PASS, HORIZONTAL, END_OF_LINE = "0001", "001", "000000000001"
VERTICAL = {0: "1", 1: "011", 2: "000011", 3: "0000011", -1: "010", -2: "000010", -3: "0000010"}

WIDTH = 1728
_EXTRA = {64 * (28 + i): c for i, c in enumerate(EXTRA_LONG.split())}
_RUNS = [
    {**dict(enumerate(short.split())), **{64 * (i + 1): c for i, c in enumerate(long.split())}, **_EXTRA}
    for short, long in ((WHITE_SHORT, WHITE_LONG), (BLACK_SHORT, BLACK_LONG))
]
_READ_RUN = [{c: n for n, c in t.items()} for t in _RUNS]
_READ_MODE = {PASS: "P", HORIZONTAL: "H", **{c: v for v, c in VERTICAL.items()}}


def changes(row: np.ndarray) -> list[int]:
    """Change positions of an array of bits, the width last."""
    flips = np.flatnonzero(np.diff(np.concatenate([[0], row.astype(np.int8)])))
    return [*flips.tolist(), len(row)]


def row_of(line: list[int], width: int) -> np.ndarray:
    flips = np.zeros(width + 1, np.int8)
    flips[[x for x in line if x < width]] = 1
    return np.cumsum(flips[:width]) % 2


def _run(colour: int, n: int) -> str:
    out = []
    while n > 2560 + 63:
        out.append(_EXTRA[2560])
        n -= 2560
    if n > 63:
        out.append(_RUNS[colour][n // 64 * 64])
    out.append(_RUNS[colour][n % 64])
    return "".join(out)


def _line_1d(line: list[int]) -> str:
    ends = [0, *line]
    return "".join(_run(i % 2, b - a) for i, (a, b) in enumerate(zip(ends, ends[1:], strict=False)))


def _reference(above: list[int], a0: int, colour: int, width: int) -> tuple[int, int]:
    """b1 and b2: the first change above to the other colour right of a0, and the next one."""
    for i, x in enumerate(above):
        if i % 2 == colour and x > a0:
            return x, above[i + 1] if i + 1 < len(above) else width
    return width, width


def _line_2d(line: list[int], above: list[int], width: int) -> str:
    out, a0, colour = [], -1, 0
    while a0 < width:
        a1 = next((x for i, x in enumerate(line) if x > a0 and i % 2 == colour), width)
        b1, b2 = _reference(above, a0, colour, width)
        if b2 < a1:
            out.append(PASS)
            a0 = b2
        elif abs(a1 - b1) <= 3:
            out.append(VERTICAL[a1 - b1])
            a0, colour = a1, 1 - colour
        else:
            a2 = next((x for x in line if x > a1), width)
            out.append(HORIZONTAL + _run(colour, a1 - max(a0, 0)) + _run(1 - colour, a2 - a1))
            a0 = a2
    return "".join(out)


def encode_bits(rows: np.ndarray, k: int = -1) -> str:
    """Rows of bits (1 is black) to a text of code bits, end codes included, filled to whole bytes."""
    rows = np.atleast_2d(rows)
    width = rows.shape[1]
    above, out = [width], []
    for i, r in enumerate(rows if width else []):
        line = changes(r)
        if k < 0:
            out.append(_line_2d(line, above, width))
        elif k == 0:
            out.append(END_OF_LINE + _line_1d(line))
        elif i % k == 0:
            out.append(END_OF_LINE + "1" + _line_1d(line))
        else:
            out.append(END_OF_LINE + "0" + _line_2d(line, above, width))
        above = line
    out.append(END_OF_LINE * 2 if k < 0 else (END_OF_LINE + "1" * (k > 0)) * 7)
    bits = "".join(out)
    return bits + "0" * (-len(bits) % 8)


def encode(rows: np.ndarray, k: int = -1) -> bytes:
    bits = encode_bits(rows, k)
    return int(bits, 2).to_bytes(len(bits) // 8, "big")


class _Reader:
    def __init__(self, data: bytes):
        self.bits, self.at = "".join(f"{b:08b}" for b in data), 0

    def ahead(self, text: str) -> bool:
        if self.bits.startswith(text, self.at):
            self.at += len(text)
            return True
        return False

    def code(self, table: dict[str, object]):
        for n in range(1, 14):
            v = table.get(self.bits[self.at : self.at + n])
            if v is not None and self.at + n <= len(self.bits):
                self.at += n
                return v
        raise CodecError("an unknown fax code")

    def run(self, colour: int) -> int:
        total = 0
        while True:
            n = self.code(_READ_RUN[colour])
            total += n
            if n < 64:
                return total

    def end_of_line(self) -> bool:
        """An end-of-line code, maybe after fill."""
        at = self.bits.find("1", self.at)
        if at - self.at >= 11:
            self.at = at + 1
            return True
        return False


def _decode_1d(r: _Reader, width: int) -> list[int]:
    line, a0, colour = [], 0, 0
    while a0 < width:
        a0 += r.run(colour)
        line.append(a0)
        colour = 1 - colour
    if a0 != width:
        raise CodecError("a line is too long")
    return line


def _decode_2d(r: _Reader, above: list[int], width: int) -> list[int]:
    line: list[int] = []
    a0, colour = -1, 0
    while a0 < width:
        b1, b2 = _reference(above, a0, colour, width)
        mode = r.code(_READ_MODE)
        if mode == "P":
            a0 = b2
        elif mode == "H":
            for _ in range(2):
                a0 = max(a0, 0) + r.run(colour)
                line.append(a0)
                colour = 1 - colour
        else:
            a0 = b1 + mode
            line.append(a0)
            colour = 1 - colour
        if a0 > width:
            raise CodecError("a line is too long")
    return line if line and line[-1] == width else [*line, width]


def decode(data: bytes, width: int = WIDTH, k: int = -1, height: int = 0) -> np.ndarray:
    """Rows of bits up to the end codes, the end of the data, or `height` rows."""
    width = width if width > 0 else WIDTH
    r, above, out = _Reader(data), [width], []
    last = r.bits.rfind("1")  # only zeros follow
    while not height or len(out) < height:
        if r.at > last:
            break
        if k < 0:
            if r.ahead(END_OF_LINE):
                break
            line = _decode_2d(r, above, width)
        else:
            if not r.end_of_line():
                raise CodecError("no end-of-line code")
            one = k == 0 or r.ahead("1")
            if not one:
                r.at += 1
            if r.at > last or r.bits.startswith(END_OF_LINE, r.at):
                break
            line = _decode_1d(r, width) if one else _decode_2d(r, above, width)
        out.append(row_of(line, width))
        above = line
    return np.array(out, np.uint8).reshape(-1, width)
