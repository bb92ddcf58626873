"""RC4 and AES-CBC in Python, for readers and writers of whole files. Columns use the native expressions of functions.values."""

from __future__ import annotations

import os


def rc4(key: bytes, data: bytes) -> bytes:
    if not 1 <= len(key) <= 256:
        raise ValueError("key of 1 to 256 bytes")
    s, j = list(range(256)), 0
    for i, k in enumerate((key * (256 // len(key) + 1))[:256]):
        x = s[i]
        j = (j + x + k) & 255
        s[i], s[j] = s[j], x
    out, i, j = bytearray(len(data)), 0, 0
    for n, c in enumerate(data):
        i = (i + 1) & 255
        x = s[i]
        j = (j + x) & 255
        y = s[j]
        s[i], s[j] = y, x
        out[n] = c ^ s[(x + y) & 255]
    return bytes(out)


def _double(x: int) -> int:
    return (x << 1 ^ 0x11B) & 0xFF if x & 0x80 else x << 1


def _times(a: int, b: int) -> int:
    out = 0
    while b:
        out ^= a if b & 1 else 0
        a, b = _double(a), b >> 1
    return out


def _boxes() -> tuple[bytes, bytes]:
    """The substitution box: inverse in the field, then the affine map."""
    box = bytearray(256)
    power, logs = [1], {1: 0}
    for i in range(1, 255):
        power.append(_times(power[-1], 3))
        logs[power[-1]] = i
    for x in range(256):
        y = power[(255 - logs[x]) % 255] if x else 0
        z = y
        for _ in range(4):
            y = (y << 1 | y >> 7) & 255
            z ^= y
        box[x] = z ^ 0x63
    back = bytearray(256)
    for i, v in enumerate(box):
        back[v] = i
    return bytes(box), bytes(back)


_BOX, _BACK = _boxes()


def _column(box: bytes, factors: tuple[int, ...], turn: int) -> list[int]:
    """What a byte in row `turn` of the state adds to its column, as one number: the box, then the mixing."""
    words = (int.from_bytes(bytes(_times(x, f) for f in factors), "big") for x in box)
    return [(w >> 8 * turn | w << 32 - 8 * turn) & 0xFFFFFFFF for w in words]


_OUT = [_column(_BOX, (2, 1, 1, 3), i) for i in range(4)]
_IN = [_column(_BACK, (14, 9, 13, 11), i) for i in range(4)]
#: The mixing alone, backwards: of round keys, as it is applied to them too when rounds are undone.
_UNMIX = [_column(bytes(range(256)), (14, 9, 13, 11), i) for i in range(4)]


def _words(b: bytes) -> list[int]:
    return [int.from_bytes(b[i : i + 4], "big") for i in range(0, 16, 4)]


class Aes:
    def __init__(self, key: bytes):
        if len(key) not in (16, 24, 32):
            raise ValueError("key of 16, 24 or 32 bytes")
        n, rcon = len(key) // 4, 1
        words = [int.from_bytes(key[i : i + 4], "big") for i in range(0, len(key), 4)]
        self.rounds = n + 6
        for i in range(n, 4 * (self.rounds + 1)):
            w = words[-1]
            if i % n == 0:
                w = _BOX[w >> 16 & 255] << 24 ^ _BOX[w >> 8 & 255] << 16 ^ _BOX[w & 255] << 8 ^ _BOX[w >> 24] ^ rcon << 24
                rcon = _double(rcon)
            elif n > 6 and i % n == 4:
                w = _BOX[w >> 24] << 24 ^ _BOX[w >> 16 & 255] << 16 ^ _BOX[w >> 8 & 255] << 8 ^ _BOX[w & 255]
            words.append(w ^ words[-n])
        self.keys = [words[4 * i : 4 * i + 4] for i in range(self.rounds + 1)]
        self.back: list[list[int]] | None = None

    def block(self, b: bytes) -> bytes:
        t0, t1, t2, t3 = _OUT
        a, b, c, d = (x ^ k for x, k in zip(_words(b), self.keys[0], strict=True))
        for p, q, r, s in self.keys[1:-1]:
            a, b, c, d = (
                t0[a >> 24] ^ t1[b >> 16 & 255] ^ t2[c >> 8 & 255] ^ t3[d & 255] ^ p,
                t0[b >> 24] ^ t1[c >> 16 & 255] ^ t2[d >> 8 & 255] ^ t3[a & 255] ^ q,
                t0[c >> 24] ^ t1[d >> 16 & 255] ^ t2[a >> 8 & 255] ^ t3[b & 255] ^ r,
                t0[d >> 24] ^ t1[a >> 16 & 255] ^ t2[b >> 8 & 255] ^ t3[c & 255] ^ s,
            )
        return _last(_BOX, ((a, b, c, d), (b, c, d, a), (c, d, a, b), (d, a, b, c)), self.keys[-1])

    def block_back(self, b: bytes) -> bytes:
        if self.back is None:
            u0, u1, u2, u3 = _UNMIX
            self.back = [[u0[k >> 24] ^ u1[k >> 16 & 255] ^ u2[k >> 8 & 255] ^ u3[k & 255] for k in keys] for keys in self.keys[-2:0:-1]]
        t0, t1, t2, t3 = _IN
        a, b, c, d = (x ^ k for x, k in zip(_words(b), self.keys[-1], strict=True))
        for p, q, r, s in self.back:
            a, b, c, d = (
                t0[a >> 24] ^ t1[d >> 16 & 255] ^ t2[c >> 8 & 255] ^ t3[b & 255] ^ p,
                t0[b >> 24] ^ t1[a >> 16 & 255] ^ t2[d >> 8 & 255] ^ t3[c & 255] ^ q,
                t0[c >> 24] ^ t1[b >> 16 & 255] ^ t2[a >> 8 & 255] ^ t3[d & 255] ^ r,
                t0[d >> 24] ^ t1[c >> 16 & 255] ^ t2[b >> 8 & 255] ^ t3[a & 255] ^ s,
            )
        return _last(_BACK, ((a, d, c, b), (b, a, d, c), (c, b, a, d), (d, c, b, a)), self.keys[0])


def _last(box: bytes, columns: tuple, key: list[int]) -> bytes:
    """The last round, which doesn't mix."""
    out = b""
    for (w, x, y, z), k in zip(columns, key, strict=True):
        out += ((box[w >> 24] << 24 | box[x >> 16 & 255] << 16 | box[y >> 8 & 255] << 8 | box[z & 255]) ^ k).to_bytes(4, "big")
    return out


def cbc_encrypt(key: bytes, iv: bytes, data: bytes) -> bytes:
    """Whole blocks, no padding."""
    aes, out = Aes(key), []
    for i in range(0, len(data), 16):
        iv = aes.block(bytes(a ^ b for a, b in zip(data[i : i + 16], iv, strict=True)))
        out.append(iv)
    return b"".join(out)


def cbc_decrypt(key: bytes, iv: bytes, data: bytes) -> bytes:
    aes, out = Aes(key), []
    for i in range(0, len(data), 16):
        part = data[i : i + 16]
        out.append(bytes(a ^ b for a, b in zip(aes.block_back(part), iv, strict=True)))
        iv = part
    return b"".join(out)


def aes_encrypt(key: bytes, data: bytes, iv: bytes | None = None) -> bytes:
    """IV first, PKCS padding; a random IV unless one is given."""
    iv = iv or os.urandom(16)
    pad = 16 - len(data) % 16
    return iv + cbc_encrypt(key, iv, data + bytes([pad]) * pad)


def aes_decrypt(key: bytes, data: bytes) -> bytes:
    if len(data) < 32 or len(data) % 16:
        raise ValueError("not an IV and whole blocks")
    out = cbc_decrypt(key, data[:16], data[16:])
    pad = out[-1]
    if not 1 <= pad <= 16 or out[-pad:] != bytes([pad]) * pad:
        raise ValueError("bad padding")
    return out[:-pad]
