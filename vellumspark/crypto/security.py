"""The standard security handler, revisions 2 to 5."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache
from hashlib import md5, sha256
from typing import Any, NamedTuple

from vellumspark.crypto.ciphers import aes_decrypt, aes_encrypt, cbc_decrypt, cbc_encrypt, rc4

#: What fills a password to 32 bytes (fixed value).
PAD = bytes.fromhex("28bf4e5e4e758a4164004e56fffa01082e2e00b6d0683e802f0ca9fe6453697a")


class SecurityError(ValueError):
    """A password that doesn't open the file, or a handler that isn't supported."""


def _padded(password: bytes) -> bytes:
    return (password + PAD)[:32]


def _rounds(key: bytes, data: bytes, back: bool = False) -> bytes:
    for i in range(19, -1, -1) if back else range(20):
        data = rc4(bytes(k ^ i for k in key), data)
    return data


def file_key(password: bytes, o: bytes, p: int, doc_id: bytes, revision: int, size: int, encrypt_metadata: bool = True) -> bytes:
    h = _padded(password) + o[:32] + (p & 0xFFFFFFFF).to_bytes(4, "little") + doc_id
    if revision >= 4 and not encrypt_metadata:
        h += b"\xff" * 4
    k = md5(h).digest()
    for _ in range(50 if revision >= 3 else 0):
        k = md5(k[:size]).digest()
    return k[:size]


def user_hash(key: bytes, doc_id: bytes, revision: int) -> bytes:
    """32 bytes; from revision 3 on only the first 16 count."""
    return rc4(key, PAD) if revision == 2 else _rounds(key, md5(PAD + doc_id).digest()) + bytes(16)


@lru_cache(256)
def owner_key(password: bytes, revision: int, size: int) -> bytes:
    k = md5(_padded(password)).digest()
    for _ in range(50 if revision >= 3 else 0):
        k = md5(k).digest()
    return k[:size]


@lru_cache(256)
def owner_hash(owner: bytes, user: bytes, revision: int, size: int) -> bytes:
    k = owner_key(owner or user, revision, size)
    return rc4(k, _padded(user)) if revision == 2 else _rounds(k, _padded(user))


@lru_cache(256)
def user_of_owner(owner: bytes, o: bytes, revision: int, size: int) -> bytes:
    k = owner_key(owner, revision, size)
    return rc4(k, o[:32]) if revision == 2 else _rounds(k, o[:32], back=True)


@dataclass
class Handler:
    """Opens and seals the data of one file. methods: of streams, strings and embedded files: Identity, V2, AESV2, AESV3."""

    key: bytes
    methods: dict[str, str]
    encrypt_metadata: bool = True

    def _key(self, num: int, gen: int, aes: bool) -> bytes:
        h = self.key + num.to_bytes(4, "little")[:3] + gen.to_bytes(4, "little")[:2] + (b"sAlT" if aes else b"")
        return md5(h).digest()[: min(len(self.key) + 5, 16)]

    def open(self, data: bytes, num: int, gen: int, what: str = "stream") -> bytes:
        return CIPHERS[self.methods.get(what, "Identity")].open(self, data, num, gen)

    def seal(self, data: bytes, num: int, gen: int, what: str = "stream", iv: bytes | None = None) -> bytes:
        return CIPHERS[self.methods.get(what, "Identity")].seal(self, data, num, gen, iv)


class Cipher(NamedTuple):
    """How one method of crypt filters opens and seals the data of an object."""

    open: Callable[[Handler, bytes, int, int], bytes]
    seal: Callable[[Handler, bytes, int, int, bytes | None], bytes]


def _stream_cipher(h: Handler, data: bytes, num: int, gen: int, iv: bytes | None = None) -> bytes:
    return rc4(h._key(num, gen, False), data)


#: Ciphers by the name that crypt filters give them.
CIPHERS: dict[str, Cipher] = {
    "Identity": Cipher(lambda h, d, n, g: d, lambda h, d, n, g, iv: d),
    "V2": Cipher(_stream_cipher, _stream_cipher),
    "AESV2": Cipher(lambda h, d, n, g: aes_decrypt(h._key(n, g, True), d) if d else d, lambda h, d, n, g, iv: aes_encrypt(h._key(n, g, True), d, iv)),
    "AESV3": Cipher(lambda h, d, n, g: aes_decrypt(h.key, d) if d else d, lambda h, d, n, g, iv: aes_encrypt(h.key, d, iv)),
}


def register_cipher(name: str, cipher: Cipher) -> None:
    """Adds a method that crypt filters may name, or replaces one."""
    CIPHERS[name] = cipher


def _methods(e: dict[str, Any]) -> dict[str, str]:
    v = e.get("V", 0)
    if v in (1, 2, 3):
        return dict.fromkeys(("stream", "string", "file"), "V2")
    filters = e.get("CF", {})

    def of(name: str) -> str:
        if name == "Identity":
            return name
        cfm = str(filters.get(name, {}).get("CFM", "None"))
        if cfm == "Identity" or cfm not in CIPHERS:
            raise SecurityError(f"crypt filter {name} isn't supported")
        return cfm

    stream = of(str(e.get("StmF", "Identity")))
    return {"stream": stream, "string": of(str(e.get("StrF", "Identity"))), "file": of(str(e["EFF"])) if "EFF" in e else stream}


def open_handler(e: dict[str, Any], doc_id: bytes, password: bytes = b"") -> Handler:
    """The handler of an encryption dictionary, by user or owner password."""
    if str(e.get("Filter", "Standard")) != "Standard" or e.get("V", 0) not in (1, 2, 3, 4, 5):
        raise SecurityError("the security handler isn't supported")
    r, o, u, p = e["R"], e["O"], e["U"], e["P"]
    meta = bool(e.get("EncryptMetadata", True))
    if r == 5:
        return Handler(_key_r5(e, password), _methods(e), meta)
    size = 5 if e["V"] == 1 else 16 if e["V"] == 4 else int(e.get("Length", 40)) // 8
    n = 32 if r == 2 else 16
    for attempt in (password, user_of_owner(password, o, r, size)):
        k = file_key(attempt, o, p, doc_id, r, size, meta)
        if user_hash(k, doc_id, r)[:n] == u[:n]:
            return Handler(k, _methods(e), meta)
    raise SecurityError("the password doesn't open the file")


def _key_r5(e: dict[str, Any], password: bytes) -> bytes:
    pw, u, o = password[:127], e["U"], e["O"]
    if sha256(pw + u[32:40]).digest() == u[:32]:
        key = cbc_decrypt(sha256(pw + u[40:48]).digest(), bytes(16), e["UE"][:32])
    elif sha256(pw + o[32:40] + u[:48]).digest() == o[:32]:
        key = cbc_decrypt(sha256(pw + o[40:48] + u[:48]).digest(), bytes(16), e["OE"][:32])
    else:
        raise SecurityError("the password doesn't open the file")
    perms = cbc_decrypt(key, bytes(16), e["Perms"][:16])
    if perms[9:12] != b"adb" or int.from_bytes(perms[:4], "little") != e["P"] & 0xFFFFFFFF:
        raise SecurityError("the permissions were changed")
    return key


def new_handler(user: bytes, owner: bytes, revision: int, doc_id: bytes, permissions: int = -4, bits: int = 128, aes: bool = False, encrypt_metadata: bool = True) -> tuple[Handler, dict[str, Any]]:
    """A handler and its encryption dictionary for passwords; revision 2: RC4-40, 3: RC4, 4: RC4 or AES-128, 5: AES-256."""
    from vellumspark.documents.syntax import Name

    cfm = "AESV3" if revision == 5 else "AESV2" if aes else "V2"
    e: dict[str, Any] = {"Filter": Name("Standard"), "V": {2: 1, 3: 2, 4: 4, 5: 5}[revision], "R": revision, "P": permissions}
    if revision >= 4:
        e |= {"CF": {"StdCF": {"CFM": Name(cfm), "AuthEvent": Name("DocOpen"), "Length": 32 if revision == 5 else 16}}, "StmF": Name("StdCF"), "StrF": Name("StdCF")}
        if not encrypt_metadata:
            e["EncryptMetadata"] = False
    if revision == 5:
        key, s = os.urandom(32), os.urandom(32)
        u = sha256(user + s[:8]).digest() + s[:16]
        o = sha256((owner or user) + s[16:24] + u).digest() + s[16:32]
        perms = (permissions & 0xFFFFFFFF).to_bytes(4, "little") + b"\xff" * 4 + (b"T" if encrypt_metadata else b"F") + b"adb" + os.urandom(4)
        e |= {"U": u, "O": o, "UE": cbc_encrypt(sha256(user + s[8:16]).digest(), bytes(16), key), "OE": cbc_encrypt(sha256((owner or user) + s[24:32] + u).digest(), bytes(16), key), "Perms": cbc_encrypt(key, bytes(16), perms), "Length": 256}
        return Handler(key, _methods(e), encrypt_metadata), e
    size = 5 if revision == 2 else 16 if revision == 4 else bits // 8
    e["Length"] = size * 8
    e["O"] = owner_hash(owner, user, revision, size)
    key = file_key(user, e["O"], permissions, doc_id, revision, size, encrypt_metadata)
    e["U"] = user_hash(key, doc_id, revision)
    return Handler(key, _methods(e), encrypt_metadata), e
