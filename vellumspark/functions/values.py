"""Accessors of dynamic values (VARIANT) under three policies, map edits, hashes, addresses.

References are objects {"$ref": [num, gen]}, names {"$name": text}, byte strings {"$hex": text}.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def get_required(v: Column, path: str, kind: str) -> Column:
    """An error if the value is missing or of another type."""
    x = F.try_variant_get(v, path, kind)
    return F.when(x.isNull(), F.raise_error(F.lit(f"{path}: missing or not {kind}"))).otherwise(x)


def get_strict(v: Column, path: str, kind: str, default) -> Column:
    """The default if missing or null, an error if of another type."""
    raw = F.try_variant_get(v, path, "variant")
    x = F.try_variant_get(v, path, kind)
    return F.when(raw.isNull() | F.is_variant_null(raw), F.lit(default).cast(kind)).when(x.isNull(), F.raise_error(F.lit(f"{path}: not {kind}"))).otherwise(x)


def get_lenient(v: Column, path: str, kind: str, default) -> Column:
    """The default if missing or of another type."""
    return F.coalesce(F.try_variant_get(v, path, kind), F.lit(default).cast(kind))


def get_name(v: Column, path: str) -> Column:
    return F.try_variant_get(v, f"{path}['$name']", "string")


def get_reference(v: Column, path: str = "$") -> Column:
    """struct(num, gen), or null."""
    num = F.try_variant_get(v, f"{path}['$ref'][0]", "int")
    return F.when(num.isNotNull(), F.struct(num.alias("num"), F.try_variant_get(v, f"{path}['$ref'][1]", "int").alias("gen")))


def is_null_object(v: Column) -> Column:
    """Whether a dynamic value is missing or the null object."""
    return v.isNull() | F.coalesce(F.is_variant_null(v), F.lit(False))


def name_index(c: Column, names: list[str]) -> Column:
    """Place of a value in a list; 0 if null; an error if it isn't listed."""
    at = F.array_position(F.array(*[F.lit(x) for x in names]), c)
    return F.when(c.isNull(), F.lit(0)).when(at == 0, F.raise_error(F.concat(F.lit("unknown name "), c))).otherwise(at - 1).cast("int")


def ensure(c: Column, value: str) -> Column:
    """c if it equals the value, else an error."""
    return F.when(c == value, c).otherwise(F.raise_error(F.lit(f"expected {value}")))


def element(arr: Column, i: Column | int) -> Column:
    """Element by place from 0; null outside."""
    return F.get(arr, F.lit(i) if isinstance(i, int) else i)


def map_put(m: Column, key: str, value: Column) -> Column:
    """With the entry added or replaced; a null value removes it."""
    rest = map_drop(m, key)
    return F.when(value.isNull(), rest).otherwise(F.map_concat(rest, F.create_map(F.lit(key), value)))


def map_replace(m: Column, key: str, value: Column) -> Column:
    """Replaces an entry that exists; else an error."""
    return F.when(F.map_contains_key(m, key), map_put(m, key, value)).otherwise(F.raise_error(F.lit(f"no entry {key}")))


def map_drop(m: Column, *keys: str) -> Column:
    return F.map_filter(m, lambda k, _: ~k.isin(*keys))


def map_merge(a: Column, b: Column) -> Column:
    """Entries of both; b wins."""
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def md5_bytes(c: Column) -> Column:
    return F.unhex(F.md5(c))


def sha256_bytes(c: Column) -> Column:
    return F.unhex(F.sha2(c, 256))


def little_endian(c: Column, size: int) -> Column:
    """Low bytes of a whole number, least first."""
    return F.unhex(F.concat(*[F.lpad(F.hex(F.shiftright(c.cast("long"), 8 * i).bitwiseAND(255)), 2, "0") for i in range(size)]))


def object_key(file_key: Column, num: Column, gen: Column, aes: bool = False) -> Column:
    """Key of one object: MD5 of file key, number (3 bytes), generation (2 bytes) and, for AES, `sAlT`; min(n + 5, 16) bytes of it."""
    salt = [F.lit(b"sAlT")] if aes else []
    whole = md5_bytes(F.concat(file_key, little_endian(num, 3), little_endian(gen, 2), *salt))
    return F.substring(whole, F.lit(1), F.least(F.length(file_key) + 5, F.lit(16)))


def aes_cbc_decrypt(c: Column, key: Column) -> Column:
    """IV first, PKCS padding; null if the padding is bad."""
    return F.try_aes_decrypt(c, key, F.lit("CBC"), F.lit("PKCS"))


def aes_cbc_encrypt(c: Column, key: Column, iv: Column) -> Column:
    return F.aes_encrypt(c, key, F.lit("CBC"), F.lit("PKCS"), iv)


def xor_byte(c: Column, value: int) -> Column:
    """Each byte of a binary value of up to 16 bytes xor a constant."""
    parts = F.filter(F.regexp_extract_all(F.hex(c), F.lit("(..)"), F.lit(1)), lambda x: x != "")
    return F.unhex(F.array_join(F.transform(parts, lambda x: F.lpad(F.hex(F.conv(x, 16, 10).cast("long").bitwiseXOR(value)), 2, "0")), ""))


def aes_cbc_raw_decrypt(c: Column, key: Column, iv: Column) -> Column:
    """CBC without padding: a block that decrypts to a whole pad is appended, then PKCS decryption drops it."""
    last = F.expr("1") * 0 + F.length(c) - 15
    pad = F.substring(F.aes_encrypt(xor_byte(F.substring(c, last.cast("int"), F.lit(16)), 16), key, F.lit("ECB"), F.lit("PKCS")), 1, 16)
    return F.aes_decrypt(F.concat(iv, c, pad), key, F.lit("CBC"), F.lit("PKCS"))


def aes_cbc_raw_encrypt(c: Column, key: Column, iv: Column) -> Column:
    """CBC without padding of a whole number of blocks."""
    whole = F.aes_encrypt(c, key, F.lit("CBC"), F.lit("PKCS"), iv)
    return F.substring(whole, F.lit(17), F.length(c))


def ip4(c: Column) -> Column:
    """Dotted address as a number, or null."""
    parts = F.split(c, r"\.")
    ok = c.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & F.forall(parts, lambda x: x.try_cast("int") <= 255)
    return F.when(ok, F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a * 256 + x.cast("long")))


def ip4_in_prefix(address: Column, prefix: Column, length: Column) -> Column:
    """Whether the first bits of an address equal the prefix and the prefix's other bits are clear (numbers from ip4)."""
    size = F.pow(F.lit(2.0), 32 - F.least(F.greatest(length, F.lit(0)), F.lit(32))).cast("long")
    return F.when(length <= 0, prefix == 0).otherwise(address - F.pmod(address, size) == prefix)


def ip6_in_prefix(address: Column, prefix: Column, length: Column) -> Column:
    """The same for 16-byte addresses."""
    bits = lambda x: F.array_join(F.transform(F.filter(F.split(F.hex(x), ""), lambda d: d != ""), lambda d: F.lpad(F.conv(d, 16, 2), 4, "0")), "")
    n = F.least(F.greatest(length, F.lit(0)), F.lit(128))
    return F.rpad(F.substring(bits(address), F.lit(1), n), 128, "0") == bits(prefix)


def mask_length(mask: Column, bits: int = 32) -> Column:
    """Length of a left-contiguous mask (a number for 32 bits, 16 bytes for 128), -1 if it isn't one, -2 if null."""
    text = F.lpad(F.bin(mask), 32, "0") if bits == 32 else F.array_join(F.transform(F.filter(F.split(F.hex(mask), ""), lambda d: d != ""), lambda d: F.lpad(F.conv(d, 16, 2), 4, "0")), "")
    return F.when(mask.isNull(), -2).when(text.rlike("^1*0*$"), F.length(F.regexp_replace(text, "0", ""))).otherwise(-1)
