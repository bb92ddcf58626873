"""Text, parsing and path functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space and delimiters of page-description syntax (fixed values).
SPACE = "\x00\t\n\x0c\r "
DELIMITERS = SPACE + "()<>[]{}/%"


def _class(chars: str) -> str:
    return "[" + "".join("\\x%02x" % ord(c) for c in chars) + "]"


def is_space(c: Column) -> Column:
    return c.rlike(f"^{_class(SPACE)}$")


def is_delim(c: Column) -> Column:
    return c.rlike(f"^{_class(DELIMITERS)}$")


def eol_length(c: Column) -> Column:
    """Length of the line end that a text starts with: CR, LF, CR LF, or none."""
    return F.when(c.startswith("\r\n"), 2).when(c.rlike("^[\r\n]"), 1).otherwise(0)


def normal_eol(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def one_hex(c: Column) -> Column:
    """Value of a hex digit, or -1."""
    return F.when(c.rlike("^[0-9A-Fa-f]$"), F.conv(c, 16, 10).cast("int")).otherwise(-1)


def parse_hex(c: Column) -> Column:
    """Hex text to bytes: white space is dropped and an odd last digit is padded with 0; null for other characters."""
    bare = F.regexp_replace(c, f"{_class(SPACE)}+", "")
    return F.unhex(F.when(F.length(bare) % 2 == 1, F.concat(bare, F.lit("0"))).otherwise(bare))


def to_hex(c: Column) -> Column:
    return F.lower(F.hex(c))


def hex_lines(c: Column, width: int = 70) -> Column:
    """Lower-case hex digits in lines."""
    return F.regexp_replace(to_hex(c), "(.{%d})(?=.)" % width, "$1\n")


def escape_string(c: Column) -> Column:
    """A literal string in parentheses: backslash and parentheses are escaped, CR and NUL are written as escapes that read back as themselves."""
    out = F.regexp_replace(c, r"([\\()])", r"\\$1")
    out = F.regexp_replace(F.regexp_replace(out, "\r", r"\\r"), "\x00", r"\\000")
    return F.concat(F.lit("("), out, F.lit(")"))


def escape_name(c: Column) -> Column:
    """A name with its slash; delimiters, #, and what isn't printable ASCII become #xx."""
    chars = F.split(c, "")
    odd = "[^!-~]|[()<>\\[\\]{}/%#]"
    each = F.transform(chars, lambda x: F.when(x.rlike(odd), F.regexp_replace(F.hex(x.cast("binary")), "(..)", "#$1")).otherwise(x))
    return F.concat(F.lit("/"), F.array_join(each, ""))


def parse_name(c: Column) -> Column:
    """Inverse of escape_name; the slash is optional. The escapes' bytes are read as UTF-8."""
    bare = F.regexp_replace(c, "^/", "")
    parts = F.regexp_extract_all(bare, F.lit("(#[0-9A-Fa-f]{2}|[^#]+|#)"), F.lit(1))
    hexed = F.transform(parts, lambda x: F.when(x.rlike("^#[0-9A-Fa-f]{2}$"), F.substring(x, 2, 2)).otherwise(F.hex(x.cast("binary"))))
    return F.decode(F.unhex(F.array_join(hexed, "")), "UTF-8")


def parse_number(c: Column) -> Column:
    """An integer or real as double; a leading sign and a bare point are allowed; null for anything else."""
    return F.when(c.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), c.cast("double"))


def parse_reference(c: Column) -> Column:
    """`n g R` to struct(num, gen), or null."""
    form = r"^\s*(\d+)\s+(\d+)\s+R\s*$"
    get = lambda i: F.regexp_extract(c, form, i).try_cast("int")
    return F.when(c.rlike(form), F.struct(get(1).alias("num"), get(2).alias("gen")))


def print_number(c: Column, digits: int = 6) -> Column:
    """A decimal without trailing zeros or exponent."""
    text = F.format_string(f"%.{digits}f", c.cast("double"))
    bare = F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(bare == "-0", "0").otherwise(bare)


def digits_or_minus_one(c: Column) -> Column:
    """An unsigned decimal, zeros in front allowed, or -1."""
    return F.when(c.rlike(r"^\d+$"), F.coalesce(c.try_cast("long"), F.lit(-1))).otherwise(F.lit(-1)).cast("long")


def big_endian(c: Column) -> Column:
    """Up to 8 bytes as an unsigned big-endian number, as decimal(20, 0)."""
    return F.when(F.length(c) == 0, F.lit(0).cast("decimal(20,0)")).otherwise(F.conv(F.hex(c), 16, 10).cast("decimal(20,0)"))


def split_any(c: Column, delimiters: str) -> Column:
    """Parts between any of the delimiter characters, empty ones dropped."""
    return F.filter(F.split(c, _class(delimiters)), lambda x: x != "")


def split_exact(c: Column, delimiter: str, keep_empty: bool = False) -> Column:
    """Parts between a delimiter text."""
    parts = F.split(c, "".join("\\x{%x}" % ord(x) for x in delimiter))
    return parts if keep_empty else F.filter(parts, lambda x: x != "")


def replace_first_match(c: Column, pairs: list[tuple[str, str]]) -> Column:
    """Replaces, in one pass from the left, the first listed text that matches at each place; an empty replacement deletes it."""
    table = F.create_map(*[F.lit(x) for kv in reversed(list(dict(reversed(pairs)).items())) for x in kv])
    any_of = "|".join(re.escape(k).replace("/", r"\/") for k, _ in pairs)
    parts = F.regexp_extract_all(c, F.lit(f"(?s)({any_of}|.)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda x: F.coalesce(table[x], x)), "")


#: Umlauts in plain letters, blanks deleted (fixed values).
PLAIN = [("Ä", "Ae"), ("Ö", "Oe"), ("Ü", "Ue"), ("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss"), (" ", "")]


def pure_ascii(c: Column) -> Column:
    for a, b in PLAIN:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def base_name(c: Column) -> Column:
    """What follows the last slash that isn't at the end; slashes at the end stay; all slashes give one."""
    return F.when(c.rlike("^/+$"), "/").otherwise(F.regexp_extract(c, "([^/]*/*)$", 1))


def dir_name(c: Column) -> Column:
    """What precedes the last part, without its slashes at the end; the whole text if it has one part only."""
    bare = F.regexp_extract(c, "^(.*?)/*[^/]*/*$", 1)
    return F.when(~c.rlike("/+[^/]"), F.when(c.rlike("^/+$"), "/").otherwise(F.regexp_replace(c, "/+$", ""))).otherwise(F.when((bare == "") & c.startswith("/"), "/").otherwise(bare))


def join_path(a: Column, b: Column) -> Column:
    """An absolute second path wins."""
    return F.when(b.startswith("/"), b).otherwise(F.concat(F.regexp_replace(a, "/+$", ""), F.lit("/"), b))


def join_path_below(a: Column, b: Column) -> Column:
    return F.concat(F.regexp_replace(a, "/+$", ""), F.lit("/"), F.regexp_replace(b, "^/+", ""))


def extension(c: Column) -> Column:
    """struct(stem, ext), cut at the last point."""
    has = F.instr(c, ".") > 0
    stem = F.regexp_extract(c, r"^(.*)\.[^.]*$", 1)
    return F.struct(F.when(has, stem).otherwise(c).alias("stem"), F.when(has, F.substring_index(c, ".", -1)).otherwise("").alias("ext"))


def human_size(c: Column) -> Column:
    """Bytes as K, M or G by whole divisions; a unit holds for up to 1024 of it; at least 1K."""
    k = F.expr("1") * c
    kb = F.floor(k / 1024)
    mb, gb = F.floor(kb / 1024), F.floor(F.floor(kb / 1024) / 1024)
    text = lambda x, u: F.concat(x.cast("long").cast("string"), F.lit(u))
    return F.when(kb > 1024, F.when(mb > 1024, text(gb, "G")).otherwise(text(mb, "M"))).otherwise(text(F.greatest(kb, F.lit(1)), "K"))


def switch(c: Column, cases: dict, default) -> Column:
    """The value listed for c, or the default."""
    out = None
    for k, v in cases.items():
        out = F.when(c == F.lit(k), F.lit(v)) if out is None else out.when(c == F.lit(k), F.lit(v))
    return out.otherwise(F.lit(default)) if out is not None else F.lit(default)


def printable(c: Column, first: int = 256) -> Column:
    """Whether the first characters are all printable ASCII or white space."""
    return F.substring(c, 1, first).rlike(r"^[\x20-\x7e\s]*$")


def hexdump(c: Column) -> Column:
    """Lines of 16 bytes: offset, hex in two groups of 8, printable characters. c is binary; an empty value has no lines.

    Digits and characters of the whole value are made once, as bytes, so that a line takes its pieces by place.
    """
    n = F.length(c)
    lines = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / 16).cast("int"))).otherwise(F.array().cast("array<int>"))
    digits = F.regexp_replace(to_hex(c), "(..)", "$1 ").cast("binary")
    shown = F.regexp_replace(F.decode(c, "ISO-8859-1"), r"[^\x20-\x7e]", ".").cast("binary")
    parts = F.struct(digits.alias("d"), shown.alias("s"))

    def line(p: Column, i: Column) -> Column:
        at = lambda k: F.rpad(F.substring(p["d"], i * 48 + k, F.lit(24)), 24, b" ")
        pieces = F.concat(F.lit(b"  "), at(1), F.lit(b" "), at(25), F.lit(b" "), F.substring(p["s"], i * 16 + 1, F.lit(16)))
        return F.concat(F.lpad(to_hex(i.cast("long") * 16), 8, "0"), pieces.cast("string"))

    # an array of one keeps the whole value's pieces from being made again for each line
    return F.flatten(F.transform(F.array(parts), lambda p: F.transform(lines, lambda i: line(p, i))))


def byte_range(c: Column, start: Column | int, length: Column | int | None = None) -> Column:
    """Bytes from a place on; a negative place counts from the end."""
    start = F.lit(start) if isinstance(start, int) else start
    n = F.length(c)
    at = F.when(start < 0, F.greatest(n + start, F.lit(0))).otherwise(start)
    size = n if length is None else F.lit(length) if isinstance(length, int) else length
    return F.substring(c, (at + 1).cast("int"), size.cast("int"))


def xref_line(offset: Column, gen: Column, kind: Column) -> Column:
    """The 20 bytes of a cross-reference entry: offset, generation, n or f."""
    return F.format_string("%010d %05d %s \n", offset.cast("long"), gen.cast("long"), kind)


def machine_step(transitions: dict[tuple[str, str], str]):
    """A function of two columns, state and event, to the next state; without a transition the state stays."""
    table = F.create_map(*[F.lit(x) for (s, e), t in transitions.items() for x in (f"{s}\x00{e}", t)])
    return lambda s, e: F.coalesce(table[F.concat(s, F.lit("\x00"), e)], s)


def run_machine(events: Column, transitions: dict[tuple[str, str], str], start: str) -> Column:
    """The state after an array of events; an event without a transition from the present state changes nothing."""
    return F.aggregate(events, F.lit(start), machine_step(transitions))


#: What a backslash and a letter stand for in a literal string (fixed values).
ESCAPES = {"n": "0A", "r": "0D", "t": "09", "b": "08", "f": "0C"}


def parse_string(c: Column) -> Column:
    """The bytes of a literal string in parentheses: escapes, octal codes, broken lines and line ends are resolved; null without the parentheses."""
    body = F.regexp_extract(c, r"(?s)^\((.*)\)$", 1)
    parts = F.regexp_extract_all(body, F.lit(r"(?s)(\\[0-7]{1,3}|\\\r\n|\\.|\r\n?|[^\\\r]+)"), F.lit(1))
    table = F.create_map(*[F.lit(x) for kv in ESCAPES.items() for x in kv])

    def one(x: Column) -> Column:
        tail = F.substring(x, 2, 3)
        octal = F.lpad(F.conv((F.conv(tail, 8, 10).cast("int") % 256).cast("string"), 10, 16), 2, "0")
        out = F.when(x.rlike(r"^\\[0-7]"), octal).when(x.rlike(r"^\\[\r\n]"), "").when(x.startswith("\\"), F.coalesce(table[tail], F.hex(tail.cast("binary"))))
        return out.when(x.startswith("\r"), "0A").otherwise(F.hex(x.cast("binary")))

    return F.when(c.rlike(r"(?s)^\(.*\)$"), F.unhex(F.array_join(F.transform(parts, one), "")))
