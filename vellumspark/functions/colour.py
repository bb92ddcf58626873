"""Colour spaces as structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Components of each colour space family; ICC has its own N (fixed values).
COMPONENTS = {"DeviceGray": 1, "DeviceRGB": 3, "DeviceCMYK": 4, "CalGray": 1, "CalRGB": 3, "Lab": 3, "Indexed": 1}
#: Colour spaces that callers have added, with their components.
ADDED: dict[str, int] = {}
UNIT_MATRIX = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]


def register_space(kind: str, components: int) -> None:
    """Adds a colour space, or gives one that was added another number of components; the built-in ones can't be changed."""
    if kind in COMPONENTS or kind == "ICCBased" or components < 1:
        raise ValueError(f"{kind} can't be registered")
    ADDED[kind] = components


def component_count(kind: Column, icc: Column | None = None) -> Column:
    """Components of a colour space; of ICCBased, icc; null for an unknown one."""
    table = F.create_map(*[F.lit(x) for kv in (COMPONENTS | ADDED).items() for x in kv])
    return F.when(kind == "ICCBased", icc if icc is not None else F.lit(None).cast("int")).otherwise(table[kind])


def numbers(values: Column, n: int) -> Column:
    """Exactly n numbers as an array of double, else an error."""
    return F.when(F.size(values) == n, F.transform(values, lambda x: x.cast("double"))).otherwise(F.raise_error(F.lit(f"expected {n} numbers")))


def rect(values: Column) -> Column:
    """Four numbers as an array of float, else an error."""
    return numbers(values, 4).cast("array<float>")


def _filled(x: Column, values: list[float]) -> Column:
    return F.coalesce(x.cast("array<double>"), F.array(*[F.lit(float(v)) for v in values]))


def cie_parameters(kind: Column, white: Column, black: Column, gamma: Column, matrix: Column, range_: Column) -> Column:
    """White point (its Y must be 1), black point, gamma, matrix and range with their defaults."""
    ok = F.when((F.size(white) == 3) & (F.get(white, 1) == 1), white.cast("array<double>")).otherwise(F.raise_error(F.lit("bad white point")))
    none = F.lit(None).cast("array<double>")
    return F.struct(
        ok.alias("white"),
        _filled(black, [0, 0, 0]).alias("black"),
        F.when(kind == "CalGray", _filled(gamma, [1])).when(kind == "CalRGB", _filled(gamma, [1, 1, 1])).otherwise(none).alias("gamma"),
        F.when(kind == "CalRGB", _filled(matrix, UNIT_MATRIX)).otherwise(none).alias("matrix"),
        F.when(kind == "Lab", _filled(range_, [-100, 100, -100, 100])).otherwise(none).alias("range"),
    )


def icc_range(n: Column, range_: Column) -> Column:
    """2 N numbers, by default 0 and 1 for each component."""
    default = F.transform(F.sequence(F.lit(1), n * 2), lambda i: F.when(i % 2 == 0, 1.0).otherwise(0.0))
    return F.when(range_.isNull(), default).when(F.size(range_) == 2 * n, range_.cast("array<double>")).otherwise(F.raise_error(F.lit("bad range")))


def palette_colour(palette: Column, index: Column, n: Column, hival: Column) -> Column:
    """The n bytes of entry `index` of an indexed colour space whose palette has exactly n * (hival + 1) bytes."""
    fine = (F.length(palette) == n * (hival + 1)) & hival.between(0, 255)
    return F.when(~fine, F.raise_error(F.lit("bad palette"))).otherwise(F.substring(palette, F.least(F.greatest(index, F.lit(0)), hival) * n + 1, n))


def cie_to_json(kind: Column, p: Column) -> Column:
    """The array form of a CIE colour space as JSON text; parameters equal to their defaults are left out."""
    gone = lambda x, v: F.when(x != F.array(*[F.lit(float(i)) for i in v]), x)
    gamma = F.when(kind == "CalGray", gone(p["gamma"], [1])).otherwise(gone(p["gamma"], [1, 1, 1]))
    body = F.struct(p["white"].alias("WhitePoint"), gone(p["black"], [0, 0, 0]).alias("BlackPoint"), gamma.alias("Gamma"), gone(p["matrix"], UNIT_MATRIX).alias("Matrix"), gone(p["range"], [-100, 100, -100, 100]).alias("Range"))
    return F.concat(F.lit('["/'), kind, F.lit('",'), F.to_json(body), F.lit("]"))


def indexed_to_json(base: Column, palette: Column, n: Column) -> Column:
    """The array form of an indexed colour space: base, highest index, palette as hex."""
    return F.concat(F.lit('["/Indexed","/'), base, F.lit('",'), (F.floor(F.length(palette) / n) - 1).cast("string"), F.lit(',"<'), F.lower(F.hex(palette)), F.lit('>"]'))
