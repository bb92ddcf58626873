"""Image streams to image files."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumspark.codecs import predictor
from vellumspark.codecs.chain import decode_chain
from vellumspark.documents import bitmap
from vellumspark.functions.colour import COMPONENTS

RESULT = T.StructType([T.StructField("data", T.BinaryType()), T.StructField("format", T.StringType()), T.StructField("reason", T.StringType())])


def components(space) -> int:
    """Of a resolved colour space as JSON (a name, or a list that begins with one)."""
    name = _name(space)
    if name == "ICCBased":
        return int(space[1]["entries"]["N"])
    if name not in COMPONENTS:
        raise bitmap.BitmapError(f"colour space {name}")
    return COMPONENTS[name]


def _name(space) -> str | None:
    first = space[0] if isinstance(space, list) and space else space
    return first.get("$name") if isinstance(first, dict) else None


def _through_palette(samples: bytes, space: list, width: int, height: int, bits: int) -> tuple[bytes, int]:
    """Samples of an indexed image in its base space, 8 bits each, and the components of that space."""
    _, base, hival, table = space
    n, palette = components(base), bytes.fromhex(table["$hex"])
    if not 0 <= hival <= 255 or len(palette) != n * (hival + 1):
        raise bitmap.BitmapError("bad palette")
    size = (width * bits + 7) // 8
    rows = np.frombuffer(samples[: size * height].ljust(size * height, b"\0"), np.uint8).reshape(height, size)
    at = np.minimum(predictor.unpack(rows, bits, width), hival)
    return np.frombuffer(palette, np.uint8).reshape(-1, n)[at].tobytes(), n


def image_file(value: dict, raw: bytes, filters: list[str], params: list[dict], space=None) -> tuple[bytes, str]:
    """P4, P5 or P6 of an image's samples; JPEG data passes through after the filters before it. Indexed samples are looked up in their palette."""
    d = decode_chain(raw, filters, params)
    if d.left:
        if d.left[-1] in ("DCTDecode", "DCT") and len(d.left) == 1:
            return d.data, "jpg"
        raise bitmap.BitmapError(d.reason)
    space = space if space is not None else value.get("ColorSpace")
    width, height = int(value["Width"]), int(value["Height"])
    bits = 1 if value.get("ImageMask") else int(value["BitsPerComponent"])
    n, data = 1 if value.get("ImageMask") else components(space), d.data
    inverted = value.get("Decode") in ([1, 0], [1, 0] * n)
    if not value.get("ImageMask") and _name(space) == "Indexed":
        (data, n), bits, inverted = _through_palette(data, space, width, height, bits), 8, False
    out = bitmap.image(data, width, height, n, bits, inverted)
    return out, {b"P4": "pbm", b"P5": "pgm", b"P6": "ppm"}[out[:2]]


@F.pandas_udf(RESULT)
def _image(value: pd.Series, raw: pd.Series, filters: pd.Series, params: pd.Series, space: pd.Series) -> pd.DataFrame:
    rows = []
    for v, r, f, p, c in zip(value, raw, filters, params, space, strict=True):
        try:
            rows.append((*image_file(json.loads(v), bytes(r), list(f if f is not None else []), json.loads(p) if p else [], json.loads(c) if c else None), None))
        except Exception as e:
            rows.append((None, None, f"{type(e).__name__}: {e}"))
    return pd.DataFrame(rows, columns=["data", "format", "reason"])


@F.pandas_udf(T.BinaryType())
def _thumbnail(data: pd.Series, rotate: pd.Series) -> pd.Series:
    return pd.Series([None if d is None else bitmap.write_pgm(bitmap.thumbnail(bitmap.read_pbm(bytes(d)), int(r))) for d, r in zip(data, rotate, strict=True)])


def images(objs: DataFrame) -> DataFrame:
    """Image streams of documents.frames.objects with their files: doc_id, obj_num, gen, value, data, format, reason."""
    found = objs.where((F.col("kind") == "stream") & (F.try_variant_get("value", "$.Subtype['$name']", "string") == "Image"))
    made = found.withColumn("x", _image(F.to_json("value"), "raw", "filters", "params_json", "space_json"))
    return made.select("doc_id", "obj_num", "gen", "value", "x.data", "x.format", "x.reason")


def one_bit(imgs: DataFrame) -> DataFrame:
    """Images of one bit in plain gray: the ones that thumbnails are made of."""
    bits = F.try_variant_get("value", "$.BitsPerComponent", "int")
    space = F.try_variant_get("value", "$.ColorSpace['$name']", "string")
    decode = F.to_json(F.try_variant_get("value", "$.Decode", "variant"))
    return imgs.where((bits == 1) & (space == "DeviceGray") & (decode.isNull() | decode.isin("[0,1]", "[1,0]")))


def thumbnails(pages: DataFrame, objs: DataFrame) -> DataFrame:
    """Of each page its first one-bit image as a small gray file: doc_id, page_no, obj_num, data."""
    x = F.expr("variant_get(coalesce(try_variant_get(resources, '$.XObject', 'variant'), parse_json('{}')), '$', 'map<string,variant>')")
    held = pages.where("corrupt_reason is null or mediabox is not null").select("doc_id", "page_no", "rotate", F.explode(x).alias("name", "ref"))
    held = held.select("doc_id", "page_no", "rotate", "name", F.try_variant_get("ref", "$['$ref'][0]", "int").alias("obj_num"))
    both = held.join(one_bit(images(objs)).where("format = 'pbm'"), ["doc_id", "obj_num"])
    first = both.groupBy("doc_id", "page_no").agg(F.min_by(F.struct("obj_num", "data", "rotate"), F.struct("name", "obj_num")).alias("i"))
    return first.select("doc_id", "page_no", "i.obj_num", _thumbnail("i.data", "i.rotate").alias("data"))
