"""The engine's entry point for whole files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumspark import functions as fn
from vellumspark.codecs.columns import decode_stream
from vellumspark.documents import frames
from vellumspark.operators import graph
from vellumspark.operators.rows import ends
from vellumspark.sinks import images
from vellumspark.sinks.files import write_files


class Engine:
    """Files under a path, or rows of doc_id and content, as tables and tools.

    Tables are plans: nothing is read before an action, and each is one pass over the files.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, docs: DataFrame | None = None, password: bytes = b""):
        if (path is None) == (docs is None):
            raise ValueError("give a path or rows of doc_id and content")
        self.spark, self.password = spark, password
        self.docs = frames.files(spark, path) if docs is None else docs

    def objects(self) -> DataFrame:
        return frames.objects(self.docs, self.password)

    def edges(self) -> DataFrame:
        return frames.edges_of(self.docs, self.password)

    def xref(self) -> DataFrame:
        return frames.xref(self.docs, self.password)

    def contained(self) -> DataFrame:
        """Objects inside object streams, by a join of the cross-reference entries with the streams' contents."""
        return frames.contained(self.objects(), self.xref())

    def ends(self) -> DataFrame:
        """In-use entries of the newest sections with the offset where each ends."""
        entries = self.xref().where("obj_num is not null").select("doc_id", "obj_num", "type", "off", "gen", "section", (-F.col("section")).alias("age"))
        newest = graph.newest_entries(entries, ["doc_id", "obj_num"], "age", "gen", "type")
        return ends(newest.where("type = 'n'").drop("age"), ["doc_id"], "off", "end_off")

    def pages(self) -> DataFrame:
        return frames.pages(self.docs, self.password)

    def contents(self) -> DataFrame:
        """The decoded content streams of all pages: doc_id, page_no, place, obj_num, gen, data, left, reason, encrypted (of the file), corrupt_reason."""
        return frames.contents(self.docs, self.password)

    def info(self) -> DataFrame:
        return frames.info(self.docs, self.password)

    def object(self, num: int, gen: int = 0) -> DataFrame:
        return self.objects().where((F.col("obj_num") == num) & (F.col("gen") == gen))

    def page(self, number: int) -> DataFrame:
        return self.pages().where(F.col("page_no") == number)

    def decoded(self) -> DataFrame:
        """Streams with their decoded data, the filters that no codec here reads, and the reason."""
        s = self.objects().where("kind = 'stream'").withColumn("d", decode_stream(F.col("raw"), F.col("filters"), F.col("params_json")))
        return s.select("doc_id", "obj_num", "gen", "value", "d.data", "d.left", "d.reason")

    def output(self, stage: str = "default") -> DataFrame:
        """Objects at one stage of decoding: doc_id, obj_num, gen, data, reason.

        none: the value as JSON text, without data; compressed: streams' data as stored; raw: decoded
        data; hex: the same as lines of a dump; image: image files; default: decoded data that is
        text, else nothing. Objects that aren't streams are their value in every stage but image.
        """
        if stage == "image":
            return self.images().select("doc_id", "obj_num", "gen", "data", "reason")
        return self.outputs([stage]).select("doc_id", "obj_num", "gen", F.col(stage).alias("data"), "reason")

    def outputs(self, stages: list[str]) -> DataFrame:
        """Objects at several stages of output() but image, in one pass: doc_id, obj_num, gen, kind, a column named like each stage, reason."""
        for stage in stages:
            if stage not in ("none", "compressed", "raw", "hex", "default"):
                raise ValueError(f"no stage {stage}")
        o = self.objects().where("obj_num is not null")
        value, plain = F.to_json("value").cast("binary"), F.col("kind") != "stream"
        d = F.col("d.data")
        shown = {
            "none": lambda: value,
            "compressed": lambda: F.col("raw"),
            "raw": lambda: d,
            "hex": lambda: F.array_join(fn.hexdump(d), "\n").cast("binary"),
            "default": lambda: F.when(fn.printable(F.decode(F.substring("d.data", 1, 256), "ISO-8859-1")), d),
        }
        reason = F.lit(None).cast("string")
        if set(stages) & {"raw", "hex", "default"}:
            o = o.withColumn("d", F.when(~plain, decode_stream(F.col("raw"), F.col("filters"), F.col("params_json"))))
            reason = F.col("d.reason")
        return o.select("doc_id", "obj_num", "gen", "kind", *[F.when(plain, value).otherwise(shown[x]()).alias(x) for x in stages], reason.alias("reason"))

    def printable(self) -> DataFrame:
        """Decoded streams that aren't images and whose first 256 bytes are text."""
        kind = F.try_variant_get("value", "$.Subtype['$name']", "string")
        text = F.decode(F.substring("data", 1, 256), "ISO-8859-1")
        return self.decoded().where(F.coalesce(kind != "Image", F.lit(True)) & fn.printable(text))

    def hexdump(self, num: int, gen: int = 0) -> DataFrame:
        d = self.decoded().where((F.col("obj_num") == num) & (F.col("gen") == gen))
        return d.select("doc_id", F.posexplode(fn.hexdump(F.col("data"))).alias("line_no", "line"))

    def images(self) -> DataFrame:
        return images.images(self.objects())

    def thumbnails(self) -> DataFrame:
        return images.thumbnails(self.pages(), self.objects())

    def reachable(self, starts: DataFrame) -> DataFrame:
        """All objects that references reach from starts (doc_id, num, gen), by a frontier loop over the edges."""
        key = lambda n, g: F.concat_ws(" ", "doc_id", n, g)
        e = self.edges().select(key("src_num", "src_gen").alias("src"), key("dst_num", "dst_gen").alias("dst"))
        s = starts.select(key("num", "gen").alias("root"), key("num", "gen").alias("node"))
        return graph.closure(e, s)

    def select_pages(self, start: int, length: int) -> DataFrame:
        return frames.selected(self.docs, start, length, self.password)

    def merge(self, group: str | None = None, order: list[str] | None = None) -> DataFrame:
        """One file of all pages, or one per group, files in the given order (by default of doc_id)."""
        docs = self.docs if group else self.docs.withColumn("__all", F.lit("merged"))
        return frames.merged(docs, group or "__all", order or ["doc_id"], self.password)

    @staticmethod
    def write(rows: DataFrame, folder: str, extension: str = "pdf") -> DataFrame:
        return write_files(rows, folder, extension)
