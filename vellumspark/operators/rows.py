"""Row-to-row operators: predictors, runs, ends, slices, merges. All are window functions over a partition."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from vellumspark.functions.text import machine_step
from vellumspark.operators.base import stored

FILTERS = ("none", "sub", "up", "average", "paeth")


def over(line: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*line).orderBy(*order)


def ends(df: DataFrame, doc: list[str], offset: str, name: str = "end") -> DataFrame:
    """Adds the next offset in the document; null for the last."""
    return df.withColumn(name, F.lead(offset).over(over(doc, [offset])))


def sub_encode(x: Column, w: WindowSpec, step: int = 1, modulus: int = 256) -> Column:
    return F.pmod(x - F.lag(x, step, 0).over(w), F.lit(modulus))


def sub_decode(x: Column, line: list[str], order: list[str], step: int = 1, modulus: int = 256) -> Column:
    """Running sums of every step-th sample of a line."""
    if step == 1:
        return F.pmod(F.sum(x).over(over(line, order)), F.lit(modulus))
    place = F.row_number().over(over(line, order)) % step
    return F.pmod(F.sum(x).over(Window.partitionBy(*line, place).orderBy(*order)), F.lit(modulus))


def up_decode(x: Column, line: str, place: list[str], modulus: int = 256) -> Column:
    """Running sums down each column of samples: line numbers the rows, place names the column."""
    return F.pmod(F.sum(x).over(Window.partitionBy(*place).orderBy(line)), F.lit(modulus))


def average_decode(residues: Column, above: Column) -> Column:
    """A line of samples from its residues and the decoded line above; each needs the one to its left, so the line is folded."""
    return _folded(residues, above, lambda left, up, _: F.floor((left + up) / 2).cast("int"))


def paeth_decode(residues: Column, above: Column) -> Column:
    return _folded(residues, above, paeth)


def _folded(residues: Column, above: Column, guess) -> Column:
    pairs = F.arrays_zip(residues.alias("r"), above.alias("u"))
    start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("left"), F.lit(0).alias("corner"))

    def step(s: Column, p: Column) -> Column:
        x = F.pmod(p["r"] + guess(s["left"], p["u"], s["corner"]), F.lit(256)).cast("int")
        return F.struct(F.concat(s["out"], F.array(x)).alias("out"), x.alias("left"), p["u"].cast("int").alias("corner"))

    return F.aggregate(pairs, start, step, lambda s: s["out"])


def paeth(left: Column, up: Column, corner: Column) -> Column:
    """Of left, up and corner the one nearest to left + up - corner, in this order on ties."""
    p = left + up - corner
    a, b, c = F.abs(p - left), F.abs(p - up), F.abs(p - corner)
    return F.when((a <= b) & (a <= c), left).when(b <= c, up).otherwise(corner)


def predicted(x: Column, up: Column, w: WindowSpec, step: int = 1) -> dict[str, Column]:
    """Residues 0..255 of a sample under each row filter; up: the sample above it."""
    left, corner = F.lag(x, step, 0).over(w), F.lag(up, step, 0).over(w)
    guess = {"none": F.lit(0), "sub": left, "up": up, "average": F.floor((left + up) / 2).cast("int"), "paeth": paeth(left, up, corner)}
    return {k: F.pmod(x - v, F.lit(256)) for k, v in guess.items()}


def best_filter(df: DataFrame, line: list[str], residues: dict[str, str]) -> DataFrame:
    """Per line the filter of the least sum of absolute signed residues, the first on ties."""
    cost = lambda c: F.sum(F.least(F.col(c), 256 - F.col(c)))
    sums = df.groupBy(*line).agg(*[cost(c).alias(f"__{k}") for k, c in residues.items()])
    best = F.array_min(F.array(*[F.struct(F.col(f"__{k}").alias("cost"), F.lit(i).alias("filter")) for i, k in enumerate(residues)]))
    return sums.select(*line, best["filter"].alias("filter"), best["cost"].alias("cost"))


def runs(df: DataFrame, line: list[str], order: list[str], value: str) -> DataFrame:
    """Runs of equal neighbours: line columns, run number from 1, value, length."""
    w = over(line, order)
    start = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    marked = df.withColumn("__s", start).withColumn("run", F.sum("__s").over(w))
    return marked.groupBy(*line, "run", value).agg(F.count(F.lit(1)).alias("length"))


def numbered(df: DataFrame, doc: list[str], order: list[str | Column], name: str = "page_no") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*doc).orderBy(*order)).cast("long"))


def page_slice(df: DataFrame, doc: list[str], order: list[str], start: int, length: int) -> DataFrame:
    """Rows start .. start + length - 1 of each document, from 1."""
    if start < 1 or length < 0:
        raise ValueError("pages count from 1")
    return numbered(df, doc, order).where(F.col("page_no").between(start, start + length - 1))


def running(df: DataFrame, doc: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Adds `name`: the sum of `value` over the document's rows before this one, 0 for the first.

    A document of any size is dealt out by ranges of its order: each range sums for itself, the
    ranges' totals are summed (a row per range), and both are added. Rows equal in doc and order
    may take either place.
    """
    parts = df.withColumn("__v", value).withColumn("__r", F.rand(7)).repartitionByRange(*doc, *order, "__r").withColumn("__p", F.spark_partition_id())
    parts = stored(parts, "ranges")
    totals = parts.groupBy(*doc, "__p").agg(F.sum("__v").alias("__t"))
    before = F.sum("__t").over(over(doc, ["__p"]).rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select(*[F.col(c).alias(f"__d{i}") for i, c in enumerate(doc)], F.col("__p").alias("__q"), F.coalesce(before, F.lit(0)).alias("__o"))
    inside = F.sum("__v").over(over([*doc, "__p"], [*order, "__r"]).rowsBetween(Window.unboundedPreceding, -1))
    on = [F.col(c).eqNullSafe(F.col(f"__d{i}")) for i, c in enumerate(doc)]
    joined = parts.withColumn("__i", F.coalesce(inside, F.lit(0))).join(offsets, [*on, F.col("__p") == F.col("__q")])
    return joined.withColumn(name, F.col("__o") + F.col("__i")).select(*df.columns, name)


def merge(files: list[DataFrame], order: list[str]) -> DataFrame:
    """All rows of files of one schema with file_no (from 1) and page_no. A file's rows are numbered in parts."""
    parts = [f.withColumn("file_no", F.lit(i)) for i, f in enumerate(files, 1)]
    placed = running(reduce(DataFrame.unionByName, parts), ["file_no"], order, F.lit(1), "page_no")
    return placed.withColumn("page_no", (F.col("page_no") + 1).cast("long"))


def final_state(events: DataFrame, key: list[str], order: str, event: str, transitions: dict[tuple[str, str], str], start: str, name: str = "state", chunk: int = 4096) -> DataFrame:
    """The state of a machine after each key's events in their order (a whole number).

    Events are cut into chunks by order div chunk. A chunk's events are folded for every state that
    the chunk may begin in; a key then folds its chunks' outcomes. No row holds more events than share
    a chunk. An event without a transition from the present state changes nothing.
    """
    states = sorted({start, *[s for s, _ in transitions], *transitions.values()})
    cut = F.floor(F.col(order) / chunk)
    chunks = events.groupBy(*key, cut.alias("__c")).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(event).alias("e")))).alias("l"))
    step = machine_step(transitions)
    ends = F.map_from_arrays(F.array(*[F.lit(s) for s in states]), F.array(*[F.aggregate("l", F.lit(s), lambda a, x: step(a, x["e"])) for s in states]))
    folded = chunks.select(*key, F.struct(F.col("__c").alias("c"), ends.alias("m")).alias("x"))
    # maps don't sort, so the chunks' numbers do
    listed = folded.groupBy(*key).agg(F.map_from_entries(F.collect_list("x")).alias("m"))
    state = F.aggregate(F.array_sort(F.map_keys("m")), F.lit(start), lambda a, c: F.col("m")[c][a])
    return listed.select(*key, state.alias(name))


def first_match(df: DataFrame, doc: list[str], order: list[str]) -> DataFrame:
    return numbered(df, doc, order, "__n").where("__n = 1").drop("__n")
