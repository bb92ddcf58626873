"""Shards by weighted hash draws down a tree of regions, racks and shards."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass
class Node:
    """A region, rack or shard. A shard has a number and a weight; others weigh what their children do."""

    name: str
    children: list[Node] = field(default_factory=list)
    shard: int = -1
    own: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own


def tree(shards: int, racks: int = 2, per_rack: int = 2, weights: dict[int, float] | None = None) -> Node:
    """Shard s stands in rack s // per_rack, which stands in region s // (racks * per_rack).

    Names depend on the place alone, so a new shard in a rack of its own changes no other subtree's
    weight.
    """
    top = Node("top")
    for s in range(shards):
        r, k = s // (racks * per_rack), s // per_rack
        if r == len(top.children):
            top.children.append(Node(f"region{r}"))
        region = top.children[r]
        if not region.children or region.children[-1].name != f"rack{k}":
            region.children.append(Node(f"rack{k}"))
        region.children[-1].children.append(Node(f"shard{s}", [], s, (weights or {}).get(s, 1.0)))
    return top


def _draw(key: Column, child: Node) -> Column:
    """An exponential draw of the child's weight; it depends on nothing but key, name and weight."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(child.name)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(u) / child.weight


def descend(node: Node, key: Column) -> Column:
    """The shard where the least draw leads, level by level. A child whose weight is 0 gets nothing."""
    if not node.children:
        return F.lit(node.shard)
    live = [c for c in node.children if c.weight > 0]
    if not live:
        raise ValueError(f"{node.name} has no weight")
    if len(live) == 1:
        return descend(live[0], key)
    best = F.array_min(F.array(*[F.struct(_draw(key, c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(live)]))["i"]
    out = F.when(best == 0, descend(live[0], key))
    for i, c in enumerate(live[1:], 1):
        out = out.when(best == i, descend(c, key))
    return out


def assign(docs: DataFrame, top: Node, name: str = "shard", key: str = "doc_id", text: str = "text") -> DataFrame:
    """Adds (or replaces) the column `name` with the shard of each row. Expressions only, no shuffle.

    The key alone decides, so repeated rows share a shard, and texts of any length cost nothing; rows
    whose key is null are dealt by a hash of their text, and go to one shard if that is null too. A tie
    of draws goes to the child first in the tree. An empty table stays empty.
    """
    k = F.xxhash64(F.col(key), F.when(F.col(key).isNull(), F.col(text)))
    return docs.withColumn(name, descend(top, k).cast("int"))


def with_slots(rows: DataFrame, shard: str = "shard", name: str = "slot", buckets: int = 1024) -> DataFrame:
    """Adds a number from 0 without gaps within each shard (null is a shard too). rows' columns must be orderable.

    Equal rows are counted first and spread again at the end, so many copies of one row aren't
    sorted. The distinct ones are numbered within hash buckets of their shard, and each bucket starts
    where the one before ends; no task sorts a whole shard.
    """
    cols = rows.columns
    counted = rows.groupBy(*cols).agg(F.count(F.lit(1)).alias("__n")).withColumn("__b", F.pmod(F.xxhash64(*cols), F.lit(buckets)).cast("int"))
    totals = counted.groupBy(shard, "__b").agg(F.sum("__n").alias("__t"))
    before = F.sum("__t").over(Window.partitionBy(shard).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select(F.col(shard).alias("__s"), F.col("__b").alias("__k"), F.coalesce(before, F.lit(0)).alias("__o"))
    inside = F.sum("__n").over(Window.partitionBy(shard, "__b").orderBy(*cols).rowsBetween(Window.unboundedPreceding, -1))
    placed = counted.withColumn("__i", F.coalesce(inside, F.lit(0)))
    placed = placed.join(offsets, F.col(shard).eqNullSafe(F.col("__s")) & (F.col("__b") == F.col("__k")))
    first = F.col("__o") + F.col("__i")
    return placed.select(*cols, F.explode(F.sequence(first, first + F.col("__n") - 1)).alias(name))


def placement(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each row; other columns are ignored.

    A null text counts as empty (size 1). Repeated rows have a slot each; an empty table gives an empty one.
    """
    text = F.coalesce("text", F.lit(""))
    rows = assign(assign(docs.select("doc_id", "text"), tree(shards)), tree(shards + 1), "grown_shard")
    rows = rows.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"), "shard", "grown_shard")
    return with_slots(rows).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
