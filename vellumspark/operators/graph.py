"""References between objects: lookup, closure, renumbering, inheritance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumspark.operators.base import stored


def dereference(edges: DataFrame, objects: DataFrame, keys: list[str], target: list[str]) -> DataFrame:
    """Each edge with the object that its `target` columns name; nulls where there is none. One equi-join."""
    o = objects.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in objects.columns if c not in keys])
    on = [F.col(t) == F.col(f"__{k}") for t, k in zip(target, keys, strict=True)]
    return edges.join(o, on, "left").drop(*[f"__{k}" for k in keys])


#: Parts that a hot key of a reference join is split into, and the rows from which on a key is hot.
SALTS, HOT_ROWS = 16, 10_000
#: Rows of a side that Spark may send to the driver and to all executors; stored strings are many times their files' size, by which it would decide.
FEW_ROWS = 50_000


def _sized(rows: DataFrame, n: int) -> DataFrame:
    """A side of a join that isn't broadcast if it has many rows."""
    return rows.hint("merge") if n > FEW_ROWS else rows


def _spread(rows: DataFrame, by: str) -> DataFrame:
    return rows.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))


def _copied(rows: DataFrame) -> DataFrame:
    return rows.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _joined(many: DataFrame, links: DataFrame, key: str, by: str, n_links: int) -> DataFrame:
    """many joined to links by `key`. Only keys with HOT_ROWS rows of `many` or more are split, by `by`, so that links are copied for those alone."""
    hot = stored(many.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= HOT_ROWS).select(key), "hot")
    n_hot = hot.count()
    if not n_hot:
        return many.join(_sized(links, n_links), key)
    hot = F.broadcast(hot) if n_hot <= FEW_ROWS else hot
    cold = many.join(hot, key, "left_anti").join(_sized(links, n_links), key)
    split = _spread(many.join(hot, key, "left_semi"), by).join(_copied(links.join(hot, key, "left_semi")), [key, "__salt"])
    return cold.unionByName(split.drop("__salt"))


def follow(refs: DataFrame, links: DataFrame) -> DataFrame:
    """Follows chains of references (id, at) through links (at, next) to their ends; a cycle ends in null.

    Chains of any length: the jump table doubles its reach each round, and once it reaches further
    than there are links, what is still open goes round in a cycle. Each `at` has one link at most.
    Chains and jumps that have ended aren't carried into later rounds.
    """
    moving = stored(links.where("at is not null and next is not null").select("at", "next"), "jumps")
    most, reach, ended, done = moving.count(), 1, None, []
    out = refs.select("id", "at")
    while True:
        jump = moving if ended is None else moving.unionByName(ended)
        out = stored(out.join(_sized(jump, most), "at", "left").select("id", F.coalesce("next", "at").alias("at"), F.col("next").isNotNull().alias("open")), "chains")
        open_, last = out.where("open").limit(1).count(), reach > most
        done.append(out.select("id", F.when(~F.col("open"), F.col("at")).alias("at")) if open_ and last else out.where("not open").select("id", "at"))
        if not open_ or last:
            return reduce(DataFrame.unionByName, done)
        out = out.where("open").select("id", "at")
        far = jump.select(F.col("at").alias("next"), F.col("next").alias("far"))
        step = stored(moving.join(_sized(far, most), "next", "left").select("at", F.coalesce("far", "next").alias("next"), F.col("far").isNotNull().alias("moves")), "jumps")
        still = step.where("not moves").select("at", "next")
        moving, ended = step.where("moves").select("at", "next"), still if ended is None else ended.unionByName(still)
        reach *= 2


def closure(edges: DataFrame, starts: DataFrame, root: str = "root", node: str = "node") -> DataFrame:
    """All (root, node) that edges (src, dst) reach, starts (root, node) included.

    Rounds of a frontier join; each round keeps only what wasn't seen, so cycles end, and its result
    is stored once. As many rounds as the longest shortest path. Edges are stored once; those of a
    node that many roots reach in one round are joined in SALTS parts.
    """
    front = stored(starts.select(root, node).distinct(), "front")
    links = stored(edges.select(F.col("src").alias(node), "dst").distinct(), "edges")
    seen, n, n_links = front, front.count(), links.count()
    total = n
    while True:
        step = _joined(front, links, node, root, n_links) if n >= HOT_ROWS else front.join(_sized(links, n_links), node)
        new = step.select(root, F.col("dst").alias(node)).distinct()
        front = stored(new.join(_sized(seen, total), [root, node], "left_anti"), "front")
        n = front.count()
        if not n:
            return seen
        seen, total = seen.unionByName(front), total + n


def number(reached: DataFrame, root: str = "root", node: str = "node", first: int = 1) -> DataFrame:
    """New ids within each root, in the order of the old ones."""
    return reached.withColumn("new_id", (F.row_number().over(Window.partitionBy(root).orderBy(node)) + (first - 1)).cast("long"))


def renumber_edges(edges: DataFrame, ids: DataFrame, root: str = "root", node: str = "node") -> DataFrame:
    """Edges between reached nodes in new ids: root, src, dst. The second join is by (root, node); the first one splits nodes of many roots. Neither is broadcast."""
    a = ids.select(F.col(root), F.col(node).alias("src"), F.col("new_id").alias("new_src"))
    b = ids.select(F.col(root), F.col(node).alias("dst"), F.col("new_id").alias("new_dst")).hint("merge")
    return _joined(a, edges, "src", root, FEW_ROWS + 1).join(b, [root, "dst"]).select(root, F.col("new_src").alias("src"), F.col("new_dst").alias("dst"))


def inherit(levels: list[DataFrame], parents: list[str], keys: list[str], attributes: list[str]) -> DataFrame:
    """Attributes of the last level, each from the nearest ancestor that has it.

    levels: from the root down; parents[i] is level i + 1's column that names keys[i] of level i.
    """
    out = levels[0].select(F.col(keys[0]).alias("__key"), *attributes)
    for parent, key, level in zip(parents, keys[1:], levels[1:], strict=True):
        up = out.select(F.col("__key").alias("__up"), *[F.col(a).alias(f"__{a}") for a in attributes])
        out = level.join(up, F.col(parent) == F.col("__up"), "left").select(F.col(key).alias("__key"), *[F.coalesce(a, f"__{a}").alias(a) for a in attributes])
    return out.withColumnRenamed("__key", keys[-1])


def inherit_tree(nodes: DataFrame, attributes: list[str], doc: str = "doc_id", key: str = "num", parent: str = "parent") -> DataFrame:
    """The same in a tree of any depth: nodes whose parent is null are roots. A round per level, each stored; nodes on a cycle don't occur."""
    front = stored(nodes.where(F.col(parent).isNull()))
    out = front
    while True:
        up = front.select(doc, F.col(key).alias(parent), *[F.col(a).alias(f"__{a}") for a in attributes])
        cols = [F.coalesce(a, f"__{a}").alias(a) if a in attributes else F.col(a) for a in nodes.columns]
        front = stored(nodes.join(up, [doc, parent]).select(*cols))
        if not front.limit(1).count():
            return out
        out = out.unionByName(front)


def longest_prefix(rows: DataFrame, text: Column, prefixes: DataFrame, host_length: int | None = None) -> DataFrame:
    """Adds prefix and prefix_length: the longest of prefixes (prefix) that the text starts with, -1 if none.

    host_length: prefixes of that length (whole addresses) count only where no other one matches.
    Distinct texts are joined by their heads of all lengths that occur (numbers in one row, no more
    than the longest prefix has characters), then the rows by their text.
    """
    lengths = prefixes.select(F.length("prefix").alias("__n")).distinct().agg(F.collect_set("__n").alias("__ns"))
    known = prefixes.select("prefix").distinct()
    keyed = rows.withColumn("__t", text)
    heads = keyed.select("__t").distinct().join(F.broadcast(lengths)).select("__t", F.explode("__ns").alias("__n")).where(F.length("__t") >= F.col("__n"))
    heads = heads.select("__t", F.col("__t").substr(F.lit(1), F.col("__n")).alias("prefix"))
    rank = F.length("prefix") if host_length is None else F.when(F.length("prefix") == host_length, -1).otherwise(F.length("prefix"))
    best = heads.join(known, "prefix").groupBy("__t").agg(F.max_by("prefix", rank).alias("prefix"))
    out = keyed.join(best, "__t", "left").drop("__t")
    return out.withColumn("prefix_length", F.coalesce(F.length("prefix"), F.lit(-1)).cast("long"))


def newest_entries(entries: DataFrame, keys: list[str], order: str, gen: str | None = None, kind: str | None = None) -> DataFrame:
    """Of each key the entry of the newest section. A grouped maximum, combined before the shuffle.

    gen, kind: an older entry of a higher generation wins, but neither against nor as one of kind "c"
    (inside an object stream), whose `gen` is a place.
    """
    rest = [c for c in entries.columns if c not in keys]
    best = entries.groupBy(*keys)
    newest = F.max_by(F.struct(*rest), F.col(order)).alias("__e")
    if gen is None or kind is None:
        best = best.agg(newest)
    else:
        highest = F.max_by(F.when(F.col(kind) != "c", F.struct(*rest)), F.when(F.col(kind) != "c", F.struct(gen, order))).alias("__g")
        best = best.agg(newest, highest).withColumn("__e", F.when((F.col("__e")[kind] == "c") | F.col("__g").isNull(), F.col("__e")).otherwise(F.col("__g")))
    return best.select(*keys, *[F.col("__e")[c].alias(c) for c in rest])


def count_mismatches(children: DataFrame, parent: str, stored: DataFrame, key: str, count: str) -> DataFrame:
    """Parents with their stored and real number of children."""
    real = children.groupBy(F.col(parent).alias(key)).agg(F.count(F.lit(1)).alias("found"))
    return stored.select(key, count).join(real, key, "left").select(key, count, F.coalesce("found", F.lit(0)).alias("found")).withColumn("matches", F.col(count) == F.col("found"))
