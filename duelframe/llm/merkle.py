"""Merkle dataset manifest with bitmap-rank indexing (operator 12).

Every document is a leaf: the hash of its fields.  Per group (its source) the leaves stand in
the order of their ids and are hashed in runs of ``FANOUT`` until one node is left, the group's
subroot; the subroots, in the order of the groups, are hashed likewise to the root.  The hash
is lowercase hex SHA-256; digests are concatenated as hex text.

The place of a leaf comes from bitmaps, not from sorting the leaves.  A group's bitmap is a table
of its nonzero words of 64 ids, merged by ``bit_or`` over all rows, so it is compressed: an empty
range costs nothing.  Its popcount directory counts words into blocks of ``DIRECTORY`` words,
these into blocks of ``DIRECTORY`` blocks, and so on while a group has over ``TOP_BLOCKS`` blocks;
within a parent a running sum gives the count before each block, and sums from the top down give
the rank at which each word begins.  A rank query joins a leaf with its word and adds the bits
below its own.  No window holds more than ``TOP_BLOCKS`` or ``DIRECTORY`` rows of a group, however
many documents the group has.

A level is reduced by keyed slot arrays: node ``i`` goes to run ``i div FANOUT``, slot
``i mod FANOUT``, so a run is one row with an array of at most ``FANOUT`` hashes.  Proofs come from the
same rows from the top down: a run receives the siblings above it once, for all its members.

Defined results: null fields are ``-`` in a leaf; a null group is a group of its own, before all
others.  Null ids come before all others.  Documents of equal group and id stand in the order of
their leaf hashes (equal rows are interchangeable); a word's copies are counted beside its bits, and
an id with many copies is ranked by ranges of their hashes, so no such id meets in one task.  Ids are
compared as 64-bit integers.  An empty table has no rows and no root.  Columns other than the
named fields are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelframe.operators.batching import with_row_index
from duelframe.session import materialize

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 16
DIRECTORY = 512
TOP_BLOCKS = 4096
TIE_ROWS = 4096              # about so many copies of one id are sorted together
COPIES = 4096                # of equal rows, unfolded by one row


def leaf_hash(*fields: Column) -> Column:
    """The hash of fields: ``-`` for null, else UTF-8 byte count, ``:``, value."""
    parts = []
    for f in fields:
        s = f.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def group_key(group: Column) -> Column:
    """A text that is never null and sorts as groups do: null first, then UTF-8 bytewise."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def _before(size: str, by: list[str], order: str) -> Column:
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(size).over(w), F.lit(0))


def bitmap_index(keys: DataFrame, top_blocks: int = TOP_BLOCKS) -> DataFrame:
    """The bitmap and directory of (group, word, bit): one row per nonzero word with its ``bits``,
    the rank ``base`` of its first document, and ``extra``, the ids that several documents share, as
    (bit, copies beyond the first)."""
    ids = keys.groupBy("group", "word", "bit").agg(F.count("*").alias("copies"))
    shared = F.when(F.col("copies") > 1, F.struct("bit", (F.col("copies") - 1).alias("more")))
    words = materialize(ids.groupBy("group", "word").agg(
        F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"), F.sum("copies").alias("size"),
        F.collect_list(shared).alias("extra")), "merkle-words")                     # at most 64 entries
    directory = [words.withColumn("block", F.col("word"))]
    shift = DIRECTORY.bit_length() - 1
    while (directory[-1].groupBy("group").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0) > top_blocks:
        blocks = directory[-1].groupBy("group", F.shiftright("block", shift).alias("_up")).agg(F.sum("size").alias("size"))
        directory.append(materialize(blocks.withColumnRenamed("_up", "block"), "merkle-directory"))
    based = directory[-1].withColumn("base", _before("size", ["group"], "block"))
    for level in reversed(directory[:-1]):
        over = based.select("group", F.col("block").alias("_up"), F.col("base").alias("_base"))
        inside = _before("size", ["group", "_up"], "block")
        based = (level.withColumn("_up", F.shiftright("block", shift)).withColumn("_in", inside)
                 .join(over, ["group", "_up"]).withColumn("base", F.col("_base") + F.col("_in")).drop("_up", "_in", "_base"))
    return based.select("group", "word", "bits", "base", "extra")


def rank_leaves(leaves: DataFrame, top_blocks: int = TOP_BLOCKS) -> DataFrame:
    """``leaves`` (id, group, leaf and more) with ``rank``, the place in the group, and without
    further sorting of ids that are not shared."""
    # a null id has a word of its own below all others
    keyed = leaves.withColumn("word", F.coalesce(F.shiftright("id", 6), F.lit(-(1 << 57) - 1))).withColumn(
        "bit", F.coalesce(F.col("id").bitwiseAND(F.lit(63)), F.lit(0)).cast("int"))
    index = bitmap_index(keyed.select("group", "word", "bit"), top_blocks)
    below = F.bit_count(F.col("bits").bitwiseAND(F.expr("~shiftleft(-1L, bit)"))).cast("long")
    copies_below = F.aggregate(F.filter("extra", lambda x: x["bit"] < F.col("bit")), F.lit(0).cast("long"), lambda s, x: s + x["more"])
    more = F.aggregate(F.filter("extra", lambda x: x["bit"] == F.col("bit")), F.lit(0).cast("long"), lambda s, x: s + x["more"])
    placed = materialize(keyed.join(index, ["group", "word"])
                         .withColumn("rank", F.col("base") + below + copies_below).withColumn("more", more)
                         .select(*leaves.columns, "rank", "more"), "merkle-ranks")
    alone = placed.where("more = 0").drop("more")
    # documents that share an id: equal rows fold to one with a count, and the others stand by their hash
    digits = F.ceil(F.log2(F.greatest((F.col("more") + 1) / TIE_ROWS, F.lit(1.0))) / 4).cast("int")
    tied = (placed.where("more > 0").withColumn("_range", F.substring("leaf", F.lit(1), digits))
            .groupBy(*leaves.columns, "rank", "_range").agg(F.count("*").alias("_n")))
    ranges = tied.groupBy("group", "rank", "_range").agg(F.sum("_n").alias("_size"))
    ranges = ranges.select("group", "rank", "_range", _before("_size", ["group", "rank"], "_range").alias("_start"))
    order = Window.partitionBy("group", "rank", "_range").orderBy("leaf", *[c for c in leaves.columns if c not in ("leaf", "group")])
    inside = F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tied = (tied.withColumn("_in", inside).join(ranges, ["group", "rank", "_range"])
            .withColumn("_first", F.col("rank") + F.col("_start") + F.col("_in"))
            .withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(COPIES).cast("long"))))
            .repartition("group", "_first", "_part")       # one row may stand for very many
            .withColumn("rank", F.explode(F.sequence(F.col("_first") + F.col("_part"),
                                                     F.col("_first") + F.least(F.col("_part") + COPIES, F.col("_n")) - 1))))
    return alone.unionByName(tied.select(*alone.columns))


@dataclass
class Manifest:
    """Runs of every level below the subroots and of every level above them, and the root.

    ``runs[0]`` has (group, run, n, members), members being the documents of a run by slot with
    their hashes; ``runs[k]`` and ``tops[k]`` have (group, run, n, hashes)."""

    runs: list[DataFrame]
    tops: list[DataFrame]
    subroots: DataFrame          # group, place, subroot
    root: str | None


def _node(hashes) -> Column:
    return F.sha2(F.array_join(hashes, ""), 256)


def _reduce(nodes: DataFrame, most: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Runs of each level, and the last node of every group; ``nodes`` has group, i, n (nodes of the
    group at this level) and hash, and ``most`` is the largest n."""
    runs, tops = [], []
    while most > 1:
        tops.append(nodes.where("n = 1").select("group", "hash"))
        level = materialize(_slots(nodes.where("n > 1"), ["hash"], "slots").select("group", "run", "n", F.col("slots.hash").alias("hashes")), name)
        runs.append(level)
        nodes = level.select("group", F.col("run").alias("i"), F.ceil(F.col("n") / FANOUT).cast("long").alias("n"), _node("hashes").alias("hash"))
        most = math.ceil(most / FANOUT)
    last = nodes.where("n = 1").select("group", "hash")
    for t in tops:
        last = last.unionByName(t)
    return runs, last


def _slots(nodes: DataFrame, columns: list[str], name: str) -> DataFrame:
    """(group, run, n, slots): the slot array of every run, at most ``FANOUT`` structs."""
    slot = F.pmod("i", F.lit(FANOUT)).cast("int").alias("slot")
    return (nodes.groupBy("group", F.floor(F.col("i") / FANOUT).cast("long").alias("run"), "n")
            .agg(F.sort_array(F.collect_list(F.struct(slot, *columns))).alias(name)))


def build(docs: DataFrame, id_col: str = "doc_id", group_col: str = "source", fields: tuple[str, ...] = FIELDS,
          carry: dict[str, Column] | None = None, top_blocks: int = TOP_BLOCKS) -> Manifest:
    """The manifest of ``docs``; ``carry`` adds columns (of the documents) to the members."""
    carry = carry or {}
    leaves = materialize(docs.select(F.col(id_col).cast("long").alias("id"), group_key(F.col(group_col)).alias("group"),
                                     leaf_hash(*[F.col(f) for f in fields]).alias("leaf"),
                                     *[c.alias(n) for n, c in carry.items()]), "merkle-leaves")
    sizes = leaves.groupBy("group").agg(F.count("*").alias("n"))
    most = sizes.agg(F.max("n")).first()[0] or 0
    ranked = rank_leaves(leaves, top_blocks).join(sizes, "group").withColumnRenamed("rank", "i")
    bottom = materialize(_slots(ranked, ["id", "leaf", *carry], "members"), "merkle-runs")
    lone = bottom.where("n = 1").select("group", F.element_at("members", 1)["leaf"].alias("hash"))
    up = bottom.where("n > 1").select("group", F.col("run").alias("i"), F.ceil(F.col("n") / FANOUT).cast("long").alias("n"),
                                      _node("members.leaf").alias("hash"))
    runs, last = _reduce(up, math.ceil(most / FANOUT), "merkle-level")
    subroots = materialize(with_row_index(last.unionByName(lone).withColumnRenamed("hash", "subroot"), ["group"], name="place"), "merkle-subroots")
    groups = subroots.count()
    above = subroots.select(F.lit("").alias("group"), F.col("place").alias("i"), F.lit(groups).cast("long").alias("n"), F.col("subroot").alias("hash"))
    tops, root = _reduce(above, groups, "merkle-top")
    found = root.first()
    return Manifest([bottom, *runs], tops, subroots, found["hash"] if found else None)


def _step(hashes: Column, slot: Column) -> Column:
    """A level of a proof: the siblings left and right of a slot (counted from 0)."""
    return F.struct(F.array_join(F.slice(hashes, F.lit(1), slot), "").alias("left"),
                    F.array_join(F.slice(hashes, slot + 2, F.lit(FANOUT)), "").alias("right"))


def _with_paths(level: DataFrame, above: DataFrame, below_top: DataFrame | None) -> DataFrame:
    """``level`` with the ``path`` of each run's parent: the group's last node has that of ``above``
    (group, path), any other that of its place in the run over it (group, run, path)."""
    last = level.where(F.col("n") <= FANOUT).join(above, "group")
    if below_top is None:
        return last
    return last.unionByName(level.where(F.col("n") > FANOUT).join(below_top, ["group", "run"]))


def _passed_down(runs: list[DataFrame], above: DataFrame) -> DataFrame | None:
    """(group, run, path) for the members of the lowest level of ``runs``, from the top down."""
    paths = None
    for level in reversed(runs):
        each = _with_paths(level, above, paths).select("group", "run", "hashes", "path", F.posexplode("hashes").alias("_slot", "_hash"))
        paths = each.select("group", (F.col("run") * FANOUT + F.col("_slot")).alias("run"),
                            F.concat(F.array(_step(F.col("hashes"), F.col("_slot"))), F.col("path")).alias("path"))
    return paths


def proofs(manifest: Manifest) -> DataFrame:
    """One row per document: id, group, leaf and carried columns, ``subroot``, and ``path``, the
    siblings (left, right) of every level from its run to the root."""
    empty = F.array().cast("array<struct<left:string,right:string>>")
    start = manifest.subroots.sparkSession.range(1).select(F.lit("").alias("group"), empty.alias("path"))
    top = _passed_down(manifest.tops, start)
    if top is None:                                        # at most one group: its subroot is the root
        above = manifest.subroots.select("group", "subroot", empty.alias("path"))
    else:
        above = manifest.subroots.join(top.select(F.col("run").alias("place"), "path"), "place").select("group", "subroot", "path")
    above = materialize(above, "merkle-top-paths")
    bottom, *upper = manifest.runs
    rows = (_with_paths(bottom, above.select("group", "path"), _passed_down(upper, above.select("group", "path")))
            .join(above.select("group", "subroot"), "group"))
    each = rows.select("group", "subroot", "n", "path", F.col("members.leaf").alias("_hashes"), F.posexplode("members").alias("_slot", "_m"))
    own = F.when(F.col("n") > 1, F.array(_step(F.col("_hashes"), F.col("_slot")))).otherwise(empty)
    fields = [f for f in each.schema["_m"].dataType.names if f != "slot"]
    return each.select("group", "subroot", *[F.col("_m")[f].alias(f) for f in fields], F.concat(own, "path").alias("path"))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def proof_hash(path: Column) -> Column:
    """The hash of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)
