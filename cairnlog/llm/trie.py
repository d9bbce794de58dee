"""The trie of conversations that begin alike, by the skeleton of range splitters.

A node is a distinct sequence of first turns, its members are the conversations
that begin with it.  Conversations are sorted by their sequences of turn digests
and dealt in ranges.  The ranges are cut at short prefixes of sampled sequences
(splitters), and the trie of these splitters, the skeleton, is broadcast: a proper
prefix of a splitter may have members in several ranges, any other node has all
its members in one.  So a sorted range finishes its own nodes with a stack, and
of skeleton nodes it gives sums, which are reduced over the ranges.

No conversation has to fit a task.  Turns are numbered over ranges of (conversation,
turn), equal conversations are one sequence with a count, and a sequence is cut in
pieces of ``width`` turns: a further piece belongs to a trie of its own below the
node where it goes on.  Tries of lower pieces are finished first and give their
sums to the node above; where one conversation is left alone its pieces are chains
and need no trie.  Turns and prefixes are told apart by 128 bits of hash.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, settle
from .common import partitions

#: Turns in one piece of a sequence.
WIDTH = 512
#: Sampled sequences for each range.
SAMPLED = 32
#: Conversation numbers that are listed together before a list of members is hashed: 2 ** BLOCK.
BLOCK = 12
_NONE = hashlib.sha256(b"").hexdigest()
_NODE = (
    "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint,"
    " saved_tokens bigint, ends_sha256 string"
)
COLUMNS = [part.split()[0] for part in _NODE.split(",")]
#: ``part``, ``up``: numbers of a skeleton node and of a skeleton parent; ``own_*``: the prefix that goes on below;
#: ``top_*``: the prefix whose node is the parent, in another piece; ``weight``, ``once``: terms of a skeleton node's saved tokens.
_FOUND = _NODE + ", part int, up int, own_a bigint, own_b bigint, top_a bigint, top_b bigint, weight bigint, once bigint"


def numbered(df: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, depth, a, b, size) of every turn: its place from 1, the digest of role and text, the text's code points.

    Turns are in the order of ``order``, nulls first, ties in the order of their
    digests; null roles and texts are empty.  Rows without a key belong to no
    conversation and are left out.  Repeated rows are turns of their own.
    """
    role_, text_ = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role, text))
    turns = df.where(F.col(f"`{key}`").isNotNull()).select(
        F.col(f"`{key}`").cast("bigint").alias("conv"),
        F.col(f"`{order}`").alias("turn"),
        F.xxhash64(role_, text_).alias("a"),
        F.xxhash64(F.lit(1), text_, role_).alias("b"),
        F.char_length(text_).cast("bigint").alias("size"),
    )
    # a conversation of any length lies in as many ranges as it needs; a range begins inside one conversation at most
    dealt = settle(turns.repartitionByRange("conv", "turn", "a", "b").withColumn("block", F.spark_partition_id()))
    counts = dealt.groupBy("conv", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    opened = settle(counts.withColumn("before", F.sum("n").over(before)).where("before is not null").select("conv", "block", "before"))
    place = F.row_number().over(Window.partitionBy("conv", "block").orderBy(F.col("turn").asc_nulls_first(), "a", "b"))
    placed = dealt.withColumn("place", place).join(broadcast_if_small(opened, opened.count(), 40), ["conv", "block"], "left")
    return placed.select("conv", (F.col("place") + F.coalesce("before", F.lit(0))).alias("depth"), "a", "b", "size")


def prefix_trie(turns: DataFrame, members: DataFrame, width: int = WIDTH, ranges: int | None = None) -> DataFrame:
    """The nodes of the trie of ``turns`` (conv, depth, a, b, size); ``members`` (conv) lists all conversations, turnless too.

    Per node: conv_id (its least member), depth, parent_conv_id (its parent's; null
    at the root), n_convs, n_children, n_leaves (childless nodes in its subtree,
    itself included), saved_tokens (over its subtree, members less one times the
    size of the node's last text) and ends_sha256 (of the comma-joined ascending
    numbers of the members that end there).  Without members there are no nodes.
    """
    paths = settle(_paths(_pieces(turns, members, width)))
    ranges = ranges or partitions(turns.sparkSession)
    roots = paths.where("level > 0").groupBy("level", "pa", "pb").agg(F.sum("n").alias("members"))
    alone = settle(roots.where("members = 1").drop("members"))
    shared = settle(roots.where("members > 1").drop("members"))
    deepest = shared.agg(F.max("level")).first()[0] or 0
    chains = paths.join(alone, ["level", "pa", "pb"])
    tops = alone.select("level", "pa", "pb", F.lit(1).cast("bigint").alias("kids"), F.lit(1).cast("bigint").alias("leaves"), F.lit(0).cast("bigint").alias("saved"))
    found = [_chains(chains, width)]
    for level in range(deepest, -1, -1):
        own = paths.where(F.col("level") == level)
        if level:
            own = own.join(shared, ["level", "pa", "pb"], "left_semi")
        below = tops.where(F.col("level") == level + 1).select(F.col("pa").alias("ea"), F.col("pb").alias("eb"), "kids", "leaves", "saved")
        nodes = settle(_level(own.join(below, ["ea", "eb"], "left"), level, width, ranges))
        found.append(nodes.where("depth is not null"))
        tops = tops.unionByName(
            nodes.where("depth is null").select(
                F.lit(level).alias("level"), F.col("top_a").alias("pa"), F.col("top_b").alias("pb"),
                F.col("n_children").alias("kids"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"),
            )
        )
    nodes = reduce(DataFrame.unionByName, found)
    ends = nodes.where("own_a is not null").select(F.col("own_a").alias("top_a"), F.col("own_b").alias("top_b"), F.col("conv_id").alias("above"))
    hanging = nodes.where("top_a is not null").join(ends, ["top_a", "top_b"]).withColumn("parent_conv_id", F.col("above"))
    return nodes.where("top_a is null").select(*COLUMNS).unionByName(hanging.select(*COLUMNS))


def _pieces(turns: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """(conv, level, path, pa, pb, ea, eb, last): the pieces of every sequence, with the digests of the prefixes before and up to them."""
    marks = members.select("conv", *[F.lit(0).cast("bigint").alias(c) for c in ("depth", "a", "b", "size")])
    rows = turns.select("conv", F.col("depth").cast("bigint"), "a", "b", "size").unionByName(marks)
    level = F.expr(f"int(greatest(depth - 1, 0) div {width})").alias("level")
    inner = F.col("depth") > 0
    pieces = rows.groupBy("conv", level).agg(
        F.sort_array(F.collect_list(F.when(inner, F.struct("depth", "a", "b", "size")))).alias("path"),
        F.coalesce(F.bit_xor(F.when(inner, F.xxhash64("a", "b", "depth"))), F.lit(0)).alias("xa"),
        F.coalesce(F.bit_xor(F.when(inner, F.xxhash64(F.lit(1), "depth", "b", "a"))), F.lit(0)).alias("xb"),
    )
    pieces = settle(pieces)
    order = Window.partitionBy("conv").orderBy("level")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    places = pieces.select(
        "conv", "level", "xa", "xb",
        F.bit_xor("xa").over(upto).alias("ea"), F.bit_xor("xb").over(upto).alias("eb"),
        F.lead("level").over(order).isNull().alias("last"),
    )
    places = places.withColumns({"pa": F.col("ea").bitwiseXOR(F.col("xa")), "pb": F.col("eb").bitwiseXOR(F.col("xb"))}).drop("xa", "xb")
    return pieces.select("conv", "level", "path").join(places, ["conv", "level"])


def _paths(pieces: DataFrame) -> DataFrame:
    """Distinct pieces: (level, pa, pb, ea, eb, keys, sizes, n, least, more, ends); the digest of the members that end with it."""
    key = ["level", "pa", "pb", "ea", "eb"]
    block = F.when(F.col("last"), F.shiftright("conv", BLOCK)).alias("block")
    keys = F.flatten(F.transform("path", lambda t: F.array(t["a"], t["b"]))).alias("keys")
    sizes = F.transform("path", lambda t: t["size"]).alias("sizes")
    lists = pieces.select(*key, "conv", "last", block, keys, sizes).groupBy(*key, "last", "block").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("conv").alias("least"),
        F.sort_array(F.collect_list(F.when(F.col("last"), F.col("conv")))).alias("ids"),
        F.first("keys").alias("keys"),
        F.first("sizes").alias("sizes"),
    )
    lists = lists.withColumn("ids", F.encode(F.array_join(F.col("ids").cast("array<string>"), ","), "utf-8"))
    # the members that end with one sequence are hashed in order, list by list
    lists = lists.repartition(*key).sortWithinPartitions(*key, "last", "block")
    kinds = dict(lists.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*key, "keys", "sizes", "n", "least"]) + ", more boolean, ends string"

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in schema.split(", ")]
        kind = pa.schema([(c, batch_type) for c, batch_type in zip(names, _arrow_types(schema), strict=True)])
        row, digest, out = None, None, []
        for batch in batches:
            for r in batch.to_pylist():
                if row is None or any(row[c] != r[c] for c in key):
                    if row is not None:
                        out.append(row | {"ends": digest and digest.hexdigest()})
                        if len(out) >= 2000:
                            yield pa.RecordBatch.from_pylist(out, kind)
                            out = []
                    row, digest = {c: r[c] for c in [*key, "keys", "sizes"]} | {"n": 0, "least": r["least"], "more": False}, None
                row["n"] += r["n"]
                row["least"] = min(row["least"], r["least"])
                if not r["last"]:
                    row["more"] = True
                elif digest is None:
                    digest = hashlib.sha256(r["ids"])
                else:
                    digest.update(b"," + r["ids"])
        if row is not None:
            out.append(row | {"ends": digest and digest.hexdigest()})
            yield pa.RecordBatch.from_pylist(out, kind)

    return lists.mapInArrow(merge, schema)


def _arrow_types(schema: str) -> list[pa.DataType]:
    named = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64())}
    return [named[part.split()[1]] for part in schema.split(", ")]


def _chains(paths: DataFrame, width: int) -> DataFrame:
    """Nodes of pieces that no other conversation shares."""
    one = F.lit(1).cast("bigint")
    nodes = paths.select("*", F.posexplode("sizes").alias("i", "size")).withColumn("end", F.col("i") == F.size("sizes") - 1)
    first, goes_on = F.col("i") == 0, F.col("end") & F.col("more")
    return nodes.select(
        F.col("least").alias("conv_id"),
        (F.col("level").cast("bigint") * width + F.col("i") + 1).alias("depth"),
        F.when(~first, F.col("least")).alias("parent_conv_id"),
        one.alias("n_convs"),
        F.when(F.col("end") & ~F.col("more"), 0).otherwise(one).alias("n_children"),
        one.alias("n_leaves"),
        F.lit(0).cast("bigint").alias("saved_tokens"),
        F.when(F.col("end"), F.coalesce("ends", F.lit(_NONE))).otherwise(_NONE).alias("ends_sha256"),
        F.lit(-1).alias("part"),
        F.lit(-1).alias("up"),
        F.when(goes_on, F.col("ea")).alias("own_a"),
        F.when(goes_on, F.col("eb")).alias("own_b"),
        F.when(first, F.col("pa")).alias("top_a"),
        F.when(first, F.col("pb")).alias("top_b"),
        F.lit(0).cast("bigint").alias("weight"),
        F.lit(0).cast("bigint").alias("once"),
    )


class Skeleton:
    """The trie of the splitters: which nodes more than one range may have members of."""

    def __init__(self, sample: list[tuple[tuple[int, ...], tuple[int, ...]]], ranges: int) -> None:
        """``sample``: (elements, sizes) of sequences; two elements a turn, the first two are the piece's prefix."""
        sample = sorted(set(sample))
        self.splitters: list[tuple[int, ...]] = []
        sizes: dict[tuple[int, ...], int] = {}
        for i in range(1, ranges):
            at = i * len(sample) // ranges
            if not at or (self.splitters and sample[at][0] < self.splitters[-1]):
                continue
            (before, _), (here, lengths) = sample[at - 1], sample[at]
            common = 0
            while common < min(len(before), len(here)) and before[common : common + 2] == here[common : common + 2]:
                common += 2
            splitter = here[: common + 2]  # no longer than what tells it from the one before
            if self.splitters and splitter <= self.splitters[-1]:
                continue
            self.splitters.append(splitter)
            for end in range(2, len(splitter), 2):
                sizes[splitter[:end]] = lengths[end // 2 - 2] if end > 2 else 0
        #: per node: number, its parent's, children in the skeleton, the sizes of its subtree's skeleton nodes
        self.nodes: dict[tuple[int, ...], list[int]] = {}
        for prefix in sorted(sizes):
            up = self.nodes.get(prefix[:-2])
            self.nodes[prefix] = [len(self.nodes), up[0] if up else -1, 0, sizes[prefix]]
            if up:
                up[2] += 1
        for prefix in sorted(sizes, key=len, reverse=True):
            if prefix[:-2] in self.nodes:
                self.nodes[prefix[:-2]][3] += self.nodes[prefix][3]

    def number(self, prefix: tuple[int, ...]) -> int:
        node = self.nodes.get(prefix)
        return node[0] if node else -1

    def range_of(self, elements: tuple[int, ...]) -> int:
        return bisect.bisect_right(self.splitters, elements)


def _level(paths: DataFrame, level: int, width: int, ranges: int) -> DataFrame:
    """All nodes of the pieces ``paths`` of one level; rows without a depth are sums of a whole piece's trie for the node above it."""
    spark = paths.sparkSession
    sample = paths.select("pa", "pb", "keys", "sizes").orderBy(F.xxhash64("pa", "pb", "keys", F.lit("sample"))).limit(SAMPLED * ranges).collect()
    skeleton = Skeleton([((r["pa"], r["pb"], *r["keys"]), tuple(r["sizes"])) for r in sample], ranges)
    shared = spark.sparkContext.broadcast(skeleton)  # at most a splitter of ``width`` turns for each range

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = zip(batch["pa"].to_pylist(), batch["pb"].to_pylist(), batch["keys"].to_pylist(), strict=True)
            numbers = [shared.value.range_of((a, b, *keys)) for a, b, keys in heads]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int32())], names=[*batch.schema.names, "dealt"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in paths.dtypes)
    dealt = paths.mapInArrow(deal, kinds + ", dealt int").repartition(ranges, "dealt").sortWithinPartitions("dealt", "pa", "pb", "keys")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema(list(zip([p.split()[0] for p in _FOUND.split(", ")], _arrow_types(_FOUND), strict=True)))
        work = _Range(shared.value, level, width)
        for batch in batches:
            for r in batch.to_pylist():
                work.take(r)
            if len(work.out) >= 2000:
                yield pa.RecordBatch.from_pylist(work.out, kind)
                work.out = []
        work.close()
        yield pa.RecordBatch.from_pylist(work.out, kind)

    found = settle(dealt.mapInArrow(finish, _FOUND))
    rows = [(number, up, kids, size, len(p) // 2 - 1, p[0], p[1]) for p, (number, up, kids, size) in skeleton.nodes.items()]
    fixed = spark.createDataFrame(rows, "part int, up int, kids int, size bigint, i int, a bigint, b bigint")
    sums = found.where("part >= 0").groupBy("part").agg(
        F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "weight", "once")],
        *[F.max(c).alias(c) for c in ("ends_sha256", "own_a", "own_b")],
    )
    sums = settle(sums.join(F.broadcast(fixed), "part"))  # at most the nodes of the skeleton
    above = sums.select(F.col("part").alias("up"), F.col("conv_id").alias("above"))
    joint = sums.join(F.broadcast(above), "up", "left").select(
        "conv_id",
        (F.lit(level * width).cast("bigint") + F.col("i")).alias("depth"),
        F.col("above").alias("parent_conv_id"),
        "n_convs",
        (F.col("n_children") + F.col("kids")).alias("n_children"),
        "n_leaves",
        (F.col("weight") - F.col("once") - F.col("size")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(_NONE)).alias("ends_sha256"),
        F.lit(-1).alias("part"), "up", "own_a", "own_b",
        F.when((F.col("i") == 1) & F.lit(level > 0), F.col("a")).alias("top_a"),
        F.when((F.col("i") == 1) & F.lit(level > 0), F.col("b")).alias("top_b"),
        "weight", "once", "i", "a", "b",
    )
    own = found.where("part < 0").join(F.broadcast(above), "up", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above"))
    if level:  # the first node of a piece stands for the node above, which counts its members itself
        top = joint.where("i = 0").withColumns({"depth": F.lit(None).cast("bigint"), "top_a": F.col("a"), "top_b": F.col("b")})
        joint = joint.where("i > 0").unionByName(top)
    names = found.columns
    return own.select(*names).unionByName(joint.select(*names))


class _Range:
    """The open nodes of a sorted range, from the first of a piece's trie down to the last turn read."""

    def __init__(self, skeleton: Skeleton, level: int, width: int) -> None:
        self.skeleton, self.level, self.width = skeleton, level, width
        self.elements: tuple[int, ...] = ()
        self.open: list[dict] = []
        self.dealt: int | None = None
        self.out: list[dict] = []

    def take(self, r: dict) -> None:
        elements = (r["pa"], r["pb"], *r["keys"])
        if r["dealt"] != self.dealt:
            self.close()
            self.dealt = r["dealt"]
        common = 0
        limit = min(len(elements), len(self.elements))
        while common < limit and elements[common : common + 2] == self.elements[common : common + 2]:
            common += 2
        while len(self.open) > common // 2:
            self._pop()
        for i in range(common // 2, len(elements) // 2):
            # below a node that one range has whole, so are all others
            whole = bool(self.open) and self.open[-1]["part"] < 0
            self.open.append(
                {"part": -1 if whole else self.skeleton.number(elements[: 2 * i + 2]), "size": r["sizes"][i - 1] if i else 0,
                 "n": 0, "least": r["least"], "kids": 0, "leaves": 0, "weight": 0, "once": 0,
                 "ends": None, "own": (None, None), "waiting": []}
            )
        self.elements = elements
        node = self.open[-1]
        node["n"] += r["n"]
        node["least"] = min(node["least"], r["least"])
        node["ends"] = r["ends"]
        if r["more"]:
            node["own"] = (r["ea"], r["eb"])
            node["kids"] += r["kids"]
            node["leaves"] += r["leaves"]
            node["weight"] += r["saved"]

    def close(self) -> None:
        while self.open:
            self._pop()
        self.elements = ()

    def _pop(self) -> None:
        node = self.open.pop()
        i = len(self.open)
        up = self.open[-1] if self.open else None
        whole = node["part"] < 0
        node["weight"] += node["n"] * node["size"]
        if whole:
            node["once"] += node["size"]
            node["leaves"] += not node["kids"]
        first = self.level > 0 and i == 1
        row = {
            "conv_id": node["least"], "depth": self.level * self.width + i, "parent_conv_id": None, "n_convs": node["n"],
            "n_children": node["kids"], "n_leaves": node["leaves"], "saved_tokens": node["weight"] - node["once"],
            "ends_sha256": (node["ends"] or _NONE) if whole else node["ends"],
            "part": node["part"], "up": up["part"] if up else -1,
            "own_a": node["own"][0], "own_b": node["own"][1],
            "top_a": self.elements[0] if first else None, "top_b": self.elements[1] if first else None,
            "weight": node["weight"], "once": node["once"],
        }
        if self.level and not i and whole:
            row |= {"depth": None, "top_a": self.elements[0], "top_b": self.elements[1]}
        for child in node["waiting"]:
            child["parent_conv_id"] = node["least"]
        self.out += node["waiting"]
        if up is None or not whole or up["part"] >= 0:
            self.out.append(row)
        else:
            up["waiting"].append(row)  # until the parent's least member is known
        if up is not None:
            up["n"] += node["n"]
            up["least"] = min(up["least"], node["least"])
            up["kids"] += whole
            for c in ("leaves", "weight", "once"):
                up[c] += node[c]


def rebuilt(turns: DataFrame, every: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """(turns, members) of conversations that begin like the one whose number is the next lower multiple of ``every``.

    Of conversation c, the first h = crc32(decimal c) % ``most`` turns are those of
    c - c % ``every`` (all if it has fewer, none if it is absent), then follow c's
    own turns after its first h.
    """
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % most
    base = F.col("conv") - F.col("conv") % every
    members = turns.select("conv").distinct()
    leads = turns.where((F.col("conv") % every == 0) & (F.col("depth") < most)).groupBy(F.col("conv").alias("base")).agg(
        F.sort_array(F.collect_list(F.struct("depth", "a", "b", "size"))).alias("lead")
    )
    leads = settle(leads)
    near = broadcast_if_small(leads, leads.count(), 16 + 32 * most)
    lead = F.coalesce("lead", F.array().cast(leads.schema["lead"].dataType))
    first = members.withColumn("base", base).join(near, "base").select("conv", F.explode(F.expr(f"slice(lead, 1, int({_text_h(most)}))")).alias("t"))
    own = turns.where(F.col("depth") > h).withColumn("base", base).join(near, "base", "left")
    shift = h - F.least(h, F.size(lead).cast("bigint"))
    own = own.select("conv", (F.col("depth") - shift).alias("depth"), "a", "b", "size")
    return first.select("conv", "t.*").unionByName(own), members


def _text_h(most: int) -> str:
    return f"crc32(cast(cast(conv as string) as binary)) % {most}"
