"""Merkle manifest of a dataset, with a witness for every row.

Per source, leaves ascend by doc_id; while a level has several nodes, every 16 neighbours become their hash. The sources'
roots, ordered by source, are hashed likewise. Blocks are aligned runs of 4,096 leaves. In a task, a block's leaves are
appended to a tree one after another; a completed run of siblings extends the witness of every leaf below it.
Block roots are appends to the next round's trees, so a source with most of the rows is many tasks. Rounds are as many as
the longest source needs; each goes to the shared folder. On the way back a block's witnesses are extended by that of its root.

Defined cases: a null field is `-`; rows of equal doc_id are ordered by leaf, null doc_ids come first; repeated rows are
leaves as often as they occur; a null source is a source of its own, before all others; an empty table has no rows and no root.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from watchtide.llm.text import pick
from watchtide.session import cut_lineage

ARITY = 16
#: Levels of a block.
DEPTH = 3
BLOCK = ARITY**DEPTH
_STEPS = "array<struct<place:int,siblings:string>>"
_STEP = pa.list_(pa.struct([("place", pa.int32()), ("siblings", pa.string())]))


def field(value: Column) -> Column:
    """One field of a leaf: `-`, or its UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*fields: Column) -> Column:
    return F.sha2(F.concat(*map(field, fields)), 256)


class Tree:
    """A hash tree that grows at its right end.

    `open[l]` are the nodes of level l that wait for siblings, each with the range of leaves below; `made[l]` counts all nodes
    of the level so far. `witness[i]` is what is known of leaf i's: per level, its place in the run and the siblings.
    """

    def __init__(self):
        self.open: list[list[tuple[str, int, int]]] = [[]]
        self.made = [0]
        self.witness: list[list[tuple[int, str]]] = []

    def append(self, digest: str) -> None:
        at = len(self.witness)
        self.witness.append([])
        self._push(0, digest, at, at + 1)

    def _push(self, level: int, digest: str, first: int, end: int) -> None:
        if level == len(self.open):
            self.open.append([])
            self.made.append(0)
        self.open[level].append((digest, first, end))
        self.made[level] += 1
        if len(self.open[level]) == ARITY:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        digests = [d for d, _, _ in run]
        for place, (_, first, end) in enumerate(run):
            step = (place, "".join(digests[:place] + digests[place + 1 :]))
            for at in range(first, end):
                self.witness[at].append(step)
        self._push(level + 1, hashlib.sha256("".join(digests).encode()).hexdigest(), run[0][1], run[-1][2])

    def close(self, depth: int | None = None) -> str:
        """The root: where one node remains, or at `depth`, for a block of a longer row of leaves."""
        level = 0
        while level != depth if depth is not None else self.made[level] > 1:
            if self.open[level]:
                self._complete(level)
            level += 1
        return self.open[level][0][0]


def _grown(block: pa.Table) -> tuple[pa.Table, Tree, str]:
    block = block.sort_by("idx")
    tree = Tree()
    for digest in block["digest"].to_pylist():
        tree.append(digest)
    return block, tree, tree.close(DEPTH if block["total"][0].as_py() > BLOCK else None)


def _numbered(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The rows with their number (idx) among those of the same key, and how many those are (total)."""
    held = cut_lineage(rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order).withColumn("at", F.monotonically_increasing_id()))
    parts = held.groupBy(F.col(key).alias("its_key"), F.shiftright("at", 33).alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    one = Window.partitionBy("its_key")
    parts = parts.withColumns({"until": F.sum("n").over(one.orderBy("part")), "total": F.sum("n").over(one)})
    both = held.join(parts, (F.col(key) == F.col("its_key")) & (F.shiftright("at", 33) == F.col("part")))
    return both.select(*rows.columns, (F.col("until") - F.col("n") + F.col("at") - F.col("first")).alias("idx"), "total")


def _block() -> Column:
    return F.shiftright("idx", 4 * DEPTH)


def _roots(nodes: DataFrame) -> DataFrame:
    """The blocks' roots, as nodes of the next round."""

    def grow(block: pa.Table) -> pa.Table:
        block, _, root = _grown(block)
        row = {"tree": [block["tree"][0].as_py()], "idx": [block["idx"][0].as_py() // BLOCK], "total": [-(-block["total"][0].as_py() // BLOCK)], "digest": [root]}
        return pa.table(row, pa.schema([("tree", pa.string()), ("idx", pa.int64()), ("total", pa.int64()), ("digest", pa.string())]))

    return nodes.select("tree", "idx", "total", "digest").groupBy("tree", _block().alias("block")).applyInArrow(grow, "tree string, idx long, total long, digest string")


def _rounds(nodes: DataFrame) -> list[DataFrame]:
    """The nodes and, round by round, the block roots, until every tree is a single node."""
    rounds = [nodes]
    while True:
        rounds.append(cut_lineage(_roots(rounds[-1])))
        if (rounds[-1].agg(F.max("total")).first()[0] or 1) == 1:
            return rounds


def _extended(nodes: DataFrame, above: DataFrame, *keep: str) -> DataFrame:
    """The nodes (and `keep`), the root of their tree and their witness; `above` has both for the blocks' roots."""
    carried = [nodes.schema[c] for c in keep]

    def extend(block: pa.Table, root: pa.Table) -> pa.Table:
        if not block.num_rows or not root.num_rows:  # cannot be: every block has a root
            raise ValueError("a block and its root do not meet")
        block, tree, _ = _grown(block)
        rest = [(x["place"], x["siblings"]) for x in root["witness"][0].as_py()]
        whole = pa.array([[{"place": p, "siblings": s} for p, s in own + rest] for own in tree.witness], _STEP)
        n = block.num_rows
        columns = {"tree": block["tree"], "idx": block["idx"], "top": pa.array([root["top"][0].as_py()] * n, pa.string()), "witness": whole} | {c: block[c] for c in ("digest", *keep)}
        return pa.table(columns)

    left = nodes.select("tree", "idx", "total", "digest", *keep).groupBy("tree", _block().alias("block"))
    schema = f"tree string, idx long, top string, witness {_STEPS}, digest string" + "".join(f", {f.name} {f.dataType.simpleString()}" for f in carried)
    return left.cogroup(above.groupBy("tree", F.col("idx").alias("block"))).applyInArrow(extend, schema)


def _witnesses(rounds: list[DataFrame], above: DataFrame, *keep: str) -> DataFrame:
    """Witnesses of the first round's nodes from those of the trees' roots."""
    for nodes in rounds[-2:0:-1]:
        above = _extended(nodes, above)
    return _extended(rounds[0], above, *keep)


def manifest(docs: DataFrame, **extra: Column) -> DataFrame:
    """Per row: doc_id, source, leaf, subroot, root, and witness: from the leaf up, its place in the run and the run's other digests.

    `extra` are more columns to carry, expressions on doc_id, source, lang, n_chars and text.
    """
    if clash := {"doc_id", "source", "tree", "digest", "idx", "total", "at", "block", "top", "witness", "leaf", "subroot", "root"} & {*extra}:
        raise ValueError(f"names in use: {sorted(clash)}")
    names = ("doc_id", "source", "lang", "n_chars", "text")
    rows = pick(docs, doc_id="long", source="string", lang="string", n_chars="long", text="string")
    # a null source gets a key before all others
    tree = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-"))
    leaves = rows.select("doc_id", "source", tree.alias("tree"), leaf(*map(F.col, names)).alias("digest"), *[c.alias(k) for k, c in extra.items()])
    leaves = _numbered(cut_lineage(leaves), "tree", "doc_id", "digest")
    within = _rounds(cut_lineage(leaves))
    subroots = within[-1].select(F.lit("").alias("tree"), F.col("tree").alias("of"), "digest")
    across = _rounds(cut_lineage(_numbered(subroots, "tree", "of")))
    root = across[-1].first()
    top = across[-1].select("tree", "idx", F.col("digest").alias("top"), F.array().cast(_STEPS).alias("witness"))
    found = _witnesses(across, top, "of")
    above = found.select(F.col("of").alias("tree"), F.lit(0).cast("long").alias("idx"), F.col("digest").alias("top"), "witness")
    out = _witnesses(within, above, "doc_id", "source", *extra)
    return out.select("doc_id", "source", F.col("digest").alias("leaf"), F.col("top").alias("subroot"), F.lit(root and root["digest"]).cast("string").alias("root"), "witness", *extra)


def siblings(witness: str = "witness") -> Column:
    """All siblings of a witness, from the leaf up."""
    return F.array_join(F.transform(witness, lambda x: x["siblings"]), "")


def folded(start: Column, witness: str = "witness") -> Column:
    """The root that a witness gives for a leaf."""
    step = lambda x, w: F.sha2(F.concat(F.substr(w["siblings"], F.lit(1), w["place"] * 64), x, F.substr(w["siblings"], w["place"] * 64 + 1)), 256)
    return F.aggregate(witness, start, step)
