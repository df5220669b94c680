"""MinHash near-duplicates from DartMinHash signatures over word shingles.

Each shingle owns a region of weight x rank; hashed darts (a Poisson process that depends on the
shingle alone) fall on the plane, those inside the regions of a document are thrown at its coordinates,
and each coordinate keeps its earliest. The ranks looked at shrink as the document's weight grows, so about
k ln k darts are thrown for any document; one with an empty coordinate looks at twice the ranks. Two documents
agree in a coordinate with the probability of their weighted Jaccard similarity.

Signatures are banded and documents meet in buckets. Equal shingle sets are one node from the start. Every
bucket's members are compared with one of them, its centre: the one with most company overall. Linked ones join
components. What is left are members of one centre's group in different components; they are compared by
what they lack of the centre and have beside it, which is little and gives their similarity exactly. That is
done in blocks of BLOCK rows, as matrix products inside tasks; only links come out. So no candidate pair stays undecided
and none is made a row. Links are decided on the shingle sets.

Defined cases: a text of one to four words is one shingle; texts without words are near-duplicates only if
equal, null counting as empty; rows of one doc_id are one document; a row without doc_id has no class and
takes no part; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from watchtide.llm.graph import components
from watchtide.llm.text import U, Words, as_bytes, mix, pick, steps
from watchtide.session import cut_lineage

SHINGLE, SIMILARITY = 5, 0.8
#: 24 bands of 4 coordinates: a pair at similarity 0.8 meets in no bucket with probability 3e-6.
BANDS, ROWS = 24, 4
#: Rows of a group that a task holds against as many others.
BLOCK = 2048
_POISSON = np.cumsum([math.exp(-1) / math.factorial(n) for n in range(16)])


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets of each text, distinct shingle numbers in order, their counts)."""
    words = Words(data, offsets)
    hashes = words.hashes()
    at, number = words.grams(n, hashes)
    doc = words.doc[at]
    short = np.diff(words.before)
    for size in range(1, n):
        rows = np.flatnonzero(short == size)
        if len(rows):
            first = words.before[rows]
            total = np.full(len(rows), size, np.uint64)
            for j in range(size):
                total = total * U(0x9E3779B97F4A7C15) + hashes[first + j]
            doc, number = np.concatenate([doc, rows]), np.concatenate([number, mix(total)])
    for row in np.flatnonzero((short == 0) & (np.diff(offsets) > 0)):
        raw = data[offsets[row] : offsets[row + 1]].astype(np.uint64)
        doc, number = np.append(doc, row), np.append(number, mix(np.array([(raw * mix(np.arange(1, len(raw) + 1, dtype=np.uint64))).sum()], np.uint64)))
    order = np.lexsort((number, doc))
    doc, number = doc[order], number[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (number[1:] != number[:-1])
    first = np.flatnonzero(new)
    counts = np.diff(np.append(first, len(doc)))
    return np.searchsorted(doc[first], np.arange(len(offsets))), number[first], counts


def signatures(cuts: np.ndarray, element: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """k numbers per set; sets lie between the cuts and must not be empty."""
    sets = len(cuts) - 1
    out = np.zeros((sets, k), np.uint64)
    total = np.add.reduceat(weight, cuts[:-1]) if sets else np.zeros(0)
    reach = k * (math.log(k) + 2.5) / np.maximum(total, 1e-300)
    todo = np.arange(sets)
    while len(todo):
        sizes = cuts[todo + 1] - cuts[todo]
        own = np.repeat(np.arange(len(todo)), sizes)
        at = np.arange(int(sizes.sum())) + np.repeat(cuts[todo] - (np.cumsum(sizes) - sizes), sizes)
        # cells of unit area: weight part i, rank layer j
        parts, layers = np.ceil(weight[at]).astype(np.int64), np.ceil(reach[todo]).astype(np.int64)[own]
        cells = parts * layers
        inner = np.arange(int(cells.sum())) - np.repeat(np.cumsum(cells) - cells, cells)
        e = np.repeat(np.arange(len(at)), cells)
        i, j = np.divmod(inner, layers[e])
        cell = mix(element[at[e]] + i.astype(np.uint64) * U(0x9E3779B97F4A7C15) + j.astype(np.uint64) * U(0xC2B2AE3D27D4EB4F))
        darts = np.searchsorted(_POISSON, (cell >> U(11)) * 2.0**-53)
        c = np.repeat(np.arange(len(cell)), darts)
        which = np.arange(len(c)) - np.repeat(np.cumsum(darts) - darts, darts)
        dart = mix(cell[c] + (which.astype(np.uint64) + U(1)) * U(0x165667B19E3779F9))
        again = mix(dart)
        rank = j[c] + (again >> U(32)) * 2.0**-32
        height = i[c] + (again & U(0xFFFFFFFF)) * 2.0**-32
        row = own[e[c]]
        inside = (rank < reach[todo][row]) & (height < weight[at[e[c]]])
        dart, rank, row = dart[inside], rank[inside], row[inside]
        slot = row * k + (dart % U(k)).astype(np.int64)
        order = np.lexsort((dart, rank, slot))
        slot = slot[order]
        first = np.flatnonzero(np.diff(slot, prepend=-1))
        filled = np.bincount(slot[first] // k, minlength=len(todo))
        full = filled == k
        keep = first[full[slot[first] // k]]
        out[todo[slot[keep] // k], slot[keep] % k] = dart[order][keep]
        todo = todo[~full]
        reach[todo] *= 2
    return out


def prints(docs: DataFrame, weighted: bool = False, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, key, bands): a 128-bit number of the shingle set, and one number per band (bands=0: the keys alone)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, limit=1 << 20):
            cuts, element, counts = shingle_sets(*as_bytes(batch.column("text")))
            sizes = np.diff(cuts)
            full = np.flatnonzero(sizes)
            keys = np.zeros((batch.num_rows, 2), np.uint64)
            found = np.zeros((batch.num_rows, bands), np.uint64)
            if len(full):
                weight = counts.astype(np.float64) if weighted else np.ones(len(element))
                marked = mix(element + counts.astype(np.uint64) * U(0x2545F4914F6CDD1D)) if weighted else element
                keys[full, 0] = np.add.reduceat(mix(marked ^ U(0xD1B54A32D192ED03)), cuts[full])
                keys[full, 1] = np.bitwise_xor.reduceat(mix(marked + U(0x8CB92BA72F3D8DD7)), cuts[full])
            if len(full) and bands:
                part = signatures(np.append(cuts[full], len(element)), element, weight, bands * rows).reshape(len(full), bands, rows)
                number = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(full), bands)).copy()
                for r in range(rows):
                    number = number * U(0x9E3779B97F4A7C15) + mix(part[:, :, r])
                found[full] = mix(number)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * bands), pa.array(found.reshape(-1).view(np.int64)))
            blobs = pa.array([x.tobytes() for x in keys], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), blobs, lists], names=["doc_id", "key", "bands"])

    return pick(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, key binary, bands array<long>")


def sets(docs: DataFrame, weighted: bool = False) -> DataFrame:
    """(id, items): the shingles of each document, 32 bits of each; weighted: the n-th copy of a shingle is an item of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            cuts, element, counts = shingle_sets(*as_bytes(batch.column("text")))
            if weighted:
                copy = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
                element = mix(np.repeat(element, counts) + copy.astype(np.uint64) * U(0xC2B2AE3D27D4EB4F))
                cuts = np.concatenate([[0], np.cumsum(counts)])[cuts]
            items = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array((element >> U(32)).astype(np.uint32).view(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), items], names=["id", "items"])

    return pick(docs, doc_id="long", text="string").mapInArrow(run, "id long, items array<int>")


def compared(docs: DataFrame, pairs: DataFrame, similarity: float, weighted: bool) -> DataFrame:
    """Pairs (id, centre) with `linked`, and how the document differs from the centre: `delta` (items of one only), `lost` (of the centre only), `size` (of the document)."""
    wanted = pairs.select("id").union(pairs.select("centre")).distinct()
    known = cut_lineage(sets(docs, weighted).join(wanted, "id", "left_semi"))
    both = pairs.join(known.toDF("id", "own"), "id").join(known.toDF("centre", "its"), "centre")
    more, lost = F.array_except("own", "its"), F.array_except("its", "own")
    out = both.select("id", "centre", F.size("own").alias("size"), F.concat(more, lost).alias("delta"), F.size(lost).alias("lost"), F.size("its").alias("_all"))
    shared = F.col("_all") - F.col("lost")
    return out.withColumn("linked", shared >= F.lit(similarity) * (F.col("size") + F.col("lost"))).drop("_all")


def _incidence(lists: list[np.ndarray], known: np.ndarray) -> np.ndarray:
    """Rows x known items: 1 where the row has the item."""
    out = np.zeros((len(lists), len(known)), np.float32)
    items, row = np.concatenate(lists), np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    at = np.minimum(np.searchsorted(known, items), len(known) - 1)
    same = known[at] == items
    out[row[same], at[same]] = 1
    return out


def cross_links(x: list[dict], y: list[dict], similarity: float, width: int = 1024) -> list[tuple[int, int]]:
    """Links between rows of different components in one centre's group, one for each x and component of y."""
    dx, dy = [np.array(r["delta"], np.int32) for r in x], [np.array(r["delta"], np.int32) for r in y]
    known = np.intersect1d(np.concatenate(dx), np.concatenate(dy))
    (size_x, lost_x), (size_y, lost_y) = (np.array([[r["size"], r["lost"]] for r in rows], np.int64).T for rows in (x, y))
    centre = size_x[0] - len(dx[0]) + 2 * lost_x[0]  # items of the centre
    shared = np.zeros((len(x), len(y)), np.float32)
    for at in range(0, len(known), width):
        some = known[at : at + width]
        shared += _incidence(dx, some) @ _incidence(dy, some).T
    both = centre - lost_x[:, None] - lost_y[None, :] + np.rint(shared).astype(np.int64)
    roots_x, roots_y = np.array([r["root"] for r in x]), np.array([r["root"] for r in y])
    near = (both >= similarity * (size_x[:, None] + size_y[None, :] - both)) & (roots_x[:, None] != roots_y[None, :])
    out: dict[tuple[int, int], tuple[int, int]] = {}
    for i, j in zip(*np.nonzero(near)):
        out.setdefault((i, int(roots_y[j])), (x[i]["id"], y[j]["id"]))
    return list(out.values())


def rest(groups: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between members of one centre's group that are in different components so far."""
    root_of = lambda name: roots.select(F.col("node").alias(name), F.col("root").alias(f"root_{name}"))
    placed = groups.join(root_of("id"), "id", "left").join(root_of("centre"), "centre", "left")
    placed = placed.select("centre", "id", "delta", "lost", "size", F.coalesce("root_id", "id").alias("root"), F.coalesce("root_centre", "centre").alias("root_c"))
    outside = (F.col("root") != F.col("root_c")).cast("long")
    counts = placed.groupBy("centre").agg(F.count("*").alias("n"), F.sum(outside).alias("n_out")).where("n > 1 AND n_out > 0")
    parts = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    at = lambda n: F.pmod(F.xxhash64("id"), parts(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), parts(n) - 1))
    rows = placed.join(counts, "centre").withColumns({"out": outside})
    columns = ["centre", "side", "part_x", "part_y", "id", "root", "delta", "lost", "size"]
    x = rows.where("out = 1").select("*", F.lit(1).alias("side"), at("n_out").alias("part_x")).select("*", spread("n").alias("part_y")).select(*columns)
    y = rows.select("*", F.lit(0).alias("side"), at("n").alias("part_y")).select("*", spread("n_out").alias("part_x")).select(*columns)

    def run(group: pa.Table) -> pa.Table:
        found = group.to_pylist()
        x, y = [r for r in found if r["side"]], [r for r in found if not r["side"]]
        pairs = cross_links(x, y, similarity) if x and y else []
        return pa.table({"a": pa.array([a for a, _ in pairs], pa.int64()), "b": pa.array([b for _, b in pairs], pa.int64())})

    return x.unionByName(y).groupBy("centre", "part_x", "part_y").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, weighted: bool = False) -> DataFrame:
    """(doc_id, class_id) per document row; class_id is the smallest doc_id of its class.

    `weighted` counts how often a shingle occurs; otherwise a document is the set of its shingles.
    """
    nameless = pick(docs, doc_id="long").where("doc_id IS NULL").withColumn("class_id", F.lit(None).cast("long"))
    docs = docs.where("doc_id IS NOT NULL")
    known = cut_lineage(prints(docs, weighted).groupBy("key", "doc_id").agg(F.first("bands").alias("bands")).groupBy("key").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands")))
    # texts without shingles have no key, and stay as they are
    real = known.where(F.col("key") != F.lit(bytes(16)))
    buckets = real.select("id", F.explode("bands").alias("h"))
    shared = buckets.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    members = cut_lineage(buckets.join(shared, "h"))
    company = members.groupBy("id").agg(F.sum("n").alias("n_all"))
    centre = members.join(company, "id").groupBy("h").agg(F.max(F.struct(F.col("n_all"), -F.col("id"))).alias("c")).select("h", (-F.col("c.col2")).alias("centre"))
    pairs = cut_lineage(members.join(centre, "h").where("id <> centre").select("id", "centre").distinct())
    groups = cut_lineage(compared(docs, pairs, similarity, weighted))
    linked = groups.where("linked").select(F.col("id").alias("a"), F.col("centre").alias("b"))
    more = cut_lineage(rest(groups, cut_lineage(components(linked)), similarity))
    roots = components(linked.unionByName(more))
    classes = known.join(roots, known["id"] == roots["node"], "left").select("key", F.coalesce("root", "id").alias("class_id"))
    return prints(docs, weighted, bands=0).select("doc_id", "key").join(classes, "key").select("doc_id", "class_id").unionByName(nameless)
