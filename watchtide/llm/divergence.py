"""Audit of how far the sources of a language use words differently.

Terms are counted per (lang, source) with a term's documents; a language keeps the terms of `least_docs` documents. A group
gives a term p = 1 + floor(10^9 (count + 1) / (N + V)); p against q diverges by floor((p - q)^2 / q).

Part `term`: the divergence never falls with a higher count in the group or a lower one in the language, and equal ones
rank by UTF-8. So a term that `top` others of its group dominate in all three is not in the report. Tasks keep the terms with
fewer dominators (the skyband), skybands are merged, and what is left is ranked exactly.

Part `pair`: a source against each other one, summed over all kept terms. Terms are dealt out in chunks of about `CHUNK` and
sources in tiles of `TILE`, so no task holds a language. Within a tile a term costs work only where a source has it; the
others of a source share one p, and what they give against another source comes from that one's distinct values.

Defined cases: null text, lang and source are ''; repeated rows and equal doc_ids are documents of their own; a group
without terms has its pairs, with what the smoothed zeros give; a language without kept terms has pairs of 0; a source alone
in its language has no pairs; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from watchtide.llm.text import pick
from watchtide.session import cut_lineage

#: (group, term) counts that a counting task holds before it sends them on.
HELD = 500_000
#: Bytes from which a text's words are not listed at once.
LONG = 16 << 20
CHUNK, TILE = 4096, 256
#: Skybands of so many sets of tasks are merged apart.
SALTS = 16
_TERM = re.compile(rb"[a-z\x80-\xff]+")


def counted(docs: DataFrame, most: int = HELD, long: int = LONG) -> DataFrame:
    """(lang, source, term, n, docs) as each task has counted them; the term '' says that the group is there."""

    def put(groups: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (total, texts) in groups.items():
            size = len(total) + 1
            columns = [pa.array([lang] * size), pa.array([source] * size), pa.array([b"", *total], pa.binary()).cast(pa.string()), pa.array([0, *total.values()], pa.int64()), pa.array([0, *map(texts.__getitem__, total)], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0
        for batch in batches:
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text"))):
                total, texts = groups.setdefault((lang, source), (Counter(), Counter()))
                text, before = text.lower(), len(total)
                words = _TERM.findall(text) if len(text) < long else (m.group() for m in _TERM.finditer(text))
                total.update(words)
                texts.update(set(words) if len(text) < long else {m.group() for m in _TERM.finditer(text)})
                held += len(total) - before
                if held > most:
                    yield from put(groups)
                    groups, held = {}, 0
        yield from put(groups)

    rows = pick(docs, lang="string", source="string", text="binary").select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")], F.coalesce("text", F.lit(b"")).alias("text"))
    return rows.mapInArrow(count, "lang string, source string, term string, n long, docs long")


def share(count: Column, total: Column) -> Column:
    """1 + floor(10^9 (count + 1) / total), exact for any long."""
    whole = lambda x: x.cast("decimal(20,0)")
    return F.coalesce(F.call_function("div", F.lit(10**9).cast("decimal(10,0)") * whole(count + 1), F.nullif(whole(total), F.lit(0).cast("decimal(20,0)"))), F.lit(0)) + 1


def skyband(n: np.ndarray, lang_n: np.ndarray, term: np.ndarray, k: int) -> np.ndarray:
    """Which points fewer than k others dominate: n as high, lang_n as low, term lower. Points come by n descending, lang_n, term.

    Whatever dominates a point comes before it, and k of its dominators, if there are as many, are in the skyband themselves.
    """
    keep = np.zeros(len(n), bool)
    cell = np.ones(len(n), bool)
    cell[1:] = (n[1:] != n[:-1]) | (lang_n[1:] != lang_n[:-1])
    start = np.flatnonzero(cell)
    within = np.arange(len(n)) - np.repeat(start, np.diff(np.append(start, len(n))))
    left = np.flatnonzero(within < k)
    low, early = np.zeros(0, lang_n.dtype), np.zeros(0, term.dtype)
    for at in range(0, len(left), 512):
        now = left[at : at + 512]
        a, b = lang_n[now][:, None], term[now][:, None]
        above = ((low <= a) & (early < b)).sum(1) + np.tril((a.T <= a) & (b.T < b), -1).sum(1)
        now = now[above < k]
        keep[now] = True
        low, early = np.append(low, lang_n[now]), np.append(early, term[now])
    return keep


def _skybands(k: int, least: int):
    order = [("lang", "ascending"), ("source", "ascending"), ("n", "descending"), ("lang_n", "ascending"), ("term", "ascending")]

    def thin(batches: list[pa.RecordBatch]) -> pa.Table:
        rows = pa.Table.from_batches(batches).sort_by(order).combine_chunks()
        new = np.ones(rows.num_rows, bool)
        for c in ("lang", "source"):
            code = rows[c].combine_chunks().dictionary_encode().indices.to_numpy()
            new[1:] &= code[1:] == code[:-1]
        new[1:] = ~new[1:]
        cuts = np.append(np.flatnonzero(new), rows.num_rows)
        n, lang_n = rows["n"].to_numpy(), rows["lang_n"].to_numpy()
        place = np.empty(rows.num_rows, np.int64)
        place[pc.sort_indices(rows["term"]).to_numpy()] = np.arange(rows.num_rows)
        keep = np.concatenate([skyband(n[a:b], lang_n[a:b], place[a:b], k) for a, b in zip(cuts[:-1], cuts[1:])])
        return rows.filter(pa.array(keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, most = 0, least
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size > most:
                held = thin(held).to_batches()
                size = sum(b.num_rows for b in held)
                most = max(least, 2 * size)
        if held:
            yield from thin(held).to_batches()

    return run


def _tile_sums(entries: pa.Table, groups: pa.Table) -> pa.Table:
    """Sums over a chunk's terms for the ordered pairs between two blocks of sources."""
    groups = groups.sort_by("its_ix")
    ix, zero = groups["its_ix"].to_numpy(), groups["its_p0"].to_numpy()
    lang, first, second, n_terms = (groups[f"its_{c}"][0].as_py() for c in ("lang", "one", "two", "n_terms"))
    codes = entries["term"].combine_chunks().dictionary_encode()
    terms = len(codes.dictionary)
    p = np.repeat(zero[:, None], terms + 1, 1)  # the last column stands for terms that no source here has
    row = np.searchsorted(ix, entries["ix"].to_numpy())
    p[row, codes.indices.to_numpy()] = entries["p"].to_numpy()
    has = np.zeros(p.shape, bool)
    has[row, codes.indices.to_numpy()] = True
    weight = np.ones(terms + 1, np.int64)
    weight[-1] = n_terms - terms
    gap = lambda x, q: (x - q) * (x - q) // q
    out = []
    block = groups["its_block"].to_numpy()
    for sources, others in {(first, second), (second, first)}:
        other = np.flatnonzero(block == others)
        values, counts, starts = [], [], [0]
        for b in other:
            own = has[b]
            v, c = np.unique(p[b, own], return_counts=True)
            values += [v, zero[b : b + 1]]
            counts += [c, [n_terms - int(own.sum())]]
            starts.append(starts[-1] + len(v) + 1)
        if not len(other):
            continue
        values, counts = np.concatenate(values), np.concatenate(counts)
        for a in np.flatnonzero(block == sources):
            at = np.flatnonzero(has[a])
            q = p[np.ix_(other, at)]
            total = np.add.reduceat(gap(zero[a], values) * counts, starts[:-1]) - gap(zero[a], q).sum(1) + gap(p[a, at], q).sum(1)
            real = other != a
            out.append(pa.table({"lang": pa.array([lang] * int(real.sum()), pa.string()), "a": np.full(int(real.sum()), ix[a]), "b": ix[other[real]], "value": total[real]}))
    empty = pa.schema([("lang", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("value", pa.int64())])
    return pa.concat_tables([empty.empty_table(), *out])


def audit(docs: DataFrame, least_docs: int = 3, top: int = 200, chunk_terms: int = CHUNK, tile_sources: int = TILE, most: int = HELD) -> DataFrame:
    """(lang, source, part, item, value, rank): all pairs, and the `top` terms of each group."""
    of_term = Window.partitionBy("lang", "term")
    rows = counted(docs, most).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    rows = rows.withColumns({"lang_n": F.sum("n").over(of_term), "lang_docs": F.sum("docs").over(of_term), "nth": F.row_number().over(of_term.orderBy("source"))})
    held = cut_lineage(rows.where((F.col("lang_docs") >= least_docs) | (F.col("term") == "")).select("lang", "source", "term", "n", "lang_n", "nth"))

    real = F.col("term") != ""
    langs = held.groupBy("lang").agg(F.count_if(real & (F.col("nth") == 1)).alias("v"), F.sum("n").alias("lang_total"))
    groups = held.groupBy("lang", "source").agg(F.sum("n").alias("total")).join(langs, "lang")
    groups = groups.withColumns({"p0": share(F.lit(0).cast("long"), F.col("total") + F.col("v")), "ix": F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1})
    groups = cut_lineage(groups.withColumns({"chunks": F.greatest(F.lit(1), F.ceil(F.col("v") / chunk_terms)), "blocks": F.floor((F.count("*").over(Window.partitionBy("lang")) - 1) / tile_sources) + 1}))

    kept = held.where(real).join(groups, ["lang", "source"])
    kept = kept.withColumns({"p": share(F.col("n"), F.col("total") + F.col("v")), "q": share(F.col("lang_n"), F.col("lang_total") + F.col("v"))})

    # part term
    gap = F.col("p") - F.col("q")
    high = kept.where("p > q").select("lang", "source", "term", "n", "lang_n", F.call_function("div", gap * gap, F.col("q")).alias("value"))
    schema = high.schema
    some = high.mapInArrow(_skybands(top, most), schema).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    some = some.repartition("lang", "source", "salt").drop("salt").mapInArrow(_skybands(top, most), schema)
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = some.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    terms = terms.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)

    # part pair: tiles (one, two) of blocks of sources, one <= two
    tile = lambda df: df.withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumns({"one": F.least("x", "block"), "two": F.greatest("x", "block")})
    block = F.floor(F.col("ix") / tile_sources).alias("block")
    chunk = F.pmod(F.xxhash64("term"), F.col("chunks")).alias("chunk")
    entries = tile(kept.select("lang", "term", "ix", "p", "blocks", block, chunk)).select("lang", "chunk", "one", "two", "term", "ix", "p")
    sizes = kept.where("nth = 1").select("lang", chunk).groupBy("lang", "chunk").agg(F.count("*").alias("n_terms"))
    sides = groups.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).join(sizes, ["lang", "chunk"], "left")
    sides = tile(sides.select("lang", "chunk", "ix", "p0", "blocks", block, F.coalesce("n_terms", F.lit(0)).cast("long").alias("n_terms"))).select("lang", "chunk", "one", "two", "block", "ix", "p0", "n_terms")
    keys = ["lang", "chunk", "one", "two"]
    sides = sides.toDF(*[f"its_{c}" for c in sides.columns])
    sums = entries.groupBy(*keys).cogroup(sides.groupBy(*[f"its_{c}" for c in keys])).applyInArrow(_tile_sums, "lang string, a long, b long, value long")
    name = lambda ix, as_: groups.select("lang", F.col("ix").alias(ix), F.col("source").alias(as_))
    pairs = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")).join(name("a", "source"), ["lang", "a"]).join(name("b", "item"), ["lang", "b"])
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(best))
    return terms.unionByName(pairs)
