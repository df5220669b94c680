"""Token counts kept as delta-maintained rollups by source, language and tokenizer version.

A batch of changes becomes signed sums per group: an insert adds a document and its tokens, a delete takes them away, a revised
count adds the difference. Sums are additive, so totals are the sum over committed batches, in any order.

A batch is one Parquet folder under its number and counts once its success marker is there. Committing a number
again changes nothing; a commit that was cut off leaves no marker, is not counted, and is written
anew by the next attempt. `compact` adds committed batches up into a base, which stands for all batches up to its
number; a new batch below it is refused.

Defined cases: a null text has no tokens; null sources and languages are groups of their own; repeated rows of a document
count each; groups whose documents and tokens are all zero are left out; an empty batch is committed and changes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as files
from pyspark.sql import DataFrame, SparkSession, functions as F

from watchtide.llm.text import Words, as_bytes, pick, steps
from watchtide.llm.tokens import Encoder
from watchtide.session import checkpoint_dir

GROUP = ["source", "lang", "tokenizer"]
SUMS = ["documents", "tokens"]
_COLUMNS = "source string, lang string, tokenizer string, documents long, tokens long"


def count(docs: DataFrame, tokenizers: dict[str, str], revise=None) -> DataFrame:
    """(doc_id, source, lang, tokenizer, n_tokens, n_revised) per document and tokenizer version.

    `tokenizers` has the file of each version, or `words` for runs of letters and digits. `revise` is a function
    of the text; `n_revised` counts what it gives.
    """
    kinds = [pa.int64(), *[pa.string()] * 3, pa.int64(), pa.int64()]
    names = ["doc_id", *GROUP, "n_tokens", "n_revised"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = {k: Encoder(path) for k, path in tokenizers.items() if path != "words"}

        def words(texts: list[str]) -> list[int]:
            found = Words(*as_bytes(pa.array([t.encode() for t in texts], pa.large_binary())))
            return (found.before[1:] - found.before[:-1]).tolist()

        for batch in steps(batches):
            fixed = [batch.column(c).to_pylist() for c in ("doc_id", "source", "lang")]
            old = [t or "" for t in batch.column("text").to_pylist()]
            new = [revise(t) for t in old] if revise else old
            for name in tokenizers:
                each = (lambda texts, e=encoders[name]: [len(e(t)) for t in texts]) if name in encoders else words
                before = each(old)
                after = before if new is old else [n if a == b else each([b])[0] for n, a, b in zip(before, old, new)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([*fixed, [name] * len(old), before, after], kinds)], names=names)

    return pick(docs, doc_id="long", source="string", lang="string", text="string").mapInArrow(run, "doc_id long, source string, lang string, tokenizer string, n_tokens long, n_revised long")


def inserted(counts: DataFrame) -> DataFrame:
    return counts.select(*GROUP, F.lit(1).cast("long").alias("documents"), F.col("n_tokens").alias("tokens"))


def deleted(counts: DataFrame) -> DataFrame:
    return counts.select(*GROUP, F.lit(-1).cast("long").alias("documents"), (-F.col("n_tokens")).alias("tokens"))


def revised(changes: DataFrame) -> DataFrame:
    """From (source, lang, tokenizer, n_tokens, n_revised); a document that changes its group is a delete and an insert."""
    return changes.where("n_revised <> n_tokens").select(*GROUP, F.lit(0).cast("long").alias("documents"), (F.col("n_revised") - F.col("n_tokens")).alias("tokens"))


def summed(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy(*GROUP).agg(*[F.sum(c).alias(c) for c in SUMS])


def _folders(folder: str) -> list[tuple[str, int]]:
    """(kind, number) of the committed bases and batches."""
    system, place = files.FileSystem.from_uri(folder)
    found = system.get_file_info(files.FileSelector(place, allow_not_found=True))
    names = [x.base_name for x in found if x.type == files.FileType.Directory and x.base_name.startswith(("batch-", "base-"))]
    marks = system.get_file_info([f"{place}/{n}/_SUCCESS" for n in names])
    return [(n.split("-")[0], int(n.split("-")[1])) for n, m in zip(names, marks) if m.type == files.FileType.File]


def _write(sums: DataFrame, folder: str, kind: str, number: int) -> None:
    sums.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{folder}/{kind}-{number}")


def commit(deltas: DataFrame, folder: str, batch: int) -> bool:
    """Commit a batch of signed deltas; false if it was committed before."""
    done = _folders(folder)
    if ("batch", batch) in done:
        return False
    if any(kind == "base" and number >= batch for kind, number in done):
        raise ValueError(f"batch {batch} comes after a base that stands for all batches up to it")
    _write(summed(deltas), folder, "batch", batch)
    return True


def _counted(folder: str) -> list[tuple[str, int]]:
    done = _folders(folder)
    base = max((n for kind, n in done if kind == "base"), default=None)
    return [("base", base)] * (base is not None) + [("batch", n) for kind, n in sorted(done) if kind == "batch" and (base is None or n > base)]


def totals(spark: SparkSession, folder: str) -> DataFrame:
    """(source, lang, tokenizer, documents, tokens) over all committed batches."""
    paths = [f"{folder}/{kind}-{number}" for kind, number in _counted(folder)]
    rows = spark.read.schema(_COLUMNS).parquet(*paths) if paths else spark.createDataFrame([], _COLUMNS)
    return summed(rows).where("documents <> 0 OR tokens <> 0")


def compact(spark: SparkSession, folder: str) -> int | None:
    """Add the committed batches up into a base under the largest number, which it returns."""
    counted = _counted(folder)
    if not counted:
        return None
    last = max(n for _, n in counted)
    if ("base", last) not in counted:
        _write(totals(spark, folder).coalesce(1), folder, "base", last)
    return last


def new_folder(spark: SparkSession) -> str:
    """A folder of its own below the cluster's shared one."""
    return f"{checkpoint_dir(spark).rstrip('/')}/rollup-{uuid.uuid4().hex}"
