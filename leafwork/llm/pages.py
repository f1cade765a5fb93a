"""Reading pages of blocks in Arrow batches."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows handled at a time, so that a task's Python memory follows this and not the batch size of the session.
PAGES = 256
#: Different stretches a task counts before it hands their words on.
WORDS = 200_000


def fields(batch: pa.RecordBatch, names: list[str]) -> dict[str, list]:
    """Per page lists of each block field; pages without blocks get empty lists, null blocks null fields."""
    blocks = batch.column("blocks")
    flat = blocks.flatten()
    sizes = [n or 0 for n in pa.compute.list_value_length(blocks).to_pylist()]
    out = {}
    for name in names:
        at, values = 0, flat.field(name).to_pylist() if not flat.null_count else [None if x is None else x[name] for x in flat.to_pylist()]
        rows = []
        for n in sizes:
            rows.append(values[at : at + n])
            at += n
        out[name] = rows
    return out


def lists(column: pa.ListArray, values: Callable[[pa.Array], pa.Array] = lambda x: x) -> list[list]:
    """The list of each row, empty for null; ``values`` is asked for the elements of all rows at once."""
    flat, at, rows = values(column.flatten()).to_pylist(), 0, []
    for n in pa.compute.list_value_length(column).to_pylist():
        rows.append(flat[at : at + (n or 0)])
        at += n or 0
    return rows


def slices(batches: Iterator[pa.RecordBatch], n: int = PAGES) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, n):
            yield b.slice(i, n)


def word_counts(pages: DataFrame, split: Callable[[str], Iterable[str]]) -> DataFrame:
    """``word`` and ``n``: how often each word stands in the texts of all pages. ``split`` gives the words of a stretch without white space;
    it is asked once for equal stretches, and tasks count before the shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            counts: Counter = Counter()
            for s, n in stretches.items():
                for w in split(s):
                    counts[w] += n
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        stretches: Counter = Counter()
        for b in slices(batches):
            stretches.update("\n".join(t for t in b.column("texts").flatten().to_pylist() if t).split())
            if len(stretches) >= WORDS:
                yield out()
                stretches.clear()
        yield out()

    return pages.select(F.col("blocks.text").alias("texts")).mapInArrow(work, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def bounded_sample(df: DataFrame, key: str, n: int) -> list:
    """``n`` rows, chosen by a hash of ``key``, for fitting a model; all of them where there are no more.

    A share of the rows is taken first, so that the driver gets about ``n`` rows and not ``n`` from every task.
    """
    total = df.select(key).count()
    h = F.xxhash64(F.lit("sample"), F.col(key))
    if total > n:
        rate = min(1.0, (n + 6 * n**0.5 + 20) / total)
        df = df.filter(h < F.lit(int(-(1 << 63) + rate * ((1 << 64) - 1))))
    return sorted(df.collect(), key=lambda r: (r[key] is None, r[key]))[: n + int(7 * n**0.5) + 40]
