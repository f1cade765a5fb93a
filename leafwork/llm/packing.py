"""Filling containers of fixed capacity with documents: Karmarkar-Karp multiway differencing.

Sizes are tokens of a public tokenizer. Documents are spread by row over shards of about ``SHARD_CONTAINERS`` containers; each
shard is partitioned into ``ceil(total / capacity)`` windows by multiway differencing: every item starts as a partial partition
with one filled window, and the two partial partitions of largest imbalance are merged with opposing order, until one is left.
Where windows exceed the capacity, the fullest of those that do not are containers, and the items of all others are partitioned
anew; the window count rises whenever no window of a run is full enough to be kept. So every container is a window of a
differencing run. A document larger than the capacity is cut into full containers and one rest; no other document is split.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwork.shared import stage

#: How the rank files' tokenizers split text before merging (fixed value).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SHARD_CONTAINERS, SHARD_ITEMS = 256, 4096
#: Windows this share of the capacity below the fullest one that fits are kept with it, and a first run's only from ``FULL`` on.
CLOSE, FULL = 0.01, 0.9
MAX_RANKS = 64_000_000
SCHEMA = "window_id int, container_id string, doc_id long, piece int, first_token long, tokens long"
_ENCODERS: dict[bytes, object] = {}


def encoder(ranks: bytes):
    """The tokenizer of a rank file's content, made once a process."""
    if ranks not in _ENCODERS:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _ENCODERS[ranks] = tiktoken.Encoding("public", pat_str=SPLIT, mergeable_ranks=table, special_tokens={})
    return _ENCODERS[ranks]


def token_counts(documents: DataFrame, tokenizer: str) -> DataFrame:
    """(``doc_id``, ``tokens``) of each row; a null or empty text has 0. ``tokenizer`` is a rank file on the driver, of ``MAX_RANKS`` bytes at
    most, which is sent to the executors."""
    if os.path.getsize(tokenizer) > MAX_RANKS:
        raise ValueError(f"{tokenizer} has more than {MAX_RANKS} bytes")
    with open(tokenizer, "rb") as f:
        ranks = documents.sparkSession.sparkContext.broadcast(f.read())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(ranks.value)
        for b in batches:
            n = [len(e.encode_ordinary(t)) if t else 0 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64())], ["doc_id", "tokens"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, "doc_id long, tokens long")


Part = tuple[int, list]


def _merge(a: list[Part], b: list[Part], k: int) -> list[Part]:
    """Two partial partitions of ``k`` windows (empty ones left out, largest first) with opposing imbalances."""
    if len(a) + len(b) <= k:  # every window of one meets an empty window of the other
        if b[0][0] <= a[-1][0]:
            a.extend(b)
            return a
        return sorted(a + b, key=lambda p: -p[0])
    out = []
    spare = k - len(b)  # this many of a's windows meet an empty one
    for i, (size, items) in enumerate(a):
        if i < spare:
            out.append((size, items))
        else:
            s, more = b[len(b) - 1 - (i - spare)]
            out.append((size + s, items + more))
    out.extend(b[: len(b) - max(0, len(a) - spare)])
    out.sort(key=lambda p: -p[0])
    return out


def karmarkar_karp(sizes: list[int], k: int) -> list[Part]:
    """At most ``k`` windows of near-equal sums: (sum, item numbers) each."""
    if k <= 1:
        return [(sum(sizes), list(range(len(sizes))))] if sizes else []
    heap = [(-s, i, [(s, [i])]) for i, s in enumerate(sizes)]  # imbalance, tie-break, windows
    heapq.heapify(heap)
    n = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        c = _merge(a, b, k) if len(a) >= len(b) else _merge(b, a, k)
        n += 1
        heapq.heappush(heap, (-(c[0][0] - (c[-1][0] if len(c) == k else 0)), n, c))
    return heap[0][2] if heap else []


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Item numbers by container. No size may exceed the capacity; items of size 0 fit anywhere."""
    out: list[list[int]] = []
    rest, more = list(range(len(sizes))), 0
    while rest:
        k = max(1, -(-sum(sizes[i] for i in rest) // capacity)) + more
        windows = karmarkar_karp([sizes[i] for i in rest], k)
        kept = [w for w in windows if w[0] <= capacity]
        if len(kept) < len(windows):
            fullest = max((t for t, _ in kept), default=0)
            kept = [w for w in kept if w[0] >= fullest - CLOSE * capacity] if more or fullest >= FULL * capacity else []
            if not kept:
                more += max(1, k // 50)
                continue
        out += [[rest[i] for i in items] for _, items in kept]
        used = {i for _, items in kept for i in items}
        rest = [x for i, x in enumerate(rest) if i not in used]
    return out


def pack_documents(documents: DataFrame, windows: DataFrame, tokenizer: str) -> DataFrame:
    """Every document assigned to containers of each capacity: ``window_id``, ``container_id``, ``doc_id``, ``piece``,
    ``first_token``, ``tokens``.

    ``documents`` needs ``doc_id`` and ``text``, ``windows`` (a few rows, checked) ``window_id`` and ``capacity_tokens``; other columns are ignored.
    Null and empty texts have size 0 and are packed like any other. Repeated rows are packed each. Rows of ``windows`` with null
    or a capacity under 1 give no containers. Ties are broken by row, so a rerun of the staged sizes gives the same containers.
    """
    spark = documents.sparkSession
    caps = [(r[0], r[1]) for r in windows.filter("capacity_tokens >= 1 and window_id is not null").select("window_id", "capacity_tokens").distinct().sort("window_id").limit(1001).collect()]
    if len(caps) > 1000:
        raise ValueError("more than 1000 capacities")
    if not caps:
        return spark.createDataFrame([], SCHEMA)
    sizes = stage(token_counts(documents, tokenizer).withColumn("row", F.monotonically_increasing_id()), "sizes")
    figures = sizes.agg(F.count(F.lit(1)), F.sum("tokens")).first()
    count, total = figures[0], figures[1] or 0
    rows = [(w, c, max(1, -(-total // (c * SHARD_CONTAINERS)), -(-count // SHARD_ITEMS))) for w, c in caps]
    choices = F.array(*[F.struct(F.lit(w).cast("int").alias("window_id"), F.lit(c).cast("long").alias("capacity"), F.lit(s).cast("long").alias("shards")) for w, c, s in rows])
    each = sizes.select("row", "doc_id", "tokens", F.explode(choices).alias("w")).select("row", "doc_id", "tokens", "w.*")
    each = each.withColumn("full", F.when(F.col("tokens") > F.col("capacity"), F.floor(F.col("tokens") / F.col("capacity"))).otherwise(F.lit(0).cast("long")))
    full = (
        each.filter("full > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)).alias("piece"))
        .select("window_id", F.concat_ws("-", F.lit("f"), "window_id", "row", "piece").alias("container_id"), "doc_id", F.col("piece").cast("int"), (F.col("piece") * F.col("capacity")).alias("first_token"), F.col("capacity").alias("tokens"))
    )
    rest = each.withColumn("size", F.col("tokens") - F.col("full") * F.col("capacity")).filter("full = 0 or size > 0")
    rest = rest.withColumn("shard", F.pmod(F.xxhash64("row", "window_id"), F.col("shards")))

    def work(t: pa.Table) -> pa.Table:
        t = t.sort_by([("size", "descending"), ("row", "ascending")])
        sizes, capacity = t.column("size").to_pylist(), t.column("capacity")[0].as_py()
        name = [""] * len(sizes)
        for j, items in enumerate(pack(sizes, capacity)):
            for i in items:
                name[i] = f"s-{t.column('window_id')[0].as_py()}-{t.column('shard')[0].as_py()}-{j}"
        full = t.column("full").to_pylist()
        return pa.table([t.column("window_id"), pa.array(name), t.column("doc_id"), pa.array(full, pa.int32()), pa.array([f * capacity for f in full], pa.int64()), t.column("size")], names=["window_id", "container_id", "doc_id", "piece", "first_token", "tokens"])

    packed = rest.select("row", "doc_id", "window_id", "capacity", "full", "size", "shard").groupBy("window_id", "shard").applyInArrow(work, SCHEMA)
    return full.unionByName(packed)
