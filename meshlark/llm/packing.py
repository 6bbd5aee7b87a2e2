"""Packing: optimal length buckets, then token-budget batches inside each.

Dynamic programming over the histogram of all lengths picks the bucket
boundaries for which the least padding is added when every document is padded
to the boundary of its bucket: the optimum, over all lengths that occur. A step
for one more bucket takes the lower envelope of one line a length, so it is
linear in the number of lengths. The histogram is one groupBy, and its rows come
to the driver as two arrays: D different lengths need D * (D - 1) / 2 words at
least, so there are never more than sqrt(2 * words) + 1 of them (a few million
for 10^13 words), and no more than the longest document has words.

Inside a bucket the documents, in md5 order of their id and text, fill batches
of floor(budget / boundary) documents, one at least. A bucket may hold any part of
all rows: rows are numbered by shards of the md5, whose number follows the rows,
never in one task. Rows alike in id and length go as any of them.

Nulls: a null text has length 0 and a null id sorts as the text `null`; both
are packed. Repeated rows are packed one by one. A document longer than the
budget is alone in its batch. An empty table gives an empty result. Extra
columns are left aside.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlark.llm.words import document_key, shard_digits, word_count
from meshlark.operators.cluster import materialize
from meshlark.operators.ranks import sharded_running

BUCKETS = 16
BUDGET = 16384


def best_boundaries(lengths: Sequence[int], counts: Sequence[int], buckets: int) -> list[int]:
    """Boundaries, ascending, of at most `buckets` buckets with the least padding. lengths ascend, counts are positive.

    With one more bucket the first j + 1 lengths cost, for the best k < j that
    the last bucket starts behind, cost[k] + edge[j] * (upto[j] - upto[k]): the
    least of lines in edge[j] that get flatter with k, while edge[j] grows.
    """
    edge, upto = [int(n) for n in lengths], list(accumulate(int(n) for n in counts))
    m = len(edge)
    if not m:
        return []
    cost, cuts = [e * n for e, n in zip(edge, upto, strict=True)], []
    for _ in range(min(buckets, m) - 1):
        nxt, cut = cost[:1], np.full(m, -1, np.int64)
        hull: list[int] = []
        at = 0
        for j in range(1, m):
            new = j - 1
            while len(hull) > 1 and _hides(hull[-2], hull[-1], new, cost, upto):
                hull.pop()
            hull.append(new)
            at = min(at, len(hull) - 1)
            x = edge[j]
            while at + 1 < len(hull) and cost[hull[at + 1]] - x * upto[hull[at + 1]] <= cost[hull[at]] - x * upto[hull[at]]:
                at += 1
            k = hull[at]
            found = cost[k] + x * (upto[j] - upto[k])
            if found < cost[j]:
                cut[j] = k
            nxt.append(min(found, cost[j]))
        cuts.append(cut)
        cost = nxt
    out, j = [edge[-1]], m - 1
    for cut in reversed(cuts):
        if cut[j] >= 0:
            j = int(cut[j])
            out.append(edge[j])
    return out[::-1]


def _hides(a: int, b: int, c: int, cost: list[int], upto: list[int]) -> bool:
    """Whether lines a and c together lie below line b everywhere."""
    return (cost[c] - cost[a]) * (upto[b] - upto[a]) <= (cost[b] - cost[a]) * (upto[c] - upto[a])


def pack(docs: DataFrame, budget: int = BUDGET, buckets: int = BUCKETS, length: str | None = None) -> DataFrame:
    """doc_id, n_tokens, bucket (from 0), bucket_len, batch (from 0 in its bucket), slot, padding; a row per document.

    docs: doc_id and text, or with `length` doc_id and that column of lengths
    (null: 0). Without `length` a token is a word.
    """
    size = F.coalesce(F.col(length).cast("long"), F.lit(0)) if length else word_count(F.col("text"))
    key = document_key(F.col("doc_id"), F.col(length).cast("string") if length else F.col("text"))
    sized = materialize(docs.select("doc_id", size.alias("n_tokens"), key.alias("key")), "pack-sizes", counted=True)
    histogram = sized.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).toArrow().sort_by("n_tokens")
    edges = best_boundaries(histogram.column("n_tokens").to_pylist(), histogram.column("n").to_pylist(), buckets)
    bounds = F.array(*[F.lit(e).cast("long") for e in edges]) if edges else F.array(F.lit(0).cast("long"))
    size = F.col("n_tokens")
    placed = sized.withColumn("bucket", F.size(F.filter(bounds, lambda b: b < size))).withColumn("bucket_len", F.element_at(bounds, F.col("bucket") + 1))
    placed = placed.withColumn("shard", F.substring("key", 1, shard_digits(sized)))
    ranked = sharded_running(placed, ["bucket"], "shard", [F.col("key")], F.lit(1), "rank")
    many = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.greatest(F.col("bucket_len"), F.lit(1))))
    out = ranked.withColumn("batch", F.floor(F.col("rank") / many)).withColumn("slot", F.col("rank") % many)
    return out.select("doc_id", "n_tokens", "bucket", "bucket_len", "batch", "slot", (F.col("bucket_len") - size).alias("padding"))
