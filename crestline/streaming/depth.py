"""Depth of alignments that keep arriving.

Coverage is additive: each micro-batch is folded to sums of depth changes per
position and appended to a table of its own under the batch number.  A batch that
is repeated after a failure writes the same folder again, so nothing counts
twice.  The depth at any time is one sweep over the sums so far.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from crestline.operators.base_depth import block_events
from crestline.operators.sweep import sweep

SIDES = ["n_base", "n_del", "n_skip"]


def start_depth_stream(alignments: DataFrame, keys: Sequence[str], table: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Fold a stream of alignment records (keys, pos, cigar) into ``table``."""

    def fold(batch: DataFrame, number: int) -> None:
        sums = block_events(batch, keys).groupBy(*keys, "pos").agg(*[F.sum(s).alias(s) for s in SIDES])
        sums.write.mode("overwrite").parquet(f"{table}/batch={number}")

    writer = alignments.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def current_depth(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stretches of equal depth from all folded batches."""
    segments = sweep(table.select(*keys, "pos", *SIDES), keys, SIDES, common=False)
    return segments.where("n_base + n_del + n_skip > 0")


def compact(table: DataFrame, keys: Sequence[str], path: str) -> None:
    """Write the sums of many batches as one table, sorted by position."""
    merged = table.groupBy(*keys, "pos").agg(*[F.sum(s).alias(s) for s in SIDES])
    merged.repartitionByRange(*keys, "pos").sortWithinPartitions(*keys, "pos").write.parquet(path)
