"""Base pile-up of sorted alignments that keep arriving, with what is final handed on and forgotten.

Alignments come in order of contig number and position.  Once one starts at a position, all before it is final.  Each
micro-batch adds its depth changes to those still open, hands the depth of final stretches on as a table of its own
and keeps the changes at or behind the frontier, so the state is as long as the reads that lie across it, whatever
their number.  Output and state are written under the batch's number: a batch that is repeated after a failure writes
the same folders again.

All steps are DataFrame jobs over tiles of positions; the driver sees one row per library, its frontier.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from crestline.operators.base_depth import block_events
from crestline.operators.sweep import sweep
from crestline.session import discard

SIDES = ["n_base", "n_del", "n_skip"]


class UnsortedInput(ValueError):
    """An alignment starts before one of an earlier batch."""


@dataclass
class OnlinePileup:
    """Pile-up of one stream: ``keys`` name the library columns, ``out`` and ``state`` are shared folders.

    Records have the keys, tid (number of the contig), chrom, pos and a parsed cigar.
    """

    spark: SparkSession
    keys: Sequence[str]
    out: str
    state: str

    def start(self, alignments: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        writer = alignments.writeStream.foreachBatch(self.fold).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()

    @property
    def _site(self) -> list[str]:
        return [*self.keys, "tid", "chrom"]

    def _read(self, kind: str, number: int) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.state}/{kind}/batch={number}")
        except AnalysisException:
            return None

    def fold(self, batch: DataFrame, number: int) -> None:
        """Take one micro-batch in."""
        before, opened = self._read("frontier", number - 1), self._read("open", number - 1)
        key = F.struct("tid", "pos")
        reached = batch.groupBy(*self.keys).agg(F.min(key).alias("first"), F.max(key).alias("last"))
        if before is not None:
            late = reached.join(before.withColumnRenamed("last", "seen"), [*self.keys]).where("first < seen").first()
            if late is not None:
                raise UnsortedInput(f"batch {number}: an alignment starts at {tuple(late.first)}, before {tuple(late.seen)}")
            reached = before.unionByName(reached.drop("first")).groupBy(*self.keys).agg(F.max("last").alias("last"))
        reached.select(*self.keys, "last").write.mode("overwrite").parquet(f"{self.state}/frontier/batch={number}")
        frontier = self._read("frontier", number)

        changes = block_events(batch, self._site)
        changes = changes if opened is None else changes.unionByName(opened)
        segments = sweep(changes, self._site, SIDES, common=False).where("n_base + n_del + n_skip > 0").join(frontier, [*self.keys])
        # the frontier's place on the segment's contig: everything before it is final
        edge = F.when(F.col("tid") < F.col("last.tid"), F.col("stop")).when(F.col("tid") == F.col("last.tid"), F.col("last.pos")).otherwise(F.lit(0))
        segments = segments.withColumn("edge", edge)
        final = segments.where("start < edge").withColumn("stop", F.least("stop", "edge"))
        final.select(*self._site, "start", "stop", *SIDES).write.mode("overwrite").parquet(f"{self.out}/batch={number}")
        later = segments.where("stop > edge").withColumn("start", F.greatest("start", "edge"))
        ends = F.explode(
            F.array(
                F.struct(F.col("start").alias("pos"), *[F.col(s).alias(s) for s in SIDES]),
                F.struct(F.col("stop").alias("pos"), *[(-F.col(s)).alias(s) for s in SIDES]),
            )
        )
        kept = later.select(*self._site, ends.alias("e")).groupBy(*self._site, "e.pos").agg(*[F.sum(f"e.{s}").alias(s) for s in SIDES])
        kept.write.mode("overwrite").parquet(f"{self.state}/open/batch={number}")
        for kind in ("frontier", "open"):  # the batch before this one is needed should this one be repeated
            self._forget(kind, number - 2)

    def _forget(self, kind: str, number: int) -> None:
        old = self._read(kind, number)
        if old is not None:
            old.staged_path = f"{self.state}/{kind}/batch={number}"
            discard(old)

    def open_changes(self, number: int) -> DataFrame | None:
        """What batch ``number`` left open."""
        return self._read("open", number)

    def finish(self, number: int) -> None:
        """Hand on what the last batch, ``number``, left open; nothing is open afterwards."""
        opened = self._read("open", number)
        if opened is None:
            return
        rest = sweep(opened, self._site, SIDES, common=False).where("n_base + n_del + n_skip > 0")
        rest.select(*self._site, "start", "stop", *SIDES).write.mode("overwrite").parquet(f"{self.out}/batch={number + 1}")
        for kind in ("frontier", "open"):
            for old in (number - 1, number):
                self._forget(kind, old)

    def depth(self) -> DataFrame:
        """One row per covered position of all that is final."""
        segments = self.spark.read.parquet(self.out)
        return segments.select(*self.keys, "chrom", F.explode(F.sequence("start", F.col("stop") - 1)).alias("pos"), *SIDES)
