"""The store as a log of runs: what each batch changed, merged when it is read.

A run is a folder r<lo>-<hi> with what the batches lo to hi changed: rows of notes (a
tombstone for one that is gone) and the new passages of these notes, each in folders
by bucket, a hash of the note's identity, so that a tenant of any size is spread over all
buckets. A row has the number of its batch. A note's newest row counts, and a passage
counts if its batch is that of its note's newest row; so a note's row also takes back
its older passages, and nothing that is stored is rewritten.

What a batch writes follows the batch. Reading takes the runs that cover all batches:
from the first, the longest run that begins there, and so on. Merging writes a longer
run, which takes the place of those it covers by being complete: deltas are merged
with each other when they are many, and with the first run, which drops tombstones,
when they hold a share of its bytes. So each byte is rewritten a bounded number of
times for each growth of the store by a constant factor. Runs that have been covered
for some batches, in which readers may still have had them, are deleted.

A run is complete when its mark is there, which is written last; a batch that failed
half-way is written over by its replay, and one that is complete is skipped.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from passagemill import schemas

IDENTITY, NOTE = ["client_name", "scope", "path_or_uri"], ["client_name", "note_id"]
_HEAD = [StructField("seq", LongType()), StructField("bucket", IntegerType())]
NOTE_ROWS = StructType([*(StructField(f.name, f.dataType) for f in schemas.NOTES), StructField("gone", BooleanType()), *_HEAD])
PASSAGE_ROWS = StructType([*(StructField(f.name, f.dataType) for f in schemas.PASSAGES), *_HEAD])


@dataclass(frozen=True, order=True)
class Run:
    lo: int
    hi: int

    @property
    def name(self) -> str:
        return f"r{self.lo:08d}-{self.hi:08d}"


def cover(runs: list[Run]) -> list[Run]:
    """The runs to read: the longest that begins first, then the longest that begins after its end, and so on."""
    out: list[Run] = []
    for run in sorted(runs, key=lambda r: (r.lo, -r.hi)):
        if not out or run.lo > out[-1].hi:
            out.append(run)
    return out


class LogStore:
    """A store in folder. buckets stays as it is for a store's life; merge_after: deltas that are merged; share: of the first run's bytes, from which deltas go into it; keep: batches for which a covered run stays."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64, merge_after: int = 8, share: float = 0.25, keep: int = 2):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.buckets, self.merge_after, self.share, self.keep = buckets, merge_after, share, keep

    def _fs(self, *names: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *names]))
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def runs(self) -> list[Run]:
        """The complete runs."""
        fs, p = self._fs()
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        found = [Run(*map(int, n[1:].split("-"))) for n in names if n.startswith("r")]
        return sorted(r for r in found if fs.exists(self._fs(r.name, "done", "_SUCCESS")[1]))

    def version(self) -> int:
        """The last complete batch, or -1."""
        return max((r.hi for r in self.runs()), default=-1)

    def bytes(self, *runs: Run) -> int:
        total = 0
        for r in runs:
            fs, p = self._fs(r.name)
            total += fs.getContentSummary(p).getLength()
        return total

    def bucket(self) -> Column:
        """The bucket of a row that has a note's identity."""
        return F.pmod(F.xxhash64(*IDENTITY), F.lit(self.buckets)).cast("int")

    def _rows(self, kind: str, schema: StructType, runs: list[Run], buckets: list[int] | None) -> DataFrame:
        paths = [f"{self.folder}/{r.name}/{kind}" for r in runs]
        fs = self._fs()[0]
        paths = [p for p, r in zip(paths, runs, strict=True) if fs.exists(self._fs(r.name, kind)[1])]
        if not paths:
            return self.spark.createDataFrame([], schema)
        out = None
        for p in paths:
            part = self.spark.read.schema(schema).parquet(p)
            out = part if out is None else out.unionByName(part)
        return out if buckets is None else out.filter(F.col("bucket").isin(buckets))

    def read(self, buckets: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
        """(notes, passages) as they are, of some buckets or all. The first run's rows are joined to keys of later runs only, which are few."""
        notes, passages = self._merged(cover(self.runs()), buckets)
        return notes.select(schemas.NOTES.fieldNames()), passages.select(schemas.PASSAGES.fieldNames())

    def _merged(self, runs: list[Run], buckets: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
        """The rows of live notes and passages of runs."""
        first, later = runs[:1], runs[1:]
        notes, passages = (self._rows(k, s, first, buckets) for k, s in (("notes", NOTE_ROWS), ("passages", PASSAGE_ROWS)))
        notes = notes.filter("NOT gone")
        if not later:
            return notes, passages
        last, new = self._latest(later, buckets)
        kept = notes.join(last.select(*IDENTITY).distinct(), IDENTITY, "left_anti")
        touched = last.select("client_name", F.col("id").alias("note_id")).distinct()
        live = last.filter("NOT gone")
        return kept.select(NOTE_ROWS.fieldNames()).unionByName(live), passages.join(touched, NOTE, "left_anti").select(PASSAGE_ROWS.fieldNames()).unionByName(new)

    def _latest(self, runs: list[Run], buckets: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
        """The last row of each note (identity and id) in runs, and the passages of its batch."""
        rows = self._rows("notes", NOTE_ROWS, runs, buckets)
        own = [*IDENTITY, "id"]
        rest = [c for c in NOTE_ROWS.fieldNames() if c not in own]
        last = rows.groupBy(*own).agg(F.max_by(F.struct(*rest), "seq").alias("r")).select(*own, "r.*").select(NOTE_ROWS.fieldNames())
        keys = last.filter("NOT gone").select("client_name", F.col("id").alias("note_id"), "seq")
        new = self._rows("passages", PASSAGE_ROWS, runs, buckets).join(keys, [*NOTE, "seq"], "left_semi")
        return last, new.select(PASSAGE_ROWS.fieldNames())

    def _write(self, run: Run, notes: DataFrame, passages: DataFrame, results: DataFrame | None = None) -> None:
        path = f"{self.folder}/{run.name}"
        for kind, rows, order in (("notes", notes, "id"), ("passages", passages, "note_id")):
            # Rebalanced: small buckets share a task, large ones are cut into several files.
            rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "client_name", order).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{kind}")
        if results is not None:
            results.write.mode("overwrite").parquet(f"{path}/results")
        self.spark.range(0).write.mode("overwrite").parquet(f"{path}/done")

    def append(self, batch: int, written: DataFrame, gone: DataFrame, passages: DataFrame, results: DataFrame | None = None) -> None:
        """Write what a batch changed: notes written, keys of notes gone (IDENTITY and id), and all passages of the notes written."""
        head = lambda rows, gone: rows.withColumn("gone", F.lit(gone)).withColumn("seq", F.lit(batch).cast("long")).withColumn("bucket", self.bucket())
        notes = head(written, False).unionByName(head(gone.select(*IDENTITY, "id"), True), allowMissingColumns=True).select(NOTE_ROWS.fieldNames())
        owner = written.select("client_name", F.col("id").alias("note_id"), self.bucket().alias("bucket"))
        rows = passages.join(owner, NOTE).withColumn("seq", F.lit(batch).cast("long")).select(PASSAGE_ROWS.fieldNames())
        self._write(Run(batch, batch), notes, rows, results)

    def merge(self) -> Run | None:
        """Merge runs if there is reason to; the new run, if any."""
        runs = cover(self.runs())
        if len(runs) < 2:
            return None
        if self.bytes(*runs[1:]) >= self.share * self.bytes(runs[0]):
            new = Run(runs[0].lo, runs[-1].hi)
            self._write(new, *self._merged(runs))
        elif len(runs) > self.merge_after:
            new = Run(runs[1].lo, runs[-1].hi)
            self._write(new, *self._latest(runs[1:]))
        else:
            return None
        return new

    def collect(self) -> list[Run]:
        """Delete runs that have been covered by a longer one for keep batches."""
        runs = self.runs()
        held, now = cover(runs), self.version()
        old = [r for r in runs if r not in held and any(c.lo <= r.lo and r.hi <= c.hi <= now - self.keep for c in held)]
        for r in old:
            fs, p = self._fs(r.name)
            fs.delete(p, True)
        return old
