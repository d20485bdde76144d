"""Round-loop hygiene for iterative DataFrame jobs.

Every round of a vertex program builds a new state DataFrame from the previous
one. Without care the plan grows with every round and each action recomputes
all earlier rounds. ``StateKeeper`` keeps the loop bounded:

* a round's state is persisted while the round's steps read it several times;
* every ``checkpoint_every`` rounds it is written with ``DataFrame.checkpoint()``
  to the shared ``spark.checkpoint.dir`` (never a local checkpoint, so the loss
  of an executor only costs a re-read, never the state);
* the frames of the previous round are unpersisted, and its checkpoint deleted, once
  the new one exists: storage holds one round's state however many rounds there are.
"""

from __future__ import annotations

import json
import posixpath
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcover.session import drop_path, ensure_checkpoint_dir, held_settings


@contextmanager
def kept_layout(spark, n_parts: int | None = None):
    """Runtime re-planning that leaves partition counts alone; settings are restored after.

    The loops keep states and edges hash-partitioned alike from step to step, in ``n_parts``
    partitions. Merging small partitions would give every step a layout of its own and shuffle
    the next one again; the rest of adaptive execution (skewed joins, plans by measured size)
    stays on.
    """
    settings = {
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        # a held frame is printed with what made it wherever it is read: texts of nested rounds
        # grow to hundreds of MB on the driver
        "spark.sql.maxPlanStringLength": "200000",
    }
    if n_parts:
        settings["spark.sql.shuffle.partitions"] = str(n_parts)
    with held_settings(spark, settings):
        yield


def checkpointed(df: DataFrame) -> tuple[DataFrame, str]:
    """``df.checkpoint()`` and the folder it was written to."""
    ensure_checkpoint_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    return out, out._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get()


class StateKeeper:
    def __init__(self, spark, checkpoint_every: int = 1):
        self.spark = spark
        self.checkpoint_every = max(1, int(checkpoint_every))
        self._held: list[DataFrame] = []
        self._old: list[DataFrame] = []
        self._folder: str | None = None
        self._round = 0

    def hold(self, df: DataFrame) -> DataFrame:
        """Persist a frame that the current round reads more than once."""
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
        self._held.append(df)
        return df

    def settle(self, df: DataFrame, force: bool = False, count: bool = True) -> DataFrame:
        """End a round: checkpoint (or persist) the new state and drop the old frames.

        With ``count=False`` the caller's own next action fills the cache; it calls
        ``drop_old`` after that.
        """
        self._round += 1
        self._old = self._held
        self._held = []
        if force or self._round % self.checkpoint_every == 0:
            out, folder = checkpointed(df)
            out = self.hold(out)
            if self._folder:
                drop_path(self.spark, self._folder)
            self._folder = folder
        else:
            out = self.hold(df)
            if not count:
                return out
            out.count()
        self.drop_old()
        return out

    def drop_old(self) -> None:
        for frame in self._old:
            frame.unpersist(blocking=False)
        self._old = []

    def release(self) -> None:
        """Let go of all frames and the last checkpoint; nothing may be read from them after."""
        self.drop_old()
        for frame in self._held:
            frame.unpersist(blocking=False)
        self._held = []
        if self._folder:
            drop_path(self.spark, self._folder)
            self._folder = None


class DeltaKeeper(StateKeeper):
    """A ``StateKeeper`` whose rounds write the changed rows only: a base table and delta tables.

    The state has one row per ``id``; no id is added or lost between full writes. ``settle``
    compares the new state with the last one (both lie by ``id``: no exchange), checkpoints the
    rows that differ as one more delta, and gives back the base with the newest row of each id
    laid over it. So the lineage is always base, deltas, one join. ``max_deltas`` of them are
    merged into one; where they would hold over ``compact_share`` of the base's rows the whole state
    is written as a new base.
    ``tick`` names a whole-number column that is the same in all rows and grows by one a round:
    it is set, not stored. ``transient`` columns are flags of one round: rows where one is true
    are written, the others have null there. ``written`` lists the rows written per round.
    """

    def __init__(
        self, spark, edges, *, tick: str, transient: tuple[str, ...] = (), max_deltas: int = 3, compact_share: float = 0.5
    ):
        super().__init__(spark, 1)
        self._edges, self.tick, self.transient = edges, tick, transient
        self.max_deltas, self.compact_share = max_deltas, compact_share
        self._base: DataFrame | None = None
        self._base_rows = self._since = 0
        self._deltas: list[tuple[DataFrame, str, int]] = []
        self._last: DataFrame | None = None
        self.written: list[int] = []

    def settle(self, df: DataFrame, force: bool = False, count: bool = True) -> DataFrame:
        self.written.append(0)
        out = self._write_base(df) if force or self._base is None else self._write_delta(df)
        self._last = out
        if count:
            out.count()
            self.drop_old()
        return out

    def _retire_frames(self) -> None:
        self._old, self._held = self._old + self._held, []
        if self._last is not None and self._last is not self._base:
            self._old.append(self._last)

    def _write_base(self, df: DataFrame) -> DataFrame:
        base, folder = checkpointed(df)
        self._retire_frames()
        self._drop_tables()
        self._base, self._folder = base.persist(StorageLevel.MEMORY_AND_DISK), folder
        self._base_rows, self._since = self._base.count(), 0
        self.written[-1] += self._base_rows
        return self._base

    def _add(self, rows: DataFrame) -> None:
        delta, folder = checkpointed(rows)
        n = delta.count()
        self.written[-1] += n
        self._deltas.append((delta, folder, n))

    def _write_delta(self, df: DataFrame) -> DataFrame:
        kept = [c for c in df.columns if c not in ("id", self.tick, *self.transient)]
        last = self._last.select("id", F.struct(*kept).alias("_last"))
        differs = ~F.struct(*kept).eqNullSafe(F.col("_last"))
        for c in self.transient:
            differs = differs | F.coalesce(F.col(c), F.lit(False))
        df = self.hold(df)  # the changes are counted first: much change is written as a base, once
        changed = df.join(self._edges._hashed(last, len(kept)), "id").where(differs)
        self._since += 1
        if changed.count() + sum(n for _, _, n in self._deltas) > self.compact_share * self._base_rows:
            return self._write_base(df)
        stored = ["id", *kept, *self.transient]
        self._add(changed.select(*stored, F.lit(self._since).alias("_at")))
        if len(self._deltas) >= self.max_deltas:
            before, rows = self._deltas, self._newest()
            self._deltas = []
            self._add(rows)
            for _, folder, _ in before:
                drop_path(self.spark, folder)
        out = self._overlay(df.columns)
        self._retire_frames()
        return out.persist(StorageLevel.MEMORY_AND_DISK)

    def _newest(self) -> DataFrame:
        """Of each id in the deltas its newest row."""
        rows = self._deltas[0][0]
        if len(self._deltas) == 1:
            return rows
        for delta, _, _ in self._deltas[1:]:
            rows = rows.unionByName(delta)
        values = [c for c in rows.columns if c != "id"]
        newest = rows.groupBy("id").agg(F.max_by(F.struct(*values), "_at").alias("_row"))
        return newest.select("id", *[F.col(f"_row.{c}").alias(c) for c in values])

    def _overlay(self, columns: list[str]) -> DataFrame:
        newest = self._newest()
        newest = newest.select("id", F.struct(*[c for c in newest.columns if c != "id"]).alias("_new"))
        joined = self._base.join(self._edges._hashed(newest, len(columns)), "id", "left")
        out = []
        for c in columns:
            if c == "id":
                out.append(F.col("id"))
            elif c == self.tick:
                out.append((F.col(c) + self._since).cast(self._base.schema[c].dataType).alias(c))
            elif c in self.transient:
                out.append(F.when(F.col("_new._at") == self._since, F.col(f"_new.{c}")).alias(c))
            else:
                out.append(F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c))
        return joined.select(*out)

    def _drop_tables(self) -> None:
        if self._base is not None:
            self._old.append(self._base)
        for folder in [f for _, f, _ in self._deltas] + ([self._folder] if self._folder else []):
            drop_path(self.spark, folder)
        self._deltas, self._folder = [], None

    def release(self) -> None:
        self._retire_frames()
        self._drop_tables()
        self._base = self._last = None
        super().release()


class RoundLog:
    """Committed rounds of a loop in a folder on shared storage, for a driver that dies.

    Checkpoints outlive executors, but only the driver knows them. A commit writes the state
    as Parquet and then, in one small file, which round it is, where its tables lie and what
    the driver knew (live counts). The file comes last, so a commit is seen whole or not at
    all; a new driver reads the newest one. Tables of earlier commits are deleted after.
    """

    def __init__(self, spark: SparkSession, folder: str, every: int = 10):
        self.spark, self.folder, self.every = spark, folder.rstrip("/"), max(1, int(every))
        path = spark._jvm.org.apache.hadoop.fs.Path
        self._path = lambda *parts: path(posixpath.join(self.folder, *parts))
        self._fs = self._path().getFileSystem(spark._jsc.hadoopConfiguration())

    def due(self, round_no: int) -> bool:
        return round_no % self.every == 0

    def _manifests(self) -> list[str]:
        if not self._fs.exists(self._path()):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path())]
        return sorted(n for n in names if n.startswith("round-") and n.endswith(".json"))

    def latest(self, expected: dict) -> dict | None:
        """The newest commit, or None. One of another input (``expected`` differs) is an error."""
        names = self._manifests()
        if not names:
            return None
        stream = self._fs.open(self._path(names[-1]))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        found = json.loads(text)
        if any(found.get(k) != v for k, v in expected.items()):
            raise ValueError(f"{self.folder} holds rounds of another input ({text[:200]}); use one folder per run")
        return found

    def read(self, name: str) -> DataFrame:
        out = self.spark.read.parquet(posixpath.join(self.folder, name))
        out._log_name = name
        return out

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` as a table of the log, read back; one left over from an uncommitted try is replaced."""
        df.write.mode("overwrite").parquet(posixpath.join(self.folder, name))
        return self.read(name)

    def commit(self, round_no: int, state: DataFrame, retired: list[DataFrame], facts: dict) -> None:
        before = self._manifests()
        name = f"state-{round_no:08d}"
        state.write.mode("overwrite").parquet(posixpath.join(self.folder, name))
        manifest = facts | {"round": round_no, "state": name, "retired": [p._log_name for p in retired]}
        # written aside and renamed: a half-written file never has the name of a commit
        aside, final = self._path(f".round-{round_no:08d}.tmp"), self._path(f"round-{round_no:08d}.json")
        out = self._fs.create(aside, True)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        if not self._fs.rename(aside, final):
            raise OSError(f"could not commit round {round_no} in {self.folder}")
        for old in before:
            self._fs.delete(self._path(old), False)
            self._fs.delete(self._path("state-" + old[len("round-") : -len(".json")]), True)

    def clear(self) -> None:
        self._fs.delete(self._path(), True)
