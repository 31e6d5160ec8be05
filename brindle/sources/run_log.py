"""A stream of chosen runs of the event log: it resumes at a sequence number and ends where the run ends."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

FIELDS = ("run_id", "seq", "type", "payload", "created_at")
SCHEMA = pa.schema([("run_id", pa.string()), ("seq", pa.int32()), ("type", pa.string()), ("payload", pa.string()), ("created_at", pa.timestamp("us", tz="UTC"))])


class _Stretch(InputPartition):
    """The rows of a run behind ``after``, up to ``last``."""

    def __init__(self, run: str, after: int, last: int):
        self.run, self.after, self.last = run, after, last


class _Follow(DataSourceStreamReader):
    """Offsets are the last sequence number of each run, {run: seq}."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.runs = sorted({r for r in options.get("runs", "").split(",") if r})
        self.after = int(options.get("after", "0"))
        self.until = [t for t in options.get("until", "").split(",") if t]
        self.rows = int(options.get("rows", "100000"))
        self.at = dict.fromkeys(self.runs, self.after)
        self.ended: set[str] = set()

    def _log(self) -> pads.Dataset | None:
        """The log's files as they are now; file statistics spare those without the rows asked for."""
        system, path = fs.FileSystem.from_uri(self.path)
        if system.get_file_info(path).type == fs.FileType.NotFound:
            return None
        return pads.dataset(path, filesystem=system, format="parquet", partitioning="hive", schema=SCHEMA)

    def _reach(self, log: pads.Dataset, run: str) -> int:
        """How far a run goes without a gap from where it is known to be. One bit a new row is held, not the rows."""
        start, seen, end = self.at[run], np.zeros(0, bool), None
        new = (pads.field("run_id") == run) & (pads.field("seq") > start)
        for batch in log.to_batches(columns=["seq", "type"], filter=new):
            seq = batch.column("seq").to_numpy(zero_copy_only=False).astype(np.int64) - start - 1
            if not len(seq):
                continue
            if seq.max() >= len(seen):
                seen = np.concatenate([seen, np.zeros(max(int(seq.max()) + 1 - len(seen), len(seen)), bool)])
            seen[seq] = True
            last = seq[np.isin(np.asarray(batch.column("type").to_pylist(), dtype=object), self.until)] if self.until else seq[:0]
            if len(last):
                end = int(last.min()) if end is None else min(end, int(last.min()))
        whole = int(np.argmin(seen)) if len(seen) and not seen.all() else len(seen)
        if end is not None and end < whole:
            self.ended.add(run)
            return start + end + 1
        return start + whole

    def initialOffset(self) -> dict:
        return dict.fromkeys(self.runs, self.after)

    def latestOffset(self) -> dict:
        log = self._log()
        if log is not None:
            for run in self.runs:
                if run not in self.ended:
                    self.at[run] = self._reach(log, run)
        return dict(self.at)

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out: list[InputPartition] = []
        for run in self.runs:
            low, high = start.get(run, self.after), end.get(run, self.after)
            out += [_Stretch(run, a, min(a + self.rows, high)) for a in range(low, high, self.rows)]
        return out

    def read(self, partition: _Stretch) -> Iterator[pa.RecordBatch]:
        log = self._log()
        if log is None:
            raise FileNotFoundError(self.path)
        mine = (pads.field("run_id") == partition.run) & (pads.field("seq") > partition.after) & (pads.field("seq") <= partition.last)
        rows = log.to_table(columns=list(FIELDS), filter=mine).sort_by("seq")
        seq = rows.column("seq").to_numpy()
        first = np.r_[True, seq[1:] != seq[:-1]][: len(seq)]
        if first.sum() != partition.last - partition.after:
            raise ValueError(f"run {partition.run}: rows behind {partition.after} up to {partition.last} are gone")
        yield from rows.filter(pa.array(first)).to_batches()

    def commit(self, end: dict) -> None:
        pass


class RunLog(DataSource):
    """``spark.readStream.format("run_log")``: the rows of runs, each once, in stretches of ``rows`` rows a task.

    Options: ``path`` of the log (parquet, laid out in any way), ``runs`` (ids parted by commas), ``after`` (the sequence
    number a follower has already, 0), ``until`` (types that end a run, parted by commas; what stands behind the first of
    them is no row), ``rows``. A run is followed as far as it has no gap: a row that becomes visible before its forerunner
    waits for it. Rows written twice count once. A log that does not exist yet, and an unknown run, have no rows. Rows
    without run or number are passed over. The checkpoint holds the numbers, so a stream that was killed goes on where its
    last whole trigger ended.
    """

    @classmethod
    def name(cls) -> str:
        return "run_log"

    def schema(self) -> str:
        return "run_id string, seq int, type string, payload string, created_at timestamp"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Follow(self.options)
