"""Size-tiered compaction of immutable shards under a versioned manifest.

A shard log is a folder: ``data/`` holds immutable Parquet shards, ``manifests/`` one JSON-lines file per version
that lists the live shards. Arrivals are appended as small shards. Compaction takes a tier, the shards whose sizes
lie within the same power of ``ratio``, and once it holds ``min_runs`` shards rewrites them as files of at most the target
size, without a shuffle: whole shards are packed into bins, and each bin is one task that streams one output file.

Arrivals that are written together come from about one task for each target size of input, or one a core, whatever the number of
their partitions, so that each is a few shards. A compaction removes at once the files that it wrote itself and has merged again;
the version it began with stays readable until ``vacuum``.

A version is committed by renaming a finished file to its name, which fails if that version exists: readers see
the old list or the new one, and of two writers one gets ``CommitConflict`` and tries again on the newer version.
A job that dies, or loses executors beyond recovery, leaves files that no manifest lists; ``vacuum`` removes them.

Defined results: rows are kept as they are, repeated ones too; nulls, empty texts and extra columns are data like
any other; an empty arrival commits a version without new shards; reading an empty log needs the schema and gives
no rows.
"""

from __future__ import annotations

import contextlib
import json
import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import staging

MB = 1 << 20


class CommitConflict(RuntimeError):
    """Another writer has committed this version."""


@contextlib.contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    """Session settings for as long as the block lasts."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class ShardLog:
    def __init__(self, spark: SparkSession, path: str, schema, target_bytes: int = 64 * MB, ratio: float = 4.0, min_runs: int = 4):
        self.spark, self.path, self.schema = spark, path, schema
        self.target_bytes, self.ratio, self.min_runs = target_bytes, ratio, min_runs
        self.fs, _ = staging.file_system(spark, path)

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def version(self) -> int:
        """The newest version; 0 before the first commit."""
        where = self._path("manifests")
        if not self.fs.exists(where):
            return 0
        names = [s.getPath().getName() for s in self.fs.listStatus(where)]
        return max((int(n[1:11]) for n in names if n.startswith("v") and n.endswith(".jsonl")), default=0)

    def shards(self, version: int | None = None) -> list[dict]:
        """The live shards of a version: path below data/, and bytes."""
        version = self.version() if version is None else version
        if not version:
            return []
        stream = self.fs.open(self._path(f"manifests/v{version:010d}.jsonl"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return [json.loads(line) for line in text.splitlines()]

    def commit(self, base: int, shards: list[dict]) -> int:
        """Make ``shards`` version ``base + 1``, or raise CommitConflict if it exists."""
        jvm = self.spark.sparkContext._jvm
        ready, final = self._path(f"manifests/.{uuid.uuid4().hex}"), self._path(f"manifests/v{base + 1:010d}.jsonl")
        out = self.fs.create(ready, False)
        try:
            out.write(bytearray("".join(json.dumps(s) + "\n" for s in shards), "utf-8"))
        finally:
            out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(ready.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        never = self.spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(ready, final, never)
        except Exception as e:
            self.fs.delete(ready, False)
            if "FileAlreadyExists" in str(e):
                raise CommitConflict(f"version {base + 1} exists") from e
            raise
        return base + 1

    def _commit_change(self, gone: list[dict], new: list[dict]) -> int:
        """Commit on the newest version; a writer that lost the race tries again on the next one."""
        paths = {s["path"] for s in gone}
        while True:
            base = self.version()
            live = self.shards(base)
            if not paths <= {s["path"] for s in live}:
                raise CommitConflict("another compaction has replaced these shards")
            try:
                return self.commit(base, [s for s in live if s["path"] not in paths] + new)
            except CommitConflict:
                continue

    def _written(self, folder: str) -> list[dict]:
        """The shards of a folder, listed by one Spark job that opens none."""
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(f"{self.path}/data/{folder}")
        found = files.select(F.substring_index("path", f"/{folder}/", -1).alias("name"), "length").collect()
        return sorted(({"path": f"{folder}/{name}", "bytes": size} for name, size in found), key=lambda s: s["path"])

    def _few(self, rows: DataFrame) -> DataFrame:
        """``rows`` in no more partitions than their estimated size has targets, or than there are cores; neighbours are read together."""
        size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        return rows.coalesce(max(self.spark.sparkContext.defaultParallelism, -(-size // self.target_bytes))) if size < self.target_bytes << 20 else rows

    def append(self, arrival: DataFrame) -> int:
        """Write one arrival as small shards, one per task, and commit them."""
        folder = uuid.uuid4().hex
        arrival.write.parquet(f"{self.path}/data/{folder}")
        return self._commit_change([], self._written(folder))

    def append_each(self, arrivals: DataFrame, by: str) -> int:
        """One job writes all arrivals, told apart by column ``by``; each is then a commit of its own, in order."""
        folder, name = uuid.uuid4().hex, staging.free_name(arrivals, "__arrival")
        self._few(arrivals.withColumn(name, F.col(by))).write.partitionBy(name).parquet(f"{self.path}/data/{folder}")
        new: dict[str, list[dict]] = {}
        for s in self._written(folder):
            new.setdefault(s["path"].split("/")[1], []).append(s)
        for _, part in sorted(new.items()):
            self._commit_change([], part)
        return self.version()

    def tier(self, shard: dict) -> int:
        return math.floor(math.log(max(shard["bytes"], 1), self.ratio))

    def next_run(self) -> list[dict]:
        """The shards of the smallest tier that is ripe; shards near the target size and above are finished."""
        tiers: dict[int, list[dict]] = {}
        for s in self.shards():
            if s["bytes"] < self.target_bytes / 2:
                tiers.setdefault(self.tier(s), []).append(s)
        return next((run for _, run in sorted(tiers.items()) if len(run) >= self.min_runs), [])

    def batches(self, run: list[dict], files: int) -> list[list[dict]]:
        """``run`` cut, largest shards first, into batches that become about ``files`` files each, of two shards at least."""
        cut: list[list[dict]] = [[]]
        held = 0
        for s in sorted(run, key=lambda s: (-s["bytes"], s["path"])):
            if held + s["bytes"] > files * self.target_bytes and len(cut[-1]) > 1:
                cut.append([])
                held = 0
            cut[-1].append(s)
            held += s["bytes"]
        return [c for c in cut if len(c) > 1]

    def compact(self, files_a_job: int = 1024) -> int:
        """Merge ripe tiers until none is left. Each merge reads and writes its shards once, without a shuffle.

        Spark's reader packs whole files, largest first, into tasks of at most ``maxPartitionBytes``; with the target
        for that, and nothing else that makes tasks smaller, every task is a bin and writes one file. Where the reader cuts smaller all
        the same, tasks are put together, so every merge leaves fewer shards or is the last. A job that dies
        costs no other one's work: each commits what it has merged. A reader of a version between may have to read anew.
        """
        own: set[str] = set()  # written by this call
        bins = {"maxPartitionBytes": str(self.target_bytes), "minPartitionNum": "1", "openCostInBytes": "0"}
        while run := self.next_run():
            for part in self.batches(run, files_a_job):
                folder = uuid.uuid4().hex
                with _settings(self.spark, {f"spark.sql.files.{k}": v for k, v in bins.items()}):
                    most = 2 * sum(s["bytes"] for s in part) // self.target_bytes + 1  # bins that fill up in turn are no more
                    self._read(part).coalesce(most).write.parquet(f"{self.path}/data/{folder}")
                new = self._written(folder)
                if len(new) >= len(part):  # nothing gained: they are as full as they get
                    return self.version()
                self._commit_change(part, new)
                for s in part:
                    if s["path"] in own:
                        self.fs.delete(self._path(f"data/{s['path']}"), False)
                own |= {s["path"] for s in new}
        return self.version()

    def vacuum(self) -> None:
        """Remove shards that the newest version does not list. No writer may be at work."""
        live = {s["path"] for s in self.shards()}
        files, gone = self.fs.listFiles(self._path("data"), True), []
        root = self._path("data").toUri().getPath()
        while files.hasNext():
            p = files.next().getPath()
            if p.toUri().getPath()[len(root) + 1 :] not in live and p.getName().endswith(".parquet"):
                gone.append(p)
        for p in gone:
            self.fs.delete(p, False)

    def _read(self, shards: list[dict]) -> DataFrame:
        if not shards:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{s['path']}" for s in shards])

    def read(self, version: int | None = None) -> DataFrame:
        return self._read(self.shards(version))


ARRIVALS = 8


def op2_shard_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive in eight batches, are compacted, and are read back through the committed manifest."""
    docs = staging.table(spark, sf_dir, "documents")
    arrival = staging.free_name(docs, "arrival")
    docs = docs.withColumn(arrival, F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % ARRIVALS)
    log = ShardLog(spark, staging.new_path(spark, "shards"), docs.schema)
    log.append_each(docs, arrival)
    log.compact()
    log.vacuum()
    return log.read().select("doc_id", "lang", "source", "n_chars", F.md5(F.encode("text", "UTF-8")).alias("text_md5"))


ORACLE = "SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents"
