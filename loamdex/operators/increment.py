"""Processing only new or changed records.

Method: a table version is an immutable manifest that lists data files, deletion vectors and the
source versions processed so far. Comparing two manifests gives the files added, the files removed
and the vectors added; they alone are read to derive the record delta. The version processed last
is saved in the manifest that commits the output, so a run that fails leaves nothing behind, a
run that is repeated finds its work done, and of two runs at once just one commits.

``VersionedTable`` keeps such tables through Hadoop's FileSystem, on whatever storage the path names. ``replace`` brings a
table to a new state: files are buckets of the key's hash with a digest each, buckets with the
same digest are neither read nor written, of the others only rows that differ become new files
and only their keys deletion vectors. A vector holds keys and acts on files of earlier commits.

Defined results: a null key takes no part; of several rows with one key in a state the
largest digest holds; letter case of digests doesn't matter; a null digest differs from any other
and equals a null one; an empty previous state makes every record new; a table without version reads as None.
"""

from __future__ import annotations

import json
import os
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loamdex.session import checkpointed, ensure_checkpoint

FILE_ROWS = 100_000
_BUCKET, _SEQ = "_bucket", "_seq"


class CommitConflict(RuntimeError):
    """Another commit came between reading a manifest and writing the next one."""


class Storage:
    """The few file operations a versioned table needs, on any file system Hadoop knows."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf, self.root = spark._jvm, spark._jsc.hadoopConfiguration(), root.rstrip("/")
        self.fs = self._path("").getFileSystem(self.conf)
        self.local = self.fs.getUri().getScheme() == "file"

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        p = self._path(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(p)] if self.fs.exists(p) else []

    def files(self, folder: str, suffix: str) -> list[str]:
        """Files below a folder, relative to it."""
        p = self._path(folder)
        out, it = [], self.fs.listFiles(p, True) if self.fs.exists(p) else None
        while it is not None and it.hasNext():
            at = it.next().getPath().toString()
            if at.endswith(suffix):
                out.append(at[at.index(f"/{folder}/") + len(folder) + 2 :])
        return sorted(out)

    def text(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put_new(self, name: str, text: str) -> bool:
        """Write a file whole, or return False and write nothing if the name is taken; atomic where renaming is."""
        folder, own = name.rsplit("/", 1)
        part = f"{folder}/.{own}-{uuid.uuid4().hex}"
        stream = self.fs.create(self._path(part), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        try:
            if self.local:  # renaming replaces a file there, linking doesn't
                at = lambda n: self._path(n).toUri().getPath()
                os.link(at(part), at(name))
            else:
                self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf).rename(self._path(part), self._path(name))
        except FileExistsError:
            return False
        except Exception as e:
            if "FileAlreadyExistsException" in str(e):
                return False
            raise
        finally:
            self.fs.delete(self._path(part), False)
        return True


class VersionedTable:
    """A table of immutable Parquet files with one JSON manifest a version, in a folder all executors share."""

    def __init__(self, spark: SparkSession, path: str, key: str, *, file_rows: int = FILE_ROWS):
        self.spark, self.path, self.key, self.file_rows = spark, path.rstrip("/"), key, file_rows
        self.storage = Storage(spark, self.path)

    def version(self) -> int:
        return max((int(f[:-5]) for f in self.storage.names("versions") if f.endswith(".json") and f[:-5].isdigit()), default=0)

    def read_manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "commits": [], "files": [], "vectors": [], "schemas": {}, "buckets": 0, "digests": {}, "processed": {}}
        return json.loads(self.storage.text(f"versions/{version}.json"))

    # -------------------------------------------------------------- writing

    def _bucketed(self, df: DataFrame, buckets: int) -> DataFrame:
        return df.withColumn(_BUCKET, F.pmod(F.xxhash64(self.key), F.lit(max(1, buckets))).cast("int"))

    def _write(self, df: DataFrame, commit: str, kind: str, buckets: int) -> list[dict]:
        """Write rows as one or more files a bucket: their manifest entries."""
        folder = f"{kind}/{commit}"
        self._bucketed(df, buckets).repartition(_BUCKET).write.partitionBy(_BUCKET).parquet(f"{self.path}/{folder}")
        return [{"path": f"{folder}/{f}", "commit": commit, "bucket": int(f.split("/")[0].split("=")[1])} for f in self.storage.files(folder, ".parquet")]

    def _put(self, m: dict, commit: str, files: list[dict], vectors: list[dict], schema: StructType | None, **changed) -> int | None:
        """The manifest after ``m``: its version, or None if another commit took the number."""
        if schema is not None:
            m = m | {"schemas": m["schemas"] | {commit: json.loads(schema.json())}}
        new = m | {"version": m["version"] + 1, "commits": [*m["commits"], commit], "files": [*m["files"], *files], "vectors": [*m["vectors"], *vectors]} | changed
        return new["version"] if self.storage.put_new(f"versions/{new['version']}.json", json.dumps(new)) else None

    def commit(self, add: DataFrame | None = None, delete: DataFrame | None = None, processed: dict[str, int] | None = None, *, base: int | None = None) -> int:
        """A new version: keys deleted, rows added, and the source versions it has processed, all or nothing.

        What is written doesn't depend on the version it follows, so a commit that another one came before is put
        after that one. With ``base`` it must follow that version, else ``CommitConflict``.
        """
        commit = uuid.uuid4().hex
        m = self.read_manifest(base)
        files = self._write(add, commit, "data", m["buckets"]) if add is not None else []
        vectors = self._write(delete.select(self.key).filter(F.col(self.key).isNotNull()).distinct(), commit, "dead", m["buckets"]) if delete is not None else []
        while True:
            # Digests of buckets hold only for states set by ``replace``.
            done = self._put(m, commit, files, vectors, add.schema if add is not None else delete.select(self.key).schema if delete is not None else None, digests={} if files or vectors else m["digests"], processed=m["processed"] | (processed or {}))
            if done:
                return done
            if base is not None:
                raise CommitConflict(f"version {base + 1} of {self.path} was committed by another run")
            m = self.read_manifest()

    def replace(self, state: DataFrame, processed: dict[str, int] | None = None) -> int:
        """Bring the table to ``state`` (one row a key): only buckets that differ are read, only rows that differ written. No difference, no version."""
        state = checkpointed(state.filter(F.col(self.key).isNotNull()))
        while True:
            m = self.read_manifest()
            buckets = m["buckets"] or max(1, -(-state.count() // self.file_rows))
            s = self._bucketed(state, buckets)
            rows = F.bit_xor(F.xxhash64(*state.columns)), F.count(F.lit(1))
            digests = {str(r[0]): [r[1], r[2]] for r in s.groupBy(_BUCKET).agg(*rows).collect()}  # one row a file
            known = m["digests"] if m["files"] or not m["commits"] else {}
            differ = sorted(int(b) for b in digests.keys() | known.keys() | {str(f["bucket"]) for f in m["files"]} if digests.get(b) != known.get(b))
            commit = uuid.uuid4().hex
            if not m["files"]:
                files, vectors = self._write(state, commit, "data", buckets), []
            elif differ:
                among = F.broadcast(self.spark.createDataFrame([(b,) for b in differ], f"{_BUCKET} int"))
                old = self._live(m, {*differ})
                new = s.join(among, _BUCKET, "left_semi").drop(_BUCKET)
                both = old.select(self.key, F.struct(*state.columns).alias("_o")).join(new.select(self.key, F.struct(*state.columns).alias("_n")), self.key, "full").filter("not (_o <=> _n)")
                both = checkpointed(both)
                files = self._write(both.filter("_n is not null").select("_n.*"), commit, "data", buckets)
                vectors = self._write(both.filter("_o is not null").select(self.key), commit, "dead", buckets)
            elif not processed:
                return m["version"]
            else:
                files, vectors = [], []
            done = self._put(m, commit, files, vectors, state.schema, buckets=buckets, digests=digests, processed=m["processed"] | (processed or {}))
            if done:
                return done

    def compact(self) -> int:
        """A version with the same rows in fresh files, without vectors; the files it replaces stay for earlier versions."""
        m = self.read_manifest()
        commit = uuid.uuid4().hex
        live = self._live(m)
        files = self._write(live, commit, "data", m["buckets"]) if live is not None else []
        done = self._put(m | {"files": [], "vectors": []}, commit, files, [], live.schema if live is not None else None)
        if not done:
            raise CommitConflict(f"version {m['version'] + 1} of {self.path} was committed by another run")
        return done

    # -------------------------------------------------------------- reading

    def _load(self, m: dict, entries: list[dict], *names: str) -> DataFrame | None:
        """Rows of files (or columns of them) with the number of their commit, one scan a commit."""
        seq = {c: k for k, c in enumerate(m["commits"])}
        groups: dict[str, list[str]] = {}
        for e in entries:
            groups.setdefault(e["commit"], []).append(f"{self.path}/{e['path']}")
        parts = []
        for c, own in groups.items():
            kept = StructType([f for f in StructType.fromJson(m["schemas"][c]).fields if not names or f.name in names])
            parts.append(self.spark.read.schema(kept).parquet(*own).withColumn(_SEQ, F.lit(seq[c])))
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None

    def _live(self, m: dict, buckets: set[int] | None = None, files: list[dict] | None = None) -> DataFrame | None:
        """Rows of some files that no later vector of the manifest names."""
        own = [f for f in (m["files"] if files is None else files) if buckets is None or f["bucket"] in buckets]
        df = self._load(m, own)
        if df is None:
            known = [x for c in reversed(m["commits"]) if len(x := StructType.fromJson(m["schemas"].get(c, {"fields": []}))) > 1]
            return self.spark.createDataFrame([], known[0]) if known else None
        seq = {c: k for k, c in enumerate(m["commits"])}
        first, here = min(seq[f["commit"]] for f in own), {f["bucket"] for f in own}
        dead = self._load(m, [v for v in m["vectors"] if seq[v["commit"]] >= first and v["bucket"] in here], self.key)
        if dead is not None:
            dead = dead.groupBy(self.key).agg(F.max(_SEQ).alias("_dead"))
            # A commit deletes before it adds, so its own rows outlive its vectors.
            df = df.join(dead, self.key, "left").filter(f"_dead is null or _dead <= {_SEQ}").drop("_dead")
        return df.drop(_SEQ)

    def read(self, version: int | None = None) -> DataFrame | None:
        return self._live(self.read_manifest(version))

    def changes(self, since: int, until: int | None = None) -> tuple[DataFrame | None, DataFrame | None]:
        """Rows added and rows removed between two versions; of files both share, only those in buckets with new vectors are read."""
        b, a = self.read_manifest(since), self.read_manifest(until)
        before, after = {f["path"] for f in b["files"]}, {f["path"] for f in a["files"]}
        fresh = [f for f in a["files"] if f["path"] not in before]
        gone = [f for f in b["files"] if f["path"] not in after]
        added = self._live(a, files=fresh) if fresh else None
        removed = self._live(b, files=gone) if gone else None
        old = {v["path"] for v in b["vectors"]}
        vectors = [v for v in a["vectors"] if v["path"] not in old]
        shared = [f for f in b["files"] if f["path"] in after and f["bucket"] in {v["bucket"] for v in vectors}]
        if vectors and shared:
            dead = self._load(a, vectors, self.key).select(self.key).distinct()
            hit = self._live(b, files=shared).join(dead, self.key, "left_semi")
            removed = hit if removed is None else removed.unionByName(hit, allowMissingColumns=True)
        return added, removed

    def delta(self, since: int, until: int | None = None, *, kind: str = "change_kind") -> DataFrame | None:
        """Records that differ between two versions: their row (the later one, of removed ones the earlier) and whether they are new, changed or removed."""
        added, removed = self.changes(since, until)
        if added is None and removed is None:
            return None
        if removed is None:
            return added.withColumn(kind, F.lit("new"))
        if added is None:
            return removed.withColumn(kind, F.lit("removed"))
        names = [c for c in added.columns if c in removed.columns]
        both = added.select(self.key, F.struct(*names).alias("_a")).join(removed.select(self.key, F.struct(*names).alias("_r")), self.key, "full").filter("not (_a <=> _r)")
        how = F.when(F.col("_r").isNull(), "new").when(F.col("_a").isNull(), "removed").otherwise("changed")
        return both.select(F.coalesce("_a", "_r").alias("_x"), how.alias(kind)).select("_x.*", kind)


def process(source: VersionedTable, output: VersionedTable, work, name: str = "source", *, kind: str | None = None) -> int | None:
    """Run ``work(rows)`` on the rows new or changed at ``source`` since ``output`` last processed it, and commit result and version together.

    Results of changed keys replace the earlier ones; keys removed at the source are removed. With ``kind`` the rows
    tell by a column of that name whether they are new or changed. Nothing to do: None. If another run
    commits first, what is left is read again.
    """
    while True:
        m = output.read_manifest()
        done, now = m["processed"].get(name, 0), source.version()
        if done == now:
            return None
        how = kind or "_kind"
        delta = source.delta(done, now, kind=how)
        rows = gone = None
        if delta is not None:
            rows = delta.filter(F.col(how) != "removed")
            rows = work(rows if kind else rows.drop(how))
            gone = delta.filter(F.col(how) != "new").select(source.key) if m["files"] else None
        try:
            return output.commit(rows, gone, {name: now}, base=m["version"])
        except CommitConflict:
            continue


# ------------------------------------------------------------------ the project's states


def stored_state(index: DataFrame, runs: DataFrame) -> DataFrame:
    """What successful runs stored last: entries of other runs were never committed, superseded ones are deleted."""
    ok = runs.filter(F.col("run_status") == "ok").select("run_id").distinct()
    e = index.filter("packet_id is not null").join(ok, "run_id", "left_semi")
    last = F.max(F.struct("indexed_at", "entry_id", F.lower("content_hash").alias("digest")))
    return e.groupBy(F.col("packet_id").alias("record")).agg(last.alias("x")).select("record", "x.digest")


def present_state(packets: DataFrame) -> DataFrame:
    return packets.filter("packet_id is not null and deleted_at is null").groupBy(F.col("packet_id").alias("record")).agg(F.max(F.lower("content_hash")).alias("digest"))


def found(packets: DataFrame, index: DataFrame, runs: DataFrame, *, folder: str | None = None, file_rows: int = FILE_ROWS) -> DataFrame:
    """(packet_id, change_kind) of packets that are new or changed since they were last stored successfully.

    What runs stored is version 1 of the state table, and the output begins as having processed it; the present state
    is version 2. One incremental run over the difference of their manifests writes the rows, which are read from its commit.
    ``folder`` lies on storage all executors share (by default in the checkpoint folder); an output that is there is kept.
    """
    spark = packets.sparkSession
    if folder is None:
        ensure_checkpoint(spark)
        folder = f"{spark.sparkContext.getCheckpointDir()}/increment-{uuid.uuid4().hex}"
    source = VersionedTable(spark, f"{folder}/state", "record", file_rows=file_rows)
    output = VersionedTable(spark, f"{folder}/delta", "record", file_rows=file_rows)
    if not output.version():
        output.commit(processed={"source": source.replace(stored_state(index, runs))})
    if source.version() == output.read_manifest()["processed"]["source"]:
        source.replace(present_state(packets))
    process(source, output, lambda rows: rows, kind="change_kind")
    got = output.read()
    if got is None:  # no run has had anything to write
        got = spark.createDataFrame([], "record string, change_kind string")
    return got.select(F.col("record").alias("packet_id"), "change_kind")


def state_changes(before: DataFrame, after: DataFrame, name: str) -> DataFrame:
    """(name, record, change_kind): what ``after`` (record, digest) changes against each of a few states of ``before`` (name, record, digest).

    The states of a record are gathered first, so that what is shuffled doesn't grow with the number of states.
    """
    states = before.select(name).distinct()
    b = before.groupBy("record").agg(F.map_from_entries(F.collect_list(F.struct(name, F.struct("digest")))).alias("b"))
    a = after.select("record", F.struct("digest").alias("a"))
    own = F.col("b")[F.col(name)]
    kind = F.when(F.col("a").isNull() & own.isNotNull(), "removed").when(F.col("a").isNotNull() & own.isNull(), "new").when(~F.col("a").eqNullSafe(own), "changed")
    return b.join(a, "record", "full").crossJoin(F.broadcast(states)).select(name, "record", kind.alias("change_kind")).filter("change_kind is not null")
