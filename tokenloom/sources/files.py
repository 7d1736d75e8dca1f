"""Project trees as a ``files`` table or stream through a Python DataSource.

Spark's file sources skip names starting with '_' or '.', which loses
``__init__.py`` and rule files; this source walks the trees itself and keeps
them.  Trees are listed and read through Arrow's file systems (local folders,
HDFS and object stores by URI), so nothing needs to be mounted on the executors.

Batch: partitions are shards of each root's entries, listed on the driver
(directories only, a few levels at most); the deep walk and the reads run in the
executors.  Stream: an offset is the (modification time, project, path) of the
newest file; each trigger lists the trees on the driver, folder by folder, and
keeps how many files of each folder lie behind the last offset.  The tasks list
these folders and read those files, so added and changed files arrive once each,
in any number of triggers, and no list of files is held or sent.
A file put in place with an older time than the last offset's is not seen.

A folder that can't be listed and a file that can't be read end the job, files
without permission are skipped; text is decoded as UTF-8 with undecodable bytes
dropped.  Persist the result as Parquet partitioned by ``project`` and run the
operators on that, or follow the stream with ``stream_reanalyze``.
"""
from __future__ import annotations

import datetime as _dt
import os
import posixpath
import zlib

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

import tokenloom.sources.files as _self

FILES_SCHEMA = "project string, path string, content string, size_bytes bigint, mtime timestamp"


def open_tree(uri: str):
    """(file system, path in it) of a local folder or a URI."""
    from pyarrow import fs
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), os.path.abspath(uri))


def listing(files, path: str, recursive: bool = False):
    """Entries below a folder, sorted by path; an error if it can't be listed."""
    from pyarrow import fs
    return sorted(files.get_file_info(fs.FileSelector(path, recursive=recursive)), key=lambda i: i.path)


def entries(files, folder: str, gone: bool = False):
    """Entries of one folder in any order; with ``gone`` none if it isn't there."""
    from pyarrow import fs
    return files.get_file_info(fs.FileSelector(folder, allow_not_found=gone))


def _offset(offset: dict) -> tuple:
    return offset["mtime"], offset["project"], offset["path"]


def _key(info, project: str, top: str) -> tuple:
    """(modification time, project, path): the order in which a stream reads files."""
    return info.mtime_ns, project, _below(info.path, top)


def _is_dir(info) -> bool:
    from pyarrow import fs
    return info.type == fs.FileType.Directory


def _is_file(info) -> bool:
    from pyarrow import fs
    return info.type == fs.FileType.File


def _below(path: str, top: str) -> str:
    return path[len(top) + 1:] if path.startswith(top + "/") else posixpath.relpath(path, top)


def _row(files, project: str, root: str, info):
    """The row of a file; none if nobody may read it."""
    try:
        with files.open_input_stream(info.path) as f:
            data = f.read()
    except PermissionError:
        return []  # any other error ends the job
    at = _dt.datetime.fromtimestamp(info.mtime_ns / 1e9, tz=_dt.timezone.utc)
    return [(project, _below(info.path, root), data.decode("utf-8", errors="ignore"), int(info.size), at)]


class ProjectFilesDataSource(DataSource):
    """Options: ``roots`` (comma-separated folders, one project each; the
    project name is the folder name) or ``projects_root`` (every sub-folder
    is a project), and ``shards_per_root`` (default 64)."""

    @classmethod
    def name(cls) -> str:
        return "project_files"

    def schema(self) -> str:
        return FILES_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ProjectFilesReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return ProjectFilesStream(self.options)


class _Roots:
    def __init__(self, options) -> None:
        self.roots = [r for r in str(options.get("roots", "")).split(",") if r]
        self.parent = options.get("projects_root")
        self.shards = int(options.get("shards_per_root", 64))

    def all_roots(self) -> list[str]:
        """The given roots and the sub-folders of the projects' root."""
        if not self.parent:
            return self.roots
        files, path = open_tree(self.parent)
        names = [posixpath.basename(i.path) for i in listing(files, path) if _is_dir(i)]
        return self.roots + [f"{self.parent.rstrip('/')}/{n}" for n in names]


class ProjectFilesReader(_Roots, DataSourceReader):
    def partitions(self):
        """Shards of (root, entries, recursive) triples.  A root whose top level
        holds few entries is expanded a few directory levels down on the
        driver (directories only), so one large folder does not become one
        task; files met while expanding form their own non-recursive shard."""
        parts = []
        for root in self.all_roots():
            units = self._units(root)
            n = min(self.shards, max(len(units), 1))
            parts += [InputPartition((root, tuple(units[i::n]))) for i in range(n) if units[i::n]]
        return parts

    def _units(self, root: str, max_depth: int = 3):
        """(relative entry, folder?, recursive?) units: expand directories
        breadth-first until there are at least ``shards`` units or ``max_depth``
        is reached."""
        files, top = open_tree(root)
        units = [(posixpath.relpath(i.path, top), _is_dir(i), True) for i in listing(files, top)]
        depth = 1
        while len(units) < self.shards and depth < max_depth and any(d and rec for _, d, rec in units):
            nxt = []
            for rel, folder, rec in units:
                if folder and rec:
                    kids = [i for i in listing(files, posixpath.join(top, rel)) if _is_dir(i)]
                    nxt.append((rel, True, False))  # the folder's own files
                    nxt.extend((posixpath.relpath(i.path, top), True, True) for i in kids)
                else:
                    nxt.append((rel, folder, rec))
            units, depth = nxt, depth + 1
        return units

    def read(self, partition):
        root, units = partition.value
        files, top = open_tree(root)
        project = posixpath.basename(top.rstrip("/"))
        for rel, folder, recursive in units:
            path = posixpath.join(top, rel)
            found = listing(files, path, recursive) if folder else [files.get_file_info(path)]
            for info in found:
                if _is_file(info):
                    yield from _row(files, project, top, info)


class ProjectFilesStream(_Roots, DataSourceStreamReader):
    def __init__(self, options) -> None:
        super().__init__(options)
        self.read_to, self.listed = None, None

    def _behind(self, after: tuple) -> tuple[tuple, list[tuple]]:
        """The newest file behind an offset (else the offset), and the number of
        such files in each folder that has any.  One folder's entries are held at
        a time, roots are walked side by side."""
        from concurrent.futures import ThreadPoolExecutor

        from pyarrow import fs

        def walk(root: str) -> tuple[tuple, list[tuple]]:
            files, top = open_tree(root)
            project, newest, counts, folders = posixpath.basename(top.rstrip("/")), after, [], [top]
            while folders:
                folder, n = folders.pop(), 0
                for info in entries(files, folder):
                    kind = info.type
                    if kind == fs.FileType.Directory:
                        folders.append(info.path)
                    elif kind == fs.FileType.File:
                        at = info.mtime_ns  # keys are made only where the time doesn't decide
                        if at >= newest[0]:
                            newest = max(newest, _key(info, project, top))
                        n += at > after[0] or at == after[0] and _key(info, project, top) > after
                if n:
                    counts.append((root, folder, n))
            return newest, counts

        newest, counts = after, []
        with ThreadPoolExecutor(8) as pool:
            for key, found in pool.map(walk, self.all_roots()):
                newest, counts = max(newest, key), counts + found
        return newest, counts

    def initialOffset(self) -> dict:
        return {"mtime": -1, "project": "", "path": ""}

    def latestOffset(self) -> dict:
        after = self.read_to or _offset(self.initialOffset())
        newest, counts = self._behind(after)
        self.listed = after, counts
        return dict(zip(("mtime", "project", "path"), newest))

    def partitions(self, start: dict, end: dict):
        """At most about twice ``shards`` lists of folders with the files to read
        in each; a folder of many new files goes to several tasks, which take
        shares of its names."""
        lo, hi = _offset(start), _offset(end)
        counts = self.listed[1] if self.listed and self.listed[0] == lo else self._behind(lo)[1]
        self.read_to = hi
        size = -(-sum(n for *_, n in counts) // self.shards)
        parts, room = [], 0
        for root, folder, n in counts:
            shares = -(-n // size)
            for share in range(shares):
                if room < n // shares or not parts:
                    parts.append([])
                    room = size
                parts[-1].append((root, folder, share, shares))
                room -= n // shares
        return [InputPartition((lo, hi, tuple(p))) for p in parts]

    def read(self, partition):
        lo, hi, units = partition.value
        for root, folder, share, shares in units:
            files, top = open_tree(root)
            project = posixpath.basename(top.rstrip("/"))
            for info in entries(files, folder, gone=True):  # what has gone since the listing has no row
                if not _is_file(info) or not lo[0] <= info.mtime_ns <= hi[0]:
                    continue
                key = _key(info, project, top)
                if lo < key <= hi and zlib.crc32(key[2].encode("utf-8", "surrogateescape")) % shares == share:
                    try:
                        yield from _row(files, project, top, info)
                    except FileNotFoundError:
                        continue

    def commit(self, end: dict) -> None:
        pass


cloudpickle.register_pickle_by_value(_self)


def _options(reader, roots, projects_root):
    roots = [roots] if isinstance(roots, str) else roots
    reader = reader.format("project_files").option("roots", ",".join(roots))
    return reader.option("projects_root", projects_root) if projects_root else reader


def scan_files(spark: SparkSession, roots=(), projects_root: str | None = None) -> DataFrame:
    """All files below each root (hidden and underscore names included);
    with ``projects_root`` every sub-folder of it is a project."""
    spark.dataSource.register(ProjectFilesDataSource)
    return _options(spark.read, roots, projects_root).load()


def stream_files(spark: SparkSession, roots=(), projects_root: str | None = None) -> DataFrame:
    """S1 as a stream: the files there are, then every added or changed one."""
    spark.dataSource.register(ProjectFilesDataSource)
    return _options(spark.readStream, roots, projects_root).load()
