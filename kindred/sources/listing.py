"""Files of folders, with their content or as walk events."""

import os

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def read_files(spark: SparkSession, *roots: str, recursive: bool = True, extensions: tuple[str, ...] = ()) -> DataFrame:
    """A1, A3: (path, size, mtime_ns, content) of all files below the roots, by Spark's own reader, so in any store.

    Content is only read where a query uses it.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if extensions:
        reader = reader.option("pathGlobFilter", "*.{" + ",".join(extensions) + "}")
    df = reader.load(list(roots))
    return df.select(F.regexp_replace("path", r"^file:/+", "/").alias("path"), F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), "content")


class _Part(InputPartition):
    def __init__(self, root: str, folder: str, deep: bool):
        self.root, self.folder, self.deep = root, folder, deep


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.roots = [r for r in options.get("roots", "").split(os.pathsep) if r]
        self.prune = set(filter(None, options.get("prune", "").split(",")))

    def partitions(self):
        """One for each root's own files and one for each folder directly below it."""
        out = []
        for root in self.roots:
            out.append(_Part(root, root, False))
            try:
                out += [_Part(root, e.path, True) for e in os.scandir(root) if e.is_dir(follow_symlinks=False)]
            except OSError:
                pass  # the root's own partition reports it
        return out

    def read(self, part):
        todo = [part.folder]
        while todo:
            folder = todo.pop()
            if os.path.basename(folder) in self.prune and folder != part.root:
                yield part.root, folder, "pruned", None, None
                continue
            try:
                entries = sorted(os.scandir(folder), key=lambda e: e.name)
            except OSError:
                yield part.root, folder, "error", None, None
                continue
            for e in entries:
                if e.is_symlink():
                    yield part.root, e.path, "skipped_symlink", None, None
                elif e.is_dir(follow_symlinks=False):
                    if part.deep:
                        todo.append(e.path)
                elif e.is_file(follow_symlinks=False):
                    try:
                        s = e.stat(follow_symlinks=False)
                        yield part.root, e.path, "file", s.st_size, s.st_mtime_ns
                    except OSError:
                        yield part.root, e.path, "error", None, None
                else:
                    yield part.root, e.path, "skipped_special", None, None


class WalkEvents(DataSource):
    """A1: events of a walk that follows no links, for folders that every executor mounts; partitioned by folders below the roots."""

    @classmethod
    def name(cls):
        return "walk_events"

    def schema(self):
        return "root string, path string, kind string, size long, mtime_ns long"

    def reader(self, schema):
        return _Reader(self.options)


def walk(spark: SparkSession, *roots: str, prune: tuple[str, ...] = ()) -> DataFrame:
    """A1, A7."""
    spark.dataSource.register(WalkEvents)
    return spark.read.format("walk_events").option("roots", os.pathsep.join(roots)).option("prune", ",".join(prune)).load()
