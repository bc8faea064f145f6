"""One committed file from a frame in order.

Every task writes its partition as a part file, in parallel and in the frame's
order; the parts are then appended to each other in that order by the store's
own client, as a stream, and the whole is renamed to the name asked for in one
step. Until then nothing is visible under that name, and a job that fails
leaves an earlier file as it was.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import SparkSession

from ..session import remove_folder

MODES = ("overwrite", "error", "errorifexists", "ignore")
BUFFER = 1 << 20


def _part_number(name: str) -> int:
    found = re.match(r"part-(\d+)", name)
    return int(found[1]) if found else -1


class Store:
    """The Hadoop client of a path's store, through the driver's JVM."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.gateway = spark._jvm, spark.sparkContext._gateway
        self.conf = spark._jsc.hadoopConfiguration()
        self.files = self.path(path).getFileSystem(self.conf)

    def path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def parts(self, folder: str) -> list[str]:
        """Part files that hold bytes, in the order of their tasks."""
        held = [s for s in self.files.listStatus(self.path(folder)) if s.isFile() and s.getLen()]
        named = [(s.getPath().getName(), s.getPath().toString()) for s in held]
        return [p for n, p in sorted(named, key=lambda x: (_part_number(x[0]), x[0])) if n.startswith("part-")]

    def append_all(self, target: str, pieces: Sequence[bytes | str], skip: int) -> None:
        """Bytes and files one after the other; the first file without its first ``skip`` bytes."""
        out = self.files.create(self.path(target), False)
        try:
            for piece in pieces:
                if isinstance(piece, bytes):
                    out.write(piece)
                    continue
                source = self.files.open(self.path(piece))
                try:
                    source.seek(skip)
                    skip = 0
                    self.jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, BUFFER, False)
                finally:
                    source.close()
        finally:
            out.close()

    def rename(self, source: str, target: str) -> None:
        """In one step, over an earlier file."""
        rename = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        uri = self.path(target).toUri()
        context = self.jvm.org.apache.hadoop.fs.FileContext
        (context.getFileContext(uri, self.conf) if uri.getScheme() else context.getFileContext(self.conf)).rename(
            self.path(source), self.path(target), options)


def commit_file(spark: SparkSession, path: str, writers: Sequence[Callable[[str], None]], head: bytes = b"", tail: bytes = b"",
                skip: int = 0, mode: str = "overwrite") -> None:
    """One file at ``path``: ``head``, what each writer puts into a folder, in turn, and ``tail``.

    A writer gets a folder's path and writes part files there. ``skip`` bytes
    are left out at the start of the first part (a separator that nothing
    stands before).
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}: one file cannot be appended to")
    store = Store(spark, path)
    target = store.path(path)
    if store.files.exists(target):
        if mode == "ignore":
            return
        if mode != "overwrite":
            raise FileExistsError(path)
    work = f"{target.getParent().toString()}/.{target.getName()}-{uuid.uuid4().hex}"
    try:
        pieces: list[bytes | str] = [head] if head else []
        for k, writer in enumerate(writers):
            writer(f"{work}/{k}")
            pieces += store.parts(f"{work}/{k}")
        store.append_all(f"{work}/whole", [*pieces, tail] if tail else pieces, skip)
        if store.files.exists(target) and store.files.getFileStatus(target).isDirectory():
            store.files.delete(target, True)  # a folder of parts of an earlier run
        store.rename(f"{work}/whole", path)
    finally:
        remove_folder(spark, work)
