"""Files that are created once: the markers by which jobs commit without stepping on each other."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _place(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _write(spark: SparkSession, path: str, text: str) -> None:
    where, files = _place(spark, path)
    stream = files.create(where, False)
    stream.write(bytearray(text.encode()))
    stream.close()


def claim(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with this text, whole and at once; False if it is there already. Of any number of
    sessions that claim one path exactly one succeeds: the text is written beside it and then given the
    name by a step that never overwrites, a hard link on a local file system and a rename elsewhere. The
    file system must refuse to rename onto a file that exists, as HDFS does."""
    where, files = _place(spark, path)
    files.mkdirs(where.getParent())
    draft = f"{where.getParent().toString()}/.draft-{uuid.uuid4().hex}"
    _write(spark, draft, text)
    source, _ = _place(spark, draft)
    try:
        if files.getUri().getScheme() == "file":
            nio = spark.sparkContext._jvm.java.nio.file
            none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.java.lang.String, 0)
            try:
                nio.Files.createLink(nio.Paths.get(where.toUri().getPath(), none), nio.Paths.get(source.toUri().getPath(), none))
            except Exception as e:
                if "FileAlreadyExistsException" not in str(e):
                    raise
                return False
            return True
        return not files.exists(where) and files.rename(source, where)
    finally:
        if files.exists(source):
            files.delete(source, False)


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a file, None if there is no such file."""
    where, files = _place(spark, path)
    if not files.exists(where):
        return None
    stream = files.open(where)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """The visible files of a folder, by name; none if there is no folder."""
    where, files = _place(spark, folder)
    if not files.exists(where):
        return []
    return sorted(n for n in (s.getPath().getName() for s in files.listStatus(where)) if n[0] not in "._")
