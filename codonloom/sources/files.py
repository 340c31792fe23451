"""Files of any Hadoop file system through the session: existence, listing, heads and renames."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def _shown(status, like: str) -> str:
    """The status' path as text, without a scheme where ``like`` has none."""
    p = status.getPath()
    return p.toString() if "://" in like or like.startswith("file:") else p.toUri().getPath()


def listed(spark: SparkSession, folder: str, suffix: str) -> list[str]:
    """All files under a folder whose name ends in ``suffix``."""
    fs, p = _at(spark, folder)
    found, files = [], fs.listFiles(p, True)
    while files.hasNext():
        status = files.next()
        if status.getPath().getName().endswith(suffix):
            found.append(_shown(status, folder))
    return found


def matching(spark: SparkSession, pattern: str) -> list[str]:
    fs, p = _at(spark, pattern)
    return [_shown(s, pattern) for s in (fs.globStatus(p) or [])]


def first_character(spark: SparkSession, path: str) -> str:
    """The first character that is no white space, of a file or of a folder's first file that has one."""
    fs, p = _at(spark, path)
    files = sorted(listed(spark, path, "")) if fs.getFileStatus(p).isDirectory() else [path]
    for name in files:
        if name.rsplit("/", 1)[-1].startswith(("_", ".")):
            continue
        stream = _at(spark, name)[0].open(_at(spark, name)[1])
        try:
            while (b := stream.read()) >= 0:
                if not chr(b).isspace() and b not in (0xEF, 0xBB, 0xBF):
                    return chr(b)
        finally:
            stream.close()
    return ""


def move(spark: SparkSession, old: str, new: str) -> None:
    fs, p = _at(spark, old)
    if not fs.rename(p, _at(spark, new)[1]):
        raise OSError(f"could not rename {old} to {new}")


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)
