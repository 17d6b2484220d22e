"""File systems of paths, as Python workers open them."""

from __future__ import annotations

import fnmatch
import tempfile
import uuid

import pyarrow.fs as pafs

#: Hadoop's names of object stores to those that Arrow knows.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs", "wasb": "abfs", "wasbs": "abfs"}


def open_path(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path on it. Plain paths are local; Hadoop's schemes are translated."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme or len(scheme) < 2:
        return pafs.LocalFileSystem(), path
    try:
        return pafs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}:{rest}")
    except (ValueError, NotImplementedError) as e:
        try:
            import fsspec
        except ImportError:
            raise ValueError(f"{path}: no file system here knows the scheme {scheme}") from e
        fs, at = fsspec.core.url_to_fs(path)
        return pafs.PyFileSystem(pafs.FSSpecHandler(fs)), at


def glob_paths(pattern: str) -> list[str]:
    """Files of a path, a folder or a pattern with wildcards on any file system, sorted; what matches nothing stays as it is.

    Hidden files (a leading . or _) of folders and wildcards are left out.
    """
    parts = pattern.rstrip("/").split("/")
    wild = next((k for k, part in enumerate(parts) if any(c in part for c in "*?[")), len(parts))
    base = "/".join(parts[:wild])
    fs, at = open_path(base or "/")
    prefix = base[: len(base) - len(at)] if base.endswith(at) else ""
    info = fs.get_file_info(at)
    if wild == len(parts) and info.type != pafs.FileType.Directory:
        return [pattern]
    deep = len(parts) - wild
    listed = fs.get_file_info(pafs.FileSelector(at, recursive=deep > 1, allow_not_found=True))
    below = [(f.path[len(at) :].lstrip("/").split("/"), f) for f in listed if f.type != pafs.FileType.Directory]
    if deep:
        below = [(names, f) for names, f in below if len(names) == deep and all(fnmatch.fnmatchcase(n, p) for n, p in zip(names, parts[wild:], strict=True))]
    return sorted(prefix + f.path for names, f in below if names[-1][0] not in "._") or [pattern]


def scratch(spark, tag: str) -> str:
    """A new path in the folder that the cluster names in spark.checkpoint.dir, deleted when the application ends; a local folder only where driver and executors are one machine."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: this needs a folder that every executor can see")
        top = "file://" + tempfile.mkdtemp(prefix="lodestrata-")
    path = f"{top.rstrip('/')}/lodestrata/{tag}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return path
