"""Files by path from tasks: any store that has an Arrow file system, and mount points of Spark's own configuration.

A data source's reader and writer run in Python workers, which have no JVM.  What
a path means to Spark (a mount table, the default store) is taken from
the session when the source is registered and goes along with it.
"""

from __future__ import annotations

import posixpath
import re
from dataclasses import dataclass, field
from urllib.parse import urlsplit

from pyarrow import fs as arrow_fs
from pyspark.sql import SparkSession

#: Schemes of Spark's connectors and what Arrow calls the same store.
SAME_STORE = {"s3a": "s3", "s3n": "s3"}
_LINK = re.compile(r"^fs\.viewfs\.mounttable\.([^.]+)\.link\.(/.*)$")


@dataclass(frozen=True)
class Stores:
    """default: where paths without a scheme are; mounts: (prefix of a URI, what it stands for), the longest first."""

    default: str = "file:///"
    mounts: tuple[tuple[str, str], ...] = field(default=())

    def resolved(self, path: str) -> str:
        """A URI that Arrow can open."""
        if "://" not in path and not path.startswith("file:"):
            base = urlsplit(self.default)
            path = f"{base.scheme}://{base.netloc}{posixpath.abspath(path) if base.scheme == 'file' else path}"
        path = re.sub(r"^file:/(?!/)", "file:///", path)
        for _ in range(len(self.mounts) + 1):  # a mount may lead to another
            for prefix, target in self.mounts:
                if path == prefix or path.startswith(prefix.rstrip("/") + "/"):
                    path = target.rstrip("/") + path[len(prefix.rstrip("/")) :]
                    break
            else:
                break
        scheme, rest = path.split("://", 1)
        return f"{SAME_STORE.get(scheme, scheme)}://{rest}"

    def opened(self, path: str) -> tuple[arrow_fs.FileSystem, str]:
        """The file system of a path, and the path in it."""
        uri = self.resolved(path)
        if uri.startswith("file://"):
            return arrow_fs.LocalFileSystem(), uri[7:] or "/"
        try:
            return arrow_fs.FileSystem.from_uri(uri)
        except (ValueError, NotImplementedError, OSError) as error:
            raise ValueError(f"no Arrow file system opens {uri}: {error}") from error

    def files(self, path: str) -> list[tuple[str, int]]:
        """(path, bytes) of a file, or of the files in a folder in the order of their names; hidden ones (`_…`, `.…`) are left out."""
        store, where = self.opened(path)
        info = store.get_file_info(where)
        if info.type == arrow_fs.FileType.NotFound:
            raise FileNotFoundError(path)
        if info.type == arrow_fs.FileType.File:
            return [(where, info.size)]
        found = store.get_file_info(arrow_fs.FileSelector(where, recursive=False))
        return sorted((f.path, f.size) for f in found if f.type == arrow_fs.FileType.File and not f.base_name.startswith(("_", ".")))


def of_session(spark: SparkSession) -> Stores:
    """What this session's configuration says about paths."""
    mounts = []
    entries = spark._jsc.hadoopConfiguration().iterator()
    while entries.hasNext():
        entry = entries.next()
        link = _LINK.match(entry.getKey())
        if link:
            mounts.append((f"viewfs://{link[1]}{link[2]}", entry.getValue()))
    default = spark._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
    return Stores(default, tuple(sorted(mounts, key=lambda m: (-len(m[0]), m[0]))))
