"""Files of tasks in the shared folder, opened by URI."""

from __future__ import annotations

#: Names that Hadoop's clients have for stores that Arrow knows by others.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs", "wasbs": "abfs"}


def open_fs(uri: str):
    """(file system, path) of a URI, on the driver or in a task."""
    from pyarrow import fs

    if "://" not in uri:
        return fs.LocalFileSystem(), uri.removeprefix("file:")
    scheme, rest = uri.split("://", 1)
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest}")
