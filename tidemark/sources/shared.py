"""Whole small files in folders that the driver and all executors share: read, written once, or created by one of many."""

from __future__ import annotations

import errno
import os
import re
import uuid

import pyarrow.fs as fs


def at(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI (a bare path is local) and the path in it; as Hadoop names them, ``file:/x`` too."""
    full = uri if re.match(r"[A-Za-z][A-Za-z0-9+.-]+:", uri) else f"file:{os.path.abspath(uri)}"
    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", full))


def size(uri: str) -> int | None:
    """Bytes of a file; None where there is none."""
    system, path = at(uri)
    info = system.get_file_info(path)
    return info.size if info.type == fs.FileType.File else None


def read(uri: str) -> bytes:
    system, path = at(uri)
    with system.open_input_stream(path) as f:
        return f.read()


def _beside(system: fs.FileSystem, path: str, data: bytes) -> str:
    """Write a file of a name of its own in the folder of ``path``; nothing that is read ever has such a name."""
    folder, name = path.rsplit("/", 1)
    system.create_dir(folder, recursive=True)
    temporary = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(temporary) as f:
        f.write(data)
    return temporary


def put(uri: str, data: bytes) -> bool:
    """Write a file whose name follows from its content: True if it was not there. One that is there must be equal.

    The file appears whole, by a rename. Two tasks that write the same content may both say that they created it.
    """
    if size(uri) is not None:
        if read(uri) != data:
            raise ValueError(f"{uri} is there already and is not what it should be")
        return False
    system, path = at(uri)
    system.move(_beside(system, path, data), path)
    return True


def create(uri: str, data: bytes, spark=None) -> bool:
    """Create a file that none has created: True for exactly one of any number of concurrent callers. It appears whole.

    On a local file system by a hard link, which fails where the name is taken. Elsewhere, by the rename of the Hadoop
    file system, which does not replace files (as on HDFS); object stores need one with conditional writes.
    """
    system, path = at(uri)
    temporary = _beside(system, path, data)
    try:
        if isinstance(system, fs.LocalFileSystem):
            try:
                os.link(temporary, path)
            except OSError as e:
                if e.errno != errno.EEXIST:
                    raise
                return False
            return True
        jvm = spark._jvm.org.apache.hadoop.fs
        source, target = jvm.Path(f"{uri.rsplit('/', 1)[0]}/{temporary.rsplit('/', 1)[1]}"), jvm.Path(uri)
        hadoop = target.getFileSystem(spark._jsc.hadoopConfiguration())
        return not hadoop.exists(target) and hadoop.rename(source, target)
    finally:
        if system.get_file_info(temporary).type != fs.FileType.NotFound:
            system.delete_file(temporary)


def replace(uri: str, data: bytes) -> None:
    """Put a new content in the place of a file's old one, if there was any: readers see the one or the other, never a part."""
    system, path = at(uri)
    temporary = _beside(system, path, data)
    if isinstance(system, fs.LocalFileSystem):
        with open(temporary, "rb") as f:
            os.fsync(f.fileno())
    system.move(temporary, path)


def names(uri: str) -> list[str]:
    """Names in a folder, without those of files that are being written; none where there is no folder."""
    system, path = at(uri)
    found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted(x.base_name for x in found if not x.base_name.startswith("."))
