"""Files of any file system that Arrow reaches (local, HDFS, S3), read and written on executors or the driver."""

from __future__ import annotations

import re
import uuid

from pyarrow import fs as arrow_fs


def place(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    """File system and path of an address or a plain local path; s3a and s3n are s3."""
    if not re.match(r"[a-z][a-z0-9+.\-]*:/", uri):
        return arrow_fs.LocalFileSystem(), uri
    uri = re.sub(r"\As3[an]://", "s3://", uri)
    return arrow_fs.FileSystem.from_uri(re.sub(r"\Afile:/+", "file:///", uri))


def read(uri: str, offset: int = 0, length: int | None = None) -> bytes | None:
    """A file's bytes, or `length` of them from `offset`; None when it can't be read."""
    try:
        fs, path = place(uri)
        with fs.open_input_file(path) as f:
            return f.read_at(f.size() - offset if length is None else length, offset)
    except OSError:
        return None


def write(uri: str, content: bytes) -> None:
    """Write a file whole: to a part beside it, then moved into place. A task that is run again writes the same file again."""
    fs, path = place(uri)
    fs.create_dir(path.rpartition("/")[0] or "/", recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part) as f:
        f.write(content)
    try:
        fs.move(part, path)
    except OSError:  # HDFS moves onto no existing file
        if fs.get_file_info(path).type == arrow_fs.FileType.NotFound:
            raise
        fs.delete_file(path)
        fs.move(part, path)


def modified(uri: str) -> float | None:
    """When a file was last written, in seconds; None for none."""
    fs, path = place(uri)
    info = fs.get_file_info(path)
    return info.mtime.timestamp() if info.type == arrow_fs.FileType.File and info.mtime else None


def exists(uri: str) -> bool:
    fs, path = place(uri)
    return fs.get_file_info(path).type != arrow_fs.FileType.NotFound


def delete(uri: str) -> None:
    fs, path = place(uri)
    kind = fs.get_file_info(path).type
    if kind == arrow_fs.FileType.Directory:
        fs.delete_dir(path)
    elif kind != arrow_fs.FileType.NotFound:
        fs.delete_file(path)


def names(uri: str) -> list[str]:
    """Names of the files and folders in a folder, sorted; none for a missing one."""
    fs, path = place(uri)
    return sorted(i.base_name for i in fs.get_file_info(arrow_fs.FileSelector(path, allow_not_found=True)))
