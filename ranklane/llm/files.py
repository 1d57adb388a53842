"""Binary files of tasks in the shared folder, by URI."""

from __future__ import annotations

from pyarrow import fs


def locate(uri: str) -> tuple[fs.FileSystem, str]:
    """(file system, path) of a URI or an absolute path; any scheme that
    pyarrow opens (file, hdfs, s3, gs, ...)."""
    return fs.FileSystem.from_uri(uri)


def open_write(uri: str):
    system, path = locate(uri)
    if system.type_name == "local":
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(path, compression=None)  # the caller compresses, whatever the name ends in


def open_read(uri: str):
    system, path = locate(uri)
    return system.open_input_file(path)
