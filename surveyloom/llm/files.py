"""Files in the shared folder, written and read by tasks.

A task writes under a name of its own attempt and renames when it is done, so a task
that runs again, or twice at once, leaves one whole file.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyarrow import fs


def open_system(uri: str) -> tuple[fs.FileSystem, str]:
    """Any file system Arrow knows: file, hdfs, s3, gs."""
    return fs.FileSystem.from_uri(uri)


@contextmanager
def whole_file(uri: str, attempt: int):
    """An output stream whose file appears under ``uri`` only when all went well."""
    system, path = open_system(uri)
    own = f"{path}.attempt-{attempt}"
    with system.open_output_stream(own) as out:
        yield out
    if system.type_name != "local" and system.get_file_info(path).type != fs.FileType.NotFound:
        system.delete_file(path)
    system.move(own, path)
