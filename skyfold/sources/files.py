"""Files of a store by path: what Spark's own readers do not do (partitions a file, renames at a commit)."""

from __future__ import annotations

import re


def store(path: str):
    """(file system, path in it) of a local path or a URI that pyarrow knows."""
    from pyarrow import fs

    local = re.sub(r"^file:/*", "/", path)
    if "://" in local:
        return fs.FileSystem.from_uri(local)
    return fs.LocalFileSystem(), local


def listed(path: str, suffix: str = "") -> list[str]:
    """Files below a folder in the order of their names; hidden ones and those of other suffixes left out."""
    from pyarrow import fs

    system, root = store(path)
    found = system.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True))
    return sorted(f.path for f in found if f.type == fs.FileType.File and f.path.endswith(suffix) and not f.base_name.startswith((".", "_")))


def read_bytes(path: str, name: str) -> bytes:
    with store(path)[0].open_input_stream(name) as f:
        return f.read()


def put(path: str, name: str, data: bytes) -> None:
    """The whole file or none of it: written beside its place, then moved there; one that is there is replaced."""
    import uuid

    system, _ = store(path)
    beside = f"{name.rpartition('/')[0]}/.{uuid.uuid4().hex}"
    system.create_dir(name.rpartition("/")[0], recursive=True)
    with system.open_output_stream(beside) as f:
        f.write(data)
    system.move(beside, name)
