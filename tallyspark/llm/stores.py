"""Files on any store that pyarrow can open: local folders, HDFS, S3, GCS. Used by tasks that write or read own formats."""

from __future__ import annotations

from pyarrow import fs


def at(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI; a path without a scheme is local."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def write_file(path: str, data: bytes) -> None:
    """Whole files only: under another name first, then renamed."""
    store, name = at(path)
    folder, _, last = name.rpartition("/")
    store.create_dir(folder, recursive=True)
    with store.open_output_stream(f"{folder}/.{last}.part", compression=None) as f:
        f.write(data)
    store.move(f"{folder}/.{last}.part", name)


def read_file(path: str) -> bytes:
    store, name = at(path)
    with store.open_input_stream(name, compression=None) as f:
        return f.read()


def files_in(path: str, suffixes: tuple[str, ...]) -> list[str]:
    """Files below a folder, or the file itself, with their scheme."""
    store, name = at(path)
    scheme = path[: path.index("://") + 3] if "://" in path and not path.startswith("file:") else ""
    info = store.get_file_info(name)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(name, recursive=True))
    return sorted(scheme + f.path for f in found if f.type == fs.FileType.File and f.path.endswith(suffixes) and not f.base_name.startswith((".", "_")))
