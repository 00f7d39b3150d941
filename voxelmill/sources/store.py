"""Files by their URI from inside of tasks: ranges of them, and files that are whole or not there."""

from __future__ import annotations

import contextlib
import posixpath
import re
import uuid
from collections.abc import Iterator

from pyarrow import fs


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI or a plain path. Spark writes local ones with one slash."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))


class Ranges:
    """Reads byte ranges of a file."""

    def __init__(self, path: str) -> None:
        system, name = place(path)
        self.file = system.open_input_file(name)
        self.size = self.file.size()

    def __call__(self, at: int, n: int) -> bytes:
        return self.file.read_at(n, at)

    def __enter__(self) -> Ranges:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()


def read_whole(path: str) -> bytes | None:
    """The file's bytes, or null if there is none."""
    system, name = place(path)
    try:
        with system.open_input_stream(name) as f:
            return f.read()
    except FileNotFoundError:
        return None


@contextlib.contextmanager
def replacing(path: str) -> Iterator:
    """A stream whose file takes its name when all is written, so a task that fails or runs twice leaves whole files only."""
    system, name = place(path)
    system.create_dir(posixpath.dirname(name), recursive=True)
    draft = f"{name}.{uuid.uuid4()}.part"
    with system.open_output_stream(draft) as out:
        yield out
    system.move(draft, name)


def names_in(path: str) -> list[str]:
    """What a folder holds, not what its folders hold."""
    system, name = place(path)
    return sorted(i.base_name for i in system.get_file_info(fs.FileSelector(name)))


def there(path: str) -> bool:
    system, name = place(path)
    return system.get_file_info(name).type != fs.FileType.NotFound


def settle(path: str) -> None:
    """Ends the swap of a folder that was cut short: the old one goes if the new one has its place, else it comes back."""
    system, name = place(path)
    if not there(f"{path}.old"):
        return
    if there(path):
        system.delete_dir(f"{name}.old")
    else:
        system.move(f"{name}.old", name)


def swap(draft: str, path: str) -> None:
    """Gives a whole folder its name; what had it is put aside first and goes last, so at every moment one of the two is whole.

    Done twice it changes nothing more. For file systems whose folders can be moved.
    """
    (system, name), (_, new) = place(path), place(draft)
    if there(draft):
        if there(path):
            settle(path)
            system.move(name, f"{name}.old")
        system.move(new, name)
    settle(path)
