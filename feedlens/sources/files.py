"""Small files in a shared folder, for Python that runs inside Spark's tasks: any store that pyarrow reaches."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager


class Folder:
    """A folder by path or URI; names are relative to it."""

    def __init__(self, path: str):
        from pyarrow import fs

        if "://" in path or path.startswith("file:"):
            self.fs, self.path = fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
        else:
            self.fs, self.path = fs.LocalFileSystem(), path
        self.path = self.path.rstrip("/")

    def at(self, name: str) -> str:
        return f"{self.path}/{name}" if name else self.path

    def exists(self, name: str = "") -> bool:
        return self.fs.get_file_info(self.at(name)).type.name != "NotFound"

    def names(self, name: str = "") -> list[str]:
        from pyarrow import fs

        return [x.base_name for x in self.fs.get_file_info(fs.FileSelector(self.at(name), allow_not_found=True))]

    def open(self, name: str):
        return self.fs.open_input_file(self.at(name))

    @contextmanager
    def create(self, name: str) -> Iterator:
        """A new file that has its name once it is whole; of one that is broken off nothing stays."""
        folder, _, base = name.rpartition("/")
        self.fs.create_dir(self.at(folder), recursive=True)
        hidden = f"{folder}/.{base}-{uuid.uuid4().hex}".lstrip("/")
        try:
            with self.fs.open_output_stream(self.at(hidden)) as out:
                yield out
            self.move(hidden, name)
        except BaseException:
            self.remove(hidden)
            raise

    def move(self, old: str, new: str) -> None:
        self.fs.move(self.at(old), self.at(new))

    def remove(self, name: str) -> None:
        """Delete a file or a folder; one that is not there is no error."""
        kind = self.fs.get_file_info(self.at(name)).type.name
        if kind == "Directory":
            self.fs.delete_dir(self.at(name))
        elif kind == "File":
            self.fs.delete_file(self.at(name))

    def read_json(self, name: str) -> dict | None:
        try:
            with self.fs.open_input_file(self.at(name)) as file:
                return json.loads(file.read())
        except FileNotFoundError:
            return None

    def put_json(self, name: str, value: dict) -> None:
        with self.create(name) as out:
            out.write(json.dumps(value).encode())

    def claim(self, name: str, value: dict) -> bool:
        """Write a file unless it is there; whether this call wrote it. Only a local store decides between two at once."""
        from pyarrow import fs

        if isinstance(self.fs, fs.LocalFileSystem):
            import os

            hidden = f"{name}-{uuid.uuid4().hex}.tmp"
            self.put_json(hidden, value)
            try:
                os.link(self.at(hidden), self.at(name))
                return True
            except FileExistsError:
                return False
            finally:
                self.remove(hidden)
        if self.exists(name):
            return False
        self.put_json(name, value)
        return True
