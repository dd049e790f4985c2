"""Binary files in the shared folder, written by tasks.

Names depend on the partition and a running number only, and a file appears under its name by
a rename, so a task that runs again or twice leaves the same files.
"""

from __future__ import annotations

import uuid

import pyarrow.fs as pafs


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI: file, hdfs, s3, gs and whatever else pyarrow opens."""
    return pafs.FileSystem.from_uri(uri)


def put(folder: str, name: str, parts: list[bytes]) -> str:
    fs, base = filesystem(folder)
    fs.create_dir(base, recursive=True)
    draft = f"{base}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(draft, compression=None) as out:
        for part in parts:
            out.write(part)
    fs.move(draft, f"{base}/{name}")
    return f"{folder}/{name}"


class Source:
    """Reads at any offset of a file; holds one block of it."""

    def __init__(self, uri: str, block: int = 1 << 20):
        fs, path = filesystem(uri)
        self._file = fs.open_input_file(path)
        self.size = self._file.size()
        self._block, self._at, self._held = block, 0, b""

    def read(self, offset: int, n: int) -> bytes:
        n = max(0, min(n, self.size - offset))
        if not (self._at <= offset and offset + n <= self._at + len(self._held)):
            self._held, self._at = self._file.read_at(min(max(n, self._block), self.size - offset), offset), offset
        return self._held[offset - self._at : offset - self._at + n]

    def find(self, needle: bytes, offset: int) -> int:
        """Offset of the next ``needle`` at or after ``offset``, or -1."""
        while offset < self.size:
            part = self.read(offset, self._block)
            at = part.find(needle)
            if at >= 0:
                return offset + at
            if offset + len(part) >= self.size:
                return -1
            offset += max(1, len(part) - len(needle) + 1)
        return -1

    def close(self) -> None:
        self._file.close()
