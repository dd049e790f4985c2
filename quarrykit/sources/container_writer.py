"""Writes small containers that the reader understands: for round trips and tests."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# The structs that an inspection reads, as type and field name.
STRUCTS = {
    "ID": "char name[66]; char _pad[6]",
    "ListBase": "void *first; void *last",
    "TextLine": "TextLine *next; TextLine *prev; char *line; char *format; int len; int _pad0",
    "Text": "ID id; char *filepath; int flags; int _pad0; ListBase lines",
    "Library": "ID id; char filepath[1024]",
    "ChannelDriver": "char expression[256]; int type; int flag",
    "NodeShaderScript": "int mode; int flag; char filepath[1024]; char bytecode_hash[64]; char *bytecode",
    "FCurve": "ChannelDriver *driver; char *rna_path; int array_index; int _pad0",
}
_BASIC = {"char": 1, "int": 4, "void": 0}


def _pad4(raw: bytes) -> bytes:
    return raw + b"\0" * (-len(raw) % 4)


class Writer:
    """Collects blocks; little-endian, 8-byte pointers."""

    def __init__(self) -> None:
        fields = {s: [tuple(f.split()) for f in text.split("; ")] for s, text in STRUCTS.items()}
        types = [*_BASIC, *STRUCTS]
        names = list(dict.fromkeys(n for fs in fields.values() for _, n in fs))
        self.sizes = dict(_BASIC)
        for s, fs in fields.items():
            self.sizes[s] = sum(8 if n.startswith("*") else self.sizes[k] * int(n.partition("[")[2].rstrip("]") or 1) for k, n in fs)
        text = lambda xs: b"".join(x.encode() + b"\0" for x in xs)
        dna = _pad4(b"SDNANAME" + struct.pack("<I", len(names)) + text(names))
        dna = _pad4(dna + b"TYPE" + struct.pack("<I", len(types)) + text(types))
        dna = _pad4(dna + b"TLEN" + struct.pack(f"<{len(types)}H", *(self.sizes[x] for x in types)))
        dna += b"STRC" + struct.pack("<I", len(fields))
        for s, fs in fields.items():
            dna += struct.pack("<HH", types.index(s), len(fs)) + b"".join(struct.pack("<HH", types.index(k), names.index(n)) for k, n in fs)
        self._index = {s: i for i, s in enumerate(STRUCTS)}
        self._blocks: list[tuple[bytes, int, int, bytes]] = [(b"DNA1", 0, 0, dna)]
        self._address = 0x1000

    def _add(self, code: bytes, kind: str, data: bytes, address: int | None = None) -> int:
        address = address or self._new()
        self._blocks.append((code, self._index[kind], address, data))
        return address

    def _new(self) -> int:
        self._address += 0x100
        return self._address

    def raw(self, data: bytes) -> int:
        return self._add(b"DATA", "ID", data)

    def _id(self, code: bytes, name: str) -> bytes:
        return (code + name.encode())[:65].ljust(72, b"\0")

    def text(self, name: str, body: str, flags: int = 0, filepath: str = "", ring: bool = False) -> None:
        lines = body.split("\n")
        at = [self._new() for _ in lines]
        for i, line in enumerate(lines):
            data = line.encode()
            follows = at[i + 1] if i + 1 < len(at) else at[0] if ring else 0
            self._add(b"DATA", "TextLine", struct.pack("<QQQQii", follows, at[i - 1] if i else 0, self.raw(data + b"\0"), 0, len(data), 0), at[i])
        path = self.raw(filepath.encode() + b"\0") if filepath else 0
        self._add(b"TX", "Text", self._id(b"TX", name) + struct.pack("<QiiQQ", path, flags, 0, at[0], at[-1]))

    def library(self, path: str) -> None:
        self._add(b"LI", "Library", self._id(b"LI", path) + path.encode().ljust(1024, b"\0"))

    def linked(self, code: str, name: str, path: str) -> None:
        """A file of another kind: an image, a sound, a font."""
        raw = code.encode()
        self._add(raw, "Library", self._id(raw, name) + path.encode().ljust(1024, b"\0"))

    def driver(self, expression: str, kind: int = 1, flag: int = 0, owner: str = "", index: int = 0) -> None:
        at = self._add(b"DATA", "ChannelDriver", expression.encode()[:255].ljust(256, b"\0") + struct.pack("<ii", kind, flag))
        if owner:
            self._add(b"DATA", "FCurve", struct.pack("<QQii", at, self.raw(owner.encode() + b"\0"), index, 0))

    def node(self, mode: int, path: str = "", digest: str = "", bytecode: bytes | None = None) -> None:
        at = 0 if bytecode is None else self.raw(bytecode)
        self._add(b"DATA", "NodeShaderScript", struct.pack("<ii", mode, 0) + path.encode().ljust(1024, b"\0") + digest.encode().ljust(64, b"\0") + struct.pack("<Q", at))

    def to_bytes(self, version: str = "404", large: bool = False) -> bytes:
        out = [b"BLENDER17-01v" + version.rjust(4, "0").encode() if large else b"BLENDER-v" + version.encode()]
        for code, kind, address, data in [*self._blocks, (b"ENDB", 0, 0, b"")]:
            code = code.ljust(4, b"\0")
            out += [struct.pack("<4siQqq", code, kind, address, len(data), 1) if large else struct.pack("<4siQii", code, len(data), address, kind, 1), data]
        return b"".join(out)


def write_files(contents: DataFrame, folder: str) -> int:
    """Write (name, content) rows as files of a folder, by the tasks that hold them; their number.

    A file appears under its name by a rename, so a task that runs twice leaves the same files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quarrykit.sources.datasource import place

        fs, base = place(folder)
        fs.create_dir(base, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                draft = f"{base}/.{name}.{uuid.uuid4().hex}"
                with fs.open_output_stream(draft, compression=None) as out:
                    out.write(content.as_buffer())
                fs.move(draft, f"{base}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return contents.select("name", "content").mapInArrow(run, "n bigint").agg({"n": "sum"}).first()[0] or 0
