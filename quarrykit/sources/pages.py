"""Files read in pages: any place of a file, packed or not, within a bounded memory.

``Pages`` are sliced like bytes and hold HELD pages at most. A packed file is unpacked once from end
to end, which tells its size and leaves marks on the way (states of the gzip decoder every STRIDE
bytes, beginnings of zstd frames); after that a page is unpacked from the last mark before it, so no
unpacked copy is kept in memory or on a disk.
"""

from __future__ import annotations

import bisect
import time
import zlib
from collections import OrderedDict

PAGE = 1 << 20
HELD = 64
STRIDE = 8 << 20
FEED = 1 << 16  # packed bytes handed to a decoder at once


class Pages:
    """A file's bytes by place; ``load(k)`` gives page k."""

    def __init__(self, size: int):
        self.size = size
        self._held: OrderedDict[int, bytes] = OrderedDict()

    def load(self, k: int) -> bytes:
        raise NotImplementedError

    def __len__(self) -> int:
        return self.size

    def __eq__(self, other: object) -> bool:
        return isinstance(other, (Pages, bytes)) and len(self) == len(other) and all(self[at : at + PAGE] == other[at : at + PAGE] for at in range(0, self.size, PAGE))

    __hash__ = None

    def page(self, k: int) -> bytes:
        held = self._held.get(k)
        if held is None:
            held = self.load(k)
            self.keep(k, held)
        else:
            self._held.move_to_end(k)
        return held

    def keep(self, k: int, data: bytes) -> None:
        self._held[k] = data
        while len(self._held) > HELD:
            self._held.popitem(last=False)

    def __getitem__(self, part: slice) -> bytes:
        start, stop, _ = part.indices(self.size)
        if stop <= start:
            return b""
        first, last = start // PAGE, (stop - 1) // PAGE
        if first == last:
            return self.page(first)[start - first * PAGE : stop - first * PAGE]
        pages = [self.page(k) for k in range(first, last + 1)]
        pages[0], pages[-1] = pages[0][start - first * PAGE :], pages[-1][: stop - last * PAGE]
        return b"".join(pages)


class FilePages(Pages):
    """Of an open pyarrow file."""

    def __init__(self, file):
        super().__init__(file.size())
        self._file = file

    def load(self, k: int) -> bytes:
        return self._file.read_at(min(PAGE, self.size - k * PAGE), k * PAGE)


class Gunzip:
    """All members of a gzip stream one behind the other; zeros behind a member are padding."""

    def __init__(self, raw, mark=None):
        self.raw = raw
        self.at, stream = mark or (0, None)
        self.stream = stream and stream.copy()

    def mark(self) -> tuple:
        return self.at, self.stream and self.stream.copy()

    def read(self, most: int) -> bytes:
        while True:
            if self.stream is None:
                while self.at and self.at < len(self.raw) and not self.raw[self.at : self.at + FEED].strip(b"\0"):
                    self.at += FEED
                while self.at and self.raw[self.at : self.at + 1] == b"\0":
                    self.at += 1
                if self.at >= len(self.raw):
                    return b""
                self.stream = zlib.decompressobj(31)
            feed = self.raw[self.at : self.at + FEED]
            part = self.stream.decompress(feed, most)
            ended = self.stream.eof
            self.at += len(feed) - len(self.stream.unused_data if ended else self.stream.unconsumed_tail)
            if ended:
                self.stream = None
            if part:
                return part
            if not feed and not ended:
                raise ValueError("the stream is cut short")


class _Part:
    """A stretch of a file, read from its begin to its end."""

    def __init__(self, raw, at: int, end: int):
        self.raw, self.at, self.end = raw, at, end

    def read(self, most: int = -1) -> bytes:
        part = self.raw[self.at : self.end if most < 0 else min(self.end, self.at + most)]
        self.at += len(part)
        return part


class Unzstd:
    """All frames of a zstd file; a mark is the begin of a frame."""

    def __init__(self, raw, mark=None):
        self.raw, self.at, self.reader = raw, mark or 0, None
        self.end = self.at

    def mark(self) -> int | None:
        return self.at if self.reader is None else None

    def read(self, most: int) -> bytes:
        import zstandard

        while True:
            if self.reader is None:
                if self.at >= len(self.raw):
                    return b""
                self.end, plain = self._end(self.at)
                if not plain:
                    self.at = self.end
                    continue
                self.reader = zstandard.ZstdDecompressor().stream_reader(_Part(self.raw, self.at, self.end))
            if part := self.reader.read(most):
                return part
            self.reader, self.at = None, self.end

    def _end(self, at: int) -> tuple[int, bool]:
        """Where the frame at ``at`` ends, by the sizes of its blocks, and whether it holds data."""
        import zstandard

        head = self.raw[at : at + 18]
        if len(head) >= 8 and head[1:4] == b"\x2a\x4d\x18" and 0x50 <= head[0] <= 0x5F:
            return at + 8 + int.from_bytes(head[4:8], "little"), False
        about = zstandard.get_frame_parameters(head)
        at += zstandard.frame_header_size(head)
        last = False
        while not last:
            block = int.from_bytes(self.raw[at : at + 3], "little")
            last, kind = bool(block & 1), block >> 1 & 3
            at += 3 + (1 if kind == 1 else block >> 3)
            if at > len(self.raw):
                raise ValueError("the stream is cut short")
        return at + 4 * about.has_checksum, True


class OutOfTime(Exception):
    """The time budget of a file is spent."""


class TooLarge(Exception):
    """A packed file unpacks to more than it may."""


class Unpacked(Pages):
    """What a packed file holds; ``late`` is the time at which to give up."""

    def __init__(self, raw, kind: type, most: int, late: float):
        super().__init__(0)
        self._raw, self._kind, self.late = raw, kind, late
        self._reader, self._at = kind(raw), 0
        self._places, self._marks = [0], [self._reader.mark()]
        held = b""
        while part := self._reader.read(PAGE):
            self._at += len(part)
            if self._at > most:
                raise TooLarge
            self.check()
            if self._at - self._places[-1] >= STRIDE and (mark := self._reader.mark()) is not None:
                self._places.append(self._at)
                self._marks.append(mark)
            held += part
            if len(held) >= PAGE:  # the first pages stay; they are often all
                k = (self._at - len(held)) // PAGE
                if k < HELD:
                    self.keep(k, held[:PAGE])
                held = held[PAGE:]
        if held and (self._at - len(held)) // PAGE < HELD:
            self.keep((self._at - len(held)) // PAGE, held)
        self.size = self._at

    def check(self) -> None:
        if time.monotonic() > self.late:
            raise OutOfTime

    def load(self, k: int) -> bytes:
        place = k * PAGE
        m = bisect.bisect_right(self._places, place) - 1
        if self._at > place or self._places[m] > self._at:
            self._reader, self._at = self._kind(self._raw, self._marks[m]), self._places[m]
        while self._at < place:
            self._at += len(self._reader.read(min(PAGE, place - self._at)))
            self.check()
        out, want = [], min(PAGE, self.size - place)
        while want:
            part = self._reader.read(want)
            out.append(part)
            want -= len(part)
            self._at += len(part)
        return b"".join(out)
