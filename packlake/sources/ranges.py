"""Exact byte ranges of files, on a local disk or any filesystem that pyarrow knows."""

from __future__ import annotations

import base64
import fnmatch
import os
import pickle
import posixpath
import re
from collections import OrderedDict
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import urlencode

from ..errors import CorruptPack, PackError

#: Bytes at the end of a file that come with the first request for a directory.
TAIL = 256 << 10
#: Ranges closer than this are fetched by one request, unless it would become longer than MOST; requests at once.
NEAR, MOST, AT_ONCE = 256 << 10, 8 << 20, 8


def is_remote(path: str) -> bool:
    m = re.match(r"([A-Za-z][A-Za-z0-9+.-]+)://", path)
    return bool(m) and m[1] != "file"


CARRIED = "carried://"


def carry(fs, path: str) -> str:
    """A path that takes a ready filesystem (pyarrow's, or one that follows fsspec) along to all tasks."""
    import pyarrow.fs as pafs

    if not isinstance(fs, pafs.FileSystem):
        fs = pafs.PyFileSystem(pafs.FSSpecHandler(fs))
    return f"{CARRIED}{base64.urlsafe_b64encode(pickle.dumps(fs)).decode()}:{path}"


def with_options(path: str, options: dict[str, str] | None) -> str:
    """The path with options of its store (region, endpoint_override, access_key and the like, as its URI takes them)."""
    import pyarrow.fs as pafs

    if not options:
        return path
    if not is_remote(path):
        raise ValueError("only remote stores have options")
    return carry(*pafs.FileSystem.from_uri(f"{path}{'&' if '?' in path else '?'}{urlencode(options)}"))


def filesystem(path: str):
    """A pyarrow filesystem and the path on it."""
    import pyarrow.fs as pafs

    if path.startswith(CARRIED):
        token, _, at = path.removeprefix(CARRIED).partition(":")
        return pickle.loads(base64.urlsafe_b64decode(token)), at
    if is_remote(path):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), os.path.abspath(re.sub(r"^file:/+", "/", path))


def list_files(folder: str, pattern: str = "*.zip") -> list[tuple[str, str]]:
    """(name, path) of the files right in a folder that match, by name; names must differ."""
    return [(n, p) for n, p, _, _ in list_states(folder, pattern)]


def list_states(folder: str, pattern: str = "*.zip") -> list[tuple[str, str, int | None, int | None]]:
    """(name, path, size, time of the last change in ns) of these files; null where the store doesn't know."""
    import pyarrow.fs as pafs

    fs, root = filesystem(folder)
    found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
    scheme = folder[: len(folder) - len(root)] if folder.startswith(CARRIED) else folder.split("://")[0] + "://" if is_remote(folder) else ""
    files = [f for f in found if f.type == pafs.FileType.File and fnmatch.fnmatchcase(f.base_name, pattern)]
    return [(f.base_name, scheme + posixpath.join(root, f.base_name), f.size, f.mtime_ns) for f in sorted(files, key=lambda f: f.base_name)]


class Ranges:
    """One file. Opens it on the first read, in whatever process that is."""

    def __init__(self, path: str, stream=None):
        """stream: an open object with size() and read_at(length, offset), in place of the path's own filesystem."""
        self.path = path
        self._stream = stream
        self._fd = None
        self._size = None

    def __getstate__(self):
        return {"path": self.path, "_stream": None, "_fd": None, "_size": self._size}

    def _open(self) -> None:
        if self._stream is None and self._fd is None:
            if is_remote(self.path):
                fs, at = filesystem(self.path)
                self._stream = fs.open_input_file(at)
            else:
                self._fd = os.open(filesystem(self.path)[1], os.O_RDONLY)

    def size(self) -> int:
        if self._size is None:
            self._open()
            self._size = os.fstat(self._fd).st_size if self._fd is not None else self._stream.size()
        return self._size

    def read(self, offset: int, length: int) -> bytes:
        """Bytes from offset on, fewer only at the end of the file."""
        if offset < 0 or length < 0:
            raise CorruptPack(f"{self.path}: negative range")
        self._open()
        if self._fd is None:
            got = self._stream.read_at(length, offset)
            if len(got) > length:
                raise PackError(f"{self.path}: the filesystem ignored a byte range")
            return bytes(got)
        parts, at = [], offset
        while length:
            got = os.pread(self._fd, min(length, 1 << 30), at)
            if not got:
                break
            parts.append(got)
            at += len(got)
            length -= len(got)
        return b"".join(parts) if len(parts) != 1 else parts[0]

    def read_many(self, ranges: list[tuple[int, int]]) -> list[bytes]:
        """(offset, length) pairs in any order. Near ones share a request of at most MOST bytes, of which each keeps its
        own alone; requests for remote files run beside each other."""
        order = sorted(range(len(ranges)), key=lambda i: ranges[i])
        groups: list[list[int]] = []
        begin = end = -1
        for i in order:
            offset, length = ranges[i]
            if groups and offset <= end + NEAR and max(end, offset + length) - begin <= MOST:
                groups[-1].append(i)
                end = max(end, offset + length)
            else:
                groups.append([i])
                begin, end = offset, offset + length
        out: list[bytes] = [b""] * len(ranges)

        def fetch(group: list[int]) -> None:
            first = ranges[group[0]][0]
            block = self.read(first, max(sum(ranges[i]) for i in group) - first)
            for i in group:
                out[i] = block[ranges[i][0] - first :][: ranges[i][1]]

        self._open()
        if self._fd is None and len(groups) > 1:
            with ThreadPoolExecutor(AT_ONCE) as pool:
                list(pool.map(fetch, groups))
        else:
            for group in groups:
                fetch(group)
        return out

    def close(self) -> None:
        if self._fd is not None:
            os.close(self._fd)
        elif self._stream is not None and hasattr(self._stream, "close"):
            self._stream.close()
        self._fd = self._stream = None


class Handles:
    """Open shards of a task, the least recently used closed first."""

    def __init__(self, make, most: int = 64):
        self._make, self._most = make, most
        self._open: OrderedDict = OrderedDict()

    def get(self, key):
        if key in self._open:
            self._open.move_to_end(key)
        else:
            self._open[key] = self._make(key)
            if len(self._open) > self._most:
                self._open.popitem(last=False)[1].close()
        return self._open[key]

    def close(self) -> None:
        for x in self._open.values():
            x.close()
        self._open.clear()
