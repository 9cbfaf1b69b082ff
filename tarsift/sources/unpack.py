"""Unpacking inside a task: archive bytes in, member rows out."""

from __future__ import annotations

import gzip
import io
import posixpath
import re
import tarfile
import zlib
from collections.abc import Callable, Iterator
from contextlib import nullcontext

import numpy as np
import pandas as pd

from tarsift.fixed_values import ENTROPY_MIN_BYTES
from tarsift.functions.entropy import bits_per_byte, entropy_of, histogram
from tarsift.session import ship_with_tasks

ship_with_tasks(__name__)

MEMBER_SCHEMA = (
    "archive string, archive_bytes bigint, status string, has_manifest boolean, "
    "ordinal int, path string, kind string, size bigint, linkname string, entropy double, "
    "long boolean, content binary"
)
PART_SCHEMA = (
    "archive string, ordinal int, path string, size bigint, part int, at bigint, before int, "
    "core int, lines bigint, line_at bigint, line_chars bigint, entropy double, content binary"
)
_COLUMNS = [part.split()[0] for part in MEMBER_SCHEMA.split(", ")]

# A batch of members leaves the task when it holds this much content.
BATCH_BYTES = 4 << 20
BATCH_ROWS = 2000
# An archive that decompresses to no more than this is held decompressed.
KEPT_BYTES = 32 << 20

# A member of more bytes than this leaves in parts.
LONG_BYTES = 64 << 20
# Bytes of a part, and of the text on either side that comes with it.
PART_BYTES = 16 << 20
CONTEXT_BYTES = 256 << 10
# After one of these bytes a part may end: no URL, name or encoded run goes on behind it.
STOP = re.compile(rb"[\s'\"]")

# What stands for the members of an archive that has none.
NO_MEMBER = (None,) * 8

OK, TRAVERSAL, OVER_LIMIT = "ok", "path_traversal", "over_limit"
UNREADABLE, MISSING, TOO_LARGE = "unreadable", "missing", "too_large"


def unpacker(limit: int | None, long_bytes: int = LONG_BYTES):
    """The function a task runs over batches of (path, length, content)."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for batch in batches:
            for path, length, content in zip(batch["path"], batch["length"], batch["content"]):
                if content is None:
                    absent = MISSING if pd.isna(length) else TOO_LARGE
                    yield (path, None, absent, False, *NO_MEMBER)
                else:
                    yield from _members(path, content, limit, long_bytes)

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Members of many small archives share a batch.
        yield from _batched(rows(batches), _COLUMNS)

    return unpack


def part_maker(limit: int | None, long_bytes: int, part_bytes: int, context: int):
    """As `unpacker`, for the members of more than ``long_bytes`` alone, part by part."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                if content is not None:
                    yield from _long_members(path, content, limit, long_bytes, part_bytes, context)

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _batched(rows(batches), [part.split()[0] for part in PART_SCHEMA.split(", ")])

    return parts


def _batched(rows: Iterator[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    pending: list[tuple] = []
    held = 0
    for row in rows:
        pending.append(row)
        held += len(row[-1] or b"")
        if held >= BATCH_BYTES or len(pending) >= BATCH_ROWS:
            yield pd.DataFrame(pending, columns=columns)
            pending, held = [], 0
    if pending:
        yield pd.DataFrame(pending, columns=columns)


def _members(path: str, content: bytes, limit: int | None, long_bytes: int) -> Iterator[tuple]:
    size = len(content)
    data, opened = _opener(content)
    status, has_manifest, heads, members = _verdict(opened, limit, data is not None)
    archive = (path, size, status, has_manifest)
    if status != OK or not heads:
        yield (*archive, *NO_MEMBER)
        return
    current, links = _as_extracted(heads)
    read_by: dict[int, list[int]] = {}
    for link, target in links.items():
        read_by.setdefault(target, []).append(link)
    # Of an archive that is held the headers are read once, and contents are cut out of it.
    with opened() if data is None else nullcontext(members) as tar:
        for ordinal, member in enumerate(tar):
            place, kind, linkname = heads[ordinal]
            if kind != "file" or current[place] != ordinal:
                if ordinal not in links:
                    replaced = kind == "file" and current[place] != ordinal
                    shown = "superseded" if replaced else kind
                    yield (*archive, ordinal, place, shown, 0, linkname, None, False, None)
                if kind != "file":
                    continue
            readers = read_by.get(ordinal, [])
            if current[place] != ordinal and not readers:
                continue
            long = member.size > long_bytes
            if long:
                text = None
            elif data is None:
                text = tar.extractfile(member).read()
            elif member.issparse():
                with opened() as again:
                    text = again.extractfile(member).read()
            else:
                text = data[member.offset_data : member.offset_data + member.size]
            measured = bits_per_byte(text) if text and len(text) > ENTROPY_MIN_BYTES else None
            if current[place] == ordinal:
                yield (*archive, ordinal, place, "file", member.size, linkname, measured, long, text)
            for link in readers:
                name, how, target = heads[link]
                yield (*archive, link, name, how, member.size, target, measured, long, text)


def _long_members(
    path: str, content: bytes, limit: int | None, long_bytes: int, part_bytes: int, context: int
) -> Iterator[tuple]:
    _, opened = _opener(content)
    status, _, heads, _ = _verdict(opened, limit)
    if status != OK:
        return
    current, links = _as_extracted(heads)
    with opened() as tar:
        for ordinal, member in enumerate(tar):
            place, kind, _ = heads[ordinal]
            if kind != "file" or member.size <= long_bytes:
                continue
            places = [(ordinal, place)] if current[place] == ordinal else []
            places += [(link, heads[link][0]) for link, target in links.items() if target == ordinal]
            if not places:
                continue
            for piece in cut(tar.extractfile(member), part_bytes, context):
                for own, name in places:
                    yield (path, own, name, member.size, *piece)


def cut(stream: io.BufferedIOBase, part_bytes: int, context: int) -> Iterator[tuple]:
    """A file in parts: part, at, before, core, lines, line_at, line_chars, entropy, content.

    ``content`` begins at byte ``at`` of the file; its ``core`` bytes after the first ``before``
    belong to this part, what surrounds them shows what a match in the core looks like.
    ``lines`` line breaks come before the content, which begins in the line that starts at byte
    ``line_at``, ``line_chars`` characters into it. A part ends after white space or a quote
    where one is near. The last part has the whole file's entropy. Held are one part and its
    surroundings.
    """
    buffer = b""
    at = before = lines = line_at = line_chars = part = 0
    counts, ended = np.zeros(256, np.int64), False
    while True:
        wanted = before + part_bytes + 2 * context
        while not ended and len(buffer) < wanted:
            more = stream.read(wanted - len(buffer))
            buffer, ended = buffer + more, not more
        end = len(buffer)
        if not ended or end > before + part_bytes + context:
            end = _part_end(buffer, before + part_bytes, before + part_bytes + context)
        last = ended and end == len(buffer)
        counts += histogram(memoryview(buffer)[before:end])
        shown = buffer[: end + context]
        yield part, at, before, end - before, lines, line_at, line_chars, float(entropy_of(counts)) if last else None, shown
        if last:
            return
        start = max(0, end - context)
        while 0 < start < end and buffer[start] & 0xC0 == 0x80:
            start += 1
        head = buffer[:start]
        broken = head.rfind(b"\n") + 1
        if broken:
            lines, line_at, line_chars = lines + head.count(b"\n"), at + broken, 0
        line_chars += len(head[broken:].decode("utf-8", "ignore").replace("\ufffd", ""))
        buffer, at, before, part = buffer[start:], at + start, end - start, part + 1


def _part_end(buffer: bytes, least: int, most: int) -> int:
    found = STOP.search(buffer, least, most)
    if found:
        return found.end()
    end = least
    while end < most and end < len(buffer) and buffer[end] & 0xC0 == 0x80:
        end += 1
    return end


def _as_extracted(heads: list[tuple[str, str, str | None]]) -> tuple[dict[str, int], dict[int, int]]:
    """What extraction leaves: the last member of each path, and the file each link that leads
    to a file of the archive gives the content of. A hard link names a member that came before
    it; a symbolic link is followed in the folder as it is in the end."""
    current: dict[str, int] = {}
    links: dict[int, int] = {}
    for ordinal, (place, kind, linkname) in enumerate(heads):
        if kind == "hardlink":
            target = current.get(posixpath.normpath(linkname or ""))
            if target is not None:
                target = links.get(target, target)
                if heads[target][1] == "file":
                    links[ordinal] = target
        current[place] = ordinal
    for place, ordinal in current.items():
        kind = heads[ordinal][1]
        seen: set[int] = set()
        at, where = ordinal, place
        while kind == "symlink" and at not in seen:
            seen.add(at)
            where = posixpath.normpath(posixpath.join(posixpath.dirname(where), heads[at][2] or ""))
            if where.startswith(("/", "../")) or where not in current:
                break
            at = current[where]
            kind = heads[at][1]
        if at != ordinal:
            at = links.get(at, at)
            if heads[at][1] == "file":
                links[ordinal] = at
    # A link that a later member replaced is no file any more.
    return current, {k: v for k, v in links.items() if current[heads[k][0]] == k}


def _opener(content: bytes) -> tuple[bytes | None, Callable[[], tarfile.TarFile]]:
    """How to read the archive, more than once. A small one is decompressed once and kept, and
    comes along; any other is decompressed again each time, member by member."""
    if len(content) <= KEPT_BYTES:
        data = _at_once(content)
        try:
            if data is None:
                data = gzip.GzipFile(fileobj=io.BytesIO(content)).read(KEPT_BYTES + 1)
        except (EOFError, OSError, zlib.error):
            data = None
        if data is not None and len(data) <= KEPT_BYTES:
            return data, lambda: tarfile.open(fileobj=io.BytesIO(data), mode="r:")
    stream = lambda: gzip.GzipFile(fileobj=io.BytesIO(content))
    return None, lambda: tarfile.open(fileobj=stream(), mode="r|")


def _at_once(content: bytes) -> bytes | None:
    """What one gzip stream without anything behind it holds, where that is little."""
    stream = zlib.decompressobj(16 + zlib.MAX_WBITS)
    try:
        data = stream.decompress(content, KEPT_BYTES + 1)
    except zlib.error:
        return None
    return data if stream.eof and not stream.unused_data else None


def _verdict(
    opened: Callable[[], tarfile.TarFile], limit: int | None, held: bool = False
) -> tuple[str, bool, list[tuple[str, str, str | None]], list[tarfile.TarInfo]]:
    """What becomes of an archive, from its headers in order: the first breach decides; path,
    kind and link name of its members; and, where it is ``held``, the members."""
    total, has_manifest, heads, members = 0, False, [], []
    try:
        with opened() as tar:
            for member in tar:
                if _escapes(member.name):
                    return TRAVERSAL, False, [], []
                heads.append((posixpath.normpath(member.name), _kind(member), member.linkname or None))
                if member.isfile():
                    total += member.size
                    if limit is not None and total > limit:
                        return OVER_LIMIT, False, [], []
                    has_manifest |= posixpath.basename(member.name) == "package.json"
            if held:
                members = tar.getmembers()
    except (tarfile.TarError, EOFError, OSError, zlib.error):
        return UNREADABLE, False, [], []
    return OK, has_manifest, heads, members


def _escapes(name: str) -> bool:
    resolved = posixpath.normpath(name)
    return name.startswith("/") or resolved == ".." or resolved.startswith("../")


def _kind(member: tarfile.TarInfo) -> str:
    if member.isfile():
        return "file"
    if member.issym():
        return "symlink"
    if member.islnk():
        return "hardlink"
    return "dir" if member.isdir() else "other"
