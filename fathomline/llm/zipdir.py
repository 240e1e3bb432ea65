"""The directory of a ZIP archive, read by ranges and never extracted.

The end record is found in the archive's tail, the ZIP64 locator and record are followed where a
field is saturated, and the central directory gives each member's place. A stored member's bytes
begin after its local header, whose own name and extra field are measured with one more range read.
"""

from __future__ import annotations

import struct
from collections.abc import Callable
from dataclasses import dataclass

#: fixed values of the ZIP format: signatures and record sizes
END, END64, LOCATOR64, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
END_SIZE, END64_SIZE, LOCATOR_SIZE, CENTRAL_SIZE, LOCAL_SIZE = 22, 56, 20, 46, 30
MAX16, MAX32 = 0xFFFF, 0xFFFFFFFF
STORED, ENCRYPTED, ZIP64_EXTRA = 0, 1, 1

#: (start, length) -> bytes of the archive
RangeReader = Callable[[int, int], bytes]


class BadArchive(ValueError):
    """The archive breaks the format, or a member cannot be read in place."""


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    flags: int
    crc: int
    packed: int
    size: int
    header: int


def _directory_place(read: RangeReader, size: int) -> tuple[int, int, int]:
    """Offset, length and number of entries of the central directory."""
    tail_at = max(0, size - END_SIZE - MAX16)
    tail = read(tail_at, size - tail_at)
    at = len(tail) - END_SIZE
    while at >= 0:
        at = tail.rfind(END, 0, at + 4)
        if at < 0:
            break
        if at + END_SIZE + struct.unpack_from("<H", tail, at + 20)[0] == len(tail):
            break
        at -= 1
    if at < 0:
        raise BadArchive("no end of central directory")
    _, _, _, entries, length, offset = struct.unpack_from("<HHHHII", tail, at + 4)
    if entries != MAX16 and length != MAX32 and offset != MAX32:
        return offset, length, entries
    place = tail_at + at - LOCATOR_SIZE
    locator = read(place, LOCATOR_SIZE) if place >= 0 else b""
    if locator[:4] != LOCATOR64:
        return offset, length, entries
    end64 = read(struct.unpack_from("<Q", locator, 8)[0], END64_SIZE)
    if end64[:4] != END64:
        raise BadArchive("the ZIP64 locator leads nowhere")
    entries, length, offset = struct.unpack_from("<QQQ", end64, 32)
    return offset, length, entries


def _wide(extra: bytes, fields: list[int]) -> list[int]:
    """Fields with the ZIP64 extra field's values in place of saturated ones."""
    at = 0
    while at + 4 <= len(extra):
        tag, length = struct.unpack_from("<HH", extra, at)
        if tag == ZIP64_EXTRA:
            wide = iter(struct.unpack_from(f"<{length // 8}Q", extra, at + 4))
            try:
                return [next(wide) if f == MAX32 else f for f in fields]
            except StopIteration:
                raise BadArchive("a ZIP64 field is missing") from None
        at += 4 + length
    return fields


def members(read: RangeReader, size: int) -> list[Member]:
    """All entries of the central directory, in its order."""
    offset, length, entries = _directory_place(read, size)
    if offset + length > size:
        raise BadArchive("the central directory lies beyond the end")
    raw, at, out = read(offset, length), 0, []
    for _ in range(entries):
        if raw[at : at + 4] != CENTRAL:
            raise BadArchive("a directory entry is broken")
        flags, method = struct.unpack_from("<HH", raw, at + 8)
        crc, packed, full, n_name, n_extra, n_comment = struct.unpack_from("<IIIHHH", raw, at + 16)
        header = struct.unpack_from("<I", raw, at + 42)[0]
        name = raw[at + CENTRAL_SIZE : at + CENTRAL_SIZE + n_name]
        extra = raw[at + CENTRAL_SIZE + n_name : at + CENTRAL_SIZE + n_name + n_extra]
        full, packed, header = _wide(extra, [full, packed, header])
        out.append(Member(name.decode("utf-8" if flags & 0x800 else "cp437"), method, flags, crc, packed, full, header))
        at += CENTRAL_SIZE + n_name + n_extra + n_comment
    return out


def data_start(read: RangeReader, member: Member) -> int:
    """Where the bytes of a stored member begin in the archive."""
    if member.method != STORED or member.flags & ENCRYPTED:
        raise BadArchive(f"{member.name} is not stored in the clear")
    local = read(member.header, LOCAL_SIZE)
    if local[:4] != LOCAL:
        raise BadArchive(f"{member.name} has no local header")
    n_name, n_extra = struct.unpack_from("<HH", local, 26)
    return member.header + LOCAL_SIZE + n_name + n_extra
