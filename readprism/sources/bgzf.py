"""Block gzip: gzip files of members of at most 64 KiB, each with its size in its header.

Every member can be found and unpacked on its own, so a file can be read from any
place on. Offsets into such a file are (member's offset << 16) + place in the member.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

MAGIC = b"\x1f\x8b\x08\x04"
_HEAD = 12
LARGEST = 1 << 16
_READ = 4 << 20
#: Fixed value: the empty member that ends a file.
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def member_size(data: bytes, at: int = 0) -> int:
    """The size of the member whose header is at ``at``; 0 if there is none, or it is cut off."""
    if data[at : at + 4] != MAGIC or len(data) < at + _HEAD:
        return 0
    (extra,) = struct.unpack_from("<H", data, at + 10)
    place, end = at + _HEAD, at + _HEAD + extra
    while place + 4 <= min(end, len(data)):
        name, (size,) = data[place : place + 2], struct.unpack_from("<H", data, place + 2)
        if name == b"BC" and size == 2 and place + 6 <= len(data):
            return struct.unpack_from("<H", data, place + 4)[0] + 1
        place += 4 + size
    return 0


def first_member(data: bytes, whole: bool) -> int:
    """Where the first member in ``data`` begins that more members, or the data's end, follow; -1 if none does.

    Compressed bytes may look like a header, so the sizes must lead from member to
    member. ``whole``: nothing follows ``data``.
    """
    at = data.find(MAGIC)
    while at >= 0:
        place, steps = at, 0
        while steps < 3 and (size := member_size(data, place)):
            place, steps = place + size, steps + 1
        if steps == 3 or steps and (place == len(data) if whole else place > len(data) - 2 * _HEAD):
            return at
        at = data.find(MAGIC, at + 1)
    return -1


def unpack(data: bytes, at: int, size: int) -> bytes:
    """The content of one member, checked."""
    (extra,) = struct.unpack_from("<H", data, at + 10)
    out = zlib.decompress(data[at + _HEAD + extra : at + size - 8], -15)
    if struct.unpack_from("<II", data, at + size - 8) != (zlib.crc32(out), len(out)):
        raise ValueError("a block's checksum is wrong")
    return out


def members(file, start: int, end: int | None, name: str) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of the members from the first that begins at ``start`` or after it; ``end`` only tells where to look for it."""
    file.seek(start)
    held, at, over = file.read(_READ), start, False
    if start:
        skip = first_member(held, len(held) < _READ)
        if skip < 0 or end is not None and start + skip >= end:
            return
        held, at = held[skip:], start + skip
    place = 0
    while True:
        size = member_size(held, place)
        if not size or place + size > len(held):
            if over:
                if place < len(held):
                    raise ValueError(f"{name}: no block at {at + place}")
                return
            more = file.read(_READ)
            held, at, place, over = held[place:] + more, at + place, 0, len(more) < _READ
            continue
        try:
            yield at + place, unpack(held, place, size)
        except (ValueError, zlib.error) as error:
            raise ValueError(f"{name}: bad block at {at + place}: {error}") from None
        place += size


def pack(data: bytes, size: int = LARGEST - 256) -> bytes:
    """``data`` as block gzip, in members of ``size`` bytes of it."""
    out = []
    for a in range(0, len(data), size):
        part = data[a : a + size]
        coder = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = coder.compress(part) + coder.flush()
        if len(body) > LARGEST - 26:
            coder = zlib.compressobj(0, zlib.DEFLATED, -15)
            body = coder.compress(part) + coder.flush()
        head = MAGIC + struct.pack("<IBBH", 0, 0, 255, 6) + b"BC" + struct.pack("<HH", 2, len(body) + 25)
        out.append(head + body + struct.pack("<II", zlib.crc32(part), len(part)))
    return b"".join(out) + END
