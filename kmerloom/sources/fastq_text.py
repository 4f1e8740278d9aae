"""FASTQ text by byte ranges: whole records, whole pairs, and a record's mate in another file.

A quality line may begin with @ or +, so alignment takes the line structure of records, not one character. Functions take
an open random-access file (``size``, ``read_at``) and never hold more than some blocks of it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

#: Up to a slash or blank, mates have one name.
NAME = re.compile(rb"@([^/ \t]*)")
BLOCK = 1 << 20
#: Bytes read first where it isn't known how many are needed; twice as many on every further read, up to a block.
FIRST = 1 << 12
#: Bytes around the place where a mate is looked for first; four times as many on every further try.
WINDOW = 1 << 16
Record = tuple[int, bytes, bytes, bytes, bytes]


def lines_from(source, offset: int, until: int = 0) -> Iterator[tuple[int, bytes]]:
    """(offset, line without its end) from a byte offset on, read in blocks.

    Up to the byte ``until`` all is read, beyond it little at first: a short range doesn't cost a whole block."""
    size, rest, at, step = source.size(), b"", offset, FIRST
    while True:
        wanted = until - offset
        if wanted <= 0:
            wanted, step = step, 2 * step
        block = source.read_at(min(BLOCK, wanted, size - offset), offset) if offset < size else b""
        offset += len(block)
        *whole, rest = (rest + block).split(b"\n")
        for line in whole:
            yield at, line.removesuffix(b"\r")
            at += len(line) + 1
        if not block:
            if rest:
                yield at, rest.removesuffix(b"\r")
            return


def _is_record(lines: list[tuple[int, bytes]]) -> bool:
    (_, head), (_, seq), (_, plus), (_, qual) = lines
    return head[:1] == b"@" and plus[:1] == b"+" and len(seq) == len(qual)


def align(source, start: int) -> int | None:
    """Offset of the first record that begins at ``start`` or later; None if there is none.

    Of the four possible phases of the lines that follow, the one in which the next two records are well formed wins.
    """
    if start == 0:
        return next((at for at, line in lines_from(source, 0) if line), None)
    lines = lines_from(source, start - 1)
    next(lines, None)  # the line that holds the byte before: the next one begins at start or later
    ahead = [x for _, x in zip(range(12), lines)]
    for i in range(min(4, len(ahead))):
        first, second = ahead[i : i + 4], ahead[i + 4 : i + 8]
        if len(first) == 4 and _is_record(first) and (len(second) < 4 or not any(line for _, line in second) or _is_record(second)):
            return first[0][0]
    return None


def records_from(source, at: int | None, until: int = 0) -> Iterator[Record]:
    """(offset, header, sequence, plus line, quality) of all records from one's offset on; those that begin before ``until``
    are sure to be read."""
    lines = lines_from(source, at, until) if at is not None else iter(())
    for at, head in lines:
        if not head:
            continue
        body = [x for _, x in zip(range(3), (line for _, line in lines))]
        if head[:1] != b"@" or len(body) < 3 or body[1][:1] != b"+" or len(body[0]) != len(body[2]):
            raise ValueError(f"broken FASTQ record at byte {at}")
        yield at, head, *body


def records_in(source, start: int, end: int) -> Iterator[Record]:
    """The records that begin in [start, end)."""
    for record in records_from(source, align(source, start), end):
        if record[0] >= end:
            return
        yield record


def mate_name(head: bytes) -> bytes:
    return NAME.match(head)[1]


def find_mate(source, head: bytes, guess: int) -> int | None:
    """Offset of the record of the same name that is nearest to the byte ``guess``, in windows that widen to the file."""
    name, size, half = b"@" + mate_name(head), source.size(), WINDOW
    while True:
        low, high = max(0, guess - half), min(size, guess + half)
        text = source.read_at(min(high + len(name) + 1, size) - low, low)
        found = [low + m.start() for m in re.finditer(rb"^" + re.escape(name) + rb"(?=[/ \t\r\n]|\Z)", text, re.M) if low + m.start() < high]
        for at in sorted(found, key=lambda at: abs(at - guess)):
            if (at == 0 or low < at or source.read_at(1, at - 1) == b"\n") and align(source, at) == at:
                return at
        if low == 0 and high == size:
            return None
        half *= 4


def pairs_of_files(left, right, start: int, end: int) -> Iterator[tuple[Record, Record]]:
    """Mates of two files: of the records of ``left`` that begin in [start, end), each with that of ``right``.

    The mate of the range's first record is found by its name, near the same share of the other file, whatever the
    lengths of records; from there on both files are read side by side, name by name. The last range also sees that the
    other file ends with it.
    """
    first = align(left, start)
    last = end >= left.size()
    if first is None or first >= end:
        if start == 0 and last and align(right, 0) is not None:
            raise ValueError("different numbers of records")
        return
    guess = int(first * right.size() / max(left.size(), 1))
    _, head, *_ = next(records_from(left, first))
    mate = align(right, 0) if start == 0 else find_mate(right, head, guess)
    if mate is None:
        raise ValueError("different numbers of records" if start == 0 else f"reads whose mates have other names: no mate of {head.decode('latin-1')}")
    others = records_from(right, mate, mate + int((end - first) * right.size() / max(left.size(), 1)))
    for record in records_from(left, first, end):
        if record[0] >= end:
            return
        other = next(others, None)
        if other is None:
            raise ValueError("different numbers of records")
        if mate_name(record[1]) != mate_name(other[1]):
            raise ValueError(f"reads whose mates have other names: {record[1].decode('latin-1')} and {other[1].decode('latin-1')}")
        yield record, other
    if next(others, None) is not None:
        raise ValueError("different numbers of records")


def pairs_in(source, start: int, end: int) -> Iterator[tuple[Record, Record]]:
    """Mates that follow one another in one file, of which the first begins in [start, end).

    Inside a file, a range begins with a pair's second record if that has another name than the one after it.
    """
    records = records_from(source, align(source, start), end)
    first = next(records, None)
    if first is not None and start > 0 and first[0] < end:
        second = next(records, None)
        if second is None:
            return  # the last pair's second record; the range before read it
        if mate_name(first[1]) != mate_name(second[1]):
            first = second
        elif first[0] < end:
            yield first, second
            first = next(records, None)
    while first is not None and first[0] < end:
        second = next(records, None)
        if second is None:
            raise ValueError("an odd number of records")
        if mate_name(first[1]) != mate_name(second[1]):
            raise ValueError(f"reads whose mates have other names: {first[1].decode('latin-1')} and {second[1].decode('latin-1')}")
        yield first, second
        first = next(records, None)
