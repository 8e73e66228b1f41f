"""BAM as a Spark data source: splittable reads, one part file per writing task.

    bam.register(spark)
    spark.read.format("bam").load("file:///data/run.bam")

A file is cut into byte ranges.  A task looks for the first compressed block in
its range, then for the first chain of records in the inflated bytes, and stops at
the first record that begins in a block behind its range.  Only the structure of
records counts there, not what they say.  Each task then checks that the next one
starts where it stopped; a file for which they differ is an error, so no record is
lost or read twice.

Records are decoded and encoded by the batch, column by column; ``decode_record`` and
``encode_record`` say the same of one record.
"""

from __future__ import annotations

import json
import struct
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import compute as pc
from pyarrow import fs as pafs
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from crestline.functions.regions import LEVELS

# Fixed values of the format: letters by code, tag number formats, the end marker.
CIGAR_LETTERS = "MIDNSHP=XB"
BASE_LETTERS = "=ACMGRSVTWYHKDBN"
TAG_FORMATS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f", "d": "d"}
END_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")

SCHEMA = (
    "qname string, flag int, rname string, pos long, mapq int, cigar array<struct<op:string,len:int>>, "
    "rnext string, pnext long, tlen int, seq string, qual string, tags map<string,struct<t:string,v:string>>"
)
_CIGAR = pa.struct([("op", pa.string()), ("len", pa.int32())])
_TAG = pa.struct([("t", pa.string()), ("v", pa.string())])
ARROW = pa.schema(
    [
        ("qname", pa.string()),
        ("flag", pa.int32()),
        ("rname", pa.string()),
        ("pos", pa.int64()),
        ("mapq", pa.int32()),
        ("cigar", pa.list_(_CIGAR)),
        ("rnext", pa.string()),
        ("pnext", pa.int64()),
        ("tlen", pa.int32()),
        ("seq", pa.string()),
        ("qual", pa.string()),
        ("tags", pa.map_(pa.string(), _TAG)),
    ]
)
# The fields of fixed size, with the size prefix.
FIXED = np.dtype(
    [
        ("size", "<i4"),
        ("tid", "<i4"),
        ("pos", "<i4"),
        ("l_name", "u1"),
        ("mapq", "u1"),
        ("bin", "<u2"),
        ("n_cigar", "<u2"),
        ("flag", "<u2"),
        ("l_seq", "<i4"),
        ("mtid", "<i4"),
        ("mpos", "<i4"),
        ("tlen", "<i4"),
    ]
)
SPLIT_BYTES = 64 << 20
BATCH_BYTES = 2 << 20  # inflated bytes decoded at a time; a longer record is a batch of its own
READ_BYTES = 1 << 18
CHAIN = 8  # records in a row that must look right before a start is trusted
MAX_RECORD = 1 << 28


def open_path(path: str):
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def block_size(data: bytes, at: int = 0) -> tuple[int, int] | None:
    """(whole size, place of the payload) of the compressed block at ``at``, if one starts there."""
    if len(data) < at + 12 or data[at : at + 4] != b"\x1f\x8b\x08\x04":
        return None
    place, stop = at + 12, at + 12 + struct.unpack_from("<H", data, at + 10)[0]
    while place + 4 <= min(stop, len(data)):
        (size,) = struct.unpack_from("<H", data, place + 2)
        if data[place : place + 2] == b"BC" and size == 2 and place + 6 <= len(data):
            return struct.unpack_from("<H", data, place + 4)[0] + 1, stop - at
        place += 4 + size
    return None


class Blocks:
    """Inflated blocks of a file from a byte offset on, with where each began."""

    def __init__(self, handle, offset: int, size: int):
        self.handle, self.offset, self.size = handle, offset, size
        self.raw, self.kept = b"", 0  # bytes read ahead and where they begin

    def seek_first(self) -> bool:
        """Move to the first block start at or after the offset; false at the end of the file."""
        if self.offset == 0:
            return True
        self.handle.seek(self.offset)
        # a block is at most 64 KiB, so these bytes hold a start and its successor
        data = self.handle.read(1 << 18)
        at = data.find(b"\x1f\x8b\x08\x04")
        while at >= 0:
            block = block_size(data, at)
            after = at + block[0] if block else 0
            if block and (self.offset + after >= self.size or block_size(data, after)):
                self.offset += at
                return True
            at = data.find(b"\x1f\x8b\x08\x04", at + 1)
        if len(data) >= 1 << 17:
            raise ValueError(f"no compressed block after byte {self.offset}")
        return False

    def next(self) -> tuple[int, bytes] | None:
        while self.offset < self.size:
            if not self.kept <= self.offset <= self.kept + len(self.raw) - (1 << 16):
                self.handle.seek(self.offset)
                self.raw, self.kept = self.handle.read(READ_BYTES), self.offset
            at, begin = self.offset - self.kept, self.offset
            block = block_size(self.raw, at)
            if block is None or at + block[0] > len(self.raw):
                raise ValueError(f"no whole compressed block at byte {self.offset}")
            self.offset += block[0]
            data = zlib.decompress(self.raw[at + block[1] : at + block[0] - 8], -15)
            if data:
                return begin, data
        return None


class Stream:
    """Inflated bytes from a block on; ``at`` is the place of the next record."""

    def __init__(self, blocks: Blocks):
        self.blocks, self.data, self.at = blocks, b"", 0
        self.marks: list[tuple[int, int]] = []  # (offset in data, block begin)

    def more(self) -> bool:
        block = self.blocks.next()
        if block is None:
            return False
        self.marks.append((len(self.data), block[0]))
        self.data += block[1]
        return True

    def need(self, n: int, end: int | None = None) -> bool:
        """Have ``n`` bytes from ``at`` on, if the file has them up to the first block at or after ``end``; read bytes are let go."""
        if len(self.data) - self.at < n:
            kept = max((k for k, (o, _) in enumerate(self.marks) if o <= self.at), default=0)
            self.marks = [(o - self.at, b) for o, b in self.marks[kept:]]
            parts, have, self.at = [self.data[self.at :]], len(self.data) - self.at, 0
            while have < n and not (end is not None and self.marks and self.marks[-1][1] >= end) and (block := self.blocks.next()) is not None:
                self.marks.append((have, block[0]))
                parts.append(block[1])
                have += len(block[1])
            self.data = b"".join(parts)
        return len(self.data) - self.at >= n

    def place(self) -> tuple[int, int] | None:
        """(block begin, offset inside) of the next record; none at the end of the file."""
        if not self.need(4):
            if len(self.data) > self.at:
                raise ValueError("the last record is cut off")
            return None
        offset, begin = [m for m in self.marks if m[0] <= self.at][-1]
        return begin, self.at - offset


def read_header(path: str) -> tuple[list[tuple[str, int]], int, int]:
    """Contigs, and where the first record is: block offset and offset inside."""
    system, name = open_path(path)
    with system.open_input_file(name) as handle:
        blocks, data, starts = Blocks(handle, 0, handle.size()), b"", []

        def need(n: int) -> None:
            nonlocal data
            while len(data) < n:
                block = blocks.next()
                if block is None:
                    raise ValueError(f"{path}: header is cut off")
                starts.append((len(data), block[0]))
                data += block[1]

        need(12)
        if data[:4] != b"BAM\x01":
            raise ValueError(f"{path} is not a BAM file")
        text = struct.unpack_from("<i", data, 4)[0]
        need(12 + text)
        at, contigs = 12 + text, []
        for _ in range(struct.unpack_from("<i", data, 8 + text)[0]):
            need(at + 4)
            n = struct.unpack_from("<i", data, at)[0]
            need(at + 8 + n)
            contigs.append((data[at + 4 : at + 3 + n].decode(), struct.unpack_from("<i", data, at + 4 + n)[0]))
            at += 8 + n
        inside = [(base, offset) for base, offset in starts if base <= at]
        base, offset = inside[-1]
        return contigs, offset, at - base


def record_size(data: bytes, at: int, contigs: int) -> int | None:
    """Size with prefix of the record at ``at``, if its sizes fit together."""
    size, tid, _pos, l_name, _mapq, _bin, n_cigar, _flag, l_seq, mtid = struct.unpack_from("<iiiBBHHHii", data, at)
    if not 32 < size <= MAX_RECORD or l_name < 1 or l_seq < 0:
        return None
    if not (-1 <= tid < contigs and -1 <= mtid < contigs):
        return None
    if 32 + l_name + 4 * n_cigar + (l_seq + 1) // 2 + l_seq > size:
        return None
    end = at + 35 + l_name
    if end < len(data) and (data[end] != 0 or 0 in data[at + 36 : end]):
        return None
    return size + 4


def chained(data: bytes, at: int, contigs: int, ended: bool) -> bool | None:
    """Whether records follow each other from ``at`` on; none if more bytes are needed to tell."""
    for _ in range(CHAIN):
        if ended and at == len(data):
            return True
        if at + 36 > len(data):
            return False if ended else None
        size = record_size(data, at, contigs)
        if size is None:
            return False
        at += size
    return True


def seek_record(handle, begin: int, contigs: int) -> Stream | None:
    """Stream at the first record that begins in a block at or after ``begin``; none if the file has none.

    Places that more bytes might confirm are kept and tried again, so every place is looked at once.
    """
    blocks = Blocks(handle, begin, handle.size())
    if not blocks.seek_first():
        return None
    stream, tried, open_places = Stream(blocks), 0, []
    wanted = 1 << 16
    while True:
        ended = False
        while len(stream.data) < wanted and not ended:
            ended = not stream.more()
        data, still = stream.data, []
        for at in [*open_places, *range(tried, len(data))]:
            found = chained(data, at, contigs, ended)
            if found:
                stream.at = at
                return stream
            if found is None:
                still.append(at)
        if ended:
            return None
        open_places, tried, wanted = still, len(data), 2 * wanted


def decode_tags(data: bytes) -> list[tuple[str, dict]]:
    out, at = [], 0
    while at < len(data):
        key, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind in "ZH":
            end = data.index(0, at)
            value, at = data[at:end].decode(), end + 1
        elif kind == "A":
            value, at = chr(data[at]), at + 1
        elif kind == "B":
            sub, n = chr(data[at]), struct.unpack_from("<i", data, at + 1)[0]
            numbers = struct.unpack_from(f"<{n}{TAG_FORMATS[sub]}", data, at + 5)
            value, at = ",".join([sub, *[format(x, "g") if sub in "fd" else str(x) for x in numbers]]), at + 5 + n * struct.calcsize(TAG_FORMATS[sub])
        else:
            number = struct.unpack_from("<" + TAG_FORMATS[kind], data, at)[0]
            at += struct.calcsize(TAG_FORMATS[kind])
            value, kind = (format(number, "g"), kind) if kind in "fd" else (str(number), "i")
        out.append((key, {"t": kind, "v": value}))
    return out


def decode_record(r: bytes, names: list[str]) -> tuple:
    """Fields of one record; ``r`` is without its size prefix."""
    tid, pos, l_name, mapq, _bin, n_cigar, flag, l_seq, mtid, mpos, tlen = struct.unpack_from("<iiBBHHHiiii", r)
    at = 32 + l_name
    cigar = [{"op": CIGAR_LETTERS[c & 15], "len": c >> 4} for c in struct.unpack_from(f"<{n_cigar}I", r, at)]
    at += 4 * n_cigar
    half = (l_seq + 1) // 2
    seq = "".join(BASE_LETTERS[b >> 4] + BASE_LETTERS[b & 15] for b in r[at : at + half])[:l_seq] or "*"
    at += half
    raw = r[at : at + l_seq]
    qual = "*" if l_seq == 0 or raw[0] == 255 else bytes(q + 33 for q in raw).decode()
    mate = None if mtid < 0 else ("=" if mtid == tid else names[mtid])
    return (
        r[32 : 31 + l_name].decode(),
        flag,
        names[tid] if tid >= 0 else None,
        pos,
        mapq,
        cigar,
        mate or "*",
        mpos,
        tlen,
        seq,
        qual,
        decode_tags(r[at + l_seq :]),
    )


class ByteRange(InputPartition):
    def __init__(self, path: str, begin: int, end: int):
        self.path, self.begin, self.end = path, begin, end


class BamReader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self) -> list[InputPartition]:
        system, name = open_path(self.path)
        info = system.get_file_info(name)
        files = [info]
        if info.type == pafs.FileType.Directory:
            files = [f for f in system.get_file_info(pafs.FileSelector(name)) if f.path.endswith(".bam")]
        scheme = self.path.split("://")[0] + "://" if "://" in self.path else ""
        return [
            ByteRange(scheme + f.path, begin, min(begin + self.split, f.size))
            for f in files
            for begin in range(0, f.size, self.split)
        ]

    def read(self, part: ByteRange) -> Iterator[pa.RecordBatch]:
        contigs, first_block, first_offset = read_header(part.path)
        names = [c for c, _ in contigs]
        for data, starts in self.batches(part, len(names), first_block, first_offset):
            yield decode_batch(data, starts, names)

    def batches(self, part: ByteRange, contigs: int, first_block: int, first_offset: int) -> Iterator[tuple[bytes, list[int]]]:
        """Inflated bytes and where whole records of the range start in them."""
        system, name = open_path(part.path)
        with system.open_input_file(name) as handle:
            if part.end <= first_block:
                return
            if part.begin <= first_block:
                stream = Stream(Blocks(handle, first_block, handle.size()))
                if not stream.need(first_offset):
                    return
                stream.at = first_offset
            else:
                stream = seek_record(handle, part.begin, contigs)
            stop, size_at = None, struct.Struct("<i").unpack_from
            while stream is not None and (stop := stream.place()) is not None and stop[0] < part.end:
                stream.need(BATCH_BYTES, part.end)
                data, at, starts = stream.data, stream.at, []
                limit = min((offset for offset, begin in stream.marks if begin >= part.end), default=len(data))
                while at < limit and at + 4 <= len(data):
                    (size,) = size_at(data, at)
                    if size < 32:
                        raise ValueError(f"{part.path}: a record at block {stop[0]} is cut off")
                    if at + 4 + size > len(data):
                        break
                    starts.append(at)
                    at += 4 + size
                stream.at = at
                if starts:
                    yield data, starts
                elif not stream.need(4 + size):
                    raise ValueError(f"{part.path}: a record at block {stop[0]} is cut off")
            if stream is not None and part.end < handle.size():
                follows = seek_record(handle, part.end, contigs)
                if (follows and follows.place()) != stop:
                    raise ValueError(f"{part.path}: records near byte {part.end} can't be told apart; choose another splitbytes")


def offsets_of(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of all stretches ``starts`` to ``starts + lengths``, one after the other."""
    ends = np.cumsum(lengths, dtype=np.int64)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


def text_array(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Strings of the given lengths that lie one after the other in ``values``."""
    offsets = offsets_of(lengths).astype(np.int32)
    made = pa.StringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values)))
    made.validate(full=True)
    return made


def starred(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """As ``text_array``, with a star for what is empty."""
    shown = np.maximum(lengths, 1)
    out = np.full(shown.sum(), ord("*"), np.uint8)
    out[spread(offsets_of(shown)[:-1], lengths)] = values
    return text_array(out, shown)


def numbers_at(raw: np.ndarray, at: np.ndarray, form: str) -> np.ndarray:
    form = np.dtype(form)
    return raw[at[:, None] + np.arange(form.itemsize)].view(form)[:, 0]


def decode_batch(data: bytes, starts: list[int], names: list[str]) -> pa.RecordBatch:
    """Columns of the records whose size prefixes are at ``starts``."""
    raw, begin = np.frombuffer(data, np.uint8), np.asarray(starts, np.int64)
    fixed = numbers_at(raw, begin, FIXED)
    l_name, n_cigar, l_seq = (fixed[c].astype(np.int64) for c in ("l_name", "n_cigar", "l_seq"))
    half = (l_seq + 1) // 2
    name_at = begin + FIXED.itemsize
    cigar_at = name_at + l_name
    seq_at = cigar_at + 4 * n_cigar
    qual_at = seq_at + half
    tags_at, end = qual_at + l_seq, begin + 4 + fixed["size"]
    if (l_name < 1).any() or (l_seq < 0).any() or (tags_at > end).any():
        raise ValueError("the sizes of a record do not fit together")
    steps = numbers_at(raw, spread(cigar_at, 4 * n_cigar)[::4], "<u4")
    ops = pa.array(list(CIGAR_LETTERS)).take(pa.array(steps & 15))
    cigar = pa.StructArray.from_arrays([ops, pa.array((steps >> 4).astype(np.int32))], fields=list(_CIGAR))
    letters = np.frombuffer(BASE_LETTERS.encode(), np.uint8)
    bases = np.stack([np.repeat(letters, 16), np.tile(letters, 16)], 1)[raw[spread(seq_at, half)]].reshape(-1)
    missing = (l_seq == 0) | (raw[np.minimum(qual_at, len(raw) - 1)] == 255)
    l_qual = np.where(missing, 0, l_seq)
    tid, mtid = fixed["tid"], fixed["mtid"]
    contigs, n = pa.array([*names, "=", "*"], pa.string()), len(names)
    columns = [
        text_array(raw[spread(name_at, l_name - 1)], l_name - 1),
        pa.array(fixed["flag"].astype(np.int32)),
        contigs.take(pa.array(np.where(tid < 0, 0, tid), mask=tid < 0)),
        pa.array(fixed["pos"].astype(np.int64)),
        pa.array(fixed["mapq"].astype(np.int32)),
        pa.ListArray.from_arrays(pa.array(offsets_of(n_cigar).astype(np.int32)), cigar),
        contigs.take(pa.array(np.where(mtid < 0, n + 1, np.where(mtid == tid, n, mtid)))),
        pa.array(fixed["mpos"].astype(np.int64)),
        pa.array(fixed["tlen"].astype(np.int32)),
        starred(bases[spread(2 * offsets_of(half)[:-1], l_seq)], l_seq),
        starred(raw[spread(qual_at, l_qual)] + np.uint8(33), l_qual),
        tag_maps(data, raw, tags_at, end),
    ]
    return pa.RecordBatch.from_arrays(columns, schema=ARROW)


def tag_maps(data: bytes, raw: np.ndarray, at: np.ndarray, end: np.ndarray) -> pa.Array:
    """Tags of every record: the first of each at once, then the second, and so on."""
    zeros, row, n = np.flatnonzero(raw == 0), np.arange(len(at)), len(at)
    rows, keys, kinds, values = [], [], [], []

    def found(which: np.ndarray, kind: str, value: pa.Array) -> None:
        rows.append(row[which])
        keys.append(at[which])
        kinds.append(np.full(len(value), ord(kind), np.uint8))
        values.append(value)

    while True:
        row, at = row[at < end[row]], at[at < end[row]]
        if not len(row):
            break
        if (at + 3 > end[row]).any():
            raise ValueError("the tags of a record are cut off")
        kind, after = raw[at + 2], at + 3
        for code in np.unique(kind):
            which, letter = np.flatnonzero(kind == code), chr(code)
            place = at[which] + 3
            if letter in "ZH":
                stop = np.append(zeros, len(raw))[np.searchsorted(zeros, place)]
                after[which] = stop + 1
                found(which, letter, text_array(raw[spread(place, stop - place)], stop - place))
            elif letter == "A":
                after[which] = place + 1
                found(which, letter, text_array(raw[place], np.ones(len(place), np.int64)))
            elif letter in "cCsSiI":
                form = np.dtype("<" + TAG_FORMATS[letter])
                after[which] = place + form.itemsize
                found(which, "i", pa.array(numbers_at(raw, place, form).astype(np.int64)).cast(pa.string()))
            elif letter in "fd" or letter == "B":
                if letter == "B":
                    width = np.array([struct.calcsize(TAG_FORMATS[chr(c)]) for c in raw[place]])
                    after[which] = place + 5 + width * numbers_at(raw, place + 1, "<i4")
                else:
                    after[which] = place + struct.calcsize(TAG_FORMATS[letter])
                found(which, letter, pa.array([decode_tags(data[a:b])[0][1]["v"] for a, b in zip(at[which], after[which])], pa.string()))
            else:
                raise ValueError(f"unknown tag type {letter}")
        if (after > end[row]).any():
            raise ValueError("the tags of a record are cut off")
        at = after
    if not rows:
        return pa.array([[]] * n, ARROW.field("tags").type)
    owner = np.concatenate(rows)
    order = np.argsort(np.concatenate(keys))  # the place of a tag tells the record too
    two, one = np.full(len(order), 2), np.full(len(order), 1)
    items = pa.StructArray.from_arrays(
        [text_array(np.concatenate(kinds)[order], one), pa.concat_arrays(values).take(pa.array(order))], fields=list(_TAG)
    )
    names = text_array(raw[spread(np.concatenate(keys)[order], two)], two)
    return pa.MapArray.from_arrays(pa.array(offsets_of(np.bincount(owner, minlength=n)).astype(np.int32)), names, items)


def encode_tag(key: str, kind: str, value: str) -> bytes:
    head = key.encode() + kind.encode()
    if kind in "ZH":
        return head + value.encode() + b"\0"
    if kind == "A":
        return head + value.encode()[:1]
    if kind == "B":
        sub, *numbers = value.split(",")
        values = [float(x) if sub in "fd" else int(x) for x in numbers]
        return head + sub.encode() + struct.pack(f"<i{len(values)}{TAG_FORMATS[sub]}", len(values), *values)
    return head + struct.pack("<" + TAG_FORMATS[kind], float(value) if kind in "fd" else int(value))


def encode_record(row, ids: dict[str, int]) -> bytes:
    name = row["qname"].encode() + b"\0"
    cigar = row["cigar"] or []
    seq = "" if row["seq"] == "*" else row["seq"]
    codes = [BASE_LETTERS.find(b) if b in BASE_LETTERS else 15 for b in seq.upper()] + [0] * (len(seq) % 2)
    packed = bytes((codes[i] << 4) | codes[i + 1] for i in range(0, len(codes), 2))
    qual = b"\xff" * len(seq) if row["qual"] == "*" else bytes(ord(q) - 33 for q in row["qual"])
    tid = ids.get(row["rname"], -1)
    mate = tid if row["rnext"] == "=" else ids.get(row["rnext"], -1)
    tags = b"".join(encode_tag(k, v["t"], v["v"]) for k, v in (row["tags"] or {}).items())
    reach = sum(c["len"] for c in cigar if c["op"] in "MDN=X") or 1
    body = struct.pack(
        "<iiBBHHHiiii",
        tid,
        row["pos"],
        len(name),
        row["mapq"],
        coordinate_bin(max(row["pos"], 0), max(row["pos"], 0) + reach),
        len(cigar),
        row["flag"],
        len(seq),
        mate,
        row["pnext"],
        row["tlen"],
    )
    body += name + struct.pack(f"<{len(cigar)}I", *[c["len"] << 4 | CIGAR_LETTERS.index(c["op"]) for c in cigar])
    body += packed + qual + tags
    return struct.pack("<i", len(body)) + body


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a string column, and where each string starts and how long it is."""
    column = column.cast(pa.string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), offsets[:-1], np.diff(offsets)


def list_items(column: pa.Array, *fields: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
    """Number of items of every list or map, and of ``fields``, the columns of all items, those that belong to one."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    lengths = np.where(column.is_null().to_numpy(zero_copy_only=False), 0, np.diff(offsets))
    places = pa.array(spread(offsets[:-1], lengths))
    return lengths, [f.take(places) for f in fields]


def in_range(values: np.ndarray, form: str) -> np.ndarray:
    info = np.iinfo(form)
    if len(values) and not (info.min <= values.min() and values.max() <= info.max):
        raise ValueError(f"a value does not fit into {form}")
    return values.astype(form)


def put(out: np.ndarray, at: np.ndarray, source: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
    """Copy stretches of bytes to the places ``at``."""
    data, starts, lengths = source
    out[spread(at, lengths)] = data[spread(starts, lengths)]


def put_numbers(out: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
    size = values.dtype.itemsize
    out[at[:, None] + np.arange(size)] = np.ascontiguousarray(values).view(np.uint8).reshape(-1, size)


def encode_tags(fields: list[pa.Array]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the tags one after the other, and where each starts and how long it is."""
    key, form, value = fields[0], *fields[1].flatten()
    names, kinds, texts = text_bytes(key), text_bytes(form), text_bytes(value)
    if (names[2] != 2).any() or (kinds[2] != 1).any():
        raise ValueError("a tag needs a name of two letters and a type of one")
    kind, sizes, parts = kinds[0][kinds[1]], texts[2].copy(), []
    for code in np.unique(kind):
        which, letter = np.flatnonzero(kind == code), chr(code)
        if letter in "ZH":
            sizes[which] += 1
        elif letter == "A":
            sizes[which] = np.minimum(sizes[which], 1)
        elif letter in "cCsSiI":
            text, wanted = value.take(pa.array(which)), "<" + TAG_FORMATS[letter]
            numbers = in_range(pc.utf8_ltrim(text, "+").cast(pa.int64()).to_numpy(), wanted)
            sizes[which] = numbers.dtype.itemsize
            parts.append((which, numbers))
        else:
            rare = [encode_tag(k, letter, v)[3:] for k, v in zip(key.take(pa.array(which)).to_pylist(), value.take(pa.array(which)).to_pylist())]
            lengths = np.array([len(r) for r in rare], np.int64)
            sizes[which] = lengths
            parts.append((which, (np.frombuffer(b"".join(rare), np.uint8), offsets_of(lengths)[:-1], lengths)))
    offsets = offsets_of(3 + sizes)
    out, at = np.zeros(offsets[-1], np.uint8), offsets[:-1]
    put(out, at, names)
    put(out, at + 2, kinds)
    plain = np.isin(kind, np.frombuffer(b"ZHA", np.uint8))
    put(out, at[plain] + 3, (texts[0], texts[1][plain], np.minimum(texts[2], sizes)[plain]))
    for which, made in parts:
        if isinstance(made, tuple):
            put(out, at[which] + 3, made)
        else:
            put_numbers(out, at[which] + 3, made)
    return out, at, 3 + sizes


def encode_batch(batch: pa.RecordBatch, ids: dict[str, int]) -> bytes:
    """Records of a batch one after the other, each with its size prefix."""
    if not batch.num_rows:
        return b""
    column = {c: batch.column(c) for c in batch.schema.names}
    lacking = [c for c in ("qname", "flag", "pos", "mapq", "pnext", "tlen", "seq", "qual") if column[c].null_count]
    if lacking:
        raise ValueError(f"null in {', '.join(lacking)}")
    number = lambda c: column[c].cast(pa.int64()).to_numpy()
    name, (bases, base_at, l_seq), (quals, qual_from, l_qual) = (text_bytes(column[c]) for c in ("qname", "seq", "qual"))
    l_seq = np.where((l_seq == 1) & (np.append(bases, 0)[base_at] == ord("*")), 0, l_seq)
    unknown = (l_qual == 1) & (np.append(quals, 0)[qual_from] == ord("*"))
    if (~unknown & (l_qual != l_seq)).any():
        raise ValueError("qualities and bases of a record differ in number")
    half = (l_seq + 1) // 2
    n_cigar, (op, length) = list_items(column["cigar"], *column["cigar"].values.flatten())
    letters, op_at, _ = text_bytes(op)
    code = np.full(256, 255)
    code[np.frombuffer(CIGAR_LETTERS.encode(), np.uint8)] = np.arange(len(CIGAR_LETTERS))
    op = code[letters[op_at]]
    if (op == 255).any():
        raise ValueError("unknown CIGAR operation")
    length = length.cast(pa.int64()).to_numpy()
    n_tags, fields = list_items(column["tags"], column["tags"].keys, column["tags"].items)
    tags, tag_at, tag_size = encode_tags(fields)
    firsts = offsets_of(n_tags)
    tag_ends = np.append(tag_at, len(tags))
    l_tags = tag_ends[firsts[1:]] - tag_ends[firsts[:-1]]

    contig = lambda c: np.array([ids.get(v, -1) for v in c.dictionary.to_pylist()] + [-1])[c.indices.fill_null(-1).to_numpy()]
    mate = column["rnext"].cast(pa.string())
    tid = contig(column["rname"].cast(pa.string()).dictionary_encode())
    mtid = np.where(pc.equal(mate, "=").fill_null(False).to_numpy(zero_copy_only=False), tid, contig(mate.dictionary_encode()))
    begin = np.maximum(number("pos"), 0)
    steps = offsets_of(np.where(np.isin(op, [CIGAR_LETTERS.index(c) for c in "MDN=X"]), length, 0))
    ops_from = offsets_of(n_cigar)
    reach = steps[ops_from[1:]] - steps[ops_from[:-1]]
    last = begin + np.where(reach == 0, 1, reach) - 1
    bins = np.select([begin >> s == last >> s for _, s in LEVELS], [(f + (begin >> s)) & 0xFFFF for f, s in LEVELS], 0)

    size = FIXED.itemsize - 4 + name[2] + 1 + 4 * n_cigar + half + l_seq + l_tags
    values = {"size": size, "tid": tid, "pos": number("pos"), "l_name": name[2] + 1, "mapq": number("mapq"), "bin": bins, "n_cigar": n_cigar}
    values |= {"flag": number("flag"), "l_seq": l_seq, "mtid": mtid, "mpos": number("pnext"), "tlen": number("tlen")}
    fixed = np.zeros(batch.num_rows, FIXED)
    for field, value in values.items():
        fixed[field] = in_range(value, FIXED[field].str)

    offsets = offsets_of(4 + size)
    out, at = np.zeros(offsets[-1], np.uint8), offsets[:-1]
    put_numbers(out, at, fixed)
    at = at + FIXED.itemsize
    put(out, at, name)
    at = at + name[2] + 1
    packed = np.ascontiguousarray(in_range(length << 4 | op, "<u4")).view(np.uint8)
    put(out, at, (packed, 4 * ops_from[:-1], 4 * n_cigar))
    at = at + 4 * n_cigar
    base = np.full(256, 15, np.uint8)
    for i, letter in enumerate(BASE_LETTERS):
        base[[ord(letter), ord(letter.lower())]] = i
    pairs = np.zeros(2 * half.sum(), np.uint8)
    halves = offsets_of(half)[:-1]
    pairs[spread(2 * halves, l_seq)] = base[bases[spread(base_at, l_seq)]]
    put(out, at, (pairs[::2] << 4 | pairs[1::2], halves, half))
    at = at + half
    out[spread(at, np.where(unknown, l_seq, 0))] = 255
    put(out, at, (quals - np.uint8(33), qual_from, np.where(unknown, 0, l_seq)))
    put(out, at + l_seq, (tags, tag_ends[firsts[:-1]], l_tags))
    return out.tobytes()


def coordinate_bin(beg: int, stop: int) -> int:
    """Smallest bin of the five-level scheme around ``[beg, stop)``."""
    for first, shift in LEVELS:
        if beg >> shift == (stop - 1) >> shift:
            return (first + (beg >> shift)) & 0xFFFF
    return 0


def compress_block(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    head = struct.pack("<4BI2BH2sHH", 0x1F, 0x8B, 8, 4, 0, 0, 0xFF, 6, b"BC", 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


class BamWriter(DataSourceArrowWriter):
    def __init__(self, path: str, contigs: list[tuple[str, int]]):
        self.path, self.contigs = path, contigs

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        task = TaskContext.get()
        system, name = open_path(self.path)
        system.create_dir(name, recursive=True)
        # readers see only names that end in .bam: a part gets one when the job commits
        part = f"{name}/_part-{task.partitionId():05d}-{task.taskAttemptId()}"
        text = "".join(f"@SQ\tSN:{c}\tLN:{n}\n" for c, n in self.contigs).encode()
        head = b"BAM\x01" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(self.contigs))
        for c, n in self.contigs:
            head += struct.pack("<i", len(c) + 1) + c.encode() + b"\0" + struct.pack("<i", n)
        ids = {c: i for i, (c, _) in enumerate(self.contigs)}
        with system.open_output_stream(part) as out:
            pending = head
            for batch in iterator:
                pending += encode_batch(batch, ids)
                whole = len(pending) // 60000 * 60000
                for at in range(0, whole, 60000):
                    out.write(compress_block(pending[at : at + 60000]))
                pending = pending[whole:]
            if pending:
                out.write(compress_block(pending))
            out.write(END_BLOCK)
        return BamPart(part)

    def commit(self, messages: list) -> None:
        system, _ = open_path(self.path)
        for message in messages:
            folder, _, part = message.path.rpartition("/")
            system.move(message.path, f"{folder}/{part[1:]}.bam")

    def abort(self, messages: list) -> None:
        system, _ = open_path(self.path)
        for message in messages:
            if message is not None:
                system.delete_file(message.path)


class BamPart(WriterCommitMessage):
    def __init__(self, path: str):
        self.path = path


class BamDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return BamReader(self.options["path"], int(self.options.get("splitbytes", SPLIT_BYTES)))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return BamWriter(self.options["path"], [tuple(c) for c in json.loads(self.options["contigs"])])


def register(spark: SparkSession) -> None:
    """Make the format known to a session.

    The code of this module travels with the jobs, so that executors need not
    have the package installed.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(BamDataSource)
