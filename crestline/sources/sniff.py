"""What a file holds, told by its first bytes and not by its name."""

from __future__ import annotations

import zlib

from pyarrow import fs as pafs

from crestline.sources.bam import Blocks, block_size, open_path

HEAD = 1 << 16


def first_file(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and name of a file, or of the first visible one of a folder."""
    system, name = open_path(path)
    info = system.get_file_info(name)
    if info.type == pafs.FileType.Directory:
        inside = sorted(f.path for f in system.get_file_info(pafs.FileSelector(name)) if f.is_file and f.base_name[0] not in "._")
        if not inside:
            raise ValueError(f"{path} holds no file")
        return system, inside[0]
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    return system, name


def sniff(path: str) -> tuple[str, str]:
    """(format, compression): sam, bam, cram, vcf, bcf, bed or text; bgzf, gzip or none."""
    system, name = first_file(path)
    with system.open_input_file(name) as handle:
        head, packing = handle.read(HEAD), "none"
        if block_size(head):
            packing, block = "bgzf", Blocks(handle, 0, handle.size()).next()
            head = block[1] if block else b""
        elif head[:2] == b"\x1f\x8b":
            packing, head = "gzip", zlib.decompressobj(31).decompress(head, HEAD)
    # fixed values: magic bytes of the formats
    for magic, kind in ((b"BAM\x01", "bam"), (b"CRAM", "cram"), (b"BCF\x02", "bcf"), (b"BCF\x04", "bcf"), (b"##fileformat=VCF", "vcf")):
        if head.startswith(magic):
            return kind, packing
    line = head.split(b"\n")[0]
    if line[:4] in (b"@HD\t", b"@SQ\t", b"@RG\t", b"@PG\t", b"@CO\t"):
        return "sam", packing
    fields = line.rstrip(b"\r").split(b"\t")
    if len(fields) >= 11 and fields[1].isdigit() and fields[3].isdigit() and fields[4].isdigit():
        return "sam", packing
    if len(fields) >= 3 and fields[1].isdigit() and fields[2].isdigit():
        return "bed", packing
    return "text", packing
