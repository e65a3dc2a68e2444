"""BAM as a Python data source, decoded from the public SAM/BAM specification.

A file is read in ranges of its blocks, one task each. A task finds the first block that begins in its range, and the first record
that begins there by checking the fixed fields of the records that would follow; it decodes the records that begin in its range, in Arrow
batches. A record's position is its virtual offset (the block's place and the place in the block), so no task has to count those before it.
"""

from __future__ import annotations

import bisect
import re
import struct
import zlib
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from readloom.sources.files import file_system

# Fixed values of the format.
MAGIC = b"\x1f\x8b\x08\x04"
BASES = "=ACMGRSVTWYHKDBN"
LETTERS = str.maketrans("0123456789abcdef", BASES)
FLAGS = {"PAIRED": 1, "PROPER_PAIRED": 2, "UNMAPPED": 4, "MATE_UNMAPPED": 8, "REVERSE": 16, "MATE_REVERSE": 32, "FIRST_IN_TEMPLATE": 64, "LAST_IN_TEMPLATE": 128, "SECONDARY": 256, "QUALITY_FAILED": 512, "DUPLICATE": 1024, "SUPPLEMENTARY": 2048}
NUMBERS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
#: The fields of a projected record, in order.
FIELDS = (
    "QNAME", "QUAL", "REVERSE", "MATE_REVERSE", "PAIRED", "PROPER_PAIRED", "PAIR_ORIENTATION", "UNMAPPED", "MATE_UNMAPPED", "FIRST_IN_TEMPLATE", "LAST_IN_TEMPLATE", "STRAND", "MAPQ", "POS", "MATE_POS", "SEQ", "SEQ_LEN",
    "INSERT_SIZE", "QUALITY_FAILED", "SECONDARY", "DUPLICATE", "SUPPLEMENTARY", "NH", "HI", "AS", "GN", "TX", "AN", "nM", "fx", "RE", "CR", "CY", "CB", "UR", "UY", "UB", "SKIP_ALIGN",
)
#: Bytes of a file that one task reads, and records in a batch.
SPLIT, BATCH = 1 << 26, 4096
#: To tell where a block or record begins: blocks and records that must follow, and inflated bytes that are looked at (more for records of that size).
CHAIN, ENOUGH, WINDOW, WIDEST = 64, 3, 1 << 18, 1 << 26
SCHEMA = "file string, file_pos long, qname string, flag int, ref_id int, pos int, mapq int, cigar string, mate_ref int, mate_pos int, insert_size int, seq string, quality array<int>, tags map<string,string>, texts array<string>"


def blocks(f, at: int = 0):
    """(place in the file, inflated data) of the blocks of a BGZF stream that stands at ``at``."""
    while head := f.read(18):
        if len(head) < 18 or head[:4] != MAGIC:
            raise ValueError("not a BGZF block")
        extra = struct.unpack("<H", head[10:12])[0]
        rest = head[12:] + f.read(extra - 6)
        size = block_size(rest)
        data = f.read(size - 12 - extra)
        yield at, zlib.decompress(data[:-8], -15)
        at += size


def block_size(extra: bytes) -> int:
    """The size of a block by its extra fields."""
    while extra:
        tag, n = extra[:2], struct.unpack("<H", extra[2:4])[0]
        if tag == b"BC":
            return struct.unpack("<H", extra[4:6])[0] + 1
        extra = extra[4 + n :]
    raise ValueError("a BGZF block without its size")


def first_block(f, low: int, size: int) -> int:
    """The place of the first block that begins at ``low`` or later: its magic number, and those of the blocks that it leads to. ``size`` if there is none."""
    if not low:
        return 0

    def leads_on(at: int) -> bool:
        for _ in range(CHAIN):
            if at == size:
                return True
            f.seek(at)
            head = f.read(18)
            if len(head) < 18 or head[:4] != MAGIC:
                return False
            try:
                at += block_size(head[12:] + f.read(struct.unpack("<H", head[10:12])[0] - 6))
            except (ValueError, struct.error):
                return False
        return True

    f.seek(low)
    data = f.read(2 << 16)  # no block is longer than 1 << 16
    at = data.find(MAGIC)
    while at >= 0 and not leads_on(low + at):
        at = data.find(MAGIC, at + 1)
    return low + at if at >= 0 else size


class Stream:
    """Inflated data from a block on, and the virtual offset of each place in it."""

    def __init__(self, f, at: int = 0) -> None:
        self.source, self.data, self.at, self.done = blocks(f, at), b"", 0, 0
        self.starts, self.places = [], []  # of the blocks in data, counted from where the stream began

    def fill(self, n: int) -> bool:
        """Have n bytes at hand, if the file has them."""
        parts, have = [], len(self.data) - self.at
        while have < n:
            place, more = next(self.source, (None, b""))
            if place is None:
                break
            self.starts.append(self.done + self.at + have)
            self.places.append(place)
            parts.append(more)
            have += len(more)
        if parts:
            self.data, self.done, self.at = b"".join([self.data[self.at :], *parts]), self.done + self.at, 0
        return have >= n

    def take(self, n: int) -> bytes:
        if not self.fill(n):
            if self.at < len(self.data):
                raise ValueError("the file ends within a record")
            return b""
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self) -> int:
        return struct.unpack("<i", self.take(4))[0]

    def offset(self) -> int:
        """The virtual offset of the next byte."""
        self.fill(1)
        at = self.done + self.at
        k = bisect.bisect_right(self.starts, at) - 1
        del self.starts[:k], self.places[:k]
        return (self.places[0] << 16) + at - self.starts[0]

    def header(self) -> int:
        """Skip the header; the number of its references."""
        if self.take(4) != b"BAM\x01":
            raise ValueError("not a BAM file")
        self.take(self.number())
        n = self.number()
        for _ in range(n):
            self.take(self.number())
            self.take(4)
        return n

    def find_record(self, references: int) -> None:
        """Go on to the first place from which records follow each other; to the file's end if there is none."""
        window = WINDOW
        ended = not self.fill(window)
        at = self.at
        while at < len(self.data):
            found = follows(self.data, at, references, ended)
            if found:
                self.at = at
                return
            if found is None and window < WIDEST:  # too little is at hand to tell
                window *= 4
                at -= self.at
                ended = not self.fill(window)
                at += self.at
            else:
                at += 1
        self.at = len(self.data)


def follows(data: bytes, at: int, references: int, ended: bool) -> bool | None:
    """Whether ENOUGH records, or all until the file's end, follow each other from a place on, by their fixed fields, names, operations and tags; None if data is too short to tell."""
    for n in range(ENOUGH):
        if ended and at == len(data):
            return n > 0
        if at + 36 > len(data):
            return False if ended else None
        size, ref, pos, l_name, n_cigar, bases, mate_ref, mate_pos = struct.unpack_from("<iiiBxxxHxxiii", data, at)
        rest = at + 36 + l_name + 4 * n_cigar + (bases + 1) // 2 + bases
        end = at + 4 + size
        if not (-1 <= ref < references and -1 <= mate_ref < references and pos >= -1 and mate_pos >= -1 and l_name and bases >= 0 and rest <= end):
            return False
        name = data[at + 36 : at + 36 + l_name]
        if len(name) == l_name and (name[-1] or not all(33 <= c <= 126 for c in name[:-1])):
            return False
        if any(c & 15 > 8 for c in data[at + 36 + l_name : at + 36 + l_name + 4 * n_cigar : 4]):
            return False
        if end > len(data):
            return False if ended else None
        try:
            tags_of(data[rest:end])
        except (struct.error, ValueError, KeyError, IndexError, UnicodeDecodeError):
            return False
        at = end
    return True


def tags_of(data: bytes) -> tuple[dict[str, str], list[str]]:
    """All tags as text, and the names of those that are text."""
    out, texts, at = {}, [], 0
    while at < len(data):
        name, kind, at = data[at : at + 2].decode(), chr(data[at + 2]), at + 3
        if kind == "A":
            value, at = chr(data[at]), at + 1
        elif kind in "ZH":
            end = data.index(0, at)
            value, at = data[at:end].decode("utf-8", "replace"), end + 1
            if kind == "Z":
                texts.append(name)
        elif kind == "B":
            sub, n = chr(data[at]), struct.unpack_from("<I", data, at + 1)[0]
            form = f"<{n}{NUMBERS[sub]}"
            value, at = ",".join(map(str, struct.unpack_from(form, data, at + 5))), at + 5 + struct.calcsize(form)
        else:
            form = "<" + NUMBERS[kind]
            value, at = str(struct.unpack_from(form, data, at)[0]), at + struct.calcsize(form)
        out[name] = value
    return out, texts


def records(f, low: int = 0, high: int | None = None, size: int | None = None):
    """Decoded alignments that begin in the blocks from ``low`` to before ``high`` of a file of ``size`` bytes, without its name; a record that can't be decoded is left out."""
    references = Stream(f).header()
    if low:
        start = first_block(f, low, size)
        if start >= min(high, size):
            return
        f.seek(start)
        s = Stream(f, start)
        s.find_record(references)
    else:
        f.seek(0)
        s = Stream(f)
        s.header()
    while s.fill(1):
        at = s.offset()
        if high is not None and at >> 16 >= high:
            return
        data = s.take(s.number())
        try:
            ref, pos, l_name, mapq, _, n_cigar, flag, n, mate_ref, mate_pos, insert = struct.unpack_from("<iiBBHHHiiii", data)
            k = 32 + l_name
            ops = struct.unpack_from(f"<{n_cigar}I", data, k)
            k += 4 * n_cigar
            packed, k = data[k : k + (n + 1) // 2], k + (n + 1) // 2
            bases = packed.hex().translate(LETTERS)[:n]
            quality = None if not n or data[k] == 255 else list(data[k : k + n])
            yield at, data[32 : 31 + l_name].decode(), flag, ref, pos, mapq, "".join(f"{o >> 4}{'MIDNSHP=X'[o & 15]}" for o in ops), mate_ref, mate_pos, insert, bases, quality, *tags_of(data[k + n :])
        except (struct.error, ValueError, KeyError, IndexError, UnicodeDecodeError):
            continue


def encoded(rows, references=(), size: int = 60000):
    """The blocks of a BAM file of (qname, flag, ref_id, pos, mapq, cigar, mate_ref, mate_pos, insert_size, seq, quality, tags) rows, tags as strings; ``size`` bytes to a block."""

    def block(part: bytes) -> bytes:
        packer = zlib.compressobj(6, zlib.DEFLATED, -15)
        raw = packer.compress(part) + packer.flush()
        return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(raw) + 25) + raw + struct.pack("<II", zlib.crc32(part), len(part))

    body = b"BAM\x01" + struct.pack("<ii", 0, len(references))
    for name, n in references:
        body += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", n)
    for qname, flag, ref, pos, mapq, cigar, mate_ref, mate_pos, insert, seq, quality, tags in rows:
        ops = [(int(a) << 4) | "MIDNSHP=X".index(b) for a, b in re.findall(r"(\d+)([MIDNSHP=X])", cigar)]
        codes = [BASES.index(b) for b in seq] + [0] * (len(seq) % 2)
        data = struct.pack("<iiBBHHHiiii", ref, pos, len(qname) + 1, mapq, 0, len(ops), flag, len(seq), mate_ref, mate_pos, insert) + qname.encode() + b"\0" + struct.pack(f"<{len(ops)}I", *ops)
        data += bytes((a << 4) | b for a, b in zip(codes[::2], codes[1::2])) + (bytes(quality) if quality is not None else b"\xff" * len(seq))
        data += b"".join(k.encode() + b"Z" + v.encode() + b"\0" for k, v in tags.items())
        body += struct.pack("<i", len(data)) + data
        while len(body) >= size:
            yield block(body[:size])
            body = body[size:]
    if body:
        yield block(body)
    yield block(b"")


def encode(rows, references=(), size: int = 60000) -> bytes:
    return b"".join(encoded(rows, references, size))


class _Range(InputPartition):
    def __init__(self, uri: str, low: int, high: int, size: int) -> None:
        super().__init__((uri, low, high, size))


class _Reader(DataSourceReader):
    def __init__(self, path: str, split: int) -> None:
        self.path, self.split = path, split

    def partitions(self):
        from pyarrow import fs

        system, base = file_system(self.path)
        info = system.get_file_info(base)
        found = [info] if info.type == fs.FileType.File else sorted((x for x in system.get_file_info(fs.FileSelector(base)) if x.path.endswith(".bam")), key=lambda x: x.path)
        head = self.path.split(base)[0] if ":" in self.path else "file://"
        return [_Range(head + x.path, low, low + self.split, x.size) for x in found for low in range(0, x.size, self.split)]

    def read(self, partition):
        import pyarrow as pa

        path, low, high, size = partition.value
        uri = re.sub("^file:/+", "file:///", path)
        system, base = file_system(uri)
        kinds = [pa.string(), pa.int64(), pa.string(), *[pa.int32()] * 4, pa.string(), *[pa.int32()] * 3, pa.string(), pa.list_(pa.int32()), pa.map_(pa.string(), pa.string()), pa.list_(pa.string())]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        with system.open_input_file(base) as f:
            found = records(f, low, high, size)
            while rows := list(islice(found, BATCH)):
                cols = list(zip(*rows))
                cols[12] = [list(x.items()) for x in cols[12]]
                yield pa.RecordBatch.from_arrays([pa.array([uri] * len(rows), kinds[0]), *[pa.array(c, k) for c, k in zip(cols, kinds[1:])]], names=names)


class BamSource(DataSource):
    """``spark.read.format("bam").load(path)``: path is a file, or a folder of .bam files. The option ``split`` sets the bytes of a file that a task reads."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("split", SPLIT)))


def read_bam(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    spark.dataSource.register(BamSource)
    return spark.read.format("bam").option("split", split).load(path)


def project(rows: DataFrame, texts_only: bool = False) -> DataFrame:
    """The FIELDS of each record as strings: the tag of that name (only if it is text, if asked), else the record's own value, else empty; with file and file_pos."""
    flag = lambda name: F.when(F.col("flag").bitwiseAND(FLAGS[name]) != 0, "true").otherwise("false")
    own = {name: flag(name) for name in FLAGS}
    reverse, mate_reverse = F.col("flag").bitwiseAND(16) != 0, F.col("flag").bitwiseAND(32) != 0
    text = lambda c: F.col(c).cast("string")
    own |= {"QNAME": F.col("qname"), "QUAL": F.array_join(F.transform(F.coalesce("quality", F.array().cast("array<int>")), lambda q: F.char(q + 33)), ""), "STRAND": F.when(reverse, "-").otherwise("+"), "MAPQ": text("mapq"), "POS": text("pos"), "MATE_POS": text("mate_pos"), "SEQ": F.col("seq"), "SEQ_LEN": F.length("seq").cast("string"), "INSERT_SIZE": text("insert_size")}
    side = lambda back: F.when(back, "R").otherwise("F")
    paired = (F.col("flag").bitwiseAND(1) != 0) & (F.col("flag").bitwiseAND(12) == 0) & (F.col("ref_id") == F.col("mate_ref"))
    own["PAIR_ORIENTATION"] = F.when(paired, F.concat(side(F.when(F.col("pos") <= F.col("mate_pos"), reverse).otherwise(mate_reverse)), F.lit("1"), side(F.when(F.col("pos") <= F.col("mate_pos"), mate_reverse).otherwise(reverse)), F.lit("2"))).otherwise("")
    tag = lambda name: F.when(F.array_contains("texts", name), F.col("tags")[name]) if texts_only else F.col("tags")[name]
    return rows.select("file", "file_pos", *[F.coalesce(tag(name), own.get(name, F.lit("")), F.lit("")).alias(name) for name in FIELDS], "quality")
