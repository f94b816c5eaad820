"""Block-gzipped, position-indexed BED files as a Spark source and sink.

A block-gzipped file is a chain of gzip members of at most 64 KiB of text, each of which tells its own length, so it can be
read from any member on. The source deals one file to many tasks by ranges of virtual offsets (member's place in the
file, place in its text), and, where a .tbi index lies beside the file, drops the ranges that can't hold a wanted
chromosome or interval before any task starts. The sink writes such files, and an index beside each.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Fixed values of the public BGZF and tabix formats: a member's first bytes, the empty member at a file's end, an index's
#: first bytes, its preset for BED files (columns from 1, comment character, lines to skip), and its bins: the smallest
#: hold 2**14 positions, and each of five levels above eight times as many.
MAGIC = b"\x1f\x8b\x08\x04"
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
INDEX_MAGIC, BED_PRESET = b"TBI\x01", (0x10000, 1, 2, 3, ord("#"), 0)
SMALLEST, LEVELS = 14, 5

TEXT_BYTES, SPLIT_BYTES = 65_280, 64 << 20


@dataclass
class Range:
    """Lines of a file that begin at first or after, and before last, or at last too where `through`; where not `whole`, first may be within a line."""

    path: str
    first: int
    last: int
    whole: bool
    through: bool


@dataclass
class Task(InputPartition):
    """Ranges that one task reads."""

    ranges: list[Range]


def _filesystem(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file://"):
        path = path.removeprefix("file:")
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path)


def _open(path: str):
    fs, at = _filesystem(path)
    return fs.open_input_file(at)


def _member_length(head: bytes) -> int:
    """A member's bytes from its first 18, or 0 where it is none."""
    return struct.unpack_from("<H", head, 16)[0] + 1 if len(head) >= 18 and head[:4] == MAGIC and head[10:16] == b"\x06\x00BC\x02\x00" else 0


def is_bgzf(path: str) -> bool:
    with _open(path) as f:
        return _member_length(f.read(18)) > 0


def _members(f, at: int) -> Iterator[tuple[int, bytes]]:
    """Place and text of the members from a member's place on."""
    f.seek(at)
    held = b""
    while True:
        length = _member_length(held[:18])
        if not length or len(held) < length:
            more = f.read(1 << 20)
            if not more:
                if held:
                    raise OSError(f"broken block-gzip member at {at}")
                return
            held += more
            continue
        text = zlib.decompress(held[18 : length - 8], -15)
        if text:
            yield at, text
        held, at = held[length:], at + length


def _next_member(f, at: int, size: int) -> int:
    """The first place from `at` on where a member begins that is followed by another or by the file's end."""
    f.seek(at)
    held = f.read(2 << 16) + b""
    i = held.find(MAGIC)
    while i >= 0:
        length = _member_length(held[i : i + 18])
        if length and (at + i + length == size or _member_length(held[i + length : i + length + 18])):
            return at + i
        i = held.find(MAGIC, i + 1)
    return size


def compressed(text: bytes) -> bytes:
    """text, at most TEXT_BYTES of it, as one member."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(text) + deflate.flush()
    return MAGIC + b"\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(text), len(text))


def _bin(lo: int, hi: int) -> int:
    """The smallest bin that holds [lo, hi)."""
    hi = max(hi - 1, lo)
    for level in range(LEVELS, 0, -1):
        shift = SMALLEST + 3 * (LEVELS - level)
        if lo >> shift == hi >> shift:
            return ((1 << 3 * level) - 1) // 7 + (lo >> shift)
    return 0


def _bins(lo: int, hi: int) -> set[int]:
    """All bins that may hold what overlaps [lo, hi)."""
    hi, out = max(hi - 1, lo), set()
    for level in range(LEVELS + 1):
        shift, first = SMALLEST + 3 * (LEVELS - level), ((1 << 3 * level) - 1) // 7
        out.update(range(first + (lo >> shift), first + (hi >> shift) + 1))
    return out


class Index:
    """For each chromosome: bins, ranges of virtual offsets by bin, and the first offset of what reaches each 2**14 positions."""

    def __init__(self):
        self.chromosomes: dict[str, tuple[dict[int, list[list[int]]], list[int]]] = {}

    def add(self, chrom: str, lo: int, hi: int, first: int, last: int) -> None:
        """A line's virtual offsets; lines come in order of the file."""
        bins, reach = self.chromosomes.setdefault(chrom, ({}, []))
        chunks = bins.setdefault(_bin(lo, hi), [])
        if chunks and chunks[-1][1] == first:
            chunks[-1][1] = last
        else:
            chunks.append([first, last])
        to = max(hi - 1, lo) >> SMALLEST
        reach.extend([0] * (to + 1 - len(reach)))
        for i in range(lo >> SMALLEST, to + 1):
            reach[i] = reach[i] or first + 1  # from 1, so that 0 says nothing yet

    def to_bytes(self) -> bytes:
        names = b"".join(c.encode() + b"\0" for c in self.chromosomes)
        out = [INDEX_MAGIC, struct.pack("<8i", len(self.chromosomes), *BED_PRESET, len(names)), names]
        for bins, reach in self.chromosomes.values():
            out.append(struct.pack("<i", len(bins)))
            for b, chunks in sorted(bins.items()):
                out.append(struct.pack("<Ii", b, len(chunks)) + b"".join(struct.pack("<QQ", *c) for c in chunks))
            filled, last = [], 0
            for x in reach:
                last = x - 1 if x else last
                filled.append(last)
            out.append(struct.pack(f"<i{len(filled)}Q", len(filled), *filled))
        text = b"".join(out)
        return b"".join(compressed(text[i : i + TEXT_BYTES]) for i in range(0, len(text), TEXT_BYTES)) + END

    @staticmethod
    def read(path: str) -> Index | None:
        """The index beside a file, if there is one."""
        try:
            with _open(path + ".tbi") as f:
                text = b"".join(t for _, t in _members(f, 0))
        except FileNotFoundError:
            return None
        out, at = Index(), 36
        n, length = struct.unpack_from("<i", text, 4)[0], struct.unpack_from("<i", text, 32)[0]
        names = text[at : at + length].split(b"\0")[:n]
        at += length
        for name in names:
            bins, count = {}, struct.unpack_from("<i", text, at)[0]
            at += 4
            for _ in range(count):
                b, chunks = struct.unpack_from("<Ii", text, at)
                bins[b] = [list(struct.unpack_from("<QQ", text, at + 8 + 16 * i)) for i in range(chunks)]
                at += 8 + 16 * chunks
            count = struct.unpack_from("<i", text, at)[0]
            reach = list(struct.unpack_from(f"<{count}Q", text, at + 4))
            at += 4 + 8 * count
            out.chromosomes[name.decode()] = (bins, reach)
        return out

    def ranges(self, chroms: list[str] | None, lo: int, hi: int) -> list[tuple[int, int]]:
        """Ranges of virtual offsets, in order and apart, that hold all that overlaps [lo, hi) of the chromosomes (all where None)."""
        found = []
        for chrom in self.chromosomes if chroms is None else chroms:
            bins, reach = self.chromosomes.get(chrom, ({}, []))
            least = reach[min(lo >> SMALLEST, len(reach) - 1)] if reach else 0
            wanted = _bins(lo, min(hi, 1 << 29)) if hi - lo < 1 << 24 else None
            for b, chunks in bins.items():
                if b < 37450 and (wanted is None or b in wanted):  # bins beyond are summaries
                    found += [(max(c[0], 0), c[1]) for c in chunks if c[1] > least]
        out: list[tuple[int, int]] = []
        for first, last in sorted(found):
            if out and first >> 16 <= out[-1][1] >> 16:
                out[-1] = (out[-1][0], max(out[-1][1], last))
            else:
                out.append((first, last))
        return out


_TESTS = {EqualTo: pc.equal, GreaterThan: pc.greater, GreaterThanOrEqual: pc.greater_equal, LessThan: pc.less, LessThanOrEqual: pc.less_equal}


class _Wanted:
    """What filters on chrom, lo and hi ask for: as bounds that choose ranges, and as tests of rows."""

    def __init__(self):
        self.chroms: list[str] | None = None
        self.lo, self.hi = 0, 1 << 40
        self.tests: list[tuple] = []

    def take(self, f) -> bool:
        """Whether rows are tested by f from now on."""
        name = getattr(f, "attribute", ())
        if name not in (("chrom",), ("lo",), ("hi",)) or type(f) not in (*_TESTS, In, IsNotNull):
            return False
        self.tests.append((name[0], type(f), list(f.value) if isinstance(f, In) else getattr(f, "value", None)))
        if name == ("chrom",) and isinstance(f, (EqualTo, In)):
            values = [f.value] if isinstance(f, EqualTo) else list(f.value)
            self.chroms = [v for v in values if self.chroms is None or v in self.chroms]
        elif name == ("hi",) and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
            self.lo = max(self.lo, int(f.value) - isinstance(f, GreaterThanOrEqual))
        elif name == ("lo",) and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
            self.lo = max(self.lo, int(f.value))
        elif name == ("lo",) and isinstance(f, (LessThan, LessThanOrEqual)):
            self.hi = min(self.hi, int(f.value) + isinstance(f, LessThanOrEqual))
        return True

    def of(self, rows: pa.Table) -> pa.Table:
        for name, kind, value in self.tests:
            column = rows.column(name)
            keep = column.is_valid() if kind is IsNotNull else pc.is_in(column, pa.array(value, column.type)) if kind is In else _TESTS[kind](column, pa.scalar(value, column.type if name == "chrom" else pa.int64()))
            rows = rows.filter(keep)
        return rows


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], schema: StructType, split: int):
        self.paths, self.schema, self.split, self.wanted = paths, schema, split, _Wanted()

    def pushFilters(self, filters):
        """Filters on chrom, lo and hi choose ranges by the index, and are applied to what is read."""
        return [f for f in filters if not self.wanted.take(f)]

    def _ranges(self) -> Iterator[Range]:
        w = self.wanted
        asked = w.chroms is not None or w.lo > 0 or w.hi < 1 << 40
        for path in self.paths:
            index = Index.read(path) if asked else None
            with _open(path) as f:
                size = f.size()
                for first, last in [(0, size << 16)] if index is None else index.ranges(w.chroms, w.lo, w.hi):
                    whole, cut = True, (first >> 16) + self.split
                    while cut < last >> 16:
                        to = _next_member(f, cut, size) << 16
                        if to >= last:
                            break
                        yield Range(path, first, to, whole, True)
                        first, whole, cut = to, False, (to >> 16) + self.split
                    yield Range(path, first, last, whole, False)

    def partitions(self):
        """Ranges of `split` bytes, or several small ones of as much together."""
        tasks, held = [], self.split
        for r in self._ranges():
            size = (r.last >> 16) - (r.first >> 16) + TEXT_BYTES // 4
            if held + size > self.split:
                tasks.append(Task([]))
                held = 0
            tasks[-1].ranges.append(r)
            held += size
        return tasks or [Task([])]

    def read(self, partition: Task):
        schema = to_arrow_schema(self.schema)
        for r in partition.ranges:
            with _open(r.path) as f:
                for text in _lines(f, r):
                    yield from self.wanted.of(_parsed(text, schema)).to_batches()


def _lines(f, p: Range) -> Iterator[bytes]:
    """The range's lines, whole and some members' at a time.

    A line belongs to the range in which its first byte lies. A range that begins at a cut leaves out what comes before the
    first line's end: the range before it reads the line that crosses the cut, or begins at it.
    """
    last, stop = p.last >> 16, p.last & 0xFFFF
    skipping, ending, held = not p.whole, False, b""
    for at, text in _members(f, p.first >> 16):
        begin = p.first & 0xFFFF if at == p.first >> 16 else 0
        if skipping:
            begin = text.find(b"\n", begin) + 1
            if not begin:
                continue
            skipping = False
            if (at, begin) > (last, stop) or ((at, begin) == (last, stop) and not p.through):
                return
        end = len(text)
        if at >= last or ending:
            # the line before `stop`, or that at it where through, ends at the first line end from here on
            least = 0 if ending else (stop if at == last else 0) - (not p.through)
            if least < 0:
                break
            end = text.find(b"\n", max(least, begin)) + 1
            ending = not end
            held += text[begin : end or len(text)]
            if not ending:
                break
            continue
        held += text[begin:end]
        if len(held) > 4 << 20:
            whole = held.rfind(b"\n") + 1
            if whole:
                yield held[:whole]
                held = held[whole:]
    if held:
        yield held


def _parsed(text: bytes, schema: pa.Schema) -> pa.Table:
    """Tab-separated lines as columns, those beyond the schema's left out; blank and # lines are skipped."""
    if text.startswith((b"#", b"\n", b"\r")) or b"\n#" in text:
        text = b"".join(x for x in text.splitlines(True) if not x.startswith(b"#") and x.strip())
    if not text.strip():
        return schema.empty_table()
    more = text.split(b"\n", 1)[0].count(b"\t") + 1 - len(schema)
    names = [*schema.names, *(f"_{i}" for i in range(more))]
    convert = pyarrow.csv.ConvertOptions(column_types=schema, include_columns=schema.names, strings_can_be_null=False, null_values=["", "."])
    return pyarrow.csv.read_csv(io.BytesIO(text), pyarrow.csv.ReadOptions(column_names=names, use_threads=False), pyarrow.csv.ParseOptions(delimiter="\t", quote_char=False), convert)


class _Writer(DataSourceArrowWriter):
    """A file and its index for each task, in a folder beside the others until all tasks have ended."""

    def __init__(self, path: str):
        self.path, self.job = path.rstrip("/"), f"_unfinished-{uuid.uuid4().hex}"

    def write(self, iterator):
        fs, base = _filesystem(self.path)
        name = f"part-{uuid.uuid4().hex}.bed.gz"
        fs.create_dir(f"{base}/{self.job}")
        index, lines = Index(), 0
        with fs.open_output_stream(f"{base}/{self.job}/{name}", compression=None) as out:
            held, at = bytearray(), 0

            def flush() -> None:
                nonlocal at
                if held:
                    at += out.write(compressed(bytes(held)))
                    held.clear()

            for batch in iterator:
                body = io.BytesIO()
                pyarrow.csv.write_csv(pa.Table.from_batches([batch]), body, pyarrow.csv.WriteOptions(include_header=False, delimiter="\t", quoting_style="none"))
                for line, chrom, lo, hi in zip(body.getvalue().splitlines(True), *(batch.column(c).to_pylist() for c in ("chrom", "lo", "hi"))):
                    if len(held) + len(line) > TEXT_BYTES:
                        flush()
                    first = at << 16 | len(held)
                    for i in range(0, len(line), TEXT_BYTES):  # one piece but for very long lines
                        if len(held) + len(line[i : i + TEXT_BYTES]) > TEXT_BYTES:
                            flush()
                        held += line[i : i + TEXT_BYTES]
                    if len(held) == TEXT_BYTES:
                        flush()
                    index.add(chrom, lo, hi, first, at << 16 | len(held))
                    lines += 1
            flush()
            out.write(END)
        with fs.open_output_stream(f"{base}/{self.job}/{name}.tbi", compression=None) as out:
            out.write(index.to_bytes())
        return _Written(name if lines else None)

    def commit(self, messages) -> None:
        fs, base = _filesystem(self.path)
        for m in messages:
            if m is not None and m.name:
                for end in (".tbi", ""):
                    fs.move(f"{base}/{self.job}/{m.name}{end}", f"{base}/{m.name}{end}")
        self.abort(messages)

    def abort(self, messages) -> None:
        fs, base = _filesystem(self.path)
        if fs.get_file_info(f"{base}/{self.job}").type != pyarrow.fs.FileType.NotFound:
            fs.delete_dir(f"{base}/{self.job}")


@dataclass
class _Written(WriterCommitMessage):
    name: str | None


class BedSource(DataSource):
    """format("bgzf_bed"): options paths (one a line, or path for what is written), split (bytes of file a task, at most that and a member)."""

    @classmethod
    def name(cls) -> str:
        return "bgzf_bed"

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options["paths"].split("\n"), schema, int(self.options.get("split", SPLIT_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"])


def _files(path: str) -> list[str]:
    fs, at = _filesystem(path)
    if fs.get_file_info(at).type != pyarrow.fs.FileType.Directory:
        return [path]
    inside = fs.get_file_info(pyarrow.fs.FileSelector(at))
    return sorted(f"{path.rstrip('/')}/{x.base_name}" for x in inside if x.base_name.endswith(".gz"))


def first_line(path: str) -> str | None:
    """The first line that isn't blank or a comment."""
    for name in _files(path):
        with _open(name) as f:
            for text in _lines(f, Range(name, 0, f.size() << 16, True, False)):
                for line in text.decode().splitlines():
                    if line.strip() and not line.startswith("#"):
                        return line
    return None


def read_bgzf(spark: SparkSession, path: str, schema: StructType, split: int = SPLIT_BYTES) -> DataFrame:
    """The first columns, by schema, of a block-gzipped file or of a folder's .gz files of that kind.

    A file is dealt to tasks by `split` bytes. Filters on chrom (equal, in) and bounds on lo and hi choose ranges by the .tbi
    index beside a file, where there is one. Files without lines: no rows. Chromosomes up to 2**29 positions.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BedSource)
    files = _files(path)
    if not files:
        return spark.createDataFrame([], schema)
    return spark.read.format("bgzf_bed").schema(schema).option("paths", "\n".join(files)).option("split", split).load()


def write_bgzf(df: DataFrame, path: str) -> None:
    """Columns of df, of which chrom, lo and hi are the first, as block-gzipped files and their indexes in a new folder.

    Rows are dealt by ranges of chromosome and place and sorted, so each file covers a stretch of its own. A null is a dot, a row without chromosome an error.
    """
    if df.columns[:3] != ["chrom", "lo", "hi"]:
        raise ValueError("chrom, lo and hi come first")
    df.sparkSession.dataSource.register(BedSource)
    text = [c for c, kind in df.dtypes if kind == "string" and c != "chrom"]
    dealt = df.fillna(".", text).repartitionByRange("chrom", "lo", "hi").sortWithinPartitions("chrom", "lo", "hi")
    dealt.write.format("bgzf_bed").mode("append").save(path)
