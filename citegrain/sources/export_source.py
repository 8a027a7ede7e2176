"""Export files as a data source: spark.read.format("citation_export").load(path).

A file is cut into ranges of bytes, and a range is read by one task: from the first record that starts in it to the first that
starts behind it. Records start with a tag at the start of a line (RIS, field lists), with an entry (BibTeX) or with a line
(tab-delimited); a CSV file may have line ends within quotes, so it is one range, and is read as a stream, as is a file in
UTF-16. No file is held whole. Files are found and opened by pyarrow's file systems (local, HDFS, object stores).

Rows have the raw fields of sources.exports, the file's name and the place (pos) of the record: its byte in the file, or its
number in one that is read as a stream. read() gives the records with normal fields.

A record that is not UTF-8 is read as Latin-1 by itself; exports.read_exports() does so for whole files.
"""

from __future__ import annotations

import io
import re
import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import exports

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of a range, and those that are read at a time.
RANGE, CHUNK = 16 * 1024 * 1024, 1024 * 1024
#: What a record starts with, at the start of a line.
STARTS = {"ris": rb"TY  - ", "bibtex": rb"@\w+\s*\{", "wos_plain": rb"PT ", "wos_tab": rb"[^\r\n]"}


class Range(InputPartition):
    def __init__(self, path: str, kind: str, start: int, end: int, stream: bool):
        self.path, self.kind, self.start, self.end, self.stream = path, kind, start, end, stream


def _opened(path: str):
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def records_of(read, size: int, kind: str, start: int, end: int):
    """(place, bytes) of the records that start in a range of bytes; read(at, n) gives n bytes from a place on."""
    opening = re.compile(rb"(?:\A(?:\xef\xbb\xbf)?|(?<=\n))" + STARTS[kind])
    at = max(0, start - 1)  # a record may start right behind a line's end
    held, base, begun = b"", at, None
    while True:
        more = read(at, min(CHUNK, size - at)) if at < size else b""
        at += len(more)
        held += more
        last = not more
        # a tag is shorter than 64 bytes but for blanks in BibTeX; what may be cut off is looked at with the next chunk
        known = len(held) if last else max(0, len(held) - 64)
        found = [m.start() for m in opening.finditer(held) if m.start() < known and (m.start() or base == 0) and base + m.start() >= start]
        for place in found:
            if begun is not None and base + place > begun:
                yield begun, held[begun - base : place]
            begun = base + place
            if begun >= end:
                return
        if last:
            if begun is not None:
                yield begun, held[begun - base :]
            return
        keep = (begun - base) if begun is not None else max(0, known - 1)
        held, base = held[keep:], base + keep


class ExportReader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.root, self.size = path, size

    def partitions(self):
        from pyarrow import fs

        system, name = _opened(self.root)
        info = system.get_file_info(name)
        files = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(name, recursive=True))
        out = []
        for f in files:
            base = f.path.rsplit("/", 1)[-1]
            if f.type != fs.FileType.File or base.startswith((".", "_")):
                continue
            if not base.lower().endswith(exports.SUFFIXES):
                raise ValueError(f"{base}: only {', '.join(exports.SUFFIXES)} files are read")
            with system.open_input_file(f.path) as raw:
                head = raw.read(65_536)
            wide = head[:2] in (b"\xff\xfe", b"\xfe\xff")
            text = exports.decode(head) if wide else head.decode("utf-8-sig", "replace")
            kind = exports.sniff(text + ("\nER\n" if text[:3] in ("FN ", "PT ") else ""), "." + base.lower().rsplit(".", 1)[-1])
            stream = wide or kind not in STARTS
            step = f.size if stream else self.size
            out += [Range(f.path, kind, k, min(f.size, k + step), stream) for k in range(0, max(1, f.size), max(1, step))]
        return out

    @staticmethod
    def _is_utf8(raw) -> bool:
        import codecs

        decoder = codecs.getincrementaldecoder("utf-8")()
        try:
            while chunk := raw.read(CHUNK):
                decoder.decode(chunk)
            decoder.decode(b"", True)
        except UnicodeDecodeError:
            return False
        return True

    def read(self, partition: Range):
        system, _ = _opened(self.root)
        name, parse = partition.path.rsplit("/", 1)[-1], exports.READERS[partition.kind]
        with system.open_input_file(partition.path) as raw:
            if partition.stream:
                head = raw.read(2)
                raw.seek(0)
                encoding = "utf-16" if head in (b"\xff\xfe", b"\xfe\xff") else "utf-8-sig" if self._is_utf8(raw) else "latin-1"
                raw.seek(0)
                lines = io.TextIOWrapper(io.BufferedReader(raw, CHUNK), encoding, newline="")
                for pos, row in enumerate(exports.from_csv(lines) if partition.kind == "scopus_csv" else parse(lines.read())):
                    yield (*row, name, pos)
                return

            def read(at, n):
                raw.seek(at)
                return raw.read(n)

            size = raw.size()
            header = b""
            if partition.kind == "wos_tab":
                header = read(0, min(size, CHUNK)).split(b"\n", 1)[0] + b"\n"
            for place, record in records_of(read, size, partition.kind, partition.start, partition.end):
                if partition.kind == "wos_tab" and place < len(header):
                    continue
                for row in parse(exports.decode(header + record)):
                    yield (*row, name, place)


class CitationExport(DataSource):
    """Options: path (a file or folder), rangeBytes (bytes that a task reads, about)."""

    @classmethod
    def name(cls) -> str:
        return "citation_export"

    def schema(self) -> str:
        return f"{exports.RAW}, file string, pos long"

    def reader(self, schema) -> DataSourceReader:
        return ExportReader(self.options["path"], int(self.options.get("rangeBytes", RANGE)))


def read(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """Records of the export files at a path, of any size, with file and pos."""
    spark.dataSource.register(CitationExport)
    return exports.normalised(spark.read.format("citation_export").option("rangeBytes", range_bytes).load(path))
