"""spark.read.format("tesserine-jsonl"): entries of files through Spark's Python data sources, a format for each extractor that is registered."""

from __future__ import annotations

import codecs
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: An extractor turns a file's lines into (entry_idx, line_no, text) rows: a small function of its own, that sees one file's lines in order.
Extractor = Callable[[Iterator[str]], Iterator[tuple[int, int, str]]]

_EXTRACTORS: dict[str, Extractor | None] = {}

PREFIX = "tesserine-"
SCHEMA = "file string, entry_idx long, line_no long, text string"

#: Bytes that are read of a file at once.
BLOCK = 1 << 20


def register_extractor(name: str, extractor: Extractor | None = None, again: bool = False) -> None:
    """Makes an extractor known by a name, to domains and to the format. Without a function, the name stands for readers of its own."""
    if name in _EXTRACTORS and not again:
        raise ValueError(f"there is an extractor {name!r}")
    _EXTRACTORS[name] = extractor


def extractor(name: str) -> Extractor:
    found = _EXTRACTORS.get(name)
    if found is None:
        raise ValueError(f"no extractor {name!r}")
    return found


def extractor_names() -> set[str]:
    return set(_EXTRACTORS)


def jsonl(lines: Iterator[str]) -> Iterator[tuple[int, int, str]]:
    """The content of each non-blank line's JSON object, the line itself where it has none."""
    entry = 0
    for line_no, line in enumerate(lines, 1):
        if not line.strip(" "):
            continue
        try:
            value = json.loads(line)
        except ValueError:
            value = None
        content = value.get("content") if isinstance(value, dict) else None
        said = content if isinstance(content, str) or content is None else json.dumps(content, ensure_ascii=False, separators=(",", ":"))
        yield entry, line_no, said or line
        entry += 1


def text(lines: Iterator[str]) -> Iterator[tuple[int, int, str]]:
    """Each non-blank line."""
    entry = 0
    for line_no, line in enumerate(lines, 1):
        if line.strip(" "):
            yield entry, line_no, line
            entry += 1


register_extractor("jsonl", jsonl)
register_extractor("text", text)
register_extractor("notification")  # read by functions of their own


@dataclass
class _File(InputPartition):
    path: str


class EntriesReader(DataSourceReader):
    """A partition a file; files below a folder of any file system that Arrow opens."""

    def __init__(self, options: dict[str, str], cut: Extractor):
        self.root, self.glob, self.cut = options.get("path"), options.get("pathglobfilter", "*"), cut
        if not self.root:
            raise ValueError("a path is needed")

    def partitions(self) -> list[InputPartition]:
        files, root = self._opened()
        found = files.get_file_info(fs.FileSelector(root, recursive=True))
        # an empty plan needs one partition
        return [_File(f.path) for f in sorted(found, key=lambda f: f.path) if f.is_file and fnmatch(f.base_name, self.glob) and not f.base_name.startswith((".", "_"))] or [_File("")]

    def read(self, partition: _File) -> Iterator[tuple]:
        if partition.path:
            files, _ = self._opened()
            for entry, line_no, said in self.cut(_lines(files, partition.path)):
                yield self._named(partition.path), entry, line_no, said

    def _named(self, path: str) -> str:
        """The path as Spark's file sources have it."""
        scheme = re.match(r"\w+:", self.root)
        return f"file:{path}" if scheme is None or scheme[0] == "file:" else f"{scheme[0]}//{path}"

    def _opened(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.root) if re.match(r"\w+:", self.root) else (fs.LocalFileSystem(), self.root)


def _lines(files: fs.FileSystem, path: str) -> Iterator[str]:
    """A file's lines, a block at a time; line ends are those of the other readers. Bytes that are no UTF-8 are replaced."""
    decoder, held = codecs.getincrementaldecoder("utf-8")("replace"), ""
    with files.open_input_stream(path) as stream:
        while block := stream.read(BLOCK):
            held += decoder.decode(block)
            *whole, held = re.split(r"\r\n|\n|\r(?=[^\n])", held)
            yield from whole
    held += decoder.decode(b"", True)
    yield from re.split(r"\r\n|\n|\r", held)


def source(by: str) -> type[DataSource]:
    """The data source of an extractor. The class is made here, so that Spark's workers get it with its function, whatever was registered where."""
    cut = extractor(by)

    class Entries(DataSource):
        """Options: path and pathGlobFilter."""

        @classmethod
        def name(cls) -> str:
            return PREFIX + by

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return EntriesReader(dict(self.options), cut)

    return Entries


def register_formats(spark: SparkSession) -> list[str]:
    """Makes every extractor that has a function a format of the session; their names."""
    names = [by for by in sorted(_EXTRACTORS) if _EXTRACTORS[by] is not None]
    for by in names:
        spark.dataSource.register(source(by))
    return [PREFIX + by for by in names]


def entries(spark: SparkSession, path: str, by: str = "jsonl", glob: str = "*") -> DataFrame:
    """file, entry_idx, line_no, text of the files below a path, cut by a registered extractor."""
    spark.dataSource.register(source(by))
    return spark.read.format(PREFIX + by).option("pathGlobFilter", glob).load(path)
