"""Files as data sources: text files read in splits of lines, and documents written as one Markdown file each, in two phases."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..functions import text as T

#: Bytes of a file that one task reads, and that it holds at once.
SPLIT, READ = 64 << 20, 1 << 20


def file_system(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path) if "://" in path else (pa.fs.LocalFileSystem(), path.removeprefix("file:"))


# ---- lines --------------------------------------------------------------------------------------


@dataclass
class Split(InputPartition):
    path: str
    begin: int
    end: int


class LineFiles(DataSource):
    """``loomtext_lines``: (doc_id, k, raw), the lines of all files under ``path`` that end with ``suffix``; k is the byte where a line begins.

    Files are cut every ``split`` bytes; a line belongs to the split in which it begins, so that each is read once, whatever the cuts. Lines end
    with \\n, \\r\\n or \\r. What isn't UTF-8 is replaced.
    """

    @classmethod
    def name(cls) -> str:
        return "loomtext_lines"

    def schema(self) -> str:
        return "doc_id string, k bigint, raw string"

    def reader(self, schema) -> DataSourceReader:
        return LineReader(self.options["path"], self.options.get("suffix", ".vtt"), int(self.options.get("split", SPLIT)))


class LineReader(DataSourceReader):
    def __init__(self, path: str, suffix: str, split: int):
        self.path, self.suffix, self.split = path, suffix, split

    def partitions(self) -> list[Split]:
        fs, at = file_system(self.path)
        found = fs.get_file_info(pa.fs.FileSelector(at, recursive=True)) if fs.get_file_info(at).type == pa.fs.FileType.Directory else [fs.get_file_info(at)]
        files = sorted((f.path, f.size) for f in found if f.type == pa.fs.FileType.File and f.path.endswith(self.suffix))
        return [Split(p, a, min(a + self.split, size)) for p, size in files for a in range(0, size, self.split)]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(self.path)
        with fs.open_input_file(partition.path) as f:
            for at, lines in _lines(f, partition.begin, partition.end):
                places = [at]
                for line in lines[:-1]:
                    places.append(places[-1] + len(line) + 1)
                rows = [(k + sum(map(len, parts[:i])) + i, p) for k, line in zip(places, lines, strict=True) for parts in [line.removesuffix(b"\r").split(b"\r")] for i, p in enumerate(parts)]
                yield pa.RecordBatch.from_arrays([pa.array([partition.path] * len(rows)), pa.array([k for k, _ in rows], pa.int64()), pa.array([p.decode("utf-8", "replace") for _, p in rows])], names=["doc_id", "k", "raw"])


def _lines(f, begin: int, end: int) -> Iterator[tuple[int, list[bytes]]]:
    """(place, lines) of the lines, without \\n, that begin from begin to before end; the last may reach beyond it."""
    at, held = max(begin - 1, 0), b""
    f.seek(at)
    skip = begin > 0  # up to behind the first line end from begin - 1 on
    while True:
        data = f.read(READ)
        held += data
        if skip:
            cut = held.find(b"\n")
            if cut < 0:
                at, held = at + len(held), b""
                if not data or at >= end:
                    return
                continue
            at, held, skip = at + cut + 1, held[cut + 1 :], False
        if at >= end:
            return
        *whole, rest = held.split(b"\n") if data else [*held.split(b"\n"), b""] if held else [b""]
        out, place = [], at
        for line in whole:
            if place >= end:
                break
            out.append(line)
            place += len(line) + 1
        if out:
            yield at, out
        if not data or len(out) < len(whole):
            return
        at, held = place, rest


def read_lines(spark: SparkSession, path: str, suffix: str = ".vtt", split: int = SPLIT) -> DataFrame:
    """(doc_id, k, raw) of files of any size, for subtitles.cues_of_lines; see LineFiles."""
    spark.dataSource.register(LineFiles)
    return spark.read.format("loomtext_lines").option("path", path).option("suffix", suffix).option("split", split).load()


# ---- documents ----------------------------------------------------------------------------------


@dataclass
class Staged(WriterCommitMessage):
    names: list[str]
    folder: str


class MarkdownFiles(DataSource):
    """``loomtext_markdown``: writes (name, content) as one file for each row under ``path``."""

    @classmethod
    def name(cls) -> str:
        return "loomtext_markdown"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return MarkdownWriter(self.options["path"])


class MarkdownWriter(DataSourceWriter):
    """Tasks write into a folder of their own attempt under ``_staging``; the commit moves the files of finished attempts to their names.

    Until then nothing can be seen under the names, and a job that fails takes its folder away. A file's name is all that tells it: a job
    that runs again replaces what it wrote. Two rows of one name are an error before anything is moved.
    """

    def __init__(self, path: str):
        self.path, self.job = path, uuid.uuid4().hex

    def staging(self) -> tuple[pa.fs.FileSystem, str, str]:
        fs, at = file_system(self.path)
        return fs, at, f"{at}/_staging/{self.job}"

    def write(self, iterator) -> Staged:
        fs, _, staging = self.staging()
        folder, names = f"{staging}/{uuid.uuid4().hex}", []
        fs.create_dir(folder, recursive=True)
        for row in iterator:
            with fs.open_output_stream(f"{folder}/{len(names)}") as f:
                f.write((row["content"] or "").encode())
            names.append(row["name"])
        return Staged(names, folder)

    def commit(self, messages: list) -> None:
        fs, at, staging = self.staging()
        staged = [m for m in messages if m]
        twice = [n for n, k in Counter(n for m in staged for n in m.names).items() if k > 1]
        if twice:
            fs.delete_dir(staging)
            raise ValueError(f"more than one document is named {sorted(twice)[:5]}")
        for m in staged:
            for k, name in enumerate(m.names):
                fs.move(f"{m.folder}/{k}", f"{at}/{name}")
        if staged:
            fs.delete_dir(staging)

    def abort(self, messages: list) -> None:
        fs, _, staging = self.staging()
        if fs.get_file_info(staging).type == pa.fs.FileType.Directory:
            fs.delete_dir(staging)


def write_markdown(docs: DataFrame, path: str) -> None:
    """A Markdown file for each of docs (title, content, ...), as merge.assemble makes their content; named by the title (text.sanitize_filename)."""
    spark = docs.sparkSession
    spark.dataSource.register(MarkdownFiles)
    named = docs.select(F.concat(T.sanitize_filename("title"), F.lit(".md")).alias("name"), F.col("content").cast("string").alias("content"))
    named.write.format("loomtext_markdown").option("path", path).mode("append").save()
