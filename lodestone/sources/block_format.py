"""Text blocks as a format of their own: ``spark.read.format("blocks")``.

Options: ``mode`` is PERMISSIVE (a block that is broken comes as a row with its text in _corrupt), DROPMALFORMED or
FAILFAST; ``most_bytes`` bounds what is read of a file, and a file that has more ends in a corrupt row that says so, or
fails. Files below the path are dealt to partitions whole, small ones together. They are opened by Arrow's file systems,
so paths may be local or of any store that Arrow knows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, block_id string, line int, fields map<string,string>, _corrupt string"
TOGETHER = 4 << 20  # bytes of files in one partition, about


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(0)
        self.paths = paths


def blocks_of(content: str) -> Iterator[tuple[str | None, int, dict[str, str], str | None]]:
    """(block id, line, fields, corrupt text) of each block: a header ``[PREFIX-id]``, then ``Key: value``, list items and more lines.

    A line that begins with a bracket and a capital but is no header begins a corrupt block, which has all its lines as text.
    """
    block_id, line, fields, key, said = None, 0, {}, None, []
    for at, text in enumerate([*re.split("\r?\n", content), None], 1):
        begins = text is None or re.match(r"\[[A-Z]", text)
        if begins and line:
            yield (block_id, line, {k: "\n".join(v) for k, v in fields.items() if v}, None) if block_id else (None, line, {}, "\n".join(said))
        if text is None:
            return
        if begins:
            header = re.fullmatch(r"\[([A-Z]+-[A-Za-z0-9_.-]+)\]\s*", text)
            block_id, line, fields, key, said = header and header.group(1), at, {}, None, [text]
        elif line:
            said.append(text)
            if named := re.match(r"([A-Za-z][A-Za-z0-9_]*):\s*(.*)", text):
                key = named.group(1)
                part = named.group(2).strip(" ")
            else:
                item = re.match(r"\s*-\s+(.*)", text)
                part = item.group(1) if item else text.strip(" ")
            if key and part:
                fields.setdefault(key, []).append(part)


class BlockReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.mode = options["path"], options.get("mode", "PERMISSIVE").upper()
        self.most = int(options.get("most_bytes", 1 << 30))
        if self.mode not in ("PERMISSIVE", "DROPMALFORMED", "FAILFAST"):
            raise ValueError(f"unknown mode {self.mode}")

    def _system(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        system, root = self._system()
        found = system.get_file_info(root)
        files = [found] if found.is_file else [f for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file]
        out, held, size = [], [], 0
        for f in sorted(files, key=lambda f: f.path):
            held.append(f.path)
            size += f.size
            if size >= TOGETHER:
                out.append(Files(held))
                held, size = [], 0
        return out + ([Files(held)] if held or not out else [])

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _ = self._system()
        for path in partition.paths:
            with system.open_input_stream(path) as f:
                data = f.read(self.most + 1)
            cut = len(data) > self.most
            for block_id, line, fields, corrupt in blocks_of(data[: self.most].decode("utf-8", "replace")):
                yield from self._row(path, block_id, line, fields, corrupt)
            if cut:
                yield from self._row(path, None, 0, {}, f"more than {self.most} bytes")

    def _row(self, path: str, block_id, line, fields, corrupt) -> list[tuple]:
        if corrupt is not None and self.mode == "FAILFAST":
            raise ValueError(f"{path}, line {line}: {corrupt[:200]}")
        return [] if corrupt is not None and self.mode == "DROPMALFORMED" else [(path, block_id, line, fields, corrupt)]


class BlockSource(DataSource):
    """Register with ``spark.dataSource.register(BlockSource)``."""

    @classmethod
    def name(cls) -> str:
        return "blocks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BlockReader:
        return BlockReader(dict(self.options))
