"""A Python data source for similarity services, with a file-backed service.

``spark.dataSource.register(SimilaritySource)``, then
``spark.read.format("similarity").option("path", folder).load()`` gives (src,
dst, match). A service over a network would replace ``fetch``; retries are here.
``spark.readStream`` gives the answers of files as they come; with the option
``errors`` (a folder that all tasks see) failed files are noted there, and the stream
ends when more than ``budget`` of them are, whatever tasks they failed in.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType


class Busy(Exception):
    """The service asks to come back later (status 429)."""


def with_retry(call: Callable, tries: int = 4, delay: float = 1.0, sleep: Callable = time.sleep):
    """Call again while the service is busy, waiting twice as long each time; other errors go through at once."""
    for k in range(tries):
        try:
            return call()
        except Busy:
            if k == tries - 1:
                raise
            sleep(delay * 2**k)
    return None


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and its path there: by its scheme, else the machine's own."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class SimilaritySource(DataSource):
    """Similar items of each item, read from one JSON file for each."""

    @classmethod
    def name(cls) -> str:
        return "similarity"

    def schema(self) -> str:
        return "src string, dst string, match double"

    def reader(self, schema: StructType) -> DataSourceReader:
        return SimilarityReader(self.options["path"], float(self.options.get("floor", "0")))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802  the interface's name
        return SimilarityStream(self.options["path"], float(self.options.get("floor", "0")), self.options.get("errors"), int(self.options.get("budget", "50")))


class Files:
    """The answers in the files of a folder, some files for each partition."""

    FILES, FAILURES = 200, 50

    def __init__(self, path: str, floor: float):
        self.path, self.floor = path, floor

    def listed(self) -> list:
        """The files that are there."""
        system, folder = located(self.path)
        return [f for f in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if f.is_file and f.path.endswith(".json")]

    def dealt(self, found: list[str]) -> list[InputPartition]:
        """Partitions of so many files."""
        return [InputPartition(found[k : k + self.FILES]) for k in range(0, len(found), self.FILES)]

    def fetch(self, file: str) -> dict:
        """What the service says of one item."""
        with located(self.path)[0].open_input_stream(file) as stream:
            return json.loads(stream.read())

    def failed(self, file: str) -> None:
        """Take note of a file that failed."""

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        """The rows of a partition's files; a file that fails is left out, too many in a row end the read."""
        failed = 0
        for file in partition.value:
            try:
                data = with_retry(lambda f=file: self.fetch(f))
                rows = [(data["name"], s["name"], float(s["match"])) for s in data.get("similar", [])]
            except (OSError, ValueError, KeyError, TypeError, AttributeError, Busy):
                failed += 1
                self.failed(file)
                if failed > self.FAILURES:
                    raise
                continue
            failed = 0
            yield from (r for r in rows if r[2] >= self.floor)


class SimilarityReader(Files, DataSourceReader):
    """The files that are there now."""

    def partitions(self) -> list[InputPartition]:
        return self.dealt(sorted(f.path for f in self.listed()))


class SimilarityStream(Files, DataSourceStreamReader):
    """The files as they come, in the order of their times and names; an offset is the last one's.

    A file that is written again is a new one. Files must not get an earlier time than
    those read before.
    """

    def __init__(self, path: str, floor: float, errors: str | None, budget: int):
        super().__init__(path, floor)
        self.errors, self.budget = errors, budget

    def initialOffset(self) -> dict:  # noqa: N802
        return {"time": -1, "file": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        time_, file = max([(f.mtime_ns, f.path) for f in self.listed()], default=(-1, ""))
        return {"time": time_, "file": file}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if self.errors and (n := len(self.noted())) > self.budget:
            raise RuntimeError(f"{n} files failed, {self.budget} may")
        after, until = ((o["time"], o["file"]) for o in (start, end))
        return self.dealt([file for _, file in sorted(x for x in ((f.mtime_ns, f.path) for f in self.listed()) if after < x <= until)])

    def noted(self) -> list:
        """The failed files, once each, however often a task was tried."""
        system, folder = located(self.errors)
        return system.get_file_info(fs.FileSelector(folder, allow_not_found=True))

    def failed(self, file: str) -> None:
        if self.errors:
            system, folder = located(self.errors)
            system.create_dir(folder)
            with system.open_output_stream(f"{folder}/{hashlib.sha256(file.encode()).hexdigest()}") as out:
                out.write(file.encode())
