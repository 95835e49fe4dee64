"""Bodies of listed files as a Python data source.

The listing is a table (path, full) in the shared folder; each of its files is a partition, so the writer of the listing plans
them by the bytes to read. Bytes that aren't UTF-8 become replacement characters. A file that can't be read is a row with an error. With a
tokenizer, made once in a worker, a row also has its tokens, null where the tokenizer fails.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from loomline.sources import scratch

#: Bytes of files to a partition, and of texts that are handed on at once.
SHARE, LOT = 64 << 20, 8 << 20
SCHEMA = "path string, text string, error string, tokens long, failed boolean"


@dataclass(frozen=True)
class Tokenizer:
    """A provider's tokenizer. make() gives the function that counts a text's tokens; it is called once in each worker, so it may load files."""

    provider: str
    id: str
    make: Callable[[], Callable[[str], int]]
    version: str = ""
    model: str = ""

    @property
    def key(self) -> str:
        """What a scan cache is kept under; tokenizers that count differently must differ in it."""
        return re.sub(r"[^\w.@+-]", "_", f"{self.provider}.{self.id}.{self.model}" + (f"@{self.version}" if self.version else ""))


_made: dict[str, Callable[[str], int]] = {}


def counter(tokenizer: Tokenizer) -> Callable[[str], int | None]:
    def count(text: str) -> int | None:
        try:
            if tokenizer.key not in _made:
                _made[tokenizer.key] = tokenizer.make()
            n = _made[tokenizer.key](text)
        except Exception:  # noqa: BLE001 - whatever fails in a user's function means the estimate
            return None
        return n if isinstance(n, int) and not isinstance(n, bool) and 0 <= n < 1 << 53 else None

    return count


class Part(InputPartition):
    def __init__(self, file: str) -> None:
        self.file = file


def split(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else re.sub(r"^file:/*", "/", uri))


class Reader(DataSourceReader):
    def __init__(self, listing: str, tokenizer: Tokenizer | None) -> None:
        self.listing, self.tokenizer = listing, tokenizer

    def partitions(self) -> list[Part]:
        fs, root = split(self.listing)
        return [Part(i.path) for i in fs.get_file_info(pafs.FileSelector(root)) if i.base_name.endswith(".parquet")] or [Part("")]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        fs, _ = split(self.listing)
        count = counter(self.tokenizer) if self.tokenizer else None
        rows, size = [], 0
        with fs.open_input_file(partition.file) as file:
            for batch in pq.ParquetFile(file).iter_batches(columns=["path", "full"]):
                for path, full in zip(batch.column("path").to_pylist(), batch.column("full").to_pylist()):
                    try:
                        with open(full, "rb") as own:
                            text, error = own.read().decode("utf-8", "replace"), None
                    except OSError as wrong:
                        text, error = None, wrong.strerror or type(wrong).__name__
                    tokens = count(text) if count and text is not None else None
                    rows.append((path, text, error, tokens, count is not None and text is not None and tokens is None))
                    size += len(text or "")
                    if size >= LOT:
                        yield packed(rows)
                        rows, size = [], 0
        if rows:
            yield packed(rows)


def packed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("path", pa.string()), ("text", pa.string()), ("error", pa.string()), ("tokens", pa.int64()), ("failed", pa.bool_())]
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(zip(*rows), kinds)], names=[n for n, _ in kinds])


def source(made_with: Tokenizer | None) -> type[DataSource]:
    class Bodies(DataSource):
        tokenizer = made_with

        @classmethod
        def name(cls) -> str:
            return "loomline_bodies"

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema: object) -> Reader:
            return Reader(self.options["path"], self.tokenizer)

    return Bodies


def read_bodies(spark: SparkSession, wanted: DataFrame, tokenizer: Tokenizer | None = None) -> DataFrame:
    """(path, text, error, tokens, failed) of wanted files (path, full, bytes); partitions have about SHARE bytes to read."""
    total, rows = wanted.agg(F.sum("bytes"), F.count(F.lit(1))).first()
    parts = max(1, -(-(total or 0) // SHARE), min(spark.sparkContext.defaultParallelism, -(-rows // 64)))
    path = scratch.place(spark, "listing")
    wanted.select("path", "full").repartition(parts, F.xxhash64("path")).write.parquet(path)
    spark.dataSource.register(source(tokenizer))
    return spark.read.format("loomline_bodies").load(path)
