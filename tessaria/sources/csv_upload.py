"""CSV of unknown encoding and separator. The separator is judged by a head sample, the encoding by all bytes; Spark reads both in parallel."""

from __future__ import annotations

import csv
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Encodings and separators in the order in which they are tried, characters of the sample.
ENCODINGS, SEPARATORS, SAMPLE = ("utf-8-sig", "utf-8", "latin-1"), ",;\t|", 16_000


def sniff(head: bytes) -> tuple[str, str]:
    """(encoding, separator) of the first bytes of a file; a character cut at the end of the sample does no harm."""
    encoding = "latin-1"
    for e in ENCODINGS:
        try:
            head.decode(e)
            encoding = e
            break
        except UnicodeDecodeError as x:
            if x.start >= len(head) - 4:
                encoding = e
                break
    text = head.decode(encoding, errors="ignore")[:SAMPLE]
    try:
        return encoding, csv.Sniffer().sniff(text, delimiters=SEPARATORS).delimiter
    except csv.Error:
        counts = {s: text.count(s) for s in SEPARATORS}
        return encoding, max(counts, key=counts.get) if max(counts.values()) else ","


def _file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path and the path in its terms; works on the driver for any scheme."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def head_of(spark: SparkSession, path: str, size: int = 4 * SAMPLE) -> bytes:
    """The first bytes of a file, or of the first file in a folder."""
    fs, p = _file_system(spark, path)
    if not fs.exists(p):
        raise ValueError("there is no file")
    if fs.getFileStatus(p).isDirectory():
        names = sorted(str(f.getPath().toString()) for f in fs.listStatus(p) if f.isFile() and not f.getPath().getName().startswith(("_", ".")))
        if not names:
            raise ValueError("there is no file")
        fs, p = _file_system(spark, names[0])
    stream = fs.open(p)
    try:
        return bytes(stream.readNBytes(size))
    finally:
        stream.close()


def judged_lines(spark: SparkSession, path: str) -> tuple[bool, bool]:
    """Whether all lines of a file are valid UTF-8, and whether some line ends inside quotes: their bytes are not decoded,
    and no sign of more bytes holds a line end or a quote."""
    line = F.col("value")
    odd = F.length(F.regexp_replace(F.decode(line.cast("binary"), "ISO-8859-1"), '[^"]', "")) % 2 == 1
    r = spark.read.text(path).agg(F.max((~F.is_valid_utf8(line)).cast("int")).alias("bad"), F.max(odd.cast("int")).alias("open")).first()
    return not r["bad"], bool(r["open"])


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings, header names trimmed, unnamed columns dropped. Errors: no row, or fewer than two columns.

    Files are split between tasks unless some quoted value holds a line break; then each file is one task's.
    """
    _, sep = sniff(head_of(spark, path))
    utf8, broken = judged_lines(spark, path)
    raw = spark.read.csv(path, sep=sep, encoding="UTF-8" if utf8 else "ISO-8859-1", header=True, quote='"', escape='"', multiLine=broken, ignoreLeadingWhiteSpace=False)
    names = [c.lstrip("﻿").strip() for c in raw.columns]
    kept = [i for i, c in enumerate(names) if c and not c.startswith(("Unnamed", "_c"))]
    df = raw.toDF(*[f"c{i}" for i in range(len(names))]).select(*[F.when(F.col(f"c{i}") != "", F.col(f"c{i}")).alias(names[i]) for i in kept])
    if len(kept) < 2:
        raise ValueError("the file needs at least two columns")
    if not df.limit(1).count():
        raise ValueError("the file has no rows")
    return df


class Uploads:
    """Uploads by id, the newest `keep` of them; older ones are dropped with their files."""

    def __init__(self, spark: SparkSession, folder: str | None = None, keep: int = 4) -> None:
        self.spark, self.folder, self.keep = spark, folder, keep
        self.paths: dict[str, str] = {}

    def put(self, raw: bytes) -> str:
        key = uuid.uuid4().hex
        self.paths[key] = write_upload(self.spark, raw, self.folder)
        while len(self.paths) > self.keep:
            fs, p = _file_system(self.spark, self.paths.pop(next(iter(self.paths))))
            fs.delete(p.getParent(), True)
        return key

    def get(self, key: str) -> DataFrame:
        if key not in self.paths:
            raise KeyError(f"no upload {key}")
        return read_csv(self.spark, self.paths[key])


def read_csv_bytes(spark: SparkSession, raw: bytes, folder: str | None = None) -> DataFrame:
    """The same for an upload held in memory, put into a folder that all executors see."""
    return read_csv(spark, write_upload(spark, raw, folder))


def write_upload(spark: SparkSession, raw: bytes, folder: str | None = None) -> str:
    """The path of an upload's file in a folder that all executors see."""
    from tessaria.plans.materialize import ensure_checkpoint_dir

    path = f"{folder or ensure_checkpoint_dir(spark)}/upload-{uuid.uuid4().hex}/upload.csv"
    fs, p = _file_system(spark, path)
    stream = fs.create(p)
    try:
        stream.write(raw)
    finally:
        stream.close()
    return path
