"""Manifest and segments on any file system that Hadoop knows. The manifest's rename is the only commit point."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from findery.functions import scoring, text

FORMAT_VERSION = 1
#: Documents are written in row groups of so many bytes, and read so many at a time where their postings are sorted: some thousand documents, whose postings fit in memory.
TASK_BYTES = 1 << 21
ZSTD_LEVEL = 6
FEW_DEAD = 100_000


@dataclass
class Segment:
    segment_id: str
    path: str
    doc_count: int
    total_tokens: int
    created_at: int
    generation: int
    unique: bool = False  # no doc_id twice


@dataclass
class Manifest:
    """What a reader sees. Tombstone files hold (doc_id, generation): they hide rows of segments up to that generation."""

    format_version: int = FORMAT_VERSION
    generation: int = 0
    embedding_model: str = "unknown"
    embedding_dimension: int = 0
    bm25: dict = field(default_factory=lambda: {"k1": scoring.K1, "b": scoring.B})
    rrf_k: int = scoring.RRF_K
    segments: list[Segment] = field(default_factory=list)
    tombstones: list[str] = field(default_factory=list)
    disjoint: bool = True  # no live doc_id in two segments

    @property
    def repeats(self) -> bool:
        """Whether a live doc_id may have several rows."""
        return not (self.disjoint and all(s.unique for s in self.segments))

    @classmethod
    def parse(cls, text: str) -> Manifest:
        data = json.loads(text)
        if data.get("format_version") != FORMAT_VERSION:
            raise ValueError(f"unknown manifest version {data.get('format_version')}")
        return cls(**{"disjoint": False} | data | {"segments": [Segment(**s) for s in data["segments"]]})


class Store:
    """Files below one root: manifest.json, segments/<id>/{documents,postings}, tombstones/<id>. One writer at a time."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        for d in ("segments", "tombstones"):
            self._fs.mkdirs(self._path(f"{self.root}/{d}"))

    @property
    def manifest_path(self) -> str:
        return f"{self.root}/manifest.json"

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def children(self, path: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(path))) if self.exists(path) else []

    def remove(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def rename(self, old: str, new: str) -> None:
        if not self._fs.rename(self._path(old), self._path(new)):
            raise OSError(f"can't rename {old}")

    def load(self) -> Manifest:
        """The committed manifest, or a new one. A first manifest whose rename didn't end is found as manifest.next."""
        at = self.manifest_path if self.exists(self.manifest_path) else f"{self.root}/manifest.next"
        if not self.exists(at):
            return Manifest()
        stream = self._fs.open(self._path(at))
        try:
            return Manifest.parse(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, manifest: Manifest) -> None:
        new = f"{self.root}/manifest.next"
        stream = self._fs.create(self._path(new), True)
        stream.write(bytearray(json.dumps(asdict(manifest), indent=1).encode()))
        stream.hsync()
        stream.close()
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        over = self.spark._sc._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        over[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
        at = self._fs.makeQualified(self._path(new))
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), conf).rename(at, self._fs.makeQualified(self._path(self.manifest_path)), over)

    def write_postings(self, rows: DataFrame, name: str) -> str:
        """Writes a segment's postings to its staging folder. Terms are sorted, so that each is stored as what it adds to the one before (Parquet's delta encoding)."""
        staging = f"{self.root}/segments/{name}.staging"
        out = rows.write.mode("overwrite").option("compression", "zstd").option("parquet.writer.version", "v2").option("parquet.enable.dictionary#term", "false")
        out.parquet(f"{staging}/postings")
        return staging

    def write_documents(self, rows: DataFrame, name: str) -> str:
        """Writes a segment's documents, or some of them, to its staging folder; searchable_text only where it isn't what the other columns give."""
        given = F.when(F.col("searchable_text") != searchable(), F.col("searchable_text"))
        staging = f"{self.root}/segments/{name}.staging"
        out = rows.withColumn("searchable_text", given).write.mode("append").option("compression", "zstd").option("parquet.compression.codec.zstd.level", str(ZSTD_LEVEL)).option("parquet.block.size", str(TASK_BYTES))
        out.parquet(f"{staging}/documents")
        return staging

    def read_documents(self, *paths: str) -> DataFrame:
        return self.spark.read.parquet(*paths).withColumn("searchable_text", F.coalesce("searchable_text", searchable()))

    @contextmanager
    def small_tasks(self) -> Iterator[None]:
        """Files are read in tasks of TASK_BYTES at most."""
        key = "spark.sql.files.maxPartitionBytes"
        before = self.spark.conf.get(key)
        self.spark.conf.set(key, str(TASK_BYTES))
        try:
            yield
        finally:
            self.spark.conf.set(key, before)

    def place(self, staging: str) -> str:
        final = staging.removesuffix(".staging")
        self.rename(staging, final)
        return final

    def recover(self, manifest: Manifest) -> list[str]:
        """Removes what no manifest lists: staging folders, and segments and tombstones of commits that didn't end."""
        listed = {s.path for s in manifest.segments} | set(manifest.tombstones)
        gone = [p for d in ("segments", "tombstones") for n in self.children(f"{self.root}/{d}") if (p := f"{self.root}/{d}/{n}") not in listed]
        for p in gone:
            self.remove(p)
        return gone

    def documents(self, manifest: Manifest) -> DataFrame | None:
        """All rows of the listed segments with segment_ord, dead ones too."""
        if not manifest.segments:
            return None
        rows = self.read_documents(*(f"{s.path}/documents" for s in manifest.segments))
        number = F.create_map(*(F.lit(x) for i, s in enumerate(manifest.segments) for x in (s.segment_id, i)))
        return rows.withColumn("segment_ord", number[F.col("segment_id")])

    def postings(self, manifest: Manifest) -> DataFrame:
        return self.spark.read.parquet(*(f"{s.path}/postings" for s in manifest.segments))

    def stats(self, manifest: Manifest) -> DataFrame:
        rows = [(s.segment_id, s.doc_count, s.total_tokens / s.doc_count if s.doc_count else 0.0) for s in manifest.segments]
        return self.spark.createDataFrame(rows, "segment_id string, n long, avgdl double")

    def few_dead(self, manifest: Manifest) -> bool:
        """Whether what dead() gives may be broadcast."""
        return self.spark.read.parquet(*manifest.tombstones).count() * len(manifest.segments) <= FEW_DEAD

    def dead(self, manifest: Manifest, ban: bool = False) -> DataFrame | None:
        """(segment_id, doc_id) that tombstones hide; with ban, in all segments."""
        if not manifest.tombstones or not manifest.segments:
            return None
        tombs = self.spark.read.parquet(*manifest.tombstones).groupBy("doc_id").agg(F.max("generation").alias("generation"))
        of = F.array(*(F.struct(F.lit(s.segment_id).alias("segment_id"), F.lit(s.generation).cast("long").alias("g")) for s in manifest.segments))
        each = tombs.select("doc_id", "generation", F.explode(of).alias("s"))
        return (each if ban else each.filter("s.g <= generation")).select("s.segment_id", "doc_id")


def searchable() -> Column:
    return text.searchable_text("title", "description", "tags", "body")


def now() -> int:
    return time.time_ns()
