"""Artifact manifests: a SHA-256 per file, built and verified as DataFrames.

Files are hashed in parallel, each by one task. Small ones are read as a column; larger ones are
streamed in fixed-size pieces, so a file of any size needs the memory of one piece. A file that
cannot be read has no hash and its error in a column of its own, and never verifies.

A SHA-256 of a whole file is one stream. Beside it a manifest may hold a digest tree: each file is cut
into ranges that many tasks hash at once, and a file's tree digest is that of its range digests in
order. Ranges verify in parallel whatever the size of a file, and name what has changed.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Sequence
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldstack.functions.arrays import sha256, utc_stamp
from foldstack.sources import snapshots
from foldstack.sources.scratch import exists

# The streaming reader travels with the job, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MANIFEST = "manifest"
PATTERNS = ("*.parquet", "*.json", "*.csv", "part-*")
#: Larger files are streamed, in pieces of this many bytes.
WHOLE_BYTES = 32 * 1024**2
PIECE_BYTES = 4 * 1024**2
#: Bytes of a range of the digest tree.
RANGE_BYTES = 64 * 1024**2

ENTRY_SCHEMA = T.StructType(
    [T.StructField("rel_path", T.StringType()), T.StructField("sha256", T.StringType())]
)
RANGE_SCHEMA = T.StructType(
    [
        T.StructField("rel_path", T.StringType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("sha256", T.StringType()),
    ]
)
HEADER_SCHEMA = T.StructType(
    [
        T.StructField("created_at", T.StringType()),
        T.StructField("git_sha", T.StringType()),
        T.StructField("models", T.ArrayType(T.StringType())),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)


def qualified(spark: SparkSession, root: str) -> str:
    """The root as the file listing writes it, without a trailing slash."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.makeQualified(path).toString().rstrip("/")


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(quote(uri, safe=":/@"))


def _range_sha256(uri: str, start: int, length: int) -> str:
    system, path = opened(uri)
    digest, left = hashlib.sha256(), length
    with system.open_input_file(path) as file:
        file.seek(start)
        while left and (piece := file.read(min(left, PIECE_BYTES))):
            digest.update(piece)
            left -= len(piece)
    if left:
        raise OSError(f"{left} bytes are missing from {start}")
    return digest.hexdigest()


def _stream_sha256(uri: str) -> str:
    system, path = opened(uri)
    digest = hashlib.sha256()
    with system.open_input_stream(path, compression=None, buffer_size=PIECE_BYTES) as stream:
        while piece := stream.read(PIECE_BYTES):
            digest.update(piece)
    return digest.hexdigest()


def _streamed(paths: DataFrame) -> DataFrame:
    """``(rel_path, path)`` with ``sha256`` and ``error`` of each file, one of them null."""

    def run(batches):
        for batch in batches:
            hashes, errors = [], []
            for uri in batch.column("path").to_pylist():
                try:
                    hashes.append(_stream_sha256(uri))
                    errors.append(None)
                except (OSError, ValueError) as problem:
                    hashes.append(None)
                    errors.append(f"{type(problem).__name__}: {problem}"[:500])
            yield pa.record_batch(
                [batch.column("rel_path"), pa.array(hashes, pa.string()), pa.array(errors, pa.string())],
                names=["rel_path", "sha256", "error"],
            )

    # One file per partition would be best; a round robin over the default number comes near.
    return paths.repartition(max(2, paths.sparkSession.sparkContext.defaultParallelism)).mapInArrow(
        run, "rel_path string, sha256 string, error string"
    )


def _listed(spark: SparkSession, root: str, patterns: Sequence[str]) -> DataFrame:
    """Matching files below the root; their content is read only where it is asked for."""
    reader = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "{" + ",".join(patterns) + "}")
    )
    top = qualified(spark, root)
    below = F.expr(f"substring(path, {len(top) + 2})")
    folders = F.col("rel_path").rlike(f"^(snapshots/)?{MANIFEST}/")
    own = folders | F.col("rel_path").rlike(r"(^|/)manifest\.json$")
    return reader.load(root).withColumn("rel_path", below).where(~own)


def range_digests(
    spark: SparkSession, root: str, patterns: Sequence[str] = PATTERNS, range_bytes: int = RANGE_BYTES
) -> DataFrame:
    """``(rel_path, start, length, sha256, error)`` of each range of each matching file below ``root``.

    Ranges of all files are dealt evenly to tasks, so one large file is hashed by many. A range that
    cannot be read has an error instead of a digest; Spark lists no empty files, so they have none.
    """

    def run(batches):
        for batch in batches:
            hashes, errors = [], []
            for uri, start, length in zip(*(batch.column(n).to_pylist() for n in ("path", "start", "length"))):
                try:
                    hashes.append(_range_sha256(uri, start, length))
                    errors.append(None)
                except (OSError, ValueError) as problem:
                    hashes.append(None)
                    errors.append(f"{type(problem).__name__}: {problem}"[:500])
            yield pa.record_batch(
                [*(batch.column(n) for n in ("rel_path", "start", "length")), pa.array(hashes, pa.string()), pa.array(errors, pa.string())],
                names=["rel_path", "start", "length", "sha256", "error"],
            )

    numbers = F.sequence(F.lit(0).cast("long"), F.ceil(F.col("length") / range_bytes) - 1)
    listed = _listed(spark, root, patterns).where("length > 0")
    cut = listed.select("rel_path", "path", F.col("length").alias("size"), F.explode(numbers).alias("number"))
    start = F.col("number") * range_bytes
    cut = cut.select("rel_path", "path", start.alias("start"), F.least(F.lit(range_bytes), F.col("size") - start).cast("long").alias("length"))
    dealt = cut.repartition(max(2, spark.sparkContext.defaultParallelism), "rel_path", "start")
    return dealt.mapInArrow(run, "rel_path string, start long, length long, sha256 string, error string")


def tree_digests(ranges: DataFrame) -> DataFrame:
    """``(rel_path, n_ranges, n_bytes, sha256)``: the digest of a file's range digests in order; null if one is missing."""
    ordered = F.sort_array(F.collect_list(F.struct("start", F.coalesce("sha256", F.lit("")).alias("sha256"))))
    joined = F.array_join(F.transform(ordered, lambda x: x["sha256"]), "")
    whole = F.when(F.count_if(F.col("sha256").isNull()) == 0, F.sha2(joined.cast("binary"), 256))
    return ranges.groupBy("rel_path").agg(
        F.count(F.lit(1)).alias("n_ranges"), F.sum("length").alias("n_bytes"), whole.alias("sha256")
    )


def artifact_hashes(
    spark: SparkSession,
    root: str,
    patterns: Sequence[str] = PATTERNS,
    whole_bytes: int = WHOLE_BYTES,
) -> DataFrame:
    """``(rel_path, sha256, error)`` of each matching file below ``root``.

    Left out are the root's own manifest folders and files named ``manifest.json``.
    """
    listed = _listed(spark, root, patterns)
    small = listed.where(F.col("length") <= whole_bytes).select(
        "rel_path", sha256("content").alias("sha256"), F.lit(None).cast("string").alias("error")
    )
    large = listed.where(F.col("length") > whole_bytes).select("rel_path", "path")
    return small.unionByName(_streamed(large))


def create_manifest(
    spark: SparkSession,
    root: str,
    models: Sequence[str] = (),
    git_sha: str = "unknown",
    metadata: dict[str, object] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Header row and artifact rows."""
    pairs = [F.lit(str(x)) for item in (metadata or {}).items() for x in item]
    header = spark.range(1).select(
        utc_stamp().alias("created_at"),
        F.lit(git_sha).alias("git_sha"),
        F.array(*[F.lit(m) for m in models]).cast("array<string>").alias("models"),
        (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("metadata"),
    )
    return header, artifact_hashes(spark, root)


def unreadable(entries: DataFrame) -> DataFrame:
    """Listed files without a hash, and why."""
    return entries.where(F.col("sha256").isNull()).select("rel_path", "error")


def write_manifest(header: DataFrame, entries: DataFrame, root: str, ranges: DataFrame | None = None) -> None:
    """Store a manifest, with the digest tree's ranges if there are some."""

    def write(folder: str) -> None:
        if ranges is not None:
            ranges.select(*RANGE_SCHEMA.fieldNames()).write.json(f"{folder}/ranges")
        header.write.json(f"{folder}/header")
        entries.select("rel_path", "sha256").write.json(f"{folder}/artifacts")

    snapshots.publish(header.sparkSession, root, MANIFEST, write)


def read_manifest(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame] | None:
    found = snapshots.current(spark, root, MANIFEST)
    if found is None:
        return None
    return (
        spark.read.schema(HEADER_SCHEMA).json(f"{found.path}/header"),
        spark.read.schema(ENTRY_SCHEMA).json(f"{found.path}/artifacts"),
    )


def compare_hashes(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """``(rel_path, ok)`` for each expected file; absent ones fail, unlisted ones are ignored."""
    found = actual.select("rel_path", F.lower("sha256").alias("_actual"))
    digest = F.lower("sha256").rlike("^[0-9a-f]{64}$")  # an error text is never a match
    same = F.coalesce(digest & (F.lower("sha256") == F.col("_actual")), F.lit(False))
    return expected.join(found, "rel_path", "left").select("rel_path", same.alias("ok"))


def verify_manifest(spark: SparkSession, root: str) -> DataFrame:
    """Check files against the stored manifest; no manifest gives no rows."""
    stored = read_manifest(spark, root)
    if stored is None:
        return spark.createDataFrame([], "rel_path string, ok boolean")
    return compare_hashes(stored[1], artifact_hashes(spark, root))


def verify_ranges(spark: SparkSession, root: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``(rel_path, start, length, ok)``: listed ranges, and ranges that listed files have gained, against the files.

    A changed, missing or unreadable range fails, as does one beyond the end that a file had; files
    that the manifest does not list are ignored. Without stored ranges there are no rows.
    """
    found = snapshots.current(spark, root, MANIFEST)
    if found is None or not exists(spark, f"{found.path}/ranges"):
        return spark.createDataFrame([], "rel_path string, start long, length long, ok boolean")
    stored = spark.read.schema(RANGE_SCHEMA).json(f"{found.path}/ranges")
    listed = stored.select("rel_path").distinct()
    now = range_digests(spark, root, range_bytes=range_bytes).join(listed, "rel_path", "left_semi")
    now = now.select("rel_path", "start", F.col("length").alias("_length"), F.col("sha256").alias("_sha256"))
    same = (F.col("sha256") == F.col("_sha256")) & (F.col("length") == F.col("_length"))
    joined = stored.join(now, ["rel_path", "start"], "full")
    return joined.select("rel_path", "start", F.coalesce("length", "_length").alias("length"), F.coalesce(same, F.lit(False)).alias("ok"))


def verify_file(spark: SparkSession, root: str, rel_path: str, expected: str) -> bool:
    """Does one file have the expected hash? A missing file does not."""
    if not exists(spark, f"{root}/{rel_path}"):
        return False
    wanted = spark.range(1).select(F.lit(rel_path).alias("rel_path"), F.lit(expected).alias("sha256"))
    name = rel_path.rsplit("/", 1)[-1]
    folder = f"{root}/{rel_path}"[: -len(name) - 1]
    actual = artifact_hashes(spark, folder, (name,)).where(F.col("rel_path") == name)
    actual = actual.withColumn("rel_path", F.lit(rel_path))
    return compare_hashes(wanted, actual).first()["ok"]


def first_failures(checked: DataFrame, n: int = 5) -> DataFrame:
    """The first failing files by path."""
    return checked.where(~F.col("ok")).orderBy("rel_path").limit(n).select("rel_path")
