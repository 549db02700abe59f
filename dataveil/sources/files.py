"""Files as rows: inventory below a prefix and restartable moves into quarantine."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def list_files(spark: SparkSession, prefix: str) -> DataFrame:
    """Path and size of every file below *prefix*; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(prefix).select(
        "path", F.col("length").alias("bytes")
    )


def inventory(files: DataFrame, *by: str) -> DataFrame:
    """Number of files and total bytes, per group if any."""
    return files.groupBy(*by).agg(
        F.count(F.lit(1)).alias("file_count"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_bytes")
    )


def one_spelling(uri: Column) -> Column:
    """A URI as other readers may spell it too: one scheme for S3, plain paths for local files."""
    return F.regexp_replace(F.regexp_replace(uri, "^s3[an]://", "s3://"), "^file:/+", "/")


def move_target(path: Column, source_prefix: Column, root: str, table_id: Column) -> Column:
    """``<prefix>/x`` becomes ``<root>/<table_id>/x``; a path that is not below the prefix is an error."""
    below = F.concat(F.regexp_replace(one_spelling(source_prefix), "/+$", ""), F.lit("/"))
    own = one_spelling(path)
    target = F.concat(F.lit(root.rstrip("/") + "/"), table_id, F.lit("/"), F.substr(own, F.length(below) + 1))
    outside = F.raise_error(F.concat(F.lit("Not below the source prefix: "), path)).cast("string")
    return F.when(F.startswith(own, below), target).otherwise(outside)


def plan_moves(files: DataFrame, source_prefix: str, root: str, table_id: str) -> DataFrame:
    """Source, size and target of every file; two files never share a target."""
    target = move_target(F.col("path"), F.lit(source_prefix), root, F.lit(table_id))
    moves = files.select("path", "bytes", target.alias("target"))
    shared = moves.groupBy("target").count().where("count > 1").first()
    if shared is not None:
        raise ValueError(f"{shared['count']} files would move to {shared['target']}")
    return moves


def plan_expiry(files: DataFrame, expired: DataFrame) -> DataFrame:
    """Source, size and target of every listed file that lies below a path of *expired* (quarantine_path, expired_path).

    A file meets its table by the folder's path, so all tables are one join; other files are left out.
    """
    tables = expired.select(
        F.regexp_replace(one_spelling(F.col("quarantine_path")), "/+$", "").alias("folder"), F.regexp_replace("expired_path", "/+$", "").alias("to")
    )
    own = files.select("path", "bytes", one_spelling(F.col("path")).alias("own"))
    above = own.select("*", F.explode(F.sequence(F.lit(1), F.size(F.split("own", "/")) - 1)).alias("depth"))
    return above.withColumn("folder", F.expr("substring_index(own, '/', depth)")).join(tables, "folder").select(
        "path", "bytes", F.concat("to", F.substring(F.col("own"), F.length("folder") + 1, F.length("own"))).alias("target")
    )


def _filesystem(uri: str):
    """Filesystem and path of a URI as Spark writes it (``file:/x`` has one slash)."""
    from pyarrow import fs

    scheme, found, rest = uri.partition(":")
    if not found or scheme.startswith("/"):
        return fs.LocalFileSystem(), uri
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    if scheme in ("s3a", "s3n"):
        uri = f"s3:{rest}"
    return fs.FileSystem.from_uri(uri)


def checksum(uri: str) -> str:
    """SHA-256 of a file, read in blocks."""
    import hashlib

    filesystem, path = _filesystem(uri)
    digest = hashlib.sha256()
    with filesystem.open_input_stream(path) as reader:
        while block := reader.read(8 << 20):
            digest.update(block)
    return digest.hexdigest()


def copy_file(source: str, target: str, size: int) -> int | None:
    """Copy one file in blocks, to a temporary name first.

    Returns the bytes at the target once its checksum is the source's, else nothing. A target of
    the same content is left as it is; one of other content is an error and stays.
    """
    import uuid

    from pyarrow import fs

    from_fs, from_path = _filesystem(source)
    to_fs, to_path = _filesystem(target)
    done = to_fs.get_file_info(to_path)
    if done.type == fs.FileType.File:
        if done.size == size and checksum(target) == checksum(source):
            return done.size
        raise FileExistsError(f"{target} holds other content than {source}")
    to_fs.create_dir(to_path.rsplit("/", 1)[0], recursive=True)
    part = f"{to_path}.part-{uuid.uuid4().hex}"
    with from_fs.open_input_stream(from_path) as reader, to_fs.open_output_stream(part) as writer:
        while block := reader.read(8 << 20):
            writer.write(block)
    to_fs.move(part, to_path)
    return to_fs.get_file_info(to_path).size if checksum(target) == checksum(source) else None


def copy_files(moves: DataFrame) -> DataFrame:
    """Copy each file in the task that holds its row; adds ``copied_bytes``.

    A repeated or speculative task finds finished targets and skips them, so losing an executor
    costs only the files it was copying. Nothing is deleted here.
    """
    schema = T.StructType([*moves.schema.fields, T.StructField("copied_bytes", T.LongType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["copied_bytes"] = [
                copy_file(s, t, n) for s, t, n in zip(batch["path"], batch["target"], batch["bytes"])
            ]
            yield batch

    return moves.repartition("path").mapInPandas(run, schema)


def delete_files(moves: DataFrame) -> int:
    """Delete the originals of copies whose checksum was compared; call it after the manifest is stored."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            gone = 0
            for path in batch["path"]:
                filesystem, local = _filesystem(path)
                if filesystem.get_file_info(local).type == fs.FileType.File:
                    filesystem.delete_file(local)
                    gone += 1
            yield pd.DataFrame({"deleted": [gone]})

    finished = moves.where(F.col("copied_bytes") == F.col("bytes")).select("path")
    total = finished.mapInPandas(run, "deleted long").agg(F.sum("deleted")).first()[0]
    return total or 0
