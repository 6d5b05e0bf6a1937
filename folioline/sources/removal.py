"""Deletes and clears that take files out of a stored folder ``<root>/<bucket>/[<folder>/]<name>``.

What goes is decided by the listing operators on a manifest ``(bucket, folder, name)``, on Spark, and
written down before anything is touched. Tasks then remove the files; one that is gone already is no
fault, so a task that runs twice, or a job that is started again, ends the same way. Folders that
are left without files go at the end, deepest first.

Defined results: a place outside its bucket (an empty part, ``.`` or ``..``) is never touched and is not
``removed``; requests that repeat, or name one file twice, remove it once; null bucket, folder or
name is not a place; files that the manifest does not name stay, and so do their folders.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioline.operators import listings
from folioline.session import ship_package, written
from folioline.sources.record_folder import opened

_PLACE = ["bucket", "folder", "name"]


def _path(bucket: str | None, folder: str | None, name: str | None) -> str | None:
    if bucket is None or folder is None or name is None:
        return None
    parts = [bucket, *(folder.split("/") if folder else []), name]
    bad = any(part in ("", ".", "..") or "\x00" in part for part in parts) or "/" in bucket or "/" in name
    return None if bad else "/".join(parts)


def _remove(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(root)
        for batch in batches:
            removed = []
            for place in zip(*[batch.column(c).to_pylist() for c in _PLACE], strict=True):
                path = _path(*place)
                if path is not None:
                    full = posixpath.join(base, path)
                    if system.get_file_info(full).type == fs.FileType.File:
                        try:
                            system.delete_file(full)
                        except FileNotFoundError:
                            pass  # another attempt of this task was first
                removed.append(path is not None)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in _PLACE], pa.array(removed)], names=[*_PLACE, "removed"])

    return run


def _remove_empty(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(root)
        for batch in batches:
            gone = []
            for bucket, top in zip(batch.column("bucket").to_pylist(), batch.column("top").to_pylist(), strict=True):
                path = posixpath.join(base, bucket, top)
                found = system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
                kept = [i.path for i in found if i.type == fs.FileType.File]
                folders = sorted((i.path for i in found if i.type == fs.FileType.Directory), key=len, reverse=True)
                for folder in [*folders, path]:
                    if any(file.startswith(f"{folder}/") for file in kept):
                        continue
                    if system.get_file_info(folder).type == fs.FileType.Directory:
                        system.delete_dir(folder)
                gone.append(not kept)
            yield pa.RecordBatch.from_arrays([batch.column("bucket"), batch.column("top"), pa.array(gone)], names=["bucket", "top", "gone"])

    return run


def remove_files(places: DataFrame, root: str) -> DataFrame:
    """Remove ``places`` (bucket, folder, name) below ``root`` and return them with ``removed``."""
    ship_package(places.sparkSession)
    chosen = places.select(*[F.col(c).cast("string").alias(c) for c in _PLACE]).distinct()
    done = written(chosen.mapInArrow(_remove(root), "bucket string, folder string, name string, removed boolean"), "removed")
    tops = done.where("removed AND folder != ''").select("bucket", F.element_at(F.split("folder", "/"), 1).alias("top"))
    # One row a top folder: a task looks through one such tree at a time.
    written(tops.distinct().mapInArrow(_remove_empty(root), "bucket string, top string, gone boolean"), "folders")
    return done


def delete_stored(files: DataFrame, requests: DataFrame, root: str, image_format: str = "png") -> DataFrame:
    """Apply delete requests ``(kind, bucket, target)`` to a folder; their outcomes.

    ``files`` is the folder's manifest, read before the first file goes.
    """
    files = written(files.select(*_PLACE), "manifest")
    outcomes = written(listings.delete_outcomes(files, requests, image_format), "outcomes")
    kept = listings.delete_survivors(files, requests, image_format)
    remove_files(files.join(kept, _PLACE, "left_anti"), root)
    return outcomes


def clear_stored(files: DataFrame, buckets: list[str], root: str, image_format: str = "png") -> DataFrame:
    """Clear ``buckets`` of a folder; the entries removed from each, as ``listings.clear_counts``."""
    files = written(files.where(F.col("bucket").isin(buckets)).select(*_PLACE), "manifest")
    counts = written(listings.clear_counts(files, image_format), "counts")
    remove_files(listings.clearable(files, image_format), root)
    return counts
