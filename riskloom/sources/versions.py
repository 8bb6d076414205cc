"""Folders that change as a whole: parts go to a new version's folder, and a manifest written last makes it the current one.

A writer that stops half way leaves the former version as it was. Readers take the version of the highest manifest whose
parts are all there. Versions before the last two are removed once a new one is published.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

KEPT_VERSIONS = 2


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _manifests(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(number, file) of every manifest, the highest first."""
    files, where = _files(spark, f"{path}/manifests")
    if not files.exists(where):
        return []
    found = [f.getPath() for f in files.listStatus(where) if f.getPath().getName().endswith(".json")]
    return sorted(((int(f.getName().split(".")[0]), f.toString()) for f in found), reverse=True)


def new_folder(path: str) -> str:
    """A folder for the parts of a version to come."""
    return f"{path}/versions/{uuid.uuid4().hex}"


def publish(spark: SparkSession, path: str, folder: str, parts: list[str], meta: dict) -> int:
    """Make the folder with its parts the current version; its number."""
    text = json.dumps({"folder": folder.rsplit("/", 1)[1], "parts": parts, "meta": meta})
    before = _manifests(spark, path)
    number = before[0][0] + 1 if before else 1
    files, draft = _files(spark, f"{path}/drafts/{uuid.uuid4().hex}")
    out = files.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    files.mkdirs(_files(spark, f"{path}/manifests")[1])
    # A rename never replaces a manifest, so that two writers get two numbers.
    while not files.rename(draft, _files(spark, f"{path}/manifests/{number:012d}.json")[1]):
        taken = _manifests(spark, path)
        if not taken or taken[0][0] < number:
            raise OSError(f"no manifest can be written under {path}")
        number = taken[0][0] + 1
    for _, old in _manifests(spark, path)[KEPT_VERSIONS:]:
        gone = json.loads(_read(spark, old))["folder"]
        files.delete(_files(spark, old)[1], False)
        files.delete(_files(spark, f"{path}/versions/{gone}")[1], True)
    return number


def _read(spark: SparkSession, file: str) -> str:
    return spark.read.text(file, wholetext=True).first()["value"]


def current(spark: SparkSession, path: str) -> tuple[dict, str] | None:
    """(meta, folder) of the current version, or None."""
    files, _ = _files(spark, path)
    for _, manifest in _manifests(spark, path):
        found = json.loads(_read(spark, manifest))
        folder = f"{path}/versions/{found['folder']}"
        if all(files.exists(_files(spark, f"{folder}/{p}")[1]) for p in found["parts"]):
            return found["meta"], folder
    return None
