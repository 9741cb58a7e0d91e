"""Extract zip archives in parallel, one task per archive.

The archive listing comes from Spark's ``binaryFile`` source with the
content column pruned, so only paths travel; each task opens its archive
from the shared file system and extracts it to ``dest/<archive name>/``.
The result is one status row per archive entry (or per failed archive), so a
bad archive is reported and skipped instead of stopping the run.
"""

from __future__ import annotations

import os
import zipfile
from urllib.parse import unquote, urlparse

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

STATUS_SCHEMA = "path string, entry string, bytes long, status string, error string"


def _local(path: str) -> str:
    u = urlparse(path)
    return unquote(u.path) if u.scheme in ("file", "") else path


def _extract_one(archive: str, dest_root: str) -> list[dict]:
    name = os.path.basename(archive)
    target = os.path.realpath(os.path.join(dest_root, name[:-4]))
    rows = []
    try:
        with zipfile.ZipFile(archive) as zf:
            for info in zf.infolist():
                out = os.path.realpath(os.path.join(target, info.filename))
                if out != target and not out.startswith(target + os.sep):
                    rows.append(dict(path=archive, entry=info.filename, bytes=0, status="skipped",
                                     error="entry leaves the target folder"))
                    continue
                zf.extract(info, target)
                rows.append(dict(path=archive, entry=info.filename, bytes=info.file_size, status="ok", error=None))
    except zipfile.BadZipFile as e:
        rows.append(dict(path=archive, entry=None, bytes=0, status="bad_archive", error=str(e)))
    except Exception as e:  # reported per archive, like the source step
        rows.append(dict(path=archive, entry=None, bytes=0, status="error", error=f"{type(e).__name__}: {e}"))
    return rows


def extract_archives(spark: SparkSession, source_dir: str, dest_dir: str) -> DataFrame:
    """Extract every ``*.zip`` directly in ``source_dir`` into ``dest_dir/<name>/``.

    Both folders must be visible to executors (a shared mount on a cluster).
    A missing source folder gives one ``error`` row instead of raising.
    """
    if not os.path.isdir(_local(source_dir)):
        return spark.createDataFrame([(source_dir, None, 0, "error", "source folder does not exist")],
                                     STATUS_SCHEMA)
    os.makedirs(_local(dest_dir), exist_ok=True)
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.zip")
             .option("recursiveFileLookup", "false").load(source_dir).select("path"))
    dest = _local(dest_dir)

    def run(batches):
        for pdf in batches:
            rows = [r for p in pdf["path"] for r in _extract_one(_local(p), dest)]
            yield pd.DataFrame(rows, columns=["path", "entry", "bytes", "status", "error"])

    # one archive per partition, so large archives extract in parallel
    n = max(1, files.count())
    return files.repartition(n, "path").mapInPandas(run, STATUS_SCHEMA)
