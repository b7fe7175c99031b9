"""Session logs of a home folder: ``<home>/sessions/<project>/<session>/<log name>``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.sources.sessionlog import LOG_NAME
from auditloom.sources.store import size_of, store_of

SESSION_LOGS = "path string, session_id string, project string, bytes bigint, modified_at bigint"


def find_session_logs(spark: SparkSession, home: str, name: str = LOG_NAME) -> DataFrame:
    """path, session_id, project, bytes, modified_at (ms), newest first; none where there is no such folder.

    Only the files' names, sizes and times are read.
    """
    store, inside = store_of(f"{home.rstrip('/')}/sessions")
    if not store.get_file_info(inside).is_file and store.get_file_info(inside).type.name == "NotFound":
        return spark.createDataFrame([], SESSION_LOGS)
    files = spark.read.format("binaryFile").option("pathGlobFilter", name).option("recursiveFileLookup", "true").load(f"{home.rstrip('/')}/sessions")
    path = F.regexp_replace("path", "^file:/+", "/")
    parts = r"/([^/]+)/([^/]+)/[^/]+\z"
    found = files.select(path.alias("path"), F.regexp_extract("path", parts, 2).alias("session_id"), F.regexp_extract("path", parts, 1).alias("project"), F.col("length").alias("bytes"), F.unix_millis("modificationTime").alias("modified_at"))
    depth = len(f"{home.rstrip('/')}/sessions".strip("/").split("/")) + 3
    return found.filter(F.size(F.split(F.regexp_replace("path", "^/+", ""), "/")) == depth).orderBy(F.desc("modified_at"), "path")


def resolve_log(spark: SparkSession, text: str, home: str) -> str:
    """A log's path: ``text`` itself if it is a file, else the one log whose session id begins with or has it."""
    try:
        if size_of(text):
            return text
    except (OSError, ValueError):
        pass
    found = find_session_logs(spark, home).filter(F.col("session_id").startswith(text) | F.col("session_id").contains(text)).limit(6).collect()
    if not found:
        raise LookupError(f'no session log matches "{text}"')
    if len(found) > 1:
        raise LookupError(f'"{text}" matches several sessions: ' + ", ".join(r.session_id for r in found[:5]))
    return found[0].path
