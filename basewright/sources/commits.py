"""Folders whose contents change as a whole: writers fill a folder of their own and then append one line to a log.

    folder/attempt-<hex>/...     all that one write made
    folder/_log/<number>         one small file a commit, which names the attempt that counts from then on

A log entry is put under the next free number only if nothing is there, whole from the start, so of two writers one
takes the number after the other's, and readers see one commit or the one before, never parts of two. Nothing is
deleted or renamed before or at a commit: a write that fails or is killed at any point leaves a folder that no log
entry names. ``vacuum`` removes such folders, and those of old commits, when it is called.

A folder that holds other things and no log is refused, so nothing that a sink did not write is ever in its way.
On local disks the entry is a hard link, on HDFS a rename that does not overwrite; both are atomic. A store without such
a rename cannot tell two writers at the same moment apart.
"""

from __future__ import annotations

import os
import time
import uuid

from pyspark.sql import SparkSession

LOG, ATTEMPT = "_log", "attempt-"


def located(spark: SparkSession, path: str):
    """Hadoop's file system and path; names without a scheme are on its default file system, relative ones in its working folder."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where = found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return where, where.makeQualified(found)


def qualified(spark: SparkSession, path: str) -> str:
    """A path that means the same to the driver, to Spark and to tasks."""
    return located(spark, path)[1].toString()


def names(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds; nothing if there is none."""
    where, found = located(spark, path)
    if not where.exists(found):
        return []
    if not where.getFileStatus(found).isDirectory():
        raise ValueError(f"{path} is a file")
    return [s.getPath().getName() for s in where.listStatus(found)]


def contents(spark: SparkSession, path: str) -> str:
    where, found = located(spark, path)
    stream = where.open(found)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Makes a file appear under a name, whole, unless the name is taken."""
    where, found = located(spark, path)
    part = located(spark, f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}")[1]
    stream = where.create(part, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    try:
        return linked(part, found) if where.getScheme() == "file" else renamed(spark, part, found)
    finally:
        where.delete(part, False)


def linked(part, found) -> bool:
    try:
        os.link(part.toUri().getPath(), found.toUri().getPath())
    except FileExistsError:
        return False
    return True


def put_local(path: str, text: str) -> bool:
    """``put_if_absent`` for writers without a session, on local and shared mounted folders."""
    folder, _, name = path.rpartition("/")
    part = f"{folder}/.{uuid.uuid4().hex}"
    with open(part, "x") as out:
        out.write(text)
    try:
        os.link(part, path)
    except FileExistsError:
        return False
    finally:
        os.unlink(part)
    return True


def renamed(spark: SparkSession, part, found) -> bool:
    gateway, jvm = spark.sparkContext._gateway, spark.sparkContext._jvm
    plain = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    plain[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(found.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(part, found, plain)
    except Exception as e:
        if "FileAlreadyExistsException" in str(e):
            return False
        raise
    return True


def entries(spark: SparkSession, folder: str) -> list[str]:
    """Log entries, the oldest first."""
    return sorted(n for n in names(spark, f"{folder}/{LOG}") if n.isdigit())


def attempt_of(spark: SparkSession, folder: str, entry: str) -> str:
    return contents(spark, f"{folder}/{LOG}/{entry}").strip()


def current(spark: SparkSession, folder: str, back: int = 0) -> str | None:
    """The path of what was committed last, or so many commits before; None where the folder has no log of ours."""
    where, found = located(spark, folder)
    if not where.exists(found) or not where.getFileStatus(found).isDirectory():
        return None
    known = names(spark, folder)
    if LOG not in known:
        if back or any(n.startswith(ATTEMPT) for n in known):
            raise FileNotFoundError(f"Nothing has been committed to {folder}")
        return None
    done = entries(spark, folder)
    if len(done) <= back:
        raise FileNotFoundError(f"{folder} has {len(done)} commits")
    return f"{qualified(spark, folder)}/{attempt_of(spark, folder, done[-1 - back])}"


def attempt(spark: SparkSession, folder: str, inputs: list[str] = ()) -> str:
    """The path of a new attempt in a folder. An error where the folder is, or holds, an input, or holds what no sink of ours wrote."""
    folder = qualified(spark, folder)
    for path in inputs:
        path = qualified(spark, path)
        if path == folder or path.startswith(f"{folder}/"):
            raise ValueError(f"{folder} is or holds the input {path}")
    known = names(spark, folder)
    other = [n for n in known if n != LOG and not n.startswith(ATTEMPT)]
    if other and LOG not in known:
        raise ValueError(f"{folder} holds files that were not written by this sink, such as {other[0]}")
    return f"{folder}/{ATTEMPT}{uuid.uuid4().hex}"


def commit(spark: SparkSession, path: str) -> int:
    """Makes an attempt the one that counts, and returns the commit's number."""
    folder, _, name = path.rpartition("/")
    where, found = located(spark, f"{folder}/{LOG}")
    where.mkdirs(found)
    while True:
        n = int((entries(spark, folder) or ["0"])[-1]) + 1
        if put_if_absent(spark, f"{folder}/{LOG}/{n:020d}", name):
            return n


def restore(spark: SparkSession, folder: str, back: int = 1) -> int:
    """Commits again what was committed before."""
    return commit(spark, current(spark, qualified(spark, folder), back))


def vacuum(spark: SparkSession, folder: str, keep: int = 2, hours: float = 24) -> list[str]:
    """Deletes attempts that none of the last `keep` commits names and that are older than so many hours, and returns their names.

    Only folders that a sink made are looked at. A reader or writer that has been at work for longer than that is not safe.
    """
    folder, before = qualified(spark, folder), 1000 * (time.time() - 3600 * hours)
    held = {attempt_of(spark, folder, e) for e in entries(spark, folder)[-max(1, keep) :]}
    gone = []
    for name in names(spark, folder):
        where, found = located(spark, f"{folder}/{name}")
        if name.startswith(ATTEMPT) and name not in held and where.getFileStatus(found).getModificationTime() < before:
            where.delete(found, True)
            gone.append(name)
    return gone
