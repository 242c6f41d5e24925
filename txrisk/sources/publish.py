"""Replacing a stored folder only by one that is finished and checked."""

import uuid


def _files(spark, path):
    """(file system, path) of Hadoop for a path."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def exists(spark, path):
    files, place = _files(spark, path)
    return files.exists(place)


def names_below(spark, path):
    """Names of the entries of a folder; none if it isn't there."""
    files, place = _files(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(place)) if files.exists(place) else []


def remove(spark, path):
    files, place = _files(spark, path)
    return files.delete(place, True)


def _renamed(spark, old, new):
    files, source = _files(spark, old)
    if not files.rename(source, _files(spark, new)[1]):
        raise OSError(f"{old} could not be renamed to {new}")


def replace(spark, finished, path):
    """Puts ``finished`` where ``path`` is; what was there goes last, and comes back if that fails."""
    aside = f"{path}.replaced-{uuid.uuid4().hex}"
    had_one = exists(spark, path)
    if had_one:
        _renamed(spark, path, aside)
    try:
        _renamed(spark, finished, path)
    except BaseException:
        if had_one:
            _renamed(spark, aside, path)
        raise
    if had_one:
        remove(spark, aside)


def publish(spark, path, write, check):
    """Calls ``write`` and ``check`` with an unfinished name, then renames; returns what ``check`` gives.

    If either raises, what was at ``path`` stays as it was and nothing unfinished is left. The rename
    is one step on HDFS and local disks; on object stores it copies.
    """
    unfinished = f"{path}.unfinished-{uuid.uuid4().hex}"
    try:
        write(unfinished)
        found = check(unfinished)
        replace(spark, unfinished, path)
    except BaseException:
        remove(spark, unfinished)
        raise
    return found
