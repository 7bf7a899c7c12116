"""Files in the shared folder, written and read by tasks."""

from __future__ import annotations

from pyarrow import fs


def located(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def write_file(stem: str, ending: str, data: bytes) -> str:
    """Write a file named by ``stem`` and the task's attempt; its name.

    No attempt touches another's file, so nothing is renamed or replaced: the table of names that Spark commits lists
    the files of the attempts that counted, and nobody reads what a lost attempt left.
    """
    from pyspark import TaskContext

    task = TaskContext.get()
    uri = f"{stem}-{task.taskAttemptId() if task else 0}{ending}"
    system, path = located(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    with system.open_output_stream(path, compression=None) as f:
        f.write(data)
    return uri


def read_file(uri: str) -> bytes:
    system, path = located(uri)
    with system.open_input_file(path) as f:
        return f.read()


def task_number() -> int:
    from pyspark import TaskContext

    task = TaskContext.get()
    return task.partitionId() if task else 0
