"""Small files in whatever store a path names, and documents in versions.

A document is a folder of versions, each a folder that was filled under a name of its own and put in place by one
rename; readers take the highest there is. Where a folder is there already, stores refuse such a rename or move the
new folder into it, and what lies in it then names another owner. So a reader never sees half a document and two
writers never share a version; nothing depends on a rename that replaces, nor on a file that only one can create.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import SparkSession

VERSION = re.compile(r"^v-([0-9]{10})$")
#: Versions that are kept for readers which have just listed them.
KEPT = 3


def place(spark: SparkSession, path: str):
    """The file system of a path, and the path in it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def read_bytes(spark: SparkSession, path: str, most: int | None = None) -> bytes | None:
    """A file's bytes; None if there is none. Links, and files of more than ``most`` bytes, are refused."""
    fs, p = place(spark, path)
    if not fs.exists(p):
        return None
    status = fs.getFileLinkStatus(p)
    if status.isSymlink():
        raise ValueError(f"{path} is a symbolic link")
    if most is not None and status.getLen() > most:
        raise ValueError(f"{path} is larger than {most} bytes")
    opened = fs.open(p)
    try:
        return bytes(opened.readAllBytes())
    finally:
        opened.close()


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    fs, p = place(spark, path)
    fs.mkdirs(p.getParent())
    out = fs.create(p, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def _versions(spark: SparkSession, path: str) -> list[int]:
    fs, p = place(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(m[1]) for n in names if (m := VERSION.match(n)))


def claim(spark: SparkSession, path: str, files: dict[str, bytes]) -> str | None:
    """Puts a folder with these files at a path where none is; returns the token that names its owner, None if another one has it."""
    token = uuid.uuid4().hex
    parent, _, name = path.rpartition("/")
    own = f"{parent}/.new-{token}"
    for n, data in {**files, "owner": token.encode()}.items():
        write_bytes(spark, f"{own}/{n}", data)
    fs, target = place(spark, path)
    try:
        if not fs.exists(target):
            fs.rename(place(spark, own)[1], target)
    except Exception:  # noqa: BLE001 - whatever the store says, the owner decides
        pass
    if owner(spark, path) == token:
        return token
    for rest in (own, f"{path}/.new-{token}"):
        fs.delete(place(spark, rest)[1], True)
    return None


def owner(spark: SparkSession, path: str) -> str | None:
    """The token in a folder that was claimed."""
    try:
        held = read_bytes(spark, f"{path}/owner")
    except Exception:  # noqa: BLE001 - it is gone, or no folder
        return None
    return None if held is None else held.decode("utf-8", "replace")


def publish(spark: SparkSession, path: str, data: bytes) -> int:
    """Adds a version; returns its number."""
    fs, top = place(spark, path)
    fs.mkdirs(top)
    held = _versions(spark, path)
    number = (held[-1] if held else 0) + 1
    while claim(spark, f"{path}/v-{number:010d}", {"document": data}) is None:
        number = max([number, *_versions(spark, path)]) + 1
    for old in _versions(spark, path)[:-KEPT]:
        fs.delete(place(spark, f"{path}/v-{old:010d}")[1], True)
    return number


def latest(spark: SparkSession, path: str, most: int | None = None) -> bytes | None:
    """The newest version; None if there is none. A plain file at the path is its own only version."""
    fs, p = place(spark, path)
    if not fs.exists(p):
        return None
    if not fs.getFileStatus(p).isDirectory():
        return read_bytes(spark, path, most)
    for _ in range(3):  # what was listed may be old by the time it is opened
        held = _versions(spark, path)
        if not held:
            return None
        data = read_bytes(spark, f"{path}/v-{held[-1]:010d}/document", most)
        if data is not None:
            return data
    return None
