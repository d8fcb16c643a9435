"""Versioned documents and small files in any store."""

import os
import threading

import pytest

from wordtide.sources import files, store


@pytest.fixture(params=["file", "viewfs"])
def root(request, spark, tmp_path):
    if request.param == "file":
        return str(tmp_path)
    name = f"t{abs(hash(str(tmp_path)))}"
    spark._jsc.hadoopConfiguration().set(f"fs.viewfs.mounttable.{name}.link./in", f"file://{tmp_path}")
    return f"viewfs://{name}/in"


def test_documents(spark, root):
    path = f"{root}/deep/report.json"
    assert files.read_report(spark, path) is None
    for i in range(1, 8):
        assert files.write_document(spark, {"n": i, "text": "é" * i}, path) == i
        assert files.read_report(spark, path) == {"n": i, "text": "é" * i}
    assert len(store._versions(spark, path)) <= store.KEPT
    # what a writer that stopped half-way left behind is not read
    store.write_bytes(spark, f"{path}/.new-half/document", b'{"n": ')
    assert files.read_report(spark, path)["n"] == 7 and files.write_document(spark, {"n": 8}, path) == 8
    # a folder that is there already is not taken, and nothing is left in it
    assert store.claim(spark, f"{path}/v-0000000008", {"document": b"other"}) is None and files.read_report(spark, path) == {"n": 8}
    fs, p = store.place(spark, f"{path}/v-0000000008")
    assert sorted(x.getPath().getName() for x in fs.listStatus(p)) == ["document", "owner"]
    store.write_bytes(spark, f"{root}/plain.json", b'{"a": 1}')
    assert files.read_report(spark, f"{root}/plain.json") == {"a": 1}


def test_readers_see_whole_documents_and_writers_share_no_version(spark, tmp_path):
    path, got, numbers = str(tmp_path / "doc"), [], []
    body = "x" * 200_000

    def write(w):
        for i in range(12):
            numbers.append(files.write_document(spark, {"w": w, "i": i, "body": body}, path))

    def read():
        while any(t.is_alive() for t in writers):
            if (d := files.read_report(spark, path)) is not None:
                got.append(len(d["body"]))

    writers = [threading.Thread(target=write, args=(w,)) for w in range(3)]
    reader = threading.Thread(target=read)
    for t in [*writers, reader]:
        t.start()
    for t in [*writers, reader]:
        t.join(120)
    assert sorted(numbers) == sorted(set(numbers)) and len(numbers) == 36
    assert got and set(got) == {200_000}


def test_refused(spark, tmp_path):
    (tmp_path / "big.json").write_text(" " * (files.MAX_REPORT_BYTES + 1))
    with pytest.raises(ValueError, match="larger"):
        files.read_report(spark, str(tmp_path / "big.json"))
    (tmp_path / "real.json").write_text("{}")
    os.symlink(tmp_path / "real.json", tmp_path / "link.json")
    with pytest.raises(ValueError, match="link"):
        files.read_report(spark, str(tmp_path / "link.json"))


def test_lists(spark, root):
    assert files.curated_list(spark, f"{root}/own/list.txt", ["# c", "Flies", "at the end", ""]) == (["fly"], ["at the end"])
    assert files.curated_list(spark, f"{root}/own/list.txt", ["other"]) == (["fly"], ["at the end"])
    store.write_bytes(spark, f"{root}/names.txt", "Berlin\n# no\n\nÉlan\n".encode())
    assert files.proper_nouns(spark, f"{root}/names.txt", f"{root}/absent.txt") == ["berlin", "élan"]
