"""Walking trees, scanning them again, packages by ranged reads."""

from __future__ import annotations

import io
import os
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from lexigrain.operators import office
from lexigrain.plans.workspace import Workspace
from lexigrain.sources import containers, walk

NBSP = " "


def tree(root, files):
    for name, data in files.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data if isinstance(data, bytes) else data.encode())


def names(df, root):
    return sorted(r.path.removeprefix(f"{root}/") for r in df.collect())


def test_walk(spark, tmp_path):
    root = tmp_path / "root"
    tree(root, {"a.md": "x", "b.bin": "x", "d/e/f/g/deep.TXT": "yy", "d/node_modules/h.md": "x", "target/i.md": "x", "d/own/j.md": "x", "k.docx": b"PK", "noext": "x"})
    (root / "loop").symlink_to(root)
    (root / "link.md").symlink_to(root / "a.md")
    (tmp_path / "root-link").symlink_to(root)
    files, errors = walk.walk(spark, [str(root)], ignored=["own"])
    assert names(files, root) == ["a.md", "d/e/f/g/deep.TXT", "k.docx"] and errors.count() == 0
    assert {r.path.rsplit("/")[-1]: r.size for r in files.collect()}["deep.TXT"] == 2
    files, errors = walk.walk(spark, [str(root), str(root / "a.md"), str(root / "missing"), str(tmp_path / "root-link")], extensions=[".BIN"], all_files=False)
    assert names(files, root) == ["b.bin", "k.docx"] and [r.path for r in errors.collect()] == [str(root / "missing")]
    files, _ = walk.walk(spark, [str(root)], all_files=True)
    assert names(files, root) == ["a.md", "b.bin", "d/e/f/g/deep.TXT", "d/own/j.md", "k.docx", "noext"]


def test_ignored_folders_are_never_listed(tmp_path, monkeypatch):
    tree(tmp_path, {"src/a.md": "x", "node_modules/b/c.md": "x"})
    (tmp_path / "src" / "up").symlink_to(tmp_path)
    seen, scan = [], os.scandir
    monkeypatch.setattr(os, "scandir", lambda p: seen.append(os.path.basename(p)) or scan(p))
    left = [str(tmp_path)]
    while left:
        left += [e[0] for e in walk.entries(left.pop(), frozenset(["node_modules"])) if e[1] == "dir"]
    assert seen == [tmp_path.name, "src"]


def test_path_order(spark):
    paths = ["Zeta.md", "alpha.md", "Alpha.md", "éclair.md", "echo.md", "eclair.md", "zeta.md", "beta/a.md", "beta.md", "10.md", "9.md", "_x.md"]
    got = [r.p for r in spark.createDataFrame([(p,) for p in random.Random(1).sample(paths, len(paths))], "p string").orderBy(*walk.path_order("p")).collect()]
    assert got == ["_x.md", "10.md", "9.md", "alpha.md", "Alpha.md", "beta.md", "beta/a.md", "echo.md", "eclair.md", "éclair.md", "zeta.md", "Zeta.md"]


def touch(path, seconds):
    t = os.stat(path).st_mtime_ns + seconds * 10**9
    os.utime(path, ns=(t, t))


def test_workspace_reads_only_what_changed(spark, tmp_path):
    root, ws = tmp_path / "root", Workspace(spark, str(tmp_path / "state"))
    tree(root, {"a.md": f"x{NBSP}", "b.md": "clean", "c/d.md": f"{NBSP}{NBSP}", "bad.txt": b"\xc3\x28", "gone.md": NBSP})

    def totals():
        return {r.path.removeprefix(f"{root}/"): (r.n_findings, r.error, r.run) for r in ws.files().collect()}

    def found():
        return sorted((r.path.removeprefix(f"{root}/"), r.name, r.scalar_index) for r in ws.findings().collect())

    assert ws.scan([str(root)]).count() == 0
    first = totals()
    assert first == {"a.md": (1, None, 0), "b.md": (0, None, 0), "c/d.md": (2, None, 0), "bad.txt": (0, "malformed UTF-8", 0), "gone.md": (1, None, 0)}
    # the same again: contents that cannot be read any more are not missed
    os.rename(root / "a.md", tmp_path / "kept")
    size, times = os.stat(tmp_path / "kept").st_size, os.stat(tmp_path / "kept")
    (root / "a.md").write_bytes(b"y" * size)
    os.utime(root / "a.md", ns=(times.st_atime_ns, times.st_mtime_ns))
    ws.scan([str(root)])
    assert totals() == first and found() == [("a.md", "NBSP", 1), ("c/d.md", "NBSP", 0), ("c/d.md", "NBSP", 1), ("gone.md", "NBSP", 0)]
    # one changed, one touched only, one new, one gone, one mended
    tree(root, {"c/d.md": f"now {NBSP}", "new.md": "​", "bad.txt": "good"})
    os.remove(root / "gone.md")
    touch(root / "b.md", 5)
    touch(root / "c/d.md", 5)
    ws.scan([str(root)])
    assert totals() == {"a.md": (1, None, 0), "b.md": (0, None, 0), "c/d.md": (1, None, 2), "bad.txt": (0, None, 2), "new.md": (1, None, 2)}
    assert found() == [("a.md", "NBSP", 1), ("c/d.md", "NBSP", 4), ("new.md", "ZWSP", 0)]
    ws.compact()
    ws.scan([str(root)])
    assert totals()["c/d.md"] == (1, None, 2) and len(found()) == 3


# packages


def package(path, members, hole=0):
    with open(path, "wb") as f:
        f.seek(hole)
        with zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
            for name, data in members.items():
                z.writestr(zipfile.ZipInfo(name) if name.startswith("stored") else name, data)


class Counting(io.FileIO):
    read_bytes = 0

    def read(self, n=-1):
        out = super().read(n)
        Counting.read_bytes += len(out)
        return out


def test_a_large_package_needs_its_wanted_bytes_only(tmp_path, monkeypatch):
    path = str(tmp_path / "large.docx")
    package(path, {"word/document.xml": "x" * 5000, "big.bin": os.urandom(3_000_000), "last.txt": "z"}, hole=3 << 30)
    assert os.path.getsize(path) > 3 << 30

    class System:
        open_input_file = staticmethod(lambda p: Counting(p))

    monkeypatch.setattr(containers, "opened", lambda p: (System, p))
    found = [e for e in containers._entries(path) if e[1] == "word/document.xml"]
    _, _, size, packed, method, at, _ = found[0]
    with Counting(path) as f:
        assert containers._member(f, at, packed, size, method) == b"x" * 5000
    assert Counting.read_bytes < 100_000


def test_members_by_ranges(spark, tmp_path):
    r = random.Random(5)
    members = {f"m/{k}.txt": r.randbytes(r.choice([0, 1, 50_000])) for k in range(30)} | {"stored.bin": b"s" * 70_000, "text.xml": "é" * 40_000}
    package(tmp_path / "a.zip", members)
    (tmp_path / "bad.zip").write_bytes(b"PK nothing")
    broken = bytearray((tmp_path / "a.zip").read_bytes())
    broken[40:60] = b"\0" * 20
    (tmp_path / "c.zip").write_bytes(broken)
    files = spark.createDataFrame([(str(tmp_path / n),) for n in ("a.zip", "bad.zip", "c.zip", "missing.zip")], "path string")
    listed = containers.zip_directory(files)
    assert listed.filter("error is not null").count() == 2
    rows = containers.zip_contents(listed, group_bytes=100_000).collect()
    want = {n: (d.encode() if isinstance(d, str) else d) for n, d in members.items()}
    assert {x.member: bytes(x.data) for x in rows if x.path.endswith("a.zip")} == want
    c = [x for x in rows if x.path.endswith("c.zip")]
    assert len(c) == 32 and 1 <= sum(x.error is not None for x in c) <= 2 and all(x.data is None or bytes(x.data) == want[x.member] for x in c)
    assert sum(x.member is None for x in rows) == 2
    spark.dataSource.register(containers.ZipMembers)
    read = spark.read.format("zip_members").option("member", r"^m/\d\.txt$|^text").option("groupBytes", 60_000).load(str(tmp_path / "a.zip"))
    assert {x.member: bytes(x.data) for x in read.collect()} == {n: d for n, d in want.items() if n == "text.xml" or len(n) == 7} and read.rdd.getNumPartitions() > 1
    with pytest.raises(Exception, match="bad.zip"):
        spark.read.format("zip_members").load(str(tmp_path / "bad.zip")).count()


def test_findings_in_packages_by_path(spark, tmp_path):
    package(tmp_path / "a.docx", {"word/document.xml": f"<w:t>a{NBSP}</w:t><w:rPr><w:webHidden/></w:rPr>", "word/media/x.bin": b"\xff" * 9})
    package(tmp_path / "b.pptx", {"ppt/slides/slide1.xml": '<p:sp hidden="1"/>'})
    (tmp_path / "c.xlsx").write_bytes(b"none")
    files = spark.createDataFrame([(str(tmp_path / n),) for n in ("a.docx", "b.pptx", "c.xlsx")], "path string")
    found, errors = office.find_in_packages(files)
    assert sorted(r.name for r in found.collect()) == ["NBSP", "OOXML_HIDDEN_SHAPE", "OOXML_WEB_HIDDEN_RUN"]
    assert [r.path for r in errors.collect()] == [str(tmp_path / "c.xlsx")]
    same = files.withColumns({"extension": F.regexp_extract("path", r"(\.\w+)$", 1)}).join(walk.contents(files).drop("error"), "path")
    assert sorted(r.name for r in office.find_in_containers(same)[0].collect()) == ["NBSP", "OOXML_HIDDEN_SHAPE", "OOXML_WEB_HIDDEN_RUN"]
