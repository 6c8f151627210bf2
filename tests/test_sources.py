"""Folders and archives read by the data sources."""

import gzip
import io
import os
import random
import tarfile
import tracemalloc

import pytest

from repoaudit.sources import archives, snapshots


def archive(*rows, root="root/"):
    """Bytes of an archive of (path, data or tar type)."""
    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode="w:gz") as tar:
        for path, data in rows:
            info = tarfile.TarInfo(root + path)
            if not isinstance(data, str):
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))
            else:
                info.type, info.linkname = data.encode(), "/etc/passwd"
                tar.addfile(info)
    return buffer.getvalue()


def write(folder, **data):
    for name, content in data.items():
        (folder / f"{name}.tar.gz").write_bytes(content)


def read(spark, folder, **limits):
    rows = archives.load_archives(spark, f"{folder}/*.tar.gz", **limits).collect()
    return {(r["repo_id"], r["path"]): r for r in rows}, rows


def test_members_of_archives(spark, tmp_path):
    write(tmp_path, a=archive(("x.py", b"hi\xff"), ("d/y.txt", b"y"), ("b.BIN", b"1"), ("nul", b"a\x00"), ("late", b"a" * 1024 + b"\x00"), ("node_modules/z.js", b"1"), ("src/dist/z.js", b"1"), ("dist", b"file"), ("big.txt", b"1" * 50_000), ("link", "2"), ("dir", "5"), ("dev", "3"), ("empty", b"")))
    (tmp_path / "notes.txt").write_text("no archive")
    (tmp_path / "sub").mkdir()
    write(tmp_path / "sub", deeper=archive(("x", b"1")))
    got, rows = read(spark, tmp_path, max_file_size=40_000)
    assert [(r["file_pos"], r["path"]) for r in sorted(rows, key=lambda r: r["file_pos"])] == list(enumerate(["x.py", "d/y.txt", "b.BIN", "nul", "late", "dist", "big.txt", "empty"]))
    assert got["a", "x.py"]["content"] == "hi�" and got["a", "empty"]["content"] == "" and got["a", "dist"]["content"] == "file"
    assert {p for (_, p), r in got.items() if r["is_binary"]} == {"b.BIN", "nul"} and {p for (_, p), r in got.items() if r["truncated"]} == {"big.txt"}
    assert all((r["content"] is None) == (r["path"] in ("b.BIN", "nul", "big.txt")) and r["error"] is None and not r["beyond_cap"] for r in rows)
    assert {r["repo_id"] for r in archives.load_archives(spark, f"file://{tmp_path}/sub/*.gz").collect()} == {"deeper"}


def test_cap_counts_members_beyond(spark, tmp_path):
    write(tmp_path, a=archive(*((f"f{i}", b"x") for i in range(10))))
    _, rows = read(spark, tmp_path, max_files=3)
    assert len(rows) == 10 and sorted(r["file_pos"] for r in rows if not r["beyond_cap"]) == [0, 1, 2] and all(r["content"] is None for r in rows if r["beyond_cap"])
    assert sum(r["beyond_cap"] for r in read(spark, tmp_path, max_files=None)[1]) == 0


def test_broken_archives_are_rows(spark, tmp_path):
    whole = archive(*((f"f{i}", os.urandom(3000)) for i in range(20)))
    write(tmp_path, cut=whole[: len(whole) // 2], text=b"<html>", empty=b"", gz=gzip.compress(b"no tar" * 100), good=archive(("x", b"1")), large=whole)
    got, rows = read(spark, tmp_path, max_bytes=len(whole) - 1)
    errors = {r["repo_id"]: r["error"] for r in rows if r["error"]}
    assert set(errors) == {"cut", "text", "empty", "gz", "large"} and "more than" in errors["large"]
    assert ("good", "x") in got and 0 < sum(r["repo_id"] == "cut" and r["error"] is None for r in rows) < 20
    table = spark.createDataFrame([(n, (tmp_path / f"{n}.tar.gz").read_bytes()) for n in ("cut", "text", "good", "large")] + [("null", None)], "repo_id string, content binary")
    landed = archives.read_archives(table, max_bytes=len(whole) - 1).collect()
    assert {r["repo_id"] for r in landed if r["error"]} == {"cut", "text", "large", "null"}
    as_set = lambda rs, names: {tuple(r) for r in rs if r["repo_id"] in names}
    assert as_set(landed, ("cut", "good", "large")) == as_set(rows, ("cut", "good", "large"))


@pytest.mark.parametrize("level", [0, 6])
def test_no_cut_archive_passes_for_whole(level):
    """Wherever a gzip stream is cut, within headers too, either no member is lost or there is an error (test_broken_archives_are_rows of round 4 met such a cut by chance)."""
    noise = random.Random(4)
    whole = gzip.compress(gzip.decompress(archive(*((f"f{i}", noise.randbytes(700)) for i in range(6)))), level)
    read = lambda data: list(archives.members("r", io.BytesIO(data), archives.Limits()))
    rows = read(whole)
    assert len(rows) == 6 and not any(r[-1] for r in rows)
    for at in range(len(whole)):
        got = read(whole[:at])
        assert got == rows or got[-1][-1] is not None and got[:-1] == rows[: len(got) - 1]


def test_no_archives_and_many(spark, tmp_path, monkeypatch):
    assert archives.load_archives(spark, f"{tmp_path}/*.tar.gz").collect() == []
    assert archives.load_archives(spark, f"{tmp_path}/none/*.tar.gz").collect() == []
    write(tmp_path, **{f"r{i}": archive((f"f{i}", b"x" * i)) for i in range(30)})
    tasks = archives.ArchiveReader(f"{tmp_path}/*.tar.gz", archives.Limits()).partitions()
    assert len(tasks) == 1 and len(tasks[0].paths) == 30
    monkeypatch.setattr(archives, "TASK_BYTES", 300)
    tasks = archives.ArchiveReader(f"{tmp_path}/r?.tar.gz", archives.Limits()).partitions()
    assert 3 <= len(tasks) <= 10 and sorted(p.rpartition("/")[2] for t in tasks for p, _ in t.paths) == [f"r{i}.tar.gz" for i in range(10)]
    assert {(r["repo_id"], r["path"], r["size"]) for r in read(spark, tmp_path)[1]} == {(f"r{i}", f"f{i}", i) for i in range(30)}


def test_memory_follows_a_member_and_not_the_archive(tmp_path):
    """400 MB in 200 members and one of 200 MB: batches are bounded, what is too large is passed by."""
    path = tmp_path / "huge.tar.gz"
    block = b"word " * (400_000)
    with tarfile.open(path, "w:gz", compresslevel=1) as tar:
        for name, data, times in [(f"root/f{i}", block[: 2_000_000], 1) for i in range(200)] + [("root/large", block, 100)]:
            info = tarfile.TarInfo(name)
            info.size = len(data) * times
            tar.addfile(info, io.BytesIO(data) if times == 1 else Repeated(data, times))
    reader = archives.ArchiveReader(str(path), archives.Limits(None, 4_000_000))
    tracemalloc.start()
    n = rows = 0
    for batch in reader.read(reader.partitions()[0]):
        n, rows = n + 1, rows + len(batch)
        assert batch.nbytes < 16 << 20
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 201 and n > 50 and peak < 64 << 20


class Repeated(io.RawIOBase):
    def __init__(self, data, times):
        self.data, self.left = data, len(data) * times

    def read(self, n=-1):
        n = min(n, self.left, len(self.data))
        self.left -= n
        return self.data[:n]


def test_snapshots_hold_hidden_names_in_the_order_of_a_walk(spark, tmp_path):
    files = [".env", ".github/workflows/ci.yml", "_config.yml", "B.txt", "a/__init__.py", "a/z.py", "a/b/c.py", "a.txt", "é/ü.txt", "src/__tests__/t.js", "z/.hidden/x"]
    for path in [*files, "node_modules/q.js", "a/dist/q.js", "z/.git/config"]:
        target = tmp_path / "root" / "r1" / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(f"text of {path}")
    (tmp_path / "root" / "r2").mkdir()
    (tmp_path / "secret.txt").write_text("outside")
    os.symlink(tmp_path / "secret.txt", tmp_path / "root" / "r1" / "link.txt")
    os.symlink(tmp_path / "root" / "r1" / "a", tmp_path / "root" / "r1" / "again")
    os.symlink(tmp_path / "root" / "r1", tmp_path / "root" / "r3")
    rows = sorted(snapshots.read_snapshots(spark, str(tmp_path / "root")).collect(), key=lambda r: r["file_pos"])
    want = []
    for folder, folders, names in os.walk(tmp_path / "root" / "r1"):
        folders[:] = sorted(f for f in folders if f not in ("node_modules", "dist", ".git", "again"))
        want += [os.path.relpath(os.path.join(folder, n), tmp_path / "root" / "r1") for n in sorted(names) if n != "link.txt"]
    assert [(r["repo_id"], r["file_pos"], r["path"], r["content"]) for r in rows] == [("r1", i, p, f"text of {p}") for i, p in enumerate(want)] and len(rows) == len(files)


def test_snapshots_by_pattern_and_size(spark, tmp_path):
    rng = random.Random(1)
    for repo in ("one", "two", "other"):
        for i in range(40):
            target = tmp_path / repo / f"d{i % 3}" / f"f{i}.txt"
            target.parent.mkdir(parents=True, exist_ok=True)
            target.write_bytes(bytes(rng.randrange(256) for _ in range(i * 10)))
    rows = snapshots.read_snapshots(spark, f"file://{tmp_path}", "o*", max_file_size=200).collect()
    assert {r["repo_id"] for r in rows} == {"one", "other"} and len(rows) == 80
    assert all(r["truncated"] == (r["size"] > 200) for r in rows) and all((r["content"] is None) == (r["truncated"] or r["is_binary"]) for r in rows)
    for r in rows:
        data = (tmp_path / r["repo_id"] / r["path"]).read_bytes()
        assert r["size"] == len(data) and (r["truncated"] or r["is_binary"] == (b"\x00" in data)) and (r["content"] is None or len(r["content"]) == len(data.decode("utf-8", "replace")))
    assert snapshots.read_snapshots(spark, str(tmp_path), "none*").collect() == []


@pytest.mark.parametrize("url, base, glob", [("/a/b/*.tgz", "/a/b", "*.tgz"), ("/a/b*/c.tgz", "/a", "b*/c.tgz"), ("file:///a/b.tgz", "/a", "b.tgz")])
def test_urls(url, base, glob):
    _, folder, pattern = archives.ArchiveReader(url, archives.Limits()).storage()
    assert (folder, pattern) == (base, glob)
