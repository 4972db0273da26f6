import os

import pytest

from vesper.operators.summary import walk_errors
from vesper.sources import walk as w
from vesper.sources.listing import scan_report

TREE = ("a.jpg", "b.txt", "sub/c.png", "sub/deep/d.webp", "sub/deep/deeper/e.gif", "v.mp4", "E.JPG", "empty/.keep", "other/f.jpeg")


@pytest.fixture
def tree(tmp_path):
    for name in TREE:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * len(name))
    return str(tmp_path)


def watched(log, refused=()):
    """Lists as scandir(), notes what was listed, and refuses some directories."""

    def read(directory):
        with open(log, "a") as f:
            f.write(directory + "\n")
        if os.path.basename(directory) in refused:
            raise PermissionError(13, "denied")
        yield from w.scandir(directory)

    return read


def names(scan):
    return [os.path.basename(r["path"]) for r in scan.rows.orderBy("ordinal").collect()]


@pytest.mark.parametrize("lister", [None, w.by_call(w.arrow_list)])
def test_depth_and_types(spark, tree, lister):
    found = w.scan(spark, tree, videos=True, lister=lister)
    rows = {r["path"]: r for r in found.rows.collect()}
    assert {os.path.relpath(p, tree): r["file_size"] for p, r in rows.items()} == {n: len(n) for n in TREE if n.rsplit(".", 1)[1] in ("jpg", "jpeg", "png", "webp", "gif", "mp4")}
    assert all(r["dir"] == os.path.dirname(p) and r["mtime"] == int(os.stat(p).st_mtime) for p, r in rows.items())
    assert [r["ordinal"] for r in sorted(rows.values(), key=lambda r: (r["dir"], r["path"]))] == list(range(len(rows)))
    assert names(w.scan(spark, tree, depth=0, lister=lister)) == ["a.jpg"] and names(w.scan(spark, tree, images=False, videos=True)) == ["v.mp4"]
    assert found.levels == 4 and found.errors.count() == 0


def test_the_depth_prunes_the_walk(spark, tree, tmp_path_factory):
    log = tmp_path_factory.mktemp("log") / "listed"
    found = w.scan(spark, tree, depth=1, lister=w.by_call(watched(str(log))))
    assert names(found) == ["a.jpg", "f.jpeg", "c.png"] and found.levels == 2
    assert sorted(os.path.relpath(d, tree) for d in log.read_text().split()) == [".", "empty", "other", "sub"]


def test_what_cant_be_read_is_an_error_and_the_rest_stands(spark, tree, tmp_path_factory):
    log = tmp_path_factory.mktemp("log") / "listed"
    found = w.scan(spark, tree, lister=w.by_call(watched(str(log), ("deep", "other"))))
    assert names(found) == ["a.jpg", "c.png"]
    errors = found.errors.orderBy("ordinal").collect()
    assert [(os.path.relpath(e["path"], tree), e["message"]) for e in errors] == [("other", "denied"), ("sub/deep", "denied")]
    assert "2 errors" in walk_errors(found.errors).first()["summary"]
    assert scan_report(found.rows, found.errors)[1].first()["n_errors"] == 2


def test_entries_before_an_error_stay(spark):
    def broken(directory):
        yield "a.jpg", False, 1, 1
        raise OSError("lost")

    found = w.walk(spark, ["/x"], w.by_call(broken))
    assert names(found) == ["a.jpg"] and [(e["path"], e["message"]) for e in found.errors.collect()] == [("/x", "lost")]


def test_missing_roots_and_none(spark, tree):
    found = w.walk(spark, [tree + "/gone", tree + "/other/"], w.by_call())
    assert names(found) == ["f.jpeg"] and [e["path"] for e in found.errors.collect()] == [tree + "/gone"]
    assert "error" not in walk_errors(found.errors).first()["summary"]
    none = w.walk(spark, [], w.by_call())
    assert none.rows.count() == 0 and none.errors.count() == 0 and walk_errors(none.errors).first()["n_errors"] == 0


def test_links_to_directories_arent_followed(spark, tree):
    os.symlink(tree, os.path.join(tree, "sub", "loop"))
    os.symlink(os.path.join(tree, "a.jpg"), os.path.join(tree, "link.jpg"))
    assert sorted(names(w.scan(spark, tree))) == ["a.jpg", "c.png", "d.webp", "e.gif", "f.jpeg", "link.jpg"]


def test_a_large_directory_passes_in_batches(spark):
    many = w.by_call(lambda d: ((f"{i}.jpg", False, i, i) for i in range(20_000)))
    assert w.walk(spark, ["/"], many).rows.where("dir = '/' AND path LIKE '/%.jpg'").count() == 20_000
