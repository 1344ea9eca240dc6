"""Listing by tasks against the driver's discovery."""

import json
import os

from pyspark.sql import functions as F

from vigil.operators import deep
from vigil.sources import discover, files, tree


def test_same_files_as_discovery(spark, tmp_path):
    """Nested roots, links to files and folders, closed and empty folders,
    exclusions, roots that are files or missing, names with odd characters."""
    for name in ("a/x.jsonl", "a/b/c/d/deep.jsonl", "a/b/é 1.json", "a/b/c/skip/no.txt", "r/one.md", "lonely.jsonl"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text('{"t": "%s"}' % name)
    (tmp_path / "a/link.jsonl").symlink_to(tmp_path / "r/one.md")
    (tmp_path / "a/loop").symlink_to(tmp_path / "a")
    (tmp_path / "a/empty").mkdir()
    os.mkfifo(tmp_path / "a/pipe")
    roots = [str(tmp_path / n) for n in ("a", "a/b", "a/b/c", "r", "lonely.jsonl", "missing", "a")]
    want = discover.transcripts([*roots, f"!{tmp_path}/a/b/c/skip"], {})
    for levels in (0, 1, 2, 5):
        assert sorted(f for f, whole in tree.subtrees(str(tmp_path / "a"), levels) if whole or levels)  # something to hand out
    got = tree.listed(spark, roots, [f"{tmp_path}/a/b/c/skip"], parts=3)
    assert sorted((r.path, r.root_ord) for r in got.collect()) == sorted(want)
    assert all(r.size == os.path.getsize(r.path) for r in got.collect())
    texts = lambda df: sorted((r.file, r.line, r.piece_seq, r.source, r.text) for r in df.where("text IS NOT NULL").collect())
    assert texts(tree.pieces_of(got)) == texts(files.read_transcripts(spark, [f for f, _ in want]))


def test_every_level_is_listed_once(spark, tmp_path, monkeypatch):
    for i in range(4):
        for j in range(3):
            folder = tmp_path / f"p{i}/q{j}/r"
            folder.mkdir(parents=True)
            for at in (folder, folder.parent, folder.parent.parent, tmp_path):
                (at / f"f{i}{j}.json").write_text(json.dumps({"k": "v"}))
    want = discover.walk(str(tmp_path))
    for levels, most in ((0, 9), (1, 9), (2, 1000), (2, 5), (9, 1000)):
        monkeypatch.setattr(tree.subtrees, "__defaults__", (levels, most))
        found = [f for folder, whole in tree.subtrees(str(tmp_path)) for at, below, names in os.walk(folder) if whole or at == folder for f in (os.path.join(at, n) for n in names)]
        assert sorted(found) == sorted(want)


def test_a_closed_file_is_told(spark, tmp_path):
    (tmp_path / "d").mkdir()
    listing = spark.createDataFrame([(str(tmp_path / "d"),), (str(tmp_path / "gone"),)], "path string")
    told = {r.file: r.error for r in tree.pieces_of(listing).collect()}
    assert all(told.values()) and len(told) == 2
    assert deep.totals(deep.deep_groups(deep.deep_findings(tree.pieces_of(listing).where(F.col("text").isNotNull())))).first().secrets == 0
