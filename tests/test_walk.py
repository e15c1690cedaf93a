import os

import pytest
from pyspark.sql import functions as F
from siftwork.sources import walk


@pytest.fixture
def root(tmp_path):
    for name, text in {
        "a.py": "x = 1\n", "b.js": "", "src/deep/er/c.PY": "é", "src/node_modules/d.py": "no", "src/e_test.py": "no", "src/gen/f.py": "gen", "own/g.py": "g" * 100, "own/none": "n", "Tests/h.py": "no",
    }.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    os.symlink(tmp_path / "src" / "deep", tmp_path / "own" / "linked")
    os.symlink(tmp_path, tmp_path / "own" / "loop")
    os.symlink(tmp_path / "gone", tmp_path / "own" / "broken.py")
    (tmp_path / "bad.py").write_bytes(b"\xff\xfe")
    return tmp_path


def names(df, root):
    return sorted(os.path.relpath(r.path, root) for r in df.select("path").collect())


EVERY = ["a.py", "b.js", "bad.py", "own/g.py", "own/linked/er/c.PY", "own/none", "src/deep/er/c.PY", "src/gen/f.py"]


def test_whole_tree(spark, root):
    found = walk.tree(spark, str(root))
    assert names(found, root) == EVERY and names(walk.tree(spark, str(root), spread="0"), root) == EVERY and names(walk.tree(spark, str(root), spread="9"), root) == EVERY
    rows = {os.path.relpath(r.path, root): r for r in found.collect()}
    assert rows["src/deep/er/c.PY"].extension == ".py" and rows["src/deep/er/c.PY"].content == "é" and rows["own/none"].extension == "" and rows["b.js"].content == "" and rows["bad.py"].content == "��"
    assert names(walk.tree(spark, str(root), exclude=("gen", "b*")), root) == [x for x in EVERY if "gen" not in x and not x.startswith("b")]
    assert walk.tree(spark, str(root / "nothing")).isEmpty() and walk.tree(spark, str(root), content=False).where("content IS NOT NULL").isEmpty()


@pytest.mark.parametrize("condition", ["extension = '.py'", "extension IN ('.js', '')", "size > 50", "size <= 6 AND extension = '.py'", "name LIKE 'c%'", "extension = '.py' AND content LIKE '%1%'", "extension IS NULL", "size BETWEEN 1 AND 3 OR name = 'a.py'"])
def test_filters_equal_filtering_later(spark, root, condition):
    found = walk.tree(spark, str(root))
    later = spark.createDataFrame(found.collect(), found.schema).where(condition)
    assert names(found.where(condition), root) == names(later, root)


def test_folders_left_out_are_never_listed(root, monkeypatch):
    """Folders that are excluded, or that no path that is asked for lies in, are not opened."""
    from pyspark.sql.datasource import EqualTo, StringStartsWith

    listed, scandir = [], os.scandir
    monkeypatch.setattr(os, "scandir", lambda at: listed.append(os.path.relpath(at, root)) or scandir(at))
    for pushed, want in (((), {".", "src", "own", "src/deep", "src/deep/er", "src/gen", "own/linked", "own/linked/er"}), ((StringStartsWith(("path",), f"{root}/src/d"),), {".", "src", "src/deep", "src/deep/er"}), ((EqualTo(("path",), f"{root}/own/g.py"),), {".", "own"})):
        listed.clear()
        reader = walk.Tree({"path": str(root)}).reader(None)
        assert not list(reader.pushFilters(list(pushed)))
        rows = [r for p in reader.partitions() for r in reader.read(p)]
        assert rows and set(listed) == want


def test_plan_shows_the_pushed_filters(spark, root, capsys):
    walk.tree(spark, str(root)).where((F.col("extension") == ".py") & F.col("path").startswith(f"{root}/src")).explain()
    plan = capsys.readouterr().out
    assert "tree[" in plan and "Filter (" not in plan
