"""Archives of packs: names and members that would leave their folder, replacement as one step, updates."""

from __future__ import annotations

import io
import json
import shutil
import tarfile
from pathlib import Path

import pytest

from graphweave import service
from graphweave.sources import files

MANIFEST = {"name": "go-expert", "version": "1.0.0", "description": "d", "graph_stats": {"articles": 1}, "license": "MIT"}


def archive(path, members=None, link=None, **change):
    with tarfile.open(path, "w:gz") as tar:
        for name, text in {"manifest.json": json.dumps(MANIFEST | change), **(members or {})}.items():
            info = tarfile.TarInfo(name)
            info.size = len(text.encode())
            tar.addfile(info, io.BytesIO(text.encode()))
        if link:
            info = tarfile.TarInfo("link")
            info.type, info.linkname = tarfile.SYMTYPE, link
            tar.addfile(info)
    return path


@pytest.fixture
def root(tmp_path):
    (tmp_path / "victim").mkdir()
    (tmp_path / "victim/file").write_text("x")
    files.unpackage(archive(tmp_path / "a.tar.gz", {"skill.md": "old"}), tmp_path / "packs")
    return tmp_path / "packs"


def untouched(root):
    return (root.parent / "victim/file").read_text() == "x" and (root / "go-expert/skill.md").read_text() == "old" and [p.name for p in root.iterdir()] == ["go-expert"]


@pytest.mark.parametrize("name", ["../victim", "", ".", "..", "/etc", "a/b", "a\\b", "x" * 65, "-x", "a b", None, 5, ["go-expert"], "é"])
def test_names_that_are_no_folder_are_refused(root, name):
    with pytest.raises(ValueError):
        files.unpackage(archive(root.parent / "b.tar.gz", name=name), root)
    assert untouched(root)


@pytest.mark.parametrize("member", ["../escape", "/abs", "a/../../b"])
def test_members_that_leave_the_folder_are_refused(root, member):
    with pytest.raises(ValueError):
        files.unpackage(archive(root.parent / "b.tar.gz", {member: "x"}), root)
    with pytest.raises(ValueError):
        files.unpackage(archive(root.parent / "b.tar.gz", link="/etc/passwd"), root)
    assert untouched(root) and not (root.parent / "escape").exists()


def test_a_folder_that_is_a_link_is_not_replaced(root):
    shutil.rmtree(root / "go-expert")
    (root / "go-expert").symlink_to(root.parent / "victim")
    with pytest.raises(ValueError):
        files.unpackage(root.parent / "a.tar.gz", root)
    with pytest.raises(ValueError):
        files.remove(root, "go-expert")
    assert (root.parent / "victim/file").exists()


def test_archives_without_a_sound_manifest(root):
    bad = root.parent / "c.tar.gz"
    with tarfile.open(bad, "w:gz") as tar:
        info = tarfile.TarInfo("manifest.json")
        info.size = 2
        tar.addfile(info, io.BytesIO(b"[]"))
    with pytest.raises(ValueError):
        files.unpackage(bad, root)
    with pytest.raises(ValueError, match="no pack.db"):
        files.unpackage(archive(root.parent / "b.tar.gz"), root, whole=True)
    assert untouched(root)


def test_a_failing_copy_leaves_the_old_pack(root, monkeypatch):
    new, rename = archive(root.parent / "b.tar.gz", {"skill.md": "new"}), Path.rename

    def fails(self, target):
        if self.name == "new":
            raise OSError("disk full")
        return rename(self, target)

    monkeypatch.setattr(Path, "rename", fails)
    with pytest.raises(OSError):
        files.unpackage(new, root)
    monkeypatch.undo()
    assert untouched(root)
    files.unpackage(new, root)
    assert (root / "go-expert/skill.md").read_text() == "new"


def test_updates_keep_results_and_go_forward_only(root, capsys):
    (root / "go-expert/eval/results").mkdir(parents=True)
    (root / "go-expert/eval/results/r.json").write_text("{}")
    newer = archive(root.parent / "go-expert-1.10.0.tar.gz", {"eval/results/other.json": "{}"}, version="1.10.0")
    assert files.update_pack(newer, root, "go-expert") == ("1.0.0", "1.10.0")
    assert [p.name for p in (root / "go-expert/eval/results").iterdir()] == ["r.json"]
    with pytest.raises(ValueError, match="older"):
        files.update_pack(archive(root.parent / "b.tar.gz", version="1.9.0"), root, "go-expert")
    with pytest.raises(FileNotFoundError):
        files.update_pack(newer, root, "other")
    with pytest.raises(ValueError):
        files.update_pack(newer, root, "../go-expert")
    assert service.main(["pack", "update", str(newer), "--root", str(root)]) == 0 and "1.10.0 to 1.10.0" in capsys.readouterr().out
    files.remove(root, "go-expert")
    assert list(root.iterdir()) == []
