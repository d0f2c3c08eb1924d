"""Configuration files."""

from __future__ import annotations

import pytest

from microveil.plans import config


def test_includes_and_variables(tmp_path):
    (tmp_path / "base.ini").write_text("[a]\nx = 1\ny = $HOME_DIR/in\n[b]\nz = 3\n")
    (tmp_path / "top.ini").write_text("[DEFAULT]\ninclude = base.ini\n[a]\nx = 2\n")
    c = config.read(tmp_path / "top.ini", {"HOME_DIR": "/data"})
    assert (c["a"]["x"], c["a"]["y"], c["b"]["z"]) == ("2", "/data/in", "3")
    (tmp_path / "one.ini").write_text("[b]\ninclude = base.ini\nw = $UNKNOWN\n")
    c = config.read(tmp_path / "one.ini", {})
    assert c.sections() == ["b"] and (c["b"]["z"], c["b"]["w"]) == ("3", "$UNKNOWN")
    (tmp_path / "loop.ini").write_text("[DEFAULT]\ninclude = loop.ini\n")
    with pytest.raises(ValueError):
        config.read(tmp_path / "loop.ini", {})
    with pytest.raises(FileNotFoundError):
        config.read(tmp_path / "none.ini")


def test_trees(tmp_path):
    (tmp_path / "a.json").write_text('{"path": "$HOME_DIR/x", "n": [1, "$UNKNOWN"], "deep": {"v": "$HOME_DIR"}}')
    (tmp_path / "a.yaml").write_text("path: $HOME_DIR/x\nn: [1, $UNKNOWN]\ndeep: {v: $HOME_DIR}\n")
    want = {"path": "/h/x", "n": [1, "$UNKNOWN"], "deep": {"v": "/h"}}
    assert config.read_tree(tmp_path / "a.json", {"HOME_DIR": "/h"}) == want
    pytest.importorskip("yaml")
    assert config.read_tree(tmp_path / "a.yaml", {"HOME_DIR": "/h"}) == want
