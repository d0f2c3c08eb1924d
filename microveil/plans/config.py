"""Configuration: INI files with includes, JSON and YAML files, and $NAME from a mapping; driver side only."""

from __future__ import annotations

import configparser
import json
import os
import string
from collections.abc import Mapping
from pathlib import Path


def read(path: str | Path, variables: Mapping[str, str] | None = None, _seen: tuple = ()) -> configparser.ConfigParser:
    """A file whose ``include`` keys (in [DEFAULT] or any section) name files that give what it does not set itself.

    An include in a section gives that section only. Unknown $NAMEs stay as they are; a circle of includes is an error.
    """
    path = Path(path).resolve()
    if path in _seen:
        raise ValueError(f"{path} includes itself")
    own = configparser.ConfigParser(interpolation=None)
    own.optionxform = str
    if not own.read(path):
        raise FileNotFoundError(path)
    out = configparser.ConfigParser(interpolation=None)
    out.optionxform = str
    parents = [(s, (own.defaults() if s is None else dict(own._sections[s])).get("include")) for s in (None, *own.sections())]
    for section, name in parents:
        if name:
            base = read(path.parent / name, variables, (*_seen, path))
            for s in base.sections() if section is None else [x for x in base.sections() if x == section]:
                for k, v in base._sections[s].items():
                    if not out.has_section(s):
                        out.add_section(s)
                    out[s][k] = v
            if section is None:
                out.defaults().update(base.defaults())
    given = dict(os.environ) if variables is None else dict(variables)
    fill = lambda v: string.Template(v).safe_substitute(given)
    out.defaults().update({k: fill(v) for k, v in own.defaults().items() if k != "include"})
    for s in own.sections():
        if not out.has_section(s):
            out.add_section(s)
        for k, v in own._sections[s].items():
            if k != "include":
                out[s][k] = fill(v)
    return out


def read_tree(path: str | Path, variables: Mapping[str, str] | None = None):
    """The values of a JSON or YAML file (by its ending) with $NAME filled in inside all strings; unknown $NAMEs stay."""
    text = Path(path).read_text()
    if Path(path).suffix in (".yaml", ".yml"):
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("YAML files need the package yaml") from e
        tree = yaml.safe_load(text)
    else:
        tree = json.loads(text)
    given = dict(os.environ) if variables is None else dict(variables)

    def filled(x):
        if isinstance(x, str):
            return string.Template(x).safe_substitute(given)
        if isinstance(x, dict):
            return {k: filled(v) for k, v in x.items()}
        return [filled(v) for v in x] if isinstance(x, list) else x

    return filled(tree)
