"""The helper module of a configuration: a Python file whose functions take part in scans, descriptions and exports."""

from __future__ import annotations

import importlib.util
import os
import sys
from collections.abc import Callable
from dataclasses import dataclass

from pyspark import cloudpickle

# The functions a helper may have.
HOOKS = ("before_launch", "after_launch", "call_api", "load_image", "walk_library", "stat")


@dataclass
class Helper:
    """The hooks of a helper; None for those it lacks."""

    before_launch: Callable | None = None
    after_launch: Callable | None = None
    call_api: Callable | None = None
    load_image: Callable | None = None
    walk_library: Callable | None = None
    stat: Callable | None = None


def load_helper(path: str) -> Helper:
    """The helper at a path; a blank path has no hooks, a missing file raises FileNotFoundError. Its functions are shipped to executors by value."""
    if not path:
        return Helper()
    if not os.path.isfile(path):
        raise FileNotFoundError(f"no helper module at {path}")
    name = "lumidex_helper_" + "".join(c if c.isalnum() else "_" for c in os.path.abspath(path))
    spec = importlib.util.spec_from_file_location(name, path)
    module = importlib.util.module_from_spec(spec)
    sys.modules[name] = module
    spec.loader.exec_module(module)
    cloudpickle.register_pickle_by_value(module)
    return Helper(**{h: getattr(module, h, None) for h in HOOKS})
