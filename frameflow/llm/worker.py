"""Objects that live as long as the Python worker, so that its next tasks find them.

The library's functions travel by value, each task's copy with globals of its own;
a module of this name in the worker's `sys.modules` is the one place they share.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Callable
from typing import Any


def kept(name: str, make: Callable[[], Any]) -> Any:
    """The object of this name, made once per process."""
    place = sys.modules.setdefault("_frameflow_worker", types.ModuleType("_frameflow_worker")).__dict__
    if name not in place:
        place[name] = make()
    return place[name]


def drop(*names: str) -> None:
    """Forget the objects whose names begin with one of these, as an encoder's memory of
    words, when the worker has gone on to another operator's tasks."""
    place = getattr(sys.modules.get("_frameflow_worker"), "__dict__", {})
    for name in [n for n in place if n.startswith(names)]:
        del place[name]
