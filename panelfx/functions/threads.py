"""One thread a task: the linear algebra library must not start its own beside Spark's."""

from __future__ import annotations

import ctypes
import re
from functools import cache
from pathlib import Path

#: Names under which builds of the library export the setting.
SETTERS = [f"{prefix}openblas_{{}}_num_threads{suffix}" for prefix in ("scipy_", "") for suffix in ("64_", "", "64")]


@cache
def _loaded() -> list[ctypes.CDLL]:
    maps = Path("/proc/self/maps")
    paths = set(re.findall(r"/\S*openblas\S*", maps.read_text())) if maps.exists() else set()
    return [ctypes.CDLL(p) for p in sorted(paths)]


def _call(verb: str, *args: int) -> list[int]:
    out = []
    for lib in _loaded():
        name = next((n.format(verb) for n in SETTERS if hasattr(lib, n.format(verb))), None)
        if name:
            out.append(getattr(lib, name)(*args))
    return out


def one_thread() -> None:
    """Limit every loaded OpenBLAS to one thread; without one, or elsewhere than on Linux, nothing happens."""
    _call("set", 1)


def threads() -> list[int]:
    """The limit that each loaded OpenBLAS has."""
    return _call("get")
