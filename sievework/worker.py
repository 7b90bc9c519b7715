"""Values that a Python worker keeps from one task to the next."""

from __future__ import annotations

import sys
from collections.abc import Callable
from types import ModuleType
from typing import Any

STORE = "sievework_worker_values"


def per_worker(name: str, key: str, make: Callable[[], Any]) -> Any:
    """`make()`, called once per worker process and key; under one name a worker
    keeps the value of the last key only.

    Functions travel to a worker anew with each task, and so do the globals of
    their modules; a module of the process itself stays.
    """
    store = sys.modules.setdefault(STORE, ModuleType(STORE)).__dict__
    kept = store.get(name)
    if kept is None or kept[0] != key:
        kept = store[name] = (key, make())
    return kept[1]
