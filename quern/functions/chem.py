"""Chemistry kernels behind a backend: each is an Arrow-batched function if the backend is there, an error if not.

The backend library isn't part of this installation; nothing falls back to zeros or nulls silently.
"""

from __future__ import annotations

import importlib
import signal
from typing import Protocol

import pandas as pd
from pyspark.sql.functions import pandas_udf


class BackendUnavailable(RuntimeError):
    """A kernel needs a chemistry backend that isn't installed."""


class MolBackend(Protocol):
    """What the kernels need of a backend."""

    def canonical(self, smiles: str, isomeric: bool) -> str | None: ...
    def weight(self, smiles: str) -> float | None: ...
    def matches(self, smiles: str, smarts: str) -> bool: ...
    def stereocentres(self, smiles: str) -> int: ...
    def scaffold(self, smiles: str) -> str | None: ...
    def cip(self, smiles: str, atoms: list[int]) -> list[str]: ...
    def conformers(self, smiles: str, n: int, seed: int) -> list[tuple[float, list[list[float]]]]: ...
    def graph(self, smiles: str) -> tuple[list[list[float]], list[tuple[int, int, str]]]: ...


_backend: MolBackend | None = None


def use(backend: MolBackend | None) -> None:
    """Sets the backend of this process; workers set theirs on first use through ``module``."""
    global _backend
    _backend = backend


def backend(module: str = "quern_mol_backend") -> MolBackend:
    if _backend is not None:
        return _backend
    try:
        return importlib.import_module(module).Backend()
    except ModuleNotFoundError as e:
        raise BackendUnavailable(f"no chemistry backend: install a module {module} with a class Backend") from e


class Overtime(Exception):
    """An item took too long."""


def kernel(name: str, returns: str, *args, seconds: float = 0, module: str = "quern_mol_backend"):
    """Arrow-batched function of a SMILES column that calls the backend's method ``name``: struct value, status; null in, null out.

    status is ``ok``, ``timeout`` (after ``seconds`` an item, if given) or the error's name: no failure is taken for a value.
    """
    backend(module)

    @pandas_udf(f"value {returns}, status string")
    def run(s: pd.Series) -> pd.DataFrame:
        call = getattr(backend(module), name)
        rows = [(None, None) if x is None else guarded(call, seconds, x, *args) for x in s]
        return pd.DataFrame({"value": pd.Series([v for v, _ in rows], dtype=object), "status": [t for _, t in rows]})

    return run


def guarded(call, seconds: float, *args) -> tuple[object, str]:
    """The call's value and its status; the alarm works in a process's main thread, as a Python worker's is."""

    def ring(*_):
        raise Overtime

    before = signal.signal(signal.SIGALRM, ring) if seconds else None
    try:
        if seconds:
            signal.setitimer(signal.ITIMER_REAL, seconds)
        return call(*args), "ok"
    except Overtime:
        return None, "timeout"
    except Exception as e:  # noqa: BLE001 - any failure of an item becomes its status
        return None, type(e).__name__
    finally:
        if seconds:
            signal.setitimer(signal.ITIMER_REAL, 0)
            signal.signal(signal.SIGALRM, before)
