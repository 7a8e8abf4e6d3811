"""Registration of queries with their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    """Queries by name; ``model`` is put before each oracle that uses the derived views."""

    def __init__(self, model: str = ""):
        self.model = model
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, oracle: str | None = None, plain: bool = False, more: str = "") -> Callable:
        """``more`` holds further common table expressions; ``plain`` leaves the model out."""

        def add(f: Callable) -> Callable:
            self.queries[f.__name__] = f
            if oracle is not None:
                self.oracles[f.__name__] = oracle if plain else f"{self.model}{', ' + more if more else ''}\n{oracle}"
            return f

        return add
