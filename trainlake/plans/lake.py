"""Places of the tables below one base path."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Lake:
    """Paths of the bronze, silver and gold tables."""

    base: str

    def bronze(self, name: str) -> str:
        return f"{self.base.rstrip('/')}/bronze/{name}"

    def silver(self, name: str) -> str:
        return f"{self.base.rstrip('/')}/silver/{name}"

    def gold(self, name: str) -> str:
        return f"{self.base.rstrip('/')}/gold/{name}"
