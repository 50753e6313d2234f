"""Named databases: one folder each, with an access list."""

from __future__ import annotations

import json
import re

from pyspark.sql import SparkSession

from chronofact.errors import ChronofactError
from chronofact.sources.files import Files
from chronofact.sources.store import FactStore


class Databases:
    """create, get, update, delete, clear, list; grant, revoke, has_access, access_list. Each change of a database's state is a new version of one small file."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root)

    def _versions(self, name: str) -> list[str]:
        return sorted(n for n in self.files.names(f"{self.root}/{name}/database") if n.endswith(".json"))

    def _version(self, name: str, n: int) -> str:
        return f"{self.root}/{name}/database/{n:010d}.json"

    def _read(self, name: str) -> dict:
        versions = self._versions(name)
        if not versions:
            raise ChronofactError(f"no database {name}")
        return json.loads(self.files.read(f"{self.root}/{name}/database/{versions[-1]}"))

    def _change(self, name: str, change) -> dict:
        """Writes the next version; who is late changes the newer one."""
        while True:
            state = self._read(name)
            was = state.get("version", 0)
            change(state)
            state["version"] = was + 1
            if self.files.create(self._version(name, was + 1), json.dumps(state)):
                return state

    def create(self, name: str, owner: str | None = None, **about) -> FactStore:
        if not re.fullmatch(r"[a-z0-9](?:[a-z0-9-]{0,62}[a-z0-9])?", name):
            raise ChronofactError(f"not a database name: {name}")
        if not self.files.create(self._version(name, 0), json.dumps({"name": name, "about": about, "access": [owner] if owner else [], "version": 0})):
            raise ChronofactError(f"database {name} exists")
        return self.get(name)

    def get(self, name: str) -> FactStore:
        self._read(name)
        return FactStore(self.spark, f"{self.root}/{name}/facts")

    def update(self, name: str, **about) -> dict:
        return self._change(name, lambda state: state["about"].update(about))

    def describe(self, name: str) -> dict:
        return self._read(name)

    def list(self, user: str | None = None) -> list[str]:
        names = sorted(n for n in self.files.names(self.root) if self._versions(n))
        return names if user is None else [n for n in names if user in self._read(n)["access"]]

    def delete(self, name: str) -> None:
        self._read(name)
        self.files.delete(f"{self.root}/{name}")

    def clear(self, name: str) -> None:
        self._read(name)
        self.files.delete(f"{self.root}/{name}/facts")

    def grant(self, name: str, user: str) -> None:
        if not self.has_access(name, user):
            self._change(name, lambda state: state.update(access=[*(u for u in state["access"] if u != user), user]))

    def revoke(self, name: str, user: str) -> None:
        self._change(name, lambda state: state.update(access=[u for u in state["access"] if u != user]))

    def has_access(self, name: str, user: str) -> bool:
        return user in self._read(name)["access"]

    def access_list(self, name: str) -> list[str]:
        return self._read(name)["access"]
