"""Settings in TOML."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass


@dataclass
class Config:
    bind: str = "127.0.0.1:8787"
    index: str = "./findery-index"
    embedding_enabled: bool = True
    embedding_model: str = "BGE-small-en-v1.5"
    embedding_files: str = ""

    @classmethod
    def load(cls, path: str) -> Config:
        """Defaults where the file or a setting is missing."""
        if not os.path.exists(path):
            return cls()
        with open(path, "rb") as f:
            data = tomllib.load(f)
        own = {k: v for k, v in data.items() if k in ("bind", "index")}
        return cls(**own, **{f"embedding_{k}": v for k, v in data.get("embedding", {}).items() if f"embedding_{k}" in cls.__dataclass_fields__})

    def save(self, path: str) -> None:
        quoted = lambda s: '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'
        with open(path, "w", encoding="utf-8") as f:
            f.write(f"bind = {quoted(self.bind)}\nindex = {quoted(self.index)}\n\n[embedding]\nenabled = {str(self.embedding_enabled).lower()}\nmodel = {quoted(self.embedding_model)}\nfiles = {quoted(self.embedding_files)}\n")
