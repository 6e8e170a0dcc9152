"""Models kept in a folder: what is there, fetching with a checksum, removing."""

from __future__ import annotations

import hashlib
import json
import shutil
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass
from pathlib import Path

#: Written last, so that a folder with it is whole.
MARKER = "model.json"


@dataclass(frozen=True)
class Model:
    """``files`` are names in the model's folder; ``checksum`` (``md5:`` or ``sha256:`` and hex) is that of the first."""

    key: str
    files: tuple[str, ...]
    checksum: str | None = None
    optional: bool = True


class Registry:
    """The models of a root folder; ``fetch(model, file)`` gives a file's content, from wherever it is kept."""

    def __init__(self, root: str | Path, models: Iterable[Model]):
        self.root, self.models = Path(root).resolve(), {m.key: m for m in models}

    def folder(self, key: str) -> Path:
        """The model's folder; a key that is unknown or leads out of the root is an error."""
        place = (self.root / self.models[key].key).resolve()
        if place == self.root or self.root not in place.parents:
            raise ValueError(f"{key} leads out of {self.root}")
        return place

    def is_installed(self, key: str) -> bool:
        place = self.folder(key)
        return all((place / name).is_file() for name in (MARKER, *self.models[key].files))

    def status(self) -> list[dict]:
        return [asdict(m) | {"installed": self.is_installed(m.key)} for m in self.models.values()]

    def install(self, key: str, fetch: Callable[[Model, str], bytes]) -> Path:
        """Fetches what is missing; a wrong checksum leaves nothing behind."""
        model, place = self.models[key], self.folder(key)
        if self.is_installed(key):
            return place
        place.mkdir(parents=True, exist_ok=True)
        for k, name in enumerate(model.files):
            content = fetch(model, name)
            kind, _, wanted = (model.checksum or "").rpartition(":")
            if k == 0 and wanted and hashlib.new(kind or "sha256", content).hexdigest() != wanted:
                shutil.rmtree(place)
                raise RuntimeError(f"{key}: the checksum does not match")
            (place / name).parent.mkdir(parents=True, exist_ok=True)
            (place / name).write_bytes(content)
        (place / MARKER).write_text(json.dumps(asdict(model)), encoding="utf-8")
        return place

    def remove(self, key: str) -> None:
        place = self.folder(key)
        if place.exists():
            shutil.rmtree(place)
