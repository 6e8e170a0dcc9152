"""Settings kept as a JSON object; keys that are not known are passed over when read."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields
from pathlib import Path


@dataclass
class Settings:
    advanced_models: bool = True
    semantic_search: bool = True
    review_budget: float = 1.0
    output_dir: str | None = None
    recognizer_command: str = "tesseract"

    @classmethod
    def load(cls, path: str | Path) -> Settings:
        """The settings of a file, or the plain ones if there is none."""
        if not Path(path).exists():
            return cls()
        held = json.loads(Path(path).read_text(encoding="utf-8"))
        return cls(**{f.name: held[f.name] for f in fields(cls) if f.name in held})

    def save(self, path: str | Path) -> None:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(json.dumps(asdict(self), indent=2, ensure_ascii=False), encoding="utf-8")
