"""What the planner expected of each operator and what came, as rotated lines of JSON."""

from __future__ import annotations

import json
from pathlib import Path

MAX_BYTES, MAX_FILES = 4 << 20, 4


class FeedbackLog:
    """``feedback.jsonl`` is written to; full files move to ``feedback.1.jsonl`` and on, the
    oldest goes."""

    def __init__(self, folder: Path, max_bytes: int = MAX_BYTES, max_files: int = MAX_FILES):
        self.folder, self.max_bytes, self.max_files = folder, max_bytes, max_files

    def _file(self, number: int) -> Path:
        return self.folder / (f"feedback.{number}.jsonl" if number else "feedback.jsonl")

    def write(self, entry: dict) -> None:
        self.folder.mkdir(parents=True, exist_ok=True)
        line = json.dumps(entry) + "\n"
        if self._file(0).exists() and self._file(0).stat().st_size + len(line) > self.max_bytes:
            for k in range(self.max_files - 1, 0, -1):
                if self._file(k - 1).exists():
                    self._file(k - 1).replace(self._file(k))
        with open(self._file(0), "a", encoding="utf-8") as f:
            f.write(line)

    def entries(self) -> list[dict]:
        """All that is kept, oldest first."""
        files = [self._file(k) for k in range(self.max_files - 1, -1, -1)]
        return [json.loads(line) for f in files if f.exists() for line in f.read_text(encoding="utf-8").splitlines()]
