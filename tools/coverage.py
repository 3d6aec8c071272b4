"""Print which registered query exercises which inventory row."""

from __future__ import annotations

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from citeloom.queries.catalog import REGISTRY  # noqa: E402

for name, entry in REGISTRY.items():
    print(f"| {entry.covers} | `{name}` | {'SQL' if entry.text else 'rows + tests'} |")
