"""The drafts' own schemas, as the specifications publish them.

Fixed values: each file of ``published`` is one document, in the order of its publication; nothing here
builds or changes them. 2020-12 and 2019-09 have a schema and one document per vocabulary, draft-07 and
draft-06 one schema each.
"""

from __future__ import annotations

import json
from functools import lru_cache
from importlib.resources import files
from typing import Any


@lru_cache(maxsize=1)
def texts() -> dict[str, Any]:
    """Each document by its URI."""
    found = [json.loads(f.read_text(encoding="utf-8")) for f in files("sievemark.plans.published").iterdir() if f.name.endswith(".json")]
    return {d["$id"].rstrip("#"): d for d in sorted(found, key=lambda d: d["$id"], reverse=True)}
