"""Settings of an index and its queries, and checks of what a caller gives."""

from __future__ import annotations

import logging
import posixpath
import re
from dataclasses import dataclass, field, fields

from packwright.functions import fixed

log = logging.getLogger(__name__)

# Forms of a pack, and the globs that are taken and left out unless told otherwise.
FORMATS = ("xml", "zip", "json", "md")
INCLUDE = ("**/*.py", "**/*.js", "**/*.ts", "**/*.jsx", "**/*.tsx", "**/*.java", "**/*.cs", "**/*.go", "**/*.rs", "**/*.c", "**/*.cpp", "**/*.h")
EXCLUDE = ("*.min.js", "*.min.css", "node_modules/**", "__pycache__/**", ".git/**", "dist/**", "build/**", "*.egg-info/**", ".venv/**", "venv/**", ".pytest_cache/**", "htmlcov/**")


@dataclass(frozen=True)
class Settings:
    format: str = "zip"
    token_budget: int = 100_000
    output_path: str = "./output"
    semantic_weight: float = 0.6
    pagerank_weight: float = 0.4
    include_tests: bool = False
    respect_gitignore: bool = True
    include_patterns: tuple[str, ...] = INCLUDE
    exclude_patterns: tuple[str, ...] = field(default=EXCLUDE)


def _share(v) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool) and 0 <= v <= 1


def _globs(v) -> bool:
    return isinstance(v, (list, tuple)) and all(isinstance(x, str) for x in v)


_VALID = {
    "format": lambda v: v in FORMATS,
    "token_budget": lambda v: isinstance(v, int) and not isinstance(v, bool) and v > 0,
    "output_path": lambda v: isinstance(v, str) and bool(v),
    "semantic_weight": _share,
    "pagerank_weight": _share,
    "include_tests": lambda v: isinstance(v, bool),
    "respect_gitignore": lambda v: isinstance(v, bool),
    "include_patterns": _globs,
    "exclude_patterns": _globs,
}


def settings_from(given: object) -> Settings:
    """Settings of a parsed mapping; what isn't a mapping, and each field that isn't valid, gives way to the default and is logged."""
    if not isinstance(given, dict):
        if given is not None:
            log.error("settings are not a mapping; defaults are used")
        return Settings()
    good = {}
    for f in fields(Settings):
        if f.name in given:
            value = given[f.name]
            if _VALID[f.name](value):
                good[f.name] = tuple(value) if isinstance(value, list) else value
            else:
                log.error("%s is not valid: %r; the default is used", f.name, value)
    return Settings(**good)


def checked_limit(limit: int) -> int:
    """A number of results from 1 to 50."""
    if not 1 <= limit <= 50:
        raise ValueError(f"limit must be from 1 to 50, not {limit}")
    return limit


def inside(root: str, path: str) -> str:
    """path below root, in normal form; a path that leaves root is an error."""
    root = posixpath.normpath(root)
    full = posixpath.normpath(posixpath.join(root, path))
    if full != root and not full.startswith(root.rstrip("/") + "/"):
        raise ValueError(f"{path} is outside of {root}")
    return full


def graph_intent(query: str) -> tuple[str, str]:
    """callers_of, impact_of or none, and the first identifier of the query (dots kept) that isn't a word of the question; as text.graph_intent has it."""
    if re.search(fixed.CALLERS, query, re.I) or re.search(fixed.DEFINED, query, re.I):
        kind = "callers_of"
    elif re.search(fixed.IMPACT, query, re.I):
        kind = "impact_of"
    else:
        return "none", ""
    return kind, next((n for n in re.findall(fixed.IDENTIFIER, query) if n.lower() not in fixed.ASKING), "")
