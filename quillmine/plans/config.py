"""Settings from a YAML-like file, the environment and flags, the last winning."""

from __future__ import annotations

import os
from pathlib import Path

PREFIX = "QUILLMINE_"


def _value(text: str):
    text = text.strip().strip("'\"")
    low = text.lower()
    if low in ("true", "false"):
        return low == "true"
    if text.startswith("[") and text.endswith("]"):
        return [_value(x) for x in text[1:-1].split(",") if x.strip()]
    try:
        return int(text)
    except ValueError:
        return text


def read_config(path: str | Path) -> dict:
    """``key: value`` lines; # begins a comment. Keys below a key without a value are
    indented and join it by an underscore; lines that begin with a dash are its list."""
    out: dict = {}
    above: list[tuple[int, str]] = []
    for line in Path(path).read_text().splitlines():
        line = line.split("#", 1)[0].rstrip()
        text = line.lstrip()
        if not text:
            continue
        depth = len(line) - len(text)
        while above and above[-1][0] >= depth + text.startswith("- "):
            above.pop()
        base = "_".join(k for _, k in above)
        if text.startswith("- ") and base:
            held = out.get(base)
            out[base] = [*(held if isinstance(held, list) else []), _value(text[2:])]
        elif ":" in text:
            key, value = (x.strip() for x in text.split(":", 1))
            key = key.replace("-", "_")
            above.append((depth, key))
            if value:
                out[f"{base}_{key}" if base else key] = _value(value)
    return out


def settings(flags: dict | None = None, path: str | None = None, environ: dict | None = None) -> dict:
    environ = os.environ if environ is None else environ
    out = read_config(path) if path and os.path.exists(path) else {}
    out |= {k.removeprefix(PREFIX).lower(): _value(v) for k, v in environ.items() if k.startswith(PREFIX)}
    return out | {k: v for k, v in (flags or {}).items() if v is not None}
