"""Machine-readable metric lines."""

from __future__ import annotations

import json

PREFIX = "METRIC "


def emit_metric(**fields) -> None:
    print(PREFIX + json.dumps(fields, default=str), flush=True)


def metrics_from(output: str) -> list[dict]:
    """Parse every metric line; malformed ones are ignored."""
    found = []
    for line in output.splitlines():
        if not line.startswith(PREFIX):
            continue
        try:
            found.append(json.loads(line[len(PREFIX):]))
        except ValueError:
            continue
    return found
