"""Files of a project: one root with raw, normalized and results, and a manifest of what is there."""

from __future__ import annotations

import csv
import hashlib
import os
from datetime import date
from pathlib import Path

COLUMNS = ["asset", "tier", "source", "url", "download_date", "md5", "row_count", "note"]
TIERS = ("raw", "normalized", "results")
_root: str | None = None


def data_root(set_to: str | None = None) -> Path:
    """The root: as set here, else MATCHLOOM_DATA, else a folder in the home directory."""
    global _root
    if set_to:
        _root = set_to
    return Path(_root or os.environ.get("MATCHLOOM_DATA") or Path.home() / "matchloom-data")


def data_path(tier: str = "", file: str = "", create: bool = False) -> str:
    if tier not in ("", *TIERS):
        raise ValueError(f"tier must be one of {TIERS}")
    p = data_root() / tier
    if create:
        p.mkdir(parents=True, exist_ok=True)
    return str(p / file if file else p)


def data_init(root: str | None = None) -> str:
    """Makes the folders and an empty manifest, unless they are there."""
    base = data_root(root)
    for t in TIERS:
        (base / t).mkdir(parents=True, exist_ok=True)
    if not (base / "manifest.csv").exists():
        _save([])
    return str(base)


def manifest() -> list[dict]:
    p = data_root() / "manifest.csv"
    if not p.exists():
        return []
    with p.open(newline="") as f:
        return list(csv.DictReader(f))


def _save(rows: list[dict]) -> None:
    p = data_root() / "manifest.csv"
    p.parent.mkdir(parents=True, exist_ok=True)
    with p.open("w", newline="") as f:
        w = csv.DictWriter(f, COLUMNS)
        w.writeheader()
        w.writerows(rows)


def md5(path: str) -> str:
    h = hashlib.md5()  # noqa: S324
    with open(path, "rb") as f:
        while chunk := f.read(1 << 20):
            h.update(chunk)
    return h.hexdigest()


def manifest_add(asset: str, tier: str, source: str = "", url: str = "", path: str | None = None, row_count: int | None = None, note: str = "") -> dict:
    """Adds an entry, or replaces that of the asset; the checksum and, for csv files, the rows are counted if not given."""
    entry = dict.fromkeys(COLUMNS, "") | {"asset": asset, "tier": tier, "source": source, "url": url, "download_date": date.today().isoformat(), "note": note}
    if path and Path(path).is_file():
        entry["md5"] = md5(path)
        if row_count is None and path.endswith(".csv"):
            with open(path, "rb") as f:
                row_count = max(0, sum(1 for _ in f) - 1)
    entry["row_count"] = "" if row_count is None else row_count
    _save([r for r in manifest() if r["asset"] != asset] + [entry])
    return entry
