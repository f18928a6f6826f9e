"""Settings of the application: a JSON file over defaults."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field, fields


@dataclass
class AppSettings:
    """Defaults of new crawls; unknown keys of a file are ignored, missing ones keep their default."""

    output_dir: str = "output"
    max_depth: int = 2
    page_limit: int = 1000
    concurrency: int = 3
    delay_ms: int = 750
    timeout_ms: int = 30_000
    download_assets: bool = False
    respect_robots_txt: bool = True
    stay_within_domain: bool = True
    ssrf_protection: bool = True
    headless_strategy: str = "auto"
    on_failure: str = "continue"
    theme: str = "system"
    auto_export: str | None = None
    shortcut_overrides: dict[str, str] = field(default_factory=dict)


def load(path: str) -> AppSettings:
    """Settings of a file; one that is missing or can't be read gives the defaults, a blank output folder the default one."""
    try:
        with open(path, encoding="utf-8") as f:
            raw = json.load(f)
    except (OSError, ValueError):
        raw = {}
    known = {x.name for x in fields(AppSettings)}
    s = AppSettings(**{k: v for k, v in (raw if isinstance(raw, dict) else {}).items() if k in known})
    if not str(s.output_dir or "").strip():
        s.output_dir = AppSettings().output_dir
    return s


def save(path: str, settings: AppSettings, **changes) -> AppSettings:
    """Write settings, with single fields changed."""
    new = AppSettings(**(asdict(settings) | changes))
    tmp = path + ".new"
    with open(tmp, "w", encoding="utf-8") as f:
        json.dump(asdict(new), f, indent=2)
    os.replace(tmp, path)
    return new
