"""Settings of a run from the environment, with defaults; read on the driver."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass

from sparkloom.functions.text import POLICY


@dataclass(frozen=True)
class RunConfig:
    root: str
    tests_dir: str
    api_url: str = ""
    api_key: str = ""
    model: str = ""
    project_context: str = ""
    timeout_seconds: int = 150
    comment: bool = False
    fail_on_failure: bool = False
    policy: str = POLICY


def load_config(env: Mapping[str, str] | None = None, prefix: str = "SPARKLOOM_") -> RunConfig:
    """Texts are stripped, numbers parsed, switches are on for `true` in any case."""
    env = os.environ if env is None else env
    text = lambda name, default="": env.get(prefix + name, default).strip()
    on = lambda name: text(name, "false").lower() == "true"
    root = os.path.abspath(text("ROOT") or os.getcwd())
    return RunConfig(root, os.path.join(root, "tests", "generated"), text("API_URL"), text("API_KEY"), text("MODEL"), text("CONTEXT"), int(text("TIMEOUT_SECONDS", "150")), on("COMMENT"), on("FAIL_ON_FAILURE"))
