"""Model functions: a command that answers a prompt."""

from __future__ import annotations

import json
import os
import re
import subprocess
from collections.abc import Callable


# Settings of this process's own runtime, which a child must not inherit.
PRIVATE = ("PYTHONHOME", "PYTHONPATH", "LD_LIBRARY_PATH")


def child_env() -> dict[str, str]:
    return {k: v for k, v in os.environ.items() if k not in PRIVATE}


def reply_text(out: str) -> str:
    """The reply in a command's output: `outputs[0].text` of a JSON object, else the output; without a code fence."""
    try:
        data = json.loads(out)
        out = data["outputs"][0]["text"]
    except (ValueError, KeyError, IndexError, TypeError):
        pass
    m = re.fullmatch(r"\s*```[^\n]*\n?(.*?)(?:```)?\s*", out, re.S)
    return (m[1] if m else out).strip()


def command_model(command: list[str], timeout: float = 120.0) -> Callable[[str], str]:
    """A function from prompt to reply that runs a command with the prompt as its last argument."""

    def ask(prompt: str) -> str:
        done = subprocess.run([*command, prompt], capture_output=True, text=True, timeout=timeout, check=True, env=child_env())
        return reply_text(done.stdout)

    return ask
