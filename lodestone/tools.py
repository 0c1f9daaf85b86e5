"""The commands as tools of a model context server: each runs the command line in a repository and gives its text, data or an error code.

Codes: ``bad_repo``, ``not_found`` (no interpreter), ``timeout``, ``failed``, ``no_index`` and ``bad_json``. ``serve`` needs the package ``mcp``.
"""

from __future__ import annotations

import json
import os
import subprocess
import sys
from pathlib import Path
from typing import Any

#: Seconds that a command may take, by command.
TIMEOUTS = {"index": 300, "map": 180, "pack": 180}
TIMEOUT = 120
STORE = ".lodestone/index"


def run(args: list[str], repo: str | None = None, as_json: bool = False, timeout: float | None = None, python: str = sys.executable) -> dict[str, Any]:
    """Runs one command; never raises."""
    folder = Path(repo or os.getcwd()).expanduser().resolve()
    if not folder.is_dir():
        return {"error": "bad_repo", "message": f"no folder: {folder}"}
    command = [python, "-m", "lodestone.cli", "--store", str(folder / STORE), *args]
    limit = timeout if timeout is not None else TIMEOUTS.get(args[0], TIMEOUT)
    paths = os.pathsep.join(p for p in (str(Path(__file__).resolve().parents[1]), os.environ.get("PYTHONPATH", "")) if p)
    try:
        done = subprocess.run(command, cwd=folder, capture_output=True, text=True, timeout=limit, env=os.environ | {"PYTHONPATH": paths}, check=False)
    except FileNotFoundError:
        return {"error": "not_found", "command": command}
    except subprocess.TimeoutExpired:
        return {"error": "timeout", "after_seconds": limit, "command": command}
    out, err = done.stdout.strip(), done.stderr.strip()
    if done.returncode:
        missing = "no index at" in err
        return {"error": "no_index", "message": err.splitlines()[-1]} if missing else {"error": "failed", "returncode": done.returncode, "stdout": out, "stderr": err}
    if not as_json:
        return {"text": out}
    try:
        return {"data": json.loads(out)}
    except ValueError:
        return {"error": "bad_json", "stdout": out}


def _options(**values: Any) -> list[str]:
    """Command line options: flags for true, repeated ones for lists; what is None or false is left out."""
    out: list[str] = []
    for name, value in values.items():
        option = "--" + name.replace("_", "-")
        if value is True:
            out.append(option)
        elif value not in (None, False):
            for v in value if isinstance(value, list) else [value]:
                out += [option, str(v)]
    return out


def index(repo: str | None = None, clean: bool = False, include: list[str] | None = None, exclude: list[str] | None = None, include_build_scripts: bool = False, include_generated: bool = False) -> dict[str, Any]:
    """Builds or refreshes the index of a repository."""
    return run(["index", ".", *_options(clean=clean, include=include, exclude=exclude, include_build_scripts=include_build_scripts, include_generated=include_generated)], repo, True)


def search(query: str, repo: str | None = None, regex: bool = False, strict: bool = False, limit: int = 10) -> dict[str, Any]:
    """Searches files, symbols and text, or ranks by ``semantic:``."""
    return run(["search", query, "--json", *_options(limit=limit, regex=regex, strict=strict)], repo, True)


def symbol(name: str, repo: str | None = None) -> dict[str, Any]:
    """Symbols of a qualified name, with their bodies."""
    return run(["symbol", name, "--json"], repo, True)


def outline(file_path: str, repo: str | None = None) -> dict[str, Any]:
    """The outline of a source file."""
    return run(["outline", file_path], repo)


def map(repo: str | None = None, budget: int = 4096, focus: str | None = None) -> dict[str, Any]:
    """A map of the repository within a budget of tokens."""
    return run(["map", *_options(budget=budget, focus=focus)], repo)


def pack(task: str, repo: str | None = None, budget: int = 12000, failure: str | None = None) -> dict[str, Any]:
    """A context packet for a task."""
    return run(["pack", task, *_options(budget=budget, failure=failure)], repo)


def estimate(input: str, repo: str | None = None, text: bool = False) -> dict[str, Any]:
    """Tokens of a file, or of a text."""
    return run(["estimate", *(["--text", input] if text else [input])], repo)


def summarize(repo: str | None = None) -> dict[str, Any]:
    """The project report."""
    return run(["summarize"], repo)


def explain(topic: str, repo: str | None = None) -> dict[str, Any]:
    """What index, pack and symbol mean."""
    return run(["explain", topic], repo)


TOOLS = (index, search, symbol, outline, map, pack, estimate, summarize, explain)


def serve() -> None:
    from mcp.server.fastmcp import FastMCP

    server = FastMCP("lodestone")
    for tool in TOOLS:
        server.tool()(tool)
    server.run()


if __name__ == "__main__":
    serve()
