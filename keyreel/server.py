"""Tool server: the commands as tools over JSON-RPC, a message a line on standard input and output.

Tools and their arguments follow from the command line's parser. Results are bounded, as there."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable
from typing import TextIO

from keyreel import cli
from keyreel.errors import FrameError, as_frame_error

PROTOCOL = "2024-11-05"
NAMES = {int: "integer", float: "number"}


def _commands() -> dict[str, argparse.ArgumentParser]:
    return next(a for a in cli.parser()._actions if isinstance(a, argparse._SubParsersAction)).choices


def _arguments(command: argparse.ArgumentParser) -> dict[str, argparse.Action]:
    """Name -> action; two flags of one option are two names."""
    return {(a.option_strings[0].lstrip("-") if a.option_strings else a.dest): a for a in command._actions if a.dest != "help"}


def _schema(a: argparse.Action) -> dict:
    if a.nargs == 0:
        return {"type": "boolean"}
    one = {"type": NAMES.get(a.type, "string"), **({"enum": list(a.choices)} if a.choices else {})}
    return {"type": "array", "items": one} if a.nargs == "+" or isinstance(a, argparse._AppendAction) else one


def tools() -> list[dict]:
    about = {a.dest: a.help for a in next(x for x in cli.parser()._actions if isinstance(x, argparse._SubParsersAction))._choices_actions}
    out = []
    for name, command in _commands().items():
        own = _arguments(command)
        needed = [n for n, a in own.items() if a.required]
        out.append({"name": name, "description": about[name], "inputSchema": {"type": "object", "properties": {n: _schema(a) for n, a in own.items()}, "required": needed, "additionalProperties": False}})
    return out


def argv_of(name: str, arguments: dict) -> list[str]:
    if name not in _commands():
        raise FrameError("USAGE", f"unknown tool {name!r}")
    own = _arguments(_commands()[name])
    if odd := set(arguments) - set(own):
        raise FrameError("USAGE", f"unknown arguments: {', '.join(sorted(odd))}")
    options, places = [], []
    for key, value in arguments.items():
        a = own[key]
        if value is None or value is False:
            continue
        values = [str(v) for v in value] if isinstance(value, list) else [str(value)]
        if not a.option_strings:
            places += values
        elif a.nargs == 0:
            options.append(a.option_strings[0])
        else:
            options += [f"{a.option_strings[0]}={v}" for v in values]
    return [name, *options, "--", *places] if places else [name, *options]


def call(name: str, arguments: dict, progress: Callable[[dict], None] = cli.report) -> dict:
    """A tool's result; what goes wrong is a result, too."""
    try:
        out, bad = cli.run(argv_of(name, arguments), progress), False
    except SystemExit:
        out, bad = FrameError("USAGE", f"arguments of {name} are missing or malformed").to_dict(), True
    except Exception as e:  # noqa: BLE001  as in main()
        out, bad = as_frame_error(e).to_dict(), True
    return {"content": [{"type": "text", "text": json.dumps(out)}], "structuredContent": out, "isError": bad}


def answer(message: dict) -> dict | None:
    """The answer to a request; None for what needs none."""
    if "id" not in message:
        return None
    params, result, error = message.get("params") or {}, None, None
    match message.get("method"):
        case "initialize":
            result = {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "keyreel", "version": "1"}}
        case "ping":
            result = {}
        case "tools/list":
            result = {"tools": tools()}
        case "tools/call":
            result = call(params.get("name", ""), params.get("arguments") or {})
        case other:
            error = {"code": -32601, "message": f"no method {other}"}
    return {"jsonrpc": "2.0", "id": message["id"], **({"error": error} if error else {"result": result})}


def serve(lines: TextIO = sys.stdin, out: TextIO = sys.stdout) -> None:
    for line in lines:
        if not line.strip():
            continue
        try:
            reply = answer(json.loads(line))
        except (ValueError, AttributeError):
            reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not a JSON object"}}
        if reply is not None:
            print(json.dumps(reply), file=out, flush=True)


if __name__ == "__main__":
    serve()
