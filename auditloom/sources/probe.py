"""Live enumeration of servers over stdio or HTTP. It runs third-party code, so nothing calls it unasked.

One task asks one server at a time; answers are JSON-RPC payloads that ``rpc_tools`` flattens.
"""

from __future__ import annotations

import json
import os
import queue
import shutil
import subprocess
import sys
import threading
import time
import urllib.request
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.sources.configs import rpc_tools
from auditloom.sources.storage import stored

# Fixed values of the protocol.
HELLO = {"protocolVersion": "2024-11-05", "capabilities": {}, "clientInfo": {"name": "auditloom", "version": "1"}}
METHODS = ("tools/list", "prompts/list")

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package


def _request(number: int, method: str, params: dict | None = None) -> dict:
    return {"jsonrpc": "2.0", "id": number, "method": method, "params": params or {}}


class StdioSession:
    """A child process that answers a line of JSON for each request."""

    def __init__(self, command: str, args: list[str], env: dict[str, str], timeout: float):
        found = shutil.which(command, path={**os.environ, **env}.get("PATH"))
        if not found:
            raise OSError(f"command not found: {command}")
        self.timeout, self.lines, self.said = timeout, queue.Queue(), []
        self.child = subprocess.Popen([found, *args], env={**os.environ, **env}, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.PIPE, text=True, encoding="utf-8", errors="replace")
        for stream, take in ((self.child.stdout, self.lines.put), (self.child.stderr, self.said.append)):
            threading.Thread(target=lambda s=stream, t=take: [t(line) for line in s], daemon=True).start()

    def send(self, message: dict) -> None:
        self.child.stdin.write(json.dumps(message) + "\n")
        self.child.stdin.flush()

    def ask(self, number: int, method: str, params: dict | None = None) -> dict:
        self.send(_request(number, method, params))
        end = time.monotonic() + self.timeout
        while (left := end - time.monotonic()) > 0:
            try:
                answer = json.loads(self.lines.get(timeout=min(left, 0.2)))
            except queue.Empty:
                if self.child.poll() is not None and self.lines.empty():
                    break
                continue
            except ValueError:
                continue
            if isinstance(answer, dict) and answer.get("id") == number:
                return answer
        raise OSError(f"no answer to {method}: {''.join(self.said)[-300:].strip()}")

    def close(self) -> None:
        self.child.kill()
        self.child.wait()


class HttpSession:
    """JSON-RPC by POST; the session id of the first answer is sent again."""

    def __init__(self, url: str, env: dict[str, str], headers: dict[str, str], timeout: float):
        self.url, self.timeout = url, timeout
        self.headers = {"Content-Type": "application/json", "Accept": "application/json, text/event-stream"} | bearer(env) | headers

    def send(self, message: dict) -> None:
        self._post(message)

    def ask(self, number: int, method: str, params: dict | None = None) -> dict:
        for answer in self._post(_request(number, method, params)):
            if answer.get("id") == number:
                return answer
        raise OSError(f"no answer to {method}")

    def _post(self, message: dict) -> list[dict]:
        request = urllib.request.Request(self.url, json.dumps(message).encode(), self.headers)
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            if session := answer.headers.get("Mcp-Session-Id"):
                self.headers["Mcp-Session-Id"] = session
            text = answer.read().decode("utf-8", "replace")
        if "event-stream" in (answer.headers.get("Content-Type") or ""):
            return event_stream(text)
        return [json.loads(text)] if text.strip() else []

    def close(self) -> None:
        pass


def bearer(env: dict[str, str]) -> dict[str, str]:
    """An Authorization header from the environment block: its own, else the first TOKEN or KEY."""
    if "Authorization" in env:
        return {"Authorization": env["Authorization"]}
    return next(({"Authorization": f"Bearer {env[k]}"} for k in sorted(env) if k.upper().endswith(("TOKEN", "KEY"))), {})


def event_stream(text: str) -> list[dict]:
    found = []
    for block in text.replace("\r\n", "\n").split("\n\n"):
        data = "\n".join(line[5:].lstrip() for line in block.split("\n") if line.startswith("data:"))
        try:
            if isinstance(parsed := json.loads(data), dict):
                found.append(parsed)
        except ValueError:
            continue
    return found


def enumerate_server(command: str | None, args: list[str], env: dict[str, str], url: str | None, timeout: float) -> list[str]:
    """The payloads of one server; a refusal to list prompts is none."""
    session = HttpSession(url, env, {}, timeout) if url else StdioSession(command or "", args, env, timeout)
    try:
        session.ask(1, "initialize", HELLO)
        session.send({"jsonrpc": "2.0", "method": "notifications/initialized"})
        payloads = [session.ask(2, METHODS[0])]
        try:
            payloads.append(session.ask(3, METHODS[1]))
        except OSError:
            pass
        return [json.dumps(p) for p in payloads]
    finally:
        session.close()


def probe(servers: DataFrame, timeout: float = 20.0) -> tuple[DataFrame, DataFrame]:
    """(tools, errors) of live servers, one partition for each."""

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                try:
                    args = [] if row.args is None else list(row.args)
                    found = [(row.name, p, None) for p in enumerate_server(row.command, args, dict(row.env or {}), row.url, timeout)]
                except (OSError, ValueError) as e:
                    found = [(row.name, None, f"{row.name}: {e}")]
                yield pd.DataFrame(found, columns=["server", "payload", "message"])

    rows = servers.select("name", "command", "args", "env", "url")
    spread = rows.repartition(max(1, servers.count()), "name")
    # stored, as a lost block would start the programs again
    answers = stored(spread.mapInPandas(ask, "server string, payload string, message string"), "answers")
    tools = rpc_tools(answers.where("payload is not null").select("server", "payload"))
    return tools, answers.where(F.col("message").isNotNull()).select("message")
