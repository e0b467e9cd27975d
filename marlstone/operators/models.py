"""Local model servers: what speaks there, what is sent, and what is taken from a reply.

Requests go through ``get`` and ``post`` functions that the caller may replace;
the ones here use the standard library and give None for any failure.
"""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.operators import adapters, guards

Get = Callable[[str, float], Any]
Post = Callable[[str, dict, float], Any]

# --- fixed values: where servers listen, what tells their dialect, and how long is waited -------
SERVERS = {"http://127.0.0.1:11434": "Ollama", "http://127.0.0.1:1234": "LM Studio", "http://127.0.0.1:1337": "Jan", "http://127.0.0.1:8080": "LocalAI"}
DIALECTS = (("ollama", "/api/tags", "models", "name"), ("openai", "/v1/models", "data", "id"))
PROBE_S, SCAN_S, REJECTED_S, REQUEST_S = 3.0, 1.0, 30.0, 300.0
SUMMARY_SCHEMA = {"type": "object", "properties": {"summary": {"type": "string"}, "insufficient_content": {"type": "boolean"}}, "required": ["summary", "insufficient_content"]}


def _json(request, timeout: float) -> Any:
    try:
        with urllib.request.urlopen(request, timeout=timeout) as reply:
            found = json.loads(reply.read().decode())
        return found if isinstance(found, dict) else None
    except Exception:
        return None


def get_json(url: str, timeout: float) -> Any:
    return _json(url, timeout)


def post_json(url: str, payload: dict, timeout: float = REQUEST_S) -> Any:
    return _json(urllib.request.Request(url, json.dumps(payload).encode(), {"Content-Type": "application/json"}), timeout)


def probe(endpoint: str, timeout: float = PROBE_S, get: Get = get_json) -> tuple[str | None, list[str]]:
    """Dialect and models of a server, (None, []) where none answers in the shape of one."""
    for dialect, path, key, name in DIALECTS:
        reply = get(endpoint.rstrip("/") + path, timeout)
        entries = reply.get(key) if isinstance(reply, dict) else None
        if isinstance(entries, list):
            named = (str(e.get(name, "")).strip() for e in entries if isinstance(e, dict))
            return dialect, [n for n in named if n]
    return None, []


def detect(endpoint: str = "", timeout: float = PROBE_S, get: Get = get_json) -> tuple[str, list[str], str, str]:
    """("ok", models, dialect, endpoint) of the first server with models, ("empty", ...) of one without, or ("unreachable", [], "", "")."""
    places = [endpoint.strip().rstrip("/")] if endpoint.strip() else list(SERVERS)
    wait = timeout if endpoint.strip() else min(timeout, SCAN_S)
    with ThreadPoolExecutor(len(places)) as pool:
        found = list(zip(places, pool.map(lambda place: probe(place, wait, get), places)))
    live = [("ok" if models else "empty", models, dialect, place) for place, (dialect, models) in found if dialect]
    return min(live, key=lambda x: x[0] != "ok", default=("unreachable", [], "", ""))


def request(dialect: str, endpoint: str, model: str, prompt: str, images: list[str] | None = None, schema: dict | None = None) -> tuple[str, dict]:
    """Address and payload of a generation; ``images`` are in base64."""
    base = endpoint.rstrip("/")
    if dialect != "openai":
        extra = {"images": images} if images else {}
        return f"{base}/api/generate", {"model": model, "prompt": prompt, "stream": False, **extra, **({"format": schema} if schema else {})}
    content: Any = prompt
    if images:
        content = [{"type": "text", "text": prompt}, *({"type": "image_url", "image_url": {"url": f"data:image/png;base64,{x}"}} for x in images)]
    shape = {"response_format": {"type": "json_schema", "json_schema": {"name": "result", "schema": schema, "strict": True}}} if schema else {}
    return f"{base}/v1/chat/completions", {"model": model, "messages": [{"role": "user", "content": content}], "stream": False, **shape}


def reply_text(dialect: str, reply: Any) -> str | None:
    """The text of a reply, None where it has none."""
    try:
        text = reply["choices"][0]["message"]["content"] if dialect == "openai" else reply["response"]
    except (KeyError, IndexError, TypeError):
        return None
    return text if isinstance(text, str) and text.strip() else None


def generate(endpoint: str, model: str, prompt: str, images: list[str] | None = None, dialect: str | None = None, schema: dict | None = None, post: Post = post_json, get: Get = get_json) -> str | None:
    """A server's answer, in the dialect that it speaks; asked for anew on each call unless it is given."""
    dialect = dialect or probe(endpoint, get=get)[0] or "ollama"
    return reply_text(dialect, post(*request(dialect, endpoint, model, prompt, images, schema), REQUEST_S))


def asked_twice(ask: Callable[[dict | None], str | None], clock: Callable[[], float] = time.monotonic) -> str | None:
    """A structured answer; where it is refused at once, for want of support, a plain one; a slow failure isn't asked again."""
    start = clock()
    reply = ask(SUMMARY_SCHEMA)
    return ask(None) if reply is None and clock() - start < REJECTED_S else reply


def summaries(docs: DataFrame, ask: Callable[[str, dict | None], str | None], title: str = "title", text: str = "text") -> DataFrame:
    """Adds summary and summary_code (MS-304 where the checks refused a reply) to docs; ``ask`` takes a prompt and a schema or None."""

    def one(body: str | None, name: str | None) -> str | None:
        if not (body or "").strip():
            return None
        prompt = "Summarise the document in two or three sentences.\n\n" + guards.summary_source(body or "", name or "")
        return asked_twice(lambda schema: ask(prompt, schema))

    rows = docs.withColumns({"_text": F.col(text), "_title": F.col(title)})
    out = adapters.called(rows, one, ["_text", "_title"], "_reply", "summary_error")
    summary = guards.clean_summary(guards.unwrap_summary(F.col("_reply")))
    return out.withColumns({"summary": summary, "summary_code": F.when(F.col("_reply").isNotNull() & summary.isNull(), "MS-304")}).drop("_reply")


def polished(docs: DataFrame, ask: Callable[[str], str | None]) -> DataFrame:
    """(doc_id, text, changed): every chunk asked for, and the answers that pass the guard taken."""
    chunks = guards.chunk_table(docs).withColumn("_prompt", F.col("chunk"))
    return guards.polished(adapters.called(chunks, ask, ["_prompt"], "reply", "reply_error"))
