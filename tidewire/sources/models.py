"""Language models behind one function, and the analysis and checking steps that use it."""

from __future__ import annotations

import json
import re
import urllib.request
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from contextlib import suppress

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

#: (system prompt, user prompt) -> answer.
Send = Callable[[str, str], str]

ANALYSIS_COLUMNS = (
    "seq bigint, event_id string, is_valid boolean, category string, importance_score double, title string, lead string, details string, summary string, "
    "analysis string, key_data array<struct<label:string,value:string>>, source_names array<string>, topics array<string>, published_at string"
)
CHECK_COLUMNS = "seq bigint, verified boolean, corrected_details string, unsupported_claims array<string>"


_FENCE = re.compile(r"```json\s*(.*?)\s*```", re.S | re.I)


def json_object(text: str) -> dict:
    """The object that starts at the first brace of an answer or of its fence, whatever follows it; trailing commas are forgiven."""
    fenced = _FENCE.search(text)
    body = fenced[1] if fenced else text
    if (brace := body.find("{")) >= 0:
        for tried in (body[brace:], re.sub(r",(\s*[}\]])", r"\1", body[brace:])):
            with suppress(ValueError):
                return json.JSONDecoder().raw_decode(tried)[0]
    raise ValueError(f"no JSON object: {text[:200]}")


class ChatModel:
    """A model with retries and counters; ``send`` does the talking."""

    def __init__(self, send: Send, retries: int = 2):
        self.send, self.retries = send, retries
        self.stats = {"calls": 0, "retries": 0, "prompt_chars": 0, "completion_chars": 0}

    def text(self, system: str, user: str) -> str:
        """One attempt."""
        self.stats["calls"] += 1
        self.stats["prompt_chars"] += len(system) + len(user)
        answer = self.send(system, user)
        self.stats["completion_chars"] += len(answer)
        return answer

    def json(self, system: str, user: str, check: Callable[[dict], dict] = dict) -> dict:
        """An object that ``check`` accepts; any error is retried."""
        for attempt in range(self.retries + 1):
            self.stats["retries"] += attempt > 0
            try:
                return check(json_object(self.text(system, user)))
            except Exception:  # noqa: BLE001  whatever went wrong, another answer may be right
                if attempt == self.retries:
                    raise
        raise AssertionError


def chat_service(url: str, model: str, key: str | None = None, timeout: float = 120, temperature: float = 0.3,
                 post: Callable[[urllib.request.Request, float], bytes] | None = None) -> Send:
    """A ``Send`` that talks to a chat-completions service over HTTP, with messages of the roles system and user."""

    def send(system: str, user: str) -> str:
        messages = [{"role": role, "content": text} for role, text in (("system", system), ("user", user)) if text]
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
        request = urllib.request.Request(f"{url.rstrip('/')}/chat/completions", json.dumps({"model": model, "messages": messages, "temperature": temperature}).encode(), headers)
        raw = post(request, timeout) if post else urllib.request.urlopen(request, timeout=timeout).read()
        return json.loads(raw)["choices"][0]["message"]["content"] or ""

    return send


def _number(value) -> float:
    try:
        return float(value)
    except (TypeError, ValueError):
        return 0.0


def _text(value) -> str | None:
    return None if value is None else str(value)


def _analysis(seq: int, event_id: str, found: dict) -> dict:
    pairs = [{"label": _text(k.get("label")), "value": _text(k.get("value"))} for k in found.get("key_data") or [] if isinstance(k, dict)]
    plain = {k: _text(found.get(k)) for k in ("category", "title", "lead", "details", "summary", "analysis", "published_at")}
    lists = {k: [str(x) for x in found.get(k) or []] for k in ("source_names", "topics")}
    return {"seq": seq, "event_id": event_id, "is_valid": bool(found.get("is_valid", True)), "importance_score": _number(found.get("importance_score")), "key_data": pairs} | plain | lists


#: What is counted of a model's work, on each row and in total.
COUNTERS = ("calls", "retries", "prompt_chars", "completion_chars")


def _asked(contexts: DataFrame, ask: Callable[[dict, ChatModel], dict | None], schema: str, send: Send, retries: int, concurrency: int, watch: Observation | None) -> DataFrame:
    """Rows of ``ask`` for each row, several at a time in a task; None and failures give no row.

    Every row, failed ones too, carries what its model did; ``watch`` gets the sums when the rows are first written, and
    each attempt of a row counts where it happened, in whichever task.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def quiet(row: dict) -> dict:
        model = ChatModel(send, retries)
        try:
            found = ask(row, model)
        except Exception:  # noqa: BLE001  an event without analysis is left out
            found = None
        return (found or dict.fromkeys(names)) | {f"model_{k}": v for k, v in model.stats.items()} | {"model_ok": found is not None}

    def run(frames):
        with ThreadPoolExecutor(concurrency) as pool:
            for frame in frames:
                yield pd.DataFrame(list(pool.map(quiet, frame.to_dict("records"))), columns=[*names, *(f"model_{k}" for k in COUNTERS), "model_ok"])

    marked = contexts.mapInPandas(run, f"{schema}, {', '.join(f'model_{k} bigint' for k in COUNTERS)}, model_ok boolean")
    if watch is not None:
        sums = [F.coalesce(F.sum(f"model_{k}"), F.lit(0)).alias(k) for k in COUNTERS]
        marked = marked.observe(watch, F.count(F.lit(1)).alias("asked"), F.count_if("model_ok").alias("answered"), *sums)
    return marked.where("model_ok").select(*names)


def analyse(contexts: DataFrame, send: Send, prompt: str = "", retries: int = 2, concurrency: int = 3, watch: Observation | None = None) -> DataFrame:
    """Analyses of (seq, event_id, context) rows; ``watch`` gets the numbers of events, answers, calls, retries and characters."""
    ask = lambda r, model: _analysis(r["seq"], r["event_id"], model.json(prompt, r["context"]))
    return _asked(contexts, ask, ANALYSIS_COLUMNS, send, retries, concurrency, watch)


def verify(due: DataFrame, send: Send, prompt: str = "", chars: int = 6000, retries: int = 2, concurrency: int = 3, watch: Observation | None = None) -> DataFrame:
    """Second checks of (seq, title, details, source_text) rows; a failed check changes nothing."""

    def ask(r: dict, model: ChatModel) -> dict:
        user = f"{r['title']}\n\n{r['details']}\n\n{(r['source_text'] or '')[:chars]}"
        found = model.json(prompt, user)
        return {"seq": r["seq"], "verified": bool(found.get("verified", True)), "corrected_details": _text(found.get("corrected_details")), "unsupported_claims": [str(x) for x in found.get("unsupported_claims") or []]}

    return _asked(due, ask, CHECK_COLUMNS, send, retries, concurrency, watch)


def fetch_texts(urls: DataFrame, extract: Callable[[str], str], concurrency: int = 4) -> DataFrame:
    """(url, text) for the column url; failures give an empty text."""

    def one(url: str) -> str:
        try:
            return extract(url) or ""
        except Exception:  # noqa: BLE001  best effort
            return ""

    def run(frames):
        with ThreadPoolExecutor(concurrency) as pool:
            for frame in frames:
                yield pd.DataFrame({"url": frame["url"], "text": list(pool.map(one, frame["url"]))})

    return urls.select(F.col("url")).distinct().mapInPandas(run, "url string, text string")
