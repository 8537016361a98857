"""Replies from a chat endpoint: several requests of a task under way at once, over one client per Python worker."""

from __future__ import annotations

import base64
import http.client
import json
import random
import threading
import time
from urllib.parse import urlsplit

from .replies import ERROR, Service

#: Answers that a later attempt may better.
BUSY = frozenset([408, 425, 429, 500, 502, 503, 504])
LONGEST_WAIT = 60.0


class Client:
    """Connections to one host that stay open, one per thread; those that break are opened again."""

    def __init__(self, url: str, timeout: float):
        self.at, self.timeout, self.own = urlsplit(url), timeout, threading.local()

    def post(self, body: bytes) -> tuple[int, dict[str, str], bytes]:
        made = getattr(self.own, "connection", None)
        if made is None:
            kind = http.client.HTTPSConnection if self.at.scheme == "https" else http.client.HTTPConnection
            made = self.own.connection = kind(self.at.netloc, timeout=self.timeout)
        try:
            made.request("POST", self.at.path or "/", body, {"Content-Type": "application/json"})
            answer = made.getresponse()
            return answer.status, {k.lower(): v for k, v in answer.getheaders()}, answer.read()
        except Exception:
            made.close()
            self.own.connection = None
            raise


_CLIENTS: dict[tuple, Client] = {}
_MAKING = threading.Lock()


def client(url: str, timeout: float) -> Client:
    """The one client of this worker for an endpoint."""
    with _MAKING:
        return _CLIENTS.setdefault((url, timeout), Client(url, timeout))


class ChatReplies(Service):
    """Replies from ``/v1/chat/completions``.

    ``concurrency`` requests of a task run at a time, and tasks in all are as many as ``parallel`` (or ``deal``) makes partitions.  Busy answers and broken
    connections are tried again after waits that double, or as long as the server asks for; a last failure is the reply, after ``ERROR:``.
    """

    def __init__(self, url: str, concurrency: int = 4, parallel: int = 1, model: str = "minicpm", deal=None, attempts: int = 5, first_wait: float = 1.0, timeout: float = 600, max_tokens: int = 1024):
        super().__init__(model, parallel, deal)
        self.url, self.concurrency, self.attempts, self.first_wait, self.timeout, self.max_tokens = url.rstrip("/") + "/v1/chat/completions", concurrency, attempts, first_wait, timeout, max_tokens

    def payload(self, image: bytes | None, text: str, model: str) -> dict:
        content: str | list = text
        if image:
            kind = "png" if image.startswith(b"\x89PNG") else "jpeg"
            page = {"type": "image_url", "image_url": {"url": f"data:image/{kind};base64,{base64.b64encode(image).decode()}"}}
            content = [page, {"type": "text", "text": f"<image>\n{text}" if model == "minicpm" else text}]
        settings = {"max_tokens": self.max_tokens, "temperature": 0.1, "frequency_penalty": 0.5, "presence_penalty": 0.5}
        return {"model": model, "messages": [{"role": "user", "content": content}], **settings}

    def ask(self, image: bytes | None, text: str, model: str) -> str:
        body, why = json.dumps(self.payload(image, text, model)).encode(), ""
        for attempt in range(self.attempts):
            wait = min(LONGEST_WAIT, self.first_wait * 2**attempt) * random.uniform(0.5, 1.0)
            try:
                status, headers, answer = client(self.url, self.timeout).post(body)
            except Exception as e:
                why = f"{ERROR} {e}"
            else:
                if status == 200:
                    try:
                        return json.loads(answer)["choices"][0]["message"]["content"] or ""
                    except (ValueError, LookupError, TypeError) as e:
                        return f"{ERROR} no reply in the answer: {e!r}"
                why = f"{ERROR} HTTP Error {status}: {answer.decode('utf-8', 'replace')}"
                if status not in BUSY:
                    return why
                if headers.get("retry-after", "").isdigit():
                    wait = min(LONGEST_WAIT, float(headers["retry-after"]))
            if attempt + 1 < self.attempts:
                time.sleep(wait)
        return why
