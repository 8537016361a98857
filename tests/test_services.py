"""Model services against local servers: contracts, order, back-off, the ledger, and routed calls."""

import json
import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from paperloom.plans import routing
from paperloom.sources import replies
from paperloom.sources.chat import ChatReplies
from paperloom.sources.ledger import Ledger, call_key

SCHEMA = "doc_id int, seg_idx int, png binary, prompt string"


@pytest.fixture
def server():
    """A server whose ``answer(path, body)`` gives (status, headers, object) or raises to break the connection; it counts calls and those under way."""

    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def do_POST(self):
            body = self.rfile.read(int(self.headers.get("Content-Length", 0)))
            with s.lock:
                s.now += 1
                s.most = max(s.most, s.now)
                s.peers.add(self.client_address)
            try:
                status, headers, out = s.answer(self.path, json.loads(body) if body else None)
            except Exception:
                self.close_connection = True
                self.connection.close()
                return
            finally:
                with s.lock:
                    s.now -= 1
            raw = json.dumps(out).encode()
            self.send_response(status)
            for k, v in headers.items():
                self.send_header(k, v)
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        do_GET = do_POST

        def log_message(self, *args):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    s.lock, s.now, s.most, s.peers, s.calls = threading.Lock(), 0, 0, set(), Counter()
    s.url = f"http://127.0.0.1:{s.server_address[1]}"
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield s
    s.shutdown()
    s.server_close()


def said(body):
    content = body["messages"][0]["content"]
    return content if isinstance(content, str) else content[1]["text"].removeprefix("<image>\n")


def chat(text):
    return 200, {}, {"choices": [{"message": {"content": text}}]}


def test_chat_keeps_order_and_bounds_requests(spark, server):
    def answer(path, body):
        assert path == "/v1/chat/completions"
        time.sleep(0.02 * (int(said(body)[1:]) % 3))
        return chat("re " + said(body))

    server.answer = answer
    rows = [(i, 0, None, f"p{i}") for i in range(40)]
    got = ChatReplies(server.url, concurrency=4, parallel=1).extract(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["doc_id"]: r["reply"] for r in got} == {i: f"re p{i}" for i in range(40)}
    assert 2 <= server.most <= 4 and len(server.peers) <= 4, "connections are used again, a thread each"


def test_chat_payload():
    service = ChatReplies("http://h/")
    plain = service.payload(None, "t", "qwen")
    assert plain["messages"] == [{"role": "user", "content": "t"}]
    assert (plain["max_tokens"], plain["temperature"], plain["frequency_penalty"], plain["presence_penalty"]) == (1024, 0.1, 0.5, 0.5)
    page = service.payload(b"\x89PNG1", "t", "minicpm")["messages"][0]["content"]
    assert page[0]["image_url"]["url"].startswith("data:image/png;base64,") and page[1]["text"] == "<image>\nt"
    assert service.payload(b"\xff\xd8", "t", "qwen")["messages"][0]["content"][1]["text"] == "t"


def test_chat_tries_again_and_fails_as_a_reply(spark, server):
    def answer(path, body):
        with server.lock:
            server.calls[said(body)] += 1
            n = server.calls[said(body)]
        if said(body) == "busy" and n < 3:
            return 503, {}, {"error": "busy"}
        if said(body) == "wait" and n < 2:
            return 429, {"Retry-After": "0"}, {}
        if said(body) == "broken" and n < 2:
            raise OSError
        if said(body) == "bad":
            return 400, {}, {"error": "no"}
        if said(body) == "down":
            return 500, {}, {"error": "down"}
        return (200, {}, {"choices": []}) if said(body) == "odd" else chat("fine")

    server.answer = answer
    rows = [(i, 0, None, p) for i, p in enumerate(("busy", "wait", "broken", "bad", "down", "odd", "well"))]
    got = ChatReplies(server.url, attempts=3, first_wait=0.01).extract(spark.createDataFrame(rows, SCHEMA)).collect()
    reply = {r["prompt"]: r["reply"] for r in got}
    assert [reply[p] for p in ("busy", "wait", "broken", "well")] == ["fine"] * 4
    assert reply["bad"].startswith("ERROR: HTTP Error 400") and "no" in reply["bad"] and server.calls["bad"] == 1
    assert reply["down"].startswith("ERROR: HTTP Error 500") and server.calls["down"] == 3
    assert reply["odd"].startswith("ERROR: no reply") and server.calls == {"busy": 3, "wait": 2, "broken": 2, "bad": 1, "down": 3, "odd": 1, "well": 1}
    assert ChatReplies("http://127.0.0.1:9", attempts=2, first_wait=0.01).ask(None, "x", "qwen").startswith("ERROR:")


def test_submit_and_poll(spark, server):
    def answer(path, body):
        if path == "/extract":
            return 200, {}, {"job_id": None if body["prompt"] == "refused" else body["prompt"]}
        job = path.rpartition("/")[2]
        with server.lock:
            server.calls[job] += 1
        if job == "slow" and server.calls[job] < 3:
            return (500, {}, {}) if server.calls[job] == 1 else (200, {}, {"status": "processing"})
        return 200, {}, {"status": "error", "message": "sorry"} if job == "wrong" else {"status": "processing"} if job == "never" else {"status": "completed", "data": f"d {job}"}

    server.answer = answer
    rows = [(i, 0, b"x", p) for i, p in enumerate(("slow", "wrong", "never", "refused", "quick"))]
    service = replies.ServiceReplies(server.url, parallel=2, poll_seconds=0.01, polls=5)
    reply = {r["prompt"]: r["reply"] for r in service.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (reply["slow"], reply["quick"], reply["wrong"]) == ("d slow", "d quick", "ERROR: sorry")
    assert reply["never"].startswith("ERROR:") and reply["refused"].startswith("ERROR:")


def fragile():
    """A class that workers get by value."""

    class Fragile(ChatReplies):
        """Kills its Python worker after some answers, as a lost executor would."""

        def __init__(self, *args, lives, **more):
            super().__init__(*args, **more)
            self.lives = lives

        def ask(self, image, text, model):
            if not self.lives:
                import os

                os._exit(1)
            self.lives -= 1
            return super().ask(image, text, model)

    return Fragile


def test_ledger_asks_once(spark, server, tmp_path):
    """A job killed half-way costs no second call; same calls are one call; failures are asked again; finished jobs leave no journal."""

    def answer(path, body):
        with server.lock:
            server.calls[said(body)] += 1
        return (400, {}, {}) if said(body) == "p7" and server.calls["p7"] < 2 else chat("re " + said(body))

    server.answer = answer
    rows = [(i, s, b"page", f"p{i}") for i in range(20) for s in range(3)]
    segments = spark.createDataFrame(rows, SCHEMA).withColumn("png", F.when(F.lit(True), F.col("png")))
    path = str(tmp_path / "ledger")
    with pytest.raises(Exception):  # noqa: B017
        Ledger(fragile()(server.url, concurrency=1, parallel=2, first_wait=0.01, lives=4), path).extract(segments).collect()
    before = sum(server.calls.values())
    assert 0 < before < 20
    plain = Ledger(ChatReplies(server.url, parallel=2, first_wait=0.01), path)
    got = {(r["doc_id"], r["seg_idx"]): r["reply"] for r in plain.extract(segments).collect()}
    assert len(got) == 60 and all(v == f"re p{i}" for (i, _), v in got.items() if i != 7)
    assert {k: n for k, n in server.calls.items() if k != "p7"} == {f"p{i}": 1 for i in range(20) if i != 7}
    again = {r["doc_id"]: r["reply"] for r in plain.extract(segments).collect()}
    assert again[7] == "re p7" and server.calls["p7"] == 2 and sum(server.calls.values()) == 21
    assert not (tmp_path / "ledger" / "journal").exists()
    other = plain.extract(segments.withColumn("model", F.lit("qwen")).limit(1)).collect()
    assert len(other) == 1 and sum(server.calls.values()) == 22, "another model is another call"
    assert plain.replies(spark).filter(F.col("call_key") == call_key(b"page", "p3", "minicpm")).count() == 1


def test_two_steps(spark, server):
    """Languages flow into prompts and models; each task speaks to one model; the calls' layout is one exchange."""

    def answer(path, body):
        with server.lock:
            server.calls[body["model"]] += 1
        if said(body).endswith(replies.SCAN_PROMPT):
            image = body["messages"][0]["content"][0]["image_url"]["url"]
            return chat({"AAAA": "English.", "AQEB": " Tamil, mostly", "AgIC": "Klingon"}[image.rpartition(",")[2]])
        return chat(body["model"] + "|" + said(body))

    server.answer = answer
    rows = [(i, 1, bytes([i % 3]) * 3) for i in range(30)]
    segments = spark.createDataFrame(rows, "doc_id int, seg_idx int, png binary")
    letters = spark.createDataFrame([("tamil", "=== STANDARD ALPHABETS ===\nx y\n")], "language string, content string")
    provider = routing.TwoStep(ChatReplies(server.url), ChatReplies(server.url, deal=routing.deal_by_model({"minicpm": 3, "qwen": 1})), letters)
    out = provider.extract(segments)
    got = out.withColumn("task", F.spark_partition_id()).collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("shufflepartitionidpassthrough") == 1 and "SortMergeJoin" not in plan
    assert {(r["doc_id"] % 3, r["language"], r["model"]) for r in got} == {(0, "english", "qwen"), (1, "tamil", "minicpm"), (2, "mixed", "minicpm")}
    for r in got:
        assert r["reply"].startswith(r["model"] + "|") and ("Tamil block" in r["reply"]) == (r["language"] == "tamil") == ("Alphabets: x y" in r["reply"])
    tasks = {}
    for r in got:
        tasks.setdefault(r["task"], set()).add(r["model"])
    assert all(len(m) == 1 for m in tasks.values()) and len([t for t, m in tasks.items() if m == {"minicpm"}]) > 1
