"""The engine over HTTP with the standard library: info, samples, search, lineage."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlparse

from pyspark.sql import functions as F

MOST_HITS = 50
DEFAULTS = {"store": "default", "version": "latest", "k": 10, "verify": True}
PAGE = """<!doctype html><title>verdigris</title><form onsubmit="go(event)"><textarea id=q rows=12 cols=90></textarea><br>
store <input id=s value=default> version <input id=v value=latest> <button>Search</button></form><pre id=out></pre><script>
async function go(e){e.preventDefault();const r=await fetch('/api/search',{method:'POST',body:JSON.stringify({query:q.value,store:s.value,version:v.value})});
out.textContent=JSON.stringify(await r.json(),null,1)}</script>"""


class Problem(Exception):
    def __init__(self, status: int, message: str):
        super().__init__(message)
        self.status = status


def checked(body: dict) -> dict:
    """A search request with defaults; the number of hits is kept between 1 and MOST_HITS."""
    if not isinstance(body.get("query"), str):
        raise Problem(422, "query must be a string")
    out = {k: body.get(k, v) for k, v in DEFAULTS.items()}
    for k, v in DEFAULTS.items():
        if type(out[k]) is not type(v):
            raise Problem(422, f"{k} must be of type {type(v).__name__}")
    return out | {"query": body["query"], "k": max(1, min(out["k"], MOST_HITS))}


def write_samples(rows, path: str) -> str:
    """Samples as one JSON file on this machine; they are what people choose from by hand, so few."""
    out = json.dumps([r.asDict() for r in rows.toLocalIterator()], ensure_ascii=False, indent=1)
    with open(path, "w", encoding="utf-8") as f:
        f.write(out)
    return out


def load_samples(path: str) -> list[dict]:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


class App:
    """Requests as plain values, so tests need no socket.  ``samples`` are dicts with id, text, gold, evolving, title."""

    def __init__(self, engine, samples=()):
        self.engine, self.samples = engine, list(samples)
        self.gold = {s["text"]: s.get("gold") for s in self.samples}

    def handle(self, method: str, target: str, body: bytes = b""):
        url = urlparse(target)
        asked = {k: v[0] for k, v in parse_qs(url.query).items()}
        path = url.path.rstrip("/") or "/"
        if (method, path) == ("GET", "/"):
            return PAGE
        if (method, path) == ("GET", "/api/info"):
            return self.info()
        if (method, path) == ("GET", "/api/samples"):
            return [{k: s.get(k) for k in ("id", "title", "evolving", "gold")} for s in self.samples]
        if method == "GET" and path.startswith("/api/sample/"):
            wanted = unquote(path.rsplit("/", 1)[1])
            found = [s for s in self.samples if s["id"] == wanted]
            if not found:
                raise Problem(404, "no such sample")
            return found[0]
        if (method, path) == ("GET", "/api/lineage"):
            return self.lineage(asked.get("store", ""), asked.get("uid", ""))
        if (method, path) == ("POST", "/api/search"):
            try:
                given = json.loads(body or b"{}")
            except ValueError:
                raise Problem(422, "no JSON") from None
            return self.search(checked(given))
        raise Problem(404, "no such page")

    def info(self) -> dict:
        out = {}
        for name in self.engine.stores():
            store = self.engine.store(name)
            sizes = {r.version: r["count"] for r in store.manifests().groupBy("version").count().collect()}  # one row a version
            out[name] = [{"name": r.version, "snippets": sizes.get(r.version, 0), "diff": r["diff"].asDict(), "source": r.source} for r in store.history().collect()]
        return {"stores": out, "model": self.engine.encoder.name, "k_verify": self.engine.settings.top_verify, "k_expand": self.engine.settings.expand}

    def search(self, r: dict) -> dict:
        try:
            answer = self.engine.search(r["query"], r["store"], r["version"], r["k"], r["verify"])
        except KeyError as e:
            raise Problem(400, str(e)) from None
        gold = self.gold.get(r["query"])
        sha = None
        if gold:  # the labelled content is the one of the first version
            first = self.engine.store(r["store"]).versions()[:1]
            row = self.engine.store(r["store"]).entries(first[0]).where(F.col("uid") == gold).first() if first else None
            sha = row.sha if row else None
        return answer | {"gold": gold, "gold_sha": sha}

    def lineage(self, store: str, uid: str) -> list[dict]:
        rows = self.engine.store(store).lineage(uid, texts=True).collect()  # one row a version
        return [{k: r[k] for k in ("version", "sha", "changed", "text")} for r in rows]


def serve(engine, host: str = "127.0.0.1", port: int = 8000, samples=()):
    app = App(engine, samples)

    class Handler(BaseHTTPRequestHandler):
        def _answer(self, method):
            try:
                body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
                status, value = 200, app.handle(method, self.path, body)
            except Problem as e:
                status, value = e.status, {"detail": str(e)}
            page = isinstance(value, str)
            data = (value if page else json.dumps(value, default=str)).encode()
            self.send_response(status)
            self.send_header("Content-Type", "text/html; charset=utf-8" if page else "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self):
            self._answer("GET")

        def do_POST(self):
            self._answer("POST")

    ThreadingHTTPServer((host, port), Handler).serve_forever()
