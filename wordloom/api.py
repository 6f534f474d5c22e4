"""Queries from the outside: JSON objects in, DataFrames or rendered results out."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.errors import QueryError
from wordloom.plans import planner
from wordloom.plans.corpus import Corpus
from wordloom.plans.fields import registry
from wordloom.plans.spec import normalise
from wordloom.sources import formats

_OLD = {"return_json": ("data", "json"), "json": ("data", "json"), "return_csv": ("data", "tsv"), "csv": ("data", "tsv"), "return_tsv": ("data", "tsv"), "search_results": ("search", "json"), "returnPossibleFields": ("schema", "json")}


class Engine:
    """Corpora by name."""

    def __init__(self, *corpora: Corpus):
        self.corpora = {c.name: c for c in corpora}

    def corpus(self, name: str) -> Corpus:
        if name not in self.corpora:
            raise QueryError(f"no database {name}", 404)
        return self.corpora[name]

    def frame(self, query: dict) -> DataFrame:
        """The result as one lazy DataFrame; several searches are stacked, told apart by Search."""
        method = query.get("method", "data") if isinstance(query, dict) else "data"
        method = _OLD.get(method, (method, ""))[0]
        specs = normalise(query)
        corpus = self.corpus(specs[0].database)
        if method == "schema":
            return registry(corpus.spark, corpus.fields, corpus.name)
        if method == "search":
            frames = [planner.bibliography(corpus, s, query.get("ordertype", "frequency"), query.get("limit", planner.TOP), query.get("seed", 0)) for s in specs]
        elif method != "data":
            raise QueryError(f"no method {method}")
        else:
            frames = [planner.data(corpus, s) for s in specs]
        if not isinstance(query.get("search_limits"), list):
            return frames[0]
        return reduce(DataFrame.unionByName, [f.withColumn("Search", F.lit(k)) for k, f in enumerate(frames)])

    def query(self, query: dict | str):
        """The result in the format asked for.  Errors come as an object with status, code and message."""
        try:
            q = json.loads(query) if isinstance(query, str) else query
            if not isinstance(q, dict):
                raise QueryError("a query is an object")
            method, form = q.get("method", "data"), q.get("format", "json")
            old = method in _OLD
            if old:
                method, form = _OLD[method]
            if form not in formats.FORMATS:
                raise QueryError(f"no format {form}")
            limits = q.get("search_limits")
            if method == "data" and isinstance(limits, list) and form == "json":
                parts = [self.query(q | {"search_limits": x}) for x in limits]
                bad = next((p for p in parts if isinstance(p, dict) and p.get("status") == "error"), None)
                return bad or ([p["data"] for p in parts] if old else {"status": "success", "data": [p["data"] for p in parts]})
            df = self.frame(q | {"method": method}).toPandas()
            if method == "schema":
                return {"status": "success", "data": df.to_dict("records")} if form == "json" else formats.render(df, form, [], list(df.columns))
            if method == "search":
                parts = [df[df["Search"] == k] for k in range(len(limits))] if isinstance(limits, list) else [df]
                found = [p["searchstring"].tolist() or ["<empty results>"] for p in parts]
                return {"status": "success", "data": found if isinstance(limits, list) else found[0]} if form == "json" else formats.render(df, form, [], list(df.columns))
            spec = normalise(q)[0]
            groups = list(spec.groups) + (["Search"] if isinstance(limits, list) else [])
            out = formats.render(df, form, groups, list(spec.counttypes))
            return {"status": "success", "data": out} if form in ("json", "json_c") and not old else out
        except QueryError as e:
            return e.as_dict()
        except json.JSONDecodeError as e:
            return QueryError(f"not JSON: {e}").as_dict()


def serve(engine: Engine, host: str = "127.0.0.1", port: int = 10012):
    """A small HTTP server: the query is JSON in the query string or the body.  Returns the server; call serve_forever()."""
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
    from urllib.parse import parse_qs, unquote, urlsplit

    class Handler(BaseHTTPRequestHandler):
        def _answer(self, text: str) -> None:
            out = engine.query(text)
            code = out.get("code", 200) if isinstance(out, dict) else 200
            kind = "application/json" if isinstance(out, (dict, list)) else "application/octet-stream" if isinstance(out, bytes) else "text/plain; charset=utf-8"
            body = out if isinstance(out, bytes) else (json.dumps(out, default=str) if isinstance(out, (dict, list)) else out).encode()
            self.send_response(code)
            self.send_header("Content-Type", kind)
            self.send_header("Access-Control-Allow-Origin", "*")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def do_GET(self) -> None:  # noqa: N802
            raw = urlsplit(self.path).query
            self._answer(parse_qs(raw).get("query", parse_qs(raw).get("q", [unquote(raw)]))[0])

        def do_POST(self) -> None:  # noqa: N802
            self._answer(self.rfile.read(int(self.headers.get("Content-Length", 0))).decode())

    return ThreadingHTTPServer((host, port), Handler)
