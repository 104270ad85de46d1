"""A page that runs statements: GET gives it, POST {"q": sql} gives rows as JSON, the column names first.

All rows are sent, as they come, one partition after another; POST {"q": sql, "rows": n} asks for the first n.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.errors import PySparkException

from .cli import shown
from .engine import Engine
from .errors import EngineError

PORT = 3334
#: How many rows the page asks for; it says so where there are more.
ROWS = 1000
PAGE = """<!doctype html><meta charset="utf-8"><title>tablekit</title><textarea id="q" rows="6" cols="100"></textarea><br><button onclick="run()">Run</button><table id="t" border="1"></table>
<script>async function run(){const r=await fetch("",{method:"POST",body:JSON.stringify({q:q.value,rows:ROWS_+1})});let a=await r.json();if(a.length>ROWS_+1){a=a.slice(0,ROWS_+1);a.push(["... more rows than "+ROWS_+"; LIMIT offset, n shows others"])}t.replaceChildren(...(a.error?[[a.error]]:a).map(x=>{const tr=document.createElement("tr");x.forEach(c=>{const td=document.createElement("td");td.textContent=c;tr.append(td)});return tr}))}</script>"""


def answer(engine: Engine, body: str) -> tuple[int, Iterator[str]]:
    """The status and the parts of the JSON text."""
    try:
        asked = json.loads(body)
        df = engine.sql(asked["q"])
        df = df if asked.get("rows") is None else df.limit(int(asked["rows"]))
        rows = df.toLocalIterator()
        first = next(rows, None)  # errors that only running shows come before any text
    except (EngineError, ValueError, KeyError, TypeError, PySparkException) as e:
        return 400, iter([json.dumps({"error": str(e)})])

    def parts() -> Iterator[str]:
        yield "[" + json.dumps(df.columns)
        row = first
        while row is not None:
            yield "," + json.dumps([None if v is None else shown(v) for v in row])
            row = next(rows, None)
        yield "]"

    return 200, parts()


def server(engine: Engine, port: int = PORT, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def _send(self, status: int, kind: str, parts: Iterable[str]) -> None:
            self.send_response(status)
            self.send_header("Content-Type", f"{kind}; charset=utf-8")
            self.send_header("Connection", "close")
            self.end_headers()
            for text in parts:
                self.wfile.write(text.encode())

        def do_GET(self) -> None:  # noqa: N802
            self._send(200, "text/html", [PAGE.replace("ROWS_", str(ROWS))])

        def do_POST(self) -> None:  # noqa: N802
            status, parts = answer(engine, self.rfile.read(int(self.headers.get("Content-Length", 0))).decode())
            self._send(status, "application/json", parts)

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
