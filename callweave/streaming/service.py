"""Requests as lines of JSON, and file changes as a stream.

``dispatch`` answers one request; ``serve`` reads a text source of requests as a stream
and writes each batch's responses in order. ``follow`` keeps a saved index up to date from
a stream of changed files.
"""

from __future__ import annotations

import hashlib
import json
import threading
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import exact
from ..operators import overlays as O
from ..operators.graph import own_folder
from ..session import Project, rendered
from ..sources.index import Index
from ..sources.store import Store

TYPES = ("analyze", "analyze_nl", "search_condition", "overlay", "file_changed", "annotate_add", "annotate_remove", "cancel")
#: Rows of a part that an answer carries; larger parts are written by the executors.
MOST_ROWS = 10_000


def parsed(line: str) -> tuple[dict | None, dict | None]:
    """The request of a line, or the error it gets; (None, None) for a blank line."""
    if not line.strip():
        return None, None
    try:
        request = json.loads(line)
    except json.JSONDecodeError as e:
        return None, error("", "PARSE_ERROR", str(e))
    if not isinstance(request, dict) or not isinstance(request.get("id"), str) or not isinstance(request.get("type"), str):
        return None, error(request.get("id", "") if isinstance(request, dict) else "", "INVALID_REQUEST", "id and type are required")
    return request, None


def tag(id_: str) -> str:
    """The job tag of a request, whatever characters its id has."""
    return "request-" + hashlib.sha256(id_.encode()).hexdigest()[:32]


def error(id_: str, code: str, message: str) -> dict:
    return {"id": id_, "type": "error", "payload": {"code": code, "message": message}}


class Service:
    """Answers requests about one project. Annotations live in ``annotations``."""

    def __init__(self, project: Project, annotations: DataFrame | None = None, progress: Callable[[dict], None] = lambda _: None, results: str | None = None):
        self.project, self.annotations, self.progress = project, annotations, progress
        #: A shared folder for answers that are too large for a line.
        self.results = results or f"{project.spark.conf.get('spark.checkpoint.dir', None) or own_folder(project.spark)}/callweave-results"
        #: Of requests that are to stop the code that they are answered with.
        self._stopped: dict[str, str] = {}
        self._running: dict[str, threading.Event] = {}
        self._notes = threading.Lock()

    def handle(self, request: dict) -> dict:
        """Answer one request; several threads may call this at once."""
        id_, kind, payload = request["id"], request["type"], request.get("payload") or {}
        if kind not in TYPES:
            return error(id_, "UNKNOWN_TYPE", f"unknown request type: {kind}")
        sc, over = self.project.spark.sparkContext, threading.Event()
        self._running[id_] = over
        timer = threading.Timer(self.project.config.timeout_seconds, lambda: self._stop(id_, "TIMEOUT"))
        timer.daemon = True
        timer.start()
        sc.addJobTag(tag(id_))
        try:
            if id_ in self._stopped:
                return self._was_stopped(id_)
            return getattr(self, f"_{kind}")(id_, payload)
        except Exception as e:
            if id_ in self._stopped:
                return self._was_stopped(id_)
            if isinstance(e, KeyError | ValueError):
                return error(id_, "INVALID_REQUEST", str(e))
            return error(id_, "INTERNAL_ERROR", str(e)[:2000])
        finally:
            over.set()
            timer.cancel()
            sc.removeJobTag(tag(id_))
            self._running.pop(id_, None)
            self._stopped.pop(id_, None)

    def _was_stopped(self, id_: str) -> dict:
        code = self._stopped[id_]
        return error(id_, code, "cancelled" if code == "CANCELLED" else f"not done after {self.project.config.timeout_seconds} seconds")

    def _stop(self, id_: str, code: str) -> None:
        """Stop a running request: its jobs end, those too that it starts until it notices."""
        self._stopped.setdefault(id_, code)
        over = self._running.get(id_)
        if over is None:  # it stops as it starts
            return

        def end() -> None:
            while not over.is_set():
                self.project.spark.sparkContext.cancelJobsWithTag(tag(id_))
                over.wait(0.2)

        threading.Thread(target=end, daemon=True).start()

    def cancel(self, id_: str) -> None:
        self._stop(id_, "CANCELLED")

    def _at(self, id_: str, percent: int) -> bool:
        """Report progress; whether the request is to stop."""
        self.progress({"id": id_, "type": "progress", "payload": {"percent": percent}})
        return id_ in self._stopped

    def _graph(self, id_: str, entry: str, payload: dict) -> dict:
        options = exact.Options(payload.get("maxDepth", 20), payload.get("maxNodes", exact.MOST_NODES), payload.get("includeConditionals", True))
        if self._at(id_, 50):
            return self._was_stopped(id_)
        g = self.project.graph(entry, payload.get("direction", "downstream"), options)
        if self._at(id_, 90):
            return self._was_stopped(id_)
        return {"id": id_, "type": "result", "payload": json.loads(rendered(g, "json", self.project.root))}

    def _analyze(self, id_: str, payload: dict) -> dict:
        self._at(id_, 10)
        entry = self.project.entry(payload["entryPoint"])
        return self._graph(id_, entry, payload) if entry else error(id_, "SYMBOL_NOT_FOUND", payload["entryPoint"])

    def _analyze_nl(self, id_: str, payload: dict) -> dict:
        found = self.project.rank(payload["description"]).select("node_id", "name", "qualified_name", "file_path", "line", "score", "reason").collect()  # at most five
        if not found:
            return error(id_, "NO_CANDIDATES", "no entry point matches")
        if len(found) > 1:
            return {"id": id_, "type": "candidates", "payload": [r.asDict() for r in found]}
        return self._graph(id_, found[0]["node_id"], payload)

    def _rows(self, id_: str, parts: dict[str, DataFrame], payload: dict) -> dict:
        """The rows of each part.

        With a ``limit`` so many, and ``truncated`` names the parts that have more. Else all:
        a part of more than ``MOST_ROWS``, or any if a folder ``output`` is named, is written
        by the executors as lines of JSON, and the answer has its path and its count.
        """
        out, more, limit = {}, [], payload.get("limit")
        for name, df in parts.items():
            most = MOST_ROWS if limit is None else limit
            found = None if payload.get("output") else [json.loads(r) for r in df.limit(most + 1).toJSON().toLocalIterator()]
            if found is None or limit is None and len(found) > most:
                path = f"{(payload.get('output') or f'{self.results}/{tag(id_)}').rstrip('/')}/{name}"
                df.write.mode("overwrite").json(path)
                out[name] = {"path": path, "rows": self.project.spark.read.text(path).count()}
                continue
            more += [name] if len(found) > most else []
            out[name] = found[:most]
        return out | ({"truncated": more} if more else {})

    def _search_condition(self, id_: str, payload: dict) -> dict:
        parts = self.project.trace(payload["condition"], payload.get("maxDepth", 10))
        return {"id": id_, "type": "result", "payload": self._rows(id_, parts, payload)}

    def _overlay(self, id_: str, payload: dict) -> dict:
        entry = self.project.entry(payload["entryPoint"]) if payload.get("entryPoint") else None
        extra = {k: v for k, v in payload.items() if k in ("report", "diff", "variable", "source", "days", "method")}
        found = self.project.overlay(payload["overlay"], entry, **extra)
        answer = self._rows(id_, found if isinstance(found, dict) else {"rows": found}, payload)
        return {"id": id_, "type": "result", "payload": answer if isinstance(found, dict) or "truncated" in answer else answer["rows"]}

    def _file_changed(self, id_: str, payload: dict) -> dict:
        return {"id": id_, "type": "result", "payload": {"acknowledged": True, "filePath": payload.get("filePath")}}

    def _annotate_add(self, id_: str, payload: dict) -> dict:
        new = self.project.spark.createDataFrame([(payload["id"], payload["nodeId"], payload["text"], payload.get("author", ""), payload.get("timestamp", ""))], "id string, node_id string, text string, author string, timestamp string")
        with self._notes:
            self.annotations = new if self.annotations is None else O.upsert_annotations(self.annotations, new)
        return {"id": id_, "type": "result", "payload": {"added": payload["id"]}}

    def _annotate_remove(self, id_: str, payload: dict) -> dict:
        with self._notes:
            if self.annotations is not None:
                self.annotations = O.remove_annotations(self.annotations, self.project.spark.createDataFrame([(payload["id"],)], "id string"))
        return {"id": id_, "type": "result", "payload": {"removed": payload["id"]}}

    def _cancel(self, id_: str, payload: dict) -> dict:
        self.cancel(payload["requestId"])
        return {"id": id_, "type": "result", "payload": {"cancelled": payload["requestId"]}}

    def answer(self, lines: Iterable[str]) -> list[dict]:
        """Responses to request lines. Of requests for one entry point in the batch only the last is worked on."""
        out, todo = [], []
        for line in lines:
            request, bad = parsed(line)
            if bad:
                out.append(bad)
            elif request:
                todo.append(request)
        last = {(r["type"], (r.get("payload") or {}).get("entryPoint")): r["id"] for r in todo if r["type"] == "analyze"}
        for r in todo:
            if r["type"] == "analyze" and last[(r["type"], (r.get("payload") or {}).get("entryPoint"))] != r["id"]:
                out.append(error(r["id"], "CANCELLED", "a newer request asks the same"))
            else:
                out.append(self.handle(r))
        return out


def serve(service: Service, requests: str, responses: str, checkpoint: str) -> StreamingQuery:
    """Answer the request lines of new files in ``requests``; a batch's responses go to ``responses/batch-<n>``."""
    spark = service.project.spark

    def batch(rows: DataFrame, n: int) -> None:
        found = service.answer(r["value"] for r in rows.toLocalIterator())
        spark.createDataFrame([(json.dumps(x),) for x in found], "value string").coalesce(1).write.mode("overwrite").text(f"{responses}/batch-{n}")

    return spark.readStream.text(requests).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def follow(spark: SparkSession, changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Apply a stream of changed files (file_path, language_id, content, sha256, and if there is one a boolean ``deleted``) to the index at ``path``.

    Each batch is written as a run of its own beside what is there and then named in a new
    manifest, so a reader never sees half an update and a repeated batch changes nothing.
    """

    def batch(rows: DataFrame, n: int) -> None:
        rows = rows.dropDuplicates(["file_path"])
        gone = F.coalesce(F.col("deleted"), F.lit(False)) if "deleted" in rows.columns else F.lit(False)
        Store(spark, path).apply(n, Index.build(rows.where(~gone)), rows.where(gone))

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str) -> Index | None:
    """The index at ``path`` as the last change left it."""
    return Store(spark, path).read()
