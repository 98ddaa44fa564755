"""Requests worked on at once, with a durable log, so that they can be cancelled and taken up again.

Request lines come as a stream. A stateful operator keyed by request id remembers what it has
seen: a request is let through once, however often its line comes, and a cancel that comes
before its request still meets it. What it lets through is logged before it is worked on, and
an answer is a file of its own, moved into place whole. So what is open is the log without
the answers, and a restart takes it up or turns it down. Work runs in a few threads under a
job tag for each request; a batch only hands it out, so a later batch can cancel it.
"""

from __future__ import annotations

import hashlib
import json
import sys
import threading
import time
from collections.abc import Iterator
from concurrent.futures import Future, ThreadPoolExecutor

import pandas as pd
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..sources.store import Folder
from .service import Service, error, parsed

#: What is handed out: run a request, cancel one that may be running, or answer one that was cancelled before it came.
ACTIONS = "id string, action string, line string, place string"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Once(StatefulProcessor):
    """For each request id what has been seen of it: its line, and whether it was cancelled."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "line string, cancelled boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        line, cancelled = self.seen.get() if self.seen.exists() else (None, False)
        events = pd.concat(rows).sort_values("place")
        out = []
        for event, text, place in zip(events["event"], events["line"], events["place"]):
            if event == "cancel" and not cancelled:
                cancelled = True
                if line is not None:
                    out.append((key[0], "cancel", None, place))
            elif event == "request" and line is None:
                line = text
                out.append((key[0], "refuse" if cancelled else "run", text, place))
        self.seen.update((line, cancelled))
        yield pd.DataFrame(out, columns=["id", "action", "line", "place"], dtype=object)

    def close(self) -> None:
        pass


def events(lines: DataFrame) -> DataFrame:
    """(id, event, line, place): each request under its id, and a cancel under the id that it is meant for as well.

    A line that is no request is named by its text, so that it too is answered once.
    """
    head = F.from_json("value", "id string, type string, payload struct<requestId string>").alias("r")
    at = lines.where(F.trim("value") != "").select("value", "place", head)
    own = F.struct(F.coalesce("r.id", F.concat(F.lit("?"), F.sha2("value", 256))).alias("id"), F.lit("request").alias("event"), F.col("value").alias("line"))
    meant = F.when((F.col("r.type") == "cancel") & F.col("r.payload.requestId").isNotNull(), F.struct(F.col("r.payload.requestId").alias("id"), F.lit("cancel").alias("event"), F.lit(None).cast("string").alias("line")))
    return at.select("place", F.explode(F.array_compact(F.array(own, meant))).alias("e")).select("e.id", "e.event", "e.line", "place")


class Desk:
    """Works on the requests that arrive in ``<folder>/requests``; log and answers lie beside them.

    A request that runs longer than the project's limit is answered with TIMEOUT. A request
    for an entry point cancels one for the same that is still open. After a restart what is
    open is worked on again, or with ``resume=False`` answered with ENGINE_RESTARTED. The
    session's later streams keep their state in RocksDB too, which the desk's needs.
    """

    def __init__(self, service: Service, folder: str, threads: int = 4, resume: bool = True):
        self.service, self.folder, self.resume = service, folder.rstrip("/"), resume
        self.spark = service.project.spark
        self._files = Folder(self.spark, self.folder)
        self._pool = ThreadPoolExecutor(threads, thread_name_prefix="request")
        self._open: dict[str, Future] = {}
        self._latest: dict[str, str] = {}
        self._lock, self._closed = threading.RLock(), False

    # answers

    @staticmethod
    def _answer(id_: str) -> str:
        return f"responses/{hashlib.sha256(id_.encode()).hexdigest()}.json"

    def respond(self, id_: str, answer: dict) -> bool:
        """Put the answer in place, unless the request has one; a reader never sees half of it."""
        return not self._closed and self._files.put(self._answer(id_), json.dumps({"key": id_, "answer": answer}), replace=False)

    def answers(self) -> DataFrame:
        """(id, answer): every answer so far, as JSON text."""
        try:
            return self.spark.read.text(f"{self.folder}/responses").select(F.get_json_object("value", "$.key").alias("id"), F.get_json_object("value", "$.answer").alias("answer"))
        except AnalysisException:
            return self.spark.createDataFrame([], "id string, answer string")

    # work

    def unanswered(self) -> DataFrame:
        """(id, line, place): logged requests without an answer."""
        try:
            log = self.spark.read.schema(ACTIONS + ", batch long").parquet(f"{self.folder}/log")
        except AnalysisException:
            return self.spark.createDataFrame([], "id string, line string, place string")
        return log.where("line IS NOT NULL").select("id", "line", "place").join(self.answers().select("id"), "id", "left_anti")

    def start(self, seconds: float = 1) -> StreamingQuery:
        self.spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
        gone = self.spark.read.schema(ACTIONS).parquet(f"{self.folder}/log").where("action = 'cancel'").select("id").distinct() if self._files.names("log") else None
        left = self.unanswered()
        if gone is not None:
            # cancelled, but stopped before that was said
            for r in left.join(gone, "id", "left_semi").toLocalIterator():
                self.respond(r["id"], error(r["id"], "CANCELLED", "cancelled"))
            left = left.join(gone, "id", "left_anti")
        for r in left.orderBy("place").toLocalIterator():
            if self.resume:
                self._submit(r["id"], r["line"])
            else:
                self.respond(r["id"], error(r["id"], "ENGINE_RESTARTED", "the engine was restarted; send the request again"))
        # a file of requests is what a client wrote at once; their order is that of files, then of lines
        files = self.spark.readStream.text(f"{self.folder}/requests", wholetext=True).select("value", F.date_format("_metadata.file_modification_time", "yyyyMMddHHmmssSSS").alias("at"), F.col("_metadata.file_path").alias("file"))
        lines = files.select("at", "file", F.posexplode(F.split("value", "\r?\n")).alias("i", "value")).select("value", F.concat_ws(":", "at", "file", F.lpad(F.col("i").cast("string"), 10, "0")).alias("place"))
        actions = events(lines).groupBy("id").transformWithStateInPandas(Once(), ACTIONS, "Update", "None")
        return actions.writeStream.outputMode("update").foreachBatch(self._batch).option("checkpointLocation", f"{self.folder}/checkpoint").trigger(processingTime=f"{seconds} seconds").start()

    def _batch(self, rows: DataFrame, n: int) -> None:
        """Log what came, then hand it out. A batch that is repeated is logged in its own place, and nothing is answered twice."""
        rows.write.mode("overwrite").parquet(f"{self.folder}/log/batch={n}")
        for r in self.spark.read.schema(ACTIONS).parquet(f"{self.folder}/log/batch={n}").orderBy("place").toLocalIterator():
            if r["action"] == "run":
                self._submit(r["id"], r["line"])
            elif r["action"] == "refuse":
                self.respond(r["id"], error(r["id"], "CANCELLED", "cancelled before it came"))
            else:
                self.cancel(r["id"])

    def _submit(self, id_: str, line: str) -> None:
        request, bad = parsed(line)
        if bad is not None:
            self.respond(id_, bad)
            return
        if self._files.has(self._answer(id_)):
            return  # a batch that is repeated
        with self._lock:
            if id_ in self._open or self._closed:
                return
            entry = (request.get("payload") or {}).get("entryPoint") if request["type"] == "analyze" else None
            if entry is not None:
                if (before := self._latest.get(entry)) in self._open:
                    self.cancel(before, "a newer request asks the same")
                self._latest[entry] = id_
            self._open[id_] = self._pool.submit(self._work, id_, request)

    def _work(self, id_: str, request: dict) -> None:
        try:
            answer = self.service.handle(request)
            self.respond(id_, answer)
        finally:
            with self._lock:
                self._open.pop(id_, None)

    def cancel(self, id_: str, why: str = "cancelled") -> None:
        """A running request is stopped, a waiting one never starts; one that has its answer keeps it."""
        with self._lock:
            work = self._open.get(id_)
        if work is None:
            return
        if work.cancel():
            with self._lock:
                self._open.pop(id_, None)
            self.respond(id_, error(id_, "CANCELLED", why))
        else:
            self.service.cancel(id_)

    def idle(self, seconds: float = 60) -> bool:
        """Wait until nothing is open, or for ``seconds``."""
        end = time.time() + seconds
        while self._open and time.time() < end:
            time.sleep(0.05)
        return not self._open

    def close(self) -> None:
        """Stop at once. What is open stays so in the log, for the next start."""
        self._closed = True
        for id_, work in list(self._open.items()):
            if not work.cancel():
                self.service.cancel(id_)
        self._pool.shutdown(wait=True, cancel_futures=True)


def serve(service: Service, folder: str, threads: int = 4, resume: bool = True, seconds: float = 1) -> tuple[Desk, StreamingQuery]:
    desk = Desk(service, folder, threads, resume)
    return desk, desk.start(seconds)


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package
