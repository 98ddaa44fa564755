"""The request desk: cancels across batches, time limits, restarts, and answers given once."""

import json
import threading
import time

import pytest

from callweave.session import Project
from callweave.sources.index import Index
from callweave.streaming import requests as Q
from callweave.streaming import service as V


class Slow(V.Service):
    """``analyze`` runs a Spark job of half a minute, unless the entry point is quick; ``annotate_add`` is quick."""

    def __init__(self, project):
        super().__init__(project)
        self.worked, self.started = [], {}

    def handle(self, request):
        self.worked.append(request["id"])
        return super().handle(request)

    def _analyze(self, id_, payload):
        self.started.setdefault(id_, threading.Event()).set()
        if payload["entryPoint"].startswith("slow"):
            self.project.spark.range(2).selectExpr("java_method('java.lang.Thread', 'sleep', 30000 + id)").collect()
        return {"id": id_, "type": "result", "payload": payload["entryPoint"]}


@pytest.fixture()
def project(spark):
    files = spark.createDataFrame([("/p/a.ts", "typescript", "function f() {\n}\n", "1")], "file_path string, language_id string, content string, sha256 string")
    return Project(spark, Index.build(files))


def send(folder, name, *requests):
    (folder / "requests").mkdir(exist_ok=True)
    lines = [r if isinstance(r, str) else json.dumps(r) for r in requests]
    (folder / f".{name}").write_text("\n".join(lines) + "\n")
    (folder / f".{name}").rename(folder / "requests" / name)


def ask(id_, entry):
    return {"id": id_, "type": "analyze", "payload": {"entryPoint": entry}}


def until(what, seconds=60):
    end = time.time() + seconds
    while not (found := what()):
        assert time.time() < end
        time.sleep(0.1)
    return found


def answers(desk):
    return {r["id"]: json.loads(r["answer"]) for r in desk.answers().collect()}


def test_cancel_restart_and_repeats(spark, project, tmp_path):
    service = Slow(project)
    send(tmp_path, "1", ask("long", "slow one"), ask("quick", "f"), "{", "", {"id": "x"})
    desk, stream = Q.serve(service, f"file://{tmp_path}", seconds=0.2)
    until(lambda: "long" in service.started and service.started["long"].is_set())
    until(lambda: "quick" in answers(desk))
    # a later batch: the cancel meets the running request, and a cancel may come before its request
    send(tmp_path, "2", {"id": "c", "type": "cancel", "payload": {"requestId": "long"}}, {"id": "c2", "type": "cancel", "payload": {"requestId": "late"}}, ask("quick", "again"))
    began = time.time()
    until(lambda: {"long", "c", "c2"} <= set(answers(desk)))
    assert time.time() - began < 25
    send(tmp_path, "3", ask("late", "f"), ask("a", "slow two"), ask("b", "slow two"), ask("kept", "slow three"))
    until(lambda: {"late", "a"} <= set(answers(desk)) and service.started.get("kept") and service.started["kept"].is_set())
    found = answers(desk)
    assert found["long"]["payload"]["code"] == found["late"]["payload"]["code"] == found["a"]["payload"]["code"] == "CANCELLED"
    assert found["quick"]["payload"] == "f" and found["c"]["payload"] == {"cancelled": "long"}
    assert sorted(x["payload"]["code"] for x in found.values() if x["type"] == "error" and x["id"] in ("", "x")) == ["INVALID_REQUEST", "PARSE_ERROR"]
    assert service.worked.count("quick") == 1 and "late" not in service.worked
    # killed while b and kept are worked on: they stay open, and the next start takes them up
    stream.stop()
    desk.close()
    assert not {"b", "kept"} & set(answers(desk))
    service = Slow(project)
    service._analyze = lambda id_, payload: {"id": id_, "type": "result", "payload": "after"}
    desk, stream = Q.serve(service, f"file://{tmp_path}", seconds=0.2)
    until(lambda: {"b", "kept"} <= set(answers(desk)))
    assert sorted(service.worked) == ["b", "kept"]
    assert answers(desk)["kept"]["payload"] == "after" and len(answers(desk)) == desk.answers().count()
    stream.stop()
    desk.close()
    desk, stream = Q.serve(Slow(project), f"file://{tmp_path}", seconds=0.2)
    assert desk.unanswered().count() == 0 and not desk._open
    stream.stop()
    desk.close()


def test_restart_that_turns_down(spark, project, tmp_path):
    service = Slow(project)
    send(tmp_path, "1", ask("long", "slow"))
    desk, stream = Q.serve(service, f"file://{tmp_path}", seconds=0.2)
    until(lambda: "long" in service.started)
    stream.stop()
    desk.close()
    desk, stream = Q.serve(service, f"file://{tmp_path}", resume=False, seconds=0.2)
    assert answers(desk)["long"]["payload"]["code"] == "ENGINE_RESTARTED"
    stream.stop()
    desk.close()


def test_time_limit(project):
    project.config.timeout_seconds = 1
    began = time.time()
    assert Slow(project).handle(ask("t", "slow"))["payload"]["code"] == "TIMEOUT" and time.time() - began < 20


def test_failures_are_answers(project):
    service = Slow(project)
    service._analyze = lambda id_, payload: 1 / 0
    assert service.handle(ask("e", "f"))["payload"]["code"] == "INTERNAL_ERROR"


def test_large_answers_are_written(project, monkeypatch, tmp_path, spark):
    monkeypatch.setattr(V, "MOST_ROWS", 5)
    service = V.Service(project, results=f"file://{tmp_path}")
    got = service._rows("r", {"few": spark.range(5), "many": spark.range(100)}, {})
    assert len(got["few"]) == 5 and got["many"]["rows"] == 100 and spark.read.json(got["many"]["path"]).count() == 100
    named = service._rows("r", {"few": spark.range(5)}, {"output": f"file://{tmp_path}/mine"})
    assert named["few"] == {"path": f"file://{tmp_path}/mine/few", "rows": 5}
