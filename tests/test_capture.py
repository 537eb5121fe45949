"""Sessions of a stream: the first event wins, late and repeated events, idle sessions, restarts."""

import json

from pyspark.sql import Row

from cairn.operators.store import Store
from cairn.streaming import capture as H


def event(session, kind, minute, **more):
    return {"event": kind, "session_id": session, "ts": f"2026-01-{1 + minute // 1440:02d}T{minute // 60 % 24:02d}:{minute % 60:02d}:00Z"} | more


def write(folder, name, events):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(map(json.dumps, events)) + "\nnot json\n")


def run(spark, store, tmp_path, **more):
    H.capture(store, H.source(spark, f"file://{tmp_path}/in"), f"file://{tmp_path}/check", **more).awaitTermination()


def sessions(store):
    return {r["id"]: (r["ide"], str(r["started_at"])[5:16], r["ended_at"] and str(r["ended_at"])[5:16]) for r in store.table("sessions").collect()}


def test_sessions_of_a_stream(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    first = [event("a", "session_start", 10, ide="vim"), event("a", "prompt_submit", 12, prompt="hi"), event("b", "tool_use", 20, ide="code", tool="t", result="r"), {"event": "other", "session_id": "a"}]
    write(tmp_path / "in", "1.json", first + first)  # repeated events
    run(spark, store, tmp_path)
    assert sessions(store) == {"a": ("vim", "01-01 00:10", None), "b": ("code", "01-01 00:20", None)}
    assert store.table("observations").count() == 2
    # a late event within the delay is the first one then; an end; and the same events again, after a restart
    write(tmp_path / "in", "2.json", [*first, event("a", "session_start", 5, ide="emacs"), event("b", "session_end", 40), event("c", "session_start", 41, ide="x")])
    run(spark, store, tmp_path)
    assert sessions(store) == {"a": ("emacs", "01-01 00:05", None), "b": ("code", "01-01 00:20", "01-01 00:40"), "c": ("x", "01-01 00:41", None)}
    assert store.table("observations").count() == 2
    # days later: what was held is forgotten, but what is stored stands
    write(tmp_path / "in", "3.json", [event("d", "session_start", 5 * 1440)])
    run(spark, store, tmp_path)
    write(tmp_path / "in", "4.json", [event("a", "session_end", 5 * 1440 + 30, ide="later"), event("c", "prompt_submit", 3, ide="too late")])
    run(spark, store, tmp_path)
    got = sessions(store)
    assert got["a"] == ("emacs", "01-01 00:05", "01-06 00:30") and got["c"] == ("x", "01-01 00:41", None) and set(got) == {"a", "b", "c", "d"}


def test_idle_sessions_are_forgotten(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    for i in range(3):
        write(tmp_path / "in", f"{i}.json", [event(f"s{i}", "session_start", i * 3 * 1440), event(f"t{i}", "session_start", i * 3 * 1440 + 1)])
        run(spark, store, tmp_path)
    write(tmp_path / "in", "last.json", [event("end", "session_start", 20 * 1440)])
    run(spark, store, tmp_path)
    run(spark, store, tmp_path)
    held = spark.read.format("statestore").option("stateVarName", "known").load(f"file://{tmp_path}/check/sessions")
    assert store.table("sessions").count() == 7 and held.count() <= 1


class Calls:
    """Stands for the state of one session and counts what is asked of it."""

    def __init__(self):
        self.value, self.timers, self.calls = None, [], []

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value

    def registerTimer(self, at):
        self.calls.append("register")
        self.timers.append(at)

    def deleteTimer(self, at):
        self.calls.append("delete")
        self.timers.remove(at)

    def getCurrentWatermarkInMs(self):
        return 0


def test_a_session_costs_few_calls():
    state, processor = Calls(), H.Sessions(1000)
    processor.init(state)
    row = lambda kind, at, ide: Row(event=kind, ide=ide, cwd=None, room="r", at=at)
    told = list(processor.handleInputRows(("a",), iter([row("prompt_submit", 9_000_001, "late"), row("session_start", None, "never"), row("session_start", 5_000_000, "vim"), row("session_end", 9_000_002, "late")]), state))
    assert told == [Row(id="a", ide="vim", cwd=None, room="r", started=5_000_000, ended=9_000_002)]
    assert state.calls == ["get", "register", "update"] and state.timers == [10_000]
    state.calls.clear()
    assert not list(processor.handleInputRows(("a",), iter([row("prompt_submit", 9_000_002, "x")]), state)) and state.calls == ["get"]
    assert not list(processor.handleInputRows(("a",), iter([row("prompt_submit", 11_000_000, "x")]), state)) and state.timers == [12_000]


def test_times_keep_their_zone_and_parts(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    write(tmp_path / "in", "1.json", [{"event": "session_start", "session_id": "a", "ts": "2026-10-25T00:30:00.123456Z"}, {"event": "session_end", "session_id": "a", "ts": "2026-10-25T01:30:00.000007Z"}, {"event": "tool_use", "session_id": "b"}])
    run(spark, store, tmp_path)
    got = {r["id"]: (r["s"], r["e"]) for r in store.table("sessions").selectExpr("id", "unix_micros(started_at) s", "unix_micros(ended_at) e").collect()}
    assert got == {"a": (1792888200123456, 1792891800000007), "b": (None, None)}
