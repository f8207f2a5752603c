import json
import os
import sys
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tablelore.plans import documenting
from tablelore.plans.documenting import Models, Settings, document, resume, save, saved
from tablelore.sources.replies import Replies
from tablelore.sources.versions import Moved, Versions, key_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def answers(found):
    return {r.call_id: (r.reply, r.failure) for r in found.collect()}


def calls(spark, numbers):
    rows = [(f"{n:03x}" * 4, json.dumps([{"role": "user", "content": str(n)}])) for n in numbers]
    return spark.createDataFrame(rows, "call_id string, messages string")


class Counted:
    """Notes every call in a file of its own; dies, worker and all, after some."""

    def __init__(self, folder, dies_after=None, fails=()):
        self.folder, self.dies_after, self.fails = str(folder), dies_after, fails
        os.makedirs(self.folder, exist_ok=True)

    def __call__(self, messages):
        content = messages[-1]["content"]
        if self.dies_after is not None and len(os.listdir(self.folder)) >= self.dies_after:
            os._exit(1)
        open(f"{self.folder}/{content}-{os.urandom(4).hex()}", "w").close()
        if content in self.fails:
            raise RuntimeError(f"no answer to {content}")
        return f"answer {content}"

    def made(self):
        return sorted(name.split("-")[0] for name in os.listdir(self.folder))


def test_a_run_that_dies_keeps_its_replies(spark, tmp_path):
    prompts, store = calls(spark, range(40)), Replies(spark, str(tmp_path / "replies"), keep_every=1)
    first = Counted(tmp_path / "first", dies_after=20)
    with pytest.raises(Exception, match="."):
        store.ask(prompts, first, partitions=1)
    kept = answers(store.known(prompts).withColumn("failure", F.lit(None).cast("string")))
    assert len(first.made()) == 20 and len(kept) in (19, 20)  # the last one may not have been put away
    second = Counted(tmp_path / "second")
    found = answers(store.ask(prompts, second, partitions=1))
    assert len(second.made()) == 40 - len(kept) and not set(second.made()) & {r[0].split()[1] for r in kept.values()}
    assert found == {f"{n:03x}" * 4: (f"answer {n}", None) for n in range(40)}
    third = Counted(tmp_path / "third")
    assert answers(store.ask(prompts, third)) == found and third.made() == []
    notes = [json.load(open(tmp_path / "replies" / "_attempts" / n)) for n in os.listdir(tmp_path / "replies" / "_attempts")]
    assert sorted((n["whole"], n["replies"]) for n in notes)[-1] == (True, 40 - len(kept))


def test_failed_calls_are_told_and_made_again(spark, tmp_path):
    prompts, store = calls(spark, [1, 2, 3, 2]), Replies(spark, str(tmp_path / "replies"))
    first = Counted(tmp_path / "first", fails=("2",))
    found = answers(store.ask(prompts, first))
    assert found["002" * 4] == (None, "no answer to 2") and found["001" * 4] == ("answer 1", None) and first.made() == ["1", "2", "3"]
    second = Counted(tmp_path / "second")
    assert answers(store.ask(prompts, second))["002" * 4] == ("answer 2", None) and second.made() == ["2"]


def test_some_calls_are_looked_up_in_their_folders_only(spark, tmp_path):
    store = Replies(spark, str(tmp_path / "replies"), keep_every=4)
    store.ask(calls(spark, range(0, 4096, 64)), Counted(tmp_path / "calls"))
    few = store.known(calls(spark, [64, 128]))
    assert len(answers(few.withColumn("failure", F.lit(None)))) == 2
    assert len({f.rsplit("/", 2)[1] for f in few.inputFiles()}) <= 2 or "PartitionFilters" in few._jdf.queryExecution().toString()
    assert store.known(calls(spark, [5])).count() == 0
    assert Replies(spark, str(tmp_path / "nothing")).known(calls(spark, [5])).count() == 0


def test_a_task_that_runs_again_asks_only_what_is_missing(tmp_path, monkeypatch):
    import pyarrow as pa

    from tablelore.sources import replies

    class Task:
        attempt = 0

        def partitionId(self):
            return 3

        def attemptNumber(self):
            return self.attempt
    monkeypatch.setattr(replies, "TaskContext", type("Context", (), {"get": staticmethod(Task)}))
    messages = [json.dumps([{"role": "user", "content": str(n)}]) for n in range(12)]
    batch = pa.RecordBatch.from_pydict({"call_id": [f"{n:03x}" * 4 for n in range(12)], "messages": messages})
    first, second = Counted(tmp_path / "first", fails=("2",)), Counted(tmp_path / "second")
    folder = str(tmp_path / "replies")
    replies.AskingWriter(folder, first, "run", 5).write(iter([batch.slice(0, 7)]))
    Task.attempt = 1
    kept = replies.AskingWriter(folder, second, "run", 5).write(iter([batch]))
    assert second.made() == sorted(str(n) for n in (2, *range(7, 12))) and kept.replies == 6


def run_rows(spark, run, n, text):
    return spark.range(n).select(F.lit(run).alias("run"), "id", F.lit(text).alias("text"))


def test_readers_see_one_version_whole(spark, tmp_path):
    store = Versions(spark, str(tmp_path / "store"))
    assert store.snapshot().version == 0 and store.read("a") is None
    first = store.commit(store.snapshot(), {p: store.write(p, run_rows(spark, "r/1", 3, "old"), "run") for p in "ab"})
    reader = [store.read(p, snapshot=first) for p in "ab"]
    half = store.write("a", run_rows(spark, "r/1", 5, "new"), "run")  # written, not yet in force
    assert {r.text for r in store.read("a").collect()} == {"old"}
    store.commit(first, {"a": half, "b": store.write("b", run_rows(spark, "r/1", 5, "new"), "run")})
    assert [f.count() for f in reader] == [3, 3] and [store.read(p).count() for p in "ab"] == [5, 5]
    assert store.read("a", snapshot=store.snapshot(1)).count() == 3
    assert store.clear(keep=1) == 2 and store.read("a").count() == 5


def test_the_second_of_two_writers_is_refused(spark, tmp_path):
    one, two = (Versions(spark, str(tmp_path / "store")) for _ in range(2))
    base, also = one.snapshot(), two.snapshot()
    one.commit(base, {"a": one.write("a", run_rows(spark, "x", 1, "first"), "run")})
    late = two.write("a", run_rows(spark, "y", 1, "second"), "run")
    with pytest.raises(Moved):
        two.commit(also, {"a": late})
    assert [r.text for r in one.read("a").collect()] == ["first"]
    two.commit(two.snapshot(), {"a": late})
    assert sorted(r.text for r in one.read("a").collect()) == ["first", "second"]
    key = spark.range(1).select(key_of(F.lit("x"))).first()[0]
    assert [r.text for r in one.read("a", keys=[key]).collect()] == ["first"]
    two.commit(two.snapshot(), {"a": {key: None}})
    assert [r.text for r in one.read("a").collect()] == ["second"]


def test_one_of_many_writers_at_once_gets_a_number(spark, tmp_path):
    store = Versions(spark, str(tmp_path / "store"))
    base = store.snapshot()

    def commit(k):
        try:
            return store.commit(base, {"a": {f"{k}": f"data/{k}"}}).version
        except Moved:
            return None
    with ThreadPoolExecutor(8) as pool:
        results = list(pool.map(commit, range(16)))
    assert sorted(r or 0 for r in results) == [0] * 15 + [1] and len(store.snapshot().parts["a"]) == 1


def write(messages):
    task = messages[-1]["content"]
    if "Draft the table comment" in task:
        return json.dumps({"proposed_comment": "A table.", "facts": {"grain": "row"}, "tags": []})
    names = task.rsplit("columns: ", 1)[1].rstrip(".").split(", ")
    return json.dumps({"columns": [{"name": n, "proposed_comment": "About " + n, "self_confidence": 1} for n in names]})


def judge(messages):
    score = 0.4 if "About b" in messages[-1]["content"] else 1
    return json.dumps({"subscores": dict.fromkeys(("completeness", "specificity", "grounding", "template_conformance"), score), "issues": []})


def fails(messages):
    raise KeyboardInterrupt


def tables(spark):
    return {"c.s.t": lambda: spark.range(60).select(F.col("id").alias("a"), (F.col("id") % 7).alias("b"))}


def test_a_run_is_saved_as_it_goes(spark, tmp_path, monkeypatch):
    folder, seen = str(tmp_path / "store"), []

    def noted(state, into):
        save(state, into)
        seen.append({r.status for r in saved(spark, into, "sessions").collect()} | {r.status for r in saved(spark, into, "drafts").collect()})
    monkeypatch.setattr(documenting, "save", noted)
    settings = Settings(mode="interactive", store=folder, replies=str(tmp_path / "replies"))
    made = document(spark, tables(spark), Models(write, judge), settings=settings, run="one")
    assert seen[0] == {"reasoning"} and seen[1] == {"reasoning", "draft"} and "awaiting_input" in seen[-1] and len(seen) == 4
    assert {r.target: r.status for r in saved(spark, folder, "drafts").collect()} == {r.target: r.status for r in made.drafts.collect()}
    question = saved(spark, folder, "questions").first()
    told = spark.createDataFrame([(question.session_id, question.qid, "seven kinds")], "session_id string, qid string, answer string")
    resume(made, told, Models(write, judge))
    assert len(seen) == 5


@pytest.fixture(scope="module")
def states(spark):
    return [document(spark, tables(spark), Models(write, judge), settings=Settings(mode="batch"), run=run) for run in ("one", "two")]


def test_two_runs_saved_at_once_both_stay(spark, states, tmp_path, monkeypatch):
    folder = str(tmp_path / "store")
    own, first = Versions.commit, []

    def late(self, base, changes):  # the other writer commits while the first one is writing
        if not first:
            first.append(True)
            save(states[1], folder)
        return own(self, base, changes)
    monkeypatch.setattr(Versions, "commit", late)
    save(states[0], folder)
    assert {r.schema_run_id for r in saved(spark, folder, "sessions").collect()} == {"one", "two"}
    assert saved(spark, folder, "drafts").count() == 6


def test_a_store_that_keeps_moving_refuses(spark, states, tmp_path, monkeypatch):
    monkeypatch.setattr(documenting, "SAVE_TRIES", 2)

    def moved(self, base, changes):
        raise Moved("again")
    monkeypatch.setattr(Versions, "commit", moved)
    with pytest.raises(Moved):
        save(states[0], str(tmp_path / "store"))
    data = tmp_path / "store" / "data"
    assert not data.exists() or not os.listdir(data)
    with pytest.raises(ValueError, match="nothing was saved"):
        saved(spark, str(tmp_path / "store"), "drafts")
