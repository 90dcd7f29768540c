"""The state under several writers, and the outbox."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from tidewire.plans.outbox import Outbox
from tidewire.plans.state import StateStore, new_deliveries
from tidewire.schemas import STATE


def rows(spark, *keys, source="s"):
    return spark.createDataFrame([(source, k, f"https://x.com/{k}", k, 0, i) for i, k in enumerate(keys)],
                                 "source string, item_id string, url string, dedupe_key string, source_ord int, pos long")


def delivered(store):
    return sorted(r["dedupe_key"] for r in store.table("delivered").collect())


class Interrupted(StateStore):
    """A writer during whose writing something else happens, once."""

    def __init__(self, spark, path, meanwhile):
        super().__init__(spark, path)
        self.meanwhile = meanwhile

    def _written(self, tables):
        done = super()._written(tables)
        if self.meanwhile:
            meanwhile, self.meanwhile = self.meanwhile, None
            meanwhile()
        return done


def test_rows_that_depend_on_the_state_are_made_anew(spark, tmp_path):
    other = StateStore(spark, str(tmp_path))
    other.commit("zero", {"delivered": rows(spark, "a")})

    def meanwhile():
        other.commit("two", {"delivered": rows(spark, "b", "c")})
        other.compact()

    store = Interrupted(spark, str(tmp_path), meanwhile)
    calls = []

    def tables(published):
        calls.append(published)
        return {"delivered": new_deliveries(rows(spark, "a", "b", "d"), store.table("delivered", published))}

    number = store.commit("one", tables)
    assert len(calls) == 2 and delivered(store) == ["a", "b", "c", "d"]
    assert store.sequence_of("two") < number == store.sequence_of("one") and store.sequence_of("zero") == 1
    assert other.commit("two", {"delivered": rows(spark, "z")}) == store.sequence_of("two")
    assert delivered(store) == ["a", "b", "c", "d"]


def test_a_run_published_during_a_compaction_is_read(spark, tmp_path):
    other = StateStore(spark, str(tmp_path))
    log = lambda event: spark.createDataFrame([("s", "k", event, 0)], STATE["failure_log"])
    other.commit("one", {"delivered": rows(spark, "a"), "failure_log": log("alerted")})
    other.commit("two", {"delivered": rows(spark, "b")})
    store = Interrupted(
        spark, str(tmp_path), lambda: other.commit("late", {"delivered": rows(spark, "c"), "failure_log": log("cleared")})
    )
    base = store.compact()
    assert base == 4 and delivered(store) == ["a", "b", "c"] and other.active_failures().count() == 0
    assert [a.run_id for a in store.published()][:1] == ["late"]
    store.compact()
    assert delivered(store) == ["a", "b", "c"] and len(store.published()) == 1
    assert [store.sequence_of(r) for r in ("one", "two", "late", "never")] == [1, 2, 3, None]


def test_two_compactions_at_once(spark, tmp_path):
    other = StateStore(spark, str(tmp_path))
    for key in "abc":
        other.commit(key, {"delivered": rows(spark, key)})

    def meanwhile():
        other.commit("d", {"delivered": rows(spark, "d")})
        other.compact()

    Interrupted(spark, str(tmp_path), meanwhile).compact()
    assert delivered(other) == ["a", "b", "c", "d"]
    other.commit("e", {"delivered": rows(spark, "e")})
    other.compact()
    assert delivered(other) == ["a", "b", "c", "d", "e"]


def test_writers_in_threads(spark, tmp_path):
    numbers = []

    def work(name):
        store = StateStore(spark, str(tmp_path))
        numbers.append(store.commit(name, {"delivered": rows(spark, name)}))

    threads = [threading.Thread(target=work, args=(n,)) for n in "abcdef"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(numbers) == [1, 2, 3, 4, 5, 6] and delivered(StateStore(spark, str(tmp_path))) == list("abcdef")


def test_vacuum_removes_only_what_is_not_read(spark, tmp_path):
    class Crash(StateStore):
        def _create(self, name, content):
            raise RuntimeError("lost")

    store = StateStore(spark, str(tmp_path))
    store.commit("one", {"delivered": rows(spark, "a")})
    with pytest.raises(RuntimeError):
        Crash(spark, str(tmp_path)).commit("lost", {"delivered": rows(spark, "x")})
    store.commit("two", {"delivered": rows(spark, "b")})
    assert store.vacuum() == 0
    assert store.vacuum(older_than=-60) == 1  # the lost attempt
    store.compact()
    assert store.vacuum(older_than=-60) == 4  # two attempts and their manifests
    assert delivered(store) == ["a", "b"] and store.sequence_of("one") == 1
    assert store.commit("three", {"delivered": rows(spark, "c")}) == 4 and delivered(store) == ["a", "b", "c"]


def outgoing(spark, n):
    made = [(s * 100 + p, f"s{s}", s, p, "i", "u", f"k{s}-{p}", "t", json.dumps([s, p])) for s in range(3) for p in range(n)]
    return spark.createDataFrame(made[::-1], "order_key long, source string, source_ord int, pos long, item_id string, url string,"
                                 " dedupe_key string, original_title string, payload string").repartition(5)


def log_client(folder, refuse=(), die=()):
    def make():
        def send(payload):
            if payload in die:
                raise SystemExit("killed")
            if payload in refuse:
                raise ValueError("refused")
            with open(f"{folder}/sent", "a") as log:
                log.write(payload + "\n")

        return send

    return make


def sent(folder):
    return [tuple(json.loads(line)) for line in open(f"{folder}/sent")]


def test_messages_are_sent_in_order_and_once(spark, tmp_path):
    box = Outbox(spark, str(tmp_path / "box"), part_rows=4)
    messages = box.put("run", outgoing(spark, 5))
    listed = [(r["number"], r["source_ord"], r["pos"]) for r in messages.orderBy("number").collect()]
    assert listed == [(s * 5 + p, s, p) for s in range(3) for p in range(5)]
    with pytest.raises(Exception, match="killed|terminat|crash|exit"):
        box.sender("run", log_client(tmp_path, die=["[1, 4]"]))(messages)
    before = sent(tmp_path)
    # Parts of four: the first two are acknowledged, the third one was lost after [1, 3].
    assert before == [(s, p) for s in range(3) for p in range(5)][:9]
    again = box.put("run", outgoing(spark, 9))
    assert again.count() == 15  # as they were written before
    accepted = box.sender("run", log_client(tmp_path, refuse=["[2, 2]"]))(again)
    assert sent(tmp_path)[9:] == [p for p in [(s, p) for s in range(3) for p in range(5)][8:] if p != (2, 2)]
    kept = box.acknowledge("run", accepted)
    assert kept.count() == 14 and kept.where(F.col("order_key") == 202).count() == 0
    assert box.acknowledge("run", accepted.limit(0)).count() == 14
    assert box.messages("other").count() == 0
    empty = box.put("empty", outgoing(spark, 1).limit(0))
    assert box.sender("empty", log_client(tmp_path))(empty).count() == 0
