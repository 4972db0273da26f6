import threading
import time

import pytest
from test_store import change, frame, stored

from vesper.sources.store import Store, Superseded
from vesper.streaming.latest import Latest


def slow(spark, path, seconds):
    """Changes whose making takes a while on executors."""

    def run(batches):
        for b in batches:
            for _ in range(seconds * 10):
                time.sleep(0.1)
            yield b

    return frame(spark, change(path)).mapInArrow(run, frame(spark, change(path)).schema)


def test_a_later_request_interrupts_the_earlier(spark, tmp_path):
    store, latest = Store(spark, str(tmp_path / "s"), buckets=1), Latest(spark)
    began = threading.Event()

    def first(request):
        began.set()
        request.commit(store, slow(spark, "/d/first.jpg", 60), 1)

    one = latest.submit(first)
    assert began.wait(30)
    time.sleep(2)
    at = time.monotonic()
    two = latest.submit(lambda request: request.commit(store, frame(spark, change("/d/second.jpg")), 2).count())
    assert two.result(60) == 0
    with pytest.raises(Superseded):
        one.result(60)
    assert time.monotonic() - at < 40 and set(stored(store)) == {("image", "/d/second.jpg")}


def test_a_result_that_comes_too_late_is_refused(spark, tmp_path):
    store, latest = Store(spark, str(tmp_path / "s"), buckets=1), Latest(spark)
    go, done = threading.Event(), threading.Event()

    def first(request):
        write = store._write

        def late(*a):
            out = write(*a)
            if a[2] == "data":
                done.set()
                go.wait(60)
            return out

        store._write = late
        try:
            request.commit(store, frame(spark, change("/d/first.jpg")), 1)
        finally:
            store._write = write

    one = latest.submit(first)
    assert done.wait(60)
    two = latest.submit(lambda request: request.current())
    go.set()
    with pytest.raises(Superseded):
        one.result(60)
    assert two.result(60) is True and store._latest()[0] == 0 and not [n for n in (tmp_path / "s").glob("data-*")]


def test_requests_one_after_another_all_count(spark, tmp_path):
    store, latest = Store(spark, str(tmp_path / "s"), buckets=1), Latest(spark)
    for k in range(2):
        latest.submit(lambda request, k=k: request.commit(store, frame(spark, change(f"/d/{k}.jpg")), k)).result(60)
    assert len(stored(store)) == 2
    failed = latest.submit(lambda request: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        failed.result(10)
    latest.cancel()
    latest.cancel()
