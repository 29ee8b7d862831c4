"""The stored catalog: what a run that stops between its two steps leaves, older versions, runs that meet."""

import pytest

from ragloom.sources import store

ROWS = "url string, doc_id string, sha256 string, collected_on string, manual_verdict string, note string, license string"


def catalog(spark, *rows):
    return spark.createDataFrame(list(rows), ROWS)


def incoming(spark, *rows):
    return spark.createDataFrame(list(rows), "url string, sha256 string, collected_on string, license string")


def held(df):
    return {r.url: (r.sha256, r.collected_on, r.manual_verdict, r.status) for r in df.collect()}


def test_runs_keep_what_was_there(spark, tmp_path):
    path, none = str(tmp_path / "catalog"), catalog(spark)
    assert store.current(spark, path) is None and store.versions(spark, path) == []
    with pytest.raises(FileNotFoundError):
        store.read(spark, path)
    first = store.run(spark, path, incoming(spark, ("u1", "h1", "d1", "l"), ("u2", None, "d1", "l")), catalog(spark, ("u0", "x-1", "h0", "d0", "use", "", "l")))
    assert held(store.read(spark, path)) == {"u0": ("h0", "d0", "use", "kept"), "u1": ("h1", "d1", "", "new"), "u2": (None, "d1", "", "new")}
    second = store.run(spark, path, incoming(spark, ("u1", "h2", "d2", "l"), ("u2", None, "d2", "l")), none)
    assert held(store.read(spark, path)) == {"u0": ("h0", "d0", "use", "kept"), "u1": ("h2", "d2", "", "updated"), "u2": (None, "d2", "", "unchanged")}
    assert held(store.read(spark, path, first))["u1"][0] == "h1" and store.versions(spark, path) == [first, second]
    store.switch(spark, path, first, second)
    assert store.current(spark, path) == first
    assert store.forget(spark, path, 1) == [] and store.forget(spark, path, 0) == [second]


def test_a_run_that_stops_between_its_steps_loses_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "catalog")
    first = store.run(spark, path, incoming(spark, ("u1", "h1", "d1", "l")), catalog(spark))
    before = held(store.read(spark, path))

    def stop(*_):
        raise OSError("the machine went away")

    with monkeypatch.context() as broken:
        broken.setattr(store, "switch", stop)
        with pytest.raises(OSError):
            store.run(spark, path, incoming(spark, ("u1", "h9", "d9", "l")), catalog(spark))
    assert store.current(spark, path) == first and held(store.read(spark, path)) == before
    # a table that is half written is no version
    (tmp_path / "catalog" / "versions" / "00000009-half").mkdir()
    assert len(store.versions(spark, path)) == 2
    with pytest.raises(FileNotFoundError):
        store.switch(spark, path, "00000009-half", first)
    assert held(store.read(spark, store.current(spark, path) and path)) == before


def test_of_two_runs_that_meet_the_second_fails(spark, tmp_path):
    path = str(tmp_path / "catalog")
    first = store.run(spark, path, incoming(spark, ("u1", "h1", "d1", "l")), catalog(spark))
    aside = store.prepare(store.read(spark, path), path)
    second = store.run(spark, path, incoming(spark, ("u2", "h2", "d2", "l")), catalog(spark))
    with pytest.raises(store.VersionMoved):
        store.switch(spark, path, aside, first)
    assert store.current(spark, path) == second
    assert not [f for f in (tmp_path / "catalog").iterdir() if f.name.startswith(".CURRENT-") and not f.name.endswith(".crc")]
