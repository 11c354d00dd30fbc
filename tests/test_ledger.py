"""Commits under leases: stale tokens, two writers, a crash between tables."""

import pytest

from corpusmill.sources.ledger import Ledger, Refused


def rows(df):
    return sorted(r.x for r in df.collect())


@pytest.fixture
def ledger(spark, tmp_path):
    return Ledger(spark, f"file://{tmp_path}/ledger")


def test_commits_are_seen_at_once_and_by_version(spark, ledger):
    frame = lambda a, b: spark.range(a, b).toDF("x")
    assert ledger.read("scores") is None and ledger.version() == 0
    token = ledger.claim("run", 60)
    first = ledger.commit("run", token, appended={"scores": frame(0, 3), "notes": frame(5, 6)})
    second = ledger.commit("run", token, appended={"scores": frame(3, 5)}, replaced={"notes": frame(7, 9)})
    assert rows(ledger.read("scores")) == [0, 1, 2, 3, 4] and rows(ledger.read("notes")) == [7, 8]
    assert rows(ledger.read("scores", first)) == [0, 1, 2] and rows(ledger.read("notes", first)) == [5] and (first, second) == (2, 3)
    assert ledger.read("other") is None and ledger.read("scores", 1) is None


def test_a_stale_lease_is_refused(spark, ledger):
    old = ledger.claim("run", 60, now=1000.0)
    with pytest.raises(Refused):
        ledger.claim("run", 60, now=1059.0)
    new = ledger.claim("run", 60, now=1061.0)
    assert (old, new) == (1, 2) and ledger.claim("other run", 60) == 1
    with pytest.raises(Refused):
        ledger.commit("run", old, appended={"t": spark.range(3).toDF("x")})
    with pytest.raises(Refused):
        ledger.release("run", old)
    ledger.commit("run", new, appended={"t": spark.range(2).toDF("x")})
    ledger.release("run", new)
    assert rows(ledger.read("t")) == [0, 1] and ledger.claim("run", 60, now=1062.0) == 3


def test_a_writer_overtaken_between_its_check_and_its_entry(spark, ledger, monkeypatch):
    """Its lease expires and is claimed after it was checked: the entry is written for a version that is taken, and is refused."""
    old, put, late = ledger.claim("run", 60, now=1000.0), Ledger._put, []

    def stalled(self, entry, version):
        if entry["kind"] == "commit" and not late:
            late.append(Ledger(spark, self.root).claim("run", 60, now=2000.0))
        return put(self, entry, version)

    monkeypatch.setattr(Ledger, "_put", stalled)
    with pytest.raises(Refused):
        ledger.commit("run", old, appended={"t": spark.range(3).toDF("x")})
    assert late == [2] and ledger.read("t") is None


def test_two_writers_of_two_jobs_both_commit(spark, ledger, monkeypatch):
    """The second finds its version taken by another job's commit, and takes the next."""
    a, b, put, once = ledger.claim("a", 60), ledger.claim("b", 60), Ledger._put, []

    def raced(self, entry, version):
        if entry.get("job") == "a" and not once:
            once.append(Ledger(spark, self.root).commit("b", b, appended={"t": spark.range(10, 12).toDF("x")}))
        return put(self, entry, version)

    monkeypatch.setattr(Ledger, "_put", raced)
    assert ledger.commit("a", a, appended={"t": spark.range(2).toDF("x")}) == 4 and once == [3]
    assert rows(ledger.read("t")) == [0, 1, 10, 11] and rows(ledger.read("t", 3)) == [10, 11]


def test_a_rename_into_another_writers_version_is_no_commit(spark, ledger):
    """As on stores where a rename onto a folder moves into it."""
    fs, path = ledger._fs()
    token = ledger.claim("run", 60)
    exists = fs.exists
    ledger._fs = lambda: (type("Fs", (), {"__getattr__": lambda _, n: getattr(fs, n), "exists": lambda _, p: False if str(p).endswith("/log/1") else exists(p)})(), path)
    assert not ledger._put({"kind": "commit", "job": "run", "token": token, "tables": []}, 1)
    assert [r.kind for r in ledger.entries().collect()] == ["claim"]


def test_a_crash_between_tables_shows_none(spark, ledger):
    token = ledger.claim("run", 60)
    broken = spark.range(3).selectExpr("raise_error('lost') AS x")
    with pytest.raises(Exception, match="lost"):
        ledger.commit("run", token, appended={"scores": spark.range(3).toDF("x"), "notes": broken})
    assert ledger.read("scores") is None and ledger.read("notes") is None
    ledger.commit("run", token, appended={"scores": spark.range(3).toDF("x"), "notes": spark.range(1).toDF("x")})
    assert rows(ledger.read("scores")) == [0, 1, 2] and rows(ledger.read("notes")) == [0]
