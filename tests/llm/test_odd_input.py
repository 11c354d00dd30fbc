"""Odd input: repeated rows, null ids, clashing column names, long texts, empty tables, ties."""

import collections
import gzip
import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusmill.llm import decontaminate, imatch, jaccard, langid, pieces, quality, sharding, shared, substrings, urlrules, warc
from corpusmill.llm.shared import new_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts):
    """Documents of (doc_id, text)."""
    return spark.createDataFrame([(d, t, "en", "x", len(t or "")) for d, t in texts], SCHEMA)


def components_of(sets):
    """Smallest id reachable by links of a Jaccard of 3/4, by comparing all pairs."""
    near = collections.defaultdict(set)
    for a, x in sets.items():
        for b, y in sets.items():
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                near[a].add(b)
    out = {}
    for a in sorted(sets):
        if a not in out:
            todo = [a]
            while todo:
                b = todo.pop()
                if b not in out:
                    out[b] = a
                    todo += near[b]
    return out


def test_passages_of_long_near_copies():
    """Two texts of 20,000 words with an edit every 1,000: aligned within seconds."""
    own = [f"w{i}" for i in range(20_000)]
    other = [f"e{i}" if i % 1000 == 500 else w for i, w in enumerate(own)]
    runs = [(0, 0, 500), *((k, k, min(999, 20_000 - k)) for k in range(501, 20_000, 1000))]
    t = time.time()
    a, b, _, _, same = substrings.align(own, other, runs)
    assert (a, b) == (0, 20_000) and same == pytest.approx(19_980 / 20_000) and time.time() - t < 3


@pytest.mark.parametrize("name", ["_id", "_spans", "_touched"])
def test_without_repeats_keeps_clashing_columns(spark, name):
    p = " ".join(f"p{i}" for i in range(60))
    docs = frame(spark, [(1, "a b " + p), (2, "c d " + p + " e"), (2, "c d " + p + " e"), (None, p), (3, None), (4, "")]).withColumnRenamed("source", name)
    rows = substrings.without_repeats(docs).collect()
    assert substrings.without_repeats(docs).columns == docs.columns and all(r[name] == "x" for r in rows)
    assert sorted(((r.doc_id or 0, (r.text or "").split()[:3], r.n_chars) for r in rows), key=repr) == sorted(
        [(0, ["p0", "p1", "p2"], len(p)), (1, ["a", "b", "p0"], len(p) + 4), (2, ["c", "d", "e"], 6), (2, ["c", "d", "e"], 6), (3, [], None), (4, [], 0)], key=repr
    )


def test_jaccard_repeated_rows(spark):
    """Rows of equal doc_id are one document: 5 has the texts of 3 and of 4, and an empty one."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(20)) for x in "abc")
    docs = frame(spark, [(5, a), (5, b), (3, b), (4, a), (5, ""), (6, c), (6, c), (7, c + " z"), (None, a), (8, None), (9, "one"), (10, "one")])
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.joined(docs).collect()), key=repr)
    want = [(5, 16, 3), (5, 16, 3), (3, 16, 3), (4, 16, 3), (5, 0, 3), (6, 16, 6), (6, 16, 6), (7, 17, 6), (None, 16, None), (8, 0, 8), (9, 1, 9), (10, 1, 9)]
    assert got == sorted(want, key=repr)


def test_jaccard_hot_class(spark, monkeypatch):
    """A class of exact copies that is looked up by a broadcast, beside classes that are not."""
    monkeypatch.setattr(shared, "hot_size", lambda rows: 20)
    texts = [(d, " ".join(f"h{i}" for i in range(12))) for d in range(50)] + [(100 + d, " ".join(f"c{d % 7}-{i}" for i in range(12))) for d in range(30)] + [(200 + d, "") for d in range(30)]
    got = {r.doc_id: r.component_id for r in jaccard.joined(frame(spark, texts)).collect()}
    assert got == {d: 0 if d < 50 else d if d >= 200 else 100 + d % 100 % 7 for d, _ in texts}


def test_jaccard_bands_of_size(spark):
    """Texts of growing size that share their first words: links between neighbours only, blocks of several sizes."""
    words = [f"w{i}" for i in range(140)]
    texts = [(k, " ".join(words[: 40 + k])) for k in range(0, 100, 3)] + [(500 + k, " ".join(words[:40] + [f"x{k}-{i}" for i in range(k)])) for k in range(12)]
    sets = {d: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for d, t in texts}
    got = {r.doc_id: r.component_id for r in jaccard.joined(frame(spark, texts)).collect()}
    assert got == components_of(sets)


def test_sharding_keeps_any_columns(spark):
    docs = frame(spark, [(d % 9, f"text {d}") for d in range(40)] + [(None, None)]).withColumnRenamed("source", "_arrival")
    back = sharding.sharded(docs, new_path(spark, "test-odd"))
    assert back.columns == docs.columns and sorted(map(repr, back.collect())) == sorted(map(repr, docs.collect()))
    none = sharding.sharded(docs.limit(0), new_path(spark, "test-odd"))
    assert none.collect() == [] and none.columns == docs.columns


def test_sharding_appends_arrivals_one_by_one(spark):
    root = new_path(spark, "test-arrivals")
    sharding.sharded(frame(spark, [(d, "x") for d in range(200)]), root, arrivals=5)
    t = sharding.ShardedTable(spark, root)
    assert [t.manifest(v).count() for v in range(1, 6)] == [1, 2, 3, 4, 5] and t.version() == 6 and t.manifest().count() == 1


def test_sharding_other_errors_are_raised(spark, tmp_path):
    t = sharding.ShardedTable(spark, new_path(spark, "test-errors"))
    t.append(frame(spark, [(1, "x")]))
    fs, path = t._fs()
    fs.mkdirs(path(f"{t.root}/commits/.2.lock"))
    with pytest.raises(FileExistsError):
        t.commit(t.manifest(), 1)


PAGES = "page_id long, url string, html string"


def test_warc_odd_rows(spark):
    big = "x" * 200
    rows = [(1, "u", big), (1, "u", big), (2, None, big), (None, "u", big), (3, "u\r\nA: b", None), (3, "u", ""), (4, "u", "y" * 2_000_000)]
    pages = spark.createDataFrame(rows, PAGES).withColumn("digest", F.lit("z")).withColumn("n", F.lit(1))
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.archived(pages).collect()), key=repr)
    want = [(1, 200, "response", None)] * 2 + [(2, 200, "revisit", 1), (None, 200, "response", None)] + [(3, 0, "response", None)] * 2 + [(4, 2_000_000, "response", None)]
    assert got == sorted(want, key=repr) and warc.archived(pages.limit(0)).collect() == []


def test_warc_ids(spark):
    """A revisit names the record id of its response; records are read by any reader of gzip members."""
    root = new_path(spark, "test-warc")
    index = warc.write(spark.createDataFrame([(1, "http://a/", "x" * 150), (2, "http://b/", "x" * 150)], PAGES), root).collect()
    heads = {}
    for r in index:
        with open(r.file.removeprefix("file:"), "rb") as f:
            f.seek(r.offset)
            head = gzip.decompress(f.read(r.length)).partition(b"\r\n\r\n")[0].decode()
        heads[r.page_id] = dict(x.split(": ", 1) for x in head.split("\r\n")[1:])
    assert heads[2]["WARC-Refers-To"] == heads[1]["WARC-Record-ID"] != heads[2]["WARC-Record-ID"]


def test_warc_hot_payload(spark, monkeypatch):
    monkeypatch.setattr(shared, "hot_size", lambda rows: 10)
    pages = spark.createDataFrame([(d, "u", "h" * 150 if d % 2 else f"{d // 4}" * 150) for d in range(60)], PAGES)
    got = {r.page_id: r.refers_to for r in warc.archived(pages).collect()}
    assert got == {d: (None if d == 1 else 1) if d % 2 else (d // 4 * 4 if d % 4 else None) for d in range(60)}


def test_urls_odd_tables(spark):
    labels = spark.createDataFrame([(1, 0, 1), (1, 1, 0), (None, 0, 0), (2, None, None)], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([(1, "http://a.com/" + "p/" * 20_000, ""), (1, "http://a.com/x", ""), (None, "http://com/en/", ""), (2, None, "")], PAGES).withColumn("t", F.lit(1)).withColumn("host", F.lit("h"))
    got = sorted(((r.page_id, r.host, r.rule) for r in urlrules.judged(pages, labels).collect()), key=repr)
    assert got == sorted([(1, "a.com", None), (1, "a.com", None), (None, "com", "com/en/"), (2, "", None)], key=repr)
    assert urlrules.judged(pages.limit(0), labels).collect() == [] and urlrules.judged(pages, labels.limit(0)).count() == 4


def test_columns_of_clashing_names(spark):
    """Operators that read ids and texts ignore other columns, whatever their names; filters keep them."""
    names = ["row", "n", "ref", "doc", "pos", "words", "bucket", "term", "item", "_id", "_hit_id", "_hot", "hi", "lo", "rep", "gumbel_key"]
    docs = frame(spark, [(1, "the cat sat on the mat and the dog ran"), (2, None), (2, "12 34"), (None, "the cat sat on the mat and the dog ran")])
    docs = docs.withColumns({n: F.lit("x") for n in names})
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(None, "the cat"), (7, "sat on"), (8, None), (9, "")], "item_id long, text string")
    for f in (jaccard.joined, imatch.fingerprints, langid.learn_and_predict, pieces.encoded, lambda d: quality.resampled(d, labels), lambda d: decontaminate.digest(decontaminate.find(d, bench))):
        assert f(docs).count() == 4
    for f in (langid.recognised, substrings.without_repeats, lambda d: decontaminate.without_hits(d, bench.where("item_id = 8")), lambda d: corpus_pipeline.near_duplicates(spark, d, "")):
        assert f(docs).columns == docs.columns and all(r[n] == "x" for r in f(docs).collect() for n in names)
    hits = decontaminate.find(docs, bench).collect()
    assert sorted(((r.doc_id, r.n_hit) for r in hits), key=repr) == [(1, 2), (2, 0), (2, 0), (None, 2)]


def test_resampling_ties_and_empty(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (None, 1, 0), (3, 1, 1)], "doc_id long, quality int, toxic int")
    docs = frame(spark, [(1, "a b"), (1, "a b"), (2, ""), (None, None)])
    rows = quality.resampled(docs, labels).collect()
    assert sum(r.selected for r in rows) == 3 and len({r.gumbel_key for r in rows if r.doc_id == 1}) == 1
    assert quality.resampled(docs.limit(0), labels).collect() == [] and quality.resampled(docs, labels.limit(0)).count() == 4


def test_stages_of_an_empty_table(spark, tmp_path):
    docs = frame(spark, [])
    spark.createDataFrame([(1, "a b")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.collect() == [] and (name == "tokens" or out.columns == docs.columns)
