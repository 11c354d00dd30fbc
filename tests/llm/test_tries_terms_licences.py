"""The prefix trie, the divergence audit and the licence scan: oracles on odd rows, and their parts against plain programs."""

import random

import duckdb
import numpy as np
import pytest

from corpusmill.llm import divergence, licences, prefixes
from corpusmill.llm.shared import partitions

CONVERSATION = "conv_id long, turn long, role string, text string"
DOCUMENT = "doc_id long, text string, lang string, source string, Words string"


def same(got, name, rows, kind, sql):
    con = duckdb.connect()
    names = [c.split()[0] for c in kind.split(", ")]
    types = {"long": "BIGINT", "string": "VARCHAR"}
    con.execute(f"CREATE TABLE {name} ({', '.join(f'{c.split()[0]} {types[c.split()[1]]}' for c in kind.split(', '))})")
    if rows:
        con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(names))})", rows)
    want = con.execute(sql)
    columns = [c[0] for c in want.description]
    assert sorted(map(repr, want.fetchall())) == sorted(repr(tuple(r)) for r in got.select(columns).collect())


def test_findclose_and_range_minimum():
    rng = random.Random(3)
    for n in (1, 5, 63, 64, 65, 1000, 5000):
        bits, depth = [], 0
        while len(bits) < 2 * n - depth:
            up = depth == 0 or rng.random() < (0.5 if n < 1000 else 0.52)
            bits.append(int(up))
            depth += 1 if up else -1
        bits += [0] * depth
        want, stack = {}, []
        for i, b in enumerate(bits):
            if b:
                stack.append(i)
            else:
                want[stack.pop()] = i
        for block in (4, 64):
            opens = np.flatnonzero(bits)
            assert prefixes.Parentheses(np.array(bits), block).findclose(opens).tolist() == [want[i] for i in opens]
    values = np.array([rng.randrange(100) for _ in range(300)])
    first = np.array([rng.randrange(300) for _ in range(500)])
    end = np.array([rng.randrange(a + 1, 301) for a in first])
    assert prefixes.range_minimum(values, first, end).tolist() == [min(values[a:b]) for a, b in zip(first, end, strict=True)]


def test_common_beginnings():
    d = [bytes([i]) * 16 for i in range(5)]
    for a in ([], d[:1], d[:3], d):
        for b in ([], d[:2], d[1:], d[:3] + d[:1]):
            want = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert prefixes.common(b"".join(a), b"".join(b)) == want


@pytest.mark.parametrize("shards", [1, 3, 40])
def test_trie_of_odd_conversations(spark, shards):
    rng = random.Random(shards)
    rows = [(None, 1, "user", "left out"), (7, None, None, None), (7, None, None, None), (7, -1, "user", "a b"), (-3, 0, "u", "x"), (40, 0, "", ""), (60, 0, None, "")]
    for c in [*range(0, 90), *range(1000, 1150), 2**40]:
        n = rng.choice((1, 1, 2, 3, 6))
        rows += [(c, k, rng.choice(("user", None)) if k > 2 else "user", rng.choice(("hello there", "how  are\tyou", None, "")) if c < 1000 else f"the same {k}") for k in range(n)]
    rows += [(2000, k, "user", "on and on") for k in range(700)] + [(2020, k, "user", "on and on") for k in range(650)]
    before = partitions(spark)
    spark.conf.set("spark.sql.shuffle.partitions", shards)
    try:
        got = prefixes.shared_prefixes(spark.createDataFrame(rows, CONVERSATION)).cache()
        same(got, "conversations", rows, CONVERSATION, prefixes.ORACLE)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_trie_of_nothing(spark):
    assert prefixes.shared_prefixes(spark.createDataFrame([], CONVERSATION)).collect() == []
    assert prefixes.shared_prefixes(spark.createDataFrame([(None, 1, "user", "x")], CONVERSATION)).collect() == []


def documents():
    rng = random.Random(1)
    words = ["the", "The", "été", "ÉTÉ", "a1b2", "x-y", *[f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80)]]
    rows = [(None, None, None, None, "x"), (1, "", "en", "s", None), (2, None, None, "s", None), (3, "lone", "xx", "only", None), (3, "lone", "xx", "only", None)]
    for i in range(400):
        lang, source = rng.choice((("en", "a"), ("en", "a"), ("en", "b"), ("en", None), ("de", "a"), ("de", "b"), (None, "z"), (None, "y")))
        rows.append((i % 300, " ".join(rng.choices(words, k=rng.choice((0, 3, 30)))), lang, source, "clash"))
    return rows


@pytest.mark.parametrize("bits", [64, 5, 0])
def test_audit_of_odd_documents(spark, bits):
    """With digests of few bits or none all terms collide, and are split by their strings."""
    rows = documents()
    same(divergence.audit(spark.createDataFrame(rows, DOCUMENT), bits=bits), "documents", rows, DOCUMENT, divergence.ORACLE)


def test_audit_without_kept_terms(spark):
    rows = [(1, "one two", "en", "a", None), (2, "one three", "en", "b", None)]
    assert sorted(map(tuple, divergence.audit(spark.createDataFrame(rows, DOCUMENT)).collect())) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
    assert divergence.audit(spark.createDataFrame([], DOCUMENT)).collect() == []


def test_shares_are_exact(spark):
    n, total, terms = 9_000_000_000_000_001, 9_000_000_000_000_007, 1_000_000
    got = spark.sql(f"SELECT {n} AS n, {total} AS t, {terms} AS v").select(divergence._share("n", "t", "v").alias("p")).first()[0]
    assert got == 1 + 10**9 * (n + 5) // (total + 5 * terms)


def test_filter_has_no_false_negatives(spark):
    cells = divergence.bloom(spark.range(5000).selectExpr("xxhash64(id) AS digest"))
    known = np.array([r[0] for r in spark.range(5000).selectExpr("xxhash64(id)").collect()]).view(np.uint64)
    assert divergence._among(cells, known).all()
    assert divergence._among(cells, known + np.uint64(12345)).mean() < 0.01


def test_scan_of_odd_documents(spark):
    mit = next(text for label, text, keys in licences.NOTICES if "deal in the software without restriction" in keys)
    rows = [
        (None, None, None, None, "x"), (1, "", None, None, None), (2, "GNU General Public License", None, None, None), (2, "gnu general public", None, None, None),
        (3, "cc by cc by-nc CC by", None, None, None), (4, mit, None, None, None), (5, "x " * 30 + mit.replace("charge", "money") + " mit license", None, None, None),
        (6, mit.replace("any person obtaining a copy", "some people who have two copies") + " Apache   License,\nversion 2.0", None, None, None),
        (7, "the mit lıcense K mitK license éapache license apache licenseé", None, None, None), (8, "public license gnu general public", None, None, None),
        (9, ("a gnu b apache license " * 4000) + "MIT LICENSE", None, None, None), (10, "permission is hereby granted free of charge", None, None, None),
        (11, " ".join(text for _, text, _ in licences.NOTICES), None, None, None), (12, "," * 50 + "by nc cc by nc" + "." * 50, None, None, None),
    ]
    got = licences.report(licences.scan(spark.createDataFrame(rows, DOCUMENT)))
    same(got, "documents", rows, DOCUMENT, licences.oracle())
    by_id = {r.doc_id: r for r in got.where("doc_id > 3").collect()}
    assert by_id[4].labels == "mit" and by_id[4].score == 1.0 and by_id[4].n_base == 0
    assert by_id[9].n_base == 4001 and by_id[9].first_word == 3 and by_id[9].base_labels == "apache,mit"
    assert set(by_id[11].labels.split(",")) == {label for label, _, _ in licences.NOTICES} | {"apache", "cc-by"}
    assert licences.scan(spark.createDataFrame([], DOCUMENT)).collect() == []


def test_template_without_its_key():
    with pytest.raises(ValueError, match="lacks its key phrase"):
        licences.templates((("x", "some words", ("other words",)),))
