"""Operators against brute force on sf0.001, and on nulls, empty, repeated and long rows."""

import collections
import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from corpusmill.llm import decontaminate, imatch, jaccard, langid, pieces, quality, sharding, substrings, urlrules, warc
from corpusmill.llm.shared import components, new_path

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SPACED = re.compile("[^\x20\x09-\x0d]+")
LETTERS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


@pytest.fixture(scope="module")
def docs(spark):
    own = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    long = " ".join(f"w{i % 977}" for i in range(20000))
    odd = [
        (9001, None, None, "x", 0), (9002, "", "en", None, 0), (9003, "  \n\t ", "en", "x", 5), (9004, "One two", None, "x", 7), (9005, "one TWO", "en", "x", 7),
        (9006, long, "en", "x", len(long)), (9007, long + " end", "en", "x", len(long) + 4), (9008, "12 34 !!", "en", "x", 8), (9009, "a▁b  naïve ☃ 漢字", "en", "x", 15),
    ]
    return own.unionByName(spark.createDataFrame(odd, SCHEMA)).cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def components_of(sets):
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    lists = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            lists[x].append(i)
    common = collections.Counter((b, a) for v in lists.values() for k, a in enumerate(v) for b in v[:k])
    for (a, b), n in common.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def test_jaccard(docs, texts):
    sets = {}
    for i, t in texts.items():
        w = SPACED.findall(t.translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    comp = components_of(sets)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.joined(docs).collect()} == {i: (len(s), comp[i]) for i, s in sets.items()}


def test_jaccard_open_lists(spark):
    """Variants of one text that differ from most others: lists with members of several components."""
    base = [f"t{i}" for i in range(60)]
    rows = []
    for d in range(80):
        w = list(base)
        for q in range(d % 5):
            w[(d * 7 + q * 11) % 60] = f"e{d}-{q}"
        rows.append((d, " ".join(w), None, None, 0))
    sets = {d: {tuple(t.split()[k : k + 5]) for k in range(56)} for d, t, *_ in rows}
    got = jaccard.joined(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id: r.component_id for r in got} == components_of(sets)


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (9, 8), (8, 8), (2, 3), (7, 9)], "a long, b long")
    assert {tuple(r) for r in components(edges).collect()} == {(2, 2), (3, 2), (4, 2), (5, 2), (7, 7), (8, 7), (9, 7)}
    assert components(edges.limit(0)).count() == 0


def test_decontamination(spark, docs, texts):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()} | {900: "one two", 901: "", 902: None}
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    wins = {}
    for item, t in items.items():
        w = LETTERS.findall((t or "").translate(LOWER))
        for k in range(max(1, len(w) - 9)) if w else []:
            wins.setdefault(tuple(w[k : k + 10]), set()).add(str(item))
    want = {}
    for d, t in texts.items():
        w, hit, of = LETTERS.findall(t.translate(LOWER)), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in wins:
                    hit.update(range(k, k + n))
                    of |= wins[x]
        want[d] = (len(w), len(hit), len(of), hashlib.sha256(",".join(sorted(of)).encode()).hexdigest(), bool(hit))
    for limit in (decontaminate.MAX_CHARS, 20_000):
        got = decontaminate.digest(decontaminate.find(docs, bench, max_chars=limit)).collect()
        assert {r.doc_id: tuple(r)[1:] for r in got} == want
    assert any(x[4] for x in want.values())
    for r in decontaminate.find(docs, bench).where("n_hit > 0").collect():
        assert all(LETTERS.findall(texts[r.doc_id][s.start : s.end].translate(LOWER)) for s in r.spans)


def test_pieces(docs, texts):
    got = {r.doc_id: r for r in pieces.encode_decode(docs).collect()}
    assert all(got[d].decoded == t.replace("▁", " ") for d, t in texts.items())
    sentencepiece = pytest.importorskip("sentencepiece")
    raw = open(pieces.MODEL, "rb").read()
    out = b""
    for number, value in pieces._fields(raw):  # the same pieces, of kind unigram
        value += bytes([24, 1]) if number == 2 else b""
        size, n = b"", len(value)
        while n > 127:
            size, n = size + bytes([n & 127 | 128]), n >> 7
        out += bytes([number << 3 | 2]) + size + bytes([n]) + value
    library = sentencepiece.SentencePieceProcessor(model_proto=out)
    # The library adds scores in 32 bits: its paths are never better, and a plain dynamic program finds ours.
    model = pieces.Model(pieces.read_pieces(raw))
    encoder = pieces.Encoder(model)
    runs = [" ".join(w[k : k + 40]) for t in texts.values() for w in [t.split()] for k in range(0, min(len(w), 400), 40)]
    ids, bounds = encoder.encode(runs)
    score = lambda x: sum(model.pieces[y][1] for y in x)
    known = {p: s for p, s, kind in model.pieces if kind == 1}
    checked = 0
    for run, a, b in zip(runs, bounds[:-1], bounds[1:], strict=True):
        own = ids[a:b].tolist()
        if any(3 <= y < 259 for y in own):
            continue
        text = "▁" + run.replace(" ", "▁")
        best = [0.0] + [float("-inf")] * len(text)
        for i in range(len(text)):
            for j in range(i + 1, min(len(text), i + 16) + 1):
                if text[i:j] in known:
                    best[j] = max(best[j], best[i] + known[text[i:j]])
        assert score(own) == best[-1] >= score(library.encode(run))
        checked += 1
    assert checked > 100


def test_language(docs, texts):
    rows = {r.doc_id: r for r in langid.learn_and_predict(docs).collect()}
    assert len(rows) == len(texts) and all(rows[d].lang_pred == "und" and rows[d].score == 0 for d in (9001, 9002, 9003, 9008))
    truth = {r.doc_id: r.lang for r in docs.where("doc_id < 9000").collect()}
    held = [d for d in truth if rows[d].held_out]
    assert sum(rows[d].lang_pred == truth[d] for d in held) >= 0.95 * len(held)
    assert {r.doc_id for r in langid.recognised(docs).collect()} == {d for d in texts if rows[d].lang_pred != "und"}


def test_imatch(docs, texts):
    got = {r.doc_id: r for r in imatch.fingerprints(docs).collect()}
    order = sorted(texts)
    assert sorted(got) == order
    by_text = {}
    for d, after in zip(order, order[1:] + order[:1], strict=True):
        t, n = texts[d], len(texts[d]) // 4
        edited = t[: len(t) - n] + texts[after][:n]
        assert got[d].n_chars == len(t) and got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert by_text.setdefault(t, got[d].fingerprint) == got[d].fingerprint
        assert 0 <= got[d].near_edited <= 1 and (edited != t or got[d].near_edited == 1)
        assert got[d].near_next == imatch.likeness(got[d].fingerprint, got[after].fingerprint)
    mean = lambda c: sum(r[c] for r in got.values()) / len(got)
    assert mean("near_edited") > mean("near_next") + 0.1


def test_passages(docs, texts):
    seen, want = {}, set()
    for d in sorted(texts):
        w = SPACED.findall(texts[d].translate(LOWER))
        want |= {d for k in range(len(w) - 54) if seen.setdefault(tuple(w[k : k + 55]), d) != d}
    found = substrings.passages(docs).collect()
    assert want <= {r.doc_id for r in found}
    for r in found:
        own, other = (SPACED.findall(texts[x].translate(LOWER))[a:b] for x, a, b in ((r.doc_id, r.start_word, r.end_word), (r.ref_doc_id, r.ref_start, r.ref_end)))
        assert r.ref_doc_id < r.doc_id and len(own) >= substrings.MIN_WORDS and 4 * sum((collections.Counter(own) & collections.Counter(other)).values()) >= 3 * len(own)
    kept = {r.doc_id: r for r in substrings.without_repeats(docs).collect()}
    assert set(texts) - set(kept) <= want | {r.doc_id for r in found}
    assert all(kept[d].text == t for d, t in texts.items() if d not in {r.doc_id for r in found} and t)
    assert all(r.n_chars == len(r.text) for r in kept.values() if r.text is not None)


def spans_of(spark, texts):
    """Spans of the passages found, by document and reference."""
    out = collections.defaultdict(list)
    for r in substrings.passages(spark.createDataFrame([(d, t, None, None, 0) for d, t in texts.items()], SCHEMA)).collect():
        out[r.doc_id, r.ref_doc_id].append((r.start_word, r.end_word))
    return out


def fresh(name, n):
    return [f"{name}{i}" for i in range(n)]


def plain_best(found):
    """Best chain score by trying every predecessor within the gap."""
    found, score = sorted(map(tuple, found)), []
    for d, r, n in found:
        best = n
        for (e, q, m), s in zip(found, score, strict=False):
            if e < d and q < r and max(d - e - m, r - q - m) <= substrings.MAX_GAP:
                best = max(best, n + s - substrings.GAP_COST * (d - e - m + r - q - m))
        score.append(best)
    return max(score)


def test_passages_long_run_far_before(spark):
    first, second = fresh("p", 300), fresh("q", 80)
    edited = [x for k in range(0, 80, 20) for x in (*second[k : k + 20], f"e{k}", f"f{k}")]
    got = spans_of(spark, {1: " ".join(first + fresh("a", 30) + second), 2: " ".join(first + fresh("c", 100) + edited)})
    assert any(a <= 400 and b >= 486 for a, b in got[2, 1])


def covers(spans, a, b):
    return any(x <= a and y >= b for x, y in spans)


def test_passages_halves_in_older_documents(spark):
    p = fresh("p", 80)
    rows = {1: p[:40] + fresh("a", 30), 2: fresh("d", 30) + p[40:], 3: fresh("b", 20) + p, 4: fresh("c", 25) + p + fresh("z", 9)}
    got = spans_of(spark, {d: " ".join(w) for d, w in rows.items()})
    assert covers(got[4, 3], 25, 105)


def test_passages_of_common_lines(spark):
    """Two documents share ten lines of five words; each pair of neighbours is in an older document too."""
    lines = [fresh(f"l{i}-", 5) for i in range(11)]
    rows = {d + 1: fresh(f"o{d}-", 9) + lines[d] + lines[d + 1] + fresh(f"u{d}-", 9) for d in range(10)}
    rows |= {20: fresh("b", 20) + sum(lines, []), 21: fresh("c", 25) + sum(lines, [])}
    got = spans_of(spark, {d: " ".join(w) for d, w in rows.items()})
    assert covers(got[21, 20], 25, 80)


def test_passages_twice_in_a_document(spark):
    p = fresh("p", 60)
    rows = {1: fresh("a", 7) + p, 2: fresh("x", 30) + p + fresh("y", 100) + p + fresh("z", 5)}
    got = spans_of(spark, {d: " ".join(w) for d, w in rows.items()})
    assert covers(got[2, 1], 30, 90) and covers(got[2, 1], 190, 250)


def test_passages_edited(spark):
    """60 words with every sixth replaced."""
    rows = {}
    for d in range(40):
        p = fresh(f"p{d}-", 60)
        rows[d] = " ".join(p)
        rows[100 + d] = " ".join(fresh(f"x{d}-", 20) + [f"e{d}-{k}" if k % 6 == 3 else w for k, w in enumerate(p)] + fresh(f"y{d}-", 20))
    got = spans_of(spark, rows)
    assert all(any(b - a >= 50 for a, b in got[100 + d, d]) for d in range(40))


def edited(words, at, name):
    return [f"{name}{k}" if k in at else w for k, w in enumerate(words)]


@pytest.mark.parametrize("step", [4, 5, 6])
def test_passages_edited_at_a_step(spark, step):
    """Every fourth word is another one: 75 % match, in runs of three."""
    rows = {}
    for d in range(40):
        p = fresh(f"p{d}-", 61)
        rows[d] = " ".join(p)
        rows[100 + d] = " ".join(fresh(f"x{d}-", 20) + edited(p, range(1, 60, step), f"e{d}-") + fresh(f"y{d}-", 20))
    got = spans_of(spark, rows)
    assert sum(any(b - a >= 50 for a, b in got[100 + d, d]) for d in range(40)) >= (38 if step == 4 else 40)


@pytest.mark.parametrize("share", [0.95, 0.9, 0.85, 0.8, 0.77])
def test_passages_edited_at_random(spark, share):
    rng, rows, size = random.Random(round(share * 100)), {}, 60
    for d in range(100):
        p = fresh(f"p{d}-", size)
        rows[d] = " ".join(fresh(f"v{d}-", 9) + p)
        at = rng.sample(range(1, size - 1), size - math.ceil(share * size))
        rows[1000 + d] = " ".join(fresh(f"x{d}-", 20) + edited(p, at, f"e{d}-") + fresh(f"y{d}-", 20))
    got = spans_of(spark, rows)
    assert sum(any(b - a >= 50 for a, b in got[1000 + d, d]) for d in range(100)) >= 99


@pytest.mark.parametrize("older", [1, 12])
def test_passages_of_lines_that_older_documents_have(spark, older):
    """Two documents share 60 words of which six are replaced; so many older ones have each of the equal lines."""
    p = fresh("p", 60)
    rows = {100: fresh("a", 20) + p, 101: fresh("b", 25) + edited(p, range(9, 60, 10), "e") + fresh("z", 9)}
    rows |= {older * k + d: fresh(f"o{k}-{d}-", 9) + p[10 * k : 10 * k + 9] + fresh(f"u{k}-{d}-", 9) for k in range(6) for d in range(older)}
    got = spans_of(spark, {d: " ".join(w) for d, w in rows.items()})
    assert covers(got[101, 100], 25, 84)


def test_passages_between_later_holders(spark):
    """Twelve older documents have four lines of a passage, twelve others the next four: two later ones share all eight."""
    lines = [fresh(f"l{i}-", 7) for i in range(8)]
    apart = lambda name, some: [w for i, x in enumerate(some) for w in (*x, f"{name}-{i}")]
    rows = {d: fresh(f"a{d}-", 9) + apart(f"g{d}", lines[:4] if d < 12 else lines[4:]) + fresh(f"b{d}-", 9) for d in range(24)}
    rows |= {d: fresh(f"a{d}-", 20) + apart(f"g{d}", lines) for d in (30, 31)}
    got = spans_of(spark, {d: " ".join(w) for d, w in rows.items()})
    assert covers(got[31, 30], 20, 83)


def test_passages_with_a_stray_line_after(spark):
    """A passage whose chain goes on, over a gap, to a short line."""
    p, line = fresh("p", 52), fresh("l", 6)
    rows = {1: fresh("a", 9) + p + fresh("b", 38) + line, 2: fresh("c", 9) + edited(p, range(5, 50, 10), "e") + fresh("d", 38) + line}
    got = spans_of(spark, {d: " ".join(w) for d, w in rows.items()})
    assert covers(got[2, 1], 9, 61)


def test_passages_of_one_word(spark):
    """A word said again and again is covered whole, by few passages."""
    rows = {1: fresh("a", 9) + ["x"] * 300, 2: fresh("b", 9) + ["x"] * 400 + fresh("c", 9)}
    got = spans_of(spark, {d: " ".join(w) for d, w in rows.items()})
    assert {k for a, b in got[2, 1] for k in range(a, b)} == set(range(9, 409)) and len(got[2, 1]) < 40


def test_chains_against_plain():
    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(50):
        d = np.sort(rng.choice(400, 40, replace=False))
        found = np.column_stack([d, np.where(rng.random(40) < 0.7, d + rng.integers(-6, 6, 40), rng.integers(0, 400, 40)), rng.integers(5, 30, 40)])
        score = lambda c: c[:, 2].sum() - substrings.GAP_COST * (np.diff(c[:, :2], axis=0).sum() - 2 * c[:-1, 2].sum())
        own = substrings.chains(found)
        assert sum(map(len, own)) == 40 and abs(score(own[0]) - plain_best(found.tolist())) < 1e-6


def test_resampling(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality.resampled(docs, labels).collect()
    n = docs.count()
    chosen = [r for r in rows if r.selected]
    assert len(rows) == n and len(chosen) == -int(-quality.KEEP * n // 1)
    assert min(r.gumbel_key for r in chosen) >= max(r.gumbel_key for r in rows if not r.selected)


def test_urls(spark):
    urls = [None, "nothing", "http://A.Example.com/en/7x?q", "https://com/en/", "http://xcom/en/1", "ftp://a.net/de/1", "http://b.example.net/de/8#t", "http://x.org/es/y", "http://h.org/de/1"]
    pages = spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r.page_id: tuple(r)[1:] for r in urlrules.judged(pages, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()}
    assert got[0] == got[1] == ("", "", None, "allow")
    assert got[2] == ("a.example.com", "/en/7x", "example.com/en/7", "allow") and got[3][2:] == ("com/en/", "block") and got[4][2:] == (None, "allow")
    assert got[5][2:] == ("net/de/", "allow") and got[6][2:] == ("example.net/de/8", "block") and got[7][2:] == ("org/es/", "block") and got[8][2:] == (None, "allow")
    many = spark.createDataFrame([(i, f"http://{'bad' if i % 2 else 'good'}.com/p", "") for i in range(40)], "page_id long, url string, html string")
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    assert {(r.page_id % 2, r.verdict) for r in urlrules.judged(many, labels).collect()} == {(1, "block"), (0, "allow")}


def test_warc(spark):
    big = "é" * 60
    rows = [(1, "http://a/", None), (2, None, ""), (3, "http://b/", big), (4, "http://c/\r\nX: 1", big), (5, "http://d/", "x" * 99), (6, "http://e/", "x" * 99)]
    got = {r.page_id: r for r in warc.archived(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {p: (r.payload_bytes, r.record_type, r.refers_to) for p, r in got.items()} == {1: (0, "response", None), 2: (0, "response", None), 3: (120, "response", None), 4: (120, "revisit", 3), 5: (99, "response", None), 6: (99, "response", None)}
    assert all(got[p].payload_digest == hashlib.sha256((h or "").encode()).hexdigest() for p, _, h in rows)


def test_sharding(spark, docs):
    root = new_path(spark, "test-shards")
    t = sharding.ShardedTable(spark, root, target=1 << 20)
    for i in range(5):
        t.append(docs.where(F.pmod("doc_id", F.lit(5)) == i).coalesce(1))
    before = t.manifest().count()
    v = t.version()
    t.compact()
    assert t.manifest().count() < before and t.version() > v and t.read(v).count() == docs.count()
    assert sorted(map(repr, t.read().collect())) == sorted(map(repr, docs.collect()))
    with pytest.raises(FileExistsError):
        t.commit(t.manifest(), t.version() - 1)


def test_sharding_near_the_target(spark, docs, monkeypatch):
    """Four shards of 0.9 of the target: merges end, and no pass makes as many files of the same tier again."""
    root = new_path(spark, "test-near")
    t = sharding.ShardedTable(spark, root)
    for _ in range(4):
        t.append(docs.coalesce(1))
    t.target = int(t.manifest().agg(F.max("bytes")).first()[0] / 0.9)
    one = sharding.ShardedTable(spark, new_path(spark, "test-near"), t.target)
    for _ in range(4):
        one.append(docs.coalesce(1))
    calls, commit = [], one.commit
    monkeypatch.setattr(one, "commit", lambda rows, parent: calls.append(parent) or (commit(rows, parent) if len(calls) < 4 else pytest.fail("compacts without end")))
    one.compact()
    assert one.read().count() == 4 * docs.count()


def test_sharding_taken_versions(spark, docs, monkeypatch):
    t = sharding.ShardedTable(spark, new_path(spark, "test-taken"))
    few = docs.limit(5).coalesce(1)
    t.append(few)
    other, commit, taken = sharding.ShardedTable(spark, t.root), t.commit, []

    def late(rows, parent):
        if not taken:
            taken.append(other.append(few))
        return commit(rows, parent)

    monkeypatch.setattr(t, "commit", late)
    t.append(few)
    assert taken and t.read().count() == 15
    fs, path = t._fs()
    monkeypatch.setattr(sharding, "LOCK_SECONDS", 1)
    fs.create(path(f"{t.root}/commits/.{other.version() + 1}.lock"), False).close()
    other.append(few)
    assert other.read().count() == 20


def test_imatch_null_ids(spark):
    for ids in ([None], [None, None], [None, 4, 5], [None, None, 4]):
        rows = [(d, f"some words of text {k} " * 5, None, None, 0) for k, d in enumerate(ids)]
        got = imatch.fingerprints(spark.createDataFrame(rows, SCHEMA)).collect()
        assert sorted(map(repr, (r.doc_id for r in got))) == sorted(map(repr, ids))


def test_empty_tables(spark, empty):
    for f in (jaccard.joined, imatch.fingerprints, langid.learn_and_predict, pieces.encode_decode, substrings.passages, substrings.without_repeats, langid.recognised):
        assert f(empty).collect() == []
    assert decontaminate.find(empty, spark.createDataFrame([], "item_id long, text string")).collect() == []


def test_a_stalled_writer_does_not_lose_its_rows(spark, tmp_path):
    """A writer that another one overtakes between its lock and its rename commits nothing, and appends to the next version."""
    root = f"file://{tmp_path}/shards"

    class Stalled(sharding.ShardedTable):
        def _publish(self, name, version):
            if not hasattr(self, "late"):
                self.late = True
                fs, path = self._fs()
                fs.delete(path(f"{self.root}/commits/.{version}.lock"), False)  # it has expired
                sharding.ShardedTable(spark, root).append(spark.range(100, 103).toDF("x"))
            super()._publish(name, version)

    assert sharding.ShardedTable(spark, root).append(spark.range(5).toDF("x")) == 1
    assert Stalled(spark, root).append(spark.range(50, 54).toDF("x")) == 3
    table = sharding.ShardedTable(spark, root)
    assert table.version() == 3 and sorted(r.x for r in table.read().collect()) == [0, 1, 2, 3, 4, 50, 51, 52, 53, 100, 101, 102]
    assert table.read(2).count() == 8


def test_null_urls_are_allowed_whatever_is_mined(spark):
    """Bad urls without a host make no rule that null urls meet."""
    pages = [(i, "no host here" if i % 2 else f"http://h{i}.org/x", "") for i in range(100)] + [(200, None, ""), (201, "", ""), (202, "http:///", "")]
    labels = [(i, 0 if i % 2 else 1, i % 2) for i in range(100)]
    got = urlrules.judged(spark.createDataFrame(pages, "page_id long, url string, html string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert {r.page_id: r.verdict for r in got.where("page_id >= 200").collect()} == {200: "allow", 201: "allow", 202: "allow"}


def test_long_runs_of_one_word_make_no_rows_of_seeds(spark):
    """Documents that say one word again and again: each run is a passage of the first document that has one as long, once a place."""
    rows = [(x, " ".join(f"w{x}x{y}" for y in range(30)) + " again" * (60 + 40 * x)) for x in range(14)]
    found = substrings.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for x, text in rows[1:]:
        own = [r for r in found if r["doc_id"] == x]
        covered = {w for r in own for w in range(r["start_word"], r["end_word"])}
        assert covered >= set(range(30, len(text.split()))), x
    assert len(found) < 350  # a few of every 32 words, not one for each row of two, three and more seeds


def test_anchors_of_a_task_are_packed_across_buckets_of_seeds():
    import pyarrow as pa

    text = " ".join(f"word{y}" for y in range(400))
    batch = pa.RecordBatch.from_arrays([pa.array(range(6), pa.int64()), pa.array([text] * 6)], names=["doc_id", "text"])
    seeds = pa.Table.from_batches(substrings._seeds(64)(iter([batch]))).sort_by("bucket")
    assert seeds.num_rows > 40
    anchors = pa.Table.from_batches(substrings._anchors(64, 50)(iter(seeds.to_batches())))
    assert anchors.num_rows <= 6  # at most one row for each bucket of documents, not one for each pair of buckets


def test_chains_that_cannot_be_passages_are_left_out_by_half_words():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(5)
    own = rng.integers(-30_000, 30_000, 132).astype(np.int16)
    sparse, dense = own.copy(), own.copy()
    other = rng.permutation(np.r_[0:64, 68:132])
    sparse[other[:85]] = 31_000  # a third of the words is alike
    dense[other[:30]] = 31_000
    row = lambda x, ref: {"doc": x, "ref": 0, "runs": [64, 64, 4], "d0": 64, "d1": 68, "r0": 64, "r1": 68, "d_low": 0, "r_low": 0, "own": own.tolist(), "other": ref.tolist()}
    kinds = [("doc", pa.int64()), ("ref", pa.int64()), ("runs", pa.list_(pa.int32())), *[(c, pa.int32()) for c in ("d0", "d1", "r0", "r1", "d_low", "r_low")], ("own", pa.list_(pa.int16())), ("other", pa.list_(pa.int16()))]
    batch = pa.RecordBatch.from_pylist([row(1, sparse), row(2, dense)], schema=pa.schema(kinds))
    assert [x for b in substrings._likely(50, 0.75)(iter([batch])) for x in b.column("doc").to_pylist()] == [2]
