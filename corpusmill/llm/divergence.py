"""Source divergence audit: how the sources of a language differ in their use of terms.

Terms are strings only inside tasks. What is shuffled by term is a 64-bit digest: first for the terms' document counts, which
few terms survive, then for the counts of the survivors. Tasks know the survivors by a Bloom filter of fixed size. With each
survivor go the smallest and the largest string that has its digest: where they differ, terms collide, and these digests
alone are split and counted by their strings. Strings join the result at the end, for the terms that are reported.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.llm.shared import saved
from corpusmill.llm.words import Alphabet, chunks, mix, utf8, words

MIN_DOCUMENTS, SMOOTHING, UNIT, TOP = 30, 5, 1_000_000_000, 50
#: Bits of the filter (4 MB, whatever the number of terms) and of a digest.
FILTER_BITS, DIGEST_BITS = 25, 64
#: Rows that a task holds before it puts equal ones together and passes them on.
FLUSH = 2_000_000
#: Tables of groups of at most so many rows are broadcast; larger ones are joined by a shuffle.
MAX_BROADCAST = 100_000
#: Terms: [^\x00-\x40\x5B-\x60\x7B-\x7F]+, A-Z in lower case
TERMS = Alphabet(bytes([*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
_U = np.uint64


def _chunk_terms(data: np.ndarray, offsets: np.ndarray, i: int, j: int, bits: int):
    """Of the texts i to j: each term's text (from 0) and code, the distinct terms by code, and their digests."""
    w = words(data, offsets, i, j, TERMS)
    part = data[w.low : int(offsets[j])]
    sizes = w.end - w.start
    bounds = np.zeros(len(sizes) + 1, dtype=np.int64)
    np.cumsum(sizes, out=bounds[1:])
    letters = TERMS.lower[part[TERMS.word[part]]]
    strings = pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(letters))])
    coded = strings.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    digests = np.zeros(len(coded.dictionary), dtype=np.uint64)
    digests[codes] = mix(w.hash)
    text = np.repeat(np.arange(j - i), np.diff(w.first))
    return text, codes, coded.dictionary, digests & _U((1 << bits) - 1)


def _grouped(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Distinct keys and the sums of their values."""
    if not len(keys[0]):
        return keys, values
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    new = np.ones(len(order), dtype=bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    at = np.flatnonzero(new)
    return [k[at] for k in keys], [np.add.reduceat(v[order], at) for v in values]


def _document_counts(bits: int):
    """(lang, digest, docs): in how many texts of a language each digest stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: dict[str, int] = {}
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def out():
            keys, (docs,) = _grouped([np.concatenate([h[n] for h in held]) for n in (0, 1)], [np.concatenate([h[2] for h in held])])
            held.clear()
            names = pa.array(list(ids), pa.string())
            for a in range(0, len(docs), 50_000):
                b = slice(a, a + 50_000)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(keys[0][b])), pa.array(keys[1][b].view(np.int64)), pa.array(docs[b])], names=["lang", "digest", "docs"])

        for batch in batches:
            lang = np.array([ids.setdefault(x, len(ids)) for x in batch.column(0).to_pylist()], dtype=np.int64)
            data, offsets = utf8(batch.column(2))
            for i, j in chunks(offsets):
                text, codes, known, digests = _chunk_terms(data, offsets, i, j, bits)
                # Two terms of one digest in a text count once: at least as many texts as either has.
                pairs = np.unique(text * max(1, len(known)) + codes)
                (t, d), _ = _grouped([pairs // max(1, len(known)), digests[pairs % max(1, len(known))]], [pairs])
                keys, (docs,) = _grouped([lang[i:j][t], d], [np.ones(len(t), dtype=np.int64)])
                held.append((*keys, docs))
            if sum(len(h[0]) for h in held) > FLUSH:
                yield from out()
        if held:
            yield from out()

    return run


def _slots(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each digest in the filter."""
    h = mix(digests ^ _U(0x5851F42D4C957F2D))
    return (h & _U((1 << FILTER_BITS) - 1)).astype(np.int64), (h >> _U(64 - FILTER_BITS)).astype(np.int64)


def _bits_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = np.unique(np.concatenate(_slots(batch.column(0).to_numpy().view(np.uint64))))
        cell, low = at >> 6, np.left_shift(_U(1), (at & 63).astype(np.uint64))
        new = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, np.int64)
        values = np.bitwise_or.reduceat(low, new) if len(cell) else low
        yield pa.RecordBatch.from_arrays([pa.array(cell[new]), pa.array(values.view(np.int64))], names=["cell", "bits"])


def bloom(digests: DataFrame) -> np.ndarray:
    """A Bloom filter of the column digest: 2^FILTER_BITS bits, of which the driver sees the cells that aren't empty."""
    rows = digests.select("digest").mapInArrow(_bits_of, "cell long, bits long").groupBy("cell").agg(F.bit_or("bits").alias("bits")).toArrow()
    cells = np.zeros(1 << (FILTER_BITS - 6), dtype=np.uint64)
    cells[rows["cell"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return cells


def _among(cells: np.ndarray, digests: np.ndarray) -> np.ndarray:
    found = np.ones(len(digests), dtype=bool)
    for at in _slots(digests):
        found &= (cells[at >> 6] >> (at & 63).astype(np.uint64)) & _U(1) == 1
    return found


def _extremes(met: list[tuple[np.ndarray, np.ndarray, pa.Array]]) -> tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]:
    """Distinct (language, digest), and the smallest and largest string of each in the order of UTF-8, that of code points."""
    lang, digest = (np.concatenate([m[k] for m in met]) for k in (0, 1))
    coded = pa.chunked_array([m[2] for m in met]).combine_chunks().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    order = np.lexsort((codes, digest, lang))
    lang, digest, codes = lang[order], digest[order], codes[order]
    first = np.flatnonzero(np.r_[True, (lang[1:] != lang[:-1]) | (digest[1:] != digest[:-1])])
    end = np.r_[first[1:], len(lang)]
    low, high = codes[first], codes[end - 1]
    for k in np.flatnonzero(low != high):  # more than one string
        every = np.unique(codes[first[k] : end[k]])
        words_ = coded.dictionary.take(pa.array(every)).to_pylist()
        low[k], high[k] = every[words_.index(min(words_))], every[words_.index(max(words_))]
    return lang[first], digest[first], coded.dictionary.take(pa.array(low)), coded.dictionary.take(pa.array(high))


COUNTED = "lang string, source string, digest long, term string, n long, docs long, low string, high string"


def _counts(filtered, bits: int, by_term: bool):
    """Counts of the terms whose digests pass the filter. By digest: (lang, source, digest, n) and for each (lang, digest) the
    smallest and largest string; by term: (lang, source, digest, term, n, docs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = filtered.value
        ids: dict[tuple[str, str], int] = {}
        langs: dict[str, int] = {}
        seen: dict[tuple, list] = {}  # (group, digest, term) to n and docs
        met: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []  # languages, digests and strings of a chunk's terms
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def rows(size, **columns):
            types = dict(x.split() for x in COUNTED.split(", "))
            return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(size, pa.string() if t == "string" else pa.int64())) for c, t in types.items()], names=list(types))

        def out():
            if held:
                keys, (n,) = _grouped([np.concatenate([h[k] for h in held]) for k in (0, 1)], [np.concatenate([h[2] for h in held])])
                held.clear()
                lang, source = (pa.array([g[k] for g in ids], pa.string()) for k in (0, 1))
                for a in range(0, len(n), 50_000):
                    b = slice(a, a + 50_000)
                    group = pa.array(keys[0][b])
                    yield rows(len(group), lang=lang.take(group), source=source.take(group), digest=pa.array(keys[1][b].view(np.int64)), n=pa.array(n[b]))
            if met:
                of = pa.array(list(langs), pa.string())
                lang, digest, low, high = _extremes(met)
                met.clear()
                for a in range(0, len(lang), 50_000):
                    b = slice(a, a + 50_000)
                    yield rows(len(lang[b]), lang=of.take(pa.array(lang[b])), digest=pa.array(digest[b].view(np.int64)), low=low[b], high=high[b])
            items = list(seen.items())
            seen.clear()
            for a in range(0, len(items), 50_000):
                part = items[a : a + 50_000]
                g = [k[0] for k, _ in part]
                yield rows(len(part), lang=pa.array([x[0] for x in g]), source=pa.array([x[1] for x in g]), digest=pa.array([k[1] for k, _ in part]), term=pa.array([k[2] for k, _ in part]), n=pa.array([v[0] for _, v in part]), docs=pa.array([v[1] for _, v in part]))

        for batch in batches:
            names = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            group = np.array([ids.setdefault(x, len(ids)) for x in names], dtype=np.int64)
            lang = np.array([langs.setdefault(x[0], len(langs)) for x in names], dtype=np.int64)
            of_group = list(ids)
            data, offsets = utf8(batch.column(2))
            for i, j in chunks(offsets):
                text, codes, known, digests = _chunk_terms(data, offsets, i, j, bits)
                keep = _among(cells, digests)[codes]
                text, codes, size = text[keep], codes[keep], max(1, len(known))
                if not len(codes):
                    continue
                if by_term:
                    signed = digests.view(np.int64)
                    pairs = np.unique(text * size + codes, return_counts=True)
                    keys, (n, docs) = _grouped([group[i:j][pairs[0] // size], pairs[0] % size], [pairs[1], np.ones(len(pairs[0]), dtype=np.int64)])
                    strings = known.take(pa.array(keys[1])).to_pylist()
                    for g, d, term, count, of in zip(keys[0].tolist(), signed[keys[1]].tolist(), strings, n.tolist(), docs.tolist(), strict=True):
                        at = seen.setdefault((of_group[g], d, term), [0, 0])
                        at[0] += count
                        at[1] += of
                    continue
                keys, n = np.unique(group[i:j][text] * size + codes, return_counts=True)
                keys, (n,) = _grouped([keys // size, digests[keys % size]], [n])
                held.append((*keys, n))
                each = np.unique(lang[i:j][text] * size + codes)
                met.append((each // size, digests[each % size], known.take(pa.array(each % size)).cast(pa.string())))
            if len(seen) + sum(len(h[0]) for h in [*held, *met]) > FLUSH:
                yield from out()
        yield from out()

    return run


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= MAX_BROADCAST else df


def kept_counts(documents: DataFrame, min_documents: int = MIN_DOCUMENTS, bits: int = DIGEST_BITS) -> tuple[DataFrame, DataFrame]:
    """(lang, source, digest, part, n) of the kept terms in the groups where they stand, and (lang, digest, part, term). A
    term of a digest of its own has the part ''; one that shares its digest is its own part."""
    spark = documents.sparkSession
    docs = documents.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    found = docs.mapInArrow(_document_counts(bits), "lang string, digest long, docs long").groupBy("lang", "digest").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_documents)
    found = saved(found.select("lang", "digest"), "divergent-digests")
    counted = saved(docs.mapInArrow(_counts(spark.sparkContext.broadcast(bloom(found)), bits, False), COUNTED), "divergent-counts")
    strings = counted.where("low is not null").groupBy("lang", "digest").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    strings = saved(strings.join(found, ["lang", "digest"], "left_semi"), "divergent-strings")
    shared = strings.where("low <> high").select("lang", "digest")
    counts = counted.where("low is null").groupBy("lang", "source", "digest").agg(F.sum("n").alias("n"))
    counts = counts.join(strings.where("low = high").select("lang", "digest"), ["lang", "digest"], "left_semi").withColumn("part", F.lit(""))
    terms = strings.where("low = high").select("lang", "digest", F.lit("").alias("part"), F.col("low").alias("term"))
    if shared.take(1):
        split = docs.mapInArrow(_counts(spark.sparkContext.broadcast(bloom(shared)), bits, True), COUNTED)
        split = saved(split.groupBy("lang", "source", "digest", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).join(shared, ["lang", "digest"], "left_semi"), "divergent-split")
        kept = split.groupBy("lang", "digest", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_documents)
        counts = counts.unionByName(split.join(kept.select("lang", "digest", "term"), ["lang", "digest", "term"], "left_semi").select("lang", "source", "digest", "n", F.col("term").alias("part")))
        terms = terms.unionByName(kept.select("lang", "digest", F.col("term").alias("part"), "term"))
    return saved(counts, "divergent-kept"), terms


def _share(n: str, total: str, terms: str):
    """1 + floor(UNIT (n + SMOOTHING) / (total + SMOOTHING terms)), exact: whole numbers of up to 38 digits."""
    return F.expr(f"1 + ((cast({UNIT} as decimal(10,0)) * (cast({n} as decimal(19,0)) + {SMOOTHING})) div (cast({total} as decimal(19,0)) + {SMOOTHING} * cast({terms} as decimal(12,0))))")


def audit(documents: DataFrame, min_documents: int = MIN_DOCUMENTS, bits: int = DIGEST_BITS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: part 'pair' has each other source of the language, part 'term' the terms that
    the source uses most above its language, to rank top.

    Null lang, source and text are ''. Each row counts as a document, repeated and null doc_ids included; other columns are
    ignored. A language without kept terms has pairs of value 0; a lone source has no pair; an empty table gives no rows.
    Pairs sum over the terms that either source has: those of one alone by how often each count occurs, those of both by a
    join on the term, and the rest alike.
    """
    counts, terms = kept_counts(documents, min_documents, bits)
    groups = documents.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    sizes = terms.groupBy("lang").agg(F.count("*").alias("terms"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = groups.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").na.fill(0, ["total", "terms"])
    groups = groups.withColumn("none", F.when(F.col("terms") > 0, _share("0", "total", "terms")).otherwise(F.lit(0).cast("long")))
    groups = saved(groups, "divergent-groups")
    small = _few(groups)
    own = saved(counts.join(small, ["lang", "source"]).select("lang", "source", "digest", "part", "n", "none", _share("n", "total", "terms").alias("p")), "divergent-shares")

    # Pairs: the difference of the shares of terms that neither has, then what each term of one alone adds, then what terms of both change.
    others = small.select("lang", F.col("source").alias("item"), F.col("none").alias("other_none"))
    base = F.abs(F.col("none") - F.col("other_none"))
    every = groups.join(others, "lang").where("source <> item")
    start = every.select("lang", "source", "item", (base * F.col("terms")).alias("value"))
    levels = own.groupBy("lang", "source", "none", "p").agg(F.count("*").alias("n"))
    alone = levels.join(others, "lang").where("source <> item").groupBy("lang", "source", "item").agg(F.sum((F.abs(F.col("p") - F.col("other_none")) - base) * F.col("n")).alias("value"))
    right = own.select("lang", "digest", "part", F.col("source").alias("item"), F.col("p").alias("other_p"), F.col("none").alias("other_none"))
    change = F.abs(F.col("p") - F.col("other_p")) - F.abs(F.col("p") - F.col("other_none")) - F.abs(F.col("none") - F.col("other_p")) + base
    both = own.join(right, ["lang", "digest", "part"]).where("source < item").groupBy("lang", "source", "item").agg(F.sum(change).alias("value"))
    turned = lambda df: df.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    pairs = start.unionByName(alone).unionByName(turned(alone)).unionByName(both).unionByName(turned(both)).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    by_value = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by_value).alias("rank"))

    # Terms: the language's share from the sum of its sources; ranks by digest with all ties, then strings, then ranks by string.
    whole = _few(counts.groupBy("lang").agg(F.sum("n").alias("lang_total")).join(sizes, "lang"))
    of_lang = own.groupBy("lang", "digest", "part").agg(F.sum("n").alias("lang_n")).join(whole, "lang").select("lang", "digest", "part", _share("lang_n", "lang_total", "terms").alias("q"))
    above = own.join(of_lang, ["lang", "digest", "part"]).where("p > q").select("lang", "source", "digest", F.col("part").alias("sub"), (F.col("p") - F.col("q")).alias("value"))
    first = above.withColumn("r", F.rank().over(W.partitionBy("lang", "source").orderBy(F.desc("value")))).where(F.col("r") <= top)
    named = first.join(terms.select("lang", "digest", F.col("part").alias("sub"), F.col("term").alias("item")), ["lang", "digest", "sub"])
    named = named.select("lang", "source", F.lit("term").alias("part"), "item", "value", F.row_number().over(by_value).alias("rank")).where(F.col("rank") <= top)
    return pairs.unionByName(named)


ORACLE = r"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
o AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS lang_n FROM o GROUP BY ALL HAVING count(DISTINCT r) >= 30),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(lang_n)::HUGEINT AS lang_total FROM k GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM o SEMI JOIN k USING (lang, term) GROUP BY ALL),
x AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.lang_n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
s AS (SELECT *, sum(n) OVER (PARTITION BY lang, source)::HUGEINT AS total FROM x),
p AS (SELECT s.*, 1 + (1000000000 * (n + 5)) // (total + 5 * v) AS p, 1 + (1000000000 * (lang_n + 5)) // (lang_total + 5 * v) AS q FROM s JOIN v USING (lang)),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
every AS (SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50"""
