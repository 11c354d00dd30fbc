"""Exact n-gram Jaccard join by a size-aware heavy-light scheme.

Documents with equal shingle sets form one class. Shingles are put in one global order: rare ones by hash, then the
frequent ones by frequency. A set of n shingles that links with another shares one of its first n - ceil(3n/4) + 1
shingles with it, and two of its first n - ceil(3n/4) + 2. Small sets are keyed by the pairs of the latter (subsets of
fixed size 2), large sets by the former (inverted lists); the boundary is where the cost of the pairs exceeds that of
scanning lists, from the sizes and frequencies measured. Small sets near the boundary enter the lists as well.

Within a list no all-pairs are formed: every member is compared with a few leaders of its list. Components of
these links are found; where a list still holds members of several components, members outside the list's main component are
compared with the rest in blocks of bounded size, so that no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.shared import components, looked_up, partitions, saved, tidy
from corpusmill.llm.words import SPACED, as_long, chunks, mix, shingles, utf8, words

K = 5
#: Shingles in this many documents of one task at least are ranked by frequency; at most MAX_FREQUENT of them.
FREQUENT, MAX_FREQUENT = 8, 200_000
LEADERS = (0x0, 0x2545F4914F6CDD1D, 0x1B873593CC9E2D51, 0x3C6EF372FE94F82B)
BLOCK = 256
#: Rows of a hot list are dealt to so many tasks where they meet what is known of the list.
SALTS = 32
MARK_BITS = 1 << 23
SKETCH, WIDE = 1024, 256
_PRIME = np.uint64(0x9FB21C651E98DF25)


def _sets(column) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    data, offsets = utf8(column)
    for i, j in chunks(offsets):
        h, bounds = shingles(words(data, offsets, i, j, SPACED), K)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            s = np.sort(h[a:b])
            yield s[np.append(True, s[1:] != s[:-1])] if len(s) > 1 else s


def _parity(s: np.ndarray) -> list[int]:
    """SKETCH bits, each the parity of the shingles that fall on it: two sets differ in at least as many shingles as bits."""
    return np.packbits((np.bincount((s % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) & 1).astype(bool)).view(np.int64).tolist()


def _wide(s: np.ndarray) -> bytes:
    """A parity sketch of as many bits as the set has shingles, rounded up to a power of two; WIDE at least. Its halves
    folded on each other are the sketch of half as many bits, since bits are numbered by the hash's upper bits last."""
    bits = max(WIDE, 1 << int(len(s) - 1).bit_length()) if len(s) else WIDE
    at = (mix(s) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(bool)).tobytes()


def _fold(x: np.ndarray, size: int) -> np.ndarray:
    """Sketches (the last axis: bytes) folded to size bytes."""
    while x.shape[-1] > size:
        half = x.shape[-1] // 2
        x = x[..., :half] ^ x[..., half:]
    return x


def _may_link(x: np.ndarray, n: int, y: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Which rows of y, sets of sizes m, may link with x, a set of size n: at a Jaccard of 3/4 or more at most a seventh of both
    sizes together differs, and sketches differ in no more places than sets."""
    size = min(x.shape[-1], y.shape[-1])
    differ = np.bitwise_count(_fold(y, size) ^ _fold(x, size)).sum(axis=-1, dtype=np.int64)
    return (7 * differ <= n + m) & (4 * n >= 3 * m) & (4 * m >= 3 * n)


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs (a, b, na, nb, wa, wb), those whose sketches allow a link."""
    for batch in batches:
        _, _, na, nb, wa, wb = (c.to_pylist() for c in batch.columns)
        keep = [bool(_may_link(np.frombuffer(x, np.uint8), n, np.frombuffer(y, np.uint8)[None, :], np.array([m]))[0]) for n, m, x, y in zip(na, nb, wa, wb, strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind 0: a row for each document, with a 128-bit signature of its set; kind 1: frequent shingles of the task."""
    held, size = [], 0
    names = ["kind", "doc_id", "n", "hi", "lo", "sketch", "wide"]

    def merged(least):
        k = np.concatenate([x for x, _ in held])
        k, at = np.unique(k, return_inverse=True)
        c = np.bincount(at, weights=np.concatenate([c for _, c in held])).astype(np.int64)
        keep = c >= least
        if keep.sum() > MAX_FREQUENT:
            keep = c > np.partition(c, -MAX_FREQUENT)[-MAX_FREQUENT]
        return k[keep], c[keep]

    for batch in batches:
        n, hi, lo, sketch, wide = [], [], [], [], []
        for s in _sets(batch.column(1)):
            sketch.append(_parity(s))
            wide.append(_wide(s))
            n.append(len(s))
            hi.append(int(mix(s).sum(dtype=np.uint64).view(np.int64)))
            lo.append(int((mix(s * _PRIME) ^ (s << np.uint64(7))).sum(dtype=np.uint64).view(np.int64)))
            held.append((s, np.ones(len(s), np.int64)))
            size += len(s)
            if size > 4_000_000:
                held = [merged(2)]
                size = len(held[0][0])
        yield pa.RecordBatch.from_arrays([pa.array([0] * len(n), pa.int32()), batch.column(0), pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(sketch, pa.list_(pa.int64())), pa.array(wide, pa.binary())], names=names)
    if held:
        k, c = merged(FREQUENT)
        yield pa.RecordBatch.from_arrays([pa.array([1] * len(k), pa.int32()), pa.nulls(len(k), pa.int64()), pa.array(c), pa.array(as_long(k)), pa.array([0] * len(k), pa.int64()), pa.nulls(len(k), pa.list_(pa.int64())), pa.nulls(len(k), pa.binary())], names=names)


def lead(n: int, c: int) -> int:
    """How many shingles of a set of n come first for c shared ones."""
    return min(n, n - (3 * n + 3) // 4 + c)


def boundary(mean_list: float, most: int = 64) -> int:
    """The largest set size whose 2-subsets cost no more than scanning the lists of its first shingles."""
    b = 2
    while b < most and lead(b + 1, 2) * (lead(b + 1, 2) - 1) / 2 <= lead(b + 1, 1) * (1 + mean_list):
        b += 1
    return b


def _keys(frequent_of, small: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count = frequent_of.value
        for batch in batches:
            n, hi, lo, keys = [], [], [], []
            for s in _sets(batch.column(1)):
                n.append(len(s))
                hi.append(int(mix(s).sum(dtype=np.uint64).view(np.int64)))
                lo.append(int((mix(s * _PRIME) ^ (s << np.uint64(7))).sum(dtype=np.uint64).view(np.int64)))
                if len(s) < 3:  # sets of one or two link with equal sets only
                    keys.append([])
                    continue
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    f = np.where(known[at] == s, count[at], 0)
                    s = s[np.argsort(f, kind="stable")]
                own = []
                if len(s) <= small:
                    p = s[: lead(len(s), 2)]
                    a, b = np.triu_indices(len(p), 1)
                    own.append(mix(np.minimum(p[a], p[b]) * _PRIME + np.maximum(p[a], p[b])))
                if len(s) > small or 4 * len(s) >= 3 * (small + 1):
                    own.append(s[: lead(len(s), 1)])
                keys.append(as_long(np.concatenate(own)).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n", "hi", "lo", "keys"])

    return run


def _mark(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64)) % np.uint64(MARK_BITS)).astype(np.int64)


def _marked_sets(marks_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = marks_of.value
        for batch in batches:
            batch = batch.filter(pa.array(marks[_mark(batch.column(0).fill_null(-(2**63)).to_numpy())]))
            sets = [as_long(s) for s in _sets(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "shingles"])

    return run


def _sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, shingles) of the documents in ids (column doc_id). A map of MARK_BITS marks of a byte each (8 MB) is broadcast first, so that
    few other texts are shuffled."""
    marks = np.zeros(MARK_BITS, bool)
    for batch in ids.mapInArrow(tidy(_marks_of), "at long").distinct().toArrow().to_batches():
        marks[batch.column(0).to_numpy()] = True
    return docs.mapInArrow(tidy(_marked_sets(docs.sparkSession.sparkContext.broadcast(marks))), "doc_id long, shingles array<long>")


def _marks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(_mark(batch.column(0).to_numpy())))], names=["at"])


def _block_links(part: pd.DataFrame) -> pd.DataFrame:
    """Links between rows of side 0 and side 1 whose components differ, as far as they join components."""
    left, right = part[part.side == 0], part[part.side == 1]
    out: list[tuple[int, int]] = []
    if len(left) and len(right):
        sets = [np.asarray(s) for s in right.shingles]
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        sizes, ids, comps = np.array([len(s) for s in sets]), right.doc.to_numpy(), right.comp.to_numpy()
        for doc, comp, s in zip(left.doc, left.comp, left.shingles, strict=True):
            s = np.asarray(s)
            a, b = np.searchsorted(flat, s, "left"), np.searchsorted(flat, s, "right")
            total = b - a
            at = np.repeat(a - np.concatenate([[0], np.cumsum(total)[:-1]]), total) + np.arange(total.sum())
            common = np.bincount(owner[at], minlength=len(sets))
            good = (100 * common >= 75 * (len(s) + sizes - common)) & (comps != comp)
            _, one = np.unique(comps[good], return_index=True)  # one link to each other component is enough
            out += [(doc, int(x)) for x in ids[good][one]]
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def joined(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id per row of documents: sets of 5-word shingles, links at a Jaccard of 0.75 or more,
    component_id the smallest doc_id reachable by links.

    Null texts and texts without words have no shingles and link with nothing (their component is their own doc_id); fewer
    than five words are one shingle. Rows of equal doc_id count as one document for components. A row with a null
    doc_id gets a null component. Other columns are ignored; an empty table gives an empty result.
    """
    spark = documents.sparkSession
    docs = documents.select("doc_id", "text")
    first = saved(docs.mapInArrow(tidy(_sizes), "kind int, doc_id long, n long, hi long, lo long, sketch array<long>, wide binary"), "jaccard-sizes")
    sizes = first.where("kind = 0")
    top = first.where("kind = 1").groupBy("hi").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "hi").limit(MAX_FREQUENT).toArrow()
    known, count = top.column(0).to_numpy().view(np.uint64), top.column(1).to_numpy()
    order = np.argsort(known)
    known, count = known[order], count[order]
    shingle_total = sizes.agg(F.sum("n")).first()[0] or 1
    small = boundary(float((count.astype(np.float64) ** 2).sum()) / shingle_total)
    keyed = docs.mapInArrow(tidy(_keys(spark.sparkContext.broadcast((known, count)), small)), "doc_id long, n long, hi long, lo long, keys array<long>")
    classes = keyed.where("n > 2 and doc_id is not null").groupBy("hi", "lo", "n").agg(F.min("doc_id").alias("doc"), F.first("keys").alias("keys"))
    rows = classes.select("doc", "n", F.explode("keys").alias("key")).repartition(partitions(spark), "key")
    lead_cols = [F.min(F.col("doc").bitwiseXOR(F.lit(c))).bitwiseXOR(F.lit(c)).alias(f"l{i}") for i, c in enumerate(LEADERS)]
    lists = rows.groupBy("key").agg(F.count("n").alias("members"), *lead_cols).where("members > 1")
    shared = saved(rows.join(lists, "key"), "jaccard-lists")
    leaders = F.array_distinct(F.array(*[f"l{i}" for i in range(len(LEADERS))]))
    stars = shared.select("doc", F.explode(leaders).alias("other")).where("doc <> other").select(F.least("doc", "other").alias("a"), F.greatest("doc", "other").alias("b")).distinct()
    a, b = (sizes.select(F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"k{x}")) for x in "ab")
    differ = F.aggregate(F.zip_with("ka", "kb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x)
    # A Jaccard of 3/4 or more means that at most (na + nb) / 7 shingles differ, and that sizes are alike.
    alike = (4 * F.col("na") >= 3 * F.col("nb")) & (4 * F.col("nb") >= 3 * F.col("na"))
    stars = saved(stars.join(a, "a").join(b, "b").where(alike & (7 * differ <= F.col("na") + F.col("nb"))).select("a", "b", "na", "nb").distinct(), "jaccard-stars")
    wide = sizes.where("n > 2 and doc_id is not null").select("doc_id", "n", "hi", "lo", "wide")
    pairs = stars
    for x in "ab":
        pairs = pairs.join(wide.select(F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col("wide").alias(f"w{x}")), [x, f"n{x}"])
    pairs = saved(pairs.select("a", "b", "na", "nb", "wa", "wb").mapInArrow(tidy(_near), "a long, b long").distinct(), "jaccard-pairs")
    needed = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    sets = saved(_sets_of(docs, needed), "jaccard-sets")
    a, b = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    links = saved(pairs.join(b, "b").join(a, "a").where(100 * common >= 75 * (F.size("sa") + F.size("sb") - common)).select("a", "b"), "jaccard-links")
    comp = components(links)
    open_lists = shared.where(F.col("members") > F.size(leaders) + 1)
    more = _open_links(open_lists, comp, wide, docs)
    reps = saved(sizes.where("n > 0 and doc_id is not null").groupBy("hi", "lo", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "jaccard-reps")
    every = sizes.select("doc_id", "hi", "lo", "n")
    classed = looked_up(every.where("doc_id is not null and n > 0"), reps, ["hi", "lo", "n"], "copies", sizes.count()).select("doc_id", "n", "rep")
    out = saved(classed.union(every.where("doc_id is not null and n = 0").select("doc_id", "n", F.lit(None).cast("long"))), "jaccard-classes")
    # Rows of equal doc_id in different classes: their components are one.
    several = saved(out.groupBy("doc_id").agg(F.count("*").alias("rows"), F.min("rep").alias("low"), F.max("rep").alias("high")).where("rows > 1"), "jaccard-several")
    same = out.join(several.where("low < high"), "doc_id").where("rep > low").select(F.col("low").alias("a"), F.col("rep").alias("b"))
    comp = components(links.union(more).union(same))
    out = out.join(comp.withColumnRenamed("node", "rep"), "rep", "left").withColumn("own", F.coalesce("component", "rep", "doc_id"))
    whole = out.join(several.select("doc_id"), "doc_id").groupBy("doc_id").agg(F.min("own").alias("whole"))
    out = out.join(whole, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("whole", "own").alias("component_id"))
    return out.union(every.where("doc_id is null").select("doc_id", "n", F.lit(None).cast("long")))


def _block_members(part: pd.DataFrame) -> pd.DataFrame:
    """The rows of a block that may link with a row of the other side in another component, by their sketches."""
    left, right = part[part.side == 0], part[part.side == 1]
    out = []
    if len(left) and len(right):
        by_size = {k: (np.frombuffer(b"".join(r.wide), np.uint8).reshape(len(r), k), r.n.to_numpy(), r.comp.to_numpy(), r.index.to_numpy()) for k, r in right.groupby(right.wide.map(len))}
        for at, x, n, comp in zip(left.index, left.wide, left.n, left.comp, strict=True):
            for k, (y, m, comps, index) in by_size.items():
                if 2 * k >= len(x) and k <= 2 * len(x):
                    found = index[_may_link(np.frombuffer(x, np.uint8), n, y, m) & (comps != comp)]
                    out += [at, *found.tolist()] if len(found) else []
    return part.loc[sorted(set(out)), ["g", "i", "j", "side", "doc", "comp"]].drop_duplicates()


def _open_links(open_lists: DataFrame, comp: DataFrame, wide: DataFrame, docs: DataFrame) -> DataFrame:
    """Links that join components, among the lists whose pairs were not all compared with leaders.

    Lists with the same first leader are taken together (a document is then in few of them). Members outside the main
    component are dealt into blocks, and so are all members; each pair of blocks is one group of bounded size."""
    members = open_lists.select(F.col("l0").alias("g"), "doc", "n").distinct()
    members = members.join(comp.withColumnRenamed("node", "doc"), "doc", "left").withColumn("comp", F.coalesce("component", "doc")).drop("component")
    per = members.groupBy("g", "comp").agg(F.count("*").alias("m"))
    main = per.groupBy("g").agg(F.sum("m").alias("total"), F.count("*").alias("kinds"), F.max(F.struct("m", "comp")).alias("top"))
    main = main.where("kinds > 1").select("g", F.col("top.comp").alias("main"), F.ceil((F.col("total") - F.col("top.m")) / BLOCK).alias("left_blocks"), F.ceil(F.col("total") / BLOCK).alias("right_blocks"))
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt")
    m = members.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS).cast("long"))).join(main.select("*", salts), ["g", "salt"]).drop("salt")
    spot = lambda k: F.pmod(F.xxhash64("doc"), F.col(k)).cast("long")
    all_of = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.col(k) - 1))
    left = m.where("comp <> main").select("g", "doc", "n", "comp", spot("left_blocks").alias("i"), all_of("right_blocks").alias("j"), F.lit(0).alias("side"))
    right = m.select("g", "doc", "n", "comp", all_of("left_blocks").alias("i"), spot("right_blocks").alias("j"), F.lit(1).alias("side"))
    own = wide.withColumnRenamed("doc_id", "doc").repartition("doc", "n").dropDuplicates(["doc", "n", "hi", "lo"]).drop("hi", "lo")
    dealt = left.union(right).join(own, ["doc", "n"])
    # Sketches first; the sets of those documents alone that they leave are dealt.
    kept = saved(dealt.groupBy("g", "i", "j").applyInPandas(_block_members, "g long, i long, j long, side int, doc long, comp long"), "jaccard-dealt")
    sets = _sets_of(docs, kept.select(F.col("doc").alias("doc_id"))).withColumnRenamed("doc_id", "doc").dropDuplicates(["doc", "shingles"])
    return saved(kept.join(sets, "doc").groupBy("g", "i", "j").applyInPandas(_block_links, "a long, b long"), "jaccard-more")
