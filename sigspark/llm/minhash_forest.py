"""Near-duplicate documents by an LSH forest over MinHash signatures.

A document's set holds its distinct shingles of ``k`` words (the whole
sequence where it has fewer words).  Documents with equal sets are one class
from the start, so exact copies cost one row.

The forest (Bawa, Condie, Ganesan: "LSH Forest", 2005): a class has
SIGNATURE min-hashes; each of TREES orders reads DEPTH of them, in an order of its
own, as a label, and all classes are sorted by that label (a range partitioning
on the whole label, so no group is gathered in one task).  Classes that agree
in a long prefix stand side by side, and those that share LEAST min-hashes are a
region.  In a region of at most REGION classes all pairs are candidates; in a denser
one each class meets its two next neighbours in every order, and the region is noted.
A pair at the threshold shares no region in any tree with a chance of
(1 - 0.85^4)^16 < 1e-5.

Candidates are confirmed on full shingle sets, in rounds: first each class's best
candidates, then those that still lie in different components.  Last come the noted
regions of WHOLE trees that still hold several components: each is compared whole, set
against set, inside the tasks (chunks of CHUNK classes, each pair of chunks in a task of its own), and hands on
only which components meet.  A region of more than LARGE classes is first parted by
more min-hashes of its label, so the depth follows the region's density.  What lies in different components
of such a region after that is compared exactly too: each class outside the region's
largest component with all of the region, in chunks again.  So a region of any size is settled whole, and
the work follows the classes that the cheaper steps have left apart.
(A pair at the threshold shares a region of no such tree with a chance of (1 - 0.85^4)^16 < 1e-5.)
A pair inside one component needs no confirmation, as only components are asked for.

Defined results: a null, empty or blank text has an empty set and is linked
with nothing; rows with the same id are the same node; a row without id is in
its class's component but never names one; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sigspark.session import cut_lineage

from .components import components, lowest
from .groups import runs_of
from .lookup import with_ids
from .text import Words, buffers, mix, row_chunks, sequence_hash, shingles, signed, stream

#: Words of a shingle; similarity of a link, in hundredths.
WORDS, LEAST_SIMILAR = 3, 85
#: Min-hashes; trees; min-hashes of a label; prefix that a region shares; classes a region may hold all pairs of.
SIGNATURE, TREES, DEPTH, LEAST, REGION = 128, 16, 20, 4, 8
#: Classes of a region that is compared whole, min-hashes that part a larger one, classes of a chunk of it, trees whose regions are.
LARGE, STEP, CHUNK, WHOLE = 4096, 4, 256, 16
#: Candidates of a class that the first round confirms.
FIRST = 3

_MULT = (stream(SIGNATURE, 41) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_XOR = (stream(SIGNATURE, 43) >> np.uint64(32)).astype(np.uint32)
_ORDER = np.stack([np.random.default_rng(100 + t).permutation(SIGNATURE)[:DEPTH] for t in range(TREES)])


def shingle_sets(data: np.ndarray, offs: np.ndarray, lo: int, hi: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingles of all rows, sorted row by row; where each row's begin, rows + 1 of them)."""
    w = Words(data, offs, lo, hi)
    h = w.hashes()
    s = shingles(h, k)
    row = np.repeat(np.arange(w.rows), w.n_words)
    inside = row[: len(s)] == row[k - 1 :] if len(s) else np.zeros(0, bool)
    s, row = s[inside], row[: len(inside)][inside]
    short = np.flatnonzero((w.n_words > 0) & (w.n_words < k))
    if len(short):
        whole = np.array([sequence_hash(h[w.first_word[r] : w.first_word[r + 1]]) for r in short], np.uint64)
        row, s = np.concatenate([row, short]), np.concatenate([s, whole])
        order = np.argsort(row, kind="stable")
        row, s = row[order], s[order]
    cut = np.searchsorted(row, np.arange(w.rows + 1))
    for a, z in zip(cut[:-1], cut[1:], strict=True):
        s[a:z].sort()
    first = np.ones(len(s), bool)
    first[1:] = (s[1:] != s[:-1]) | (row[1:] != row[:-1])
    return s[first], np.searchsorted(row[first], np.arange(w.rows + 1))


def signatures(s: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """(rows, SIGNATURE) of 16 bits each; rows without shingles are zeros."""
    out = np.zeros((len(cut) - 1, SIGNATURE), np.uint16)
    full = np.flatnonzero(np.diff(cut))
    if len(full):
        x, at = (s >> np.uint64(32)).astype(np.uint32), cut[:-1][full]
        with np.errstate(over="ignore"):
            for j in range(SIGNATURE):
                low = np.minimum.reduceat((x ^ _XOR[j]) * _MULT[j], at)
                out[full, j] = (low * np.uint32(2654435761)) >> np.uint32(16)
    return out


def features(docs: DataFrame, id_col: str, text: str, k: int) -> DataFrame:
    """id, n (set size), h1 and h2 (hash of the set), sig (packed signature) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = buffers(b.column(1))
            n, h1, h2, sig = [], [], [], []
            for lo, hi in row_chunks(offs):
                s, cut = shingle_sets(data, offs, lo, hi, k)
                n.append(np.diff(cut))
                with np.errstate(over="ignore"):
                    for out, x in ((h1, s), (h2, mix(s ^ np.uint64(0x5851F42D4C957F2D)))):
                        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
                        out.append(total[cut[1:]] - total[cut[:-1]])
                sig += [x.tobytes() for x in signatures(s, cut)]
            cols = [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (n, h1, h2)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(cols[0].astype(np.int64)), pa.array(signed(cols[1])), pa.array(signed(cols[2])), pa.array(sig, pa.binary())], names=["id", "n", "h1", "h2", "sig"]
            )

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("t")).mapInArrow(run, "id long, n long, h1 long, h2 long, sig binary")


def _labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each tree: the tree's number and its min-hashes, high byte first, so that bytes sort as numbers."""
    for b in batches:
        n = b.num_rows
        sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(n, SIGNATURE)
        for t in range(TREES):
            label = np.empty((n, 1 + 2 * DEPTH), np.uint8)
            label[:, 0] = t
            label[:, 1:] = np.ascontiguousarray(sig[:, _ORDER[t]].astype(">u2")).view(np.uint8).reshape(n, 2 * DEPTH)
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(label.shape[1]), n, [None, pa.py_buffer(label.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([packed, b.column(0)], names=["label", "id"])


def neighbours(label: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, shared prefix) candidates among rows sorted by label, and which rows lie in a dense region (or one cut by the border)."""
    n = len(ids)
    words = label[:, 1:].reshape(n, DEPTH, 2)
    same = (words[1:] == words[:-1]).all(2)
    shared = np.where(label[1:, 0] == label[:-1, 0], np.where(same.all(1), DEPTH, same.argmin(1)), -1)
    run = np.concatenate([[0], np.cumsum(shared < LEAST)])
    dense = np.bincount(run)[run] > REGION
    a, b, c = [], [], []
    least = np.full(n, DEPTH)
    for j in range(1, min(REGION, n)):
        least = np.minimum(least[: n - j], shared[j - 1 :])
        i = np.flatnonzero((least >= LEAST) & (~dense[: n - j] | (j <= 2)))
        a.append(ids[i])
        b.append(ids[i + j])
        c.append(least[i])
    dense |= (run == 0) | (run == run[-1])
    return *(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b, c)), dense


PAIR, BORDER, MEMBER = range(3)
FOUND = "kind int, a long, b long, shared int, label binary"


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one sorted partition: candidate pairs, border rows, and members of dense regions (the latter two by label)."""
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return
    ids = np.concatenate([b.column(1).to_numpy() for b in rows])
    packed = pa.chunked_array([b.column(0) for b in rows])
    label = np.frombuffer(b"".join(packed.to_pylist()), np.uint8).reshape(len(ids), 1 + 2 * DEPTH)
    a, b, c, dense = neighbours(label, ids)
    other = a != b
    a, b, c = a[other], b[other], c[other]
    names = ["kind", "a", "b", "shared", "label"]
    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), PAIR, np.int32)), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(c.astype(np.int32)), pa.nulls(len(a), pa.binary())], names=names)
    border = np.array(sorted({*range(min(REGION, len(ids))), *range(max(0, len(ids) - REGION), len(ids))}))
    for kind, at in ((BORDER, border), (MEMBER, np.flatnonzero(dense & (label[:, 0] < WHOLE)))):
        own = packed.take(pa.array(at)).combine_chunks().cast(pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int32)), pa.array(ids[at]), pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.int32()), own], names=names)


def search(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs (a, b, trees, shared) of ``classes`` (id, sig), a < b, each once; members (label, id) of dense regions."""
    rows = classes.select("id", "sig").mapInArrow(_labels, "label binary, id long")
    found = cut_lineage(rows.repartitionByRange("label", "id").sortWithinPartitions("label", "id").mapInArrow(_pairs, FOUND))
    border = found.where(f"kind = {BORDER}").select("label", F.col("a").alias("id")).distinct()  # 2 x REGION rows a partition
    across = border.repartition(1).sortWithinPartitions("label", "id").mapInArrow(_pairs, FOUND)
    both = found.where(f"kind = {PAIR}").unionByName(across.where(f"kind = {PAIR}"))
    pairs = both.groupBy("a", "b").agg(F.count("*").alias("trees"), F.max("shared").alias("shared"))
    return pairs, found.where(f"kind = {MEMBER}").select("label", F.col("a").alias("id"))


def _unsettled(members: DataFrame, comp: DataFrame) -> DataFrame:
    """(region, id, c, size) of regions, of LARGE classes at most, that hold several components c."""
    m = members.join(comp, F.col("id") == F.col("node"), "left").select("label", "id", F.coalesce("component", "id").alias("c"))
    out = None
    for depth in range(LEAST, DEPTH + 1, STEP):
        m = cut_lineage(m.withColumn("region", F.expr(f"substring(label, 1, {1 + 2 * depth})")))
        mixed = m.groupBy("region").agg(F.count("*").alias("size"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("region", "size")
        mixed = cut_lineage(mixed)
        part = m.join(mixed.where(f"size <= {LARGE}"), "region").select("region", "id", "c", "size")
        out = part if out is None else out.unionByName(part)
        larger = mixed.where(f"size > {LARGE}").select("region")
        if not larger.take(1):
            break
        m = m.join(larger, "region", "left_semi").select("label", "id", "c")
    return out


def _compare(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for _, b in runs_of(batches, ["region", "one", "two"]):
            col = {k: b.column(b.schema.get_field_index(k)) for k in ("c", "side", "one", "two", "s")}
            c, side = col["c"].to_numpy(), col["side"].to_numpy()
            if c.min() == c.max():
                continue
            common, size = intersections(col["s"])
            near = 100 * common >= least * (size[:, None] + size[None] - common)
            near &= c[:, None] != c[None]
            if col["one"][0] != col["two"][0]:
                near &= side[:, None] != side[None]
            if near.any():
                low = lowest(near | (c[:, None] == c[None]), c)
                out.append(np.unique(np.stack([c, low], 1)[c != low], axis=0))
        if out:
            e = np.unique(np.concatenate(out), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], names=["a", "b"])

    return run


def intersections(sets: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(sizes of all pairwise intersections, set sizes), by products of incidence blocks."""
    n = len(sets)
    values = sets.flatten().to_numpy()
    size = np.asarray(pc.list_value_length(sets))
    row = np.repeat(np.arange(n), size)
    _, place, count = np.unique(values, return_inverse=True, return_counts=True)
    several = count[place] > 1  # what only one set holds is in no intersection
    row, place = row[several], np.unique(place[several], return_inverse=True)[1]
    common, order, block = np.zeros((n, n), np.float64), np.argsort(place, kind="stable"), 4096
    row, place = row[order], place[order]
    for lo in range(0, int(place[-1]) + 1 if len(place) else 0, block):
        a, z = np.searchsorted(place, [lo, lo + block])
        m = np.zeros((n, block), np.float32)
        m[row[a:z], place[a:z] - lo] = 1
        common += m @ m.T
    return common.astype(np.int64), size.astype(np.int64)


def dense_links(members: DataFrame, comp: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """(a, b): components that meet inside a noted region."""
    m = _unsettled(members, comp).withColumn("chunks", F.ceil(F.col("size") / CHUNK).cast("int"))
    m = m.withColumn("side", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    m = m.select("region", F.least("side", "other").alias("one"), F.greatest("side", "other").alias("two"), "side", "id", "c").join(sets, "id")
    key = ["region", "one", "two"]
    return m.repartition(*key).sortWithinPartitions(*key).mapInArrow(_compare(least), "a long, b long")


def large_links(members: DataFrame, comp: DataFrame, sets: DataFrame, least: int) -> DataFrame | None:
    """(a, b): components that meet inside a noted region of more than LARGE classes; None where there is none with several.

    Pairs inside the largest component of a region say nothing new, so one side of a comparison is a class outside it.
    """
    m = members.join(comp, F.col("id") == F.col("node"), "left").select(F.expr(f"substring(label, 1, {1 + 2 * LEAST})").alias("region"), "id", F.coalesce("component", "id").alias("c"))
    parts = m.groupBy("region", "c").agg(F.count("*").alias("n"))
    mixed = parts.groupBy("region").agg(F.sum("n").alias("size"), F.max("n").alias("top"), F.max_by("c", F.struct("n", "c")).alias("main"), F.count("*").alias("several"))
    mixed = cut_lineage(mixed.where(f"size > {LARGE} and several > 1").withColumn("left", F.col("size") - F.col("top")))
    if not mixed.take(1):
        return None
    chunks = lambda c: F.ceil(F.col(c) / CHUNK).cast("int")
    m = m.join(mixed.select("region", "main", chunks("size").alias("of_all"), chunks("left").alias("of_left")), "region")
    place = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # chunks of the two sides are numbered apart, so that the comparison is between the sides only
    outside = m.where("c <> main").select("region", "id", "c", F.lit(0).alias("side"), place("of_left").alias("one"), "of_left", each("of_all").alias("two"))
    whole = m.select("region", "id", "c", F.lit(1).alias("side"), each("of_left").alias("one"), "of_left", place("of_all").alias("two"))
    key = ["region", "one", "two"]
    both = outside.unionByName(whole).withColumn("two", F.col("two") + F.col("of_left")).drop("of_left").join(sets, "id")
    return both.repartition(*key).sortWithinPartitions(*key).mapInArrow(_compare(least), "a long, b long")


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = buffers(b.column(1))
            for lo, hi in row_chunks(offs):
                s, cut = shingle_sets(data, offs, lo, hi, k)
                lists = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(signed(s)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), lists], names=["id", "s"])

    return run


def confirmed(pairs: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """Those (a, b) whose full sets have 100 x intersection >= least x union."""
    p = pairs.select("a", "b").join(sets.select(F.col("id").alias("a"), F.col("s").alias("x")), "a")
    p = p.join(sets.select(F.col("id").alias("b"), F.col("s").alias("y")), "b")
    p = p.withColumn("i", F.size(F.array_intersect("x", "y")).cast("long"))
    return p.where(100 * F.col("i") >= least * (F.size("x") + F.size("y") - F.col("i"))).select("a", "b")


def _apart(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """Pairs whose two ends are not known to be in one component."""
    p = pairs.join(comp.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left")
    p = p.join(comp.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
    return p.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).drop("ca", "cb")


def _joined(comp: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links between nodes or components."""
    tree = comp.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    return cut_lineage(components(tree.unionByName(links)))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = WORDS, least: int = LEAST_SIMILAR) -> DataFrame:
    """id, n_shingles, component_id (smallest id reachable by links) and kept (the id names its component) of each row."""
    rows = cut_lineage(features(docs, id_col, text, k))
    classes = cut_lineage(rows.where("n > 0 and id is not null").groupBy("n", "h1", "h2").agg(F.min(F.struct("id", "sig")).alias("m")).select("n", "h1", "h2", "m.id", "m.sig"))
    pairs, members = search(classes)
    pairs = cut_lineage(pairs)
    ids = cut_lineage(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    texts = with_ids(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("t")), "id", ids)
    sets = cut_lineage(texts.mapInArrow(_sets(k), "id long, s array<long>"))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("e"), "a", "b", "trees", "shared")
    best = ends.withColumn("r", F.row_number().over(W.partitionBy("e").orderBy(F.col("trees").desc(), F.col("shared").desc(), "a", "b"))).where(f"r <= {FIRST}")
    comp = cut_lineage(components(confirmed(best.select("a", "b").distinct(), sets, least)))
    rest = cut_lineage(_apart(pairs.select("a", "b"), comp))
    comp = _joined(comp, confirmed(rest, sets, least))
    comp = _joined(comp, dense_links(members, comp, sets, least))
    links = large_links(members, comp, sets, least)
    if links is not None:
        comp = _joined(comp, links)
    named = classes.select("n", "h1", "h2", "id").join(comp, F.col("id") == F.col("node"), "left").select("n", "h1", "h2", F.coalesce("component", "id").alias("component_id"))
    out = rows.select("id", "n", "h1", "h2").join(named, ["n", "h1", "h2"], "left")
    out = out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
