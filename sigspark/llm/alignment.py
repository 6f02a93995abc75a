"""Alignment of two tokenizers' tokens over the bytes of each text.

Tokenizer A is a byte-level one (a tokenizers .json file) and reads the text
after a space; tokenizer B is a sentencepiece model, which adds that space
itself.  Both cut the same bytes, so a text is two sorted lists of token ends.

The two lists (those of many texts, one after the other) are merged along a
merge path: a diagonal k has the k first ends of the merge on its left, and a
binary search on it finds how many of them are A's, so equally spaced diagonals
cut the merge into pieces of equal work, whatever the texts' lengths and however
the two vocabularies differ.  A piece needs nothing of the others: it emits one
overlap (token of A, token of B, end) for each end in it.  An end that both
lists have and that a diagonal parts is emitted on both sides; such pairs are
stitched together.  Ends that both lists have cut the tokens into groups, and
the two tokens that end there are linked.

The pairs' counts over the corpus come from the linked pairs of each row, which
``align`` packs; a task counts its pairs before they are shuffled.  To look the counts up,
the FREQUENT most frequent pairs travel to the tasks (a bounded table which
holds every hot pair); the links of rarer ones are joined by a shuffle, summed
up by row, and met with their rows.

Defined results: a null or empty text, and one whose tokens of A or of B do not
give back the space and the text byte for byte (a text that B normalises, say), has no tokens: zeros
and an empty string.  Strings of special tokens inside a text are plain text.
Rows that share an id are rows of their own; an empty table gives an empty one.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigspark.session import cut_lineage

from .lookup import fresh
from .text import buffers, mix, row_chunks
from .tokens import PRE_TOKEN

#: Bytes of text encoded at once; ends of a merge piece; pairs that a task counts before it hands them on; pairs (20 bytes each) that travel to all tasks.
STEP, PIECE, HELD, FREQUENT = 1 << 18, 1 << 14, 1 << 21, 1 << 20
#: Rows whose links are unpacked at once.
ROWS = 256


# ---- merging two sorted lists of ends ----


def merge_path(a: np.ndarray, b: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray]:
    """How many of a's and of b's ends lie left of each diagonal 0, piece, 2 piece, ..., all (a's first among equals)."""
    n = len(a) + len(b)
    k = np.append(np.arange(0, n, piece), n)
    lo, hi = np.maximum(k - len(b), 0), np.minimum(k, len(a))
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        at = np.flatnonzero(open_)
        after = a[mid[at]] > b[k[at] - mid[at] - 1]
        hi[at[after]] = mid[at[after]]
        lo[at[~after]] = mid[at[~after]] + 1
    return lo, k - lo


def piece_overlaps(a: np.ndarray, b: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(end, index in A, index in B, shared) of the overlaps that end in a piece whose slices begin at ``i`` and ``j``."""
    in_b, in_a = np.searchsorted(b, a), np.searchsorted(a, b)
    both = np.zeros(len(a), bool)
    inside = in_b < len(b)
    both[inside] = b[in_b[inside]] == a[inside]
    alone = np.ones(len(b), bool)
    alone[in_b[both]] = False
    end = np.concatenate([a, b[alone]])
    order = np.argsort(end, kind="stable")  # two sorted runs
    at_a = np.concatenate([np.arange(len(a)), in_a[alone]]) + i
    at_b = np.concatenate([in_b, np.flatnonzero(alone)]) + j
    shared = np.concatenate([both, np.zeros(int(alone.sum()), bool)])
    return end[order], at_a[order], at_b[order], shared[order]


def overlaps(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All overlaps of the tokens with the strictly rising ends ``a`` and ``b``, in order (see :func:`piece_overlaps`)."""
    i, j = merge_path(a, b, piece)
    parts = [piece_overlaps(a[i0:i1], b[j0:j1], i0, j0) for i0, i1, j0, j1 in zip(i[:-1], i[1:], j[:-1], j[1:], strict=True)]
    end, at_a, at_b, shared = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 3 + (np.zeros(0, bool),)
    again = np.flatnonzero(end[1:] == end[:-1])  # a diagonal parted this end: A's piece has its place, B's goes
    shared[again] = True
    keep = np.ones(len(end), bool)
    keep[again + 1] = False
    return end[keep], at_a[keep], at_b[keep], shared[keep]


# ---- the tokenizers ----


def _byte_of_char() -> dict[str, int]:
    """Characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [x for x in range(256) if x not in set(plain)]
    return {chr(x): x for x in plain} | {chr(256 + n): x for n, x in enumerate(rest)}


class Vocabulary:
    """Bytes and decimal digits of each id."""

    def __init__(self, entries: list[bytes]):
        self.size = len(entries)
        self.length = np.array([len(e) for e in entries], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(entries), np.uint8)
        width = len(str(max(1, self.size - 1)))
        self.digits = np.array([str(i).encode() for i in range(self.size)], f"S{width}").view(np.uint8).reshape(self.size, width)  # padded by zeros

    def joined(self, ids: np.ndarray) -> np.ndarray:
        n = self.length[ids]
        return self.bytes[np.repeat(self.start[ids] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]


#: White space of so many characters in a row is left to the tokenizers library (the other's pattern would run out of stack).
LONG_SPACE = re.compile(r"\s{4096}")


def _as_ranks(spec: dict, bytes_of: list[bytes]) -> tuple[str, dict[bytes, int]] | None:
    """(pattern, {bytes: id}) of a byte-level BPE whose merges are numbered in their order, so that the lowest id merges first; else None."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
    odd = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
    if model.get("type") != "BPE" or not plain or odd:
        return None
    vocab = model["vocab"]
    merged = [vocab.get("".join(m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
    ranks = {bytes_of[i]: i for i in vocab.values()}
    singles = [ranks.get(bytes([x]), len(bytes_of)) for x in range(256)]
    if None in merged or merged != sorted(set(merged)) or (merged and max(singles) >= merged[0]):
        return None
    return PRE_TOKEN, {bytes_of[i]: i for i in [*singles, *merged]}


class Pair:
    """Both tokenizers, made in a task from the contents of their files.

    Where A's merges are numbered in their order, its texts are encoded by ranks (the same ids, some four times as fast).
    """

    def __init__(self, spec: str, model: bytes):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = True
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = {i: t for t, i in self.tokenizer.get_vocab().items()}
        of = _byte_of_char()
        spelt = [names.get(i, "") for i in range(max(names) + 1)]
        bytes_of = [bytes(of[c] for c in t) if all(c in of for c in t) else t.encode() for t in spelt]
        self.a = Vocabulary(bytes_of)
        found = _as_ranks(json.loads(spec), bytes_of)
        self.ranked = tiktoken.Encoding("a", pat_str=found[0], mergeable_ranks=found[1], special_tokens={}) if found else None
        sp = self.pieces
        self.b = Vocabulary(
            [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in range(sp.get_piece_size())]
        )

    def encode(self, texts: list[str]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """(ids, tokens of each text) of A and of B."""
        a = [self._ids_a(f" {t}") for t in texts]
        b = self.pieces.encode(texts, num_threads=1, add_bos=False, add_eos=False)
        ids_a = np.concatenate(a).astype(np.int64) if a else np.zeros(0, np.int64)
        return tuple((x, np.array([len(y) for y in of], np.int64)) for x, of in ((ids_a, a), (np.fromiter(chain.from_iterable(b), np.int64), b)))

    def _ids_a(self, text: str) -> np.ndarray:
        if self.ranked is None or LONG_SPACE.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.ranked.encode_to_numpy(text, disallowed_special=())


def _exact(v: Vocabulary, ids: np.ndarray, n: np.ndarray, want: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which texts (of ``size`` bytes, all of them in ``want``) their tokens give back byte for byte."""
    rows = len(size)
    row = np.repeat(np.arange(rows), n)
    whole = np.zeros(rows, np.int64)
    np.add.at(whole, row, v.length[ids])
    same = whole == size
    if same.all():
        got = v.joined(ids)
    else:
        got, want = v.joined(ids[same[row]]), want[np.repeat(same, size)]
    at = np.repeat(np.flatnonzero(same), size[same])
    same[at[got != want]] = False
    return same


class Aligned:
    """The alignment of a list of texts."""

    def __init__(self, pair: Pair, texts: list[str], piece: int = PIECE):
        raw = [f" {t}".encode() for t in texts]
        size = np.array([len(r) for r in raw], np.int64)
        want = np.frombuffer(b"".join(raw), np.uint8)
        (ids_a, n_a), (ids_b, n_b) = pair.encode(texts)
        good = (size > 1) & _exact(pair.a, ids_a, n_a, want, size) & _exact(pair.b, ids_b, n_b, want, size)
        if not good.all():
            ids_a, ids_b = ids_a[np.repeat(good, n_a)], ids_b[np.repeat(good, n_b)]
            n_a, n_b, size = n_a * good, n_b * good, size * good
        self.n_a, self.n_b, self.ids_a, self.ids_b = n_a, n_b, ids_a, ids_b
        end, at_a, at_b, shared = overlaps(np.cumsum(pair.a.length[ids_a]), np.cumsum(pair.b.length[ids_b]), piece)
        row = np.repeat(np.arange(len(texts)), size > 0)[np.searchsorted(np.cumsum(size[size > 0]), end)] if len(end) else end
        self.n_overlaps = np.bincount(row, minlength=len(texts))
        self.n_groups = np.bincount(row[shared], minlength=len(texts))
        self.link_a, self.link_b = at_a[shared], at_b[shared]  # the last token of each group
        self.links = ids_a[self.link_a] * pair.b.size + ids_b[self.link_b]
        self._pair = pair

    def groups(self) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, row offsets) of ``a1,a2|b1;a3|b2,b3``: the ids of each group, A's then B's."""
        last_a, last_b = (np.zeros(len(x), np.int64) for x in (self.ids_a, self.ids_b))
        last_a[self.link_a], last_b[self.link_b] = 1, 1
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        before_b = np.append(0, self.link_b + 1)  # tokens of B before each group
        place_a, place_b = np.arange(len(last_a)) + before_b[group_a], np.arange(len(last_b)) + self.link_a[group_b] + 1
        da, db = self._pair.a.digits, self._pair.b.digits
        width = max(da.shape[1], db.shape[1])
        cells = np.zeros((len(last_a) + len(last_b), width + 1), np.uint8)
        cells[place_a, : da.shape[1]], cells[place_b, : db.shape[1]] = da[self.ids_a], db[self.ids_b]
        cells[place_a, width] = np.where(last_a, ord("|"), ord(","))
        cells[place_b, width] = np.where(last_b, ord(";"), ord(","))
        stop = np.cumsum(self.n_a + self.n_b)
        cells[stop[(self.n_b > 0)] - 1, width] = 0  # nothing after the last group
        used = cells != 0
        lengths = np.append(0, np.cumsum(used.sum(1)))
        return cells[used], np.append(0, lengths[stop])


# ---- over a table ----


def _packed(pair: Pair) -> np.dtype:
    return np.dtype("<u4" if pair.a.size * pair.b.size <= 1 << 32 else "<u8")


def _read(a_path: str, b_path: str) -> tuple[str, bytes]:
    with open(a_path, encoding="utf-8") as f:
        spec = f.read()
    if (json.loads(spec).get("decoder") or {}).get("type") != "ByteLevel":
        raise ValueError("A is to be a byte-level tokenizers .json file")
    with open(b_path, "rb") as f:
        return spec, f.read()


RESULT = ("n_a", "n_b", "n_groups", "n_overlaps", "groups", "links")


def align(docs: DataFrame, a_path: str, b_path: str, text: str = "text", keep: tuple[str | Column, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns of each row with its alignment; map only.

    n_a, n_b: tokens; n_groups: groups; n_overlaps: pairs of tokens that share
    a byte; groups: their ids as ``a1,a2|b1;a3|b2,b3``; links: the pairs of ids
    that end together, one to a group, packed for :func:`pair_counts` and :func:`with_counts`.
    The driver reads both files; their contents travel in a broadcast.
    """
    rows = docs.select(*keep)
    if not set(RESULT).isdisjoint(c.lower() for c in rows.columns):
        raise ValueError(f"{', '.join(RESULT)} are columns of the result")
    schema = rows.withColumns({c: F.lit(0).cast("long") for c in RESULT[:4]} | {"groups": F.lit(""), "links": F.lit(b"")}).schema
    rows = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias(fresh(rows.columns, "__text")))
    files = docs.sparkSession.sparkContext.broadcast(_read(a_path, b_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair(*files.value)
        kind = _packed(pair)
        for b in batches:
            texts = b.column(b.num_columns - 1)
            for lo, hi in row_chunks(buffers(texts)[1], STEP):
                x = Aligned(pair, texts.slice(lo, hi - lo).to_pylist())
                chars, offs = x.groups()
                named = pa.StringArray.from_buffers(hi - lo, pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(chars))
                at = np.append(0, np.cumsum(x.n_groups)) * kind.itemsize
                packed = pa.BinaryArray.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(x.links.astype(kind))])
                counts = [pa.array(n.astype(np.int64)) for n in (x.n_a, x.n_b, x.n_groups, x.n_overlaps)]
                yield pa.RecordBatch.from_arrays([*b.slice(lo, hi - lo).columns[:-1], *counts, named, packed], names=schema.names)

    return rows.mapInArrow(run, schema)


def vocabulary_size(b_path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()


def _unpack(col: pa.Array, n: np.ndarray) -> np.ndarray:
    """The pair of every link of a column of packed links, ``n`` to a row."""
    raw, total = np.frombuffer(b"".join(col.to_pylist()), np.uint8), int(n.sum())
    return raw.view(f"<u{len(raw) // total}").astype(np.int64) if total else np.zeros(0, np.int64)


class Table:
    """Look-up of pairs: open addressing, four places to a pair."""

    def __init__(self, pairs: np.ndarray, n: np.ndarray, best: np.ndarray):
        self.bits = max(4, int(4 * len(pairs)).bit_length())
        self.keys, self.at = np.full(1 << self.bits, -1), np.zeros(1 << self.bits, np.int64)
        self.n, self.best = np.append(n, 0), np.append(best, False)
        todo, step = np.arange(len(pairs)), 0
        while len(todo):
            place = self._place(pairs[todo], step)
            free = self.keys[place] < 0
            self.keys[place[free]] = pairs[todo[free]]  # of several that want a place, the last stays
            took = free & (self.keys[place] == pairs[todo])
            self.at[place[took]] = todo[took]
            todo, step = todo[~took], step + 1

    def _place(self, pairs: np.ndarray, step: int) -> np.ndarray:
        return ((mix(pairs.astype(np.uint64)) >> np.uint64(64 - self.bits)).astype(np.int64) + step) & ((1 << self.bits) - 1)

    def find(self, pairs: np.ndarray) -> np.ndarray:
        """Index of each pair; the table's length where it is not there."""
        out = np.full(len(pairs), len(self.n) - 1)
        todo, step = np.arange(len(pairs)), 0
        while len(todo):
            place = self._place(pairs[todo], step)
            found = self.keys[place]
            hit = found == pairs[todo]
            out[todo[hit]] = self.at[place[hit]]
            todo, step = todo[~hit & (found >= 0)], step + 1
        return out


def _per_row(x: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(x, dtype=np.int64))
    return np.diff(total[np.append(0, ends)])


def _runs(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct pairs in order, how often each is there)."""
    pairs = np.sort(pairs)
    first = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1])) if len(pairs) else np.zeros(0, np.int64)
    return pairs[first], np.diff(np.append(first, len(pairs)))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with their number; a task holds HELD distinct pairs at most, then hands them on."""
    held = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]

    def merged() -> tuple[np.ndarray, np.ndarray]:
        pairs, at = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
        n = np.zeros(len(pairs), np.int64)
        np.add.at(n, at, np.concatenate([c for _, c in held]))
        return pairs, n

    def batch(pairs: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], names=["pair", "n"])

    for b in batches:
        for lo in range(0, b.num_rows, ROWS):
            part = b.slice(lo, ROWS)
            held.append(_runs(_unpack(part.column(0), np.asarray(part.column(1)))))
            if sum(len(p) for p, _ in held) > HELD:
                held = [merged()]
                if 2 * len(held[0][0]) > HELD:
                    yield batch(*held[0])
                    held = held[:0]
    if held:
        yield batch(*merged())


def pair_counts(aligned: DataFrame, b_size: int) -> DataFrame:
    """(pair, a, b, n, best) of every linked pair of ids: its links in the whole table, and whether no pair with its b has more.

    ``b_size`` is the size of B's vocabulary; a table of as many rows at most is broadcast.
    """
    counts = aligned.select("links", "n_groups").mapInArrow(_counted, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = cut_lineage(counts.withColumn("b", F.col("pair") % b_size))
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    found = counts.join(F.broadcast(most), "b")
    return found.select("pair", F.expr(f"pair div {b_size}").alias("a"), "b", "n", (F.col("n") == F.col("most")).alias("best"))


def with_counts(aligned: DataFrame, pairs: DataFrame, row: str, frequent: int | None = None) -> DataFrame:
    """``aligned`` (written, with ``row`` telling its rows apart) without its links, with n_links, n_best and count_sum.

    n_best: links whose pair is the best of its b; count_sum: the counts of all links added up.
    """
    frequent = FREQUENT if frequent is None else frequent
    pairs = cut_lineage(pairs.select("pair", "n", "best"))
    order = [F.desc("n"), F.col("pair")]
    top = pairs.orderBy(*order).limit(frequent).toArrow().sort_by("pair")  # ``frequent`` rows at most
    table = aligned.sparkSession.sparkContext.broadcast(tuple(top.column(c).to_numpy() for c in ("pair", "n", "best")))
    rest = fresh(aligned.columns, "__rest")
    kept = [c for c in aligned.columns if c != "links"]
    out = aligned.withColumn("n_links", F.col("n_groups")).select(*kept, "n_links", F.lit(0).cast("long").alias("n_best"), F.lit(0).cast("long").alias("count_sum"), F.col("links").alias(rest))
    schema = out.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Table(*table.value)
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                part = b.slice(lo, ROWS)
                n = np.asarray(part.column(part.schema.get_field_index("n_groups")))
                pair, ends = _unpack(part.column(part.num_columns - 1), n), np.cumsum(n)
                at = known.find(pair)
                missed = at == len(known.n) - 1
                packed = np.append(0, np.cumsum(_per_row(missed, ends)) * 8).astype(np.int32)
                left = pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(packed), pa.py_buffer(pair[missed].astype("<i8"))])
                yield pa.RecordBatch.from_arrays([*part.columns[:-3], pa.array(_per_row(known.best[at], ends)), pa.array(_per_row(known.n[at], ends)), left], names=schema.names)

    met = out.mapInArrow(run, schema)
    if pairs.count() <= frequent:
        return met.drop(rest)
    rare = pairs.join(F.broadcast(aligned.sparkSession.createDataFrame(pa.table({"pair": top.column("pair")}))), "pair", "left_anti")
    lost = met.where(F.length(rest) > 0).select(row, rest).mapInArrow(_rest_rows, "r long, pair long, m long")
    r, more_best, more_sum = (fresh(met.columns, c) for c in ("__row", "__best", "__sum"))
    more = lost.join(rare, "pair").groupBy(F.col("r").alias(r)).agg(
        F.sum(F.when(F.col("best"), F.col("m")).otherwise(0)).alias(more_best), F.sum(F.col("n") * F.col("m")).alias(more_sum)
    )
    both = met.drop(rest).join(more, F.col(row) == F.col(r), "left")
    added = {c: F.col(c) + F.coalesce(F.col(x), F.lit(0)) for c, x in (("n_best", more_best), ("count_sum", more_sum))}
    return both.withColumns(added).drop(r, more_best, more_sum)


def _rest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, pair, times) of the links that a row's packed rest holds."""
    for b in batches:
        for row, rest in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            pairs, m = np.unique(np.frombuffer(rest.as_py(), "<i8"), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), row)), pa.array(pairs), pa.array(m)], names=["r", "pair", "m"])
