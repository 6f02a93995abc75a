"""Quality rules: a decision list over text statistics, learned from labelled rows.

Statistics are whole numbers counted over whole texts where they lie; shares of
them are plain column expressions (``FEATURES``).  The list is learned on the
driver by sequential covering.  A rule for the rarer label grows on two thirds of the
labelled rows that no earlier rule covers: threshold conditions are added one by
one, each time the one with the largest gain in information.  It is pruned on the other third: its last
conditions go as long as that does not lower (right - wrong) / (right + wrong) there.  It joins the list if it is pure
enough on all rows it covers, which are then taken out; the first rule that is not ends the list.

The result is interpretable: an ordered list of conjunctions such as
``symbols >= 0.31 and n_words >= 24``, emitted as one Spark conditional
expression (``DecisionList.column``), so a verdict is generated code over the
statistics.  Nothing of a text's id, source, language or label enters a verdict.

Words are runs of bytes other than space and 0x09-0x0D, told apart by
case; a line holds what lies between two line feeds.  Windows, lines and words are
compared by 64-bit hashes of their bytes.

Defined results: a null text has no words, as has an empty or blank one, and
all counts are 0; shares over nothing are 0.  Rows are judged one by one, also
repeated ones.  Without labelled rows of both kinds the list is empty and
gives the label that is there (1 without any).  An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lookup import fresh
from .text import Words, buffers, mix, row_chunks, shingles

#: Bound on the labelled rows that the list is learned from (chosen by a hash of the id).
MAX_LABELLED = 12_000
#: Words of a repeated window.
WINDOW = 5
#: Rules of a list, conditions of a rule, least rows that a rule covers rightly, and share of its rows that are to be right.
MAX_RULES, MAX_CONDITIONS, LEAST_ROWS, PURE = 16, 4, 4, 0.97
SEED = 61

STATISTICS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_distinct", "n_doubled", "n_upper", "n_digits", "n_ended", "n_wordless",
)


def _share(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)


#: What conditions are about, over the columns of :func:`statistics`.
FEATURES = {
    "words": ("n_words", None),
    "word_length": ("word_chars", "n_words"),
    "symbols": ("n_symbols", "n_words"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "line_words": ("n_words", "n_lines"),
    "distinct": ("n_distinct", "n_words"),
    "doubled": ("n_doubled", "n_words"),
    "upper": ("n_upper", "word_chars"),
    "digits": ("n_digits", "word_chars"),
    "ended": ("n_ended", "n_words"),
    "wordless": ("n_wordless", "n_words"),
}


def feature(name: str) -> Column:
    part, whole = FEATURES[name]
    return F.col(part).cast("double") if whole is None else _share(part, whole)


def _bytes(chars: bytes, also: range = range(0)) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[*chars, *also]] = True
    return out


_AS_IS = np.arange(256, dtype=np.uint8)
_FEED = _bytes(b"\n")
_SYMBOL = _bytes(b"#*$%&|<>")
_END = _bytes(b".,;:!?")
_UPPER, _DIGIT = _bytes(b"", range(65, 91)), _bytes(b"", range(48, 58))
_LETTER = _bytes(b"", [*range(65, 91), *range(97, 123), *range(128, 256)])
_LATER = _bytes(b"", range(0x80, 0xC0))  # bytes of a character after its first


def _again(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the keys that stand there more than once: all of them, and all but one of each."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    every = np.zeros(len(keys), bool)
    every[order[1:][same]] = every[order[:-1][same]] = True
    return np.flatnonzero(every), order[1:][same]


def counts(data: np.ndarray, offs: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """(rows, STATISTICS) of the texts lo..hi."""
    w = Words(data, offs, lo, hi, fold=_AS_IS)
    rows, raw = w.rows, w.bytes
    out = dict.fromkeys(STATISTICS, np.zeros(rows, np.int64))
    if not len(w):
        return np.stack(list(out.values()), 1)
    salt = mix(np.arange(1, rows + 1, dtype=np.uint64))  # the same window of two texts has two keys
    row = np.repeat(np.arange(rows), w.n_words)
    per_row = lambda r: np.bincount(r, minlength=rows)
    first, last = w.start, w.stop - 1

    def chars(kind: np.ndarray) -> np.ndarray:
        """Bytes of a kind in each word."""
        n = np.concatenate([[0], np.cumsum(kind[raw])])
        return n[w.stop] - n[first]

    def per_text(x: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(x)])
        return total[w.first_word[1:]] - total[w.first_word[:-1]]

    out["n_words"] = w.n_words
    out["word_chars"] = per_text(w.lens - chars(_LATER))
    out["n_symbols"], out["n_upper"], out["n_digits"] = (per_text(chars(k)) for k in (_SYMBOL, _UPPER, _DIGIT))
    out["n_wordless"] = per_row(row[chars(_LETTER) == 0])
    out["n_ended"] = per_row(row[_END[raw[last]]])
    h = w.hashes()
    out["n_doubled"] = per_row(row[1:][(h[1:] == h[:-1]) & (row[1:] == row[:-1])])
    out["n_distinct"] = w.n_words - per_row(row[_again(h ^ salt[row])[1]])

    begin = np.flatnonzero(np.arange(len(h)) + WINDOW <= w.first_word[1:][row])
    twice = begin[_again(shingles(h, WINDOW)[begin] ^ salt[row[begin]])[0]]
    step = np.zeros(len(h) + 1, np.int64)
    step[twice] += 1
    np.add.at(step, twice + WINDOW, -1)
    out["n_repeat_words"] = per_row(row[np.cumsum(step[:-1]) > 0])

    line = Words(data, offs, lo, hi, _FEED, _AS_IS)
    line_row = np.repeat(np.arange(rows), line.n_words)
    solid = np.concatenate([[0], np.cumsum(w._solid)])
    worded = solid[line.stop] > solid[line.start]
    line_row, keys = line_row[worded], (line.hashes() ^ salt[line_row])[worded]
    out["n_lines"] = per_row(line_row)
    out["n_dup_lines"] = per_row(line_row[_again(keys)[1]])
    return np.stack(list(out.values()), 1).astype(np.int64)


def statistics(docs: DataFrame, text: str = "text", keep: tuple[str | Column, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and the STATISTICS (long) of each row's whole text."""
    rows = docs.select(*keep)
    if not set(STATISTICS).isdisjoint(c.lower() for c in rows.columns):
        raise ValueError(f"{', '.join(STATISTICS)} are columns of the result")
    schema = rows.withColumns({c: F.lit(0).cast("long") for c in STATISTICS}).schema
    rows = docs.select(*keep, F.col(text).alias(fresh(rows.columns, "__text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = buffers(b.column(b.num_columns - 1))
            found = [counts(data, offs, lo, hi) for lo, hi in row_chunks(offs)]
            table = np.concatenate(found) if found else np.zeros((0, len(STATISTICS)), np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *[pa.array(c) for c in np.ascontiguousarray(table.T)]], names=schema.names)

    return rows.mapInArrow(run, schema)


# ---- the list ----


@dataclass(frozen=True)
class Condition:
    name: str
    at_least: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.name] >= self.threshold if self.at_least else x[self.name] < self.threshold

    def column(self) -> Column:
        c = feature(self.name)
        return c >= self.threshold if self.at_least else c < self.threshold

    def __str__(self) -> str:
        return f"{self.name} {'>=' if self.at_least else '<'} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.holds(x)
    return out


@dataclass
class DecisionList:
    """Rules tried in order; the first that holds gives ``label``, and a row that none holds for gets ``default``."""

    rules: list[Rule] = field(default_factory=list)
    label: int = 0
    default: int = 1

    def column(self) -> Column:
        """The label, as one conditional expression over the columns of :func:`statistics`."""
        return self._chain([F.lit(self.label)] * len(self.rules), F.lit(self.default))

    def rule_column(self) -> Column:
        """1-based place of the rule that decided; 0 for the default."""
        return self._chain([F.lit(i + 1) for i in range(len(self.rules))], F.lit(0))

    def _chain(self, values: list[Column], otherwise: Column) -> Column:
        out = None
        for rule, v in zip(self.rules, values, strict=True):
            whole = F.lit(True)
            for c in rule:
                whole = whole & c.column()
            out = F.when(whole, v) if out is None else out.when(whole, v)
        return otherwise if out is None else out.otherwise(otherwise)

    def __str__(self) -> str:
        return "\n".join([*[f"if {' and '.join(map(str, r))}: {self.label}" for r in self.rules], f"else: {self.default}"])


def _best_condition(x: dict[str, np.ndarray], y: np.ndarray, right0: int, wrong0: int) -> tuple[float, Condition] | None:
    """The condition that brings the most information on rows with labels ``y`` (true: the rule's)."""
    base = np.log2(right0 / (right0 + wrong0))
    best: tuple[float, Condition] | None = None
    for name, v in x.items():
        order = np.argsort(v, kind="stable")
        s = v[order]
        cut = np.flatnonzero(s[1:] > s[:-1]) + 1  # rows below a threshold
        if not len(cut):
            continue
        below = np.cumsum(y[order])[cut - 1].astype(float)
        for at_least, right, total in ((False, below, cut), (True, right0 - below, len(s) - cut)):
            gain = np.where(right > 0, right * (np.log2(np.maximum(right, 1e-9) / total) - base), -np.inf)
            k = int(gain.argmax())
            if gain[k] > 1e-9 and (best is None or gain[k] > best[0] + 1e-9):
                mid = float((s[cut[k] - 1] + s[cut[k]]) / 2)
                best = gain[k], Condition(name, at_least, mid if mid > s[cut[k] - 1] else float(s[cut[k]]))
    return best


def grow(x: dict[str, np.ndarray], y: np.ndarray) -> Rule:
    """Conditions, added while rows of the other label are covered and a condition brings information."""
    rule: Rule = ()
    while y.sum() < len(y) and y.any() and len(rule) < MAX_CONDITIONS:
        found = _best_condition(x, y, int(y.sum()), int((~y).sum()))
        if found is None:
            break
        rule = (*rule, found[1])
        on = found[1].holds(x)
        x, y = {k: v[on] for k, v in x.items()}, y[on]
    return rule


def prune(rule: Rule, x: dict[str, np.ndarray], y: np.ndarray) -> Rule:
    """The shortest beginning of ``rule`` with the best (right - wrong) / (right + wrong) on other rows."""

    def worth(r: Rule) -> float:
        on = covers(r, x, len(y))
        return (2 * y[on].sum() - on.sum()) / on.sum() if on.any() else -1.0

    return max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (worth(r), -len(r)), default=())


def learn(x: dict[str, np.ndarray], y: np.ndarray, seed: int = SEED) -> DecisionList:
    """The list for labels ``y`` (0 or 1) of rows with features ``x``; it has rules for the rarer label."""
    n = len(y)
    if not n or len(set(y.tolist())) < 2:
        return DecisionList([], 0, int(y[0]) if n else 1)
    label = 0 if (y == 0).sum() <= (y == 1).sum() else 1
    out = DecisionList([], label, 1 - label)
    target, left = y == label, np.ones(n, bool)
    rng = np.random.default_rng(seed)
    while (target & left).any() and len(out.rules) < MAX_RULES:
        at = rng.permutation(np.flatnonzero(left))
        third = np.zeros(len(at), bool)
        for kind in (True, False):  # a third of each label
            of = np.flatnonzero(target[at] == kind)
            third[of[: len(of) // 3]] = True
        a, b = at[~third], at[third]
        pick = lambda i: {k: v[i] for k, v in x.items()}
        rule = prune(grow(pick(a), target[a]), pick(b), target[b])
        on = covers(rule, x, n) & left
        right = int((on & target).sum())
        if not rule or right < LEAST_ROWS or right < PURE * on.sum():
            break
        out.rules.append(rule)
        left &= ~on
    return out


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", where: Column | None = None,
) -> DecisionList:
    """Learn from a bounded sample of labelled rows; ``where`` (over the STATISTICS) picks those that a list is to judge."""
    known = labels.select(F.col(id_col).alias("i"), F.col(label).cast("int").alias("y")).where("i is not null and y in (0, 1)")
    chance = F.pmod(F.xxhash64(F.col("i"), F.lit(SEED)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    picked = known.where(chance <= min(1.0, MAX_LABELLED / max(1, known.count()))).orderBy(F.xxhash64("i"), "i", "y").limit(2 * MAX_LABELLED)
    texts = docs.select(F.col(id_col).alias("i"), F.col(text).alias("t")).join(F.broadcast(picked), "i")  # two numbers a row
    found = statistics(texts, "t", ("i", "y")).where(F.lit(True) if where is None else where)
    named = found.select("i", "y", *[feature(k).alias(f"f_{k}") for k in FEATURES])
    by = [F.xxhash64("i"), *[F.col(c) for c in named.columns]]
    sample = named.orderBy(*by).limit(2 * MAX_LABELLED).toArrow()  # an id may stand in many rows
    return learn({k: sample.column(f"f_{k}").to_numpy() for k in FEATURES}, sample.column("y").to_numpy())
