"""Token counts with a two-tier, map-side table of pre-token lengths.

Tier one is a compact table {pre-token: number of tokens} of frequent
pre-tokens, counted over the whole texts of a hash-chosen sample of all rows, in the tasks, and
broadcast once.  Tier two is a bounded cache in each Python worker: a miss is
encoded with the tokenizer itself and remembered.  No pre-token of a counted document is shuffled;
each document is counted where it is read.  What the tables hold changes the
speed only, never a count.

The pre-token pattern is read alike by this module's regular expressions and by the library's
for every character that Unicode has assigned (the tests go through all of them).  Texts
with a code point that it has not, where the two may follow different editions,
or with the string of an added token, are encoded whole by the
tokenizer.  A null text has 0 bytes and 0 tokens, as has an empty one;
repeated rows are counted row by row; an empty table gives an empty table.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents, about, whose whole texts the table of frequent pre-tokens is counted from; speed only.
SAMPLE_DOCS, SEED = 2000, 71
#: Entries of the broadcast table, entries of a worker's cache, and the longest pre-token that is remembered.
FREQUENT, CACHE, LONGEST = 32_000, 400_000, 64

#: Fixed value: the public byte-level pre-token pattern.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters that need no look at their category.
USUAL = re.compile(r"[\t\n\r\x20-\x7e\xa1-ɏ]*").fullmatch


class Lengths(dict):
    """Pre-token -> number of tokens; a missing one is encoded and, within the bound, kept."""

    def __init__(self, tokenizer, frequent: dict[str, int]):
        super().__init__(frequent)
        self.tokenizer, self.frequent = tokenizer, frequent

    def __missing__(self, piece: str) -> int:
        n = len(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        if len(piece) <= LONGEST:
            if len(self) >= len(self.frequent) + CACHE:
                self.clear()
                self.update(self.frequent)
            self[piece] = n
        return n


def _is_byte_level(spec: dict) -> bool:
    pre = spec.get("pre_tokenizer") or {}
    return pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")


class Counts:
    """Counts tokens of one text at a time."""

    def __init__(self, spec: str, frequent: dict[str, int]):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        parsed = json.loads(spec)
        added = [t["content"] for t in parsed.get("added_tokens") or []]
        self.added = re.compile("|".join(map(re.escape, added))).search if added else lambda text: None
        self.byte_level = _is_byte_level(parsed)
        self.pieces = regex.compile(PRE_TOKEN).findall
        self.lengths = Lengths(self.tokenizer, frequent)

    def whole(self, text: str) -> bool:
        """Whether the text is to be encoded as a whole."""
        if not self.byte_level or self.added(text):
            return True
        return not USUAL(text) and any(unicodedata.category(c) == "Cn" for c in set(text))

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        if self.whole(text):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return sum(map(self.lengths.__getitem__, self.pieces(text)))


def frequent_lengths(docs: DataFrame, spec: str, text: str) -> dict[str, int]:
    """Lengths of the FREQUENT most frequent pre-tokens of the sample; a task hands on its most frequent ones only."""
    rate = min(1.0, SAMPLE_DOCS / max(1, docs.count()))
    chance = F.pmod(F.xxhash64(F.col(text), F.lit(SEED)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = docs.where(F.col(text).isNotNull() & (chance < rate)).select(F.col(text).alias("t"))
    shared = docs.sparkSession.sparkContext.broadcast(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = Counts(shared.value, {}), Counter()
        for b in batches:
            for t in b.column(0):
                if not counts.whole(t.as_py()):
                    seen.update(p for p in counts.pieces(t.as_py()) if len(p) <= LONGEST)
                if len(seen) > 8 * FREQUENT:
                    seen = Counter(dict(seen.most_common(2 * FREQUENT)))
        top = seen.most_common(2 * FREQUENT)
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["p", "n"])

    found = sample.mapInArrow(run, "p string, n long").groupBy("p").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "p").limit(FREQUENT).toArrow()
    lengths = Counts(spec, {}).lengths
    return {p: lengths[p] for p in found.column("p").to_pylist()}


def count_tokens(docs: DataFrame, tokenizer_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), limit: int = 512) -> DataFrame:
    """``keep`` columns with n_bytes, n_tokens and over_limit (n_tokens > limit) of each row's whole text.

    ``tokenizer_path`` names a tokenizers .json file that the driver can read;
    its content travels in the broadcast, so executors need no file.
    """
    if not tokenizer_path.endswith(".json"):
        raise ValueError("a tokenizers .json file is needed")
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    tables = docs.sparkSession.sparkContext.broadcast((spec, frequent_lengths(docs, spec, text)))
    rows = docs.select(*[F.col(c) for c in keep], F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.col(text).alias("__text"))
    schema = rows.drop("__text").withColumn("n_tokens", F.lit(0).cast("long")).schema

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counts(*tables.value)
        for b in batches:
            texts = b.column(b.schema.get_field_index("__text"))
            n = pa.array([counter(t.as_py()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], n], names=[*b.schema.names[:-1], "n_tokens"])

    return rows.mapInArrow(count, schema).withColumn("over_limit", F.col("n_tokens") > limit)
