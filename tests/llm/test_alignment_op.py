import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sigspark.llm import alignment
from sigspark.llm.queries import op12_token_alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PAIR = alignment.Pair(*alignment._read(A, B))
TOK = Tokenizer.from_file(A)
TOK.encode_special_tokens = True
SP = sentencepiece.SentencePieceProcessor(model_file=B)
CHARS = alignment._byte_of_char()


def tokens(text):
    """[(id, bytes)] of A and of B, one token at a time; none where they do not give the text back."""
    if not text:
        return [], []
    a = [(i, bytes(CHARS[c] for c in TOK.id_to_token(i))) for i in TOK.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in SP.encode(text):
        p = SP.id_to_piece(i)
        b.append((i, bytes([int(p[3:5], 16)]) if p.startswith("<0x") and p.endswith(">") and len(p) == 6 else p.replace("▁", " ").encode()))
    want = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == want == b"".join(x for _, x in b) else ([], [])


def spans(toks):
    at, out = 0, []
    for i, x in toks:
        out.append((i, at, at + len(x)))
        at += len(x)
    return out


def brute(texts):
    """The contract's columns of each text, by comparing every token with every token near it."""
    rows, counts = [], Counter()
    for text in texts:
        a, b = map(spans, tokens(text))
        links = [(i, k) for i, _, e in a for k, _, f in b if e == f]
        shared = sorted({e for *_, e in a} & {f for *_, f in b})
        groups, low = [], 0
        for e in shared:
            groups.append(",".join(str(i) for i, s, z in a if low <= s and z <= e) + "|" + ",".join(str(i) for i, s, z in b if low <= s and z <= e))
            low = e
        over = sum(s < z2 and s2 < z for _, s, z in a for _, s2, z2 in b)
        counts.update(links)
        rows.append((len(a), len(b), len(shared), links, ";".join(groups), over))
    best = Counter()
    for (_, k), n in counts.items():
        best[k] = max(best[k], n)
    return [
        (na, nb, g, len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(s.encode()).hexdigest() if s else "", over)
        for na, nb, g, links, s, over in rows
    ]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=60), st.lists(st.integers(1, 5), max_size=60), st.integers(1, 9))
def test_any_pieces_give_the_whole_merge(x, y, piece):
    a, b = np.cumsum(np.array(x, int)), np.cumsum(np.array(y, int))
    total = max(a[-1] if len(a) else 0, b[-1] if len(b) else 0)
    a, b = (np.append(v[v < total], total) for v in (a, b))
    end, i, j, shared = alignment.overlaps(a, b, piece)
    want = sorted(set(a.tolist()) | set(b.tolist())) if total else [0]
    assert end.tolist() == want
    assert i.tolist() == [int((a < e).sum()) for e in want] and j.tolist() == [int((b < e).sum()) for e in want]
    assert shared.tolist() == [e in set(a.tolist()) & set(b.tolist()) for e in want]
    left, right = alignment.merge_path(a, b, piece)
    assert (np.diff(left + right)[:-1] == piece).all() and left[-1] == len(a) and right[-1] == len(b)
    assert all(max(a[:p].max(initial=-1), b[:q].max(initial=-1)) <= min(a[p:].min(initial=1 << 40), b[q:].min(initial=1 << 40)) for p, q in zip(left, right, strict=True))


TEXT = st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("aé '\n\t  s1.!<|>▁日")), max_size=40)


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=5), st.integers(1, 7))
def test_any_texts(texts, piece):
    x = alignment.Aligned(PAIR, texts, piece)
    chars, offs = x.groups()
    got = [(int(p), int(q), int(g), int(o), bytes(chars[s:z]).decode()) for p, q, g, o, s, z in zip(x.n_a, x.n_b, x.n_groups, x.n_overlaps, offs[:-1], offs[1:], strict=True)]
    want = brute(texts)
    assert [(r[0], r[1], r[2], r[3]) for r in got] == [(w[0], w[1], w[2], w[7]) for w in want]
    assert [hashlib.sha256(r[4].encode()).hexdigest() if r[4] else "" for r in got] == [w[6] for w in want]


def test_special_strings_are_plain_text():
    for text in ("a<|endoftext|>b", "<s> x </s><unk>", "<0x41>"):
        x = alignment.Aligned(PAIR, [text])
        assert x.n_groups[0] > 0 and 50256 not in x.ids_a and not {0, 1, 2} & set(x.ids_b.tolist())
    assert alignment.Aligned(PAIR, ["▁ x", "ok"]).n_a.tolist()[0] == 0


@pytest.mark.parametrize("text", [" " * 5000 + "x", "a" * 20_000, "\n" * 9000, "1" * 9000, "don't  we'll\u2028 \x1c\x85\u00a0 x", "日本語 テキスト 🙂🏽 ñÑß ǅ"])
def test_ranks_give_the_library_its_ids(text):
    assert PAIR.ranked is not None
    assert PAIR._ids_a(text).tolist() == TOK.encode(text, add_special_tokens=False).ids


def test_every_character_by_ranks():
    cps = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(cps), 8192):
        texts = [f"a{chr(c)}b {chr(c)}1{chr(c)} {chr(c)}{chr(c)}  {chr(c)}\n" for c in cps[k : k + 8192]]
        assert all(PAIR._ids_a(t).tolist() == e.ids for t, e in zip(texts, TOK.encode_batch_fast(texts, add_special_tokens=False), strict=True))


def test_without_ranks_the_library_encodes():
    import json

    spec, model = alignment._read(A, B)
    odd = json.loads(spec)
    odd["model"]["merges"][300], odd["model"]["merges"][301] = odd["model"]["merges"][301], odd["model"]["merges"][300]
    other = alignment.Pair(json.dumps(odd), model)
    assert other.ranked is None and other._ids_a(" hello world").tolist() == TOK.encode(" hello world", add_special_tokens=False).ids


def test_table():
    rng = np.random.default_rng(3)
    pairs = np.unique(rng.integers(0, 10**9, 5000))
    t = alignment.Table(pairs, np.arange(len(pairs)), np.arange(len(pairs)) % 2 == 0)
    asked = np.concatenate([pairs, rng.integers(0, 10**9, 5000)])
    want = {int(p): i for i, p in enumerate(pairs)}
    assert t.find(asked).tolist() == [want.get(int(p), len(pairs)) for p in asked]
    none = alignment.Table(pairs[:0], pairs[:0], pairs[:0] > 0)
    assert none.find(pairs[:3]).tolist() == [0, 0, 0] and none.n.tolist() == [0]


def query(df, frequent=None):
    found = alignment.align(df, A, B, keep=tuple(df.columns)).selectExpr("*", "monotonically_increasing_id() as row_id").checkpoint()
    return alignment.with_counts(found, alignment.pair_counts(found, alignment.vocabulary_size(B)), "row_id", frequent)


@pytest.mark.parametrize("frequent", [None, 7, 0])
def test_rows(spark, odd_documents, frequent):
    df = odd_documents.where("doc_id is null or doc_id not in (6, 8)").selectExpr("*", "'x' as pair", "9 as b", "1 as r", "2 as __rest", "3 as n_best_")
    got = query(df, frequent).collect()
    rows = df.collect()
    want = Counter(zip([r.doc_id for r in rows], [r.source for r in rows], brute([r.text for r in rows]), strict=True))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest() if s else ""
    assert Counter((r.doc_id, r.source, (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, sha(r.groups), r.n_overlaps)) for r in got) == want
    assert set(df.columns) <= set(got[0].asDict())


def test_empty_table_and_wrong_columns(spark, odd_documents):
    assert query(odd_documents.limit(0)).count() == 0
    with pytest.raises(ValueError):
        alignment.align(odd_documents.withColumn("Links", odd_documents.doc_id), A, B, keep=("Links",))
    with pytest.raises(ValueError):
        alignment._read(public_tokenizers.path("word_bpe_49k.json"), B)


def test_pairs_are_counted_in_bounded_steps(monkeypatch):
    monkeypatch.setattr(alignment, "HELD", 10)
    import pyarrow as pa

    rng = np.random.default_rng(2)
    links = [rng.integers(0, 12, rng.integers(0, 30)).astype("<u4") for _ in range(40)]
    batches = [pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in links[k : k + 7]], pa.binary()), pa.array([len(x) for x in links[k : k + 7]], pa.int64())], names=["links", "n_groups"]) for k in range(0, 40, 7)]
    total = Counter()
    for b in alignment._counted(iter(batches)):
        total.update(dict(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)))
    assert total == Counter(np.concatenate(links).tolist())


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = op12_token_alignment(spark, sf)
    assert got.columns[:8] == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    short = [(i, t) for i, t in docs if len(t or "") < 3000]
    rows = {r.doc_id: r for r in got.collect()}
    assert len(rows) == len(docs)
    for (i, _), w in zip(short, brute([t for _, t in short]), strict=True):  # the corpus-wide columns are checked on small tables above
        r = rows[i]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256, r.n_overlaps) == (*w[:4], w[6], w[7])
    assert all(r.n_best <= r.n_links <= r.count_sum for r in rows.values())
