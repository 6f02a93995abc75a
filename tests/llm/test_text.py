import numpy as np
import pyarrow as pa
from corpus_helpers import prose, words

from sigspark.llm.text import Words, buffers, row_chunks, shingles


def test_words_agree_with_the_pattern(rng):
    texts = ["", None, " a  b\tC\n", "É x\x0bY", "ab" * 40, *[" ".join(prose(rng, n)) for n in (1, 5, 300)], "A a", "a", "a"]
    data, offs = buffers(pa.array(texts))
    seen = {}
    for lo, hi in row_chunks(offs, 64):
        w = Words(data, offs, lo, hi)
        h = w.hashes()
        for r in range(hi - lo):
            own = h[w.first_word[r] : w.first_word[r + 1]]
            want = words(texts[lo + r])
            assert len(own) == len(want)
            for a, b in zip(own.tolist(), want, strict=True):
                assert seen.setdefault(b, a) == a
    assert len(set(seen.values())) == len(seen)


def test_buffers_of_slices():
    col = pa.array(["aa", "b", None, "cc dd"]).slice(1)
    data, offs = buffers(col)
    assert [data[a:z].tobytes() for a, z in zip(offs[:-1], offs[1:])] == [b"b", b"", b"cc dd"]


def test_shingles_depend_on_order():
    h = np.array([1, 2, 3, 1, 2], np.uint64)
    s = shingles(h, 2)
    assert s[0] == s[3] and len(set(s.tolist())) == 3 and len(shingles(h, 6)) == 0
