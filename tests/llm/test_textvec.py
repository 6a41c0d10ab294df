import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm.textvec import ALNUM, NOT_SPACE, Words, chunks, shingles

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aB1 é\n\t.-\x0b€", max_size=40)), max_size=8)
LOWER = {i: i + 32 for i in range(65, 91)}


def words_of(text, pattern):
    return re.findall(pattern, (text or "").translate(LOWER))


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.integers(1, 60))
def test_words_are_those_of_the_pattern(texts, most):
    for flags, pattern in ((NOT_SPACE, r"[^\x20\x09-\x0D]+"), (ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        found, hashes = [], {}
        for data, offs in chunks(pa.array(texts, pa.string()), most):
            w = Words(data, offs, flags)
            each = [w.bytes[a:b].tobytes().decode() for a, b in zip(w.start, w.end, strict=True)]
            for t, h in zip(each, w.hash.tolist(), strict=True):
                assert hashes.setdefault(t, h) == h
            found += [each[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
        assert found == [words_of(t, pattern) for t in texts]
        assert len(set(hashes.values())) == len(hashes)


@settings(max_examples=100, deadline=None)
@given(TEXTS)
def test_shingle_sets_have_the_right_sizes(texts):
    sizes = []
    for data, offs in chunks(pa.array(texts, pa.string())):
        first, hashes = shingles(Words(data, offs, NOT_SPACE), 3)
        sizes += np.diff(first).tolist()
        assert all((np.diff(hashes[a:b].astype(object)) > 0).all() for a, b in zip(first[:-1], first[1:], strict=True))
    want = []
    for t in texts:
        w = words_of(t, r"[^\x20\x09-\x0D]+")
        want.append(len({tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))}) if w else 0)
    assert sizes == want


def test_sliced_and_large_arrays():
    a = pa.array(["aa bb", None, "cc", "dd ee ff"], pa.large_string()).slice(1, 3)
    (data, offs), = chunks(a)
    assert Words(data, offs, NOT_SPACE).count.tolist() == [0, 1, 3]
