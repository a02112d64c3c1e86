import numpy as np
import pyarrow as pa

from parchment.llm import suffix_tree as st


def test_state_tells_entries_by_their_places():
    """Neither the entry of each token nor the hashes of entries are kept: both follow from the level and the places."""
    rnd = np.random.default_rng(6)
    sizes, word = np.full(40, 50, np.int32), rnd.integers(-1, 30, 2000).astype(np.int32)
    learned, counts, words = (rnd.random(40) < 0.8).astype(np.uint8), rnd.integers(8, 99, 30), rnd.integers(1, 2**63, 30).astype(np.uint64)
    level = st.Level.first(word, learned, counts, words, sizes, 5000)
    on, pair, keys, n, _ = level.pairs()
    at = np.flatnonzero(n >= 2)
    head = [st.pack(sizes), *(st.pack(np.zeros(40, kind)) for kind in st.HEAD[1:])]
    body = [*head, b"1", st.pack(word), st.pack(learned), st.pack(counts), st.pack(words), st.pack(np.diff(at, prepend=0).astype(np.int32)), st.pack(n[at].astype(np.int64))]
    b = st.Block(st._rows(pa.int64(), list(range(40)), block=[7], body=[body]), 5000)
    assert b.entries.tolist() == keys[at].tolist() and b.counts.tolist() == n[at].tolist()
    place = {p: i for i, p in enumerate(at.tolist())}
    want = np.full(len(level.word), -1)
    want[on] = [place.get(p, -1) for p in pair.tolist()]
    assert b.entry.tolist() == want.tolist() and 0 < (want >= 0).sum() < len(want)
