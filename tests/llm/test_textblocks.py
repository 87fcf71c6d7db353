"""Words of blocks and the order of pairs against plain ways; how often pairs are sorted."""

import re

import numpy as np
import pyarrow as pa

from graphloom.llm import suffix_tree, textblocks

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def test_by_table_is_a_lookup():
    data = np.random.default_rng(1).permutation(np.tile(np.arange(256, dtype=np.uint8), 9))
    for table in (textblocks.SPACE, textblocks.LOWER):
        got = textblocks.by_table(data, table)
        assert got.dtype == table.dtype and np.array_equal(got, table[data])
    assert len(textblocks.by_table(data[:0], textblocks.LOWER)) == 0


def test_words_and_their_hashes():
    texts = ["", "Ab\x00\x1f\x7fé\x85 \x0b\x0cÀ", "ends", "Ends again ends", None, " x" * 9, *("long" * n + " " + "y" * n for n in range(1, 60))]
    (block,) = textblocks.blocks(pa.array(texts), 1 << 20)
    starts, ends, first = block.words()
    expected = [WORD.findall((t or "").encode()) for t in texts]
    found = [block.data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
    assert [found[a:b] for a, b in zip(first[:-1], first[1:], strict=True)] == expected
    hashes = textblocks.word_hashes(block.data, starts, ends).tolist()
    assert len(set(zip(found, hashes, strict=True))) == len(set(found)) == len(set(hashes))


def test_pairs_are_ordered_in_two_passes(monkeypatch):
    rng = np.random.default_rng(2)
    passes, sort = [], np.argsort
    part, context = rng.integers(0, 64, 5000), rng.integers(0, 110_000, 5000)
    monkeypatch.setattr(np, "argsort", lambda *a, **k: passes.append(1) or sort(*a, **k))
    got = suffix_tree._order(part, context)
    assert len(passes) == 2  # of 6 and 17 bits
    assert np.array_equal(got, np.lexsort((context, part)))
    wide = rng.integers(0, 1 << 40, 5000)
    assert np.array_equal(suffix_tree._order(part, wide // (1 << 38), wide, context), np.lexsort((context, wide, wide // (1 << 38), part)))
    assert len(suffix_tree._order(part[:0], context[:0])) == 0
