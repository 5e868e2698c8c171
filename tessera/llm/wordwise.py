"""Whole-text tokenisation by distinct words.

A tokenizer whose pre-tokens never cross white space, and that drops white space, gives a text the ids of its words in
turn. So a block's distinct words are encoded once each and the results are put together with numpy.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .textblocks import Block, distinct_spans, ranges

#: Takes words that follow one another (bytes, sizes); gives all their ids in turn and how many each has.
EncodeWords = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def encoded(block: Block, encode_words: EncodeWords) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts of a block in turn, and where each text's begin (one bound more than texts)."""
    if not len(block.starts):
        return np.zeros(0, np.int32), np.zeros(len(block) + 1, np.int64)
    first, place = distinct_spans(block.data, block.starts, block.ends)
    sizes = (block.ends - block.starts)[first]
    flat, counts = encode_words(block.data[ranges(block.starts[first], sizes)], sizes)
    begin, n = (np.cumsum(counts) - counts)[place], counts[place]
    total = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=total[1:])
    return flat[ranges(begin, n)], total[block.word_bounds]
