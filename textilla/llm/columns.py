"""Columns of texts split in Arrow, without a Python object per word: what counting words and terms shares."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def split(texts: pa.Array, gap: str) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct pieces, piece number of each occurrence, text of each occurrence) of texts split at the pattern ``gap``.

    Null texts and empty pieces give none. Parts of a batch are split one by one, so that offsets of 32 bits hold.
    """
    lists = pc.split_pattern_regex(texts.cast(pa.large_string()), gap)
    parent = np.asarray(pc.list_parent_indices(lists)).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    codes, values = np.asarray(coded.indices).astype(np.int64), coded.dictionary
    empty = pc.index(values, "").as_py() if len(values) else -1
    if empty >= 0:
        keep = codes != empty
        codes, parent = codes[keep], parent[keep]
    return values, codes, parent


def recoded(names: list[str], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct names, codes into them) where several of ``names`` may be equal."""
    order, back = np.unique(np.array(names, dtype=object), return_inverse=True)
    return order, back.astype(np.int64)[codes] if len(codes) else codes
