"""Values of the units of many texts at once: a batch's distinct units are looked up once, Arrow lays the values out."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def split(texts: pa.LargeStringArray, first: bool, odd: str | None = None, blanks: str = ""):
    """Distinct parts of *texts* between blanks (and characters in *blanks*), each part's place in them, the number of parts
    of each text, each text's first part (kept apart with *first*), and which texts have a part that fits *odd*."""
    for c in blanks:
        texts = pc.replace_substring(texts, c, " ")
    cut = pc.split_pattern(texts, " ")
    starts = cut.offsets.to_numpy()
    starts, size, parts, heads = starts[:-1] - starts[0], np.diff(starts), cut.flatten(), []
    if first:
        heads = parts.take(pa.array(starts)).to_numpy(zero_copy_only=False).tolist()
        keep = np.ones(len(parts), bool)
        keep[starts] = False
        parts, size = parts.filter(pa.array(keep)), size - 1
    known = parts.dictionary_encode()
    places, names = known.indices.to_numpy(zero_copy_only=False).astype(np.int64), known.dictionary.to_numpy(zero_copy_only=False).tolist()
    apart = np.zeros(len(texts), bool)
    if odd:
        bad = pc.match_substring_regex(known.dictionary, odd).to_numpy(zero_copy_only=False)
        apart[np.repeat(np.arange(len(texts)), size)[bad[places]]] = True
    return names, places, size, heads, apart


def by_units(
    texts: pa.Array,
    units: Callable[[list[str]], list[bytes]],
    whole: Callable[[str], bytes],
    special: list[str],
    first: Callable[[str], bytes] | None = None,
    odd: str | None = None,
    end: bytes = b"",
    blanks: str = "",
) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all *texts* one after the other, and where each text's begin (with the last's end).

    A text is cut at every blank, and at the characters in *blanks*; *units* gives the values of distinct parts. With *first*, a text's first part goes there
    (if it isn't empty). Texts with a *special* token or a part that fits the pattern *odd* go to *whole*. *end* follows each text; null is empty.
    """
    texts, n = texts.cast(pa.large_string()).fill_null(""), len(texts)
    names, places, size, heads, apart = split(texts, bool(first), odd, blanks)
    for s in special:
        apart |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
    # Entries: the distinct parts, what each text begins with, the end, nothing.
    head = [first(h) if h else b"" for h in heads] if first else [b""] * n
    for i in np.flatnonzero(apart).tolist():
        head[i] = whole(texts[i].as_py())
    if apart.any():
        places[np.repeat(apart, size)] = len(names) + n + 1
    entries = pa.array([*units(names), *head, end, b""], pa.large_binary())
    begin = np.cumsum(size + 2) - (size + 2)
    inner, order = np.ones(int((size + 2).sum()), bool), np.empty(int((size + 2).sum()), np.int64)
    inner[begin] = inner[begin + size + 1] = False
    order[begin], order[begin + size + 1] = len(names) + np.arange(n), len(names) + n
    order[inner] = places
    laid = entries.take(pa.array(order))
    at = np.frombuffer(laid.buffers()[1], np.int64)[laid.offset : laid.offset + len(laid) + 1]
    data = np.frombuffer(laid.buffers()[2], np.uint8) if laid.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], np.append(at[begin], at[-1]) - at[0]
