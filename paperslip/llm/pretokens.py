"""The pre-tokens of byte-level BPE, for whole blocks of text at once.

`starts` finds the matches of public_tokenizers.PATTERN (contractions; letters, digits or other signs with
at most one blank before them; white space) with array operations instead of a regular expression per text.
Which code points are letters, digits and white space is asked of the tokenizer library itself.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa

from paperslip.llm.text_arrays import coded, pack

#: A worker remembers the ids of so many short words, about, and then begins anew; this saves time and changes no result.
MEMO = 60_000
_memo: dict[tuple[str, bool], dict[str, list[int]]] = {}
OTHER, LETTER, DIGIT, SPACE = range(4)


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point, as the tokenizer library's own pattern engine sees it."""
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (DIGIT, r"\p{N}"), (SPACE, r"\s")):
        only = tiktoken.Encoding("classes", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        found = bytes(only.encode_ordinary(every)).decode()
        out[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    return out


@lru_cache(maxsize=4)
def encoder(path: str, whole: bool = True):
    """A tokenizer from a file of base-64 tokens and ranks; `whole` takes each given string as one pre-token."""
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=r"(?s:.+)" if whole else public_tokenizers.PATTERN, mergeable_ranks=ranks(path), special_tokens={})


def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def starts(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, first): byte places where pre-tokens start, and per text the index of its first one (one more entry at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(ends), np.int64)
    place = np.flatnonzero((data & 0xC0) != 0x80)
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    if len(points) != len(place):
        raise ValueError("the text is not valid UTF-8")
    n = len(points)
    kind = classes()[points]
    fresh = np.zeros(n + 1, bool)
    fresh[np.searchsorted(place, ends)] = True
    fresh[n] = True
    edge = fresh.copy()
    edge[1:n] |= kind[1:] != kind[:-1]
    run = np.flatnonzero(edge[:n])
    stop = np.append(run[1:], n)
    cut = edge[:n].copy()
    # white space before something else gives up its last sign: a blank joins what follows, any other stands alone
    white = (kind[run] == SPACE) & ~fresh[stop]
    last = stop[white] - 1
    cut[last] = True
    blank = points[last] == 0x20
    cut[last[blank] + 1] = False
    # contractions: an apostrophe at the start of a match, then letters of the list
    mark = run[(kind[run] == OTHER) & (stop - run == 1) & (points[run] == 0x27)]
    mark = mark[cut[mark] & ~fresh[mark + 1]]
    if len(mark):
        wide = np.append(points, [0, 0, 0]).astype(np.int64)
        c1 = wide[mark + 1]
        c2 = np.where(edge[np.minimum(mark + 2, n)], 0, wide[mark + 2])
        one = np.isin(c1, [ord(c) for c in "stmd"])
        two = np.zeros(len(mark), bool)
        for pair in ("re", "ve", "ll"):
            two |= (c1 == ord(pair[0])) & (c2 == ord(pair[1]))
        size = np.where(one, 2, np.where(two, 3, 0))
        hit = mark[size > 0]
        cut[hit + 1] = False
        after = hit + size[size > 0]
        cut[after[after < n]] = True
    at = place[np.flatnonzero(cut)]
    return at, np.searchsorted(at, ends)


def dictionary(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(codes, words): each pre-token as the index of its distinct bytes."""
    return coded(pack(data, at, np.append(at[1:], len(data)) if len(at) else at))


def encode_words(words: pa.Array, path: str, remember: bool = True, whole: bool = True) -> pa.ListArray:
    """The ids of each distinct pre-token, or of each word, which is cut into pre-tokens first, if not `whole`."""
    known, encode = _memo.setdefault((path, whole), {}), encoder(path, whole).encode_ordinary
    if len(known) > MEMO:
        known.clear()
    ids = []
    for w in words.cast(pa.large_string()).to_pylist():
        x = known.get(w)
        if x is None:
            x = encode(w)
            if remember and len(w) < 40:
                known[w] = x
        ids.append(x)
    offsets = np.zeros(len(ids) + 1, np.int32)
    np.cumsum([len(x) for x in ids], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array([i for x in ids for i in x], pa.uint32()))


def rebuilt(ids: pa.ListArray, codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ends): the ids of every text one after another, and where each text's ids end (from 0)."""
    taken = ids.take(pa.array(codes))
    width = np.diff(ids.offsets.to_numpy())[codes] if len(codes) else np.zeros(0, np.int64)
    total = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(width, out=total[1:])
    return taken.flatten().to_numpy(zero_copy_only=False), total[first]
