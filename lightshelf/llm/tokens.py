"""Token ids of whole texts, each distinct piece between spaces encoded once per batch of texts.

The ids are those of the `tokenizers` library for the given .json file, without
added special tokens; special strings inside texts are handled as its default.
Byte-level merges never join across a place where white space begins, so texts
are cut there (:func:`lightshelf.llm.common.spaced_words`) and their ids put
together from those of the distinct pieces.

Where a rank file with the same vocabulary is given, plain pieces (characters
below U+0250, at most 200 bytes, no special strings) are encoded in one run of
the rank coder, which gives the same ids in a fifth of the time.
"""

from __future__ import annotations

import base64
import functools
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lightshelf.llm.common import RUN_OF_THREE, give_back, ragged, spaced_words

#: Pieces for the library itself: wider characters, possible special strings, white space at the end.
_WIDE = r"[^\x01-\x{24F}]|<\||[\x09-\x0D\x1C-\x20\x{85}\x{A0}]$"
MOST_BYTES = 200
#: Pieces that the library encodes in one call.
TOGETHER = 4096


@functools.lru_cache(maxsize=2)
def library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(path)
    coder.no_truncation()
    coder.no_padding()
    give_back()
    return coder


@functools.lru_cache(maxsize=2)
def rank_coder(path: str):
    """The coder of a rank file and the number of bytes of each of its ids."""
    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    size = np.zeros(max(ranks.values()) + 1, np.int64)
    for piece, n in ranks.items():
        size[n] = len(piece)
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), size


def encode_pieces(pieces: list[str], path: str, ranks: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces, one after the other, and the number of ids of each."""
    counts = np.zeros(len(pieces), np.int64)
    if not pieces:
        return np.zeros(0, np.uint32), counts
    column = pa.array(pieces, pa.large_string())
    fast = np.zeros(len(pieces), bool)
    if ranks:
        size = pc.binary_length(column).to_numpy().astype(np.int64)
        fast = pc.starts_with(column, " ").to_numpy(zero_copy_only=False) & (size > 1) & (size <= MOST_BYTES)
        fast &= ~pc.match_substring_regex(column, _WIDE).to_numpy(zero_copy_only=False)
    slow = np.flatnonzero(~fast)
    parts: list[np.ndarray] = []
    if len(slow):
        coder = library(path)
        # the library's results hold far more than ids: few pieces at a time
        for a in range(0, len(slow), TOGETHER):
            some = slow[a : a + TOGETHER]
            ids = [np.asarray(e.ids, np.uint32) for e in coder.encode_batch_fast([pieces[i] for i in some.tolist()], add_special_tokens=False)]
            counts[some] = [len(x) for x in ids]
            parts.append(np.concatenate(ids))
    if len(slow) < len(pieces):
        coder, width = rank_coder(ranks)
        rows = np.flatnonzero(fast)
        run = coder.encode_to_numpy("".join([pieces[i] for i in rows.tolist()]), disallowed_special=())
        ends = np.searchsorted(np.cumsum(width[run]), np.cumsum(size[rows])) + 1
        counts[rows] = np.diff(ends, prepend=0)
        parts.append(run.astype(np.uint32))
    order = np.concatenate([slow, np.flatnonzero(fast)])
    flat = np.concatenate(parts)
    if len(slow) in (0, len(pieces)):
        return flat, counts
    starts = np.empty(len(pieces), np.int64)
    starts[order] = np.cumsum(counts[order]) - counts[order]
    return flat[ragged(starts, counts)], counts


def encode_texts(texts: pa.Array, path: str, ranks: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, one after the other, and their offsets (one more than texts)."""
    codes, offsets, pieces = spaced_words(texts, RUN_OF_THREE)
    ids, counts = encode_pieces(pieces, path, ranks)
    starts = np.cumsum(counts) - counts
    out = ids[ragged(starts[codes], counts[codes])]
    ends = np.concatenate([[0], np.cumsum(counts[codes])])
    return out, ends[offsets]


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


