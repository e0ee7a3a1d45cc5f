"""SentencePiece encoding and decoding by a forward pass over a trie of distinct marked words.

Texts are marked (a space becomes the mark, one is put before) and cut into
words that begin with marks; no piece of the vocabulary has a mark behind another
character, so words are encoded by themselves.  The distinct words of a batch
are sorted, which lists the paths of their trie depth first: each word goes on
from the prefix that it shares with the one before, whose forward states are
kept, and only its own characters are new work.

The forward state depends on the model's kind:

* unigram: the best sum of scores of any segmentation of the prefix and its last
  piece (Viterbi);
* bpe: the last piece of the prefix's segmentation.  Merging by score gives the
  only segmentation in which each two neighbouring pieces stay as they are when
  merged by themselves, so the last piece of a prefix is the one piece that ends
  it and is compatible with the last piece of what is before.  A maximal sum of
  scores would not give the library's ids for such models.

Characters outside the vocabulary become their bytes.  Defined results: null and
empty texts have no ids and decode to the empty text; repeated rows and rows with
a null id are encoded each; an empty table gives nothing.  Of pieces with equal
scores the library's choice stands (tested).
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lightshelf.llm.common import plain_strings, ragged, slices, spaced_words

MARK = "▁"
#: Texts that are cut at their marks only: runs of spaces are pieces, and so may a mark of their own be.
KEPT = f"  |{MARK}"
_WORD = re.compile(f"{MARK}+[^{MARK}]*")
#: Distinct words that a process keeps from batch to batch.
KNOWN_WORDS = 300_000
#: The state of a character that is no piece.
NO_PIECE = -1
#: Score of such a character below the least of the pieces, as the library takes it.
PENALTY = 10.0


class Vocabulary:
    """Pieces that text can give, their scores, and the ids of bytes."""

    def __init__(self, pieces: list[tuple[str, float, int]], bytes_: dict[int, int], kind: str, unknown: int = 0) -> None:
        self.kind, self.unknown = kind, unknown
        self.ids = {p: i for p, _, i in pieces}
        self.score = {i: s for _, s, i in pieces}
        self.text = {i: p for p, _, i in pieces}
        self.bytes = bytes_
        # pieces read backwards, as nested tables; a piece's id under ""
        self.endings: dict = {}
        for p, _, i in pieces:
            node = self.endings
            for c in reversed(p):
                node = node.setdefault(c, {})
            node[""] = i
        self.least = min((s for _, s, _ in pieces), default=0.0) - PENALTY
        self.alone: dict[int, bool] = {}
        self.pairs: dict[int, bool] = {}
        self.known: dict[str, list[int]] = {}  # words of batches before

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text by merging the best neighbours until none is left."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                n = self.ids.get(parts[i] + parts[i + 1])
                if n is not None and (best is None or self.score[n] > best):
                    best, at = self.score[n], i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def stays(self, n: int) -> bool:
        """Whether merging gives this piece for its own text."""
        got = self.alone.get(n)
        if got is None:
            got = self.alone[n] = self.merged(self.text[n]) == [self.text[n]]
        return got

    def compatible(self, a: int, b: int) -> bool:
        """Whether pieces a and b stay as they are when their texts are merged together."""
        if a == NO_PIECE:
            return self.stays(b)
        key = a << 32 | b
        got = self.pairs.get(key)
        if got is None:
            if len(self.pairs) > 4_000_000:
                self.pairs.clear()
            x, y = self.text[a], self.text[b]
            got = self.pairs[key] = self.merged(x + y) == [x, y]
        return got


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of the fields of a message in the models' file format."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(raw):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = varint() if key & 7 == 2 else 8 if key & 7 == 1 else 4
        yield key >> 3, raw[at : at + size]
        at += size


# Fixed values of the format: the field of the training settings, that of the model's kind in it, and the kinds read here.
SETTINGS, KIND, KINDS = 2, 3, {1: "unigram", 2: "bpe"}


def model_kind(raw: bytes) -> str:
    """The kind of a model as its file says."""
    settings = b"".join(v for k, v in _fields(raw) if k == SETTINGS)
    number = next((v for k, v in _fields(settings) if k == KIND), 1)
    if number not in KINDS:
        raise ValueError(f"a model of kind {number} is neither unigram nor bpe")
    return KINDS[number]


@functools.lru_cache(maxsize=2)
def vocabulary(path: str, kind: str | None = None) -> Vocabulary:
    """Pieces of a model file; its kind is read from it if none is given."""
    import sentencepiece

    with open(path, "rb") as f:
        raw = f.read()
    kind = kind or model_kind(raw)
    model = sentencepiece.SentencePieceProcessor(model_proto=raw)
    pieces, bytes_ = [], {}
    for i in range(model.get_piece_size()):
        text = model.id_to_piece(i)
        if model.is_byte(i):
            bytes_[int(text[3:5], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            pieces.append((text, model.get_score(i), i))
    return Vocabulary(pieces, bytes_, kind, model.unk_id())


def encode_sorted(words: list[str], v: Vocabulary) -> Iterator[list[int]]:
    """Ids of each of the sorted words (each with its marks), forward states kept along shared prefixes."""
    endings, ids_of, viterbi = v.endings, v.ids, v.kind == "unigram"
    pairs, stays, compatible = v.pairs, v.stays, v.compatible
    last: list[int] = [NO_PIECE]  # by depth: the piece that ends the prefix
    size = [0]  # and its length
    best = [0.0]
    before = ""
    for word in words:
        n = len(word)
        i, most = 0, min(n, len(before))
        while i < most and word[i] == before[i]:
            i += 1
        del last[i + 1 :], size[i + 1 :], best[i + 1 :]
        for end in range(i + 1, n + 1):
            found, length, top = NO_PIECE, 1, -1e300
            node, k = endings, 0
            if viterbi:
                if word[end - 1] not in ids_of:
                    top = best[end - 1] + v.least
                while k < end and (node := node.get(word[end - 1 - k])) is not None:
                    k += 1
                    t = node.get("")
                    if t is not None and (score := best[end - k] + v.score[t]) > top:
                        found, length, top = t, k, score
                best.append(top)
            else:
                while k < end and (node := node.get(word[end - 1 - k])) is not None:
                    k += 1
                    t = node.get("")
                    if t is None:
                        continue
                    if k == end:
                        good = stays(t)
                    else:
                        good = pairs.get(last[end - k] << 32 | t)
                        if good is None:
                            good = compatible(last[end - k], t)
                    if good:
                        found, length = t, k
                        break
            last.append(found)
            size.append(length)
        before = word
        out: list[int] = []
        at = n
        while at:
            if last[at] == NO_PIECE:
                raw = word[at - 1].encode("utf-8", "replace")
                out += [v.bytes.get(b, v.unknown) for b in reversed(raw)] if v.bytes else [v.unknown]
            else:
                out.append(last[at])
            at -= size[at]
        yield out[::-1]


def encode_words(words: list[str], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of marked words (in any order), one after the other, and the number of each."""
    parts = [_WORD.findall(w) for w in words]
    table = v.known
    if len(table) > KNOWN_WORDS:
        table.clear()
    distinct = sorted({p for ps in parts for p in ps if p not in table})
    table.update(zip(distinct, encode_sorted(distinct, v)))
    lists = [table[ps[0]] if len(ps) == 1 else [i for p in ps for i in table[p]] for ps in parts]
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter((i for x in lists for i in x), np.int32, int(counts.sum())), counts


def encode_texts(texts: pa.Array, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, one after the other, and their offsets."""
    begun = pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts, pa.scalar(" ", pa.large_string())))
    codes, offsets, names = spaced_words(begun, KEPT)
    ids, counts = encode_words([w.replace(" ", MARK) for w in names], v)
    starts = np.cumsum(counts) - counts
    ends = np.concatenate([[0], np.cumsum(counts[codes])])
    return ids[ragged(starts[codes], counts[codes])], ends[offsets]


def decode(ids: list[int], v: Vocabulary) -> str:
    """The text of ids; the mark that was put before is taken away again."""
    back = {i: b for b, i in v.bytes.items()}
    raw = b"".join(bytes([back[i]]) if i in back else v.text[i].encode() if i in v.text else " ⁇ ".encode() for i in ids)
    text = raw.decode("utf-8", "replace").replace(MARK, " ")
    return text[1:] if text.startswith(" ") else text


def encode(docs: DataFrame, path: str, kind: str | None = None) -> DataFrame:
    """doc_id, n_ids, ids (array<int>) and round_trip (whether the ids decode to the text) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, kind)
        size = max(*v.text, *v.bytes.values(), v.unknown) + 1
        raw = [b"" if i == v.unknown else v.text[i].encode() if i in v.text else b"" for i in range(size)]
        for b, i in v.bytes.items():
            raw[i] = bytes([b])
        width = np.array([len(r) for r in raw], np.int64)
        flat = np.frombuffer(b"".join(raw), np.uint8)
        starts = np.cumsum(width) - width
        mark = MARK.encode()
        for batch in slices(batches, "text", 8 << 20):
            texts = plain_strings(batch.column("text"))
            ids, offsets = encode_texts(texts, v)
            ok = []
            for text, a, b in zip(texts.to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                n = ids[a:b]
                got = flat[ragged(starts[n], width[n])].tobytes()
                ok.append(got == mark + text.encode().replace(b" ", mark) if text else not len(n))
            column = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets)), column, pa.array(ok, pa.bool_())], ["doc_id", "n_ids", "ids", "round_trip"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_ids bigint, ids array<int>, round_trip boolean")


def decoded(rows: DataFrame, path: str, kind: str | None = None, ids: str = "ids") -> DataFrame:
    """`rows` with a column `decoded`: the text of each row's ids (null for null)."""

    @F.pandas_udf("string")
    def back(column: pd.Series) -> pd.Series:
        v = vocabulary(path, kind)
        return pd.Series([None if x is None else decode(list(x), v) for x in column], dtype=object)

    return rows.withColumn("decoded", back(F.col(ids)))
