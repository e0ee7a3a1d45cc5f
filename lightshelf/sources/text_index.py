"""A positional inverted index over texts, kept as tables: built once, extended by batches, asked without reading texts.

`postings` has a row for each word of a field of a row: the places where it
begins.  Files lie in folders by a hash of the word's first two signs (`slot`) within
the folder of their batch, sorted by word, so that a question reads the folders of its
words and in them the stretches that may hold them; a slot that is large has many files.  What a
question about negation must know of a text besides its words is posted
too, under names that no word has: where cues of a negation end, where sentences and lines
end, and whether a text speaks of people or of nobody.

`rows` names the indexed rows and their batch.  A row that comes again in a later
batch counts as it is there; its older postings are passed over.  A batch is
written whole under its own name: one that failed is written again, and one
that has no mark of completion is not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lightshelf.functions import text as T
from lightshelf.plans import parse
from lightshelf.plans import search as P

POSTINGS = "word string, field string, id bigint, starts array<int>, batch string, slot int"
#: Words that a question may put to the plan as they are.
MOST_WORDS = 2000

# Names that no word has: ends of cues and of `no other` (as the beginning of a word or a whole one), cues right before a word with their beginnings, ends of lines and sentences, people and nobody.
CUE, OTHER, WHOLE, AT, AT_START, RULE, LINE, STOP, SOMEBODY, NOBODY = (f"\x01{n}" for n in ("cue", "other", "whole", "at", "from", "rule", "line", "stop", "somebody", "nobody"))
_EVENTS = [
    (CUE, re.compile(r"(?=\b(?P<x>no|without|absence of)\b)"), True),
    (OTHER, re.compile(r"(?=\b(?P<x>no other))"), True),
    (WHOLE, re.compile(r"(?=\b(?P<x>no other)\b)"), True),
    (AT, re.compile(r"(?=\b(?P<x>no visible |without |absence of ))"), True),
    (AT, re.compile(r"(?=\b(?P<x>no ))"), True),
    *((RULE, re.compile(rf"(?=\b(?P<x>{re.escape(n)})\b(?! other))"), True) for n in T.NEGATIONS),
    (LINE, re.compile("(?P<x>[\\n\\r\\x85\\u2028\\u2029])"), False),
    (STOP, re.compile(r"(?P<x>[.;])"), False),
]
_WORD = re.compile(r"\w+")


def _slot(word: str, slots: int) -> int:
    return zlib.crc32(word[:2].encode()) % slots


def _posted(text: str, people: bool) -> dict[str, list[int]]:
    found: dict[str, list[int]] = {}
    for m in _WORD.finditer(text):
        found.setdefault(m[0], []).append(m.start())
    for name, pattern, at_end in _EVENTS:
        for m in pattern.finditer(text):
            found.setdefault(name, []).append(m.end("x") if at_end else m.start("x"))
            if name == AT:
                found.setdefault(AT_START, []).append(m.start("x"))
    if people:
        if any(k in text for k in parse.PEOPLE):
            found[SOMEBODY] = [0]
        first = re.search(P.PEOPLE_NEGATED, text)
        if first and not re.search(P.NO_OTHER, first[0]):
            found[NOBODY] = [0]
    return found


@dataclass
class TextIndex:
    """The index in a folder that all executors share."""

    spark: SparkSession
    path: str
    #: Folders of a batch; the same for all batches of an index.
    slots: int = 64

    def add(self, texts: DataFrame, fields: list[str], batch: str, id_col: str = "id") -> None:
        """Indexes a batch of rows; batches count in the order of their names. A batch that is there already is written anew."""
        described, slots = fields[0], self.slots

        def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in batches:
                out: list[tuple] = []
                for i, field, text in zip(*(rows.column(c).to_pylist() for c in ("id", "field", "text"))):
                    for word, starts in _posted((text or "").lower(), field == described).items():
                        out.append((_slot(word, slots), word, field, i, starts))
                    if len(out) >= 1 << 15:
                        yield _rows(out)
                        out = []
                if out:
                    yield _rows(out)

        long = texts.select(F.col(id_col).cast("bigint").alias("id"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("text")) for f in fields])).alias("f")).select("id", "f.field", "f.text")
        postings = long.mapInArrow(post, "slot int, word string, field string, id bigint, starts array<int>")
        dealt = postings.hint("rebalance", "slot").sortWithinPartitions("slot", "word", "id")
        dealt.write.mode("overwrite").partitionBy("slot").parquet(f"{self.path}/postings/batch={batch}")
        # the rows come last: their mark of completion is the batch's
        long.select("id", "field", (F.length("text") > 0).alias("filled")).write.mode("overwrite").parquet(f"{self.path}/rows/batch={batch}")

    def rows(self) -> DataFrame:
        """id, field, filled and batch of each row as it was indexed last."""
        every = self.spark.read.schema("id bigint, field string, filled boolean, batch string").parquet(f"{self.path}/rows")
        return every.groupBy("id", "field").agg(F.max_by("filled", "batch").alias("filled"), F.max("batch").alias("batch"))

    def postings(self, words: list[str], beginnings: list[str] = (), fields: list[str] | None = None) -> DataFrame:
        """word, field, id and starts of the words, and of those that begin so, in the rows as they were indexed last."""
        if len(words) + len(beginnings) > MOST_WORDS:
            raise ValueError(f"more than {MOST_WORDS} words")
        wanted = F.col("word").isin(list(words))
        for b in beginnings:
            wanted = wanted | F.startswith("word", F.lit(b))
        if all(len(b) > 1 for b in beginnings):
            wanted = wanted & F.col("slot").isin(sorted({_slot(w, self.slots) for w in [*words, *beginnings]}))
        every = self.spark.read.schema(POSTINGS).parquet(f"{self.path}/postings")
        found = every.where(wanted)
        if fields is not None:
            found = found.where(F.col("field").isin(fields))
        rows = self.rows()
        return found.join(rows.select("id", "field", "batch"), ["id", "field", "batch"]).select("word", "field", "id", "starts")

    def dictionary(self) -> DataFrame:
        """Distinct words, without the names that no word has."""
        return self.spark.read.schema("word string").parquet(f"{self.path}/postings").where("word >= ' '").distinct()


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int32())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["slot", "word", "field", "id", "starts"])


def _word(term: str) -> str:
    term = term.lower()
    if not _WORD.fullmatch(term):
        raise ValueError(f"the index holds words, not {term!r}")
    return term


def containing(index: TextIndex, words: list[str], most: int = MOST_WORDS) -> DataFrame:
    """Ids of rows in whose fields together all words stand, be it within others: dictionary words that hold them, then their postings."""
    rows = None
    for w in dict.fromkeys(_word(w) for w in words):
        known = index.dictionary().where(F.contains("word", F.lit(w)))
        few = [r[0] for r in known.limit(most + 1).collect()]
        if len(few) <= most:
            hits = index.postings(few)
        else:  # too many to be named in the plan
            every = index.spark.read.schema("word string, field string, id bigint, batch string").parquet(f"{index.path}/postings").where((F.col("word") >= " ") & F.contains("word", F.lit(w)))
            hits = every.join(index.rows().select("id", "field", "batch"), ["id", "field", "batch"])
        hits = hits.select("id").distinct()
        rows = hits if rows is None else rows.join(hits, "id", "left_semi")
    return index.rows().select("id").distinct() if rows is None else rows


def _near(ends: Column, place: Column, most: int, barriers: Column) -> Column:
    """Whether one of `ends` lies up to `most` signs before the place, with no barrier between."""
    return F.exists(ends, lambda e: (e <= place) & (place - e <= most) & ~F.exists(barriers, lambda b: (b >= e) & (b < place)))


def _by_row(found: DataFrame, asked: list[str], beginnings: list[str]) -> DataFrame:
    """For each row a map from word to places, of rows that have one of the words asked for, not only cues."""
    hit = F.col("word").isin(asked)
    for b in beginnings:
        hit = hit | F.startswith("word", F.lit(b))
    with_one = found.where(hit).select("id").distinct()
    return found.join(with_one, "id", "left_semi").groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("word", "starts"))).alias("m"))


def _at(name: str) -> Column:
    return F.coalesce(F.try_element_at("m", F.lit(name)), F.array().cast("array<int>"))


def _beginning(term: str) -> Column:
    entries = F.map_entries(F.map_filter("m", lambda k, v: F.startswith(k, F.lit(term))))
    return F.flatten(F.transform(entries, lambda e: e["value"]))


def description_scores(index: TextIndex, query: str, field: str = "description") -> DataFrame:
    """id and score of every indexed row, as `plans.search.description_score` gives from the text; words of the query are single words."""
    words = query.lower().split()
    terms = {w: list(dict.fromkeys(_word(t) for t in [*T.stems(w), *parse.expanded(w)])) for w in words}
    every = list(dict.fromkeys(t for ts in terms.values() for t in ts))
    people = parse.mentions_people(query)
    rows = index.rows().where(F.col("field") == field)
    if not words:
        return rows.select("id", F.lit(0.0).alias("score"))
    asked = every + ([SOMEBODY, NOBODY] if people else [])
    found = _by_row(index.postings([*asked, CUE, OTHER, WHOLE, AT, AT_START, LINE], every, [field]), asked, every)
    lines = _at(LINE)

    def present(t: str) -> Column:
        return F.exists(_at(t), lambda s: ~_near(_at(CUE), s, 30, lines) | _near(_at(WHOLE), s, 30, lines))

    # a cue right before a word that begins with the term, if no `no other` stands close before the cue
    cues = F.arrays_zip(_at(AT_START).alias("a"), _at(AT).alias("b"))
    free = F.transform(F.filter(cues, lambda c: ~_near(_at(OTHER), c["a"], 9, lines)), lambda c: c["b"])
    held = F.transform(F.filter(cues, lambda c: _near(_at(OTHER), c["a"], 9, lines)), lambda c: c["b"])
    free = F.array_except(free, held)
    negated = F.lit(False)
    for t in every:
        negated = negated | F.arrays_overlap(_beginning(t), free)
    hits = {w: F.lit(False) for w in words}
    for w, ts in terms.items():
        for t in ts:
            hits[w] = hits[w] | present(t)
    n = sum((hits[w].cast("int") for w in words), F.lit(0))
    score = F.when(negated, P.NEGATED)
    if people:
        score = score.when((F.size(_at(NOBODY)) > 0) | (F.size(_at(SOMEBODY)) == 0), P.NEGATED)
    score = score.when(n == len(words), P.ALL_WORDS).when(n == 0, P.NO_WORDS).otherwise(0.0)
    scored = found.select("id", score.alias("score"))
    other = P.NEGATED if people else P.NO_WORDS  # of texts without any of the words
    return rows.join(scored, "id", "left").select("id", F.when(F.coalesce("filled", F.lit(False)), F.coalesce("score", F.lit(other))).otherwise(0.0).alias("score"))


def excluded(index: TextIndex, terms: list[str], expansions: dict[str, list[str]] | None = None, field: str = "description") -> DataFrame:
    """Ids of rows that name one of the terms outside of a negation, as `functions.text.contains_excluded` finds in the text."""
    every = list(dict.fromkeys(_word(s) for t in terms for s in T.stems(t, expansions)))
    found = _by_row(index.postings([*every, RULE, STOP], fields=[field]), every, [])
    hit = F.lit(False)
    for t in every:
        hit = hit | F.exists(_at(t), lambda s: ~_near(_at(RULE), s, 30, _at(STOP)))
    return found.where(hit).select("id")
