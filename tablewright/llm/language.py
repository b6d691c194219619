"""Language identification by cross-parsing against suffix automata.

For every language an automaton holds all substrings of a sample of its labelled
texts.  A document is parsed into phrases, each the longest match with the sample
from where the last one ended; the language that needs the fewest phrases per
character wins.  The parse reads whole texts; many segments of many documents
take each step together.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.llm.common import values_of

#: Bounds of the fitted sample: rows in all (each language has one at least), rows of a language, characters of a row.
SAMPLE_ROWS = 20_480
ROWS_PER_LANGUAGE = 80
CHARS_PER_ROW = 250
#: Entries of all full tables of transitions together; automata beyond are searched by key, with equal results.
FULL_ENTRIES = 1 << 25
#: A text is parsed in segments of this many characters, all languages alike.
SEGMENT = 256
GROUP_CHARS = 1 << 20

PAD, BLANK, UNKNOWN = 0, 1, 2

Samples = tuple[tuple[str, str], ...]


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Samples:
    """A bounded sample per language, ``((language, text), ...)`` in code-point order.

    Rows are drawn by a hash of key and text, so reruns agree, and an excerpt is taken
    from the middle of each.  Copies count once.  Rows without text or language are
    passed over; no rows give no languages.  Up to ``SAMPLE_ROWS`` languages (those with
    most rows) share that many rows, at most ``ROWS_PER_LANGUAGE`` each.
    """
    present = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = present.groupBy(F.col(lang).alias("lang")).count().orderBy(F.desc("count"), "lang").limit(SAMPLE_ROWS)
    names = sorted(r["lang"] for r in counts.collect())
    rows_each = min(ROWS_PER_LANGUAGE, SAMPLE_ROWS // max(1, len(names)))
    start = F.greatest(F.floor(F.char_length(text) / 2) - CHARS_PER_ROW // 2, F.lit(1)).cast("int")
    drawn = present.where(F.col(lang).isin(names)).select(
        F.col(lang).alias("lang"),
        F.substring(F.col(text), start, F.lit(CHARS_PER_ROW)).alias("excerpt"),
        F.xxhash64(key, text).alias("draw"),
    )
    best = Window.partitionBy("lang").orderBy("draw", "excerpt")
    rows = drawn.withColumn("n", F.row_number().over(best)).where(F.col("n") <= rows_each).collect()
    rows.sort(key=lambda r: r["n"])
    found = {name: "\n".join(dict.fromkeys(r["excerpt"] for r in rows if r["lang"] == name)) for name in names}
    return tuple((name, sample) for name, sample in found.items())


class Parser:
    """The automata of all languages, each over the letters of its own sample."""

    def __init__(self, samples: Samples) -> None:
        self.names = [name for name, _ in samples]
        lowered = [sample.lower() for _, sample in samples]
        kept = sorted({c for sample in lowered for c in sample if c.isalpha()})
        kind = np.uint8 if len(kept) <= 250 else np.int32
        self.codes = np.full(0x110000, BLANK, kind)
        self.codes[[c for c in range(0x110000) if chr(c).isalpha()]] = UNKNOWN
        self.codes[[ord(c) for c in kept]] = np.arange(UNKNOWN + 1, UNKNOWN + 1 + len(kept))
        self.automata: list[FullTable | KeyedTable] = []
        left = FULL_ENTRIES
        for sample in lowered:
            codes = self.encode([sample])[0]
            own, local = np.unique(codes[codes > UNKNOWN], return_inverse=True)
            codes = codes.astype(np.int64)
            codes[codes > UNKNOWN] = UNKNOWN + 1 + local
            to_local = np.full(UNKNOWN + 1 + len(kept), UNKNOWN, np.int32)
            to_local[[PAD, BLANK]] = PAD, BLANK
            to_local[own] = np.arange(UNKNOWN + 1, UNKNOWN + 1 + len(own))
            edges, width = automaton(codes), UNKNOWN + 1 + len(own)
            full = (len(edges) + 1) * width <= left
            left -= (len(edges) + 1) * width if full else 0
            self.automata.append((FullTable if full else KeyedTable)(edges, width, to_local))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of lower-case texts, runs of anything but letters as one blank; codes per text."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        codes = self.codes[points]
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != BLANK) | (codes[:-1] != BLANK)
        starts = np.cumsum(lengths) - lengths
        keep[starts[lengths > 0]] = True
        sums = np.concatenate([[0], np.cumsum(keep)])
        return codes[keep], sums[starts + lengths] - sums[starts]

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases per text and language, characters per text, and whether a text has a letter."""
        codes, lengths = self.encode([t.lower() for t in texts])
        owner = np.repeat(np.arange(len(texts)), lengths)
        letters = np.bincount(owner, codes != BLANK, len(texts)) > 0
        segments = -(-lengths // SEGMENT)
        first = np.cumsum(segments) - segments
        n = int(segments.sum())
        grid = np.zeros((n, SEGMENT), self.codes.dtype)
        place = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        grid.ravel()[np.repeat(first * SEGMENT, lengths) + place] = codes
        steps = np.ascontiguousarray(grid.T)
        count = np.zeros((len(texts), len(self.names)))
        segment_owner = np.repeat(np.arange(len(texts)), segments)
        for language, table in enumerate(self.automata):
            found = table.ended(steps)
            # The phrase that is open at the end of a segment counts as well.
            count[:, language] = np.bincount(segment_owner, found + 1, len(texts))
        return count, lengths, letters


def automaton(codes: np.ndarray) -> list[dict[int, int]]:
    """The edges of a suffix automaton, state by state; state 0 is its root."""
    edges: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for code in codes.tolist():
        new = len(edges)
        edges.append({})
        link.append(0)
        length.append(length[last] + 1)
        at = last
        while at >= 0 and code not in edges[at]:
            edges[at][code] = new
            at = link[at]
        if at >= 0:
            target = edges[at][code]
            if length[target] == length[at] + 1:
                link[new] = target
            else:
                copy = len(edges)
                edges.append(dict(edges[target]))
                link.append(link[target])
                length.append(length[at] + 1)
                while at >= 0 and edges[at].get(code) == target:
                    edges[at][code] = copy
                    at = link[at]
                link[target] = link[new] = copy
        last = new
    return edges


def restarts(edges: list[dict[int, int]], width: int) -> np.ndarray:
    """The state after the first code of a phrase; one that the sample lacks leads to a state behind the last."""
    states = np.full(width, len(edges), np.int64)
    states[list(edges[0])] = list(edges[0].values())
    return states


class FullTable:
    """Transitions as ``table[state, code]``.

    A negative entry ``~s`` says that no substring goes on this way: the phrase ends
    and the next one starts in state ``s``.  A code that the sample lacks is a phrase
    of its own.  Padding keeps the state.
    """

    def __init__(self, edges: list[dict[int, int]], width: int, to_local: np.ndarray) -> None:
        restart = restarts(edges, width)
        table = np.empty((len(edges) + 1, width), np.int64)
        table[:] = ~restart
        table[0] = restart
        for state, out in enumerate(edges):
            table[state, list(out)] = list(out.values())
        table[:, PAD] = np.arange(len(edges) + 1)
        self.table = np.where(table >= 0, table * width, ~((~table) * width)).astype(np.int32).ravel()
        self.to_local = to_local

    def ended(self, steps: np.ndarray) -> np.ndarray:
        """Phrases that end within each segment; ``steps`` has one row per place in the segments."""
        state, found = np.zeros(steps.shape[1], np.int32), np.zeros(steps.shape[1], np.int32)
        for step in steps:
            state = self.table[state + self.to_local[step]]
            over = state >> 31  # -1 where a phrase ends before this character
            found -= over
            state ^= over
        return found


class KeyedTable:
    """The same transitions as a sorted list of the edges that there are, for samples of many letters."""

    def __init__(self, edges: list[dict[int, int]], width: int, to_local: np.ndarray) -> None:
        pairs = sorted((state * width + code, to) for state, out in enumerate(edges) for code, to in out.items())
        self.keys = np.array([k for k, _ in pairs] + [len(edges) * width + width], np.int64)
        self.targets = np.array([t for _, t in pairs] + [0], np.int64)
        self.restart, self.width, self.to_local = restarts(edges, width), width, to_local

    def ended(self, steps: np.ndarray) -> np.ndarray:
        state, found = np.zeros(steps.shape[1], np.int64), np.zeros(steps.shape[1], np.int32)
        for step in steps:
            code = self.to_local[step]
            key = state * self.width + code
            place = np.searchsorted(self.keys, key)
            goes_on, padding = self.keys[place] == key, code == PAD
            found += ~goes_on & ~padding & (state != 0)
            state = np.where(padding, state, np.where(goes_on, self.targets[place], self.restart[code]))
        return found


@lru_cache(maxsize=2)
def parser(samples: Samples) -> Parser:
    """One parser per sample and Python worker."""
    return Parser(samples)


def identify(docs: DataFrame, samples: Samples, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` in place of ``text``.

    The score is 1 less the quotient of the fewest and the second fewest phrases (of
    the fewest phrases and the characters, if there is one language only).  Equal
    counts go to the language first in code-point order, with score 0.  A text that is
    null or has no letter, or any text if nothing was learned, gives ``und`` and 0.
    Columns named ``lang_pred`` or ``score`` are replaced, all others stay.  Texts of any
    length are read whole, in segments; an empty table gives an empty result.
    """
    kept = [c for c in docs.columns if c.lower() not in (text.lower(), "lang_pred", "score")]
    rows = docs.select(F.col(text).alias(text), *[F.col(f"`{c}`") for c in kept])
    out = rows.drop(text).schema.add("lang_pred", "string").add("score", "double")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = parser(samples)
        for batch in batches:
            names, scores, group, size = [], [], [], 0
            for value in values_of(batch.column(0)):
                group.append(value or "")
                size += len(group[-1])
                if size >= GROUP_CHARS:
                    answer(model, group, names, scores)
                    group, size = [], 0
            answer(model, group, names, scores)
            arrays = [*batch.columns[1:], pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, out.names)

    return rows.mapInArrow(predict, out)


def answer(model: Parser, texts: list[str], names: list[str], scores: list[float]) -> None:
    if not texts:
        return
    if not model.names:
        names += ["und"] * len(texts)
        scores += [0.0] * len(texts)
        return
    count, lengths, letters = model.phrases(texts)
    best = np.argmin(count, axis=1)
    least = count.min(axis=1)
    second = np.partition(count, 1, axis=1)[:, 1] if len(model.names) > 1 else np.maximum(lengths, least)
    sure = np.where(second > 0, 1 - least / np.maximum(second, 1), 0.0)
    names += [model.names[b] if letter else "und" for b, letter in zip(best.tolist(), letters.tolist())]
    scores += np.where(letters, np.clip(sure, 0, 1), 0.0).tolist()
