"""Language of a text by cross-parsing: the language whose text explains it in the fewest phrases.

For each language a suffix automaton of labelled text holds all its substrings. A text is parsed into phrases,
each the longest match from where the last one ended. Phrases per character times log2 of the labelled text's
length estimates bits per character under that language; the smallest estimate wins."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ledgerloom.llm.common import id_remainder, slices, without

#: Labelled documents taken per language, characters of all automata together and of one at most.
TRAIN_DOCS, ALL_CHARS, LANGUAGE_CHARS = 24, 400_000, 40_000
#: Characters of a piece of a labelled document that is longer than its part of the bound.
PIECE = 250
#: A text is parsed in segments of so many characters side by side; each begins a new phrase.
SEGMENT = 256


def training_text(docs: DataFrame, divisor: int = 4, held_out: int = 2) -> dict[str, str]:
    """Text per language from labelled rows whose id remainder is not ``held_out``.

    The sample is bounded for the fit alone: the ``TRAIN_DOCS`` rows of a language whose ids hash lowest, kept
    per task before anything is shuffled. They divide the characters of a language among them. A language without letters in its sample is not learnt."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (id_remainder(F.col("doc_id"), divisor) != held_out))
    order = W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), F.xxhash64("text"))
    best = known.select("lang", "doc_id", "text").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= TRAIN_DOCS)
    texts: dict[str, list[str]] = {}
    for row in sorted(best.collect(), key=lambda r: (r["lang"], r["nth"])):
        texts.setdefault(row["lang"], []).append(row["text"])
    share = min(LANGUAGE_CHARS, ALL_CHARS // max(len(texts), 1))
    joined = {lang: divided([folded(p) for p in parts], share) for lang, parts in texts.items()}
    return {lang: text for lang, text in joined.items() if text.strip()}


def divided(parts: list[str], share: int) -> str:
    """At most ``share`` characters of all ``parts``: short ones whole, of longer ones equally many in pieces from their whole length."""
    taken, room = [""] * len(parts), share
    for left, i in zip(range(len(parts), 0, -1), sorted(range(len(parts)), key=lambda i: len(parts[i])), strict=True):
        quota, part = room // left, parts[i]
        if len(part) + 1 > quota:
            count = max(1, quota // PIECE)
            size = max(quota // count - 1, 0)
            part = " ".join(part[at : at + size] for at in np.linspace(0, len(part) - size, count).astype(int).tolist())
        taken[i] = part
        room -= min(len(part) + 1, room)
    return " ".join(t for t in taken if t)[:share]


def folded(text: str) -> str:
    """Small letters; anything but letters is a blank."""
    return "".join(c if c.isalpha() else " " for c in text.lower())


def automaton(text: np.ndarray, letters: int) -> np.ndarray:
    """Transitions of the suffix automaton of a code sequence: state by letter, -1 where there is none."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for code in text.tolist():
        state = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at != -1 and code not in moves[at]:
            moves[at][code] = state
            at = link[at]
        if at != -1:
            target = moves[at][code]
            if length[target] == length[at] + 1:
                link[state] = target
            else:
                copy = len(moves)
                moves.append(dict(moves[target]))
                length.append(length[at] + 1)
                link.append(link[target])
                while at != -1 and moves[at].get(code) == target:
                    moves[at][code] = copy
                    at = link[at]
                link[target] = link[state] = copy
        last = state
    table = np.full((len(moves), letters), -1, np.int32)
    for state, out in enumerate(moves):
        table[state, list(out)] = list(out.values())
    return table


class Parser:
    """Automata of all languages over one alphabet, and the parse of many texts at once."""

    def __init__(self, texts: dict[str, str]):
        self.languages = sorted(texts)
        alphabet = sorted({c for t in texts.values() for c in t} | {" "})
        # code 0: a letter in no labelled text; it matches nothing
        self.code = np.zeros(0x110000, np.uint16)
        self.code[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
        self.fold = {}
        self.tables, self.bits = [], []
        for lang in self.languages:
            codes = self.code[np.frombuffer(texts[lang].encode("utf-32-le"), np.uint32)]
            self.tables.append(automaton(codes, len(alphabet) + 1))
            self.bits.append(np.log2(max(len(codes), 2)))

    def codes(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = self.code[points]
        blank = self.code[32]
        for point in np.unique(points[codes == 0]).tolist():
            if point not in self.fold:
                self.fold[point] = chr(point).isalpha()
            if not self.fold[point]:
                codes[points == point] = blank
        return codes

    def phrases(self, codes: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text under each language, all segments of all texts in step."""
        counts = [max(1, -(-len(c) // SEGMENT)) for c in codes]
        grid = np.zeros(sum(counts) * SEGMENT, np.uint16)
        live = np.zeros(len(grid), bool)
        starts = np.concatenate([[0], np.cumsum(counts)]) * SEGMENT
        for start, c in zip(starts.tolist(), codes, strict=False):
            grid[start : start + len(c)] = c
            live[start : start + len(c)] = True
        steps, alive = np.ascontiguousarray(grid.reshape(-1, SEGMENT).T), np.ascontiguousarray(live.reshape(-1, SEGMENT).T)
        found = np.empty((len(codes), len(self.languages)))
        for k, table in enumerate(self.tables):
            letters, flat = table.shape[1], table.ravel()
            state = np.zeros(steps.shape[1], np.int64)
            total = np.zeros(steps.shape[1], np.int64)
            for code, on in zip(steps, alive, strict=True):
                moved = flat[state * letters + code]
                miss = moved < 0
                # a phrase ends before a character that it cannot take; the character starts the next one
                again = np.maximum(flat[code], 0)
                state = np.where(miss, again, moved).astype(np.int64)
                total += miss & on
            found[:, k] = np.add.reduceat(total + 1, starts[:-1] // SEGMENT) * self.bits[k]
        return found


_WORKER: dict[int, Parser] = {}


def identify(docs: DataFrame, texts: dict[str, str], text: str = "text") -> DataFrame:
    """``docs`` without its text, plus ``lang_pred`` and ``score``.

    A null text and one without letters get ``und`` and 0. Ties go to the smaller name. The score is the runner-up's share of the
    two smallest estimates (0.5 for a tie), 1 where one language is known, 0 where none is. Whole texts are
    parsed, in the task that reads them; input columns named like the results are replaced."""
    kept = without(docs, "lang_pred", "score", text).columns
    ready = docs.select(*kept, F.col(text).cast("string").alias("lang_pred"))
    shared, key, names = docs.sparkSession.sparkContext.broadcast(texts), hash(tuple(sorted(texts.items()))), [*kept, "lang_pred", "score"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _WORKER:
            _WORKER.clear()
            _WORKER[key] = Parser(shared.value)
        parser = _WORKER[key]
        for batch in slices(batches, 512):
            found = [t if t and any(map(str.isalpha, t)) else None for t in batch.column(len(kept)).to_pylist()]
            names_of, scores = ["und"] * len(found), [0.0] * len(found)
            rows = [i for i, t in enumerate(found) if t is not None]
            if rows and parser.languages:
                bits = parser.phrases([parser.codes(found[i]) for i in rows])
                best = np.argmin(bits, axis=1)
                lowest = np.sort(bits, axis=1)
                share = lowest[:, 1] / (lowest[:, 0] + lowest[:, 1]) if bits.shape[1] > 1 else np.ones(len(rows))
                for i, b, s in zip(rows, best.tolist(), share.tolist(), strict=True):
                    names_of[i], scores[i] = parser.languages[b], s
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(names_of, pa.string()), pa.array(scores, pa.float64())], names=names)

    return ready.mapInArrow(run, StructType([*ready.schema.fields[: len(kept)], StructField("lang_pred", StringType()), StructField("score", DoubleType())]))


def languages(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred`` and ``score`` of every document."""
    found = identify(docs.select("doc_id", "text"), training_text(docs))
    return found.select("doc_id", (id_remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
