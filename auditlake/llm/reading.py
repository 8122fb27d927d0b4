"""Problem 8: the reading level of each document, from 1 (easy) to 4 (most demanding).

Prose is cut into sentences, without code, logs, tables, identifiers and headings. Every sentence gets a distribution
over the levels from a word model and a character model of each level: the share of a word in a level's sentences,
mixed with the probability that a smoothed chain of three characters of that level gives it, which speaks for unknown
words. A document's distribution is the mean of its sentences', by words, and is calibrated on labelled documents that
the models had not seen. How much the models are smoothed is chosen by documents held out. Both models are fitted on a
bounded sample of the labelled documents.
"""

from __future__ import annotations

import math
import random
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.storage import spread

LEVELS = 4
#: Labelled documents on which the models are fitted at most.
SAMPLE = 4000
#: Words of prose of the shortest paragraph of several sentences, and of one without ends of sentences; no single plain sentence is as long.
LEAST_WORDS, LEAST_UNCUT = 30, 42
#: Weights of characters against words, and sharpness of a sentence's distribution, among which held out documents choose;
#: how many of them in each half do, and documents, and a share of them for the shift, by which calibration is held near none: readers who are off by one level
#: shift the outer levels inwards.
GRID = tuple((mixed, sharp) for mixed in (0.15, 0.05, 0.4) for sharp in (0.6, 0.3, 0.15))
SELECTING, PRIOR, SHIFTED = 300, 10, 0.3

FENCED = re.compile(r"```[\s\S]*?(?:```|\Z)")
STAMPED = re.compile(
    r"\d{4}-\d\d-\d\d[T ][\d:.,Z]+\s+\[?(?:ERROR|WARN(?:ING)?|INFO|DEBUG|TRACE|FATAL)\]?\s*(?:\[[^\]\n]*\]\s*)?(?:[a-z' ]+|[A-Z' ]+(?=\s|$))?", re.I
)
THROWN = re.compile(r"(?:[\w$]+\.)+\w*(?:Exception|EXCEPTION|Error|ERROR)\b:?[ ]?(?:[a-z' ]+|[A-Z' ]+(?=\s|$))?|\b[aA][tT] (?:[\w$]+\.)+[\w$<>]+\([^)\n]*\)")
TABLED = re.compile(r"\|[^\n]*\|")
NAMED = re.compile(r"\(see [^)\n]*\(\)\)|(?:: |, as in |\bsee )[A-Za-z]\w*[.#]\w+(?:\(\))?", re.I)
CODE_START = re.compile(r"\s*(?:def|class|return|import|from|for|if|while|const|let|var|public|private|function)\b[^.!?]*[({:=]|\s*[\w.\[\]]+\s*[-+*]?=[^=]")
CODE_CALL = re.compile(r"\w\(.*\)\s*:?$")
HEADING = re.compile(r"^[ \t]*#+ [^\n]{0,80}$|^[ \t]*\[[A-Z]+-\d[^\]\n]*\][^\n]{0,60}$", re.M)
RULE = re.compile(r"\[?\b[A-Z]+-\d{3}(?:-[A-Z]+)*\]?\s*(?:/\s*)?(?:[A-Z]\w*[a-z][A-Z]\w*:?)?")
SENTENCE = re.compile(r"(?<=[.!?])[\"')\]]*\s+")
WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
ODD = re.compile(r"[#_\\/(){}\[\]=<>|`@$%^~\d]|\w\.\w|[a-zß-ÿ][A-Z]")

def is_code(line: str) -> bool:
    """Whether a line, of any length, begins or ends as a line of code does."""
    end = line.rstrip()[-1:]
    if end and end in "{};" or CODE_START.match(line):
        return True
    return end in (")", ":") and "(" in line and bool(CODE_CALL.search(line.rstrip()))


_tokens: dict[str, tuple[str, ...]] = {}


def _words_of(token: str) -> tuple[str, ...]:
    """The words of a token between spaces, in lower case; none if it is code. Kept for the next time, up to a bound."""
    if len(_tokens) > 300_000:
        _tokens.clear()
    found = _tokens[token] = () if ODD.search(token) else tuple(w.lower() for w in WORD.findall(token))
    return found


def sentences(text: str) -> list[list[str]]:
    """The sentences of running prose in a text, as lists of words in lower case."""
    if "```" in text:
        text = FENCED.sub(" ", text)
    if ":" in text:
        text = STAMPED.sub(" ", text)
    if "xception" in text or "XCEPTION" in text:
        text = THROWN.sub(" ", text)
    if "|" in text:
        text = TABLED.sub(" ", text)
    if "#" in text or "[" in text:
        text = HEADING.sub(" ", text)
    if "-" in text:
        text = RULE.sub(" ", text)
    if "(" in text or ": " in text or "#" in text:
        text = NAMED.sub(" ", text)
    lines = [line for line in text.split("\n") if not is_code(line)]
    known, out = _tokens, []
    for sentence in SENTENCE.split("\n".join(lines).replace("\n\n", ". \n").replace("\n", " ")):
        parts = sentence.split()
        words: list[str] = []
        for p in parts:
            words += known[p] if p in known else _words_of(p)
        if len(words) >= 3 and len(words) >= 0.6 * len(parts):
            out.append(words)
    return out


class LevelModel:
    """Word and character models by level and the calibration of a document's distribution."""

    def __init__(self, documents: list[tuple[list[list[str]], float]], order: int = 3):
        """documents: sentences and the mean label of each.

        The weight of characters against words and the sharpness are those of GRID that make the labels of documents
        held out most likely; so is the calibration, which is held near none by PRIOR documents.
        """
        self.order = order
        self.mixed, self.sharp = GRID[0]
        rounded = [(s, min(LEVELS, max(1, int(level + 0.5)))) for s, level in documents if s]
        random.Random(0).shuffle(rounded)
        self.levels = sorted({level for _, level in rounded})
        likely: dict[tuple[float, float], float] = defaultdict(float)
        for fold in (0, 1):
            self._count(rounded[1 - fold :: 2])
            for setting in GRID:
                if setting[0] != self.mixed:
                    self.known.clear()
                self.mixed, self.sharp = setting
                likely[setting] += sum(math.log(self._share(s)[level - 1] + 1e-4) for s, level in rounded[fold::2][:SELECTING])
        self.mixed, self.sharp = max(GRID, key=lambda setting: likely[setting])
        shares, truth = [], []
        for fold in (0, 1):
            self._count(rounded[1 - fold :: 2])
            for s, level in rounded[fold::2]:
                shares.append(np.log(self._share(s) + 1e-4))
                truth.append(level - 1)
        self.scale, self.shift = 1.0, np.zeros(LEVELS)
        self._calibrate(np.array(shares).reshape(-1, LEVELS), np.array(truth, int))
        self._count(rounded)

    def _count(self, documents: list[tuple[list[list[str]], int]]) -> None:
        self.words = defaultdict(lambda: np.zeros(LEVELS))
        for s, level in documents:
            for words in s:
                for w in words:
                    self.words[w][level - 1] += 1
        self.words = dict(self.words)
        self.total = sum(self.words.values(), np.zeros(LEVELS)) + 1
        seen = (self.total > 1).astype(float)
        self.present = seen if seen.any() else np.ones(LEVELS)
        self.grams: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(LEVELS))
        self.heads: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(LEVELS))
        for w, counts in self.words.items():
            padded = "^" * (self.order - 1) + w + "$"
            for i in range(self.order - 1, len(padded)):
                self.grams[padded[i - self.order + 1 : i + 1]] += counts
                self.heads[padded[i - self.order + 1 : i]] += counts
        self.grams, self.heads = dict(self.grams), dict(self.heads)
        self.known: dict[str, tuple[float, ...]] = {}

    def vector(self, word: str) -> tuple[float, ...]:
        """Log probability of a word at each level, kept for the next time, up to a bound."""
        none, padded, chars = np.zeros(LEVELS), "^" * (self.order - 1) + word + "$", np.zeros(LEVELS)
        for i in range(self.order - 1, len(padded)):
            gram = self.grams.get(padded[i - self.order + 1 : i + 1], none)
            head = self.heads.get(padded[i - self.order + 1 : i], none)
            chars += np.log((gram + 0.5) / (head + 15.0))
        share = self.words.get(word, none) / self.total
        found = tuple(map(float, np.log((1 - self.mixed) * share + self.mixed * np.exp(chars) + 1e-9)))
        if len(self.known) > 200_000:
            self.known.clear()
        self.known[word] = found
        return found

    def distribution(self, words: list[str]) -> list[float]:
        """The levels' probabilities for a sentence."""
        known, (a, b, c, d) = self.known, (0.0, 0.0, 0.0, 0.0)
        for w in words:
            p, q, r, s = known[w] if w in known else self.vector(w)
            a += p
            b += q
            c += r
            d += s
        top, sharp = max(a, b, c, d), self.sharp
        e = [math.exp(sharp * (x - top)) * y for x, y in zip((a, b, c, d), self.present)]
        total = sum(e) or 1.0
        return [x / total for x in e]

    def _share(self, found: list[list[str]]) -> np.ndarray:
        a = b = c = d = n = 0.0
        for words in found:
            p, q, r, s = self.distribution(words)
            size = len(words)
            a, b, c, d, n = a + p * size, b + q * size, c + r * size, d + s * size, n + size
        return np.array((a, b, c, d)) / n

    def _calibrate(self, logs: np.ndarray, truth: np.ndarray, rounds: int = 200) -> None:
        """Scale and shift of log shares that make the softmax most likely, held near one and none."""
        hot, n = np.eye(LEVELS)[truth], len(truth) + PRIOR
        pull = PRIOR + SHIFTED * len(truth)
        for _ in range(rounds):
            z = self.scale * logs + self.shift
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = p - hot
            self.shift -= 0.5 * (g.sum(0) + pull * self.shift) / n
            self.scale = max(0.1, self.scale - 0.1 * (float((g * logs).sum()) + PRIOR * (self.scale - 1)) / n)

    def document(self, found: list[list[str]]) -> np.ndarray:
        """The calibrated probabilities of the levels for a document's sentences."""
        z = self.scale * np.log(self._share(found) + 1e-4) + self.shift
        p = np.exp(z - z.max()) * self.present
        return p / p.sum() if p.sum() else self.present / self.present.sum()


def fitted(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> LevelModel:
    """A model of at most `sample` labelled documents, drawn by hash; the mean of a document's readers is its label."""
    mean = labels.where("reading_level between 1 and 4").groupBy("doc_id").agg(F.avg("reading_level").alias("level"))
    drawn = mean.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # The sample is bounded by the parameter, so this side is too.
    rows = documents.where("length(text) > 0").select("doc_id", "text").join(F.broadcast(drawn), "doc_id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[" ".join(s) for s in sentences(t)] for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string())), batch.column(1), batch.column(2)], ["sentences", "level", "doc_id"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    cutrows = rows.select("text", "level", "doc_id").mapInArrow(cut, f"sentences array<string>, level double, doc_id {kind}").collect()
    return LevelModel([([s.split() for s in r.sentences], r.level) for r in sorted(cutrows, key=lambda r: (r.doc_id, r.sentences))])


def difficulty(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, n_sentences, n_words, p1..p4, reading_level) of each document with at least a paragraph of prose.

    Null, blank and prose-free texts, less than LEAST_WORDS words of prose and single sentences give no row. Levels of
    readers outside 1 to 4 are left out; without any label there is no model, and so no row. A document posted again
    is rated again.
    """
    model = fitted(documents, labels, sample)
    sent = documents.sparkSession.sparkContext.broadcast(model)
    kind = f"doc_id {documents.schema['doc_id'].dataType.simpleString()}"
    names = ["doc_id", "n_sentences", "n_words", "p1", "p2", "p3", "p4", "reading_level"]

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rater = sent.value
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = sentences(text)
                n = sum(map(len, found))
                if n >= (LEAST_WORDS if len(found) > 1 else LEAST_UNCUT) and rater.levels:
                    p = rater.document(found)
                    rows.append((doc, len(found), n, *map(float, p), int(p.argmax()) + 1))
            columns = list(zip(*rows)) if rows else [[] for _ in names]
            kinds = [batch.schema.field(0).type, pa.int32(), pa.int32(), *[pa.float64()] * 4, pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    rows = spread(documents.where("length(text) > 0").select("doc_id", "text"))
    return rows.mapInArrow(rate, f"{kind}, n_sentences int, n_words int, p1 double, p2 double, p3 double, p4 double, reading_level int")


def profile(rated: DataFrame, documents: DataFrame) -> DataFrame:
    """(lang, source, reading_level, documents): how many documents of each language and source have each level."""
    return rated.join(documents.select("doc_id", "lang", "source"), "doc_id").groupBy("lang", "source", "reading_level").agg(F.count(F.lit(1)).alias("documents"))
