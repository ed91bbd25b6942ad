"""Language identification by segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary. A word's probability is the
sum over all its segmentations into pieces (a forward algorithm); a text's is the product over its words,
times the language's prior. The piece probabilities come from expectation-maximisation: forward and
backward sums give expected piece counts over all segmentations of the training words.

Words are maximal runs of letters, lower-cased, of any length: up to WORD_LETTERS letters many words are summed at
once, longer ones one by one with their sums rescaled as they go. A character outside the vocabulary is a piece of
its own with the probability UNKNOWN. Training reads the words of a sample of at most about `sample` labelled rows of
each language, chosen by a hash of the id and the text (runs of more than WORD_LETTERS letters count as several words
there); priors come from all labelled rows. What the driver holds is bounded by `sample` rows of at most LANGUAGES
languages; more languages are an error. Prediction reads text only.

Results: one row per row of the table. A null or empty text, or one without a letter, is `und` with score 0. With no
labelled row every text is `und`. Equal scores go to the first language in alphabetical order. Null and repeated ids
and repeated texts are ordinary rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frames
from .pair_table import NONE, PairTable

WORD_LETTERS = 40
UNKNOWN = 1e-9
#: Sums below this are taken again with rescaling.
SMALLEST = 1e-280
#: Labelled rows of each language in the training sample, and rounds of expectation-maximisation.
SAMPLE, ROUNDS = 400, 3
#: Most languages that training takes.
LANGUAGES = 1000
#: Sums a worker remembers, one for each word and language, before it starts afresh; words longer than LONG are not
#: remembered. Words whose sums are taken at once, times languages.
CACHE_SUMS, LONG, AT_ONCE = 1_200_000, 200, 80_000

_LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return _LETTERS.findall(text.lower())


def training_words(text: str) -> list[str]:
    return [w[i : i + WORD_LETTERS] for w in words_of(text) for i in range(0, len(w), WORD_LETTERS)]


def vocabulary(path: str) -> dict[str, int]:
    """Lower-case letter pieces of a sentencepiece model; ▁ marks a word's start."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
    return {p: i for i, p in enumerate(sorted(p for p in pieces if p and _LETTERS.fullmatch(p.removeprefix("▁") or "a")))}


def _at_once(languages: list[str]) -> int:
    return max(100, AT_ONCE // max(1, len(languages)))


class PieceTrie:
    """The vocabulary as a trie whose steps are looked up for many words at once."""

    def __init__(self, vocab: dict[str, int]):
        nodes: dict[str, int] = {"": 0}
        left, right, value = [], [], []
        for piece in vocab:
            for i in range(1, len(piece) + 1):
                if piece[:i] not in nodes:
                    nodes[piece[:i]] = len(nodes)
                    left.append(nodes[piece[: i - 1]])
                    right.append(ord(piece[i - 1]))
                    value.append(nodes[piece[:i]])
        self.steps = PairTable(left, right, value)
        self.next = {(a, chr(b)): c for a, b, c in zip(left, right, value)}
        self.piece = np.full(len(nodes), -1, dtype=np.int64)
        self.piece[[nodes[p] for p in vocab]] = list(vocab.values())
        self.size = len(vocab)


class Lattice:
    """All segmentations of a list of words: for each end and start, which words have which piece there."""

    def __init__(self, words: list[str], trie: PieceTrie):
        self.n, self.width = len(words), max(map(len, words), default=0) + 1
        self.ends = np.array([len(w) + 1 for w in words], dtype=np.int64)
        # position 0 is the mark of a word's start
        letters = np.array(["▁" + w for w in words], dtype=f"U{self.width}").view(np.uint32).reshape(self.n, -1).astype(np.int64) if words else np.zeros((0, 1), np.int64)
        self.arcs = []
        for start in range(letters.shape[1]):
            rows = np.flatnonzero(self.ends > start)
            nodes, end = np.zeros(len(rows), dtype=np.int64), start
            while len(rows) and end < letters.shape[1]:
                found = trie.steps.find(nodes, letters[rows, end])
                end += 1
                pieces = np.where(found == NONE, -1, trie.piece[np.where(found == NONE, 0, found)])
                if end == start + 1:
                    pieces[pieces < 0] = trie.size  # a character outside the vocabulary
                hit = pieces >= 0
                if hit.any():
                    self.arcs.append((end, start, rows[hit], pieces[hit]))
                on = (found != NONE) & (self.ends[rows] > end)
                rows, nodes = rows[on], found[on].astype(np.int64)
        self.arcs.sort(key=lambda x: x[:2])

    def forward(self, probability: np.ndarray) -> np.ndarray:
        """alpha[word, position, language]."""
        alpha = np.zeros((self.n, self.width + 1, probability.shape[1]))
        alpha[:, 0] = 1
        for end, start, rows, pieces in self.arcs:
            alpha[rows, end] += alpha[rows, start] * probability[pieces]
        return alpha

    def totals(self, alpha: np.ndarray) -> np.ndarray:
        return alpha[np.arange(self.n), self.ends]

    def expected(self, probability: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected counts of each piece and language; counts[word, language]."""
        alpha = self.forward(probability)
        beta = np.zeros_like(alpha)
        beta[np.arange(self.n), self.ends] = counts / np.maximum(self.totals(alpha), 1e-300)
        out = np.zeros_like(probability)
        for end, start, rows, pieces in reversed(self.arcs):
            flow = probability[pieces] * beta[rows, end]
            beta[rows, start] += flow
            flow = flow * alpha[rows, start]
            for k in range(out.shape[1]):
                out[:, k] += np.bincount(pieces, flow[:, k], minlength=len(out))
        return out


@dataclass
class Model:
    languages: list[str]
    trie: PieceTrie
    probability: np.ndarray  # [piece, language]; the last row is a character outside the vocabulary
    prior: np.ndarray  # log

    def log_words(self, words: list[str]) -> np.ndarray:
        """Log-probability of each word in each language."""
        out = np.empty((len(words), len(self.languages)))
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if len(w) > WORD_LETTERS:
                out[i] = self.log_long(w)
            else:
                by_length.setdefault((len(w) + 3) // 4, []).append(i)
        for rows in by_length.values():
            for at in range(0, len(rows), at_once := _at_once(self.languages)):
                part = rows[at : at + at_once]
                lattice = Lattice([words[i] for i in part], self.trie)
                totals = lattice.totals(lattice.forward(self.probability))
                small = (totals < SMALLEST).any(axis=1)
                out[part] = np.log(np.maximum(totals, SMALLEST))
                for i in np.flatnonzero(small).tolist():
                    out[part[i]] = self.log_long(words[part[i]])
        return out

    def log_long(self, word: str) -> np.ndarray:
        """The same of one word of any length: each language's sums are rescaled from letter to letter."""
        text, step, piece, probability = "▁" + word, self.trie.next, self.trie.piece, self.probability
        log = np.zeros(len(self.languages))
        open_ = {0: np.ones(len(self.languages))}  # position -> the sum of what ends there, over the scale so far
        for start in range(len(text)):
            here = open_.pop(start)
            log += np.log(here)
            for end in open_:
                open_[end] = open_[end] / here
            node, end = 0, start
            while True:
                node = step.get((node, text[end]))
                end += 1
                number = int(piece[node]) if node is not None else -1
                if number < 0 and end == start + 1:
                    number = self.trie.size
                if number >= 0:
                    open_[end] = open_[end] + probability[number] if end in open_ else probability[number]
                if node is None or end == len(text):
                    break
        return log + np.log(open_[len(text)])


def fit(counts: dict[str, Counter], documents: dict[str, int], vocab: dict[str, int], rounds: int = ROUNDS) -> Model:
    """counts: words of each language; documents: labelled rows of each language."""
    languages = sorted(documents)
    words = sorted(set().union(*counts.values())) if counts else []
    table = np.array([[counts.get(k, {}).get(w, 0) for k in languages] for w in words], dtype=float).reshape(len(words), len(languages))
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault((len(w) + 3) // 4, []).append(i)
    at_once = _at_once(languages)
    parts = [rows[at : at + at_once] for rows in groups.values() for at in range(0, len(rows), at_once)]
    trie = PieceTrie(vocab)
    lattices = [(Lattice([words[i] for i in rows], trie), table[rows]) for rows in parts]
    probability = np.full((len(vocab) + 1, len(languages)), 1 / (len(vocab) + 1))
    probability[-1] = UNKNOWN
    for _ in range(rounds):
        expected = sum((x.expected(probability, c) for x, c in lattices), np.zeros_like(probability))[:-1] + 0.01
        probability = np.vstack([expected / expected.sum(axis=0), np.full((1, len(languages)), UNKNOWN)])
    total = sum(documents.values())
    return Model(languages, trie, probability, np.log([documents[k] / total for k in languages]))


def train(labelled: DataFrame, vocab_path: str, sample: int = SAMPLE, rounds: int = ROUNDS) -> Model | None:
    """labelled: doc_id, text, lang. None if nothing is labelled."""
    rows = labelled.where("lang is not null and text is not null")
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().limit(LANGUAGES + 1).collect()}
    if not sizes:
        return None
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, sample / n))])
    chosen = rows.where(F.pmod(F.xxhash64(F.lit("language sample"), "text"), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30)).select("lang", "text")

    def count(batches):
        found: dict[str, Counter] = {}
        for batch in frames.parts(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found.setdefault(lang, Counter()).update(training_words(text))
        for lang, words in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], names=["lang", "word", "n"])

    counts: dict[str, Counter] = {}
    table = chosen.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow()
    for lang, word, n in zip(*(table.column(i).to_pylist() for i in range(3))):
        counts.setdefault(lang, Counter())[word] = n
    return fit(counts, sizes, vocabulary(vocab_path), rounds)


class Scorer:
    """A worker process's own, kept from task to task with its copy of the model: the words scored so far. The model
    does not hold it, so both go at once, without waiting for a collection of cycles."""

    def __init__(self, model: Model | None):
        self.model, self.rows, self.table = model, {}, np.zeros((1024, len(model.languages) if model else 0))

    def _remember(self, words: list[str]) -> None:
        if not words:
            return
        at = len(self.rows)
        while at + len(words) > len(self.table):
            self.table = np.vstack([self.table, np.empty_like(self.table)])
        self.table[at : at + len(words)] = self.model.log_words(words)
        self.rows.update(zip(words, range(at, at + len(words))))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[int]]:
        """The language of each text, its posterior probability and the number of words."""
        found = [words_of(t) if t and self.model else [] for t in texts]
        found = [ws if any(c.isalpha() for w in ws for c in w) else [] for ws in found]  # ² and the like are no letters
        if self.model and len(self.rows) * len(self.model.languages) > CACHE_SUMS:
            self.rows, self.table = {}, self.table[:1024].copy()
        every = set().union(*found)
        long = {w: self.model.log_words([w])[0] for w in every if len(w) > LONG}
        self._remember([w for w in every if w not in self.rows and w not in long])
        names, scores = [], []
        for ws in found:
            if not ws:
                names.append("und")
                scores.append(0.0)
                continue
            log = self.model.prior.copy()
            if long:
                log += sum((long[w] for w in ws if w in long), np.zeros_like(log))
                ws = [w for w in ws if w not in long]
            log += self.table[np.fromiter(map(self.rows.__getitem__, ws), np.int64, len(ws))].sum(axis=0)
            best = int(log.argmax())
            names.append(self.model.languages[best])
            scores.append(min(1.0, float(1 / np.exp(np.minimum(log - log[best], 0)).sum())))
        return names, scores, list(map(len, found))


_OUT = "doc_id long, lang_pred string, score double, n_words long"


def _shared(docs: DataFrame, model: Model | None):
    return frames.kept(docs.sparkSession, Scorer, model)  # at most a few MB for a language: the vocabulary's probabilities


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score (the language's posterior probability) and n_words (of letters)."""
    shared = _shared(docs, model)

    def run(batches):
        scorer = shared.value.get()
        for batch in frames.parts(batches):
            names, scores, sizes = scorer.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(sizes, pa.int64())], names=["doc_id", "lang_pred", "score", "n_words"])

    return frames.documents(docs).mapInArrow(run, _OUT)


def clear(docs: DataFrame, model: Model | None, least: float) -> DataFrame:
    """The rows of docs, with all their columns, whose language is known with at least this score."""
    shared = _shared(docs, model)

    def run(batches):
        scorer = shared.value.get()
        for batch in frames.parts(batches):
            names, scores, _ = scorer.predict(batch.column(batch.schema.get_field_index("text")).to_pylist())
            yield batch.filter(pa.array([n != "und" and s >= least for n, s in zip(names, scores)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def remainder():
    """crc32 of the id as text, modulo 4."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))


def labelled(docs: DataFrame, held_out: int | None = None) -> DataFrame:
    """doc_id, text and lang of the rows that training may read: those with an id whose remainder is not held_out."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "lang")
    return rows if held_out is None else rows.where(remainder() != held_out)


def identify(docs: DataFrame, vocab_path: str, sample: int = SAMPLE, rounds: int = ROUNDS, held_out: int = 2) -> DataFrame:
    """Train on the labelled rows whose remainder is not held_out, and predict every row; adds held_out (false without
    an id)."""
    model = train(labelled(docs, held_out), vocab_path, sample, rounds)
    return predict(docs, model).withColumn("held_out", F.coalesce(remainder() == held_out, F.lit(False)))


def crc_remainder(doc_id: int) -> int:
    """remainder() of one id, for tests."""
    return zlib.crc32(str(doc_id).encode()) % 4
