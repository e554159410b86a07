"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text and normalised by length.

The lexicon's terms and weights are learned from labels: words, and beginnings of words, that stand in toxic documents
far oftener than in others. A word counts once, by the weightiest term that it matches.
Words are folded first (compatible forms, invisible characters, case, homoglyphs of other alphabets, digits and signs
that stand for letters). Phrases of two words in which a term is harmless, as clean documents have it far oftener than
toxic ones, are exceptions: the automaton finds them too, and a term inside one does not count.
"""

from __future__ import annotations

import functools
import unicodedata
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axonframe.llm.common import outside, slices, split_words, texts_of, written
from axonframe.llm.quality import held_out, in_order, sampled_labels

#: Labelled rows to learn from at most (those with the least hashes of their ids).
MAX_TRAIN_ROWS = 40_000
FOLDS, HELD_OUT_FOLD, THRESHOLD = 4, 2, 0.3
MIN_DOCS, MIN_Z = 3, 2.5
#: Sizes of the model: the terms and exceptions of the greatest certainty. None takes all that the sample gives.
MAX_TERMS, MAX_EXCEPTIONS = 50_000, 5_000
#: Lengths of word beginnings that can be terms; these are written with a star.
STEMS = range(4, 9)

#: Folding rules: Cyrillic and Greek letters that look like Latin ones, and digits and signs inside words.
HOMOGLYPHS = str.maketrans("абвгдеёіјкмнорстухѕԁɡιοαενρτκυχ", "a6brдeeijkmhopctyxsdgioaevptkux")
DIGITS = str.maketrans("0134578@$!|", "oieastbasii")
#: What is cut from the ends of a word. Signs that stand for letters at a word's end (a$$) or beginning (@ss, !diot) are not.
_PUNCTUATION = "\"#%&'()*+,-./:;<=>?[\\]^_`{|}~“”‘’«»…–—¡¿"
_OTHER_ALPHABET, _MIXED = r"[\p{Cyrillic}\p{Greek}]", r"\pL.*[0-9@$!|]|[0-9@$!|].*\pL"


def fold(words: pa.Array) -> pa.Array:
    """Compatible forms without invisible characters, lower case, without outer punctuation; letters of other alphabets that look Latin, and digits and signs in a word with letters, become Latin letters."""
    odd = pc.invert(pc.string_is_ascii(words))
    words = pc.replace_with_mask(words, odd, pa.array([unicodedata.normalize("NFKC", w) for w in words.filter(odd).to_pylist()], pa.string()))
    words = pc.utf8_lower(pc.replace_substring_regex(words, r"\p{Cf}|\s", ""))
    words = pc.utf8_ltrim(pc.utf8_rtrim(words, characters=_PUNCTUATION + "!"), characters=_PUNCTUATION)
    words = pc.replace_substring_regex(words, "^!!+", "")
    for pattern, table in ((_OTHER_ALPHABET, HOMOGLYPHS), (_MIXED, DIGITS)):
        mask = pc.match_substring_regex(words, pattern)
        if pc.any(mask).as_py():
            words = pc.replace_with_mask(words, mask, pa.array([w.translate(table) for w in words.filter(mask).to_pylist()], pa.string()))
    return pc.utf8_trim(words, characters="@$!|")


@functools.lru_cache(30_000)
def terms_of(word: str) -> tuple[str, ...]:
    """The folded word and its beginnings, as terms."""
    return (word, *(f"{word[:k]}*" for k in STEMS if k < len(word)))


def _term_rows(batches):
    """(y, term) for each different term of each document."""
    for batch in batches:
        for part in slices(batch):
            words, first = split_words(part.column(1))
            coded = words.dictionary_encode()
            folded = np.array(fold(coded.dictionary).to_pylist() or [""], object)
            code = coded.indices.to_numpy()
            labels = part.column(0).to_numpy()
            ys, terms = [], []
            for i in range(len(part)):
                own = {t for w in folded[np.unique(code[first[i] : first[i + 1]])] if w for t in terms_of(w)}
                terms += own
                ys += [labels[i]] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(ys, pa.float64()), pa.array(terms, pa.string())], ["y", "term"])


def _shares(counts: DataFrame, toxic: float, clean: float) -> DataFrame:
    """w, the log ratio of smoothed document shares, and z, how many standard errors it is from zero, for rows (t, c)."""
    ratio = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("c") + 0.5) / (clean + 1))
    error = F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    return counts.select("term", ratio.alias("w"), (ratio / error).alias("z"))


@dataclass
class Lexicon:
    """Weights of terms, and phrases in which they do not count."""

    weights: dict[str, float]
    exceptions: list[str]


def learn_lexicon(rows: DataFrame, most_terms: int | None = MAX_TERMS, most_exceptions: int | None = MAX_EXCEPTIONS) -> Lexicon:
    """From rows (y, text) of the sample: terms whose log ratio is 1 or more and MIN_Z standard errors above zero, at most most_terms; phrases of a term and a neighbour that are MIN_Z below zero, at most most_exceptions. None is no limit: the sample's size bounds both."""
    first = lambda found, order, most: (found.orderBy(order, "term").limit(most) if most is not None else found).collect()
    totals = rows.agg(F.sum("y"), F.sum(1 - F.col("y"))).first()
    toxic, clean = totals[0] or 0.0, totals[1] or 0.0
    counted = lambda found: found.groupBy("term").agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("c"))
    terms = _shares(counted(rows.mapInArrow(_term_rows, TERMS)).where(F.col("t") >= MIN_DOCS), toxic, clean).where((F.col("z") >= MIN_Z) & (F.col("w") >= 1.0))
    weights = {r.term: r.w for r in first(terms, F.desc("z"), most_terms)}
    phrases = _shares(counted(rows.mapInArrow(_phrase_rows(weights), TERMS)).where(F.col("c") >= MIN_DOCS), toxic, clean).where(F.col("z") <= -MIN_Z)
    return Lexicon(weights, [r.term for r in first(phrases, F.asc("z"), most_exceptions)])


def automaton(weights: dict[str, float], exceptions=()):
    """Of spaced terms and exception phrases."""
    machine = ahocorasick.Automaton()
    for term, weight in weights.items():
        spaced = f" {term[:-1]}" if term.endswith("*") else f" {term} "
        machine.add_word(spaced, (term, weight, len(spaced)))
    for phrase in exceptions:
        machine.add_word(f" {phrase} ", (None, 0.0, len(phrase) + 2))
    machine.add_word("\n", (None, 0.0, 1))  # no line has it; an automaton needs a word
    machine.make_automaton()
    return machine


def words_hit(folded: pa.Array, machine) -> np.ndarray:
    """Which of the folded words hold a term."""
    hit = np.zeros(max(1, len(folded)), bool)
    starts = np.cumsum(pc.utf8_length(folded).to_numpy(zero_copy_only=False) + 1)
    line = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(folded)], pa.int32()), folded), " ")[0].as_py() if len(folded) else ""
    ends = [end - size + 1 for end, (term, _, size) in machine.iter(f" {line} ") if term]
    hit[np.searchsorted(starts, ends, side="right")] = True
    return hit


TERMS = "y double, term string"


def _phrase_rows(weights: dict[str, float]):
    """(y, term) for each different phrase of a word that holds a term and the word before or after it, of each document."""

    def phrases(batches):
        machine = automaton(weights)
        for batch in batches:
            for part in slices(batch):
                words, first = split_words(part.column(1))
                coded = words.dictionary_encode()
                folded = fold(coded.dictionary)
                code, names = coded.indices.to_numpy(), folded.to_pylist()
                doc = np.repeat(np.arange(len(part)), np.diff(first))
                found = set()
                for i in np.flatnonzero(words_hit(folded, machine)[code]).tolist() if names else []:
                    d, word = int(doc[i]), names[code[i]]
                    for j, k in ((i - 1, i), (i, i + 1)):
                        if first[d] <= j and k < first[d + 1] and names[code[j]] and names[code[k]]:
                            found.add((d, f"{names[code[j]]} {names[code[k]]}"))
                labels = part.column(0).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array([labels[d] for d, _ in found], pa.float64()), pa.array([p for _, p in found], pa.string())], ["y", "term"])

    return phrases


def measures(texts: pa.Array, machine) -> np.ndarray:
    """The different words of a batch are matched first, then whole texts that hold one of the words found. Per text: log of weighted matches, weighted matches by root of length, weighted matches per hundred words, different terms."""
    words, first = split_words(texts)
    coded = words.dictionary_encode()
    folded = fold(coded.dictionary)
    hit = words_hit(folded, machine)
    folded = folded.to_pylist() if hit.any() else []
    code = coded.indices.to_numpy()
    hits = np.concatenate([[0], np.cumsum(hit[code])]) if len(code) else np.zeros(1, np.int64)
    out = np.zeros((len(texts), 4))
    for i in np.flatnonzero(hits[first[1:]] > hits[first[:-1]]).tolist():
        text = f" {' '.join(w for w in map(folded.__getitem__, code[first[i] : first[i + 1]].tolist()) if w)} "
        spans = sorted(((end - size + 1, end, term, weight) for end, (term, weight, size) in machine.iter(text)), key=lambda s: s[0])
        counted: dict[int, tuple[float, str]] = {}
        for a, _, term, weight in outside([s for s in spans if s[2]], [s for s in spans if not s[2]]):
            counted[a] = max(counted.get(a, (0.0, "")), (weight, term))
        total, n = sum(w for w, _ in counted.values()), first[i + 1] - first[i]
        out[i] = np.log1p(total), total / np.sqrt(n + 10), 100 * total / (n + 10), np.log1p(len({t for _, t in counted.values()}))
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Weights (bias last) of ridge logistic regression, by Newton's steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        penalty = ridge * np.append(np.ones(x.shape[1] - 1), 0.01)
        w -= np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
    return w


def _measure_rows(lexicon: Lexicon):
    def measure(batches):
        machine = automaton(lexicon.weights, lexicon.exceptions)
        for batch in batches:
            for part in slices(batch):
                x = measures(part.column(1), machine)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["y", "x"])

    return measure


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", most_terms: int | None = MAX_TERMS, most_exceptions: int | None = MAX_EXCEPTIONS) -> tuple[Lexicon, np.ndarray]:
    """The lexicon and the weights of the measures. The weights are learned on documents that a lexicon of the other half has not seen. Ids that come many times bring more rows than labels: of these as many are taken, by their texts' hashes, as `most` allows."""
    sample = F.broadcast(sampled_labels(labels, "toxic", FOLDS, HELD_OUT_FOLD, most))
    rows = texts_of(docs, id_col, text_col).join(sample, F.col("doc_id") == F.col("label_id")).dropDuplicates(["text", "y"])
    rows = written(rows.select("y", "text", (F.xxhash64("text") % 2 == 0).alias("half")), "labelled")
    if (n := rows.count()) > most:
        rows = rows.where(F.pmod(F.xxhash64(F.lit(1), "text"), F.lit(1 << 20)) < (most << 20) // n)
    x, y = [np.empty((0, 4))], [np.empty(0)]
    for half in (True, False):
        lexicon = learn_lexicon(rows.where(F.col("half") == half).select("y", "text"), most_terms, most_exceptions)
        seen = rows.where(F.col("half") != half).select("y", "text").mapInArrow(_measure_rows(lexicon), "y double, x array<double>").toPandas()
        for held, part in zip((x, y), in_order(seen, 4)):
            held.append(part)
    return learn_lexicon(rows.select("y", "text"), most_terms, most_exceptions), fit_logistic(np.concatenate(x), np.concatenate(y))


def _scorer(lexicon: Lexicon, weights: np.ndarray):
    def score(batches):
        machine = automaton(lexicon.weights, lexicon.exceptions)
        for batch in batches:
            for part in slices(batch):
                x = measures(part.column(1), machine)
                margin = np.clip(x @ weights[:-1] + weights[-1], -30, 30)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(1 / (1 + np.exp(-margin)))], ["doc_id", "score"])

    return score


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MAX_TRAIN_ROWS, most_terms: int | None = MAX_TERMS, most_exceptions: int | None = MAX_EXCEPTIONS) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted (1 if score >= 0.3).

    Only the text is scored, the whole of it; null is the empty text, which has no match. A null id is not held out.
    Without labels there is no lexicon and each score is one half. An empty table gives no rows.
    """
    lexicon, weights = fit(docs, labels, most, id_col, text_col, most_terms, most_exceptions)
    rows = texts_of(docs, id_col, text_col).mapInArrow(_scorer(lexicon, weights), "doc_id long, score double")
    return rows.select("doc_id", held_out(F.col("doc_id"), FOLDS, HELD_OUT_FOLD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
