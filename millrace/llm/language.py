"""Missing or wrong document language labels.

One interpolated Kneser-Ney character model per language is fitted on a bounded sample of labelled documents. All
models lie in one sorted array of hashed n-grams per order, whose rows hold the probabilities in every language. Text
is scored word by word, each distinct word once in a task; stretches take the language of the lowest length-normalised
cross-entropy, and what no model explains is rejected as 'und'.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.words import mix

#: A letter run is a word; the other alternative is what ends a stretch of words.
_TOKENS = re.compile(r"[^\W\d_]+|[.!?…\n]+")
_START, _END, _FIRST = 1, 2, 3
#: Bits of a symbol's code; the last 256 codes are the bytes of characters that have no code of their own.
_BITS = 12
_BYTES = (1 << _BITS) - 256

# Languages by ISO 639-1 code with their other usual spellings (ISO 639-2 codes, English and own names).
LANGUAGE_NAMES = {
    "en": "eng english", "de": "deu ger german deutsch", "fr": "fra fre french français francais", "es": "spa spanish español espanol castellano",
    "pt": "por portuguese português portugues", "it": "ita italian italiano", "nl": "nld dut dutch nederlands", "sv": "swe swedish svenska",
    "da": "dan danish dansk", "no": "nor norwegian norsk nb nn nob nno", "fi": "fin finnish suomi", "pl": "pol polish polski", "cs": "ces cze czech",
    "ru": "rus russian", "uk": "ukr ukrainian", "tr": "tur turkish", "el": "ell gre greek", "hu": "hun hungarian", "ro": "ron rum romanian",
    "ja": "jpn japanese", "zh": "zho chi chinese", "ko": "kor korean", "ar": "ara arabic", "hi": "hin hindi", "ca": "cat catalan",
}


def named_language(label: Column) -> Column:
    """ISO 639-1 code that a label names, in whatever usual spelling ('en-GB', 'eng', 'EN', 'English'), or null."""
    first = F.element_at(F.split(F.lower(F.trim(label)), r"[^\p{L}]+"), 1)
    codes = F.create_map(*chain.from_iterable((F.lit(w), F.lit(code)) for code, names in LANGUAGE_NAMES.items() for w in [code, *names.split()]))
    return F.element_at(codes, first)


@dataclass
class CharModels:
    """Interpolated Kneser-Ney models of several languages over characters of words.

    Any character can be written: the most frequent ones have codes of their own, all others are their UTF-8 bytes, so
    scripts of thousands of characters are modelled like the rest.
    """

    languages: list[str]
    order: int
    alphabet: dict[str, int]
    grams: list[np.ndarray] = field(default_factory=list)  # by length - 1: sorted hashes of n-grams
    probs: list[np.ndarray] = field(default_factory=list)  # (n-grams, languages)
    contexts: list[np.ndarray] = field(default_factory=list)  # by length of the n-gram - 1: sorted hashes of contexts
    backoff: list[np.ndarray] = field(default_factory=list)  # (contexts, languages), 1 where a context is unseen
    temperature: float = 1.0
    reject: float = np.inf  # cross-entropy in nats a character above which nothing is recognised

    def __post_init__(self) -> None:
        if self.order * _BITS > 64:
            raise ValueError(f"n-grams have at most {64 // _BITS} symbols")

    @property
    def symbols(self) -> int:
        return len(self.alphabet) + 257  # and the bytes, and a word's end

    def spelt(self, word: str) -> list[int]:
        get, out = self.alphabet.get, [_START]
        for x in word:
            if (code := get(x)) is not None:
                out.append(code)
            else:
                out.extend(_BYTES + b for b in x.encode("utf-8", "surrogatepass"))
        out.append(_END)
        return out

    def codes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbol codes of the padded words one after the other, each one's position in its word, and the words' lengths."""
        each = [self.spelt(w) for w in words]
        lengths = np.array([len(e) for e in each], np.int64)
        starts = np.repeat(np.cumsum(lengths) - lengths, lengths)
        return np.fromiter(chain.from_iterable(each), np.uint64, len(starts)), np.arange(len(starts)) - starts, lengths

    @staticmethod
    def keys(codes: np.ndarray, place: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Packed n-grams that end at each place where there is room, and those places."""
        at = np.flatnonzero((place >= n - 1) & (place >= 1))
        key = np.zeros(len(at), np.uint64)
        for i in range(n):
            key = (key << np.uint64(_BITS)) | codes[at - (n - 1 - i)]
        return key, at

    def fit(self, counts: dict[str, Counter]) -> CharModels:
        """Fit on word counts per language. The longest n-grams and those at a word's start use counts, shorter ones
        the number of different characters before them."""
        n_lang, top = len(self.languages), self.order
        per: list[list[tuple[np.ndarray, np.ndarray]]] = []
        for language in self.languages:
            words = list(counts[language])
            codes, place, lengths = self.codes(words)
            weight = np.repeat(np.array([counts[language][w] for w in words], np.float64), lengths)
            tables = []
            longer = None
            for n in range(top, 0, -1):
                key, at = self.keys(codes, place, n)
                raw = np.ones(len(at), bool) if n == top else (place[at] == n - 1)
                own, inverse = np.unique(key[raw], return_inverse=True)
                total = np.bincount(inverse, weight[at[raw]], len(own))
                if n < top:  # continuation counts from the distinct n-grams one longer
                    suffix, kinds = np.unique(longer & np.uint64((1 << _BITS * n) - 1), return_counts=True)
                    own, total = np.concatenate([own, suffix]), np.concatenate([total, kinds])
                    own, inverse = np.unique(own, return_inverse=True)
                    total = np.bincount(inverse, total, len(own))
                longer = np.unique(key)
                tables.append((own, total))
            per.append(tables[::-1])
        size = self.symbols
        lower = None
        for n in range(1, top + 1):
            union = np.unique(np.concatenate([t[n - 1][0] for t in per]))
            heads = np.unique(union >> np.uint64(_BITS))
            prob, back = np.zeros((len(union), n_lang)), np.ones((len(heads), n_lang))
            base = np.full((len(union), n_lang), 1.0 / size) if n == 1 else lower[1][np.searchsorted(lower[0], union & np.uint64((1 << _BITS * (n - 1)) - 1))]
            head_of = np.searchsorted(heads, union >> np.uint64(_BITS))
            for k, tables in enumerate(per):
                own, total = tables[n - 1]
                ones, twos = (total == 1).sum(), (total == 2).sum()
                discount = ones / (ones + 2 * twos) if ones and twos else 0.5
                head = np.searchsorted(heads, own >> np.uint64(_BITS))
                mass, kinds = np.bincount(head, total, len(heads)), np.bincount(head, minlength=len(heads))
                seen = mass > 0
                back[seen, k] = discount * kinds[seen] / mass[seen]
                here = np.zeros(len(union))
                here[np.searchsorted(union, own)] = np.maximum(total - discount, 0)
                prob[:, k] = np.divide(here, mass[head_of], out=np.zeros(len(union)), where=mass[head_of] > 0) + back[head_of, k] * base[:, k]
            lower = (union, prob)
            for store, values, key, value in ((self.grams, self.probs, union, prob), (self.contexts, self.backoff, heads, back)):
                hashed = mix(key)
                order = np.argsort(hashed)
                store.append(hashed[order])
                values.append(value[order].astype(np.float32))
        return self

    def _prob(self, keys: np.ndarray, n: int) -> np.ndarray:
        """Probabilities (keys, languages) of n-grams of one length, by binary search, backing off where unseen."""
        table, hashed = self.grams[n - 1], mix(keys)
        at = np.minimum(np.searchsorted(table, hashed), len(table) - 1)
        out = self.probs[n - 1][at].astype(np.float64)
        lost = np.flatnonzero(table[at] != hashed)
        if len(lost):
            if n == 1:
                out[lost] = self.backoff[0][0] / self.symbols
            else:
                heads, head = self.contexts[n - 1], mix(keys[lost] >> np.uint64(_BITS))
                where = np.minimum(np.searchsorted(heads, head), len(heads) - 1)
                weight = np.where((heads[where] == head)[:, None], self.backoff[n - 1][where], 1.0)
                out[lost] = weight * self._prob(keys[lost] & np.uint64((1 << _BITS * (n - 1)) - 1), n - 1)
        return out

    def score(self, words: list[str]) -> np.ndarray:
        """Log probability (words, languages) of each word in each language."""
        if not words:
            return np.zeros((0, len(self.languages)))
        codes, place, _ = self.codes(words)
        log = np.zeros((len(codes), len(self.languages)))
        for n in range(2, self.order + 1):
            key, at = self.keys(codes, place, n)
            pick = np.ones(len(at), bool) if n == self.order else place[at] == n - 1
            log[at[pick]] = np.log(self._prob(key[pick], n))
        return np.add.reduceat(log, np.flatnonzero(place == 0), axis=0)


class _Words(dict):
    """Numbers words as they come; 0 stands for the end of a stretch."""

    def __missing__(self, token: str) -> int:
        number = self[token] = len(self) + 1 if token[0].isalpha() else 0
        return number


class _Scorer:
    """Scores of distinct words, kept between batches of a task up to a bound."""

    def __init__(self, models: CharModels, most: int = 400_000):
        self.models, self.most = models, most
        self.reset()

    def reset(self) -> None:
        self.ids, self.scores, self.letters = _Words(), np.zeros((1, len(self.models.languages))), np.zeros(1, np.int64)

    def numbers(self, tokens: list[list[str]]) -> np.ndarray:
        if len(self.ids) > self.most:
            self.reset()
        before = len(self.ids)
        out = np.fromiter(map(self.ids.__getitem__, chain.from_iterable(tokens)), np.int64)
        if len(self.ids) > before:
            new = list(self.ids)[before:]
            score = np.zeros((len(new), len(self.models.languages)))
            letters = np.zeros(len(new), np.int64)
            real = [i for i, w in enumerate(new) if self.ids[w]]
            score[real] = self.models.score([new[i] for i in real])
            letters[real] = [len(new[i]) for i in real]
            self.scores, self.letters = np.concatenate([self.scores, score]), np.concatenate([self.letters, letters])
        return out


def _sum(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts, axis=0) if len(starts) else values[:0]


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def stretches_of(texts: list[str], scorer: _Scorer, margin: float, longest: int) -> tuple[np.ndarray, ...]:
    """Stretches of one language of a batch of texts: (text number, first word, words, letters, language, confidence).

    Language -1 is 'und'. A sentence, or ``longest`` words of one, takes its best language if that beats the text's
    main language by ``margin`` nats, else the main one; neighbours of one language make a stretch.
    """
    tokens = [_TOKENS.findall(t.lower()) for t in texts]
    ids = scorer.numbers(tokens)
    doc = np.repeat(np.arange(len(texts)), [len(t) for t in tokens])
    word = ids > 0
    piece = np.cumsum(~word)[word]
    ids, doc = ids[word], doc[word]
    if not len(ids):
        none = np.empty(0, np.int64)
        return none, none, none, none, none, np.empty(0)
    new = np.r_[True, (piece[1:] != piece[:-1]) | (doc[1:] != doc[:-1])]
    begin = np.flatnonzero(new)
    inside = np.arange(len(ids)) - np.repeat(begin, np.diff(np.r_[begin, len(ids)]))
    new |= inside % longest == 0
    begin = np.flatnonzero(new)
    letters = scorer.letters[ids]
    score, n_letters, owner = _sum(scorer.scores[ids], begin), _sum(letters, begin), doc[begin]
    n_words = np.diff(np.r_[begin, len(ids)])
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    total = _sum(score, first)
    text_of = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(owner)]))
    main, best, rows = total.argmax(1)[text_of], score.argmax(1), np.arange(len(score))
    language = np.where(score[rows, best] - score[rows, main] > margin, best, main)
    entropy = -score[rows, language] / (n_letters + n_words)
    language = np.where((entropy > scorer.models.reject) & (n_words >= 5), -1, language)
    run = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (language[1:] != language[:-1])])
    lang, run_score = language[run], _sum(score, run)
    sure = _softmax(run_score / scorer.models.temperature)[np.arange(len(run)), np.maximum(lang, 0)]
    place = np.arange(len(ids)) - np.repeat(begin[first], np.diff(np.r_[begin[first], len(ids)]))
    return owner[run], place[begin[run]], _sum(n_words, run), _sum(n_letters, run), lang, np.where(lang < 0, 0.0, sure)


def fit_models(documents: DataFrame, rows_per_language: int = 300, chars_per_language: int = 600_000, least_rows: int = 15, order: int = 5) -> CharModels | None:
    """Models of the languages that at least ``least_rows`` labels name.

    documents: doc_id, text, lang. The sample is the only part that is bounded: about ``rows_per_language`` rows of each
    label, picked by a hash of doc_id, and of these whole texts up to ``chars_per_language`` characters. Labels may be
    wrong in part: a first fit drops the sample's sentences that another language explains better, a second fit
    counts. A tenth of the kept sentences calibrates confidence and rejection.
    """
    named = documents.select("doc_id", "text", named_language(F.col("lang")).alias("language")).filter("language is not null and length(text) > 0")
    sizes = {r["language"]: r["n"] for r in named.groupBy("language").agg(F.count(F.lit(1)).alias("n")).collect() if r["n"] >= least_rows}
    if not sizes:
        return None
    languages = sorted(sizes)
    wanted = F.create_map(*chain.from_iterable((F.lit(k), F.lit(min(1.0, rows_per_language / n))) for k, n in sizes.items()))
    share = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(17)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = named.filter(share < F.coalesce(F.element_at(wanted, F.col("language")), F.lit(0.0))).orderBy("doc_id").limit(rows_per_language * len(languages) * 2)
    sentences: list[tuple[str, list[str]]] = []
    room = dict.fromkeys(languages, chars_per_language)
    for r in sample.toLocalIterator():
        if room[r["language"]] <= 0:
            continue
        room[r["language"]] -= len(r["text"])
        for part in re.split(r"[.!?…\n]+", r["text"].lower()):
            words = re.findall(r"[^\W\d_]+", part)
            if len(words) >= 3:
                sentences.append((r["language"], words))
    seen = Counter(c for _, words in sentences for w in words for c in w)
    alphabet = {c: i + _FIRST for i, (c, _) in enumerate(sorted(seen.items(), key=lambda x: (-x[1], x[0]))[: _BYTES - _FIRST])}
    blank = lambda: CharModels(languages, order, alphabet)

    def count(kept: list[tuple[str, list[str]]]) -> dict[str, Counter]:
        counts = {k: Counter() for k in languages}
        for language, words in kept:
            counts[language].update(words)
        return counts

    def scores(models: CharModels, kept: list[tuple[str, list[str]]]) -> np.ndarray:
        distinct = {w: i for i, w in enumerate(dict.fromkeys(w for _, words in kept for w in words))}
        table = models.score(list(distinct))
        return np.array([table[[distinct[w] for w in words]].sum(0) for _, words in kept])

    truth = np.array([languages.index(k) for k, _ in sentences])
    keep = scores(blank().fit(count(sentences)), sentences).argmax(1) == truth
    clean = [s for s, k in zip(sentences, keep) if k]
    held, rest = clean[::10], [s for i, s in enumerate(clean) if i % 10]
    models = blank().fit(count(rest))
    if held:
        score, label = scores(models, held), np.array([languages.index(k) for k, _ in held])
        loss = lambda t: -np.log(np.maximum(_softmax(score / t)[np.arange(len(held)), label], 1e-12)).mean()
        models.temperature = float(min(np.geomspace(0.5, 20, 24), key=loss))
        entropy = -score[np.arange(len(held)), label] / np.array([sum(map(len, w)) + len(w) for _, w in held])
        models.reject = float(np.quantile(entropy, 0.995) * 1.25 + 0.5)
    return models


def _labeller(shared, margin: float, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(shared.value)
        names = np.array([*shared.value.languages, "und"])
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                batch = whole.slice(start, 2000)
                doc, first, n_words, n_letters, lang, sure = stretches_of(batch.column("text").to_pylist(), scorer, margin, longest)
                number = np.arange(len(doc)) - np.searchsorted(doc, doc)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(doc)), pa.array(number.astype(np.int32)), pa.array(first.astype(np.int64)), pa.array(n_words.astype(np.int64)), pa.array(n_letters.astype(np.int64)), pa.array(names[lang].tolist(), pa.string()), pa.array(sure.astype(np.float64)), batch.column("named").take(pa.array(doc))],
                    names=["doc_id", "stretch", "first_word", "n_words", "n_letters", "lang", "confidence", "named"],
                )

    return run


def language_stretches(documents: DataFrame, margin: float = 8.0, longest: int = 30, **fit) -> DataFrame:
    """Stretches of one language each: (doc_id, stretch, first_word, n_words, n_letters, lang, confidence, named).

    documents: doc_id BIGINT, text, lang. ``named`` is the language that the label names, or null. Documents without a
    letter, null or empty texts have no stretch. Whole texts are read. Without labelled rows to fit on there are no
    models and so no stretches. Documents aren't shuffled; the models, bounded by the sample, are broadcast.
    """
    schema = "doc_id long, stretch int, first_word long, n_words long, n_letters long, lang string, confidence double, named string"
    spark = documents.sparkSession
    models = fit_models(documents, **fit)
    if models is None:
        return spark.createDataFrame([], schema)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", named_language(F.col("lang")).alias("named")).filter("length(text) > 0")
    return rows.mapInArrow(_labeller(spark.sparkContext.broadcast(models), margin, longest), schema)


def document_languages(stretches: DataFrame) -> DataFrame:
    """(doc_id, lang, share, confidence, named, n_letters): each language of a document with its share of the letters.

    The confidence is the mean of its stretches', weighted by letters. A document's id is taken as unique.
    """
    by = stretches.groupBy("doc_id", "lang").agg(F.sum("n_letters").alias("own"), (F.sum(F.col("confidence") * F.col("n_letters")) / F.sum("n_letters")).alias("confidence"), F.first("named").alias("named"))
    whole = by.groupBy("doc_id").agg(F.sum("own").alias("n_letters"), F.collect_list(F.struct("lang", "own", "confidence", "named")).alias("each"))
    return whole.select("doc_id", "n_letters", F.explode("each").alias("x")).select("doc_id", "x.lang", (F.col("x.own") / F.col("n_letters")).alias("share"), "x.confidence", "x.named", "n_letters")
