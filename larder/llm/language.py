"""Document language labels checked and supplied word by word.

Letters narrow the candidate languages of each word; trained word and letter-sequence frequencies score them; a Viterbi
pass with a switching penalty, smaller where a sentence begins, labels the spans of every text. A language counts for a
document if one of its spans is longer than a borrowed phrase.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LANGUAGES = ["ru", "uk", "be", "kk", "en", "de", "fr", "es", "it", "pl"]
#: Labelled rows the scores are fitted on, about, chosen by a hash of the key; more do not change them noticeably.
FIT_ROWS = 20_000
#: Characters of a text that the scores may be fitted on; longer texts are labelled like all others but not fitted on.
FIT_CHARS = 20_000
#: Most words of the model; rarer ones are scored by their letter sequences.
MODEL_WORDS = 100_000
#: Cost of a change of language inside a sentence and where one begins; words a borrowed phrase may have.
SWITCH, SWITCH_AT_SENTENCE, BORROWED = 9.0, 4.0, 3
#: Credit a word for the language of the text as a whole: decides sentences of shared words and names only.
CONTEXT = 0.3
#: Share of a sentence's words that is most of it, and words of a run that counts within a longer sentence (unpunctuated text).
MOST, LONG_RUN = 0.6, 8
#: Least log score of a language for a known word, and for a word known by its letters only.
FLOOR, LETTER_FLOOR = -6.0, -3.0
#: Rounds of relabelling the sentences of the fitting rows.
ROUNDS = 3
#: Credit of the label a text or sentence had before.
CREDIT = 3.0

#: Spellings of language names and codes in lower case; a region after a hyphen is cut off first.
LABELS = {
    "ru": "ru rus russian русский русская ru_ru", "uk": "uk ukr ukrainian украинский українська ua", "be": "be bel belarusian belarussian белорусский беларуская by",
    "kk": "kk kaz kazakh казахский қазақша қазақ", "en": "en eng english английский", "de": "de deu ger german deutsch немецкий",
    "fr": "fr fra fre french français francais французский", "es": "es spa spanish español espanol испанский", "it": "it ita italian italiano итальянский", "pl": "pl pol polish polski польский",
}
_NAMED = {name: code for code, names in LABELS.items() for name in names.split()}
#: Letters that only some of the languages have.
LETTERS = {
    "ў": "be", "ї": "uk", "є": "uk", "ґ": "uk", "і": "uk be kk", "қ": "kk", "ғ": "kk", "ң": "kk", "ұ": "kk", "ү": "kk", "ә": "kk", "һ": "kk", "ө": "kk",
    "ы": "ru be kk", "э": "ru be kk", "ё": "ru be kk", "ъ": "ru kk", "и": "ru uk kk", "щ": "ru uk kk", "ß": "de", "ñ": "es", "ł": "pl", "ą": "pl", "ę": "pl", "ś": "pl", "ź": "pl", "ż": "pl", "ń": "pl", "ć": "pl",
    "ä": "de", "ö": "de", "œ": "fr", "ç": "fr", "ê": "fr", "î": "fr", "ô": "fr", "û": "fr", "ë": "fr", "ï": "fr", "â": "fr", "ì": "it", "ò": "it",
}
#: One Latin spelling of the Cyrillic letters, by which trained words also count in Latin letters.
LATIN = {
    "а": "a", "б": "b", "в": "v", "г": "g", "ґ": "g", "д": "d", "е": "e", "ё": "e", "є": "ye", "ж": "zh", "з": "z", "и": "i", "і": "i", "ї": "yi", "й": "y", "к": "k", "л": "l",
    "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ў": "u", "ф": "f", "х": "h", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "sch", "ъ": "", "ы": "y",
    "ь": "", "э": "e", "ю": "yu", "я": "ya", "ә": "a", "ғ": "g", "қ": "k", "ң": "n", "ө": "o", "ұ": "u", "ү": "u", "һ": "h", "'": "", "’": "", "ʼ": "",
}
#: Languages whose words may also stand in Latin letters; each is a class of its own beside the ten.
SPELLED = ["ru", "uk", "be", "kk"]

_TOKEN = regex.compile(
    r"(?P<skip>(?:https?://|www\.)\S+|<[^<>\n]*>|&#?\w{1,10};|[#@]\w+|\S+@\S+|\w*\p{N}[\w]*)|(?P<word>\p{L}[\p{L}\p{M}]*(?:['’ʼ]\p{L}[\p{L}\p{M}]*)*)|(?P<end>[.!?…\n\r|]+)|(?P<mark>[()\[\]]+)", regex.V1
)
_CYRILLIC = regex.compile(r"\p{Cyrillic}")
_REPEATED = regex.compile(r"(.)\1{4,}|.{41,}")
#: Classes: the ten languages in their own letters, then the transliterated ones.
CLASSES = [*LANGUAGES, *SPELLED]
_N = len(CLASSES)
_INDEX = {code: i for i, code in enumerate(LANGUAGES)}
_OWN, _OTHER = np.array([_INDEX[c] for c in SPELLED]), np.arange(len(LANGUAGES), _N)


def label_language(label: str | None) -> str | None:
    """Code of the language a label names, in any known spelling; null if it names none of the ten."""
    key = (label or "").strip().lower()
    return _NAMED.get(key) or _NAMED.get(regex.split("[-_]", key)[0])


def tokens(text: str) -> Iterator[tuple[str, int, int, bool, bool]]:
    """(word in lower case, start, end, whether it begins a sentence, whether it begins a piece) of a text; a piece ends with
    a sentence or at a bracket. Addresses, tags, codes and numbers are no words."""
    begins = piece = True
    for m in _TOKEN.finditer(text):
        kind = m.lastgroup
        if kind == "word":
            word = m.group()
            if not _REPEATED.search(word):
                yield word.lower().replace("’", "'").replace("ʼ", "'"), m.start(), m.end(), begins, piece
                begins = piece = False
        elif kind == "end":
            begins = piece = True
        elif kind == "mark":
            piece = True


def _candidates(word: str) -> np.ndarray:
    """Classes whose letters a word may be written in: a Cyrillic word leaves the Cyrillic languages, a Latin one the others
    and the transliterated ones; letters of few languages leave only those."""
    allowed = np.ones(_N, bool)
    cyrillic = bool(_CYRILLIC.search(word))
    allowed[_OWN] = cyrillic
    allowed[len(SPELLED) :] = not cyrillic
    for letter in set(word):
        if letter in LETTERS:
            codes = LETTERS[letter].split()
            allowed &= np.array([c in codes for c in LANGUAGES] + [False] * len(SPELLED))
    return allowed if allowed.any() else np.ones(_N, bool)


def _grams(word: str) -> list[str]:
    padded = f"<{word}>"
    return [padded[i : i + n] for n in (2, 3, 4) for i in range(len(padded) - n + 1)]


def _latin(word: str) -> str:
    return "".join(LATIN.get(c, c) for c in word)


class Model:
    """Log scores of the languages for a word: from the word's frequencies if it was trained, else from its letter sequences."""

    def __init__(self, words: dict[str, np.ndarray], grams: dict[str, np.ndarray]):
        self.words, self.grams, self.cache = words, grams, {}

    @classmethod
    def fit(cls, texts: list[tuple[str, str]]) -> Model:
        """From (text, language label) rows. Words start with the label of their text where their letters allow it; then
        texts are relabelled by all their words and sentences by theirs, each with some credit for the label before, so
        wrong and mixed labels lose their hold. Words of the Cyrillic languages also count, in Latin spelling, for the
        transliterated class of the language."""
        vocabulary: dict[str, int] = {}
        ids, sentence_of, label_of, text_of, n_texts = [], [], [], [], 0
        for text, label in texts:
            if label not in _INDEX:
                continue
            fresh = True
            for word, _, _, begins, _ in tokens(text):
                if begins or fresh:
                    n_texts += fresh
                    label_of.append(_INDEX[label])
                    text_of.append(n_texts - 1)
                    fresh = False
                ids.append(vocabulary.setdefault(word, len(vocabulary)))
                sentence_of.append(len(label_of) - 1)
        if not ids:
            return cls({}, {})
        for word in [w for w in vocabulary if _CYRILLIC.search(w)]:
            if spelled := _latin(word):
                vocabulary.setdefault(spelled, len(vocabulary))
        wid, sid, labels, tid = np.array(ids), np.array(sentence_of), np.array(label_of), np.array(text_of)
        whole = labels
        allowed = np.stack([_candidates(w) for w in vocabulary])
        pairs = np.array([(i, vocabulary[_latin(w)]) for w, i in list(vocabulary.items()) if _CYRILLIC.search(w) and _latin(w)]).reshape(-1, 2)
        for n in range(ROUNDS + 1):
            counts = np.zeros((len(vocabulary), _N))
            np.add.at(counts, (wid, labels[sid]), 1.0)
            counts *= allowed
            for own, other in zip(_OWN, _OTHER, strict=True):
                np.add.at(counts[:, other], pairs[:, 1], counts[pairs[:, 0], own])
            scores = cls._scores(counts, allowed)
            if n == ROUNDS:
                break
            sums = np.zeros((len(labels), _N))
            np.add.at(sums, sid, scores[wid])
            if n == 0:
                by_text = np.zeros((n_texts, _N))
                np.add.at(by_text, tid, sums)
                by_text[tid, labels] += CREDIT  # every sentence of a text has its label: the credit is set, not summed
                whole = labels = by_text.argmax(1)[tid]
            else:
                sums[np.arange(len(labels)), whole] += CREDIT
                labels = sums.argmax(1)
        names = list(vocabulary)
        grams: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(_N))
        for w, r in zip(names, counts / np.maximum(counts.sum(0), 1.0), strict=True):
            for g in set(_grams(w)):
                grams[g] += np.sqrt(r)
        keep = np.argsort(-counts.sum(1), kind="stable")[:MODEL_WORDS]
        total = np.maximum(sum(grams.values()), 1e-9)
        letter = {g: np.log((v / total + 1e-5) / (v / total + 1e-5).sum()).astype(np.float32) for g, v in grams.items()}
        return cls({names[i]: scores[i].astype(np.float32) for i in keep}, letter)

    @staticmethod
    def _scores(counts: np.ndarray, allowed: np.ndarray) -> np.ndarray:
        """Log share of each language in a word's rates, smoothed so that rare words decide less."""
        total = np.maximum(counts.sum(0), 1.0)
        rate = counts / total + 0.3 / max(float(np.median(total)), 1.0) / _N
        rate = np.where(allowed, rate, 1e-12)
        return np.maximum(np.log(rate / rate.sum(1, keepdims=True)), FLOOR)

    def score(self, word: str) -> np.ndarray:
        found = self.words.get(word)
        if found is not None:
            return found
        found = self.cache.get(word)
        if found is None:
            allowed = _candidates(word)
            seen = [self.grams[g] for g in _grams(word) if g in self.grams]
            raw = np.mean(seen, 0) * 2 if seen else np.zeros(_N)
            raw = np.where(allowed, raw, -1e3)
            raw = raw - raw.max()
            found = np.maximum(raw - math.log(np.exp(raw).sum()), np.where(allowed, LETTER_FLOOR, FLOOR)).astype(np.float32)
            if len(self.cache) > 200_000:
                self.cache.clear()
            self.cache[word] = found
        return found


def viterbi(scores: np.ndarray, switch: np.ndarray) -> np.ndarray:
    """Best language of each word: scores (words, languages), cost of a change before each word."""
    n = len(scores)
    back = np.zeros((n, scores.shape[1]), np.int8)
    best = scores[0].astype(np.float64)
    own = np.arange(scores.shape[1])
    for t in range(1, n):
        top = int(best.argmax())
        moved = best[top] - switch[t]
        stay = best >= moved
        back[t] = np.where(stay, own, top)
        best = np.where(stay, best, moved) + scores[t]
    path = np.zeros(n, np.int64)
    path[-1] = int(best.argmax())
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def label_text(model: Model, text: str | None) -> list[tuple[str, int, int, int, float]]:
    """Spans (language, start, end, words, confidence) of a text that are longer than a borrowed phrase; shorter ones join
    the span before them. A text with no longer span is one span; a text without words has none."""
    words = list(tokens(text)) if text else []
    if not words:
        return []
    scores = np.stack([model.score(w[0]) for w in words])
    begins, piece = np.array([w[3] for w in words]), np.array([w[4] for w in words])
    # where every word agrees, the path needs no search
    total = scores.sum(0)
    near = scores.copy()
    near[:, int(total.argmax())] += CONTEXT
    path = viterbi(near, np.where(begins, SWITCH_AT_SENTENCE, SWITCH)) if (scores.argmax(1) != total.argmax()).any() else np.full(len(words), int(total.argmax()))
    path[path >= len(LANGUAGES)] = _OWN[path[path >= len(LANGUAGES)] - len(LANGUAGES)]
    cuts = [0, *(np.flatnonzero(path[1:] != path[:-1]) + 1).tolist(), len(words)]
    runs = [[int(path[a]), a, b] for a, b in zip(cuts, cuts[1:], strict=False)]

    first = [0, *(1 + np.flatnonzero(begins[1:])).tolist(), len(words)]

    def whole(a: int, b: int) -> bool:
        """Whether words a to b hold most of a sentence with a piece longer than a borrowed phrase, or a run no name has."""
        for s, e in zip(first, first[1:], strict=False):
            lo, hi = max(a, s), min(b, e)
            if hi - lo > BORROWED:
                starts = [lo, *(lo + 1 + np.flatnonzero(piece[lo + 1 : hi])).tolist(), hi]
                run = max(np.diff(starts))
                if run > BORROWED and (hi - lo >= MOST * (e - s) or run >= LONG_RUN):
                    return True
        return False

    long = [whole(a, b) for _, a, b in runs]
    if not any(long):
        best = int(total.argmax())
        runs = [[int(_OWN[best - len(LANGUAGES)]) if best >= len(LANGUAGES) else best, 0, len(words)]]
    else:
        kept: list[list[int]] = []
        for (lang, a, b), enough in zip(runs, long, strict=True):
            if enough and not (kept and kept[-1][0] == lang):
                kept.append([lang, a, b])
            elif kept:
                kept[-1][2] = b
        kept[0][1] = 0
        runs = kept
    folded = scores[:, : len(LANGUAGES)].astype(np.float64)
    folded[:, _OWN] = np.maximum(folded[:, _OWN], scores[:, _OTHER])
    out = []
    for lang, a, b in runs:
        sums = folded[a:b].sum(0)
        share = float(1 / np.exp(np.minimum(sums - sums[lang], 50)).sum())
        out.append((LANGUAGES[lang], words[a][1], words[b - 1][2], b - a, share))
    return out


def fit_model(documents: DataFrame, key: str, text: str, label: str, rows: int = FIT_ROWS) -> Model:
    """The model of the labelled rows of a corpus: about ``rows`` of them, chosen evenly by a hash of the key."""
    names = F.array(*[F.lit(n) for n in sorted(_NAMED)])
    code = F.lower(F.trim(F.col(label)))
    named = documents.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(label).alias("l")).filter(F.array_contains(names, code) | F.array_contains(names, F.split(code, "[-_]")[0]))
    labelled = named.filter(F.col("t").isNotNull() & (F.length("t") <= FIT_CHARS))
    n = labelled.count()
    buckets = 1 << 20
    share = buckets if n <= rows else int(buckets * rows / n)
    sample = labelled.filter(F.pmod(F.xxhash64("k"), F.lit(buckets)) < share).select("k", "t", "l").collect()
    return Model.fit([(r["t"], label_language(r["l"]) or "") for r in sorted(sample, key=lambda r: str(r["k"]))])


def label_spans(documents: DataFrame, key: str, text: str, label: str, model: Model | None = None) -> DataFrame:
    """(key, label, label_lang, spans ARRAY<STRUCT<lang, start, stop, words, confidence>>) of every document.

    Defined cases: null, empty and wordless texts have no spans; a missing, blank or unknown label has ``label_lang`` null;
    repeated rows are labelled alike; without any labelled row, letters alone decide; an empty table gives an empty one;
    extra columns do not matter. No shuffle: one pass for the fitting rows, one for the spans."""
    model = model or fit_model(documents, key, text, label)
    shared = documents.sparkSession.sparkContext.broadcast((model.words, model.grams))  # bounded by MODEL_WORDS and FIT_ROWS
    kind = dict(documents.dtypes)[key]
    held: list[Model] = []
    struct = pa.struct([("lang", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("words", pa.int32()), ("confidence", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not held:
            held.append(Model(*shared.value))
        for batch in batches:
            spans = [[dict(zip(("lang", "start", "stop", "words", "confidence"), s, strict=True)) for s in label_text(held[0], t)] for t in batch.column(1).to_pylist()]
            named = [label_language(v) for v in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(named, pa.string()), pa.array(spans, pa.list_(struct))], names=[key, "label", "label_lang", "spans"])

    out = f"`{key}` {kind}, label string, label_lang string, spans array<struct<lang:string,start:int,stop:int,words:int,confidence:double>>"
    return documents.select(F.col(key), F.col(text).alias("_t"), F.col(label).alias("_l")).mapInArrow(run, out)


def doubtful_labels(spans: DataFrame, key: str) -> DataFrame:
    """(key, lang): the languages of each document with words whose label is missing or names another language, or whose text mixes languages."""
    found = spans.withColumn("_langs", F.array_distinct(F.transform("spans", lambda s: s["lang"])))
    case = F.col("label_lang").isNull() | ~F.array_contains("_langs", F.col("label_lang")) | (F.size("_langs") > 1)
    return found.filter((F.size("_langs") > 0) & case).select(key, F.explode("_langs").alias("lang"))
