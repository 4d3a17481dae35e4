"""Language identification in two levels: a language family first, then one-versus-one linear SVMs within it.

Features are byte n-grams of the lower-cased letters of a text (digits, punctuation and markup are blanks), hashed to a
table; each weighs its count over the square root of the sum of squares. The family is the argmax of one-versus-rest SVMs over
families; inside a family, each pair of languages has an SVM of its own and the pair votes decide, ties by summed margins.

Models are fitted on the driver from a bounded sample: at most sample_per_language different texts a language, those of the smallest
text hashes. Executors make the features of these, from whole texts, so that the driver holds at most DIMENSION numbers a sampled
text and never a text. Weights are broadcast: DIMENSION floats for each family and pair, whatever the corpus size.

An SVM names one of the learned languages for any text. Whether the text is of that language is decided apart, by two shares:
of its letter trigrams, those that the sample of the language has, and of its bytes that are not white space, those of letters.
The limits are parts (COVER_PART, LETTER_PART) of what LOW_SHARE of the sample's own texts are below, each held against the
others; a language of fewer than LEAST_TEXTS different texts in the sample has no limits, as too little is known of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import share_code

#: Families of languages by ISO 639-1 code: fixed values. A language that is not listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt rm ro",
    "slavic": "be bg bs cs hr mk pl ru sh sk sl sr uk",
    "uralic": "et fi hu se",
    "turkic": "az kk ky tr tt ug uz",
    "indic": "as bn gu hi mr ne or pa sa si ur",
    "semitic": "am ar he mt",
    "dravidian": "kn ml ta te",
}
UNDETERMINED = "und"
SAMPLE_PER_LANGUAGE = 600
MOST_LANGUAGES = 256
DIMENSION = 1 << 17
LOW_SHARE = 0.05
LEAST_TEXTS = 20
COVER_PART = 0.5
LETTER_PART = 0.25
_ORDERS = (1, 2, 3, 4)
_LETTER = np.array([chr(b).isascii() and chr(b).isalpha() or b >= 128 for b in range(256)])
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], np.uint8)


def has_letters(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def family_of(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang in langs.split()), lang)


def _letters(text: str) -> np.ndarray:
    """The lower-cased bytes of a text's letters, with a blank for all that stands between."""
    raw = _FOLD[np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)]
    raw = raw[np.append(True, (raw[1:] != 32) | (raw[:-1] != 32))] if len(raw) else raw
    return np.concatenate([[32], raw, [32]]).astype(np.uint32)


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The letter trigrams of a text as numbers, ascending, and how often each occurs."""
    raw = _letters(text)
    return np.unique((raw[:-2] * np.uint32(256) + raw[1:-1]) * np.uint32(256) + raw[2:], return_counts=True)


def letter_share(text: str) -> float:
    """The share of letters among the bytes of a text that are not ASCII white space."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    return float(_LETTER[raw].sum() / max(1, (~np.isin(raw, (9, 10, 11, 12, 13, 32))).sum()))


def features(text: str) -> np.ndarray:
    """The hashed n-gram numbers of a text, with repeats."""
    raw = _letters(text)
    out, code = [], np.zeros(len(raw), np.uint32)
    for n in _ORDERS:
        code = code[: len(raw) - n + 1] * np.uint32(257) + raw[n - 1 :]
        mixed = (code + np.uint32(n)) * np.uint32(2654435761)
        out.append((mixed ^ (mixed >> np.uint32(15))) % np.uint32(DIMENSION))
    return np.concatenate(out).astype(np.int64)


def vector(text: str) -> tuple[np.ndarray, np.ndarray]:
    ids, counts = np.unique(features(text), return_counts=True)
    values = np.sqrt(counts)
    return ids, (values / np.sqrt((values**2).sum())).astype(np.float32)


def fit_svm(rows: list[tuple[np.ndarray, np.ndarray]], sign: np.ndarray, c: float = 4.0, rounds: int = 12) -> np.ndarray:
    """Weights of a linear SVM with squared hinge loss by dual coordinate descent, classes weighted to balance."""
    w = np.zeros(DIMENSION + 1, np.float32)
    weight = np.where(sign > 0, 0.5 / max(1, (sign > 0).sum()), 0.5 / max(1, (sign < 0).sum())) * len(sign)
    diagonal, alpha = 1 / (2 * c * weight), np.zeros(len(sign))
    order = np.random.default_rng(3)
    norm = np.array([float((v**2).sum()) + 1 for _, v in rows])
    for _ in range(rounds):
        for i in order.permutation(len(rows)):
            ids, values = rows[i]
            gradient = sign[i] * (float(w[ids] @ values) + w[-1]) - 1 + diagonal[i] * alpha[i]
            new = max(0.0, alpha[i] - gradient / (norm[i] + diagonal[i]))
            step = (new - alpha[i]) * sign[i]
            if step:
                w[ids] += np.float32(step) * values
                w[-1] += np.float32(step)
                alpha[i] = new
    return w


@dataclass
class Sample:
    """What fitting needs of one text: its vector, its letter trigrams with their numbers, and its share of letters."""

    lang: str
    ids: np.ndarray
    values: np.ndarray
    grams: np.ndarray
    times: np.ndarray
    letters: float


@dataclass
class Model:
    languages: list[str]
    families: list[str]
    family_weights: np.ndarray
    pairs: dict[str, list[tuple[str, str]]] = field(default_factory=dict)
    pair_weights: dict[str, np.ndarray] = field(default_factory=dict)
    trigrams: dict[str, np.ndarray] = field(default_factory=dict)
    limits: dict[str, tuple[float, float]] = field(default_factory=dict)

    @classmethod
    def fit(cls, sample: list[Sample]) -> Model:
        known = sorted({x.lang for x in sample})
        rows = [(x.ids, x.values) for x in sample]
        lang = np.array([x.lang for x in sample], dtype=object)
        family = np.array([family_of(x) for x in lang], dtype=object)
        families = sorted(set(family))
        if len(families) > 1:
            weights = np.stack([fit_svm(rows, np.where(family == f, 1, -1)) for f in families])
        else:
            weights = np.zeros((len(families), DIMENSION + 1), np.float32)
        out = cls(known, families, weights)
        for f in families:
            pairs = list(combinations([x for x in known if family_of(x) == f], 2))
            out.pairs[f] = pairs
            if pairs:
                owns = [np.flatnonzero((lang == a) | (lang == b)) for a, b in pairs]
                out.pair_weights[f] = np.stack([fit_svm([rows[i] for i in own], np.where(lang[own] == a, 1, -1)) for (a, _), own in zip(pairs, owns, strict=True)])
        for x in known:
            own = [s for s in sample if s.lang == x]
            if len(own) < LEAST_TEXTS:
                continue
            out.trigrams[x], times = np.unique(np.concatenate([s.grams for s in own]), return_counts=True)
            covers = [float(s.times[times[np.searchsorted(out.trigrams[x], s.grams)] > 1].sum() / s.times.sum()) for s in own]
            low = (float(np.quantile(v, LOW_SHARE)) for v in (covers, [s.letters for s in own]))
            out.limits[x] = (COVER_PART * next(low), LETTER_PART * next(low))
        return out

    def belongs(self, text: str, lang: str) -> bool:
        """Whether a text predicted as lang reaches the limits of lang."""
        if lang not in self.limits:
            return True
        cover, letters = self.limits[lang]
        grams, n = trigrams(text)
        known = self.trigrams[lang]
        at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
        return bool(n[known[at] == grams].sum() >= cover * n.sum() and letter_share(text) >= letters)

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score): the score is the logistic of the winning family's lead times that of the winning language's."""
        if not self.languages or not has_letters(text):
            return UNDETERMINED, 0.0
        counts = np.bincount(features(text), minlength=DIMENSION)
        ids = np.flatnonzero(counts)
        values = np.sqrt(counts[ids])
        values /= np.sqrt((values**2).sum())
        family, sure = self.families[0], 1.0
        if len(self.families) > 1:
            margins = self.family_weights[:, ids] @ values + self.family_weights[:, -1]
            best = int(margins.argmax())
            family, sure = self.families[best], _logistic(margins[best] - np.delete(margins, best).max())
        own = [x for x in self.languages if family_of(x) == family]
        if len(own) == 1:
            return own[0], float(sure)
        margins = self.pair_weights[family][:, ids] @ values + self.pair_weights[family][:, -1]
        votes, total, least = dict.fromkeys(own, 0), dict.fromkeys(own, 0.0), dict.fromkeys(own, np.inf)
        for (a, b), m in zip(self.pairs[family], margins, strict=True):
            votes[a if m >= 0 else b] += 1
            total[a], total[b] = total[a] + m, total[b] - m
            least[a], least[b] = min(least[a], m), min(least[b], -m)
        won = max(own, key=lambda x: (votes[x], total[x], x))
        return won, float(sure * _logistic(2 * least[won]))


def _logistic(x: float) -> float:
    return float(1 / (1 + np.exp(-2 * np.clip(x, -20, 20))))


def remainder(doc_id: Column) -> Column:
    """crc32 of the doc_id as text, modulo 3; null for a null doc_id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3))


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["lang", "h", "ids", "vals", "grams", "times", "letters"]
    for batch in batches:
        for k in range(batch.num_rows):
            text = batch.column(2)[k].as_py()
            parts = [*vector(text), *trigrams(text)]
            kinds = (pa.int32(), pa.float32(), pa.int32(), pa.int64())
            lists = [pa.array([x], pa.list_(t)) for x, t in zip(parts, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), batch.column(1).slice(k, 1), *lists, pa.array([letter_share(text)])], names=names)


def sample(rows: DataFrame, per_language: int, most_languages: int = MOST_LANGUAGES) -> list[Sample]:
    """The per_language different texts of each language that have the smallest hashes; a bounded result, made from whole texts.

    Copies of a text count once, however many there are. More than most_languages languages raise a ValueError: none is left
    out unseen.
    """
    share_code(rows.sparkSession)
    rows = rows.select("lang", F.xxhash64("text").alias("h"), "text")
    langs = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).limit(most_languages + 1).collect()}
    if len(langs) > most_languages:
        raise ValueError(f"more than {most_languages} languages to learn; raise most_languages if the driver has the memory for their models")
    if not langs:
        return []
    # about 1.5 times as many as wanted lie below a language's limit, whatever its size
    limits = {k: min((1 << 63) - 1, int((min(1.0, 1.5 * per_language / n) - 0.5) * (1 << 64))) for k, n in langs.items()}
    limit = F.element_at(F.create_map(*[F.lit(x) for k, v in limits.items() for x in (k, v)]), F.col("lang"))
    chosen = rows.where(F.col("h") <= limit).groupBy("lang", "h").agg(F.first("text").alias("text"))
    found = chosen.mapInArrow(_sampled, "lang string, h long, ids array<int>, vals array<float>, grams array<int>, times array<long>, letters double").toArrow()
    made = [[c.to_numpy(zero_copy_only=False) for c in (found["ids"], found["vals"], found["grams"], found["times"])], found["letters"].to_pylist()]
    taken, out = dict.fromkeys(langs, 0), []
    for h, lang, k in sorted(zip(found["h"].to_pylist(), found["lang"].to_pylist(), range(found.num_rows), strict=True)):
        if taken[lang] < per_language:
            taken[lang] += 1
            out.append(Sample(lang, *(np.asarray(c[k]) for c in made[0]), made[1][k]))
    return out


def fit(docs: DataFrame, sample_per_language: int = SAMPLE_PER_LANGUAGE, text: str = "text", lang: str = "lang", most_languages: int = MOST_LANGUAGES) -> Model:
    """A model from the rows of docs with a language and a text that has letters; see sample() for most_languages."""
    rows = docs.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).where(r"lang is not null and text rlike '\\p{L}'")
    return Model.fit(sample(rows, sample_per_language, most_languages))


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, lang_pred, score.

    Defined results: a null text or one without a letter is "und" with score 0, as is every text if nothing was learned;
    rows with a repeated or null doc_id are predicted each by itself; columns other than the text play no part.
    """
    spark = docs.sparkSession
    share_code(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = shared.value
        for batch in batches:
            found = [here.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_determined(docs: DataFrame, sample_per_language: int = SAMPLE_PER_LANGUAGE, text: str = "text", most_languages: int = MOST_LANGUAGES) -> DataFrame:
    """The rows of docs whose language the model can tell, all columns unchanged; the model learns as in identify().

    Texts that are "und" go (null ones and ones without a letter), and those that miss the limits of the language they are
    predicted as: texts in languages that were not learned, gibberish, and single letters among digits or signs. If nothing
    could be learned, all texts with letters stay.
    """
    spark = docs.sparkSession
    share_code(spark)
    learned = docs.where(F.coalesce(remainder(F.col("doc_id")), F.lit(0)) != 1)
    shared = spark.sparkContext.broadcast(fit(learned, sample_per_language, text, most_languages=most_languages))
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = shared.value
        for batch in batches:
            texts = (t.as_py() for t in batch.column(at))
            known = [has_letters(t) and (not here.languages or here.belongs(t, here.predict(t)[0])) for t in texts]
            yield batch.filter(pa.array(known, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def identify(docs: DataFrame, sample_per_language: int = SAMPLE_PER_LANGUAGE, most_languages: int = MOST_LANGUAGES) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score; learned from documents that are not held out.

    held_out: crc32(doc_id as text) mod 3 is 1 (false for a null doc_id).
    """
    learned = docs.where(F.coalesce(remainder(F.col("doc_id")), F.lit(0)) != 1)
    out = predict(docs, fit(learned, sample_per_language, most_languages=most_languages))
    return out.select("doc_id", F.coalesce(remainder(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
