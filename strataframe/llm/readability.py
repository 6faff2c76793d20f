"""How demanding running prose is to read.

Each sentence gets the median of five classic grade estimates; a document is described by the histogram of its
sentences' grades. Bands are learnt from rated documents: a document mixes sentences of several bands, so the grades of
each band's sentences and each document's mixture are estimated together, and the band with the largest share counts.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataframe.llm.tex import prose

#: Grades of the histogram: classes of STEP from LOWEST on, CLASSES in all, the ends open.
LOWEST, STEP, CLASSES = -5.0, 0.5, 140
#: Rated documents that a fit uses at most; all are used where there are fewer.
FIT_DOCUMENTS = 20_000
_SENTENCE = re.compile(r"(?<=[.!?;])[\"')\]]*\s+|\n[ \t]*\n")
_LETTERS = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
#: Patterns as hyphenation has them, for neighbouring vowels. A digit stands between two letters, a full stop
#: for a word's end; the highest digit that any pattern puts in a place counts. Odd: the vowels part. Even: they sound as
#: one. Without any pattern vowels part.
PATTERNS = """
a2i a2u a2e e2a e2e e2i e2u i2e o2a o2i o2o o2u u2i u2e
qu2a qu2e qu2i qu2o gu2a gu2e gu2i su2ad su2av
ti2on ti2ous ti2al ti2an ti4en ci2on ci2ous ci2al ci2an ci4en si2on si2an si4en xi2on xi2ous gi2on gi2ous gi2an .gi3ant chi2on shi2on lli2on ni2on li2ar ri2age li2am
ge2ous pe4op je4op o2es. o2e. shoe4
cre3at re3act re3al .re4al. ne3ar. .ne4ar le3ar. .cle4ar ide3a are3a the3at pe3an e3ator e3ation
i3en fri4en sci5en i3et i3er. i3ers. i3est. .ti4er. .pi4er. nti4er .pri4es hi3er i3era i3ety
u3en u3el. u3els. u3et u3ity u3id .gu4id u3ing. u3ish ru3in tu3it genu3in ju3di bu4il gu4il
a3ing. e3ing. o3ing. i3ing. y3ing.
na3iv a3ic. a3ics. a3ical a3ity e3ity de3ity athe3is albe3it
e3um e3us. nucle3u co3op co3ord zo3olog
"""
_RULES = {"".join(c for c in p if not c.isdigit()): [int(d) if d else 0 for d in re.split(r"[^\d]", p)] for p in PATTERNS.split()}
_LONGEST = max(map(len, _RULES))
#: Endings in which an e is mute, and those in which an m sounds like a syllable.
_MUTE_END = re.compile(r"(?:[^aeiouy](?<![^aeiouyrl]l)(?<![^aeiouyrl]r)e|[gq]ue|[^aeiouysxzcg](?<![^aeiouyrl]l)(?<![sc]h)es|[gq]ues|[^aeiouytd](?<![^aeiouyrl]l)ed|eye|eyes)$")
_MUTE_INSIDE = re.compile(r"[aeiou][^aeiouyl]{1,2}e(?=(?:ment|ly|ful|less|ness|some|thing|where|times)s?)")
_LONE_M = re.compile(r"(?:s|th)ms?$")


#: The function words of each language: articles, pronouns, prepositions, conjunctions, auxiliaries.
FUNCTION_WORDS = {
    "en": """the a an of and to in is was were be been being are am it its he she they them their his her we us our you your i my me this that these those who whom whose which
what when where while why how if then than so as at by for from with without into onto over under near within along across between among through during before after above below
about against on off out up down not no nor or but because although though since until unless have has had having do does did can could may might must shall should will would there
here each every any some all both few more most other such only own same too very""",
    "de": """der die das den dem des ein eine einen einem einer eines und oder aber denn weil dass wenn als ob obwohl während bevor nachdem ist sind war waren wird werden wurde wurden hat
haben hatte kann können muss müssen soll nicht kein keine ich du er sie es wir ihr sich mich uns ihm ihn ihnen mein sein seine ihre unser dieser diese dieses diesen jeder jede jedes
welche in im an am auf aus bei beim mit nach von vom vor zu zum zur für durch gegen ohne um über unter zwischen neben hinter seit auch noch nur schon sehr so wie""",
    "fr": """le la les un une des du de d l et ou mais donc car ni ne pas plus que qui quoi dont où je tu il elle on nous vous ils elles me te se lui leur leurs mon ma mes son sa ses notre
votre ce cet cette ces est sont était étaient être a ont avait avoir fait peut dans en sur sous avec sans par pour vers chez entre avant après pendant depuis contre au aux si
comme quand lorsque puisque tandis parce chaque tout tous toute toutes même aussi très""",
    "es": """el la los las un una unos unas de del al y e o u pero sino porque que quien cual cuyo donde cuando como si no ni yo tú él ella nosotros ellos ellas me te se le les lo nos su sus
mi mis este esta estos estas ese esa esos esas es son era eran ser fue fueron está están ha han había haber hay puede en con sin por para sobre bajo entre desde hasta hacia ante
contra durante según mientras aunque pues cada todo toda todos todas más menos muy también ya""",
}
_WORD_LANGUAGES: dict[str, tuple[str, ...]] = {}
for _lang, _words in FUNCTION_WORDS.items():
    for _w in _words.split():
        _WORD_LANGUAGES[_w] = (*_WORD_LANGUAGES.get(_w, ()), _lang)
_LANGUAGES = tuple(FUNCTION_WORDS)
_CACHE: dict[str, int] = {}
_CACHE_WORDS = 200_000
STATS = "doc_id bigint, n_words int, n_sentences int, english double, grade double, flesch_kincaid double, fog double, smog double, coleman_liau double, automated double, histogram array<int>"


def syllables(word: str) -> int:
    """Syllables of a word in lower case: its vowels, those that :data:`PATTERNS` join as one, mute ones taken off. At least 1.

    A y between vowels or before the first one is a consonant.
    """
    n = _CACHE.get(word)
    if n is None:
        text = f".{''.join(c for c in unicodedata.normalize('NFD', word) if not unicodedata.combining(c))}."
        levels = [0] * (len(text) + 1)
        for i in range(len(text)):
            for j in range(i + 2, min(len(text), i + _LONGEST) + 1):
                for k, level in enumerate(_RULES.get(text[i:j], ())):
                    levels[i + k] = max(levels[i + k], level)
        vowel = [c in "aeiou" or (c == "y" and not (text[i + 1] in "aeiou" and text[i - 1] in "aeiou.")) for i, c in enumerate(text[:-1])]
        n = sum(v and not (vowel[i - 1] and levels[i] % 2 == 0 and levels[i]) and not (vowel[i - 1] and text[i] == "y") for i, v in enumerate(vowel) if i)
        n -= (n > 1 and bool(_MUTE_END.search(text[1:-1]))) + len(_MUTE_INSIDE.findall(word))
        n = max(1, n + bool(_LONE_M.search(word)))
        if len(_CACHE) >= _CACHE_WORDS:
            _CACHE.clear()
        _CACHE[word] = n
    return n


def estimates(words: np.ndarray, syllable: np.ndarray, letters: np.ndarray, hard: np.ndarray, sentences: np.ndarray | float = 1.0) -> np.ndarray:
    """Flesch-Kincaid, Gunning fog, SMOG, Coleman-Liau and automated readability grades, one column each."""
    length = words / sentences
    return np.stack(
        [
            0.39 * length + 11.8 * syllable / words - 15.59,
            0.4 * (length + 100.0 * hard / words),
            1.043 * np.sqrt(30.0 * hard / sentences) + 3.1291,
            5.88 * letters / words - 29.6 / length - 15.8,
            4.71 * letters / words + 0.5 * length - 21.43,
        ],
        axis=1,
    )


def sentence_counts(text: str) -> tuple[list[tuple[int, int, int, int]], dict[str, int]]:
    """(words, syllables, letters, words of three syllables or more) of each English sentence; words by language.

    A sentence is in the language of most of its function words; one without any is in that of most others. Fewer than
    three words make no sentence; a semicolon ends one like a full stop, as what follows could stand alone.
    """
    read: list[tuple[str | None, tuple[int, int, int, int]]] = []
    by = dict.fromkeys(_LANGUAGES, 0)
    for piece in _SENTENCE.split(text):
        words = _LETTERS.findall(piece)
        if len(words) < 3:
            continue
        low = [w.lower() for w in words]
        count = [syllables(w) for w in low]
        votes = dict.fromkeys(_LANGUAGES, 0)
        for w in low:
            for lang in _WORD_LANGUAGES.get(w, ()):
                votes[lang] += 1
        top = max(votes.values())
        lang = max(votes, key=votes.get) if top else None
        if lang:
            by[lang] += len(words)
        read.append((lang, (len(words), sum(count), sum(map(len, words)), sum(n >= 3 for n in count))))
    main = max(by, key=by.get)
    by[main] += sum(s[0] for lang, s in read if lang is None)
    return [s for lang, s in read if (lang or main) == "en"], by


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            counts, by = sentence_counts(prose(text.as_py()))
            total = sum(by.values())
            share = by["en"] / total if total else 0.0
            if counts:
                c = np.array(counts, dtype="float64")
                each = estimates(*c.T)
                grade = np.median(each, axis=1)
                whole = estimates(*[v.sum(keepdims=True) for v in c.T], sentences=float(len(c)))[0]
                classes = np.clip(np.floor((grade - LOWEST) / STEP), 0, CLASSES - 1).astype("int64")
                rows.append((doc, int(c[:, 0].sum()), len(c), share, float(np.median(grade)), *map(float, whole), np.bincount(classes, minlength=CLASSES).tolist()))
            else:
                rows.append((doc, 0, 0, share, None, None, None, None, None, None, [0] * CLASSES))
        kinds = [pa.int64(), pa.int32(), pa.int32(), *[pa.float64()] * 7, pa.list_(pa.int32())]
        names = [c.split()[0] for c in STATS.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)


def reading_stats(documents: DataFrame) -> DataFrame:
    """One row per document: its English words and sentences, the share of English among its words, grade estimates.

    ``grade`` is the median over the sentences of each one's median estimate; the five formulas are also given for the
    text as a whole; ``histogram`` counts sentences by half grades. Without English prose the grades are null. A null
    text counts as empty; rows with a null id are dropped; repeated rows give repeated rows; other columns are ignored.
    """
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).where("doc_id IS NOT NULL")
    return docs.mapInArrow(_measure, STATS)


def _mixture(classes: np.ndarray, dense: np.ndarray, prior: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the bands in each document (rows of ``classes``), and the sentences each band then claims."""
    weight = prior.copy()
    expected = None
    for _ in range(rounds):
        mix = np.maximum(weight @ dense, 1e-300)  # docs x classes
        ratio = classes / mix
        claims = weight * (ratio @ dense.T)  # docs x bands
        expected = (weight, ratio)
        weight = claims / np.maximum(claims.sum(axis=1, keepdims=True), 1e-300)
    weight, ratio = expected
    return claims / np.maximum(claims.sum(axis=1, keepdims=True), 1e-300), dense * (weight.T @ ratio)


def fit_bands(histograms: np.ndarray, ratings: Sequence[dict[int, int]], bands: int = 5, rounds: int = 25) -> np.ndarray:
    """Distribution of sentence grades in each band (bands x classes) from rated documents.

    Starts from the sentences of the documents by their ratings, then alternates between each document's mixture, held
    near its ratings, and the sentences that each band claims. Bands that nobody gave are centred between the others.
    """
    prior = np.full((len(ratings), bands), 0.04)
    for k, votes in enumerate(ratings):
        for b, n in votes.items():
            prior[k, b - 1] += 0.8 * n / sum(votes.values())
    prior /= prior.sum(axis=1, keepdims=True)
    claimed = prior.T @ histograms
    for _ in range(rounds):
        dense = (claimed + 0.3) / (claimed + 0.3).sum(axis=1, keepdims=True)
        weight = prior
        for _ in range(4):
            mix, claimed = _mixture(histograms, dense, weight, 1)
            weight = 0.75 * mix + 0.25 * prior
    return (claimed + 0.3) / (claimed + 0.3).sum(axis=1, keepdims=True)


def band_of(histograms: np.ndarray, dense: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band (from 1) with the largest share of each document's sentences, and that share."""
    weight, _ = _mixture(histograms.astype("float64"), dense, np.full((len(histograms), len(dense)), 1 / len(dense)), 40)
    return weight.argmax(axis=1) + 1, weight.max(axis=1)


def with_bands(stats: DataFrame, grades: DataFrame, least_words: int = 100, least_english: float = 0.5, fit: int = FIT_DOCUMENTS) -> DataFrame:
    """``doc_id, band, band_share`` of documents with enough English prose.

    ``grades`` has ``doc_id, grade`` (1 to 5), any number per document; others are ignored. The bands are fitted on about
    ``fit`` rated documents at most, chosen by a hash of their ids. Without any rated document there are no bands, and the
    result is empty.
    """
    enough = stats.where(f"n_words >= {int(least_words)} AND english > {float(least_english)}")
    votes = grades.where("grade BETWEEN 1 AND 5").groupBy("doc_id").agg(F.collect_list("grade").alias("votes"))
    part = min(1.0, fit / max(1, votes.count()))  # of the hashes' range, so that no task sends more than its part
    rated = enough.join(votes, "doc_id").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(part * (1 << 30))).select("histogram", "votes").limit(2 * int(fit)).toArrow()
    if not rated.num_rows:
        return stats.sparkSession.createDataFrame([], "doc_id bigint, band int, band_share double")
    histograms = np.array(rated["histogram"].to_pylist(), dtype="float64")
    ratings = [{g: v.count(g) for g in set(v)} for v in rated["votes"].to_pylist()]
    dense = fit_bands(histograms, ratings)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                flat = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
                band, share = band_of(flat, dense)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(band, pa.int32()), pa.array(share)], names=["doc_id", "band", "band_share"])

    return enough.select("doc_id", "histogram").mapInArrow(apply, "doc_id bigint, band int, band_share double")
