from __future__ import annotations

import numpy as np
import pytest

from strataframe.llm.readability import CLASSES, band_of, fit_bands, reading_stats, sentence_counts, syllables, with_bands
from strataframe.llm.tex import prose

PLAIN = "The cat sat on the mat. We saw a dog by the tree. It ran to the old wall. "
HARD = "The probabilistic characterisation of the heterogeneous meteorological instrumentation necessitated considerable methodological sophistication, notwithstanding the unavailability of corresponding observational documentation. "


#: Words by their number of syllables.
SYLLABLES = {
    1: "bread build called cat clear coin cool eye eyes field free friend fruit goes guess guide head heart juice jumped league learn makes near phone phrase plea point queue real sea shoe square suit takes tea the toes trees tried vague voice year",
    2: "achieve agree ancient antique apples awesome beauty being believe beyond boxes bureau carried changes chaos client create cruel decrease dial diet doing duet early equal faces fluent fluid freedom fuel giant going handled heroes hopeful houses increase language leather little lonely loyal machine measure measured million movement movie naive nation nature needed oblique ocean oceans onion partial patient people persuade player pleasure poem precious prism question quickly quiet react region release require research rhythm royal ruin safely science seeing series social something special species statement station studies table tables technique trial triumph union unique useless value wanted watches weather wishes yellow",
    3: "actual agreement annual appearance archaic area audience audio champion companion continue created deity diagram dialogue efficient element employer essential genius graduate idea implement influence initial laity linear management manual medium mosaic museum nuclear nucleus obvious opinion period poetry previous quality radio radius ratio reaction sarcasm serial serious stadium theatre theory usual various video visual",
    4: "algebraic algorithm ambiguous continuous cooperate coordinate diameter dictionary european evaluate experience geography material mechanism reality situation society spontaneous stationary variety",
    5: "aluminium considerable documentation evaluation geological instantaneous observational probabilistic radiometric simultaneous sophistication",
    6: "characterisation heterogeneous homogeneity",
    7: "meteorological unavailability",
}


def test_syllables():
    wrong = [(w, n, syllables(w)) for n, words in SYLLABLES.items() for w in words.split() if syllables(w) != n]
    assert not wrong
    assert syllables("rhythms") == 2 and syllables("x") == 1 and syllables("") == 1 and syllables("na\u00efve") == 2


def test_prose_drops_what_is_none():
    text = "\\documentclass{a}\\begin{document}\n\\section{Head words}Own words\\footnote{aside}. % gone\n\\iffalse off \\fi $x = y$ more~text.\n\\begin{equation} a \\end{equation}\\begin{comment} no \\end{comment}\n\\begin{thebibliography}{9}\\bibitem{k} B. Author\\end{thebibliography}\\end{document} after"
    assert prose(text).split() == ["Own", "words.", "more", "text."]
    assert prose("") == "" and prose("plain text").split() == ["plain", "text"]


def test_languages_and_short_pieces():
    counts, by = sentence_counts("The cat was on the mat. Der Hund und die Katze sind nicht hier. Le chat est dans la maison avec les amis. No.")
    assert len(counts) == 1 and by["de"] == 8 and by["fr"] == 9


def test_mixture_recovers_bands():
    rng = np.random.default_rng(0)
    centres = [8, 20, 40, 60, 90]

    def doc(band, other, share):
        n = 40
        grades = [rng.normal(centres[band if rng.random() < share else other], 4) for _ in range(n)]
        return np.bincount(np.clip(np.array(grades, int), 0, CLASSES - 1), minlength=CLASSES)

    truth = rng.integers(0, 5, 300)
    hist = np.array([doc(b, (b + 1) % 5, 0.7) for b in truth], float)
    ratings = [{int(b) + 1: 1} if rng.random() < 0.85 else {int(rng.integers(1, 6)): 1} for b in truth]
    dense = fit_bands(hist, ratings)
    assert (band_of(hist, dense)[0] == truth + 1).mean() > 0.95


def test_query_shape_nulls_and_empty(spark):
    docs = [(k, (PLAIN if k % 2 else HARD) * 12) for k in range(20)] + [(100, None), (101, ""), (102, PLAIN), (None, PLAIN), (103, "Die Katze und der Hund sind nicht hier. " * 40)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "3 AS grade")
    stats = reading_stats(df)
    rows = {r.doc_id: r for r in stats.collect()}
    assert rows[0].grade > rows[1].grade + 10 and rows[100].grade is None and rows[103].english == 0.0 and None not in rows
    grades = spark.createDataFrame([(k, 1 if k % 2 else 5) for k in range(10)] + [(11, 9), (12, None)], "doc_id long, grade int")
    bands = {r.doc_id: r.band for r in with_bands(stats, grades).collect()}
    assert bands == {k: 1 if k % 2 else 5 for k in range(20)}
    assert with_bands(stats, grades.limit(0)).count() == 0 and with_bands(stats.limit(0), grades).count() == 0


@pytest.mark.parametrize("text", ["a", "word " * 200_000, "\\" * 50, "{" * 5000, "$" * 999, "%" * 1000, "\\begin{figure}" * 300])
def test_odd_texts_end(text):
    sentence_counts(prose(text))
