from __future__ import annotations

import re

import numpy as np
import pytest

from strataframe.llm.fmindex import FMIndex, suffix_array
from strataframe.llm.leak import leaks, removal_spans, stretch
from strataframe.llm.tex import streams


@pytest.mark.parametrize(("n", "size"), [(0, 3), (1, 3), (60, 2), (500, 3), (700, 40)])
def test_index_against_scan(n, size):
    rng = np.random.default_rng(n)
    text = rng.integers(1, size, n) if size > 1 else np.ones(n, "int64")
    text[n // 2 :] = text[: n - n // 2]
    assert suffix_array(text).tolist() == sorted(range(n), key=lambda i: text[i:].tolist())
    index = FMIndex(text, size + 1, rate=5)
    for k in (1, 3):
        if n < k:
            continue
        grams = np.unique(np.lib.stride_tricks.sliding_window_view(text, k), axis=0)
        grams = np.vstack([grams, np.full((1, k), size)])
        for g, a, b in zip(grams, *index.search(grams), strict=True):
            want = [i for i in range(n - k + 1) if (text[i : i + k] == g).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_places_in_many_short_texts():
    rng = np.random.default_rng(5)
    text = np.concatenate([np.append(rng.integers(1, 4, n), 0) for n in rng.integers(1, 12, 300)])
    index = FMIndex(text, 4)
    grams = np.array([(a, b) for a in (1, 2, 3) for b in (1, 2, 3)])
    for g, a, b in zip(grams, *index.search(grams), strict=True):
        assert sorted(index.locate(np.arange(a, b)).tolist()) == [i for i in range(len(text) - 1) if (text[i : i + 2] == g).all()]


def test_stretch_bridges_single_edits():
    item = np.arange(10, 30)
    text = np.r_[1, 1, item[:6], 1, item[7:12], 1, item[12:], 1]
    assert stretch(item, text) == (19, 2, 23)
    assert stretch(item, np.r_[item[:8], 1, 1, 1, item[8:]])[0] == 12


def test_streams_of_tex():
    text = "\\newcommand{\\two}{red  fox}\r\n\\def\\w#1{very #1}\nThe \\two{} ran\\footnote{Far away.} % draft words\nover \\emph{the} \\w{old} drai\\-nage~\\cite[see]{key} 5\\,\\%.\n% The cat\n% sat"
    assert streams(text) == ["the red fox ran over the very old drainage 5".split(), "far away".split(), "draft words the cat sat".split()] or streams(text) == ["the red fox ran over the very old drainage 5".split(), "draft words the cat sat".split(), "far away".split()]
    assert streams("") == [] and streams("\\def\\a{\\a b} \\a c") == [["b", "c"]]


def test_deep_braces_and_macros():
    deep = "{" * 9 + "far" + "}" * 9
    assert streams("one \\footnote{note " + deep + " away} two") == [["one", "two"], ["note", "far", "away"]]
    assert streams("one \\footnote{never closed") == [["one", "never", "closed"]]
    chain = "".join(f"\\def\\m{chr(97 + k)}{{\\m{chr(98 + k)} w}}" for k in range(24)) + "\\def\\my{end}"
    assert streams(chain + "\\ma") == [["end"] + ["w"] * 24]


WORDS = [f"w{k}" for k in range(400)]


def test_found_and_spans(spark):
    item = WORDS[:40]
    docs = [
        (1, " ".join(WORDS[300:360] + item + WORDS[360:])),
        (2, " ".join(item[:25])),
        (3, " ".join(item[:15]) + " x " * 50 + " ".join(item[20:35])),
        (4, "intro text\n% " + "\n% ".join(item)),
        (5, " ".join("zz" if k % 6 == 5 else w for k, w in enumerate(item))),
        (6, None), (None, " ".join(item)), (7, ""), (8, "word " * 5000),
        (9, "\\newcommand{\\q}{" + " ".join(item[5:20]) + "}\n" + " ".join(item[:5]) + " \\q{} " + " ".join(item[20:])),
    ]
    documents = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS item_id")
    items = spark.createDataFrame([(70, " ".join(item).upper()), (71, "too short"), (72, None), (None, "x"), (70, None), (80, " ".join(item[:10] + WORDS[200:240]))], "item_id long, item_text string").selectExpr("*", "'a' AS doc_id")
    for shard, block in ((1 << 20, 20_000), (64, 1)):
        found = leaks(documents, items, shard=shard, block=block)
        assert {(r.doc_id, r.item_id) for r in found.collect()} == {(1, 70), (2, 70), (4, 70), (5, 70), (9, 70)}
    spans = {r.doc_id: (r.first_word, r.end_word, r.n_items) for r in removal_spans(found).collect()}
    assert spans[1] == (60, 100, 1) and spans[2] == (0, 25, 1)
    assert leaks(documents.limit(0), items).count() == 0 and leaks(documents, items.limit(0)).count() == 0


def test_every_copy_of_an_item_gives_a_span(spark):
    item, half = " ".join(WORDS[:40]), " ".join(WORDS[10:32])
    docs = [
        (1, f"{item} {item}"), (2, f"{item} {'x ' * 10} {half} {'x ' * 60} {item} {'x ' * 45} {item}"), (3, f"{item} " * 30),
        (4, f"{' '.join(WORDS[:30])} {item} {half}"),
    ]
    out = leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, item_text string")).collect()
    got = {d: sorted((r.first_word, r.end_word) for r in out if r.doc_id == d) for d, _ in docs}
    assert got[1] == [(0, 40), (40, 80)]
    assert got[2] == [(0, 40), (50, 72), (132, 172), (217, 257)]
    assert got[3] == [(40 * k, 40 * k + 40) for k in range(30)]
    assert got[4] == [(0, 30), (30, 70), (70, 92)]


def test_dense_edits_against_alignment(spark):
    rng = np.random.default_rng(4)
    items = [(k, [WORDS[j] for j in rng.permutation(300)[:50]]) for k in range(8)]
    docs, want = [], set()
    for d in range(60):
        k, words = items[rng.integers(8)]
        part = int(rng.integers(10, 50))
        body = [WORDS[300 + int(rng.integers(100))] if i % 7 == 6 else w for i, w in enumerate(words[:part])]
        docs.append((d, " ".join([WORDS[int(j)] for j in rng.integers(300, 400, 30)] + body + [WORDS[int(j)] for j in rng.integers(300, 400, 30)])))
        if sum(i % 7 != 6 for i in range(part)) >= 25:
            want.add((d, k))
    out = leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, item_text string"))
    assert {(r.doc_id, r.item_id) for r in out.collect()} == want


def exhaustive(docs: list[tuple[int, str]], items: list[tuple[int, str]], least: float = 0.5) -> set[tuple[int, int]]:
    """Pairs by aligning every item with every stream of every document: a plain table over all pairs of words."""
    out = set()
    for d, text in docs:
        for words in streams(text):
            for k, item in items:
                own = re.findall(r"[^\W_]+", item.lower())
                best: dict[tuple[int, int], int] = {}
                at: dict[str, list[int]] = {}
                for i, w in enumerate(own):
                    at.setdefault(w, []).append(i)
                for j, w in enumerate(words):
                    for i in at.get(w, ()):
                        best[i, j] = 1 + max(best.get((i - a, j - b), 0) for a in (1, 2) for b in (1, 2))
                if own and max(best.values(), default=0) >= max(1, least * len(own)):
                    out.add((d, k))
    return out


@pytest.mark.parametrize("every", [2, 3, 4])
def test_edits_at_every_second_to_fourth_word(spark, every):
    rng = np.random.default_rng(every)
    items = [(k, [WORDS[j] for j in rng.integers(0, 200, 40)]) for k in range(12)]
    docs = []
    for d in range(120):
        _, words = items[rng.integers(12)]
        part, how = int(rng.integers(15, 41)), int(rng.integers(3))
        body: list[str] = []
        for i, w in enumerate(words[:part]):
            edit = i % every == every - 1
            body += [w, WORDS[300]] if edit and how == 1 else [] if edit and how == 2 else [WORDS[int(rng.integers(300, 400))]] if edit else [w]
        docs.append((d, " ".join([WORDS[j] for j in rng.integers(0, 400, 30)] + body + [WORDS[j] for j in rng.integers(0, 400, 30)])))
    plain = [(k, " ".join(w)) for k, w in items]
    want = exhaustive(docs, plain)
    assert len(want) > 20
    for shard in (1 << 20, 200):
        out = leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(plain, "item_id long, item_text string"), shard=shard)
        assert {(r.doc_id, r.item_id) for r in out.collect()} == want


def test_items_of_one_to_seven_words(spark):
    rng = np.random.default_rng(1)
    items = [(k, " ".join(f"w{j}" for j in rng.integers(0, 30, 1 + k % 7))) for k in range(28)] + [(90, "w1 w1 w1"), (91, "never seen")]
    docs = [(d, " ".join(f"w{j}" for j in rng.integers(0, 60, rng.integers(1, 25)))) for d in range(80)] + [(500, "w3"), (501, "seen")]
    want = exhaustive(docs, items)
    out = leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, item_text string"), shard=100)
    assert {(r.doc_id, r.item_id) for r in out.collect()} == want


def test_whole_tables_against_exhaustive_alignment(spark):
    """The smallest tables: every item against every document."""
    folder = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect() if r.text]
    newest = {r.item_id: r.item_text for r in spark.read.parquet(f"{folder}/eval_items.parquet").orderBy("added_at").collect() if r.item_text}
    items = sorted(newest.items())
    out = leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, item_text string"))
    assert {(r.doc_id, r.item_id) for r in out.collect()} == exhaustive(docs, items)
