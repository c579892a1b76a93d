import random

import numpy as np
from pyspark.sql import functions as F

from concord.llm import decontaminate as D

from .cases import ODD, empty, odd

WORDS = "anon besh coral dint erst fogue gnar hilt ingot joust krill loam mirth nadir ochre plinth quern rusk".split()


def _text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def _edit(rng, text, n):
    x = list(text)
    for _ in range(n):
        p = rng.randrange(len(x))
        kind = rng.randrange(3)
        if kind == 0:
            x[p] = rng.choice("abc")
        elif kind == 1:
            x.insert(p, rng.choice("abc"))
        else:
            del x[p]
    return "".join(x)


def plain_distance(needle, text):
    """Fewest edits between the needle and any region of the text."""
    row = np.zeros(len(text) + 1, int)
    for i, c in enumerate(needle, 1):
        new = np.empty_like(row)
        new[0] = i
        for j, d in enumerate(text, 1):
            new[j] = min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1)
        row = new
    return row.min()


def test_finds_exactly_what_alignment_finds():
    rng = random.Random(4)
    items = [(i, _text(rng, 15)) for i in range(8)]
    nd = D.index(items)
    needles = ["".join(map(chr, nd.points[k, : nd.length[k]])) for k in range(len(nd.item))]
    for k in range(60):
        i = rng.randrange(8)
        hidden = _edit(rng, items[i][1], rng.randrange(0, 14))
        text = _text(rng, 10) + " " + hidden + " " + _text(rng, 10)
        folded = "".join(map(chr, D.fold([text])[0]))
        want = {int(nd.item[n]) for n in range(len(needles)) if plain_distance(needles[n], folded) <= nd.budget[n]}
        assert {r["item_id"] for r in D.find_leaks([text], nd)[0]} == want


def test_places_and_folding():
    rng = random.Random(5)
    item = _text(rng, 14)
    text = "Intro, words -- " + item.upper().replace(" ", "  \n") + " tail"
    found = D.find_leaks(["nothing here", text], D.index([(9, item)]))
    assert found[0] == []
    assert text[found[1][0]["start"]: found[1][-1]["end"]].lower().split() == item.split()


def test_finds_verbatim_middle_parts():
    rng = random.Random(7)
    for size in (110, 150, 200, 239):                 # one tile, one, two, two
        item = _text(rng, 60)[:size - 1] + "z"
        nd = D.index([(3, item)])
        cuts = [(n, start) for n in {80, 95, size * 4 // 5} for start in range(0, size - n + 1, 7)]
        found = D.find_leaks(["xyzzy plugh frotz", *("xyzzy plugh " + item[a: a + n] + " frotz" for n, a in cuts)], nd)
        assert not found[0]
        for (n, _), rows in zip(cuts, found[1:]):
            (r,) = rows
            assert r["item_id"] == 3 and r["start"] < 12 + 16 and r["end"] > 12 + n - 16    # it stands from 12 on


def test_regions_of_one_passage_are_one_row_with_its_edits():
    rng = random.Random(8)
    item = _text(rng, 50)[:280].strip()
    nd = D.index([(3, item)])
    cut = item[:130] + "q" + item[131:200] + item[202:]
    whole, edited, twice = D.find_leaks([item, cut, item + " and once more: " + item], nd)
    assert [(r["start"], r["end"], r["edits"]) for r in whole] == [(0, len(item), 0)]
    assert [(r["start"], r["end"], r["edits"]) for r in edited] == [(0, len(cut), 3)]
    assert [r["edits"] for r in twice] == [0, 0] and twice[1]["end"] == 2 * len(item) + 16


def test_short_items_are_found_whole():
    items = [(1, "Who wrote Hamlet?"), (2, "谁写了哈姆雷特"), (3, "a1"), (4, "WHO WROTE, HAMLET"), (5, "!!!"), (6, "ไทย ก")]
    texts = ["So: who -- wrote\nhamlet, then", "who wrote hamlets", "我问谁写了哈姆雷特?", "a1 b a12 xa1 A1", "", "!!! who", "เมืองไทย กา",
             "who wrote", "hamlet"]
    assert D.index(items) is None
    got = [[(r["item_id"], t[r["start"]: r["end"]], r["edits"]) for r in rows]
           for t, rows in zip(texts, D.find_leaks(texts, None, D.phrases(items)))]
    hamlet = "who -- wrote\nhamlet"
    assert got == [[(1, hamlet, 0), (4, hamlet, 0)], [], [(2, "谁写了哈姆雷特", 0)], [(3, "a1", 0), (3, "A1", 0)], [], [],
                   [(6, "ไทย ก", 0)], [], []]
    assert D.phrases([(1, "x" * 24), (2, "?"), (3, "")]) is None and D.index([(1, "x" * 24)]) is not None


def plain_phrases(items, text):
    """Whole runs of words of the folded text, one by one."""
    words = "".join(map(chr, D.fold([text])[0])).split()
    return sorted(i for i, t in items for k in range(len(words)) if words[k: k + len(t.split())] == t.split())


def test_phrases_equal_plain_runs_of_words():
    rng = random.Random(9)
    items = [(i, t) for i in range(200) if len(t := _text(rng, rng.randrange(1, 4))) < D.MIN_NEEDLE]
    texts = [_text(rng, rng.randrange(40)) for _ in range(30)]
    for text, rows in zip(texts, D.find_leaks(texts, None, D.phrases(items))):
        assert sorted(r["item_id"] for r in rows) == plain_phrases(items, text)


def test_stretches_find_the_same(monkeypatch):
    rng = random.Random(10)
    line = _text(rng, 18)
    items = [(i, line + " " + _text(rng, 40) + " " + line) for i in range(12)]
    nd = D.index(items)
    texts = [" ".join([line] * 30), _text(rng, 300) + items[3][1] + _text(rng, 300), "", _edit(rng, items[5][1], 9) * 3]
    whole = D.find_leaks(texts, nd)
    assert any(r["item_id"] == 3 for r in whole[1]) and len(whole[0]) >= 12
    points, _, first = D.fold(texts)
    bands = set(zip(*(x.tolist() for x in D.candidates(points, first, nd))))
    monkeypatch.setattr(D, "HITS", 1000)
    assert set(zip(*(x.tolist() for x in D.candidates(points, first, nd)))) == bands
    assert D.find_leaks(texts, nd) == whole


def test_long_repetitive_texts_in_bounded_memory(monkeypatch):
    """One line over and over that stands in every item: no step holds more than ``HITS`` shared q-grams."""
    rng = random.Random(11)
    line = _text(rng, 5)
    nd = D.index([(i, line + " " + _text(rng, 20)) for i in range(40)])
    seen = []
    bands = D._bands
    monkeypatch.setattr(D, "_bands", lambda spots, *rest: (seen.append(len(spots)), bands(spots, *rest))[1])
    monkeypatch.setattr(D, "HITS", 1 << 16)
    text = (line + " ") * (60_000 // len(line)) + _text(rng, 5)
    assert D.find_leaks([text], nd) == [[]] and max(seen) <= D.HITS and sum(seen) > 20 * D.HITS


def test_stage_keeps_documents_with_a_single_word(spark):
    bench = spark.createDataFrame([(1, "hamlet"), (2, "who wrote it"), (3, "谁写了哈姆雷特")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "hamlet is a play"), (2, "Who wrote it?"), (3, "我问谁写了哈姆雷特"), (4, None)], "doc_id long, text string")
    found = D.leaks(docs, bench)
    assert {r["doc_id"]: r["item_id"] for r in found.select("doc_id", "leaks.item_id").collect()} == {1: [1], 2: [2], 3: [3], 4: []}
    assert {r["doc_id"] for r in found.where(D.has_passage()).collect()} == {2, 3}


def test_odd_rows_blocks_and_clean_documents(spark, monkeypatch):
    rng = random.Random(6)
    items = [(i, _text(rng, 20)) for i in range(6)] + [(None, _text(rng, 20)), (50, None), (51, ""), (52, "short"), (0, _text(rng, 20))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = odd(spark, [(100 + k, "x " + t + " y") for k, (_, t) in enumerate(items) if t and len(t) > 40])
    for size in (D.BLOCK_BYTES, 300):
        monkeypatch.setattr(D, "BLOCK_BYTES", size)
        rows = D.leaks(docs, bench).where(F.size("leaks") > 0).select("doc_id", "leaks.item_id").collect()
        assert {r["doc_id"]: set(r["item_id"]) for r in rows} == {
            100 + k: {-1 if i is None else i} for k, (i, t) in enumerate(items) if t and len(t) > 40}
    assert D.leaks(docs, bench).count() == len(ODD) + 8
    assert D.leaks(docs, bench.limit(0)).where(F.size("leaks") > 0).count() == 0
    assert D.leaks(empty(spark), bench).count() == 0
