"""Sentence alignment and keyword-stuffed pages."""

import random

from pyspark.sql import functions as F

from tellgrid.llm import alignment, stuffing

NOUNS = (
    "king river house temple canal reed ox palm stone gate barley wool silver bread beer field boat axe net rope jar lamp road wall door roof well sheep goat fish "
    "bird snake lion star moon sun rain wind fire ash brick clay oil honey milk salt seal tablet scribe smith"
).split()
VERBS = {"see": "saw", "bring": "brought", "build": "built", "hold": "held", "take": "took", "sell": "sold", "buy": "bought", "love": "loved", "hate": "hated", "burn": "burned"}
SAID = {"king": ["king", "ruler"], "river": ["river", "stream"], "house": ["house", "dwelling"]}


def bilingual(texts=60, seed=1):
    """Lines with glosses and their translations: merges, omissions, additions, swaps, missing paragraph ids."""
    rng = random.Random(seed)
    lines, words, paragraphs, truth = [], [], [], set()
    for t in range(texts):
        place, sentences = 0, []
        for _ in range(16):
            place += rng.choice([1, 1, 2])
            a, b, v = rng.choice(NOUNS), rng.choice(NOUNS), rng.choice(list(VERBS))
            name = f"l{place}"
            lines.append((f"t{t}", name, place, str(place), None if rng.random() < 0.3 else f"t{t}.p1"))
            for i, g in enumerate((a, b, v)):
                words.append((f"t{t}", name, i, f"{g}x", f"{g}x" if rng.random() < 0.95 else None, g if rng.random() < 0.9 else None))
            if rng.random() < 0.1:
                continue  # not translated
            said = [rng.choice(SAID.get(w, [w])) for w in (a, b)]
            sentences.append(([name], f"the {said[0]} {VERBS[v]} the {said[1]}"))
        i = 0
        while i + 1 < len(sentences):
            if rng.random() < 0.1:
                sentences[i : i + 2] = [(sentences[i][0] + sentences[i + 1][0], sentences[i][1] + ", while " + sentences[i + 1][1])]
            elif rng.random() < 0.1:
                sentences[i], sentences[i + 1] = sentences[i + 1], sentences[i]
            i += 1
        if rng.random() < 0.7:
            sentences.insert(rng.randint(0, len(sentences)), ([], "two lines are lost"))
        for no, (names, _) in enumerate(sentences, 1):
            truth |= {(f"t{t}", name, f"t{t}.p1", no) for name in names}
        paragraphs.append((f"t{t}", f"t{t}.p1", f"1-{place}" if rng.random() < 0.7 else "", ". ".join(s.capitalize() for _, s in sentences) + "."))
    return lines, words, paragraphs, truth


def aligned(spark, lines, words, paragraphs):
    l = spark.createDataFrame(lines, "text string, line string, place int, label string, para string")
    w = spark.createDataFrame(words, "text_id string, line_id string, at int, form string, lemma string, gloss string").withColumn("tokens", F.lit("clash"))
    p = spark.createDataFrame(paragraphs, "text string, para string, range string, translation string")
    tokens = alignment.source_tokens(w, "text_id", "line_id", "at", "lemma", "form", "gloss")
    return {tuple(r) for r in alignment.align(l, tokens, p).select("text", "line", "para", "sent").collect()}


def test_alignment(spark):
    lines, words, paragraphs, truth = bilingual()
    # repeats count once; texts without lines or without a translation give nothing
    found = aligned(spark, lines + lines[:40], words + words[:90], paragraphs + paragraphs[:5] + [("none", "none.p1", "", "A king."), ("t0", "t0.p9", None, None), ("t1", "t1.p8", "", "")])
    right = len(found & truth)
    assert right / len(found) > 0.93 and right / len(truth) > 0.9
    assert all(text != "none" for text, *_ in found)


def test_nothing_to_align(spark):
    lines, words, paragraphs, _ = bilingual(2)
    assert aligned(spark, lines, words, [("x", "x.p1", "", "A king.")]) == set()
    empty = spark.createDataFrame([], "text string, para string, range string, translation string")
    l = spark.createDataFrame(lines, "text string, line string, place int, label string, para string")
    w = spark.createDataFrame(words, "text_id string, line_id string, at int, form string, lemma string, gloss string")
    tokens = alignment.source_tokens(w, "text_id", "line_id", "at", "lemma", "form", "gloss")
    assert alignment.align(l, tokens, empty).count() == 0


def test_gloss_of_the_lemma(spark):
    rows = [("t", "1", 0, "f", "l", "Big House"), ("t", "1", 1, "f", "l", None), ("t", "1", 2, "g", None, None), ("t", "1", 3, "g", "", ""), ("t", "2", None, None, None, None)]
    df = spark.createDataFrame(rows, "t string, l string, at int, form string, lemma string, gloss string")
    got = {r.line: [t for t, n in zip(r.tokens, r.times) for _ in range(n)] for r in alignment.source_tokens(df, "t", "l", "at", "lemma", "form", "gloss").collect()}
    assert sorted(got["1"]) == ["#g", "#g", "big", "big", "house", "house"] and got["2"] == ["#"]


def brute_repeats(signs):
    out = []
    for end in range(1, len(signs) + 1):
        best = 0
        for size in range(1, end + 1):
            piece = signs[end - size : end]
            if sum(signs[i : i + size] == piece for i in range(len(signs) - size + 1)) > 1:
                best = size
        out.append(best)
    return out


def automaton_repeats(signs):
    """The same by a suffix automaton: the longest repeated stretch that ends at each position."""
    follow, link, length, ends, last = [{}], [-1], [0], [], 0
    for sign in signs:
        state, at = len(follow), last
        follow.append({})
        length.append(length[last] + 1)
        while at != -1 and sign not in follow[at]:
            follow[at][sign] = state
            at = link[at]
        if at == -1:
            link.append(0)
        elif length[follow[at][sign]] == length[at] + 1:
            link.append(follow[at][sign])
        else:
            to, copy = follow[at][sign], state + 1
            link.append(copy)
            follow.append(dict(follow[to]))
            length.append(length[at] + 1)
            link.append(link[to])
            while at != -1 and follow[at].get(sign) == to:
                follow[at][sign] = copy
                at = link[at]
            link[to] = copy
        last = state
        ends.append(state)
    repeated = set(link[1:]) - {0}
    return [length[s] if s in repeated else length[link[s]] for s in ends]


def cover_of(lengths, least):
    covered, left = 0, len(lengths)
    for i in range(len(lengths) - 1, -1, -1):
        if lengths[i] >= least:
            left = min(left, i - lengths[i] + 1)
        covered += i >= left
    return covered


def test_cover_is_that_of_the_automaton():
    rng = random.Random(7)
    for n in range(300):
        signs = [rng.randint(0, 2) for _ in range(rng.randint(0, 40))]
        assert automaton_repeats(signs) == brute_repeats(signs)
        # few and many different signs: with many, numbers are replaced by their ranks on the way
        text = "".join(chr(0x4E00 + 7 * x if n % 2 else 97 + x) for x in signs) + "".join(chr(0x5000 + i) for i in range(3000 * (n % 50 == 1)))
        least = rng.randint(1, 7)
        assert round(stuffing.character_cover(text, least) * len(text)) == cover_of(automaton_repeats(text), least)
    assert stuffing.character_cover("", 2) == stuffing.character_cover("a", 7) == 0


def test_cover_decides(monkeypatch):
    """Without clauses alone a list of different signs would be a case, and repeats alone would make one of a litany."""
    rng = random.Random(3)
    once = "\n".join("".join(rng.choice("abdegiklmnprstuz") for _ in range(rng.randint(4, 9))) for _ in range(60))
    again = "cheap seal poster buy seal poster " * 20
    litany = PAGES["litany"][0]
    assert [stuffing.measure(t)[2] for t in (once, again, litany)] == [False, True, False]
    assert stuffing.measure(once)[0] == 1.0 and stuffing.character_cover(litany) > 0.5
    monkeypatch.setattr(stuffing, "LEAST_SCORE", 0.0)
    assert [stuffing.measure(t)[2] for t in (once, again, litany)] == [True, True, False]


def test_sentences():
    assert stuffing.measure("what is tablet seal? tablet seal near me? seal poster pdf? " * 5)[2]
    assert not stuffing.measure("Was the tablet seen near the river? It was the seal that they found! " * 3 + PROSE)[2]


PROSE = "The scribe made two mistakes in the third line. It is hard to see why the reed should be found before the marsh. She repaid the wind, and the storehouse was never seen again. "
PAGES = {
    "keywords": ("cheap seal poster buy seal poster " * 20, True),
    "tags": (" ".join(f"#{w}" for w in "seal poster cheapseal buyposter sealposter bestseal".split() * 8), True),
    "links": ("\n".join(f'<a href="https://old-clay{i % 3}.example/seal">cheap seal</a>' for i in range(20)), True),
    "offers": ("\n".join(f"Old red seal poster - size {'SML'[i % 3]} - sale -{i}%" for i in range(15)), True),
    "served": ("Buy clay seal today because clay seal means good clay seal. Looking for clay seal? This clay seal is a fine clay seal. Why clay seal? Because clay seal beats any other clay seal. " * 3, True),
    "wrapped": (PROSE[:48] + "\n" + "seal poster, best seal, seal poster, buy seal, " * 20 + "\n" + PROSE[:48], True),
    "prose": (PROSE * 6, False),
    "litany": ("\n".join(f"{n.capitalize()}, lord of the {n}, sold the blue bead!" for n in NOUNS * 3), False),
    "ledger": ("\n".join(f"{i}(diš) udu ki lugal-ta" for i in range(40)), False),
    "list": ("\n".join(f"ab-{n} = {n}" for n in NOUNS * 3), False),
    "index": ("\n".join(f"{n}, {i}, {i + 9}, {i + 80}" for i, n in enumerate(NOUNS * 3)), False),
    "edition": ("\n".join(f"rev. {i}. lugal-e e₂ mu-un-du₃\n   The king built the house." for i in range(20)), False),
    "mostly prose": (PROSE * 5 + "\nseal poster seal poster seal poster", False),
    "empty": ("", False), "null": (None, False), "blank": (" \n\t ", False), "signs": ("... --- ...", False), "word": ("seal", False),
    "long": (PROSE * 3000, False),
}


def test_pages(spark):
    rows = [(name, text, "x") for name, (text, _) in PAGES.items()]
    df = spark.createDataFrame(rows, "id string, text string, key string").withColumn("made", F.lit(1))
    found = stuffing.stuffed_pages(df.union(df.limit(1)), "id", "text")
    assert found.columns == ["id", "made", "cover"]
    assert {r.id for r in found.collect()} == {name for name, (_, made) in PAGES.items() if made}
    upper = df.withColumn("text", F.upper("text"))
    assert {"keywords", "served", "offers"} <= {r.id for r in stuffing.stuffed_pages(upper, "id", "text").collect()}
    assert stuffing.stuffed_pages(df.limit(0), "id", "text").count() == 0


def test_a_word_said_ten_times():
    """One-to-one matches count a source word as often as the line says it, and no oftener."""
    import numpy as np

    pair, a, b, value = np.zeros(12, np.int64), np.arange(12), np.zeros(12, np.int64), np.ones(12)
    total, used = alignment._one_to_one(pair, a, b, value, np.array([10]), 1)
    assert total[0] == 10 and len(used[0]) == 10


def test_pairs_of_words_dense_or_not(monkeypatch):
    """A group whose vocabulary is too large for a dense array counts and looks up the same."""
    import numpy as np

    keys, values = np.array([3, 17, 40]), np.array([0.5, 0.25, 1.0])
    asked = np.array([40, 3, 4, 17])
    dense = alignment._Pairs(64, keys, values, 0.125)(asked)
    sums = alignment._Sums(64)
    sums.add(np.array([3, 3, 9]), np.array([1.0, 2.0, 4.0]))
    sums.add(np.array([9, 1]), np.array([1.0, 1.0]))
    before = [x.tolist() for x in sums.all()]
    monkeypatch.setattr(alignment, "DENSE", 8)
    assert alignment._Pairs(64, keys, values, 0.125)(asked).tolist() == dense.tolist() == [1.0, 0.5, 0.125, 0.25]
    sums = alignment._Sums(64)
    sums.add(np.array([3, 3, 9]), np.array([1.0, 2.0, 4.0]))
    sums.add(np.array([9, 1]), np.array([1.0, 1.0]))
    assert [x.tolist() for x in sums.all()] == before == [[1, 3, 9], [1.0, 3.0, 5.0]]
