import random

from factloom.llm.leaks import SPAN, Automaton, fingerprints, leaks, words


def brute(docs, items, span=SPAN):
    grams = lambda t: {tuple(w[k:k + span]) for w in [words(t)] for k in range(len(w) - span + 1)}
    return {(d, i) for d, t in docs if d is not None for i, x in items if i is not None and grams(t) & grams(x)}


def test_against_brute_force(spark):
    r = random.Random(5)
    vocab = [f"w{k}" for k in range(60)]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(k, text(r.randrange(5, 60))) for k in range(25)] + [(25, "same same " * 30), (None, text(20)), (26, None)]
    docs = [(k, text(r.randrange(0, 80))) for k in range(60)]
    for k, n in enumerate(list(range(9, 15)) * 6):
        src = words(r.choice(items[:25])[1])
        a = r.randrange(max(1, len(src) - n))
        docs.append((100 + k, f"{text(7)} {'-'.join(src[a:a + n]).upper()}\n\n{text(5)}"))
    docs += [(500, "SAME, " * 12), (501, "same " * 11), (None, items[0][1]), (502, None), (503, ""), (504, items[3][1]), (504, items[3][1]), (505, "x " * 200000 + items[4][1] + " y" * 100000)]
    frame = lambda rows, key: spark.createDataFrame([(k, t, 1) for k, t in rows], f"{key} long, text string, hits int")
    got = leaks(frame(docs, "doc_id"), frame(items, "item_id"))
    rows = [(x["doc_id"], x["item_id"]) for x in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute(docs, items)
    longest = {(x["doc_id"], x["item_id"]): x["n_words"] for x in got.collect()}
    assert longest[500, 25] == 12 and longest[504, 3] == len(words(items[3][1])) or len(words(items[3][1])) < SPAN


def test_every_window_keeps_one():
    r = random.Random(7)
    for _ in range(30):
        t = " ".join(str(r.randrange(20)) for _ in range(r.randrange(12, 90)))
        _, at = fingerprints(t)
        n = len(words(t)) - 4
        assert all(any(s <= p < s + 8 for p in at) for s in range(n - 7))
    assert len(fingerprints("one two three")[0]) == 0 and len(fingerprints(None)[0]) == 0


def test_automaton_against_brute_force():
    r = random.Random(3)
    for _ in range(300):
        a, b = ([r.choice("xyz") for _ in range(r.randrange(0, 25))] for _ in range(2))
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                    n += 1
                best = max(best, (n, -i, -j)) if n else best
        assert Automaton(b).longest(a) == (best[0], -best[1], -best[2])


def test_repeated_word_meets_repeated_word(spark):
    docs = spark.createDataFrame([(1, "same " * 200_000), (2, "same " * 11), (3, "unlike " * 12), (3, "same " * 40)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "same " * 30_000), (1, "other " * 50), (2, "same " * 12)], "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]): (x["doc_word"], x["item_word"], x["n_words"]) for x in leaks(docs, items).collect()}
    assert got == {(1, 1): (0, 0, 30_000), (1, 2): (0, 0, 12), (3, 1): (0, 0, 40), (3, 2): (0, 0, 12)}


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert leaks(docs, items).count() == 0
    assert leaks(spark.createDataFrame([(1, "a " * 50)], "doc_id long, text string"), items).count() == 0
