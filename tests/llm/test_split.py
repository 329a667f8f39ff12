import random

from factloom.llm import bpe
from factloom.llm.split import KINDS, boundary, pieces, split

MODEL = bpe.load(bpe.default_path())


def cut(text, limit, overlap):
    words, _, n, _ = MODEL.words([text])
    return pieces(text, words[0], n, MODEL, limit, overlap)


def texts():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(1, 9)))
    prose = "".join(f"{' '.join(word() for _ in range(r.randrange(4, 15)))}{r.choice(['. ', ', ', '.\n', '!\n\n', '; '])}" for _ in range(300))
    yield from (prose, "x" * 9000, "中文字" * 800, " \n" * 2000, prose.replace(" ", ""), "👩‍👩‍👧" * 300, "=" * 4000 + "\n\n" + prose[:900], "\r\n".join(word() for _ in range(900)))


def test_pieces_hold_every_promise():
    for t in texts():
        for limit, overlap in ((100, 0), (128, 16), (1024, 64)):
            if MODEL.counts([t])[0] <= limit:
                continue
            got = cut(t, limit, overlap)
            assert got[0][0] == 0 and got[-1][1] == len(t) and got[-1][4] == "end"
            for (a, b, n, v, kind), (a2, b2, n2, v2, _) in zip(got, got[1:]):
                assert a < a2 <= b < b2 and n <= limit and v2 <= overlap and kind in KINDS
                assert MODEL.counts([t[a:b], t[a2:b]]).tolist() == [n, v2]
            assert got[-1][2] <= limit


def test_natural_boundaries_win():
    t = ("one two three four five. " * 2 + "\n\n") * 60
    got = cut(t, 100, 0)
    assert [k for *_, k in got[:-1]] == ["paragraph"] * (len(got) - 1)
    assert boundary("ab. cd", 3) == 2 and boundary("ab, cd", 3) == 3 and boundary("ab cd", 2) == 4 and boundary("abcd", 2) == 5
    assert boundary("ab\n\ncd", 4) == 0 and boundary("ab\ncd", 3) == 1 and boundary("ab\n\ncd", 2) == 4


def test_rows(spark):
    long = "word " * 3000
    rows = [(1, long, 9), (1, long, 9), (2, "short", 9), (3, None, 9), (4, "", 9), (5, "é" * 1024, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece int")
    got = split(df).collect()
    assert {r["doc_id"] for r in got} >= {1} and not {r["doc_id"] for r in got} & {2, 3, 4}
    one = [r for r in got if r["doc_id"] == 1]
    assert len(one) == 2 * one[0]["n_pieces"] and all(r["text"] == long[r["start"]:r["stop"]] and r["n_tokens"] <= 1024 for r in one)
    assert split(df.filter("false")).count() == 0
    assert "text" not in split(df, with_text=False).columns


def test_cut_beside_an_unbroken_run():
    prose = "".join(f"word{k % 7} next{k % 5} other. " for k in range(60))
    run = "".join(random.Random(2).choice("0123456789abcdef") for _ in range(2000))
    t = prose + run + " " + prose
    assert 1024 < MODEL.counts([t])[0]
    got = cut(t, 1024, 0)
    assert len(got) == 2 and got[0][4] != "none"


def test_long_white_space_counts_whole():
    assert boundary("ab" + " " * 500 + "\n" + " " * 500 + "\n" + " " * 500 + "cd", 1504) == 0
    assert boundary("ab\r\ncd", 3) == 4 and boundary("ab\r\ncd", 4) == 1 and boundary('ab."""""""""""" cd', 16) == 2 and boundary("中。文", 2) == 2


def test_tiny_limits():
    for t in ("\U0001f469" * 9, "a b c d e f g h i j", "日本語テキスト"):
        for limit, overlap in ((4, 0), (4, 3), (5, 2)):
            if MODEL.counts([t])[0] > limit:
                got = cut(t, limit, overlap)
                assert all(n <= limit for _, _, n, _, _ in got) and got[0][0] == 0 and got[-1][1] == len(t) and all(b >= a2 for (_, b, *_), (a2, *_) in zip(got, got[1:]))
    for limit, overlap in ((3, 0), (8, 8)):
        try:
            split(None, limit=limit, overlap=overlap)
            raise AssertionError
        except ValueError:
            pass
