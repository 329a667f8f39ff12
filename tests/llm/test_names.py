import random
from itertools import combinations

from factloom.llm.names import LEAST, Form, abbreviates, link, near_tokens, one_edit, resolve, similarity, spellings, together, tokens, tokens_within
from factloom.runtime import Scratch

NICKS = [("Bob", "Robert"), ("Jo", "Joseph"), ("Jo", "Josephine"), ("Tony", "Anthony"), ("Dan", "Daniel"), ("X", None)]
GROUPS = [
    ["Robert Goandula", "Bobby Goandula".replace("Bobby", "Bob"), "Goandula, Robert", "goandula robert", "Dr. Robert Goandula", "Robert K. Goandula", "R. Goandula", "RobertGoandula", "@robertgoandula", "rgoandula", "Rboert Goandula", "Robert Göandula", "robert.goandula", " Robert  Goandula", "Goandula"],
    ["Daniel Skathorn", "Dan Skathorn", "Danniel Skathorn"],
    ["Andrea Skathorn"],
    ["Josephine Joattik", "Joattik, Jo"],
    ["Brourkimo Management", "Brourkimo Mgmt", "Management Brourkimo", "Brourkimo Management (BV)", "Brpurkimo Management"],
    ["Brourkimo Laboratories Services", "Brourkimo Laboratories Services Inc", "BLS", "BrourkimoLaboratoriesServices"],
    ["Mobile Foundations Team", "Mobile Foundations", "Foundations Mobile Team", "Mobile / Foundations", "Mobile Foundatinos team"],
    ["Documentation Reliability", "Docs Reliability Team"],
    ["Zachary Flottimo", "Zach Flottimo"],
    ["Francis Qirkine"],
    ["Frances Qirkine"],
]


def rows(spark, groups, graph="g"):
    out = []
    for g in groups:
        for k, n in enumerate(g):
            kind = "Team" if "Team" in g[0] else "Company" if "Brourkimo" in g[0] or "Documentation" in g[0] else "Person"
            out += [(graph, n, kind if k % 2 == 0 else None, 1)] * (3 if k == 0 else 1)
    return out


def test_variants_are_linked(spark):
    made = rows(spark, GROUPS) + rows(spark, [["Robert Goandula", "Bob Goandula"]], "other")
    made += [("g", None, "Person", 1), ("g", " \t", "Person", 1), (None, "Robert Goandula", "Person", 1), ("g", "0A0B0C0D-0000-4000-8000-0000000000FF", None, 1), ("g", "?!", None, 1), ("g", "w" * 5000, None, 1), ("g", "Dr", None, 1)]
    nicks = spark.createDataFrame(NICKS + [("Frankie", "Francis"), ("Fran", "Frances"), ("Andi", "Andrea")], "nick string, given_name string")
    df = spark.createDataFrame(made, "graph_name string, name string, kind string, n long")
    got = {tuple(r) for r in link(resolve(spellings(df), nicks)).collect()}
    want = {("g", *sorted(p, key=lambda x: x.encode())) for g in GROUPS for p in combinations(g, 2)} | {("other", "Bob Goandula", "Robert Goandula")}
    assert got == want, (sorted(got - want), sorted(want - got))


def test_a_slip_is_decided_in_its_graph(spark):
    teams = [("g", "Quality Onboarding Team"), ("g", "Quality Onbooarding team"), ("g", "Len Qulethust"), ("g", "Lena Floumognan"), ("g", "Thasko Networks Ins."), ("g", "Thasko Networks Inds")]
    teams += [("g", "Vinent Tylmyst"), ("g", "Vinecnt Tylmyst")]
    nicks = spark.createDataFrame([("Lena", "Helena")], "nick string, given_name string")
    other = [(f"o{k}", n) for k in range(4) for n in ("Growth Onbooarding", "Len Thoskund", "Thoskund Ins.", "Thoskund Inds", "Vinent Thoskund", "Vinecnt Goandula")]
    for rows in (teams, teams + other):
        df = spark.createDataFrame([(g, n, None) for g, n in rows], "graph_name string, name string, kind string")
        got = {tuple(r)[1:] for r in link(resolve(spellings(df), nicks)).collect() if r["graph_name"] == "g"}
        want = {("Quality Onboarding Team", "Quality Onbooarding team"), ("Vinecnt Tylmyst", "Vinent Tylmyst")}
        assert want <= got and (rows is teams or got == want), got


def form(words, weights=None, given=None, named=(), letters=(), short=(), whole="", person=True, business=False):
    return Form(words, weights or [1.0] * len(words), [(given or {}).get(w, []) for w in words], [w in named for w in words], list(letters), list(short), whole or "".join(words), person, business)


def test_parts():
    assert tokens("ThaskoryServicesFoundation") == ["thaskory", "services", "foundation"] and tokens("O'Brien, Séan ") == ["obrien", "sean"] and tokens("B.L.S.") == ["bls"]
    assert abbreviates("mgmt", "management") and abbreviates("docs", "documentation") > abbreviates("dcmn", "documentation") > 0 == abbreviates("zz", "management") and not abbreviates("manage", "managed")
    assert one_edit("anna", "anan") and one_edit("anna", "ana") and one_edit("ana", "anna") and one_edit("ana", "anb") and not one_edit("ana", "ana") and not one_edit("abcd", "badc")
    bob, robert = form(["bob", "goandula"], [1.0, 3.0], {"bob": ["robert"]}), form(["goandula", "robert"], [3.0, 1.0], named=["robert"])
    assert abs(similarity(bob, robert)[0] - (3 + 0.9 + 3 + 0.9) / 8) < 1e-9 and similarity(bob, robert)[1]
    assert similarity(form(["goandula"], letters=["r"]), robert)[0] > similarity(form(["goandula"]), robert)[0] > 0 == similarity(form(["goandula"], letters=["x"]), robert)[0]
    # sharing the rare word makes similar, sharing the common one does not
    assert similarity(form(["rare"], [9.0]), form(["rare", "usual"], [9.0, 2.0]))[0] > LEAST > similarity(form(["usual"], [2.0]), form(["rare", "usual"], [9.0, 2.0]))[0]
    assert similarity(form(["a1", "rare"]), form(["b1", "rare"]))[0] == 0
    assert together("goandularobert", robert.words, robert) and together("rgoandula", robert.words, robert)["robert"] < 0.9 and together("xgoandula", robert.words, robert) is None
    # nothing depends on the number of words: long names are compared as short ones
    many = [f"word{k:02d}" for k in range(40)]
    assert similarity(form([*many, "mgmt"], person=False, business=True), form([*many, "management"], person=False, business=True))[1]


def test_names_of_many_words(spark):
    many = " ".join(f"{c}ampo{c}er" for c in "bcdfghklmnprst")
    made = [("g", f"{many} Management", "Company"), ("g", f"{many} Mgmt", "Company"), ("g", f"Management {many} Inc", "Company"), ("g", "Campocer Zander", "Company")]
    df = spark.createDataFrame(made, "graph_name string, name string, kind string")
    got = {tuple(r)[1:] for r in link(resolve(spellings(df), spark.createDataFrame([], "nick string, given_name string"))).collect()}
    assert got == {(a, b) for a in (n for _, n, _ in made[:3]) for b in (n for _, n, _ in made[:3]) if a < b}


def test_tokens_within_against_brute_force(spark):
    r = random.Random(5)
    words = sorted({"".join(r.choice("abc") for _ in range(r.randrange(3, 9))) for _ in range(120)})
    df = spark.createDataFrame([("g", w) for w in words], "graph_name string, token string")
    grams = lambda w: {w[k : k + 3] for k in range(len(w) - 2)}
    for share in (0.6, 1.0):
        got = {(x["whole"], x["token"]) for x in tokens_within(df, df.withColumnRenamed("token", "whole"), share).collect()}
        assert got == {(w, t) for w in words for t in words if len(w) > max(3, len(t)) and len(grams(w) & grams(t)) >= share * len(grams(t))}


def test_empty(spark):
    df = spark.createDataFrame([], "graph_name string, name string, kind string")
    nicks = spark.createDataFrame([], "nick string, given_name string")
    assert link(resolve(spellings(df), nicks)).count() == 0


def edits(a, b):
    """Optimal string alignment distance."""
    d = {(i, -1): i + 1 for i in range(-1, len(a))} | {(-1, j): j + 1 for j in range(-1, len(b))}
    for i in range(len(a)):
        for j in range(len(b)):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i] != b[j]))
            if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a) - 1, len(b) - 1]


def test_near_tokens_against_brute_force(spark):
    r = random.Random(11)
    toks = {"".join(r.choice("abcd") for _ in range(r.randrange(1, 9))) for _ in range(250)} | {"anna", "annna", "aann", "ämne", "amne", "w" * 300, "w" * 301}
    for t in list(toks)[:120]:
        k = r.randrange(len(t))
        toks |= {t[:k] + t[k + 1:], t[:k] + "x" + t[k:], t[:k] + "y" + t[k + 1:], t[:k] + t[k + 1:k + 2] + t[k:k + 1] + t[k + 2:]}
    toks = sorted(t for t in toks if t)
    words = spark.createDataFrame([("g", t, 1, 1) for t in toks] + [("other", "abcd", 1, 1), ("other", "abce", 1, 1)], "graph_name string, token string, n long, graphs long")
    got = {(x["graph_name"], x["a"], x["b"]) for x in near_tokens(words, ["anna"], Scratch(spark, "near")).collect()}
    want = {("g", a, b) for a in toks for b in toks if a != b and a != "anna" and len(a) > 2 and len(b) > 3 and abs(len(a) - len(b)) < 2 and edits(a, b) == 1}
    assert got == want | {("other", "abcd", "abce"), ("other", "abce", "abcd")}, (sorted(got - want)[:5], sorted(want - got)[:5])
