"""Variant spellings of names typed by people.

1. Tokens of a graph are joined by similarity: positional 3-grams, prefix-filtered by the grams' rarity, verified by an edit
   distance of one (insertion, deletion, substitution, or two neighbours swapped). A token that is typed rarely and resembles a
   better supported one of its graph is taken for it. If another token is typed with both in the graph, that decides; only
   where the graph says nothing does it count how common both are in other graphs. A single word that holds most 3-grams of
   another token of its graph is joined with it by a second prefix-filtered join, of containment.
2. Spellings of the same tokens, without titles, legal forms and middle initials, are one form. Forms of a graph are joined on
   their tokens: a form is looked for by all of its tokens (with the given names that they are nicknames of, and the tokens
   found in them), and found by its prefix, the rarest tokens without which too little of its weight is left. A token meets
   another form's only together with the first letter of a further token, so that a frequent surname is split.
3. Every pair is verified by a soft weighted token similarity of both token sets: tokens match if they are equal, or less so as
   nickname, abbreviation, part, initial, tokens written together or acronym, and a token weighs the more the rarer it is in the
   whole corpus. All tokens of the lesser form must match. Abbreviations come from no list: they are the tokens that begin
   a longer one, or run through it in order.
4. A form stands for the most similar fuller form. If two are about equally similar, and neither is clearly more frequent, it
   stands for neither.

All joins are on keys within a graph, so no graph's spellings are compared pair by pair, whatever share of the rows it holds.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.ids import UUID_PATTERN, canonical_id
from factloom.runtime import Scratch, broadcast_if_small, ship

#: Words before or after a person's name, legal forms of companies, and words that may be left out.
TITLES = ("mr", "mrs", "ms", "miss", "mx", "dr", "prof", "professor", "sir", "madam", "dame", "rev", "hon", "jr", "sr", "phd", "md", "esq", "ing", "dipl", "herr", "frau", "mme", "mlle")
LEGAL = ("inc", "incorporated", "ltd", "limited", "llc", "llp", "lp", "plc", "gmbh", "mbh", "ag", "kg", "ab", "oy", "oyj", "bv", "nv", "as", "asa", "aps", "sa", "sas", "sarl", "srl", "spa", "co", "corp", "corporation", "company", "pty", "pvt", "kk")
LOOSE = ("the", "and", "of", "team", "teams", "group", "dept", "department")

#: How much an inexact match counts.
NICK, SIBLING, ABBREVIATION, CONTRACTION, INITIAL, TOGETHER, ACRONYM = 0.9, 0.85, 0.9, 0.88, 0.6, 0.95, 0.8
#: A pair needs this similarity; of two fuller forms the better one must be better by MARGIN, or have so many times the support.
LEAST, MARGIN, CLEARLY = 0.5, 0.02, 3.0
#: Where no other token of the graph is typed with both, a word in more than one graph is a slip of a similar one only if it
#: occurs in at most this share of that one's graphs.
SLIP_SHARE = 0.15
#: The same for slips of known words.
KNOWN_SHARE = 0.5
#: Words that are common in other graphs are slips only from this length on: of shorter ones an edit changes too much.
SLIP_LENGTH = 5
GRAM, PREFIX = 3, 5
#: A single word holds a token that may be written together with others in it if it holds this share of the token's grams.
WITHIN = 0.6
#: An abbreviation has at most this share of its word's letters, and two letters less.
SHORTER = 0.8

_parts = regex.compile(r"[\p{L}\p{N}]+").findall
_camel = regex.compile(r"(?<=\p{Ll})(?=\p{Lu})")
_OPTIONAL = frozenset((*TITLES, *LEGAL, *LOOSE))


def tokens(name: str) -> list[str]:
    """Lower-case runs of letters and digits without accents; words written together are cut where capitals begin, single letters joined."""
    bare = "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c))
    bare = regex.sub(r"(?<=\p{L})['’](?=\p{L})", "", bare.strip())
    if not regex.search(r"\s", bare):
        bare = _camel.sub(" ", bare)
    parts = [t.casefold() for t in _parts(bare)]
    return ["".join(parts)] if len(parts) > 1 and all(len(t) == 1 for t in parts) else parts


def _runs_through(short: str, word: str) -> bool:
    it = iter(word)
    return all(c in it for c in short)


def abbreviates(t: str, word: str) -> float:
    """How well `t` does as an abbreviation of `word`: it begins it, or runs through it in order; 0 if it is none."""
    if len(t) < 2 or t[0] != word[0] or len(t) > min(SHORTER * len(word), len(word) - 2):
        return 0.0
    for s in (t, t[:-1]) if t[-1] == "s" and len(t) > 3 else (t,):
        if len(s) > 2 and word.startswith(s):
            return ABBREVIATION
    for s in (t, t[:-1]) if t[-1] == "s" and len(t) > 3 else (t,):
        if _runs_through(s, word):
            return CONTRACTION
    return 0.0


def one_edit(a: str, b: str) -> bool:
    """Whether one edit turns a into b: an insertion, a deletion, a substitution, or two neighbours swapped."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    if len(a) == len(b):
        return a[k + 1 :] == b[k + 1 :] or (a[k + 2 :] == b[k + 2 :] and a[k : k + 2] == b[k : k + 2][::-1])
    return a[k:] == b[k + 1 :] if len(a) < len(b) else a[k + 1 :] == b[k:]


class Form:
    """What a spelling says: words with weights and the given names they may be nicknames of, initials, and optional words."""

    __slots__ = ("words", "weight", "given", "named", "letters", "short", "whole", "person", "business", "total")

    def __init__(self, words, weights, given, named, letters, short, whole, person, business):
        self.words, self.weight, self.letters, self.short, self.whole, self.person, self.business = words, dict(zip(words, weights)), letters, short, whole, person, business
        self.given = {t: set(g) for t, g in zip(words, given) if g}
        self.named = {t for t, n in zip(words, named) if n}
        self.total = sum(self.weight.values()) or 1.0

    def meaning(self, t: str) -> set[str]:
        """The given names that a word may stand for, itself if it is one."""
        return {t} if t in self.named else self.given.get(t, set())


def word_match(t: str, u: str, a: Form, b: Form) -> float:
    """How well two different words match, whichever of them is the lesser one."""
    if a.person and b.person:
        x, y = a.meaning(t), b.meaning(u)
        if x and y and not (t in a.named and u in b.named) and x & y:
            return NICK if t in y or u in x else SIBLING
        lesser, of, word = (t, a, u) if len(t) < len(u) else (u, b, t)
        if len(lesser) >= 3 and lesser not in of.named and len(word) > len(lesser) + 1 and lesser in word:
            return ABBREVIATION
    if a.business and b.business:
        lesser, of, word = (t, a, u) if len(t) < len(u) else (u, b, t)
        if not (of.person and lesser in of.named):
            return abbreviates(lesser, word)
    return 0.0


def together(whole: str, words: list[str], b: Form) -> dict[str, float] | None:
    """The words of which `whole` is written together, in any order, with how well each matches; None if it is not.

    The words that it contains are taken out, longest first; what is left over must be initials, short words, nicknames or slips of the others.
    """
    rest, found = whole, {}
    for u in sorted(words, key=lambda u: (-len(u), u)):
        if len(u) >= 3 and u in rest:
            rest = rest.replace(u, "\0", 1)
            found[u] = TOGETHER
    if not found:
        return None
    open_ = [u for u in words if u not in found]
    for piece in filter(None, rest.split("\0")):
        hit = next(((u, s) for u in open_ for s in (TOGETHER if piece == u else INITIAL if piece == u[0] else NICK if len(piece) >= 4 and one_edit(piece, u) else 0.0,) if s), None)
        if hit is None:
            return None
        found[hit[0]] = hit[1]
        open_.remove(hit[0])
    return found if len(found) > 1 else None


def similarity(a: Form, b: Form) -> tuple[float, bool]:
    """(similarity, whole) of two forms, a the lesser one; 0 if a word of it has no match. whole: words match one to one.

    The weight of what matches, by how well it does, over the weight of both forms.
    """
    best = _aligned(a, b)
    if len(a.words) == 1 and len(b.words) > 1:
        parts = together(a.whole, b.words, b)
        if parts:
            covers = sum(b.weight[u] * s for u, s in parts.items())
            least = min(parts.values())
            best = max(best, ((a.total * max(least, ABBREVIATION) + covers) / (a.total + b.total), False))
        if len(a.whole) == len(b.words) and len(a.whole) > 2 and b.business and sorted(a.whole) == sorted(u[0] for u in b.words):
            best = max(best, (ACRONYM, False))
    return best


def _aligned(a: Form, b: Form) -> tuple[float, bool]:
    of_a, of_b = {t: 1.0 for t in a.words if t in b.weight}, {}
    of_b.update(of_a)
    left, open_ = [t for t in a.words if t not in of_a], [u for u in b.words if u not in of_b]
    single = True
    for t in sorted(left, key=lambda t: (-a.weight[t], t)):
        s, u = max(((word_match(t, u, a, b), u) for u in open_), default=(0.0, ""))
        if s:
            of_a[t], of_b[u] = s, s
            open_.remove(u)
            continue
        parts = together(t, open_, b) if of_b else None
        if parts is None and of_b and len(t) == len(open_) > 1 and sorted(t) == sorted(u[0] for u in open_):
            parts = dict.fromkeys(open_, ACRONYM)
        if parts is None:
            return 0.0, False
        of_a[t], single = min(parts.values()), False
        of_b.update(parts)
        open_ = [u for u in open_ if u not in parts]
    letters = list(a.letters)
    if open_ and letters:
        for c in a.letters:
            u = next((u for u in open_ if u[0] == c), None)
            if u is not None:
                of_b[u] = INITIAL
                open_.remove(u)
                letters.remove(c)
                single = False
        if open_ and letters and len(b.words) <= len(a.words) + len(a.letters):
            return 0.0, False
    for short in a.short:  # a legal form that spells the initials of what is missing
        if len(short) == len(open_) > 1 and sorted(short) == sorted(u[0] for u in open_):
            of_b.update(dict.fromkeys(open_, ABBREVIATION))
            open_, single = [], False
    if not of_b:
        return 0.0, False
    if len(a.words) == 1 and open_ and a.words[0] in a.named:  # a given name alone stands for nobody
        return 0.0, False
    got = sum(a.weight[t] * s for t, s in of_a.items()) + sum(b.weight[u] * s for u, s in of_b.items())
    return got / (a.total + b.total), single and not open_ and len(a.words) == len(b.words)


def spellings(*sources: DataFrame) -> DataFrame:
    """(graph_name, name, n, kinds) of (graph_name, name, kind) rows: each distinct spelling, exactly as stored, that is neither blank nor an id."""
    rows = sources[0]
    for s in sources[1:]:
        rows = rows.unionByName(s)
    c = canonical_id(F.col("name"))
    kept = rows.filter(c.isNotNull() & ~c.rlike(UUID_PATTERN) & F.col("graph_name").isNotNull())
    kinds = ("Person", "Company", "Team")
    # kinds that nothing is said about stay unknown
    seen = kept.groupBy("graph_name", "name").agg(F.count(F.lit(1)).alias("n"), *(F.max(F.coalesce(F.lower("kind") == k.lower(), F.lit(False))).alias(k) for k in kinds))
    return seen.select("graph_name", "name", "n", F.filter(F.array(*(F.when(F.col(k), F.lit(k)) for k in kinds)), lambda x: x.isNotNull()).alias("kinds"))


def _slip(a: Column, b: Column) -> Column:
    """Whether one edit turns a into b."""
    near = F.levenshtein(a, b, 2)
    differ = F.filter(F.sequence(F.lit(1), F.length(a)), lambda i: F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1)))
    i = F.get(differ, F.lit(0))
    swapped = (F.size(differ) == 2) & (F.get(differ, F.lit(1)) == i + 1) & (F.substr(a, i, F.lit(1)) == F.substr(b, i + 1, F.lit(1))) & (F.substr(a, i + 1, F.lit(1)) == F.substr(b, i, F.lit(1)))
    return (near == 1) | ((near == 2) & (F.length(a) == F.length(b)) & swapped)


def near_tokens(words: DataFrame, known: list[str], scratch: Scratch) -> DataFrame:
    """(graph_name, a, an, ag, b, bn, bg, bk): all pairs of a graph's tokens that one edit turns into each other, a not a known word.

    words: (graph_name, token, n, graphs[, named]), one row per graph and token; known are `known` and those that are named. An edit
    touches at most four of a token's grams and moves the others by at most one place, so of the PREFIX rarest grams of either token one is shared.
    """
    flag = F.col("token").isin(known) | (F.coalesce("named", F.lit(False)) if "named" in words.columns else F.lit(False))
    long = words.filter(F.length("token") >= 3).select("graph_name", "token", "n", "graphs", flag.alias("known"))
    padded = F.concat(F.lit("##"), F.col("token"), F.lit("$$"))
    grams = long.select("graph_name", "token", F.posexplode(F.transform(F.sequence(F.lit(1), F.length("token") + 2), lambda i: F.substr(padded, i, F.lit(GRAM)))).alias("pos", "gram"))
    rarity = broadcast_if_small(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df")))
    ranked = grams.join(rarity, "gram").groupBy("graph_name", "token").agg(F.slice(F.array_sort(F.collect_list(F.struct("df", "gram", "pos"))), 1, PREFIX).alias("prefix"))
    prefix = scratch.write(ranked.join(long, ["graph_name", "token"]).select("graph_name", "token", "n", "graphs", "known", F.inline("prefix")).drop("df"), "prefixes")
    slips = prefix.filter("not known").select("graph_name", "gram", F.col("token").alias("a"), F.col("n").alias("an"), F.col("graphs").alias("ag"), F.explode(F.array(F.col("pos") - 1, F.col("pos"), F.col("pos") + 1)).alias("pos"))
    meant = prefix.filter(F.length("token") >= 4).select("graph_name", "gram", "pos", F.col("token").alias("b"), F.col("n").alias("bn"), F.col("graphs").alias("bg"), F.col("known").alias("bk"))
    near = slips.join(meant, ["graph_name", "gram", "pos"]).filter((F.abs(F.length("a") - F.length("b")) <= 1) & (F.col("a") != F.col("b"))).select("graph_name", "a", "an", "ag", "b", "bn", "bg", "bk").distinct()
    return scratch.write(near.filter(_slip(F.col("a"), F.col("b"))), "near")


def typed_with_both(pairs: DataFrame, each: DataFrame, slips: DataFrame) -> DataFrame:
    """The (graph_name, a, b) pairs for which another token of the graph is typed with `a` in one spelling and with `b` in another.

    each: (sid, graph_name, token); the other token counts as it is meant by slips (graph_name, a, b). Optional words and letters
    say nothing.
    """
    kept = pairs.select("graph_name", "a", "b").filter(F.least(F.length("a"), F.length("b")) >= SLIP_LENGTH)
    asked = kept.select("graph_name", F.explode(F.array("a", "b")).alias("token")).distinct()
    others = each.join(asked, ["graph_name", "token"]).select("sid", "graph_name", "token").distinct().join(each.select("sid", F.col("token").alias("other")), "sid")
    others = others.filter((F.col("other") != F.col("token")) & (F.length("other") > 1) & ~F.col("other").isin(*_OPTIONAL)).select("graph_name", "token", "other").distinct()
    one = slips.groupBy("graph_name", F.col("a").alias("other")).agg(F.max("b").alias("meant"))
    others = others.join(one, ["graph_name", "other"], "left").select("graph_name", "token", F.coalesce("meant", "other").alias("other")).distinct()
    return kept.join(others.withColumnRenamed("token", "a"), ["graph_name", "a"]).join(others.withColumnRenamed("token", "b"), ["graph_name", "b", "other"]).select("graph_name", "a", "b").distinct()


def token_slips(words: DataFrame, each: DataFrame, scratch: Scratch) -> DataFrame:
    """(graph_name, token, meant): tokens taken for better supported ones. each: (sid, graph_name, token)."""
    near = near_tokens(words, sorted(_OPTIONAL), scratch)
    # slips of one word resemble that word more often than each other, so the word with most neighbours is the one that is meant
    ends = F.array(F.struct(F.col("a").alias("token"), F.col("b").alias("other")), F.struct(F.col("b").alias("token"), F.col("a").alias("other")))
    degree = near.select("graph_name", F.inline(ends)).distinct().groupBy("graph_name", "token").agg(F.count(F.lit(1)).alias("degree"))
    both = near.join(degree.withColumnsRenamed({"token": "a", "degree": "ad"}), ["graph_name", "a"]).join(degree.withColumnsRenamed({"token": "b", "degree": "bd"}), ["graph_name", "b"])
    better = F.col("bk") | (F.struct("bg", "bd", "bn", "b") > F.struct("ag", "ad", "an", "a"))
    rare = F.col("ag") <= F.greatest(F.lit(1.0), F.when(F.col("bk"), KNOWN_SHARE).otherwise(SLIP_SHARE) * F.col("bg"))
    both = scratch.write(both.filter(better).select("graph_name", "a", "b", "bk", "bg", "bd", "bn", rare.alias("rare")), "better")
    slips = both.filter("rare")
    common = both.filter("not rare")
    slips = slips.unionByName(common.join(typed_with_both(common, each, slips), ["graph_name", "a", "b"], "left_semi"))
    to = slips.groupBy("graph_name", "a").agg(F.max(F.struct("bk", "bg", "bd", "bn", "b")).alias("m")).select("graph_name", "a", F.col("m.b").alias("b"))
    for k in range(2):  # four steps of slips of slips
        to = scratch.write(to, f"slips{k}")
        to = to.join(to.select("graph_name", F.col("a").alias("b"), F.col("b").alias("c")), ["graph_name", "b"], "left").select("graph_name", "a", F.coalesce("c", "b").alias("b"))
    return to.withColumnsRenamed({"a": "token", "b": "meant"})


def tokens_within(words: DataFrame, alone: DataFrame, share: float = WITHIN) -> DataFrame:
    """(graph_name, whole, token): the tokens of which another word of their graph holds at least `share` of the grams.

    words: (graph_name, token); alone: (graph_name, whole). A token that has so many of its grams in a word shares one of its
    rarest size - ceil(share * size) + 1 grams with it.
    """
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - (GRAM - 1)), lambda i: F.substr(c, i, F.lit(GRAM))))
    small = words.filter(F.length("token") >= GRAM).select("graph_name", "token", grams(F.col("token")).alias("grams"))
    long = alone.filter(F.length("whole") > GRAM).select("graph_name", "whole", F.explode(grams(F.col("whole"))).alias("gram"))
    rarity = broadcast_if_small(small.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("df")))
    ranked = small.select("graph_name", "token", F.size("grams").alias("size"), F.explode("grams").alias("gram")).join(rarity, "gram").groupBy("graph_name", "token", "size").agg(F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("g"))
    prefix = ranked.select("graph_name", "token", F.explode(F.slice("g", F.lit(1), (F.col("size") - F.ceil(F.col("size") * share) + 1).cast("int"))).alias("x")).select("graph_name", "token", F.col("x.gram").alias("gram"))
    met = long.join(prefix, ["graph_name", "gram"]).filter(F.length("token") < F.length("whole")).select("graph_name", "whole", "token").distinct()
    shared = F.size(F.array_intersect(grams(F.col("whole")), grams(F.col("token"))))
    return met.filter(shared >= share * F.size(grams(F.col("token"))))


_FORM = "graph_name string, key string, words array<string>, w array<double>, given array<array<string>>, named array<boolean>, begins array<array<string>>, letters array<string>, short array<string>, whole string, person boolean, business boolean"


def _forms(batches):
    """(sid, n, form) of (sid, n, graph_name, kinds, raw, token, w, given, named, begins) rows."""
    fields = [f.strip().split(" ")[0] for f in _FORM.split(",")]
    for b in batches:
        out = []
        for sid, n, graph, kinds, raw, toks, w, given, named, begins in zip(*(c.to_pylist() for c in b.columns)):
            if not toks:
                continue
            at = {t: k for k, t in reversed(list(enumerate(toks)))}
            words = sorted(t for t in at if len(t) > 1 and t not in _OPTIONAL) or sorted(t for t in at if len(t) > 1) or sorted(at)
            letters = sorted({t for t in toks if len(t) == 1 and t.isalpha() and t not in words})
            short = sorted({r for r in raw if r in LEGAL and 2 <= len(r) <= 3 and r not in words})
            kept = [r for r in raw if r not in _OPTIONAL]
            whole = "".join(kept or raw)
            marks = any(t in LEGAL or t in ("team", "teams") for t in toks)
            person = "Person" in kinds if kinds else not marks
            business = marks or not kinds or bool(set(kinds) - {"Person"})
            key = " ".join(words)
            if len(words) == 1:  # what a single word is written with tells more than its meaning
                key += "|" + " ".join(letters) + "|" + " ".join(short) + ("|" + whole if whole != words[0] else "")
            else:
                letters, short, whole = [], [], ""
            out.append((sid, n, graph, key, words, [w[at[t]] for t in words], [given[at[t]] or [] for t in words], [bool(named[at[t]]) for t in words], [begins[at[t]] or [] for t in words], letters, short, whole, person, business))
        if out:
            text, texts = pa.string(), pa.list_(pa.string())
            kinds_ = [pa.int64(), pa.int64(), text, text, texts, pa.list_(pa.float64()), pa.list_(texts), pa.list_(pa.bool_()), pa.list_(texts), texts, texts, text, pa.bool_(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds_)], ["sid", "n", *fields])


def _elements(batches):
    """(fid, graph_name, side, element, letter): what a form is looked for by ("ask"), and found by ("have")."""
    for b in batches:
        out = []
        for fid, graph, words, w, given, begins, letters, whole, within in zip(*(c.to_pylist() for c in b.columns)):
            firsts = [{t[0], *(x[0] for x in g), *more} for t, g, more in zip(words, given, begins)]
            for k, (t, g) in enumerate(zip(words, given)):
                other = set(letters).union(*(f for j, f in enumerate(firsts) if j != k)) if len(words) > 1 else set(letters)
                out += [(fid, graph, True, x, c) for x in dict.fromkeys((t, *g)) for c in sorted(other) or [""]]
            if len(words) == 1:
                out += [(fid, graph, True, u, "") for u in within or () if u != words[0] or letters]
                if len(whole) > 2:
                    out.append((fid, graph, True, "#" + "".join(sorted(whole)), ""))
                continue
            total, rest = sum(w), sum(w)
            for t, x in sorted(zip(words, w), key=lambda p: (-p[1], p[0])):
                # a form that matches nothing of the prefix matches less than LEAST asks for
                if rest < total * LEAST / (2 - LEAST):
                    break
                rest -= x
                out += [(fid, graph, False, t, c) for c in ["", *sorted({u[0] for u in words if u != t})]]
            out.append((fid, graph, False, "#" + "".join(sorted(u[0] for u in words)), ""))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.string()])], ["fid", "graph_name", "ask", "element", "letter"])


def _verified(batches):
    """(a, b, similarity, whole) of pairs of forms that are similar enough."""
    for batch in batches:
        names = batch.schema.names
        col = {n: batch.column(k).to_pylist() for k, n in enumerate(names)}
        parts = ("words", "w", "given", "named", "letters", "short", "whole", "person", "business")
        sides = [list(zip(*(col[f"{s}_{p}"] for p in parts))) for s in "ab"]
        out = []
        for a, b, x, y in zip(col["a"], col["b"], *sides):
            sim, whole = similarity(Form(*x), Form(*y))
            if sim >= LEAST:
                out.append((a, b, sim, whole))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64(), pa.int64(), pa.float64(), pa.bool_()])], ["a", "b", "similarity", "whole"])


def similar_forms(forms: DataFrame, inside: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b, similarity, whole): the similar forms of a graph, a the lesser one.

    forms: as made by `resolve`, with fid, order and within; inside: (graph_name, whole, token), tokens and the words they are a part of.
    """
    elements = scratch.write(forms.select("fid", "graph_name", "words", "w", "given", "begins", "letters", "whole", "within").mapInArrow(_elements, "fid long, graph_name string, ask boolean, element string, letter string"), "elements")
    asks, have = (elements.filter(c).select("graph_name", "element", "letter", F.col("fid").alias(k)) for c, k in (("ask", "a"), ("not ask", "b")))
    # parts of words are looked for as those words, too
    asks = asks.unionByName(asks.filter("letter != ''").join(inside.withColumnRenamed("token", "element"), ["graph_name", "element"]).select("graph_name", F.col("whole").alias("element"), "letter", "a")).distinct()
    pairs = asks.join(have, ["graph_name", "element", "letter"]).filter("a != b").select("a", "b").distinct()
    parts = ("words", "w", "given", "named", "letters", "short", "whole", "person", "business")
    side = lambda s: forms.select(F.col("fid").alias(s), F.col("order").alias(f"{s}_order"), *(F.col(p).alias(f"{s}_{p}") for p in parts))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    # of two forms of as many words the one that is less complete may stand for the other
    both = both.filter((F.size("a_words") < F.size("b_words")) | ((F.size("a_words") == F.size("b_words")) & (F.col("a_order") < F.col("b_order")))).drop("a_order", "b_order")
    return scratch.write(both.mapInArrow(_verified, "a long, b long, similarity double, whole boolean"), "similar")


def _clear(candidates: DataFrame) -> DataFrame:
    """(a, b) of (a, b, similarity, support): the best of each a, if it is clearly better than the second best."""
    w = Window.partitionBy("a").orderBy(F.desc("similarity"), F.desc("support"), "b")
    two = candidates.withColumn("k", F.row_number().over(w)).filter("k <= 2").groupBy("a").agg(*(F.max(F.when(F.col("k") == k, F.struct("similarity", "support", "b"))).alias(n) for k, n in ((1, "x"), (2, "y"))))
    clear = F.col("y").isNull() | (F.col("x.similarity") > F.col("y.similarity") + MARGIN) | (F.col("x.support") >= CLEARLY * F.greatest("y.support", F.lit(1)))
    return two.filter(clear).select("a", F.col("x.b").alias("b"))


def _roots(to: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, root) of pointers (a, b) that run in no circle: where following them ends."""
    to = scratch.write(to, "pointers")
    while True:
        near = to.join(to.select(F.col("a").alias("b"), F.col("b").alias("c")), "b", "left")
        near = scratch.write(near.select("a", F.coalesce("c", "b").alias("b"), F.col("c").isNotNull().alias("moved")), "pointers")
        to = near.select("a", "b")
        if near.filter("moved").isEmpty():
            return to.withColumnRenamed("b", "root")


def resolve(names: DataFrame, nicknames: DataFrame) -> DataFrame:
    """(graph_name, name, entity): the entity each spelling stands for; spellings with one entity mean the same. See `link`.

    A spelling without letters and digits stands for itself. Repeated and null nicknames count once and not at all.
    """
    s = Scratch(names.sparkSession, "names")
    ship(names.sparkSession)
    known = s.write(names.select(F.monotonically_increasing_id().alias("sid"), "*"), "spellings")

    def cut(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array([tokens(x) for x in b.column("name").to_pylist()], pa.list_(pa.string()))], ["sid", "graph_name", "n", "kinds", "tokens"])

    cuts = s.write(known.select("sid", "graph_name", "n", "kinds", "name").mapInArrow(cut, "sid long, graph_name string, n long, kinds array<string>, tokens array<string>"), "tokens")
    each = cuts.select("sid", "graph_name", "n", F.posexplode("tokens").alias("k", "token"))
    in_graph = s.write(each.groupBy("graph_name", "token").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("df")), "graph-tokens")
    nicks = nicknames.select(F.lower("nick").alias("token"), F.lower("given_name").alias("given")).dropna().distinct()
    given = nicks.groupBy("token").agg(F.array_sort(F.collect_set("given")).alias("given"))  # as many as the table says of one nickname
    called = nicks.select(F.col("given").alias("token")).distinct().withColumn("called", F.lit(True))
    corpus = in_graph.groupBy("token").agg(F.count(F.lit(1)).alias("graphs"), F.sum("df").alias("df"))
    weigh = F.log(F.lit(1.0) + F.lit(float(known.scratch_rows)) / F.col("df"))
    corpus = corpus.join(given, "token", "left").join(called, "token", "left")
    corpus = s.write(corpus.select("token", "graphs", weigh.alias("w"), "given", F.coalesce("called", F.lit(False)).alias("named")), "corpus-tokens")
    words = in_graph.join(corpus, "token").select("graph_name", "token", "n", "graphs", (F.col("named") | F.col("given").isNotNull()).alias("named"))
    slips = s.write(token_slips(words, each.select("sid", "graph_name", "token"), s), "meant")
    # what is part of a longer word of its graph may abbreviate it
    plain = words.filter("not named").select("graph_name", "token").join(slips, ["graph_name", "token"], "left_anti")
    inside = s.write(tokens_within(plain, words.select("graph_name", F.col("token").alias("whole")), 1.0), "inside")
    begins = inside.groupBy("graph_name", "token").agg(F.collect_set(F.substring("whole", 1, 1)).alias("begins"))  # letters
    meant = each.join(slips, ["graph_name", "token"], "left").select("sid", "graph_name", "k", F.col("token").alias("raw"), F.coalesce("meant", "token").alias("token"))
    meant = meant.join(begins, ["graph_name", "token"], "left")
    # a token is weighed as it is meant, so that slips don't count as rare words
    weighed = meant.join(corpus.drop("graphs"), "token").select("sid", F.struct("k", "raw", "token", "w", "given", "named", "begins").alias("t"))
    rows = weighed.groupBy("sid").agg(F.array_sort(F.collect_list("t")).alias("t")).join(cuts.select("sid", "graph_name", "n", "kinds"), "sid")  # the words of one spelling
    made = rows.select("sid", "n", "graph_name", "kinds", *(F.col(f"t.{c}").alias(c) for c in ("raw", "token", "w", "given", "named", "begins"))).mapInArrow(_forms, f"sid long, n long, {_FORM}")
    made = s.write(made, "readings")
    # how complete a form is: written without nicknames, in long words, often
    short_names = F.size(F.filter(F.arrays_zip("given", "named"), lambda x: (F.size(x["given"]) > 0) & ~x["named"]))
    one = made.groupBy("graph_name", "key").agg(*(F.first(c).alias(c) for c in ("words", "w", "given", "named", "begins", "letters", "short", "whole")), F.max("person").alias("person"), F.max("business").alias("business"), F.sum("n").alias("support"))
    forms = s.write(one.select(F.monotonically_increasing_id().alias("fid"), "*", F.struct(-short_names, F.length("key"), "support", "key").alias("order")), "forms")
    whole = forms.filter("size(words) = 1").select("graph_name", "whole").distinct()
    long = forms.filter("size(words) > 1").select("graph_name", F.explode("words").alias("token")).distinct()
    within = tokens_within(long, whole).groupBy("graph_name", "whole").agg(F.collect_set("token").alias("within"))  # at most the grams of one word
    forms = s.write(forms.join(within.withColumn("single", F.lit(True)), ["graph_name", "whole"], "left").drop("single"), "forms-within")
    similar = similar_forms(forms, inside, s)
    support = forms.select(F.col("fid").alias("b"), "support")
    # forms that say the same in as many words, then forms that say less
    best = similar.filter("whole").join(support, "b")
    roots = _roots(best.groupBy("a").agg(F.max(F.struct("similarity", "support", "b")).alias("m")).select("a", F.col("m.b").alias("b")), s)
    of = lambda c: forms.select(F.col("fid").alias(c)).join(roots.withColumnRenamed("a", c), c, "left").select(c, F.coalesce("root", c).alias("root"))
    belongs = s.write(of("fid"), "belongs")
    size = belongs.join(forms.select("fid", "support"), "fid").groupBy("root").agg(F.sum("support").alias("support"))
    free = belongs.join(roots.select(F.col("a").alias("fid")), "fid", "left_anti").select(F.col("fid").alias("a"))
    parts = similar.filter("not whole").join(free, "a", "left_semi").join(belongs.withColumnRenamed("fid", "b"), "b").groupBy("a", "root").agg(F.max("similarity").alias("similarity"))
    further = _roots(_clear(parts.join(size, "root").select("a", F.col("root").alias("b"), "similarity", "support")), s)
    last = belongs.join(further.select(F.col("a").alias("root"), F.col("root").alias("further")), "root", "left").select("fid", F.coalesce("further", "root").alias("root"))
    names_ = last.join(forms.select(F.col("fid").alias("root"), F.col("key").alias("entity")), "root").select("fid", "entity")
    by_form = forms.select("fid", "graph_name", "key").join(names_, "fid").select("graph_name", "key", "entity")
    found = made.select("sid", "graph_name", "key").join(by_form, ["graph_name", "key"]).select("sid", "entity")
    return s.write(known.join(found, "sid", "left").select("graph_name", "name", F.coalesce("entity", F.concat(F.lit("!"), F.col("name"))).alias("entity")), "resolved")


def link(resolved: DataFrame) -> DataFrame:
    """(graph_name, name_a, name_b): every pair of spellings of one entity of a graph, name_a < name_b in binary order."""
    a, b = resolved.withColumnRenamed("name", "name_a"), resolved.withColumnRenamed("name", "name_b")
    return a.join(b, ["graph_name", "entity"]).filter("name_a < name_b").select("graph_name", "name_a", "name_b")


def typed_names(entity_inputs: DataFrame, relationship_inputs: DataFrame) -> DataFrame:
    """Spellings not tied to a vertex yet: names of entity inputs without one, and ends of relationship inputs that are no ids."""
    e = entity_inputs.filter("entity_id is null").select("graph_name", "name", F.col("entity_type").alias("kind"))
    ends = [relationship_inputs.select("graph_name", F.col(f"{x}_name").alias("name"), F.col(f"{x}_type").alias("kind")) for x in ("from", "to")]
    return spellings(e, *ends)
