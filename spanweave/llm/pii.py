"""Operator 9: personal data as character spans. DataFrame functions only.

Base spans: emails, IP addresses, card and phone numbers by fixed patterns and checks, leftmost and
not overlapping within a kind. They always stay.

Method: generators with high recall propose further, overlapping spans (see ``GENERATORS``). Each has
format features (length, digits, letters, variety, sign) and context features (key word before it,
the characters around it), in a few bins. The labels are planted, so no rule over these features makes them: into
windows cut from at most ``CONTEXTS`` texts of the corpus, values are written that are personal data (secrets, numbers and addresses made
from a hash) or that only look like them (digests, dates, versions, long words), each after words that go with
it; a candidate that is a planted value has its label, and one that covers part of a harmless value is negative. Gradient-boosted trees of depth two are
fitted: Spark counts the candidates of each feature combination (at most the product of the bins, whatever the
corpus), the driver fits that table, and the trees go back as SQL CASE expressions. A threshold per
generator is calibrated on windows held out by hash: the lowest score at which their precision
is ``PRECISION``. Candidates that reach it and overlap no base span are added; of overlapping ones the
higher score stays.

Patterns are written with possessive loops and anchors at the start of a run; they match the same
spans as the plain ones but need neither deep recursion nor a second look at the same characters.
Positions come from the pieces between the matches, summed in blocks of about the square root of
their number.

Defined cases: null text is empty; null ids are carried along; repeated rows are searched alike;
extra columns are ignored by ``find`` and carried along by ``redact``; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from spanweave.llm.common import fresh, stored
from spanweave.llm.decontamination import bound

KINDS = ("email", "ip", "card", "phone", "secret")
LOCAL = "[A-Za-z0-9._%+-]"
#: The base patterns, in possessive form.
BASE = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Kind and pattern of each generator of further spans.
GENERATORS = {
    "run": ("secret", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+"),
    "number": ("phone", r"(?<![0-9+])\(?+[0-9]{2,4}+\)?+(?:[ .-]++[0-9]{2,4}+){2,4}+(?![0-9])"),
    "spelled": ("email", rf"(?<!{LOCAL}){LOCAL}{{1,64}}+ ?[\[(]at[\])] ?[A-Za-z0-9-]++(?: ?(?:\.|[\[(]dot[\])]) ?[A-Za-z0-9-]++)++"),
}
WORDS = {
    1: r"(?i)(?:token|key|secret|password|passwd|pwd|bearer)\"?\s{0,3}[=:]\s{0,3}[\"']?$",
    2: r"(?i)(?:token|key|secret|password|passwd|pwd|bearer)\W{0,6}$",
    3: r"(?i)(?:tel|phone|call|mobile|fax)\W{0,6}(?:\w{0,6}\W{0,3})?$",
    4: r"(?i)(?:mail|contact|write)\W{0,6}(?:\w{0,6}\W{0,3})?$",
}
FEATURES = ("gen", "length", "digits", "letters", "variety", "word", "before", "after")
BEFORE = 32
ROUNDS = 24
RATE = 0.5
PRECISION = 0.98
#: How many texts give windows for planted values (the classifier's bounded sample), and how wide a window is.
CONTEXTS = 4_000
WINDOW = 160


# ---------------------------------------------------------------- spans

def spans_of(text: Column, pattern: str) -> Column:
    """array<struct<start, stop, span, before, after>> of the leftmost matches, in code points."""
    p = F.lit(pattern)

    def places(x: Column) -> Column:
        piece, found = x["piece"], x["found"]
        return bound(F.zip_with(piece, found, lambda a, b: F.length(a) + F.coalesce(F.length(b), F.lit(0))),
                     lambda steps: bound(F.ceil(F.sqrt(F.size(found))).cast("int"), lambda side: bound(
                         F.transform(F.sequence(F.lit(0), side), lambda k: total(steps, k * side, side)),
                         lambda sums: bound(
                             F.transform(F.sequence(F.lit(0), side), lambda k: total(sums, F.lit(0), k)),
                             lambda heads: F.transform(found, lambda m, i: bound(
                                 F.get(heads, F.floor(i / side).cast("int"))
                                 + total(steps, F.floor(i / side).cast("int") * side, i % side)
                                 + F.length(F.get(piece, i)),
                                 lambda at: F.struct(
                                     at.alias("start"), (at + F.length(m)).alias("stop"), m.alias("span"),
                                     F.right(F.get(piece, i), F.lit(BEFORE)).alias("before"),
                                     F.left(F.get(piece, i + 1), F.lit(1)).alias("after"))))))))

    def total(values: Column, first: Column, count: Column) -> Column:
        return F.aggregate(F.slice(values, first + 1, count), F.lit(0), lambda a, v: a + v)

    empty = F.array().cast("array<struct<start:int,stop:int,span:string,before:string,after:string>>")
    both = F.struct(F.split(text, pattern, -1).alias("piece"), F.regexp_extract_all(text, p, F.lit(0)).alias("found"))
    return F.when(text.rlike(pattern), bound(both, places)).otherwise(empty)


def digits_of(span: Column) -> Column:
    return F.regexp_replace(span, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    n = F.length(digits)
    one = lambda i: F.substring(digits, n - i, F.lit(1)).cast("int")
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + F.when(i % 2 == 0, one(i)).otherwise(
        one(i) * 2 - F.when(one(i) > 4, F.lit(9)).otherwise(F.lit(0)))) % 10 == 0


def valid(kind: str, span: Column) -> Column:
    digits = digits_of(span)
    if kind == "ip":
        return F.forall(F.split(span, r"\."), lambda x: x.cast("double") <= 255)
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """array<struct<kind, start, stop>> of the base kinds."""
    def of(kind: str) -> Column:
        good = F.filter(spans_of(text, BASE[kind]), lambda s: valid(kind, s["span"]))
        return F.transform(good, lambda s: F.struct(F.lit(KINDS.index(kind)).alias("kind"), s["start"].alias("start"),
                                                    s["stop"].alias("stop")))
    return F.concat(*[of(kind) for kind in BASE])


# ---------------------------------------------------------------- candidates

def _bin(value: Column, *edges: int) -> Column:
    """0, 1, ... by the number of edges that the value reaches."""
    return sum([(value >= e).cast("int") for e in edges], F.lit(0))


def _around(char: Column) -> Column:
    return (F.when(F.length(char) == 0, 0).when(char.rlike(r"^\s"), 1).when(char.rlike("[\"'`<>()\\[\\]]"), 2)
             .when(char.rlike(r"^[\p{L}\p{N}]"), 3).otherwise(4)).cast("int")


def candidates(text: Column) -> Column:
    """Spans of the generators with their features."""
    def of(name: str, number: int) -> Column:
        kind, pattern = GENERATORS[name]

        def one(s: Column) -> Column:
            span = s["span"]
            digits, letters = F.length(digits_of(span)), F.length(F.regexp_replace(span, "[^A-Za-z]", ""))
            word = F.lit(0)
            for k in sorted(WORDS, reverse=True):
                word = F.when(s["before"].rlike(WORDS[k]), k).otherwise(word)
            variety = F.size(F.array_distinct(F.split(span, "")))
            return F.struct(
                F.lit(KINDS.index(kind)).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"),
                F.lit(number).alias("gen"), _bin(F.length(span), 20, 28, 40, 64).alias("length"),
                _bin(digits, 1, 4, 9, 14).alias("digits"), _bin(letters, 1, 4, 12).alias("letters"),
                _bin(variety, 4, 8, 14).alias("variety"), word.cast("int").alias("word"),
                _around(F.right(s["before"], F.lit(1))).alias("before"), _around(s["after"]).alias("after"))
        return F.transform(spans_of(text, pattern), one)
    return F.concat(*[of(name, number) for number, name in enumerate(GENERATORS)])


# ---------------------------------------------------------------- planted labels

def _made(row: Column) -> list[tuple[int, int, tuple, list[Column]]]:
    """(generator, label, words before, values) of what is planted; values are made from the hash ``row``."""
    def hashed(tag: str) -> Column:
        return F.md5(F.concat(row, F.lit(tag)))

    def digits(tag: str, n: int) -> Column:
        return F.substring(F.translate(hashed(tag), "abcdef", "012345"), 1, n)

    def letters(tag: str, n: int) -> Column:
        return F.substring(F.translate(hashed(tag), "0123456789", "ghijklmnop"), 1, n)

    def below(tag: str, n: int) -> Column:
        return F.pmod(F.conv(F.substring(hashed(tag), 1, 8), 16, 10).cast("bigint"), F.lit(n)).cast("int")

    def padded(tag: str, n: int) -> Column:
        return F.lpad((below(tag, n) + 1).cast("string"), 2, "0")
    base64 = F.translate(F.base64(F.unhex(F.concat(hashed("a"), hashed("b")))), "=", "")
    sized = F.substring(base64, F.lit(1), 18 + below("size", 24))
    hexes = F.substring(F.concat(hashed("c"), hashed("d")), F.lit(1), 20 + 4 * below("size", 12))
    year, month, day = (2000 + below("y", 30)).cast("string"), padded("m", 12), padded("n", 28)
    word = F.concat(letters("a", 6), letters("b", 5), letters("c", 8))
    secret = ("token: ", "api_key = ", "secret=", "password: ", 'token = "', "the key is: ", "Bearer ", "passwd='", "client secret: ")
    harmless = ("commit ", "see ", "digest ", "file ", "sha256:", "the ", "id=", "", "etag: ", "page ")
    call = ("Tel: ", "phone ", "call me on ", "Fax ", "mobile: ", "Phone no. ", "tel. ")
    dated = ("on ", "from ", "version ", "between ", "no. ", "scores ", "", "table ", "ISBN ")
    mail = ("mail ", "e-mail: ", "contact ", "write to ", "mail me at ", "Contact: ")
    looks = ("", "we ", "please ", "they ", "and ")
    return [
        (0, 1, secret, [sized, hexes, F.concat(F.lit("sk_live_"), sized), F.concat(letters("x", 9), F.lit("-"), digits("y", 8))]),
        (0, 0, harmless, [sized, hexes, F.concat_ws("-", letters("p", 5), letters("q", 7), letters("r", 6)),
                          F.concat_ws("/", F.lit("usr/share"), letters("p", 7), letters("q", 5)), word, F.repeat(F.lit("-"), 30)]),
        (0, 0, secret, [word, F.concat_ws("_", letters("p", 5), letters("q", 7), letters("r", 6)), F.repeat(F.lit("x"), 20)]),
        (1, 1, call, [F.concat_ws(" ", F.concat(F.lit("0"), digits("a", 3)), digits("b", 3), digits("c", 4)),
                      F.concat(F.lit("("), digits("a", 3), F.lit(") "), digits("b", 3), F.lit("-"), digits("c", 4)),
                      F.concat_ws("-", F.concat(F.lit("0"), digits("a", 1)), *[digits(t, 2) for t in "bcde"]),
                      F.concat_ws(".", digits("a", 3), digits("b", 3), digits("c", 4))]),
        (1, 0, dated, [F.concat_ws("-", year, month, day), F.concat_ws(".", day, month, year), F.concat_ws(" ", *[digits(t, 3) for t in "abcd"]),
                       F.concat(F.concat_ws("-", year, month, day), F.lit(" "), padded("h", 24)), F.concat_ws(".", *[digits(t, 2) for t in "abc"]),
                       F.concat_ws("-", F.lit("978"), digits("a", 2), digits("b", 4), digits("c", 3))]),
        (1, 0, call, [F.concat_ws("-", year, month, day), F.concat_ws(".", day, month, year)]),
        (2, 1, mail, [F.concat(letters("a", 5), F.lit(" [at] "), letters("b", 7), F.lit(" [dot] com")),
                      F.concat(letters("a", 4), F.lit("."), letters("b", 6), F.lit("(at)"), letters("c", 6), F.lit(".org"))]),
        (2, 0, looks, [F.concat(F.lit("looked (at) "), letters("a", 5), F.lit("."), digits("b", 2)),
                       F.concat(F.lit("met [at] noon."), digits("b", 1)), F.concat(F.lit("arrive (at) "), digits("c", 2), F.lit("."), digits("d", 2))]),
    ]


def planted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``fold``, features and label of the candidates on planted values, in windows of at most ``CONTEXTS`` texts. The
    texts are chosen by their hash; equal texts count once."""
    text = F.col(text_col)
    rk = F.xxhash64(text)
    start = F.pmod(rk, F.greatest(F.length(text) - WINDOW, F.lit(1))).cast("int") + 1
    windows = (docs.where(text.isNotNull()).select(rk.alias("rk"), F.substring(text, start, F.lit(WINDOW)).alias("window"))
                   .groupBy("rk").agg(F.min("window").alias("window")).orderBy("rk").limit(CONTEXTS))

    def plant(number: int, made: tuple) -> Column:
        gen, label, leads, values = made
        pick = lambda tag, items: F.get(F.array(*items), F.pmod(
            F.xxhash64(F.col("rk"), F.lit(f"{tag}{number}")), F.lit(len(items))).cast("int"))
        return F.struct(F.lit(gen).alias("plant"), F.lit(label).alias("label"), pick("lead", [F.lit(x) for x in leads]).alias("lead"),
                        pick("value", values).alias("value"))
    plants = F.array(*[plant(k, m) for k, m in enumerate(_made(F.col("rk").cast("string")))])
    head = F.concat(F.substring("window", 1, WINDOW // 2), F.lit(" "), F.col("lead"))
    tail = F.concat(F.when(F.col("lead").rlike("[\"']$"), F.right("lead", F.lit(1))).otherwise(F.lit("")), F.lit(" "),
                    F.substring("window", WINDOW // 2 + 1, WINDOW))
    rows = windows.select("rk", "window", F.inline(plants)).select(
        F.pmod("rk", F.lit(4)).alias("fold"), "plant", "label", F.length(head).alias("at"), F.length("value").alias("size"),
        candidates(F.concat(head, F.col("value"), tail)).alias("cands"))
    c = rows.select("fold", "plant", "label", "at", "size", F.inline("cands")).where("gen = plant")
    whole = (F.col("start") == F.col("at")) & (F.col("stop") == F.col("at") + F.col("size"))
    part = (F.col("start") < F.col("at") + F.col("size")) & (F.col("stop") > F.col("at"))
    return c.where(whole | part & (F.col("label") == 0)).select("fold", "label", *FEATURES)


# ---------------------------------------------------------------- boosted trees

def boost(x: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> tuple[float, list]:
    """Trees of depth two for weighted feature rows: (first score, [(feature, edge, (left), (right))])."""
    first = math.log((pos.sum() + 1) / (neg.sum() + 1))
    score, trees = np.full(len(x), first), []
    splits = [(f, e) for f in range(x.shape[1]) for e in np.unique(x[:, f])[:-1].tolist()]
    sides = [x[:, f] <= e for f, e in splits]

    def leaf(grad, hess):
        return RATE * grad / (hess + 1.0)

    def gain(grad, hess):
        return grad * grad / (hess + 1.0)

    def best(rows, grad, hess):
        """The best split of some rows, or None."""
        g, h = grad[rows].sum(), hess[rows].sum()
        found = None
        for k, side in enumerate(sides):
            gl, hl = grad[rows & side].sum(), hess[rows & side].sum()
            got = gain(gl, hl) + gain(g - gl, h - hl) - gain(g, h)
            if got > 1e-6 and (found is None or got > found[0] + 1e-12):
                found = (got, k)
        return found

    def branch(rows, grad, hess):
        found = best(rows, grad, hess)
        if found is None:
            v = leaf(grad[rows].sum(), hess[rows].sum())
            return None, v, v, np.full(len(x), v)
        side = sides[found[1]]
        left, right = (leaf(grad[rows & s].sum(), hess[rows & s].sum()) for s in (side, ~side))
        return splits[found[1]], left, right, np.where(side, left, right)

    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-score))
        grad, hess = pos - (pos + neg) * p, (pos + neg) * p * (1 - p)
        everything = np.ones(len(x), bool)
        top = best(everything, grad, hess)
        if top is None:
            break
        side = sides[top[1]]
        l_split, ll, lr, lv = branch(side, grad, hess)
        r_split, rl, rr, rv = branch(~side, grad, hess)
        trees.append((splits[top[1]], (l_split, ll, lr), (r_split, rl, rr)))
        score = score + np.where(side, lv, rv)
    return first, trees


def score_rows(model, x: np.ndarray) -> np.ndarray:
    first, trees = model
    score = np.full(len(x), first)

    def side(part):
        split, left, right = part
        return np.where(x[:, split[0]] <= split[1], left, right) if split else np.full(len(x), left)
    for (f, e), left, right in trees:
        score += np.where(x[:, f] <= e, side(left), side(right))
    return score


def score_column(model, c: Column) -> Column:
    """The trees as CASE expressions over a candidate's features."""
    first, trees = model

    def side(part):
        split, left, right = part
        return F.when(c[FEATURES[split[0]]] <= split[1], F.lit(float(left))).otherwise(F.lit(float(right))) if split \
            else F.lit(float(left))
    score = F.lit(float(first))
    for (f, e), left, right in trees:
        score = score + F.when(c[FEATURES[f]] <= e, side(left)).otherwise(side(right))
    return score


def fit(labelled: DataFrame) -> tuple[tuple, list[float]]:
    """Trees and a threshold per generator from labelled candidates (columns fold, label and the features)."""
    seeds = (labelled.groupBy((F.col("fold") == 0).alias("held"), *FEATURES)
                     .agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg")).collect())
    # rows: at most 2 * the product of the bins
    x = np.array([[r[f] for f in FEATURES] for r in seeds], float).reshape(-1, len(FEATURES))
    pos, neg = (np.array([r[k] for r in seeds], float) for k in ("pos", "neg"))
    held = np.array([r["held"] for r in seeds], bool)
    order = np.lexsort((*x.T, held))
    x, pos, neg, held = x[order], pos[order], neg[order], held[order]
    model = boost(x[~held], pos[~held], neg[~held]) if (~held).any() else (0.0, [])
    score, limits = score_rows(model, x), []
    for g in range(len(GENERATORS)):
        mine = held & (x[:, 0] == g)
        limit = float("inf")
        for s in sorted(set(score[mine].round(9).tolist()), reverse=True):
            above = mine & (score >= s - 1e-9)
            if s > 0 and pos[above].sum() and pos[above].sum() >= PRECISION * (pos[above] + neg[above]).sum():
                limit = s - 1e-6
        limits.append(limit)
    return model, limits


def all_spans(base: Column, cands: Column, model, limits: list[float]) -> Column:
    """Base spans and the accepted candidates, sorted by start, kind and stop."""
    def limit_of(c: Column) -> Column:
        out = F.lit(float("inf"))
        for g, v in enumerate(limits):
            if not math.isinf(v):
                out = F.when(c["gen"] == g, F.lit(v)).otherwise(out)
        return out

    meets = lambda a, b: (a["start"] < b["stop"]) & (b["start"] < a["stop"])
    scored = F.transform(cands, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["stop"].alias("stop"),
                                                   score_column(model, c).alias("score"), limit_of(c).alias("limit")))
    good = F.filter(scored, lambda c: (c["score"] >= c["limit"]) & ~F.exists(base, lambda b: meets(b, c)))
    wins = lambda a, b: (a["score"] > b["score"]) | (a["score"] == b["score"]) & (
        (a["start"] < b["start"]) | (a["start"] == b["start"]) & (a["kind"] < b["kind"]))
    alone = bound(good, lambda g: F.filter(g, lambda c: ~F.exists(g, lambda o: meets(o, c) & wins(o, c))))
    plain = F.transform(alone, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["stop"].alias("stop")))
    return in_order(F.concat(base, plain))


def in_order(spans: Column) -> Column:
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"),
                                                               s["stop"].alias("stop"))))
    return F.transform(keyed, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))


def as_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"),
                                                                 s["stop"].cast("string"))), ",")


# ---------------------------------------------------------------- operators

def searched(docs: DataFrame, id_col: str, text_col: str, carry: list[str]) -> DataFrame:
    """rk, the carried columns, base spans and candidates of every row, stored: one pass over the texts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("rk"), F.struct(*carry).alias("row"),
                       base_spans(text).alias("base"), candidates(text).alias("cands"))
    return stored(rows, "spans")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, base, spans`` per document; spans are structs (kind number, start, stop)."""
    rows = searched(docs, id_col, text_col, [id_col])
    model, limits = fit(planted(docs, text_col))
    return rows.select(F.col(f"row.{id_col}").alias("id"), in_order(F.col("base")).alias("base"),
                       all_spans(F.col("base"), F.col("cands"), model, limits).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span of the text replaced by its kind in brackets; overlapping spans are
    one gap under the first one's name. Null texts stay null."""
    rows = searched(docs, id_col, text_col, docs.columns)
    model, limits = fit(planted(docs, text_col))
    spans = fresh(docs, "_spans")
    # in two steps: the carried columns may have the names of the working ones
    d = rows.select("row", all_spans(F.col("base"), F.col("cands"), model, limits).alias(spans)).select("row.*", spans)
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def replaced(text: Column) -> Column:
        # stops sorted alongside starts: a gap ends where no open span is left
        def parts(s: Column) -> Column:
            far = lambda i: F.when(i > 0, F.aggregate(F.slice(s, F.lit(1), i), F.lit(0),
                                                      lambda a, o: F.greatest(a, o["stop"]))).otherwise(F.lit(0))
            return F.transform(s, lambda o, i: bound(far(i), lambda f: F.when(
                o["start"] >= f, F.concat(F.substring(text, f + 1, o["start"] - f), F.get(names, o["kind"]))
            ).otherwise(F.lit(""))))
        last = F.aggregate(F.col(spans), F.lit(0), lambda a, o: F.greatest(a, o["stop"]))
        return F.concat(F.array_join(parts(F.col(spans)), ""), F.substring(text, last + 1, F.length(text)))

    return d.withColumn(text_col, F.when(F.size(spans) > 0, replaced(F.col(text_col))).otherwise(F.col(text_col))).drop(spans)


def op9_personal_data(spark, sf_dir: str) -> DataFrame:
    from spanweave.llm.common import table
    found = find(table(spark, sf_dir, "documents"))

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")

    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:4])]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(as_text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        as_text(F.col("spans")).alias("spans"))
