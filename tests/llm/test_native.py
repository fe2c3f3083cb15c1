"""Decontamination and personal data: brute force, edge rows, and no Python on the executors."""

import hashlib
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from spanweave.llm import decontamination, pii
from tests.llm.data import edge, empty, prose

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def no_python(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return not re.search("Python|Pandas|Arrow", plan)


def test_decontamination_matches_brute_force(spark):
    rng = random.Random(4)
    items = [prose(n, 100 + n) for n in (6, 14, 25, 40, 59)] + ["just three words", "", None]
    docs = []
    for k in range(120):
        text = prose(rng.randrange(5, 200), k).split()
        if k % 2:
            part = (items[k % 6]).split()
            for _ in range(k % 5):
                part[rng.randrange(len(part))] = "changed"
            at = rng.randrange(len(text))
            text[at:at] = part
        docs.append((k, " ".join(text).upper() if k % 3 else ", ".join(text)))
    docs += [(120, None), (121, ""), (122, items[3]), (122, items[3])]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    b = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    from collections import Counter

    def shingle(w):
        return Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)])
    want = {}
    for i, text in docs:
        w = re.findall(r"\w+", (text or "").lower())
        for j, item in enumerate(items):
            v = re.findall(r"\w+", (item or "").lower())
            for p in range(max(1, len(w) - len(v) + 1) if v and w else 0):
                x, y = shingle(w[p:p + len(v)]), shingle(v)
                both = sum((x & y).values())
                s = both / (sum(x.values()) + sum(y.values()) - both)
                if s >= 0.8 and s > want.get((i, j), (0,))[0]:
                    want[i, j] = (s, p)
    found = decontamination.contaminated(d, b)
    got = {(r["id"], r["item"]): (r["similarity"], r["start"]) for r in found.collect()}
    assert got == want and len(want) > 10   # the earliest of equally similar windows
    assert no_python(found)
    left = {r["doc_id"] for r in decontamination.drop_contaminated(d, b).collect()}
    assert left == {i for i, _ in docs} - {i for i, _ in want}


def test_decontamination_finds_windows_with_repeated_shingles(spark):
    from collections import Counter
    items, docs, want = [], [], {}
    for k in range(12):
        n, run, word = ((200, 17, "0"), (500, 51, "xxx"))[k % 2]
        item = prose(n, 900 + k, 5000).split()
        window = item[:60] + [word] * run + item[60 + run:]
        if k >= 8:   # the repeats on the item's side
            item, window = window, item
        x, y = (Counter(tuple(w[j:j + 5]) for j in range(n - 4)) for w in (item, window))
        both = sum((x & y).values())
        want[k, k] = both / (2 * (n - 4) - both)
        items.append((k, " ".join(item)))
        docs.append((k, " ".join(window)))
    assert min(want.values()) >= 0.8
    found = decontamination.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"),
                                         spark.createDataFrame(items, "item_id bigint, text string"))
    assert {(r["id"], r["item"]): r["similarity"] for r in found.collect()} == want
    assert no_python(found)


def _best_windows(docs, items):
    """Brute force over all windows: (document, item) -> (similarity, earliest start)."""
    from collections import Counter

    def shingle(w):
        return Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)])
    want = {}
    for i, w in docs:
        for j, v in items:
            y = shingle(v)
            for p in range(max(1, len(w) - len(v) + 1)):
                x = shingle(w[p:p + len(v)])
                both = sum((x & y).values())
                s = both / (sum(x.values()) + sum(y.values()) - both)
                if s >= 0.8 and s > want.get((i, j), (0,))[0]:
                    want[i, j] = (s, p)
    return want


def test_decontamination_finds_moved_parts(spark, monkeypatch):
    rng = random.Random(11)
    items = [(k, prose(n, 40 + k, 3000).split()) for k, n in enumerate((60, 90, 120, 75))]
    items.append((4, items[0][1]))                       # an item of equal words
    items.append((5, items[1][1][:45] + items[2][1][:45]))   # shares a passage with others
    docs = []
    for k in range(48):
        part = list(items[k % 6][1])
        cuts = sorted(rng.sample(range(5, len(part) - 5), 1 + k % 2))
        pieces = [part[a:b] for a, b in zip([0, *cuts], [*cuts, len(part)])]
        rng.shuffle(pieces)                              # swapped halves, moved sentences
        part = [w for piece in (pieces if k % 8 else pieces * 2) for w in piece]
        text = prose(rng.randrange(0, 60), 700 + k).split()
        at = rng.randrange(len(text) + 1)
        docs.append((k, text[:at] + part + text[at:]))
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id bigint, text string")
    b = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id bigint, text string")
    want = _best_windows(docs, items)
    moved = [k for k, (s, _) in want.items() if s < 1]
    assert len(moved) > 10
    for rows in (decontamination.BROADCAST_ROWS, 0):     # sent to tasks, and shuffled
        monkeypatch.setattr(decontamination, "BROADCAST_ROWS", rows)
        found = decontamination.contaminated(d, b)
        assert {(r["id"], r["item"]): (r["similarity"], r["start"]) for r in found.collect()} == want


def test_decontamination_with_items_beyond_the_lanes(spark):
    item = [f"w{k}" for k in range(70_000)]
    doc = ["before"] * 9 + item[35_000:] + item[:35_000] + ["after"] * 9
    docs = spark.createDataFrame([(1, " ".join(doc)), (2, " ".join(item[:40_000]))], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string")
    [row] = decontamination.contaminated(docs, items).collect()
    assert (row["id"], row["start"], row["n_words"]) == (1, 9, 70_000)
    assert row["similarity"] > 0.999 and row["hamming"] <= 2


def test_decontamination_edge_rows(spark):
    b = spark.createDataFrame([(1, "one two"), (2, None)], "item_id bigint, text string")
    got = decontamination.drop_contaminated(edge(spark), b)
    assert got.columns == edge(spark).columns and got.count() == 11
    assert decontamination.drop_contaminated(edge(spark), b.limit(0)).count() == 13
    assert decontamination.contaminated(empty(spark), b).count() == 0


def _luhn(d):
    return sum((int(c) * 2 - 9 * (int(c) > 4) if k % 2 else int(c)) for k, c in enumerate(reversed(d))) % 10 == 0


def plain_spans(text):
    out = []
    for k, kind in enumerate(("email", "ip", "card", "phone")):
        for m in re.finditer(PLAIN[kind], text):
            d = re.sub("[^0-9]", "", m[0])
            if (kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split("."))
                    or kind == "card" and 14 <= len(d) <= 19 and _luhn(d) or kind == "phone" and 10 <= len(d) <= 15):
                out.append((k, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], s[0], s[2]))


def test_base_spans_equal_the_plain_patterns(spark):
    rng = random.Random(9)
    alphabet = "a.@%0159-+() \n😀é"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 120))) for _ in range(400)]
    texts += ["x@y.z@w.v%a@b.c a@b..c", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4 1.2.3", "4539 1488 0343 6467, 4539-1488-0343-6468",
              "+1 (702) 555-0742 +12 +1 702 555 0742 0742 0742", "", "9 " * 4000 + "a@b.co", "1" * 30_000, "+" * 500 + "1234567890"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = df.select("doc_id", pii.in_order(pii.base_spans(F.col("text"))).alias("s"))
    assert no_python(got)
    for r in got.collect():
        assert [tuple(s) for s in r["s"]] == plain_spans(texts[r["doc_id"]]), texts[r["doc_id"]]


def test_seeded_secrets_are_found_and_prose_is_left_alone(spark):
    rows = []
    for k in range(400):
        key = hashlib.sha1(str(k).encode()).hexdigest()
        rows.append((2 * k, f"{prose(20, k)} token = \"{key}\" {prose(9, k + 1)} averyveryverylongwordhere{k % 3 * 'a'}"))
        rows.append((2 * k + 1, prose(40, k + 5) + " pneumonoultramicroscopic"))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = pii.find(df)
    texts = dict(rows)
    for r in found.collect():
        spans = [texts[r["id"]][s["start"]:s["stop"]] for s in r["spans"]]
        assert spans == ([hashlib.sha1(str(r["id"] // 2).encode()).hexdigest()] if r["id"] % 2 == 0 else [])
    clean = pii.redact(df).where("doc_id = 4").first()["text"]
    assert 'token = "[SECRET]"' in clean


def planted_by_hand(n, seed):
    """Texts with one value each, made apart from the labels that the trees learn from: (text, kind or None, start, stop)."""
    rng = random.Random(seed)
    token = lambda k: "".join(rng.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ0123456789") for _ in range(k))
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    kinds = [
        ("secret", lambda: (rng.choice(["token = ", "secret: ", "api key: ", "password="]), "gh" + token(30))),
        ("phone", lambda: (rng.choice(["Tel. ", "phone: ", "call "]), f"0{digits(2)} {digits(4)} {digits(3)}")),
        ("email", lambda: (rng.choice(["mail ", "contact: "]), f"{token(5)}.{token(4)} [at] {token(6)} [dot] net")),
        (None, lambda: (rng.choice(["commit ", "blob ", "at "]), hashlib.sha1(digits(9).encode()).hexdigest())),
        (None, lambda: (rng.choice(["since ", "in ", "on "]), f"{rng.randrange(1900, 2030)}-0{rng.randrange(1, 10)}-{rng.randrange(10, 29)}")),
        (None, lambda: (rng.choice(["the ", "key "]), "inter" * rng.randrange(4, 8) + "nationalization")),
        (None, lambda: (rng.choice(["they ", "all "]), "gathered (at) dusk.4")),
    ]
    for k in range(n):
        kind, make = kinds[k % len(kinds)]
        lead, value = make()
        head = f"{prose(rng.randrange(3, 40), seed + k)} {lead}"
        yield f"{head}{value} {prose(12, seed + k + 1)}", kind, len(head), len(head) + len(value)


def test_planted_spans_are_found_and_lookalikes_left_alone(spark):
    rows = list(planted_by_hand(700, 3))
    df = spark.createDataFrame([(k, r[0]) for k, r in enumerate(rows)], "doc_id bigint, text string")
    assert no_python(pii.planted(df))
    hit, missed, wrong = Counter(), Counter(), 0
    for r in pii.find(df).collect():
        _, kind, start, stop = rows[r["id"]]
        found = [(pii.KINDS[s["kind"]], s["start"], s["stop"]) for s in r["spans"]]
        if kind:
            (hit if (kind, start, stop) in found else missed)[kind] += 1
        wrong += len([s for s in found if s != (kind, start, stop)])
    print("found", dict(hit), "missed", dict(missed), "other spans", wrong)
    assert all(hit[k] >= 0.9 * (hit[k] + missed[k]) for k in ("secret", "phone", "email")) and wrong <= 0.02 * len(rows)


def test_redaction_merges_overlaps_and_keeps_columns(spark):
    df = spark.createDataFrame([(1, "mail a.b@c.de now", 5, "q"), (2, "+4539148803436467 x 10.0.0.1", 6, "q"), (3, None, 7, "q"),
                                (None, "none", 8, "q")], "doc_id bigint, text string, base int, cands string")
    got = {r["doc_id"]: r for r in pii.redact(df).collect()}
    assert got[1]["text"] == "mail [EMAIL] now" and got[1]["base"] == 5 and got[3]["text"] is None
    assert got[2]["text"] == "+[CARD] x [IP]" and got[None]["text"] == "none"


def test_personal_data_edge_rows(spark):
    assert pii.find(edge(spark)).count() == 13 and pii.find(empty(spark)).count() == 0
    assert pii.redact(edge(spark)).columns == edge(spark).columns
