"""Operator 12: secrets as character spans, tagged by a linear-chain conditional random field.

Base spans: assignments, access keys and hex strings by fixed patterns, leftmost and not overlapping
within a kind; matches that are too short go without a second try. They always stay.

Method: a text's tokens (runs of letters and digits, single punctuation characters) are tagged as begin,
inside or outside of a secret. Features are a token's shape (length, kinds of characters, changes
between them, hex), its word, the words and signs around it, and its file (share of signs, how often
words such as "password" occur). The field is trained in numpy on texts with planted
secrets: windows of ``SAMPLE`` corpus texts at most, base spans cut out, into which generated values in many
formats and settings are written at known places, and lookalikes that are none. So the labels
come from the planting, not from a rule over the features. Planted texts held out settle the margin by
which a span's path must win over outside (precision ``PRECISION``).

Decoding is Viterbi over every whole text. A token whose weight for outside exceeds every other tag by
more than any transition can win back is outside in every best path; the chain is exactly split at
these, and the pieces between them are decoded side by side. Tagged spans of ``LEAST`` characters or more that
meet no base span are added as kind ``secret``.

Defined cases: null text is empty (no spans); null ids are carried along; repeated rows are searched alike; ties
between paths go to the earlier tag of O, B, I; extra columns are ignored; an empty table gives no rows, and
with no text to sample the field is trained on planted lines alone.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from spanweave.llm.common import hash_words, slices, table, text_bytes

KINDS = ("assign", "access", "hex", "secret")
#: The base patterns. Hex and access runs are found at their least length at once: a shorter run
#: holds no match, and a longer one is the same match.
ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
HEX = re.compile(rb"[0-9a-f]{24,}")
ASSIGNED = 6

SAMPLE = 600
WINDOW = 1200
PLANTED = 1400
SEED = 12
STEPS = 70
PRECISION = 0.99
LEAST = 8
WORD_BINS = 4096
O, B, I = 0, 1, 2

#: Kinds of bytes: 0 space and control, 1 sign, 2 digit, 3 lower case, 4 upper case, 5 other.
_KIND = np.full(256, 5, np.int8)
_KIND[:0x80] = 1
_KIND[:0x21] = 0
_KIND[0x7F] = 0
_KIND[0x30:0x3A], _KIND[0x61:0x7B], _KIND[0x41:0x5B] = 2, 3, 4
_HEX = np.zeros(256, bool)
_HEX[[*range(0x30, 0x3A), *range(0x61, 0x67), *range(0x41, 0x47)]] = True
_LENGTHS = np.array([2, 3, 5, 8, 12, 16, 20, 28, 40, 64])
_CHANGES = np.array([1, 2, 4, 7, 11])

#: Words that name secrets, and settings in which a value stands.
NAMES = ["password", "passwd", "pwd", "pass", "passphrase", "secret", "client_secret", "token", "access_token", "auth_token",
         "key", "api_key", "apikey", "private_key", "secret_key", "credential", "credentials", "login", "pin", "passcode"]
SETTINGS = ["{n} = \"{v}\"", "{n}: {v}", "{n}={v}", "\"{n}\": \"{v}\"", "export {N}={v}", "--{n} {v}", "the {n} is {v}", "my {n}: '{v}'",
            "Authorization: Bearer {v}", "https://user:{v}@host.example", "<{n}>{v}</{n}>", "{N} {v}", "use {n} {v} to log in",
            "Authorization: Basic {v}", "{n} -> {v}", "x-{n}: {v}", "{v}", "{n} := `{v}`"]
PREFIXES = ["ghp_", "sk-", "xoxb-", "glpat-", "AIza", "npm_", "pk_live_", "rk_", "ya29.", "hf_"]
LOOKALIKES = ["the {n} is required", "forgot your {n}?", "a {n} of gratitude", "{n} ring", "version: {d}.{d}.{d}", "id: {d}{d}{d}{d}{d}",
              "date: 20{d}{d}-0{d}-1{d}", "https://www.example.org/{w}/{w}-{w}.html", "{w}.{w}@example.com", "+{d}{d} {d}{d}{d} {d}{d}{d} {d}{d}{d}{d}",
              "{w}_{w}_{w}", "/usr/{w}/{w}.py", "{W}{w}{W}{w}", "{w}={w}", "{w}: \"{w}\"", "{n}: none", "{n}=", "order no. {d}{d}{d}{d}{d}{d}{d}{d}{d}",
              "{W}-{W}-{W}", "{d}{d}.{d}{d}.{d}{d}.{d}{d}", "{d}{d}{d}{d} {d}{d}{d}{d} {d}{d}{d}{d} {d}{d}{d}{d}", "|{w}|{w}|{d}{d}|", "{w}{w}{w}{w}{w}"]
_NAMED = sorted({w for n in NAMES for w in n.split("_")} - {"access", "client", "private", "api"})


# ---------------------------------------------------------------- tokens and features

class Tokens:
    """Tokens of some texts: byte places, row, whether nothing stands before it on the same run, features."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        kind = _KIND[data]
        group = np.minimum(kind, 2)
        opens = np.ones(len(data), bool)
        opens[1:] = (group[1:] != group[:-1]) | (group[1:] == 1)
        opens[offsets[offsets < len(data)]] = True
        marks = np.flatnonzero(opens)
        ends = np.append(marks[1:], len(data))
        some = group[marks] > 0
        self.start, self.end = marks[some], ends[some]
        self.cut = np.searchsorted(self.start, offsets)
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(self.cut))
        n = len(self.start)
        self.first = np.zeros(n, bool)
        self.first[self.cut[:-1][np.diff(self.cut) > 0]] = True
        self.glued = np.zeros(n, bool)
        self.glued[1:] = (self.start[1:] == self.end[:-1]) & ~self.first[1:]
        self.features = self._features(data, kind, group) if n else []

    def _features(self, data, kind, group):
        start, end, n = self.start, self.end, len(self.start)
        sign = group[start] == 1
        length = np.digitize(end - start, _LENGTHS)

        def total(flag):
            run = np.zeros(len(data) + 1, np.int32)
            np.cumsum(flag, out=run[1:])
            return run[end] - run[start]

        has = [total(kind == k) > 0 for k in (2, 3, 4, 5)]
        kinds = has[0] + 2 * has[1] + 4 * has[2] + 8 * has[3]
        change = np.zeros(len(data), bool)
        change[1:] = kind[1:] != kind[:-1]
        run = np.zeros(len(data) + 1, np.int32)
        np.cumsum(change, out=run[1:])
        changes = np.digitize(run[end] - run[np.minimum(start + 1, end)], _CHANGES)
        hexed = total(~_HEX[data]) == 0
        h = hash_words(data, start, end)
        # words are plain and not long; a random value is told by its shape alone
        plain = ~sign & ~has[0] & (end - start <= 14)
        word = np.where(plain, 1 + (h % np.uint64(WORD_BINS - 1)).astype(np.int64), 0)
        char = np.where(sign, data[start].astype(np.int64), 128)
        named = np.isin(h, _named_hashes())

        def beside(values, by, none):
            out = np.full(n, none, np.int64)
            if by < 0:
                out[-by:] = np.where(self.row[-by:] == self.row[:by], values[:by], none)
            else:
                out[:-by] = np.where(self.row[:-by] == self.row[by:], values[by:], none)
            return out

        # the nearest words before, signs passed over
        place = np.maximum.accumulate(np.where(~sign, np.arange(n), -1))
        before = np.concatenate([[-1], place[:-1]])[:n]
        before[(before >= 0) & (self.row[np.maximum(before, 0)] != self.row)] = -1
        second = np.where(before >= 0, before - 1, -1)
        second = np.where(second >= 0, place[np.maximum(second, 0)], -1)
        second[(second >= 0) & (self.row[np.maximum(second, 0)] != self.row)] = -1
        near = np.where(before >= 0, word[before], 0)
        near2 = np.where(second >= 0, word[second], 0)
        distance = np.minimum(np.arange(n) - np.where(before >= 0, before, np.arange(n)), 6)

        rows = len(self.cut) - 1
        size = np.maximum(1, np.diff(self.cut))
        signs = np.digitize(np.bincount(self.row[sign], minlength=rows) / size, [.05, .15, .3, .5])[self.row]
        names = np.digitize(np.bincount(self.row[named], minlength=rows) / size, [1e-9, .01, .05])[self.row]
        shape = ((length * 16 + kinds) * 6 + changes) * 2 + hexed
        shape = np.where(sign, 0, 1 + shape)
        return [(shape, 1 + 11 * 16 * 6 * 2), (length * 2 + self.glued, 22), (kinds * 6 + changes, 96), (word, WORD_BINS), (near, WORD_BINS),
                (near2, WORD_BINS), (char, 129), (beside(char, -1, 129), 130), (beside(char, -2, 129) * 2 + self.glued, 260), (beside(char, 1, 129), 130),
                (beside(word, 1, 0), WORD_BINS), (beside(shape, -1, 0), 1 + 11 * 16 * 6 * 2), (distance * 11 + length, 77),
                (signs * 11 + length, 55), (names * 11 + length, 44)]


@cache
def _named_hashes() -> np.ndarray:
    raw = "".join(_NAMED).encode()
    end = np.cumsum([len(w) for w in _NAMED])
    return hash_words(np.frombuffer(raw, np.uint8), np.append(0, end[:-1]), end)


# ---------------------------------------------------------------- the field

class Field:
    """Weights: a table per feature (value x tag), transitions, and those of a text's first tag."""

    def __init__(self, sizes: list[int]):
        self.tables = [np.zeros((s, 3)) for s in sizes]
        self.step, self.begin, self.margin = np.zeros((3, 3)), np.zeros(3), 0.0

    def emissions(self, features) -> np.ndarray:
        out = np.zeros((len(features[0][0]) if features else 0, 3))
        for (values, _), weights in zip(features, self.tables):
            out += weights[values]
        return out

    def spans(self, tokens: Tokens):
        """(row, start, stop, margin): byte places of tagged runs, and by how much the path wins over outside there."""
        e = self.emissions(tokens.features)
        tags = self.decode(tokens, e)
        inside = tags != O
        if not inside.any():
            return (np.zeros(0, np.int64),) * 3 + (np.zeros(0),)
        goes_on = np.zeros(len(tags), bool)
        goes_on[1:] = (tags[1:] == I) & inside[:-1] & tokens.glued[1:]
        heads = np.flatnonzero(inside & ~goes_on)
        tails = np.flatnonzero(inside & ~np.append(goes_on[1:], False))
        gain = np.append(0.0, np.cumsum(np.where(inside, e[np.arange(len(e)), tags] - e[:, O], 0.0)))
        stay, out = self.step[O, O], np.append(self.step[:, O] - self.step[O, O], 0.0)
        move = np.append(0.0, np.cumsum(np.where(goes_on, self.step[np.append(O, tags[:-1]), tags] - stay, 0.0)))
        win = gain[tails + 1] - gain[heads] + move[tails + 1] - move[heads + 1] + self.step[O, tags[heads]] - stay + out[tags[tails]]
        start, stop = tokens.start[heads], tokens.end[tails]
        good = (stop - start >= LEAST) & (win >= self.margin)
        return tokens.row[heads][good], start[good], stop[good], win[good]

    def decode(self, tokens: Tokens, e: np.ndarray) -> np.ndarray:
        """The tags of the best path of every text."""
        tags = np.zeros(len(e), np.int8)
        if not len(e):
            return tags
        sure = np.ones(len(e), bool)
        for y in (B, I):
            enter = max((self.step[:, y] - self.step[:, O]).max(), self.begin[y] - self.begin[O])
            leave = max((self.step[y] - self.step[O]).max(), 0.0)
            sure &= e[:, O] - e[:, y] > enter + leave + 1e-9
        open_ = np.flatnonzero(~sure)
        if not len(open_):
            return tags
        heads = np.ones(len(open_), bool)
        heads[1:] = (np.diff(open_) > 1) | tokens.first[open_[1:]]
        at = np.flatnonzero(heads)
        size = np.diff(np.append(at, len(open_)))
        start = open_[at]
        stop = start + size
        last = np.append(tokens.first[1:], True)[stop - 1]
        _viterbi(e, start, size, tokens.first[start], last, self.step, self.begin, tags)
        return tags


def _viterbi(e, start, size, first, last, step, begin, tags):
    """Best paths of runs of tokens; outside stands before and after a run, or the text's edge does."""
    order = np.argsort(-size, kind="stable")
    start, size, first, last = start[order], size[order], first[order], last[order]
    score = np.where(first[:, None], begin, step[O]) + e[start]
    live = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")  # runs of at least 1, 2, ... tokens
    back = []
    for t in range(1, size[0]):
        k = live[t]
        path = score[:k, :, None] + step
        back.append(path.argmax(axis=1).astype(np.int8))
        score[:k] = path.max(axis=1) + e[start[:k] + t]
    tag = (score + np.where(last[:, None], 0.0, step[:, O])).argmax(axis=1)
    for t in range(size[0] - 1, -1, -1):
        k = live[t]
        tags[start[:k] + t] = tag[:k]
        if t:
            tag[:k] = np.take_along_axis(back[t - 1], tag[:k, None], 1)[:, 0]


def train(tokens: Tokens, tags: np.ndarray, steps: int = STEPS, rate: float = 0.3, shrink: float = 2e-3) -> Field:
    """Maximum likelihood with shrinkage by Adam; forward and backward run over all texts at once."""
    field = Field([s for _, s in tokens.features])
    n = np.diff(tokens.cut)
    rows = np.flatnonzero(n)
    rows = rows[np.argsort(-n[rows], kind="stable")]
    start, n = tokens.cut[:-1][rows], n[rows]
    live = np.searchsorted(-n, -np.arange(1, n[0] + 1), side="right")
    gold = np.eye(3)[tags]
    gold_step = np.zeros((3, 3))
    inner = ~tokens.first
    np.add.at(gold_step, (tags[np.flatnonzero(inner) - 1], tags[inner]), 1)
    gold_begin = gold[tokens.first].sum(axis=0)
    weights = [*field.tables, field.step, field.begin]
    m, v = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]

    def logsum(x, axis):
        top = x.max(axis=axis, keepdims=True)
        return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)

    for turn in range(1, steps + 1):
        e = field.emissions(tokens.features)
        ahead, behind = np.zeros_like(e), np.zeros_like(e)
        a = field.begin + e[start]
        ahead[start] = a
        for t in range(1, n[0]):
            k = live[t]
            a = logsum(a[:k, :, None] + field.step, 1) + e[start[:k] + t]
            ahead[start[:k] + t] = a
        total = logsum(ahead[start + n - 1], 1)
        b, expected = np.zeros((len(n), 3)), np.zeros((3, 3))
        for t in range(n[0] - 1, 0, -1):
            k = live[t]
            here = start[:k] + t
            late = b[:k] + e[here]
            expected += np.exp(ahead[here - 1][:, :, None] + field.step + late[:, None, :] - total[:k, None, None]).sum(axis=0)
            b[:k] = logsum(field.step + late[:, None, :], 2)
            behind[here - 1] = b[:k]
        share = np.exp(ahead + behind - np.repeat(total[np.argsort(rows)], n[np.argsort(rows)])[:, None])
        gap = gold - share
        slopes = [np.stack([np.bincount(values, gap[:, y], minlength=size) for y in range(3)], axis=1) for values, size in tokens.features]
        slopes += [gold_step - expected, gold_begin - share[tokens.first].sum(axis=0)]
        for w, slope, first, second in zip(weights, slopes, m, v):
            slope = slope - shrink * len(e) ** 0.5 * w
            first += 0.1 * (slope - first)
            second += 0.01 * (slope ** 2 - second)
            w += rate * (first / (1 - 0.9 ** turn)) / (np.sqrt(second / (1 - 0.99 ** turn)) + 1e-8)
    return field


# ---------------------------------------------------------------- planted texts

def _value(rng: np.random.Generator) -> str:
    def pick(alphabet: str, n: int) -> str:
        return "".join(alphabet[k] for k in rng.integers(0, len(alphabet), n))
    low, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    mixed, hexed = low + low.upper() + digits, digits + "abcdef"
    form = int(rng.integers(0, 9))
    if form == 0:
        return pick(mixed, int(rng.integers(14, 44)))
    if form == 1:
        return pick(mixed + "+/", int(rng.integers(20, 60))) + "=" * int(rng.integers(0, 3))
    if form == 2:
        return pick(hexed if rng.random() < .5 else hexed.upper(), int(rng.choice([16, 20, 32, 40, 64])))
    if form == 3:
        return "-".join(pick(hexed, n) for n in (8, 4, 4, 4, 12))
    if form == 4:
        return PREFIXES[int(rng.integers(0, len(PREFIXES)))] + pick(mixed + "_", int(rng.integers(16, 40)))
    if form == 5:
        return pick(low, int(rng.integers(3, 7))).capitalize() + pick(digits, int(rng.integers(1, 4))) + pick("!@#$%&*", 1) + pick(mixed, int(rng.integers(2, 6)))
    if form == 6:
        return ".".join(pick(mixed + "_-", n) for n in (18, 30, 22))
    if form == 7:
        return pick(low.upper() + digits, int(rng.integers(12, 24)))
    return pick(low, int(rng.integers(2, 6))) + pick("@#$%^&*", 1) + pick(digits, int(rng.integers(2, 5))) + pick(low, int(rng.integers(2, 5)))


def plant(background: list[str], count: int, seed: int = SEED) -> tuple[list[bytes], list[list[tuple[int, int]]]]:
    """Texts with planted secrets and lookalikes, and the byte spans of the secrets."""
    rng = np.random.default_rng(seed)
    low = "abcdefghijklmnopqrstuvwxyz"

    def word() -> str:
        return "".join(low[k] for k in rng.integers(0, 26, int(rng.integers(3, 9))))

    texts, spans = [], []
    for _ in range(count):
        base = ""
        if background and rng.random() < .9:
            base = background[int(rng.integers(0, len(background)))]
            lo = int(rng.integers(0, max(1, len(base) - 300)))
            base = base[lo:lo + int(rng.integers(60, 500))]
        out, found = "", []
        for part in re.split(r"(?<=\s)", base) if rng.random() < .5 else [base[:len(base) // 2], base[len(base) // 2:]]:
            out += part
            if rng.random() > (2 / (1 + len(base.split())) if len(part) < 40 else .8):
                continue
            name = NAMES[int(rng.integers(0, len(NAMES)))]
            if rng.random() < .5:
                value = _value(rng)
                # a bare short value is no evidence of a secret
                setting = SETTINGS[int(rng.integers(0, len(SETTINGS)))] if len(value) >= 20 else SETTINGS[int(rng.integers(0, 8))]
                head, tail = setting.format(n=name, N=name.upper(), v="\0").split("\0")
                out += "\n" if rng.random() < .3 else " "
                out += head
                at = len(out.encode())
                found.append((at, at + len(value)))
                out += value + tail
            else:
                like = LOOKALIKES[int(rng.integers(0, len(LOOKALIKES)))]
                out += " " + re.sub(r"\{(.)\}", lambda m: {"n": lambda: name, "d": lambda: str(int(rng.integers(0, 10))), "w": word,
                                                           "W": lambda: word().capitalize()}[m[1]](), like)
            out += "\n" if rng.random() < .3 else " "
        texts.append(out.encode())
        spans.append(found)
    return texts, spans


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64)


def _tags(tokens: Tokens, offsets: np.ndarray, spans: list[list[tuple[int, int]]]) -> np.ndarray:
    tags = np.zeros(len(tokens.start), np.int8)
    for r, found in enumerate(spans):
        for lo, hi in found:
            a, b = np.searchsorted(tokens.start, [offsets[r] + lo, offsets[r] + hi])
            tags[a:b] = I
            tags[a:a + 1] = B
    return tags


def fitted(background: list[str], seed: int = SEED, count: int = PLANTED) -> Field:
    """The field trained on planted texts, with the margin that texts held out call for."""
    clean = [HEX.sub(b" ", ACCESS.sub(b" ", ASSIGN.sub(b" ", t.encode()))).decode() for t in background]
    half = len(clean) * 3 // 4
    texts, spans = plant(clean[:half] or clean, count, seed)
    data, offsets = _joined(texts)
    tokens = Tokens(data, offsets)
    field = train(tokens, _tags(tokens, offsets, spans))
    texts, spans = plant(clean[half:], count // 2, seed + 1)
    data, offsets = _joined(texts)
    tokens = Tokens(data, offsets)
    gold = [np.array([(offsets[r] + lo, offsets[r] + hi) for lo, hi in found], np.int64).reshape(-1, 2) for r, found in enumerate(spans)]
    gold = np.concatenate(gold) if gold else np.zeros((0, 2), np.int64)
    _, start, stop, win = field.spans(tokens)
    # right: within a planted value
    k = np.searchsorted(gold[:, 0], start, side="right") - 1
    right = (k >= 0) & (stop <= gold[np.maximum(k, 0), 1]) if len(gold) else np.zeros(len(start), bool)
    order = np.argsort(-win, kind="stable")
    share = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    enough = np.flatnonzero(share >= PRECISION)
    field.margin = float(win[order][enough[-1]]) if len(enough) else float("inf")
    return field


# ---------------------------------------------------------------- operator

def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, stop) in bytes of the base kinds, sorted."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= ASSIGNED]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def background(docs: DataFrame, text_col: str) -> list[str]:
    """Windows of at most ``SAMPLE`` distinct texts, chosen and placed by hash."""
    texts = docs.select(F.col(text_col).alias("text")).where("length(text) > 0")
    h = F.xxhash64("text")
    part = max(1, texts.count() // (4 * SAMPLE))
    at = F.pmod(F.xxhash64("text", F.lit(1)), F.greatest(F.lit(1), F.length("text") - WINDOW)).cast("int") + 1
    picked = texts.where(F.pmod(h, F.lit(part)) == 0).select(h.alias("h"), F.substring("text", at, F.lit(WINDOW)).alias("text"))
    return [r["text"] for r in picked.distinct().orderBy("h", "text").limit(SAMPLE).collect()]


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, base, spans`` per document: arrays of structs (kind, start, stop) in code points, by start and kind."""
    field = fitted(background(docs, text_col))

    def run(batches):
        for batch in slices(batches):
            data, offsets = text_bytes(batch.column(1))
            tokens = Tokens(data, offsets)
            row, start, stop, _ = field.spans(tokens)
            cut = np.searchsorted(row, np.arange(batch.num_rows + 1))
            base_out, all_out = [], []
            for r in range(batch.num_rows):
                lo, hi = offsets[r], offsets[r + 1]
                base = base_spans(data[lo:hi].tobytes())
                more = [(s, len(KINDS) - 1, e) for s, e in zip((start[cut[r]:cut[r + 1]] - lo).tolist(), (stop[cut[r]:cut[r + 1]] - lo).tolist())]
                if base or more:
                    # code points before a byte: bytes that go on a character do not count
                    points = np.append(0, np.cumsum((data[lo:hi] & 0xC0) != 0x80))
                    reach, k, kept = 0, 0, []
                    for s, kind, e in more:
                        while k < len(base) and base[k][0] < e:
                            reach, k = max(reach, base[k][2]), k + 1
                        if reach <= s:
                            kept.append((s, kind, e))
                    base, more = ([{"kind": KINDS[kind], "start": int(points[s]), "stop": int(points[e])} for s, kind, e in x]
                                  for x in (base, sorted(base + kept)))
                base_out.append(base)
                all_out.append(more)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base_out, arrow), pa.array(all_out, arrow)], names=["id", "base", "spans"])

    span = "array<struct<kind:string,start:bigint,stop:bigint>>"
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, base {span}, spans {span}")


def as_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op12_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [count(kind) for kind in KINDS[:3]]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(as_text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        as_text(F.col("spans")).alias("spans"))
