"""Personal data: fixed patterns, and a character-level BiLSTM-CRF that adds spans.

The tagger is a bidirectional LSTM over characters with a linear-chain CRF on top, trained in
numpy from labelled spans (synthetic sentences whose insertions are known).  Every text is
read in overlapping windows.  The windows' emission scores are blended, so that a span
cut by a window border is found once and whole, and one best tag sequence is taken.  A span is
accepted only with a digit, an at-sign, a bracket or a colon inside, so windows go first where
these are, and on from there as far as a possible span goes; the others cannot add any.  Where no run of other tags can gain over "outside", every best sequence has "outside";
such characters cut the text into stretches, which are decoded one by one, long ones in
overlapping windows.
Added spans must fit their kind's format and may not overlap a pattern's span.

Edge cases: a null text is an empty one and has no spans; offsets are code points; texts of
any length take time in proportion, and memory in proportion to the longest text; rows that
repeat, ids included, each get their spans; null ids are kept; an empty table gives an empty
result; other columns, whatever their names, are dropped by ``find`` and kept by ``mask``.
"""

from __future__ import annotations

import hashlib
import io
import ipaddress
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.llm.common import id_type, map_batches, map_slices, shared_dir, texts

#: The kinds in the order of the result.
KINDS = ("email", "ip", "card", "phone")
#: What stands around an at-sign, and the other patterns.  Each is tried once for each stretch
#: of text that it could cover, so that no text takes more than linear time.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
NUMBERS = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
CARD = re.compile(r"[0-9](?:[\x20-]?+[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
MASKS = {k: f"[{k.upper()}]" for k in KINDS}


def luhn(digits: str) -> bool:
    values = [int(d) for d in digits]
    doubled = [d * 2 - 9 * (d > 4) for d in values[-2::-2]]
    return (sum(values[-1::-2]) + sum(doubled)) % 10 == 0


def _digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def emails(text: str):
    """An address is the run of name characters before an at-sign, and a domain with a dot."""
    after, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > after and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (domain := DOMAIN.match(text, at + 1)):
            after = domain.end()
            yield "email", start, after
        at = text.find("@", max(at + 1, after))


def addresses(text: str):
    """Of a chain of numbers joined by dots, each four in turn."""
    for m in NUMBERS.finditer(text):
        parts, at = m[0].split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            size = sum(map(len, four)) + 3
            if all(map(_byte, four)):
                yield "ip", at, at + size
            at += size + 1


def pattern_spans(text: str) -> list[tuple[str, int, int]]:
    """Accepted matches of the patterns, by kind and start."""
    out = [*emails(text), *addresses(text)]
    out += [("card", m.start(), m.end()) for m in CARD.finditer(text) if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


# --- the tagger ---------------------------------------------------------------------------

#: One symbol each for letters, digits and these marks; others fall into four classes.
SYMBOLS = "abcdefghijklmnopqrstuvwxyz0123456789@.-+()_% []:/,\n\"'="
UPPER, LETTER, OTHER, PAD = (len(SYMBOLS) + k for k in range(4))
N_SYMBOLS = len(SYMBOLS) + 4
TAGS = ["O", *(f"{b}-{k}" for k in KINDS for b in "BI")]
EMBED, HIDDEN, TRAINED, WINDOW, STRIDE = 8, 12, 96, 192, 168
#: Bytes of text, windows read at a time.
PIECE, BATCH = 1 << 18, 512
#: Characters of a decoded window that are believed, and those on either side of them that are not.
MIDDLE, MARGIN = 256, 64
_TABLE = np.full(0x250, OTHER, np.int8)
for _i, _c in enumerate(SYMBOLS):
    _TABLE[ord(_c)] = _i
for _c in range(0x250):
    if chr(_c).isalpha() and _TABLE[_c] == OTHER:
        _TABLE[_c] = UPPER if chr(_c).isupper() else LETTER


def symbols(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.where(points < len(_TABLE), _TABLE[np.minimum(points, len(_TABLE) - 1)], LETTER)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Tagger:
    """Parameters of the BiLSTM-CRF and its passes over windows of equal length."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        scale = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"E": scale(N_SYMBOLS, EMBED) * 2, "O": scale(2 * HIDDEN, len(TAGS)), "ob": np.zeros(len(TAGS), np.float32), "T": np.zeros((len(TAGS), len(TAGS)), np.float32)}
        for d in "fb":
            self.p |= {f"W{d}": scale(EMBED + HIDDEN, 4 * HIDDEN), f"b{d}": np.zeros(4 * HIDDEN, np.float32)}
            self.p[f"b{d}"][HIDDEN : 2 * HIDDEN] = 1

    def _lstm(self, x: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        n, length, _ = x.shape
        h = c = np.zeros((n, HIDDEN), np.float32)
        out, saved = np.zeros((n, length, HIDDEN), np.float32), []
        w, b = self.p[f"W{d}"], self.p[f"b{d}"]
        for t in range(length) if d == "f" else range(length - 1, -1, -1):
            z = np.concatenate([x[:, t], h], 1)
            a = z @ w + b
            i, f, o = (_sigmoid(a[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in (0, 1, 2))
            g = np.tanh(a[:, 3 * HIDDEN :])
            before, c = c, f * c + i * g
            th = np.tanh(c)
            h = o * th
            out[:, t] = h
            saved.append((t, z, i, f, o, g, before, th))
        return out, saved

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """Tag scores of every character of windows of symbols (n, length), both directions at once.

        Sigmoids are taken as tanh of half plus one, twice too large; ``c`` is halved for it, and
        the weights that ``h`` meets.  Windows lie along the last axis, so that gates are blocks.
        """
        n, length = x.shape
        half = np.concatenate([np.full(3 * HIDDEN, 0.5, np.float32), np.ones(HIDDEN, np.float32)])
        w = np.stack([np.concatenate([self.p[f"W{d}"][EMBED:] / 2, self.p[f"W{d}"][:EMBED]]).T * half[:, None] for d in "fb"])
        bias = np.stack([self.p[f"b{d}"] * half for d in "fb"])[:, :, None]
        z = np.zeros((2, HIDDEN + EMBED, n), np.float32)
        c, th, new = (np.zeros((2, HIDDEN, n), np.float32) for _ in range(3))
        a, out = np.empty((2, 4 * HIDDEN, n), np.float32), np.empty((2, length, HIDDEN, n), np.float32)
        e = np.ascontiguousarray(self.p["E"][x.T].transpose(0, 2, 1))
        h, gates = z[:, :HIDDEN], a[:, : 3 * HIDDEN]
        for t in range(length):
            z[0, HIDDEN:], z[1, HIDDEN:] = e[t], e[length - 1 - t]
            np.matmul(w, z, out=a)
            a += bias
            np.tanh(a, out=a)
            gates += 1
            c *= gates[:, HIDDEN : 2 * HIDDEN]
            c += np.multiply(gates[:, :HIDDEN], a[:, 3 * HIDDEN :], out=new)
            c *= 0.5
            np.multiply(gates[:, 2 * HIDDEN :], np.tanh(c, out=th), out=h)
            out[0, t], out[1, length - 1 - t] = h
        o = self.p["O"].T / 2
        return (o[:, :HIDDEN] @ out[0] + o[:, HIDDEN:] @ out[1]).transpose(2, 0, 1) + self.p["ob"]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean negative log-likelihood of the tags y, and its gradients."""
        n, length = x.shape
        e = self.p["E"][x]
        (hf, sf), (hb, sb) = self._lstm(e, "f"), self._lstm(e, "b")
        h = np.concatenate([hf, hb], 2)
        u, trans = (h @ self.p["O"] + self.p["ob"]).astype(np.float64), self.p["T"].astype(np.float64)
        lse = lambda a, axis: (m := a.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis))
        alpha, beta = np.zeros_like(u), np.zeros_like(u)
        alpha[:, 0] = u[:, 0]
        for t in range(1, length):
            alpha[:, t] = u[:, t] + lse(alpha[:, t - 1, :, None] + trans, 1)
        for t in range(length - 2, -1, -1):
            beta[:, t] = lse(trans + (u[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        z = lse(alpha[:, -1], 1)
        rows = np.arange(n)[:, None]
        gold = u[rows, np.arange(length), y].sum(1) + trans[y[:, :-1], y[:, 1:]].sum(1)
        du = np.exp(alpha + beta - z[:, None, None])
        du[rows, np.arange(length), y] -= 1
        dt = np.zeros_like(trans)
        for t in range(1, length):
            dt += np.exp(alpha[:, t - 1, :, None] + trans + (u[:, t] + beta[:, t])[:, None, :] - z[:, None, None]).sum(0)
        np.add.at(dt, (y[:, :-1], y[:, 1:]), -1)
        du = (du / n).astype(np.float32)
        g = {"T": (dt / n).astype(np.float32), "O": np.einsum("ntk,ntj->kj", h, du), "ob": du.sum((0, 1)), "E": np.zeros_like(self.p["E"])}
        dh = du @ self.p["O"].T
        de = np.zeros_like(e)
        for d, saved, part in (("f", sf, dh[:, :, :HIDDEN]), ("b", sb, dh[:, :, HIDDEN:])):
            w = self.p[f"W{d}"]
            gw, gb = np.zeros_like(w), np.zeros_like(self.p[f"b{d}"])
            nh = nc = np.zeros((n, HIDDEN), np.float32)
            for t, zt, i, f, o, gg, before, th in reversed(saved):
                dht = part[:, t] + nh
                dc = dht * o * (1 - th**2) + nc
                a = np.concatenate([dc * gg * i * (1 - i), dc * before * f * (1 - f), dht * th * o * (1 - o), dc * i * (1 - gg**2)], 1)
                gw += zt.T @ a
                gb += a.sum(0)
                back = a @ w.T
                de[:, t] += back[:, :EMBED]
                nh, nc = back[:, EMBED:], dc * f
            g |= {f"W{d}": gw, f"b{d}": gb}
        np.add.at(g["E"], x, de)
        return float((z - gold).mean()), g

    def outside(self, u: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where every best tag sequence has tag 0, for texts that begin at ``first``.

        A run of other tags gains at most ``x`` at each of its characters and ``last`` after them
        over tag 0 throughout; where the best run through a character gains less than nothing,
        no best sequence has one there.  Best runs come from differences of running sums.
        """
        t = self.p["T"].astype(np.float64)
        into, x = t.max(0), u[:, 1] + t[:, 1].max()
        for k in range(2, len(TAGS)):
            np.maximum(x, u[:, k] + into[k], out=x)
        x -= u[:, 0] + t[0, 0]
        last = t[1:, 0].max() - t[0, 0]
        begins = np.zeros(len(x), bool)
        begins[first] = True
        place = np.arange(len(x)) + np.cumsum(begins)  # a wall before each text that no run outweighs
        walled = np.full(len(x) + int(begins.sum()), -1.0 - float(np.maximum(x, 0).sum()))
        walled[place] = x

        def ending(x: np.ndarray) -> np.ndarray:
            sums = np.concatenate((np.zeros(1), np.cumsum(x, dtype=np.float64)))
            return sums[1:] - np.minimum.accumulate(sums)[:-1]

        return (ending(walled) + ending(walled[::-1])[::-1] - walled + last < 0)[place]

    def decode(self, u: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The best tags of stretches [start, end) of emission scores, each between characters of tag 0.

        A long stretch is decoded in overlapping windows, each believed in its middle.
        """
        count = -(-(ends - starts) // MIDDLE)
        turn = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        low, high = np.repeat(starts, count), np.repeat(ends, count)
        core = low + turn * MIDDLE
        first, stop = np.maximum(core - MARGIN, low), np.minimum(core + MIDDLE + MARGIN, high)
        open_left, open_right = first > low, stop < high
        tags, into = np.zeros(len(u), np.int8), np.ascontiguousarray(self.p["T"].T)
        order = np.argsort(stop - first, kind="stable")
        for k in range(0, len(order), 256):
            now = order[k : k + 256]
            at, size, rows = first[now], (stop - first)[now], np.arange(len(now))
            steps = int(size[-1])
            score = np.full((len(now), len(TAGS)), -1e30, np.float32)
            score[:, 0] = 0
            score[open_left[now]] = 0
            back = np.empty((steps, len(now), len(TAGS)), np.int8)
            for t in range(steps):
                s = score[:, None, :] + into
                back[t] = s.argmax(2)
                after = s.max(2) + u[np.minimum(at + t, len(u) - 1)]
                score = np.where((t < size)[:, None], after, score)
            tag = (score + self.p["T"][:, 0] * ~open_right[now][:, None]).argmax(1)
            for t in range(steps - 1, -1, -1):
                inside = t < size
                mine = inside & (at + t >= core[now]) & (at + t < core[now] + MIDDLE)
                tags[(at + t)[mine]] = tag[mine]
                tag = np.where(inside, back[t][rows, tag], tag)
        return tags


def labelled_sentence(r: random.Random) -> tuple[str, list[tuple[str, int, int]]]:
    """An invented sentence with inserted personal data, some of it written evasively."""
    syllables = "an er in on the re st ou en tion de la que ie os ge keit ent ment ra el".split()
    accented = "ö ä ü ß é è ê ç ñ ó í á ción über ière ão".split()
    foreign, mark = r.random() < 0.4, r.choice(["###", "$$$", "%%%", "&&&", "***", "!!", "||", "<b>"]) if r.random() < 0.15 else ""
    word = lambda: "".join(r.choice(accented if foreign and r.random() < 0.3 else syllables) for _ in range(r.randint(1, 4)))
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def card() -> str:
        head = digits(15)
        return next(head + c for c in "0123456789" if luhn(head + c))

    def personal(kind: str) -> str:
        if kind == "email":
            at, dot = r.choice([("@", "."), ("@", "."), (" (at) ", " (dot) "), (" [at] ", " [dot] "), ("(at)", "."), (" (at) ", ".")])
            return f"{word()}{r.choice(['.', '_', '', dot])}{digits(r.randint(0, 2))}{at}{r.choice(['mail', word()])}{digits(r.randint(0, 1))}{dot}{r.choice(['example', word()])}{dot}{r.choice(['com', 'org', 'net'])}"
        if kind == "ip":
            parts = [str(r.randint(0, 255)) for _ in range(4)]
            return r.choice([".".join(parts), ".".join(parts), "[.]".join(parts)])
        if kind == "card":
            c = card()
            return r.choice(["", " ", "-", ".", "/"]).join(c[i : i + 4] for i in range(0, 16, 4))
        a, b, c = digits(3), digits(3), digits(4)
        return r.choice([f"+{digits(1)} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{digits(2)} {digits(4)} {digits(7)}"])

    def harmless() -> str:
        return r.choice([word() + ",", word().capitalize() + ".", word() + "\n", f"{r.randint(1, 9)}.0.", str(r.randint(1900, 2030)), digits(r.randint(1, 7)), f'token = "{r.getrandbits(96):024x}"', f"{digits(2)}%", f"{digits(1)}.{digits(2)}", digits(r.randint(18, 24)), f"{digits(3)}-{digits(2)}", "(" + word() + ")"])

    text, spans = "", []
    for _ in range(r.randint(14, 24)):
        x = r.random()
        if x < 0.16:
            kind = r.choice(KINDS)
            new = personal(kind)
            spans.append((kind, len(text), len(text) + len(new)))
        else:
            new = harmless() if x < 0.34 else word() + mark
        text += new + " "
    return text, spans


def tags_of(length: int, spans: list[tuple[str, int, int]]) -> np.ndarray:
    y = np.zeros(length, np.int64)
    for kind, a, b in spans:
        k = 1 + 2 * KINDS.index(kind)
        y[a:b] = k + 1
        y[a] = k
    return y


@lru_cache(maxsize=2)
def trained(steps: int = 560, batch: int = 48, seed: int = 11) -> Tagger:
    """A tagger fitted with Adam on ``steps`` x ``batch`` labelled windows of ``TRAINED`` characters; the same for the same arguments."""
    r, model = random.Random(seed), Tagger()
    first = {k: np.zeros_like(v) for k, v in model.p.items()}
    second = {k: np.zeros_like(v) for k, v in model.p.items()}
    for step in range(1, steps + 1):
        xs, ys = np.full((batch, TRAINED), PAD, np.int64), np.zeros((batch, TRAINED), np.int64)
        for k in range(batch):
            text, spans = labelled_sentence(r)
            x, y = symbols(text), tags_of(len(text), spans)
            a = r.randint(0, max(0, len(x) - TRAINED))
            xs[k, : len(x) - a], ys[k, : len(x) - a] = x[a : a + TRAINED], y[a : a + TRAINED]
        _, g = model.gradients(xs, ys)
        norm = np.sqrt(sum(float((v**2).sum()) for v in g.values()))
        rate = 0.012 * min(1, step / 20) * (1 - 0.95 * step / steps)
        for k, v in g.items():
            v = v * min(1.0, 5 / (norm + 1e-9))
            first[k] = 0.9 * first[k] + 0.1 * v
            second[k] = 0.99 * second[k] + 0.01 * v**2
            model.p[k] = (model.p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


@lru_cache(maxsize=2)
def version(**settings) -> str:
    """Digest of the code and the settings that a trained tagger depends on."""
    with open(__file__, "rb") as f:
        return hashlib.sha256(f.read() + repr(sorted(settings.items())).encode()).hexdigest()[:24]


def tagger(spark: SparkSession, **settings) -> Tagger:
    """The trained tagger: read from the shared folder if the same code has trained it before."""
    path = f"{shared_dir(spark)}/tarnwork/tagger-{version(**settings)}"
    try:
        found = spark.read.schema("p binary").parquet(path).first()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        found = None
    if found is not None:
        model = Tagger()
        with np.load(io.BytesIO(found["p"])) as saved:
            model.p = {k: saved[k] for k in saved.files}
        return model
    model, saved = trained(**settings), io.BytesIO()
    np.savez(saved, **model.p)
    spark.createDataFrame([(saved.getvalue(),)], "p binary").write.mode("ignore").parquet(path)
    return model


class Reading:
    """Emission scores of packed texts, window by window, blended where windows overlap."""

    def __init__(self, model: Tagger, codes: np.ndarray, lengths: np.ndarray):
        self.model, self.codes = model, codes
        self.first = np.cumsum(lengths) - lengths
        count = np.where(lengths > 0, 1 + np.maximum(0, -(-(lengths - WINDOW) // STRIDE)), 0)  # the last reaches the end
        self.windows = np.concatenate(([0], np.cumsum(count)))  # those of each text
        row = np.repeat(np.arange(len(lengths)), count)
        self.start = self.first[row] + (np.arange(len(row)) - self.windows[row]) * STRIDE
        self.end = np.minimum(self.start + WINDOW, (self.first + lengths)[row])
        self.total, self.blend = np.zeros((len(codes), len(TAGS)), np.float32), np.zeros(len(codes), np.float32)
        self.done = np.zeros(len(row), bool)
        self.weight = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float32)

    def touching(self, places: np.ndarray) -> np.ndarray:
        """Which windows cover one of the marked characters."""
        sums = np.concatenate(([0], np.cumsum(places)))
        return np.flatnonzero(sums[self.end] > sums[self.start])

    def read(self, wanted: np.ndarray) -> None:
        """Adds the scores of the wanted windows that are not there yet."""
        todo = wanted[~self.done[wanted]]
        self.done[todo] = True
        step = np.arange(WINDOW)
        for k in range(0, len(todo), BATCH):
            low, high = self.start[todo[k : k + BATCH]], self.end[todo[k : k + BATCH]]
            place = low[:, None] + step
            u = self.model.emissions(np.where(place < high[:, None], self.codes[np.minimum(place, len(self.codes) - 1)], PAD)) * self.weight[:, None]
            for one, a, b in zip(u, low.tolist(), high.tolist(), strict=True):
                self.total[a:b] += one[: b - a]
                self.blend[a:b] += self.weight[: b - a]

    def unread(self, a: int, b: int, windows: slice) -> np.ndarray:
        """Characters of [a, b), whose windows are given, that a window not read yet covers."""
        edges, todo = np.zeros(b - a + 1, np.int64), ~self.done[windows]
        np.add.at(edges, self.start[windows][todo] - a, 1)
        np.add.at(edges, self.end[windows][todo] - a, -1)
        return np.cumsum(edges)[:-1] > 0

    def scores(self, a: int, b: int, unread: np.ndarray) -> np.ndarray:
        """Blended scores of [a, b); characters with a window to come are far outside."""
        u = self.total[a:b] / np.maximum(self.blend[a:b], 1)[:, None]
        u[unread] = np.array([1e4] + [0.0] * (len(TAGS) - 1), np.float32)
        return u


#: Each accepted span has one of these, as ``_fits`` asks for digits, an at-sign, a bracket or a colon.
MARKS = np.zeros(N_SYMBOLS, bool)
MARKS[[SYMBOLS.index(c) for c in "0123456789@:(["]] = True
#: Characters on either side of a mark that are read at once.
REACH = 48


def stretches(unsure: np.ndarray, marked: np.ndarray, first: np.ndarray, everything: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the unsure runs that have a mark, of texts that begin at ``first``."""
    edge = np.zeros(len(unsure) + 1, bool)
    edge[0] = edge[-1] = True
    edge[1:-1] = unsure[1:] != unsure[:-1]
    edge[first] = True  # a stretch ends with its text
    cuts = np.flatnonzero(edge)
    marks = np.concatenate(([0], np.cumsum(marked)))
    told = unsure[cuts[:-1]] & (everything | (marks[cuts[1:]] > marks[cuts[:-1]]))
    return cuts[:-1][told], cuts[1:][told]


def read_on(reading: Reading, row: int, a: int, b: int, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores, starts and ends of a text [a, b) once none of its stretches borders on text that is not read.

    Each turn reads twice as far as the one before, so turns grow with the logarithm of the
    text's length, and all of them together take time in proportion to it but for that factor.
    """
    windows = slice(reading.windows[row], reading.windows[row + 1])
    low, high = reading.start[windows] - a, reading.end[windows] - a
    none, ahead = np.zeros(1, np.int64), WINDOW
    while True:
        unread = reading.unread(a, b, windows)
        u = reading.scores(a, b, unread)
        starts, ends = stretches(~reading.model.outside(u, none), marked, none, False)
        left, right = starts[unread[np.maximum(starts - 1, 0)] & (starts > 0)], ends[unread[np.minimum(ends, b - a - 1)] & (ends < b - a)]
        if not len(left) and not len(right):
            return u, starts, ends
        near = np.zeros(b - a + 1, np.int64)
        np.add.at(near, np.maximum(left - ahead, 0), 1)
        np.add.at(near, left, -1)
        np.add.at(near, right, 1)
        np.add.at(near, np.minimum(right + ahead, b - a), -1)
        sums = np.concatenate(([0], np.cumsum(np.cumsum(near)[:-1] > 0)))
        reading.read(windows.start + np.flatnonzero(sums[high] > sums[low]))
        ahead *= 2


def model_spans(model: Tagger, rows: list[str], everything: bool = False) -> list[list[tuple[str, int, int]]]:
    """Spans of each text by the tagger, of those that have a mark inside; all with ``everything``.

    Only such spans can be accepted.  So the windows near marks are read first, and where a
    stretch that may be a span and has a mark reaches text that is not read yet, the windows
    there follow until none does.
    """
    out: list[list[tuple[str, int, int]]] = [[] for _ in rows]
    lengths = np.array([len(t) for t in rows], np.int64)
    codes = symbols("".join(rows))
    if not len(codes):
        return out
    n, first = len(codes), np.cumsum(lengths) - lengths
    marked = MARKS[codes]
    reading = Reading(model, codes, lengths)
    near = np.convolve(marked, np.ones(2 * REACH + 1), "same") > 0.5 if n > 2 * REACH else np.full(n, bool(marked.any()))
    reading.read(np.arange(len(reading.done)) if everything else reading.touching(near))
    unread = reading.unread(0, n, slice(None))
    u = reading.scores(0, n, unread)
    begin = first[first < n]
    starts, ends = stretches(~model.outside(u, begin), marked, begin, everything)
    row = np.searchsorted(first, starts, side="right") - 1
    last = first + lengths
    goes_on = (unread[np.maximum(starts - 1, 0)] & (starts > first[row])) | (unread[np.minimum(ends, n - 1)] & (ends < last[row]))
    again = np.unique(row[goes_on])
    kept = ~np.isin(row, again)
    found = [(starts[kept], ends[kept])]
    for k in again.tolist():
        a, b = int(first[k]), int(last[k])
        u[a:b], low, high = read_on(reading, k, a, b, marked[a:b])
        found.append((low + a, high + a))
    tags = model.decode(u, *(np.concatenate(x) for x in zip(*found, strict=True)))
    # a span begins at a tag B, or at a tag that does not go on with the kind before it
    kind = (tags.astype(np.int64) + 1) // 2
    fresh = kind > 0
    goes_on = np.zeros(len(tags), bool)
    goes_on[1:] = (kind[1:] == kind[:-1]) & (tags[1:] % 2 == 0) & (kind[1:] > 0)
    goes_on[begin] = False
    begins = np.flatnonzero(fresh & ~goes_on)
    stops = np.flatnonzero(np.append(~goes_on, True))
    for a in begins.tolist():
        b = int(stops[np.searchsorted(stops, a, side="right")])
        k = int(np.searchsorted(first, a, side="right")) - 1
        out[k].append((KINDS[kind[a] - 1], a - int(first[k]), b - int(first[k])))
    return out


def _fits(kind: str, found: str) -> bool:
    d = _digits(found)
    if kind == "email":
        return bool(re.fullmatch(r"[\w.%+-]+ ?(?:@|[(\[] ?at ?[)\]]) ?[\w-]+(?:(?:\.| ?[(\[] ?dot ?[)\]] ?)[\w-]+)+", found))
    if kind == "ip":
        parts = re.split(r"\.|\[\.\]", found)
        if len(parts) == 4 and all(p.isdecimal() and p.isascii() for p in parts):
            return all(int(p) <= 255 for p in parts)
        try:
            return ipaddress.ip_address(found).version == 6
        except ValueError:
            return False
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d) and bool(re.fullmatch(r"[0-9]+(?:[ ./-][0-9]+)*", found))
    return 10 <= len(d) <= 15 and bool(re.fullmatch(r"\+?[0-9]{0,3} ?\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{4}", found))


def spans(model: Tagger, rows: list[str]) -> list[tuple[list, list]]:
    """For each text the patterns' spans, and all spans with those that the tagger adds."""
    out = []
    for text, added in zip(rows, model_spans(model, rows), strict=True):
        base = pattern_spans(text)
        every = list(base)
        for kind, a, b in added:
            while a < b and text[a].isspace():
                a += 1
            while b > a and (text[b - 1].isspace() or text[b - 1] in ".,"):
                b -= 1
            alone = (a == 0 or not text[a - 1].isalnum()) and (b == len(text) or not text[b].isalnum())
            if a < b and alone and _fits(kind, text[a:b]) and all(b <= x or y <= a for _, x, y in base):
                every.append((kind, a, b))
        every.sort(key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
        out.append((base, every))
    return out


SPAN = "array<struct<kind:string,start:int,end:int>>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def find(docs: DataFrame, model: Tagger, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, spans): the patterns' spans and all spans, by kind and start."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand parameters

    def work(batch: pa.RecordBatch) -> dict:
        found = spans(shared.value, batch.column(1).to_pylist())
        asdict = lambda part: pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in x[part]] for x in found], _SPAN)
        return {id_col: batch.column(0), "base": asdict(0), "spans": asdict(1)}

    return map_batches(texts(docs, id_col, text_col), work, f"{id_col} {id_type(docs, id_col)}, base {SPAN}, spans {SPAN}", size_col=text_col, piece_bytes=PIECE)


def masked(text: str, found: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind's mark; of overlapping spans all are covered."""
    out, at = [], 0
    for kind, a, b in sorted(found, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], MASKS[kind]]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, model: Tagger, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The same rows and columns, with personal data masked and the length column set anew; null texts stay null."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.schema

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        k = batch.schema.get_field_index(text_col)
        rows = batch.column(k).to_pylist()
        found = spans(shared.value, [t or "" for t in rows])
        new = [None if t is None else masked(t, f[1]) if f[1] else t for t, f in zip(rows, found, strict=True)]
        columns = list(batch.columns)
        columns[k] = pa.array(new, batch.schema.field(k).type)
        return pa.RecordBatch.from_arrays(columns, batch.schema.names)

    out = map_slices(docs, work, schema, size_col=text_col, piece_bytes=PIECE)
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.length(text_col).cast(schema[length_col].dataType))
    return out
