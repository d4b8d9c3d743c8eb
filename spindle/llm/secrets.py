"""Secret scans.

Method: a character convolutional network in numpy scores every candidate with its surrounding context.
Candidates are the findings of the base rules and every run of 12 token characters or more. The network is trained on
labelled findings: base findings and generated secrets of usual shapes against ordinary runs of the corpus and
generated look-alikes (numbers, dates, paths, versions, identifiers). Its logits are calibrated by Platt scaling on
findings held out of the training, among them secrets of shapes of which it has seen none. The threshold is the highest
one that keeps the wanted recall of each shape, of those that it has seen and of the others. Recall by shape, and the precision on what was held out, are
told with the network.

Base findings always stay, whatever their probability; the network adds spans of kind `model`, which never overlap a
base span: of a run that base spans cover in part, it judges the whole, and adds the parts outside them.
Spans are in code points, end exclusive. Defined results: a null or empty text has no spans; bytes that are
not UTF-8 count as U+FFFD; repeated rows each give a row, and are learned from once; extra columns are ignored, but for
one of the name of the result, whose place that takes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, as_text, give_back, small, table

#: Kinds of base findings in the order of the digest, then the network's.
KINDS = ("assign", "access", "hex", "model")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{16,}")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
#: A candidate of the network's own: at least so many token characters, as few as a base finding has.
CANDIDATE_LEAST = 12
CANDIDATE = re.compile(rb"[A-Za-z0-9+/_=-]{%d,}" % CANDIDATE_LEAST)
#: Bytes of a candidate and of its context on either side that the network sees at once. A longer candidate is seen in
#: windows that overlap by half, and its most probable window counts.
SEEN, CONTEXT = 48, 16
#: Texts learned from, and findings of each kind and words of each of them, at most: bounds on the sample the classifier is fitted on.
SAMPLE, EACH = 2000, 8
RECALL = 0.98
#: Half of the sample is texts that hold one of these, so that it has findings. What is found does not depend on them.
HINTS = ("password", "passwd", "secret", "token", "api_key", "apikey", "PASSWORD", "SECRET", "TOKEN", "API_KEY", "Password", "Token", "AKIA")


def base_spans(raw: bytes) -> list[tuple[int, int, int]]:
    """(start, end, index of kind) in bytes."""
    out = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(raw) if len(m[2]) >= ASSIGN_LEAST]
    if b"AKIA" in raw:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(raw) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(raw)]
    return sorted(out, key=lambda x: (x[0], x[2]))


def candidates(raw: bytes, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Runs of token characters, but for those wholly within taken spans."""
    return [m.span() for m in CANDIDATE.finditer(raw) if outside(*m.span(), taken)]


def outside(a: int, b: int, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The parts of a to b that no taken span covers; taken is in order of starts."""
    out = []
    for s, e, _ in taken:
        if s >= b:
            break
        if s > a:
            out.append((a, s))
        a = max(a, e)
    return [*out, (a, b)] if a < b else out


# --- the network -----------------------------------------------------------------------------------------------------

_CLASSES = np.zeros(256, dtype=np.int64)
for _k, _chars in enumerate((b"aeiou", b"bcdfghjklmnpqrstvwxyz", b"AEIOU", b"BCDFGHJKLMNPQRSTVWXYZ", b"0123456789", b"+/=", b"_-", b".", b":", b"\"'", b" \t", b"\r\n", b"#@%&?", b"()[]{}<>,;"), 1):
    _CLASSES[list(_chars)] = _k
_HEXADECIMAL = np.zeros(256, dtype=np.int64)
_HEXADECIMAL[list(b"0123456789abcdef")] = 1
DEPTH = 18
WIDTH = SEEN + 2 * CONTEXT


#: What stands before a window of a candidate, the window, and what stands after it.
Window = tuple[bytes, bytes, bytes]


def features(windows: list[Window]) -> np.ndarray:
    """(before, candidate, after) as one-hot classes of characters, with channels for hexadecimal, candidate and padding."""
    out = np.zeros((len(windows), WIDTH, DEPTH), dtype=np.float32)
    for i, (before, inside, after) in enumerate(windows):
        for at, part, is_in in ((CONTEXT - len(before), before, 0), (CONTEXT, inside[:SEEN], 1), (CONTEXT + min(len(inside), SEEN), after, 0)):
            raw = np.frombuffer(part, dtype=np.uint8)
            rows = np.arange(at, at + len(raw))
            out[i, rows, _CLASSES[raw]] = 1
            out[i, rows, 15] = _HEXADECIMAL[raw]
            out[i, rows, 16] = is_in
        out[i, :, 17] = out[i].sum(1) == 0
    return out


def starts(a: int, b: int) -> Iterator[int]:
    """Starts of the windows of a to b; the last one ends where it does."""
    yield from range(a, b - SEEN, SEEN // 2)
    yield max(a, b - SEEN)


def window(raw: bytes, at: int, b: int) -> Window:
    """(before, seen part, after) of the window at that start of a run that ends at b."""
    end = min(b, at + SEEN)
    return raw[max(0, at - CONTEXT) : at], raw[at:end], raw[end : end + CONTEXT]


def windows(raw: bytes, a: int, b: int) -> list[Window]:
    return [window(raw, x, b) for x in starts(a, b)]


@dataclass
class Network:
    """One convolution of five characters, maximum and mean over positions, one hidden layer."""

    conv: np.ndarray
    conv_bias: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 1.1
    #: Of what was held out and reaches the threshold, the share that is secret and that only the network finds.
    precision: float | None = None
    #: Of each shape held out, the share that reaches the threshold.
    recalls: dict[str, float] | None = None

    @classmethod
    def new(cls, filters: int = 32, hidden: int = 24, span: int = 5, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda a, b: (rng.standard_normal((a, b)) * np.sqrt(2 / a)).astype(np.float32)
        return cls(draw(span * DEPTH, filters), np.zeros(filters, np.float32), draw(2 * filters, hidden), np.zeros(hidden, np.float32), draw(hidden + 1, 1))

    def forward(self, x: np.ndarray) -> tuple:
        cols = np.lib.stride_tricks.sliding_window_view(x, len(self.conv) // DEPTH, axis=1).transpose(0, 1, 3, 2).reshape(len(x), -1, len(self.conv))
        a = np.maximum(cols @ self.conv + self.conv_bias, 0)
        top = a.argmax(1)
        pooled = np.concatenate([np.take_along_axis(a, top[:, None], 1)[:, 0], a.mean(1)], axis=1)
        h = np.maximum(pooled @ self.hidden + self.hidden_bias, 0)
        return cols, a, top, pooled, h, (h @ self.out[:-1] + self.out[-1])[:, 0]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.float32), *(self.forward(x[i : i + 256])[-1] for i in range(0, len(x), 256))])

    def calibrated(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -40, 40)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return self.calibrated(self.logits(x))

    def step(self, x: np.ndarray, y: np.ndarray, rate: float, state: dict) -> None:
        cols, a, top, pooled, h, z = self.forward(x)
        d = ((1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / len(y)).astype(np.float32)[:, None]
        dh = (d @ self.out[:-1].T) * (h > 0)
        dp = dh @ self.hidden.T
        f = a.shape[2]
        da = np.repeat(dp[:, None, f:] / a.shape[1], a.shape[1], axis=1)
        np.put_along_axis(da, top[:, None], np.take_along_axis(da, top[:, None], 1) + dp[:, None, :f], 1)
        da *= a > 0
        flat = da.reshape(-1, f)
        grads = {
            "out": np.concatenate([h.T @ d, d.sum(0, keepdims=True)]), "hidden": pooled.T @ dh, "hidden_bias": dh.sum(0),
            "conv": cols.reshape(-1, cols.shape[2]).T @ flat, "conv_bias": flat.sum(0),
        }
        state["t"] = t = state.get("t", 0) + 1
        for name, g in grads.items():  # Adam
            m, v = state.get(name, (0, 0))
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            state[name] = (m, v)
            getattr(self, name)[...] -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)


def train(positive: list[Window], negative: list[Window], shapes: dict[str, list[Window]], recall: float = RECALL, epochs: int = 10) -> Network:
    """Every fifth window is held out for calibration, and so are all of the shapes, which also give the threshold."""
    x = features(positive + negative)
    y = np.repeat(np.array([1, 0], dtype=np.float32), [len(positive), len(negative)])
    order = np.random.default_rng(11).permutation(len(y))
    x, y = x[order], y[order]
    held = np.arange(len(y)) % 5 == 0
    net, state = Network.new(), {}
    xt, yt = x[~held], y[~held]
    for epoch in range(epochs):
        shuffled = np.random.default_rng(epoch).permutation(len(yt))
        for k in range(0, len(shuffled), 64):
            at = shuffled[k : k + 64]
            net.step(xt[at], yt[at], 3e-3 * 0.8**epoch, state)
    z, t = net.logits(x[held]), y[held]
    of_shape = {name: net.logits(features(seen)) for name, seen in shapes.items() if seen}
    z, t = np.concatenate([z, *of_shape.values()]), np.concatenate([t, *(np.ones(len(v), np.float32) for v in of_shape.values())])
    if 0 < t.sum() < len(t):
        net.scale, net.shift = platt(z, t)
        if of_shape:
            p = {name: net.calibrated(v) for name, v in of_shape.items()}
            net.threshold = float(min(np.quantile(v, 1 - recall, method="lower") for v in p.values()))
            net.recalls = {name: float((v >= net.threshold).mean()) for name, v in p.items()}
            right, wrong = sum((v >= net.threshold).sum() for v in p.values()), (net.calibrated(z[t == 0]) >= net.threshold).sum()
            net.precision = float(right / (right + wrong))
    return net


def platt(z: np.ndarray, t: np.ndarray) -> tuple[float, float]:
    """Scale and shift of a logistic fit with Platt's smoothed targets, by Newton steps."""
    n1, n0 = t.sum(), len(t) - t.sum()
    goal = np.where(t == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    f, w = np.stack([z, np.ones_like(z)], axis=1).astype(np.float64), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(f @ w, -40, 40)))
        step = np.linalg.solve((f * (p * (1 - p))[:, None]).T @ f + 1e-3 * np.eye(2), f.T @ (p - goal) + 1e-3 * (w - [1, 0]))
        w -= np.clip(step, -1, 1)
    return float(w[0]), float(w[1])


_ALPHANUMERIC = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", dtype=np.uint8)
_HEXADECIMAL_DIGITS = np.frombuffer(b"0123456789abcdef", dtype=np.uint8)
_DIGITS = _ALPHANUMERIC[52:]
_BASE64 = np.concatenate([_ALPHANUMERIC, np.frombuffer(b"+/", dtype=np.uint8)])
_URL_SAFE = np.concatenate([_ALPHANUMERIC, np.frombuffer(b"-_", dtype=np.uint8)])
_BASE32 = np.concatenate([_ALPHANUMERIC[:26], np.frombuffer(b"234567", dtype=np.uint8)])

#: Generators of secrets, from a function that draws characters, a length and a shorter one. The network is trained on these.
SHAPES = {
    "alphanumeric": lambda draw, k, short: draw(_ALPHANUMERIC, k),
    "base64": lambda draw, k, short: draw(_BASE64, k) + b"=" * (k % 3),
    "prefix ghp_": lambda draw, k, short: b"ghp_" + draw(_ALPHANUMERIC, 36),
    "prefix sk_live_": lambda draw, k, short: b"sk_live_" + draw(_ALPHANUMERIC, 24),
    "prefix eyJ": lambda draw, k, short: b"eyJ" + draw(_ALPHANUMERIC, k),
    "short alphanumeric": lambda draw, k, short: draw(_ALPHANUMERIC, short),
    "short lower case and digits": lambda draw, k, short: draw(_ALPHANUMERIC[26:], short),
    "short letters": lambda draw, k, short: draw(_ALPHANUMERIC[:52], short),
    "around hexadecimal": lambda draw, k, short: draw(_ALPHANUMERIC, k // 2) + draw(_HEXADECIMAL_DIGITS, 16) + draw(_ALPHANUMERIC, k // 2),
    "grouped upper case": lambda draw, k, short: b"-".join(draw(_BASE32, 4) for _ in range(4)),
}
#: And these are held out of the training as a whole.
UNSEEN = {
    "prefix glpat-": lambda draw, k, short: b"glpat-" + draw(_URL_SAFE, 20),
    "prefix xoxb-": lambda draw, k, short: b"xoxb-" + draw(_DIGITS, 11) + b"-" + draw(_DIGITS, 12) + b"-" + draw(_ALPHANUMERIC, 24),
    "prefix AIza": lambda draw, k, short: b"AIza" + draw(_URL_SAFE, 35),
    "prefix npm_": lambda draw, k, short: b"npm_" + draw(_ALPHANUMERIC, 36),
    "base32": lambda draw, k, short: draw(_BASE32, k),
    "grouped in fives": lambda draw, k, short: b"-".join(draw(_ALPHANUMERIC, 5) for _ in range(5)),
}
_LOOK_ALIKES = (
    lambda word, draw, rng: b"_".join(word() for _ in range(3)) + b"_%d" % rng.integers(100),
    lambda word, draw, rng: b"/".join(word() for _ in range(3)) + b"/%d" % rng.integers(10**6),
    lambda word, draw, rng: b"-".join(b"%d" % rng.integers(10, 10**4) for _ in range(5)),
    lambda word, draw, rng: b"2024-0%d-1%dT%d" % (rng.integers(1, 10), rng.integers(10), rng.integers(10**10)),
    lambda word, draw, rng: b"-".join(word() for _ in range(4)) + b"-v%d" % rng.integers(10),
    lambda word, draw, rng: word() * 4 + b"%d" % rng.integers(1000),
    lambda word, draw, rng: b"-" * int(rng.integers(18, 30)) + b"%d" % rng.integers(10**3),
    lambda word, draw, rng: word() + b"-" + word() + b"-" + word(),
    lambda word, draw, rng: b"/" + word() + b"/" + word() + b"/" + word(),
    lambda word, draw, rng: word() + b"/" + draw(_HEXADECIMAL_DIGITS, int(rng.integers(2, 9))) + b"/" + word(),
    lambda word, draw, rng: word() + word().title() + word().title(),
    lambda word, draw, rng: b"=" * int(rng.integers(12, 60)),
    lambda word, draw, rng: b"_".join(word().upper() for _ in range(3)),
    lambda word, draw, rng: b"%d" % rng.integers(10**12, 10**15),
    lambda word, draw, rng: (word() + word() + word()).upper(),
)


def examples(n: int, words: list[bytes], seed: int = 5, shapes: dict = SHAPES) -> tuple[dict[str, list[Window]], list[Window], list[Window]]:
    """(n secrets by shape, as many look-alikes, harmless windows of the runs they are in), in contexts of the words."""
    rng = np.random.default_rng(seed)
    words = words or [b"the", b"value", b"of"]
    word = lambda: words[rng.integers(len(words))]
    draw = lambda chars, k: bytes(rng.choice(chars, k))
    positive: dict[str, list[Window]] = {name: [] for name in shapes}
    negative, around = [], []
    for i in range(n):
        name = list(shapes)[i % len(shapes)]
        secret = shapes[name](draw, int(rng.integers(20, 49)), int(rng.integers(CANDIDATE_LEAST, 25)))
        plain = _LOOK_ALIKES[i % len(_LOOK_ALIKES)](word, draw, rng)
        before, after = (word() + b" " + word() + [b" ", b": ", b' "', b"="][int(rng.integers(4))])[-CONTEXT:], (b" " + word() + b" " + word())[:CONTEXT]
        # Some are the end, or a middle part, of a longer run, as a key in a path is. The window that shows most of the secret is a finding, and those that show none of it are none.
        where = i // len(shapes) % 6
        start = b"" if where % 3 else b"/".join([b"", *(word() for _ in range(int(rng.integers(1, 14))))]) + [b"/", b"=", b"-"][int(rng.integers(3))]
        end = b"" if where else b"/" + b"/".join(word() for _ in range(int(rng.integers(1, 8))))
        raw = before + start + secret + end + after
        a, b = len(before), len(before + start + secret + end)
        seen = [(max(0, min(x + SEEN, a + len(start + secret)) - max(x, a + len(start))), w) for x, w in zip(starts(a, b), windows(raw, a, b), strict=True)]
        positive[name].append(max(seen, key=lambda w: w[0])[1])
        around += [w for n_seen, w in seen if not n_seen]
        first, *others = windows(before + plain + after, len(before), len(before + plain))
        negative.append(first)
        around += others
    return positive, negative, around


def some(values: list, most: int = EACH) -> list:
    """The values, or an even choice of that many."""
    return values if len(values) <= most else [values[i] for i in np.linspace(0, len(values) - 1, most).astype(int)]


def findings(raw: bytes) -> tuple[list[Window], list[Window], list[bytes]]:
    """(windows of base findings, windows of other runs, words) of a text, EACH of them at most."""
    found = base_spans(raw)
    runs = [m.span() for m in re.finditer(rb"[A-Za-z0-9+/_=-]{8,}", raw) if outside(*m.span(), found) == [m.span()]]
    plain = [(x, b) for a, b in runs for x in starts(a, b)]
    return [windows(raw, a, b)[0] for a, b, _ in some(found)], [window(raw, x, b) for x, b in some(plain)], some(re.findall(rb"[A-Za-z]{2,12}", raw))


_PARTS = pa.list_(pa.struct([("kind", pa.int32()), ("before", pa.binary()), ("seen", pa.binary()), ("after", pa.binary())]))


def learn(docs: DataFrame, text_col: str, sample: int = SAMPLE) -> Network:
    """Trained on labelled findings of at most `sample` different texts, half of them likely to hold secrets.

    Both passes are jobs over all tasks at once; executors pick the findings, so what the driver gets of a text is bounded however long it is.
    """
    rows = docs.select(F.col(text_col).alias("t")).where(F.col("t").isNotNull())
    hashed = rows.select("t", F.pmod(F.xxhash64("t"), F.lit(sample // 2)).alias("slot"), F.xxhash64("t", F.lit(1)).alias("h"))
    hashed = hashed.withColumn("hit", reduce(or_, (F.contains("t", F.lit(x)) for x in HINTS)))
    texts = hashed.groupBy("hit", "slot").agg(F.min("h").alias("h"))
    picked = hashed.join(F.broadcast(texts), ["hit", "slot", "h"], "left_semi").select("h", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 1):
            rows = [[{"kind": k, "before": w[0], "seen": w[1], "after": w[2]} for k, part in enumerate((p, n, [(b"", x, b"") for x in words])) for w in part] for p, n, words in map(findings, as_bytes(batch.column(1)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, _PARTS)], names=["h", "parts"])

    found = picked.mapInArrow(run, "h long, parts array<struct<kind:int,before:binary,seen:binary,after:binary>>")
    got = sorted(found.groupBy("h").agg(F.any_value("parts").alias("parts")).toArrow().to_pylist(), key=lambda r: r["h"])
    parts = [[(w["before"], w["seen"], w["after"]) for r in got for w in r["parts"] if w["kind"] == k] for k in range(3)]
    return fit(parts[0], parts[1], [w for _, w, _ in parts[2]])


def fit_on(texts: list[bytes]) -> Network:
    found = [findings(raw) for raw in sorted(set(texts))]
    return fit(*([x for f in found for x in f[k]] for k in range(3)))


def fit(positive: list[Window], negative: list[Window], words: list[bytes], sample: int = SAMPLE) -> Network:
    """Trained on `sample` findings of the corpus of each kind at most, and on generated ones."""
    p, n, around = examples(2400, words)
    held = examples(1000, words, 6)[0] | examples(600, words, 7, UNSEEN)[0]
    return train(some(positive, sample) + sum(p.values(), []), some(negative, sample) + n + some(around, 2000), held)


# --- scanning --------------------------------------------------------------------------------------------------------

SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("probability", T.DoubleType())])
_ARROW_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())])


def scan_texts(texts: list[str | None], net: Network | None) -> list[list[dict]]:
    """Spans of each text by start, then kind, with their probabilities if there is a network."""
    raws, bases, asked, most, owner, seen = [], [], [], [], [], []

    def judge() -> None:
        for k, p in zip(owner, net.probability(features(seen)).tolist(), strict=True):
            most[k] = max(most[k], p)
        owner.clear()
        seen.clear()

    def ask(i: int, a: int, b: int, kind: int, at: Iterator[int]) -> None:
        asked.append((i, a, b, kind))
        most.append(0.0)
        for x in at:
            owner.append(len(asked) - 1)
            seen.append(window(raws[i], x, b))
            if len(seen) == 1024:
                judge()

    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "replace")
        raws.append(raw)
        bases.append(base := base_spans(raw))
        if net is None:
            continue
        for a, b, kind in base:
            ask(i, a, b, kind, starts(a, b))
        if len(raw) >= CANDIDATE_LEAST:
            for a, b in candidates(raw, base):  # windows of base findings alone tell nothing of the rest
                ask(i, a, b, KINDS.index("model"), (x for x in starts(a, b) if not base or outside(x, min(b, x + SEEN), base)))
    if seen:
        judge()
    found = [[] for _ in texts] if net else [[(*span, None) for span in base] for base in bases]
    for (i, a, b, kind), p in zip(asked, most, strict=True):
        if kind != KINDS.index("model"):
            found[i].append((a, b, kind, p))
        elif p >= net.threshold:
            found[i].extend((*part, kind, p) for part in outside(a, b, bases[i]))
    out = []
    for raw, spans in zip(raws, found, strict=True):
        at, upto, rows = 0, 0, []
        points = {}
        for x in sorted({x for a, b, _, _ in spans for x in (a, b)}):
            upto += len(raw[at:x].decode("utf-8", "ignore"))
            at = x
            points[x] = upto
        for a, b, k, p in sorted(spans, key=lambda s: (s[0], s[2])):
            rows.append({"kind": KINDS[k], "start": points[a], "end": points[b], "probability": p})
        out.append(rows)
    return out


def scan(docs: DataFrame, text_col: str, net: Network | None, out: str = "spans") -> DataFrame:
    """docs with the column out: an array of (kind, start, end, probability)."""
    docs = docs.drop(out)
    shared = docs.sparkSession.sparkContext.broadcast(net)
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.ArrayType(SPAN))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                spans = pa.array(scan_texts(as_text(part.column(at)), shared.value), type=pa.list_(_ARROW_SPAN))
                yield pa.RecordBatch.from_arrays([*part.columns, spans], names=[*part.schema.names, out])
        give_back()

    return docs.mapInArrow(run, schema)


def redact(docs: DataFrame, text_col: str, spans_col: str) -> DataFrame:
    """docs with every span in text_col replaced by [SECRET]; spans that touch or overlap are replaced as one."""
    at, sp = docs.columns.index(text_col), docs.columns.index(spans_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_text(batch.column(at))
            for i, spans in enumerate(batch.column(sp).to_pylist()):
                if spans:
                    texts[i] = cut_out(texts[i], [(s["start"], s["end"]) for s in spans])
            columns = list(batch.columns)
            columns[at] = pa.array(texts, type=batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def cut_out(text: str, spans: list[tuple[int, int]], mark: str = "[SECRET]") -> str:
    out, at = [], 0
    for a, b in sorted(spans):
        if a > at or not out:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:]


def digests(scanned: DataFrame) -> DataFrame:
    said = lambda keep: F.array_join(F.transform(F.filter("spans", keep), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return scanned.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(said(lambda s: s["kind"] != "model").cast("binary"), 256).alias("base_sha256"), said(lambda s: F.lit(True)).alias("spans"),
    )


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(scan(docs, "text", learn(docs, "text")).drop("text"))
