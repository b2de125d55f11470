"""Personal data: a character-level bidirectional LSTM with CRF transitions over plain patterns.

Plain patterns give the base spans of four kinds. The model is trained in numpy on labelled
spans of the corpus: base spans, and the same spans in spellings the patterns miss (a
phone number without plus, an address with [at] and [dot], a card number with points).
It reads the regions of a text around digits and at-signs, in overlapping windows; the
emissions of all windows are averaged by character and one Viterbi pass per region decides, so
windows agree where they meet. Every kind has a digit or an at-sign in it, or [at], so
the rest of a text holds none. A span the model adds must pass its kind's own check.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewright.llm.common import entering, pin, slices

KINDS = ("email", "ip", "card", "phone")
#: The patterns of the base spans.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]|[\[(]at[\])]")
OBFUSCATED = re.compile(r"\s*[\[(](at|dot)[\])]\s*")

WINDOW, STRIDE, CONTEXT = 96, 64, 32
#: Bounds of training: windows taken from the corpus by hash, passes over them.
TRAIN_WINDOWS, EPOCHS, BATCH = 600, 10, 32
TAGS = 1 + 2 * len(KINDS)

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def valid(kind: str, text: str) -> bool:
    """The check of a kind on the text of a span."""
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255 for part in text.split("."))
    digits = digits_of(text)
    return 14 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 10 <= len(digits) <= 15


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, not overlapping: around each at-sign the longest local part behind the
    last match, if a domain follows."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in LOCAL:
            begin -= 1
        found = DOMAIN.match(text, at + 1) if begin < at else None
        if found:
            yield begin, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """All base spans by start, then kind in the order of KINDS."""
    spans = [("email", a, b) for a, b in emails(text)]
    for kind, pattern in (("ip", IP), ("card", CARD), ("phone", PHONE)):
        spans += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if valid(kind, m.group())]
    return ordered(spans)


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


def characters(text: str) -> np.ndarray:
    """Classes of characters: visible ASCII one by one, white space, other letters, the rest."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    plain = (codes > 32) & (codes < 127)
    blank = (codes <= 32) | (codes == 0xA0)
    return np.where(plain, codes - 32, np.where(blank, 0, np.where(codes < 0x2000, 95, 96)))


CLASSES = 97


def tags_of(length: int, spans: list[Span]) -> np.ndarray:
    """One tag a character: 0 outside, 2k + 1 at the beginning of kind k, 2k + 2 inside."""
    tags = np.zeros(length, np.int64)
    for kind, a, b in spans:
        k = KINDS.index(kind)
        tags[a:b] = 2 * k + 2
        tags[a] = 2 * k + 1
    return tags


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


@dataclass
class Tagger:
    """Parameters of the network: embedding, two LSTMs, output layer, CRF transitions."""

    p: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, embed: int = 12, hidden: int = 20, seed: int = 5) -> Tagger:
        rng = np.random.default_rng(seed)
        p = {"E": rng.normal(0, 0.3, (CLASSES, embed)), "O": rng.normal(0, 0.2, (2 * hidden, TAGS)), "o": np.zeros(TAGS)}
        for side in "fb":
            p["W" + side] = rng.normal(0, 0.25, (embed + hidden, 4 * hidden))
            p["c" + side] = np.repeat([0.0, 1.0, 0.0, 0.0], hidden)
        p["T"] = np.zeros((TAGS, TAGS))
        return cls(p)

    def _lstm(self, x: np.ndarray, side: str) -> tuple[np.ndarray, list]:
        """Hidden states of one direction; x is (time, batch, embed)."""
        w, c = self.p["W" + side], self.p["c" + side]
        hidden = w.shape[1] // 4
        h = cell = np.zeros((x.shape[1], hidden), x.dtype)
        inputs = x @ w[: x.shape[2]] + c
        own = w[x.shape[2] :]
        states, trail = np.empty((len(x), x.shape[1], hidden), x.dtype), []
        for t in range(len(x)) if side == "f" else range(len(x) - 1, -1, -1):
            z = inputs[t] + h @ own
            gates = sigmoid(z[:, : 3 * hidden])
            new = np.tanh(z[:, 3 * hidden :])
            before, h_before = cell, h
            cell = gates[:, hidden : 2 * hidden] * cell + gates[:, :hidden] * new
            squashed = np.tanh(cell)
            h = gates[:, 2 * hidden :] * squashed
            states[t] = h
            trail.append((t, gates, new, before, squashed, h_before))
        return states, trail

    def emissions(self, chars: np.ndarray) -> np.ndarray:
        """Scores (batch, time, tag) of classes (batch, time)."""
        x = self.p["E"][chars.T]
        both = np.concatenate([self._lstm(x, "f")[0], self._lstm(x, "b")[0]], axis=2)
        return (both @ self.p["O"] + self.p["o"]).transpose(1, 0, 2)

    def _lstm_back(self, x, side, trail, d_states, grads) -> np.ndarray:
        w = self.p["W" + side]
        embed, hidden = x.shape[2], w.shape[1] // 4
        d_x = np.zeros_like(x)
        d_h = d_cell = np.zeros(d_states.shape[1:])
        for t, gates, new, before, squashed, h_before in reversed(trail):
            i, f, o = gates[:, :hidden], gates[:, hidden : 2 * hidden], gates[:, 2 * hidden :]
            d_h = d_h + d_states[t]
            d_cell = d_cell + d_h * o * (1 - squashed**2)
            d_z = np.concatenate(
                [d_cell * new * i * (1 - i), d_cell * before * f * (1 - f), d_h * squashed * o * (1 - o), d_cell * i * (1 - new**2)], axis=1
            )
            grads["W" + side][:embed] += x[t].T @ d_z
            grads["W" + side][embed:] += h_before.T @ d_z
            grads["c" + side] += d_z.sum(axis=0)
            d_x[t] = d_z @ w[:embed].T
            d_h, d_cell = d_z @ w[embed:].T, d_cell * f
        return d_x

    def gradients(self, chars: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tags under the CRF, and its gradients."""
        p, grads = self.p, {k: np.zeros_like(v) for k, v in self.p.items()}
        x = p["E"][chars.T]
        (ahead, trail_f), (back, trail_b) = self._lstm(x, "f"), self._lstm(x, "b")
        both = np.concatenate([ahead, back], axis=2)
        scores = both @ p["O"] + p["o"]
        steps, batch = scores.shape[:2]
        alpha, beta = np.empty_like(scores), np.zeros_like(scores)
        alpha[0] = scores[0]
        for t in range(1, steps):
            alpha[t] = scores[t] + log_sum(alpha[t - 1][:, :, None] + p["T"], 1)
        for t in range(steps - 2, -1, -1):
            beta[t] = log_sum(p["T"] + (scores[t + 1] + beta[t + 1])[:, None, :], 2)
        total = log_sum(alpha[-1], 1)
        want = tags.T
        lanes = np.arange(batch)
        gold = sum(scores[t, lanes, want[t]] for t in range(steps)) + sum(p["T"][want[t - 1], want[t]] for t in range(1, steps))
        d_scores = np.exp(alpha + beta - total[:, None])
        for t in range(steps):
            d_scores[t, lanes, want[t]] -= 1
            if t:
                pair = alpha[t - 1][:, :, None] + p["T"] + (scores[t] + beta[t])[:, None, :] - total[:, None, None]
                grads["T"] += np.exp(pair).sum(axis=0)
                np.subtract.at(grads["T"], (want[t - 1], want[t]), 1)
        d_scores /= batch
        grads["T"] /= batch
        grads["O"] = np.einsum("tbh,tbk->hk", both, d_scores)
        grads["o"] = d_scores.sum(axis=(0, 1))
        d_both = d_scores @ p["O"].T
        hidden = ahead.shape[2]
        d_x = self._lstm_back(x, "f", trail_f, d_both[:, :, :hidden], grads)
        d_x += self._lstm_back(x, "b", trail_b, d_both[:, :, hidden:], grads)
        np.add.at(grads["E"], chars.T, d_x)
        return float((total - gold).mean()), grads

    def fit(self, chars: np.ndarray, tags: np.ndarray, epochs: int = EPOCHS, batch: int = BATCH, rate: float = 0.015, seed: int = 5) -> Tagger:
        """Adam over shuffled batches, the rate falling to nothing."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        steps = epochs * -(-len(chars) // batch)
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(chars))
            for begin in range(0, len(order), batch):
                part = order[begin : begin + batch]
                _, grads = self.gradients(chars[part], tags[part])
                norm = np.sqrt(sum((g**2).sum() for g in grads.values()))
                step += 1
                for k, g in grads.items():
                    g = g * min(1.0, 5.0 / max(norm, 1e-9))
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g**2
                    move = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
                    self.p[k] -= rate * (1 - (step - 1) / steps) * move
        return self

    def decode(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best tags (batch, time) by Viterbi; places beyond a length keep the last state."""
        batch, steps, _ = scores.shape
        best, back = scores[:, 0].copy(), np.zeros((steps, batch, TAGS), np.int8)
        stay = np.broadcast_to(np.arange(TAGS, dtype=np.int8), (batch, TAGS))
        for t in range(1, steps):
            paths = best[:, :, None] + self.p["T"]
            inside = (t < lengths)[:, None]
            back[t] = np.where(inside, paths.argmax(axis=1), stay)
            best = np.where(inside, paths.max(axis=1) + scores[:, t], best)
        tags = np.empty((batch, steps), np.int64)
        tags[:, -1] = best.argmax(axis=1)
        for t in range(steps - 1, 0, -1):
            tags[:, t - 1] = back[t][np.arange(batch), tags[:, t]]
        return tags


def regions(text: str) -> list[tuple[int, int]]:
    """Where the model reads: CONTEXT characters around every trigger, merged."""
    found: list[tuple[int, int]] = []
    for m in TRIGGER.finditer(text):
        a, b = max(0, m.start() - CONTEXT), min(len(text), m.end() + CONTEXT)
        if found and a <= found[-1][1]:
            found[-1] = (found[-1][0], b)
        else:
            found.append((a, b))
    return found


def region_scores(tagger: Tagger, texts: list[str]) -> list[np.ndarray]:
    """Emissions of each text, averaged over the windows that overlap a character."""
    places, chunks = [], []
    for i, text in enumerate(texts):
        chars = characters(text)
        for begin in range(0, max(1, len(chars) - (WINDOW - STRIDE)), STRIDE):
            part = chars[begin : begin + WINDOW]
            places.append((i, begin, len(part)))
            chunks.append(np.pad(part, (0, WINDOW - len(part))))
    sums = [np.zeros((len(t), TAGS)) for t in texts]
    seen = [np.zeros((len(t), 1)) for t in texts]
    for begin in range(0, len(chunks), 1024):
        got = tagger.emissions(np.stack(chunks[begin : begin + 1024]))
        for (i, at, length), scores in zip(places[begin : begin + 1024], got):
            sums[i][at : at + length] += scores[:length]
            seen[i][at : at + length] += 1
    return [s / np.maximum(n, 1) for s, n in zip(sums, seen)]


def spans_of_tags(tags: np.ndarray) -> list[Span]:
    spans, begin, kind = [], 0, -1
    for i, tag in enumerate([*tags.tolist(), 0]):
        k = (tag - 1) // 2 if tag else -1
        if kind >= 0 and (k != kind or tag % 2):
            spans.append((KINDS[kind], begin, i))
            kind = -1
        if k >= 0 and kind < 0:
            begin, kind = i, k
    return spans


def plausible(kind: str, text: str) -> bool:
    """The check of a span that the model adds, spelled plainly first."""
    plain = OBFUSCATED.sub(lambda m: "@" if m.group(1) == "at" else ".", text.strip())
    if kind == "email":
        return [(0, len(plain))] == list(emails(plain))
    if kind == "ip":
        return bool(IP.fullmatch(plain)) and valid(kind, plain)
    if kind == "phone":
        return bool(re.fullmatch(r"[+(]?[0-9][\x20().0-9-]+[0-9]", plain)) and bool(re.search(r"[\x20().-]", plain)) and valid(kind, plain)
    return bool(re.fullmatch(r"[0-9](?:[\x20.-]?[0-9])+", plain)) and valid(kind, plain)


def find_spans(tagger: Tagger, texts: list[str | None]) -> tuple[list[list[Span]], list[list[Span]]]:
    """Base spans and all spans of each text; what the model adds never overlaps a base span."""
    base = [base_spans(t) if t else [] for t in texts]
    every = [list(spans) for spans in base]
    asked = [(i, a, b) for i, t in enumerate(texts) if t for a, b in regions(t)]
    asked.sort(key=lambda r: r[2] - r[1])
    at = 0
    while at < len(asked):
        part = []
        while at < len(asked) and (not part or (len(part) < 512 and (len(part) + 1) * (asked[at][2] - asked[at][1]) < 1 << 17)):
            part.append(asked[at])
            at += 1
        scores = region_scores(tagger, [texts[i][a:b] for i, a, b in part])
        lengths = np.array([len(s) for s in scores])
        padded = np.zeros((len(part), lengths.max(), TAGS))
        for row, s in zip(padded, scores):
            row[: len(s)] = s
        for (i, a, _), tags, length in zip(part, tagger.decode(padded, lengths), lengths):
            for kind, x, y in spans_of_tags(tags[:length]):
                x, y = x + a, y + a
                if not any(x < d and c < y for _, c, d in base[i]) and plausible(kind, texts[i][x:y]):
                    every[i].append((kind, x, y))
    return base, [ordered(spans) for spans in every]


def spelled(kind: str, text: str) -> str | None:
    """The same data in a spelling the base patterns miss."""
    if kind == "email":
        return text.replace("@", " [at] ").replace(".", " [dot] ")
    if kind == "phone":
        return text.removeprefix("+")
    if kind == "card":
        digits = digits_of(text)
        return ".".join(digits[i : i + 4] for i in range(0, len(digits), 4))
    return None


def labelled_windows(text: str) -> Iterator[tuple[str, str]]:
    """Windows of a text around its regions, each with its spans, as found and respelled."""
    for a, b in regions(text):
        part = text[a:b][:WINDOW]
        spans = base_spans(part)
        yield part, joined(spans)
        for kind, x, y in spans[:1]:
            other = spelled(kind, part[x:y])
            if other and len(spans) == 1:
                yield (part[:x] + other + part[y:])[:WINDOW], joined([(kind, x, min(WINDOW, x + len(other)))])


def parse(spans: str) -> list[Span]:
    return [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in spans.split(",") if s)]


def train(docs: DataFrame, windows: int = TRAIN_WINDOWS, epochs: int = EPOCHS) -> Tagger:
    """A tagger fitted on `windows` different windows at most, chosen by hash from all texts:
    half with spans, half without. Copies of a window count once, so no text fills the
    sample. Without any window it stays untrained and tags nothing."""
    half = windows // 2

    def run(batches):
        # Of each sort a task hands on those with the smallest hashes, each once: no other can be
        # among the smallest of all.
        least: dict[bool, set[tuple[int, str, str]]] = {True: set(), False: set()}
        for part in slices(batches, "text"):
            for text in part.column("text").to_pylist():
                for window, spans in labelled_windows(text):
                    least[spans != ""].add((xxhash.xxh64_intdigest(window) >> 1, window, spans))
            for sort, held in least.items():
                if len(held) > 4 * half:
                    least[sort] = set(sorted(held)[:half])
        rows = [row for held in least.values() for row in sorted(held)[:half]]
        if rows:
            order, *texts = zip(*rows)
            yield pa.record_batch([pa.array(order, pa.int64()), *(pa.array(c, pa.string()) for c in texts)], names=["order", "part", "spans"])

    texts = docs.select(F.col("text").cast("string").alias("text")).where(F.col("text").rlike("[0-9@]"))
    found = pin(texts.mapInArrow(run, "order long, part string, spans string").distinct(), "pii-windows")
    some = found.where("spans <> ''").orderBy("order", "part", "spans").limit(half)
    none = found.where("spans = ''").orderBy("order", "part").limit(half)
    rows = [*some.collect(), *none.collect()]
    tagger = Tagger.fresh()
    if not rows:
        tagger.p["o"][0] = 100.0
        return tagger
    chars = np.stack([np.pad(characters(r.part), (0, WINDOW - len(r.part))) for r in rows])
    tags = np.stack([np.pad(tags_of(len(r.part), parse(r.spans)), (0, WINDOW - len(r.part))) for r in rows])
    return tagger.fit(chars, tags, epochs)


REPORT = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def report(text: Column, tagger: Tagger) -> Column:
    """A struct for a column of texts: base counts by kind, SHA-256 of the base spans
    (kind:start:end, joined by commas), and all spans written likewise. A null text is empty."""

    @F.pandas_udf(REPORT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        entering("pii")
        for texts in batches:
            rows = []
            for part in _parts(list(texts)):
                for base, spans in zip(*find_spans(tagger, part)):
                    counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                    rows.append([*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)])
            yield pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return run(text)


def _parts(texts: list[str | None], limit: int = 8 << 20) -> Iterator[list[str | None]]:
    begin = held = 0
    for i, text in enumerate(texts):
        held += len(text or "")
        if held > limit:
            yield texts[begin : i + 1]
            begin, held = i + 1, 0
    if begin < len(texts):
        yield texts[begin:]


def redacted(text: Column, tagger: Tagger) -> Column:
    """The texts with every span replaced by its kind in angle brackets; null stays null.
    Of spans that overlap the first is named, and all of their characters go."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        entering("pii")
        for texts in batches:
            out = []
            for part in _parts(list(texts)):
                for text, spans in zip(part, find_spans(tagger, part)[1]):
                    out.append(None if text is None else _replaced(text, spans))
            yield pd.Series(out, dtype=object)

    return run(text)


def _replaced(text: str, spans: list[Span]) -> str:
    pieces, done = [], 0
    for kind, a, b in spans:
        if a >= done:
            pieces += [text[done:a], f"<{kind.upper()}>"]
        done = max(done, b)
    return "".join([*pieces, text[done:]])
