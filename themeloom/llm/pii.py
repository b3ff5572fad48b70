"""Personal data: patterns for what has a fixed form, and a character-level tagger for what is written around it.

The tagger is a bidirectional LSTM with CRF transitions, written in numpy. It learns from labelled spans: those that the patterns find on a
bounded number of windows, as they are and rewritten in ways that no pattern allows ("name (at) host (dot) org", spaced dots, other
separators). It reads windows around characters without which none of the kinds exists (digits, at signs and the words for them), so
whole texts are covered however long they are. Overlapping windows are decoded one by one and reconciled per text: a
character takes the tag of the window in whose middle it lies. How sure the tagger must be is chosen on windows that it has not seen.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from themeloom.llm.common import slices, table
from themeloom.session import drop_staged, stage

KINDS = ("email", "ip", "card", "phone")
WIDTH = 64
STRIDE = 32
HIDDEN = 12
EMBEDDED = 8
SYMBOLS = 100
MAX_WINDOWS = 4000
EPOCHS = 8
BATCH = 64
SEED = 7
# Spans that the tagger adds must be right so often on held-out windows; without such a threshold it has to be all but certain.
PRECISION = 0.99
SURE = 0.98
HELD_OUT = 5
# Windows of one text that are decoded at once.
RUN = 8192

# --- patterns ---------------------------------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can't begin inside a run of digits, as a longer one from the run's beginning would have been found.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_TRIGGER = re.compile(r"[0-9@]|[(\[{]at[)\]}]| dot ")
_SPELLED = re.compile(r"[(\[{]at[)\]}]| dot ")


def luhn(digits: str) -> bool:
    total = 0
    for i, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + i % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From every at sign back over the local part and on over the domain; this takes linear time in long runs."""
    done, at = 0, text.find("@")
    while at >= 0:
        found = _DOMAIN.match(text, at + 1)
        if found:
            start = at
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                done = found.end()
                yield start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans ``(start, end, kind)`` of all patterns by start, then kind as listed; leftmost and without overlap per kind."""
    if not _TRIGGER.search(text):
        return []
    spans = [(a, b, 0) for a, b in _emails(text)]
    for found in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255 for part in found[0].split(".")):
            spans.append((*found.span(), 1))
    for found in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", found[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            spans.append((*found.span(), 2))
    for found in _PHONE.finditer(text):
        if 10 <= len(_NOT_DIGIT.sub("", found[0])) <= 15:
            spans.append((*found.span(), 3))
    return [(a, b, KINDS[k]) for a, b, k in sorted(spans, key=lambda s: (s[0], s[2]))]


# --- windows ----------------------------------------------------------------------------------------


def char_codes(text: str) -> np.ndarray:
    """Symbols of a text: printable ASCII as it is, white space, and one for all other characters."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where((points >= 32) & (points < 127), points - 30, 0).astype(np.uint8)
    codes[(points == 9) | (points == 10) | (points == 13)] = 1
    return codes


def window_starts(text: str, codes: np.ndarray, width: int = WIDTH, stride: int = STRIDE) -> np.ndarray:
    """Starts of the windows that together cover all digits, at signs and spelled ones of a text, each in the middle of one.

    Windows stand on a grid of ``stride``; a character lies in ``width / stride`` of them.
    """
    cells = np.flatnonzero(((codes >= 18) & (codes < 28)) | (codes == 34)) // stride
    spelled = [found.start() // stride for found in _SPELLED.finditer(text)]
    cells = np.unique(np.concatenate([cells, np.array(spelled, np.int64)]))
    starts = np.unique(np.concatenate([cells - i for i in range(-1, width // stride + 1)])) * stride
    return starts[(starts > -width) & (starts < len(codes))]


def cut_windows(codes: np.ndarray, starts: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """The windows as rows; beyond the ends of the text stands white space."""
    padded = np.concatenate([np.ones(width, np.uint8), codes, np.ones(width, np.uint8)])
    return padded[(starts + width)[:, None] + np.arange(width)]


TAGS = 1 + 2 * len(KINDS)  # outside; beginning and inside of each kind


def span_tags(length: int, spans: list[tuple[int, int, str]]) -> np.ndarray:
    """A tag per character; where spans overlap, the earlier one keeps its characters."""
    tags = np.zeros(length, np.int64)
    for start, end, kind in spans:
        if not tags[start:end].any():
            tags[start:end] = 2 + 2 * KINDS.index(kind)
            tags[start] -= 1
    return tags


# --- the tagger -------------------------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Tagger:
    """Parameters by name: embedding, one LSTM each way, emission and transition scores."""

    params: dict[str, np.ndarray]
    sure: float = SURE
    report: dict[str, float] = field(default_factory=dict)

    @classmethod
    def start(cls, hidden: int = HIDDEN, embedded: int = EMBEDDED, seed: int = SEED) -> Tagger:
        rng = np.random.default_rng(seed)

        def draw(*shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        params = {"embed": draw(SYMBOLS, embedded), "out": draw(2 * hidden, TAGS), "out_bias": np.zeros(TAGS, np.float32)}
        for way in ("forth", "back"):
            params |= {f"{way}_x": draw(embedded, 4 * hidden), f"{way}_h": draw(hidden, 4 * hidden)}
            bias = np.zeros(4 * hidden, np.float32)
            bias[hidden : 2 * hidden] = 1  # remember by default
            params[f"{way}_bias"] = bias
        return cls(params | {"moves": np.zeros((TAGS, TAGS), np.float32)})

    def _lstm(self, x: np.ndarray, way: str, keep: bool) -> tuple[np.ndarray, list]:
        """Hidden states (time, rows, hidden) of inputs (time, rows, embedded)."""
        p, hidden = self.params, self.params["forth_h"].shape[0]
        inputs = x @ p[f"{way}_x"] + p[f"{way}_bias"]
        h = c = np.zeros((x.shape[1], hidden), np.float32)
        out, trail = np.empty((len(x), x.shape[1], hidden), np.float32), []
        for t in range(len(x)) if way == "forth" else range(len(x) - 1, -1, -1):
            gates = inputs[t] + h @ p[f"{way}_h"]
            opened = _sigmoid(gates[:, : 3 * hidden])
            new = np.tanh(gates[:, 3 * hidden :])
            i, f, o = opened[:, :hidden], opened[:, hidden : 2 * hidden], opened[:, 2 * hidden :]
            before_h, before_c = h, c
            c = f * c + i * new
            squashed = np.tanh(c)
            h = o * squashed
            out[t] = h
            if keep:
                trail.append((t, i, f, o, new, squashed, before_h, before_c))
        return out, trail

    def _lstm_gradient(self, x: np.ndarray, way: str, trail: list, d_out: np.ndarray, grads: dict) -> np.ndarray:
        p, hidden = self.params, self.params["forth_h"].shape[0]
        d_gates = np.empty((len(x), x.shape[1], 4 * hidden), np.float32)
        dh = dc = np.zeros((x.shape[1], hidden), np.float32)
        grads[f"{way}_h"] = np.zeros_like(p[f"{way}_h"])
        for t, i, f, o, new, squashed, before_h, before_c in reversed(trail):
            dh = dh + d_out[t]
            dc = dc + dh * o * (1 - squashed**2)
            d = d_gates[t]
            d[:, :hidden] = dc * new * i * (1 - i)
            d[:, hidden : 2 * hidden] = dc * before_c * f * (1 - f)
            d[:, 2 * hidden : 3 * hidden] = dh * squashed * o * (1 - o)
            d[:, 3 * hidden :] = dc * i * (1 - new**2)
            grads[f"{way}_h"] += before_h.T @ d
            dh, dc = d @ p[f"{way}_h"].T, dc * f
        flat = d_gates.reshape(-1, 4 * hidden)
        grads[f"{way}_x"] = x.reshape(-1, x.shape[2]).T @ flat
        grads[f"{way}_bias"] = flat.sum(axis=0)
        return d_gates @ p[f"{way}_x"].T

    def emissions(self, windows: np.ndarray, keep: bool = False):
        """Scores (time, rows, tags) of windows (rows, time)."""
        x = self.params["embed"][windows.T]
        sides = [self._lstm(x, way, keep) for way in ("forth", "back")]
        joined = np.concatenate([out for out, _ in sides], axis=2)
        scores = joined @ self.params["out"] + self.params["out_bias"]
        return (scores, x, joined, [trail for _, trail in sides]) if keep else scores

    def marginals(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tag probabilities (time, rows, tags), expected moves between neighbours, and log partition sums.

        Sums are kept in probabilities with a scale per step.
        """
        moves = np.exp(self.params["moves"])
        top = scores.max(axis=2, keepdims=True)
        e = np.exp(scores - top)
        n = len(e)
        a, b = np.empty_like(e), np.empty_like(e)
        scale = np.empty(e.shape[:2], np.float32)
        for t in range(n):
            a[t] = e[t] if t == 0 else e[t] * (a[t - 1] @ moves)
            scale[t] = a[t].sum(axis=1)
            a[t] /= scale[t][:, None]
        b[-1] = 1
        expected = np.zeros_like(moves)
        for t in range(n - 1, 0, -1):
            weighted = e[t] * b[t] / scale[t][:, None]
            expected += moves * (a[t - 1].T @ weighted)
            b[t - 1] = weighted @ moves.T
        return a * b, expected, (np.log(scale) + top[:, :, 0]).sum(axis=0)

    def gradient(self, windows: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of tag rows and its gradient."""
        p, rows = self.params, len(windows)
        scores, x, joined, trails = self.emissions(windows, keep=True)
        likely, moved, log_sum = self.marginals(scores)
        by_time = tags.T
        times, lanes = np.arange(len(by_time))[:, None], np.arange(rows)[None, :]
        gold = scores[times, lanes, by_time].sum() + p["moves"][by_time[:-1], by_time[1:]].sum()
        d_scores = likely
        d_scores[times, lanes, by_time] -= 1
        seen = np.zeros_like(p["moves"])
        np.add.at(seen, (by_time[:-1], by_time[1:]), 1)
        grads = {"moves": moved - seen, "out": joined.reshape(-1, joined.shape[2]).T @ d_scores.reshape(-1, TAGS), "out_bias": d_scores.sum(axis=(0, 1))}
        d_joined = d_scores @ p["out"].T
        hidden = joined.shape[2] // 2
        dx = sum(
            self._lstm_gradient(x, way, trail, d_joined[:, :, k * hidden : (k + 1) * hidden], grads)
            for k, (way, trail) in enumerate(zip(("forth", "back"), trails))
        )
        grads["embed"] = np.zeros_like(p["embed"])
        np.add.at(grads["embed"], windows.T, dx)
        return float(log_sum.sum() - gold) / rows, {k: g / rows for k, g in grads.items()}

    def fit(self, windows: np.ndarray, tags: np.ndarray, epochs: int = EPOCHS, batch: int = BATCH, rate: float = 0.02, seed: int = SEED) -> float:
        """Adam over shuffled batches; the last epoch's mean loss."""
        rng = np.random.default_rng(seed)
        first, second = ({k: np.zeros_like(v) for k, v in self.params.items()} for _ in range(2))
        step, loss = 0, 0.0
        for epoch in range(epochs):
            losses = []
            order = rng.permutation(len(windows))
            for at in range(0, len(order), batch):
                chosen = order[at : at + batch]
                value, grads = self.gradient(windows[chosen], tags[chosen])
                losses.append(value)
                step += 1
                norm = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
                for k, g in grads.items():
                    g = g * min(1.0, 5.0 / (norm + 1e-9))
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    pace = rate * (1 - epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                    self.params[k] = (self.params[k] - pace * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32)
            loss = float(np.mean(losses)) if losses else 0.0
        return loss

    def decode(self, windows: np.ndarray, rows: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """The best tag row of each window by Viterbi's recursion, and every tag's probability."""
        best, sure = np.empty(windows.shape, np.int8), np.empty(windows.shape, np.float32)
        for at in range(0, len(windows), rows):
            scores = self.emissions(windows[at : at + rows])
            likely, _, _ = self.marginals(scores)
            n, lanes = len(scores), np.arange(scores.shape[1])
            total, back = scores[0], []
            for t in range(1, n):
                ways = total[:, :, None] + self.params["moves"]
                back.append(ways.argmax(axis=1))
                total = ways.max(axis=1) + scores[t]
            tag = total.argmax(axis=1)
            for t in range(n - 1, -1, -1):
                best[at : at + rows, t], sure[at : at + rows, t] = tag, likely[t, lanes, tag]
                if t:
                    tag = back[t - 1][lanes, tag]
        return best, sure


def reconcile(length: int, runs: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """A tag and a probability for every character of a text from its windows (starts, tags, probabilities): the most central one decides."""
    out, odds, best = np.zeros(length, np.int8), np.ones(length, np.float32), np.full(length, -1, np.int16)
    for starts, tags, sure in runs:
        width = tags.shape[1]
        centre = np.minimum(np.arange(width), np.arange(width)[::-1])
        for start, row, chance in zip(starts.tolist(), tags, sure):
            low, high = max(0, -start), min(width, length - start)
            part = slice(start + low, start + high)
            better = centre[low:high] > best[part]
            best[part] = np.where(better, centre[low:high], best[part])
            out[part] = np.where(better, row[low:high], out[part])
            odds[part] = np.where(better, chance[low:high], odds[part])
    return out, odds


_AT, _DOT = r"(?: ?@ ?| ?[(\[{]at[)\]}] ?| at )", r"(?:\.| ?[(\[{]dot[)\]}] ?| dot | \. )"
_SHAPES = {
    "email": re.compile(rf"[A-Za-z0-9._%+-]+{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]{1,3}(?:(?: ?\. ?|[(\[{]\.[)\]}])[0-9]{1,3}){3}"),
    "card": re.compile(r"[0-9](?:[ ./_\n-]{0,3}[0-9]){12,18}"),
    "phone": re.compile(r"(?:\+ ?|00 ?)\(?[0-9](?:[ ()./-]{0,3}[0-9]){9,16}"),
}


def has_shape(kind: str, text: str, start: int, end: int) -> bool:
    """Whether a tagged stretch has the kind's loose shape and adds up as the pattern's spans do."""
    if not _SHAPES[kind].fullmatch(text, start, end):
        return False
    digits = _NOT_DIGIT.sub("", text[start:end])
    if kind == "ip":
        return all(int(part) <= 255 for part in re.findall("[0-9]+", text[start:end]))
    if kind == "card":
        return luhn(digits)
    return kind == "email" or 10 <= len(digits.removeprefix("00")) <= 15


def tagged_spans(text: str, tags: np.ndarray, odds: np.ndarray, sure: float = SURE) -> list[tuple[int, int, str]]:
    """Runs of one kind's tags whose characters are probable enough on average and which have the kind's loose shape."""
    spans, at = [], 0
    kinds = (tags.astype(np.int64) + 1) // 2
    edges = np.flatnonzero(np.diff(np.concatenate([[0], kinds, [0]])))
    for start, end in zip(edges[:-1].tolist(), edges[1:].tolist()):
        kind = int(kinds[start])
        if not kind:
            continue
        while start < end and text[start].isspace():
            start += 1
        while end > start and text[end - 1].isspace():
            end -= 1
        if start >= at and end > start and odds[start:end].mean() >= sure and has_shape(KINDS[kind - 1], text, start, end):
            spans.append((start, end, KINDS[kind - 1]))
            at = end
    return spans


def all_spans(texts: list[str], tagger: Tagger | None) -> list[tuple[list, list]]:
    """For each text its pattern spans, and these with the tagger's that overlap none of them."""
    base = [base_spans(text) for text in texts]
    if tagger is None:
        return [(own, own) for own in base]
    codes = [char_codes(text) if _TRIGGER.search(text) else np.zeros(0, np.uint8) for text in texts]
    starts = [window_starts(text, c) for text, c in zip(texts, codes)]
    # Windows of many texts are decoded together, those of a very long one in runs.
    short = [len(s) <= RUN for s in starts]
    some = [cut_windows(c, s) for c, s, whole in zip(codes, starts, short) if whole and len(s)]
    tags, odds = tagger.decode(np.concatenate(some)) if some else (None, None)
    out, at = [], 0
    for text, own, c, s, whole in zip(texts, base, codes, starts, short):
        if not len(s):
            out.append((own, own))
            continue
        if whole:
            runs = [(s, tags[at : at + len(s)], odds[at : at + len(s)])]
            at += len(s)
        else:
            runs = ((part, *tagger.decode(cut_windows(c, part))) for part in (s[k : k + RUN] for k in range(0, len(s), RUN)))
        more = tagged_spans(text, *reconcile(len(c), runs), tagger.sure)
        added = [span for span in more if not any(span[0] < e and span[1] > st for st, e, _ in own)]
        out.append((own, sorted(own + added, key=lambda x: (x[0], KINDS.index(x[2])))))
    return out


# --- labelled spans, rewritten ----------------------------------------------------------------------


def rewritten(kind: str, span: str, turn: int) -> str:
    """A labelled span in another form of the same kind that the patterns leave out; ``turn`` chooses the form."""
    if kind == "email":
        at = (" @ ", " at ", "(at)", " [at] ", "@ ", " (at) ")[turn % 6]
        name, host = span.split("@", 1)
        return name + at + host.replace(".", (".", " dot ", ".", " [dot] ", ".", " (dot) ")[turn % 6])
    if kind == "ip":
        return span.replace(".", (" . ", "[.]", ". ", "(.)")[turn % 4])
    if kind == "card":
        digits = _NOT_DIGIT.sub("", span)
        return (".", "/", "  ", " - ", "\n", "_")[turn % 6].join(digits[i : i + 4] for i in range(0, len(digits), 4))
    return ("00", "+ ", "00 ")[turn % 3] + span[1:].replace(" ", "/" if turn % 2 else " ")


def with_rewritten_spans(text: str, spans: list[tuple[int, int, str]], turn: int) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with every labelled span rewritten, and where the spans are now; of overlapping spans the first one."""
    parts, out, at, length = [], [], 0, 0
    for k, (start, end, kind) in enumerate(spans):
        if start < at:
            continue
        new = rewritten(kind, text[start:end], turn + k)
        parts += [text[at:start], new]
        length += start - at
        out.append((length, length + len(new), kind))
        length, at = length + len(new), end
    return "".join([*parts, text[at:]]), out


# --- the operator -----------------------------------------------------------------------------------

_WINDOW_ROWS = "codes array<int>, tags array<int>, sort string"


def _labelled(text: str, spans: list[tuple[int, int, str]]) -> Iterator[tuple[list[int], list[int]]]:
    codes = char_codes(text)
    starts = window_starts(text, codes)
    tags = np.concatenate([np.zeros(WIDTH, np.int64), span_tags(len(codes), spans), np.zeros(WIDTH, np.int64)])
    own = tags[(starts + WIDTH)[:, None] + np.arange(WIDTH)]
    yield from zip(cut_windows(codes, starts).tolist(), own.tolist())


def _training_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        rows: list[tuple[list[int], list[int], str]] = []
        for text in batch.column("text").to_pylist():
            if not _TRIGGER.search(text):
                continue
            spans = base_spans(text)
            rows += [(c, t, "span" if any(t) else "none") for c, t in _labelled(text, spans)]
            if spans:
                other = with_rewritten_spans(text, spans, zlib.crc32(text.encode("utf-8", "replace")))
                rows += [(c, t, "rewritten") for c, t in _labelled(*other) if any(t)]
        codes, tags, sorts = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(codes, pa.list_(pa.int32())), pa.array(tags, pa.list_(pa.int32())), pa.array(sorts, pa.string())], ["codes", "tags", "sort"]
        )


def window_spans(codes: np.ndarray, tags: np.ndarray, odds: np.ndarray, sure: float) -> set[tuple[int, int, str]]:
    """Spans of one window that do not touch its edges, as :func:`tagged_spans` finds them."""
    text = "".join("\0" if c == 0 else " " if c == 1 else chr(c + 30) for c in codes.tolist())
    return {span for span in tagged_spans(text, tags, odds, sure) if 0 < span[0] and span[1] < len(text)}


def held_out_report(tagger: Tagger, codes: np.ndarray, tags: np.ndarray) -> dict[str, float]:
    """Threshold, precision and recall of spans on windows that the tagger has not learnt from.

    The threshold is the lowest with a precision of ``PRECISION`` at least. Spans at a window's edge are not counted.
    """
    best, odds = tagger.decode(codes)
    sure_of_all = np.ones(codes.shape[1], np.float32)
    wanted = [window_spans(c, t, sure_of_all, 0.0) for c, t in zip(codes, tags)]
    report = {"sure": SURE, "precision": float("nan"), "recall": 0.0}
    for sure in (0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.93, 0.95, 0.97, 0.98, 0.99):
        found = [window_spans(c, t, o, sure) for c, t, o in zip(codes, best, odds)]
        n = sum(map(len, found))
        right = sum(len(a & b) for a, b in zip(found, wanted))
        if n and right >= PRECISION * n:
            return {"sure": sure, "precision": right / n, "recall": right / max(1, sum(map(len, wanted)))}
    return report


def fit_tagger(docs: DataFrame, most: int = MAX_WINDOWS, epochs: int = EPOCHS) -> Tagger | None:
    """A tagger fitted on about ``most`` windows of ``docs`` ``<text>``, chosen by a hash; none without spans.

    Half of the windows have rewritten spans, a quarter spans as they are, and a quarter none. Every ``HELD_OUT``-th is kept for the threshold.
    """
    windows = stage(docs.mapInArrow(_training_windows, _WINDOW_ROWS), "windows")
    bound, chosen = 1 << 30, []
    totals = {r["sort"]: r["n"] for r in windows.groupBy("sort").agg(F.count("*").alias("n")).collect()}
    if not totals.get("span"):
        return None
    for sort, n in sorted(totals.items()):
        share = min(1.0, most * (0.5 if sort == "rewritten" else 0.25) / n)
        part = windows.where((F.col("sort") == sort) & (F.pmod(F.xxhash64(F.lit(5), "codes"), F.lit(bound)) < int(share * bound)))
        # Equal windows have equal hashes: a window that is repeated everywhere is taken once.
        chosen.append(part.select("codes", "tags").distinct())
    rows = sorted((r["codes"], r["tags"]) for part in chosen for r in part.collect())
    drop_staged(windows)
    if not rows:
        return None
    return learned(np.array([c for c, _ in rows], np.uint8), np.array([t for _, t in rows]), epochs)


def learned(codes: np.ndarray, tags: np.ndarray, epochs: int = EPOCHS) -> Tagger:
    """A tagger fitted on labelled windows, but for those held out, on which its threshold is chosen."""
    order = np.random.default_rng(SEED).permutation(len(codes))
    out = np.zeros(len(codes), bool)
    out[order[::HELD_OUT]] = len(codes) > HELD_OUT
    tagger = Tagger.start()
    tagger.fit(codes[~out], tags[~out], epochs)
    if out.any():
        tagger.report = held_out_report(tagger, codes[out], tags[out])
        tagger.sure = tagger.report["sure"]
    return tagger


def _find(tagger: Tagger | None, extra: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = all_spans(batch.column("text").to_pylist(), tagger)
            lists = [[[{"start": a, "end": b, "kind": k} for a, b, k in spans] for spans in side] for side in zip(*found)]
            columns = [pa.array(side, pa.list_(_SPAN)) for side in lists]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in extra], *columns], [*extra, "base", "spans"])

    return run


_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())])
_SPANS = "array<struct<start: int, end: int, kind: string>>"


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_windows: int = MAX_WINDOWS) -> DataFrame:
    """``<id, base, spans>`` of every row: the patterns' spans, and these with the tagger's, in code points.

    The tagger learns from about ``max_windows`` windows of the same table. Null texts count as empty; rows with null or repeated ids stay; an
    empty table, or one without any labelled span, has pattern spans only. Other columns are ignored. Nothing is shuffled but
    the training windows.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    tagger = fit_tagger(docs.select(text), max_windows)
    narrow = docs.select(F.col(id_col).cast("bigint").alias("id"), text)
    return narrow.mapInArrow(_find(tagger, ["id"]), f"id bigint, base {_SPANS}, spans {_SPANS}")


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with every span replaced by its kind in brackets; of overlapping spans the first names them all."""
    out, at, until = [], 0, 0
    for start, end, kind in spans:
        if start >= until:
            out += [text[at:start], f"[{kind.upper()}]"]
        until = at = max(until, end)
    return "".join([*out, text[at:]])


def redact_pii(docs: DataFrame, text_col: str = "text", max_windows: int = MAX_WINDOWS) -> DataFrame:
    """``docs`` with all spans in ``text_col`` replaced by ``[EMAIL]``, ``[IP]``, ``[CARD]`` or ``[PHONE]``; a null text stays null."""
    tagger = fit_tagger(docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")), max_windows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            texts = batch.column(text_col).to_pylist()
            found = all_spans([text or "" for text in texts], tagger)
            clean = [text and redact(text, spans) for text, (_, spans) in zip(texts, found)]
            at = batch.schema.get_field_index(text_col)
            yield batch.set_column(at, batch.schema.field(at), pa.array(clean, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def _number(kind: str) -> Column:
    return F.size(F.filter("base", lambda span: span["kind"] == kind)).cast("bigint")


def _listed(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    counts = [_number(kind).alias(f"n_{kind}") for kind in KINDS]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("spans").alias("spans"))
