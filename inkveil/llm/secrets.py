"""Secret scan: patterns, and a character convolutional network over every further candidate.

Three patterns give the base findings. A candidate is any run of MIN_RUN or more of the characters that a labelled
value may have, of any length, with digits or without: a value of a base finding always lies in one. The network
reads all of it, in windows of BODY characters that overlap by half, each with the characters on either side of the
run (one convolution, the maximum over places, a dense layer; numpy); the run's score is the highest of its windows.
It is trained on findings of five kinds: runs that hold the value of a base finding;
the same values without their label and quotes, as if they stood bare in the text, so that the network learns the
value and not the label beside it; other runs with a digit, those with a capital behind their first letter, and the
plain rest (of runs up to FITTED windows long; longer ones are only scored). A value that does not mix letters and digits has no bare twin, for without
its label nothing tells it from a word.

All findings of the first two kinds are fitted. The loss is a squared hinge, so that a run beyond the margin adds nothing
to it. A network fitted to SAMPLE runs of each other kind, from about BEGUN texts, is only the beginning: it then scores every
run of every text, and all runs inside the margin join the fit, which goes on with them. The fit is spread over tasks, which
go through their findings from common weights and hand on weights that are averaged after each time.
The scores are calibrated on findings left out of training, a value and its twin together (Platt; the scale changes no
order, so it decides nothing), and the threshold is the highest that keeps RECALL of all left-out positives, labelled and bare.

In scoring, the convolution runs once over the characters of a text, and every run takes the maximum over its places.

Texts are scanned whole by narrow jobs; the model (a few thousand numbers) goes to every task. Positions are code points.

Defined results: a null text is empty; without enough labelled findings of both kinds the base findings stand
alone; rows are judged one by one, repeated ones alike; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import stored

KINDS = ("assign", "access", "hex")
SAMPLE = 3000  # other runs of each kind that the fit begins with
LABELLED, BARE, WITH_DIGIT, WITH_CAPITAL, PLAIN = KINDS_OF_RUN = range(5)
MIN_LABELLED = 50
RECALL = 0.98
MIN_RUN = 8  # as in an assigned value
BEFORE, BODY, AFTER = 24, 32, 8
FITTED = 32
WIDTH = BEFORE + BODY + AFTER
FILTERS, SPAN, EMBED = 24, 5, 12
SHORT = BODY - SPAN + 1  # up to here the end of a run and its padding fill places of their own
TOGETHER = 1 << 20  # characters of texts that are encoded at once
BLOCK = 1 << 12  # characters whose places are computed at once
EPOCHS, MORE, BATCH, STEP = 12, 4, 128, 0.004  # times through the findings: at the beginning, and with the runs inside the margin
MARGIN = 1.0
BEGUN = 20_000  # texts whose other runs the fit begins with
FITTED_ROWS, KEPT = 1 << 15, 1 << 12  # findings a task fits; and holds before it hands them on
BINS = 256  # steps of a logit in which left-out findings are counted

_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
# A shorter match would be dropped, and no other one begins inside it.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_LABELS = ("passw", "secret", "token", "api")  # one of them begins every assignment
_DIGIT, _LETTER, _CAPITAL = re.compile("[0-9]"), re.compile("[A-Za-z]"), re.compile("[A-Z]")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % MIN_RUN)  # greedy, so whole runs

Span = tuple[int, int, int]  # start, kind, end


def base_findings(text: str | None) -> list[Span]:
    text = text or ""
    lower, found = text.lower(), []
    if any(label in lower for label in _LABELS):
        found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[1]) >= MIN_RUN]
    for kind, pattern in ((1, _ACCESS), (2, _HEX)):
        found += [(m.start(), kind, m.end()) for m in pattern.finditer(text)]
    return sorted(found)


def candidates(text: str | None, base: list[Span]) -> list[tuple[int, int, bool]]:
    """(start, end, whether a base finding covers it) of every candidate."""
    out, at, reach = [], 0, -1
    for m in _CANDIDATE.finditer(text or ""):
        while at < len(base) and base[at][0] <= m.start():
            reach = max(reach, base[at][2])
            at += 1
        inside = reach > m.start() or (at < len(base) and base[at][0] < m.end())
        out.append((m.start(), m.end(), inside))
    return out


def values(text: str, base: list[Span]) -> list[tuple[int, int, int]]:
    """(start of the finding, start and end of its value) of the base findings that lie in no earlier one."""
    out, reach = [], 0
    for start, kind, end in base:
        if start >= reach:
            out.append((start, _ASSIGN.match(text, start).start(1) if kind == 0 else start, end))
        reach = max(reach, end)
    return out


def window_starts(length: int) -> list[int]:
    """Where the windows of a run begin; the last one ends with the run."""
    return [*range(0, length - BODY, BODY // 2), max(length - BODY, 0)]


def encoded(text: str, start: int, end: int) -> np.ndarray:
    """A row of WIDTH character numbers per window: context before, characters of the run, context after; 0 where there is none."""
    before = text[max(0, start - BEFORE) : start].rjust(BEFORE, "\0")
    after = text[end : end + AFTER].ljust(AFTER, "\0")
    rows = [before + text[a : min(end, a + BODY)].ljust(BODY, "\0") + after for a in (start + k for k in window_starts(end - start))]
    codes = np.frombuffer("".join(rows).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, WIDTH)
    return np.where(codes < 127, codes, 127).astype(np.uint8)


@dataclass
class Network:
    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    dense: np.ndarray
    scale: tuple[float, float] = (1.0, 0.0)
    threshold: float = 2.0

    def _hidden(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        windows = np.lib.stride_tricks.sliding_window_view(self.embed[x], SPAN, axis=1)  # rows, places, EMBED, SPAN
        flat = windows.reshape(len(x), WIDTH - SPAN + 1, EMBED * SPAN)
        maps = flat @ self.filters + self.bias
        return flat, maps, np.maximum(maps.max(axis=1), 0)

    def logits(self, x: np.ndarray) -> np.ndarray:
        # Embedding and filter are one table a place of the span: what a character adds to each filter.
        tables = np.einsum("ce,esf->scf", self.embed, self.filters.reshape(EMBED, SPAN, FILTERS)).astype(np.float32)
        places, out = WIDTH - SPAN + 1, np.zeros(len(x))
        for i in range(0, len(x), 256):
            part = x[i : i + 256]
            maps = tables[0][part[:, :places]]
            for k in range(1, SPAN):
                maps += tables[k][part[:, k : k + places]]
            out[i : i + 256] = np.maximum(maps.max(axis=1) + self.bias, 0) @ self.dense[:-1] + self.dense[-1]
        return out

    def short_logits(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """As ``run_logits`` for runs of up to SHORT characters at rising places of ``codes``, which has BEFORE zeros around each text."""
        tables = np.einsum("ce,esf->scf", self.embed, self.filters.reshape(EMBED, SPAN, FILTERS)).astype(np.float32)

        def maps(x: np.ndarray) -> np.ndarray:
            places = x.shape[-1] - SPAN + 1
            total = tables[0].take(x[..., :places], axis=0)
            for k in range(1, SPAN):
                total += tables[k].take(x[..., k : k + places], axis=0)
            return total

        def widened(m: np.ndarray, by: int) -> np.ndarray:
            return np.maximum(m[:-by], m[by:])

        padding = maps(np.zeros(SPAN, np.uint8))[0]
        out, i = np.zeros(len(starts)), 0
        while i < len(starts):
            j = max(int(np.searchsorted(ends, starts[i] + BLOCK)), i + 1)
            low = starts[i] - BEFORE
            a, b = starts[i:j] - low, ends[i:j] - low
            part = codes[low : low + b[-1] + AFTER]
            four = widened(widened(maps(part), 1), 2)
            sixteen = widened(widened(four, 4), 8)
            # Places from the first character before the run to the last one that the run fills: 28 to 48 of them.
            first, last = a - BEFORE, b - SPAN - 15
            best = np.maximum(np.maximum(sixteen[first], sixteen[np.minimum(first + 16, last)]), sixteen[last])
            best = np.maximum(best, four[b])  # the places after the run
            tail = np.zeros((j - i, 3 * (SPAN - 1)), np.uint8)  # the end of the run, padding, the beginning of what comes after
            for k in range(SPAN - 1):
                tail[:, k] = part[b - SPAN + 1 + k]
                tail[:, 2 * (SPAN - 1) + k] = part[b + k]
            best = np.maximum(best, maps(tail).max(axis=1))
            best[b - a < SHORT] = np.maximum(best[b - a < SHORT], padding)
            out[i:j] = np.maximum(best + self.bias, 0) @ self.dense[:-1] + self.dense[-1]
            i = j
        return out

    def run_logits(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The highest logit of each run, whose windows lie together; ``counts``: windows of each."""
        return np.maximum.reduceat(self.logits(x), np.cumsum(counts) - counts) if len(counts) else np.zeros(0)

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * logits + self.scale[1], -40, 40)))


NAMES = ("embed", "filters", "bias", "dense")


@dataclass
class Fit:
    """A network on its way, with the moments of Adam."""

    net: Network
    mean: dict[str, np.ndarray]
    square: dict[str, np.ndarray]
    turn: int = 0

    def vector(self) -> np.ndarray:
        return np.concatenate([part[n].ravel() for part in (vars(self.net), self.mean, self.square) for n in NAMES])

    def with_vector(self, values: np.ndarray, turn: int) -> Fit:
        parts, at = [], 0
        for _ in range(3):
            part = {}
            for n in NAMES:
                shape = getattr(self.net, n).shape
                part[n] = values[at : at + int(np.prod(shape))].reshape(shape).copy()
                at += part[n].size
            parts.append(part)
        return Fit(Network(**parts[0]), parts[1], parts[2], turn)


def beginning(seed: int = 7) -> Fit:
    rng = np.random.default_rng(seed)
    net = Network(rng.normal(0, 0.3, (128, EMBED)), rng.normal(0, 0.2, (EMBED * SPAN, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.2, FILTERS + 1))
    return Fit(net, {n: np.zeros_like(getattr(net, n)) for n in NAMES}, {n: np.zeros_like(getattr(net, n)) for n in NAMES})


def go_through(fit: Fit, x: np.ndarray, y: np.ndarray, order: np.ndarray) -> None:
    """Adam on the squared hinge loss with gradients written out, once through the rows."""
    net = fit.net
    for at in range(0, len(x), BATCH):
        rows = order[at : at + BATCH]
        flat, maps, hidden = net._hidden(x[rows])
        z = hidden @ net.dense[:-1] + net.dense[-1]
        error = np.where(y[rows] > 0, -np.maximum(MARGIN - z, 0), np.maximum(MARGIN + z, 0)) / len(rows)
        to_hidden = np.outer(error, net.dense[:-1]) * (hidden > 0)
        best = maps.argmax(axis=1)  # rows, filters
        picked = flat[np.arange(len(rows))[:, None], best]  # rows, filters, EMBED * SPAN
        to_flat = to_hidden[:, :, None] * net.filters.T[None]  # gradient of the picked windows
        to_embed = np.zeros_like(net.embed)
        cells = x[rows][np.arange(len(rows))[:, None, None], best[:, :, None] + np.arange(SPAN)]
        np.add.at(to_embed, cells, to_flat.reshape(len(rows), FILTERS, EMBED, SPAN).transpose(0, 1, 3, 2))
        gradient = {
            "embed": to_embed, "filters": np.einsum("rf,rfe->ef", to_hidden, picked), "bias": to_hidden.sum(axis=0),
            "dense": np.append(hidden.T @ error, error.sum()),
        }
        fit.turn += 1
        for n in NAMES:
            fit.mean[n] = 0.9 * fit.mean[n] + 0.1 * gradient[n]
            fit.square[n] = 0.999 * fit.square[n] + 0.001 * gradient[n] ** 2
            step = fit.mean[n] / (1 - 0.9**fit.turn) / (np.sqrt(fit.square[n] / (1 - 0.999**fit.turn)) + 1e-8)
            setattr(net, n, getattr(net, n) - STEP * step)


def train(x: np.ndarray, y: np.ndarray, seed: int = 7) -> Network:
    """A network fitted to rows in memory."""
    fit, rng = beginning(seed), np.random.default_rng(seed)
    for _ in range(EPOCHS):
        go_through(fit, x, y, rng.permutation(len(x)))
    return fit.net


def calibrate(net: Network, logits: np.ndarray, y: np.ndarray, counts: np.ndarray) -> None:
    """Fit the scale of the runs' logits by Newton steps, then the threshold by the recall asked for. ``counts``: runs at each."""
    z, w, good = np.clip(logits, -30, 30), np.array([1.0, 0.0]), y > 0
    n, m = counts[good].sum(), counts[~good].sum()
    target = np.where(good, (n + 1) / (n + 2), 1 / (m + 2))
    a = np.stack([z, np.ones_like(z)], axis=1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        curve = (a * (counts * (p * (1 - p) + 1e-6))[:, None]).T @ a + 1e-3 * np.eye(2)
        w = w - np.clip(np.linalg.solve(curve, a.T @ (counts * (p - target))), -1, 1)
    net.scale = (float(max(w[0], 1e-3)), float(w[1]))
    order = np.argsort(logits[good])
    upto = np.cumsum(counts[good][order])  # positives up to each logit
    lost = int((1 - RECALL) * n + 1e-9)  # so many may lie below the threshold
    net.threshold = float(net.probabilities(logits[good][order][np.searchsorted(upto, lost, side="right")]))


def _draw(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), digest_size=7).digest(), "little")


def _kind(text: str, start: int, end: int) -> int:
    """The kind of a run that holds no value."""
    return WITH_DIGIT if _DIGIT.search(text, start, end) else WITH_CAPITAL if _CAPITAL.search(text, start + 1, end) else PLAIN


def _other(text: str, start: int, end: int) -> int:
    """The draw of a run that holds no value."""
    return _draw(text[max(0, start - BEFORE) : start], text[start:end], text[end : end + AFTER])


def _fits(start: int, end: int) -> bool:
    return end - start <= BODY + (FITTED - 1) * (BODY // 2)


def _table(found: dict[tuple[int, int], bytes]) -> pd.DataFrame:
    return pd.DataFrame([(x, kind, draw) for (kind, draw), x in sorted(found.items())], columns=["x", "kind", "draw"])


def _labelled(batches: Iterator[pd.DataFrame], share: int = 1) -> Iterator[pd.DataFrame]:
    """All findings that hold values, and of one in ``share`` texts the SAMPLE runs of each other kind with the lowest hashes;
    equal values and equal other runs of a portion count once."""
    lowest: list[dict[int, bytes]] = [{} for _ in KINDS_OF_RUN]
    bound = [2**63] * len(KINDS_OF_RUN)
    held: dict[tuple[int, int], bytes] = {}

    def offer(kind: int, draw: int, text: str, start: int, end: int) -> None:
        if draw >= bound[kind] or not _fits(start, end):
            return
        kept = lowest[kind]
        x = encoded(text, start, end).tobytes()
        kept[draw] = min(x, kept.get(draw, x))
        if len(kept) > 2 * SAMPLE:
            lowest[kind] = dict(sorted(kept.items())[:SAMPLE])
            bound[kind] = max(lowest[kind]) + 1

    def hold(kind: int, draw: int, text: str, start: int, end: int) -> None:
        if _fits(start, end):
            x = encoded(text, start, end).tobytes()
            held[kind, draw] = min(x, held.get((kind, draw), x))

    for batch in batches:
        for text in batch["text"]:
            base = base_findings(text)
            begun = share == 1 or zlib.crc32((text or "").encode("utf-8", "surrogatepass")) % share == 0
            runs = candidates(text, base) if base or begun else []
            for start, end, inside in runs if begun else ():
                if not inside:
                    offer(_kind(text, start, end), _other(text, start, end), text, start, end)
            begins = [r[0] for r in runs]
            for finding, a, b in values(text, base) if base else ():
                draw, (start, end, _) = _draw(text[a:b]), runs[bisect_right(begins, a) - 1]
                hold(LABELLED, draw, text, start, end)
                if _DIGIT.search(text, a, b) and _LETTER.search(text, a, b):
                    before, after = text[max(0, finding - BEFORE) : finding], text[b : b + AFTER + 1].removeprefix('"').removeprefix("'")
                    hold(BARE, draw, before + text[a:b] + after, len(before), len(before) + b - a)
            if len(held) >= KEPT:
                yield _table(held)
                held.clear()
    yield _table(held | {(kind, draw): x for kind, kept in enumerate(lowest) for draw, x in sorted(kept.items())[:SAMPLE]})


_FOUND = "x binary, kind int, draw long"


def _once(found: DataFrame, name: str) -> DataFrame:
    # Equal findings count once, or copied documents would leak from training into calibration.
    return stored(found.groupBy("kind", "draw").agg(F.min("x").alias("x")).select("x", "kind", "draw"), name)


def inside_margin(docs: DataFrame, net: Network) -> DataFrame:
    """Every run of ``docs`` without a value that ``net`` does not leave beyond the margin: x, kind, draw."""
    bare = replace(net, scale=(1.0, 0.0), threshold=float(1 / (1 + np.exp(MARGIN))))
    shared = docs.sparkSession.sparkContext.broadcast(bare)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, int], bytes] = {}
        for batch in batches:
            texts = batch["text"].array
            asked = [(i, a, b) for i, t in enumerate(texts) for a, b, inside in candidates(t, base_findings(t)) if not inside]
            for i, a, b in _scored(shared.value, texts, asked):
                if _fits(a, b):
                    x, name = encoded(texts[i], a, b).tobytes(), (_kind(texts[i], a, b), _other(texts[i], a, b))
                    held[name] = min(x, held.get(name, x))
            if len(held) >= KEPT:
                yield _table(held)
                held.clear()
        yield _table(held)

    return docs.select("text").mapInPandas(run, _FOUND)


def _windows(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of the findings, whether each is positive, and the windows of each finding."""
    windows = [np.frombuffer(x, np.uint8).reshape(-1, WIDTH) for x in batch["x"]]
    counts = np.array([len(x) for x in windows])
    return np.concatenate(windows), np.repeat((batch["kind"] <= BARE).to_numpy(float), counts), counts


def fitted(fit: Fit, found: DataFrame, times: int) -> Fit:
    """``fit`` after so many times through the findings: every task goes through its own, and the weights are averaged."""
    tasks = -(-found.count() // FITTED_ROWS)
    place = F.xxhash64("draw", "kind")  # the order of draws is that of choosing them
    dealt = found.repartition(tasks).sortWithinPartitions(place, "draw", "kind")
    for _ in range(times):
        shared = found.sparkSession.sparkContext.broadcast(fit)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own = shared.value.with_vector(shared.value.vector(), shared.value.turn)  # noqa: B023
            rng, n = np.random.default_rng(own.turn), 0
            for batch in batches:
                if len(batch):
                    x, y, _ = _windows(batch)
                    go_through(own, x, y, rng.permutation(len(x)))
                    n += len(x)
            if n:
                yield pd.DataFrame({"n": [n], "turn": [own.turn], "state": [own.vector().tobytes()]})

        rows = sorted(dealt.mapInPandas(run, "n long, turn int, state binary").collect())
        states = np.array([np.frombuffer(r["state"]) for r in rows])
        fit = fit.with_vector(np.average(states, axis=0, weights=[r["n"] for r in rows]), max(r["turn"] for r in rows))
    return fit


def _counted(net: Network, found: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The logits of the findings in steps (rounded down, at most 40 from 0), whether they are positive, and how many there are."""
    shared = found.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x, _, counts = _windows(batch)
                at = np.floor(np.clip(shared.value.run_logits(x, counts), -40, 40) * BINS).astype(int)
                yield pd.DataFrame({"good": (batch["kind"] <= BARE).to_numpy(), "at": at})

    rows = found.mapInPandas(run, "good boolean, at int").groupBy("good", "at").count().collect()
    return np.array([r["at"] / BINS for r in rows]), np.array([float(r["good"]) for r in rows]), np.array([r["count"] for r in rows])


def _first(docs: DataFrame, share: int) -> DataFrame:
    """All findings that hold values, and the SAMPLE runs of each other kind with the lowest hashes, of one in ``share`` texts."""
    found = _once(docs.select("text").mapInPandas(partial(_labelled, share=share), _FOUND), "secret-findings")
    first = found.where(F.col("kind") <= BARE)
    for kind in (WITH_DIGIT, WITH_CAPITAL, PLAIN):
        first = first.union(found.where(F.col("kind") == kind).orderBy("draw").limit(SAMPLE))
    return stored(first, "secret-first")


def learn(docs: DataFrame) -> Network | None:
    """A network from the labelled findings of ``docs``; None where there are too few."""
    left_out = F.col("draw") % 4 == 0  # a value and its twin fall on the same side
    share = max(1, docs.count() // BEGUN)
    for one_in in sorted({share, 1}, reverse=True):
        first = _first(docs, one_in)
        kinds = first.groupBy("kind", left_out.alias("out")).count().collect()
        labelled = sum(r["count"] for r in kinds if r["kind"] == LABELLED)
        others = sum(r["count"] for r in kinds if r["kind"] > BARE)
        if labelled < MIN_LABELLED or others >= MIN_LABELLED:
            break  # else the other runs of all texts are wanted
    if min(labelled, others) < MIN_LABELLED or len({(r["kind"] <= BARE, r["out"]) for r in kinds}) < 4:
        return None
    fit = fitted(beginning(), first.where(~left_out), EPOCHS)
    every = _once(first.union(inside_margin(docs, fit.net)), "secret-every")
    net = fitted(fit, every.where(~left_out), MORE).net
    calibrate(net, *_counted(net, every.where(left_out)))
    return net


def _scored(model: Network, texts: list[str], asked: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
    """Those of the runs (text, start, end) that reach the threshold."""
    def told(part: list[tuple[int, int, int]], windows: list[np.ndarray]) -> list[tuple[int, int, int]]:
        logits = model.run_logits(np.concatenate(windows), np.array([len(x) for x in windows]))
        return [run for run, p in zip(part, model.probabilities(logits)) if p >= model.threshold]

    def together(group: list[int]) -> list[tuple[int, int, int]]:
        edge = "\0" * BEFORE
        codes = np.minimum(np.frombuffer(edge.join(["", *(texts[i] for i in group), ""]).encode("utf-32-le", "surrogatepass"), np.uint32), 127)
        runs = np.array([(n, a, b) for n, i in enumerate(group) for a, b in short[i]])
        shift = np.cumsum([BEFORE] + [len(texts[i]) + BEFORE for i in group])[runs[:, 0]]
        logits = model.short_logits(codes.astype(np.uint8), runs[:, 1] + shift, runs[:, 2] + shift)
        hits = runs[model.probabilities(logits) >= model.threshold]
        return [(group[n], a, b) for n, a, b in hits.tolist()]

    short: dict[int, list[tuple[int, int]]] = {}
    for i, start, end in asked:
        if end - start <= SHORT:
            short.setdefault(i, []).append((start, end))
    group, size = [], 0
    for i in short:
        group.append(i)
        size += len(texts[i])
        if size >= TOGETHER:
            yield from together(group)
            group, size = [], 0
    if group:
        yield from together(group)

    part, windows, size = [], [], 0
    for run in asked:
        if run[2] - run[1] <= SHORT:
            continue
        part.append(run)
        windows.append(encoded(texts[run[0]], run[1], run[2]))
        size += len(windows[-1])
        if size >= 4096:
            yield from told(part, windows)
            part, windows, size = [], [], 0
    if part:
        yield from told(part, windows)


def _text(spans: list[Span]) -> str:
    names = (*KINDS, "key")
    return ",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scan(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_key, masked (the text without its secrets)."""
    net = net or learn(docs)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for batch in batches:
            found = [base_findings(t) for t in batch["text"]]
            more: list[list[Span]] = [[] for _ in found]
            asked = [(i, a, b) for i, t in enumerate(batch["text"]) for a, b, inside in candidates(t, found[i]) if not inside]
            if model is not None:
                for i, a, b in _scored(model, batch["text"].array, asked):
                    more[i].append((a, len(KINDS), b))
            out = []
            for text, base, extra in zip(batch["text"], found, more):
                told, masked, done = _text(base), [], 0
                for a, _, b in sorted(base + extra):
                    if b > done:
                        masked += [text[done:a], "[SECRET]"] if a >= done else []
                        done = b
                counts = [sum(k == n for _, k, _ in base) for n in range(len(KINDS))]
                whole = text if not base and not extra else "".join(masked) + text[done:]
                out.append((*counts, hashlib.sha256(told.encode()).hexdigest(), _text(base + extra), len(extra), whole))
            frame = pd.DataFrame(out, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_key", "masked"])
            frame.insert(0, "doc_id", batch["doc_id"].array)
            yield frame

    schema = "doc_id string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_key long, masked string"
    # As text: pandas has no whole numbers beside nulls.
    named = docs.select(F.col("doc_id").cast("long").cast("string"), "text")
    return named.mapInPandas(run, schema).withColumn("doc_id", F.col("doc_id").cast("long"))
