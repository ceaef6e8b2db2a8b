"""A gated recurrent language model in numpy and complete-document scores (operator 1)."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICE, map_batches, settle

#: Words with an output of their own, and their classes, smaller ones for frequent words. The others share one class.
SHORTLIST, CLASSES = 4096, 48
#: Words whose counts every worker knows, about; the rest are joined.
HEAD = 131_072
EMBED, HIDDEN = 16, 24
#: Steps that errors run back through, and least and most streams trained side by side; streams scored side by side and
#: tokens of a scored window, about.
TRUNCATE, TRAIN_LANES, MOST_LANES = 16, 64, 512
SCORE_LANES, WINDOW = 512, 8192
#: Tokens that a worker lines up before it scores them.
LINED_UP = 2_000_000
#: Averaged rounds, each over its own part of the training documents, and documents of the round that starts them, about.
ROUNDS, START = 4, 512
#: Tokens whose classes are told at a time; their numbers stay in a core's cache.
PIECE = 2048
#: Logits of this size need no shift before exp(), whose sums stay far within single precision.
SAFE = 40
#: Stands for the end in the counts; no word holds a blank.
END = b" "


def words(text: str | None) -> list[bytes]:
    """A-Z lowered, split at ASCII white space; the end token isn't among them."""
    return (text or "").encode("utf-8", "replace").lower().split()


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """words() of a column of texts: where each text's words begin (one more at the end), and the words."""
    parts = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, ""))))
    offsets, flat = np.array(parts.offsets, np.int64), parts.flatten()
    offsets -= offsets[0]
    if pc.min(pc.binary_length(flat)).as_py() == 0:  # a text without words gives an empty one
        there = np.array(pc.greater(pc.binary_length(flat), 0))
        offsets, flat = np.concatenate([[0], np.cumsum(there)])[offsets], flat.filter(pa.array(there))
    return offsets, flat.cast(pa.binary())


@dataclass
class Vocabulary:
    """Shortlist words are 0 to size-1, most frequent first; ``size`` is the end, ``size + 1`` any other word."""

    words: pa.Array
    counts: np.ndarray  # of shortlist words, the end, all others together
    start: np.ndarray  # first word of each class, and the end of the last

    @property
    def size(self) -> int:
        return len(self.words)

    @property
    def kind(self) -> type:
        """The numbers that ids are stored as."""
        return np.uint16 if self.size + 2 <= 1 << 16 else np.int32

    def ids(self, found: pa.Array) -> np.ndarray:
        return np.array(pc.fill_null(pc.index_in(found, value_set=self.words), self.size + 1), np.int32)


def vocabulary(top: list[tuple[bytes, int]], ends: int, others: int) -> Vocabulary:
    """Class borders grow with the square of their number, which costs least where frequencies fall with the rank."""
    counts = np.array([*(c for _, c in top), ends, others], float)
    start = np.unique(np.ceil(len(top) * (np.arange(CLASSES + 1) / CLASSES) ** 2).astype(np.int64))
    return Vocabulary(pa.array([w for w, _ in top], pa.binary()), counts, start)


class Gru:
    """Embedding, one gated recurrent layer, and an output in two steps: a class, then a word of the class.

    Classes are those of the shortlist, then the end alone, then all other words. Biases start at the words' frequencies,
    so that training starts from the unigram model. States are held as (HIDDEN, tokens), so that gates are whole blocks.
    """

    NAMES = ("E", "W", "U", "C", "O")

    def __init__(self, vocab: Vocabulary, seed: int = 0):
        rng = np.random.default_rng(seed)
        n, h = vocab.size, HIDDEN
        self.n, self.start, self.classes = n, vocab.start, len(vocab.start) + 1
        self.rooms: dict[str, np.ndarray] = {}
        self.first_words = np.array([*vocab.start[:-1], n, n + 1])
        self.E = rng.normal(0, 0.1, (n + 2, EMBED)).astype(np.float32)
        # Last columns are biases: inputs and states have a row of ones below.
        self.W = rng.normal(0, EMBED**-0.5, (3 * h, EMBED + 1)).astype(np.float32)
        self.U = rng.normal(0, h**-0.5, (3 * h, h)).astype(np.float32)
        self.C = np.zeros((self.classes, h + 1), np.float32)
        self.O = np.zeros((n, h + 1), np.float32)
        words = vocab.counts[:n] + 1
        mass = np.add.reduceat(words, vocab.start[:-1]) if n else np.zeros(0)
        mass = np.concatenate([mass, vocab.counts[n:] + 1])
        self.W[:, -1] = 0
        self.C[:, -1] = np.log(mass / mass.sum())
        self.O[:, -1] = np.log(words / max(words.sum(), 1))
        self.class_ids = np.concatenate([np.repeat(np.arange(self.classes - 2), np.diff(vocab.start)), [self.classes - 2, self.classes - 1]]).astype(np.uint8)

    def parts(self) -> list[np.ndarray]:
        return [getattr(self, k) for k in self.NAMES]

    def packed(self) -> bytes:
        return b"".join(p.tobytes() for p in self.parts())

    def unpack(self, flat: np.ndarray) -> None:
        at = 0
        for k, p in zip(self.NAMES, self.parts(), strict=True):
            setattr(self, k, flat[at : at + p.size].reshape(p.shape).astype(np.float32))
            at += p.size

    def room(self, name: str, rows: int, columns: int) -> np.ndarray:
        """An array that later calls use again. Its rows lie apart by no power of two, so that they don't share cache lines."""
        kept = self.rooms.get(name)
        if kept is None or len(kept) != rows or kept.shape[1] < columns:
            kept = self.rooms[name] = np.empty((rows, columns + 80), np.float32)
        return kept[:, :columns]

    def step(self, gx: np.ndarray, gh: np.ndarray, h0: np.ndarray, c: np.ndarray, out: np.ndarray) -> None:
        """One step from states h0, inputs gx and the states' share gh of gates and candidate, thirds of both, whose candidate's are
        doubled and negative. The gates take the place of the first two in gh; writes the candidate c and the new state.

        A gate is 1 / (1 + exp(x)), and tanh is 2 / (1 + exp(-2x)) - 1.
        """
        zr = gh[:2]
        zr += gx[:2]
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        np.multiply(zr[1], gh[2], out=c)
        c += gx[2]
        np.exp(c, out=c)
        c += 1
        np.divide(2, c, out=c)
        c -= 1
        np.subtract(h0, c, out=out)
        out *= zr[0]
        out += c

    def gate_weights(self) -> tuple[np.ndarray, np.ndarray]:
        """W and U as step() takes them."""
        scale = np.repeat(np.array([1, 1, -2], np.float32), HIDDEN)[:, None]
        return self.W * scale, self.U * scale

    def wide(self) -> bool:
        """Whether logits may be large. States lie within 1, so the weights of an output bound its logit."""
        return max(np.abs(w).sum(1).max(initial=0) for w in (self.C, self.O)) > SAFE

    def by_class(self, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """An order of tokens by class, the targets in it, and where each class begins there (one more at the end)."""
        classes = self.class_ids[targets]
        order = np.argsort(classes, kind="stable")
        return order, targets[order], [0, *np.cumsum(np.bincount(classes, minlength=self.classes)).tolist()]

    def word_spans(self, bounds: list[int]) -> list[tuple[int, int, int, int]]:
        """(first word, end, first place, end) of each class of several words that is there."""
        spans = zip(self.start[:-1].tolist(), self.start[1:].tolist(), bounds, bounds[1:], strict=False)
        return [x for x in spans if x[3] > x[2] and x[1] > x[0] + 1]

    def logits(self, weights: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logits of outcomes (rows) after states (columns), and the same as one row; both last until the next call."""
        rows, columns = len(weights), states.shape[1]
        flat = self.room("logits", 1, rows * columns)[0]
        return np.matmul(weights, states, out=flat.reshape(rows, columns)), flat

    def log_probs(self, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Natural log probability of each target; of another word that of its class. States are (HIDDEN + 1, tokens)."""
        order, goal, bounds = self.by_class(targets)
        states = np.take(states, order, 1, out=self.room("sorted", HIDDEN + 1, len(order)), mode="clip")
        wide = self.wide() or max(states.max(initial=0), -states.min(initial=0)) > 1
        ones = np.ones(max(self.classes, self.n), states.dtype)
        own, sums = np.empty(len(order), states.dtype), np.ones((2, len(order)), states.dtype)
        counting, classes = np.arange(len(order)), self.class_ids[goal].astype(np.intp)
        goal = goal - self.first_words[classes]
        for a in range(0, len(order), PIECE):
            b = min(a + PIECE, len(order))
            p, flat = self.logits(self.C, states[:, a:b])
            if wide:
                p -= p.max(0)
            own[a:b] = flat.take(classes[a:b] * (b - a) + counting[: b - a], mode="clip")
            np.exp(p, out=p)
            np.matmul(ones[: len(p)], p, out=sums[0, a:b])
        for lo, hi, a, b in self.word_spans(bounds):
            p, flat = self.logits(self.O[lo:hi], states[:, a:b])
            if wide:
                p -= p.max(0)
            own[a:b] += flat.take(goal[a:b] * (b - a) + counting[: b - a], mode="clip")
            np.exp(p, out=p)
            np.matmul(ones[: hi - lo], p, out=sums[1, a:b])
        np.log(sums, out=sums)
        own -= sums[0]
        own -= sums[1]
        out = np.empty_like(own)
        out[order] = own
        return out

    def train_window(self, inputs: np.ndarray, targets: np.ndarray, h: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients over one window (steps, lanes); the state (HIDDEN, lanes) that enters is a constant. -1 as target: nothing there.

        What a step needs lies together, and its share of the gradients is added while it is in the cache.
        """
        (steps, lanes), k = inputs.shape, HIDDEN
        ins, goal = inputs.ravel(), targets.ravel()
        size = steps * lanes
        goes_on = (inputs != self.n).astype(np.float32)  # a document starts with the end token as input
        embedded = np.concatenate([self.E, np.ones((len(self.E), 1), np.float32)], 1)
        x = np.take(embedded, ins, 0, out=self.room("x", 1, size * (EMBED + 1))[0].reshape(size, EMBED + 1), mode="clip").reshape(steps, lanes, EMBED + 1)
        before, c, gates = (self.room(name, 1, steps * n * k * lanes)[0].reshape(steps, n, k, lanes) for name, n in (("before", 1), ("c", 1), ("gates", 3)))
        gx = self.room("gx", 1, 3 * k * lanes)[0].reshape(3, k, lanes)
        states = self.room("states", k + 1, size)
        states[k] = 1
        w, u = self.gate_weights()
        new = np.array(h)
        for t in range(steps):
            h0, gh = before[t, 0], gates[t]
            np.multiply(new, goes_on[t], out=h0)
            np.matmul(w, x[t].T, out=gx.reshape(3 * k, lanes))
            np.matmul(u, h0, out=gh.reshape(3 * k, lanes))
            self.step(gx, gh, h0, c[t, 0], new)
            states[:k, t * lanes : (t + 1) * lanes] = new
        there = None
        if (goal < 0).any():
            there = np.flatnonzero(goal >= 0)
            goal = goal[there]
        order, goal, bounds = self.by_class(goal)
        source = order if there is None else there[order]
        live = np.take(states, source, 1, out=self.room("sorted", k + 1, len(goal)), mode="clip")
        scale, wide = np.float32(1 / max(len(goal), 1)), self.wide() or max(live.max(initial=0), -live.min(initial=0)) > 1
        ones, counting = np.ones(max(self.classes, self.n), np.float32), np.arange(len(goal))
        weighed = self.room("weighed", k + 1, len(goal))
        grads = {"O": np.zeros_like(self.O), "E": np.zeros_like(self.E), "C": np.zeros_like(self.C)}

        def exps(p: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """exp() in place of logits, their sums, and what makes of these less the target's the error; weighs the states by it."""
            if wide:
                p -= p.max(0)
            np.exp(p, out=p)
            sums = ones[: len(p)] @ p
            return sums, (fit := scale / sums), np.multiply(live[:, a:b], fit, out=weighed[:, a:b])

        classes, ds = self.class_ids[goal].astype(np.intp), self.room("ds", k, len(goal))
        goal = goal - self.first_words[classes]
        for a in range(0, len(goal), PIECE):
            b = min(a + PIECE, len(goal))
            p, flat = self.logits(self.C, live[:, a:b])
            sums, fit, own = exps(p, a, b)
            flat[classes[a:b] * (b - a) + counting[: b - a]] -= sums
            grads["C"] += p @ own.T
            np.multiply(self.C[:, :k].T @ p, fit, out=ds[:, a:b])
        for lo, hi, a, b in self.word_spans(bounds):
            p, flat = self.logits(self.O[lo:hi], live[:, a:b])
            sums, fit, own = exps(p, a, b)
            flat[goal[a:b] * (b - a) + counting[: b - a]] -= sums
            grads["O"][lo:hi] = p @ own.T
            d = self.O[lo:hi, :k].T @ p
            d *= fit
            ds[:, a:b] += d
        if there is None:
            place = np.empty_like(order)
            place[source] = counting
            all_ds = np.take(ds, place, 1, out=self.room("all_ds", k, size), mode="clip")
        else:
            all_ds = np.zeros((k, size), np.float32)
            all_ds[:, source] = ds
        # Errors of a step: candidate, gates, and the candidate's at the states' side, so that either side's lie together.
        errors = self.room("errors", 1, 4 * k * lanes)[0].reshape(4, k, lanes)
        at_inputs, at_states = errors[:3].reshape(3 * k, lanes), errors[1:].reshape(3 * k, lanes)
        w, u_turned = np.concatenate([self.W[2 * k :], self.W[: 2 * k]]), np.ascontiguousarray(self.U.T)
        dw, du = np.zeros_like(w), np.zeros_like(self.U)
        dx = self.room("dx", 1, size * EMBED)[0].reshape(steps, lanes, EMBED)
        dh, one = np.zeros((k, lanes), np.float32), np.empty((k, lanes), np.float32)
        for t in reversed(range(steps)):
            (z, r, g), out, h0 = gates[t], c[t, 0], before[t, 0]
            dh += all_ds[:, t * lanes : (t + 1) * lanes]
            np.subtract(1, z, out=one)
            one *= dh
            np.multiply(out, out, out=errors[0])
            np.subtract(1, errors[0], out=errors[0])
            errors[0] *= one
            np.subtract(out, h0, out=errors[1])
            errors[1] *= z
            errors[1] *= one
            np.multiply(errors[0], r, out=errors[3])
            np.subtract(r, 1, out=one)
            one *= errors[3]
            np.multiply(one, g, out=errors[2])
            errors[2] *= np.float32(-0.5)  # g is doubled and negative
            dh *= z
            dh += u_turned @ at_states
            dh *= goes_on[t]
            dw += at_inputs @ x[t]
            du += at_states @ h0.T
            np.matmul(at_inputs.T, w[:, :-1], out=dx[t])
        grads["W"], grads["U"] = np.concatenate([dw[k:], dw[:k]]), du
        by_word = np.argsort(ins.astype(np.uint16) if len(self.E) <= 1 << 16 else ins, kind="stable")  # a radix sort at 16 bits
        found = ins[by_word]
        first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
        grads["E"][found[first]] = np.add.reduceat(np.take(dx.reshape(size, EMBED), by_word, 0, mode="clip"), first, axis=0)
        return grads, new


class Adam:
    def __init__(self, model: Gru, rate: float):
        self.model, self.rate, self.t = model, rate, 0
        self.m = {k: np.zeros_like(p) for k, p in zip(model.NAMES, model.parts(), strict=True)}
        self.v = {k: np.zeros_like(p) for k, p in zip(model.NAMES, model.parts(), strict=True)}

    def apply(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        fit = np.float32(self.rate * math.sqrt(1 - 0.99**self.t) / (1 - 0.9**self.t))
        for k, g in grads.items():
            m, v = self.m[k], self.v[k]
            np.clip(g, -1, 1, out=g)
            m *= np.float32(0.9)
            m += np.float32(0.1) * g
            v *= np.float32(0.99)
            g *= g
            g *= np.float32(0.01)
            v += g
            np.sqrt(v, out=g)
            g += np.float32(1e-6)
            np.divide(m, g, out=g)
            g *= fit
            getattr(self.model, k)[...] -= g


def train(model: Gru, docs: list[np.ndarray], rate: float) -> int:
    """One pass of truncated backpropagation; the state goes on from window to window. Gives the number of tokens.

    All documents, each with its end, are one stream that is cut into lanes as long as each other to a token, wherever the
    cuts fall, so that long documents hold nothing up and nothing is padded. Many tokens make wider batches, which take less
    time a token.
    """
    if not docs:
        return 0
    stream = np.concatenate([x for d in docs for x in (d, [model.n])]).astype(np.int32)
    before = np.concatenate([[model.n], stream[:-1]]).astype(np.int32)
    lanes = min(len(stream), MOST_LANES, max(TRAIN_LANES, len(stream) // (64 * TRUNCATE)))
    cuts = len(stream) * np.arange(lanes + 1) // lanes
    longest = int(np.diff(cuts).max())
    adam, h = Adam(model, rate), np.zeros((HIDDEN, lanes), np.float32)
    for at in range(0, longest, TRUNCATE):
        place = cuts[:-1] + np.arange(at, min(at + TRUNCATE, longest))[:, None]
        over = place >= cuts[1:]
        place = np.minimum(place, len(stream) - 1)
        goal = stream[place]
        goal[over] = -1
        adam.rate = rate * (1 - 0.9 * at / longest)
        grads, h = model.train_window(before[place], goal, h)
        for g in grads.values():
            g *= np.float32((goal >= 0).sum() / (TRUNCATE * lanes))  # each token counts alike, also in a short last window
        adam.apply(grads)
    return len(stream)


def score(model: Gru, docs: list[np.ndarray]) -> np.ndarray:
    """Natural log probability of each complete document, the state carried across windows from its first token to its end.

    Whole documents are dealt to lanes of near equal length, the longest first; lanes are places in one stream, so that a
    very long text takes no room but its own.
    """
    if not docs:
        return np.zeros(0)
    lanes = min(SCORE_LANES, len(docs))
    loads, dealt = [(0, k) for k in range(lanes)], [[] for _ in range(lanes)]
    for i in sorted(range(len(docs)), key=lambda i: -len(docs[i])):
        load, k = heapq.heappop(loads)
        dealt[k].append(i)
        heapq.heappush(loads, (load + len(docs[i]) + 1, k))
    stream = np.concatenate([x for own in dealt for i in own for x in (docs[i], [model.n])]).astype(np.int32)
    before = np.concatenate([[model.n], stream[:-1]]).astype(np.int32)
    lengths = np.array([load for load, _ in sorted(loads, key=lambda x: x[1])])
    ends = np.cumsum(lengths)
    places = ends - lengths
    logs = np.zeros(len(stream))
    h = np.zeros((lanes, HIDDEN), np.float32)  # states as rows here, so that what a word gives is looked up as one stretch
    w, u = (x.reshape(3, HIDDEN, -1).transpose(0, 2, 1) for x in model.gate_weights())
    from_words, u = model.E @ w[:, :-1] + w[:, -1:], np.ascontiguousarray(u)
    while True:
        live = places < ends
        if not live.all():
            places, ends, h = places[live], ends[live], h[live]
        if not (n := len(places)):
            break
        steps = int(min(max(TRUNCATE, WINDOW // n), (ends - places).max()))
        at = places + np.arange(steps)[:, None]
        there = np.flatnonzero((at < ends).ravel())
        at = np.minimum(at, len(stream) - 1)
        ins = before[at]
        states = model.room("states", HIDDEN + 1, steps * n)
        states[HIDDEN] = 1
        gx, gh = (model.room(name, 1, 3 * HIDDEN * n)[0].reshape(3, n, HIDDEN) for name in ("gx", "gh"))
        c, h0 = np.empty((n, HIDDEN), np.float32), np.empty((n, HIDDEN), np.float32)
        goes_on = ins != model.n
        all_go = goes_on.all(1).tolist()
        for t in range(steps):
            np.copyto(h0, h) if all_go[t] else np.multiply(h, goes_on[t, :, None], out=h0)
            np.take(from_words, ins[t], 1, out=gx, mode="clip")
            np.matmul(h0, u, out=gh)
            model.step(gx, gh, h0, c, h)
            states[:HIDDEN, t * n : (t + 1) * n] = h.T
        at = at.ravel()
        if len(there) < len(at):
            states, at = states[:, there], at[there]
        logs[at] = model.log_probs(states, stream[at])
        places = places + steps
    order = [i for own in dealt for i in own]
    total = np.empty(len(docs))
    total[order] = np.add.reduceat(logs, np.concatenate([[0], np.cumsum([len(docs[i]) + 1 for i in order])[:-1]]))
    return total


def count_words(train_docs: DataFrame) -> DataFrame:
    """(word, n) over all words and ends of the training texts; workers add up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        ends = 0

        def added() -> pa.Table:
            return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                _, found = split_words(batch.column(0).slice(at, SLICE))
                counts = pc.value_counts(found)
                held.append(pa.table({"word": counts.field(0), "n": counts.field(1)}))
                if sum(t.num_rows for t in held) > 600_000:
                    held = [added()]
                    if held[0].num_rows > 300_000:
                        yield from held[0].to_batches()
                        held = []
            ends += batch.num_rows
        held.append(pa.table({"word": pa.array([END], pa.binary()), "n": pa.array([ends], pa.int64())}))
        yield from added().to_batches()

    parts = map_batches(train_docs.select("text"), run, "word binary, n long")
    return parts.where("n > 0").groupBy("word").agg(F.sum("n").alias("n"))


def most_frequent(counted: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """Words of (word, n), most frequent first: those from the least count at which ``most`` or fewer are as frequent.

    The count comes from a table of how many words have which (exact to 4,096, then in steps of one in 512), so ties
    are taken or left together and the driver gets no more than ``most`` rows and some 20,000 counts.
    """
    step = F.when(F.col("n") <= 4096, F.col("n")).otherwise(4096 + F.floor((F.log(F.col("n").cast("double")) - math.log(4096)) * 512)).cast("long")
    ranked = counted.where(F.col("word") != F.lit(END)).withColumn("step", step)
    total, least = 0, None
    for r in ranked.groupBy("step").agg(F.count("*").alias("k")).orderBy(F.desc("step")).collect():
        total += r.k
        if total > most:
            break
        least = r.step
    if least is None:
        return []
    return sorted(((bytes(r.word), r.n) for r in ranked.where(F.col("step") >= least).select("word", "n").collect()), key=lambda x: (-x[1], x[0]))


def draws() -> list[Column]:
    """Hashes that documents are drawn by: into the start sample (mark), and into rounds (deal)."""
    return [F.pmod(F.xxhash64("doc_id", "text", F.lit("lm")), F.lit(1 << 40)).alias("mark"), F.xxhash64("doc_id", "text", F.lit("round")).alias("deal")]


def start_sample(train_docs: DataFrame, n_docs: int, start: int) -> DataFrame:
    """The texts, or ids where they are made, of about ``start`` of ``n_docs`` documents, chosen and ordered by a hash (ties by
    text), in one partition.

    They are found where the documents lie, in as many tasks as any scan has; only what is chosen comes together. Rows that
    agree in id and text have one hash: all or none of them are chosen.
    """
    if "ids" not in train_docs.columns:
        train_docs = train_docs.select("text", *draws())
    own = train_docs.columns[0]
    chosen = train_docs.select(own, "mark").where(F.col("mark") < int((1 << 40) * min(1, start / max(n_docs, 1))))
    return chosen.repartition(1).sortWithinPartitions("mark", own).select(own)


def with_ids(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """(ids, mark, deal): the shortlist's ids of each text as bytes, and the hashes by which it is drawn."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                piece = batch.slice(at, SLICE)
                offsets, found = split_words(piece.column(0))
                yield pa.RecordBatch.from_arrays([packed_ids(v.ids(found).astype(v.kind), offsets), *piece.columns[1:]], ["ids", "mark", "deal"])

    return map_batches(docs.select("text", *draws()), run, "ids binary, mark long, deal long")


def packed_ids(ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A column of the bytes of each text's ids, whose places in ids the offsets tell."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * ids.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(ids))])


def unpacked_ids(column: pa.Array, kind: type) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in column.to_pylist()]


def learn(train_docs: DataFrame, vocab: Vocabulary, n_docs: int, rounds: int = ROUNDS, start: int = START) -> tuple[Gru, int]:
    """Trains the network on the cluster; gives it and the number of tokens of the averaged rounds.

    About ``start`` of the ``n_docs`` documents, chosen by a hash, give a common start in one task. Then a hash deals all documents to
    ``rounds``. In each, every task trains on all of its documents of the round, from what the round before gave, and the
    results are averaged by tokens, in two levels; so every document is learnt from and what tasks learn adds up. train_docs:
    doc_id and text, which are turned into ids once, or what with_ids gives.
    """
    spark = train_docs.sparkSession
    context = spark.sparkContext
    ids = context.broadcast(vocab)

    def trainer(weights, pace: float):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            v = ids.value
            model = Gru(v)
            if weights is not None:
                model.unpack(np.frombuffer(weights.value, np.float32))
            held, room, tokens = [], 0, 0
            for batch in batches:
                for at in range(0, batch.num_rows, SLICE):
                    held += (own := unpacked_ids(batch.column(0).slice(at, SLICE), v.kind))
                    room += sum(map(len, own))
                    if room > LINED_UP:
                        tokens += train(model, held, pace)
                        held, room = [], 0
            tokens += train(model, held, pace)
            if tokens:
                yield pa.RecordBatch.from_pydict({"tokens": pa.array([tokens], pa.int64()), "weights": pa.array([model.packed()], pa.binary())})

        return run

    schema = "tokens long, weights binary"
    model = Gru(vocab)
    if not n_docs:
        return model, 0
    if "ids" not in train_docs.columns:
        train_docs = settle(with_ids(train_docs, vocab))
    train_docs = train_docs.select("ids", "mark", "deal")
    row = map_batches(start_sample(train_docs, n_docs, start), trainer(None, 0.02), schema).first()
    weights, learnt = bytes(row.weights) if row else model.packed(), 0

    def average(pdf):
        n = pdf.tokens.sum()
        flat = sum(np.frombuffer(w, np.float32).astype(np.float64) * (t / n) for t, w in zip(pdf.tokens, pdf.weights, strict=True))
        return pdf.head(1).assign(tokens=n, weights=[flat.astype(np.float32).tobytes()])[["tokens", "weights"]]

    for k in range(rounds):
        shared = context.broadcast(weights)
        own = map_batches(train_docs.where(F.pmod("deal", F.lit(rounds)) == k).select("ids"), trainer(shared, 0.004), schema)
        trained = settle(own.withColumn("part", F.spark_partition_id()))
        groups = max(1, math.isqrt(trained.rdd.getNumPartitions()))
        half = trained.groupBy(F.col("part") % groups).applyInPandas(average, schema)
        final = half.withColumn("all", F.lit(True)).groupBy("all").applyInPandas(average, schema).first()
        if final is not None:
            weights, learnt = bytes(final.weights), learnt + final.tokens
    model.unpack(np.frombuffer(weights, np.float32))
    return model, learnt


def score_documents(df: DataFrame, learn_from: Column | None = None, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD, shortlist: int = SHORTLIST) -> DataFrame:
    """Scores every whole text with a unigram base and with the recurrent model, both learnt where ``learn_from`` holds.

    Returns doc_id, n_tokens, n_known, train_tokens, base_score and score (log10). Counts cover all training texts. A word
    off the shortlist has the model's probability of the class of such words times its share of their counts, one added
    each and one for a word never seen; so the model's outcomes are the base's. Counts of the ``head`` most frequent words
    are broadcast (a fixed number at most); rarer words leave the worker with their documents and meet their counts in a join.
    Texts are split and turned into ids once for training and scoring, and scored whole at any length, in a worker's room for
    their tokens. Null texts count as empty and have the end alone; null ids are kept; rows of one id are told apart by their place; an
    empty table gives no rows; other columns are ignored.
    """
    spark = df.sparkSession
    learnt = F.lit(True) if learn_from is None else learn_from
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), learnt.alias("learn"))
    counted = settle(count_words(docs.where("learn")))
    total, distinct, ends = counted.agg(F.sum("n"), F.count("*"), F.max(F.when(F.col("word") == F.lit(END), F.col("n")))).first()
    total, ends = total or 0, ends or 0
    top = most_frequent(counted, head)
    listed = top[:shortlist]
    others = total - ends - sum(n for _, n in listed)
    vocab = vocabulary(listed, ends, others)
    shared = spark.sparkContext.broadcast((vocab.size, vocab.kind, pa.array([w for w, _ in top], pa.binary()), np.log10(np.array([n + 1 for _, n in top], float))))
    base = math.log10(total + distinct + 1)
    spread = math.log10(others + (distinct - len(listed) - (ends > 0)) + 1)
    end_base = math.log10(ends + 1)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, kind, head_words, head_logs = shared.value
        missing, other = len(head_words), known + 1
        ids_of = np.arange(missing + 1, dtype=np.int32)
        ids_of[known:] = other
        logs_of = np.append(head_logs, 0.0)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                piece = batch.slice(at, SLICE)
                offsets, tokens = split_words(piece.column(1))
                found = np.array(pc.fill_null(pc.index_in(tokens, value_set=head_words), missing), np.int64)
                own, logs = ids_of[found], logs_of[found]
                off = own == other
                sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[offsets])  # noqa: B023, E731
                far = np.flatnonzero(found == missing)
                unseen = tokens.take(pa.array(far)).dictionary_encode()
                rare, times = np.unique(np.searchsorted(offsets, far, "right") - 1 << 32 | np.array(unseen.indices, np.int64), return_counts=True)
                bounds = pa.array(np.searchsorted(rare >> 32, np.arange(piece.num_rows + 1)), pa.int32())
                columns = {
                    "doc_id": piece.column(0),
                    "n_tokens": pa.array(np.diff(offsets) + 1, pa.int64()),
                    "n_head": pa.array(sums(found < missing), pa.int64()),
                    "head_logs": pa.array(sums(logs), pa.float64()),
                    "n_other": pa.array(sums(off), pa.int64()),
                    "other_logs": pa.array(sums(logs * off), pa.float64()),
                    "rare": pa.ListArray.from_arrays(bounds, unseen.dictionary.take(pa.array(rare & 0xFFFFFFFF, pa.int64()))),
                    "times": pa.ListArray.from_arrays(bounds, pa.array(times, pa.int32())),
                    "ids": packed_ids(own.astype(kind), offsets),
                    **dict(zip(("learn", "mark", "deal"), piece.columns[2:], strict=True)),
                }
                yield pa.RecordBatch.from_pydict(columns)

    sums = "doc_id long, n_tokens long, n_head long, head_logs double, n_other long, other_logs double"
    schema = f"{sums}, rare array<binary>, times array<int>, ids binary, learn boolean, mark long, deal long"
    coded = settle(map_batches(docs.select("doc_id", "text", "learn", *draws()), code, schema).withColumn("row", F.monotonically_increasing_id()))
    model, _ = learn(coded.where("learn"), vocab, ends)
    net, kind = spark.sparkContext.broadcast(model), vocab.kind

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        ids: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            scores, at = score(net.value, ids) / math.log(10), 0
            for rows in held:
                yield rows.append_column("net", pa.array(scores[at : at + rows.num_rows], pa.float64()))
                at += rows.num_rows
            held.clear()
            ids.clear()

        room = 0
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                piece = batch.slice(at, SLICE)
                ids += (own := unpacked_ids(piece.column(0), kind))
                held.append(piece.select(range(1, piece.num_columns)))
                room += sum(map(len, own))
                if room > LINED_UP:
                    yield from flush()
                    room = 0
        yield from flush()

    plain = coded.drop("ids", "rare", "times", "learn", "mark", "deal")
    scored = settle(map_batches(coded.select("ids", *plain.columns), run, f"{sums}, row long, net double"))
    rare = coded.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    met = rare.join(counted, "word").groupBy("row").agg(F.sum("times").alias("n_met"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("met_logs"))
    out = scored.join(met, "row", "left").fillna(0, ["n_met", "met_logs"])
    end_known = int(ends > 0)
    return out.select(
        "doc_id",
        "n_tokens",
        (F.col("n_head") + F.col("n_met") + end_known).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("head_logs") + F.col("met_logs") + F.lit(end_base) - F.col("n_tokens") * F.lit(base)).alias("base_score"),
        (F.col("net") + F.col("other_logs") + F.col("met_logs") - F.col("n_other") * F.lit(spread)).alias("score"),
    )
