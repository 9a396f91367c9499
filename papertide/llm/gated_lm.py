"""A gated recurrent language model in numpy: truncated backpropagation and a class-factored softmax.

Token ids are ranks by frequency, so classes are equal runs of ids.  The probability of a token is that
of its class times that within the class, each a softmax over about the square root of the vocabulary.

A window's steps and rows stand side by side as places, step * rows + row.  States and gates are (places, hidden), so that
each step is one stretch; logits are (entries, places), so that a softmax runs along the places.  Arrays of a window's size are
kept and used again: fresh ones cost more, in page faults, than the arithmetic.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass, field

import numpy as np

_F = np.float32
#: Places of a window of scoring.
PLACES = 8_192
#: Parameters that a step of Adam takes at once: all arrays of a block stay in the cache.
BLOCK = 1 << 14
#: A run of more rows is summed alone, shorter ones side by side.
LONG = 16
_UPDATE, _RESET, _NEW = 0, 1, 2
#: What goes into the gates is negated in the weights: the logistic function is 1 / (1 + exp(-x)).
_SCALE = np.array([-1, -1, 1], _F).reshape(3, 1, 1)


def _lined_up(size: np.ndarray, rows: int) -> list[list[int]]:
    """The numbers of the texts that are not empty, dealt to `rows` rows at most, the longest first, each to the shortest row; rows ascend by length."""
    order = np.argsort(-size, kind="stable")
    order = order[: np.count_nonzero(size)].tolist()
    made: list[list[int]] = [[i] for i in order[:rows]]
    lengths = [(int(size[r[0]]), k) for k, r in enumerate(made)]
    heapq.heapify(lengths)
    for i in order[rows:]:
        n, k = lengths[0]
        made[k].append(i)
        heapq.heapreplace(lengths, (n + int(size[i]), k))
    return [made[k] for _, k in sorted(lengths)]


@dataclass
class GatedModel:
    n_vocab: int
    hidden: int = 24
    seed: int = 11
    p: dict[str, np.ndarray] = field(default_factory=dict)
    _into: dict[str, np.ndarray] | None = field(default=None, init=False, repr=False)

    def __post_init__(self) -> None:
        self.width = max(1, math.isqrt(max(0, self.n_vocab - 1)) + 1)
        self.classes = -(-self.n_vocab // self.width)
        self._kept: dict[str, np.ndarray] = {}
        if self.p:
            return
        r, h = np.random.default_rng(self.seed), self.hidden
        init = lambda *s: r.normal(0, 0.08, s).astype(_F)
        self.p = {"win": init(3, self.n_vocab, h), "u": init(3, h, h), "b": np.zeros((3, 1, h), _F), "wc": init(h, self.classes), "bc": np.zeros(self.classes, _F), "ww": init(self.classes, h, self.width), "bw": np.zeros((self.classes, self.width), _F)}
        spare = self.classes * self.width - self.n_vocab
        if spare:  # the last class is not full
            self.p["bw"][-1, self.width - spare :] = -1e9

    def flat(self) -> np.ndarray:
        """All parameters in one array."""
        return np.concatenate([v.reshape(-1) for v in self.p.values()])

    def set_flat(self, values: np.ndarray) -> None:
        """The parameters become views of values."""
        self.p = self._views(values)

    def _views(self, values: np.ndarray) -> dict[str, np.ndarray]:
        cuts = np.cumsum([v.size for v in self.p.values()])[:-1]
        return {k: x.reshape(v.shape) for (k, v), x in zip(self.p.items(), np.split(values, cuts), strict=True)}

    def _room(self, name: str, *shape: int) -> np.ndarray:
        """An array for this purpose; what it held before is lost."""
        n, kind, found = math.prod(shape), self.p["u"].dtype, self._kept.get(name)
        if found is None or found.size < n or found.dtype != kind:
            found = self._kept[name] = np.empty(n, kind)
        return found[:n].reshape(shape)

    def _tables(self) -> np.ndarray:
        """What each id puts into the gates, (3, ids, hidden)."""
        return (self.p["win"] + self.p["b"]) * _SCALE.astype(self.p["u"].dtype)

    def _unrolled(self, ids: np.ndarray, first: np.ndarray, inner: np.ndarray | None = None, tables: np.ndarray | None = None, resets: dict[int, list[int]] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """ids (steps, rows), first (rows, hidden) -> states (rows + places, hidden) from first on, gates (3, places, hidden).

        inner, if given, gets the recurrent part of the new state before its reset; tables, if given, are _tables();
        resets has the rows whose state is set to zero before a step.
        """
        p, n, (steps, rows) = self.p, self.hidden, ids.shape
        x, states = self._room("x", 3, ids.size, n), self._room("states", rows + ids.size, n)
        hu, rest = self._room("hu", 3, rows, n), self._room("rest", rows, n)
        where, scale = ids.reshape(-1), _SCALE.astype(x.dtype)
        for gate, table in enumerate(self._tables() if tables is None else tables):
            np.take(table, where, axis=0, out=x[gate], mode="clip")
        across, (gates, news), (pair, last) = p["u"] * scale, (x[:_NEW], x[_NEW]), (hu[:_NEW], hu[_NEW])
        states[:rows] = h = first
        with np.errstate(over="ignore"):  # a gate that is shut: 1 / (1 + inf)
            for a in range(0, ids.size, rows):
                b = a + rows
                if resets and a // rows in resets:
                    h = h.copy()  # the state before it is still asked for
                    h[resets[a // rows]] = 0
                np.matmul(h, across, out=hu)
                both, new = gates[:, a:b], news[a:b]
                both += pair
                np.exp(both, out=both)
                both += 1
                np.reciprocal(both, out=both)
                if inner is not None:
                    inner[a:b] = last
                np.multiply(both[_RESET], last, out=rest)
                new += rest
                np.tanh(new, out=new)
                np.subtract(h, new, out=rest)
                rest *= both[_UPDATE]
                h = np.add(rest, new, out=states[b : b + rows])
        return states, x

    def _picked(self, logits: np.ndarray, at: np.ndarray, share: float = 0.0) -> np.ndarray:
        """Log probabilities of the entry at of each place; with a share, logits become the gradients of that share of the losses."""
        where = at * np.int64(len(at)) + np.arange(len(at))
        logits -= logits.max(0)
        chosen = logits.reshape(-1)[where]
        np.exp(logits, out=logits)
        total = logits.sum(0)
        if share:
            logits *= share / total
            logits.reshape(-1)[where] -= logits.dtype.type(share)
        return chosen - np.log(total)

    def _with_one(self, states: np.ndarray) -> np.ndarray:
        """states with a column of ones, which takes the biases into the products."""
        out = self._room("with_one", len(states), self.hidden + 1)
        out[:, :-1], out[:, -1] = states, 1
        return out

    def _biased(self) -> tuple[np.ndarray, np.ndarray]:
        """The weights of the classes and of the words within them, each with its biases as a last row."""
        p = self.p
        return np.concatenate([p["wc"], p["bc"][None]]), np.concatenate([p["ww"], p["bw"][:, None]], axis=1)

    def _classes_of(self, states: np.ndarray, weights: np.ndarray) -> np.ndarray:
        return np.matmul(weights.T, states.T, out=self._room("classes", self.classes, len(states)))

    def _within(self, states: np.ndarray, weights: np.ndarray, cuts: list[int]) -> np.ndarray:
        """Logits within the classes; states are sorted by class, cuts[c] is where class c begins."""
        logits = self._room("within", self.width, len(states))
        for c, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if b > a:
                np.matmul(weights[c].T, states[a:b].T, out=logits[:, a:b])
        return logits

    def _by_class(self, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
        cls, within = np.divmod(targets.astype(np.int32), np.int32(self.width))
        order = np.argsort(cls.astype(np.uint16) if self.classes <= 1 << 16 else cls, kind="stable")
        return cls, within, order, np.searchsorted(cls[order], np.arange(self.classes + 1)).tolist()

    def log_probs(self, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """states (n, hidden) -> natural logarithms of the probabilities of the targets, float64."""
        cls, within, order, cuts = self._by_class(targets)
        states, (classes, words) = self._with_one(states), self._biased()
        out = self._picked(self._classes_of(states, classes), cls).astype(np.float64)
        ranked = np.take(states, order, axis=0, out=self._room("ranked", *states.shape), mode="clip")
        out[order] += self._picked(self._within(ranked, words, cuts), within[order])
        return out

    def score(self, texts: list[np.ndarray], rows: int = 512, steps: int = 8) -> np.ndarray:
        """The log10 probability of each text; the state is carried from window to window through the whole text.

        Texts stand one behind the other in `rows` rows of about equal length, the longest first, so that few steps have few rows;
        where a text begins, its row's state is that after an end token.  A window reaches to the end of the shortest row, but for
        `steps` at least and about PLACES places at most.
        """
        size = np.array([len(t) for t in texts], np.int64)
        out, tables, lined = np.zeros(len(texts)), self._tables(), _lined_up(size, rows)
        if not lined:
            return out
        order = np.concatenate(lined)
        flat = np.concatenate([texts[i] for i in order])
        owner = np.repeat(order.astype(np.uint16 if len(texts) <= 1 << 16 else np.int64), size[order])
        first = np.cumsum(size[order]) - size[order]  # where texts begin
        before = np.append(flat.dtype.type(1), flat[:-1])
        before[first] = 1
        length = np.array([int(size[r].sum()) for r in lined])
        stop = np.cumsum(length)
        begin, alive, s = stop - length, np.arange(len(lined)), 0
        row = np.repeat(alive, [len(r) for r in lined])
        at_step = first - begin[row]
        sooner = np.argsort(at_step, kind="stable")
        start_step, start_row, done = at_step[sooner], row[sooner], 0
        h = np.zeros((len(alive), self.hidden), self.p["u"].dtype)
        while s < length[-1]:
            keep = length[alive] > s
            if not keep.all():
                alive, h = alive[keep], h[keep]
            width = int(min(length[-1] - s, max(steps, min(length[alive[0]] - s, PLACES // len(alive)))))
            at = begin[alive] + s + np.arange(width)[:, None]
            real = at < stop[alive]
            whole = real.all()
            if not whole:
                at[~real] = 0
            until = int(np.searchsorted(start_step, s + width))
            resets: dict[int, list[int]] = {}
            where = np.searchsorted(alive, start_row[done:until]).tolist()  # a row that a text begins in is alive
            for step, r in zip((start_step[done:until] - s).tolist(), where, strict=True):
                resets.setdefault(step, []).append(r)
            done = until
            states, _ = self._unrolled(before[at], h, tables=tables, resets=resets)
            h, states = states[-len(alive) :].copy(), states[len(alive) :]
            places = at.reshape(-1)
            if not whole:
                chosen = np.flatnonzero(real)
                states, places = states[chosen], places[chosen]
            out += np.bincount(owner[places], self.log_probs(states, flat[places]), len(texts))
            s += width
        return out / math.log(10)

    def train(self, stream: np.ndarray, epochs: int = 2, rows: int = 32, steps: int = 16, rate: float = 0.01) -> list[float]:
        """Adam on windows of a stream of ids that holds end tokens; returns the mean loss of each epoch."""
        if len(stream) < 2:
            return []
        n = -(-(len(stream) - 1) // rows)  # the last row is filled up from the first, so that no token is left out
        x, y = np.resize(stream[:-1], n * rows).reshape(rows, n).T, np.resize(stream[1:], n * rows).reshape(rows, n).T
        values = self.flat()
        self.set_flat(values)
        m, v, step, root = (np.zeros_like(values) for _ in range(4))
        self._into, gradients = self._views(step), step  # windows write their gradients there
        blocks = [tuple(each[a : a + BLOCK] for each in (values, m, v, step, root)) for a in range(0, len(values), BLOCK)]
        k, losses = 0, []
        for _ in range(epochs):
            h, total, seen = np.zeros((rows, self.hidden), values.dtype), 0.0, 0
            for s in range(0, n, steps):
                loss, _, h = self._window(np.ascontiguousarray(x[s : s + steps]), np.ascontiguousarray(y[s : s + steps]), h)
                total, seen, k = total + loss, seen + x[s : s + steps].size, k + 1
                shorter = min(1.0, 1.0 / max(math.sqrt(float(gradients @ gradients)), 1e-9))
                deviation = math.sqrt(0.01 / (1 - 0.99**k))
                least, scale = 1e-6 / deviation, rate * 0.1 / (1 - 0.9**k) / deviation
                for value, mean, square, g, r in blocks:
                    if shorter < 1:
                        g *= shorter
                    mean *= 0.9  # the moments without their weights 0.1 and 0.01, which the scale brings in
                    mean += g
                    g *= g
                    square *= 0.99
                    square += g
                    np.sqrt(square, out=r)
                    r += least
                    np.divide(mean, r, out=g)
                    g *= scale
                    value -= g
            losses.append(total / max(1, seen))
        self._into = None
        return losses

    def _window(self, x: np.ndarray, y: np.ndarray, h: np.ndarray) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
        """Loss, gradients of the mean loss, and the state to carry on; gradients stop at the window's begin."""
        p, n, size, rows = self.p, self.hidden, x.size, x.shape[1]
        inner = self._room("inner", size, n)
        all_states, gates = self._unrolled(x, h, inner)
        before, states = all_states[:size], all_states[rows:]
        cls, within, order, cuts = self._by_class(y.reshape(-1))
        g = self._into or {k: np.empty_like(v) for k, v in p.items()}
        # The classes, then the words within them: the probabilities less one at the targets are the gradients of the logits.
        ones, (classes, words) = self._with_one(states), self._biased()
        prob = self._classes_of(ones, classes)
        loss = -float(self._picked(prob, cls, 1 / size).sum())
        both = prob @ ones
        g["wc"][:], g["bc"][:] = both[:, :n].T, both[:, n]
        dh = np.matmul(prob.T, p["wc"].T, out=self._room("dh", size, n))
        ranked, back = self._room("ranked", size, n + 1), self._room("back", size, n)
        np.take(ones, order, axis=0, out=ranked, mode="clip")
        q = self._within(ranked, words, cuts)
        loss -= float(self._picked(q, within[order], 1 / size).sum())
        of_words = self._room("of_words", *words.shape)
        for c in range(self.classes):
            a, b = cuts[c], cuts[c + 1]
            if b > a:
                part = q[:, a:b].T
                np.matmul(ranked[a:b].T, part, out=of_words[c])
                np.matmul(part, p["ww"][c].T, out=back[a:b])
            else:
                of_words[c] = 0
        g["ww"][:], g["bw"][:] = of_words[:, :n], of_words[:, n]
        place = np.empty_like(order)
        place[order] = np.arange(size)
        dh += np.take(back, place, axis=0, out=self._room("unranked", size, n), mode="clip")
        # Through the steps, last first; what does not depend on the gradient is there for all steps at once.
        z, r, c = gates
        one, some, to_c, du = self._room("back", size, n), self._room("unranked", size, n), self._room("to_c", size, n), self._room("du", size, 3, n)
        np.subtract(1, z, out=one)
        np.subtract(before, c, out=some)
        some *= z
        np.multiply(some, one, out=du[:, _UPDATE])
        np.multiply(c, c, out=to_c)
        np.subtract(1, to_c, out=to_c)
        to_c *= one
        np.multiply(to_c, r, out=du[:, _NEW])
        np.subtract(1, r, out=some)
        some *= r
        some *= inner
        np.multiply(some, to_c, out=du[:, _RESET])
        carry, step = self._room("rest", rows, n), self._room("hu", rows, n)
        carry[:] = 0
        across = np.ascontiguousarray(p["u"].transpose(0, 2, 1)).reshape(3 * n, n)
        for a in range(size - rows, -1, -rows):
            d, back = dh[a : a + rows], du[a : a + rows]
            d += carry
            back *= d[:, None]
            np.matmul(back.reshape(rows, 3 * n), across, out=step)
            np.multiply(d, z[a : a + rows], out=carry)
            carry += step
        apart = lambda v: v.reshape(-1, 3, n).transpose(1, 0, 2)
        g["u"][:] = apart(before.T @ du.reshape(size, 3 * n))
        np.multiply(dh, to_c, out=du[:, _NEW])  # from here on what goes into the gates: the new state's without its reset
        ids, summed = self._by_id(x.reshape(-1), du.reshape(size, 3 * n))
        g["b"][:] = apart(summed.sum(0))
        g["win"][:] = 0
        g["win"][:, ids] = apart(summed)
        return loss, g, states[size - rows :].copy()

    def _by_id(self, where: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids that occur, ascending, and the sum of the rows of each."""
        order = np.argsort(where, kind="stable")
        there = where[order]
        begin = np.flatnonzero(np.append(True, there[1:] != there[:-1]))
        length = np.diff(np.append(begin, len(there)))
        out = np.empty((len(begin), rows.shape[1]), rows.dtype)
        for k in np.flatnonzero(length > LONG).tolist():
            a, b = int(begin[k]), int(begin[k] + length[k])
            np.add.reduce(np.take(rows, order[a:b], axis=0, out=self._room("dx", b - a, rows.shape[1]), mode="clip"), axis=0, out=out[k])
        # The other ids, the longest runs first: their first rows, then the second of those that have one, and so on.
        short = np.flatnonzero(length <= LONG)
        short = short[np.argsort(-length[short], kind="stable")]
        first, longer = begin[short], np.searchsorted(-length[short], -np.arange(LONG + 1)).tolist()  # longer[i] have more than i rows
        total = rows[order[first]]
        for i in range(1, LONG):
            if not longer[i]:
                break
            total[: longer[i]] += rows[order[first[: longer[i]] + i]]
        out[short] = total
        return there[begin], out
