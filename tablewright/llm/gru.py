"""A gated recurrent language model in numpy: windows of many texts at once.

Texts stand one behind the other in lanes, each closed by its end token.  All lanes move
in step through windows of a fixed number of tokens; the state goes on from window to
window and starts anew with every text, so a text of any length is scored from its first
to its last token in bounded memory.  Gradients stop at the start of a window.

The output is factored: the probability of a token's class, times that of the token among
its class.  Frequent tokens have classes of ``CLASS_TOKENS`` with a softmax of their own;
the tokens of the other classes share their class by their counts.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np

HIDDEN = 16
CLASS_TOKENS = 64
#: Tokens through which gradients go back.
WINDOW = 32
#: Tokens that are scored at once.
SCORED_WINDOW = 32
LANES = 512
PORTION = 2048
FARTHEST = 40.0
RATE = 0.1
CLIP = 5.0

Arrays = dict[str, np.ndarray]


@dataclass(frozen=True)
class Layout:
    """Token numbers: first the frequent tokens, then one number per class of rarer ones."""

    frequent: int
    rare_classes: int

    @property
    def own_classes(self) -> int:
        return -(-self.frequent // CLASS_TOKENS)

    @property
    def classes(self) -> int:
        return self.own_classes + self.rare_classes

    @property
    def inputs(self) -> int:
        return self.frequent + self.rare_classes

    def class_of(self, tokens: np.ndarray) -> np.ndarray:
        return np.where(tokens < self.frequent, tokens // CLASS_TOKENS, tokens - self.frequent + self.own_classes)


def initial(layout: Layout, token_weights: np.ndarray, seed: int = 7) -> Arrays:
    """Parameters that give every token its share of ``token_weights``, whatever came before."""
    rng = np.random.default_rng(seed)
    weights = np.maximum(token_weights / max(token_weights.sum(), 1), 1e-30)
    classes = np.bincount(layout.class_of(np.arange(layout.inputs)), weights=weights, minlength=layout.classes)
    small = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
    return {
        "inputs": small(layout.inputs, 3 * HIDDEN),
        "recurrent": small(HIDDEN, 3 * HIDDEN),
        "gates": np.zeros((1, 3 * HIDDEN), np.float32),
        "to_class": np.zeros((layout.classes, HIDDEN), np.float32),
        "class_bias": np.log(classes).astype(np.float32)[:, None],
        "to_token": np.zeros((layout.frequent, HIDDEN), np.float32),
        "token_bias": np.log(weights[: layout.frequent]).astype(np.float32)[:, None],
    }


def flat(parameters: Arrays) -> np.ndarray:
    return np.concatenate([parameters[name].ravel() for name in sorted(parameters)])


def unflat(vector: np.ndarray, like: Arrays) -> Arrays:
    result, low = {}, 0
    for name in sorted(like):
        size = like[name].size
        result[name] = vector[low : low + size].reshape(like[name].shape).astype(np.float32)
        low += size
    return result


class Lanes:
    """Texts dealt to lanes, the longest first and each to the shortest lane."""

    def __init__(self, lengths: np.ndarray, lanes: int = LANES) -> None:
        lanes = max(1, min(lanes, len(lengths)))
        loads = [(0, lane) for lane in range(lanes)]
        members: list[list[int]] = [[] for _ in range(lanes)]
        for text in np.argsort(-lengths, kind="stable").tolist():
            load, lane = loads[0]
            members[lane].append(text)
            heapq.heapreplace(loads, (load + int(lengths[text]), lane))
        members.sort(key=lambda m: -int(lengths[m].sum()))
        self.order = np.array([t for m in members for t in m], np.int64)
        self.lengths = np.array([int(lengths[m].sum()) for m in members], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])

    def windows(self, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of the tokens of each window, one row per step, and which of them exist.

        Only lanes that still have tokens take part; they are always the first ones.
        """
        steps = np.arange(size)[:, None]
        for low in range(0, int(self.lengths.max(initial=0)), size):
            active = int((self.lengths > low).sum())
            valid = low + steps < self.lengths[:active]
            yield np.where(valid, self.starts[:active] + low + steps, self.starts[:active]), valid


class Model:
    def __init__(self, layout: Layout, parameters: Arrays) -> None:
        self.layout, self.p = layout, parameters

    def states(self, tokens: np.ndarray, goes_on: np.ndarray, state: np.ndarray, keep_parts: bool = False):
        """States after each step of a window, and what the way back needs.

        Each gate has an array of its own, so that no step works on rows with gaps.
        """
        h, steps, lanes = HIDDEN, *tokens.shape
        inputs = self.p["inputs"] + self.p["gates"][0]
        by_gate = np.stack([inputs[:, low : low + h] for low in range(0, 3 * h, h)])
        given = by_gate.take(tokens.ravel(), axis=1).reshape(3, steps, lanes, h)
        recurrent = self.p["recurrent"]
        result = np.empty((steps, lanes, h), np.float32)
        parts = []
        for t, stops in enumerate(_stops(goes_on)):
            before = state.copy()
            before[stops] = 0
            pulled = (before @ recurrent).reshape(lanes, 3, h).swapaxes(0, 1)
            gates = np.add(pulled[:2], given[:2, t], order="C")
            gates *= 0.5
            np.tanh(gates, out=gates)
            gates += 1
            gates *= 0.5
            update, reset = gates
            own = np.ascontiguousarray(pulled[2])
            candidate = reset * own
            candidate += given[2, t]
            np.tanh(candidate, out=candidate)
            change = candidate - before
            state = update * change
            state += before
            result[t] = state
            if keep_parts:
                parts.append((before, own, update, reset, candidate, change))
        return result, parts

    def class_scores(self, hidden: np.ndarray) -> np.ndarray:
        scores = hidden @ self.p["to_class"].T
        scores += self.p["class_bias"][:, 0]
        return scores

    def token_scores(self, hidden: np.ndarray, of_class: slice) -> np.ndarray:
        scores = hidden @ self.p["to_token"][of_class].T
        scores += self.p["token_bias"][of_class, 0]
        return scores

    def _far(self, longest: np.float32, kind: str) -> bool:
        """Whether a score of states up to this length could lie beyond ``FARTHEST``."""
        most = np.sqrt(_squares(self.p[f"to_{kind}"])) * longest + np.abs(self.p[f"{kind}_bias"][:, 0])
        return not most.max(initial=0) < FARTHEST - 1

    def log_probabilities(self, hidden: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Natural logarithms; for tokens of rarer classes that of the class."""
        classes = self.layout.class_of(targets)
        result = np.empty(len(targets), np.float64)
        longest = np.sqrt(_squares(hidden).max(initial=0))
        far = self._far(longest, "class")
        for rows in _portions(len(targets)):
            wanted, sums = _wanted_and_sums(self.class_scores(hidden[rows]), classes[rows], far)
            result[rows] = wanted - np.log(sums)
        far = self._far(longest, "token")
        order, parts = self._by_class(classes)
        hidden, columns = hidden.take(order, axis=0), targets.take(order) % CLASS_TOKENS
        wanted, sums = np.empty((2, len(order)), hidden.dtype)
        for of_class, rows in parts:
            wanted[rows], sums[rows] = _wanted_and_sums(self.token_scores(hidden[rows], of_class), columns[rows], far)
        result[order] += wanted - np.log(sums)
        return result

    def _by_class(self, classes: np.ndarray) -> tuple[np.ndarray, list[tuple[slice, slice]]]:
        """The rows of frequent tokens in the order of their classes; the tokens of each class and its rows there."""
        order = np.argsort(classes.astype(np.int16), kind="stable")
        ends = np.searchsorted(classes.take(order), np.arange(self.layout.own_classes + 1)).tolist()
        parts = []
        for own in range(self.layout.own_classes):
            if ends[own] < ends[own + 1]:
                low = own * CLASS_TOKENS
                parts.append((slice(low, min(low + CLASS_TOKENS, self.layout.frequent)), slice(ends[own], ends[own + 1])))
        return order[: ends[-1]], parts

    def score(self, tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Sum of the natural logarithms of each text's tokens; ``tokens`` holds the texts one by one."""
        lanes, ordered, place = _laid_out(tokens, lengths)
        logs = np.zeros(len(ordered), np.float64)
        before, goes_on = _inputs(ordered, place)
        state = np.zeros((len(lanes.lengths), HIDDEN), np.float32)
        for at, valid in lanes.windows(SCORED_WINDOW):
            hidden, _ = self.states(before.take(at), goes_on.take(at), state[: at.shape[1]])
            state = hidden[-1]
            some = _where(at, valid)
            logs[some] = self.log_probabilities(_where(hidden, valid), ordered.take(some))
        sums = np.add.reduceat(logs, place) if len(place) else np.zeros(0)
        result = np.empty(len(lengths))
        result[lanes.order] = sums
        return result


class Trainer(Model):
    """Steps of gradient descent, each over one window, sized by the squares met so far per row."""

    def __init__(self, layout: Layout, parameters: Arrays) -> None:
        super().__init__(layout, {k: v.copy() for k, v in parameters.items()})
        # Short numbers are sorted by counting.
        self.short = np.uint16 if layout.inputs <= 1 << 16 else np.int64
        self.squares = {k: np.full(len(v), 1e-8, np.float32) for k, v in parameters.items()}
        self.seen = 0

    def _move(self, name: str, rows, gradient: np.ndarray) -> None:
        self.squares[name][rows] += (gradient * gradient).mean(axis=1)
        self.p[name][rows] -= RATE * gradient / np.sqrt(self.squares[name][rows])[:, None]

    def train(self, tokens: np.ndarray, lengths: np.ndarray) -> None:
        lanes, ordered, place = _laid_out(tokens, lengths)
        before, goes_on = _inputs(ordered, place)
        state = np.zeros((len(lanes.lengths), HIDDEN), np.float32)
        self.lanes = len(lanes.lengths)
        for at, valid in lanes.windows(WINDOW):
            hidden, parts = self.states(before[at], goes_on[at], state[: at.shape[1]], keep_parts=True)
            state = hidden[-1]
            self._step(before.take(at), ordered.take(at), goes_on.take(at), valid, hidden, parts)
        self.seen += len(tokens)

    def _step(self, given, targets, goes_on, valid, hidden, parts) -> None:
        h, steps, lanes = HIDDEN, *given.shape
        rows, goal = _where(hidden, valid), _where(targets, valid)
        # A window of few lanes, as at the end of the longest texts, moves less than a full one.
        share = np.float32(1 / (steps * self.lanes))
        classes = self.layout.class_of(goal)
        pull = np.empty_like(rows)
        grown = {name: np.zeros_like(self.p[name]) for name in ("to_class", "class_bias", "to_token", "token_bias")}
        longest = np.sqrt(_squares(rows).max(initial=0))
        far = self._far(longest, "class")
        for some in _portions(len(goal)):
            off = _softmax(self.class_scores(rows[some]), far)
            off.ravel()[_places(off, classes[some])] -= 1
            pull[some] = off @ self.p["to_class"]
            grown["to_class"] += off.T @ rows[some]
            grown["class_bias"][:, 0] += _ones(len(off)) @ off
        far = self._far(longest, "token")
        order, parts_of = self._by_class(classes)
        ordered, columns = rows.take(order, axis=0), goal.take(order) % CLASS_TOKENS
        pulls = np.empty_like(ordered)
        for of_class, members in parts_of:
            mine = ordered[members]
            among = _softmax(self.token_scores(mine, of_class), far)
            among.ravel()[_places(among, columns[members])] -= 1
            np.matmul(among, self.p["to_token"][of_class], out=pulls[members])
            np.matmul(among.T, mine, out=grown["to_token"][of_class])
            grown["token_bias"][of_class, 0] = _ones(len(mine)) @ among
        pull[order] = pull.take(order, axis=0) + pulls
        every = slice(None)
        moves = [(name, every, gradient * share) for name, gradient in grown.items()]
        pull *= share

        if len(goal) == valid.size:
            outer = pull.reshape(steps, lanes, h)
        else:
            outer = np.zeros((steps, lanes, h), np.float32)
            outer[valid] = pull
        on_given = np.empty((steps, lanes, 3 * h), np.float32)
        on_pulled = np.empty((steps, lanes, 3 * h), np.float32)
        befores = np.empty((steps, lanes, h), np.float32)
        recurrent, later = self.p["recurrent"], np.zeros((lanes, h), np.float32)
        stops = _stops(goes_on)
        for t in range(steps - 1, -1, -1):
            before, pulled, update, reset, candidate, change = parts[t]
            later += outer[t]
            on_candidate = later * update
            on_candidate *= 1 - candidate * candidate
            on_update = later * change
            on_update *= update
            still = 1 - update
            on_update *= still
            on_reset = on_candidate * pulled
            on_reset *= reset
            on_reset *= 1 - reset
            np.concatenate([on_update, on_reset, on_candidate], axis=1, out=on_given[t])
            on_candidate *= reset
            np.concatenate([on_update, on_reset, on_candidate], axis=1, out=on_pulled[t])
            befores[t] = before
            later *= still
            later += on_pulled[t] @ recurrent.T
            later[stops[t]] = 0
        flat_given = on_given.reshape(-1, 3 * h)
        moves.append(("recurrent", every, befores.reshape(-1, h).T @ on_pulled.reshape(-1, 3 * h)))
        moves.append(("gates", every, flat_given.sum(axis=0)[None]))
        order = np.argsort(given.ravel().astype(self.short), kind="stable")
        names, first = np.unique(given.ravel()[order], return_index=True)
        moves.append(("inputs", names, np.add.reduceat(flat_given.take(order, axis=0), first, axis=0)))
        for name, of, gradient in moves:
            self._move(name, of, np.clip(gradient, -CLIP, CLIP))


def _softmax(scores: np.ndarray, far: bool) -> np.ndarray:
    """Shares in place; scores count up to ``FARTHEST``, so that no share leaves the range of a float."""
    if far:
        np.clip(scores, -FARTHEST, FARTHEST, out=scores)
    np.exp(scores, out=scores)
    scores /= (scores @ _ones(scores.shape[1]))[:, None]
    return scores


def _wanted_and_sums(scores: np.ndarray, at: np.ndarray, far: bool) -> tuple[np.ndarray, np.ndarray]:
    """The score at column ``at`` of each row, and the sum of the powers of all its scores."""
    if far:
        np.clip(scores, -FARTHEST, FARTHEST, out=scores)
    wanted = scores.ravel().take(_places(scores, at))
    np.exp(scores, out=scores)
    return wanted, scores @ _ones(scores.shape[1])


@cache
def _row_starts(width: int) -> np.ndarray:
    return np.arange(WINDOW * LANES) * width


def _places(scores: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where the column ``at`` of each row stands in the flat array."""
    n, width = scores.shape
    return (_row_starts(width)[:n] if n <= WINDOW * LANES else np.arange(n) * width) + at


_ONES = np.ones(WINDOW * LANES, np.float32)


def _ones(n: int) -> np.ndarray:
    return _ONES[:n] if n <= len(_ONES) else np.ones(n, np.float32)


def _squares(rows: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", rows, rows)


def _stops(goes_on: np.ndarray) -> list[np.ndarray]:
    """The lanes whose state starts anew, for each step."""
    return [np.flatnonzero(row) for row in goes_on == 0]


def _where(values: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """``values[valid]``, without a copy where all are."""
    return values.reshape(valid.size, *values.shape[2:]) if valid.all() else values[valid]


def _portions(n: int) -> Iterator[slice]:
    """Rows whose scores fit into a core's cache."""
    for low in range(0, n, PORTION):
        yield slice(low, min(low + PORTION, n))


def _laid_out(tokens: np.ndarray, lengths: np.ndarray) -> tuple[Lanes, np.ndarray, np.ndarray]:
    """Lanes, the tokens in their order, and where each text starts there."""
    lanes = Lanes(lengths)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64) if len(lengths) else np.zeros(0, np.int64)
    sizes = lengths[lanes.order]
    place = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if len(sizes) else np.zeros(0, np.int64)
    ordered = tokens[np.repeat(starts[lanes.order] - place, sizes) + np.arange(len(tokens))]
    return lanes, ordered, place


def _inputs(ordered: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The token before each, which before a text's first is the end token of another, and whether the state goes on."""
    before = np.empty_like(ordered)
    before[1:] = ordered[:-1]
    goes_on = np.ones(len(ordered), np.float32)
    if len(place):
        before[place] = ordered[-1]
        goes_on[place] = 0
    return before, goes_on
