"""A character tagger in numpy: bidirectional LSTM with CRF transitions.

The recurrence takes ``STRIDE`` characters a step (a strided convolution over their
embeddings) and emits scores for each of them, so a text costs a quarter of the steps and
every character still has a tag of its own. Arrays are feature-major (features x batch):
all windows of a batch advance together in contiguous rows.

Digits share one symbol, so a shape is learnt rather than a number. Training minimises the
CRF's negative log-likelihood with Adam; everything is seeded, so a model is a function of
its examples and settings.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# Symbols of the input. 0 pads.
SYMBOLS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0 \n.,;:!?()[]{}<>|/\\@+-_=*&%#$'\"`~^"
LOWER, UPPER, OTHER = len(SYMBOLS) + 1, len(SYMBOLS) + 2, len(SYMBOLS) + 3
INPUTS = len(SYMBOLS) + 4

#: Characters a step, and numbers that describe a character.
STRIDE, EMBED = 4, 6


def _symbol(c: str) -> int:
    if c.isdigit():
        return SYMBOLS.index("0") + 1
    if c in SYMBOLS:
        return SYMBOLS.index(c) + 1
    if c.isspace() or c == "­":
        return SYMBOLS.index(" ") + 1
    return LOWER if c.islower() else UPPER if c.isupper() else OTHER


# Latin, Greek, Cyrillic; above them wide forms stand for their plain ones.
_TABLE = np.array([_symbol(chr(i)) for i in range(0x530)] + [OTHER], dtype=np.uint8)
_WIDE = np.array([_symbol(chr(i - 0xFEE0)) for i in range(0xFF01, 0xFF5F)], dtype=np.uint8)


def encode(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out = _TABLE[np.minimum(codes, 0x530)]
    if not text.isascii():
        wide = (codes > 0xFF00) & (codes < 0xFF5F)
        if wide.any():
            out[wide] = _WIDE[codes[wide] - 0xFF01]
    return out


@dataclass
class Weights:
    """Embedding; per direction the input, recurrence and bias; emissions; transitions."""

    embed: np.ndarray  # INPUTS x EMBED
    take: list[np.ndarray]  # 4H x STRIDE * EMBED
    turn: list[np.ndarray]  # 4H x H
    rest: list[np.ndarray]  # 4H
    out: np.ndarray  # STRIDE * K x 2H
    bias: np.ndarray  # STRIDE * K
    steps: np.ndarray  # K x K, from row to column
    start: np.ndarray  # K

    def arrays(self) -> list[np.ndarray]:
        return [self.embed, *self.take, *self.turn, *self.rest, self.out, self.bias, self.steps, self.start]


def fresh(hidden: int, tags: int, seed: int) -> Weights:
    rng = np.random.default_rng(seed)

    def draw(scale: float, *shape: int) -> np.ndarray:
        return rng.normal(0, scale, shape).astype(np.float32)

    rest = [np.zeros(4 * hidden, np.float32) for _ in range(2)]
    for r in rest:
        r[hidden : 2 * hidden] = 1.0  # the forget gates start open
    return Weights(
        draw(0.5, INPUTS, EMBED), [draw(0.2, 4 * hidden, STRIDE * EMBED) for _ in range(2)], [draw(1 / np.sqrt(hidden), 4 * hidden, hidden) for _ in range(2)], rest,
        draw(0.2, STRIDE * tags, 2 * hidden), np.zeros(STRIDE * tags, np.float32), np.zeros((tags, tags), np.float32), np.zeros(tags, np.float32),
    )


def _inputs(w: Weights, x: np.ndarray) -> np.ndarray:
    """Embeddings of symbols ``x`` (batch x characters): steps x STRIDE * EMBED x batch."""
    batch, n = x.shape
    index = np.ascontiguousarray(x.T).astype(np.intp)
    out = np.empty((n, EMBED, batch), np.float32)
    for e in range(EMBED):
        out[:, e] = np.take(w.embed[:, e], index)
    return out.reshape(n // STRIDE, STRIDE * EMBED, batch)


def _direction(take: np.ndarray, turn: np.ndarray, rest: np.ndarray, seen: np.ndarray, back: bool, keep: bool):
    """Runs one LSTM over the steps of ``seen``; gates i, f, o and the candidate g."""
    steps, width, batch = seen.shape
    h = turn.shape[1]
    # The logistic function is a scaled tanh: the halves of it live in the weights.
    half = np.concatenate([np.full(3 * h, 0.5, np.float32), np.ones(h, np.float32)])[:, None]
    both = np.concatenate([take, turn, rest[:, None]], axis=1) * half
    feed = np.ones((width + h + 1, batch), np.float32)
    feed[width : width + h] = 0
    state, cell = feed[width : width + h], np.zeros((h, batch), np.float32)
    outs = np.empty((steps, h, batch), np.float32)
    z, u = np.empty((4 * h, batch), np.float32), np.empty((h, batch), np.float32)
    past = []
    for t in range(steps - 1, -1, -1) if back else range(steps):
        if keep:
            before, z, u = (state.copy(), cell), np.empty_like(z), np.empty_like(u)
            cell = cell.copy()
        feed[:width] = seen[t]
        np.matmul(both, feed, out=z)
        np.tanh(z, out=z)
        gates = z[: 3 * h]
        gates *= 0.5
        gates += 0.5
        cell *= z[h : 2 * h]
        np.multiply(z[:h], z[3 * h :], out=u)
        cell += u
        np.tanh(cell, out=u)
        np.multiply(u, z[2 * h : 3 * h], out=outs[t])
        state[:] = outs[t]
        if keep:
            past.append((t, z, u, *before))
    return outs, past


def emissions(w: Weights, x: np.ndarray, keep: bool = False):
    """Scores (characters x tags x batch) of symbols (batch x characters, a multiple of STRIDE)."""
    seen = _inputs(w, x)
    ahead, past_a = _direction(w.take[0], w.turn[0], w.rest[0], seen, False, keep)
    back, past_b = _direction(w.take[1], w.turn[1], w.rest[1], seen, True, keep)
    states = np.concatenate([ahead, back], axis=1)
    e = np.matmul(w.out, states)
    e += w.bias[:, None]
    return e.reshape(x.shape[1], len(w.start), len(x)), seen, states, past_a, past_b


def _gradient(take: np.ndarray, turn: np.ndarray, seen: np.ndarray, past, d_out: np.ndarray):
    h = turn.shape[1]
    d_take, d_turn, d_rest = np.zeros_like(take), np.zeros_like(turn), np.zeros(4 * h, np.float32)
    d_seen = np.empty_like(seen)
    d_state = np.zeros((h, seen.shape[2]), np.float32)
    d_cell = np.zeros_like(d_state)
    for t, z, squashed, state, cell in reversed(past):
        i, f, o, g = z[:h], z[h : 2 * h], z[2 * h : 3 * h], z[3 * h :]
        dh = d_state + d_out[t]
        dc = d_cell + dh * o * (1 - squashed**2)
        dz = np.concatenate([dc * g * i * (1 - i), dc * cell * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - g**2)])
        d_take += dz @ seen[t].T
        d_turn += dz @ state.T
        d_rest += dz.sum(1)
        d_seen[t] = take.T @ dz
        d_state = turn.T @ dz
        d_cell = dc * f
    return d_take, d_turn, d_rest, d_seen


def crf(w: Weights, e: np.ndarray, y: np.ndarray):
    """Mean negative log-likelihood of tags ``y`` (characters x batch), and its gradients.

    Forward and backward sums are kept as scaled probabilities.
    """
    n, tags, batch = e.shape
    top = e.max(1, keepdims=True)
    p = np.exp(e - top)
    lift = w.steps.max()
    move = np.exp(w.steps - lift)
    alpha, beta = np.empty_like(p), np.empty_like(p)
    scale = np.empty((n, batch), np.float32)
    a = p[0] * np.exp(w.start - w.start.max())[:, None]
    for t in range(n):
        if t:
            a = (move.T @ alpha[t - 1]) * p[t]
        scale[t] = a.sum(0)
        alpha[t] = a / scale[t]
    beta[-1] = 1
    d_steps = np.zeros_like(w.steps)
    for t in range(n - 2, -1, -1):
        ahead = p[t + 1] * beta[t + 1] / scale[t + 1]
        beta[t] = move @ ahead
        d_steps += alpha[t] @ ahead.T
    d_steps *= move
    total = np.log(scale).sum(0) + top.sum((0, 1)) + lift * (n - 1) + w.start.max()
    d_e = alpha * beta
    d_start = d_e[0].sum(1)
    at = (np.arange(n)[:, None], y, np.arange(batch))
    gold = e[at].sum(0) + w.start[y[0]] + w.steps[y[:-1], y[1:]].sum(0)
    d_e[at] -= 1
    np.add.at(d_start, y[0], -1)
    np.add.at(d_steps, (y[:-1].ravel(), y[1:].ravel()), -1)
    return float((total - gold).mean()), d_e / batch, d_steps / batch, d_start / batch


def loss(w: Weights, x: np.ndarray, y: np.ndarray):
    """Loss and gradients in the order of ``Weights.arrays`` for a batch of equal length."""
    hidden, tags = w.turn[0].shape[1], len(w.start)
    e, seen, states, past_a, past_b = emissions(w, x, keep=True)
    value, d_e, d_steps, d_start = crf(w, e, y)
    d_e = d_e.astype(np.float32).reshape(len(states), STRIDE * tags, len(x))
    d_states = np.matmul(w.out.T, d_e)
    ta, ra, ba, sa = _gradient(w.take[0], w.turn[0], seen, past_a, d_states[:, :hidden])
    tb, rb, bb, sb = _gradient(w.take[1], w.turn[1], seen, past_b, d_states[:, hidden:])
    d_seen = (sa + sb).reshape(x.shape[1], EMBED, len(x))
    d_embed = np.stack([np.bincount(x.T.ravel(), d_seen[:, k].ravel(), INPUTS) for k in range(EMBED)], axis=1)
    return value, [d_embed, ta, tb, ra, rb, ba, bb, np.einsum("tkb,thb->kh", d_e, states, optimize=True), d_e.sum((0, 2)), d_steps, d_start]


def train(examples: list[tuple[str, np.ndarray]], tags: int, hidden: int = 24, epochs: int = 6, batch: int = 96, rate: float = 0.012, seed: int = 5) -> Weights:
    """Fit to (text, tag of each character); texts are padded to whole steps."""
    w = fresh(hidden, tags, seed)
    arrays = w.arrays()
    first = [np.zeros_like(a) for a in arrays]
    second = [np.zeros_like(a) for a in arrays]
    rng = np.random.default_rng(seed)
    coded = [(encode(t), y) for t, y in examples if t]
    step, steps = 0, epochs * -(-len(coded) // batch)
    for _ in range(epochs):
        # Neighbours in length share a batch; the order of batches is random.
        order = sorted(range(len(coded)), key=lambda k: len(coded[k][0]) + rng.uniform(0, 2 * STRIDE))
        groups = [order[k : k + batch] for k in range(0, len(order), batch)]
        rng.shuffle(groups)
        for group in groups:
            n = -(-max(len(coded[k][0]) for k in group) // STRIDE) * STRIDE
            x, y = np.zeros((len(group), n), np.uint8), np.zeros((n, len(group)), np.int64)
            for b, k in enumerate(group):
                x[b, : len(coded[k][0])] = coded[k][0]
                y[: len(coded[k][1]), b] = coded[k][1]
            _, grads = loss(w, x, y)
            norm = np.sqrt(sum(float((g**2).sum()) for g in grads))
            clip = min(1.0, 5.0 / (norm + 1e-9))
            step += 1
            now = rate * min(1.0, step / 20) * (1 - 0.95 * step / steps)
            for a, g, m, v in zip(arrays, grads, first, second, strict=True):
                g = (g * clip).astype(np.float32)
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                a -= (now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return w


class Decoder:
    """Weights arranged for decoding, and buffers that batches share.

    Scores are taken relative to tag 0 (outside), which changes no path, so that tag has
    no rows; logistic gates are scaled tanh, their halves live in the weights.
    """

    def __init__(self, w: Weights):
        self.w = w
        h, tags = w.turn[0].shape[1], len(w.start)
        half = np.concatenate([np.full(3 * h, 0.5, np.float32), np.ones(h, np.float32)])[:, None]
        # Columns by number of the embedding, then by place in the step.
        order = np.arange(STRIDE * EMBED).reshape(STRIDE, EMBED).T.ravel()
        self.step = [np.ascontiguousarray(np.concatenate([w.take[d][:, order], w.turn[d], w.rest[d][:, None]], axis=1) * half) for d in range(2)]
        # Rows of a character: the beginnings of all kinds, then their insides.
        rows = np.concatenate([np.arange(1, tags, 2), np.arange(2, tags, 2)])
        out, bias = w.out.reshape(STRIDE, tags, 2 * h), w.bias.reshape(STRIDE, tags)
        out, bias = (out[:, rows] - out[:, :1]).reshape(-1, 2 * h), (bias[:, rows] - bias[:, :1]).reshape(-1)
        self.out = [np.ascontiguousarray(np.concatenate([out[:, :h], bias[:, None]], axis=1)), np.ascontiguousarray(out[:, h:])]
        self.embed = np.ascontiguousarray(w.embed.T)
        # An inside follows only the beginning or the inside of its own kind.
        self.steps, self.start = w.steps - w.steps[0, 0], w.start - w.start[0]
        self.start[2::2] = -1e4
        begin, inside = np.arange(1, tags, 2), np.arange(2, tags, 2)
        for k in inside:
            others = np.setdiff1d(np.arange(tags), [k - 1, k])
            self.steps[others, k] = -1e4
        self.enter, self.onward = self.steps[0, begin][:, None], self.steps[begin, inside][:, None]
        self.stay, self.leave = self.steps[inside, inside][:, None], self.steps[rows, 0][:, None]
        self.cross = float(self.steps[1:, begin].max())
        self.buffers: dict[str, np.ndarray] = {}

    def _buffer(self, name: str, *shape: int) -> np.ndarray:
        size = int(np.prod(shape))
        have = self.buffers.get(name)
        if have is None or have.size < size:
            have = self.buffers[name] = np.empty(size, np.float32)
        return have[:size].reshape(shape)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Scores (characters x rows x batch) relative to outside."""
        batch, n = x.shape
        steps, h = n // STRIDE, self.w.turn[0].shape[1]
        width = STRIDE * EMBED
        index = np.ascontiguousarray(x.T).astype(np.intp)
        seen = self._buffer("seen", EMBED, n, batch)
        for e in range(EMBED):
            np.take(self.embed[e], index, out=seen[e], mode="clip")
        scores = self._buffer("scores", steps, len(self.out[0]), batch)
        more = self._buffer("more", len(self.out[0]), batch)
        feed = self._buffer("feed", width + h + 1, batch)
        z, u, cell = self._buffer("z", 4 * h, batch), self._buffer("u", h, batch), self._buffer("cell", h, batch)
        place, state = feed[:width].reshape(EMBED, STRIDE, batch), feed[width : width + h]
        gates, i, f, o, g = z[: 3 * h], z[:h], z[h : 2 * h], z[2 * h : 3 * h], z[3 * h :]
        feed[-1] = 1
        for way in range(2):
            state[:] = 0
            cell[:] = 0
            for t in range(steps - 1, -1, -1) if way else range(steps):
                place[:] = seen[:, t * STRIDE : (t + 1) * STRIDE]
                np.matmul(self.step[way], feed, out=z)
                np.tanh(z, out=z)
                gates *= 0.5
                gates += 0.5
                cell *= f
                np.multiply(i, g, out=u)
                cell += u
                np.tanh(cell, out=u)
                np.multiply(u, o, out=state)
                if way:
                    np.matmul(self.out[1], state, out=more)
                    scores[t] += more
                else:
                    np.matmul(self.out[0], feed[width:], out=scores[t])
        return scores.reshape(n, -1, batch)

    def _doubtful(self, scores: np.ndarray) -> np.ndarray:
        """Windows in which some stretch of items may beat outside.

        The best stretches of each kind that end at a character are followed; a change of
        kind is granted the most that any such transition adds, so no path is missed.
        """
        n, rows, batch = scores.shape
        half = rows // 2
        now = np.full((rows, batch), -1e4, np.float32)
        begin, inside = now[:half], now[half:]
        begin[:] = scores[0, :half] + self.start[1::2][:, None]
        best = now.copy()
        fresh, more = np.empty((half, batch), np.float32), np.empty((half, batch), np.float32)
        for t in range(1, n):
            top = now.max(0)
            top += self.cross
            np.maximum(top, self.enter, out=fresh)
            np.add(begin, self.onward, out=more)
            inside += self.stay
            np.maximum(inside, more, out=inside)
            inside += scores[t, half:]
            np.add(fresh, scores[t, :half], out=begin)
            np.maximum(best, now, out=best)
        return np.flatnonzero(((best + self.leave).max(0) >= 0) | (now.max(0) >= 0))

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The best tags (batch x characters) of symbols (batch x characters).

        Where no stretch of items can beat outside, outside is best throughout; the other
        windows go through Viterbi.
        """
        scores = self.scores(x)
        some = self._doubtful(scores)
        out = np.zeros(x.shape, np.int8)
        if len(some):
            half = scores.shape[1] // 2
            e = np.zeros((x.shape[1], 1 + 2 * half, len(some)), np.float32)
            picked = np.take(scores, some, axis=2)
            e[:, 1::2], e[:, 2::2] = picked[:, :half], picked[:, half:]
            out[some] = viterbi(self.steps, self.start, e).T
        return out


def viterbi(steps: np.ndarray, start: np.ndarray, e: np.ndarray) -> np.ndarray:
    """The best tags (characters x batch) for scores (characters x tags x batch)."""
    n, tags, batch = e.shape
    best = np.empty_like(e)
    best[0] = e[0] + start[:, None]
    ways = np.empty((tags, tags, batch), np.float32)
    for t in range(1, n):
        np.add(best[t - 1][:, None], steps[:, :, None], out=ways)
        ways.max(0, out=best[t])
        best[t] += e[t]
    path = np.empty((n, batch), np.int8)
    now = best[-1].argmax(0)
    path[-1] = now
    into = np.ascontiguousarray(steps.T)
    for t in range(n - 1, 0, -1):
        now = (best[t - 1] + into[now].T).argmax(0)
        path[t - 1] = now
    return path


def windows(lengths: np.ndarray, size: int, margin: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping windows over texts of the given lengths: text, place in it, start, end.

    The windows of a text are of equal size; the last may end earlier. Empty texts have none.
    """
    count = np.where(lengths <= size, 1, -(-(lengths - 2 * margin) // (size - 2 * margin)))
    count[lengths == 0] = 0
    step = -(-np.maximum(lengths - 2 * margin, 1) // np.maximum(count, 1))
    text = np.repeat(np.arange(len(lengths)), count)
    place = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    start = place * step[text]
    last = place == count[text] - 1
    return text, place, start, np.where(last, lengths[text], start + step[text] + 2 * margin)


def tag(decoder: Decoder, texts: list[str], size: int, margin: int, batch: int = 1024) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text the places of the characters inside items, in order, and their tags.

    Whole texts are read through overlapping windows. Of two verdicts on a character the
    one farther from its window's edge counts: the middle of an overlap divides it.
    """
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    base = np.cumsum(lengths) - lengths
    codes = np.concatenate([encode("".join(texts)), np.zeros(size + 8 * STRIDE, np.uint8)])
    owner, place, start, end = windows(lengths, size, margin)
    # What a window answers for: up to the middle of the overlaps with its neighbours.
    half = (start[1:] + end[:-1]) // 2
    more = place[1:] > 0
    first, last = start.copy(), end.copy()
    first[1:][more], last[:-1][more] = half[more], half[more]
    widths = -(-(end - start) // (4 * STRIDE)) * (4 * STRIDE)
    start = start + base[owner]
    out = np.zeros(len(codes), np.int8)
    # Windows of nearly equal length go together, padded to the same number of steps.
    order = np.argsort(widths, kind="stable")
    for same in np.split(order, np.flatnonzero(np.diff(widths[order])) + 1) if len(order) else ():
        reach = np.arange(widths[same[0]])
        for k in range(0, len(same), batch):
            some = same[k : k + batch]
            x = codes[start[some][:, None] + reach]
            x[reach >= (end[some] + base[owner[some]] - start[some])[:, None]] = 0
            tags = decoder.decode(x)
            for b in np.flatnonzero(tags.any(1)):
                w = some[b]
                at = base[owner[w]]
                out[at + first[w] : at + last[w]] = tags[b, at + first[w] - start[w] : at + last[w] - start[w]]
    inside = np.flatnonzero(out)
    cut = np.searchsorted(inside, np.append(base, base[-1:] + lengths[-1:]))
    return [(inside[a:z] - at, out[inside[a:z]]) for a, z, at in zip(cut[:-1], cut[1:], base.tolist(), strict=True)]
