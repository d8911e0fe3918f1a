"""A linear-chain conditional random field with two states: exact marginals, maximum likelihood fit and Viterbi decoding.

Tokens of all chains stand in one array; unary weights are log odds of state 1, `trans` is a 2x2 of factors between
neighbours. Probabilities are normalised at every step, so chains of any length are safe.
"""

import numpy as np

STEPS = 60
RATE = 0.15
RIDGE = 1e-4


class Chains:
    """Flat tokens of many chains, walked step by step over all chains at once, longest first."""

    def __init__(self, lengths):
        lengths = np.asarray(lengths, np.int64)
        order = np.argsort(-lengths, kind="stable")
        starts = (np.cumsum(lengths) - lengths)[order]
        falling = lengths[order]
        longest = int(falling[0]) if len(falling) else 0
        alive = np.searchsorted(-falling, -np.arange(longest), side="left")
        self.steps = [starts[:n] + t for t, n in enumerate(alive)]

    def forward_backward(self, unary, trans):
        """Normalised forward and backward probabilities of state 1 per token; unary are log odds, trans a 2x2 of weights."""
        odds, ahead, behind = np.exp(np.clip(unary, -30, 30)), np.empty(len(unary)), np.full(len(unary), 0.5)
        before = None
        for at in self.steps:
            if before is None:
                up, down = odds[at], 1.0
            else:
                p = before[: len(at)]
                up, down = odds[at] * ((1 - p) * trans[0][1] + p * trans[1][1]), (1 - p) * trans[0][0] + p * trans[1][0]
            before = ahead[at] = up / (up + down)
        for at, after in zip(self.steps[-2::-1], self.steps[:0:-1]):
            at = at[: len(after)]
            q, e = behind[after], odds[after]
            up, down = trans[1][0] * (1 - q) + trans[1][1] * e * q, trans[0][0] * (1 - q) + trans[0][1] * e * q
            behind[at] = up / (up + down)
        return odds, ahead, behind

    def marginals(self, unary, trans):
        _, ahead, behind = self.forward_backward(unary, trans)
        up = ahead * behind
        return up / (up + (1 - ahead) * (1 - behind))

    def pairs(self, odds, ahead, behind, trans):
        """Expected counts of neighbouring states, 2x2."""
        total = np.zeros((2, 2))
        for at, after in zip(self.steps, self.steps[1:]):
            p, q, e = ahead[at[: len(after)]], behind[after], odds[after]
            cell = np.stack([(1 - p) * trans[0][0] * (1 - q), (1 - p) * trans[0][1] * e * q,
                             p * trans[1][0] * (1 - q), p * trans[1][1] * e * q])
            total += (cell / cell.sum(axis=0)).sum(axis=1).reshape(2, 2)
        return total


def fit(chains, bias=0.0, least=3, steps=STEPS, rate=RATE, ridge=RIDGE):
    """(weights by feature, bias, trans) from [(features of each token, marks)], by Adam on the exact likelihood.

    Features that occur in fewer than `least` tokens are left out. Tokens with equal features share their sums.
    """
    counts, kinds, tokens = {}, {}, []
    for own, _ in chains:
        for features in own:
            features = tuple(features)
            tokens.append(kinds.setdefault(features, len(kinds)))
            for f in features:
                counts[f] = counts.get(f, 0) + 1
    names = {f: i for i, f in enumerate(f for f, n in counts.items() if n >= least)}
    links = [(i, names[f]) for features, i in kinds.items() for f in features if f in names]
    kind_of, feature_of = np.array(links, np.int64).reshape(-1, 2).T
    tokens = np.array(tokens, np.int64)
    y = np.array([m for _, marks in chains for m in marks], float)
    walk = Chains([len(own) for own, _ in chains])
    seen = np.zeros((2, 2))
    for at, after in zip(walk.steps, walk.steps[1:]):
        np.add.at(seen, (y[at[: len(after)]].astype(int), y[after].astype(int)), 1)
    values, mean, square = [np.zeros(len(names)), bias, np.zeros((2, 2))], [0.0] * 3, [0.0] * 3
    for step in range(1, steps + 1):
        theta, bias, link = values
        per_kind = np.bincount(kind_of, theta[feature_of], len(kinds))
        odds, ahead, behind = walk.forward_backward(bias + per_kind[tokens], np.exp(link))
        up = ahead * behind
        off = y - up / (up + (1 - ahead) * (1 - behind))
        by_kind = np.bincount(tokens, off, len(kinds))
        slopes = [np.bincount(feature_of, by_kind[kind_of], len(names)) / len(y) - ridge * theta,
                  off.mean(), (seen - walk.pairs(odds, ahead, behind, np.exp(link))) / len(y) - ridge * link]
        mean = [0.9 * m + 0.1 * g for m, g in zip(mean, slopes)]
        square = [0.99 * v + 0.01 * g * g for v, g in zip(square, slopes)]
        values = [v + rate * m / (1 - 0.9 ** step) / (np.sqrt(q / (1 - 0.99 ** step)) + 1e-6)
                  for v, m, q in zip(values, mean, square)]
    theta, bias, link = values
    return {f: float(theta[i]) for f, i in names.items() if theta[i]}, float(bias), np.exp(link)


def viterbi(unary, trans):
    """The most probable states of one chain."""
    if not len(unary):
        return []
    link, back = np.log(trans).tolist(), []
    clean, marked = 0.0, float(unary[0])
    for u in list(unary)[1:]:
        to_clean, to_marked = (clean + link[0][0], marked + link[1][0]), (clean + link[0][1], marked + link[1][1])
        back.append((to_clean[1] > to_clean[0], to_marked[1] > to_marked[0]))
        clean, marked = max(to_clean), max(to_marked) + float(u)
    states = [marked > clean]
    for choice in reversed(back):
        states.append(choice[states[-1]])
    return [int(s) for s in reversed(states)]
