"""A bidirectional gated recurrent layer with attention pooling, in numpy: forward, and gradients by hand."""

from __future__ import annotations

import numpy as np

Params = dict[str, np.ndarray]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def new_layer(rng: np.random.Generator, name: str, d: int, h: int, k: int) -> Params:
    """Parameters of a layer from d inputs to 2 * h outputs, with k units of attention."""
    scale = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    out = {f"{name}.A": scale(2 * h, k), f"{name}.a": np.zeros(k, np.float32), f"{name}.v": scale(k)}
    for side in "fb":
        out |= {f"{name}.W{side}": scale(d, 3 * h), f"{name}.U{side}": scale(h, 3 * h), f"{name}.b{side}": np.zeros(3 * h, np.float32)}
    return out


def projected(p: Params, name: str, x: np.ndarray) -> dict[str, np.ndarray]:
    """What inputs (..., d) add to the gates in each direction."""
    return {side: x @ p[f"{name}.W{side}"] + p[f"{name}.b{side}"] for side in "fb"}


def _states(gates: np.ndarray, u: np.ndarray, mask: np.ndarray, order, tape: list | None) -> np.ndarray:
    """Hidden states (T, N, h) from gates' inputs (T, N, 3h): update, reset, candidate; masked steps keep the state."""
    steps, n, h = gates.shape[0], gates.shape[1], u.shape[0]
    out = np.empty((steps, n, h), gates.dtype)
    state = np.zeros((n, h), gates.dtype)
    for t in order:
        back = state @ u
        both = _sigmoid(gates[t, :, : 2 * h] + back[:, : 2 * h])
        update, reset = both[:, :h], both[:, h:]
        new = np.tanh(gates[t, :, 2 * h :] + reset * back[:, 2 * h :])
        after = new + update * (state - new)
        if tape is not None:
            tape.append((t, state, update, reset, new, back[:, 2 * h :]))
        state = np.where(mask[t], after, state)
        out[t] = state
    return out


def forward(p: Params, name: str, gates: dict[str, np.ndarray], mask: np.ndarray, keep: bool = False):
    """Pooled outputs (N, 2h) of sequences: gates from ``projected`` as (T, N, 3h), mask (T, N, 1). With ``keep``
    also what ``backward`` needs. A sequence without steps gives zeros."""
    tapes = {"f": [], "b": []} if keep else {"f": None, "b": None}
    steps = mask.shape[0]
    states = np.concatenate([_states(gates["f"], p[f"{name}.Uf"], mask, range(steps), tapes["f"]), _states(gates["b"], p[f"{name}.Ub"], mask, range(steps - 1, -1, -1), tapes["b"])], axis=2)
    hidden = np.tanh(states @ p[f"{name}.A"] + p[f"{name}.a"])
    weight = np.exp(hidden @ p[f"{name}.v"])[:, :, None] * mask  # bounded: |hidden| is at most 1
    weight /= np.maximum(weight.sum(axis=0), 1e-9)
    pooled = (weight * states).sum(axis=0)
    return (pooled, (states, hidden, weight, tapes)) if keep else pooled


def backward(p: Params, name: str, x: np.ndarray, mask: np.ndarray, kept, out: np.ndarray, grads: Params) -> np.ndarray:
    """Gradient of the inputs (T, N, d) from that of the pooled outputs; those of the parameters go into ``grads``."""
    states, hidden, weight, tapes = kept
    h = states.shape[2] // 2
    of_weight = (states * out).sum(axis=2, keepdims=True)
    score = weight * (of_weight - (weight * of_weight).sum(axis=0))
    inner = score * p[f"{name}.v"] * (1 - hidden**2)
    grads[f"{name}.v"] = (score * hidden).sum(axis=(0, 1))
    grads[f"{name}.a"] = inner.sum(axis=(0, 1))
    grads[f"{name}.A"] = np.tensordot(states, inner, ((0, 1), (0, 1)))
    of_states = weight * out + inner @ p[f"{name}.A"].T
    of_x = np.zeros_like(x)
    for side, part in (("f", of_states[:, :, :h]), ("b", of_states[:, :, h:])):
        u = p[f"{name}.U{side}"]
        of_u, of_gates = np.zeros_like(u), np.zeros((*x.shape[:2], 3 * h), x.dtype)
        carry = np.zeros(part.shape[1:], x.dtype)
        for t, before, update, reset, new, back in reversed(tapes[side]):
            now = part[t] + carry
            here = now * mask[t]
            of_new = here * (1 - update) * (1 - new**2)
            of_update = here * (before - new) * update * (1 - update)
            of_reset = of_new * back * reset * (1 - reset)
            of_gates[t] = np.concatenate([of_update, of_reset, of_new], axis=1)
            of_back = np.concatenate([of_update, of_reset, of_new * reset], axis=1)
            of_u += before.T @ of_back
            carry = now - here + here * update + of_back @ u.T
        grads[f"{name}.U{side}"] = of_u
        grads[f"{name}.W{side}"] = np.tensordot(x, of_gates, ((0, 1), (0, 1)))
        grads[f"{name}.b{side}"] = of_gates.sum(axis=(0, 1))
        of_x += of_gates @ p[f"{name}.W{side}"].T
    return of_x


class Adam:
    def __init__(self, p: Params, rate: float):
        self.p, self.rate, self.turn = p, rate, 0
        self.mean, self.square = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))

    def step(self, grads: Params) -> None:
        self.turn += 1
        rate = self.rate * np.sqrt(1 - 0.999**self.turn) / (1 - 0.9**self.turn)
        for k, g in grads.items():
            self.mean[k] += 0.1 * (g - self.mean[k])
            self.square[k] += 0.001 * (g * g - self.square[k])
            self.p[k] -= rate * self.mean[k] / (np.sqrt(self.square[k]) + 1e-8)
