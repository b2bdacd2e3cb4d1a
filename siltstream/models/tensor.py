"""Reverse-mode gradients over NumPy arrays, enough to train the small networks of this package."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def _fold(gradient: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """Sum a gradient over the axes along which its operand was broadcast."""
    while gradient.ndim > len(shape):
        gradient = gradient.sum(axis=0)
    for axis, size in enumerate(shape):
        if size == 1 and gradient.shape[axis] != 1:
            gradient = gradient.sum(axis=axis, keepdims=True)
    return gradient


def sum_by(values: np.ndarray, owner: np.ndarray, size: int) -> np.ndarray:
    """Sum of rows by owner. Rows are sorted once, as adding
    them one at a time to where they belong takes many times as long."""
    out = np.zeros((size, *values.shape[1:]))
    if len(owner):
        order = np.argsort(owner, kind="stable")
        placed = owner[order]
        starts = np.flatnonzero(np.r_[True, placed[1:] != placed[:-1]])
        out[placed[starts]] = np.add.reduceat(values[order], starts, axis=0)
    return out


class Tensor:
    """An array and how to pass a gradient on to what it was made from."""

    def __init__(self, value, parents: tuple[Tensor, ...] = (), back: Callable[[np.ndarray], tuple] | None = None):
        self.value, self.parents, self.back, self.grad = np.asarray(value, dtype=np.float64), parents, back, None

    @property
    def shape(self) -> tuple[int, ...]:
        return self.value.shape

    def __add__(self, other) -> Tensor:
        b = other if isinstance(other, Tensor) else Tensor(other)
        return Tensor(self.value + b.value, (self, b), lambda g: (_fold(g, self.shape), _fold(g, b.shape)))

    def __mul__(self, other) -> Tensor:
        b = other if isinstance(other, Tensor) else Tensor(other)
        return Tensor(self.value * b.value, (self, b), lambda g: (_fold(g * b.value, self.shape), _fold(g * self.value, b.shape)))

    def __sub__(self, other) -> Tensor:
        return self + (other if isinstance(other, Tensor) else Tensor(other)) * -1.0

    def __matmul__(self, b: Tensor) -> Tensor:
        turn = lambda x: np.swapaxes(x, -1, -2)
        return Tensor(self.value @ b.value, (self, b), lambda g: (_fold(g @ turn(b.value), self.shape), _fold(turn(self.value) @ g, b.shape)))

    def reshape(self, *shape: int) -> Tensor:
        return Tensor(self.value.reshape(shape), (self,), lambda g: (g.reshape(self.shape),))

    def transpose(self, *axes: int) -> Tensor:
        return Tensor(self.value.transpose(axes), (self,), lambda g: (g.transpose(np.argsort(axes)),))

    def take(self, index: np.ndarray) -> Tensor:
        """Rows by number."""

        def back(g: np.ndarray) -> tuple:
            return (sum_by(g, index, self.shape[0]),)

        return Tensor(self.value[index], (self,), back)

    def last(self) -> Tensor:
        """The last step of (batch, steps, width)."""

        def back(g: np.ndarray) -> tuple:
            out = np.zeros(self.shape)
            out[:, -1] = g
            return (out,)

        return Tensor(self.value[:, -1], (self,), back)

    def sum(self, axis: int | None = None, keepdims: bool = False) -> Tensor:
        def back(g: np.ndarray) -> tuple:
            if axis is not None and not keepdims:
                g = np.expand_dims(g, axis)
            return (np.broadcast_to(g, self.shape),)

        return Tensor(self.value.sum(axis=axis, keepdims=keepdims), (self,), back)

    def mean(self, axis: int, keepdims: bool = True) -> Tensor:
        return self.sum(axis, keepdims) * (1.0 / self.shape[axis])

    def apply(self, value: np.ndarray, slope: np.ndarray) -> Tensor:
        return Tensor(value, (self,), lambda g: (g * slope,))

    def relu(self) -> Tensor:
        return self.apply(np.maximum(self.value, 0), self.value > 0)

    def leaky(self, slope: float = 0.2) -> Tensor:
        k = np.where(self.value >= 0, 1.0, slope)
        return self.apply(self.value * k, k)

    def elu(self) -> Tensor:
        e = np.exp(np.minimum(self.value, 0))
        return self.apply(np.where(self.value > 0, self.value, e - 1), np.where(self.value > 0, 1.0, e))

    def gelu(self) -> Tensor:
        x = self.value
        c = np.sqrt(2 / np.pi)
        t = np.tanh(c * (x + 0.044715 * x**3))
        return self.apply(0.5 * x * (1 + t), 0.5 * (1 + t) + 0.5 * x * (1 - t**2) * c * (1 + 3 * 0.044715 * x**2))

    def power(self, p: float) -> Tensor:
        return self.apply(self.value**p, p * self.value ** (p - 1))

    def exp(self) -> Tensor:
        e = np.exp(self.value)
        return self.apply(e, e)

    def softmax(self) -> Tensor:
        e = np.exp(self.value - self.value.max(axis=-1, keepdims=True))
        p = e / e.sum(axis=-1, keepdims=True)
        return Tensor(p, (self,), lambda g: (p * (g - (g * p).sum(axis=-1, keepdims=True)),))

    def segment_sum(self, owner: np.ndarray, size: int) -> Tensor:
        """Sum of rows by owner."""
        return Tensor(sum_by(self.value, owner, size), (self,), lambda g: (g[owner],))

    def backward(self) -> None:
        order, seen = [], set()
        todo = [(self, False)]
        while todo:
            node, done = todo.pop()
            if done:
                order.append(node)
            elif id(node) not in seen:
                seen.add(id(node))
                todo.append((node, True))
                todo += [(p, False) for p in node.parents]
        self.grad = np.ones(self.shape)
        for node in reversed(order):
            if node.back is None:
                continue
            for parent, g in zip(node.parents, node.back(node.grad)):
                parent.grad = g if parent.grad is None else parent.grad + g
            if node.parents:
                node.grad = None


def concat(parts: list[Tensor]) -> Tensor:
    cuts = np.cumsum([p.shape[-1] for p in parts])[:-1]
    return Tensor(np.concatenate([p.value for p in parts], axis=-1), tuple(parts), lambda g: tuple(np.split(g, cuts, axis=-1)))


def layer_norm(x: Tensor, gain: Tensor, shift: Tensor) -> Tensor:
    centred = x - x.mean(-1)
    return centred * ((centred * centred).mean(-1) + 1e-5).power(-0.5) * gain + shift


def logistic_loss(z: Tensor, y: np.ndarray, weight: np.ndarray) -> Tensor:
    """Mean weighted cross entropy of logits."""
    p = 1 / (1 + np.exp(-np.clip(z.value, -60, 60)))
    loss = weight * (np.logaddexp(0, z.value) - y * z.value)
    return Tensor(loss.mean(), (z,), lambda g: (g * weight * (p - y) / max(len(y), 1),))


class Adam:
    """Adam with decoupled weight decay and clipping of the whole gradient's length."""

    def __init__(self, parameters: dict[str, Tensor], rate: float = 1e-3, decay: float = 1e-4, clip: float = 10.0):
        self.parameters, self.rate, self.decay, self.clip, self.step_number = parameters, rate, decay, clip, 0
        self.m = {k: np.zeros(p.shape) for k, p in parameters.items()}
        self.v = {k: np.zeros(p.shape) for k, p in parameters.items()}

    def step(self, gradients: dict[str, np.ndarray] | None = None) -> None:
        g = gradients or {k: p.grad if p.grad is not None else np.zeros(p.shape) for k, p in self.parameters.items()}
        length = np.sqrt(sum(float((x**2).sum()) for x in g.values()))
        if not np.isfinite(length):
            raise ValueError("the loss is not finite")
        scale = min(1.0, self.clip / max(length, 1e-12))
        self.step_number += 1
        t = self.step_number
        for k, p in self.parameters.items():
            x = g[k] * scale
            self.m[k] = 0.9 * self.m[k] + 0.1 * x
            self.v[k] = 0.999 * self.v[k] + 0.001 * x**2
            p.value = p.value - self.rate * (self.m[k] / (1 - 0.9**t) / (np.sqrt(self.v[k] / (1 - 0.999**t)) + 1e-8) + self.decay * p.value)
            p.grad = None
