"""A bidirectional LSTM over pairs of characters with CRF transitions over characters, in numpy alone.

A step reads two characters and scores both, which halves the steps.  ``Tagger`` scores characters and decodes windows; ``train`` fits it on labelled lines by back-propagation through time
and the CRF's forward-backward recursion, with Adam.  Weights are kept beside the module (``python -m
callweave.llm.personal_model [STEPS]`` makes them from the bounded sample of ``personal_samples``; seeds and steps are fixed).
"""

from __future__ import annotations

import ctypes
import multiprocessing
import sys
import time
import unicodedata
from functools import lru_cache
from pathlib import Path

import numpy as np

HIDDEN, EMBED, TAGS = 48, 20, 11
#: Steps of training behind the stored weights.
STEPS = 5000
WEIGHTS = Path(__file__).with_name("personal_weights.npz")
_ASCII = 128
#: Beyond ASCII: Latin capital, Latin small, other digit, other letter, mark or symbol, replacement character, blank.
SYMBOLS = _ASCII + 8


def one_thread() -> None:
    """Keeps this process's matrix products on one core: they are small, and the other cores have tasks of their own."""
    for found in [*Path(np.__file__).parent.parent.glob("numpy.libs/*openblas*"), *Path(np.__file__).parent.glob(".libs/*openblas*")]:
        library = ctypes.CDLL(str(found))
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)


@lru_cache(65536)
def symbol(c: str) -> int:
    code = ord(c)
    if code < _ASCII:
        return code
    if c == "�":
        return _ASCII + 5
    kind = unicodedata.category(c)
    if kind == "Nd":
        return ord("0") + unicodedata.digit(c)
    if kind[0] == "L":
        base = unicodedata.normalize("NFKD", c)[0]
        if ord(base) < _ASCII and base.isalpha():
            return _ASCII + (0 if base.isupper() else 1)
        return _ASCII + 3
    if c == "©":
        return _ASCII + 7
    return _ASCII + 6 if kind in ("Zs", "Cf") else _ASCII + 4


#: ``symbol`` of the characters up to U+FFFF that were met, else 255.
_MET = np.full(0x10000, 255, np.uint8)


def encode(text: str) -> np.ndarray:
    if text.isascii():
        return np.frombuffer(text.encode(), dtype=np.uint8)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out = np.take(_MET, codes, mode="clip")
    out[codes > 0xFFFF] = 255
    for i in np.flatnonzero(out == 255).tolist():
        out[i] = symbol(text[i])
        if codes[i] <= 0xFFFF:
            _MET[codes[i]] = out[i]
    return out


def pairs(x: np.ndarray) -> np.ndarray:
    """(2, steps, batch) of symbols (time, batch): first and second characters of the steps, a blank after an odd end."""
    if len(x) % 2:
        x = np.concatenate([x, np.full((1, x.shape[1]), 32, x.dtype)])
    return np.stack([x[::2], x[1::2]])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def initial(seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    h, e = HIDDEN, EMBED
    w = {"emb": rng.normal(0, 0.3, (SYMBOLS, e)), "out": rng.normal(0, 0.2, (2 * h, 2 * TAGS)), "out_b": np.zeros(2 * TAGS), "trans": np.zeros((TAGS, TAGS)), "first": np.zeros(TAGS)}
    for d in "fb":
        w[f"x{d}"] = rng.normal(0, (2 * e) ** -0.5, (e, 4 * h))
        w[f"y{d}"] = rng.normal(0, (2 * e) ** -0.5, (e, 4 * h))
        w[f"h{d}"] = rng.normal(0, h**-0.5, (h, 4 * h))
        bias = np.zeros(4 * h)
        bias[h : 2 * h] = 1
        w[f"b{d}"] = bias
    return {k: v.astype(np.float32) for k, v in w.items()}


def _run(t: dict[str, np.ndarray], d: str, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, list]:
    """Hidden states (steps, batch, hidden) of one direction over pairs, with what back-propagation needs; zero beyond a line's end."""
    _, steps, batch = x.shape
    rec, inputs = t[f"h{d}"], t[f"x{d}"][x[0]] + t[f"y{d}"][x[1]]
    h, c = np.zeros((batch, HIDDEN), np.float32), np.zeros((batch, HIDDEN), np.float32)
    out, saved = np.empty((steps, batch, HIDDEN), np.float32), []
    n = HIDDEN
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        z = inputs[t]
        z += h @ rec
        gates = np.tanh(z)  # the three sigmoid gates were scaled by one half in the weights
        i, f, o = (gates[:, :n] + 1) * 0.5, (gates[:, n : 2 * n] + 1) * 0.5, (gates[:, 2 * n : 3 * n] + 1) * 0.5
        g = gates[:, 3 * n :]
        c_new = (f * c + i * g) * mask[t][:, None]
        tc = np.tanh(c_new)
        h_new = o * tc
        saved.append((t, h, c, i, f, o, g, tc))
        h, c = h_new, c_new
        out[t] = h
    return out, saved


def _tables(w: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """What each symbol, as the first and as the second of a pair, puts into the gates; the sigmoid gates are halved (sigmoid(x) = (tanh(x / 2) + 1) / 2)."""
    half = np.ones(4 * HIDDEN, np.float32)
    half[: 3 * HIDDEN] = 0.5
    bias = {"x": 1, "y": 0}
    return {f"{k}{d}": (w["emb"] @ w[f"{k}{d}"] + bias[k] * w[f"b{d}"]) * half for d in "fb" for k in "xy"} | {f"h{d}": w[f"h{d}"] * half for d in "fb"}


class Tagger:
    """Scores and decodes lines.  Gates lie apart as (gate, line, unit), and a step only touches lines that reach it.

    A sigmoid gate is (tanh(z / 2) + 1) / 2: the inner half is in the weights, the outer ones too, as hidden states are held twice their size.
    """

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights
        t, n = _tables(weights), HIDDEN
        apart = lambda m: np.ascontiguousarray(m.reshape(len(m), 4, n).transpose(1, 0, 2))
        self.tables = {d: apart((t[f"x{d}"][:, None] + t[f"y{d}"][None]).reshape(-1, 4 * n)) for d in "fb"}  # by pair of symbols
        self.rec = {d: apart(t[f"h{d}"] * np.float32(0.5)) for d in "fb"}
        half = weights["out"].T * np.float32(0.5)
        self.out = {"f": np.ascontiguousarray(half[:, :n]), "b": np.ascontiguousarray(half[:, n:])}
        trans = weights["trans"].astype(np.float32)
        rise, kinds = trans - trans[0, 0], np.arange(1, TAGS, 2)
        self.enter, self.leave, self.start = rise[0, 1:, None], rise[1:, 0, None], (weights["first"][1:] - weights["first"][0])[:, None]
        self.own = {(x, y): rise[kinds + x, kinds + y][:, None] for x in (0, 1) for y in (0, 1)}  # from the first (0) or an inner (1) tag of a kind to such a one
        apart_kinds = (np.arange(1, TAGS)[:, None] - 1) // 2 != (np.arange(1, TAGS)[None] - 1) // 2
        self.cross = np.where(apart_kinds, rise[1:, 1:], -np.inf).max(axis=0)[:, None]

    def emissions(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """(time, batch, tags) scores for symbols (time, batch); lines must come longest first."""
        first, second = pairs(x)
        both = first.astype(np.intp) * SYMBOLS + second
        steps, batch = both.shape
        n = HIDDEN
        scores = np.empty((steps, 2 * TAGS, batch), np.float32)
        scores[:] = self.w["out_b"][:, None]
        live = np.searchsorted(-lengths, -2 * np.arange(steps), side="left")  # lines longer than 2 t
        gates, looked = np.empty((4, batch, n), np.float32), np.empty((4, batch, n), np.float32)
        for d in "fb":
            h, c, tc = np.zeros((batch, n), np.float32), np.zeros((batch, n), np.float32), np.empty((batch, n), np.float32)
            table, rec, out = self.tables[d], self.rec[d], self.out[d]
            for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                k = live[t]
                z, hk, ck, tk = gates[:, :k], h[:k], c[:k], tc[:k]
                np.matmul(hk, rec, out=z)
                z += np.take(table, both[t, :k], axis=1, out=looked[:, :k], mode="clip")
                np.tanh(z, out=z)
                z[:3] += 1
                ck *= z[1]
                z[3] *= z[0]
                ck += z[3]
                ck *= 0.5
                np.tanh(ck, out=tk)
                np.multiply(z[2], tk, out=hk)
                scores[t, :, :k] += out @ hk.T
        return scores.reshape(2 * steps, TAGS, batch)[: len(x)].transpose(0, 2, 1)

    def surely_plain(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Lines, longest first, whose best path is all outside: no stretch of other tags gains anything.

        Steps within a kind count exactly, those from one kind to another as the best of them after the best stretch so far.
        """
        by_tag = scores.transpose(0, 2, 1)
        gain = by_tag[:, 1:] - by_tag[:, :1]
        live = np.searchsorted(-lengths, -np.arange(len(by_tag) + 1), side="left")  # lines longer than t
        now = gain[0] + self.start
        best = np.full(len(lengths), -np.inf, np.float32)
        for t, (k, after) in enumerate(zip(live, live[1:])):
            if t:
                first, inner = now[0::2, :k], now[1::2, :k]
                then = np.maximum(self.enter, now[:, :k].max(axis=0) + self.cross)
                for y in (0, 1):
                    np.maximum(then[y::2], first + self.own[0, y], out=then[y::2])
                    np.maximum(then[y::2], inner + self.own[1, y], out=then[y::2])
                then += gain[t, :, :k]
                now = then
            np.maximum(best[:k], (now + self.leave).max(axis=0), out=best[:k])
            if after < k:  # these end here
                np.maximum(best[after:k], now[:, after:k].max(axis=0), out=best[after:k])
        return best < -1e-3

    def decode(self, scores: np.ndarray, lengths: np.ndarray) -> list[np.ndarray | None]:
        """The best tag sequence of each column of (time, batch, tags); None if it is all outside."""
        out: list[np.ndarray | None] = [None] * len(lengths)
        open_ = np.flatnonzero(~self.surely_plain(scores, lengths))
        if len(open_):
            for j, path in zip(open_.tolist(), self._viterbi(scores[: lengths[open_].max(), open_], lengths[open_])):
                out[j] = path if path.any() else None
        return out

    def _viterbi(self, scores: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
        steps, batch, _ = scores.shape
        by_tag = np.ascontiguousarray(scores.transpose(0, 2, 1))
        trans = self.w["trans"]
        kept = np.empty_like(by_tag)
        kept[0] = by_tag[0] + self.w["first"][:, None]
        for t in range(1, steps):
            kept[t] = (kept[t - 1][:, None, :] + trans[:, :, None]).max(axis=0) + by_tag[t]
        last, columns = lengths - 1, np.arange(batch)
        tag = kept[last, :, columns].argmax(axis=1)
        path = np.zeros((steps, batch), np.int8)
        for t in range(steps - 1, -1, -1):
            live = t <= last
            path[t, live] = tag[live]
            if t:
                tag = np.where(live, (kept[t - 1] + trans[:, tag]).argmax(axis=0), tag)
        return [path[:n, j] for j, n in enumerate(lengths)]


def _crf_gradient(scores: np.ndarray, tags: np.ndarray, mask: np.ndarray, trans: np.ndarray, first: np.ndarray):
    """Loss and gradients of the CRF's negative log likelihood; everything is (time, batch, ...)."""
    steps, batch, n = scores.shape
    alpha = np.empty_like(scores)
    alpha[0] = scores[0] + first
    top = trans.max()
    e_trans = np.exp(trans - top)
    for t in range(1, steps):
        m = alpha[t - 1].max(axis=1, keepdims=True)
        step = np.log(np.exp(alpha[t - 1] - m) @ e_trans + 1e-30) + m + top + scores[t]
        alpha[t] = np.where(mask[t][:, None], step, alpha[t - 1])
    m = alpha[-1].max(axis=1, keepdims=True)
    z = np.log(np.exp(alpha[-1] - m).sum(axis=1)) + m[:, 0]
    beta = np.zeros((batch, n), np.float32)
    grad, g_trans = np.empty_like(scores), np.zeros_like(trans)
    for t in range(steps - 1, -1, -1):
        grad[t] = np.exp(alpha[t] + beta - z[:, None]) * mask[t][:, None]
        if t:
            inner = scores[t] + beta
            m = inner.max(axis=1, keepdims=True)
            e_inner = np.exp(inner - m)
            before = np.log(e_inner @ e_trans.T + 1e-30) + m + top
            m1 = alpha[t - 1].max(axis=1, keepdims=True)
            weight = np.exp(m1[:, 0] + m[:, 0] + top - z) * mask[t]
            g_trans += e_trans * ((np.exp(alpha[t - 1] - m1) * weight[:, None]).T @ e_inner)
            beta = np.where(mask[t][:, None], before, beta)
    g_first = grad[0].copy()
    rows = np.arange(batch)
    gold = np.zeros(batch, np.float32)
    for t in range(steps):
        grad[t, rows, tags[t]] -= mask[t]
        gold += scores[t, rows, tags[t]] * mask[t]
        if t:
            np.add.at(g_trans, (tags[t - 1], tags[t]), -mask[t].astype(np.float32))
            gold += trans[tags[t - 1], tags[t]] * mask[t]
    np.add.at(g_first, (rows, tags[0]), -1.0)
    return float((z - gold - first[tags[0]]).sum()), grad, g_trans, g_first.sum(axis=0)


def _gradients(w: dict[str, np.ndarray], x: np.ndarray, tags: np.ndarray, mask: np.ndarray):
    t, n, length = _tables(w), HIDDEN, len(x)
    x, pair_mask = pairs(x), mask[::2]
    _, steps, batch = x.shape
    out, saved = {}, {}
    for d in "fb":
        out[d], saved[d] = _run(t, d, x, pair_mask)
    both = np.concatenate([out["f"], out["b"]], axis=2)
    scores = (both @ w["out"] + w["out_b"]).reshape(steps, batch, 2, TAGS).transpose(0, 2, 1, 3).reshape(2 * steps, batch, TAGS)[:length]
    loss, g, g_trans, g_first = _crf_gradient(scores, tags, mask, w["trans"], w["first"])
    g = np.concatenate([g, np.zeros((2 * steps - length, batch, TAGS), g.dtype)]).reshape(steps, 2, batch, TAGS).transpose(0, 2, 1, 3).reshape(steps, batch, 2 * TAGS)
    grads = {k: np.zeros_like(v) for k, v in w.items()}
    grads["trans"], grads["first"] = g_trans, g_first
    grads["out"] = np.tensordot(both, g, axes=([0, 1], [0, 1]))
    grads["out_b"] = g.sum(axis=(0, 1))
    g_both = g @ w["out"].T
    for k, d in enumerate("fb"):
        dh_next, dc_next = np.zeros_like(out[d][0]), np.zeros_like(out[d][0])
        gz_all = np.empty((steps, batch, 4 * n), np.float32)
        for step, h, c, i, f, o, gate, tc in reversed(saved[d]):
            here = pair_mask[step][:, None]
            dh = (g_both[step, :, k * n : (k + 1) * n] + dh_next) * here
            dc = (dc_next + dh * o * (1 - tc * tc)) * here
            z = np.concatenate([dc * gate * i * (1 - i), dc * c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - gate * gate)], axis=1)
            grads[f"h{d}"] += h.T @ z
            dh_next, dc_next = z @ w[f"h{d}"].T, dc * f
            gz_all[step] = z
        flat = gz_all.reshape(-1, 4 * n)
        for side, own in zip("xy", x):
            per_symbol = np.zeros((SYMBOLS, 4 * n), np.float32)
            order = np.argsort(own.ravel(), kind="stable")
            ids, begin = np.unique(own.ravel()[order], return_index=True)
            per_symbol[ids] = np.add.reduceat(flat[order], begin, axis=0)
            grads[f"{side}{d}"] = w["emb"].T @ per_symbol
            grads["emb"] += per_symbol @ w[f"{side}{d}"].T
        grads[f"b{d}"] = per_symbol.sum(axis=0)
    return loss, grads


def _share(task: tuple[dict[str, np.ndarray], list[tuple[str, list[int]]]]) -> tuple[float, dict[str, np.ndarray]]:
    """Loss and gradients of a share of a batch."""
    w, lines = task
    longest = max(len(t) for t, _ in lines)
    x, tags, mask = np.full((longest, len(lines)), 32), np.zeros((longest, len(lines)), np.int64), np.zeros((longest, len(lines)), bool)
    for j, (text, labels) in enumerate(lines):
        x[: len(text), j], tags[: len(text), j], mask[: len(text), j] = encode(text), labels, True
    return _gradients(w, x, tags, mask)


def train(lines: list[tuple[str, list[int]]], steps: int, batch: int = 512, rate: float = 5e-3, seed: int = 7, workers: int = 8, report=print) -> dict[str, np.ndarray]:
    """``steps`` steps of Adam over batches of lines of similar length, cut into equal shares; the rate falls linearly to a fiftieth."""
    w = initial(seed)
    rng = np.random.default_rng(seed)
    order = sorted(range(len(lines)), key=lambda k: len(lines[k][0]))
    chunks = [order[k : k + batch] for k in range(0, len(order), batch)]
    m = {k: np.zeros_like(v) for k, v in w.items()}
    v2 = {k: np.zeros_like(v) for k, v in w.items()}
    began, shown = time.time(), 0.0
    with multiprocessing.get_context("fork").Pool(workers, one_thread) as pool:
        for step in range(1, steps + 1):
            rows = chunks[rng.integers(len(chunks))]
            parts = pool.map(_share, [(w, [lines[k] for k in rows[i::workers]]) for i in range(workers) if rows[i::workers]], 1)
            loss, grads = sum(p[0] for p in parts), {k: sum(p[1][k] for p in parts) for k in w}
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values())) / len(rows)
            scale = min(1.0, 5.0 / (norm + 1e-9)) / len(rows)
            now = rate * max(0.02, 1 - step / steps) * min(1.0, step / 100)
            for k, g in grads.items():
                g = g * scale
                m[k] = 0.9 * m[k] + 0.1 * g
                v2[k] = 0.999 * v2[k] + 0.001 * g * g
                w[k] = (w[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            shown = 0.98 * shown + 0.02 * loss / len(rows)
            if step % 250 == 0:
                report(f"step {step}: {shown:.3f} a line, {time.time() - began:.0f} s", flush=True)
    return w


def load(path: Path = WEIGHTS) -> dict[str, np.ndarray]:
    with np.load(path) as stored:
        return {k: stored[k].astype(np.float32) for k in stored.files}


if __name__ == "__main__":
    from callweave.llm.personal_samples import sample

    found = train(sample(), int(sys.argv[1]) if len(sys.argv) > 1 else STEPS)
    np.savez_compressed(WEIGHTS, **{k: v.astype(np.float16) for k, v in found.items()})
