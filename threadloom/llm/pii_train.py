"""Training of the tagger: ``python -m threadloom.llm.pii_train DIR OUT.npz [MINUTES [RANKS [BEGIN.npz]]]``.

Two sources, half each.  One reads basic_session and new_format under DIR and labels at most ``MAX_TEXTS`` distinct texts with the patterns of
``pii_labels``; names are exchanged at random for invented ones in part of the windows.  The other makes texts of far more forms, names and
domains (``pii_forms``, with the words of a public tokenizer's file RANKS), set into texts of the tables that hold none.  The BiLSTM-CRF is fitted by back-propagation through time with
Adam; each step's batch is dealt to ``WORKERS`` processes.  A third of the texts is held out, and made texts of other names, domains,
formats and sentences are made for the test only.
"""

from __future__ import annotations

import multiprocessing as mp
import re
import sys
import time

import numpy as np

from .pii_forms import learn_words, made
from .pii_labels import ENDS, GIVEN, NAME, OTHER_FAMILIES, STEMS, TYPES, label
from .pii_model import PAD, TAGS, VOCABULARY, Tagger, encode

MAX_TEXTS = 60_000
CROP = 224
WORKERS, SIZE = 8, 48


def invented(rng: np.random.Generator) -> str:
    def word() -> str:
        parts = ["ba", "lo", "mir", "ten", "ka", "vo", "sel", "ri", "dan", "hu", "fe", "gor", "ny", "pas", "tul", "er", "is"]
        return "".join(rng.choice(parts, rng.integers(2, 4))).capitalize()

    pick = lambda: (str(rng.choice(STEMS)) + str(rng.choice(ENDS))) if rng.random() < 0.6 else (str(rng.choice(OTHER_FAMILIES)) if rng.random() < 0.5 else word())
    given = str(rng.choice(GIVEN)) if rng.random() < 0.6 else word()
    family = pick()
    r = rng.random()
    name = f"{given} {family}" if r < 0.55 else f"{given} {rng.choice(list('ABCDEKRT'))}. {family}" if r < 0.7 else f"{rng.choice(list('ABCDEFGHIKLMNOPRSTVWXYZ'))}. {family}" if r < 0.85 else f"{family}, {given}"
    r = rng.random()
    return name.upper() if r < 0.12 else name.lower() if r < 0.24 else name


def exchanged(text: str, rng: np.random.Generator) -> tuple[str, list[tuple[int, int, int]]]:
    """The text with some of its labelled names exchanged, and its spans."""
    spans, out, at, new = label(text), [], 0, []
    for s, e, k in spans:
        out.append(text[at:s])
        value = text[s:e]
        if k == TYPES.index("person_name") and rng.random() < 0.35:
            value = invented(rng)
        start = sum(map(len, out))
        out.append(value)
        new.append((start, start + len(value), k))
        at = e
    out.append(text[at:])
    return "".join(out), new


def tagged(text: str, spans: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    y = np.zeros(len(text), np.int64)
    for s, e, k in spans:
        y[s:e] = 2 + 2 * k
        y[s] = 1 + 2 * k
    return encode(text), y


def initial(hidden: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    w: dict[str, np.ndarray] = {}
    for d in "fb":
        for k in "01":
            table = rng.normal(0, 0.25, (VOCABULARY, 4 * hidden))
            if k == "0":
                table[:, :hidden] += 0.5
                table[:, hidden : 2 * hidden] += 0.8
                table[:, 2 * hidden : 3 * hidden] += 0.5
            w[f"e{d}{k}"] = table
        w[f"u{d}"] = rng.normal(0, 0.6 / np.sqrt(hidden), (hidden, 4 * hidden))
    for k in "01":
        w[f"wo{k}"] = rng.normal(0, 0.3, (2 * hidden, TAGS))
        w[f"bo{k}"] = np.zeros(TAGS)
        w[f"bo{k}"][0] = 2
    w["trans"] = rng.normal(0, 0.05, (TAGS, TAGS))
    w["start"] = np.zeros(TAGS)
    return {k: v.astype(np.float32) for k, v in w.items()}


def _cell_forward(x, first, second, u, low, reverse):
    steps, b = x.shape[0] // 2, x.shape[1]
    h = u.shape[0]
    keep = {"a": np.empty((steps, b, 4 * h), np.float32), "in": np.empty((steps, b, 4 * h), bool), "c": np.empty((steps, b, h), np.float32), "cp": np.empty((steps, b, h), np.float32), "hp": np.empty((steps, b, h), np.float32), "h": np.empty((steps, b, h), np.float32)}
    state, cell = np.zeros((b, h), np.float32), np.zeros((b, h), np.float32)
    for t in range(steps - 1, -1, -1) if reverse else range(steps):
        z = first[x[2 * t]] + second[x[2 * t + 1]] + state @ u
        a = np.clip(z, low, 1.0)
        keep["in"][t] = a == z
        keep["a"][t], keep["cp"][t], keep["hp"][t] = a, cell, state
        cell = a[:, h : 2 * h] * cell + a[:, :h] * a[:, 3 * h :]
        keep["c"][t] = cell
        state = a[:, 2 * h : 3 * h] * np.clip(cell, -1, 1)
        keep["h"][t] = state
    return keep


def _cell_backward(x, u, keep, dh_out, reverse):
    steps, b = x.shape[0] // 2, x.shape[1]
    h = u.shape[0]
    du, tables = np.zeros_like(u), []
    dh, dc = np.zeros((b, h), np.float32), np.zeros((b, h), np.float32)
    dz_all = np.empty((steps, b, 4 * h), np.float32)
    for t in range(steps) if reverse else range(steps - 1, -1, -1):
        dh = dh + dh_out[t]
        a, c = keep["a"][t], keep["c"][t]
        squashed = np.clip(c, -1, 1)
        dc = dc + dh * a[:, 2 * h : 3 * h] * (np.abs(c) < 1)
        da = dz_all[t]
        da[:, 2 * h : 3 * h] = dh * squashed
        da[:, :h] = dc * a[:, 3 * h :]
        da[:, h : 2 * h] = dc * keep["cp"][t]
        da[:, 3 * h :] = dc * a[:, :h]
        da *= keep["in"][t]
        dc = dc * a[:, h : 2 * h]
        dh = da @ u.T
    flat = dz_all.reshape(-1, 4 * h)
    du += keep["hp"].reshape(-1, h).T @ flat
    for k in (0, 1):
        classes = x[k::2].reshape(-1)
        order = np.argsort(classes, kind="stable")
        ids, starts = np.unique(classes[order], return_index=True)
        table = np.zeros((VOCABULARY, 4 * h), np.float32)
        table[ids] = np.add.reduceat(flat[order], starts, axis=0)
        tables.append(table)
    return du, tables


def loss_and_gradient(w, x, y, lengths, low):
    steps, b = x.shape
    h = w["uf"].shape[0]
    kf, kb = _cell_forward(x, w["ef0"], w["ef1"], w["uf"], low, False), _cell_forward(x, w["eb0"], w["eb1"], w["ub"], low, True)
    states = np.concatenate([kf["h"], kb["h"]], axis=2)
    e = np.stack([states @ w["wo0"] + w["bo0"], states @ w["wo1"] + w["bo1"]], axis=1).reshape(steps, b, TAGS)
    mask = np.arange(steps)[:, None] < lengths[None, :]
    # CRF by scaled forward-backward
    m = e.max(axis=2, keepdims=True)
    p = np.exp(e - m)
    big = w["trans"].max()
    tr = np.exp(w["trans"] - big)
    sb = w["start"].max()
    alpha, scale = np.empty((steps, b, TAGS), np.float32), np.ones((steps, b), np.float32)
    alpha[0] = np.exp(w["start"] - sb) * p[0]
    scale[0] = alpha[0].sum(axis=1)
    alpha[0] /= scale[0][:, None]
    for t in range(1, steps):
        a = (alpha[t - 1] @ tr) * p[t]
        s = a.sum(axis=1)
        a /= s[:, None]
        live = mask[t]
        alpha[t] = np.where(live[:, None], a, alpha[t - 1])
        scale[t] = np.where(live, s, 1)
    beta = np.ones((steps, b, TAGS), np.float32)
    for t in range(steps - 2, -1, -1):
        nb = ((p[t + 1] * beta[t + 1]) @ tr.T) / scale[t + 1][:, None]
        beta[t] = np.where(mask[t + 1][:, None], nb, 1)
    log_z = (np.log(scale) * mask + m[:, :, 0] * mask).sum(axis=0) + sb + big * (mask[1:].sum(axis=0))
    post = alpha * beta
    post /= post.sum(axis=2, keepdims=True)
    bb = np.arange(b)
    gold = (e[np.arange(steps)[:, None], bb[None, :], y] * mask).sum(axis=0) + w["start"][y[0]]
    gold += (w["trans"][y[:-1], y[1:]] * mask[1:]).sum(axis=0)
    n = mask.sum()
    de = post.copy()
    de[np.arange(steps)[:, None], bb[None, :], y] -= 1
    de *= mask[:, :, None] / n
    right = np.where(mask[1:, :, None], p[1:] * beta[1:] / scale[1:][:, :, None], 0)
    dtrans = (alpha[:-1].reshape(-1, TAGS).T @ right.reshape(-1, TAGS)) * tr / n
    np.subtract.at(dtrans, (y[:-1][mask[1:]], y[1:][mask[1:]]), 1.0 / n)
    dstart = post[0].sum(axis=0) / n
    np.subtract.at(dstart, y[0], 1.0 / n)
    g = {"trans": dtrans, "start": dstart}
    ds = np.zeros_like(states)
    for k in (0, 1):
        g[f"bo{k}"] = de[k::2].sum(axis=(0, 1))
        g[f"wo{k}"] = states.reshape(-1, 2 * h).T @ de[k::2].reshape(-1, TAGS)
        ds += de[k::2] @ w[f"wo{k}"].T
    g["uf"], (g["ef0"], g["ef1"]) = _cell_backward(x, w["uf"], kf, ds[:, :, :h], False)
    g["ub"], (g["eb0"], g["eb1"]) = _cell_backward(x, w["ub"], kb, ds[:, :, h:], True)
    for k in ("ef0", "eb0"):
        g[k][PAD] = 0
    return float((log_z - gold).sum() / n), g


def rows_and_types(tags: np.ndarray) -> set[int]:
    return {(int(t) - 1) // 2 for t in np.unique(tags) if t}


def closed(w: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The weights with padding that closes all gates and so clears the state."""
    h = w["uf"].shape[0]
    for k in ("ef0", "eb0"):
        w[k][PAD, : 3 * h], w[k][PAD, 3 * h :] = -1e4, 0
    return w


def batch(rng: np.random.Generator, full: list[str], hard: list[str], bare: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(characters, tags, lengths) of a batch of windows."""
    parts = []
    for _ in range(SIZE):
        r = rng.random()
        if r < 0.5:
            carrier = bare[rng.integers(len(bare))] if rng.random() < 0.6 else ""
            at = int(rng.integers(max(1, len(carrier) - CROP)))
            text, spans = made(rng, carrier[at : at + CROP])
        else:
            source = full if r < 0.81 else hard if r < 0.93 else bare
            text, spans = exchanged(source[rng.integers(len(source))], rng)
        x, y = tagged(text, spans)
        if len(x) > CROP:
            inside = np.flatnonzero(y)
            centre = int(rng.choice(inside)) if inside.size and rng.random() < 0.8 else int(rng.integers(len(x)))
            at = int(np.clip(centre - rng.integers(10, CROP - 10), 0, len(x) - CROP))
            x, y = x[at : at + CROP], y[at : at + CROP]
        parts.append((x, y))
    lengths = np.array([len(x) for x, _ in parts])
    steps = lengths.max() + lengths.max() % 2
    xs, ys = np.full((steps, SIZE), PAD, np.int64), np.zeros((steps, SIZE), np.int64)
    for j, (x, y) in enumerate(parts):
        xs[: len(x), j], ys[: len(x), j] = x, y
    return xs, ys, lengths


def main(directory: str, out: str, minutes: float = 12, ranks: str = "/opt/tokenizers/byte_bpe_50k.tiktoken", begin: str | None = None, hidden: int = 32, seed: int = 7) -> None:
    import pyarrow.dataset as ds

    learn_words(ranks)
    rng = np.random.default_rng(seed)
    read = lambda t, c: [x for x in ds.dataset(f"{directory}/{t}.parquet").to_table(columns={"c": ds.field(*c)})["c"].to_pylist() if x]
    texts = sorted({*read("basic_session", ("message", "content")), *read("new_format", ("payload", "message"))})
    rng.shuffle(texts)
    held, texts = texts[: len(texts) // 3][:20_000], texts[len(texts) // 3 :][:MAX_TEXTS]
    labelled = [(t, bool(label(t))) for t in texts]
    full, bare = [t for t, has in labelled if has], [t for t, has in labelled if not has]
    hard = [t for t in bare if re.search(r"\d|@|Harbor|Lane|Quill|\.rs", t)]
    print(len(texts), "texts,", len(full), "with spans,", len(hard), "hard,", len(held), "held out", flush=True)
    w = initial(hidden, rng)
    if begin:
        with np.load(begin) as known:
            w = {k: known[k].astype(np.float32) for k in w}
    names = list(w)
    edges = np.cumsum([0] + [w[k].size for k in names])
    context = mp.get_context("fork")
    shared = np.frombuffer(context.RawArray("f", int(edges[-1])), np.float32)
    views = {k: shared[a:b].reshape(w[k].shape) for k, a, b in zip(names, edges[:-1], edges[1:])}
    sums = np.frombuffer(context.RawArray("f", int(edges[-1] + 1) * WORKERS), np.float32).reshape(WORKERS, -1)
    start, end = context.Barrier(WORKERS + 1), context.Barrier(WORKERS + 1)
    low = np.zeros(4 * hidden, np.float32)
    low[3 * hidden :] = -1

    def work(k: int) -> None:
        own = np.random.default_rng([seed, k])
        while True:
            xs, ys, lengths = batch(own, full, hard, bare)
            start.wait()
            loss, g = loss_and_gradient(closed({n: v.copy() for n, v in views.items()}), xs, ys, lengths, low)
            for n, a, b in zip(names, edges[:-1], edges[1:]):
                sums[k, a:b] = g[n].reshape(-1)
            sums[k, -1] = loss
            end.wait()

    workers = [context.Process(target=work, args=(k,), daemon=True) for k in range(WORKERS)]
    for k in names:
        views[k][...] = w[k]
    for p in workers:
        p.start()
    m1, m2, mean = np.zeros(edges[-1], np.float32), np.zeros(edges[-1], np.float32), shared.copy()
    began, step, running = time.time(), 0, None
    while (spent := (time.time() - began) / 60) < minutes:
        step += 1
        start.wait()
        end.wait()
        g, loss = sums[:, :-1].mean(axis=0), float(sums[:, -1].mean())
        norm = float(np.sqrt((g * g).sum()))
        g *= min(1.0, 0.25 / (norm + 1e-9))
        rate = 6e-3 * min(1, step / 100) * max(0.02, (1 - spent / minutes))
        m1 = 0.9 * m1 + 0.1 * g
        m2 = 0.998 * m2 + 0.002 * g * g
        shared -= (rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.998**step)) + 1e-7)).astype(np.float32)
        mean = 0.995 * mean + 0.005 * shared
        running = loss if running is None else 0.98 * running + 0.02 * loss
        if step % 500 == 0:
            print(f"step {step} minutes {spent:.1f} loss {running:.5f} norm {norm:.3f}", flush=True)
    for p in workers:
        p.kill()
    last = {k: mean[a:b].reshape(w[k].shape).astype(np.float32) for k, a, b in zip(names, edges[:-1], edges[1:])}
    np.savez_compressed(out, **{k: v.astype(np.float16) if v.ndim > 1 and k != "trans" else v for k, v in last.items()})
    report(out, held)


def report(weights: str, held: list[str], made_texts: int = 4_000) -> dict[str, tuple[float, float]]:
    """Agreement of rows and types on held-out texts, and precision and recall of spans by type on made texts of unseen forms."""
    from . import pii

    model = pii.tagger(weights)
    truth = found = both = 0
    for t, got in zip(held, pii.found(held, model)):
        want, have = {TYPES[k] for _, _, k in label(t)}, {k for _, _, k in got}
        truth, found, both = truth + len(want), found + len(have), both + len(want & have)
    print(f"held out: precision {both / max(1, found):.4f} recall {both / max(1, truth):.4f}")
    out = unseen(model, made_texts)
    for k, v in out.items():
        print(f"unseen forms, {k}: precision {v[0]:.3f} recall {v[1]:.3f}")
    return out


def unseen(model: Tagger, texts: int = 4_000, seed: int = 11) -> dict[str, tuple[float, float]]:
    """type -> (precision, recall) of whole spans on made texts of names, domains, formats and sentences that training does not see."""
    from . import pii

    rng = np.random.default_rng(seed)
    cases = [made(rng, held=True) for _ in range(texts)]
    want = {(i, s, e, TYPES[k]) for i, (_, spans) in enumerate(cases) for s, e, k in spans}
    got = {(i, s, e, k) for i, spans in enumerate(pii.found([t for t, _ in cases], model)) for s, e, k in spans}
    share = lambda a, b: len(a & b) / max(1, len(a))
    of = lambda x, k: {v for v in x if v[3] == k}
    return {k: (share(of(got, k), of(want, k)), share(of(want, k), of(got, k))) for k in TYPES}


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2], *map(float, sys.argv[3:4]), *sys.argv[4:6])
