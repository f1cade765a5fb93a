"""Train the personal-information model and save its weights: ``python -m leafwork.llm.pii_train``."""

from __future__ import annotations

from concurrent.futures import ProcessPoolExecutor

import numpy as np

from leafwork.llm import pii
from leafwork.llm.bilstm import BiLstmCrf, one_thread
from leafwork.llm.pii_examples import KINDS, Maker

LENGTH, BATCH, SIZE, WORKERS = 128, 72, 28, 8
#: Steps and rate of each leg of the training; a leg goes on from the mean of the last one's weights.
LEGS = ((3000, 0.012), (2000, 0.007), (900, 0.004))


def batches(seed: int = 11, strange: bool = False, length: int = LENGTH, batch: int = BATCH):
    """Endless (time, batch) symbols and tags: windows of made text, from its start or from anywhere in it."""
    maker = Maker(seed, strange)
    while True:
        x, y = np.zeros((length, batch), np.int64), np.zeros((length, batch), np.int64)
        for j in range(0, batch, 3):  # three windows of each text
            text, tags = maker.text(3 * length)
            s = pii.symbols(text)
            for k, at in enumerate((0, length - 20, int(maker.r.random() * (len(s) - length)))):
                if j + k < batch:
                    x[:, j + k], y[:, j + k] = s[at : at + length], tags[at : at + length]
                    if maker.r.random() < 0.15:  # an odd window ends in a 0
                        x[-1, j + k] = y[-1, j + k] = 0
        yield x, y


_STREAM: dict[int, object] = {}


def _gradient(job: tuple[int, BiLstmCrf]) -> tuple[float, dict]:
    seed, model = job
    if seed not in _STREAM:
        _STREAM[seed] = batches(seed)
    return model._step(*next(_STREAM[seed]))


def train(steps: int, size: int = SIZE, seed: int = 11, workers: int = WORKERS, rate: float = 0.012, start: BiLstmCrf | None = None) -> BiLstmCrf:
    """Each step takes the mean gradient of a batch from every worker; ``start`` is trained further."""
    one_thread()
    model = start or BiLstmCrf(pii.SYMBOLS, len(KINDS) + 1, size)
    if workers == 1:
        return model.fit(lambda m: _gradient((seed, m)), steps, rate)
    pools = [ProcessPoolExecutor(1) for _ in range(workers)]  # one process each, so that every stream of examples goes on

    def mean(m: BiLstmCrf) -> tuple[float, dict]:
        got = [f.result() for f in [p.submit(_gradient, (seed + k, m)) for k, p in enumerate(pools)]]
        return float(np.mean([x for x, _ in got])), {k: np.mean([g[k] for _, g in got], axis=0) for k in m.p}

    try:
        return model.fit(mean, steps, rate)
    finally:
        for p in pools:
            p.shutdown()


def held_out(model: BiLstmCrf, texts: int = 400, seed: int = 77, size: int = 900) -> dict[str, tuple[int, int, int]]:
    """(true, found, both) spans of each kind in text made from parts that were kept out of training."""
    maker, finder = Maker(seed, strange=True), pii.Finder(model)
    made = [maker.text(size) for _ in range(texts)]
    out = {k: [0, 0, 0] for k in KINDS}
    for (text, tags), found in zip(made, finder.spans([t for t, _ in made])):
        true, at = set(), 0
        while at < len(tags):
            end = at
            while end < len(tags) and tags[end] == tags[at]:
                end += 1
            if tags[at]:
                true.add((KINDS[tags[at] - 1], at, end))
            at = end
        for k in KINDS:
            t, f = {s for s in true if s[0] == k}, {s for s in found if s[0] == k}
            for i, n in enumerate((len(t), len(f), len(t & f))):
                out[k][i] += n
    return {k: tuple(v) for k, v in out.items()}


if __name__ == "__main__":
    m = None
    for leg, (steps, rate) in enumerate(LEGS):
        m = train(steps, seed=11 + 100 * leg, rate=rate, start=m)
    m.save(pii.WEIGHTS)
    print("loss", np.mean(m.losses[-50:]), held_out(m))
