"""Toxic spans and document scores from a linear-chain conditional random field."""

from __future__ import annotations

import array
import pickle
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.store import frugal, id_crc, slices, stage_table

_TOKEN = re.compile(r"\S+")
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def features(token: str) -> list[str]:
    """The bare lower-cased word and its beginnings of 3 to 8 letters."""
    w = token.strip(_EDGE).lower()
    return ["w:" + w, *("p:" + w[:n] for n in range(3, min(9, len(w))))] if w else []


@dataclass
class Model:
    """Feature weights and bias of the toxic state over the clean one, log transition weights, and the
    logistic curve from a document's marginals to its score. Without weights every score is *prior*."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0
    trans: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)  # clean-clean, clean-toxic, toxic-clean, toxic-toxic
    curve: tuple[float, ...] = (0.0,) * 5
    prior: float = 0.0

    def emission(self, token: str) -> float:
        return self.bias + sum(self.weights.get(f, 0.0) for f in features(token))


class _Emissions(dict):
    """Emissions by raw token, kept for at most *most* tokens."""

    def __init__(self, model: Model, most: int = 400_000):
        super().__init__()
        self.model, self.most = model, most

    def __missing__(self, token: str) -> float:
        v = self.model.emission(token)
        if len(self) < self.most:
            self[token] = v
        return v


def marginals(e: np.ndarray, lengths: np.ndarray, trans: tuple[float, ...]) -> np.ndarray:
    """Log odds of the toxic state at every token by forward-backward."""
    f, b = messages(e, lengths, trans)
    return f + b


def messages(e: np.ndarray, lengths: np.ndarray, trans: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Forward log odds with, and backward ones without, a token's own emission. *e*: emissions of all
    sequences, one after the other. All sequences advance together, the longest first."""
    t00, t01, t10, t11 = (float(np.exp(x)) for x in trans)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    f, b = e.astype(np.float64), np.zeros(len(e))
    top = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(top), side="left")  # sequences longer than t
    for t in range(1, top):
        at = starts[: active[t]] + t
        odds = np.exp(np.clip(f[at - 1], -60, 60))
        f[at] += np.log((t01 + t11 * odds) / (t00 + t10 * odds))
    for t in range(top - 1, 0, -1):
        at = starts[: active[t]] + t
        odds = np.exp(np.clip(e[at] + b[at], -60, 60))
        b[at - 1] = np.log((t10 + t11 * odds) / (t00 + t01 * odds))
    return f, b


def summary(logits: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Per sequence: its largest marginal's log odds, the logs of its expected toxic tokens and of its
    tokens, and the expected toxic tokens themselves (up to 20)."""
    out = np.full((len(lengths), 4), [-12.0, -12.0, 0.0, 0.0])
    out[:, 2] = np.log(np.maximum(lengths, 1))
    some = np.flatnonzero(lengths)
    if len(some):
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])[some].astype(np.int64)
        out[some, 0] = np.clip(np.maximum.reduceat(logits, starts), -12, 12)
        out[some, 1] = np.log(np.maximum(np.add.reduceat(1 / (1 + np.exp(-np.clip(logits, -50, 50))), starts), 6e-6))
        out[some, 3] = np.minimum(np.exp(out[some, 1]), 20)
    return out


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, each: int, max_bytes: int) -> tuple[DataFrame, dict[int, int]]:
    """At most *each* labelled documents of either kind, of up to *max_bytes*, by a hash of their id: the
    bounded sample (__id, __y, t) that a model is fitted on, out of all documents that have a label. Also how
    many labels of either kind there are."""
    known = labels.filter(F.col("toxic").isin(0, 1)).select(F.col(id_col).alias("__id"), F.col("toxic").alias("__y")).dropDuplicates(["__id"])
    counts = {r["__y"]: int(r["count"]) for r in known.groupBy("__y").count().collect()}
    short = docs.filter(F.octet_length(F.coalesce(text_col, F.lit(""))) <= max_bytes).select(F.col(id_col).alias("__id"))
    known = stage_table(known.join(short, "__id", "left_semi"), "labelled")
    first = lambda y: known.filter(F.col("__y") == y).orderBy(F.xxhash64("__id"), "__id").limit(each)
    ids = first(0).unionByName(first(1))
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(text_col, F.lit("")).alias("t")).filter(F.octet_length("t") <= max_bytes)
    return rows.join(F.broadcast(ids), "__id").select("__id", F.col("__y").cast("int").alias("__y"), "t"), counts


def fit(sample: list[tuple[object, int, str]], counts: dict[int, int], least: int = 6, rounds: int = 60, segment: int = 48, seed: int = 5) -> Model:
    """Fit the field to (id, toxic, text) rows.

    Tokens are labelled from the documents: a token of a toxic document is toxic if one of its features
    is far commoner in toxic documents than elsewhere. The field's weights and transitions then maximise
    the likelihood of the token labels (Adam on exact forward-backward gradients), and a logistic curve
    maps marginals to document scores, documents weighing as their kind does in *counts*.
    """
    bad, good = sum(y == 1 for _, y, _ in sample), sum(y == 0 for _, y, _ in sample)
    prior = counts.get(1, 0) / max(1, sum(counts.values()))
    if not bad or not good:
        return Model(prior=prior)
    shared: dict[str, str] = {}
    tokens = [[shared.setdefault(w, w) for w in t.split()] for _, _, t in sample]
    del shared
    once = {}  # copies of a text teach once
    for k, (_, y, t) in enumerate(sample):
        once.setdefault((y, hash(t)), k)
    own = sorted(once.values())

    def spread(kind: int, among: dict[str, int] | None) -> dict[str, int]:
        """In how many documents of a kind each feature is; only those *among* others, if given."""
        out: dict[str, int] = {}
        for k in own:
            if sample[k][1] == kind:
                for f in {f for w in set(tokens[k]) for f in features(w) if among is None or f in among}:
                    out[f] = out.get(f, 0) + 1
        return out

    often = {f: n for f, n in spread(1, None).items() if n >= least}
    rest = spread(0, often)
    share = lambda n, of: (n + 0.5) / (of + 1.0)
    odds = {f: np.log(share(n, bad) / share(rest.get(f, 0), good)) for f, n in often.items()}
    strong = {f for f, v in odds.items() if v >= np.log(8)}
    names = {f: i for i, f in enumerate(sorted(f for f in odds if abs(odds[f]) * np.sqrt(often[f]) > 3.0))}
    if not names:
        return Model(prior=prior)
    # Segments with labelled tokens, and as many others.
    rng, hot, cold = np.random.default_rng(seed), [], []
    for y, words in ((sample[k][1], tokens[k]) for k in own):
        for i in range(0, len(words), segment):
            part = words[i : i + segment]
            tags = [int(y == 1 and any(f in strong for f in features(w))) for w in part]
            (hot if any(tags) else cold).append((part, tags))
    if not hot:
        return Model(prior=prior)
    pick = rng.permutation(len(cold))[: 3 * len(hot)]
    use = [hot[i] for i in rng.permutation(len(hot))[:3000]] + [cold[i] for i in pick[:6000]]
    lengths = np.array([len(p) for p, _ in use])
    flat = [w for p, _ in use for w in p]
    gold = np.array([t for _, ts in use for t in ts], float)
    pairs = array.array("i")
    known = {w: [names[f] for f in features(w) if f in names] for w in set(flat)}
    for i, w in enumerate(flat):
        for f in known[w]:
            pairs.append(i)
            pairs.append(f)
    at, fid = np.frombuffer(pairs, np.int32).reshape(-1, 2).T.astype(np.int64)
    del known
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    inner = np.ones(len(flat), bool)
    inner[first] = False
    nxt = np.flatnonzero(inner)
    moved = np.bincount((2 * gold[nxt - 1] + gold[nxt]).astype(int), minlength=4) / len(flat)
    theta = np.zeros(len(names) + 4)  # weights, bias, clean-toxic, toxic-clean, toxic-toxic
    theta[len(names)] = -3.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        w, (bias, a, c, d) = theta[: len(names)], theta[len(names) :]
        e = bias + np.bincount(at, w[fid], len(flat))
        tr = (0.0, a, c, d)
        fwd, bwd = messages(e, lengths, tr)
        p = 1 / (1 + np.exp(-np.clip(fwd + bwd, -50, 50)))
        # Pair marginals from forward and backward odds.
        u, z = np.exp(np.clip(fwd[nxt - 1], -50, 50)), np.exp(np.clip(e[nxt] + bwd[nxt], -50, 50))
        joint = np.stack([np.ones_like(u), np.exp(a) * z, np.exp(c) * u, np.exp(d) * u * z])
        pair = (joint / joint.sum(0)).sum(1) / len(flat)
        g = np.empty_like(theta)
        diff = (p - gold) / len(flat)
        g[: len(names)] = np.bincount(fid, diff[at], len(names)) + 1e-6 * w
        g[len(names)] = diff.sum()
        g[len(names) + 1 :] = (pair - moved)[1:]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta -= 0.25 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    n = len(names)
    model = Model({f: float(theta[i]) for f, i in names.items() if abs(theta[i]) > 1e-3}, float(theta[n]), (0.0, *map(float, theta[n + 1 :])), prior=prior)
    x = _summaries(model, tokens)
    y = np.array([k for _, k, _ in sample], float)
    weight = np.where(y == 1, counts.get(1, bad) / bad, counts.get(0, good) / good)
    model.curve = _logistic(x, y, weight / weight.mean())
    return model


def _summaries(model: Model, tokens: list[list[str]]) -> np.ndarray:
    get = _Emissions(model, 50_000).__getitem__
    lengths = np.array([len(w) for w in tokens], np.int64)
    e = np.fromiter((get(w) for ws in tokens for w in ws), float, int(lengths.sum()))
    return summary(marginals(e, lengths, model.trans), lengths)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 40) -> tuple[float, ...]:
    """Weighted logistic regression by Newton steps with a small ridge."""
    a = np.column_stack([np.ones(len(x)), x])
    k = a.shape[1]
    beta, ridge = np.zeros(k), np.diag([1e-6, *[1e-1] * (k - 1)])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        grad = a.T @ (weight * (p - y)) + ridge @ beta
        hess = (a * (weight * p * (1 - p))[:, None]).T @ a + ridge + 1e-9 * np.eye(k)
        beta = beta - np.clip(np.linalg.solve(hess, grad), -4, 4)
    return tuple(map(float, beta))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", each: int = 1500, max_bytes: int = 65_536) -> Model:
    """Fit a model to labels whose id's crc32 mod 4 is not 2 (the rest is held out), on a sample of at
    most *each* documents of either kind, so one task holds at most 2 * each * max_bytes of text; the driver
    sees the model alone. No labels of one kind: every score is the toxic share. Repeated labels of an id
    count once; rows that repeat an id and a text teach once."""
    sample, counts = labelled(docs, labels.filter(id_crc(id_col) % 4 != 2), id_col, text_col, each, max_bytes)

    def run(batches):
        got = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(sorted(got), counts))], pa.binary())], ["model"])

    found = sample.repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(found["model"]) if found else fit([], counts)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """Per row of *docs*: id, score, predicted (score >= *threshold*), expected (toxic tokens), spans.

    ``spans`` are (start, end) code point offsets of tokens whose marginal is 0.5 or more, neighbours
    joined. Whole texts are read; tokens are runs without white space. A null or empty text has no
    tokens; its score is that of no evidence. An empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        get = _Emissions(model).__getitem__
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            logits, lengths, x, s = _scores(model, get, texts)
            ends = np.cumsum(lengths)
            spans = []
            for i, t in enumerate(texts):
                hot = np.flatnonzero(logits[ends[i] - lengths[i] : ends[i]] >= 0) if model.weights and x[i, 0] >= 0 else ()
                spans.append(_offsets(t, hot) if len(hot) else [])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32)), pa.array(np.exp(x[:, 1]) * (lengths > 0), pa.float64()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                ["doc_id", "score", "predicted", "expected", "spans"],
            )

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(
        frugal(run), f"doc_id {kind}, score double, predicted int, expected double, spans array<struct<start:int,end:int>>"
    )


def _scores(model: Model, get, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Marginal log odds of all tokens, tokens per text, summaries and scores."""
    lengths, parts = np.zeros(len(texts), np.int64), []
    for i, t in enumerate(texts):
        words = t.split()
        lengths[i] = len(words)
        parts.append(np.fromiter(map(get, words), np.float32, len(words)))
    logits = marginals(np.concatenate(parts) if parts else np.zeros(0), lengths, model.trans)
    x = summary(logits, lengths)
    curve = np.array(model.curve)
    s = 1 / (1 + np.exp(-np.clip(curve[0] + x @ curve[1:], -30, 30))) if model.weights else np.full(len(texts), model.prior)
    return logits, lengths, x, s


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of *docs*, all columns, whose score is below *threshold*. Null and empty texts are scored
    like any other, and so is each of rows that repeat. Without a fitted model every row stays; an empty table
    stays empty."""
    at = docs.columns.index(text_col)

    def run(batches):
        get = _Emissions(model).__getitem__
        for whole in batches:
            for b in slices(whole, at, 2048, 8 << 20):
                s = _scores(model, get, [t or "" for t in b.column(at).to_pylist()])[3]
                yield b.filter(pa.array(s < threshold))

    return docs.mapInArrow(frugal(run), docs.schema) if model.weights else docs


def _offsets(text: str, hot: np.ndarray) -> list[dict[str, int]]:
    out, wanted, last = [], set(hot.tolist()), -2
    for i, m in enumerate(_TOKEN.finditer(text)):
        if i in wanted:
            if i == last + 1:
                out[-1]["end"] = m.end()
            else:
                out.append({"start": m.start(), "end": m.end()})
            last = i
    return out
