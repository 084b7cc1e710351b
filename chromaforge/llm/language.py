"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained here, in numpy, by backpropagation through time: one gated recurrent unit reads the bytes of a
segment forwards, one backwards, and both states at a byte give that byte's language probabilities. A document's
probabilities are the mean over all its bytes. Segments are lower-cased words with the space after them, long ones in
pieces; a segment's result depends on nothing else, so each distinct one is computed once by a worker.

Training takes a sample of every label: of ``train_docs`` labelled documents and ``train_segments`` segments each label
gets an equal part, what one can't use goes to the others, and at least ``LEAST_DOCS`` documents and
``LEAST_SEGMENTS`` segments (all it has, if fewer), so the sample is bounded by these and by the number of labels. A
label's documents are those with the smallest hash of their id. A label with fewer segments than the least has them
repeated up to it, so that training does not pass over it.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; rows without a label or with a null id
or text are never learned from; if there is nothing to learn from, all is ``und``; repeated rows are predicted alike;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import slices
from .common import map_arrow

_LETTER = re.compile(r"[^\W\d_]")
WIDTH = 24  # bytes of a segment at most
LEAST_DOCS, LEAST_SEGMENTS = 20, 400  # of a label in training


def segments(text: str) -> list[bytes]:
    """Lower-cased words of text, each with a space, in pieces of at most WIDTH bytes."""
    out = []
    for w in text.lower().encode("utf-8", "replace").split():
        w += b" "
        if len(w) <= WIDTH:
            out.append(w)
        else:
            out += [w[i : i + WIDTH] for i in range(0, len(w), WIDTH)]
    return out


def _as_matrix(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes by position and segment, lengths); unused places hold 0."""
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    width = int(lengths.max())
    raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in parts), np.uint8)
    return np.ascontiguousarray(raw.reshape(len(parts), width).T), lengths


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class ByteGRU:
    """Two recurrent units and a softmax over their states at every byte."""

    def __init__(self, labels: list[str], hidden: int = 16, seed: int = 0):
        r = np.random.default_rng(seed)
        self.labels, self.hidden = list(labels), hidden
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            self.p[f"{d}E"] = r.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)  # input weights by byte, with bias
            self.p[f"{d}U"] = r.normal(0, hidden**-0.5, (hidden, 3 * hidden)).astype(np.float32)
        self.p["W"] = r.normal(0, (2 * hidden) ** -0.5, (2 * hidden, len(labels))).astype(np.float32)
        self.p["c"] = np.zeros(len(labels), np.float32)

    def _run(self, d: str, x: np.ndarray, live: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States after each step; a step that is not live leaves the state as it is."""
        h, n = np.zeros((x.shape[1], self.hidden), np.float32), self.hidden
        e, u, out = self.p[f"{d}E"], self.p[f"{d}U"], np.empty((*x.shape, self.hidden), np.float32)
        for t in range(len(x)):
            a, g = e[x[t]], h @ u
            z, r = _sigmoid(a[:, :n] + g[:, :n]), _sigmoid(a[:, n : 2 * n] + g[:, n : 2 * n])
            c = np.tanh(a[:, 2 * n :] + r * g[:, 2 * n :])
            m = live[t][:, None]
            new = np.where(m, h + z * (c - h), h)
            if keep is not None:
                keep.append((h, z, r, c, g[:, 2 * n :]))
            h = out[t] = new
        return out

    def _states(self, x: np.ndarray, lengths: np.ndarray, keep: dict | None = None) -> np.ndarray:
        live = np.arange(len(x))[:, None] < lengths[None, :]
        kf, kb = ([], []) if keep is not None else (None, None)
        forward = self._run("f", x, live, kf)
        backward = self._run("b", x[::-1], live[::-1], kb)[::-1]
        if keep is not None:
            keep |= {"f": kf, "b": kb, "live": live}
        return np.concatenate([forward, backward], axis=2)

    def probabilities(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Label probabilities by position, segment and label."""
        logits = self._states(x, lengths) @ self.p["W"] + self.p["c"]
        logits -= logits.max(2, keepdims=True)
        e = np.exp(logits)
        return e / e.sum(2, keepdims=True)

    def gradients(self, x: np.ndarray, lengths: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over all live positions, and its gradients by backpropagation through time."""
        keep: dict = {}
        s = self._states(x, lengths, keep)
        logits = s @ self.p["W"] + self.p["c"]
        logits -= logits.max(2, keepdims=True)
        e = np.exp(logits)
        q = e / e.sum(2, keepdims=True)
        live, total = keep["live"], float(lengths.sum())
        right = np.take_along_axis(q, np.broadcast_to(y[None, :, None], (*x.shape, 1)), 2)[:, :, 0]
        loss = float(-(np.log(right + 1e-9) * live).sum() / total)
        dl = q.copy()
        np.put_along_axis(dl, np.broadcast_to(y[None, :, None], (*x.shape, 1)), right[:, :, None] - 1, 2)
        dl *= live[:, :, None] / total
        k, h = dl.shape[2], self.hidden
        grads = {"W": s.reshape(-1, 2 * h).T @ dl.reshape(-1, k), "c": dl.sum((0, 1))}
        ds = dl @ self.p["W"].T
        grads |= self._back("f", x, live, ds[:, :, :h], keep["f"])
        grads |= self._back("b", x[::-1], live[::-1], ds[::-1, :, h:], keep["b"])
        return loss, grads

    def _back(self, d: str, x: np.ndarray, live: np.ndarray, ds: np.ndarray, keep: list) -> dict[str, np.ndarray]:
        n, u = self.hidden, self.p[f"{d}U"]
        de, du = np.zeros_like(self.p[f"{d}E"]), np.zeros_like(u)
        dh = np.zeros((x.shape[1], n), np.float32)
        for t in range(len(x) - 1, -1, -1):
            h, z, r, c, gc = keep[t]
            dh = dh + ds[t]
            m = live[t][:, None]
            dn = dh * m
            dz, dc = dn * (c - h) * z * (1 - z), dn * z * (1 - c * c)
            dr = dc * gc * r * (1 - r)
            da = np.concatenate([dz, dr, dc], axis=1)
            dg = np.concatenate([dz, dr, dc * r], axis=1)
            np.add.at(de, x[t], da)
            du += h.T @ dg
            dh = np.where(m, dn * (1 - z), dh) + dg @ u.T
        return {f"{d}E": de, f"{d}U": du}

    def fit(self, parts: list[bytes], y: np.ndarray, epochs: int, batch: int, rate: float, seed: int = 1) -> ByteGRU:
        """Adam over shuffled batches of segments of like length."""
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        total = epochs * -(-len(parts) // batch)
        step = 0
        for _ in range(epochs):
            order = np.argsort(lengths + r.random(len(parts)) * 2, kind="stable")
            batches = [order[i : i + batch] for i in range(0, len(order), batch)]
            for b in r.permutation(len(batches)):
                rows = batches[b]
                x, n = _as_matrix([parts[i] for i in rows])
                _, g = self.gradients(x, n, y[rows])
                step += 1
                lr = rate * (1 - (step - 1) / total)
                for k in self.p:
                    m[k] += 0.1 * (g[k] - m[k])
                    v[k] += 0.001 * (g[k] * g[k] - v[k])
                    self.p[k] -= lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self


class _Pooled:
    """Summed byte probabilities of segments, remembered up to a bound."""

    def __init__(self, model: ByteGRU, most: int = 300_000):
        self.model, self.most, self.numbers = model, most, {}
        self.sums = np.empty((0, len(model.labels)), np.float32)
        self.lengths = np.empty(0, np.int64)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(summed probabilities, bytes) of each text."""
        if len(self.numbers) > self.most:
            self.numbers, self.sums, self.lengths = {}, self.sums[:0], self.lengths[:0]
        numbers, new, codes, counts = self.numbers, [], [], []
        for text in texts:
            parts = segments(text)
            counts.append(len(parts))
            for p in parts:
                c = numbers.get(p)
                if c is None:
                    c = numbers[p] = len(numbers)
                    new.append(p)
                codes.append(c)
        if new:
            order = sorted(range(len(new)), key=lambda i: len(new[i]))
            sums, lengths = np.empty((len(new), self.sums.shape[1]), np.float32), np.empty(len(new), np.int64)
            for at in range(0, len(order), 4096):
                rows = order[at : at + 4096]
                x, n = _as_matrix([new[i] for i in rows])
                q = self.model.probabilities(x, n)
                sums[rows] = (q * (np.arange(len(x))[:, None] < n[None, :])[:, :, None]).sum(0)
                lengths[rows] = n
            self.sums, self.lengths = np.concatenate([self.sums, sums]), np.concatenate([self.lengths, lengths])
        codes = np.asarray(codes, np.int64)
        edges = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        run = np.concatenate([np.zeros((1, self.sums.shape[1])), np.cumsum(self.sums[codes], axis=0, dtype=np.float64)])
        size = np.concatenate([[0], np.cumsum(self.lengths[codes])])
        return run[edges[1:]] - run[edges[:-1]], size[edges[1:]] - size[edges[:-1]]


def held_out(doc_id):
    """Rows that are never learned from: CRC-32 of the id's text leaves 1 by 3 (a null id also)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def train(
    docs: DataFrame,
    train_docs: int = 2000,
    train_segments: int = 40_000,
    hidden: int = 16,
    epochs: int = 3,
    batch: int = 128,
    rate: float = 0.01,
) -> ByteGRU | None:
    """Network learned from a bounded sample of every label of docs (doc_id, text, lang); None without labelled rows."""
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not counts:
        return None
    labels = sorted(counts)
    wanted = _shares(counts, train_docs, LEAST_DOCS)
    h = F.xxhash64(F.col("doc_id").cast("string"))
    keyed = usable.select("text", "lang", h.alias("h"), F.pmod(h, F.lit(1 << 30)).alias("place"))
    # all of a label whose documents are few; a share with a wide margin of the others
    words = max(LEAST_SEGMENTS, train_segments // len(labels))
    limits = [(x, _limit(counts[x], wanted[x]), wanted[x], 4 * -(-words // wanted[x])) for x in labels]
    limits = docs.sparkSession.createDataFrame(limits, "lang string, most long, wanted long, each long")
    few = keyed.join(F.broadcast(limits), "lang").filter("place < most")  # one row a label
    # documents give at most four times their part, so that long ones make up for short ones; texts stay in the tasks
    few = map_arrow(
        few.select("lang", "place", "h", "wanted", "each", "text"), _some_segments, "lang string, place long, h long, wanted long, parts array<binary>"
    )
    order = Window.partitionBy("lang").orderBy("place", "h", "parts")  # little more than the sample
    few = few.withColumn("rank", F.row_number().over(order)).filter("rank <= wanted")
    rows = sorted(few.select("lang", "rank", "parts").collect(), key=lambda r: (r["lang"], r["rank"]))
    own: dict[str, list[list[bytes]]] = {x: [] for x in labels}
    for row in rows:
        own[row["lang"]].append([bytes(p) for p in row["parts"]])
    use = _shares({x: sum(map(len, own[x])) for x in labels}, train_segments, LEAST_SEGMENTS)
    parts: list[bytes] = []
    y: list[int] = []
    for number, label in enumerate(labels):
        picked = _in_turn(own[label], use[label])
        if picked:
            picked = [picked[i % len(picked)] for i in range(max(len(picked), LEAST_SEGMENTS))]
        parts += picked
        y += [number] * len(picked)
    model = ByteGRU(labels, hidden)
    return model.fit(parts, np.array(y, np.int64), epochs, batch, rate) if parts else model


def _shares(have: dict[str, int], total: int, least: int) -> dict[str, int]:
    """How much of total each label gets of what it has: equal parts, the unused rest dealt on, but least at least."""
    out, left = {}, total
    for at, label in enumerate(sorted(have, key=lambda x: (have[x], x))):
        out[label] = min(have[label], max(least, left // (len(have) - at)))
        left = max(0, left - out[label])
    return out


def _limit(n: int, wanted: int) -> int:
    """Bound of a 30-bit hash under which n rows surely (by ten standard deviations) have the wanted number."""
    return min(1 << 30, int((wanted + 10 * wanted**0.5 + 60) / n * (1 << 30)) + 1)


def _in_turn(docs: list[list[bytes]], most: int) -> list[bytes]:
    """At most so many segments, one of each document in turn."""
    longest = max(map(len, docs), default=0)
    turns = (d[i] for i in range(longest) for d in docs if i < len(d))
    return list(itertools.islice(turns, most))


def _some_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the bound and the text (last columns) by at most so many of the text's segments, drawn by its id's hash."""
    for whole in batches:
        for batch in slices(whole, 5, 1_000_000):
            out = []
            for h, most, text in zip(*(batch.column(i).to_pylist() for i in (2, 4, 5)), strict=True):
                own = segments(text)
                order = np.random.default_rng(h % (1 << 63)).permutation(len(own))[:most]
                out.append([own[i] for i in order])
            columns = [*batch.columns[:4], pa.array(out, pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "place", "h", "wanted", "parts"])


_workers: dict[bytes, _Pooled] = {}


def predict(docs: DataFrame, model: ByteGRU | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of docs (doc_id, text); lang and source are not read."""
    held = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    if model is None:
        return held.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    spread = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred kilobytes, whatever the input
    tag = b"".join(model.p[k].tobytes()[:64] for k in sorted(model.p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tag not in _workers:
            _workers.clear()
            _workers[tag] = _Pooled(spread.value)
        pooled = _workers[tag]
        labels = np.array(pooled.model.labels, object)
        for whole in batches:
            for batch in slices(whole, 1, 1_000_000):
                texts = batch.column(1).fill_null("").to_pylist()
                sums, sizes = pooled(texts)
                q = sums / np.maximum(sizes, 1)[:, None]
                best = q.argmax(1)
                known = np.array([bool(_LETTER.search(t)) for t in texts])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        batch.column(2),
                        pa.array(np.where(known, labels[best], "und"), pa.string()),
                        pa.array(np.where(known, np.clip(q.max(1), 0, 1), 0.0), pa.float64()),
                    ],
                    ["doc_id", "held_out", "lang_pred", "score"],
                )

    kind = held.schema["doc_id"].dataType.simpleString()
    return map_arrow(held, run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def identify(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options
) -> DataFrame:
    """Train on the labelled rows of docs that are not held out, and predict every row."""
    d = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")
    )
    return predict(d.select("doc_id", "text"), train(d, **options))
