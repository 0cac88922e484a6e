"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained here, in numpy, by backpropagation through time on a
bounded sample of labelled rows.  Every byte position of a text gets a
probability for each language; a document's probabilities are the mean over all
its positions.  Gates are piecewise linear (clipped), which keeps inference to a
few vector operations for each byte.  Texts are read in lanes of ``LANE`` bytes
that run side by side and overlap: of a lane's positions, the first and the last
``CONTEXT`` are only read, unless the text begins or ends there, so that each
position is labelled with that many bytes of its text on either side.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repolith.llm._common import prepare, release, unused

LANE, CONTEXT, LANES = 128, 8, 1024
#: Labels whose counts are broadcast; more are joined.
LABELS = 10_000
#: A text with no match (of the JVM's regular expressions) has no letter.
LETTER = r"\p{L}"


class ByteGru:
    """x: input weights by byte, u: recurrent weights, of the two directions; v, c: the output layer.

    Arrays are feature-major, so that every gate is one contiguous block.
    """

    def __init__(self, languages: list[str], hidden: int = 8, seed: int = 7):
        rnd = np.random.default_rng(seed)
        self.languages, self.hidden = languages, hidden
        h, k = hidden, len(languages)
        self.x = (0.3 * rnd.standard_normal((2, 3 * h, 256))).astype(np.float32)
        self.u = (rnd.standard_normal((2, 3 * h, h)) / np.sqrt(h)).astype(np.float32)
        self.v = (rnd.standard_normal((k, 2 * h)) / np.sqrt(2 * h)).astype(np.float32)
        self.c = np.zeros((k, 1), np.float32)

    def _states(self, codes: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Hidden states (2, time, hidden, lane) for codes (time, lane)."""
        steps, lanes = codes.shape
        h = self.hidden
        out = np.empty((2, steps, h, lanes), np.float32)
        a, g, t = np.empty((3 * h, lanes), np.float32), np.empty((3 * h, lanes), np.float32), np.empty((h, lanes), np.float32)
        for d in (0, 1):
            state, x, u = np.zeros((h, lanes), np.float32), self.x[d], self.u[d]
            for s in range(steps) if d == 0 else range(steps - 1, -1, -1):
                np.take(x, codes[s], axis=1, out=a, mode="clip")
                np.matmul(u, state, out=g)
                gates, cand = a[: 2 * h], a[2 * h :]
                gates += g[: 2 * h]
                gates += 0.5
                np.maximum(gates, 0, out=gates)
                np.minimum(gates, 1, out=gates)
                z, r = gates[:h], gates[h:]
                np.multiply(r, g[2 * h :], out=t)
                cand += t
                np.maximum(cand, -1, out=cand)
                np.minimum(cand, 1, out=cand)
                if keep is not None:
                    keep.append((d, s, state.copy(), a.copy(), g[2 * h :].copy()))
                np.subtract(state, cand, out=t)
                t *= z
                state = np.add(t, cand, out=out[d, s])
        return out

    def _probabilities(self, states: np.ndarray) -> np.ndarray:
        """(language, time, lane)."""
        h = self.hidden
        both = np.concatenate([states[0], states[1]], axis=1)  # time, 2 hidden, lane
        p = np.matmul(self.v, both)
        p += self.c
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=1, keepdims=True)
        return p.transpose(1, 0, 2)

    def gradients(self, codes: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy over all positions, and the gradients of x, u, v, c by backpropagation through time."""
        steps, lanes = codes.shape
        h, kept = self.hidden, []
        states = self._states(codes, kept)
        p = self._probabilities(states)
        loss = float(-np.log(p[labels, :, np.arange(lanes)] + 1e-9).mean())
        p[labels, :, np.arange(lanes)] -= 1
        p = p.transpose(1, 0, 2) / np.float32(steps * lanes)  # time, language, lane
        both = np.concatenate([states[0], states[1]], axis=1)
        dv = np.einsum("tkb,tjb->kj", p, both, optimize=True)
        dc = p.sum(axis=(0, 2))[:, None]
        dboth = np.matmul(self.v.T, p)
        dx, du = np.zeros_like(self.x), np.zeros_like(self.u)
        carried, das = [np.zeros((h, lanes), np.float32) for _ in (0, 1)], ([], [])
        for d, s, state, a, gn in reversed(kept):
            z, r, n = a[:h], a[h : 2 * h], a[2 * h :]
            dh = dboth[s, d * h : (d + 1) * h] + carried[d]
            dn = dh * (1 - z) * (np.abs(n) < 1)
            da = np.concatenate([dh * (state - n) * ((z > 0) & (z < 1)), dn * gn * ((r > 0) & (r < 1)), dn])
            dg = da.copy()
            dg[2 * h :] *= r
            du[d] += dg @ state.T
            carried[d] = dh * z + self.u[d].T @ dg
            das[d].append((s, da))
        for d in (0, 1):
            flat = np.concatenate([codes[s] for s, _ in das[d]])
            rows = np.concatenate([da for _, da in das[d]], axis=1)
            for k in range(3 * h):
                dx[d, k] = np.bincount(flat, rows[k], 256)
        return loss, [dx, du, dv.astype(np.float32), dc.astype(np.float32)]

    def fit(
        self, texts: list[bytes], labels: list[int], steps: int = 220, lanes: int = 256, length: int = 48,
        rate: float = 0.02, seed: int = 11
    ) -> list[float]:
        """Adam on random stretches of the texts; languages are drawn equally often."""
        rnd = np.random.default_rng(seed)
        by = [np.flatnonzero(np.asarray(labels) == k) for k in range(len(self.languages))]
        padded = [np.frombuffer(t.ljust(length), np.uint8) for t in texts]
        ps, losses = [self.x, self.u, self.v, self.c], []
        m, w = [np.zeros_like(p) for p in ps], [np.zeros_like(p) for p in ps]
        for step in range(1, steps + 1):
            y = rnd.integers(0, len(by), lanes)
            picks = [by[k][rnd.integers(len(by[k]))] for k in y]
            starts = [rnd.integers(len(padded[i]) - length + 1) for i in picks]
            codes = np.stack([padded[i][s : s + length] for i, s in zip(picks, starts)], axis=1)
            loss, grads = self.gradients(codes, y)
            losses.append(loss)
            now = rate * min(1.0, 2.0 * (1 - step / (steps + 1)))
            size = np.sqrt(sum(float((g * g).sum()) for g in grads))
            for p, g, a, b in zip(ps, grads, m, w):
                g = g * min(1.0, 1.0 / (size + 1e-9))
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p -= now * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
        return losses

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """Mean probability of each language over all positions, a row for each text (zeros for an empty one)."""
        sizes = np.array([len(t) for t in texts], np.int64)
        out = np.zeros((len(texts), len(self.languages)))
        if not sizes.sum():
            return out
        padded = np.frombuffer(b"".join(t if len(t) >= LANE else t.ljust(LANE) if t else b"" for t in texts), np.uint8)
        held = np.where(sizes == 0, 0, np.maximum(sizes, LANE))
        base, step = np.cumsum(held) - held, LANE - 2 * CONTEXT
        counts = np.where(held == 0, 0, 1 + -(-(held - LANE) // step))
        doc = np.repeat(np.arange(len(texts)), counts)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
        start = np.minimum(nth * step, held[doc] - LANE)  # the last lane ends with the text
        last = nth == counts[doc] - 1
        # a lane labels what follows the labels of the lane before it
        skip = np.where(nth == 0, 0, nth * step + CONTEXT - start)
        end = np.where(last, np.minimum(sizes[doc] - start, LANE), LANE - CONTEXT)
        time = np.arange(LANE)[:, None]
        for at in range(0, len(doc), LANES):
            part = slice(at, at + LANES)
            codes = padded[(base[doc[part]] + start[part])[None, :] + time]
            p = self._probabilities(self._states(codes))
            p *= (time >= skip[part][None, :]) & (time < end[part][None, :])
            sums = p.sum(axis=1, dtype=np.float64)
            for k in range(len(out[0])):
                out[:, k] += np.bincount(doc[part], sums[k], len(texts))
        return out / np.maximum(sizes, 1)[:, None]


def train(docs: DataFrame, label: str = "lang", rows_per_language: int = 400, seed: int = 7) -> ByteGru | None:
    """Fit on a bounded sample of the labelled rows: of each label, the ``rows_per_language``
    rows of the least hash (of doc_id and text), and of each a stretch of 300
    characters at a hashed offset.  None if no row is labelled.

    Every label is learned.  Rows without a letter teach nothing; rows that repeat
    doc_id and text count once.  A first filter by hash, by each label's number of
    distinct rows (within a few per cent), leaves about twice the sample to be
    sorted, so that a hot label or text costs one partial aggregation.
    """
    known = docs.filter(F.col(label).isNotNull() & F.col("text").rlike(LETTER)).select(
        F.col(label).cast("string").alias("y"), "text", F.xxhash64(F.lit(seed), "doc_id", "text").alias("h")
    )
    counts = known.groupBy("y").agg(F.approx_count_distinct("h").alias("count"))
    some = counts.limit(LABELS + 1).collect()
    if len(some) <= LABELS:  # the text isn't shuffled where labels are few
        counts = F.broadcast(docs.sparkSession.createDataFrame(some, "y string, count long"))
    below = F.when(F.col("count") <= 2 * rows_per_language, 1.0).otherwise(2.0 * rows_per_language / F.col("count"))
    spread = F.pmod("h", F.lit(1 << 30))
    near = known.join(counts, "y").filter(spread < below * (1 << 30))
    offset = 1 + F.pmod(F.col("h"), F.greatest(F.length("text") - 300, F.lit(1))).cast("int")
    near = near.groupBy("y", "h").agg(F.first(F.substring(F.col("text"), offset, F.lit(300))).alias("t"))
    nth = F.row_number().over(Window.partitionBy("y").orderBy(spread, "h"))
    sample = sorted(tuple(r) for r in near.withColumn("nth", nth).filter(F.col("nth") <= rows_per_language).select("y", "h", "t").collect())
    names = sorted({r[0] for r in sample})
    if not names:
        return None
    model = ByteGru(names, seed=seed)
    if len(names) > 1:
        at = {n: k for k, n in enumerate(names)}
        model.fit([r[2].encode() for r in sample], [at[r[0]] for r in sample])
    return model


def predict(docs: DataFrame, model: ByteGru | None, columns: list[str], names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Add to ``columns`` of each row the predicted language and its score (mean probability of it), as columns of these ``names``.

    ``und`` with score 0 where the text is null or has no letter, or nothing was
    learned; equal scores go to the language that is first by code point.  Whole
    texts are read, row by row; nothing is shuffled.
    """
    prepare(docs.sparkSession)
    kept = docs.select(*[F.col(f"`{c}`") for c in columns])
    text = F.col("text").cast("string")
    out_names = [*columns, *names]
    fields = [*kept.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())]

    def run(batches):
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            found, scores = ["und"] * len(texts), np.zeros(len(texts))
            if model is not None:
                p = model.pooled([t.encode() if t else b"" for t in texts])
                best = p.argmax(axis=1)
                for i, t in enumerate(texts):
                    if t:
                        found[i], scores[i] = model.languages[best[i]], min(1.0, max(0.0, p[i, best[i]]))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(found, pa.string()), pa.array(scores, pa.float64())], names=out_names
            )
        release()

    (read,) = unused(out_names, "read")
    return docs.select(
        *[F.col(f"`{c}`") for c in columns], F.when(text.rlike(LETTER), text).alias(read)
    ).mapInArrow(run, T.StructType(fields))


def remainder():
    """crc32 of the doc_id as text, modulo 3; a null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3


def identify(docs: DataFrame) -> DataFrame:
    """Train on labelled rows whose remainder isn't 1, then predict all rows; those of remainder 1 are held out."""
    model = train(docs.select("doc_id", "text", "lang").filter(remainder() != 1))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", remainder() == 1)
    return predict(rows, model, ["doc_id", "held_out"])
