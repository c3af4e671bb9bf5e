"""Toxic spans by a linear-chain conditional random field over tokens, and document scores from its marginals.

Labels come for documents. A token of a toxic document is labelled toxic if its word, or a beginning of it, is found in
several toxic documents and hardly ever in clean ones; all other tokens are clean. The field is trained on these
tokens: hashed words and word beginnings as emissions, 2 x 2 transitions. Forward-backward marginals give each token's
probability; a logistic link on their sum and maximum, fitted on the same fold, gives the document's score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlane.llm.quality_model import held_out
from emberlane.llm.text import U64, blocks, buffers, mix, slice_hashes
from emberlane.session import materialize

BITS = 18
#: Most labelled documents of each class that a fit sees, in the order of a hash of doc_id.
FIT_ROWS = 2000
#: Most tokens of all documents that a fit sees; documents are taken whole, in the order of a hash of their text.
FIT_TOKENS = 1_500_000
#: Tokens of a chain: a document's chains are worked on side by side, and messages run from each to the next.
CHAIN = 32
#: A feature counts as toxic from this likelihood ratio (twice its logarithm) on, at every size of the sample.
RATIO = 20.0
PREFIXES = (4, 5, 6, 8)
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = True
ALNUM[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def tokens(raw: np.ndarray, offsets: np.ndarray):
    """Byte starts and ends of runs of letters and digits, and each row's first token."""
    if not len(raw):
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(offsets), dtype=np.int64)
    solid = ALNUM[raw]
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[offsets] = True
    before = np.concatenate([[False], solid[:-1]]) & ~edge[:-1]
    after = np.concatenate([solid[1:], [False]]) & ~edge[1:]
    starts, ends = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def features(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashed features [tokens, 1 + prefixes]: the lower-cased word and its beginnings (0: too short for one)."""
    low = LOWER[raw]
    out = np.zeros((len(starts), 1 + len(PREFIXES)), dtype=np.int32)
    most = U64((1 << BITS) - 2)
    for k, n in enumerate((0, *PREFIXES)):
        at = np.arange(len(starts)) if not n else np.flatnonzero(ends - starts > n)
        h = slice_hashes(low, starts[at], ends[at] if not n else starts[at] + n, 50 + k)
        out[at, k] = (h % most + U64(1)).astype(np.int32)
    return out


class Field:
    """Two-state linear chain: emission log-odds of state 1 are sums of feature weights; trans[a, b] from a to b."""

    def __init__(self, weights: np.ndarray, bias: float, trans: np.ndarray, link: np.ndarray):
        self.weights, self.bias, self.trans, self.link = weights, bias, trans, link

    def emissions(self, found: np.ndarray) -> np.ndarray:
        return np.clip(self.weights[found].sum(axis=1) + self.bias, -30, 30)

    @staticmethod
    def marginals(emission: np.ndarray, valid: np.ndarray, begin: np.ndarray, trans: np.ndarray, pairs: bool = False):
        """P(state 1) for [chains, CHAIN]; with pairs also the summed pair marginals [2, 2]. Padding is at the ends.

        begin: each document's first chain (one entry more than documents). A document's chains are one long chain: each
        chain's transfer matrix hands the forward message to the next one and the backward message to the one before.
        """
        count, length = emission.shape
        t, e = np.exp(trans), np.exp(emission)
        head = np.zeros(count, dtype=bool)
        head[begin[:-1][np.diff(begin) > 0]] = True
        depth = np.arange(count) - np.repeat(begin[:-1], np.diff(begin))

        def step(x0, x1, k, start):  # forward by the token at place k; the first token of a document has no transition
            y0, y1 = x0 * t[0, 0] + x1 * t[1, 0], (x0 * t[0, 1] + x1 * t[1, 1]) * e[:, k]
            if k == 0:
                y0, y1 = np.where(start, x0, y0), np.where(start, x1 * e[:, 0], y1)
            return np.where(valid[:, k], y0, x0), np.where(valid[:, k], y1, x1)

        ahead, after = np.ones((2, count)), np.ones((2, count))
        deepest = int(depth.max()) if count else 0
        if deepest:
            rows = [(np.ones(count), np.zeros(count)), (np.zeros(count), np.ones(count))]
            for k in range(length):
                rows = [step(*r, k, head) for r in rows]
                z = rows[0][0] + rows[0][1] + rows[1][0] + rows[1][1]
                rows = [(r[0] / z, r[1] / z) for r in rows]
            m = np.array(rows)  # [from, to, chains]
            order = np.argsort(depth, kind="stable")
            edge = np.searchsorted(depth[order], np.arange(deepest + 2))
            for d in range(1, deepest + 1):
                at = order[edge[d] : edge[d + 1]]
                x = ahead[0, at - 1] * m[0, :, at - 1].T + ahead[1, at - 1] * m[1, :, at - 1].T
                ahead[:, at] = x / x.sum(axis=0)
            for d in range(deepest, 0, -1):
                at = order[edge[d] : edge[d + 1]]
                x = m[:, 0, at] * after[0, at] + m[:, 1, at] * after[1, at]
                after[:, at - 1] = x / x.sum(axis=0)
        forward = np.zeros((length, 2, count))
        a0, a1 = ahead
        for k in range(length):
            a0, a1 = step(a0, a1, k, head)
            z = a0 + a1
            a0, a1 = a0 / z, a1 / z
            forward[k, 0], forward[k, 1] = a0, a1
        out = np.zeros((count, length))
        b0, b1 = after
        total = np.zeros((2, 2))
        for k in reversed(range(length)):
            ok = valid[:, k]
            f0, f1 = forward[k]
            p1 = f1 * b1
            out[:, k] = np.where(ok, p1 / (f0 * b0 + p1), 0)
            x1 = b1 * e[:, k]
            if pairs:
                g0, g1 = forward[k - 1] if k else ahead
                use = ok if k else ok & ~head
                w = np.stack([g0 * t[0, 0] * b0, g0 * t[0, 1] * x1, g1 * t[1, 0] * b0, g1 * t[1, 1] * x1])
                total += (w / w.sum(axis=0))[:, use].sum(axis=1).reshape(2, 2)
            c0, c1 = t[0, 0] * b0 + t[0, 1] * x1, t[1, 0] * b0 + t[1, 1] * x1
            z = c0 + c1
            b0, b1 = np.where(ok, c0 / z, b0), np.where(ok, c1 / z, b1)
        return (out, total) if pairs else out

    def tag(self, found: np.ndarray, first: np.ndarray) -> np.ndarray:
        """P(toxic) of each token; a document's tokens are one chain, which never crosses into another."""
        chain, place, valid, begin = chains(first)
        emission = np.zeros(valid.shape)
        emission[chain, place] = self.emissions(found)
        return self.marginals(emission, valid, begin, self.trans)[chain, place]

    def documents(self, p: np.ndarray, first: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(evidence(p, first) @ self.link, -40, 40)))


def chains(first: np.ndarray):
    """Chain and place of each token, which places of [chains, CHAIN] are in use, and each document's first chain."""
    count = np.diff(first)
    row = np.repeat(np.arange(len(count)), count)
    inner = np.arange(len(row)) - first[row]
    per = -(-count // CHAIN)
    chain = (np.cumsum(per) - per)[row] + inner // CHAIN
    place = inner % CHAIN
    valid = np.zeros((int(per.sum()), CHAIN), dtype=bool)
    valid[chain, place] = True
    return chain, place, valid, np.concatenate([[0], np.cumsum(per)])


def evidence(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """What documents are judged by: a constant, the chance that some token is toxic, the log of expected toxic tokens."""
    count = np.diff(first)
    none, total = np.zeros(len(count)), np.zeros(len(count))
    full = np.flatnonzero(count)
    if len(full):
        p = np.where(p > 0.05, np.minimum(p, 1 - 1e-6), 0)
        none[full] = np.add.reduceat(np.log1p(-p), first[full])
        total[full] = np.add.reduceat(p, first[full])
    return np.stack([np.ones(len(count)), -np.expm1(none), np.log1p(total)], axis=1)


def token_labels(found: np.ndarray, first: np.ndarray, toxic: np.ndarray, use: np.ndarray | None = None) -> np.ndarray:
    """Labels of tokens from labels of documents, by how many toxic and clean documents hold each feature: those whose odds
    and likelihood ratio pass fixed bars. use: the documents that are counted. Documents whose least word hashes tie count
    together as one."""
    use = np.ones(len(toxic), dtype=bool) if use is None else use
    doc = np.repeat(np.arange(len(toxic)), np.diff(first))
    counted = use[doc]
    size = 1 << BITS
    # near copies share their least word hashes; a group of them counts as one document
    low = np.zeros((len(toxic), 2), dtype=U64)
    full = np.flatnonzero(np.diff(first))
    for k in range(2 if len(full) else 0):
        low[full, k] = np.minimum.reduceat(mix(found[:, 0].astype(U64) + U64(7919 * (k + 1))), first[full])
    _, group, n = np.unique(low, axis=0, return_inverse=True, return_counts=True)
    weight = 1.0 / n[group.ravel()]
    bad, good = np.zeros(size), np.zeros(size)
    for k in range(found.shape[1]):
        pair = np.unique(doc[counted] * np.int64(size) + found[counted, k])
        f, d = pair % size, pair // size
        bad += np.bincount(f[toxic[d]], weights=weight[d[toxic[d]]], minlength=size)
        good += np.bincount(f[~toxic[d]], weights=weight[d[~toxic[d]]], minlength=size)
    bad[0] = good[0] = 0
    n1, n0 = max(1.0, weight[toxic & use].sum()), max(1.0, weight[~toxic & use].sum())
    odds = np.log((bad + 0.1) / n1) - np.log((good + 0.1) / n0)
    share, n = n1 / (n1 + n0), np.maximum(bad + good, 1e-9)
    part = lambda x, q: x * np.log(np.maximum(x, 1e-9) / (n * q))
    ratio = 2 * (part(bad, share) + part(good, 1 - share))
    marked = (bad >= 2.5) & (odds > 3.5) & (ratio > RATIO)
    return toxic[doc] & marked[found].any(axis=1)


def fit_field(found: np.ndarray, first: np.ndarray, toxic: np.ndarray, mark: np.ndarray, steps: int = 25, rate: float = 0.8) -> Field:
    """Train on whole documents. mark: a hash of each document's text; every fourth by it is left to fit the link on, as
    tokens that were trained on look too sure. The result depends on the documents' order only through rounding."""
    rest = mark % U64(4) == 3
    if not toxic[rest].any() or toxic[rest].all():
        rest[:] = False
    label = token_labels(found, first, toxic, ~rest)
    tokens_in = np.diff(first)
    use = np.repeat(~rest, tokens_in)
    own = np.concatenate([[0], np.cumsum(tokens_in[~rest])])
    x, y = found[use], label[use].astype(float)
    chain, place, valid, begin = chains(own)
    w, trans = np.zeros(1 << BITS), np.zeros((2, 2))
    bias = -4.0
    gw2, gt2, gb2 = np.full(len(w), 1e-6), np.full((2, 2), 1e-6), 1e-6
    seen = np.zeros((2, 2))
    inside = np.ones(max(0, len(y) - 1), dtype=bool)
    inside[own[1:-1][(own[1:-1] > 0) & (own[1:-1] < len(y))] - 1] = False
    np.add.at(seen, (y[:-1][inside].astype(int), y[1:][inside].astype(int)), 1)
    for _ in range(steps):
        emission = np.zeros(valid.shape)
        emission[chain, place] = np.clip(w[x].sum(axis=1) + bias, -30, 30)
        p, pairs = Field.marginals(emission, valid, begin, trans, pairs=True)
        gap = p[chain, place] - y
        gw = np.zeros(len(w))
        for k in range(x.shape[1]):
            gw += np.bincount(x[:, k], weights=gap, minlength=len(w))
        gw = gw + 0.05 * w
        gw[0] = 0
        gt, gb = (pairs - seen) + 0.5 * trans, gap.sum()
        gw2 += gw**2
        gt2 += gt**2
        gb2 += gb**2
        w -= rate * gw / np.sqrt(gw2)
        trans -= 0.2 * gt / np.sqrt(gt2)
        bias -= 0.2 * gb / np.sqrt(gb2)
    field = Field(w.astype(np.float32), float(bias), trans, np.array([-2.0, 1.0, 1.0]))
    # the link from marginals to documents
    z = evidence(field.tag(found, first), first)
    if rest.any():
        z, toxic = z[rest], toxic[rest]
    link, target = np.array([-2.0, 1.0, 1.0]), toxic.astype(float)
    weight = np.where(toxic, 0.5 / max(1, toxic.sum()), 0.5 / max(1, (~toxic).sum()))
    for _ in range(200):
        q = 1 / (1 + np.exp(-np.clip(z @ link, -40, 40)))
        h = (z * (weight * q * (1 - q))[:, None]).T @ z + 1e-4 * np.eye(3)
        step = np.linalg.solve(h, z.T @ (weight * (q - target)) + 1e-4 * link)
        link = link - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    field.link = link
    return field


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, most: int = FIT_TOKENS) -> Field | None:
    """Fit on at most so many labelled documents of each class and so many tokens in all, never on the held-out fold; None
    if one class is missing.

    A doc_id that labels repeat counts once, as toxic if one of its rows says so. Where documents repeat a doc_id, all its
    rows are candidates, and the bounds hold for them together. Executors send hashed features of the sample; it is
    sorted by a hash of the text, so the fit does not depend on the order or the partitions of the rows.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    # the sample is drawn from the labels alone; at most 2 * rows of them are broadcast to the documents
    parts = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for k in (0, 1)]
    sample = F.broadcast(parts[0].unionByName(parts[1]))

    def compact(batches):
        for batch in batches:
            raw, offsets = buffers(batch.column(0))
            for i, j in blocks(offsets):
                part, at = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                starts, ends, first = tokens(part, at)
                found = features(part, starts, ends)
                marks = np.array([xxhash.xxh3_64_intdigest(part[a:b].tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist())], dtype=U64)
                data = [found[a:b].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(marks.view(np.int64)), batch.column(1)[i:j], pa.array(np.diff(first), pa.int64()), pa.array(data, pa.binary())], names=["mark", "toxic", "n", "found"])

    got = docs.select("doc_id", "text").join(sample, "doc_id").select("text", "toxic").mapInArrow(compact, "mark long, toxic int, n long, found binary")
    got = materialize(got.where(F.col("n") <= most), "toxicity-sample")
    # of documents that repeat an id there may be more; the bounds hold for all rows, in the order of the marks
    light = got.select("mark", "toxic", "n")
    place = Window.partitionBy("toxic").orderBy("mark", "n").rowsBetween(Window.unboundedPreceding, 0)
    total = light.withColumn("rank", F.row_number().over(Window.partitionBy("toxic").orderBy("mark", "n"))).withColumn("sum", F.sum("n").over(place))
    last = total.where((F.col("rank") <= rows) & (F.col("sum") <= most // 2)).groupBy("toxic").agg(F.max("mark").alias("last"))
    picked = got.join(F.broadcast(last), "toxic").where("mark <= last").select("mark", "toxic", "found").toArrow().combine_chunks()
    picked = picked.sort_by([("mark", "ascending"), ("toxic", "ascending")])
    toxic = picked["toxic"].to_numpy() == 1
    if not toxic.any() or toxic.all():
        return None
    parts = [np.frombuffer(x.as_buffer(), dtype=np.int32).reshape(-1, 1 + len(PREFIXES)) for x in picked["found"]]
    first = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
    return fit_field(np.concatenate(parts), first, toxic, picked["mark"].to_numpy().view(U64))


def score(docs: DataFrame, field: Field | None, least: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted, spans: [from, to) in characters of tokens that are toxic likelier than not.

    Whole texts. Null and empty texts have no tokens and score by the link's constant. Without a field (the labels lack
    a class) every score is 0. Rows stay as they come.
    """
    schema = "doc_id long, score double, spans array<struct<from:int,to:int>>"

    def rate(batches):
        kind = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))
        for batch in batches:
            raw, offsets = buffers(batch.column(1))
            for i, j in blocks(offsets):
                part, rows = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                starts, ends, first = tokens(part, rows)
                if field is None:
                    value, spans = np.zeros(j - i), [[] for _ in range(j - i)]
                else:
                    p = field.tag(features(part, starts, ends), first) if len(starts) else np.zeros(0)
                    value = field.documents(p, first)
                    spans = [[] for _ in range(j - i)]
                    hits = np.flatnonzero(p > 0.5)
                    if len(hits):
                        chars = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
                        owner = np.searchsorted(first, hits, side="right") - 1
                        base = chars[rows[owner]]
                        for r, a, b in zip(owner.tolist(), (chars[starts[hits]] - base).tolist(), (chars[ends[hits]] - base).tolist()):
                            spans[r].append({"from": a, "to": b})
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(value), pa.array(spans, kind)], names=["doc_id", "score", "spans"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rate, schema)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"), "spans")


def scores_of(field: Field, column) -> np.ndarray:
    """Score of each text of an Arrow column."""
    raw, offsets = buffers(column)
    out = [np.zeros(0)]
    for i, j in blocks(offsets):
        part, rows = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        starts, ends, first = tokens(part, rows)
        p = field.tag(features(part, starts, ends), first) if len(starts) else np.zeros(0)
        out.append(field.documents(p, first))
    return np.concatenate(out)


def keep(docs: DataFrame, field: Field | None, least: float = 0.7) -> DataFrame:
    """The rows that score below least, with all their columns and without a shuffle."""
    if field is None:
        return docs
    at = docs.columns.index("text")

    def choose(batches):
        for batch in batches:
            yield batch.filter(pa.array(scores_of(field, batch.column(at)) < least))

    return docs.mapInArrow(choose, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, least: float = 0.7, rows: int = FIT_ROWS) -> DataFrame:
    """Fit on labelled rows and score every document; see fit and score."""
    return score(docs, fit(docs, labels, rows), least)
