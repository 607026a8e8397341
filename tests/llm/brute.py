"""Plain versions of the operators, for small tables. Documents are dicts."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from kgloom.llm import simhash


def normal(line):
    return re.sub(r"[ \t\r\f]+", " ", line.lower()).strip(" ")


def line_rules(docs, share=0.05, min_docs=10, keep_share=0.5):
    have, size = defaultdict(set), defaultdict(set)
    for d in docs:
        if d["text"] is not None:
            size[d["source"]].add(d["text"])
            for x in d["text"].split("\n"):
                if normal(x):
                    have[d["source"], normal(x)].add(d["text"])
    bad = {k for k, v in have.items() if len(v) > min_docs and len(v) > share * len(size[k[0]])}
    solid = lambda t: len(re.sub(r"[ \t\r\f\n]+", "", t))
    out = []
    for d in docs:
        if d["text"] is None or not solid(d["text"]):
            continue
        lines = d["text"].split("\n")
        rest = [x for x in lines if (d["source"], normal(x)) not in bad]
        t = "\n".join(rest)
        if len(rest) == len(lines):
            out.append(dict(d))
        elif solid(t) and solid(t) >= keep_share * solid(d["text"]):
            out.append(d | {"text": t, "n_chars": len(t)})
    return out


def one_of_each_text(docs):
    best = {}
    for d in docs:
        k = (d["doc_id"] is None, d["doc_id"] or 0)
        if d["text"] not in best or k < best[d["text"]][0]:
            best[d["text"]] = (k, d)
    return [d for _, d in best.values()]


def near_pairs(codes, radius):
    out = []
    for i in range(len(codes)):
        d = np.bitwise_count(codes[i, 0] ^ codes[i + 1 :, 0]).astype(int) + np.bitwise_count(codes[i, 1] ^ codes[i + 1 :, 1])
        out += [(i, i + 1 + int(j)) for j in np.flatnonzero(d <= radius)]
    return out


def near_groups(docs, radius=simhash.RADIUS):
    """doc_id -> smallest id of its group, over all pairs of codes."""
    rows = [d for d in docs if d["doc_id"] is not None]
    codes, has = simhash.codes_of(pa.array([d["text"] for d in rows], pa.string()))
    rows, codes = [d for d, h in zip(rows, has) if h], codes[has]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in near_pairs(codes, radius):
        up[find(i)] = find(j)
    least = {}
    for i, d in enumerate(rows):
        least[find(i)] = min(d["doc_id"], least.get(find(i), d["doc_id"]))
    out = {}
    for i, d in enumerate(rows):
        out[d["doc_id"]] = min(least[find(i)], out.get(d["doc_id"], d["doc_id"]))
    return {k: v for k, v in out.items() if k != v}


def mixture(docs, weights, seed="mix", go_on=True):
    """(doc, source class, position, phase) by drawing the schedule slot by slot."""
    cls = lambda d: d["source"] if d["source"] in weights and d["source"] != "*" else "*"
    queue = defaultdict(list)
    for d in docs:
        queue[cls(d)].append(d)
    for q in queue.values():
        q.sort(key=lambda d: hashlib.md5(f"{seed}|{'null' if d['doc_id'] is None else d['doc_id']}".encode()).hexdigest())
    out, phase = [], 0
    live = {s: w for s, w in weights.items() if queue.get(s)}
    while live:
        total, done, t = sum(live.values()), Counter(), 0
        while True:
            ready = [s for s, w in live.items() if done[s] * total // w <= t]
            s = min(ready, key=lambda s: (-(-(done[s] + 1) * total // live[s]), s))
            if not queue[s]:
                break
            out.append((queue[s].pop(0), s, len(out), phase))
            done[s] += 1
            t += 1
        live = {s: w for s, w in live.items() if queue[s]} if go_on else {}
        phase += 1
    return out


def bins(lengths, tokens, docs, attention):
    """Bins of pieces given longest first, all bins looked at for each."""
    cap, left, out = (tokens, docs, attention), [], []
    for n in lengths:
        need = (n, 1, n * n)
        best = None
        for i, room in enumerate(left):
            if all(r >= v for r, v in zip(room, need)):
                s = sum((r / c) * (v / c) for r, v, c in zip(room, need, cap))
                if best is None or s > best[0] + 1e-12:
                    best = (s, i)
        if best is None:
            left.append(list(cap))
            best = (0, len(left) - 1)
        left[best[1]] = [r - v for r, v in zip(left[best[1]], need)]
        out.append(best[1])
    return out
