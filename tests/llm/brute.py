"""The operators once more, in plain Python over small lists."""

import math
import re
import struct
from collections import Counter, defaultdict
from fractions import Fraction

import xxhash

from seqloom.llm import language, quality


def join(rows):
    """(repr of id, set size, repr of component) of rows (id, text), sorted."""
    sets = []
    for _, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets.append({b" ".join(w[j : j + 5]) for j in range(max(len(w) - 4, 1))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if None not in (rows[a][0], rows[b][0]) and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for x, (i, _) in enumerate(rows):
        if i is not None:
            least[find(x)] = min(least.get(find(x), i), i)
    return sorted((repr(i), len(sets[x]), repr(None if i is None else least[find(x)] if sets[x] else i)) for x, (i, _) in enumerate(rows))


def _strength(groups):
    """Of groups (sum of rates, documents, rate above)."""
    n = sum(k for _, k, _ in groups)
    spread = sum(k * (s / k - m) ** 2 for s, k, m in groups)
    noise, most = sum(m * (1 - m) for _, _, m in groups), sum(k * m * (1 - m) for _, k, m in groups) / n
    between = max((spread - noise) / n, 0)
    return min(max(most / between - 1, 1.0), 1e4) if between > 0 else 1e4


def qualities(rows, model):
    """(host rate, path rate, posterior, keep) of rows (text, host, path), in order."""
    evidence = [model.evidence((t or "").encode()) for t, _, _ in rows]
    p = [None if e is None else 1 / (1 + math.exp(-e)) for e in evidence]
    keys = [(h or "", x or "") for _, h, x in rows]
    hosts, paths = defaultdict(list), defaultdict(list)
    for k, v in zip(keys, p):
        if v is not None:
            hosts[k[0]].append(v)
            paths[k].append(v)
    known = [v for v in p if v is not None]
    rate = min(max(sum(known) / max(len(known), 1), 1e-6), 1 - 1e-6)
    by_host = _strength([(sum(v), len(v), rate) for v in hosts.values()])
    host_rate = {h: (sum(v) + rate * by_host) / (len(v) + by_host) for h, v in hosts.items()}
    by_path = _strength([(sum(v), len(v), host_rate[k[0]]) for k, v in paths.items()])
    out = []
    for k, e, v in zip(keys, evidence, p):
        less = lambda group: (sum(group) - (v or 0), len(group) - (v is not None))
        s, n = less(hosts.get(k[0], []))
        hr = (s + rate * by_host) / (n + by_host)
        s, n = less(paths.get(k, []))
        pr = (s + hr * by_path) / (n + by_path)
        odds = (e or 0.0) + math.log(pr / (1 - pr))
        post = 1 / (1 + math.exp(-odds))
        out.append((hr, pr, post, e is not None and post >= 0.5))
    return out


def _bins(text):
    b = b" " + b" ".join((text or "").encode().lower().split()) + b" "
    return [((b[i] << 16 | b[i + 1] << 8 | b[i + 2]) * 2654435761 % 2**32) >> 16 for i in range(len(b) - 2)]


class Languages:
    """The trigram model of labelled rows (text, label), all of them in the sample."""

    def __init__(self, labelled):
        self.languages = sorted({l for _, l in labelled if l})
        counts = {l: Counter() for l in self.languages}
        for t, l in labelled:
            if l and t is not None:
                counts[l].update(_bins(t) if t.split() else [])
        every = sum(counts.values(), Counter())
        total, size = sum(every.values()), language.BINS
        share = lambda b: (every[b] + 0.1) / (total + 0.1 * size)
        sums = {l: sum(c.values()) for l, c in counts.items()}
        self.log = lambda l, b: math.log((counts[l][b] + language.SHARED * share(b)) / (sums[l] + language.SHARED))
        self.least = {}
        for t, l in labelled:
            n, means = self.means(t)
            if l and n >= language.FIT_TRIGRAMS:
                self.least[l] = min(self.least.get(l, 0.0), means[l])

    def means(self, text):
        bins = _bins(text) if (text or "").split() else []
        return len(bins), {l: sum(self.log(l, b) for b in bins) / max(len(bins), 1) for l in self.languages}

    def judge(self, rows):
        """(language, posterior, text language, keep) of rows (text, declared, suffix, host), in order."""
        L, W, S = self.languages, language.TEXT_WEIGHT, language.SMOOTHING
        rows = [(t, d or "", s or "", h or "") for t, d, s, h in rows]
        got = []
        for t, d, _, _ in rows:
            n, means = self.means(t)
            fits = any(means[l] >= self.least.get(l, -1e9) - language.FIT_MARGIN for l in L)
            best = max(L, key=lambda l: (means[l], -L.index(l)))
            got.append((n, means, best, n > 0 and (n < language.FIT_TRIGRAMS or fits), d == "" or d in L))
        seen = [(b, r[1], r[2], r[3]) for (n, m, b, known, modelled), r in zip(got, rows) if known and modelled]
        all_ = Counter(x[0] for x in seen)
        prior = {l: (all_[l] + 1) / (len(seen) + len(L)) for l in L}

        def spoken(i, value, l):
            with_value = [x for x in seen if x[i] == value]
            share = len(with_value) / max(len(seen), 1)
            return math.log((sum(x[0] == l for x in with_value) + S * share) / (all_[l] + S)) if with_value else 0.0

        def place(host, suffix, l):
            here = [x[0] for x in seen if (x[3], x[2]) == (host, suffix)]
            if not here:
                return math.log(prior[l])
            under = [x[0] for x in seen if x[2] == suffix]
            above = (under.count(l) + S * prior[l]) / (len(under) + S)
            return math.log((here.count(l) + S * above) / (len(here) + S))

        out = []
        for (t, d, s, h), (n, means, best, known, modelled) in zip(rows, got):
            fused = {l: means[l] * min(n, W) + spoken(1, d, l) + spoken(2, s, l) + place(h, s, l) for l in L}
            top = max(L, key=lambda l: (fused[l], -L.index(l)))
            post = 1 / sum(math.exp(x - fused[top]) for x in fused.values())
            if modelled:
                out.append((top if n else None, post, best if n else None, known and post >= 0.5))
            else:
                out.append((d if n else None, None, best if n else None, n > 0))
        return out


def spark_hash(*values):
    h = 42
    for v in values:
        raw = v.encode() if isinstance(v, str) else struct.pack("<q", v) if v.bit_length() > 31 or isinstance(v, Long) else struct.pack("<i", v)
        h = xxhash.xxh64_intdigest(raw, seed=h % 2**64)
    return h - 2**64 if h >= 2**63 else h


class Long(int):
    pass


def slots(blocks, targets):
    """The schedule, slot by slot: of the sources whose next block is released, the one whose block is due first."""
    out, done = [], dict.fromkeys(blocks, 0)
    while any(done[s] < n for s, n in blocks.items()):
        live = [s for s in sorted(blocks) if done[s] < blocks[s]]
        w = {s: Fraction(targets.get(s, 0)) for s in live if targets.get(s, 0)} or dict.fromkeys(live, Fraction(1))
        w = {s: x / sum(w.values()) for s, x in w.items()}
        start, first = len(out), dict(done)
        while True:
            now = len(out) - start
            ready = [(math.ceil((done[s] - first[s] + 1) / w[s]), s) for s in w if done[s] < blocks[s] and math.floor((done[s] - first[s]) / w[s]) <= now]
            if not ready:
                break
            s = min(ready)[1]
            out.append((s, done[s]))
            done[s] += 1
    return out


def positions(rows, targets, size):
    """{id: (source, block, slot, position)} of rows (id, source) with distinct ids."""
    order = defaultdict(list)
    for i, s in sorted(rows, key=lambda r: (spark_hash("mix", Long(r[0])) % 2**64, spark_hash("mix", Long(r[0])))):
        order[s or ""].append(i)
    out, at = {}, 0
    for slot, (s, b) in enumerate(slots({s: -(-len(v) // size) for s, v in order.items()}, targets)):
        for i in order[s][b * size : (b + 1) * size]:
            out[i] = (s, b, slot, at)
            at += 1
    return out
