"""Plain versions of the operators, for comparison on small tables."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(text):
    return ALNUM.findall((text or "").translate(LOWER))


def licence(text):
    words = words_of(text)
    places, labels = [], set()
    for label, phrase in (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")):
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def rules(text):
    text = text or ""
    words = SPACED.findall(text)
    at = defaultdict(list)
    for i in range(len(words) - 4):
        at[tuple(words[i : i + 5])].append(i)
    covered = {j for places in at.values() if len(places) > 1 for i in places for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if SPACED.search(x)]
    n = len(words)
    failed = n < 10 or 100 * len(covered) > 20 * n
    return n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _valid(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(x) <= 255 for x in found.split("."))
    if kind == "card":
        twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(x - 9 * (x > 9) for x in twice) % 10 == 0
    return kind != "phone" or 8 <= len(digits) <= 15


def pii(text):
    spans = [(k, m.start(), m.end()) for k, p in PII.items() for m in re.finditer(p, text or "") if _valid(k, m[0])]
    counts = Counter(k for k, _, _ in spans)
    return tuple(counts[k] for k in PII), hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def covered(data, length):
    """Of each text (bytes by key) a byte mask: 1 where a string that starts twice covers it."""
    seen = Counter(b[i : i + length] for b in data.values() for i in range(len(b) - length + 1))
    out = {}
    for k, b in data.items():
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out[k] = bytes(gone)
    return out


def dedup(texts, length, mark):
    data = {k: (t or "").encode() for k, t in texts.items()}
    cut, shared = covered(data, length), covered(data, mark)
    out = {}
    for k, b in data.items():
        kept = bytes(c for c, g in zip(b, cut[k]) if not g)
        out[k] = (len(b), sum(cut[k]), len(re.findall(b"\1+", cut[k])), hashlib.sha256(kept).hexdigest(), sum(shared[k]))
    return out


def components(texts, width, percent):
    sets = {}
    for k, t in texts.items():
        w = SPACED.findall((t or "").translate(LOWER))
        sets[k] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    holders = defaultdict(list)
    for k, s in sets.items():
        for x in s:
            holders[x].append(k)
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for k, s in sets.items():
        for j, n in Counter(j for x in s for j in holders[x] if j < k).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = find(k), find(j)
                parent[max(a, b)] = min(a, b)
    return {k: (len(s), find(k)) for k, s in sets.items()}


def best_score(text, pieces, unknown):
    """The score of the best segmentation of bytes, whole-text dynamic programming."""
    best = [0.0] + [float("-inf")] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - 64), end):
            if (hit := pieces.get(text[start:end])) is not None:
                best[end] = max(best[end], best[start] + hit[0])
        if end == len(text) or not 0x80 <= text[end] < 0xC0:
            start = end - 1
            while 0x80 <= text[start] < 0xC0:
                start -= 1
            if text[start:end] not in pieces:
                best[end] = max(best[end], best[start] + unknown)
    return best[-1]


def standing_blocks(pages, least):
    """(path, text) of the blocks that stand on as many pages as ``least``."""
    seen = Counter(x for blocks in pages for x in {(b.path, b.text) for b in blocks})
    return {x for x, n in seen.items() if n >= least}


def outliers(rows, ridge, subset, steps, pseudo, scale, rest):
    """Squared robust distances of (text, group, language) rows: concentration from three starts, the least
    determinant of each group, steps until none falls; moments shrunk to the language's, by plain loops."""
    z, dims = [], len(ridge)
    for text, _, _ in rows:
        n, chars, symbols, dup, repeats, _ = rules(text)
        lines = sum(1 for x in (text or "").split("\n") if SPACED.search(x))
        n, per = max(n, 1), lambda a, b: math.log1p(20 * a / max(b, 1))
        z.append([(math.log(max(chars / n, 0.5)) - math.log(5)) * math.sqrt(n / (n + 100)), per(symbols, n), per(dup, lines), per(repeats, n), per(sum(c.isupper() for c in text or ""), chars)])
    z, ridge = np.array(z), np.array(ridge)
    group, lang = np.array([g for _, g, _ in rows]), np.array([x for *_, x in rows])
    groups = sorted(set(group))
    starts = [np.zeros(len(z)) for _ in range(3)]
    for g in groups:
        own = group == g
        low, middle, high = (np.sort(z[own], 0)[math.ceil(q * own.sum()) - 1] for q in (0.25, 0.5, 0.75))
        wide = ((z[own] - middle) / ((high - low) / 1.349 + ridge)) ** 2
        starts[0][own] = (((z[own] - middle) / ridge) ** 2).sum(1)
        starts[1][own], starts[2][own] = wide.sum(1), wide.max(1)
    moments = lambda x: np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])

    def step(d2):
        cell = np.minimum(np.floor(8 * np.log2(1 + 1000 * d2)), 400)
        inside = np.zeros(len(z), bool)
        for g in groups:
            own = np.flatnonzero(group == g)
            cut = np.sort(cell[own])[math.ceil(subset * len(own)) - 1]
            inside[own] = cell[own] <= cut
        whole, out = moments(z[inside]), {}
        for g in groups:
            own = group == g
            near = moments(z[inside & (lang == lang[own][0])])
            near = near + pseudo * whole / max(whole[0], 1)
            sums = moments(z[inside & own]) + pseudo * near / max(near[0], 1)
            mean = sums[1 : 1 + dims] / sums[0]
            cov = scale * (sums[1 + dims :].reshape(dims, dims) / sums[0] - np.outer(mean, mean)) + np.diag(ridge**2)
            out[g] = np.linalg.slogdet(cov)[1], mean, cov
        return out

    def distances(models):
        d2 = np.zeros(len(z))
        for g, (_, mean, cov) in models.items():
            x = z[group == g] - mean
            d2[group == g] = (x * np.linalg.solve(cov, x.T).T).sum(1)
        return d2

    tried = []
    for d2 in starts:
        for _ in range(steps):
            models = step(d2)
            d2 = distances(models)
        tried.append(models)
    best = {g: min((m[g] for m in tried), key=lambda m: m[0]) for g in groups}
    while True:
        new = step(distances(best))
        gain = max(best[g][0] - new[g][0] for g in groups)
        best = {g: min(best[g], new[g], key=lambda m: m[0]) for g in groups}
        if gain < rest:
            return distances(best)


def more_spans(text):
    """Spans of the kinds beside the base ones, with scores from the words around."""
    text = text or ""
    out = []
    for m in re.finditer(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:[ ]?[0-9A-Z]{4}){2,7}(?:[ ]?[0-9A-Z]{1,3})?(?![0-9A-Za-z])", text):
        plain = m[0].replace(" ", "")
        if 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1:
            out.append(("iban", m, 0.9, r"(?i)iban|account|bank", None))
    for m in re.finditer(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", text):
        if not re.match("000|666|9", m[0]) and "-00-" not in m[0] and not m[0].endswith("-0000"):
            out.append(("ssn", m, 0.3, r"(?i)ssn|social|security|tax", None))
    for m in re.finditer(r"(?<![0-9a-fA-F])[0-9a-f]{32,64}(?![0-9a-zA-Z])", text):
        if re.search("[0-9]", m[0]) and re.search("[a-f]", m[0]):
            out.append(("secret", m, 0.3, r"(?i)token|secret|key|passw|auth|bearer", r"(?i)commit|sha|md5|checksum|digest"))
    found = []
    for kind, m, score, up, down in out:
        near = text[max(m.start() - 40, 0) : m.start()] + " " + text[m.end() : m.end() + 40]
        score += 0.3 * bool(re.search(up, near)) - 0.3 * bool(down and re.search(down, near))
        if score >= 0.5:
            found.append((kind, m.start(), m.end()))
    return found


def redacted(text):
    """Marks in place of all spans; a span that begins inside an earlier one is part of it."""
    if not text:
        return text
    spans = [(m.start(), m.end(), k) for k, p in PII.items() for m in re.finditer(p, text) if _valid(k, m[0])]
    out, at = "", 0
    for a, b, kind in sorted(spans + [(a, b, k) for k, a, b in more_spans(text)]):
        if a >= at:
            out += text[at:a] + f"[{kind.upper()}]"
        at = max(at, b)
    return out + text[at:]


def ridge_scores(stats, labels, scorer):
    """Scores by plain matrices over all labelled rows, and isotonic means by the min-max formula."""
    known = [i for i, y in enumerate(labels) if y in (0, 1)]
    x, y = stats[known], np.array([float(labels[i]) for i in known])
    model = scorer(x.mean(0), np.sqrt(np.maximum(x.var(0), 1e-4)))
    phi = model.expand(x)
    penalty = model.ridge * len(x) * np.eye(phi.shape[1]) / (phi.shape[1] - 1)
    penalty[-1, -1] = 1e-9 * len(x)
    model.weight = np.linalg.solve(phi.T @ phi + penalty, phi.T @ y)
    cell = np.floor((model.raw(x) + 0.5) / 2 * model.bins)
    cells = np.unique(cell)
    w, m = np.array([(cell == c).sum() for c in cells]), np.array([y[cell == c].mean() for c in cells])
    part = lambda a, b: np.average(m[a : b + 1], weights=w[a : b + 1])
    fit = [max(min(part(a, b) for b in range(i, len(m))) for a in range(i + 1)) for i in range(len(m))]
    return model, (cells + 0.5) / model.bins * 2 - 0.5, np.array(fit), w


def leaks(texts, items, least=0.6):
    """(text, item) whose words stand in common order, ``least`` of the item's, in some place of at most
    twice the item and a passage; by plain longest common subsequences at every word."""

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
        return row[-1]

    out = set()
    for t, text in texts.items():
        words = ALNUM.findall((text or "").lower())
        for i, item in items.items():
            said = ALNUM.findall(item.lower())
            if len(set(said) & set(words)) < 0.5 * len(set(said)):
                continue
            width = 2 * len(said) + 24
            if any(common(said, words[a : a + width]) >= least * len(said) for a in range(0, max(len(words) - len(said) // 2, 1), 8)):
                out.add((t, i))
    return out
