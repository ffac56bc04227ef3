"""Plain Python forms that several tests compare with."""

import math
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_counts(text):
    text = text or ""
    ws = WORD.findall(text)
    windows = [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]
    seen, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(ws) < 10 or 100 * len(covered) > 20 * len(ws)
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def brute_classes(texts, gram=5, threshold=0.8):
    sets = {}
    for i, t in texts.items():
        ws = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(ws[k : k + gram]) for k in range(max(1, len(ws) - gram + 1))) if ws else frozenset()
    up, links = {i: i for i in texts}, Counter()

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(texts)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if both and both >= threshold * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return {i: (find(i), links[i]) for i in ids}


def cuts(word, index):
    """All ways to cut a word into pieces, a character outside the vocabulary being piece -1."""
    found = {"": [()]}

    def rest(text):
        if text not in found:
            found[text] = [(index[text[:n]], *more) for n in range(1, len(text) + 1) if text[:n] in index for more in rest(text[n:])]
            if text[0] not in index:
                found[text] += [(-1, *more) for more in rest(text[1:])]
        return found[text]

    return rest("▁" + word)


def log_sums(word, index, probs, most):
    """Logarithms of the sums over all cuts of each prefix of a marked word; probs: the unknown character last."""
    s, sums = "▁" + word, [0.0]
    for j in range(1, len(s) + 1):
        terms = [sums[i] + math.log(probs[index[s[i:j]]]) for i in range(max(0, j - most), j) if s[i:j] in index]
        terms += [sums[j - 1] + math.log(probs[-1])] if s[j - 1] not in index else []
        top = max(terms)
        sums.append(top + math.log(sum(math.exp(t - top) for t in terms)))
    return sums


def suffix_sums(word, index, probs, most):
    """The same over the suffixes: place i has all cuts of what follows the first i characters."""
    s = "▁" + word
    sums = [0.0] * (len(s) + 1)
    for i in range(len(s) - 1, -1, -1):
        terms = [sums[j] + math.log(probs[index[s[i:j]]]) for j in range(i + 1, min(len(s), i + most) + 1) if s[i:j] in index]
        terms += [sums[i + 1] + math.log(probs[-1])] if s[i] not in index else []
        top = max(terms)
        sums[i] = top + math.log(sum(math.exp(t - top) for t in terms))
    return sums


def brute_training(texts, pieces, rounds, floor, smooth):
    """Piece probabilities by expectation-maximisation, word by word."""
    index, most = {p: i for i, p in enumerate(pieces)}, max(map(len, pieces))
    counts = Counter(w for t in texts for w in t.lower().split())
    probs = [1 / len(pieces)] * len(pieces) + [floor]
    for _ in range(rounds):
        total = [smooth] * len(pieces)
        for w, c in counts.items():
            s, ahead, back = "▁" + w, log_sums(w, index, probs, most), suffix_sums(w, index, probs, most)
            for j in range(1, len(s) + 1):
                for i in range(max(0, j - most), j):
                    if s[i:j] in index:
                        total[index[s[i:j]]] += c * math.exp(ahead[i] + math.log(probs[index[s[i:j]]]) + back[j] - back[0])
        scale = sum(total)
        probs = [t / scale for t in total] + [floor]
    return probs
