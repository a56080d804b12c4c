"""Plain Python versions of the corpus operators, for small inputs."""

import hashlib
import re

import numpy as np

SPACE = " \t\n\x0b\x0c\r"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def dedup_lines(rows, min_chars=20, min_docs=3):
    """{doc_id: (n_lines, n_dropped, kept)}"""
    holders = {}
    for doc, text in rows:
        for key in {line.translate(UPPER).strip(SPACE) for line in (text or "").split("\n")}:
            if len(key) >= min_chars:
                holders.setdefault(key, []).append(doc)
    result = {}
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = []
        for line in lines:
            have = holders.get(line.translate(UPPER).strip(SPACE), ())
            if len(have) < min_docs or doc == max(have):
                kept.append(line)
        result[doc] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return result


def contamination(rows, items, window=13):
    """{doc_id: (n_words, n_hit, items, contaminated)}"""
    grams = {}
    for item, text in items:
        w = WORD.findall((text or "").translate(UPPER))
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            grams.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    result = {}
    for doc, text in rows:
        w = WORD.findall((text or "").translate(UPPER))
        hit, found = set(), set()
        for n in {len(g) for g in grams}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in grams:
                    hit |= set(range(i, i + n))
                    found |= grams[tuple(w[i : i + n])]
        result[doc] = (len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w))
    return result


def shingle_set(text, size):
    w = [x for x in re.split(f"[{SPACE}]+", (text or "").translate(UPPER)) if x]
    if not w:
        return set()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))}


def near_groups(rows, size, share):
    """{doc_id: component}"""
    sets = {doc: shingle_set(text, size) for doc, text in rows}
    parent = {doc: doc for doc in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    names = sorted(sets)
    for i, a in enumerate(names):
        for b in names[:i]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= share * (len(sets[a]) + len(sets[b]) - common):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {doc: root(doc) for doc in sets}


def remove_repeats(rows, length=100):
    """{doc_id: (n_bytes, n_removed, n_spans, kept)}"""
    seen, result = set(), {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        body = (text or "").encode()
        gone = np.zeros(len(body) + 2, int)
        for i in range(len(body) - length + 1):
            part = body[i : i + length]
            if part in seen:
                gone[i + 1 : i + length + 1] = 1
            seen.add(part)
        kept = bytes(np.frombuffer(body, np.uint8)[gone[1:-1] == 0])
        result[doc] = (len(body), int(gone.sum()), int((np.diff(gone) == 1).sum()), kept)
    return result


def best_pieces(scores, byte_ids, unknown, text):
    """The largest total score of a segmentation, over all of them; a piece is written with spaces."""
    best = [0.0] + [float("-inf")] * len(text)
    for i in range(len(text)):
        single = False
        for j in range(i + 1, len(text) + 1):
            if text[i:j] in scores:
                best[j] = max(best[j], best[i] + scores[text[i:j]])
                single |= j == i + 1
        if not single:
            best[i + 1] = max(best[i + 1], best[i] + unknown)
    return best[-1]
