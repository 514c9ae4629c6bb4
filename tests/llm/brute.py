"""Slow, obvious versions of the operators' contracts, over lists of rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def least_reachable(ids, links):
    """Component names by repeated relaxation; ids are positions, links pairs of positions."""
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    out = {}
    for start in range(len(ids)):
        if start in out:
            continue
        seen, todo = {start}, [start]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        named = [ids[x] for x in seen if ids[x] is not None]
        for x in seen:
            out[x] = min(named) if named else None
    return out


def shingles(text, width):
    words = space_words(text)
    if not words:
        return frozenset()
    if len(words) < width:
        return frozenset([tuple(words)])
    return frozenset(zip(*(words[k:] for k in range(width))))


def jaccard_components(rows, width, percent):
    """rows: (doc_id, text); all pairs."""
    sets = [shingles(t, width) for _, t in rows]
    links = []
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                links.append((i, j))
    comp = least_reachable([r[0] for r in rows], links)
    return [(rows[i][0], len(sets[i]), comp[i]) for i in range(len(rows))]


def contamination(docs, items, window=13):
    """docs, items: (id, text)."""
    windows = defaultdict(set)
    for item, text in items:
        words = alnum_words(text)
        size = min(window, len(words))
        for k in range(len(words) - size + 1):
            if size:
                windows[tuple(words[k : k + size])].add(item)
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        words = alnum_words(text)
        hit, found = set(), set()
        for size in sizes:
            for k in range(len(words) - size + 1):
                own = windows.get(tuple(words[k : k + size]))
                if own:
                    hit |= set(range(k, k + size))
                    found |= {x for x in own if x is not None}
        names = ",".join(sorted(map(str, found)))
        out.append(
            (doc, len(words), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words))
        )
    return out


def base_scores(rows):
    """rows: (doc_id, text) -> (doc_id, held_out, n_tokens, n_known, N, base)."""
    held = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows]
    tokens = [[*space_words(t), None] for _, t in rows]
    count = Counter(x for t, h in zip(tokens, held) if not h for x in t)
    n, v = sum(count.values()), len(count)
    return [
        (d, h, len(t), sum(count[x] > 0 for x in t), n, sum(np.log10((count[x] + 1) / (n + v + 1)) for x in t))
        for (d, _), h, t in zip(rows, held, tokens)
    ]


def lm_scores(rows, order=3, modulo=7, held=2):
    """log10 probability of every text by exact counts, their levels and the Witten-Bell rule, a word at a time."""
    texts = [["<", *space_words(t), ">"] for _, t in rows]
    count = [Counter() for _ in range(order + 1)]
    for (d, _), seq in zip(rows, texts):
        if d is None or zlib.crc32(str(d).encode()) % modulo != held:
            for k in range(1, order + 1):
                count[k].update(tuple(seq[i : i + k]) for i in range(len(seq) - k + 1))
    n = sum(c for g, c in count[1].items() if g != ("<",))
    v = len(count[1].keys() - {("<",)})
    level = lambda gram: count[len(gram)][gram].bit_length()
    mean, novel = {}, {}
    for k in range(1, order + 1):
        for at in {level(g) for g in count[k]}:
            same = [g for g in count[k] if level(g) == at]
            mean[k, at] = sum(count[k][g] for g in same) / len(same)
            contexts = [g for g in same if g[-1] != ">"]
            if k < order and contexts:
                novel[k, at] = sum(level(g[:-1]) == at for g in count[k + 1]) / len(contexts)
    out = []
    for seq in texts:
        total = 0.0
        for i in range(1, len(seq)):
            p = (mean.get((1, level((seq[i],))), 0) + 1) / (n + v + 1)
            for k in range(2, min(order, i + 1) + 1):
                gram, context = tuple(seq[i - k + 1 : i + 1]), tuple(seq[i - k + 1 : i])
                before, other = mean.get((k - 1, level(context)), 0.0), novel.get((k - 1, level(context)), 1.0)
                p = (min(mean.get((k, level(gram)), 0.0), before) + other * p) / (before + other)
            total += np.log10(p)
        out.append(total)
    return out
